"""tidepool: document retrieval, fusion and evaluation as DataFrame plans on Spark."""

__version__ = "0.1.0"
