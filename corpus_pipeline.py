"""A corpus through five operators: language, near copies, benchmark passages, personal data, packing.

Defined cases, stage by stage:

* language ID: null, empty and letterless texts are rejected; equal documents are judged alike, whatever their ids.
* SimHash near-dedup: equal and near-equal texts keep the smallest doc_id, a null one last, of rows that tie the first;
  links chain, so a document may go though it is less alike to the one that stays than to one in between.
* benchmark decontamination: null texts stay null; an item's repeated id stands for all its texts; an empty benchmark
  changes nothing.
* PII: null and empty texts stay as they are; equal values get equal pseudonyms in all documents.
* best-fit packing: a null text is empty and yields the end id alone; only longer documents than a sequence are cut.

Long texts are worked on whole. All stages but the last return the columns of documents, also ones named like an
operator's own; empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidepool.llm import decontaminate, language, packing, pseudonyms, simhash
from tidepool.llm.common import drop_since, materialise, tables_written

#: Documents that fit no learnt language better than this are rejected; texts in one score from 0.38 up.
MIN_LANGUAGE_SCORE = 0.2


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told."""
    return language.keep_known(docs, language.learn(docs), MIN_LANGUAGE_SCORE)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return simhash.near_dedup(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the spans that benchmark items hold; mostly contaminated ones go."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with pseudonyms in place of personal numbers, dates and addresses."""
    return pseudonyms.pseudonymise(docs, pseudonyms.key_of(spark, pseudonyms.DEMONSTRATION_KEY), counts=False)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces and their places in sequences."""
    return packing.pack_documents(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language ID", known_language),
    ("SimHash near-dedup", one_of_each),
    ("benchmark decontamination", without_benchmark),
    ("PII", without_personal_data),
    ("best-fit packing", packed),
]

#: Tokenising, trained profiles and fingerprints have no SQL; tests compare with a plain restatement.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again for the next; what only earlier stages read is deleted on the way."""
    first = tables_written()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialise(docs, name.replace(" ", "-"))
            drop_since(first, docs)
    return docs
