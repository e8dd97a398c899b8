"""Fixed values of the retrieval engine and the shape of its evaluation questions."""

from __future__ import annotations

# Defaults, namespaces, keyword lists and phrases that results depend on.
MIN_TEXT_LEN = 10
RRF_K = 60
DEFAULT_WEIGHT = 0.5
K_RETRIEVER = 5
K_TEXT_MODE = 5
K_CAPTION_MODE = 5
K_VISION_MODE = 3
K_HYBRID_MODE = 3
CANDIDATE_POOL = 20
PER_RETRIEVER = 8
MAX_PAIR_TOKENS = 512
EMBED_BATCH = 8
MAX_CACHED_IMAGES = 3
TEXT_NAMESPACE = "0f4cf7cb-9e3e-4cfa-a5d1-d9b64a4f2fe1"
VISION_NAMESPACE = "18a6e0d2-4c18-4f0e-b0a9-9a8f9f7d4c11"
CAPTION_NAMESPACE = "c1be0a3a-ec0a-44e8-9a45-7e6a5d33b08c"
CHART_KEYWORDS = ("chart", "graph", "trend", "growth", "rate", "yoy", "qoq", "%", "차트", "그래프", "추이", "성장률", "증가율", "변화율")
TABLE_KEYWORDS = ("table", "breakdown", "by region", "by indication", "by segment", "표", "지역별", "부문별")
PROSE_KEYWORDS = ("explain", "describe", "mechanism", "indication", "definition", "summary", "설명", "정의", "요약", "메커니즘")
REFUSAL_KOREAN = "정보를 찾을 수 없습니다."
REFUSAL_ENGLISH = "Not found in the provided pages."
REFUSAL_SIGNS = ("not found", "찾을 수 없", "no information", "not on")
MEDIA_TYPES = {"png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "gif": "image/gif", "webp": "image/webp"}
DOLLARS_PER_MILLION_IN = 1.0
DOLLARS_PER_MILLION_OUT = 5.0

# Values of this engine's own stand-ins.
TF_BUCKETS = 1024
LINES_PER_PAGE = 20

#: Of evaluation questions, as a table or a file holds them.
EVAL_QUESTION = "id STRING, q_ko STRING, q_en STRING, answer STRING, gold_pages ARRAY<STRUCT<source: STRING, page: INT>>, block_type STRING, type STRING, period_spec STRING"
