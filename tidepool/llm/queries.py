"""One query for each operator of this folder, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidepool.llm import pseudonyms

    return pseudonyms.pseudonymise(_table(spark, sf_dir, "documents"), pseudonyms.key_of(spark, pseudonyms.DEMONSTRATION_KEY))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidepool.llm import decontaminate

    return decontaminate.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op3_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidepool.llm import neighbours

    return neighbours.search(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidepool.llm import common, language

    docs = _table(spark, sf_dir, "documents")
    found = language.predict(docs, language.learn(docs), ["doc_id"])
    return found.select("doc_id", common.held_out().alias("held_out"), "lang_pred", "score")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidepool.llm import packing

    return packing.pack_documents(_table(spark, sf_dir, "documents"))


def op6_hilbert(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidepool.llm import hilbert

    return hilbert.shard_documents(_table(spark, sf_dir, "documents"))


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidepool.llm import secrets

    return secrets.find(_table(spark, sf_dir, "documents"), ["doc_id"])


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidepool.llm import simhash

    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op9_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidepool.llm import substrings

    return substrings.dedup(_table(spark, sf_dir, "documents"), columns=["doc_id"], texts=False)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidepool.llm import common, quality

    docs = _table(spark, sf_dir, "documents")
    found = quality.score(docs, quality.learn(docs, _table(spark, sf_dir, "labels")), ["doc_id"])
    return found.select("doc_id", common.held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidepool.llm import cuckoo

    return cuckoo.classes(_table(spark, sf_dir, "documents"), ["doc_id"])


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidepool.llm import alignment

    return alignment.align(_table(spark, sf_dir, "documents"), ["doc_id"])


def op13_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidepool.llm import manifest

    return manifest.manifest(_table(spark, sf_dir, "documents"), manifest.tampered())


QUERIES = {
    f.__name__: f
    for f in (
        op1_pseudonyms, op2_decontamination, op3_neighbours, op4_language, op5_packing, op6_hilbert, op7_secrets, op8_simhash,
        op9_substrings, op10_quality, op11_exact_dedup, op12_alignment, op13_manifest,
    )
}
_DARK = "list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')"
_LOW = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

ORACLE_SQL: dict[str, str] = {
    "op2_decontamination": f"""WITH docs AS (SELECT row_number() OVER () AS r, doc_id, {_LOW} AS w FROM documents),
items AS (SELECT item_id::varchar AS item, {_LOW} AS w FROM benchmark WHERE item_id IS NOT NULL),
windows AS (SELECT DISTINCT item, least(10, len(w)) AS n, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') AS s FROM items, unnest(range(1, len(w) - least(10, len(w)) + 2)) t(i) WHERE len(w) > 0),
hits AS (SELECT r, i, n, item FROM (SELECT r, i, n, array_to_string(w[i : i + n - 1], ' ') AS s FROM docs, (SELECT DISTINCT n FROM windows), unnest(range(1, len(w) - n + 2)) t(i)) JOIN windows USING (n, s)),
places AS (SELECT DISTINCT r, unnest(range(i, i + n)) AS j FROM hits),
counts AS (SELECT r, count(*) AS n_hit FROM places GROUP BY r),
found AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT r, item FROM hits) GROUP BY r)
SELECT doc_id, len(w)::bigint AS n_words, coalesce(n_hit, 0)::bigint AS n_hit, coalesce(n_items, 0)::bigint AS n_items, sha256(coalesce(names, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated FROM docs LEFT JOIN counts USING (r) LEFT JOIN found USING (r)""",
    "op9_substrings": f"""WITH docs AS (SELECT row_number() OVER () AS r, doc_id, {_DARK} AS w FROM documents),
windows AS (SELECT r, i, array_to_string(w[i : i + 34], ' ') AS s FROM docs, unnest(range(1, len(w) - 33)) t(i)),
hits AS (SELECT r, i FROM windows JOIN (SELECT s FROM windows GROUP BY s HAVING count(*) > 1) USING (s)),
words AS (SELECT r, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS j FROM docs),
marked AS (SELECT words.r, j, word, coalesce(max(i) OVER (PARTITION BY words.r ORDER BY j) > j - 35, false) AS gone FROM words LEFT JOIN hits ON words.r = hits.r AND words.j = hits.i),
kept AS (SELECT r, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY j) FILTER (NOT gone) AS t FROM marked GROUP BY r)
SELECT doc_id, len(w)::bigint AS n_words, coalesce(n_removed, 0)::bigint AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM docs LEFT JOIN kept USING (r)""",
    "op11_exact_dedup": """SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size, row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))""",
}
