import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from tidepool.llm import manifest, queries

SF = "/root/testdata/sf0.001"
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def _h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def _tree(nodes):
    """(last node, for each leaf its siblings and its place in each run, level by level)."""
    paths = [[] for _ in nodes]
    at = list(range(len(nodes)))
    while len(nodes) > 1:
        for leaf, i in enumerate(at):
            run = nodes[i // 3 * 3 : i // 3 * 3 + 3]
            paths[leaf].append((run[: i % 3], run[i % 3 + 1 :]))
        nodes = [_h(*nodes[a : a + 3]) for a in range(0, len(nodes), 3)]
        at = [i // 3 for i in at]
    return nodes[0], paths


def _brute(rows):
    sources = {}
    for r in rows:
        own = _h(*(_field(r[c]) for c in FIELDS))
        text = r["text"]
        if r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 2 == 0 and text is not None:
            text = text.replace("\n", "")
        other = _h(*(_field(text if c == "text" else r[c]) for c in FIELDS))
        sources.setdefault(r["source"], []).append((r["doc_id"] is not None, r["doc_id"] or 0, own, other))
    names = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    if not names:
        return []
    trees = {s: _tree([x[2] for x in sorted(sources[s])]) for s in names}
    root, above = _tree([trees[s][0] for s in names])
    out = []
    for s, up in zip(names, above, strict=True):
        subroot, paths = trees[s]
        for (known, doc_id, own, other), path in zip(sorted(sources[s]), paths, strict=True):
            fold = other
            for left, right in path + up:
                fold = _h(*left, fold, *right)
            proof = _h(*(d for left, right in path + up for d in left + right))
            out.append((doc_id if known else None, own, subroot, root, proof, fold, fold == root))
    return sorted(out, key=repr)


COLUMNS = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def _told(df):
    assert df.columns == list(COLUMNS)
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_query_against_brute_force(spark, small):
    got = _told(queries.op13_manifest(spark, SF))
    assert got == _brute(small.collect())
    assert {r[-1] for r in got} == {True, False} and len({r[3] for r in got}) == 1


@pytest.mark.parametrize(("fan", "levels"), [(3, 1), (3, 2), (3, 6)])
def test_supersteps_of_any_height_give_the_same(spark, small, fan, levels):
    some = small.where("doc_id % 3 = 0")
    assert _told(manifest.manifest(some, manifest.tampered(), fan=fan, levels=levels)) == _brute(some.collect())


@pytest.mark.parametrize("n", [1, 2, 3, 4, 9, 10, 27, 28, 81, 82, 83, 244, 250])
def test_sizes_around_full_trees(spark, n):
    rng = random.Random(n)
    rows = [(i, None if i % 5 == 0 else f"s{rng.randrange(3)}", "en", i, f"line {i}\nmore") for i in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    assert _told(manifest.manifest(docs, manifest.tampered())) == _brute(docs.collect())
    one = docs.withColumn("source", F.lit("only"))
    assert _told(manifest.manifest(one, manifest.tampered())) == _brute(one.collect())


def test_many_sources_and_a_hot_one(spark):
    rows = [(i, "hot" if i % 3 == 0 else f"é{i % 400:03d}", None, None, f"t{i}\n") for i in range(1_500)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").repartition(7)
    assert _told(manifest.manifest(docs, manifest.tampered())) == _brute(docs.collect())


def test_odd_rows(odd_docs, no_docs):
    assert _told(manifest.manifest(odd_docs, manifest.tampered())) == _brute(odd_docs.collect())
    assert manifest.manifest(no_docs, manifest.tampered()).count() == 0
    whole = manifest.manifest(odd_docs).collect()  # nothing is tampered with
    assert all(r.verified and r.folded_root == r.root for r in whole)


def test_a_single_row_is_its_own_root(spark):
    docs = spark.createDataFrame([(7, None, "en", 3, "a\nb")], "doc_id long, source string, lang string, n_chars long, text string")
    r = manifest.manifest(docs).first()
    assert r.leaf == r.subroot == r.root == _h("1:7", "-", "2:en", "1:3", "3:a\nb") and r.proof_sha256 == _h()


def test_any_change_shows(spark, small):
    base = manifest.manifest(small).first().root
    other = small.withColumn("lang", F.when(F.col("doc_id") == 5, "xx").otherwise(F.col("lang")))
    assert manifest.manifest(other).first().root != base and manifest.manifest(small.repartition(5)).first().root == base
