import pytest

#: Names that operators use for results or inside, to clash with.
CLASHES = ("n_words", "score", "spans", "items", "fp", "node", "key", "shard", "slot", "n_card", "_row", "length", "lang_pred", "kept", "n_key", "rank", "seed", "wide", "m", "q", "_rank")


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Null ids and texts, empty and very long texts, equal rows, ties and clashing extra columns."""
    long = " ".join(f"word{i % 977} the of and" for i in range(30_000))
    texts = [
        (1, "the cat sat on the mat and the dog ran off with it"), (1, "the cat sat on the mat and the dog ran off with it"), (2, None), (None, "the cat sat on the mat and the dog ran off with it"),
        (None, None), (3, ""), (4, " \t\n "), (5, long), (6, long), (7, "12345 !!! 678"), (8, "é" * 3), (9, "    x"), (10, "a"), (11, "a"),
    ]
    rows = [(i, t, ("en", "de", None)[n % 3], None if n % 4 == 0 else "s", n) for n, (i, t) in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for c in CLASHES:
        df = df.selectExpr("*", f"'x' as `{c}`")
    return df


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)


@pytest.fixture(scope="session")
def small(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
