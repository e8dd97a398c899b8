import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest

from tidepool.llm import alignment, queries

SF = "/root/testdata/sf0.001"
ODD = [
    "a", " a", "a ", "  two  spaces ", "line\nline", "line\n\nline", "\nline", "line\n", "tab\tx \t y", "\r\n a\r\nb", "don't can't I'll 's 's", "naïve café ☕ 日本語 テスト", "<s> </s> <|endoftext|> <0x41> <unk>",
    "x y z", "a　b c", "low ▁ line▁x", "zero​width a​ b", "\x00nul \x1f sep \x85 next", "1234567 89 1,234.5", "a" * 3_000, ("word " * 2_000).strip(), "....!!!???\n---\n===", "é combining", "🇩🇪👩‍👩‍👧 emoji 🙂",
    "UPPER lower MiXeD", "http://x.y/z?a=b&c=d", "﻿bom a", "a \nb", "a\n b", " \n ", "x" * 50 + " " + "y" * 50,
]


@pytest.fixture(scope="module")
def paths():
    return public_tokenizers.path(alignment.BYTE_VOCABULARY), public_tokenizers.path(alignment.PIECE_VOCABULARY)


@pytest.fixture(scope="module")
def plain(paths):
    """Whole texts through both libraries, tokens as bytes, groups by loops."""
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(paths[0])
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=paths[1])
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    chars = {chr(x): x for x in kept} | {chr(256 + i): x for i, x in enumerate(x for x in range(256) if x not in kept)}

    def groups(text):
        if not text:
            return []
        ids_a = a.encode(" " + text, add_special_tokens=False).ids
        ids_b = b.encode(text)
        bytes_a = [bytes(chars[c] for c in a.id_to_token(i)) for i in ids_a]
        bytes_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
        whole = (" " + text).encode()
        if b"".join(bytes_a) != whole or b"".join(bytes_b) != whole:
            return []
        out, i, j, x, y = [], 0, 0, 0, 0
        own_a, own_b = [], []
        while i < len(ids_a) or j < len(ids_b):
            if x <= y and i < len(ids_a):
                own_a.append(ids_a[i])
                x += len(bytes_a[i])
                i += 1
            else:
                own_b.append(ids_b[j])
                y += len(bytes_b[j])
                j += 1
            if x == y:
                out.append((own_a, own_b))
                own_a, own_b = [], []
        return out

    return groups


def _brute(texts, plain):
    every = [plain(t) for t in texts]
    counts = Counter((g[0][-1], g[1][-1]) for groups in every for g in groups)  # no token is empty: one link for each group
    top = defaultdict(int)
    for (_, b), n in counts.items():
        top[b] = max(top[b], n)
    out = []
    for groups in every:
        links = [(g[0][-1], g[1][-1]) for g in groups]
        told = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append((
            sum(len(x) for x, _ in groups), sum(len(y) for _, y in groups), len(groups), len(links), sum(counts[p] == top[p[1]] for p in links),
            sum(counts[p] for p in links), hashlib.sha256(told.encode()).hexdigest() if groups else "",
        ))
    return out


COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def _told(df):
    return sorted(tuple(r[c] for c in ("doc_id", *COLUMNS)) for r in df.collect())


def test_query_against_whole_texts(spark, small, plain):
    rows = small.select("doc_id", "text").orderBy("doc_id").collect()
    want = _brute([r.text for r in rows], plain)
    assert _told(queries.op12_alignment(spark, SF)) == sorted((r.doc_id, *w) for r, w in zip(rows, want, strict=True))


def test_odd_and_random_texts(spark, plain, paths):
    rng = random.Random(3)
    alphabet = ["a", "b", "Word", "the", " ", " ", "  ", "\n", "\n\n", "\t", " ", " ", "1", "23", ".", ",", "'s", "é", "日", "🙂", "▁", "​", "<s>", "-", "_", "\r", "\x1c", "́"]
    texts = ODD + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 30))) for _ in range(1_500)] + [None, "", "a", "a"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = [(i, *w) for i, w in enumerate(_brute(texts, plain))]
    assert _told(alignment.align(docs)) == want
    assert sum(w[1] == 0 for w in want) > 2  # the sign of pieces isn't spelt back
    # vocabularies with more pairs than may be broadcast: the counts are joined
    assert _told(alignment.align(docs, most_pairs=0)) == want


def test_odd_rows(odd_docs, no_docs, plain):
    rows = [(r.doc_id, r.text) for r in odd_docs.select("doc_id", "text").collect()]
    got = alignment.align(odd_docs)
    assert {"lang", "rank", "_row"} <= set(got.columns)
    want = sorted(((i, *w) for (i, _), w in zip(rows, _brute([t for _, t in rows], plain), strict=True)), key=repr)
    assert sorted((tuple(r[c] for c in ("doc_id", *COLUMNS)) for r in got.collect()), key=repr) == want
    assert alignment.align(no_docs).count() == 0


def test_links_expand_all_pairs_at_a_cut():
    """Tokens of no bytes end where the token before them does; all that end at a cut are linked."""
    a_ends, b_ends = np.array([2, 2, 5, 9]), np.array([2, 4, 9, 9, 9])
    cuts, a, b = alignment.cuts_of(a_ends, b_ends)
    assert cuts.tolist() == [2, 9] and a.tolist() == [0, 0, 1, 1] and b.tolist() == [0, 1, 1, 1, 1]
    links = list(zip(*(x.tolist() for x in alignment.links_of(cuts, a_ends, b_ends, a, b)), strict=True))
    assert links == [(0, 0), (1, 0), (3, 2), (3, 3), (3, 4)]


def test_pairs_are_bounded_by_the_vocabularies(spark, small, paths):
    t = alignment.Tokenizers(*paths)
    assert t.cuttable and t.most_pairs() <= 1_000_000 <= alignment.MOST_PAIRS
    pairs = [r.pair for r in alignment.pair_counts(small, paths).collect()]
    assert len(pairs) == len(set(pairs)) <= t.most_pairs()
    for p in pairs:
        a, b = t.a_bytes[p // len(t.b_bytes)], t.b_bytes[p % len(t.b_bytes)]
        assert a.endswith(b) or b.endswith(a)


def test_a_full_cache_changes_nothing(spark, small, monkeypatch, paths):
    own = alignment.Aligner(alignment.Tokenizers(*paths))
    texts = ["one two three", "two three four\nfive", "one one"]
    told = [b";".join(map(own.texts.__getitem__, own.ids(list(own.t.chunks(t))).tolist())) for t in texts]
    own.clear()
    assert [b";".join(map(own.texts.__getitem__, own.ids(list(own.t.chunks(t))).tolist())) for t in reversed(texts)] == told[::-1]


def test_long_texts_go_by_pieces(plain, paths, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(alignment, "_RUN", 64)
    own = alignment.Aligner(alignment.Tokenizers(*paths))
    texts = ["short one", " ".join(f"w{i}" for i in range(500)), None, "end"]
    got = [at[x:y] for at, starts in alignment._texts(own, pa.array(texts)) for x, y in zip(starts, starts[1:], strict=False)]
    for t, at in zip(texts, got, strict=True):
        assert own.numbers()[at, 2].sum() == len(plain(t))
