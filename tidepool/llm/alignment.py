"""Cross-tokenizer alignment: two tokenizers' tokens of one text, cut into groups where both end, and linked.

Tokenizer A is a byte-level BPE and sees a space and the text; B is a piece model with byte fallback, which adds that space itself.
NumPy works on byte offsets: a cumulative sum of token lengths gives their ends, intersect1d the common cuts, searchsorted
the group of each token; tokens of A and B that end at one cut are linked, by repeats where several do.

Texts are cut into chunks before they are tokenised: before a space or a line feed that stands alone
between two other characters. Both tokenizers always end a token there (none has a piece that
goes on beyond such a place, which is looked up when they are loaded), so a chunk's tokens, groups and links are the same in
every text. Each distinct chunk is tokenised and aligned once by a task, many at a time; a text is the sum of its chunks.

Corpus-wide counts of linked pairs: a task multiplies each chunk's links by its uses, the sums are shuffled in two stages,
first by (pair, salt) and then by pair, so a pair that every text holds is no single task's. Then texts are read again and
their links looked up. Linked tokens end at one byte, so one is a suffix of the other: there are no more pairs
than the vocabularies' entries have bytes (about half a million for the two public ones), whatever the corpus. That bound is worked out
from the vocabularies; within MOST_PAIRS the counts are broadcast, beyond it they are joined to the texts' pairs.

Defined cases: texts that are null, empty, or that a tokenizer doesn't spell back (space + text) byte by byte have no tokens: zeros,
an empty groups_sha256, and no part in the counts. Rows that repeat count each; strings of special tokens are plain text; long texts are
worked on whole, by chunks. Columns named like a result give way to it. Empty tables give empty results.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepool.llm.common import bounded_batches, materialise, numbered, plus, strings
from tidepool.llm.packing import tokenizer_path

BYTE_VOCABULARY, PIECE_VOCABULARY = "byte_bpe_50k.json", "piece_bpe_32k.model"
MOST_PAIRS = 4_000_000  # pairs of 24 bytes that may be broadcast
SALTS = 32
_CACHED = 400_000  # chunks that a task remembers
_NEW = 4_096  # chunks that are tokenised at a time
_RUN = 1 << 20  # characters of texts that are looked up at a time
#: White space, and what some call so; the sign that stands for a space in pieces.
_W = r"\s\x1c-\x1f\u180e\u200b\ufeff\u2581"
_PLAIN = re.compile(rf"[ \n][^{_W}]+")
_LEAD = " a"  # before a stream of chunks, as the first may begin with a line feed
_CHUNK = re.compile(rf"[ \n][^{_W}]++(?=[ \n][^{_W}]|\Z)|.+?(?<=[^{_W}])(?=[ \n][^{_W}])|.+", re.DOTALL)
#: What a byte-level vocabulary writes for each byte: printable ones stand for themselves, the others follow from U+0100 on.
_PRINTED = {*range(33, 127), *range(161, 173), *range(174, 256)}
_BYTES = {chr(b): b for b in _PRINTED} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in _PRINTED)}


def _spelled(entry: str) -> bytes:
    """The bytes of a byte-level entry; none if it is no such entry."""
    return bytes(_BYTES[c] for c in entry) if all(c in _BYTES for c in entry) else b""


def _ranked(tokenizer, entries: dict[str, int]):
    """A function from a text to the ids of a byte-level BPE whose entries are numbered in the order of their merges: the same ids, a few times as fast.

    None for any other tokenizer.
    """
    import json

    import public_tokenizers
    import tiktoken

    told = json.loads(tokenizer.to_str())
    merges = [m if isinstance(m, str) else "".join(m) for m in told["model"].get("merges", [])]
    kind = told["pre_tokenizer"] or {}
    plain = told["normalizer"] is None and kind.get("type") == "ByteLevel" and kind.get("use_regex", True) and not kind.get("add_prefix_space")
    if not plain or any(entries.get(m.replace(" ", "")) != 256 + i for i, m in enumerate(merges)):
        return None
    ranks = {_spelled(e): i for e, i in entries.items() if _spelled(e) and i < 256 + len(merges)}
    return tiktoken.Encoding("ranked", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


class Tokenizers:
    """Both tokenizers and the bytes of their tokens."""

    def __init__(self, a_path: str, b_path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        entries = self.a.get_vocab()
        self._a_ids = _ranked(self.a, entries)
        self.a_bytes = [b""] * (max(entries.values()) + 1)
        for entry, i in entries.items():
            self.a_bytes[i] = _spelled(entry) or entry.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.space = self.b.piece_to_id("▁")
        plain = [p for i, p in enumerate(pieces) if not (self.b.is_byte(i) or self.b.is_control(i) or self.b.is_unknown(i))]
        #: Whether no piece of B goes on beyond a place where chunks are cut.
        self.cuttable = not any("▁" in p.lstrip("▁") or "\n" in p for p in plain)

    def chunks(self, text: str) -> Iterator[str]:
        """The chunks of a space and a text."""
        if not self.cuttable:
            return iter([" " + text])
        return iter(_CHUNK.findall(" " + text)) if len(text) <= _RUN else (m[0] for m in _CHUNK.finditer(" " + text))

    def encode(self, chunks: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of A and of B of chunks, which begin with the space that B adds, or with a line feed."""
        a = list(map(self._a_ids, chunks)) if self._a_ids else [e.ids for e in self.a.encode_batch_fast(chunks, add_special_tokens=False)]
        b = self.b.encode([c[1:] if c[0] == " " else c for c in chunks], num_threads=1)
        for i, c in enumerate(chunks):
            if c[0] != " ":
                b[i] = b[i][1:] if b[i][:1] == [self.space] else []
        return a, b

    def most_pairs(self) -> int:
        """How many different pairs can be linked: the shorter of two that end together is a suffix of the longer."""
        total = 0
        for many, few in ((self.a_bytes, self.b_bytes), (self.b_bytes, self.a_bytes)):
            ids: dict[bytes, int] = {}
            for x in few:
                ids[x] = ids.get(x, 0) + 1
            total += sum(ids.get(x[i:], 0) for x in many for i in range(len(x) + 1))
        return total


def cuts_of(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(common cuts, group of each A token, group of each B token)."""
    cuts = np.intersect1d(a_ends, b_ends)
    return cuts, np.searchsorted(cuts, a_ends), np.searchsorted(cuts, b_ends)


def links_of(cuts: np.ndarray, a_ends: np.ndarray, b_ends: np.ndarray, a_group: np.ndarray, b_group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the A and B tokens of each link: all pairs that end at one cut."""
    a_at, b_at = np.flatnonzero(a_ends == cuts[a_group]), np.flatnonzero(b_ends == cuts[b_group])
    n_b = np.bincount(b_group[b_at], minlength=len(cuts))
    first_b = np.cumsum(n_b) - n_b
    times = n_b[a_group[a_at]]
    step = np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times)
    return np.repeat(a_at, times), b_at[np.repeat(first_b[a_group[a_at]], times) + step]


class Aligner:
    """The alignment of each chunk met so far: counts, links and the groups as text."""

    def __init__(self, tokenizers: Tokenizers, spelling: bool = True) -> None:
        self.t, self.width, self.spelling = tokenizers, len(tokenizers.b_bytes), spelling
        self.a_size, self.b_size = (np.array(list(map(len, x)), np.int64) for x in (tokenizers.a_bytes, tokenizers.b_bytes))
        self.told = [f"{i}{mark}" for n, marks in ((len(self.a_size), ",|"), (len(self.b_size), ",;")) for mark in marks for i in range(n)]
        self.clear()

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        self.texts: list[bytes] = []
        self.counts: list[np.ndarray] = []  # n_a, n_b, n_groups, n_links, bad
        self.links: list[np.ndarray] = []
        self._told: np.ndarray | None = None

    def ids(self, chunks: list[str]) -> np.ndarray:
        new = [c for c in dict.fromkeys(chunks) if c not in self.index]
        for a in range(0, len(new), _NEW):
            self._learn(new[a : a + _NEW])
        return np.fromiter(map(self.index.__getitem__, chunks), np.int64, len(chunks))

    def numbers(self) -> np.ndarray:
        """A row of counts for each chunk."""
        if self._told is None or len(self._told) < len(self.index):
            self._told = np.concatenate(self.counts) if self.counts else np.zeros((0, 5), np.int64)
            self.counts = [self._told]
        return self._told

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """(codes of all chunks' links, where each chunk's begin)."""
        if len(self.links) > 1:
            self.links = [np.concatenate(self.links)]
        n = self.numbers()[:, 3]
        return (self.links[0] if self.links else np.zeros(0, np.int64)), np.concatenate([[0], np.cumsum(n)])

    def _learn(self, chunks: list[str]) -> None:
        plain = [c for c in chunks if _PLAIN.fullmatch(c)] if self.t.cuttable else []
        if plain and not self._learn_stream(plain):
            plain = []
        others = [c for c in chunks if c not in self.index] if len(plain) < len(chunks) else []
        if not others:
            return
        t = self.t
        a, b = t.encode(others)
        flat_a, flat_b, n_a, n_b = _flat(a, b)
        bad = np.array([b"".join(map(t.a_bytes.__getitem__, x)) != c.encode() or b"".join(map(t.b_bytes.__getitem__, y)) != c.encode() for x, y, c in zip(a, b, others, strict=True)])
        if bad.any():
            flat_a, flat_b, n_a, n_b = _flat(*([[] if no else x for x, no in zip(side, bad, strict=True)] for side in (a, b)))
        self._keep(others, flat_a, flat_b, n_a, n_b, bad)

    def _learn_stream(self, chunks: list[str]) -> bool:
        """Chunks without inner white space as one text, which is cut at every one of them; False if it isn't spelt back."""
        t, stream = self.t, _LEAD + "".join(chunks)
        raw = stream.encode()
        (a,), (b,) = t.encode([stream])
        if b"".join(map(t.a_bytes.__getitem__, a)) != raw or b"".join(map(t.b_bytes.__getitem__, b)) != raw:
            return False
        sizes = np.fromiter(map(len, chunks) if len(raw) == len(stream) else (len(c.encode()) for c in chunks), np.int64, len(chunks))
        edges = len(_LEAD) + np.concatenate([[0], np.cumsum(sizes)])
        sides = []
        for ids, size in ((np.array(a, np.int64), self.a_size), (np.array(b, np.int64), self.b_size)):
            ends = np.cumsum(size[ids])
            at = np.searchsorted(ends, edges)
            if not np.array_equal(ends[at], edges):
                return False
            sides.append((ids[at[0] + 1 :], np.diff(at)))
        (flat_a, n_a), (flat_b, n_b) = sides
        self._keep(chunks, flat_a, flat_b, n_a, n_b, np.zeros(len(chunks), bool))
        return True

    def _keep(self, chunks: list[str], flat_a: np.ndarray, flat_b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, bad: np.ndarray) -> None:
        # The chunks as one stream of bytes: a chunk's end is a cut of both.
        a_ends, b_ends = np.cumsum(self.a_size[flat_a]), np.cumsum(self.b_size[flat_b])
        cuts, a_group, b_group = cuts_of(a_ends, b_ends)
        a_link, b_link = links_of(cuts, a_ends, b_ends, a_group, b_group)
        owner = np.repeat(np.arange(len(chunks)), n_a)
        n_links = np.bincount(owner[a_link], minlength=len(chunks))
        own_group = np.zeros(len(cuts), np.int64)
        own_group[a_group] = owner
        n_groups = np.bincount(own_group, minlength=len(chunks))
        self.links.append(flat_a[a_link] * self.width + flat_b[b_link])
        self.counts.append(np.stack([n_a, n_b, n_groups, n_links, bad], axis=1).astype(np.int64))
        if self.spelling:
            self.texts += self._told_groups(flat_a, flat_b, a_group, b_group, len(cuts), n_groups)
        self.index.update(zip(chunks, range(len(self.index), len(self.index) + len(chunks)), strict=True))

    def _told_groups(self, flat_a: np.ndarray, flat_b: np.ndarray, a_group: np.ndarray, b_group: np.ndarray, n: int, n_groups: np.ndarray) -> list[bytes]:
        """Each chunk's groups as text: A ids | B ids, groups joined by semicolons."""
        n_a, n_b = np.bincount(a_group, minlength=n), np.bincount(b_group, minlength=n)
        before_a, before_b = np.cumsum(n_a), np.cumsum(n_b) - n_b
        told = np.empty(len(flat_a) + len(flat_b), np.int64)  # the string of each token in order: its id and what follows it
        last_a, last_b = (np.append(g[1:] != g[:-1], True)[: len(g)] for g in (a_group, b_group))
        told[np.arange(len(flat_a)) + before_b[a_group]] = flat_a + last_a * len(self.a_size)
        told[np.arange(len(flat_b)) + before_a[b_group]] = 2 * len(self.a_size) + flat_b + last_b * len(self.b_size)
        pieces = list(map(self.told.__getitem__, told.tolist()))
        ends = np.concatenate([[0], np.cumsum(n_a + n_b)])[np.concatenate([[0], np.cumsum(n_groups)])].tolist()
        return ["".join(pieces[x:y])[:-1].encode() for x, y in zip(ends, ends[1:], strict=False)]


def _flat(a: list[list[int]], b: list[list[int]]) -> tuple[np.ndarray, ...]:
    """(A ids, B ids, how many of A, how many of B each list has)."""
    n = [np.fromiter(map(len, x), np.int64, len(x)) for x in (a, b)]
    return *(np.fromiter(chain.from_iterable(x), np.int64, int(k.sum())) for x, k in zip((a, b), n, strict=True)), *n


_loaded: dict[tuple[str, str, bool], Aligner] = {}


def aligner(a_path: str, b_path: str, spelling: bool = True) -> Aligner:
    """This process' aligner of two vocabularies, with or without the groups as text; what it has learnt serves later tasks too."""
    if (a_path, b_path, spelling) not in _loaded:
        _loaded.clear()
        _loaded[a_path, b_path, spelling] = Aligner(Tokenizers(a_path, b_path), spelling)
    return _loaded[a_path, b_path, spelling]


def _texts(own: Aligner, column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(numbers of chunks, where each text's begin) of runs of texts; none of a text that has no tokens."""
    held: list[list[str]] = []
    size = 0

    def told(parts: list[np.ndarray], lens: list[int]):
        at, starts = np.concatenate([*parts, np.zeros(0, np.int64)]), np.concatenate([[0], np.cumsum(lens, dtype=np.int64)])
        wrong = _sums(own.numbers()[at, 4], starts) > 0
        if wrong.any():
            lens = np.where(wrong, 0, np.diff(starts))
            at, starts = at[np.repeat(~wrong, np.diff(starts))], np.concatenate([[0], np.cumsum(lens)])
        return at, starts

    def shorter():
        return told([own.ids(list(chain.from_iterable(held)))], list(map(len, held)))

    for text in strings(column):
        if text and len(text) > _RUN:  # a long text, in pieces of its chunks
            if held:
                yield shorter()
                held, size = [], 0
            chunks, parts = own.t.chunks(text), []
            while piece := list(islice(chunks, _RUN // 8)):
                parts.append(own.ids(piece))
            yield told(parts, [sum(map(len, parts))])
            continue
        held.append(list(own.t.chunks(text)) if text else [])
        size += len(text or "")
        if size > _RUN:
            yield shorter()
            held, size = [], 0
    if held:
        yield shorter()


def _sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The sums of runs of values."""
    total = np.concatenate([np.zeros((1, *values.shape[1:]), np.int64), np.cumsum(values, axis=0)])
    return total[starts[1:]] - total[starts[:-1]]


def _counted(paths: tuple[str, str]):
    """(pair, salt, n): the links of a task's texts."""

    def run(batches):
        own = aligner(*paths, spelling=False)
        uses = np.zeros(0, np.int64)
        salt = TaskContext.get().partitionId() % SALTS

        def told():
            codes, starts = own.pairs()
            n = np.repeat(uses, np.diff(starts)[: len(uses)])
            some = n > 0
            pair, at = np.unique(codes[: len(n)][some], return_inverse=True)
            total = np.bincount(at, n[some], minlength=len(pair)).astype(np.int64)
            for a in range(0, len(pair), 1 << 16):
                part = pair[a : a + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(np.full(len(part), salt, np.int32)), pa.array(total[a : a + (1 << 16)])], names=["pair", "salt", "n"])

        for b in batches:
            for at, _ in _texts(own, b.column("text")):
                more = np.bincount(at, minlength=len(own.index))
                more[: len(uses)] += uses
                uses = more
                if len(own.index) > _CACHED:
                    yield from told()
                    own.clear()
                    uses = np.zeros(0, np.int64)
        yield from told()

    return run


_COUNTS = ["n_a", "n_b", "n_groups", "n_links"]
_RESULTS = (*_COUNTS, "n_best", "count_sum", "groups_sha256")


def _told(names: list[str], paths: tuple[str, str], sent):
    """names of the rows with the counts of their tokens, and where the pairs' counts are sent those of their links."""
    results = (*_COUNTS, "n_best", "count_sum") if sent is not None else tuple(_COUNTS)

    def run(batches):
        own = aligner(*paths)
        worth = np.zeros((0, 2), np.int64)  # of each chunk's links: how many are best, and the sum of their counts
        for b in batches:
            numbers, hashes = [np.zeros((0, len(results)), np.int64)], []
            for at, starts in _texts(own, b.column("text")):
                values = own.numbers()[at, :4]
                if sent is not None:
                    if len(worth) < len(own.texts):
                        pairs, n, best = sent.value
                        codes, first = own.pairs()
                        first = first[len(worth) :]
                        place = np.minimum(np.searchsorted(pairs, codes[first[0] :]), len(pairs) - 1)  # links that no text with tokens has are in no count
                        worth = np.concatenate([worth, _sums(np.stack([best[place], n[place]], axis=1), first - first[0])])
                    values = np.concatenate([values, worth[at]], axis=1)
                numbers.append(_sums(values, starts))
                for x, y in zip(starts.tolist(), starts[1:].tolist(), strict=False):
                    hashes.append(hashlib.sha256(b";".join(map(own.texts.__getitem__, at[x:y].tolist()))).hexdigest() if y > x else "")
                if len(own.texts) > _CACHED:
                    own.clear()
                    worth = worth[:0]
            columns = np.concatenate(numbers).T
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), *map(pa.array, columns), pa.array(hashes, pa.string())], names=[*names, *results, "groups_sha256"])

    return run


def _row_pairs(paths: tuple[str, str]):
    """(_row, pair, times): the links of each text."""

    def run(batches):
        own = aligner(*paths, spelling=False)
        for b in batches:
            rows, done = np.asarray(b.column("_row")), 0
            for at, starts in _texts(own, b.column("text")):
                codes, first = own.pairs()
                for x, y in zip(starts.tolist(), starts[1:].tolist(), strict=False):
                    n = np.diff(first)[at[x:y]]
                    place = np.repeat(first[at[x:y]] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
                    pair, times = np.unique(codes[place], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(pair), rows[done])), pa.array(pair), pa.array(times.astype(np.int64))], names=["_row", "pair", "times"])
                    done += 1
                if len(own.index) > _CACHED:
                    own.clear()

    return run


def pair_counts(docs: DataFrame, paths: tuple[str, str]) -> DataFrame:
    """(pair, n): how many links of all texts join each pair; pair is the A id times B's vocabulary plus the B id."""
    bounded_batches(docs.sparkSession)
    parts = docs.select("text").mapInArrow(_counted(paths), "pair long, salt int, n long")
    salted = parts.groupBy("pair", "salt").agg(F.sum("n").alias("n"))
    return salted.groupBy("pair").agg(F.sum("n").alias("n"))


def align(docs: DataFrame, columns: list[str] | None = None, paths: tuple[str, str] | None = None, most_pairs: int = MOST_PAIRS) -> DataFrame:
    """columns of docs (all but text by default) with n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256."""
    spark = docs.sparkSession
    bounded_batches(spark)
    paths = paths or (tokenizer_path(BYTE_VOCABULARY), tokenizer_path(PIECE_VOCABULARY))
    names = [c for c in (docs.columns if columns is None else columns) if c != "text" and c not in _RESULTS]
    own = Tokenizers(*paths)
    width = len(own.b_bytes)
    counts = materialise(pair_counts(docs, paths), "pairs")
    top = counts.groupBy((F.col("pair") % width).alias("b")).agg(F.max("n").alias("top"))
    judged = counts.join(top, F.col("pair") % width == F.col("b")).select("pair", "n", (F.col("n") == F.col("top")).cast("long").alias("best"))
    quoted = [F.col("`" + c.replace("`", "``") + "`").alias(f"_own{i}") for i, c in enumerate(names)]
    back = [F.col(f"_own{i}").alias(c) for i, c in enumerate(names)]
    if own.most_pairs() <= most_pairs:
        table = judged.toArrow().sort_by("pair")  # no more rows than the vocabularies allow
        sent = spark.sparkContext.broadcast(tuple(np.asarray(table[c].combine_chunks()) if len(table) else np.zeros(1, np.int64) for c in ("pair", "n", "best")))
        source = docs.select(*quoted, "text")
        held = source.columns[:-1]
        ddl = ", ".join([*(f"{c} long" for c in _RESULTS[:-1]), "groups_sha256 string"])
        done = source.mapInArrow(_told(held, paths, sent), plus(source.select(*held).schema, ddl))
        return done.select(*back, *_RESULTS)
    base = numbered(docs.select(*quoted, "text"), "documents")
    held = [c for c in base.columns if c != "text"]
    ddl = ", ".join([*(f"{c} long" for c in _COUNTS), "groups_sha256 string"])
    told = base.select(*held, "text").mapInArrow(_told(held, paths, None), plus(base.select(*held).schema, ddl))
    pairs = base.select("_row", "text").mapInArrow(_row_pairs(paths), "_row long, pair long, times long")
    sums = pairs.join(judged, "pair").groupBy("_row").agg(F.sum(F.col("times") * F.col("best")).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum"))
    filled = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_best", "count_sum")]
    return told.join(sums, "_row", "left").select(*back, *_COUNTS, *filled, "groups_sha256")
