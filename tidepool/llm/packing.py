"""Best-fit packing of tokenised documents into sequences of a fixed capacity, by large-item matching.

Only lengths decide a packing, so the plan is made from the histogram of piece lengths: at most
`capacity` rows, whatever the corpus. Pieces above a third of the capacity are matched first, the
longest with the longest other that still fits, two to a sequence at most; the shorter ones then go,
longest first, where they leave the least room. All pieces of one length move through the plan as
one count, so the plan is a bounded list of runs (length, ranks, sequence numbers, offset), and each
piece finds its run by its rank among the pieces of its length. Ranks need no sort and no window over
pieces: a task numbers its own pieces of each length as it writes them, and the tasks' counts are summed
up, so a length that very many pieces share is no task's alone.

Defined cases: a null text is an empty one and yields the end id alone; only documents longer than
the capacity are cut, at ids, whatever their length; equal rows are pieces of their own; a null doc_id
stays null; columns of docs but doc_id and text are left out, those of pieces that pack() is given stay,
but for sequence_id and offset, which give way to the results. Empty tables give empty results. Words are
cut at ASCII white space before tokenising, which the tokenizer drops anyway.
"""

from __future__ import annotations

import bisect
import os
import zlib
from collections.abc import Iterable, Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidepool.llm.common import bounded_batches, byte_pieces, materialise, plus, strings

CAPACITY = 4096
END_ID = 1
VOCABULARY = "word_bpe_49k.json"
_CACHED = 300_000
_TAILS = {ord("."): 1, ord(","): 2}
#: What a byte-level vocabulary writes for each byte: printable ones stand for themselves, the others follow from U+0100 on.
_PRINTED = {*range(33, 127), *range(161, 173), *range(174, 256)}
_BYTE_CHARS = {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in _PRINTED)}


def tokenizer_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Ids of texts; the ids of each white-space word are looked up, new words are encoded together."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.index: dict[bytes, int] = {}
        self.ids, self.used = np.zeros(1 << 16, np.uint32), 0
        self.starts, self.lens, self.uses = (np.zeros(1 << 14, np.int64) for _ in range(3))
        ends = [self.tokenizer.encode(chr(t), add_special_tokens=False).ids for t in _TAILS]
        if any(len(e) != 1 for e in ends):
            raise ValueError("a full stop and a comma must each be one token")
        self.tails = np.array([0, *(e[0] for e in ends)], np.uint32)

    def _shrink(self) -> None:
        """Keep the half of the words that were used most."""
        kept = np.sort(np.argsort(-self.uses[: len(self.index)], kind="stable")[: _CACHED // 2])
        words, lens = list(self.index), self.lens[kept]
        place = np.arange(int(lens.sum())) + np.repeat(self.starts[kept] - (np.cumsum(lens) - lens), lens)
        ids, uses = self.ids[place], self.uses[kept] // 2
        self.index = {words[i]: n for n, i in enumerate(kept.tolist())}
        self.ids[: len(ids)], self.used = ids, len(ids)
        self.uses[:] = 0
        self.starts[: len(kept)], self.lens[: len(kept)], self.uses[: len(kept)] = np.cumsum(lens) - lens, lens, uses

    def _learn(self, words: list[bytes]) -> None:
        """Words of plain letters, but for case and one mark at the end, are put together from what is known."""
        odd, stems, made, bases, tails = [], [], [], [], []
        for w in words:
            tail = _TAILS.get(w[-1], 0)
            key = w[:-1] if tail else w
            if key.isalpha():  # ASCII letters
                key = key.lower()
            else:
                text = key.decode()
                if not text.isalpha() or max(text) >= "\u0130":
                    odd.append(w)
                    continue
                key = text.lower().encode()
            stems.append(key)
            if key != w:
                made.append(w), bases.append(key), tails.append(tail)
        self._encode_new([w for w in dict.fromkeys(odd) if w not in self.index])
        self._encode_plain([w for w in dict.fromkeys(stems) if w not in self.index])
        if made:
            at = np.fromiter(map(self.index.__getitem__, bases), np.int64, len(bases))
            tail = np.array(tails)
            own, lens = self.lens[at], self.lens[at] + (tail > 0)
            ids = np.zeros(int(lens.sum()), np.uint32)
            starts = np.cumsum(lens) - lens
            place = np.arange(int(own.sum())) - np.repeat(np.cumsum(own) - own, own)
            ids[place + np.repeat(starts, own)] = self.ids[place + np.repeat(self.starts[at], own)]
            ids[(starts + lens - 1)[tail > 0]] = self.tails[tail[tail > 0]]
            self._add(made, lens, ids)

    def _encode_plain(self, words: list[bytes]) -> None:
        """Lower-case letters only: neither normalised nor cut any further, so the model alone encodes them."""
        step = self.tokenizer.model.tokenize
        got = [[t.id for t in step(w.decode() if w.isascii() else w.decode("latin-1").translate(_BYTE_CHARS))] for w in words]
        lens = np.fromiter(map(len, got), np.int64, len(got))
        self._add(words, lens, np.fromiter(chain.from_iterable(got), np.uint32, int(lens.sum())))

    def _encode_new(self, words: list[bytes]) -> None:
        got = [e.ids for e in self.tokenizer.encode_batch_fast([w.decode() for w in words], add_special_tokens=False)]
        lens = np.fromiter(map(len, got), np.int64, len(got))
        self._add(words, lens, np.fromiter(chain.from_iterable(got), np.uint32, int(lens.sum())))

    def _add(self, words: list[bytes], lens: np.ndarray, ids: np.ndarray) -> None:
        n, k = len(self.index), len(ids)
        while n + len(words) > len(self.starts):
            self.starts, self.lens, self.uses = (np.concatenate([a, np.zeros_like(a)]) for a in (self.starts, self.lens, self.uses))
        while self.used + k > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.index.update(zip(words, range(n, n + len(words)), strict=True))
        self.lens[n : n + len(words)] = lens
        self.starts[n : n + len(words)] = self.used + np.cumsum(lens) - lens
        self.ids[self.used : self.used + k] = ids
        self.used += k

    def _encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words, number of ids of each)."""
        at = np.fromiter(map(self.index.get, words, repeat(-1)), np.int64, len(words))
        new = np.flatnonzero(at < 0)
        if len(new):
            if len(self.index) > _CACHED:
                self._shrink()
                at = np.fromiter(map(self.index.get, words, repeat(-1)), np.int64, len(words))
                new = np.flatnonzero(at < 0)
            fresh = [words[i] for i in new]
            self._learn(list(dict.fromkeys(fresh)))
            at[new] = np.fromiter(map(self.index.__getitem__, fresh), np.int64, len(fresh))
        np.add.at(self.uses, at, 1)
        lens = self.lens[at]
        place = np.arange(int(lens.sum())) + np.repeat(self.starts[at] - (np.cumsum(lens) - lens), lens)
        return self.ids[place], lens

    def encode(self, text: str | None) -> np.ndarray:
        return np.concatenate([self._encode(_words(raw))[0] for raw in byte_pieces((text or "").encode())])

    def encode_all(self, texts: Iterable[str | None], most: int = 1 << 19) -> Iterator[np.ndarray]:
        """encode() of each text; short ones are looked up together."""
        words: list[bytes] = []
        sizes: list[int] = []

        def flush() -> Iterator[np.ndarray]:
            ids, lens = self._encode(words)
            ends = np.concatenate([[0], np.cumsum(lens)])[np.cumsum(sizes)]
            return iter(np.split(ids, ends[:-1]))

        held = 0
        for text in texts:
            raw = (text or "").encode()
            if len(raw) > most:
                if sizes:
                    yield from flush()
                    words, sizes, held = [], [], 0
                yield self.encode(text)
                continue
            own = _words(raw)
            words += own
            sizes.append(len(own))
            held += len(raw)
            if held > most:
                yield from flush()
                words, sizes, held = [], [], 0
        if sizes:
            yield from flush()


def _words(raw: bytes) -> list[bytes]:
    """The words of a text at ASCII white space, in lower case where that can't change their ids.

    The tokenizer lower-cases too, but after composing marks (U+0300 to U+037F, bytes CC and CD), which
    some small letters take and their capitals don't, and after finding special tokens.
    """
    return raw.split() if b"\xcc" in raw or b"\xcd" in raw or b"<|" in raw else raw.lower().split()


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


_OWN = "_task int, _rank long"


def _numbered(batches):
    """Batches of pieces with the task's number and each piece's rank among the task's pieces of its length."""
    task = TaskContext.get().partitionId()
    seen: dict[int, int] = {}
    for b in batches:
        length = np.asarray(b.column("length"))
        rank = np.zeros(len(length), np.int64)
        order = np.argsort(length, kind="stable")
        values, first, n = np.unique(length[order], return_index=True, return_counts=True)
        earlier = np.array([seen.get(v, 0) for v in values.tolist()], np.int64)
        rank[order] = np.arange(len(length)) - np.repeat(first - earlier, n)
        seen.update(zip(values.tolist(), (earlier + n).tolist(), strict=True))
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(len(length), task, np.int32)), pa.array(rank)], names=[*b.schema.names, "_task", "_rank"])


def tokenise(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False, numbered: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids; and, numbered, a task and a rank for pack()) of each piece of each document."""
    path = path or tokenizer_path()
    bounded_batches(docs.sparkSession)
    source = docs.select("doc_id", "text")
    names = {"piece": pa.int32(), "start": pa.int64(), "length": pa.int64(), "ids_crc32": pa.int64()} | ({"ids": pa.list_(pa.int32())} if with_ids else {})
    schema = plus(source.drop("text").schema, "piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids)

    def run(batches):
        enc = encoder(path)
        for b in batches:
            rows: dict[str, list] = {k: [] for k in ("row", *names)}
            for i, found in enumerate(enc.encode_all(strings(b.column("text")))):
                ids = np.append(found, np.uint32(end_id)).astype("<u4")
                for p, a in enumerate(range(0, len(ids), capacity)):
                    part = ids[a : a + capacity]
                    for k, v in zip(rows, (i, p, a, len(part), zlib.crc32(part.tobytes()), part.astype(np.int32)), strict=False):
                        rows[k].append(v)
            kept = b.column("doc_id").take(pa.array(rows.pop("row"), pa.int64()))
            yield pa.RecordBatch.from_arrays([kept, *(pa.array(v, names[k]) for k, v in rows.items())], names=["doc_id", *names])

    if not numbered:
        return source.mapInArrow(run, schema)
    return source.mapInArrow(lambda batches: _numbered(run(batches)), plus(schema, _OWN))


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[np.ndarray, int]:
    """(runs, number of sequences); a run: length, first rank, ranks, pieces per sequence, first sequence, offset."""
    left = {n: c for n, c in counts.items() if c}
    used = dict.fromkeys(left, 0)
    runs: list[tuple[int, int, int, int, int, int]] = []
    gaps: dict[int, list[tuple[int, int]]] = {}  # room -> [(first sequence, sequences)]
    rooms: list[int] = []  # those of gaps, sorted
    bins = 0

    def put(n: int, count: int, each: int, first: int, offset: int) -> None:
        runs.append((n, used[n], count, each, first, offset))
        used[n] += count
        left[n] -= count

    def leave(room: int, first: int, count: int) -> None:
        if room and count:
            if room not in gaps:
                gaps[room] = []
                bisect.insort(rooms, room)
            gaps[room].append((first, count))

    large = sorted(n for n in left if 3 * n > capacity)
    while large:
        a = large[-1]
        if not left[a]:
            large.pop()
            continue
        i = bisect.bisect_right(large, capacity - a) - 1
        while i >= 0 and (not left[large[i]] or large[i] == a and left[a] < 2):
            i -= 1
        if i < 0:
            count = left[a]
            put(a, count, 1, bins, 0)
            leave(capacity - a, bins, count)
        else:
            b = large[i]
            count = left[a] // 2 if a == b else min(left[a], left[b])
            put(a, count, 1, bins, 0)
            put(b, count, 1, bins, a)
            leave(capacity - a - b, bins, count)
        bins += count
    for n in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        while left[n]:
            i = bisect.bisect_left(rooms, n)
            if i == len(rooms):
                each = capacity // n
                leave(capacity, bins, -(-left[n] // each))
                bins += -(-left[n] // each)
                continue
            room = rooms[i]
            first, count = gaps[room].pop()
            if not gaps[room]:
                del gaps[room]
                rooms.pop(i)
            each = room // n
            full = min(count, left[n] // each)
            if full:
                put(n, full * each, each, first, capacity - room)
                leave(room - each * n, first, full)
                leave(room, first + full, count - full)
            else:
                some = left[n]
                put(n, some, some, first, capacity - room)
                leave(room - some * n, first, 1)
                leave(room, first + 1, count - 1)
    return np.array(sorted(runs), np.int64).reshape(-1, 6), bins


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """pieces (length and any other columns) with sequence_id and offset."""
    pieces = pieces.drop("sequence_id", "offset", "_task", "_rank")
    return _placed(materialise(pieces.mapInArrow(_numbered, plus(pieces.schema, _OWN)), "pieces"), capacity)


def _placed(pieces: DataFrame, capacity: int) -> DataFrame:
    """A written table of numbered pieces with sequence_id and offset."""
    names = [c for c in pieces.columns if c not in ("_task", "_rank")]
    tasks = pieces.groupBy("length", "_task").agg((F.max("_rank") + 1).alias("n"))
    counts = {r[0]: r[1] for r in tasks.groupBy("length").agg(F.sum("n")).collect()}
    if any(not 0 < n <= capacity for n in counts):
        raise ValueError(f"every length must be from 1 to {capacity}")
    runs, _ = plan(counts, capacity)
    sent = pieces.sparkSession.sparkContext.broadcast(runs)  # a few runs for each of at most `capacity` lengths
    earlier = F.sum("n").over(W.partitionBy("length").orderBy("_task").rowsBetween(W.unboundedPreceding, -1))
    tasks = tasks.select("length", "_task", F.coalesce(earlier, F.lit(0)).alias("_earlier"))
    ranked = pieces.join(tasks, ["length", "_task"]).select(*names, (F.col("_rank") + F.col("_earlier")).alias("_rank"))

    def run(batches):
        table = sent.value
        keys = table[:, 0] << 40 | table[:, 1]
        for b in batches:
            length, rank = (np.asarray(b.column(c)) for c in ("length", "_rank"))
            r = table[np.searchsorted(keys, length.astype(np.int64) << 40 | rank, "right") - 1]
            k = rank - r[:, 1]
            seq, offset = r[:, 4] + k // r[:, 3], r[:, 5] + k % r[:, 3] * length
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(seq, pa.int64()), pa.array(offset, pa.int64())], names=[*names, "sequence_id", "offset"])

    return ranked.mapInArrow(run, plus(ranked.drop("_rank").schema, "sequence_id long, offset long"))


def pack_documents(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """Tokenise docs, write the pieces, and give each its place."""
    return _placed(materialise(tokenise(docs, path, capacity, end_id, with_ids, numbered=True), "pieces"), capacity)


def assemble(packed: DataFrame) -> DataFrame:
    """sequence_id and ids: the packed pieces' ids in order."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda p: p["ids"])).alias("ids"))
