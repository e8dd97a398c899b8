"""Secret scans with structural confirmation: candidates are decoded and parsed before they are reported.

Base kinds (assign, access, hex) are found by pattern. The method adds kinds that only structure can
confirm: `jwt`, a signed token, i.e. three runs joined by dots of which the first two decode to JSON objects
and the first names an algorithm, white space in it or not; `key`, which decodes to a private key:

* DER whose nested lengths fill each other exactly in the shape of PKCS #1, PKCS #8 or SEC 1, or an OpenSSH
  key whose length-prefixed fields do;
* in base64 that may be wrapped over lines, at real breaks or ones escaped as in JSON, and glued to other
  base64 characters on both sides, since DER tells its own length: parsing begins at every place that
  spells a sequence's first bytes;
* in hex, or as the body of a PEM block, plain or escaped, with headers or none. The body of an encrypted
  one of the old kind (Proc-Type, DEK-Info) can't be parsed; whole cipher blocks confirm it.

Byte searches at memory speed (keywords, runs of hex or base64 characters) decide which texts the
patterns see at all, so what is reported doesn't depend on them.

Defined cases: null text is empty and holds nothing; spans are code points, end exclusive; equal rows
each get a row; a span may be of several kinds; long texts are scanned whole, in time that grows with
their length, as a key in base64 is no longer than 128 KiB; input columns named like a result (n_<kind>, base_sha256, spans) give way to it. Empty
tables give empty results.
"""

from __future__ import annotations

import base64
import binascii
import bisect
import hashlib
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from tidepool.llm.common import bounded_batches, plus, strings

KINDS = ("assign", "access", "hex", "jwt", "key")
_ORDER = {k: i for i, k in enumerate(KINDS)}
_ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
_DOTTED = re.compile(r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]++(?:\.[A-Za-z0-9_-]*+){2,}")  # from where a run begins, so that each is looked at once
_BREAK = re.compile(r"(?:\\{1,2}r)?\\{1,2}n[ \t]*|\r?\n[ \t]*")
_STREAM = re.compile(r"[A-Za-z0-9+/_-]{16,}(?:(?:(?:\\{1,2}r)?\\{1,2}n[ \t]*|\r?\n[ \t]*)[A-Za-z0-9+/_-]+)*")
_OPENINGS = re.compile("M[A-P]|b3BlbnNzaC1rZXktdjEA")  # a DER sequence, OpenSSH's magic
_LONG_HEX = re.compile(r"[0-9a-fA-F]{64,}")
_BEGIN = re.compile(r"-----BEGIN ([A-Z0-9 ]{1,40})-----")
_ESCAPED = re.compile(r"\\{1,2}[nrt]")
_HEADER = re.compile(r"[A-Za-z-]+: ")
_MOST_KEY = 1 << 17  # bytes; the numbers of a key four times as long as any in use take less
_WORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
_HEX_MAP = bytes(120 if chr(c) in "0123456789abcdef" else 32 for c in range(256))
_BASE64_MAP = bytes(120 if c < 128 and (chr(c).isalnum() or chr(c) in "+/_-") else 46 if c == 46 else 32 for c in range(256))


def _der(data: bytes, at: int, end: int) -> Iterator[tuple[int, int, int]]:
    """(tag, start, end) of the values in data[at:end]; ValueError where lengths don't fit."""
    while at < end:
        if at + 2 > end:
            raise ValueError
        tag, n = data[at], data[at + 1]
        at += 2
        if n >= 128:
            k = n - 128
            if not 1 <= k <= 4 or at + k > end:
                raise ValueError
            n = int.from_bytes(data[at : at + k], "big")
            at += k
        if at + n > end:
            raise ValueError
        yield tag, at, at + n
        at += n


def is_der_key(data: bytes) -> bool:
    """A private key in PKCS #1, PKCS #8 (encrypted too) or SEC 1 form that fills data exactly."""
    if len(data) < 16 or data[0] != 0x30:
        return False
    try:
        whole = list(_der(data, 0, len(data)))
        if len(whole) != 1:
            return False
        parts = list(_der(data, whole[0][1], whole[0][2]))
        tags = [t for t, _, _ in parts]
        if len(parts) >= 9 and tags[:9] == [2] * 9:
            return True
        if tags[:3] == [2, 0x30, 4]:
            return [t for t, _, _ in _der(data, *parts[1][1:])][:1] == [6]
        if tags[:2] == [2, 4]:
            return parts[0][2] - parts[0][1] == 1 and data[parts[0][1]] == 1
        if tags == [0x30, 4]:
            return [t for t, _, _ in _der(data, *parts[0][1:])][:1] == [6]
    except ValueError:
        pass
    return False


def _ssh_end(data: bytes) -> int:
    """Where an OpenSSH private key (magic, then length-prefixed fields) at the start of data ends; 0 if there is none, -1 if data is too short to tell."""
    magic = b"openssh-key-v1\0"
    if not data.startswith(magic):
        return 0
    at, fields, last = len(magic), 0, 6
    while fields < last:
        if at + 4 > len(data):
            return -1
        n = int.from_bytes(data[at : at + 4], "big")
        if n > _MOST_KEY:
            return 0
        if fields == 3:  # the number of keys: as many public ones, then the private part
            if not 1 <= n <= 16:
                return 0
            at, fields, last = at + 4, 4, 5 + n
            continue
        at += 4 + n
        fields += 1
    return at if at <= len(data) else -1


def is_ssh_key(data: bytes) -> bool:
    """An OpenSSH private key that fills data exactly."""
    return len(data) > 0 and _ssh_end(data) == len(data)


def _decode64(s: str) -> bytes:
    s = s.rstrip("=").translate({45: 43, 95: 47})
    if len(s) % 4 == 1:
        return b""
    try:
        return base64.b64decode(s + "=" * (-len(s) % 4), validate=True)
    except (binascii.Error, ValueError):
        return b""


def _is_object(part: str, needs: str | None = None) -> bool:
    try:
        got = json.loads(_decode64(part))
    except (ValueError, RecursionError):
        return False
    return isinstance(got, dict) and (needs is None or isinstance(got.get(needs), str))


def _tokens(text: str) -> Iterator[tuple[int, int]]:
    """Spans of signed tokens."""
    for m in _DOTTED.finditer(text):
        parts = m[0].split(".")
        starts = [m.start()]
        for part in parts:
            starts.append(starts[-1] + len(part) + 1)
        i = 0
        while i + 2 < len(parts):
            head = parts[i]
            glued = [k for k in (0, head.find("eyJ")) if k >= 0]
            skip = next((k for k in glued if head[k : k + 1] and head[k] in "eICD" and _is_object(head[k:], "alg")), None)
            if skip is not None and _is_object(parts[i + 1]):
                yield starts[i] + skip, starts[i + 2] + len(parts[i + 2])
                i += 3
            else:
                i += 1


def _key_end(stream: str, a: int) -> int:
    """Where a private key in base64 that begins at a place of a stream ends; 0 if there is none."""
    if stream[a] == "b":
        for most in (1 << 12, 2 * _MOST_KEY):
            part = stream[a : a + most]
            n = _ssh_end(_decode64(part[: len(part) - (len(part) % 4 == 1)]))
            if n >= 0:
                break
    else:
        head = _decode64(stream[a : a + 16])
        if len(head) < 12 or head[0] != 0x30:
            return 0
        k = head[1] - 128 if head[1] >= 128 else 0
        if k > 4 or head[2 + k] not in (2, 0x30):
            return 0
        n = 2 + k + (int.from_bytes(head[2 : 2 + k], "big") if k else head[1])
    chars = -(-n * 4 // 3)
    if not 0 < n <= _MOST_KEY or a + chars > len(stream):
        return 0
    data = _decode64(stream[a : a + chars])[:n]
    return a + chars if is_der_key(data) or is_ssh_key(data) else 0


def _keys(text: str) -> Iterator[tuple[int, int]]:
    """Spans of private keys in base64."""
    for m in _STREAM.finditer(text):
        pieces, at = [], m.start()
        for cut in (*_BREAK.finditer(text, m.start(), m.end()), None):
            end = m.end() if cut is None else cut.start()
            pieces.append((at, text[at:end]))
            at = end if cut is None else cut.end()
        stream = "".join(p for _, p in pieces)
        if len(stream) < 40:
            continue
        ends = [0]
        for _, p in pieces:
            ends.append(ends[-1] + len(p))

        def place(i: int, ends=ends, pieces=pieces) -> int:
            j = bisect.bisect_right(ends, i) - 1
            return pieces[j][0] + i - ends[j]

        last = 0
        for o in _OPENINGS.finditer(stream):
            if o.start() >= last and (end := _key_end(stream, o.start())):
                last, stop = end, place(end - 1) + 1
                if end == len(stream):
                    stop += len(text[stop : stop + 2]) - len(text[stop : stop + 2].lstrip("="))
                yield place(o.start()), stop


def _blocks(text: str) -> Iterator[tuple[int, int]]:
    """Spans of PEM blocks that hold a private key."""
    begins = list(_BEGIN.finditer(text))
    for i, m in enumerate(begins):
        close = f"-----END {m[1]}-----"
        at = text.find(close, m.end(), begins[i + 1].start() if i + 1 < len(begins) else len(text))
        if at < 0:
            continue
        lines = [line.strip() for line in _ESCAPED.sub("\n", text[m.end() : at]).splitlines()]
        headers = [line for line in lines if _HEADER.match(line)]
        data = _decode64("".join(line for line in lines if not _HEADER.match(line)))
        sealed = m[1].endswith("PRIVATE KEY") and any("ENCRYPTED" in h for h in headers) and any(h.startswith("DEK-Info") for h in headers)
        if is_der_key(data) or is_ssh_key(data) or sealed and len(data) >= 32 and len(data) % 8 == 0:
            yield m.start(), at + len(close)


def scan(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) of all secrets of a text, by start, then kind."""
    text = text or ""
    raw = text.encode()
    found: list[tuple[str, int, int]] = []
    low = raw.lower()
    if any(w in low for w in _WORDS):
        found += [("assign", *m.span()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if b"AKIA" in raw:
        found += [("access", *m.span()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    if b"x" * 24 in raw.translate(_HEX_MAP):
        found += [("hex", *m.span()) for m in _HEX.finditer(text)]
    runs = raw.translate(_BASE64_MAP)
    if b"x" * 12 + b".x" in runs:  # a header, and a payload that isn't empty
        found += [("jwt", *s) for s in _tokens(text)]
    blocks = list(_blocks(text)) if b"-----BEGIN" in raw else []
    keys = set(blocks)
    if b"x" * 16 in runs:
        keys |= {s for s in _keys(text) if not any(a <= s[0] and s[1] <= b for a, b in blocks)}
        keys |= {m.span() for m in _LONG_HEX.finditer(text) if len(m[0]) % 2 == 0 and is_der_key(bytes.fromhex(m[0]))}
    found += [("key", *s) for s in keys]
    return sorted(found, key=lambda s: (s[1], _ORDER[s[0]], s[2]))


def told(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def find(docs: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """columns of docs (all but text by default) with n_<kind>, base_sha256 and spans."""
    own = {"text", "base_sha256", "spans", *(f"n_{k}" for k in KINDS)}
    names = [c for c in (docs.columns if columns is None else columns) if c not in own]
    bounded_batches(docs.sparkSession)
    source = docs.select(*names, "text")
    results = [*(f"n_{k}" for k in KINDS), "base_sha256", "spans"]

    def run(batches):
        for b in batches:
            got: list[list] = [[] for _ in results]
            for text in strings(b.column("text")):
                spans = scan(text)
                for i, k in enumerate(KINDS):
                    got[i].append(sum(s[0] == k for s in spans))
                got[-2].append(hashlib.sha256(told([s for s in spans if _ORDER[s[0]] < 3]).encode()).hexdigest())
                got[-1].append(told(spans))
            kinds = [pa.int64()] * len(KINDS) + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), *map(pa.array, got, kinds)], names=[*names, *results])

    ddl = ", ".join([*(f"n_{k} long" for k in KINDS), "base_sha256 string", "spans string"])
    return source.mapInArrow(run, plus(source.select(*names).schema, ddl))
