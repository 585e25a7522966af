"""Secret scans: patterns over the text and over every layer that can be decoded from it.

A worklist starts with the text. Each layer is scanned, then unwrapped: URL
escapes and Unicode escapes of the whole layer, base64 runs (of one line, and continued over line
ends, also with quoting marks there), and gzip or zlib data within base64 or URL
escapes. A run may have other characters of the alphabet glued to its front, so
it is decoded from each of its first four characters on.
What comes out is a new layer unless the same string was seen before at the
same places, so equal blobs are all reported and the list ends at a fixpoint.
Every character of a layer knows the span of the text that it comes from;
findings of inner layers are reported by that span. Bytes that are not UTF-8
stand for themselves, so they hide nothing beside them. All that comes out of
compressed data has one place; equal data are unpacked once a document.

A null text is empty. Offsets are code points, the end exclusive. Rows are
independent. Data that inflates to more than ``INFLATE_LIMIT`` bytes is scanned
and unwrapped in steps that overlap, and is reported as a span of kind
``oversize`` besides, so nothing is passed over in silence.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caseframe.llm import spans as S

INFLATE_LIMIT = 8 << 20
STEP, OVERLAP = 1 << 20, 1 << 12
#: Fixed patterns of the base kinds, in their order.
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
ORDER = {k: i for i, k in enumerate((*KINDS, "oversize"))}

URL = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
UNICODE = re.compile(r"(?:\\u[0-9A-Fa-f]{4})+|\\U00[01][0-9A-Fa-f]{5}|\\x[0-9A-Fa-f]{2}|&#[0-9]{1,7};|&#x[0-9A-Fa-f]{1,6};")
BASE64 = re.compile(r"""[A-Za-z0-9+/_-]{16,}(?:["'\\]?[ \t]*\r?\n[ \t>|"']*[A-Za-z0-9+/_-]+)*={0,2}""")
LINE = re.compile(r"[A-Za-z0-9+/_-]+")
LEAST = 16
#: Escaped bytes with the characters that escaping leaves; and where compressed data may begin in bytes.
URL_BYTES = re.compile(r"(?:%[0-9A-Fa-f]{2}|[8HXhx(](?=%))(?:%[0-9A-Fa-f]{2}|[A-Za-z0-9_.~!*'()/+-])+")
PACKED = re.compile(rb"\x1f\x8b\x08|\x78[\x01\x5e\x9c\xda]")
RUN_BYTES = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-\r\n"

#: Linear-time tests: a text that passes none of them has neither findings nor layers.
MAYBE_ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']? *[:=]"""
MAYBE_OTHER = r"AKIA[A-Z0-9]{12}|[0-9a-f]{32}"
MAYBE_LAYER = r"%[0-9A-Fa-f]{2}|\\[uUx][0-9A-Fa-f]{2}|&#[0-9x]|[A-Za-z0-9+/_-]{16}"
MAYBE = re.compile("|".join(("(?i:password|passwd|secret|token|api_?key)", MAYBE_OTHER, MAYBE_LAYER)))


@dataclass
class Layer:
    text: str
    starts: np.ndarray | None = None  # of each character, in the root text; None: the root itself
    ends: np.ndarray | None = None

    def root(self, a: int, b: int) -> tuple[int, int]:
        if self.starts is None:
            return a, b
        return int(self.starts[a:b].min()), int(self.ends[a:b].max())

    def mark(self) -> bytes:
        """Names the text and its places."""
        made = _mark(self.text.encode("utf-8", "surrogatepass"))
        if self.starts is not None:
            made.update(np.ascontiguousarray(self.starts).tobytes() + np.ascontiguousarray(self.ends).tobytes())
        return made.digest()

    def spread(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in the root text of ranges of this layer; both arrays of a layer ascend."""
        return (a, b) if self.starts is None else (self.starts[a], self.ends[b - 1])


@dataclass
class Packed:
    """Compressed data in a range of a layer."""

    data: bytes
    start: int
    end: int


def _mark(data: bytes):
    return hashlib.blake2b(data, digest_size=16)


def base_spans(text: str) -> list[S.Span]:
    """Findings of the base patterns, by start, then kind."""
    found = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text)]
    found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[0], ORDER[s[2]]))


def _decoded(data: bytes, starts: np.ndarray, ends: np.ndarray) -> tuple[str, np.ndarray, np.ndarray]:
    """Text and the source place of each character; a byte that is not UTF-8 is a character of its own."""
    text = data.decode("utf-8", "surrogateescape")
    if len(text) == len(data):
        return text, starts, ends
    sizes = np.array([1 if "\udc80" <= c <= "\udcff" else len(c.encode()) for c in text], np.int64)
    last = np.cumsum(sizes) - 1
    return text, starts[last - sizes + 1], ends[last]


def _url(match: re.Match) -> tuple[str, list[tuple[int, int]]]:
    data = bytes.fromhex(match[0].replace("%", ""))
    at = match.start() + 3 * np.arange(len(data))
    text, starts, ends = _decoded(data, at, at + 3)
    return text, list(zip(starts, ends))


def _unicode(match: re.Match) -> tuple[str, list[tuple[int, int]]] | None:
    code, start = match[0], match.start()
    if code.startswith("\\u"):
        units = [int(x, 16) for x in code.split("\\u")[1:]]
        out, places, k = [], [], 0
        while k < len(units):
            pair = 0xD800 <= units[k] < 0xDC00 and k + 1 < len(units) and 0xDC00 <= units[k + 1] < 0xE000
            value = 0x10000 + ((units[k] - 0xD800) << 10) + units[k + 1] - 0xDC00 if pair else units[k]
            out.append("�" if 0xD800 <= value < 0xE000 else chr(value))
            places.append((start + 6 * k, start + 6 * (k + 1 + pair)))
            k += 1 + pair
        return "".join(out), places
    digits = code.strip("\\UxX&#;")
    value = int(digits, 10 if code.startswith("&#") and code[2] not in "xX" else 16)
    if value > 0x10FFFF or 0xD800 <= value < 0xE000:
        return None
    return chr(value), [match.span()]


def _unescaped(layer: Layer, pattern: re.Pattern, decode) -> Layer | None:
    """The whole layer with its escapes replaced; None without a valid escape."""
    parts: list[str] = []
    begins: list[np.ndarray] = []
    ends: list[np.ndarray] = []
    last = 0
    for m in pattern.finditer(layer.text):
        got = decode(m)
        if got is None:
            continue
        plain = np.arange(last, m.start())
        places = np.array(got[1], np.int64).reshape(-1, 2)
        parts += [layer.text[last : m.start()], got[0]]
        begins += [plain, places[:, 0]]
        ends += [plain + 1, places[:, 1]]
        last = m.end()
    if not parts:
        return None
    plain = np.arange(last, len(layer.text))
    parts.append(layer.text[last:])
    return Layer("".join(parts), *layer.spread(np.concatenate([*begins, plain]), np.concatenate([*ends, plain + 1])))


def _header(data: bytes) -> int:
    """Window bits of a gzip or zlib stream; 0 if it is neither."""
    if data[:2] == b"\x1f\x8b":
        return 31
    return 15 if len(data) > 2 and data[0] & 15 == 8 and int.from_bytes(data[:2], "big") % 31 == 0 else 0


def _inflated(data: bytes) -> Iterator[bytes]:
    """What all members hold, in pieces of ``STEP`` bytes at most, up to a damaged place; then what follows the last member."""
    some = False
    while bits := _header(data):
        worker, rest, done = zlib.decompressobj(bits), data, 0
        try:
            while not worker.eof:
                out = worker.decompress(rest, STEP)
                rest = worker.unconsumed_tail
                if not out and not rest:
                    break
                done += len(out)
                if out:
                    yield out
        except zlib.error:  # the piece before the damaged byte is not lost
            yield from _until_damaged(data, bits, done)
            return
        some = some or done > 0
        data = worker.unused_data.lstrip(b"\0")
    if some and data:
        yield b"\n" + data


def _until_damaged(data: bytes, bits: int, done: int) -> Iterator[bytes]:
    """What comes out of the bytes before the damaged one, after the first ``done`` bytes."""
    worker, held = zlib.decompressobj(bits), bytearray()
    try:
        for k in range(len(data)):
            out = worker.decompress(data[k : k + 1])
            skip = min(done, len(out))
            done -= skip
            held += out[skip:]
            if len(held) >= STEP:
                yield bytes(held)
                held.clear()
    except zlib.error:
        pass
    if held:
        yield bytes(held)


def _windows(data: bytes) -> Iterator[bytes | None]:
    """What compressed data hold, whole; above ``INFLATE_LIMIT`` bytes None, then windows that overlap.

    A base64 run at the end of a window stands whole in the next one, up to the limit.
    """
    held, large, fresh = bytearray(), False, False
    for out in _inflated(data):
        held += out
        fresh = True
        if not large and len(held) > INFLATE_LIMIT:
            large = True
            yield None
        if large:
            yield bytes(held)
            run = len(held) - len(held.rstrip(RUN_BYTES))
            del held[: -max(OVERLAP, run if run <= INFLATE_LIMIT else 0)]
            fresh = False
    if fresh:
        yield bytes(held)


def _blocks(match: re.Match) -> Iterator[tuple[list[tuple[int, int]], int]]:
    """Ranges of lines that may be one base64 string, and its end: each line, lines of one width with a shorter last, and all."""
    lines = [(match.start() + m.start(), match.start() + m.end()) for m in LINE.finditer(match[0])]
    width, n = [b - a for a, b in lines], len(lines)
    ranges = {(i, i + 1) for i in range(n) if width[i] >= LEAST} | {(0, n)}
    i = 0
    while i < n:
        k = i + 1
        while k < n and width[k] == width[i]:
            k += 1
        ranges.add((i, k + (k < n and width[k] < width[i])))
        i = k
    for i, k in sorted(ranges):
        if k - i > 1 or width[i] >= LEAST:
            yield lines[i:k], match.end() if k == n else lines[k - 1][1]


def _base64(layer: Layer) -> Iterator[Layer | Packed]:
    for m in BASE64.finditer(layer.text):
        for lines, end in _blocks(m):
            whole = "".join(layer.text[a:b] for a, b in lines).replace("-", "+").replace("_", "/")
            places = np.concatenate([np.arange(a, b) for a, b in lines]) if len(lines) > 1 else np.arange(*lines[0])
            for shift in range(4):
                body, at = whole[shift:], places[shift:]
                body = body[:-1] if len(body) % 4 == 1 else body
                data = base64.b64decode(body + "=" * (-len(body) % 4))
                for k in sorted({p.start() for p in PACKED.finditer(data)} | ({0} if _header(data) else set())):
                    yield Packed(data[k:], int(at[8 * k // 6]), end)
                bit = np.arange(len(data)) * 8
                value, starts, ends = _decoded(data, at[bit // 6], at[(bit + 7) // 6] + 1)
                if MAYBE.search(value):
                    yield Layer(value, *layer.spread(starts, ends))


def _url_packed(layer: Layer) -> Iterator[Packed]:
    for m in URL_BYTES.finditer(layer.text):
        plain = m[0].replace("+", " ")
        size = np.array([3 if p else 1 for p in (x.startswith("%") for x in re.findall(r"%..|.", plain, re.S))], np.int64)
        data = b"".join(bytes.fromhex(x[1:]) if len(x) == 3 else x.encode() for x in re.findall(r"%..|.", plain, re.S))
        starts = m.start() + np.cumsum(size) - size
        found = {p.start() for p in PACKED.finditer(data)} | ({0} if _header(data) else set())
        for k in sorted(found):
            yield Packed(data[k:], int(starts[k]), m.end())


def _unwrapped(layer: Layer) -> Iterator[Layer | Packed]:
    for pattern, decode in ((URL, _url), (UNICODE, _unicode)):
        if (new := _unescaped(layer, pattern, decode)) is not None:
            yield new
    yield from _base64(layer)
    yield from _url_packed(layer)


def _kinds(data: bytes) -> frozenset[str]:
    """Kinds of all findings in compressed data and in what can be decoded from it."""
    kinds: set[str] = set()
    seen, stack = {_mark(data).digest()}, [_windows(data)]
    while stack:
        window = next(stack[-1], b"")
        if window == b"":
            stack.pop()
            continue
        if window is None:
            kinds.add("oversize")
            continue
        new: list[bytes] = [window] if _header(window) else []
        work = deque([Layer(window.decode("utf-8", "surrogateescape"))])
        while work:
            layer = work.popleft()
            kinds |= {kind for _, _, kind in base_spans(layer.text)}
            for inner in _unwrapped(layer):
                if isinstance(inner, Packed):
                    new.append(inner.data)
                elif (m := _mark(inner.text.encode("utf-8", "surrogatepass")).digest()) not in seen:
                    seen.add(m)
                    work.append(Layer(inner.text))
        for data in new:
            if (m := _mark(b"packed" + data).digest()) not in seen:
                seen.add(m)
                stack.append(_windows(data))
    return frozenset(kinds)


def all_spans(text: str) -> list[S.Span]:
    """Base findings of the text and of all its layers, by start, then kind."""
    found: set[S.Span] = set()
    unpacked: dict[bytes, frozenset[str]] = {}
    ends: dict[tuple[int, str], int] = {}  # of findings in compressed data, which escaped padding may lengthen
    root = Layer(text)
    seen, work = {root.mark()}, deque([root])
    while work:
        layer = work.popleft()
        for a, b, kind in base_spans(layer.text):
            found.add((*layer.root(a, b), kind))
        for new in _unwrapped(layer):
            if isinstance(new, Packed):
                m = _mark(new.data).digest()
                if m not in unpacked:
                    unpacked[m] = _kinds(new.data)
                a, b = layer.root(new.start, new.end)
                for kind in unpacked[m]:
                    ends[a, kind] = max(b, ends.get((a, kind), 0))
            elif (m := new.mark()) not in seen:
                seen.add(m)
                work.append(new)
    found |= {(a, b, kind) for (a, kind), b in ends.items()}
    return sorted(found, key=lambda s: (s[0], ORDER[s[2]], s[1]))


def _scan(batch: pa.RecordBatch, text: str) -> Iterator[tuple[str, list[S.Span], list[S.Span]]]:
    column = batch.column(text)
    direct = [a or b for a, b in zip(S.maybe(column, MAYBE_ASSIGN), S.maybe(column, MAYBE_OTHER))]
    layered = S.maybe(column, MAYBE_LAYER)
    for i in range(len(column)):
        if not direct[i] and not layered[i]:
            yield "", [], []
            continue
        value = column[i].as_py()
        base = base_spans(value) if direct[i] else []
        yield value, base, all_spans(value) if layered[i] else base


def scan(df: DataFrame, text: str = "text", found: str = "secrets") -> DataFrame:
    """All columns, and ``found``: the spans of all findings."""

    def rows(batch: pa.RecordBatch):
        return [[[{"kind": k, "start": a, "end": b} for a, b, k in every] for _, _, every in _scan(batch, text)]]

    return S.with_columns(df, [T.StructField(found, S.SPANS)], rows)


def masked(df: DataFrame, text: str = "text") -> DataFrame:
    """All columns, each finding in ``text`` replaced by its kind in brackets; null stays null."""
    names, schema = df.columns, df.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            old = batch.column(text)
            new = [S.masked(value, every) if every else None for value, _, every in _scan(batch, text)]
            column = pa.array([o if n is None else n for o, n in zip(old.to_pylist(), new)], old.type) if any(n is not None for n in new) else old
            yield pa.RecordBatch.from_arrays([column if n == text else batch.column(n) for n in names], names)

    return df.mapInArrow(run, schema)


def digests(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: base counts by kind, the digest of the base spans, and all spans as text."""
    fields = [T.StructField(f"n_{k}", T.LongType()) for k in KINDS]
    fields += [T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType())]

    def rows(batch: pa.RecordBatch):
        out = [
            (*(sum(s[2] == k for s in base) for k in KINDS), S.digest(base), S.joined(every)) for _, base, every in _scan(batch, text)
        ]
        return list(zip(*out)) if out else [[] for _ in fields]

    return S.with_columns(df.select(F.col(key), F.col(text)), fields, rows, keep=(key,))
