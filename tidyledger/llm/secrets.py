"""Secret scans through nested encodings.

A text is a layer.  A worklist unwraps it: percent escapes, backslash escapes of
characters, base64 runs and gzip or zlib data in any of them; every new layer is
scanned and unwrapped again until no layer is new.  Bytes that are not UTF-8 count as
one character each, so a layer is scanned whatever else it holds; what a broken or
cut-off stream gave is a layer as well.  A layer that was seen before is
not opened again, so cycles end.  Every layer knows the place of each of its
characters in the layer it came from; spans are given in the original text.

Spans are ``kind:start:end`` in code points, end exclusive.  Null counts as empty
text.  Spans found twice, by way of several layers, count once.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidyledger.llm.common import thrifty

KINDS = ("assign", "access", "hex")
# The three patterns and the least length of what they find.
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A
)
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "api")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
# A greedy run of 16 or more is the same as all runs without the short ones.
HEX = re.compile(r"[0-9a-f]{16,}")
LEAST_ASSIGN, LEAST_ACCESS = 12, 18

PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
ESCAPES = re.compile(r"(?:\\u[0-9A-Fa-f]{4}|\\u\{[0-9A-Fa-f]{1,6}\}|\\U[0-9A-Fa-f]{8}|\\x[0-9A-Fa-f]{2})+")
ESCAPE = re.compile(r"\\(?:u\{([0-9A-Fa-f]{1,6})\}|[uUx]([0-9A-Fa-f]+))")
LEAST_BASE64 = 20
BASE64 = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{%d,}={0,2}" % LEAST_BASE64)
# A run that goes on over whole lines; '>' quotes and '#' or '*' comments may stand before them.
WRAPPED = re.compile(
    r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{%d,}(?:[ \t]*\r?\n[ \t>#*]*[A-Za-z0-9+/_-]+)+={0,2}" % LEAST_BASE64
)
BASE64_CHARACTERS = re.compile(r"[A-Za-z0-9+/_-]+")
# Starts of gzip and zlib data; bytes outside UTF-8 are written as U+DC80 and so on.
STREAM = re.compile("\x1f[\x8b\udc8b]\x08|x[\x01^\x9c\xda\udc9c\udcda]")
LAYER_BYTES = 64 << 20  # unpacked data beyond is read in pieces with an overlap
OVERLAP_BYTES = 8 << 20
PIECE = 1 << 20  # characters hashed at a time
STEP = 4096  # characters that are unpacked at once


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(start, kind number, end)`` of the three patterns, leftmost and not overlapping for each kind."""
    spans = []
    lower = text.lower()
    if any(word in lower for word in ASSIGN_WORDS):
        spans += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_ASSIGN]
    if "AKIA" in text:
        spans += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= LEAST_ACCESS]
    spans += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(spans)


class Layer:
    """A text and, for each of its characters, where it starts and ends in the original.

    ``last`` is where its source ends there, padding included, if that is known.
    """

    def __init__(
        self, text: str, starts: np.ndarray | None = None, ends: np.ndarray | None = None, last: int | None = None
    ):
        self.text, self.starts, self.ends, self.last = text, starts, ends, last

    def start(self, place: int) -> int:
        return place if self.starts is None else int(self.starts[place])

    def end(self, place: int) -> int:
        """Where the character before ``place`` ends."""
        return place if self.ends is None else int(self.ends[place - 1])

    def replaced(self, runs: list[tuple[int, int, str, list[tuple[int, int]]]]) -> Layer:
        """This layer with runs ``(start, end, new text, place of each new character)``."""
        text, starts, ends, at = [], [], [], 0
        size = np.arange(len(self.text))
        own = (size if self.starts is None else self.starts, size + 1 if self.ends is None else self.ends)
        for a, b, new, places in runs:
            text += [self.text[at:a], new]
            starts += [own[0][at:a], np.array([own[0][x] for x, _ in places], np.int64)]
            ends += [own[1][at:a], np.array([own[1][y - 1] for _, y in places], np.int64)]
            at = b
        text.append(self.text[at:])
        starts.append(own[0][at:])
        ends.append(own[1][at:])
        return Layer("".join(text), np.concatenate(starts), np.concatenate(ends))


def _decoded(raw: bytes) -> tuple[str, np.ndarray]:
    """Text of bytes, those outside UTF-8 as surrogates, and where each character starts (and the last one ends)."""
    text = raw.decode("utf-8", "surrogateescape")
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = 1 + (codes >= 0x80).astype(np.int64) + (codes >= 0x800) + (codes >= 0x10000)
    sizes[(codes >= 0xDC80) & (codes < 0xDD00)] = 1
    return text, np.concatenate(([0], np.cumsum(sizes)))


def _percent(layer: Layer) -> Iterator[Layer]:
    runs = []
    for m in PERCENT.finditer(layer.text):
        new, at = _decoded(bytes.fromhex(m[0].replace("%", "")))
        at = (m.start() + 3 * at).tolist()
        runs.append((m.start(), m.end(), new, list(zip(at[:-1], at[1:], strict=True))))
    if runs:
        yield layer.replaced(runs)


def _escapes(layer: Layer) -> Iterator[Layer]:
    runs = []
    for m in ESCAPES.finditer(layer.text):
        parts = [(int(x[1] or x[2], 16), m.start() + x.start(), m.start() + x.end()) for x in ESCAPE.finditer(m[0])]
        units, k = [], 0
        while k < len(parts):
            point, a, b = parts[k]
            if 0xD800 <= point < 0xDC00 and k + 1 < len(parts) and 0xDC00 <= parts[k + 1][0] < 0xE000:
                point, b = 0x10000 + ((point - 0xD800) << 10) + parts[k + 1][0] - 0xDC00, parts[k + 1][2]
                k += 1
            units.append((point, a, b))
            k += 1
        if all(x < 0x110000 and not 0xD800 <= x < 0xE000 for x, _, _ in units):
            runs.append((m.start(), m.end(), "".join(chr(x) for x, _, _ in units), [(a, b) for _, a, b in units]))
    if runs:
        yield layer.replaced(runs)


def _bytes_of(text: str, latin: bool) -> tuple[bytes, bool]:
    """Bytes of characters as far as they stand for bytes, and whether all do."""
    try:
        return (text.encode("latin-1") if latin else text.encode("utf-8", "surrogateescape")), True
    except UnicodeEncodeError as error:
        text = text[: error.start]
        return (text.encode("latin-1") if latin else text.encode("utf-8", "surrogateescape")), False


def _unpack(text: str, at: int, latin: bool) -> Iterator[tuple[bytes, int]]:
    """Pieces of the gzip or zlib data that starts at ``at``, each with where the data read so far ends."""
    engine, whole = zlib.decompressobj(wbits=47), True
    while whole and not engine.eof and at < len(text):
        raw, whole = _bytes_of(text[at : at + STEP], latin)
        spare, k = engine.copy(), 0
        try:
            out = engine.decompress(raw)
        except zlib.error:
            # What the bytes before the error give.
            engine, whole, out = spare, False, b""
            try:
                while k < len(raw):
                    out += engine.decompress(raw[k : k + 1])
                    k += 1
            except zlib.error:
                raw = raw[:k]
        read = raw[: len(raw) - len(engine.unused_data)]
        at += len(read) if latin else len(read.decode("utf-8", "surrogateescape"))
        yield out, at


def _compressed(layer: Layer) -> Iterator[Layer]:
    """gzip and zlib data; members that follow each other are one text."""
    at = 0
    while m := STREAM.search(layer.text, at):
        first = end = m.start()
        at = first + 1
        held, fresh = bytearray(), False

        def opened(stop: int) -> Layer:
            text = held.decode("utf-8", "surrogateescape")
            last = layer.end(stop) if layer.last is None or stop < len(layer.text) else layer.last
            starts, ends = (np.broadcast_to(np.int64(x), len(text)) for x in (layer.start(first), last))  # noqa: B023
            return Layer(text, starts, ends)

        while m and m.start() == end:
            latin = "\udc80" > m[0][1] >= "\x80" or (m[0][1] < "\x80" and "\x80" <= max(layer.text[end : end + 64]) < "\u0100")
            for out, stop in _unpack(layer.text, end, latin):
                held += out
                end, fresh = max(end, stop), fresh or bool(out)
                if len(held) >= LAYER_BYTES:
                    yield opened(end)
                    del held[:-OVERLAP_BYTES]
                    fresh = False
            at = max(at, end) if held else at
            m = STREAM.match(layer.text, end) if end > first else None
        if fresh:
            yield opened(end)


def _base64(layer: Layer) -> Iterator[Layer]:
    """Runs on a line and over lines, from each of their first four characters: a payload can begin after others."""
    for pattern in (BASE64, WRAPPED):
        for m in pattern.finditer(layer.text):
            # Where each character of the run stands; nothing but these is decoded.
            pieces = [x.span() for x in BASE64_CHARACTERS.finditer(layer.text, m.start(), m.end())]
            place = np.concatenate([np.arange(a, b) for a, b in pieces])
            run = "".join(layer.text[a:b] for a, b in pieces).replace("-", "+").replace("_", "/")
            for skip in range(4):
                part = run[skip:]
                part = part[: len(part) - (len(part) % 4 == 1)]
                text, at = _decoded(base64.b64decode(part + "=" * (-len(part) % 4)))
                # Three bytes come from four characters; the last group may be shorter.
                first, last = at[:-1], at[1:] - 1
                first = place[skip + first // 3 * 4 + first % 3]
                last = place[skip + last // 3 * 4 + last % 3 + 1]
                starts = first if layer.starts is None else layer.starts[first]
                ends = last + 1 if layer.ends is None else layer.ends[last]
                yield Layer(text, starts, ends, layer.end(m.end()))


def _identity(layer: Layer) -> bytes:
    """Digest of a decoded layer's text and places, read in pieces; unpacked data has one place for all characters."""
    digest = hashlib.sha256()
    for k in range(0, len(layer.text), PIECE):
        digest.update(layer.text[k : k + PIECE].encode("utf-8", "surrogatepass"))
    starts = layer.starts[:1] if layer.starts.strides == (0,) else layer.starts
    for k in range(0, len(starts), PIECE):
        digest.update(starts[k : k + PIECE].tobytes())
    return digest.digest()


def spans(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Spans of the text itself, and those of all layers below it with them."""
    base = base_spans(text)
    every = set(base)
    seen = {hashlib.sha256(text.encode("utf-8", "surrogatepass")).digest()}
    work = [Layer(text)]
    while work:
        layer = work.pop()
        if layer.starts is not None:
            every.update((layer.start(a), kind, layer.end(b)) for a, kind, b in base_spans(layer.text))
        steps = [_base64, _compressed]
        if "%" in layer.text:
            steps.append(_percent)
        if "\\" in layer.text:
            steps.append(_escapes)
        for step in steps:
            for new in step(layer):
                # The same content at another place is another layer.
                if new.text and (key := _identity(new)) not in seen:
                    seen.add(key)
                    work.append(new)
    return base, sorted(every)


def _joined(found: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{a}:{b}" for a, kind, b in found)


def scan(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Counts and spans of every text: base spans as a digest, all spans as text."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            rows = []
            for value in part.column(1):
                base, every = spans(value.as_py() or "")
                counts = [sum(kind == k for _, kind, _ in base) for k in range(len(KINDS))]
                rows.append((*counts, hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(every)))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
            kinds = [pa.int64()] * 3 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays(
                [part.column(0), *[pa.array(x, kind) for x, kind in zip(columns, kinds, strict=True)]],
                names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
            )

    chosen = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).alias("text"))
    return chosen.mapInArrow(
        thrifty(run), "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"
    )
