"""Operator 1: secret scans through encoded layers.

A worklist starts with the text. Each layer is scanned, then unwrapped: percent escapes, Unicode and character
escapes, base64 runs, and compressed data inside base64 give further layers, until no layer yields a new one. A
layer that was seen before at the same place is not entered again (cycle detection), so self-reproducing archives
end. Every layer carries, per character, the span of the original text that it came from; findings in decoded
layers are reported by that span.

Of escapes inside escapes, the first ``ESCAPE_LAYERS`` layers are scanned each; from there on they are decoded to the end
in one linear pass and its result is scanned, so a text of nested escapes takes linear time. Findings hold no escape,
so only one that a deeper layer destroys (hex digits taken up by a completed escape) shows in the skipped layers alone.

Defined results: a null or empty text has no findings; equal findings of several layers count once; texts are
scanned whole. Decoded base64 is a layer if it is
UTF-8 with at most 5 % control characters. Base64 that is wrapped over lines is joined; all members of compressed data are read. Compressed data
that inflates to more than ``max_layer`` bytes is scanned as a stream in windows of that size that overlap, so memory is
bounded and nothing is cut off; ``n_limited`` reports such layers. Only an encoded run inside them that is longer than
the overlap and lies across the end of a window is seen in two parts.
"""

from __future__ import annotations

import base64
import binascii
import bz2
import hashlib
import io
import lzma
import re
import zlib
from array import array
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from sitegraph.llm.common import slices
from sitegraph.plans.tables import table

KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))""")
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
ESCAPE = re.compile(r"(?:\\u[0-9A-Fa-f]{4}|\\x[0-9A-Fa-f]{2}|\\U[0-9A-Fa-f]{8}|&#[0-9]{1,7};|&#[xX][0-9A-Fa-f]{1,6};)+")
ESCAPED = re.compile(r"\\u([0-9A-Fa-f]{4})|\\x([0-9A-Fa-f]{2})|\\U([0-9A-Fa-f]{8})|&#([0-9]{1,7});|&#[xX]([0-9A-Fa-f]{1,6});")
#: An escape at the end of a stretch; all escapes have at most ten characters and end in one of ``CLOSING``.
LAST = re.compile(r"(?:&#([0-9]{1,7});|&#[xX]([0-9A-Fa-f]{1,6});|%([0-9A-Fa-f]{2})|\\u([0-9A-Fa-f]{4})|\\x([0-9A-Fa-f]{2})|\\U([0-9A-Fa-f]{8}))\Z")
CLOSING = frozenset("0123456789abcdefABCDEF;")
BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
#: A run up to the end of its line and lines of such runs alone, the last perhaps before a closing mark.
WRAPPED = re.compile(r"""(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}+(?:[ \t]*+\r?\n[ \t]*+[A-Za-z0-9+/_-]++(?=={0,2}[ \t]*+(?:\r?\n|\r?\Z|["'`)\]},;<])))+={0,2}""")
RUN = re.compile(r"[A-Za-z0-9+/_-]+")
HEX_RUN = bytes(120 if chr(b) in "0123456789abcdef" else 32 for b in range(256))
BASE64_RUN = bytes(120 if chr(b).isascii() and (chr(b).isalnum() or chr(b) in "+/_-") else 32 for b in range(256))
MAX_LAYER, OVERLAP, CHUNK = 64 << 20, 1 << 16, 1 << 20
#: Escape layers right above one another that are scanned each; below them escapes are decoded to the end at once.
ESCAPE_LAYERS = 4
Span = tuple[int, int, int]  # start, kind, end: in the order of the result


def scan(text: str) -> list[Span]:
    """The base findings of one text. The failing matches of ``assign`` also take up their text."""
    out: list[Span] = []
    low = text.lower()
    if any(k in low for k in KEYWORDS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    if b"x" * 24 in text.encode("utf-8", "surrogatepass").translate(HEX_RUN):
        out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return out


class Layer:
    """Text and, per character, the original span (``None``: the original itself)."""

    def __init__(self, text: str, start: np.ndarray | None = None, end: np.ndarray | None = None):
        self.text, self.start, self.end = text, start, end

    def origin(self, a: int, b: int) -> tuple[int, int]:
        if self.start is None:
            return a, b
        return int(self.start[a:b].min()), int(self.end[a:b].max())

    def spans(self) -> tuple[np.ndarray, np.ndarray]:
        if self.start is None:
            own = np.arange(len(self.text) + 1, dtype=np.int32)
            return own[:-1], own[1:]
        return self.start, self.end


def _replaced(layer: Layer, runs: re.Pattern, decode) -> Layer | None:
    """The layer with every run decoded; a run's characters all come from the part that ``decode`` names."""
    text, out, lo, hi, at = layer.text, io.StringIO(), array("i"), array("i"), 0
    start, end = layer.spans()

    def kept(to: int) -> None:
        out.write(text[at:to])
        lo.frombytes(start[at:to].tobytes())
        hi.frombytes(end[at:to].tobytes())

    for m in runs.finditer(text):
        chars = decode(m[0])
        if not chars:
            continue
        kept(m.start())
        out.write("".join(c for c, _, _ in chars))
        lo.frombytes(start[np.array([a for _, a, _ in chars]) + m.start()].tobytes())
        hi.frombytes(end[np.array([b for _, _, b in chars]) + (m.start() - 1)].tobytes())
        at = m.end()
    if not at:
        return None
    kept(len(text))
    return Layer(out.getvalue(), np.frombuffer(lo, np.int32), np.frombuffer(hi, np.int32))


def _cascaded(layer: Layer) -> Layer | None:
    """The layer with its escapes decoded from left to right until none is left: a decoded character may complete
    the next escape. Every step shortens the text, so the time is linear. Bytes beyond ASCII become one character each
    (no finding holds any)."""
    if not (PERCENT.search(layer.text) or ESCAPE.search(layer.text)):
        return None
    chars, lo, hi = [], array("i"), array("i")
    start, end = layer.spans()
    for at in range(0, len(layer.text), CHUNK):
        piece = slice(at, at + CHUNK)
        for c, a, b in zip(layer.text[piece], start[piece].tolist(), end[piece].tolist()):
            while True:
                chars.append(c)
                lo.append(a)
                hi.append(b)
                if c not in CLOSING or (m := LAST.search("".join(chars[-10:]))) is None:
                    break
                n, code = len(m[0]), int(m[1]) if m[1] else int(next(x for x in m.groups() if x), 16)
                c = chr(code) if code <= 0x10FFFF and not 0xD800 <= code < 0xE000 else "\ufffd"
                a, b = min(lo[-n:]), max(hi[-n:])
                del chars[-n:], lo[-n:], hi[-n:]
    return Layer("".join(chars), np.frombuffer(lo, np.int32), np.frombuffer(hi, np.int32))


def _percent(run: str) -> list[tuple[str, int, int]] | None:
    raw = bytes.fromhex(run.replace("%", ""))
    try:
        text = raw.decode()
    except UnicodeDecodeError:
        text = raw.decode("latin-1")
        return [(c, 3 * i, 3 * i + 3) for i, c in enumerate(text)]
    out, at = [], 0
    for c in text:
        n = len(c.encode())
        out.append((c, 3 * at, 3 * (at + n)))
        at += n
    return out


def _escapes(run: str) -> list[tuple[str, int, int]] | None:
    out: list[tuple[str, int, int]] = []
    for m in ESCAPED.finditer(run):
        code = int(m[4]) if m[4] else int(next(x for x in m.groups() if x), 16)
        if 0xDC00 <= code < 0xE000 and out and 0xD800 <= ord(out[-1][0]) < 0xDC00:
            high, a, _ = out.pop()
            out.append((chr(0x10000 + ((ord(high) - 0xD800) << 10) + code - 0xDC00), a, m.end()))
        elif code <= 0x10FFFF:
            out.append((chr(code), m.start(), m.end()))
    return [("�" if 0xD800 <= ord(c) < 0xE000 else c, a, b) for c, a, b in out]


def _decompressor(raw: bytes):
    if raw[:2] == b"\x1f\x8b" or raw[:1] == b"\x78":
        return zlib.decompressobj(47)
    if raw[:3] == b"BZh":
        return bz2.BZ2Decompressor()
    if raw[:6] == b"\xfd7zXZ\x00":
        return lzma.LZMADecompressor(memlimit=256 << 20)
    return None


def _members(raw: bytes) -> Iterator[bytes]:
    """The decompressed data of all members (padding between them may be zeros), in chunks, as far as it is sound."""
    while (stream := _decompressor(raw)) is not None:
        data, out = raw, b""
        while not stream.eof:
            try:
                out = stream.decompress(data, CHUNK)
            except (zlib.error, OSError, EOFError, lzma.LZMAError, ValueError):
                return
            data = getattr(stream, "unconsumed_tail", b"")
            if out:
                yield out
            elif not stream.eof and not data:
                return
        raw = stream.unused_data.lstrip(b"\0")


def _inflated(raw: bytes, limit: int) -> Iterator[tuple[bytes, bool]] | None:
    """Decompressed data in overlapping windows of ``limit`` bytes, and whether the window is the first of several;
    None if it isn't compressed."""
    members = _members(raw)
    if (first := next(members, None)) is None:
        return None

    def windows() -> Iterator[tuple[bytes, bool]]:
        data, overlap, several = bytearray(first), min(OVERLAP, limit // 2), False
        for chunk in members:
            data += chunk
            while len(data) > limit:
                yield bytes(data[:limit]), not several
                several = True
                del data[:limit - overlap]
        while len(data) > limit:
            yield bytes(data[:limit]), not several
            several = True
            del data[:limit - overlap]
        yield bytes(data), False

    return windows()


def _readable(raw: bytes) -> str | None:
    try:
        text = raw.decode()
    except UnicodeDecodeError:
        return None
    odd = sum(1 for c in text if c < " " and c not in "\t\n\r")
    return text if text and odd * 20 <= len(text) else None


def _decoded(layer: Layer, pieces: list[tuple[int, int]], limit: int) -> Iterator[tuple[Layer, bool]] | None:
    """The layers of a base64 run in ``pieces`` of the text; None if it holds nothing readable."""
    body = "".join(layer.text[a:b] for a, b in pieces).replace("-", "+").replace("_", "/")
    body = body[:len(body) - 1] if len(body) % 4 == 1 else body
    try:
        raw = base64.b64decode(body + "=" * (-len(body) % 4))
    except (binascii.Error, ValueError):
        return None
    a, b = layer.origin(pieces[0][0], pieces[-1][1])
    if (inflated := _inflated(raw, limit)) is not None:
        texts = ((data.decode("utf-8", "replace"), cut) for data, cut in inflated)
        return ((Layer(t, np.broadcast_to(np.int32(a), len(t)), np.broadcast_to(np.int32(b), len(t))), cut) for t, cut in texts)
    if (text := _readable(raw)) is None:
        return None
    lengths = np.fromiter((len(c.encode()) for c in text), np.int32, len(text))
    last = np.cumsum(lengths)
    at = np.concatenate([np.arange(a, b, dtype=np.int32) for a, b in pieces])
    lo = at[(last - lengths) // 3 * 4]
    hi = at[np.minimum((last + 2) // 3 * 4, len(at)) - 1]
    start, end = layer.spans() if layer.start is not None else (None, None)
    return iter([(Layer(text, lo if start is None else start[lo], hi + 1 if end is None else end[hi]), False)])


def _wrapped(pieces: list[tuple[int, int]]) -> Iterator[list[tuple[int, int]]]:
    """Blocks of lines as wrapped at one width: the first line may begin elsewhere, the last may be shorter."""
    at = 0
    while len(pieces) - at > 1:
        width, n = pieces[at + 1][1] - pieces[at + 1][0], at + 2
        if pieces[at][1] - pieces[at][0] <= width:
            while n < len(pieces) and pieces[n - 1][1] - pieces[n - 1][0] == width >= pieces[n][1] - pieces[n][0]:
                n += 1
        yield pieces[at:n]
        at = n


def _base64(layer: Layer, limit: int) -> Iterator[tuple[Layer, bool]]:
    joined, ends = [], []  # the wrapped runs
    if "\n" in layer.text:
        for m in WRAPPED.finditer(layer.text):
            for pieces in _wrapped([r.span() for r in RUN.finditer(layer.text, m.start(), m.end())]):
                for some in (pieces, pieces[:-1]):  # the last line may be a word that follows
                    if len(some) > 1 and (found := _decoded(layer, some, limit)) is not None:
                        joined.append(some[0][0])
                        ends.append(some[-1][1])
                        yield from found
                        break
    for m in BASE64.finditer(layer.text):
        a, b = m.start(), m.start() + len(m[0].rstrip("="))
        k = bisect_right(joined, a) - 1
        if (k < 0 or b > ends[k]) and (found := _decoded(layer, [(a, b)], limit)) is not None:
            yield from found


def findings(text: str, max_layer: int = MAX_LAYER) -> tuple[list[Span], set[Span], int, int]:
    """Base findings, all findings (mapped to the text), layers scanned, and layers that met ``max_layer``."""
    base = scan(text)
    found, seen, layers, limited = set(base), set(), 0, 0

    def inner(layer: Layer, depth: int) -> Iterator[tuple[Layer | None, bool, int]]:
        if "%" in layer.text or "\\" in layer.text or "&#" in layer.text:
            if depth < ESCAPE_LAYERS:
                yield _replaced(layer, PERCENT, _percent), False, depth + 1
                yield _replaced(layer, ESCAPE, _escapes), False, depth + 1
            else:
                yield _cascaded(layer), False, depth
        if b"x" * 16 in layer.text.encode("utf-8", "surrogatepass").translate(BASE64_RUN):
            for decoded, cut in _base64(layer, max_layer):
                yield decoded, cut, 0

    work = [iter([(Layer(text), False, 0)])]  # depth first, so one window of a large layer is held at a time
    while work:
        layer, cut, depth = next(work[-1], (None, None, 0))
        if cut is None:
            work.pop()
            continue
        limited += cut
        if layer is None or (layer.start is not None and not layer.text):
            continue
        if layer.start is not None:
            key = (hashlib.blake2b(layer.text.encode("utf-8", "surrogatepass"), digest_size=16).digest(), *layer.origin(0, len(layer.text)))
            if key in seen:
                continue
            seen.add(key)
            for a, kind, b in scan(layer.text):
                lo, hi = layer.origin(a, b)
                found.add((lo, kind, hi))
        layers += 1
        work.append(inner(layer, depth))
    return base, found, layers, limited


def shown(spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


def redact(text: str, mask: str = "[REDACTED]") -> str:
    """The text with every found span (merged where they overlap) replaced by ``mask``."""
    parts, at = [], 0
    spans = sorted((a, b) for a, _, b in findings(text)[1])
    while spans:
        a, b = spans.pop(0)
        while spans and spans[0][0] < b:
            b = max(b, spans.pop(0)[1])
        parts += [text[at:a], mask]
        at = b
    return "".join([*parts, text[at:]])


SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_layers int, n_limited int"


def _scan_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, texts in slices(batches):
        rows = []
        for raw in texts:
            base, found, layers, limited = findings(raw.decode())
            kinds = [k for _, k, _ in base]
            rows.append((kinds.count(0), kinds.count(1), kinds.count(2), hashlib.sha256(shown(base).encode()).hexdigest(), shown(found), layers, limited))
        columns = list(zip(*rows))
        types = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int32()] * 2
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(c, t) for c, t in zip(columns, types)]],
                                         names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_layers", "n_limited"])


def scan_documents(docs: DataFrame) -> DataFrame:
    """One row per document with its findings (``SCHEMA``); reads ``doc_id`` and ``text`` alone."""
    return docs.select("doc_id", "text").mapInArrow(_scan_batches, SCHEMA)


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_documents(table(spark, sf_dir, "documents"))


def redact_documents(docs: DataFrame) -> DataFrame:
    """``docs`` with found secrets masked in ``text``; ``n_chars`` (if present) follows a changed text."""
    names, schema = docs.columns, docs.schema

    def masked(batches):
        for batch, texts in slices(batches):
            new = [redact(t.decode()) for t in texts]
            valid = batch.column("text").is_valid().to_pylist()
            changed = [v and n.encode() != t for v, n, t in zip(valid, new, texts)]
            columns = []
            for c in names:
                column = batch.column(c)
                if c == "text":
                    column = pa.array([n if v else None for n, v in zip(new, valid)], pa.string())
                elif c == "n_chars":
                    column = pa.array([len(n) if x else old for n, x, old in zip(new, changed, column.to_pylist())], column.type)
                columns.append(column)
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.mapInArrow(masked, schema)
