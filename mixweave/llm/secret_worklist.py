"""Secret scan with a recursive decoding worklist.

Each text is scanned as it stands (base spans). A worklist then unwraps URL escapes, Unicode
escapes, base64 tokens and compressed blobs, layer in layer, until no new layer appears; a layer
already seen at the same place ends a cycle. Every layer is rescanned, and its spans are mapped back
to code points of the original text.

What a compressed blob holds is read as a stream, in windows that end where no secret, token or blob
goes on; all that is found there maps to the blob's own place. What goes on past a window is opened
anew as a stream of its own, so that memory is bounded however far a blob inflates.

Defined results: a null text is empty and has no spans; equal rows give equal spans; an empty table
gives an empty table; a highly compressed text costs time, not memory, and a blob that is cut off,
damaged, or needs a dictionary of more than XZ_BYTES isn't unpacked. Other columns are kept; `base`
and `spans` replace columns of those names.
"""

from __future__ import annotations

import base64
import binascii
import bz2
import hashlib
import lzma
import re
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import slices

KINDS = ("assign", "access", "hex")
REDACTED = "[REDACTED]"

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ASSIGN_WORDS = ("passw", "secret", "token", "apikey", "api_key")
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")

URL_RUN = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
ESCAPE = re.compile(r"\\u[dD][89abAB][0-9a-fA-F]{2}\\u[dD][c-fC-F][0-9a-fA-F]{2}|\\u\{[0-9a-fA-F]{1,6}\}|\\u[0-9a-fA-F]{4}|\\U[0-9a-fA-F]{8}|\\x[0-9a-fA-F]{2}|&#[0-9]{1,7};|&#[xX][0-9a-fA-F]{1,6};")
BASE64 = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}={0,2}")
#: Base64 that is broken into lines.
LINES = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}(?:[ \t]*\r?\n[ \t]*[A-Za-z0-9+/_-]+)+={0,2}")
PIECE = re.compile(r"[A-Za-z0-9+/_-]+")
JOINER = re.compile(r"[/_-]")
#: How compressed blobs begin: gzip, zlib, bzip2, xz.
MAGIC = re.compile(rb"\x1f\x8b|x[\x01\x5e\x9c\xda]|BZh[1-9]|\xfd7zXZ\x00")
#: Bytes as URLs and string literals write them.
URL_BYTES, URL_BYTE = re.compile(r"[!-~]+"), re.compile(r"%(?P<hex>[0-9A-Fa-f]{2})|[!-~](?P<simple>)")
ESCAPED_BYTES, ESCAPED_BYTE = re.compile(r"[ -~]+"), re.compile(r"\\(?:x|u00|U000000|(?P<brace>u\{0{0,4}))(?P<hex>[0-9A-Fa-f]{2})(?(brace)\})|\\(?P<simple>[abfnrtv0\\'\"])|[ -~]")
#: Bytes of a window of a content, of the longest one, and of what two share where one had to be cut.
WINDOW, LONGEST, OVERLAP = 1 << 18, 2 << 20, 1 << 16
XZ_BYTES = 128 << 20
#: Where windows may end: at bytes that no secret, token or escape holds, or at the end of a line of other than base64.
LAST_BREAK, BASE64_LINE = re.compile(rb"(?s).*[^\t\r\n -~]"), re.compile(rb"[ \t]*[A-Za-z0-9+/_-]{1,}={0,2}[ \t\r]*\Z")
NOT_BASE64, LAST_OTHER, URL_SAFE = re.compile(rb"[^A-Za-z0-9+/_ \t\r\n-]"), re.compile(rb"(?s).*[^A-Za-z0-9+/_ \t\r\n-]"), bytes.maketrans(b"-_", b"+/")
SIMPLE = dict(zip("abfnrtv0", b"\a\b\f\n\r\t\v\0", strict=True))

Span = tuple[str, int, int]


def scan_layer(text: str) -> list[Span]:
    """Spans of one layer, in its own code points."""
    found = []
    low = text.lower()
    if any(w in low for w in ASSIGN_WORDS):
        found += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        found += [("access", m.start(), m.end()) for m in ACCESS.finditer(text)]
    found += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return found


class Layer:
    """A decoded text; first and last hold, for each character, the original code points it covers."""

    def __init__(self, text: str, first: np.ndarray, last: np.ndarray):
        self.text, self.first, self.last = text, first, last

    def replaced(self, parts: list[tuple[int, int, str, list[tuple[int, int]]]]) -> Layer:
        """This layer with each (start, end, decoded, places of its characters) put in."""
        texts, first, last, at = [], [], [], 0
        for start, end, decoded, places in parts:
            texts += [self.text[at:start], decoded]
            first += [self.first[at:start], self.first[[a for a, _ in places]]]
            last += [self.last[at:start], self.last[[b - 1 for _, b in places]]]
            at = end
        texts.append(self.text[at:])
        return Layer("".join(texts), np.concatenate([*first, self.first[at:]]), np.concatenate([*last, self.last[at:]]))


def _utf8(raw: bytes) -> tuple[str, np.ndarray]:
    """Text of escaped bytes with each character's number of bytes; bytes that are no UTF-8 stand alone."""
    try:
        text = raw.decode()
    except UnicodeDecodeError:
        return raw.decode("latin-1"), np.ones(len(raw), np.int64)
    begins = np.flatnonzero((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)
    return text, np.diff(begins, append=len(raw))


def url_layer(layer: Layer) -> Layer | None:
    if "%" not in layer.text:
        return None
    parts = []
    for m in URL_RUN.finditer(layer.text):
        text, sizes = _utf8(bytes.fromhex(m[0].replace("%", "")))
        ends = np.cumsum(sizes) * 3 + m.start()
        parts.append((m.start(), m.end(), text, [(int(e) - 3 * s, int(e)) for e, s in zip(ends, sizes, strict=True)]))
    return layer.replaced(parts) if parts else None


def _escaped(found: str) -> str | None:
    if found.startswith("\\u") and len(found) == 12:
        return chr(0x10000 + ((int(found[2:6], 16) & 0x3FF) << 10) + (int(found[8:], 16) & 0x3FF))
    digits = found.lstrip("\\uUx&#X{").rstrip(";}")
    value = int(digits or "0", 10 if found[0] == "&" and found[2] not in "xX" else 16)
    return chr(value) if value < 0x110000 and not 0xD800 <= value < 0xE000 else None


def unicode_layer(layer: Layer) -> Layer | None:
    if "\\" not in layer.text and "&#" not in layer.text:
        return None
    parts = [(m.start(), m.end(), c, [(m.start(), m.end())]) for m in ESCAPE.finditer(layer.text) if (c := _escaped(m[0])) is not None]
    return layer.replaced(parts) if parts else None


class Damaged(Exception):
    """A stream that is no compressed blob, or is cut off."""


class _Zlib:
    """zlib's decompressor with the interface of bz2's and lzma's."""

    def __init__(self, bits: int):
        self.z = zlib.decompressobj(bits)

    def decompress(self, data: bytes, most: int) -> bytes:
        return self.z.decompress(self.z.unconsumed_tail + data, most)

    needs_input = property(lambda self: not self.z.unconsumed_tail)
    eof = property(lambda self: self.z.eof)
    unused_data = property(lambda self: self.z.unused_data)


def _decompressor(head: bytes) -> tuple[bytes, Callable] | None:
    """How a blob begins if another may follow it, and what unpacks it."""
    if head[:3] == b"\x1f\x8b\x08":
        return head[:2], lambda: _Zlib(31)
    if len(head) > 6 and head[0] == 0x78 and (head[0] * 256 + head[1]) % 31 == 0:
        return b"", lambda: _Zlib(15)
    if head[:3] == b"BZh":
        return head[:3], bz2.BZ2Decompressor
    if head[:6] == b"\xfd7zXZ\x00":
        return head[:6], lambda: lzma.LZMADecompressor(memlimit=XZ_BYTES)
    return None


def inflated(chunks: Iterator[bytes], left: list[int] | None = None) -> Iterator[bytes]:
    """The content of the blob that a stream of bytes begins with, piece by piece; Damaged if there's
    none, or it's cut off. left gets the number of bytes that were read and not used."""
    data = next(chunks, b"")
    while len(data) < 8 and (more := next(chunks, b"")):
        data += more
    if (found := _decompressor(data)) is None:
        raise Damaged
    magic, make = found
    first = True
    while True:
        one = make()
        while not one.eof:
            try:
                part = one.decompress(data, WINDOW)
            except (zlib.error, OSError, ValueError, EOFError, lzma.LZMAError) as e:
                if first:
                    raise Damaged from e
                return
            data = b""
            if part:
                yield part
            elif not one.eof and one.needs_input and not (data := next(chunks, b"")):
                if first:
                    raise Damaged
                return
        data, first = one.unused_data, False
        if left is not None:
            left[:] = [len(data)]
        if not magic or not data.startswith(magic):
            return


def blob_ends(raw: bytes) -> Iterator[tuple[int, int | None]]:
    """(start, end) of each compressed blob in raw; end is None for one that goes on past its end."""
    at, view = 0, memoryview(raw)
    while (m := MAGIC.search(raw, at)) is not None:
        start = m.start()
        at = start + 1
        fed, left = [start], [0]

        def chunks(fed=fed) -> Iterator[bytes]:
            while fed[0] < len(view):
                piece = bytes(view[fed[0] : fed[0] + (1 << 16)])
                fed[0] += len(piece)
                yield piece

        try:
            for _ in inflated(chunks(), left):
                pass
        except Damaged as e:
            if e.__cause__ is None and fed[0] >= len(view) and _decompressor(raw[start : start + 8]):
                yield start, None
            continue
        at = fed[0] - left[0]
        yield start, at


Source = Callable[[], Iterator[bytes]]


def _skipped(chunks: Iterator[bytes], offset: int) -> Iterator[bytes]:
    for chunk in chunks:
        if offset < len(chunk):
            yield chunk[offset:]
        offset = max(offset - len(chunk), 0)


def _unpacked_at(source: Source, offset: int) -> Source:
    return lambda: inflated(_skipped(source(), offset))


def _decoded_at(source: Source, offset: int) -> Source:
    """What the base64 that begins at an offset of a source decodes to, up to its end."""

    def run() -> Iterator[bytes]:
        held = b""
        for chunk in _skipped(source(), offset):
            end = NOT_BASE64.search(chunk)
            held += bytes(chunk[: end.start()] if end else chunk).translate(URL_SAFE, b" \t\r\n")
            whole = len(held) // 4 * 4
            yield base64.b64decode(held[:whole])
            held = held[whole:]
            if end:
                break
        if len(held) > 1:
            yield base64.b64decode(held + b"=" * (-len(held) % 4))

    return run


def _safe_end(held: bytes) -> int:
    """Where a window may end in its second half; 0 if nowhere."""
    half = len(held) // 2
    if m := LAST_BREAK.match(held, half):
        return m.end()
    at = held.rfind(b"\n", half)
    while at >= 0:
        if not BASE64_LINE.match(held, held.rfind(b"\n", 0, at) + 1, at):
            return at + 1
        at = held.rfind(b"\n", half, at)
    return 0


def _windows(chunks: Iterator[bytes]) -> Iterator[tuple[bytes, int, bool]]:
    """(window, its offset, whether it was cut where something may go on) of a content."""
    held, at = b"", 0
    for chunk in chunks:
        held += chunk
        if len(held) < WINDOW:
            continue
        if end := _safe_end(held):
            yield held[:end], at, False
            held, at = held[end:], at + end
        elif len(held) >= LONGEST:
            yield held, at, True
            held, at = held[-OVERLAP:], at + len(held) - OVERLAP
    if held:
        yield held, at, False


def _read(source: Source, found: set[str], seen: set[bytes]) -> Iterator[Source]:
    """Adds the kinds of secrets of a content to found, and yields the contents found in it."""
    digest, later, known = hashlib.sha256(), [], set()
    for window, at, cut in _windows(source()):
        digest.update(window[:-OVERLAP] if cut else window)
        blobs = []
        for a, b in blob_ends(window):
            if b is None:
                later.append(_unpacked_at(source, at + a))
            else:
                blobs.append(window[a:b])
        if cut:
            run = m.end() if (m := LAST_OTHER.match(window)) else 0
            if (run or not at) and run < len(window) - OVERLAP:
                later += [_decoded_at(source, at + run + k) for k in range(4)]
        if (key := hashlib.sha256(window).digest()) in known:
            continue  # a content that inflates far repeats itself
        known.add(key)
        n = len(window)
        text = Layer(window.decode("latin-1"), np.zeros(n, np.int32), np.ones(n, np.int32))
        del window
        found.update(k for k, _, _ in scan_layer(text.text))
        for child, _ in _layers(text, {}, blobs):
            found.update(k for k, _, _ in scan_layer(child.text))
        del text
        while blobs:
            blob = blobs.pop()
            if (key := hashlib.sha256(blob).digest()) not in seen:
                seen.add(key)
                yield lambda blob=blob: inflated(iter((blob,)))
    if later and digest.digest() not in seen:
        seen.add(digest.digest())
        yield from later


def packed_kinds(blob: bytes) -> set[str]:
    """The kinds of secrets in a compressed blob, at any depth."""
    found: set[str] = set()
    seen = {hashlib.sha256(blob).digest()}
    stack = [_read(lambda: inflated(iter((blob,))), found, seen)]
    while stack and len(found) < len(KINDS):
        try:
            stack.append(_read(next(stack[-1]), found, seen))
        except (StopIteration, Damaged):
            stack.pop()
    return found


def escaped_bytes(layer: Layer) -> Iterator[tuple[bytes, np.ndarray, np.ndarray]]:
    """Bytes written with URL or backslash escapes, plain characters between, and the places of each."""
    for sign, run, one in (("%", URL_BYTES, URL_BYTE), ("\\", ESCAPED_BYTES, ESCAPED_BYTE)):
        if sign not in layer.text:
            continue
        for m in run.finditer(layer.text):
            if sign not in m[0]:
                continue
            raw, starts, ends = bytearray(), array("i"), array("i")
            for x in one.finditer(m[0]):
                raw.append(int(x["hex"], 16) if x["hex"] else SIMPLE.get(x["simple"], ord(x["simple"])) if x["simple"] else ord(x[0]))
                starts.append(x.start() + m.start())
                ends.append(x.end() + m.start())
            yield bytes(raw), np.array(starts), np.array(ends)


def _tokens(text: str) -> Iterator[tuple[str, np.ndarray]]:
    """Base64 tokens and the places of their characters: single ones, and runs of lines joined. What
    follows a '/', '-', '_' or a line's end may begin anew, so each alignment that it has is a token."""
    for pattern in (BASE64, LINES):
        for m in pattern.finditer(text):
            pieces = list(PIECE.finditer(m[0]))
            token = "".join(x[0] for x in pieces)
            places = np.concatenate([np.arange(x.start(), x.end()) for x in pieces]) + m.start()
            lines = np.cumsum([0, *(len(x[0]) for x in pieces)])
            done = set()
            for a in sorted({*lines[:-1].tolist(), *(x.end() for x in JOINER.finditer(token))}):
                if a % 4 not in done and len(token) - a >= 16:
                    done.add(a % 4)
                    yield token[a:], places[a:]


def base64_bytes(layer: Layer) -> Iterator[tuple[bytes, np.ndarray, np.ndarray]]:
    """What base64 tokens decode to, and the places of each byte."""
    for token, places in _tokens(layer.text):
        token = token[: len(token) - (len(token) % 4 == 1)]
        try:
            raw = base64.b64decode(token.replace("-", "+").replace("_", "/") + "=" * (-len(token) % 4))
        except (binascii.Error, ValueError):
            continue
        at = np.arange(len(raw))
        yield raw, places[at * 4 // 3], places[np.minimum(-(-(at + 1) * 4 // 3), len(token)) - 1] + 1


def _layers(root: Layer, known: dict[bytes, set[str]], blobs: list[bytes] | None = None) -> Iterator[tuple[Layer | None, set | list]]:
    """The worklist: each new layer under a root, and (None, spans) of the compressed blobs in it.

    With blobs, a list, compressed blobs are put there instead.
    """
    n = len(root.text)
    work, seen = [root], {(root.text, 0, n)} if n else set()

    def packed(layer: Layer, raw: bytes, starts: np.ndarray, ends: np.ndarray) -> list[Span]:
        out = []
        for a, b in blob_ends(raw):
            if b is None:
                continue
            if blobs is not None:
                blobs.append(raw[a:b])
                continue
            if (key := hashlib.sha256(raw[a:b]).digest()) not in known:
                known[key] = packed_kinds(raw[a:b])
            out += [(k, int(layer.first[starts[a]]), int(layer.last[ends[b - 1] - 1])) for k in known[key]]
        return out

    while work:
        layer = work.pop()
        children = [url_layer(layer), unicode_layer(layer)]
        for raw, starts, ends in escaped_bytes(layer):
            if spans := packed(layer, raw, starts, ends):
                yield None, spans
        for raw, starts, ends in base64_bytes(layer):
            if spans := packed(layer, raw, starts, ends):
                yield None, spans
            text, sizes = _utf8(raw)
            if text:
                last = np.cumsum(sizes) - 1
                children.append(Layer(text, layer.first[starts[last + 1 - sizes]], layer.last[ends[last] - 1]))
        for child in children:
            if child is None or not child.text:
                continue
            key = (child.text, int(child.first[0]), int(child.last[-1]))
            if key not in seen:
                seen.add(key)
                work.append(child)
                yield child, []


def all_spans(text: str) -> tuple[list[Span], list[Span]]:
    """Base spans, and all spans with those of decoded layers, by start and then kind."""
    order = lambda s: (s[1], KINDS.index(s[0]), s[2])
    base = scan_layer(text)
    if "%" not in text and "\\" not in text and "&#" not in text and not BASE64.search(text):
        base.sort(key=order)
        return base, base
    found = set(base)
    n = len(text)
    for child, spans in _layers(Layer(text, np.arange(n, dtype=np.int32), np.arange(1, n + 1, dtype=np.int32)), {}):
        found.update(spans if child is None else ((k, int(child.first[a]), int(child.last[b - 1])) for k, a, b in scan_layer(child.text)))
    return sorted(base, key=order), sorted(found, key=order)


def redact_text(text: str, spans: list[Span]) -> str:
    out, at = [], 0
    for _, start, end in spans:
        if start >= at:
            out += [text[at:start], REDACTED]
        at = max(at, end)
    return "".join([*out, text[at:]]) if out else text


_SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
_ARROW_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def scan_secrets(docs: DataFrame, text: str = "text", redact: bool = False) -> DataFrame:
    """Add base and spans, arrays of (kind, start, end), to docs; with redact, also clean the text."""
    kept = [c for c in docs.columns if c not in ("base", "spans")]
    docs = docs.select(*kept)
    schema = T.StructType([*docs.schema.fields, T.StructField("base", _SPANS), T.StructField("spans", _SPANS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        named = lambda spans: [{"kind": k, "start": a, "end": b} for k, a, b in spans]
        for batch in slices(batches):
            at = kept.index(text)
            columns, texts = list(batch.columns), batch.column(at).to_pylist()
            found = [all_spans(t or "") for t in texts]
            if redact:
                columns[at] = pa.array([t and redact_text(t, s) for t, (_, s) in zip(texts, found, strict=True)], batch.schema.field(at).type)
            columns += [pa.array([named(b) for b, _ in found], _ARROW_SPANS), pa.array([named(s) for _, s in found], _ARROW_SPANS)]
            yield pa.RecordBatch.from_arrays(columns, names=[*kept, "base", "spans"])

    return docs.mapInArrow(run, schema)


def joined_spans(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def secrets_query(docs: DataFrame) -> DataFrame:
    found = scan_secrets(docs.select("doc_id", "text"))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *[count(k) for k in KINDS], F.sha2(joined_spans(F.col("base")), 256).alias("base_sha256"), joined_spans(F.col("spans")).alias("spans"))
