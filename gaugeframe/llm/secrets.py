"""Secret scans: a worklist of layers, unwrapped until nothing new appears.

Each text is the first layer. From a layer come its children: the layer with percent escapes decoded, the layer with
Unicode escapes and full-width forms decoded, and the contents of every base64 run, on one line or wrapped at any
column, plain or compressed by gzip, zlib, bzip2, xz or zstandard (several times over, in several members, and from any
place of the run on). Layers seen before are not opened again, which ends cycles. Every layer is scanned by the same
three rules, and a span found in it is mapped back, character by character, to the text; a span in compressed data is
the compressed run. A run is decoded once for each of its four alignments, and compressed data are read as a stream, so
the work grows in proportion to the run. One scan of the table with one Arrow function: no shuffle.

Defined cases: null text counts as empty; texts of any length are scanned whole; repeated rows and rows with a null id
give a row each; an empty table gives no rows; further columns are ignored. What inflates to more than ``max_inflated``
bytes, a parameter that bounds a worker's memory, is scanned in windows of that size, which overlap by 64 KB; there a
base64 run that is itself longer than a window is decoded window by window.
"""

from __future__ import annotations

import binascii
import bz2
import hashlib
import lzma
import re
import unicodedata
import zlib
from collections.abc import Iterator
from itertools import repeat

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import begin, fresh_name, table, texts_of

KINDS = ("assign", "access", "hex")
#: The three base rules.
ASSIGN = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
#: A run of base64 and its lines; shorter ones than LEAST characters hold no secret (that of 13 characters takes 18).
RUN = re.compile(r"(?<![A-Za-z0-9+/_-])(?:[A-Za-z0-9+/_-]{18,}(?:\r?\n[A-Za-z0-9+/_-]+)*={0,2}|[A-Za-z0-9+/_-]+(?:\r?\n[A-Za-z0-9+/_-]+)+={0,2})")
LEAST = 18
STANDARD = str.maketrans("-_", "+/")
#: How base64 of gzip, zstandard, bzip2 and xz data begins.
MAGIC = re.compile(r"H4sI|KLUv|Qlpo|/Td6WFo")
#: Decoded bytes without any of these hold neither a secret nor a further layer.
HINT = re.compile(rb"(?i)passw|secret|token|api_?key|AKIA|[0-9a-f]{32}|%[0-9a-f]{2}|\\[ux]|&#|U\+[0-9a-f]{4}|[a-z0-9+/_-]{18}|\xef[\xbc\xbd]")
PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
ESCAPE = re.compile(r"\\u\{([0-9A-Fa-f]{1,6})\}|\\u([0-9A-Fa-f]{4})|\\U([0-9A-Fa-f]{8})|\\x([0-9A-Fa-f]{2})|&#[xX]([0-9A-Fa-f]{1,6});|&#([0-9]{1,7});|U\+([0-9A-Fa-f]{4,6})|([\uff01-\uff5e])")
MAX_INFLATED = 16 << 20


def _zlib_starts() -> re.Pattern:
    """Where base64 of zlib data may begin: each valid pair of header bytes (no preset dictionary) is two characters
    and the upper bits of a third."""
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    found = []
    for head in (c << 8 | f for c in range(0x08, 0x80, 16) for f in range(256) if (c << 8 | f) % 31 == 0 and not f & 32):
        third = (head & 15) << 2
        found.append(re.escape(letters[head >> 10] + letters[head >> 4 & 63]) + f"[{re.escape(letters[third : third + 4])}]")
    return re.compile(f"(?={'|'.join(found)})")


ZLIB = _zlib_starts()
#: Bytes that windows share, bytes read from compressed data at a time, and bytes they give at a time at most.
OVERLAP, FED, PIECE = 1 << 16, 1 << 14, 1 << 20

ZLIB_TOOL = type(zlib.decompressobj())

Span = tuple[int, int, int]


def base_spans(text: str) -> list[Span]:
    """(start, kind's number, end) by the base rules."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 8]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


class Same:
    """A sequence of n equal numbers."""

    __slots__ = ("n", "value")

    def __init__(self, value: int, n: int):
        self.value, self.n = value, n

    def __getitem__(self, at):
        return Same(self.value, len(range(*at.indices(self.n)))) if isinstance(at, slice) else self.value

    def __iter__(self):
        return repeat(self.value, self.n)


class Layer:
    """A decoded text; starts[i] and ends[i] say where its character i comes from in the document."""

    __slots__ = ("ends", "starts", "text")

    def __init__(self, text: str, starts, ends):
        self.text, self.starts, self.ends = text, starts, ends


def _replaced(layer: Layer, pattern: re.Pattern, decode) -> Layer | None:
    """layer with what pattern finds replaced by decode(match): [(characters, start, end in the match), ...] or None."""
    parts: list[str] = []
    starts: list[int] = []
    ends: list[int] = []
    done = 0
    for m in pattern.finditer(layer.text):
        pieces = decode(m)
        if pieces is None:
            continue
        a, b = m.span()
        parts.append(layer.text[done:a])
        starts.extend(layer.starts[done:a])
        ends.extend(layer.ends[done:a])
        for chars, i, j in pieces:
            parts.append(chars)
            starts.extend([layer.starts[a + i]] * len(chars))
            ends.extend([layer.ends[a + j - 1]] * len(chars))
        done = b
    if not parts:
        return None
    parts.append(layer.text[done:])
    starts.extend(layer.starts[done:])
    ends.extend(layer.ends[done:])
    return Layer("".join(parts), starts, ends)


def _percent(m: re.Match):
    raw, out, i = bytes.fromhex(m[0].replace("%", "")), [], 0
    while i < len(raw):
        for n in (1, 2, 3, 4):
            try:
                out.append((raw[i : i + n].decode(), 3 * i, 3 * min(i + n, len(raw))))
                break
            except UnicodeDecodeError:
                continue
        else:
            n = 1
            out.append((f"%{raw[i]:02X}", 3 * i, 3 * i + 3))  # not text: stays as it is
        i += n
    return out if any(len(c) == 1 for c, _, _ in out) else None


def _escape(m: re.Match):
    if m[8]:
        return [(unicodedata.normalize("NFKC", m[8]), 0, 1)]
    code = int(m[6]) if m[6] else int(next(g for g in m.groups() if g), 16)
    if code > 0x10FFFF or 0xD800 <= code < 0xE000:
        return None
    return [(chr(code), 0, len(m[0]))]


def _opened(data: bytes):
    """A decompressor for data, by their first bytes; None where they are not compressed."""
    if data[:2] == b"\x1f\x8b":
        return zlib.decompressobj(31)
    if data[:3] == b"BZh":
        return bz2.BZ2Decompressor()
    if data[:6] == b"\xfd7zXZ\0":
        return lzma.LZMADecompressor()
    if data[:4] == b"\x28\xb5\x2f\xfd":
        return zstandard.ZstdDecompressor().decompressobj()
    if len(data) > 2 and data[0] & 15 == 8 and (data[0] << 8 | data[1]) % 31 == 0:
        return zlib.decompressobj()
    return None


def _fed(tool, data: bytes) -> Iterator[bytes]:
    """What a decompressor gives for further data, a piece at a time; returns what lies behind its end."""
    if isinstance(tool, ZLIB_TOOL):
        while not tool.eof:
            piece = tool.decompress(data, PIECE)
            if piece:
                yield piece
            data = tool.unconsumed_tail
            if not data and len(piece) < PIECE:
                break
    elif hasattr(tool, "needs_input"):
        while not tool.eof:
            piece = tool.decompress(data, PIECE)
            if piece:
                yield piece
            data = b""
            if not tool.eof and tool.needs_input:
                break
    else:
        for k in range(0, len(data), 64):  # few bytes may stand for much
            piece = tool.decompress(data[k : k + 64])
            if piece:
                yield piece
            if tool.eof:
                return tool.unused_data + data[k + 64 :]
    return tool.unused_data if tool.eof else b""


def _members(chunks: Iterator[bytes], end: list[int]) -> Iterator[bytes]:
    """What compressed data hold, member after member, as far as they can be read. end: how many bytes of chunks they
    take, and how many members are whole."""
    rest, tool = b"", None
    for chunk in chunks:
        end[0] += len(chunk)
        rest += chunk
        while rest:
            if tool is None:
                tool = _opened(rest)
                if tool is None:
                    end[0] -= len(rest)
                    return
            try:
                rest = yield from _fed(tool, rest)
            except Exception:  # noqa: BLE001  each library has its own error for data that only look compressed
                return
            if tool.eof:
                tool = None
                end[1] += 1


def _unwrapped(chunks: Iterator[bytes], end: list[int]) -> Iterator[bytes]:
    """What data hold below all layers of compression that enclose them whole. Data that are not compressed, or only
    look so, give nothing."""
    inside = _members(chunks, end)
    first = next(inside, b"")
    while first and len(first) < 8 and (more := next(inside, b"")):
        first += more
    if not first:
        return
    tried: list[bytes] = []
    trying = True

    def again() -> Iterator[bytes]:
        yield first
        for piece in inside:
            if trying:
                tried.append(piece)
            yield piece

    deeper = _unwrapped(again(), [0, 0]) if _opened(first) else iter(())
    piece = next(deeper, b"")
    trying = False
    if piece:
        tried.clear()
        yield piece
        yield from deeper
    else:
        yield from (first, *tried)
        yield from inside


def _windows(data: memoryview, most: int, end: list[int]) -> Iterator[bytes]:
    """The unwrapped contents of data in windows of about ``most`` bytes, each with some of what came before it."""
    held, size = [], 0
    for piece in _unwrapped((bytes(data[k : k + FED]) for k in range(0, len(data), FED)), end):
        held.append(piece)
        size += len(piece)
        if size >= most:
            window = b"".join(held)
            yield window
            held, size = [window[-OVERLAP:]], 0
    if size:
        yield b"".join(held)


def _candidates(run: str, at: int) -> Iterator[range | list[int]]:
    """Which characters may be one piece of base64: all of a run, each line, and blocks of lines of one length with a
    shorter one behind them, or without it."""
    if "\n" not in run:
        yield range(at, at + len(run.rstrip("=")))
        return
    lines = [(at + m.start(), len(m[0])) for m in re.finditer(r"[^=\r\n]+", run)]
    of = lambda some: [i for a, n in some for i in range(a, a + n)]
    yield of(lines)
    k = 0
    while k < len(lines):
        j = k + 1
        while j < len(lines) and lines[j][1] == lines[k][1]:
            j += 1
        if j < len(lines) and lines[j][1] < lines[k][1] and not (k == 0 and j == len(lines) - 1):
            yield of(lines[k : j + 1])
        if j - k > 1 and j - k < len(lines):
            yield of(lines[k:j])
        k = j
    yield from (range(a, a + n) for a, n in lines if n >= LEAST)


def _runs(layer: Layer, most: int) -> Iterator[Layer]:
    for m in RUN.finditer(layer.text):
        for places in _candidates(m[0], m.start()):
            if len(places) >= LEAST:
                run = layer.text[places[0] : places[-1] + 1] if isinstance(places, range) else "".join(map(layer.text.__getitem__, places))
                yield from _decoded(layer, run.translate(STANDARD), places, most)


def _decoded(layer: Layer, run: str, places: range | list[int], most: int) -> Iterator[Layer]:
    decoded: list[bytes] = []
    for skip in range(4):
        body = run[skip:]
        body = body[:-1] if len(body) % 4 == 1 else body
        decoded.append(binascii.a2b_base64(body + "=" * (-len(body) % 4)))
    zero, tried, opened, whole = [0] * 4, set(), set(), 0

    def body(k: int, at: int) -> int | None:
        """Where the data begin behind a gzip header. Zero bytes, which end names, are looked for once."""
        d = decoded[k]
        if len(d) < at + 12 or d[at + 2] != 8 or d[at + 3] & 0xE0:
            return None
        flags, p = d[at + 3], at + 10
        if flags & 4:
            p += 2 + int.from_bytes(d[p : p + 2], "little")
        for bit in (8, 16):
            if flags & bit:
                if 0 <= zero[k] < p:
                    zero[k] = d.find(0, p)
                if zero[k] < 0:
                    return None
                p = zero[k] + 1
        return p

    for x in sorted({0, 1, 2, 3, *(m.start() for pattern in (MAGIC, ZLIB) for m in pattern.finditer(run))}):
        k, at = x % 4, x // 4 * 3
        head = decoded[k][at : at + 8]
        if x < whole or len(head) < 8 or _opened(head) is None:
            continue
        if head[:2] == b"\x1f\x8b":
            if (p := body(k, at)) is None or (k, p) in tried:
                continue
            tried.add((k, p))
        used = [0, 0]
        for window in _windows(memoryview(decoded[k])[at:], most, used):
            opened.add(x)
            text = window.decode("utf-8", "replace")
            last = min(x - (-used[0] * 4 // 3), len(run)) - 1
            yield Layer(text, Same(layer.starts[places[x]], len(text)), Same(layer.ends[places[last]], len(text)))
        if used[1]:  # a whole member: what looks like a beginning inside is none
            whole = x - (-used[0] * 4 // 3)
    for skip, data in enumerate(decoded):
        if skip in opened or not HINT.search(data):
            continue
        try:
            text = data.decode()
        except UnicodeDecodeError:
            text = data.decode("latin-1")  # what the rules look for is ASCII
        sizes = [1] * len(text) if len(text) == len(data) else [len(c.encode()) for c in text]
        starts, ends, k = [], [], 0
        for n in sizes:
            starts.append(layer.starts[places[skip + k * 4 // 3]])
            ends.append(layer.ends[places[min(skip - (-(k + n) * 4 // 3), len(run)) - 1]])
            k += n
        yield Layer(text, starts, ends)


def all_spans(text: str, max_inflated: int = MAX_INFLATED) -> tuple[list[Span], list[Span]]:
    """Base spans, and those and all found in decoded layers."""
    base = base_spans(text)
    if not ("%" in text and PERCENT.search(text) or RUN.search(text) or ESCAPE.search(text)):
        return base, base
    found = set(base)
    first = Layer(text, range(len(text)), range(1, len(text) + 1))
    work, seen = [first], {(text, 0, len(text))}
    while work:
        layer = work.pop()
        if layer is not first:
            found.update((layer.starts[a], k, layer.ends[b - 1]) for a, k, b in base_spans(layer.text))
        children = [_replaced(layer, PERCENT, _percent), _replaced(layer, ESCAPE, _escape), *_runs(layer, max_inflated)]
        for child in children:
            if child is None or not child.text:
                continue
            key = (child.text, child.starts[0], child.ends[len(child.text) - 1])
            if key not in seen:  # else a cycle, or another way to the same layer
                seen.add(key)
                work.append(child)
    return base, sorted(found)


def written(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def scan_secrets(docs: DataFrame, max_inflated: int = MAX_INFLATED) -> DataFrame:
    """A row for each document: counts and digest of the base spans, and all spans."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("secrets")
        for batch in batches:
            rows = []
            for text in texts_of(batch.column(1)):
                base, spans = all_spans(text, max_inflated)
                kinds = [k for _, k, _ in base]
                rows.append((*(kinds.count(k) for k in range(3)), hashlib.sha256(written(base).encode()).hexdigest(), written(spans)))
            columns = list(zip(*rows, strict=True)) if rows else [()] * 5
            kinds_of = [pa.int64()] * 3 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, columns, kinds_of)], names=names)

    names = ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"]
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(scan, f"doc_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def redact(text: str, mark: str = "[SECRET]", max_inflated: int = MAX_INFLATED) -> str:
    """text with every span replaced by the mark; overlapping spans by one."""
    out, done = [], 0
    spans = all_spans(text, max_inflated)[1]
    i = 0
    while i < len(spans):
        a, _, b = spans[i]
        i += 1
        while i < len(spans) and spans[i][0] <= b:
            b = max(b, spans[i][2])
            i += 1
        out += [text[done:a], mark]
        done = b
    return "".join([*out, text[done:]])


def redact_documents(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """docs with the secrets in text replaced, and n_chars set anew where that changed it; other columns as they are.
    Null text stays null."""


    def clean(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        begin("secrets")
        for texts in batches:
            yield pa.array([redact(t, mark) for t in texts_of(texts)], pa.string(), mask=texts.is_null().to_numpy(zero_copy_only=False))

    clean.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    new = fresh_name(docs, "redacted")
    out = docs.withColumn(new, F.arrow_udf(clean, "string")("text"))
    changed = ~F.col(new).eqNullSafe(F.col("text"))
    columns = {"text": F.col(new), "n_chars": F.when(changed, F.length(new)).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {"text": F.col(new)}
    return out.select(*(columns[c].alias(c) if c in columns else out[c] for c in docs.columns))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(table(spark, sf_dir, "documents"))
