"""Secret scans over all layers of a text.

A worklist holds layers: first the text itself, then whatever its encoded stretches decode
to. Percent escapes, ``\\u``/``\\x`` escapes, base64 (standard and URL-safe, also glued to other
characters or wrapped over lines) and hexadecimal stretches are unwrapped; decoded bytes
that are zlib or gzip streams are inflated. A
layer seen before at the same place is not opened again, so cycles end, and the list runs
dry when nothing decodes any further; equal content at another place is another layer. Every layer is scanned with the same rules; what is found in a decoded
layer is mapped to the stretch of the text it was unwrapped from.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import re
import zlib
from bisect import bisect_left, bisect_right
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrays import Slice, byte_class, slices
from .registry import register
from .tables import table

KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
MIN_VALUE, MIN_ACCESS, MIN_HEX = 6, 20, 24

PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
ESCAPE = re.compile(r"(?:\\u[0-9A-Fa-f]{4}|\\x[0-9A-Fa-f]{2}|\\U[0-9A-Fa-f]{8}|\\u\{[0-9A-Fa-f]{1,6}\})+")
ONE_ESCAPE = re.compile(r"\\(?:u\{([0-9A-Fa-f]+)\}|u([0-9A-Fa-f]{4})|x([0-9A-Fa-f]{2})|U([0-9A-Fa-f]{8}))")
MIN_BASE64 = 16  # characters; a shorter stretch can't hold a secret of the least length with its name
BASE64 = re.compile(r"[A-Za-z0-9+/_-]{%d,}={0,2}" % MIN_BASE64)
MIN_HEX_LAYER = 24
HEX_LAYER = re.compile(r"(?:[0-9A-Fa-f]{2}){%d,}" % (MIN_HEX_LAYER // 2))
INFLATE_STEP = 1 << 20
#: Base64 over several lines; the last one may go on with something else.
WRAPPED = re.compile(r"[A-Za-z0-9+/_-]{%d,}(?:[ \t]*\r?\n[ \t]*[A-Za-z0-9+/_-]+)+={0,2}" % MIN_BASE64)
BREAK = re.compile(r"[ \t]*\r?\n[ \t]*")
SEPARATOR = re.compile(r"[/_-]")
#: Text within decoded bytes of which the rest is noise; as many characters as MIN_BASE64 decode to.
READABLE = re.compile(rb"(?:[\x20-\x7e\t\n\r]|[\xc2-\xdf][\x80-\xbf]|[\xe0-\xef][\x80-\xbf]{2}|[\xf0-\xf4][\x80-\xbf]{3}){12,}")
NEAR_EDGE = 6  # bytes of noise that may look like text beside a cut
STREAM = re.compile(rb"\x1f\x8b\x08|[\x08\x18\x28\x38\x48\x58\x68\x78](?=.)", re.DOTALL)
QUOTED = re.compile(r"(?:%[0-9A-Fa-f]{2}|[A-Za-z0-9_.~/+*!'()$,;:@&=-])+")
UNIT = re.compile(r"%[0-9A-Fa-f]{2}|.", re.DOTALL)
Places = tuple[np.ndarray, np.ndarray]  # first and end of the stretch that each character of a layer comes from

_BASE64_BYTES = byte_class((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x2B, 0x2B), (0x2F, 0x2F), (0x2D, 0x2D), (0x5F, 0x5F))
_MARKS = byte_class((0x25, 0x25), (0x5C, 0x5C), (0x3A, 0x3A), (0x3D, 0x3D))  # % \ : =


def scan(text: str) -> list[tuple[str, int, int]]:
    """Base spans: leftmost non-overlapping matches of each kind, those that are too short dropped."""
    out = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= MIN_VALUE]
    out += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= MIN_ACCESS]
    out += [("hex", m.start(), m.end()) for m in HEX.finditer(text) if m.end() - m.start() >= MIN_HEX]
    return ordered(out)


def ordered(spans: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0].partition("@")[0]), s[0], s[2]))


def inflated(data: bytes) -> bytes | None:
    """The content of a zlib or gzip stream that ``data`` starts with; None if it is none."""
    found = unpacked(data)
    return None if found is None else found[0]


def unpacked(data: bytes) -> tuple[bytes, int] | None:
    """Content of the stream that ``data`` starts with, and how many bytes the stream has."""
    size = len(data)
    if not (data[:2] == b"\x1f\x8b" or (len(data) > 2 and data[0] & 0x0F == 8 and (data[0] << 8 | data[1]) % 31 == 0)):
        return None
    stream, out = zlib.decompressobj(zlib.MAX_WBITS | 32), []
    try:
        while data and not stream.eof:
            out.append(stream.decompress(data, INFLATE_STEP))
            data = stream.unconsumed_tail
    except zlib.error:
        return None
    return (b"".join(out), size - len(stream.unused_data)) if stream.eof else None


def streams(data: bytes) -> Iterator[tuple[str, int, int]]:
    """(text, begin, end) of the compressed streams anywhere in ``data`` that hold text."""
    at = 0
    while m := STREAM.search(data, at):
        at = m.start() + 1
        packed = data[m.start() : m.start() + 2] == b"\x1f\x8b" or (data[m.start()] << 8 | data[m.start() + 1]) % 31 == 0
        if packed and (found := unpacked(data[m.start() :])) is not None and (text := text_of(found[0])) is not None:
            yield text, m.start(), m.start() + found[1]
            at = m.start() + found[1]


def text_of(data: bytes) -> str | None:
    """Decoded bytes as text: inflated while they are a compressed stream, and mostly printable."""
    seen = set()
    while (more := inflated(data)) is not None:
        digest = hashlib.sha256(more).digest()
        if digest in seen:
            break
        seen.add(digest)
        data = more
    try:
        text = data.decode("utf-8")
    except UnicodeDecodeError:
        return None
    shown = sum(c.isprintable() or c in "\t\n\r" for c in text)
    return text if text and 10 * shown >= 9 * len(text) else None


def from_base64(run: str) -> str | None:
    body = run.rstrip("=").replace("-", "+").replace("_", "/")
    if len(body) % 4 == 1:
        body = body[:-1]
    try:
        return text_of(base64.b64decode(body + "=" * (-len(body) % 4), validate=True))
    except (binascii.Error, ValueError):
        return None


def base64_parts(run: str, whole: bool) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
    """Texts and streams inside a run of base64 characters at each of its four alignments.

    Each with first and end, in ``run``, of the stretch its characters come from. Where a separator is
    about where a text begins or ends, that is the edge. ``whole``: the run itself was decoded.
    """
    body = run.rstrip("=").replace("-", "+").replace("_", "/")
    cuts = [m.start() for m in SEPARATOR.finditer(run)]
    for shift in range(1 if whole else 0, 4):
        own = body[shift:]
        if len(own) < MIN_BASE64:
            break
        own = own[:-1] if len(own) % 4 == 1 else own
        data = base64.b64decode(own + "=" * (-len(own) % 4))
        spans = [(text, i, j, False) for text, i, j in streams(data)]
        spans += [(m.group().decode("utf-8", "replace"), *m.span(), True) for m in READABLE.finditer(data)]
        for text, i, j, readable in spans:
            a, b = shift + 4 * i // 3, min(len(run), shift - (-4 * j // 3))
            b = len(run) if run[b:].strip("=") == "" else b
            first, end = np.full(len(text), a), np.full(len(text), b)
            if readable:
                size = np.cumsum([0] + [len(c.encode()) for c in text])
                for cut in cuts[bisect_left(cuts, a) :]:
                    k = 3 * (cut + 1 - shift) // 4 - i
                    if (cut + 1 - shift) % 4 == 0 and 0 <= k <= NEAR_EDGE:
                        first[np.searchsorted(size[:-1], k) :] = cut + 1
                    if k > NEAR_EDGE:
                        break
                for cut in reversed(cuts[: bisect_right(cuts, b)]):
                    k = 3 * (cut - shift) // 4 - i  # bytes that end before the cut
                    if k < j - i - NEAR_EDGE:
                        break
                    end[: max(0, np.searchsorted(size, k, side="right") - 1)] = cut
            yield text, first, end


def quoted_streams(text: str) -> Iterator[tuple[str, int, int]]:
    """(content, begin, end) of compressed bytes in percent escapes; those that need none stand as they are."""
    for m in QUOTED.finditer(text):
        if "%" not in m.group():
            continue
        units = [(u.group(), u.start(), u.end()) for u in UNIT.finditer(m.group())]
        data = bytes(int(u[1:], 16) if len(u) == 3 else 0x20 if u == "+" else ord(u) for u, _, _ in units)
        for new, i, j in streams(data):
            yield new, m.start() + units[i][1], m.start() + units[j - 1][2]


def from_escapes(run: str) -> str:
    units = [int(next(g for g in m.groups() if g), 16) for m in ONE_ESCAPE.finditer(run)]
    text = "".join(chr(u) if u < 0x110000 else "\ufffd" for u in units)
    return text.encode("utf-16", "surrogatepass").decode("utf-16", "replace")


def stretch(a: int, b: int, size: int) -> Places:
    return np.full(size, a), np.full(size, b)


def whole_replaced(text: str, pattern: re.Pattern, decode) -> tuple[str, Places] | None:
    """``text`` with every match decoded in place, and where each new character comes from."""
    out, first, end, at = [], [], [], 0

    def copy(upto: int) -> None:
        out.append(text[at:upto])
        first.append(np.arange(at, upto))
        end.append(np.arange(at + 1, upto + 1))

    for m in pattern.finditer(text):
        new = decode(m.group())
        if new is None or new == m.group():
            continue
        copy(m.start())
        out.append(new)
        for side, place in zip((first, end), stretch(*m.span(), len(new))):
            side.append(place)
        at = m.end()
    if not at:
        return None
    copy(len(text))
    return "".join(out), (np.concatenate(first), np.concatenate(end))


def layers_of(text: str) -> Iterator[tuple[str, str, Places]]:
    """(how, decoded text, origin of each of its characters) of everything encoded in ``text``."""
    percent = lambda run: bytes.fromhex(run.replace("%", "")).decode("utf-8", "replace")
    for how, pattern, decode, mark in (("url", PERCENT, percent, "%"), ("unicode", ESCAPE, from_escapes, "\\")):
        if mark in text and (found := whole_replaced(text, pattern, decode)):
            yield how, *found
    if "%" in text:
        for new, a, b in quoted_streams(text):
            yield "url", new, stretch(a, b, len(new))
    for m in BASE64.finditer(text):
        if (new := from_base64(m.group())) is not None:
            yield "base64", new, stretch(*m.span(), len(new))
        for part, first, end in base64_parts(m.group(), new is not None):
            yield "base64", part, (first + m.start(), end + m.start())
    for m in WRAPPED.finditer(text) if "\n" in text else ():
        run, at, place = [], m.start(), []
        for gap in [*BREAK.finditer(text, *m.span()), None]:
            end = gap.start() if gap else m.end()
            run.append(text[at:end])
            place.append(np.arange(at, end))
            at = gap.end() if gap else end
        run, place = "".join(run), np.concatenate(place)
        if (new := from_base64(run)) is not None:
            yield "base64", new, stretch(*m.span(), len(new))
        for part, first, end in base64_parts(run, new is not None):
            yield "base64", part, (place[first], place[end - 1] + 1)
    for m in HEX_LAYER.finditer(text):
        if (new := text_of(bytes.fromhex(m.group()))) is not None:
            yield "hex", new, stretch(*m.span(), len(new))


def deep_scan(text: str) -> list[tuple[str, int, int]]:
    """Spans added by decoded layers: ``kind@how>how`` and the stretch of ``text`` they sit in.

    Of several ways to the same content at the same place a shortest one is named.
    """
    base = {(kind, a, b) for kind, a, b in scan(text)}
    seen, out = set(), set()
    work: deque[tuple[tuple[str, ...], str, Places | None]] = deque([((), text, None)])
    while work:
        path, layer, origin = work.popleft()
        if path:
            for kind, a, b in scan(layer):
                span = (int(origin[0][a]), int(origin[1][b - 1]))
                if (kind, *span) not in base:
                    out.add((f"{kind}@{'>'.join(path)}", *span))
        for how, new, (first, end) in layers_of(layer):
            if origin is not None:
                first, end = origin[0][first], origin[1][end - 1]
            digest = hashlib.sha256(new.encode("utf-8", "surrogatepass"))
            digest.update(first.tobytes())
            digest.update(end.tobytes())
            if digest.digest() not in seen:
                seen.add(digest.digest())
                work.append(((*path, how), new, (first, end)))
    return ordered(list(out))


def suspicious(part: Slice) -> np.ndarray:
    """Texts with anything a rule or a decoder could start from: one pass over the bytes.

    Every rule but the plain hexadecimal one needs a mark of ``_MARKS`` or a run of at
    least ``MIN_BASE64`` base64 characters; hexadecimal stretches are such runs too.
    """
    found = np.zeros(len(part), dtype=bool)
    data = part.data
    marks = np.flatnonzero(_MARKS[data])
    found[np.searchsorted(part.offsets, marks, side="right") - 1] = True
    inside = _BASE64_BYTES[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[part.offsets] = True
    edge[1:-1] |= inside[1:] != inside[:-1]
    places = np.flatnonzero(edge)
    starts, lengths = places[:-1], np.diff(places)
    long = starts[inside[starts] & (lengths >= MIN_BASE64)]
    found[np.searchsorted(part.offsets, long, side="right") - 1] = True
    return found


def scan_secrets(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """id, ``base`` and ``added`` spans (kind, start, end in code points) of each row, whole texts.

    A null text is empty and has no spans. Repeated rows and null ids are kept, a row
    each; other columns are left out; an empty table gives an empty result.
    """
    span = "array<struct<kind: string, start: long, end: long>>"
    arrow = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    kind = docs.schema[id_column].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch.column(1)):
                base: list[list] = [[]] * len(part)
                added: list[list] = [[]] * len(part)
                for k in np.flatnonzero(suspicious(part)).tolist():
                    text = part.data[part.offsets[k] : part.offsets[k + 1]].tobytes().decode("utf-8")
                    base[k], added[k] = scan(text), deep_scan(text)
                lists = [pa.array([[dict(zip(("kind", "start", "end"), s)) for s in spans] for spans in side], arrow) for side in (base, added)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(part.first, len(part)), *lists], names=[id_column, "base", "added"])

    return docs.select(id_column, F.col(text_column).cast("string")).mapInArrow(run, f"`{id_column}` {kind}, base {span}, added {span}")


def joined_spans(spans) -> F.Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


@register("op5_secret_scan")
def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    rank = lambda s: F.struct(s["start"].alias("a"), F.array_position(F.array(*map(F.lit, KINDS)), F.substring_index(s["kind"], "@", 1)).alias("k"), s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))
    every = F.array_sort(F.transform(F.concat("base", "added"), rank))
    return found.select("doc_id", *map(count, KINDS), F.sha2(joined_spans("base"), 256).alias("base_sha256"), joined_spans(every).alias("spans"))
