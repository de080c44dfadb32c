"""WARC derivatives: linked metadata and plain-text conversion records.

A response record holds an HTTP response. Of each response two records are derived: a
``metadata`` record (title, description, language, links, sizes) and a ``conversion`` record
(the page's plain text). Both carry ``WARC-Refers-To`` with the response's record id, the
target URI and date of the source, its payload digest, and digests of their own blocks.
Record ids are name-based, so a rerun after a lost executor writes the same records.
"""

from __future__ import annotations

import base64
import codecs
import hashlib
import html
import re
import uuid
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .registry import register
from .tables import table

VERSION = b"WARC/1.1"
SPACE = uuid.uuid5(uuid.NAMESPACE_URL, "warc-record")
#: Elements whose content is no text, and elements that end a line.
SILENT = ("script", "style", "noscript", "template", "head")
BLOCKS = set("address article aside blockquote br dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table td th tr ul".split())
MARKUP = re.compile(r"<!--|<[!?]|</?(?=[A-Za-z])")
NAME_END = re.compile(r"[\s/>]")
TAG_MARK = re.compile(r"[>\"']")
#: A name starts where no name goes on, so that a long one is tried once.
ATTRIBUTE = re.compile(r"(?<![^\s=/\"'>])([^\s=/\"'>]++)\s*+=\s*+(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
CLOSERS = {name: re.compile(rf"</{name}\s*>", re.IGNORECASE) for name in (*SILENT, "title", "textarea")}
#: Where a noscript element without an end tag must have ended.
UNCLOSED = re.compile(r"<(?:noscript|body)(?=[\s/>])|</(?:head|body)\s*>", re.IGNORECASE)
IN_HEAD = set("head title base basefont bgsound link meta style script noscript noframes template".split())
BLANKS = re.compile(r"[ \t\r\f\v ]+")
DERIVED = ("metadata", "conversion")
#: Headers of the source that derived records repeat.
KEPT = ("WARC-Target-URI", "WARC-Date", "WARC-IP-Address", "WARC-Warcinfo-ID")
KEPT_NAMES = {name.lower(): name for name in KEPT}
#: Text codecs of Python that are no charset of a page.
NO_CHARSETS = ("idna", "punycode", "raw-unicode-escape", "undefined", "unicode-escape")
ENDLESS = re.compile(r"&#(?:[0-9]{9,}|[xX][0-9a-fA-F]{9,});?")  # of more digits than a character can have


def digest(block: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()


def record_id(*parts: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(SPACE, chr(0).join(parts))}>"


def build_record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """One record: version line, headers (line breaks in values become blanks), block."""
    lines = [VERSION, *(f"{k}: {' '.join(v.split())}".encode() for k, v in headers), f"Content-Length: {len(block)}".encode()]
    return b"\r\n".join(lines) + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> tuple[list[tuple[str, str]], bytes, int]:
    """Headers, block and length of the record that ``data`` starts with."""
    head, found, _ = data.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not found or lines[0] not in (b"WARC/1.0", b"WARC/1.1"):
        raise ValueError("no WARC record starts here")
    headers = []
    for line in lines[1:]:
        name, _, value = line.partition(b":")
        headers.append((name.decode("utf-8", "replace").strip(), value.decode("utf-8", "replace").strip()))
    size = int(next(v for k, v in headers if k.lower() == "content-length"))
    begin = len(head) + 4
    block = data[begin : begin + size]
    if len(block) < size:
        raise ValueError("the record is cut off")
    return headers, block, begin + size + 4


def header(headers: list[tuple[str, str]], name: str) -> str | None:
    return next((v for k, v in headers if k.lower() == name.lower()), None)


def response_record(uri: str, date: str, payload: bytes, name: str) -> bytes:
    """A response record around an HTML payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + payload
    return build_record(
        [
            ("WARC-Type", "response"), ("WARC-Record-ID", record_id("response", name, uri)), ("WARC-Date", date), ("WARC-Target-URI", uri),
            ("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", digest(payload)), ("WARC-Block-Digest", digest(block)),
        ],
        block,
    )


def unchunked(body: bytes) -> tuple[bytes, bool]:
    """The chunks of a chunked body up to its end or to what is no chunk, and whether the end was met."""
    out, at = [], 0
    while (line := body.find(b"\r\n", at)) >= 0:
        digits = body[at:line].split(b";")[0].strip()
        if not re.fullmatch(rb"[0-9A-Fa-f]{1,16}", digits):
            break
        size = int(digits, 16)
        if not size:
            return b"".join(out), True
        out.append(body[line + 2 : line + 2 + size])
        at = line + 4 + size
    return b"".join(out), False


def inflated(body: bytes, wbits: int) -> tuple[bytes, bool]:
    """Content of the streams that ``body`` is made of, as far as they can be read, and whether all of them ended."""
    out = []
    while body:
        stream = zlib.decompressobj(wbits)
        try:
            for at in range(0, len(body), 1 << 16):
                out.append(stream.decompress(body[at : at + (1 << 16)]))
                if stream.eof:
                    break
        except zlib.error:
            return b"".join(out), bool(out) and not body.strip(b"\0")
        if not stream.eof:
            return b"".join(out), False
        body = stream.unused_data + body[at + (1 << 16) :]
        if wbits < 16:
            break  # a deflate body is one stream
    return b"".join(out), True


def http_payload(block: bytes) -> tuple[dict[str, str], bytes | None, list[str]]:
    """HTTP headers (lower-case names), the body decoded where it came chunked or packed, and what was wrong with it.

    Of a broken body the part that can be read; None where its packing is unknown.
    """
    head, _, body = block.partition(b"\r\n\r\n")
    headers, problems = {}, []
    for line in head.split(b"\r\n")[1:]:
        name, _, value = line.partition(b":")
        headers[name.decode("latin-1").strip().lower()] = value.decode("latin-1").strip()
    if "chunked" in headers.get("transfer-encoding", "").lower():
        body, whole = unchunked(body)
        problems += [] if whole else ["the chunked body has no end"]
    for coding in reversed([c.strip() for c in headers.get("content-encoding", "").lower().split(",")]):
        if coding in ("", "identity"):
            continue
        if coding in ("gzip", "x-gzip"):
            body, whole = inflated(body, zlib.MAX_WBITS | 16)
        elif coding == "deflate":  # with the zlib header as it should be, or without as some servers send it
            plain, whole = inflated(body, zlib.MAX_WBITS)
            if not whole and not plain:
                plain, whole = inflated(body, -zlib.MAX_WBITS)
            body = plain
        else:
            return headers, None, [*problems, f"unknown content coding {coding}"]
        problems += [] if whole else [f"the {coding} body is broken"]
    return headers, body, problems


def page_text(http: dict[str, str], body: bytes) -> str:
    """The body as text in the charset that its headers or its first bytes name; UTF-8 if that can't be used."""
    found = re.search(r"charset=[\"']?([\w.:-]+)", http.get("content-type", ""), re.I) or re.search(rb"<meta[^<>]+charset=[\"']?([\w.:-]+)", body[:2048], re.I)
    name = found.group(1) if found else "utf-8"
    name = name.decode("ascii") if isinstance(name, bytes) else name
    try:
        name = codecs.lookup(name).name
        return body.decode("utf-8" if name in NO_CHARSETS else name, "replace")
    except (LookupError, UnicodeError):
        return body.decode("utf-8", "replace")


def unescape(text: str) -> str:
    try:
        return html.unescape(text)
    except ValueError:  # a number of thousands of digits
        return html.unescape(ENDLESS.sub("\ufffd", text))


class Ahead:
    """The next match of a pattern. Places asked for never go back, so a page is searched once."""

    def __init__(self, pattern: re.Pattern, page: str):
        self.pattern, self.page, self.asked, self.found = pattern, page, False, None

    def __call__(self, at: int) -> re.Match | None:
        if not self.asked or self.found and self.found.start() < at:
            self.asked, self.found = True, self.pattern.search(self.page, at)
        return self.found


class Tags:
    """Where tags end: at the first ``>`` outside of quotes. A quote that never closes is none."""

    def __init__(self, page: str):
        self.page = page
        self.name_end = Ahead(NAME_END, page)
        self.marks = [m.start() for m in TAG_MARK.finditer(page)]
        self.ends = [-1] * (len(self.marks) + 1)
        closing: dict[str, int] = {}
        for k in range(len(self.marks) - 1, -1, -1):
            mark = page[self.marks[k]]
            self.ends[k] = self.marks[k] if mark == ">" else self.ends[closing.get(mark, k) + 1]
            closing[mark] = k

    def __call__(self, at: int) -> tuple[int, int] | None:
        """End of the name that starts at ``at``, and place of the ``>`` of its tag."""
        name = self.name_end(at)
        end = self.ends[bisect_left(self.marks, name.start())] if name else -1
        return (name.start(), end) if end >= 0 else None


def content_end(closers: dict[str, Ahead], page: str, name: str, at: int, in_head: bool) -> tuple[int, int]:
    """Where the content from ``at`` of an element without markup ends, and where the page goes on.

    An unclosed title ends at the next tag, an unclosed noscript at once, so that what follows is
    read as the page; others end with the head they are in, else with the page.
    """
    end = closers[name](at)
    stop = closers["head"](at) if in_head else None
    if name == "noscript":
        stop = closers["unclosed"](at)
        if not end or stop and stop.start() < end.start():
            return at, at
    elif stop and (not end or stop.start() < end.start()) or name == "title" and not end:
        cut = page.find("<", at) if name == "title" else stop.start()
        cut = len(page) if cut < 0 else cut
        return cut, cut
    return (end.start(), end.end()) if end else (len(page), len(page))


def read_page(page: str) -> dict:
    """Text, title, description, language and links of an HTML page, in one pass over its tags.

    A head holds no text of its own: it ends at its end tag, at the first tag that can't be inside
    it, or at text. Time grows with the length of the page, whatever is left open in it.
    """
    out, links = [], []
    found = {"title": "", "description": "", "lang": ""}
    tags = Tags(page)
    closers = {name: Ahead(pattern, page) for name, pattern in (*CLOSERS.items(), ("unclosed", UNCLOSED))}
    at, seek, in_head = 0, 0, False
    while m := MARKUP.search(page, seek):
        seek = m.end()
        opening, name = m.group() == "<", ""
        if m.group() == "<!--":
            end = page.find("-->", seek)
            end = end + 3 if end >= 0 else len(page)
        elif m.group() in ("<!", "<?"):
            end = page.find(">", seek) + 1
            if not end:
                break  # nor can any other tag end
        else:
            ends = tags(seek)
            if not ends:
                continue
            name, inside, end = page[seek : ends[0]].lower(), page[ends[0] : ends[1]], ends[1] + 1
        between = page[at : m.start()]
        out.append(unescape(between).replace("\n", " "))
        at = seek = end
        if not name:
            continue
        attributes = {k.lower(): unescape(a or b or c) for k, a, b, c in ATTRIBUTE.findall(inside)} if opening and inside else {}
        in_head = (in_head or name == "head" and opening) and name in IN_HEAD and (opening or name != "head") and (name == "head" or not between.strip())
        if opening and name in CLOSERS and name != "head" and not inside.endswith("/"):
            end, on = content_end(closers, page, name, at, in_head)
            content = page[at:end]
            if name == "title" and not found["title"]:
                found["title"] = " ".join(unescape(content).split())
            if name == "textarea":
                out.append(unescape(content))
            at = seek = on
        elif name in BLOCKS:
            out.append("\n")
        if name == "html" and "lang" in attributes:
            found["lang"] = attributes["lang"]
        if name == "meta" and attributes.get("name", "").lower() == "description":
            found["description"] = " ".join(attributes.get("content", "").split())
        if name == "a" and attributes.get("href"):
            links.append(attributes["href"])
    out.append(unescape(page[at:]).replace("\n", " "))
    lines = (BLANKS.sub(" ", line).strip() for line in "".join(out).split("\n"))
    return found | {"links": links, "text": "\n".join(line for line in lines if line)}


def derive(record: bytes) -> list[tuple[str, bytes]]:
    """The metadata and the conversion record of a response record; none of another record.

    What was wrong with a body stands in ``source-problem`` of the metadata. A body in an unknown
    packing has no text, so it has a metadata record only.
    """
    headers, block, _ = parse_record(record)
    if header(headers, "WARC-Type") != "response":
        return []
    http, body, problems = http_payload(block)
    source = header(headers, "WARC-Record-ID") or record_id("unknown", digest(block))
    sent = block.partition(b"\r\n\r\n")[2] if body is None else body
    payload = header(headers, "WARC-Payload-Digest") or digest(sent)
    page = read_page("" if body is None else page_text(http, body))
    kept = [(KEPT_NAMES[k.lower()], v) for k, v in headers if k.lower() in KEPT_NAMES]
    fields = [("title", page["title"]), ("description", page["description"]), ("language", page["lang"])]
    fields += [("source-content-type", http.get("content-type", "")), ("source-bytes", str(len(sent)))]
    fields += [("source-problem", problem) for problem in problems] + [("outlink", link) for link in page["links"]]
    blocks = {"metadata": ("application/warc-fields", "".join(f"{k}: {' '.join(v.split())}\r\n" for k, v in fields if v).encode("utf-8", "replace"))}
    if body is not None:
        blocks["conversion"] = ("text/plain; charset=utf-8", page["text"].encode("utf-8", "replace"))
    ids = {kind: record_id(kind, source) for kind in DERIVED}
    out = []
    for kind, (content_type, own) in blocks.items():
        links = [("WARC-Refers-To", source), ("WARC-Refers-To-Payload-Digest", payload)]
        links += [("WARC-Concurrent-To", ids[other]) for other in blocks if other != kind]
        out.append((kind, build_record([("WARC-Type", kind), ("WARC-Record-ID", ids[kind]), *kept, *links, ("Content-Type", content_type), ("WARC-Block-Digest", digest(own))], own)))
    return out


def page_responses(pages: DataFrame, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """(page_id, record): a response record of each row of ``pages`` (page_id, url, html).

    A null url or html is empty. Record ids name the page id and url, so a repeated row is
    the same record again.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                rows = zip(*(part.column(k).to_pylist() for k in range(3)))
                records = [response_record(url or "", date, (page or "").encode(), str(key)) for key, url, page in rows]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(records, pa.binary())], names=["page_id", "record"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(run, f"page_id {kind}, record binary")


def derived_records(responses: DataFrame) -> DataFrame:
    """Two rows (metadata, conversion) of each response ``record``, with its ``page_id``.

    Columns: page_id, warc_type, record_id, refers_to, target_uri, payload_digest (of the source),
    block_digest, block_length, block, record. Rows that hold no record, or no response
    record, give nothing, nor does a record that is cut off; a response whose body is broken gives
    what can be read of it, one in an unknown packing its metadata only. Repeated rows give
    repeated records. Other columns are left out; an empty table gives an empty result.
    """
    kind = responses.schema["page_id"].dataType.simpleString()
    names = ["page_id", "warc_type", "record_id", "refers_to", "target_uri", "payload_digest", "block_digest", "block_length", "block", "record"]
    schema = f"page_id {kind}, warc_type string, record_id string, refers_to string, target_uri string, payload_digest string, block_digest string, block_length long, block binary, record binary"
    types = [None, *[pa.string()] * 6, pa.int64(), pa.binary(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows = []
                for key, record in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    try:
                        made = derive(record) if record else []
                    except (ValueError, StopIteration):
                        made = []
                    for kind_, data in made:
                        h, block, _ = parse_record(data)
                        rows.append((key, kind_, *(header(h, n) for n in ("WARC-Record-ID", "WARC-Refers-To", "WARC-Target-URI", "WARC-Refers-To-Payload-Digest", "WARC-Block-Digest")), len(block), block, data))
                columns = list(zip(*rows)) or [()] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(c, t or part.column(0).type) for c, t in zip(columns, types)], names=names)

    return responses.select("page_id", "record").mapInArrow(run, schema)


@register("op9_warc_derivatives")
def op9_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = derived_records(page_responses(table(spark, sf_dir, "pages")))
    return made.select(
        "page_id", "warc_type", "record_id", "refers_to", "target_uri", "payload_digest", "block_digest", "block_length",
        F.sha2("block", 256).alias("block_sha256"), F.sha2("record", 256).alias("record_sha256"),
    )
