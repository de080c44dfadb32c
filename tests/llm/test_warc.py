import base64
import gzip
import hashlib
import time
import uuid
import zlib
from html.parser import HTMLParser

import pytest

from cohortlens.llm import warc as w

PAGE = """<!DOCTYPE html><html lang="fr"><head><title>A &amp; B
 c</title><meta name="description" content="what  it is"><style>p{x:"</p>"}</style><script>var t="</p>";</script>
</head><body><nav><ul><li><a href="/x?a=1&amp;b=2">one</a></li><li><a href='two'>two</a></ul></nav><!-- no <b>text</b> -->
<p>Some&nbsp;<b>bold</b> t&eacute;xt<br>next   line<p>open <a title="a > b" href=three>three</a></p><textarea><b>raw</b></textarea></body></html>"""


class Plain(HTMLParser):
    """Visible text by the standard parser, without white space."""

    def __init__(self):
        super().__init__()
        self.skip, self.out = 0, []

    def handle_starttag(self, tag, attrs):
        self.skip += tag in w.SILENT

    def handle_endtag(self, tag):
        self.skip -= tag in w.SILENT and self.skip > 0

    def handle_data(self, data):
        if not self.skip:
            self.out.append(data)


def squeezed(text):
    return "".join(text.split())


def test_page():
    page = w.read_page(PAGE)
    assert page["text"] == "one\ntwo\nSome bold téxt\nnext line\nopen three\n<b>raw</b>".replace("\n<b>", "\n<b>")
    assert (page["title"], page["description"], page["lang"]) == ("A & B c", "what it is", "fr")
    assert page["links"] == ["/x?a=1&b=2", "two", "three"]
    for broken in ("", "<", "<p", "a < b > c", "<script>never closed", "<!-- open", "</p></p>", "<a href=>x</a>"):
        w.read_page(broken)


@pytest.mark.parametrize("page,text", [
    ("<head><title>T</title><body><p>text", "text"),
    ("<html><head><meta charset=utf-8><title>T</title><link rel=x><p>one<p>two <a href=/l>three</a>", "one\ntwo three"),
    ("<head><title>T</title><script>var a;</script>\n plain <b>text</b>", "plain text"),
    ("<head><title>T</title><noscript><link rel=x><body>text", "text"),
    ("<head><title>T</title><noscript><link rel=x></head><body>text<noscript>no</noscript> on", "text on"),
    ("<head><title>T</head><body>text", "text"),
    ("<head><title>T</title><style>p{}</head><body>text", "text"),
    ("<title>T<body>text", "text"),
    ("<head><title>T</title></head><body>a<noscript><img src=x>b<p>c", "ab\nc"),
    ("<head><title>T</title></head><body>a<noscript><p>no</p></noscript>b", "ab"),
    ("<head><title>T</title><noscript><style>x</style></noscript><p>a", "a"),
])
def test_omitted_end_tags(page, text):
    read = w.read_page(page)
    assert (read["title"], read["text"]) == ("T", text)
    assert read["links"] == (["/l"] if "/l" in page else [])
    record = w.response_record("http://e.org", "2024-05-05T00:00:00Z", page.encode(), "1")
    assert w.parse_record(w.derive(record)[1][1])[1].decode() == text


def test_text_equals_the_standard_parser(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()
    for row in pages:
        plain = Plain()
        plain.feed(row.html)
        assert squeezed(w.read_page(row.html)["text"]) == squeezed("".join(plain.out))


def test_links_and_digests():
    source = w.response_record("http://e.org/a\r\nb", "2024-05-05T00:00:00Z", PAGE.encode(), "1")
    headers, block, size = w.parse_record(source)
    assert size == len(source)
    (m, metadata), (c, conversion) = w.derive(source)
    assert (m, c) == ("metadata", "conversion")
    mh, mb, _ = w.parse_record(metadata)
    ch, cb, _ = w.parse_record(conversion)
    for h, b in ((mh, mb), (ch, cb)):
        assert w.header(h, "WARC-Refers-To") == w.header(headers, "WARC-Record-ID")
        assert w.header(h, "WARC-Date") == "2024-05-05T00:00:00Z" and w.header(h, "WARC-Target-URI") == "http://e.org/a b"
        assert w.header(h, "WARC-Refers-To-Payload-Digest") == "sha1:" + base64.b32encode(hashlib.sha1(PAGE.encode()).digest()).decode()
        assert w.header(h, "WARC-Block-Digest") == w.digest(b)
        uuid.UUID(w.header(h, "WARC-Record-ID")[10:-1])
    assert w.header(mh, "WARC-Concurrent-To") == w.header(ch, "WARC-Record-ID")
    assert cb.decode() == w.read_page(PAGE)["text"]
    assert b"title: A & B c\r\n" in mb and b"outlink: two\r\n" in mb
    assert w.derive(metadata) == []
    with pytest.raises(ValueError):
        w.parse_record(source[: len(source) - 10])


def test_chunked_packed_and_other_charsets():
    body = gzip.compress("<p>größe</p>".encode("latin-1"))
    chunks = b"".join(b"%x\r\n%s\r\n" % (len(x), x) for x in (body[:7], body[7:])) + b"0\r\n\r\n"
    block = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\nContent-Encoding: gzip\r\nContent-Type: text/html; charset=iso-8859-1\r\n\r\n" + chunks
    record = w.build_record([("WARC-Type", "response"), ("WARC-Record-ID", "<urn:x>")], block)
    assert w.parse_record(w.derive(record)[1][1])[1].decode() == "größe"


def test_tables(spark):
    rows = [(1, "http://a", PAGE, b"x"), (2, None, None, b"x"), (None, "http://b", "", b"x"), (1, "http://a", PAGE, b"x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, record binary")
    out = w.derived_records(w.page_responses(df)).collect()
    assert sorted((r.page_id or -1, r.warc_type) for r in out) == sorted((k or -1, t) for k, *_ in rows for t in w.DERIVED)
    assert len({r.record_id for r in out}) == 6
    assert all(w.digest(bytes(r.block)) == r.block_digest and len(r.block) == r.block_length for r in out)
    bad = spark.createDataFrame([(1, None), (2, b""), (3, b"junk"), (4, b"WARC/1.1\r\nWARC-Type: response\r\n\r\n")], "page_id long, record binary")
    assert w.derived_records(bad).count() == 0
    assert w.derived_records(w.page_responses(df.limit(0))).count() == 0


def response(headers, body, names=("WARC-Type", "WARC-Record-ID", "WARC-Target-URI", "WARC-Date")):
    values = ("response", "<urn:x>", "http://e.org/", "2024-05-05T00:00:00Z")
    block = "".join(f"{k}: {v}\r\n" for k, v in headers).encode("latin-1")
    return w.build_record(list(zip(names, values)), b"HTTP/1.1 200 OK\r\n" + block + b"\r\n" + body)


def blocks(record):
    return {kind: w.parse_record(data)[1].decode() for kind, data in w.derive(record)}


def test_header_names_in_any_case():
    for names in (("warc-type", "warc-record-id", "warc-target-uri", "warc-date"), ("WARC-TYPE", "WARC-RECORD-ID", "WARC-TARGET-URI", "WARC-DATE")):
        for _, data in w.derive(response([], b"<p>x", names)):
            h = w.parse_record(data)[0]
            assert ("WARC-Target-URI", "http://e.org/") in h and ("WARC-Date", "2024-05-05T00:00:00Z") in h
            assert w.header(h, "WARC-Refers-To") == "<urn:x>"


@pytest.mark.parametrize("charset", ["idna", "undefined", "nothing", "hex", "punycode\xe9"])
def test_charsets_that_cannot_be_used(charset):
    assert blocks(response([("Content-Type", f"text/html; charset={charset}")], "<p>größe".encode()))["conversion"] in ("größe",)


def test_packed_and_broken_bodies_lose_no_page():
    html = ("<title>T</title>" + "".join(f"<p>line {k * k}" for k in range(400))).encode()
    text = w.read_page(html.decode())["text"]
    raw = zlib.compressobj(wbits=-15)
    raw = raw.compress(html) + raw.flush()
    for coding, body in (("deflate", zlib.compress(html)), ("deflate", raw), ("gzip", gzip.compress(html[:900]) + gzip.compress(html[900:])), ("gzip, deflate", zlib.compress(gzip.compress(html))), ("identity", html)):
        made = blocks(response([("Content-Encoding", coding)], body))
        assert made["conversion"] == text and "source-problem" not in made["metadata"], coding
    for coding, body in (("gzip", gzip.compress(html)[:-300]), ("deflate", zlib.compress(html)[:-300])):
        made = blocks(response([("Content-Encoding", coding)], body))
        assert text.startswith(made["conversion"][:-12]) and len(made["conversion"]) > 100 and f"source-problem: the {coding} body is broken\r\n" in made["metadata"]
    made = blocks(response([("Content-Encoding", "gzip")], b"no stream"))
    assert made["conversion"] == "" and "source-problem: the gzip body is broken\r\n" in made["metadata"]
    made = w.derive(response([("Content-Encoding", "br")], b"\x8b\x02\x80ab\x03"))
    assert [kind for kind, _ in made] == ["metadata"] and b"source-problem: unknown content coding br\r\n" in made[0][1] and b"Concurrent" not in made[0][1]
    chunks = b"".join(b"%x;q=1\r\n%s\r\n" % (len(html[k : k + 7]), html[k : k + 7]) for k in range(0, len(html), 7))
    for end, problem in ((b"0\r\n\r\n", False), (b"", True), (b"zz\r\nrest", True)):
        made = blocks(response([("Transfer-Encoding", "chunked")], chunks + end))
        assert made["conversion"] == text and ("source-problem: the chunked body has no end" in made["metadata"]) == problem


def test_unclosed_quotes_are_no_quotes():
    page = w.read_page("""<p>one</p><a href="/x>two</a> <b>three</b>""")
    assert page["text"] == "one\ntwo three"
    assert w.read_page("""<a title='it"s' href="/l">x</a><i class="q>y</i>""")["links"] == ["/l"]
    assert w.read_page("a < b <3 <x")["text"] == "a < b <3 <x"
    assert w.read_page("&#" + "9" * 5000 + "; <b>x</b> &#65;")["text"] == "\ufffd x A"


@pytest.mark.parametrize("piece", ['<a "', "<a '", "<a", "<!", "<!-", "<noscript>", "<title>", "<head><script></head>", "<body ", "<head><title>", "<a\"'", "&#9", "<a x=' y=\"", "a=<"])
def test_time_grows_with_length(piece):
    page = piece * (1_000_000 // len(piece))
    begin = time.process_time()
    w.read_page(page)
    w.read_page("<a " + page + ">")
    w.read_page("<a " + "b" * 500_000 + ">" + page[:500_000] + '"')
    assert time.process_time() - begin < 20
