import base64
import gzip
import random
import re
import zlib
from urllib.parse import quote

import pytest

from cohortlens.llm import secrets as s

KEY = "AKIA" + "Z9" * 8
SECRET = 'password = "hunter2hunter2"'


def b64(data):
    return base64.b64encode(data if isinstance(data, bytes) else data.encode()).decode()


def kinds(text):
    return {k for k, _, _ in s.deep_scan(text)}


def test_base_rules():
    text = f"x {SECRET}; Api_Key:'abc' TOKEN=: secret : a.b-c_d; {KEY} AKIA123 {'ab' * 12} {'0' * 23}z apikey=123456"
    assert [(k, text[a:b]) for k, a, b in s.scan(text)] == [
        ("assign", 'password = "hunter2hunter2'), ("assign", "secret : a.b-c_d"), ("access", KEY), ("hex", "ab" * 12), ("assign", "apikey=123456"),
    ]
    assert s.scan("paſſword=1234567 to\u212aen=1234567") == []  # look-alike letters are not letters here
    assert s.scan("token = token : abcdef") == []  # the first match takes the second name as its value and fails
    assert s.scan("é" * 3 + "token=abcdef")[0][1:] == (3, 15)


@pytest.mark.parametrize("how,wrap", [
    ("base64", b64), ("url", lambda t: "".join(f"%{b:02X}" for b in t.encode())), ("unicode", lambda t: "".join(f"\\u{ord(c):04x}" for c in t)),
    ("hex", lambda t: t.encode().hex()), ("base64", lambda t: b64(zlib.compress(t.encode()))), ("base64", lambda t: b64(gzip.compress(gzip.compress(t.encode())))),
    ("base64", lambda t: base64.urlsafe_b64encode(t.encode()).decode().rstrip("=")),
])
def test_one_layer(how, wrap):
    for plain, kind in ((SECRET + " ok", "assign"), ("my " + KEY + " key", "access")):
        text = f"före {wrap(plain)} after"
        found = [x for x in s.deep_scan(text) if x[0] == f"{kind}@{how}"]
        assert len(found) == 1
        _, a, b = found[0]
        assert 5 <= a < b <= len(text) - 6


def test_nested_layers_map_to_the_outermost_stretch():
    inner = b64(quote(b64(zlib.compress(SECRET.encode()))))
    text = f"é {inner} end"
    found = s.deep_scan(text)
    assert any(k.startswith("assign@base64>") for k, _, _ in found)
    assert {(a, b) for k, a, b in found if k.startswith("assign")} == {(2, 2 + len(inner))}
    mapped = s.deep_scan("to%6ben=abcdefgh and more")
    assert mapped == [("assign@url", 0, 16)]


def test_cycles_and_bad_input_end():
    assert s.deep_scan("%2525252541" * 3) == []
    assert s.deep_scan("\\ud800\\udfff %ff%fe " + "A" * 64 + " " + "/" * 40 + " " + b64(b"\x78\x9c broken")) is not None
    assert s.deep_scan("") == [] and s.deep_scan("\x00" * 50) == []
    assert kinds(b64(b64(b64(SECRET)))) == {"assign@base64>base64>base64"}


@pytest.mark.parametrize("prefix", ["com/files/", "prefix_", "id-", "ab", "x/y_z-q", "abcdefg/"])
@pytest.mark.parametrize("tail", ["", "/more", "_x", " "])
def test_glued_base64(prefix, tail):
    for plain, kind in ((SECRET + " okay", "assign"), ("my " + KEY + " key", "access")):
        for data in (plain.encode(), zlib.compress(plain.encode()), gzip.compress(plain.encode())):
            blob = b64(data) if not tail else b64(data).rstrip("=")
            text = f"see {prefix}{blob}{tail} end"
            a, b = len("see " + prefix), len("see " + prefix + blob)
            found = [x for x in s.deep_scan(text) if x[0] == f"{kind}@base64"]
            assert found and all(x[1] < b and x[2] > a and x[1] >= 4 and x[2] <= len(text) - 4 for x in found), (text, found)


@pytest.mark.parametrize("newline", ["\n", "\r\n", "\n    "])
def test_wrapped_base64(newline):
    noise = " ".join(random.Random(3).choice(["alpha", "beta", "gamma", "delta"]) + str(k) for k in range(60))
    for plain in (noise[:50] + " " + SECRET + " " + noise, noise + " " + KEY + " " + noise):
        for data in (plain.encode(), zlib.compress(plain.encode()), gzip.compress(plain.encode())):
            blob = b64(data)
            lines = newline.join(blob[k : k + 76] for k in range(0, len(blob), 76))
            text = f"before\n{lines}\nafter it all"
            found = [x for x in s.deep_scan(text) if x[0].endswith("@base64")]
            assert any(x[1] == 7 and 7 + len(lines) <= x[2] <= 7 + len(lines + "\nafter") for x in found), found


def test_percent_escaped_streams():
    for plain, kind in ((SECRET, "assign"), ("my " + KEY, "access")):
        for pack in (zlib.compress, gzip.compress):
            for wrap in (quote, lambda d: "".join(f"%{b:02x}" for b in d), lambda d: quote(d, safe="").replace("%20", "+")):
                blob = wrap(pack(plain.encode()))
                text = f"é x?data={blob} end"
                assert (f"{kind}@url", 9, 9 + len(blob)) in s.deep_scan(text)


def brute(text):
    """(kind, start, end) over every path of decoded layers, without any memory of other paths."""
    base, out = set(s.scan(text)), set()

    def walk(layer, places, path):
        if path:
            out.update((k, places[a][0], places[b - 1][1]) for k, a, b in s.scan(layer))
        for _, new, (first, end) in s.layers_of(layer):
            if new not in path:
                walk(new, [(places[a][0], places[b - 1][1]) for a, b in zip(first.tolist(), end.tolist())], (*path, new))

    walk(text, [(k, k + 1) for k in range(len(text))], ())
    return out - base


def test_equal_content_at_several_places():
    blob = b64(SECRET)
    text = f"one {blob} two {blob} three {b64('x ' + blob + ' y')} four {b64('z ' + KEY).encode().hex()} %41 {b64('z ' + KEY)}"
    found = s.deep_scan(text)
    at = [m.start() for m in re.finditer(re.escape(blob), text)]
    assert len(at) == 2 and [(a, b) for k, a, b in found if k == "assign@base64"] == [(a, a + len(blob)) for a in at]
    assert {k for k, _, _ in found} == {"assign@base64", "assign@base64>base64", "access@hex>base64", "access@base64"}

    rng = random.Random(9)
    pool = [SECRET, KEY, blob, b64(KEY + " key"), b64(blob), quote(blob + " " + SECRET), (SECRET + " ok").encode().hex(), "%41", "\\u0041", "word"]
    for _ in range(60):
        text = " ".join(rng.choice(pool) for _ in range(8))
        assert {(k.partition("@")[0], a, b) for k, a, b in s.deep_scan(text)} == brute(text), text


def test_documents(spark):
    rng = random.Random(4)
    pool = [SECRET, KEY, "f" * 30, b64(SECRET), quote(SECRET), "word", "über", "a=b", "%41", "\n", b64(gzip.compress(KEY.encode())), "plain text of some length without marks"]
    rows = [(k, " ".join(rng.choice(pool) for _ in range(rng.randrange(0, 12))), "x") for k in range(60)]
    rows += [(100, None, "x"), (101, "", "x"), (None, KEY, "x"), (7, rows[7][1], "x"), (102, "word " * 60000 + SECRET, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, base string")
    out = s.scan_secrets(df).collect()
    assert len(out) == len(rows)
    for (doc, text, _), r in zip(rows, out):
        assert r.doc_id == doc
        assert [tuple(x) for x in r.base] == s.scan(text or "")
        assert [tuple(x) for x in r.added] == s.deep_scan(text or "")
    assert s.scan_secrets(df.limit(0)).count() == 0


def test_base_kinds_against_plain_regexes():
    rng = random.Random(1)
    for _ in range(300):
        text = "".join(rng.choice(["a", "f", "0", "9", "AKIA", "Z", " ", "token", "=", ":", '"', "Secret", "é", "ab12" * 7]) for _ in range(30))
        want = [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m.group()) >= 24]
        want += [("access", m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m.group()) >= 20]
        assert sorted(x for x in s.scan(text) if x[0] != "assign") == sorted(want)
