import random
import re

import pytest

from cohortlens.llm import contamination as c

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in text)


def brute(text, items, size):
    """n_words, hit word numbers, items and the text without the hit words' runs."""
    text = text or ""
    found = list(WORD.finditer(lower(text)))
    words = [m.group() for m in found]
    hit, ids = set(), set()
    for item, item_text in items:
        w = WORD.findall(lower(item_text or ""))
        n = min(size, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            for j in range(len(words) - n + 1):
                if words[j : j + n] == w[i : i + n]:
                    hit |= set(range(j, j + n))
                    if item is not None:
                        ids.add(item)
    kept, at = "", 0
    for k in sorted(hit):
        if k - 1 not in hit:
            last = k
            while last + 1 in hit:
                last += 1
            kept += text[at : found[k].start()]
            at = found[last].end()
    return len(words), len(hit), sorted(ids), kept + text[at:]


@pytest.fixture(scope="module")
def case(spark):
    rng = random.Random(3)
    pool = ["été", "Lorem", "ipsum", "DOLOR", "x1", "42", "naïve", "sit", "amet", "end"]
    items = [(n, " ".join(rng.choice(pool) for _ in range(rng.choice([2, 4, 6, 9])))) for n in range(8)]
    items += [(20, None), (21, ""), (22, "... !!"), (None, "secret passage of null item"), (23, items[0][1]), (23, items[0][1])]
    docs = []
    for n in range(60):
        words = [rng.choice(pool) for _ in range(rng.randrange(0, 40))]
        text = "".join(w + rng.choice([" ", "\n", ", ", "--"]) for w in words)
        if n % 3 == 0:
            text += rng.choice(items[:8])[1].upper().replace("É", "é") + "! " + text
        docs.append((n, text, "de"))
    docs += [(100, None, "x"), (101, "", "x"), (None, items[2][1], "x"), (5, docs[5][1], "x"), (102, "a secret, passage OF null item?", "y"), (103, "lorem " * 20000, "z")]
    b = spark.createDataFrame(items, "item_id long, text string")
    d = spark.createDataFrame(docs, "doc_id long, text string, items string")
    return docs, items, d, b


@pytest.mark.parametrize("max_bytes", [c.MAX_BYTES, 60])
def test_scan_equals_brute_force(case, max_bytes):
    docs, items, d, b = case
    rows = c.scan(d, b, size=5, max_bytes=max_bytes).collect()
    assert len(rows) == len(docs)
    left = sorted((repr(x.doc_id), x.text or "", x.n_words, x.n_hit, x["items"]) for x in rows)
    right = sorted((repr(i), t or "", *brute(t, items, 5)[:3]) for i, t, _ in docs if i != 103)
    assert [x for x in left if x[0] != "103"] == right
    cut = {(r.doc_id, r.text) for r in c.remove_spans(d, b, size=5, max_bytes=max_bytes).collect()}
    for i, t, _ in docs:
        if i != 103:
            assert (i, brute(t, items, 5)[3]) in cut


def test_empty_tables(case):
    _, _, d, b = case
    assert c.scan(d.limit(0), b).count() == 0
    assert c.scan(d, b.limit(0)).where("n_hit > 0").count() == 0
    assert c.clean_ids(d, b.limit(0)).count() == d.count()
