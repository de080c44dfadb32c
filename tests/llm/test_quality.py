import math
import random
import re
from collections import Counter

import pytest
import sentencepiece
import tiktoken

from cohortlens.llm import quality as q

MODEL, RANKS, PATTERN = q.public_vocabularies()


@pytest.fixture(scope="module")
def vocabularies():
    sp = sentencepiece.SentencePieceProcessor(model_proto=MODEL)
    return sp, tiktoken.Encoding("levels", pat_str=PATTERN, mergeable_ranks=RANKS, special_tokens={})


def brute(text, vocabularies):
    sp, levels = vocabularies
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    runs = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    cover = {i + k for i in range(len(words) - 7) if runs[tuple(words[i : i + 8])] > 1 for k in range(8)}
    ids = [k for w in words for k in sp.encode(w)]
    n = len(ids)
    entropy = -sum(c / n * math.log2(c / n) for c in Counter(ids).values()) if n else 0.0
    return {
        "n_words": len(words),
        "word_chars": sum(map(len, words)),
        "n_symbols": len(re.findall(r"[#*$%&|<>]", text)),
        "n_dup_lines": dup,
        "n_repeat_words": len(cover),
        "n_tokens": n,
        "n_byte_tokens": sum(sp.is_byte(k) for k in ids),
        "n_level_tokens": sum(len(levels.encode_ordinary(" " + w)) for w in words),
        "entropy": entropy,
    }


def texts():
    rng = random.Random(2)
    pool = "the of and été größer mañana слово 漢字 🙂 a|b #x $$$ loop".split()
    out = ["", " \t\x0b", "one", "same line\nsame line\n\n\nsame line \nother\nother", "\n", "a\nb\na"]
    for _ in range(40):
        words = [rng.choice(pool) for _ in range(rng.randrange(1, 80))]
        if rng.random() < 0.4:
            words += words[:12] + words[:9]
        out.append("".join(w + rng.choice([" ", "  ", "\n", "\r\n"]) for w in words))
    return out


def test_measures_equal_brute_force(spark, vocabularies):
    cases = texts() + ["deep " * 30000]
    df = spark.createDataFrame([(k, t, "en", k) for k, t in enumerate(cases)], "doc_id long, text string, lang string, entropy int")
    found = {r.doc_id: r.asDict() for r in q.rate_documents(df).collect()}
    assert len(found) == len(cases)
    for k, t in enumerate(cases):
        want = brute(t, vocabularies)
        got = found[k]
        assert abs(got["entropy"] - want.pop("entropy")) < 1e-9
        assert {c: got[c] for c in want} == want
        failed = want["n_words"] < 20 or 100 * want["n_repeat_words"] > 30 * want["n_words"]
        assert got["base_failed"] == failed
        assert not (failed and got["kept"])


def test_bands(spark):
    prose = "There is a tide in the affairs of men which taken at the flood leads on to fortune and omitted all the voyage of their life is bound in shallows"
    marked = " ".join(w + "$$$###" for w in prose.split())
    shout = "A! B? C; " * 3 + "Ж漢🙂Ω ᚠᚢ " * 40
    russian = "Все счастливые семьи похожи друг на друга каждая несчастливая семья несчастлива по своему и все смешалось в доме и никто не знал что делать дальше"
    rows = [(1, prose, "en"), (2, marked, "en"), (3, shout, "en"), (4, prose, None), (5, russian, "ru"), (6, None, "en"), (None, prose, "xx"), (1, prose, "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    out = q.rate_documents(df).collect()
    assert len(out) == len(rows)
    kept = [(r.doc_id, r.band, r.kept) for r in out]
    assert kept == [(1, "en", True), (2, "en", False), (3, "en", False), (4, "latin", True), (5, "cyrillic", True), (6, "en", False), (None, "latin", True), (1, "en", True)]
    assert q.rate_documents(df.limit(0)).count() == 0
