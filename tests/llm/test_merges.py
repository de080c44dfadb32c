import hashlib
import json
import random

import numpy as np
import pytest
from tokenizers import Tokenizer

from cohortlens.llm import merges

CONTENT = merges.public_specification()
TRUTH = Tokenizer.from_str(CONTENT.decode())
TEXTS = [
    "", " ", "  \n\t ", "a", "Don't they'll we've  two   spaces\n\n and trailing   ", "naïve café Straße niño ñandú",
    "日本語のテキスト と 中文 и русский العربية", "🙂🙃👩‍👩‍👧‍👦 ​﻿", "x" * 700, "ab" * 400 + "123456789" * 40, "áé \x00\x01\x7f",
    "'s 's'S 'LL''ll'll'l x'tis!'s\n'd  've\t're'", "   mixed　blank  'm 'm", "a<|endoftext|>b", "<|endoftext|><|endoftext|> x <|endoftext|",
    "<|endof", "text|>", "it's'", "'", "s", " '", " \x1c\x1d\x85 x", "Ᲊ\U000105c0 \U0001e5f1͸ \U0003fc36", "١٢٣ ½ⅷ 𝟘",
]


@pytest.fixture(scope="module")
def coder():
    return merges.Merges(CONTENT)


def ids_of(coder, texts):
    return [np.frombuffer(code, dtype="<u4").tolist() for code in merges.encoded(coder, (t.encode() for t in texts))]


def truth(texts):
    return [e.ids for e in TRUTH.encode_batch(texts, add_special_tokens=False)]


def test_same_ids_and_texts_as_the_library(coder):
    found = ids_of(coder, TEXTS)
    assert found == truth(TEXTS)
    for text, ids in zip(TEXTS, found, strict=True):
        assert ids_of(coder, [text]) == [ids]
        assert coder.decode(np.array(ids, "<u4").tobytes()) == TRUTH.decode(ids, skip_special_tokens=False) == text


def test_random_strings_in_one_batch(coder):
    rng = random.Random(11)
    letters = "aábcdeéfg hij\n'stmdrevl  äöüß1239.,;$ñ　 🙂漢\t"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(0, 150))) for _ in range(1500)]
    assert ids_of(coder, texts) == truth(texts)


def test_every_code_point(coder):
    points = [p for p in (*range(0xD800), *range(0xE000, 0x30000), *range(0x30000, 0x110000, 61))]
    for at in range(0, len(points), 20_000):
        text = "".join(f"a{chr(p)}1{chr(p)}!{chr(p)} {chr(p)}'s" for p in points[at : at + 20_000])
        assert ids_of(coder, [text]) == truth([text])


def test_any_ids_decode_as_in_the_library(coder):
    rng = random.Random(3)
    for _ in range(300):
        ids = [rng.randrange(50_260) for _ in range(rng.randrange(0, 12))]
        assert coder.decode(np.array(ids, "<u4").tobytes()) == TRUTH.decode(ids, skip_special_tokens=False)


def test_long_texts_and_words_are_cut_without_a_trace(coder, monkeypatch):
    rng = random.Random(8)
    text = "".join(rng.choice(["word", " ", "  ", "\n", "it's", "漢字", "12", ", ", "x" * 50, "<|endoftext|>"]) for _ in range(4000))
    wide = "".join(rng.choice("abcdefgh") for _ in range(30_000))
    want = truth([text, wide])
    monkeypatch.setattr(merges, "CHUNK", 500)
    monkeypatch.setattr(merges, "SLAB", 100)
    monkeypatch.setattr(merges, "GENERATION", 50)
    assert ids_of(merges.Merges(CONTENT), [text, wide]) == want


def test_merges_that_use_later_tokens():
    """Ranks in an order that no training makes: the new pair goes before the next place of the old one."""
    letters = {chr(p): b for p, b in ((0x61, 0), (0x62, 1), (0x63, 2))}
    filler = {c: len(letters) + k for k, c in enumerate(c for c in merges.byte_letters() if c not in letters)}
    vocabulary = {**letters, **filler}
    rules = [("ab", "a"), ("aba", "b"), ("b", "c"), ("a", "b"), ("a", "a"), ("aa", "a"), ("aa", "aa")]
    for a, b in rules:
        vocabulary.setdefault(a + b, len(vocabulary))
    model = {"type": "BPE", "vocab": vocabulary, "merges": [list(r) for r in rules]}
    plain = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
    spec = json.dumps({"version": "1.0", "added_tokens": [], "normalizer": None, "pre_tokenizer": plain, "decoder": plain, "model": model})
    own, library = merges.Merges(spec.encode()), Tokenizer.from_str(spec)
    rng = random.Random(2)
    texts = ["".join(rng.choice("aabbc") for _ in range(rng.randrange(1, 14))) for _ in range(2000)]
    assert ids_of(own, texts) == [e.ids for e in library.encode_batch(texts)]


def test_other_kinds_of_files_are_refused():
    spec = json.loads(CONTENT)
    for change in ({"normalizer": {"type": "NFC"}}, {"pre_tokenizer": {"type": "Whitespace"}}, {"pre_tokenizer": None}):
        with pytest.raises(ValueError):
            merges.Merges(json.dumps({**spec, **change}).encode())


def test_documents(spark):
    rows = [(1, "Hello there, wörld<|endoftext|>", "x", 1), (2, None, "y", 2), (None, "", "z", 3), (3, "again", "u", 4), (3, "again", "u", 5), (4, "many words " * 30_000, "v", 6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string, `key` int").withColumnRenamed("key", "a.b")
    outputs = ("n_tokens", "ids", "ids_sha256", "decoded_sha256")
    out = merges.encode_documents(df, CONTENT, outputs).collect()
    assert len(out) == len(rows)
    texts = {r[0]: r[1] or "" for r in rows}
    for r in out:
        ids = TRUTH.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert (r.n_tokens, r.ids) == (len(ids), ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
    assert merges.encode_documents(df.limit(0), CONTENT).count() == 0
    back = merges.decode_documents(merges.encode_documents(df, CONTENT), CONTENT).collect()
    assert {r.doc_id: r.decoded for r in back} == texts
    with pytest.raises(ValueError):
        merges.encode_documents(df, CONTENT, ("words",))


def test_query_equals_the_library(spark):
    from cohortlens.llm.registry import QUERIES

    folder = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    for r in QUERIES["op11_merge_rounds"](spark, folder).collect():
        ids = TRUTH.encode(docs[r.doc_id], add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(TRUTH.decode(ids, skip_special_tokens=False).encode()).hexdigest()
