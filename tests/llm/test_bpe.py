import base64
import hashlib
import random

import numpy as np
import pytest
import tiktoken

from cohortlens.llm import bpe

CONTENT, PATTERN = bpe.public_vocabulary()
RANKS = bpe.load_ranks(CONTENT)
TRUTH = tiktoken.Encoding("truth", pat_str=PATTERN, mergeable_ranks=RANKS, special_tokens={})
TEXTS = [
    "", " ", "  \n\t ", "a", "Don't they'll we've  two   spaces\n\n and trailing   ", "naïve café Straße niño ñandú",
    "日本語のテキスト と 中文 и русский العربية", "🙂🙃👩‍👩‍👧‍👦 ​﻿", "x" * 700, "ab" * 400 + "123456789" * 40, "<|endoftext|> <s>",
    "áé \x00\x01\x7f", "'s 's'S 'LL", "   mixed　blank",
]


@pytest.fixture(scope="module")
def encoder():
    return bpe.Encoder(RANKS, PATTERN)


def ids_of(encoder, text):
    return np.frombuffer(encoder.encode(text), dtype="<u4").tolist()


@pytest.mark.parametrize("text", TEXTS)
def test_same_ids_as_tiktoken_and_round_trip(encoder, text):
    assert ids_of(encoder, text) == TRUTH.encode_ordinary(text)
    assert encoder.decode(encoder.encode(text)) == text.encode()


def test_random_strings_match_tiktoken(encoder):
    rng = random.Random(5)
    letters = "aábcdeéfg hij\n'stäöüß1239.,;$ñ  "
    for _ in range(300):
        text = "".join(rng.choice(letters) for _ in range(rng.randrange(0, 120)))
        assert ids_of(encoder, text) == TRUTH.encode_ordinary(text)


def test_append_and_edit_equal_encoding_anew(encoder):
    rng = random.Random(9)
    state = bpe.EditableText(encoder, "start of a text")
    for _ in range(200):
        a = rng.randrange(len(state.text) + 1)
        b = min(len(state.text), a + rng.randrange(0, 6))
        new = "".join(rng.choice("ab 'st\n1é,") for _ in range(rng.randrange(0, 7)))
        if rng.random() < 0.3:
            state.append(new)
        else:
            state.replace(a, b, new)
        assert state.ids() == TRUTH.encode_ordinary(state.text)
    long = bpe.EditableText(encoder, "word after word " * 500)
    assert long.replace(4000, 4002, "xy") < 10


def test_prefix_entries_never_change_on_append(encoder):
    table = bpe.PrefixTokens(encoder.vocabulary, b"unbeliev")
    before = list(table.last)
    table.append(b"able")
    assert table.last[: len(before)] == before
    assert table.ids() == TRUTH.encode_ordinary("unbelievable")


def test_documents(spark):
    rows = [(1, "Hello there, wörld", "x"), (2, None, "y"), (None, "", "z"), (3, "again", "u"), (3, "again", "u")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    out = bpe.token_digests(df).collect()
    assert len(out) == 5
    texts = {r[0]: r[1] or "" for r in rows}
    for r in out:
        ids = TRUTH.encode_ordinary(texts[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
    assert bpe.token_digests(df.limit(0)).count() == 0
    ids = bpe.encode_documents(df, CONTENT, PATTERN)
    back = {r.doc_id: bytes(r.decoded).decode() for r in bpe.decode_documents(ids, CONTENT).collect()}
    assert back == texts
    with pytest.raises(ValueError):
        bpe.encode_documents(df, CONTENT, PATTERN, ("words",))


def test_rank_file_reader():
    assert bpe.load_ranks(base64.b64encode(b"ab") + b" 7\n") == {b"ab": 7}
