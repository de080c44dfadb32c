import hashlib

import numpy as np
import pytest
import test_contamination
import test_jaccard
import test_lines
import test_quality
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline as p
from cohortlens.llm import bpe, quality

CONTENT, PATTERN = bpe.public_vocabulary()
TRUTH = tiktoken.Encoding("truth", pat_str=PATTERN, mergeable_ranks=bpe.load_ranks(CONTENT), special_tokens={})
FOLDER = "/root/testdata/sf0.001"


def verdict(text, lang, vocabularies):
    m = test_quality.brute(text, vocabularies)
    if m["n_words"] < 20 or 100 * m["n_repeat_words"] > 30 * m["n_words"]:
        return False
    band = quality.BANDS[lang]
    n = m["n_tokens"]
    return (
        band.chars_per_token[0] <= m["word_chars"] / n <= band.chars_per_token[1]
        and band.chars_per_byte_token[0] <= m["word_chars"] / m["n_level_tokens"] <= band.chars_per_byte_token[1]
        and m["n_byte_tokens"] / n <= band.max_byte_share
        and m["entropy"] / np.log2(max(2, min(n, 1024))) >= band.min_entropy
    )


def test_every_stage_equals_brute_force(spark):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_proto=test_quality.MODEL)
    vocabularies = sp, tiktoken.Encoding("levels", pat_str=test_quality.PATTERN, mergeable_ranks=test_quality.RANKS, special_tokens={})
    docs = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").orderBy("doc_id").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]

    want = [d for d in docs if verdict(d[1], d[2], vocabularies)]
    frame = spark.read.parquet(f"{FOLDER}/documents.parquet")
    got = p.quality_rules(spark, frame, FOLDER)
    assert got.schema == frame.schema and sorted(map(tuple, got.collect())) == want and 0 < len(want) < len(docs)

    gone = test_lines.brute([d[:2] for d in want])
    cut = []
    for d, g in zip(want, gone):
        text = "\n".join(x for k, x in enumerate(d[1].split("\n")) if k not in g)
        if not g or text.split():
            cut.append((d[0], text, d[2], d[3], len(text) if g else d[4]))
    got = p.line_dedup(spark, spark.createDataFrame(want, frame.schema), FOLDER)
    assert got.columns == frame.columns and sorted(map(tuple, got.collect())) == cut and any(gone)

    names = {doc: name for doc, _, name in test_jaccard.brute([d[:2] for d in cut], 80, 5)}
    near = [d for d in cut if names[d[0]] == d[0]]
    got = p.ngram_jaccard_join(spark, spark.createDataFrame(cut, frame.schema), FOLDER)
    assert got.columns == frame.columns and sorted(map(tuple, got.collect())) == near

    clean = [d for d in near if not test_contamination.brute(d[1], items, 10)[1]]
    got = p.benchmark_decontamination(spark, spark.createDataFrame(near, frame.schema), FOLDER)
    assert got.schema == frame.schema and sorted(map(tuple, got.collect())) == clean and len(clean) < len(near)

    tokens = {d[0]: TRUTH.encode_ordinary(d[1]) for d in clean}
    rows = p.run(spark, FOLDER).collect()
    assert {r.doc_id: r.ids for r in rows} == tokens and len(rows) == len(tokens)
    for r in rows:
        assert r.n_tokens == len(r.ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(r.ids, "<u4").tobytes()).hexdigest()


def test_near_copies_leave_one(spark):
    text = " ".join(f"w{k}" for k in range(200))
    rows = [(4, text, "en", "a", 1), (2, text.replace("w7 ", "x7 "), "en", "a", 1), (2, text.replace("w7 ", "x7 "), "en", "a", 1), (None, text, "en", "b", 1), (9, None, "en", "b", 1), (8, "other", None, "b", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r.doc_id for r in p.ngram_jaccard_join(spark, df, FOLDER).collect()) == [2, 8, 9]


def test_near_copies_with_spread_changes(spark):
    """Six spread changes in 300 words: 80 percent of the five-word shingles are shared, 90 of the three-word ones are not."""
    words = [f"w{k}" for k in range(300)]
    one = " ".join("x" if k % 50 == 25 else w for k, w in enumerate(words))
    far = " ".join("y" if k % 30 == 15 else w for k, w in enumerate(words))
    a, b, c = (test_jaccard.shingles(t, 5) for t in (" ".join(words), one, far))
    assert len(a & b) >= 0.8 * len(a | b) and len(a & c) < 0.8 * len(a | c) and len(b & c) < 0.8 * len(b | c)
    a, b = (test_jaccard.shingles(t) for t in (" ".join(words), one))
    assert len(a & b) < 0.9 * len(a | b)
    rows = [(1, " ".join(words), "en", "a", 1), (2, one, "en", "a", 1), (3, far, "en", "a", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r.doc_id for r in p.ngram_jaccard_join(spark, df, FOLDER).collect()) == [1, 3]


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, apply in p.STAGES:
        out = apply(spark, df, FOLDER)
        assert out.count() == 0


NAMES = ["id", "mark", "row", "gone", "n_removed", "first", "__id", "__mark", "__gone", "__text", "sig", "lead", "leads", "label", "node", "kept", "n_words", "n_hit", "component_id", "a.b", "c d", "e`f", "line_no", "tokens"]


@pytest.mark.parametrize("name,apply", p.STAGES[:-1])
def test_columns_of_any_name_pass_unchanged(spark, name, apply):
    """Every internal name as an input column, with dots, blanks and nulls."""
    source = spark.read.parquet(f"{FOLDER}/documents.parquet").where("doc_id < 120")
    plain = {r.doc_id: r.text for r in apply(spark, source, FOLDER).collect()}
    extra = source.select("*", *((F.when(F.col("doc_id") % 3 > 0, F.col("doc_id") + k)).alias(c) for k, c in enumerate(NAMES)))
    out = apply(spark, extra, FOLDER)
    assert out.columns == extra.columns
    rows = [r.asDict() for r in out.collect()]
    assert {r["doc_id"]: r["text"] for r in rows} == plain and len(rows) == len(plain) > 0
    for r in rows:
        assert [r[c] for c in NAMES] == [r["doc_id"] + k if r["doc_id"] % 3 else None for k in range(len(NAMES))]
