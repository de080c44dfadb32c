"""Quality rules: plain text measures, then tokeniser fertility against bands.

Fertility is measured with two public vocabularies. A subword vocabulary with byte
fallback gives characters per token, the share of tokens that fall back to single bytes,
and the entropy of a text's tokens; a byte-level vocabulary gives characters per token a
second time. Texts in the language and script a vocabulary was made for have few, varied
tokens; markup, shouting, broken encodings and looped text do not. A document is rejected
when a measure leaves the band of its language or, where the language has none, of the
script most of its letters belong to.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrays import BLANK_WORDS, Rolling, Slice, byte_class, characters, in_one, pair, ragged, slices, windows, words_of
from .registry import register
from .tables import table

MIN_WORDS = 20
REPEAT_WINDOW = 8
MAX_REPEAT_PERCENT = 30
SYMBOLS = np.zeros(256, dtype=bool)
SYMBOLS[list(b"#*$%&|<>")] = True
WORD_CACHE = 400_000  # distinct words a task keeps with their tokens; a full cache starts anew


@dataclass(frozen=True)
class Band:
    """Accepted ranges. Entropy is in bits per token over the bits of as many different tokens."""

    chars_per_token: tuple[float, float]
    chars_per_byte_token: tuple[float, float]
    max_byte_share: float
    min_entropy: float


#: Bands by language code, then by script; ``other`` is for everything else.
BANDS: dict[str, Band] = {
    "en": Band((1.65, 12.0), (1.85, 12.0), 0.02, 0.62),
    "de": Band((1.85, 12.0), (1.95, 12.0), 0.02, 0.61),
    "fr": Band((1.58, 12.0), (1.72, 12.0), 0.02, 0.61),
    "es": Band((1.7, 12.0), (1.8, 12.0), 0.02, 0.61),
    "latin": Band((1.3, 14.0), (1.2, 14.0), 0.05, 0.5),
    "cyrillic": Band((1.0, 14.0), (0.7, 14.0), 0.1, 0.5),
    "other": Band((0.4, 14.0), (0.25, 14.0), 0.9, 0.45),
}
#: Scripts by the first byte of their letters in UTF-8.
SCRIPTS = {"latin": byte_class((0x41, 0x5A), (0x61, 0x7A), (0xC3, 0xC9)), "cyrillic": byte_class((0xD0, 0xD4)), "other": byte_class((0xCA, 0xCF), (0xD5, 0xF4))}

MEASURES = {
    "n_words": T.LongType(),
    "word_chars": T.LongType(),
    "n_symbols": T.LongType(),
    "n_dup_lines": T.LongType(),
    "n_repeat_words": T.LongType(),
    "n_tokens": T.LongType(),
    "n_byte_tokens": T.LongType(),
    "n_level_tokens": T.LongType(),
    "entropy": T.DoubleType(),
    "script": T.StringType(),
}
ARROW = {T.LongType(): pa.int64(), T.DoubleType(): pa.float64(), T.StringType(): pa.string()}


def repeated(keys: np.ndarray) -> np.ndarray:
    """Which entries occur more than once."""
    if not len(keys):
        return np.zeros(0, dtype=bool)
    ordered = np.sort(keys)
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    if not len(twice):
        return np.zeros(len(keys), dtype=bool)
    at = np.minimum(np.searchsorted(twice, keys), len(twice) - 1)
    return twice[at] == keys


def duplicate_lines(part: Slice, starts: np.ndarray) -> np.ndarray:
    """Lines with a word that equal an earlier line of their text, counted by text."""
    data = part.data
    begin = np.unique(np.concatenate([part.offsets[:-1], np.flatnonzero(data == 10) + 1]))
    begin = begin[begin < len(data)]
    if not len(begin):
        return np.zeros(len(part), dtype=np.int64)
    end = np.append(begin[1:], len(data))
    doc = np.searchsorted(part.offsets, begin, side="right") - 1
    end -= data[end - 1] == 10
    end = np.maximum(end, begin)
    worded = np.searchsorted(starts, end) > np.searchsorted(starts, begin)
    begin, end, doc = begin[worded], end[worded], doc[worded]
    first = np.unique(pair(Rolling(data).of(begin, end), doc), return_index=True)[1]
    distinct = np.bincount(doc[first], minlength=len(part))
    return np.bincount(doc, minlength=len(part)) - distinct


class Fertility:
    """Tokens of distinct words, kept for the life of a task."""

    def __init__(self, piece_model: bytes, ranks: dict[bytes, int], pattern: str):
        import sentencepiece
        import tiktoken

        self.pieces = sentencepiece.SentencePieceProcessor(model_proto=piece_model)
        self.levels = tiktoken.Encoding("levels", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.is_byte = np.array([self.pieces.is_byte(k) for k in range(self.pieces.get_piece_size())])
        self.clear()

    def clear(self) -> None:
        self.codes = np.zeros(0, dtype=np.uint64)  # sorted
        self.rows = np.zeros(0, dtype=np.int64)
        self.starts = np.zeros(0, dtype=np.int64)
        self.lengths = np.zeros(0, dtype=np.int64)
        self.levels_of = np.zeros(0, dtype=np.int64)
        self.pool = np.zeros(0, dtype=np.int32)

    def lookup(self, codes: np.ndarray, text_of) -> np.ndarray:
        """Cache rows of distinct word ``codes``; words not met before are encoded."""
        if len(self.codes) > WORD_CACHE:
            self.clear()
        at = np.searchsorted(self.codes, codes)
        known = np.zeros(len(codes), dtype=bool)
        inside = at < len(self.codes)
        known[inside] = self.codes[at[inside]] == codes[inside]
        new = np.flatnonzero(~known)
        if len(new):
            words = text_of(new)
            ids = self.pieces.encode(words, out_type=int, num_threads=1)
            lengths = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids))
            encode = self.levels.encode_ordinary
            levels = np.fromiter((len(encode(" " + w)) for w in words), dtype=np.int64, count=len(words))
            begin = len(self.pool) + np.concatenate([[0], np.cumsum(lengths)[:-1]])
            row = len(self.starts) + np.arange(len(new))
            self.starts = np.append(self.starts, begin)
            self.lengths = np.append(self.lengths, lengths)
            self.levels_of = np.append(self.levels_of, levels)
            self.pool = np.append(self.pool, np.fromiter((k for x in ids for k in x), dtype=np.int32, count=int(lengths.sum())))
            merged = np.append(self.codes, codes[new])
            order = np.argsort(merged)
            self.codes, self.rows = merged[order], np.append(self.rows, row)[order]
            at = np.searchsorted(self.codes, codes)
        return self.rows[at]


def measure(part: Slice, fertility: Fertility) -> dict[str, np.ndarray]:
    words, data = words_of(part, BLANK_WORDS, lower=False)
    n = len(part)
    chars = characters(part)
    word_chars = np.bincount(words.doc, weights=chars[words.ends] - chars[words.starts], minlength=n).astype(np.int64)
    at_symbol = np.flatnonzero(SYMBOLS[data])
    doc_of = lambda places: np.searchsorted(part.offsets, places, side="right") - 1
    symbols = np.bincount(doc_of(at_symbol), minlength=n)
    codes = windows(words.code, REPEAT_WINDOW)
    whole = np.flatnonzero(in_one(words.doc, REPEAT_WINDOW))
    again = whole[repeated(pair(codes[whole], words.doc[whole]))]
    delta = np.zeros(len(words.code) + 1, dtype=np.int64)
    np.add.at(delta, again, 1)
    np.add.at(delta, again + REPEAT_WINDOW, -1)
    covered = np.cumsum(delta[:-1]) > 0
    repeat = np.bincount(words.doc[covered], minlength=n)
    lines = duplicate_lines(part, words.starts)

    distinct, first, inverse = np.unique(words.code, return_index=True, return_inverse=True)
    text = lambda k: data[words.starts[first[k]] : words.ends[first[k]]].tobytes().decode()
    rows = fertility.lookup(distinct, lambda new: [text(k) for k in new.tolist()])[inverse] if len(distinct) else inverse
    lengths = fertility.lengths[rows]
    tokens = fertility.pool[ragged(fertility.starts[rows], lengths)]
    token_doc = np.repeat(words.doc, lengths)
    total = np.bincount(token_doc, minlength=n)
    byte_tokens = np.bincount(token_doc[fertility.is_byte[tokens]], minlength=n)
    levels = np.bincount(words.doc, weights=fertility.levels_of[rows], minlength=n).astype(np.int64)
    keys, counts = np.unique(token_doc.astype(np.int64) << 32 | tokens, return_counts=True)
    spread = np.bincount(keys >> 32, weights=counts * np.log2(counts), minlength=n)
    entropy = np.where(total > 0, np.log2(np.maximum(total, 1)) - spread / np.maximum(total, 1), 0.0)
    shares = np.stack([np.bincount(doc_of(np.flatnonzero(kind[data])), minlength=n) for kind in SCRIPTS.values()])
    script = np.array(list(SCRIPTS))[shares.argmax(axis=0)]
    script = np.where(shares.max(axis=0) > 0, script, "other")
    return {
        "n_words": words.counts,
        "word_chars": word_chars,
        "n_symbols": symbols,
        "n_dup_lines": lines,
        "n_repeat_words": repeat,
        "n_tokens": total,
        "n_byte_tokens": byte_tokens,
        "n_level_tokens": levels,
        "entropy": entropy,
        "script": script,
    }


def public_vocabularies() -> tuple[bytes, dict[bytes, int], str]:
    """Installed public vocabularies: a subword model with byte fallback, and byte-level ranks."""
    import public_tokenizers

    from .bpe import load_ranks, public_vocabulary

    content, pattern = public_vocabulary()
    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as file:
        return file.read(), load_ranks(content), pattern


def measure_documents(docs: DataFrame, vocabularies: tuple[bytes, dict[bytes, int], str] | None = None, keep: tuple[str, ...] = ("doc_id", "lang"), text_column: str = "text") -> DataFrame:
    """The ``keep`` columns and all MEASURES of each row, one pass without a shuffle."""
    model, ranks, pattern = vocabularies or public_vocabularies()
    fields = [docs.schema[c] for c in keep]
    schema = T.StructType([*fields, *(T.StructField(k, v) for k, v in MEASURES.items())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fertility = Fertility(model, ranks, pattern)
        for batch in batches:
            for part in slices(batch.column(len(keep))):
                own = batch.slice(part.first, len(part))
                found = measure(part, fertility)
                arrays = [pa.array(found[k]).cast(ARROW[v]) for k, v in MEASURES.items()]
                yield pa.RecordBatch.from_arrays([*(own.column(k) for k in range(len(keep))), *arrays], names=[*keep, *MEASURES])

    text = F.col(text_column).cast("string").alias("__text")
    return docs.select(*keep, text).mapInArrow(run, schema)


def judged(measured: DataFrame, bands: Mapping[str, Band] = BANDS, lang: str = "lang") -> DataFrame:
    """Adds ``base_failed``, the derived measures, ``reasons`` and ``kept``."""
    per = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    spec = F.coalesce(*(F.when(F.col(c) == name, F.lit(name)) for c in (lang, "script") for name in bands if (len(name) == 2) == (c == lang)), F.lit("other"))
    named = measured.withColumns(
        {
            "base_failed": (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")),
            "chars_per_token": per("word_chars", "n_tokens"),
            "chars_per_byte_token": per("word_chars", "n_level_tokens"),
            "byte_share": per("n_byte_tokens", "n_tokens"),
            "entropy_share": F.col("entropy") / F.log2(F.greatest(F.least(F.col("n_tokens"), F.lit(1024)), F.lit(2))),
            "band": spec,
        }
    )

    def outside(test) -> F.Column:
        out = F.lit(False)
        for name, band in bands.items():
            out = F.when(F.col("band") == name, test(band)).otherwise(out)
        return out

    def beyond(column: str, field: str) -> F.Column:
        return outside(lambda b: ~F.col(column).between(*getattr(b, field)))

    reasons = {
        "chars_per_token": beyond("chars_per_token", "chars_per_token"),
        "chars_per_byte_token": beyond("chars_per_byte_token", "chars_per_byte_token"),
        "byte_share": outside(lambda b: F.col("byte_share") > b.max_byte_share),
        "entropy": outside(lambda b: F.col("entropy_share") < b.min_entropy),
    }
    listed = F.array_compact(F.array(*(F.when(test, F.lit(name)) for name, test in reasons.items())))
    return named.withColumn("reasons", listed).withColumn("kept", ~F.col("base_failed") & (F.size("reasons") == 0))


def rate_documents(docs: DataFrame, bands: Mapping[str, Band] = BANDS) -> DataFrame:
    """Measures, verdict and reasons of every row of ``docs`` (doc_id, text, lang).

    A null or empty text has no words and fails the base rule. A null or unknown language
    takes the band of the text's script; a text without letters takes the last band.
    Repeated rows and null ids are judged a row each; other columns are left out; an
    empty table gives an empty result. Texts are measured whole.
    """
    return judged(measure_documents(docs), bands)


@register("op2_quality_rules")
def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rated = rate_documents(table(spark, sf_dir, "documents"))
    return rated.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "n_tokens", "n_byte_tokens", "n_level_tokens", F.round("entropy", 6).alias("entropy"), "band", "reasons",
    )
