"""Benchmark decontamination: a broadcast hash set of test windows, scanned for in all texts.

Words are lower-cased runs of ASCII letters, digits and non-ASCII characters. A window is
``size`` consecutive words of a benchmark item; an item of fewer words is one window of
its own length. The windows go to the tasks as a set whose size is checked: a benchmark
above ``max_bytes`` is dealt into several sets, one scan after another over the same rows,
so the broadcast stays bounded and nothing is left out. A scan first compares 64-bit
window fingerprints and then verifies each hit word by word.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrays import PLAIN_WORDS, Words, characters, in_one, slices, windows, words_of
from .registry import register
from .tables import table

WINDOW = 10
MAX_BYTES = 64 << 20  # text of the windows in one broadcast set
FILTER_BITS = 20
RUN = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
ARROW_RUN = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def word_bytes(words: Words, data: np.ndarray, first: int, size: int) -> bytes:
    return b" ".join(data[words.starts[k] : words.ends[k]].tobytes() for k in range(first, first + size))


def benchmark_windows(bench: DataFrame, size: int = WINDOW) -> DataFrame:
    """Distinct (item_id, size, fingerprint, window) of every item with words."""
    schema = "item_id long, size int, code long, window binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for part in slices(batch.column(1)):
                words, data = words_of(part, PLAIN_WORDS)
                begin = np.concatenate([[0], np.cumsum(words.counts)])
                rows = []
                for k, n in enumerate(words.counts.tolist()):
                    own = min(n, size)
                    codes = windows(words.code[begin[k] : begin[k + 1]], own) if n else ()
                    for at, code in enumerate(codes):
                        rows.append((ids[part.first + k], own, int(code.astype(np.int64)), word_bytes(words, data, int(begin[k]) + at, own)))
                columns = list(zip(*rows)) or [()] * 4
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["item_id", "size", "code", "window"])

    ids = F.col("item_id").cast("long").alias("item_id")
    return bench.select(ids, F.col("text").cast("string")).mapInArrow(run, schema).distinct()


class WindowSet:
    """Windows by length: a bit filter over fingerprints, then the windows themselves."""

    def __init__(self, rows):
        self.items: dict[bytes, set] = {}
        self.filters: dict[int, np.ndarray] = {}
        for row in rows:
            self.items.setdefault(bytes(row.window), set()).add(row.item_id)
            bits = self.filters.setdefault(row.size, np.zeros(1 << FILTER_BITS, dtype=bool))
            bits[row.code & ((1 << FILTER_BITS) - 1)] = True

    def hits(self, words: Words, data: np.ndarray) -> Iterator[tuple[int, int, set]]:
        """First word, length and items of every window that occurs in the slice."""
        mask = np.uint64((1 << FILTER_BITS) - 1)
        for size, bits in self.filters.items():
            codes = windows(words.code, size)
            maybe = bits[codes & mask]
            maybe &= in_one(words.doc, size)
            for at in np.flatnonzero(maybe).tolist():
                found = self.items.get(word_bytes(words, data, at, size))
                if found:
                    yield at, size, found


def runs_of(marked: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last word of each run of marked words inside one text."""
    edge = np.ones(len(marked) + 1, dtype=bool)
    edge[1:-1] = doc[1:] != doc[:-1]
    before = np.concatenate([[False], marked[:-1]])
    after = np.concatenate([marked[1:], [False]])
    return np.flatnonzero(marked & (~before | edge[:-1])), np.flatnonzero(marked & (~after | edge[1:]))


def scan(
    docs: DataFrame,
    bench: DataFrame,
    size: int = WINDOW,
    max_bytes: int = MAX_BYTES,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """Hits of the benchmark in every row of ``docs``.

    Returns ``id_column``, the whole ``text``, ``n_words``, ``n_hit`` (words inside an occurrence of a
    window), ``items`` (ids of the items with occurring windows, sorted) and ``spans`` (code
    point ranges of the hit words). Null and empty texts have no words. Repeated rows and
    null ids are kept, a row each. Items without words have no window; a null item id
    counts as a hit but is not listed. Other columns are left out. Nothing is shuffled.
    """
    found = benchmark_windows(bench, size)
    total = found.agg(F.sum(F.length("window") + 16)).first()[0] or 0
    sets = max(1, math.ceil(total / max_bytes))
    key = docs.schema[id_column]
    schema = T.StructType(
        [
            T.StructField(id_column, key.dataType),
            T.StructField("text", T.StringType()),
            T.StructField("n_words", T.LongType()),
            T.StructField("words", RUN),
            T.StructField("items", T.ArrayType(T.LongType())),
            T.StructField("spans", RUN),
        ]
    )
    empty = [F.lit(None).cast(t).alias(n) for n, t in (("n_words", T.LongType()), ("words", RUN), ("items", T.ArrayType(T.LongType())), ("spans", RUN))]
    out = docs.select(id_column, F.col(text_column).cast("string").alias("text"), *empty)
    for number in range(sets):
        share = found.where(F.pmod(F.xxhash64("window"), F.lit(sets)) == number)
        held = docs.sparkSession.sparkContext.broadcast(WindowSet(share.collect()))
        out = out.mapInArrow(_scanner(held, id_column), schema)
    n_hit = F.aggregate("words", F.lit(0).cast("long"), lambda n, r: n + r["end"] - r["start"])
    return out.select(id_column, "text", "n_words", n_hit.alias("n_hit"), "items", "spans")


def _scanner(held, id_column: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            before = batch.column(3).to_pylist()
            items_before = batch.column(4).to_pylist()
            for part in slices(batch.column(1)):
                words, data = words_of(part, PLAIN_WORDS)
                begin = np.concatenate([[0], np.cumsum(words.counts)])
                delta = np.zeros(len(words.code) + 1, dtype=np.int64)
                items: list[set] = [set(items_before[part.first + k] or ()) for k in range(len(part))]
                for k in range(len(part)):
                    for r in before[part.first + k] or ():
                        delta[begin[k] + r["start"]] += 1
                        delta[begin[k] + r["end"]] -= 1
                for at, length, ids in held.value.hits(words, data):
                    delta[at] += 1
                    delta[at + length] -= 1
                    items[words.doc[at]] |= ids
                first, last = runs_of(np.cumsum(delta[:-1]) > 0, words.doc)
                runs: list[list] = [[] for _ in range(len(part))]
                spans: list[list] = [[] for _ in range(len(part))]
                if len(first):
                    chars = characters(part)
                    for a, b in zip(first.tolist(), last.tolist()):
                        k = int(words.doc[a])
                        zero = chars[part.offsets[k]]
                        runs[k].append({"start": a - int(begin[k]), "end": b + 1 - int(begin[k])})
                        spans[k].append({"start": int(chars[words.starts[a]] - zero), "end": int(chars[words.ends[b]] - zero)})
                rows = batch.slice(part.first, len(part))
                yield pa.RecordBatch.from_arrays(
                    [
                        rows.column(0),
                        rows.column(1),
                        pa.array(words.counts.astype(np.int64)),
                        pa.array(runs, ARROW_RUN),
                        pa.array([sorted(x for x in s if x is not None) for s in items], pa.list_(pa.int64())),
                        pa.array(spans, ARROW_RUN),
                    ],
                    names=[id_column, "text", "n_words", "words", "items", "spans"],
                )

    return run


def without_spans(text: str | F.Column, spans: str | F.Column) -> F.Column:
    """``text`` with the (ordered, disjoint) ``spans`` cut out."""
    text, spans = (F.col(c) if isinstance(c, str) else c for c in (text, spans))
    start = F.struct(F.lit("").alias("kept"), F.lit(0).cast("long").alias("at"))
    cut = F.aggregate(
        spans,
        start,
        lambda s, r: F.struct(
            F.concat(s["kept"], text.substr((s["at"] + 1).cast("int"), (r["start"] - s["at"]).cast("int"))).alias("kept"),
            r["end"].alias("at"),
        ),
        lambda s: F.concat(s["kept"], text.substr((s["at"] + 1).cast("int"), F.length(text))),
    )
    return F.when(F.size(spans) > 0, cut).otherwise(text)


def remove_spans(docs: DataFrame, bench: DataFrame, **options) -> DataFrame:
    """(doc_id, text) with the hit words cut out; null texts become empty."""
    hits = scan(docs, bench, **options)
    return hits.select("doc_id", F.coalesce(without_spans("text", "spans"), F.lit("")).alias("text"))


def clean_ids(docs: DataFrame, bench: DataFrame, **options) -> DataFrame:
    """Ids of the documents without any hit; what removing whole documents keeps."""
    return scan(docs, bench, **options).where("n_hit = 0").select("doc_id")


SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS k
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 8, 2))) AS i FROM b WHERE len(w) > 0)),
dw AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS k
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw))),
h AS (SELECT doc_id, i, n, item_id FROM dw JOIN bw USING (n, k)),
hw AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM h) GROUP BY doc_id),
hi AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM h) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hw USING (doc_id) LEFT JOIN hi USING (doc_id)
"""


@register("op4_decontamination", SQL)
def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    names = F.array_sort(F.transform("items", lambda x: x.cast("string")))
    return hits.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", names), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )
