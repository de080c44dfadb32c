"""N-gram Jaccard join: a blocked sparse product of the document by n-gram incidence.

Documents with equal sets are one row of the incidence matrix. A row of n n-grams can only
link over at least ``percent`` of them, so two linked rows share a column among the
n - ceil(percent * n) + 1 columns of each that come first in any common order. The order is
by the columns' counts over the whole corpus (in a table of fixed size, which any column
may share): the lead columns of a row are its rarest, and a passage that many documents
quote leads none of them. With k more lead columns each, two linked rows share k + 1 of them
(see ``shared_leads``), which rows that meet by chance hardly do: of a column of few rows the pairs are
counted, and pairs that share enough columns are joined. All rows of a column of many are joined
by it, and are never paired. A family is what these joins connect.

Where n-grams are few, columns of many rows meet by chance and a family grows large. Such a family is dealt
again by whole blocks of columns. Two rows of sizes n and m that reach the threshold differ in
at most ``h`` n-grams, a bound that follows from the sizes. The columns are dealt by hash into
more than ``h`` blocks (as many for all sizes of a class, and a row takes part in its own
class and the one below): two rows that can link agree in a whole block. Both conditions hold
for all links, so none is lost, and rows that meet by neither never meet. Within a family the
product runs block of rows by block of rows inside tasks of bounded size, accumulating
overlap counts and dropping pairs that the rest of a row can't lift over the bound, and
gives back a spanning forest of the links, never the pairs of a dense group.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import discard, stage
from .arrays import BLANK_WORDS, Slice, mix, ragged, slices, windows, words_of
from .counts import summed
from .graph import components
from .registry import register
from .tables import table

BLOCK_ENTRIES = 1_000_000  # matrix entries of a block of rows, on average
COLUMN_BLOCK = 512
LEVEL_BITS = 8
SLOT_BITS = 22  # slots of the table of counts: 16 MB at any corpus size
SHARED = 4  # lead columns that two rows must share to be joined by columns of few rows
FEW = 8  # rows of a column whose pairs are counted
SALT = np.uint64(0x5851F42D4C957F2D)


class Levels:
    """Size classes: sizes that can link lie in one class or in neighbours."""

    def __init__(self, percent: int):
        self.percent = percent
        self.begins = [1]
        while self.begins[-1] < 1 << 40 and len(self.begins) < (1 << LEVEL_BITS) - 1:
            self.begins.append(self.begins[-1] * 100 // percent + 1)

    def of(self, n: int) -> int:
        return bisect_right(self.begins, n) - 1

    def blocks(self, level: int) -> tuple[int, int]:
        """Blocks of the class, and how many of them may be empty in a row that sends no empty ones."""
        small = self.begins[level + 1] - 1
        differ = (100 - self.percent) * (small + small * 100 // self.percent) // (100 + self.percent)
        if differ == 0:
            return 0, 0  # only equal sets can link
        spare = 1 + differ // 16
        return differ + 1 + spare, spare


def lead_length(n: int, percent: int) -> int:
    """Lead columns of a row of ``n``; none where only an equal row reaches ``percent``."""
    return 0 if 100 * n < percent * (n + 1) else n - -(-percent * n // 100) + 1


def shared_leads(percent: int) -> int:
    """How many lead columns two linked, different rows have in common at least.

    Of the columns that two rows share, the k-th from the front lies, in each row, at most at the place
    n - ceil(percent * n) + k if they share that many; the smallest rows that can link bound k.
    """
    if percent >= 100:
        return 1
    smallest = max(1, -(-percent // (100 - percent)))
    return max(1, min(SHARED, -(-percent * smallest // 100)))


def sets_of(part: Slice, size: int) -> list[np.ndarray]:
    """Sorted distinct n-gram fingerprints of each text; a text of fewer words is one n-gram."""
    words, _ = words_of(part, BLANK_WORDS)
    codes = windows(words.code, size)
    begin = np.concatenate([[0], np.cumsum(words.counts)])
    out = []
    for k, n in enumerate(words.counts.tolist()):
        if n >= size:
            out.append(np.unique(codes[begin[k] : begin[k + 1] - size + 1]))
        else:
            out.append(windows(words.code[begin[k] : begin[k + 1]], n) if n else np.zeros(0, np.uint64))
    return out


def signature(grams: np.ndarray) -> int:
    """64-bit fingerprint of a set."""
    return int(mix(mix(grams ^ SALT).sum(keepdims=True) ^ mix(grams).sum(keepdims=True)).view(np.int64)[0])


def block_keys(grams: np.ndarray, levels: Levels) -> np.ndarray:
    """Keys of the column blocks a set takes part in; the lowest bits hold the class."""
    own = levels.of(len(grams))
    spread, load = mix(grams ^ SALT), mix(grams + SALT)
    keys = []
    for level in (own, own - 1):
        count, spare = levels.blocks(level) if level >= 0 else (0, 0)
        if not count:
            continue
        block = ((spread >> np.uint64(32)) * np.uint64(count) >> np.uint64(32)).astype(np.int64)
        order = np.argsort(block)
        held, first = np.unique(block[order], return_index=True)
        sums = np.add.reduceat(load[order], first)
        if count - len(held) > spare:
            sums = np.append(sums, np.zeros(count - len(held), np.uint64))
            held = np.append(held, np.setdiff1d(np.arange(count), held))
        key = mix(mix(sums + held.astype(np.uint64)) + np.uint64(level))
        keys.append((key >> np.uint64(LEVEL_BITS) << np.uint64(LEVEL_BITS)) | np.uint64(level))
    return np.concatenate(keys) if keys else np.zeros(0, np.uint64)


def slot_of(grams: np.ndarray) -> np.ndarray:
    return (mix(grams + SALT) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


def column_counts(docs: DataFrame, size: int) -> np.ndarray:
    """How often the n-grams of each slot occur in the whole corpus; 2**SLOT_BITS counts."""

    def count(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        slots = np.zeros(1 << SLOT_BITS, dtype=np.int64)
        for batch in batches:
            for part in slices(batch.column(0)):
                for grams in sets_of(part, size):
                    np.add.at(slots, slot_of(grams), 1)
        return slots

    found = summed(docs.select(F.col("text").cast("string")), count, 1 << SLOT_BITS)
    return np.minimum(found, np.iinfo(np.int32).max).astype(np.int32)


def lead_columns(grams: np.ndarray, counts: np.ndarray, percent: int) -> np.ndarray:
    """The rarest n-grams of a set (sorted), as many as its size asks for; those that no other row has are left out."""
    count = counts[slot_of(grams)]
    length = lead_length(len(grams), percent)
    first = np.argsort(count, kind="stable")[: length + shared_leads(percent) - 1 if length else 0]
    return grams[first[count[first] > 1]]


def document_sets(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """doc_id, n_shingles, sig (of the set; null when empty) and the lead columns of each row.

    Of equal sets that a task meets, one has its columns.
    """
    held = docs.sparkSession.sparkContext.broadcast(column_counts(docs, size))
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("n_shingles", T.LongType()), T.StructField("sig", T.LongType()), T.StructField("leads", T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, None] = {}
        for batch in batches:
            for part in slices(batch.column(1)):
                sets = sets_of(part, size)
                sigs = [signature(s) if len(s) else None for s in sets]
                leads = []
                for sig, grams in zip(sigs, sets):
                    again = sig is None or sig in seen
                    leads.append(np.zeros(0, np.int64) if again else lead_columns(grams, held.value, percent).view(np.int64))
                    if not again:
                        if len(seen) > 100_000:
                            seen.clear()
                        seen[sig] = None
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(part.first, len(part)), pa.array([len(s) for s in sets], pa.int64()), pa.array(sigs, pa.int64()), pa.array(leads, pa.list_(pa.int64()))],
                    names=["doc_id", "n_shingles", "sig", "leads"],
                )

    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(run, schema)


def families(rows: DataFrame, *by: str) -> DataFrame:
    """(node, label) of the rows ``sig`` that a chain of common keys (the columns ``by``) connects.

    Every row hangs on the least row of each of its keys. That row comes from a grouped
    minimum, which combines before the shuffle, and is joined back, where a key of very many rows
    can be split; keys of one row are gone by then.
    """
    least = rows.groupBy(*by).agg(F.min("sig").alias("b"), F.max("sig").alias("top")).where("b <> top").select(*by, "b")
    return components(rows.join(least, list(by)).where("sig <> b").select(F.col("sig").alias("a"), "b").distinct())


def lead_families(rows: DataFrame, shared: int) -> DataFrame:
    """(node, label) of the rows ``sig`` that may link by their lead columns ``lead``.

    A row may come several times. Two rows that share a column of more than FEW rows are connected as
    in ``families``; others when they share ``shared`` columns.
    """
    columns = rows.groupBy("lead").agg(F.min("sig").alias("b"), F.max("sig").alias("top"), F.count(F.lit(1)).alias("held"))
    columns = columns.where("b <> top").select("lead", "b", "held")
    crowded = rows.join(columns.where(F.col("held") > FEW), "lead").where("sig <> b").select(F.col("sig").alias("a"), "b")
    held = Window.partitionBy("lead").orderBy("sig")
    later = F.array(*(F.lead("sig", k).over(held) for k in range(1, FEW)))
    pairs = rows.join(columns.where(F.col("held") <= FEW).select("lead"), "lead").select(F.col("sig").alias("a"), later.alias("later"))
    pairs = pairs.select("a", F.explode("later").alias("b")).where("b is not null and a <> b")
    pairs = pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= shared).select("a", "b")
    return components(crowded.union(pairs).distinct())


class Forest:
    def __init__(self, n: int):
        self.up = np.arange(n)

    def root(self, k: int) -> int:
        up = self.up
        while up[k] != k:
            up[k] = up[up[k]]
            k = up[k]
        return int(k)

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        self.up[max(a, b)] = min(a, b)
        return a != b


def product_links(rows: list[np.ndarray], percent: int, column_block: int = COLUMN_BLOCK) -> list[tuple[int, int]]:
    """A spanning forest of the links between ``rows`` (sorted distinct n-grams each).

    Rows are taken by size. A row is multiplied with the rows before it, a block of its
    columns at a time; the overlap so far and the columns left bound what a pair can reach.
    Rows already connected with it need no count.
    """
    order = sorted(range(len(rows)), key=lambda k: len(rows[k]))
    sizes = np.array([len(rows[k]) for k in order], dtype=np.int64)
    row = np.repeat(np.arange(len(order)), sizes)
    _, column, count = np.unique(np.concatenate([rows[k] for k in order]), return_inverse=True, return_counts=True)
    by_column = np.argsort(column, kind="stable")
    begin = np.concatenate([[0], np.cumsum(count)])
    place = np.empty(len(row), dtype=np.int64)  # of an entry within its column: how many earlier rows share it
    place[by_column] = np.arange(len(row)) - np.repeat(begin[:-1], count)
    row_of_column = row[by_column]
    starts = np.concatenate([[0], np.cumsum(sizes)])
    forest, out = Forest(len(order)), []
    for r in range(1, len(order)):
        n = int(sizes[r])
        low = int(np.searchsorted(sizes[:r], -(-n * percent // 100)))
        if low == r:
            continue
        need = -(-percent * (n + sizes[low:r]) // (100 + percent))
        mine = slice(starts[r], starts[r + 1])
        columns, earlier = column[mine], place[mine]
        shared = earlier > 0
        columns, earlier = columns[shared], earlier[shared]
        overlap = np.zeros(r - low, dtype=np.int64)
        for at in range(0, len(columns), column_block):
            c, e = columns[at : at + column_block], earlier[at : at + column_block]
            met = row_of_column[ragged(begin[c], e)]
            overlap += np.bincount(met[met >= low] - low, minlength=r - low)
            if not (overlap + len(columns) - at - len(c) >= need).any():
                break
        else:
            for k in np.flatnonzero(overlap >= need).tolist():
                if forest.join(low + k, r):
                    out.append((order[low + k], order[r]))
    return out


def family_links(sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between the rows of ``sets`` (family, blocks, sig, grams)."""
    others = F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)
    block = F.pmod(F.xxhash64("sig"), F.col("blocks"))
    cells = sets.select("family", "sig", "grams", block.alias("block"), F.explode(others).alias("other"))
    cells = cells.select("family", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "sig", "grams")

    def run(group: pa.Table) -> pa.Table:
        group = group.select(["sig", "grams"]).combine_chunks()
        sigs = group["sig"].to_pylist()
        lists = group["grams"].chunk(0) if group["grams"].num_chunks else pa.array([], pa.list_(pa.int64()))
        flat, at = lists.values.to_numpy(), lists.offsets.to_numpy()
        pairs = product_links([flat[at[k] : at[k + 1]] for k in range(len(sigs))], percent)
        return pa.table({"a": pa.array([sigs[a] for a, _ in pairs], pa.int64()), "b": pa.array([sigs[b] for _, b in pairs], pa.int64())})

    return cells.groupBy("family", "i", "j").applyInArrow(run, "a long, b long")


def grams_of(docs: DataFrame, wanted: DataFrame, size: int, made: Callable[[np.ndarray], np.ndarray] = lambda grams: grams) -> DataFrame:
    """``wanted`` (doc_id, sig and more) with ``grams``: the n-grams of those documents, or what is ``made`` of them.

    Of repeated ids only the rows with the wanted set are taken.
    """
    rest = [c for c in wanted.columns if c != "doc_id"]
    texts = docs.select("doc_id", F.col("text").cast("string").alias("__text")).where("doc_id is not null")
    joined = wanted.hint("merge").join(texts, "doc_id")  # the same way at every size
    schema = T.StructType([*(wanted.schema[c] for c in rest), T.StructField("grams", T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch.column(len(rest))):
                own = batch.slice(part.first, len(part))
                sets = sets_of(part, size)
                same = [len(s) > 0 and signature(s) == sig for s, sig in zip(sets, own.column(rest.index("sig")).to_pylist())]
                grams = pa.array([made(s).view(np.int64) if ok else None for s, ok in zip(sets, same)], pa.list_(pa.int64()))
                found = pa.RecordBatch.from_arrays([*(own.column(k) for k in range(len(rest))), grams], names=[*rest, "grams"])
                yield found.filter(pa.array(same))

    return joined.select(*rest, "__text").mapInArrow(run, schema)


def jaccard_components(docs: DataFrame, size: int = 3, percent: int = 90, block_entries: int = BLOCK_ENTRIES) -> DataFrame:
    """doc_id, n_shingles, n_equal and component_id of each row of ``docs`` (doc_id, text).

    Two documents link when their sets of ``size``-word n-grams reach ``percent``; a
    component is closed under links and named by its least doc_id. ``n_equal`` is the number
    of rows with the same set. A text without words has an empty set, links with nothing
    and is its own component. Repeated rows are kept; rows without an id link only with
    rows of the same set and never name a component that has an id. Other columns are left
    out. An empty table gives an empty result. Sets are
    compared by 64-bit fingerprints of their n-grams.
    """
    columns = stage(document_sets(docs, size, percent))
    staged = stage(columns.drop("leads"))
    classes = staged.where("sig is not null").groupBy("sig").agg(F.min("doc_id").alias("doc_id"), F.max("n_shingles").alias("n"), F.count(F.lit(1)).alias("n_equal"))
    rows = columns.where("sig is not null").select("sig", F.explode("leads").alias("lead"))
    members = classes.where("doc_id is not null").join(lead_families(rows, shared_leads(percent)), F.col("sig") == F.col("node")).select("doc_id", "sig", F.col("label").alias("family"), "n")
    met = stage(members)
    discard(columns)
    large = stage(met.groupBy("family").agg(F.sum("n").alias("entries")).where(F.col("entries") > block_entries).select("family"))
    members = met
    if not large.isEmpty():  # else no text is shuffled for it
        again = met.join(large, "family").select("doc_id", "sig", "family", "n")
        levels = Levels(percent)
        rows = stage(grams_of(docs, again.select("doc_id", "sig", "family"), size, lambda grams: block_keys(grams, levels)))
        dealt = families(rows.select("sig", "family", F.explode("grams").alias("key")), "family", "key")
        dealt = again.drop("family").join(dealt, F.col("sig") == F.col("node")).select("doc_id", "sig", F.col("label").alias("family"), "n")
        members = stage(met.join(large, "family", "left_anti").select("doc_id", "sig", "family", "n").union(dealt))
        discard(rows, met)
    totals = members.groupBy("family").agg(F.ceil(F.sum("n") / block_entries).alias("blocks"))
    sets = grams_of(docs, members.join(totals, "family").select("doc_id", "sig", "family", "blocks"), size)
    links = stage(family_links(sets, percent))
    label = components(links)
    ids = classes.join(label, F.col("sig") == F.col("node"), "left").select("sig", "doc_id", "n_equal", F.coalesce("label", "sig").alias("label"))
    ids = stage(ids)
    named = ids.join(ids.groupBy("label").agg(F.min("doc_id").alias("component_id")), "label").select("sig", "n_equal", "component_id")
    return staged.join(named, "sig", "left").select(
        "doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce("n_equal", F.lit(1)).alias("n_equal")
    )


SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS MATERIALIZED (
  SELECT DISTINCT doc_id, md5(array_to_string(w[i:i + 2], ' ')) AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 2))) AS i FROM w WHERE len(w) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
o AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS o FROM g a JOIN g b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS MATERIALIZED (SELECT x, y FROM o JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * o >= 90 * (p.n + q.n - o)),
e AS MATERIALIZED (SELECT x AS a, y AS b FROM l UNION ALL SELECT y, x FROM l),
r(doc_id, reach) AS (SELECT a, a FROM e UNION SELECT r.doc_id, e.b FROM r JOIN e ON r.reach = e.a)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(c.component_id, w.doc_id) AS component_id
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT doc_id, least(doc_id, min(reach)) AS component_id FROM r GROUP BY doc_id) c USING (doc_id)
"""


@register("op3_ngram_jaccard", SQL)
def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")
