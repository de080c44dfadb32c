"""Removal of long repeated byte strings by blockwise suffix sorting.

A byte goes when it is covered by a ``LENGTH``-byte string that starts anywhere else too.
All suffixes of a corpus can't be sorted together, so they are dealt into buckets, and
one bucket is sorted at a time:

* A cover sample holds some positions of every text. It is chosen by content (the least
  fingerprint of ``GRAM`` bytes in each stretch of ``LENGTH``), so that equal strings
  have their samples at the same places; a cover by residues would need twice as
  large a share of all positions as there are residues in it, and its samples meet at a
  shift that differs from pair to pair. Samples whose bytes occur once are dropped, with
  all suffixes they stand for.
* The suffixes that share a sample are a bucket's class, aligned at that sample. In the
  aligned rows every sixteenth column is a difference cover. The ranks of the cover
  columns are computed first, by doubling (16, 32, ... 384 bytes); a suffix is then sorted
  by the 16 bytes its head and tail leave over, and ties by the rank of its cover column.
  Ranks are exact: bytes are compared, not fingerprints of them.

Equal texts are one text with a count, and equal aligned rows are one row, merged in the
task that reads them and again before the shuffle: what a class holds follows its different
bytes, not its holders. The runs found in a row go back to its holders by the row's digest.
A class of more than ``HOT`` different rows is dealt again by the bytes its suffixes have in
common, sixteen starts at a time. Only texts that a bit filter of fixed size can't rule out
are shuffled to the samples they share; full of ids, it lets all texts pass.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import discard, stage
from .arrays import Rolling, Slice, mix, slices
from .counts import summed
from .registry import register
from .tables import table

LENGTH = 400
GRAM = 128
COLUMN = 16
RANKED = 384  # LENGTH less one column
REACH = LENGTH - GRAM  # starts before a sample that it may stand for
WIDTH = REACH + LENGTH
CHUNK = 1 << 18
BUCKET_ROWS = 2000
HOT = 20_000
FILTER_SLOTS = 1 << 22
SEEN = 200_000  # digests a task keeps to send the bytes of a row once
NO_ID = -(1 << 63)
RUNS = "array<struct<first: long, last: long>>"


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """Least value of each run of ``width``, by prefix and suffix minima of blocks."""
    out = len(values) - width + 1
    full = np.full(-(-len(values) // width) * width, np.iinfo(np.uint64).max, dtype=np.uint64)
    full[: len(values)] = values
    rows = full.reshape(-1, width)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:out], ahead[width - 1 : width - 1 + out])


def samples(part: Slice) -> Iterator[tuple[np.ndarray, ...]]:
    """Cover samples of a slice: text number, place, first and last start it stands for, fingerprint."""
    low = np.uint64(0xFFFFFFFF)
    for at in range(0, max(0, len(part.data) - LENGTH + 1), CHUNK):
        data = part.data[at : at + CHUNK + LENGTH - 1]
        grams = mix(Rolling(data).raw(GRAM))
        packed = (grams & ~low) | np.arange(len(grams), dtype=np.uint64)
        place = (sliding_least(packed, REACH + 1) & low).astype(np.int64)
        start = np.arange(len(place)) + at
        doc = np.searchsorted(part.offsets, start, side="right") - 1
        whole = start + LENGTH <= part.offsets[doc + 1]
        start, doc, place = start[whole], doc[whole], place[whole]
        if not len(start):
            continue
        new = np.ones(len(start), dtype=bool)
        new[1:] = (place[1:] != place[:-1]) | (doc[1:] != doc[:-1])
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(start)) - 1
        yield doc[first], place[first] + at, start[first], start[last], grams[place[first]]


def sampled(docs: DataFrame) -> DataFrame:
    """id, sha (of the text), n_bytes, and fingerprint and place of each sample of each row."""
    schema = "id long, sha string, n_bytes long, grams array<long>, places array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch.column(1)):
                found = list(samples(part))
                doc, place, _, _, gram = (np.concatenate(x) for x in zip(*found)) if found else [np.zeros(0, np.int64)] * 4 + [np.zeros(0, np.uint64)]
                texts = [part.data[a:b].tobytes() for a, b in zip(part.offsets[:-1].tolist(), part.offsets[1:].tolist())]
                digests = [hashlib.sha256(t) for t in texts]
                head = np.array([int.from_bytes(d.digest()[:8], "little") for d in digests], dtype=np.uint64)
                places = mix(head[doc] ^ mix((place - part.offsets[doc]).astype(np.uint64)))
                begin = np.searchsorted(doc, np.arange(len(part) + 1)).astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(begin), pa.array(x.view(np.int64))) for x in (gram, places)]
                own = batch.column(0).slice(part.first, len(part))
                yield pa.RecordBatch.from_arrays([own, pa.array([d.hexdigest() for d in digests]), pa.array(np.diff(part.offsets)), *lists], names=["id", "sha", "n_bytes", "grams", "places"])

    return docs.mapInArrow(run, schema)


def aligned(texts: DataFrame, bodies: bool) -> DataFrame:
    """Aligned rows of the live samples of ``texts`` (owner, grams, text).

    A row is its class, ``skip`` (its first column) and the bytes of the suffixes it holds;
    ``name`` is a 128-bit digest of the three. With ``bodies``: class, skip, name, body and the
    least and greatest mark of its holders, rows merged within the task (a body is null when
    the task sent it before). Without: name, owner and ``left`` (place of column 0 in the text).
    """
    schema = "class long, skip int, name binary, body binary, a long, b long" if bodies else "name binary, owner binary, left long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set[bytes] = set()
        for batch in batches:
            owners = batch.column(0).to_pylist()
            live = [set(x or ()) for x in batch.column(1).to_pylist()]
            for part in slices(batch.column(2)):
                offsets = part.offsets.tolist()
                for found in samples(part):
                    merged: dict[bytes, list] = {}
                    members = []
                    doc, place, first, last, gram = found
                    head = np.array([int.from_bytes(o[:8], "little") for o in owners[part.first : part.first + len(part)]], dtype=np.uint64)
                    marks = mix(head[doc] ^ mix((place - part.offsets[doc]).astype(np.uint64))).view(np.int64).tolist()
                    for d, p, x, y, g, mark in zip(doc.tolist(), place.tolist(), first.tolist(), last.tolist(), gram.view(np.int64).tolist(), marks):
                        at = part.first + d
                        if g not in live[at]:
                            continue
                        column0 = p - REACH
                        body = part.data[x : y + LENGTH].tobytes()
                        name = hashlib.blake2b(body, digest_size=16, salt=g.to_bytes(8, "little", signed=True) + (x - column0).to_bytes(8, "little")).digest()
                        if not bodies:
                            members.append((name, owners[at], column0 - offsets[d]))
                        elif name in merged:
                            held = merged[name]
                            held[4], held[5] = min(held[4], mark), max(held[5], mark)
                        else:
                            merged[name] = [g, x - column0, name, None if name in sent else body, mark, mark]
                    if bodies:
                        if len(sent) > SEEN:
                            sent.clear()
                        sent.update(merged)
                    yield arrow_rows(list(merged.values()) if bodies else members, schema)

    return texts.select("owner", "grams", "text").mapInArrow(run, schema)


def arrow_rows(rows: list, schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "boolean": pa.bool_()}
    fields = [field.split() for field in schema.split(", ")]
    columns = list(zip(*rows)) or [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[kind]) for c, (_, kind) in zip(columns, fields)], names=[name for name, _ in fields])


def dealt_again(rows: DataFrame) -> DataFrame:
    """Rows of hot classes in pieces of sixteen starts, classed by the bytes these have in common."""
    schema = "class long, skip int, name binary, body binary, many boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                pieces = []
                for klass, skip, name, body, many in zip(*(c.to_pylist() for c in batch.slice(at, 500).columns)):
                    a, b = skip, skip + len(body) - LENGTH
                    for band in range(a // COLUMN, b // COLUMN + 1):
                        x, y = band * COLUMN, band * COLUMN + COLUMN - 1
                        salt = klass.to_bytes(8, "little", signed=True) + bytes([band]) + bytes(7)
                        core = hashlib.blake2b(body[y - skip : x + LENGTH - skip], digest_size=8, salt=salt).digest()
                        x, y = max(a, x), min(b, y)
                        pieces.append((int.from_bytes(core, "little", signed=True), x, name, body[x - skip : y + LENGTH - skip], many))
                yield arrow_rows(pieces, schema)

    return rows.select("class", "skip", "name", "body", "many").mapInArrow(run, schema)


def dense(*keys: np.ndarray) -> np.ndarray:
    """Number of each row's key in sorted order (the last key counts most)."""
    order = np.lexsort(keys)
    new = np.zeros(len(order), dtype=bool)
    for key in keys:
        new[1:] |= key[order[1:]] != key[order[:-1]]
    out = np.empty(len(order), dtype=np.int64)
    out[order] = np.cumsum(new)
    return out


def repeated_starts(klass: np.ndarray, matrix: np.ndarray, first: np.ndarray, last: np.ndarray, holders: np.ndarray) -> np.ndarray:
    """Which starts (row, column) of aligned rows occur twice: LENGTH equal bytes in rows of the class with two holders or more."""
    rows, found = len(klass), np.zeros((len(klass), REACH + 1), dtype=bool)
    halves = np.ascontiguousarray(matrix).view(">u8").reshape(rows, WIDTH // COLUMN, 2)
    ranks = {COLUMN: [dense(halves[:, c, 1], halves[:, c, 0]) for c in range(WIDTH // COLUMN)]}
    size = COLUMN
    while 2 * size <= RANKED:
        half, step = ranks[size], size // COLUMN
        ranks[2 * size] = [dense(half[c + step], half[c]) for c in range(len(half) - step)]
        size *= 2
    rest = ranks[RANKED - size]
    for c in range(REACH // COLUMN + 1):
        tied = dense(rest[c + size // COLUMN], ranks[size][c], klass)
        many = np.bincount(tied, holders)[tied] > 1
        for start in range(max(0, (c - 1) * COLUMN + 1), min(c * COLUMN, REACH) + 1):
            live = np.flatnonzero(many & (first <= start) & (start <= last))
            if not len(live):
                continue
            cover = c * COLUMN
            over = np.concatenate([matrix[live, start:cover], matrix[live, cover + RANKED : start + LENGTH]], axis=1)
            over = np.ascontiguousarray(over).view(">u8")
            name = dense(over[:, 1], over[:, 0], tied[live])
            found[live, start] = np.bincount(name, holders[live])[name] > 1
    return found


def sorted_buckets(rows: DataFrame, buckets: int) -> DataFrame:
    """name and runs of repeated starts (first, last, as columns) of every row, bucket by bucket."""
    schema = "name binary, first long, last long"

    def run(group: pa.Table) -> pa.Table:
        group = group.select(["class", "skip", "name", "body", "many"]).combine_chunks()
        holders = group["many"].to_numpy() + 1
        _, number = np.unique(group["class"].to_numpy(), return_inverse=True)
        keep = np.flatnonzero(np.bincount(number, holders)[number] > 1)
        if not len(keep):
            return pa.Table.from_batches([arrow_rows([], schema)])
        group, holders, skip = group.take(keep), holders[keep], group["skip"].to_numpy()[keep].astype(np.int64)
        matrix, lengths = np.zeros((len(keep), WIDTH), dtype=np.uint8), np.zeros(len(keep), dtype=np.int64)
        for k, body in enumerate(group["body"]):
            held = np.frombuffer(body.as_buffer(), dtype=np.uint8)
            lengths[k] = len(held)
            matrix[k, skip[k] : skip[k] + len(held)] = held
        found = repeated_starts(number[keep], matrix, skip, skip + lengths - LENGTH, holders)
        edge = np.diff(np.pad(found, ((0, 0), (1, 1))).astype(np.int8), axis=1)
        row, first = np.nonzero(edge == 1)
        _, last = np.nonzero(edge == -1)
        return pa.table({"name": group["name"].take(row), "first": pa.array(first), "last": pa.array(last - 1)})

    dealt = rows.withColumn("bucket", F.pmod(F.xxhash64("class"), F.lit(buckets)))
    return dealt.groupBy("bucket").applyInArrow(run, schema)


def with_ids_of(source: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows of ``source`` (id, text) but for those whose id is surely not in ``wanted``."""

    def slots(ids: pa.Array) -> np.ndarray:
        return (mix(ids.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)) & np.uint64(FILTER_SLOTS - 1)).astype(np.int64)

    def count(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        out = np.zeros(FILTER_SLOTS, dtype=np.int64)
        for batch in batches:
            out[slots(batch.column(0))] = 1
        return out

    held = source.sparkSession.sparkContext.broadcast(np.packbits(summed(wanted.select("id"), count, FILTER_SLOTS) > 0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.unpackbits(held.value).view(bool)
        for batch in batches:
            yield batch.filter(pa.array(bits[slots(batch.column(0))]))

    return source.mapInArrow(run, source.schema)


def cut(text: bytes, runs: list[tuple[int, int]]) -> tuple[bytes, list[tuple[int, int]]]:
    """Text without the bytes the repeated starts cover, and the spans that went."""
    spans: list[list[int]] = []
    for first, last in sorted(runs):
        if spans and first <= spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], last + LENGTH)
        else:
            spans.append([first, last + LENGTH])
    kept, at = [], 0
    for a, b in spans:
        kept.append(text[at:a])
        at = b
    return b"".join([*kept, text[at:]]), [(a, b) for a, b in spans]


def repeated_spans(docs: DataFrame, hot: int = HOT, bucket_rows_target: int = BUCKET_ROWS) -> DataFrame:
    """doc_id, n_bytes, sha (of the text), n_equal (rows with that text) and ``cut``.

    ``cut`` is null when nothing goes (also when everything does: equal texts of LENGTH
    bytes or more), else a struct: n_removed, spans (byte ranges), kept (bytes). One row for
    each row of ``docs`` (doc_id, text). A null or empty text has no bytes. Rows without an
    id and repeated ids take part like others; a repeated row is an equal text. Other
    columns are left out; an empty table gives an empty result.
    """
    source = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    owner = lambda sha: F.unhex(F.substring(sha, 1, 32))
    rows = stage(sampled(source)).withColumn("owner", owner(F.col("sha")))
    texts = stage(rows.groupBy("owner").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n_equal")))
    each = rows.select("owner", F.explode(F.arrays_zip("grams", "places")).alias("s")).select("owner", F.col("s.grams").alias("gram"), F.col("s.places").alias("place"))
    # written tables, so that the joins with hot keys (grams, owners) read plain shuffles, whose skew can be split
    live = stage(each.groupBy("gram").agg(F.min("place").alias("a"), F.max("place").alias("b")).where("a <> b").select("gram"))
    own = each.select("owner", "gram").join(live, "gram").groupBy("owner").agg(F.collect_set("gram").alias("grams"))
    wanted = stage(own.join(texts, "owner").select("id", "owner", "grams", "n_equal"))
    fetched = with_ids_of(source, wanted).join(wanted, "id").where(owner(F.sha2("text", 256)) == F.col("owner"))
    fetched = stage(fetched.select("id", "owner", "grams", "text", "n_equal"))
    discard(live, wanted)
    merged = aligned(fetched, True).groupBy("class", "skip", "name").agg(F.max("body").alias("body"), F.min("a").alias("a"), F.max("b").alias("b"))
    merged = stage(merged.select("class", "skip", "name", "body", (F.col("a") != F.col("b")).alias("many")))
    crowded = stage(merged.groupBy("class").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > hot).select("class"))
    dealt = merged
    if not crowded.isEmpty():
        dealt = merged.join(crowded, "class", "left_anti").unionByName(dealt_again(merged.join(crowded, "class")))
    found = sorted_buckets(dealt, -(-merged.count() // bucket_rows_target) or 1)
    found = stage(found.groupBy("name").agg(F.collect_list(F.struct("first", "last")).alias("found")))
    discard(merged, crowded)
    single = fetched.where("n_equal = 1").select("id", "owner", "grams", "text")
    runs = aligned(single, False).join(found, "name")
    moved = F.transform("found", lambda r: F.struct((F.col("left") + r["first"]).alias("first"), (F.col("left") + r["last"]).alias("last")))
    runs = runs.select("owner", moved.cast(RUNS).alias("runs")).groupBy("owner").agg(F.flatten(F.collect_list("runs")).alias("runs"))
    schema = "id long, owner binary, n_removed long, spans array<struct<start: long, end: long>>, kept binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [cut(t.encode(), [(r["first"], r["last"]) for r in rs]) for t, rs in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            spans = [[{"start": a, "end": b} for a, b in s] for _, s in out]
            removed = [sum(b - a for a, b in s) for _, s in out]
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            columns = [batch.column(0), batch.column(1), pa.array(removed, pa.int64()), pa.array(spans, kind), pa.array([k for k, _ in out], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "owner", "n_removed", "spans", "kept"])

    cuts = single.join(runs, "owner").select("id", "owner", "text", "runs").mapInArrow(run, schema)
    cuts = cuts.select("id", "owner", F.struct("n_removed", "spans", "kept").alias("cut"))
    ids = F.when(F.col("id") != NO_ID, F.col("id")).alias("doc_id")
    # the second join also goes by id, so that the copies of one text are dealt over all tasks
    out = rows.select("id", "sha", "n_bytes", "owner").join(texts.select("owner", "n_equal"), "owner").join(cuts, ["id", "owner"], "left")
    return out.select(ids, "n_bytes", "sha", "n_equal", "cut")


SQL = f"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
p AS MATERIALIZED (
  SELECT doc_id, i, md5(substr(h, 2 * i + 1, {2 * LENGTH})) AS g
  FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - {LENGTH - 1})) AS i FROM d)),
f AS (SELECT doc_id, i FROM p JOIN (SELECT g FROM p GROUP BY g HAVING count(*) > 1) USING (g)),
b AS (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM f),
s AS (
  SELECT doc_id, min(i) AS a, max(i) + {LENGTH} AS b
  FROM (SELECT *, sum(CASE WHEN i <= before + {LENGTH} THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM b) GROUP BY doc_id, k),
k AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS z FROM s),
t AS (
  SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_spans, string_agg(substr(h, 2 * z + 1, 2 * (a - z)), '' ORDER BY a) || substr(any_value(h), 2 * max(b) + 1) AS kept
  FROM k JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
  coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256
FROM d LEFT JOIN t USING (doc_id)
"""


@register("op8_suffix_dedup", SQL)
def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeated_spans(table(spark, sf_dir, "documents"))
    gone = (F.col("n_equal") > 1) & (F.col("n_bytes") >= LENGTH)
    return found.select(
        "doc_id",
        "n_bytes",
        F.when(gone, F.col("n_bytes")).otherwise(F.coalesce("cut.n_removed", F.lit(0))).alias("n_removed"),
        F.when(gone, F.lit(1)).otherwise(F.coalesce(F.size("cut.spans"), F.lit(0))).cast("long").alias("n_spans"),
        F.when(gone, F.sha2(F.lit(""), 256)).otherwise(F.coalesce(F.sha2("cut.kept", 256), F.col("sha"))).alias("kept_sha256"),
    )
