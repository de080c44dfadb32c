"""Line dedup: an exact set-similarity join of all lines of a corpus.

A line is the set of its lower-cased words. Two lines match when their Jaccard similarity
reaches ``percent``; a line goes when a line at an earlier place (doc_id, line number)
matches it, whether that line itself goes or not.

The tokens of a line are ordered by rarity. Rarity is the count of a token's slot in a
table of fixed size, filled from the whole corpus: any order that all lines share gives an
exact join, and the rarest tokens first make it a cheap one. Lines that match share a token
within the prefixes that follow from their sizes. The postings of the prefixes meet by
token; length, position and a parity sketch (each differing token flips one bit, so
the bits that differ bound the tokens that do) discard pairs, and what is left is verified
token by token. Where only removals are asked for, a line takes its nearest earlier partners
from a column, and lines that these don't settle are joined with all of theirs, so a dense
column never gives all pairs. Classes and link counts need every pair: the columns then tell only
which lines hang together, and the lines of such a family are verified pair by pair inside tasks
that give one row a line.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import discard, stage
from .arrays import BLANK_WORDS, Slice, mix, ragged, slices, words_of
from .counts import summed
from .graph import components
from .registry import register
from .tables import field, table, whole_row

PERCENT = 80
SLOT_BITS = 22  # slots of the rarity table: 16 MB of counts at any corpus size
BUCKET_POSTINGS = 100_000
BLOCK_TOKENS = 1 << 15  # of a family's lines that meet in one task, and of the small families dealt to one
MARK_BITS = 23
CELLS_AT_ONCE = 1 << 25
NEAREST = 3
ALL = np.iinfo(np.int64).max
PAIRS_AT_ONCE = 1 << 18
LONG = 160  # lines of more tokens also carry a wide sketch; 128 bits would tell few of them apart
WIDE_WORDS = 8
SMALL_COLUMN = 64
NO_ID = -(1 << 63)
POSTING = np.dtype([("token", "u8"), ("sig", "i8"), ("doc", "i8"), ("line", "i4"), ("n", "i4"), ("pos", "i4"), ("s0", "u8"), ("s1", "u8")])
STAR = np.dtype([("token", "u8"), ("sig", "i8"), ("n", "i4"), ("pos", "i4"), ("s0", "u8"), ("s1", "u8")])  # a POSTING without its place
WIDE = np.dtype([("sig", "i8"), ("bits", "u8", (WIDE_WORDS,))])
HEAD = np.dtype([("sig", "i8"), ("doc", "i8"), ("line", "i4"), ("n", "i4")])


def index_length(n, percent: int):
    """Prefix of the smaller line of a pair; n less the least overlap of two lines of that size, plus 1."""
    return n - -(-2 * percent * n // (100 + percent)) + 1


def probe_length(n, percent: int):
    return n - -(-percent * n // 100) + 1


def least_size(percent: int) -> int:
    """Words of the smallest line that a different line can match."""
    return -(-percent // (100 - percent)) if percent < 100 else np.iinfo(np.int32).max


def by_line(line: np.ndarray, key: np.ndarray, token: np.ndarray) -> np.ndarray:
    """Order by line, key and token. One sort of packed values; bits of the key that don't fit are looked at only where they decide."""
    if not len(line):
        return np.zeros(0, dtype=np.int64)
    bits = np.uint64(max(1, int(line.max()).bit_length()))
    packed = line.astype(np.uint64) << (np.uint64(64) - bits) | key >> bits
    order = np.argsort(packed)
    packed = packed[order]
    tied = np.flatnonzero(packed[1:] == packed[:-1])
    if (token[order[tied]] != token[order[tied + 1]]).any():
        return np.lexsort((token, key, line))
    return order


class Sets:
    """Distinct words of some lines, flat: the words of line ``k`` are ``size[k]`` entries from ``begin[k]``, ascending.

    An entry is ``vocab[index]``; ``vocab`` is ascending.
    """

    def __init__(self, vocab: np.ndarray, index: np.ndarray, size: np.ndarray, sig: np.ndarray):
        self.vocab, self.index, self.size, self.sig = vocab, index, size, sig
        self.token = vocab[index]
        self.begin = np.cumsum(size) - size
        self.number = np.repeat(np.arange(len(size)), size)  # of the line an entry belongs to


class LineSets(Sets):
    """The lines of a slice that have a word, with their text ``doc`` in the slice and ``line_no``."""

    def __init__(self, part: Slice):
        feeds = np.flatnonzero(part.data == 10)
        cuts = np.unique(np.concatenate([part.offsets[1:-1], feeds]))
        words, _ = words_of(part, BLANK_WORDS)
        vocab, index = np.unique(words.code, return_inverse=True)
        ends = np.searchsorted(words.starts, np.append(cuts, len(part.data)))  # words before each line's end
        held = np.diff(ends, prepend=0)
        worded = np.flatnonzero(held)
        held = held[worded]
        inside = words.starts[ends[worded] - held]  # the first word of each line
        bits = np.uint64(len(vocab).bit_length())
        packed = np.sort(np.repeat(np.arange(len(held), dtype=np.uint64), held) << bits | index.astype(np.uint64))
        packed = packed[np.append(True, packed[1:] != packed[:-1])[: len(packed)]]
        size = np.bincount((packed >> bits).astype(np.int64), minlength=len(held))
        super().__init__(vocab, (packed & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64), size, np.zeros(0, np.int64))
        self.doc = np.searchsorted(part.offsets, inside, side="right") - 1
        self.line_no = np.searchsorted(feeds, inside) - np.searchsorted(feeds, part.offsets[self.doc])
        sums = np.add.reduceat(mix(vocab)[self.index], self.begin) if len(self.begin) else np.zeros(0, np.uint64)
        folds = np.bitwise_xor.reduceat(mix(vocab + np.uint64(77))[self.index], self.begin) if len(self.begin) else sums
        self.sig = mix(sums ^ mix(folds)).view(np.int64)


def firsts_of(sig: np.ndarray, doc: np.ndarray, line_no: np.ndarray) -> np.ndarray:
    """Which line of each ``sig`` has the first place."""
    order = np.lexsort((line_no, doc, sig))
    keep = np.zeros(len(order), dtype=bool)
    keep[order] = np.append(True, sig[order][1:] != sig[order][:-1])[: len(order)]
    return keep


def squeezed(values: np.ndarray) -> bytes:
    """The number of ``values`` and their bytes, all first ones, then all second ones and so on, compressed."""
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), values.itemsize).T
    return np.int64(len(values)).tobytes() + pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def unsqueezed(raw: bytes, kind: np.dtype) -> np.ndarray:
    n = int(np.frombuffer(raw[:8], dtype=np.int64)[0])
    if not n:
        return np.zeros(0, dtype=kind)
    planes = np.frombuffer(pa.decompress(raw[8:], decompressed_size=n * kind.itemsize, codec="zstd", asbytes=True), dtype=np.uint8)
    return np.ascontiguousarray(planes.reshape(kind.itemsize, n).T).view(kind).reshape(n)


def packed_sets(sets: LineSets, doc: np.ndarray, keep: np.ndarray) -> pa.RecordBatch:
    """The lines ``keep`` as one row of HEAD records, their words and the numbers of these in each line; ``opened`` reads it."""
    entries = keep[sets.number]
    used = np.bincount(sets.index[entries], minlength=len(sets.vocab)) > 0
    heads = np.empty(int(keep.sum()), dtype=HEAD)
    heads["sig"], heads["doc"], heads["line"], heads["n"] = sets.sig[keep], doc[keep], sets.line_no[keep], sets.size[keep]
    vocab = sets.vocab[used]
    index = (np.cumsum(used) - 1)[sets.index[entries]].astype(np.min_scalar_type(len(vocab)))
    index[1:] -= index[:-1].copy()  # steps, modulo the type: small ones inside a line
    parts = [squeezed(heads), squeezed(np.diff(vocab, prepend=np.uint64(0))), squeezed(index)]
    return pa.RecordBatch.from_arrays([pa.array([part], pa.binary()) for part in parts], names=["heads", "vocab", "index"])


def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Sets, np.ndarray]]:
    """The lines of each row of ``packed_sets`` and their HEAD records."""
    for batch in batches:
        for heads, vocab, index in zip(*(batch.column(k).to_pylist() for k in range(3))):
            heads, vocab = unsqueezed(heads, HEAD), np.cumsum(unsqueezed(vocab, np.dtype("u8")), dtype=np.uint64)
            steps = unsqueezed(index, np.min_scalar_type(len(vocab)))
            index = np.cumsum(steps, dtype=steps.dtype).astype(np.int64)
            yield Sets(vocab, index, heads["n"].astype(np.int64), np.ascontiguousarray(heads["sig"])), heads


def rarity(docs: DataFrame) -> np.ndarray:
    """Occurrences of the words of each slot, over the whole corpus; 2**SLOT_BITS counts."""

    def count(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        slots = np.zeros(1 << SLOT_BITS, dtype=np.int64)
        for batch in batches:
            for part in slices(batch.column(0)):
                words, _ = words_of(part, BLANK_WORDS)
                np.add.at(slots, slot_of(words.code), 1)
        return slots

    found = summed(docs.select("text"), count, 1 << SLOT_BITS)
    return np.minimum(found, np.iinfo(np.int32).max).astype(np.int32)


def rarity_of(sets: DataFrame) -> np.ndarray:
    """Lines that hold the words of each slot, of the lines in ``sets``; 2**SLOT_BITS counts."""

    def count(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        slots = np.zeros(1 << SLOT_BITS, dtype=np.int64)
        for lines, _ in opened(batches):
            np.add.at(slots, slot_of(lines.vocab), np.bincount(lines.index, minlength=len(lines.vocab)))
        return slots

    return np.minimum(summed(sets, count, 1 << SLOT_BITS), np.iinfo(np.int32).max).astype(np.int32)


def slot_of(code: np.ndarray) -> np.ndarray:
    return (code >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


def prefixes(sets: Sets, slots: np.ndarray, percent: int) -> tuple[np.ndarray, ...]:
    """Line, token and position of the entries in each line's probing prefix, rarest first."""
    rank = slots[slot_of(sets.vocab)]
    key = np.minimum(rank, (1 << 24) - 1).astype(np.uint64) << np.uint64(40) | sets.vocab >> np.uint64(24)
    order = np.argsort(key, kind="stable")  # equal keys stay in the order of the words
    place = np.empty(len(order), dtype=np.uint64)
    place[order] = np.arange(len(order), dtype=np.uint64)
    bits = np.uint64(len(order).bit_length())
    packed = np.sort(sets.number.astype(np.uint64) << bits | place[sets.index])
    pos = np.arange(len(packed)) - np.repeat(sets.begin, sets.size)
    near = np.flatnonzero(pos < np.repeat(np.where(sets.size >= least_size(percent), probe_length(sets.size, percent), 0), sets.size))
    word = order[(packed[near] & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)]
    shared = rank[word] > 1  # a count of one: no other line has the token
    near, word = near[shared], word[shared]
    return sets.number[near], sets.vocab[word], pos[near]


def sketches(sets: Sets) -> tuple[np.ndarray, np.ndarray]:
    """128 parity bits of each line."""
    if not len(sets.begin):
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    bit = np.uint64(1) << (sets.token & np.uint64(63))
    high = (sets.token >> np.uint64(6)) & np.uint64(1) == 1
    zero = np.uint64(0)
    return np.bitwise_xor.reduceat(np.where(high, zero, bit), sets.begin), np.bitwise_xor.reduceat(np.where(high, bit, zero), sets.begin)


def wide_sketches(sets: Sets, lines: np.ndarray) -> np.ndarray:
    """64 * WIDE_WORDS parity bits of each of some ``lines``."""
    out = np.zeros(len(lines), dtype=WIDE)
    out["sig"] = sets.sig[lines]
    for row, k in zip(out, lines.tolist()):
        token = sets.token[sets.begin[k] : sets.begin[k] + sets.size[k]]
        odd = np.bincount((token >> np.uint64(9)).astype(np.int64) % (64 * WIDE_WORDS), minlength=64 * WIDE_WORDS) & 1
        row["bits"] = np.packbits(odd.astype(np.uint8), bitorder="little").view(np.uint64)
    return out


def postings(docs: DataFrame, held, buckets: int, percent: int, marked=None) -> DataFrame:
    """(bucket, squeezed POSTING records, WIDE records of their long lines).

    Equal lines of a slice count once, at their first place. ``marked`` is a broadcast table
    of slots: only tokens of marked slots are sent.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for part in slices(batch.column(1)):
                sets = LineSets(part)
                doc = ids[part.first + sets.doc]
                keep = firsts_of(sets.sig, doc, sets.line_no)
                number, token, pos = prefixes(sets, held.value, percent)
                use = keep[number]
                if marked is not None:
                    use &= marked.value[slot_of(token)]
                number = number[use]
                out = np.empty(len(number), dtype=POSTING)
                out["doc"], out["line"] = doc[number], sets.line_no[number]
                yield dealt_postings(sets, number, token[use], pos[use], out, buckets)

    return docs.select("id", "text").mapInArrow(run, "bucket long, packed binary, wide binary")


def star_postings(sets: DataFrame, held, buckets: int, percent: int) -> DataFrame:
    """As ``postings``, of parsed lines and in STAR records."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lines, _ in opened(batches):
            number, token, pos = prefixes(lines, held.value, percent)
            yield dealt_postings(lines, number, token, pos, np.empty(len(number), dtype=STAR), buckets)

    return sets.mapInArrow(run, "bucket long, packed binary, wide binary")


def dealt_postings(sets: Sets, number: np.ndarray, token: np.ndarray, pos: np.ndarray, out: np.ndarray, buckets: int) -> pa.RecordBatch:
    """The records ``out`` of some entries, filled and packed by bucket."""
    s0, s1 = sketches(sets)
    out["token"], out["pos"], out["sig"], out["n"] = token, pos, sets.sig[number], sets.size[number]
    out["s0"], out["s1"] = s0[number], s1[number]
    bucket = (mix(out["token"]) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    names, begin = np.unique(bucket[order], return_index=True)
    out, bounds = out[order], [*begin.tolist(), len(order)]
    packed = [squeezed(out[a:b]) for a, b in zip(bounds, bounds[1:])]
    wide = [b""] * len(packed)
    long = np.flatnonzero(sets.size > LONG)
    if len(long):
        bits, line = wide_sketches(sets, long), number[order]
        at = np.flatnonzero(sets.size[line] > LONG)
        key = np.unique(bucket[order[at]] << 32 | np.searchsorted(long, line[at]))
        ends = np.searchsorted(key >> 32, [*names.tolist(), buckets])
        wide = [bits[key[a:b] & 0xFFFFFFFF].tobytes() for a, b in zip(ends, ends[1:])]
    arrays = [pa.array(names, pa.int64()), pa.array(packed, pa.binary()), pa.array(wide, pa.binary())]
    return pa.RecordBatch.from_arrays(arrays, names=["bucket", "packed", "wide"])


def matching(rows: dict[str, np.ndarray], wide: np.ndarray, a: np.ndarray, b: np.ndarray, percent: int) -> tuple[np.ndarray, ...]:
    """Pairs (a, b) of one column that pass all filters, and their sketch distance."""
    n, m = rows["n"][a], rows["n"][b]
    good = np.flatnonzero(100 * np.minimum(n, m) >= percent * np.maximum(n, m))
    a, b, n, m = a[good], b[good], n[good], m[good]
    at, to, total = rows["pos"][a], rows["pos"][b], n + m
    small = np.where(n <= m, at, to)
    good = small < index_length(np.minimum(n, m), percent)
    good &= (1 + np.minimum(n - at - 1, m - to - 1)) * (100 + percent) >= percent * total
    good = np.flatnonzero(good)
    a, b, n, m, total = a[good], b[good], n[good], m[good], total[good]
    distance = np.bitwise_count(rows["s0"][a] ^ rows["s0"][b]).astype(np.int64) + np.bitwise_count(rows["s1"][a] ^ rows["s1"][b])
    good = distance * (100 + percent) <= (100 - percent) * total
    long = np.flatnonzero(good & (np.minimum(n, m) > LONG))
    if len(long):
        one, two = (np.searchsorted(wide["sig"], rows["sig"][side[long]]) for side in (a, b))
        distance[long] = np.bitwise_count(wide["bits"][one] ^ wide["bits"][two]).sum(axis=1)
        good[long] = distance[long] * (100 + percent) <= (100 - percent) * total[long]
    return a[good], b[good], distance[good]


def column_pairs(rows: dict[str, np.ndarray], wide: np.ndarray, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Passing pairs (later, earlier, distance) of ``rows`` in their order by columns, some columns at a time."""
    total = len(rows["token"])
    new = np.append(True, rows["token"][1:] != rows["token"][:-1])[:total]
    begin = np.flatnonzero(new)
    size = np.diff(np.append(begin, total))

    rank = np.arange(total) - np.repeat(begin, size)
    ahead = np.where(np.repeat(size, size) <= SMALL_COLUMN, rank, 0)
    steps = np.cumsum(ahead)
    at = 0
    while at < total:
        end = max(at + 1, int(np.searchsorted(steps, (steps[at - 1] if at else 0) + PAIRS_AT_ONCE, side="right")))
        own = np.arange(at, min(end, total))
        later = np.repeat(own, ahead[own])
        yield matching(rows, wide, later, ragged(own - rank[own], ahead[own]), percent)
        at = end
    for b, m in zip(begin[size > SMALL_COLUMN].tolist(), size[size > SMALL_COLUMN].tolist()):
        strip = max(1, PAIRS_AT_ONCE // m)
        for top in range(0, m, strip):
            own = np.arange(b + top, b + min(m, top + strip))
            yield matching(rows, wide, np.repeat(own, own - b), ragged(np.full(len(own), b), own - b), percent)


def columns_of(batches: Iterator[pa.RecordBatch], kind: np.dtype) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """The postings of a bucket by token and place (STAR: sig), one of each line, and the wide sketches by sig."""
    blobs, wides = [], []
    for batch in batches:
        blobs += [unsqueezed(raw, kind) for raw in batch.column(batch.schema.get_field_index("packed")).to_pylist()]
        wides += batch.column(batch.schema.get_field_index("wide")).to_pylist()
    rows, wide = np.concatenate([np.zeros(0, dtype=kind), *blobs]), np.frombuffer(b"".join(wides), dtype=WIDE)
    del blobs, wides
    wide = wide[np.unique(wide["sig"], return_index=True)[1]]
    token = np.ascontiguousarray(rows["token"])
    order = np.argsort(token)
    token = token[order]
    met = np.zeros(len(order), dtype=bool)
    met[1:] = token[1:] == token[:-1]
    met[:-1] |= met[1:]
    rows, token = rows[order[met]], token[met]  # columns of one line are done
    column = np.cumsum(np.append(0, token[1:] != token[:-1]))[: len(token)]
    sig = np.ascontiguousarray(rows["sig"])
    if kind is STAR:
        order = by_line(column, sig.view(np.uint64), sig.view(np.uint64))
    else:
        order = np.lexsort((rows["line"], rows["doc"], sig, column))
    keep = np.append(True, (column[order][1:] != column[order][:-1]) | (sig[order][1:] != sig[order][:-1]))[: len(order)]
    order = order[keep]
    if kind is not STAR:
        order = order[np.lexsort((sig[order], rows["line"][order], rows["doc"][order], column[order]))]
    held = np.bincount(column[order])
    rows = rows[order[held[column[order]] > 1]]
    return {name: rows[name].astype(np.int64 if name in ("n", "pos") else rows[name].dtype) for name in kind.names}, wide


def joined(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``label`` (the least number of each one's component) after the pairs (a, b) are connected too."""
    while True:
        a, b = label[a], label[b]
        apart = a != b
        if not apart.any():
            return label
        a, b = a[apart], b[apart]
        up = np.arange(len(label))
        np.minimum.at(up, np.maximum(a, b), np.minimum(a, b))
        while (up[up] != up).any():
            up = up[up]
        label = up[label]


def column_stars(packed: DataFrame, percent: int) -> DataFrame:
    """Edges (a, b) that connect the lines of each bucket as its passing pairs do; fewer than it has lines."""

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, wide = columns_of(batches, STAR)
        sig, number = np.unique(rows["sig"], return_inverse=True)
        label = np.arange(len(sig))
        waiting: list[tuple] = []
        for later, earlier, _ in column_pairs(rows, wide, percent):
            waiting.append((number[later], number[earlier]))
            if sum(len(a) for a, _ in waiting) > PAIRS_AT_ONCE:
                label = joined(label, *(np.concatenate(c) for c in zip(*waiting)))
                waiting = []
        if waiting:
            label = joined(label, *(np.concatenate(c) for c in zip(*waiting)))
        moved = np.flatnonzero(label != np.arange(len(sig)))
        yield pa.RecordBatch.from_arrays([pa.array(sig[moved]), pa.array(sig[label[moved]])], names=["a", "b"])

    return packed.groupBy("bucket").applyInArrow(run, "a long, b long")


def candidates(packed: DataFrame, percent: int, nearest: int, asking=None) -> DataFrame:
    """Of each line and bucket, the ``nearest`` earlier partners (x, y, distance) and how many more there are.

    ``asking`` is a broadcast table of slots: only lines whose sig has a marked slot ask.
    """

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, wide = columns_of(batches, POSTING)
        kept: list[tuple] = []
        for later, earlier, distance in column_pairs(rows, wide, percent):
            if asking is not None:
                asks = asking.value[slot_of(rows["sig"][later].view(np.uint64))]
                later, earlier, distance = later[asks], earlier[asks], distance[asks]
            if len(later):
                kept.append(_nearest(rows["sig"][later], rows["sig"][earlier], distance, np.zeros(len(later), np.int64), nearest))
            if nearest == ALL and sum(len(c[0]) for c in kept) > PAIRS_AT_ONCE:
                yield packed_up(kept)  # all are kept: nothing to hold back, a pair of two columns may come twice
                kept = []
        if kept:
            yield packed_up(kept)

    def packed_up(kept: list[tuple]) -> pa.RecordBatch:
        columns = _nearest(*(np.concatenate(c) for c in zip(*kept)), nearest)
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["x", "y", "distance", "more"])

    return packed.groupBy("bucket").applyInArrow(run, "x long, y long, distance long, more long")


def _nearest(x, y, distance, more, nearest):
    """Per x the ``nearest`` different y; what is left out is counted in ``more``."""
    order = np.lexsort((distance, y, x))
    x, y, distance, more = x[order], y[order], distance[order], more[order]
    same = np.append(False, (x[1:] == x[:-1]) & (y[1:] == y[:-1]))
    begin = np.flatnonzero(np.append(True, x[1:] != x[:-1]))
    carried = np.add.reduceat(more, begin)
    x, y, distance = x[~same], y[~same], distance[~same]
    order = np.lexsort((y, distance, x))
    x, y, distance = x[order], y[order], distance[order]
    begin = np.flatnonzero(np.append(True, x[1:] != x[:-1]))
    size = np.diff(np.append(begin, len(x)))
    keep = np.arange(len(x)) - np.repeat(begin, size) < nearest
    left = np.zeros(len(x), dtype=np.int64)
    left[begin] = carried + np.maximum(size - nearest, 0)
    return x[keep], y[keep], distance[keep], left[keep]


def all_lines(docs: DataFrame) -> DataFrame:
    """(id, mark, line_no, sig, n) of every line with a word; ``mark`` tells repeated ids apart."""
    schema = "id long, mark long, line_no long, sig long, n long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch.column(2)):
                sets = LineSets(part)
                at = pa.array(part.first + sets.doc)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(sets.line_no), pa.array(sets.sig), pa.array(sets.size)], names=["id", "mark", "line_no", "sig", "n"])

    return docs.select("id", "mark", "text").mapInArrow(run, schema)


def parsed_lines(docs: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """``all_lines``, and (heads, vocab, index) of ``packed_sets``: the lines of each slice that a different one may match.

    Both are written, in one table, by one pass over the texts. Equal lines of a slice are packed once, at their first place.
    """
    schema = "id long, mark long, line_no long, sig long, n long, heads binary, vocab binary, index binary"
    kinds = pa.schema([(c, pa.int64()) for c in ("id", "mark", "line_no", "sig", "n")] + [(c, pa.binary()) for c in ("heads", "vocab", "index")])

    def row_batch(columns: dict[str, pa.Array], rows: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([columns[f.name] if f.name in columns else pa.nulls(rows, f.type) for f in kinds], schema=kinds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch.column(2)):
                sets = LineSets(part)
                at = pa.array(part.first + sets.doc)
                id_, mark = batch.column(0).take(at), batch.column(1).take(at)
                yield row_batch({"id": id_, "mark": mark, "line_no": pa.array(sets.line_no, pa.int64()), "sig": pa.array(sets.sig), "n": pa.array(sets.size, pa.int64())}, len(at))
                doc = id_.to_numpy(zero_copy_only=False)
                packed = packed_sets(sets, doc, firsts_of(sets.sig, doc, sets.line_no) & (sets.size >= least_size(percent)))
                yield row_batch(dict(zip(packed.schema.names, packed.columns)), 1)

    both = stage(docs.select("id", "mark", "text").mapInArrow(run, schema))
    lines, sets = both.where("heads is null").select("id", "mark", "line_no", "sig", "n"), both.where("heads is not null").select("heads", "vocab", "index")
    lines._stage_path = both._stage_path
    return lines, sets


def line_tokens(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(sig, tokens) of the ``wanted`` (sig, id, line_no) lines; one row per sig."""
    per_doc = wanted.groupBy("id").agg(F.collect_list(F.struct("line_no", "sig")).alias("lines"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            asked = [{(r["line_no"], r["sig"]) for r in rows} for rows in batch.column(0).to_pylist()]
            for part in slices(batch.column(1)):
                sets = LineSets(part)
                here = [k for k, key in enumerate(zip(sets.line_no.tolist(), sets.sig.tolist())) if key in asked[part.first + sets.doc[k]]]
                tokens = [sets.token[sets.begin[k] : sets.begin[k] + sets.size[k]].view(np.int64) for k in here]
                yield pa.RecordBatch.from_arrays([pa.array(sets.sig[here]), pa.array(tokens, pa.list_(pa.int64()))], names=["sig", "tokens"])

    found = per_doc.hint("merge").join(docs.select("id", "text"), "id").select("lines", "text").mapInArrow(run, "sig long, tokens array<long>")
    return found.dropDuplicates(["sig"])


def verified(pairs: DataFrame, tokens: DataFrame, percent: int) -> DataFrame:
    """The pairs (x, y) that reach the threshold."""
    a = tokens.select(F.col("sig").alias("x"), F.col("tokens").alias("a"))
    b = tokens.select(F.col("sig").alias("y"), F.col("tokens").alias("b"))
    both = F.size(F.array_intersect("a", "b"))
    return pairs.join(a, "x").join(b, "y").where(100 * both >= percent * (F.size("a") + F.size("b") - both)).select("x", "y")


def buckets_for(classes: DataFrame, percent: int) -> int:
    """Buckets for the postings of the lines ``classes`` (n)."""
    total = classes.where(F.col("n") >= least_size(percent)).agg(F.sum(F.ceil(F.col("n") * (100 - percent) / 100) + 1)).first()[0] or 1
    return int(-(-total // BUCKET_POSTINGS))


class Found:
    """Lines, their classes by equal sets, and the candidate pairs of different ones, all staged."""

    def __init__(self, docs: DataFrame, percent: int, nearest: int):
        self.docs, self.percent = docs, percent
        self.lines = stage(all_lines(docs))
        self.classes = stage(self.lines.groupBy("sig").agg(F.min(place()).alias("first"), F.max("n").alias("n")))
        self.held = docs.sparkSession.sparkContext.broadcast(rarity(docs))
        self.buckets = buckets_for(self.classes, percent)
        self.found = stage(candidates(postings(docs, self.held, self.buckets, percent), percent, nearest))
        self.pairs = stage(self.found.groupBy("x", "y").agg(F.min("distance").alias("distance")))
        ends = self.pairs.select(F.col("x").alias("sig")).union(self.pairs.select(F.col("y").alias("sig"))).distinct()
        self.places = self.classes.select("sig", F.col("first.doc").alias("id"), F.col("first.line").alias("line_no"))
        self.tokens = stage(line_tokens(docs, ends.join(self.places, "sig")))

    def done(self, *others: DataFrame) -> None:
        """Candidates and tokens are needed no more: what was decided by them is written."""
        discard(self.found, self.pairs, self.tokens, *others)

    def partners(self, more: DataFrame) -> DataFrame:
        return _all_partners(self.docs, self.held, more, self.tokens, self.places, self.buckets, self.percent)

    def removed(self, settled: DataFrame) -> DataFrame:
        """Every line that goes, by verified pairs (x, y) that hold an earlier y for each x that has one."""
        firsts = self.classes.select(F.col("sig").alias("y"), F.col("first").alias("other"))
        near = settled.join(firsts, "y").groupBy(F.col("x").alias("sig")).agg(F.min("other").alias("near"))
        judged = self.lines.join(self.classes.select("sig", "first").join(near, "sig", "left"), "sig")
        earlier = F.least(F.when(F.col("first") < place(), F.col("first")), F.col("near"))
        return judged.withColumn("match", earlier).where("match is not null").select("id", "mark", "line_no", F.col("match.doc").alias("first_doc"), F.col("match.line").alias("first_line"))


def place() -> F.Column:
    return F.struct(F.col("id").alias("doc"), F.col("line_no").alias("line"))


def removed_lines(docs: DataFrame, percent: int = PERCENT, nearest: int = NEAREST) -> DataFrame:
    """Every line that goes: id, mark, line_no and the place (first_doc, first_line) of an earlier match.

    ``docs`` has id (never null), mark, text (never null). Lines without a word stay.
    """
    f = Found(docs, percent, nearest)
    best = f.pairs.groupBy("x").agg(F.min_by("y", F.struct("distance", "y")).alias("y"))
    near = stage(verified(best, f.tokens, percent))
    others = f.pairs.join(best, ["x", "y"], "left_anti").join(near, "x", "left_anti").select("x", "y")
    settled = stage(near.union(verified(others, f.tokens, percent)))
    more = f.found.where("more > 0").select(F.col("x").alias("sig")).distinct().join(settled.select(F.col("x").alias("sig")), "sig", "left_anti")
    more = stage(more)
    first = settled
    if not more.isEmpty():
        settled = stage(first.union(f.partners(more)))
        discard(first)
    f.done(near, more)
    return f.removed(settled)


def marked_tokens(sets: DataFrame, wanted: DataFrame) -> DataFrame:
    """(sig, doc, line, tokens): the first line of each slice that has a ``wanted`` sig, and some lines more.

    The sigs go to the tasks as a table of 2**MARK_BITS marks, so no text is shuffled; a line
    that shares a slot with a wanted one comes along.
    """
    size = 1 << MARK_BITS

    def slot(sig: np.ndarray) -> np.ndarray:
        return (sig.view(np.uint64) >> np.uint64(64 - MARK_BITS)).astype(np.int64)

    def marks(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        out = np.zeros(size, dtype=np.int64)
        for batch in batches:
            out[slot(batch.column(0).to_numpy())] = 1
        return out

    marked = sets.sparkSession.sparkContext.broadcast(summed(wanted.select("sig"), marks, size) > 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lines, heads in opened(batches):
            here = np.flatnonzero(marked.value[slot(lines.sig)])
            size = lines.size[here]
            flat = pa.array(lines.token[ragged(lines.begin[here], size)].view(np.int64))
            tokens = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(size)).astype(np.int32)), flat)
            yield pa.RecordBatch.from_arrays([pa.array(lines.sig[here]), pa.array(heads["doc"][here]), pa.array(heads["line"][here].astype(np.int64)), tokens], names=["sig", "doc", "line", "tokens"])

    return sets.mapInArrow(run, "sig long, doc long, line long, tokens array<long>")


def family_pairs(family: np.ndarray, block: np.ndarray, across: bool, size: np.ndarray, token: np.ndarray, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Matching pairs (later, earlier) of lines by ``family``, which have ``size`` tokens each; ``across``: of different blocks only."""
    if not len(family):
        return
    start = np.cumsum(size) - size
    names, column = np.unique(token, return_inverse=True)
    end = np.searchsorted(family, family, side="right")
    strip = max(1, CELLS_AT_ONCE // len(names))
    for top in range(0, len(family), strip):
        own = np.arange(top, min(len(family), top + strip))
        has = np.zeros((len(own), len(names)), dtype=bool)
        has[np.repeat(own - top, size[own]), column[start[top] : start[own[-1]] + size[own[-1]]]] = True
        ahead = end[own] - own - 1
        steps = np.cumsum(ahead)
        at = 0
        while at < len(own):
            to = max(at + 1, int(np.searchsorted(steps, (steps[at - 1] if at else 0) + PAIRS_AT_ONCE, side="right")))
            earlier, later = np.repeat(own[at:to], ahead[at:to]), ragged(own[at:to] + 1, ahead[at:to])
            at = to
            n, m = size[earlier], size[later]
            good = 100 * np.minimum(n, m) >= percent * np.maximum(n, m)
            if across:
                good &= block[earlier] != block[later]
            earlier, later = earlier[good], later[good]
            work = np.cumsum(size[later])
            cuts = [0, *np.searchsorted(work, np.arange(8 * PAIRS_AT_ONCE, work[-1] if len(work) else 0, 8 * PAIRS_AT_ONCE)).tolist(), len(work)]
            for a, b in zip(cuts, cuts[1:]):
                x, y = later[a:b], earlier[a:b]
                if not len(x):
                    continue
                n = size[x]
                hit = has[np.repeat(y - top, n), column[ragged(start[x], n)]]
                both = np.add.reduceat(hit, np.cumsum(n) - n, dtype=np.int64)
                match = 100 * both >= percent * (n + size[y] - both)
                yield x[match], y[match]


def family_links(sets: DataFrame, parts: int, percent: int) -> DataFrame:
    """What the lines ``sets`` (sig, doc, line, tokens, family, blocks) match, by task: (sig, root, links, doc, line, split).

    ``links`` counts the matching lines, ``doc`` and ``line`` are the earliest place of an earlier one, lines
    of one ``root`` hang together. A family of one block is whole in one of the ``parts``; the
    blocks of a larger one meet two by two, and its rows are ``split``.
    """
    whole = F.col("blocks") == 1
    block = F.pmod(F.xxhash64("sig"), F.col("blocks"))
    cells = sets.select("*", block.alias("block"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other"))
    cells = cells.select(
        F.when(whole, F.pmod(F.xxhash64("family"), F.lit(parts))).otherwise(F.col("family")).alias("part"),
        F.when(whole, -1).otherwise(F.least("block", "other")).alias("i"),
        F.when(whole, -1).otherwise(F.greatest("block", "other")).alias("j"),
        "family", "block", "sig", "doc", "line", "tokens",
    )

    def run(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        i, j = key[1].as_py(), key[2].as_py()
        group = group.select(["family", "block", "sig", "doc", "line", "tokens"]).combine_chunks()
        family, block, sig, doc, line = (group[c].to_numpy() for c in ("family", "block", "sig", "doc", "line"))
        order = np.lexsort((sig, line, doc, family))
        order = order[np.append(True, (sig[order][1:] != sig[order][:-1]))[: len(order)]]  # repeated rows
        family, block, sig, doc, line = family[order], block[order], sig[order], doc[order], line[order]
        lists = group["tokens"].chunk(0)
        at, flat = lists.offsets.to_numpy().astype(np.int64), lists.values.to_numpy()
        size = np.diff(at)[order]
        links, near = np.zeros(len(sig), np.int64), np.full(len(sig), len(sig))
        label = np.arange(len(sig))
        for later, earlier in family_pairs(family, block, i != j, size, flat[ragged(at[:-1][order], size)], percent):
            links += np.bincount(later, minlength=len(sig)) + np.bincount(earlier, minlength=len(sig))
            np.minimum.at(near, later, earlier)  # by place
            label = joined(label, later, earlier)
        out = np.flatnonzero(links)
        near, first = near[out], near[out] == len(sig)
        near = np.where(first, 0, near)
        columns = [pa.array(sig[out]), pa.array(sig[label[out]]), pa.array(links[out]), pa.array(doc[near], mask=first), pa.array(line[near], mask=first), pa.array(np.full(len(out), i >= 0))]
        return pa.table(columns, names=["sig", "root", "links", "doc", "line", "split"])

    return cells.groupBy("part", "i", "j").applyInArrow(run, "sig long, root long, links long, doc long, line long, split boolean")


def linked_lines(docs: DataFrame, percent: int = PERCENT, nearest: int = ALL) -> tuple[DataFrame, DataFrame]:
    """The lines that go, as ``removed_lines``, and (id, mark, class_id, n_links) of each document that shares or links a line.

    Every pair of different lines is verified, inside tasks: lines that a chain of candidate pairs
    connects are a family, and a family is compared with itself, block by block. Documents are of one class when a chain of equal
    or matching lines leads from one to the other; a class is named by its least id. ``n_links``
    counts, for each different line of a document, the different lines of the corpus that match
    it. ``nearest`` is an option of ``removed_lines``; here it changes nothing.
    """
    lines, sets = parsed_lines(docs, percent)
    sizes = stage(lines.groupBy("sig").agg(F.count(F.lit(1)).alias("held"), F.max("n").alias("n")))
    held = docs.sparkSession.sparkContext.broadcast(rarity_of(sets))
    stars = stage(column_stars(star_postings(sets, held, buckets_for(sizes, percent), percent), percent))
    families = components(stars).select(F.col("node").alias("sig"), F.col("label").alias("family"))
    # A line that no other equals or may match goes nowhere and links nothing.
    busy = sizes.where("held > 1").select("sig", F.lit(None).cast("long").alias("family")).union(families).groupBy("sig").agg(F.max("family").alias("family"))
    met = stage(lines.join(busy, "sig"))
    firsts = stage(met.groupBy("sig").agg(F.min(place()).alias("first"), F.max("n").alias("n"), F.max("family").alias("family")))
    discard(sizes, stars)
    members = firsts.where("family is not null")
    parts = int(-(-(members.agg(F.sum("n")).first()[0] or 1) // BLOCK_TOKENS))
    blocks = members.groupBy("family").agg(F.ceil(F.sum("n") / BLOCK_TOKENS).alias("blocks"))
    dealt = members.join(blocks, "family").select("sig", F.col("first.doc").alias("doc"), F.col("first.line").alias("line"), "family", "blocks")
    tokens = marked_tokens(sets, members)
    links = stage(family_links(tokens.join(dealt, ["sig", "doc", "line"]), parts, percent))
    discard(lines)  # with the sets
    split = components(links.where("split").select(F.col("sig").alias("a"), F.col("root").alias("b"))).withColumnRenamed("node", "sig")
    found = links.groupBy("sig").agg(F.sum("links").alias("links"), F.min(F.when(F.col("doc").isNotNull(), F.struct("doc", "line"))).alias("near"), F.min("root").alias("root"))
    found = found.join(split, "sig", "left").select("sig", "links", "near", F.coalesce("label", "root").alias("label"))
    judged = firsts.select("sig", "first").join(found, "sig", "left")
    every = stage(met.select("id", "mark", "line_no", "sig").join(judged, "sig"))
    discard(met, firsts, links)
    earlier = F.least(F.when(F.col("first") < place(), F.col("first")), F.col("near"))
    removed = every.withColumn("match", earlier).where("match is not null").select("id", "mark", "line_no", F.col("match.doc").alias("first_doc"), F.col("match.line").alias("first_line"))
    node = F.xxhash64("id", "mark").alias("node")
    rows = stage(every.select("id", "mark", "sig", F.coalesce("label", "sig").alias("label"), F.coalesce("links", F.lit(0)).alias("links")).distinct().select("id", "mark", node, "label", "links"))
    # Documents of a line class hang on one of them: a spanning star, never their pairs.
    star = rows.groupBy("label").agg(F.min("node").alias("b"))
    chains = components(rows.select("node", "label").distinct().join(star, "label").select(F.col("node").alias("a"), "b"))
    counts = rows.groupBy("id", "mark", "node").agg(F.sum("links").alias("n_links"))
    classes = stage(counts.join(chains, "node", "left").withColumn("label", F.coalesce("label", "node")))
    discard(rows)
    named = classes.groupBy("label").agg(F.min(F.when(F.col("id") != NO_ID, F.col("id"))).alias("class_id"))
    return removed, classes.join(named, "label").select("id", "mark", "class_id", "n_links")


def _all_partners(docs: DataFrame, held, more: DataFrame, tokens: DataFrame, places: DataFrame, buckets: int, percent: int) -> DataFrame:
    """Verified earlier partners of the lines in ``more`` (sig), from all columns of their prefixes.

    Two tables of 2**SLOT_BITS marks, for these lines and for their tokens, keep every other
    column from being sent and every other line from asking.
    """
    spark = docs.sparkSession
    size = 1 << SLOT_BITS

    def marks(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        out = np.zeros(2 * size, dtype=np.int64)
        for batch in batches:
            out[size + slot_of(batch.column(0).to_numpy().view(np.uint64))] = 1
            for row in batch.column(1):
                out[slot_of(np.array(row.as_py(), dtype=np.int64).view(np.uint64))] = 1
        return out

    found = summed(more.join(tokens, "sig").select("sig", "tokens"), marks, 2 * size) > 0
    marked, asking = (spark.sparkContext.broadcast(part) for part in (found[:size].copy(), found[size:].copy()))
    every = candidates(postings(docs, held, buckets, percent, marked), percent, ALL, asking)
    pairs = stage(every.join(more.select(F.col("sig").alias("x")), "x", "left_semi").select("x", "y").distinct())
    missing = pairs.select(F.col("y").alias("sig")).distinct().join(tokens.select("sig"), "sig", "left_anti")
    return verified(pairs, tokens.unionByName(stage(line_tokens(docs, missing.join(places, "sig")))), percent)


def prepared(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"), F.xxhash64(text).alias("mark"), text.alias("text"))


def line_decisions(docs: DataFrame, **options) -> DataFrame:
    """doc_id, n_lines, n_removed, removed (line numbers), matched, class_id and n_links of each row.

    ``matched`` holds the document of the earliest match of each removed line; class_id and
    n_links (see ``linked_lines``) cover all matches. A class of rows without an id only has none.
    A null or empty text is one line without a word. Rows without an id come before all
    others and keep a null id. A row repeated with its id is the same document: neither copy
    is earlier. Rows that repeat an id with another text are judged by their own lines. Other
    columns are left out; an empty table gives an empty result.
    """
    rows = prepared(docs)
    removed, linked = linked_lines(rows, **options)
    gone = removed.distinct().groupBy("id", "mark").agg(
        F.array_sort(F.collect_set("line_no")).alias("removed"),
        F.array_sort(F.collect_set(F.when(F.col("first_doc") != NO_ID, F.col("first_doc")))).alias("matched"),
    )
    sizes = rows.select("id", "mark", F.size(F.split("text", "\n")).cast("long").alias("n_lines"))
    none = F.array().cast("array<bigint>")
    given = F.coalesce("class_id", "id")
    return sizes.join(gone, ["id", "mark"], "left").join(linked, ["id", "mark"], "left").select(
        F.when(F.col("id") != NO_ID, F.col("id")).alias("doc_id"),
        "n_lines",
        F.coalesce(F.size("removed"), F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce("removed", none).alias("removed"),
        F.coalesce("matched", none).alias("matched"),
        F.when(given != NO_ID, given).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
    )


def cut_lines(docs: DataFrame, **options) -> DataFrame:
    """(row, text, n_removed): all columns of a row as one struct, its text without the removed lines, and their number."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    keyed = docs.select(whole_row(docs), F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"), F.xxhash64(text).alias("mark"))
    gone = removed_lines(prepared(docs), **options).groupBy("id", "mark").agg(F.collect_set("line_no").alias("gone"))
    joined = keyed.join(gone, ["id", "mark"], "left")
    kept = F.filter(F.split(F.coalesce(F.col("row.text").cast("string"), F.lit("")), "\n"), lambda line, k: ~F.array_contains("gone", k.cast("long")))
    cut = F.when(F.col("gone").isNotNull(), F.array_join(kept, "\n")).otherwise(F.col("row.text"))
    return joined.select("row", cut.alias("text"), F.coalesce(F.size("gone"), F.lit(0)).alias("n_removed"))


def without_lines(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with the removed lines cut from ``text``, and ``n_removed``.

    All columns stay, whatever their names, but an ``n_removed`` that was there before.
    """
    fields = [field(c) if c.lower() != "text" else F.col("text").alias(c) for c in docs.columns if c.lower() != "n_removed"]
    return cut_lines(docs, **options).select(*fields, "n_removed")


@register("op1_line_dedup")
def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_decisions(table(spark, sf_dir, "documents"))
    return out.select(
        "doc_id",
        "n_lines",
        "n_removed",
        F.sha2(F.array_join("removed", ","), 256).alias("removed_sha256"),
        "class_id",
        "n_links",
        "matched",
    )
