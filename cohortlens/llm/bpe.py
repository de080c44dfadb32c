"""Byte-level BPE encoding and decoding by prefix dynamic programming.

Of a stretch of bytes, every prefix has exactly one encoding, so exactly one valid last
token. ``PrefixTokens`` stores that token for each prefix: a token ending at byte ``i``
is the right one if it starts the stretch, or if the pair it forms with the stored last
token of the prefix before it survives merging. The ids are read backwards from the end.
Because the entries of a prefix never change, appending bytes only adds entries, and an
edit inside a text re-encodes only the pieces around it.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .registry import register
from .tables import table

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
PIECE_CACHE = 150_000  # pieces in each of the two generations that are kept with their ids
OUTPUTS = {
    "n_tokens": T.LongType(),
    "ids": T.ArrayType(T.IntegerType()),
    "decoded": T.BinaryType(),
    "ids_sha256": T.StringType(),
    "decoded_sha256": T.StringType(),
}


def load_ranks(content: bytes) -> dict[bytes, int]:
    """Rank file: a base64 token and its rank on each line."""
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in content.splitlines() if line)}


class Vocabulary:
    """Ranks with the two questions the dynamic program asks: is a token whole, is a pair valid."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.table = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            self.table[rank] = token
        # lists the tokens that end at each byte of a text, longest first; bytes go in as characters below 256
        self.ending = ahocorasick.Automaton()
        for token, rank in ranks.items():
            self.ending.add_word(token.decode("latin-1"), (rank, len(token)))
        self.ending.make_automaton()
        self.longest = max(map(len, ranks), default=0)
        self.whole = lru_cache(maxsize=1 << 17)(self._whole)
        self.parts = lru_cache(maxsize=1 << 17)(self._parts)
        self.valid = lru_cache(maxsize=1 << 19)(self._valid)

    def merge(self, data: bytes, leave: int = 1) -> list[bytes]:
        """Merge neighbours by lowest rank until ``leave`` parts are left; used on single tokens only."""
        ranks = self.ranks
        parts = [data[k : k + 1] for k in range(len(data))]
        while len(parts) > leave:
            best, at = None, -1
            for k in range(len(parts) - 1):
                rank = ranks.get(parts[k] + parts[k + 1])
                if rank is not None and (best is None or rank < best):
                    best, at = rank, k
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _whole(self, token: int) -> bool:
        return len(self.merge(self.table[token])) == 1

    def _parts(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes this one; none for a single byte."""
        data = self.table[token]
        return tuple(self.ranks[p] for p in self.merge(data, 2)) if len(data) > 1 else None

    def _valid(self, left: int, right: int) -> bool:
        """Whether no merge across the border comes before the merges that made the two (whole) tokens.

        The merges are undone from the last one back. The two tokens next to the border must
        not merge earlier than what was undone; of equal ranks, the left one merges first.
        """
        if not self.whole(right):
            return False
        ranks, table, before = self.ranks, self.table, len(self.table)
        while True:
            joined = ranks.get(table[left] + table[right])
            if joined is not None and joined < before:
                return False
            made_left, made_right = self.parts(left), self.parts(right)
            if made_left and (not made_right or left > right):
                before, left = left, made_left[1]
            elif made_right:
                before, right = right + 1, made_right[0]
            else:
                return True


class PrefixTokens:
    """The last token of every prefix of one piece."""

    __slots__ = ("vocabulary", "data", "last")

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.vocabulary, self.data, self.last = vocabulary, b"", [-1]
        self.append(data)

    def append(self, more: bytes) -> None:
        """Add bytes; the entries so far stay as they are."""
        voc, old = self.vocabulary, len(self.data)
        valid, last = voc.valid, self.last
        self.data = data = self.data + more
        last.extend([-1] * len(more))
        begin = max(0, old - voc.longest + 1)
        for end, (token, size) in voc.ending.iter(data[begin:].decode("latin-1")):
            end += begin + 1
            if end <= old or last[end] >= 0:
                continue
            start = end - size
            if (last[start] >= 0 and valid(last[start], token)) if start else voc.whole(token):
                last[end] = token
        if -1 in last[old + 1 :]:
            raise ValueError(f"the vocabulary has no token for byte {data[last.index(-1, 1) - 1]}")

    def ids(self) -> list[int]:
        out, end, table = [], len(self.data), self.vocabulary.table
        while end:
            token = self.last[end]
            out.append(token)
            end -= len(table[token])
        return out[::-1]


class Encoder:
    """Encodes texts: each match of the pattern separately, with a bounded cache of pieces."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.vocabulary = Vocabulary(ranks)
        self.split = regex.compile(pattern)
        self.cache: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def piece(self, text: str) -> bytes:
        """Ids of one piece, as little-endian 32-bit integers."""
        found = self.cache.get(text)
        if found is None:
            found = self.older.get(text)
            if found is None:
                data = text.encode()
                token = self.vocabulary.ranks.get(data)
                ids = PrefixTokens(self.vocabulary, data).ids() if token is None else [token]
                found = struct.pack(f"<{len(ids)}I", *ids)
            if len(self.cache) >= PIECE_CACHE:
                self.older, self.cache = self.cache, {}
            self.cache[text] = found
        return found

    def encode(self, text: str) -> bytes:
        pieces = self.split.findall(text)
        codes = list(map(self.cache.get, pieces))
        if None in codes:
            codes = [self.piece(p) if code is None else code for p, code in zip(pieces, codes, strict=True)]
        return b"".join(codes)

    def decode(self, ids: bytes) -> bytes:
        table = self.vocabulary.table
        return b"".join([table[k] for k in np.frombuffer(ids, dtype="<u4").tolist()])


@lru_cache(maxsize=2)
def encoder_of(vocabulary: bytes, pattern: str) -> Encoder:
    """One encoder, with its caches, for all tasks of a Python worker."""
    return Encoder(load_ranks(vocabulary), pattern)


class EditableText:
    """A text with its pieces, kept encoded while it grows or is edited."""

    def __init__(self, encoder: Encoder, text: str = ""):
        self.encoder, self.text = encoder, text
        self.starts = [m.start() for m in encoder.split.finditer(text)]
        self.codes = [encoder.piece(m.group()) for m in encoder.split.finditer(text)]

    def ids(self) -> list[int]:
        return np.frombuffer(b"".join(self.codes), dtype="<u4").tolist()

    def append(self, more: str) -> int:
        return self.replace(len(self.text), len(self.text), more)

    def replace(self, start: int, end: int, new: str) -> int:
        """Put ``new`` in the place of ``text[start:end]``; returns how many pieces were encoded again.

        The piece before the edit may grow into it, so encoding starts there; it stops at
        the first old boundary behind the edit that the new pieces meet.
        """
        shift = len(new) - (end - start)
        first = max(0, int(np.searchsorted(self.starts, start, side="right")) - 1)
        if first and self.starts[first] == start:
            first -= 1
        old = {s + shift: k for k, s in enumerate(self.starts) if s >= end}
        text = self.text[:start] + new + self.text[end:]
        begin = self.starts[first] if self.starts else 0
        starts, codes, rest = [], [], len(self.starts)
        for m in self.encoder.split.finditer(text, begin):
            if m.start() >= start + len(new) and m.start() in old:
                rest = old[m.start()]
                break
            starts.append(m.start())
            codes.append(self.encoder.piece(m.group()))
        self.text = text
        self.codes = self.codes[:first] + codes + self.codes[rest:]
        self.starts = self.starts[:first] + starts + [s + shift for s in self.starts[rest:]]
        return len(codes)


def encode_documents(
    df: DataFrame,
    vocabulary: bytes,
    pattern: str,
    outputs: tuple[str, ...] = ("n_tokens", "ids"),
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """``id_column`` and the wanted ``outputs`` (keys of OUTPUTS) of each row.

    ``vocabulary`` is the content of a rank file (under a megabyte, part of the task). A
    null text counts as empty and has no tokens; null and repeated ids are kept, a row
    each; other columns, whatever their names, are left out. An empty table gives an
    empty result. Texts are encoded whole; nothing is shuffled.
    """
    unknown = set(outputs) - set(OUTPUTS)
    if unknown:
        raise ValueError(f"unknown outputs: {sorted(unknown)}")
    key = df.schema[id_column]
    schema = T.StructType([T.StructField(id_column, key.dataType), *(T.StructField(o, OUTPUTS[o]) for o in outputs)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(vocabulary, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                columns: dict[str, list] = {o: [] for o in outputs}
                for text in part.column(1):
                    ids = encoder.encode(text.as_py() or "")
                    if "n_tokens" in columns:
                        columns["n_tokens"].append(len(ids) // 4)
                    if "ids" in columns:
                        columns["ids"].append(np.frombuffer(ids, dtype="<i4"))
                    if "ids_sha256" in columns:
                        columns["ids_sha256"].append(hashlib.sha256(ids).hexdigest())
                    if "decoded" in columns or "decoded_sha256" in columns:
                        decoded = encoder.decode(ids)
                        if "decoded" in columns:
                            columns["decoded"].append(decoded)
                        if "decoded_sha256" in columns:
                            columns["decoded_sha256"].append(hashlib.sha256(decoded).hexdigest())
                kinds = {"n_tokens": pa.int64(), "ids": pa.list_(pa.int32()), "decoded": pa.binary()}
                arrays = [pa.array(columns[o], kinds.get(o, pa.string())) for o in outputs]
                yield pa.RecordBatch.from_arrays([part.column(0), *arrays], names=[id_column, *outputs])

    return df.select(id_column, text_column).mapInArrow(run, schema)


def decode_documents(df: DataFrame, vocabulary: bytes, id_column: str = "doc_id", ids_column: str = "ids") -> DataFrame:
    """``id_column`` and ``decoded`` (bytes) of a column of token ids; null ids decode to nothing."""
    schema = T.StructType([df.schema[id_column], T.StructField("decoded", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Vocabulary(load_ranks(vocabulary)).table
        for batch in batches:
            decoded = [b"".join([tokens[k] for k in ids.as_py() or ()]) for ids in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(decoded, pa.binary())], names=[id_column, "decoded"])

    return df.select(id_column, ids_column).mapInArrow(run, schema)


def public_vocabulary(name: str = VOCABULARY) -> tuple[bytes, str]:
    """Content and split pattern of an installed public rank file."""
    import public_tokenizers

    with open(public_tokenizers.path(name), "rb") as file:
        return file.read(), public_tokenizers.PATTERN


def token_digests(docs: DataFrame) -> DataFrame:
    """Token count and digests of the ids and of the decoded bytes, one row per document."""
    content, pattern = public_vocabulary()
    return encode_documents(docs, content, pattern, ("n_tokens", "ids_sha256", "decoded_sha256"))


@register("op7_byte_bpe")
def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_digests(table(spark, sf_dir, "documents"))
