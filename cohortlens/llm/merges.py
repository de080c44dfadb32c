"""BPE encoding and decoding by batched merge rounds in numpy.

The words of many texts lie in one flat array of symbols. In a round, every word finds the
lowest-ranked of its neighbouring pairs (a binary search in the sorted pair keys gives the
ranks), all places of that pair in the word merge, and the array closes up; only the pairs
at the seams are looked up again. Words without a pair of the table leave the array.

The splitting into words is vectorised as well: a class for each character (letter, number,
space, other) and the places where it changes give the borders that the pattern
``'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+`` makes.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator, Sequence
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .registry import register
from .tables import table

SPECIFICATION = "byte_bpe_50k.json"
NO_RANK = np.int64(1 << 60)
CHUNK = 1 << 21  # bytes of text split together
SLAB = 1 << 20  # bytes of new words merged together
SHORT = 48  # bytes up to which a word is kept with its ids
GENERATION = 150_000  # words in each of the two generations of the cache
SPACE, LETTER, NUMBER, OTHER, UNKNOWN = range(5)
PAUSE = re.compile(rb"[\x21-\x7e](?=[ \n])")  # behind it a word begins, whatever comes before
OUTPUTS = {
    "n_tokens": T.LongType(),
    "ids": T.ArrayType(T.IntegerType()),
    "decoded": T.StringType(),
    "ids_sha256": T.StringType(),
    "decoded_sha256": T.StringType(),
}


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte: printable ones for themselves, the rest from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + k): b for k, b in enumerate(rest)}


@lru_cache(maxsize=1)
def character_classes() -> np.ndarray:
    """Class of every code point; those that Python's Unicode tables lack are UNKNOWN."""
    classes = np.full(0x110000, OTHER, dtype=np.uint8)
    for point in range(0x110000):
        kind = unicodedata.category(chr(point))
        if kind[0] == "L":
            classes[point] = LETTER
        elif kind[0] == "N":
            classes[point] = NUMBER
        elif kind == "Cn":
            classes[point] = UNKNOWN
        elif kind[0] == "Z" or 9 <= point <= 13 or point == 0x85:
            classes[point] = SPACE
    return classes


def resolve(points: np.ndarray) -> None:
    """Settle the class of UNKNOWN code points, as the installed library's newer tables have it."""
    from tokenizers import pre_tokenizers

    split = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True).pre_tokenize_str
    classes = character_classes()
    classes[points] = SPACE
    for kind, mate in ((LETTER, "a"), (NUMBER, "1"), (OTHER, "!")):
        borders = [start for _, (start, _) in split("".join(f"{mate}{chr(p)}\n" for p in points.tolist()))]
        joined = np.ones(3 * len(points), dtype=bool)
        joined[borders] = False
        classes[points[joined[1::3]]] = kind


def word_starts(points: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Positions at which the words of the code points begin.

    ``first`` are the positions where a new stretch begins; words never cross them.
    """
    n = len(points)
    classes = character_classes()[points]
    if (classes == UNKNOWN).any():
        resolve(np.unique(points[classes == UNKNOWN]))
        classes = character_classes()[points]
    fresh = np.zeros(n + 1, dtype=bool)
    fresh[first] = True
    fresh[n] = True
    change = fresh.copy()
    change[1:n] |= classes[1:] != classes[:-1]
    begin = change[:n].copy()
    space = classes == SPACE
    # the last space before something else: a blank joins it, any other stands alone
    last = np.flatnonzero(space[:-1] & ~space[1:] & ~fresh[1:n]) if n > 1 else np.zeros(0, dtype=np.int64)
    begin[last] = True
    begin[last[points[last] == 0x20] + 1] = False
    # 's and its like, where a word begins at the quotation mark
    quote = np.flatnonzero((points == 0x27) & begin)
    quote = quote[quote + 1 < n]
    quote = quote[~fresh[quote + 1]]
    one = quote[np.isin(points[quote + 1], [ord(c) for c in "stmd"])]
    two = quote[quote + 2 < n]
    two = two[~fresh[two + 2]]
    pair = points[two + 1].astype(np.int64) << 32 | points[two + 2]
    two = two[np.isin(pair, [ord(a) << 32 | ord(b) for a, b in ("re", "ve", "ll")])]
    for at, size in ((one, 2), (two, 3)):
        begin[at + 1] = False
        behind = at + size
        behind = behind[behind < n]
        begin[behind[~space[behind]]] = True
    return np.flatnonzero(begin)


class Merges:
    """Tokens, pair keys and ranks of a specification, and the batched encoder over them.

    Takes byte-level BPE without a normalizer; anything else in the file raises ValueError.
    """

    def __init__(self, content: bytes):
        spec = json.loads(content)
        model, before = spec["model"], spec.get("pre_tokenizer") or {}
        odd = spec.get("normalizer") or model.get("type") != "BPE" or before.get("type") != "ByteLevel" or before.get("add_prefix_space")
        odd = odd or not before.get("use_regex", True) or (spec.get("decoder") or {}).get("type") != "ByteLevel"
        odd = odd or any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
        odd = odd or any(t[k] for t in spec.get("added_tokens", []) for k in ("single_word", "lstrip", "rstrip", "normalized"))
        if odd:
            raise ValueError("only plain byte-level BPE is known")
        vocabulary, letters = model["vocab"], byte_letters()
        self.added = {t["content"].encode(): t["id"] for t in spec.get("added_tokens", [])}
        longest = sorted(self.added, key=len, reverse=True)
        self.special = re.compile(b"|".join(map(re.escape, longest))) if longest else None
        self.bytes: dict[int, bytes] = {k: bytes(letters[c] for c in t) if all(c in letters for c in t) else t.encode() for t, k in vocabulary.items()}
        self.bytes |= {k: t for t, k in self.added.items()}
        self.byte_ids = np.full(256, -1, dtype=np.int64)
        for letter, byte in letters.items():
            self.byte_ids[byte] = vocabulary.get(letter, -1)
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        left = np.array([vocabulary[a] for a, _ in pairs], dtype=np.int64)
        right = np.array([vocabulary[b] for _, b in pairs], dtype=np.int64)
        self.made = np.array([vocabulary[a + b] for a, b in pairs], dtype=np.int64)
        keys = left << 32 | right
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        # a merge whose token takes part in an earlier one must go one place at a time
        least = np.full(max([*vocabulary.values(), *self.bytes], default=0) + 1, NO_RANK)
        np.minimum.at(least, left, np.arange(len(pairs)))
        np.minimum.at(least, right, np.arange(len(pairs)))
        self.single = least[self.made] <= np.arange(len(pairs)) if len(pairs) else np.zeros(0, dtype=bool)
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of symbol pairs by binary search; NO_RANK where the table has none."""
        key = left << 32 | right
        if not len(self.keys):
            return np.full(len(key), NO_RANK)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NO_RANK)

    def merge(self, words: Sequence[bytes]) -> list[bytes]:
        """Ids of each word, as little-endian 32-bit integers."""
        symbols = self.byte_ids[np.frombuffer(b"".join(words), dtype=np.uint8)]
        if (symbols < 0).any():
            raise ValueError("the vocabulary lacks a byte")
        owner = np.repeat(np.arange(len(words)), [len(w) for w in words])
        ranks = np.full(len(symbols), NO_RANK)
        inside = np.flatnonzero(owner[1:] == owner[:-1])
        ranks[inside] = self.rank(symbols[inside], symbols[inside + 1])
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(symbols):
            starts = np.flatnonzero(np.diff(owner, prepend=-1))
            sizes = np.diff(starts, append=len(owner))
            low = np.minimum.reduceat(ranks, starts)
            if (low == NO_RANK).any():
                over = np.repeat(low == NO_RANK, sizes)
                done.append((owner[over], symbols[over]))
                symbols, owner, ranks = symbols[~over], owner[~over], ranks[~over]
                sizes, low = sizes[low < NO_RANK], low[low < NO_RANK]
                if not len(symbols):
                    break
            at = np.flatnonzero(ranks == np.repeat(low, sizes))
            # of equal neighbours (x x x) every other pair, from the left
            head = np.diff(at, prepend=-2) != 1
            if not head.all():
                at = at[(at - at[head][np.cumsum(head) - 1]) % 2 == 0]
            slow = self.single[ranks[at]]
            if slow.any():
                at = at[~slow | (np.diff(owner[at], prepend=-1) != 0)]
            symbols[at] = self.made[ranks[at]]
            keep = np.ones(len(symbols), dtype=bool)
            keep[at + 1] = False
            symbols, owner, ranks = symbols[keep], owner[keep], ranks[keep]
            at -= np.arange(len(at))
            seam = np.zeros(len(symbols), dtype=bool)
            seam[at] = True
            seam[at[at > 0] - 1] = True
            ranks[seam] = NO_RANK
            seams = np.flatnonzero(seam[:-1])
            seams = seams[owner[seams] == owner[seams + 1]]
            ranks[seams] = self.rank(symbols[seams], symbols[seams + 1])
        owner = np.concatenate([o for o, _ in done]) if done else np.zeros(0, dtype=np.int64)
        ids = np.concatenate([s for _, s in done]).astype("<u4") if done else np.zeros(0, dtype="<u4")
        order = np.argsort(owner, kind="stable")
        flat, ends = ids[order].tobytes(), np.cumsum(np.bincount(owner, minlength=len(words))) * 4
        return [flat[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]

    def learn(self, words: set[bytes]) -> dict[bytes, bytes]:
        """Ids of new words, merged slab by slab; short words are remembered."""
        found: dict[bytes, bytes] = {}
        slab: list[bytes] = []
        size = 0
        for word in words:
            slab.append(word)
            size += len(word)
            if size >= SLAB:
                found.update(zip(slab, self.merge(slab), strict=True))
                slab, size = [], 0
        if slab:
            found.update(zip(slab, self.merge(slab), strict=True))
        return found

    def codes(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word, from the cache where it has them."""
        young, old = self.young, self.old
        out = list(map(young.get, words))
        missing = [k for k, code in enumerate(out) if code is None]
        if missing:
            new = set()
            for k in missing:
                word = words[k]
                code = old.get(word)
                if code is None:
                    new.add(word)
                else:
                    young[word] = out[k] = code
            learnt = self.learn(new)
            for k in missing:
                if out[k] is None:
                    out[k] = learnt[words[k]]
            young.update((w, c) for w, c in learnt.items() if len(w) <= SHORT)
            if len(young) > GENERATION:
                self.old, self.young = young, {}
        return out

    def encode_stretches(self, stretches: Sequence[bytes]) -> list[bytes]:
        """Ids of stretches of text without special tokens, all split and merged together."""
        data = b"".join(stretches)
        if not data:
            return [b""] * len(stretches)
        points = np.frombuffer(data.decode().encode("utf-32-le"), dtype="<u4").astype(np.int64)
        widths = 1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000)
        place = np.concatenate([[0], np.cumsum(widths)])
        ends = np.cumsum([len(s) for s in stretches])
        first = np.searchsorted(place, np.concatenate([[0], ends[:-1]]))
        starts = place[word_starts(points, first[first < len(points)])]
        begins = starts.tolist()
        codes = self.codes([data[a:b] for a, b in zip(begins, [*begins[1:], len(data)], strict=True)])
        cut = np.searchsorted(starts, ends).tolist()
        return [b"".join(codes[a:b]) for a, b in zip([0, *cut[:-1]], cut, strict=True)]

    def encode(self, texts: Sequence[bytes]) -> list[bytes]:
        """Ids of whole texts. Special tokens in a text become their own ids."""
        stretches: list[bytes] = []
        plan: list[list[tuple[int, int]]] = []  # per text: (stretch, -1) or (-1, special id)
        for text in texts:
            own, at = [], 0
            for m in self.special.finditer(text) if self.special else ():
                own += [(len(stretches), -1), (-1, self.added[m.group()])]
                stretches.append(text[at : m.start()])
                at = m.end()
            own.append((len(stretches), -1))
            stretches.append(text[at:])
            plan.append(own)
        codes = self.encode_stretches(stretches)
        return [b"".join(codes[k] if k >= 0 else special.to_bytes(4, "little") for k, special in own) for own in plan]

    def decode(self, ids: bytes) -> str:
        """Text of token ids; unknown ids give nothing, broken UTF-8 gives U+FFFD."""
        return b"".join(map(self.bytes.get, np.frombuffer(ids, dtype="<u4").tolist(), repeat(b""))).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def merges_of(content: bytes) -> Merges:
    """One encoder, with its cache of words, for all tasks of a Python worker."""
    return Merges(content)


def windows(text: bytes) -> Iterator[bytes]:
    """Parts of at most about CHUNK bytes, cut where a word begins in any case."""
    at = 0
    while len(text) - at > CHUNK:
        m = PAUSE.search(text, at + CHUNK)
        if m is None:
            break
        yield text[at : m.end()]
        at = m.end()
    yield text[at:]


def encoded(merges: Merges, texts: Iterator[bytes | None]) -> Iterator[bytes]:
    """Ids of each text, in order; short texts are encoded together, long ones in parts."""
    held: list[bytes] = []
    size = 0
    for text in texts:
        text = text or b""
        if len(text) > CHUNK:
            yield from merges.encode(held)
            held, size = [], 0
            yield b"".join(merges.encode([part])[0] for part in windows(text))
            continue
        held.append(text)
        size += len(text)
        if size > CHUNK:
            yield from merges.encode(held)
            held, size = [], 0
    yield from merges.encode(held)


def encode_documents(
    df: DataFrame,
    specification: bytes,
    outputs: tuple[str, ...] = ("n_tokens", "ids"),
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """``id_column`` and the wanted ``outputs`` (keys of OUTPUTS) of each row.

    ``specification`` is the content of a tokenizer file (some megabytes, part of the task).
    A null or empty text has no tokens and decodes to an empty text; null and repeated ids
    are kept, a row each; other columns, whatever their names, are left out. An empty table
    gives an empty result. Texts are encoded whole, long ones part by part; no shuffle.
    """
    unknown = set(outputs) - set(OUTPUTS)
    if unknown:
        raise ValueError(f"unknown outputs: {sorted(unknown)}")
    schema = T.StructType([T.StructField("key", df.schema[id_column].dataType), *(T.StructField(o, OUTPUTS[o]) for o in outputs)])
    kinds = {"n_tokens": pa.int64(), "ids": pa.list_(pa.int32())}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merges = merges_of(specification)
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                columns: dict[str, list] = {o: [] for o in outputs}
                for ids in encoded(merges, (t.as_py() for t in part.column(1).cast(pa.binary()))):
                    text = merges.decode(ids) if "decoded" in columns or "decoded_sha256" in columns else ""
                    values = {
                        "n_tokens": lambda: len(ids) // 4, "ids": lambda: np.frombuffer(ids, dtype="<i4"), "decoded": lambda: text,  # noqa: B023
                        "ids_sha256": lambda: hashlib.sha256(ids).hexdigest(), "decoded_sha256": lambda: hashlib.sha256(text.encode()).hexdigest(),  # noqa: B023
                    }
                    for o in outputs:
                        columns[o].append(values[o]())
                arrays = [pa.array(columns[o], kinds.get(o, pa.string())) for o in outputs]
                yield pa.RecordBatch.from_arrays([part.column(0), *arrays], names=["key", *outputs])

    pairs = df.select(df[f"`{id_column}`"].alias("key"), df[f"`{text_column}`"].alias("value"))
    return pairs.mapInArrow(run, schema).withColumnRenamed("key", id_column)


def decode_documents(df: DataFrame, specification: bytes, id_column: str = "doc_id", ids_column: str = "ids") -> DataFrame:
    """``id_column`` and ``decoded`` of a column of token ids; null ids decode to an empty text."""
    schema = T.StructType([T.StructField("key", df.schema[id_column].dataType), T.StructField("decoded", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merges = merges_of(specification)
        for batch in batches:
            texts = [merges.decode(np.array(ids.as_py() or [], dtype="<u4").tobytes()) for ids in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["key", "decoded"])

    pairs = df.select(df[f"`{id_column}`"].alias("key"), df[f"`{ids_column}`"].alias("value"))
    return pairs.mapInArrow(run, schema).withColumnRenamed("key", id_column)


def public_specification(name: str = SPECIFICATION) -> bytes:
    """Content of an installed public tokenizer file."""
    import public_tokenizers

    with open(public_tokenizers.path(name), "rb") as file:
        return file.read()


@register("op11_merge_rounds")
def op11_merge_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents"), public_specification(), ("n_tokens", "ids_sha256", "decoded_sha256"))
