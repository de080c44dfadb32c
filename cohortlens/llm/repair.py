"""Repair of the turn structure of conversations by a dynamic program over sorted rows.

Rows are dealt by conversation and sorted by turn inside their partition. One streaming
pass then carries the state of the program from row to row and from one Arrow batch to the
next: the cheapest way to each state of the grammar ``(s?(ua)+)?`` over role initials, and
how the edit strings of these ways compare. Four bytes a row lead back along the best way.
They and the rows of a giant conversation go to unnamed temporary files of the task, so its
memory stays the same whatever the length of a conversation.

Edits of a row: Keep is free, Rerole (to user or assistant) costs 3, Delete 4; Insert (an
empty text of a user or assistant) costs 3. Blank and duplicate rows must be deleted; a
truncated row that stays costs 3 more. Of equally cheap ways the one with the least edit
string (initials D, I, K, R) wins.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator
from functools import lru_cache
from tempfile import TemporaryFile
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .registry import register
from .tables import table

SPACES = " \t\n\x0b\x0c\r"
DELETE, KEEP, REROLE = range(3)
LETTERS = "DKR"
COST = (4, 0, 3)
INSERT, CUT = 3, 3
NEVER = 1 << 60
START, SYSTEM, USER, ASSISTANT = range(4)  # what the grammar has read last
ENDS = (START, ASSISTANT)
KEPT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
NEXT = (USER, USER, ASSISTANT, USER)  # state after the one role that may be put in
ROLE = {USER: "user", ASSISTANT: "assistant"}
LEGAL = {"su", "ua", "au"}
LESS, MORE, STARTS, CONTINUES = -1, 1, 2, -2  # how one edit string compares with another
IN_MEMORY = 8 << 20  # bytes of a conversation's rows or of its way back, beyond that on disk
BLOCK = 1 << 16  # rows of the way back read together
BATCH_ROWS, BATCH_BYTES = 4096, 4 << 20

Step = tuple[int, int, int]  # state before the row, edit of the row, inserts behind it


def compare(one: Step, other: Step, before: tuple[int, ...]) -> int:
    """How the edit strings of two ways compare, given those of the states they come from.

    Of two ways to one place, one string can start the other only by inserts at its end.
    """
    (p, x, m), (q, y, n) = one, other
    if p != q:
        known = before[4 * p + q]
        if known == STARTS:  # x meets an insert, and D < I < K < R
            return LESS if x == DELETE else MORE
        if known == CONTINUES:
            return MORE if y == DELETE else LESS
        return known
    if x != y:
        return LESS if x < y else MORE
    return STARTS if m < n else CONTINUES


def settle(ways: dict[int, list[tuple[int, Step]]], before: tuple[int, ...]) -> tuple[list[int], tuple[int, ...], bytes]:
    """Best cost of each state with inserts, comparison of their strings, way back in four bytes."""
    full: dict[int, list[tuple[int, Step]]] = {s: list(w) for s, w in ways.items()}
    for state, found in ways.items():
        for cost, (p, x, _) in found:
            at = state
            for more in (1, 2):
                at = NEXT[at]
                full[at].append((cost + more * INSERT, (p, x, more)))
    costs, steps = [], []
    for state in range(4):
        best: tuple[int, Step] | None = None
        for cost, step in full[state]:
            if best is None or cost < best[0] or (cost == best[0] and step != best[1] and compare(step, best[1], before) == LESS):
                best = (cost, step)
        costs.append(best[0] if best else NEVER)
        steps.append(best[1] if best else None)
    relation = [0] * 16
    for s in range(4):
        for t in range(4):
            if s != t and steps[s] and steps[t]:
                relation[4 * s + t] = compare(steps[s], steps[t], before)
    return costs, tuple(relation), bytes(0 if s is None else s[0] | s[1] << 2 | s[2] << 4 for s in steps)


def begin() -> tuple[tuple[int, ...], tuple[int, ...], bytes]:
    """The program before the first row: only inserts."""
    costs, relation, back = settle({START: [(0, (0, 0, 0))], SYSTEM: [], USER: [], ASSISTANT: []}, (0,) * 16)
    return tuple(costs), relation, back


@lru_cache(maxsize=1 << 14)
def advance(costs: tuple[int, ...], relation: tuple[int, ...], initial: str, must_go: bool, cut: bool) -> tuple[tuple[int, ...], int, tuple[int, ...], bytes]:
    """One row on: costs above their least, that least, comparison, way back."""
    ways: dict[int, list[tuple[int, Step]]] = {s: [] for s in range(4)}
    for state, cost in enumerate(costs):
        if cost >= NEVER:
            continue
        ways[state].append((cost + COST[DELETE], (state, DELETE, 0)))
        if must_go:
            continue
        extra = cost + (CUT if cut else 0)
        ways[NEXT[state]].append((extra + COST[REROLE], (state, REROLE, 0)))
        if (state, initial) in KEPT:
            ways[KEPT[state, initial]].append((extra, (state, KEEP, 0)))
    found, relation, back = settle(ways, relation)
    least = min(found)
    return tuple(c if c >= NEVER else c - least for c in found), least, relation, back


class Tape:
    """Bytes written once at the end, or in place; beyond IN_MEMORY in an unnamed file."""

    def __init__(self, size: int = 0):
        self.held, self.file, self.size = bytearray(), None, size
        if size > IN_MEMORY:
            self.file = TemporaryFile()
        else:
            self.held.extend(bytes(size))

    def add(self, more: bytes) -> None:
        self.held += more
        self.size += len(more)
        if len(self.held) > IN_MEMORY:
            self.file = self.file or TemporaryFile()
            self.file.write(self.held)
            self.held = bytearray()

    def seal(self) -> None:
        if self.file and self.held:
            self.file.write(self.held)
            self.held = bytearray()

    def read(self, start: int, end: int) -> bytes:
        if self.file is None:
            return bytes(self.held[start:end])
        self.file.seek(start)
        return self.file.read(end - start)

    def put(self, start: int, part: bytes) -> None:
        if self.file is None:
            self.held[start : start + len(part)] = part
        else:
            self.file.seek(start)
            self.file.write(part)

    def close(self) -> None:
        if self.file:
            self.file.close()


class Rows:
    """The rows of a conversation in order; beyond IN_MEMORY in an unnamed file."""

    def __init__(self):
        self.held, self.bytes, self.file, self.blocks = [], 0, None, 0

    def add(self, turn: int | None, role: str, text: str) -> None:
        self.held.append((turn, role, text))
        self.bytes += 100 + len(role) + len(text)
        if self.bytes > IN_MEMORY:
            self.file = self.file or TemporaryFile()
            pickle.dump(self.held, self.file)
            self.held, self.bytes, self.blocks = [], 0, self.blocks + 1

    def __iter__(self) -> Iterator[tuple[int | None, str, str]]:
        if self.file:
            self.file.seek(0)
            for _ in range(self.blocks):
                yield from pickle.load(self.file)
        yield from self.held

    def close(self) -> None:
        if self.file:
            self.file.close()


class Conversation:
    """State of the program, and the fault counts, while the rows of one conversation pass."""

    def __init__(self):
        self.costs, self.relation, first = begin()
        self.paid, self.n = 0, 0
        self.back, self.rows = Tape(), Rows()
        self.back.add(first)
        self.low = self.high = self.last_turn = None
        self.turns = self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.initial: str | None = None

    def add(self, turn: int | None, role: str, text: str, again: bool) -> None:
        if turn is not None:
            self.turns += turn != self.last_turn
            self.low = turn if self.low is None else self.low
            self.high = self.last_turn = turn
        bare = text.rstrip(SPACES)
        blank = not bare
        again = again and not blank
        cut = not blank and bare[-1] not in ".!?"
        self.blank += blank
        self.duplicate += again
        self.truncated += cut and not again
        initial = role[:1]
        if self.initial is not None:
            self.illegal += self.initial + initial not in LEGAL
        self.initial = initial
        self.costs, paid, self.relation, back = advance(self.costs, self.relation, initial if initial in "sua" else "", blank or again, cut)
        self.paid += paid
        self.back.add(back)
        self.rows.add(turn, role, text)
        self.n += 1

    def end(self) -> int:
        """The state in which the best way ends."""
        one, other = ENDS
        if self.costs[one] != self.costs[other]:
            return min(ENDS, key=lambda s: self.costs[s])
        return one if self.relation[4 * one + other] == LESS else other

    def edits(self) -> Iterator[tuple[str, int | None, str | None, str | None]]:
        """(edit, turn, role, text) in order; a deleted row has neither role nor text."""
        self.back.seal()
        total, state = self.n + 1, self.end()
        chosen = Tape(total)
        for end in range(total, 0, -BLOCK):
            start = max(0, end - BLOCK)
            back = self.back.read(4 * start, 4 * end)
            part = bytearray(end - start)
            for k in range(end - start - 1, -1, -1):
                code = back[4 * k + state]
                part[k], state = code >> 2, code & 3
            chosen.put(start, part)
        state, source = START, iter(self.rows)
        for start in range(0, total, BLOCK):
            for k, code in enumerate(chosen.read(start, min(total, start + BLOCK)), start):
                if k:
                    turn, role, text = next(source)
                    edit = code & 3
                    if edit == DELETE:
                        yield "D", turn, None, None
                    else:
                        state = NEXT[state] if edit == REROLE else KEPT[state, role[:1]]
                        yield LETTERS[edit], turn, ROLE[state] if edit == REROLE else role, text
                for _ in range(code >> 2):
                    state = NEXT[state]
                    yield "I", None, ROLE[state], ""
        for part in (chosen, self.back, self.rows):
            part.close()

    def summary(self) -> dict[str, int]:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        cost = self.paid + self.costs[self.end()]
        return {"gaps": gaps, "blank": self.blank, "duplicate": self.duplicate, "truncated": self.truncated, "illegal": self.illegal, "cost": cost}


COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
SUMMARY = T.StructType([T.StructField(c, T.LongType()) for c in COUNTS])
EDITS = T.StructType(
    [T.StructField("conv", T.StringType()), T.StructField("step", T.LongType()), T.StructField("edit", T.StringType()), T.StructField("turn", T.LongType()),
     T.StructField("role", T.StringType()), T.StructField("text", T.StringType()), *(T.StructField(c, T.LongType()) for c in COUNTS)]
)


def _conversations(frames: Iterator[pd.DataFrame]) -> Iterator[tuple[str | None, Iterator[tuple[Any, ...]]]]:
    """Conversations of sorted rows, across the borders of batches; each must be used up in turn."""
    rows = (row for frame in frames for row in frame.astype(object).where(frame.notna(), None).itertuples(index=False, name=None))
    row = next(rows, None)
    while row is not None:
        conv = row[0]

        def own() -> Iterator[tuple[Any, ...]]:
            nonlocal row
            while row is not None and row[0] == conv:  # noqa: B023
                yield row
                row = next(rows, None)

        yield conv, own()


def _frames(rows: Iterator[tuple[Any, ...]], columns: list[str]) -> Iterator[pd.DataFrame]:
    """Rows as frames of bounded size."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += sum(len(v) for v in row if isinstance(v, str))
        if len(held) >= BATCH_ROWS or size > BATCH_BYTES:
            yield pd.DataFrame(held, columns=columns, dtype=object)
            held, size = [], 0
    if held:
        yield pd.DataFrame(held, columns=columns, dtype=object)


def _repair(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    def rows() -> Iterator[tuple[Any, ...]]:
        for conv, own in _conversations(frames):
            state = Conversation()
            for _, turn, role, text, again, skip in own:
                if not skip:
                    state.add(None if turn is None else int(turn), role, text, bool(again))
            for step, (edit, turn, role, text) in enumerate(state.edits()):
                yield conv, step, edit, turn, role, text, *([None] * len(COUNTS))
            yield conv, None, None, None, None, None, *state.summary().values()

    return _frames(rows(), EDITS.names)


def repair(turns: DataFrame, skip: Column | None = None) -> DataFrame:
    """The edits of each conversation in order, then one row with its counts.

    ``turns`` has conv_id, turn, role, text. Returns conv_id, step, edit (D, I, K, R), turn
    (null for inserts), role and text after the repair (null for deleted rows); the row
    without an edit has the counts COUNTS of the rows as they came. A partition holds the
    rows of a conversation together and in this order. Rows go by turn, nulls first, ties by
    role, then text. A null role or text counts as one space; a null conv_id is a
    conversation of its own. Rows where ``skip`` is true only tell that their conversation
    exists: without any other row it has no edits, and counts of zero. Other columns are
    left out; an empty table gives an empty result.
    """
    blank = F.lit(" ")
    rows = turns.select(
        F.col("conv_id").cast("string").alias("conv"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), blank).alias("role"),
        F.coalesce(F.col("text").cast("string"), blank).alias("text"), F.coalesce(skip if skip is not None else F.lit(False), F.lit(False)).alias("skip"),
    )
    dealt = rows.repartition("conv")
    # dealt by conversation as they are, rows need only a local sort to find repeated ones
    same = Window.partitionBy("conv", "skip", "role", "text").orderBy(F.asc_nulls_first("turn"))
    marked = dealt.select("conv", F.col("turn"), "role", "text", (F.row_number().over(same) > 1).alias("again"), "skip")
    ordered = marked.sortWithinPartitions(F.asc_nulls_first("conv"), F.asc_nulls_first("turn"), "role", "text", "again")
    sent = ordered.select("conv", F.col("turn").cast("string").alias("turn"), "role", "text", "again", "skip")
    kind = turns.schema["conv_id"].dataType
    return sent.mapInPandas(_repair, EDITS).withColumn("conv", F.col("conv").cast(kind)).withColumnRenamed("conv", "conv_id")


def _digest(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    def rows() -> Iterator[tuple[Any, ...]]:
        for conv, own in _conversations(frames):
            audit, sha, lines = [], hashlib.sha256(), 0
            for _, edit, role, text, *counts in own:
                if edit is None:
                    yield conv, *map(int, counts), "".join(audit), sha.hexdigest()
                    continue
                audit.append(edit)
                if role is not None:
                    sha.update(f"{chr(10) if lines else ''}{role}:{text}".encode())
                    lines += 1

    return _frames(rows(), ["conv", *COUNTS, "audit", "repaired_sha256"])


def digests(edits: DataFrame) -> DataFrame:
    """A row per conversation from the result of ``repair``: counts, edit string, digest of the repaired rows.

    Reads the edits where they are, in the order ``repair`` leaves them in; nothing is shuffled.
    """
    kind = edits.schema["conv_id"].dataType
    sent = edits.select(F.col("conv_id").cast("string").alias("conv"), "edit", "role", "text", *COUNTS)
    schema = f"conv string, {', '.join(f'{c} long' for c in COUNTS)}, audit string, repaired_sha256 string"
    return sent.mapInPandas(_digest, schema).withColumn("conv", F.col("conv").cast(kind)).withColumnRenamed("conv", "conv_id")


def damaged(turns: DataFrame) -> tuple[DataFrame, Column]:
    """Conversations with faults put in by the checksum of ``conv_id:turn``, and what marks dropped rows."""
    blank = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), blank), F.lit(":"), F.coalesce(F.col("turn").cast("string"), blank))
    kind = F.crc32(key.cast("binary")) % 20
    role, text = F.coalesce("role", blank), F.coalesce("text", blank)
    rows = turns.select("conv_id", "turn", role.alias("role"), text.alias("text"), kind.alias("kind")).select(
        "conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        (F.col("kind") == 0).alias("dropped"), F.explode(F.sequence(F.lit(1), F.when(F.col("kind") == 3, 2).otherwise(1))).alias("copy"),
    )
    return rows, F.col("dropped")


def _ahead(way: str, cost: str, edit: str, line: str = "''") -> str:
    """SQL: a way (cost in nine digits, edits, control character, lines) with one more edit in front."""
    mark = f"instr({way}, chr(1))"
    return f"lpad(CAST(CAST({way}[1:9] AS INTEGER) + {cost} AS VARCHAR), 9, '0') || '{edit}' || substr({way}, 10, {mark} - 10) || chr(1) || {line} || substr({way}, {mark} + 1)"


def _row(state: str, kept: str, role: str, after: str) -> str:
    """SQL: the best way from a state on, if the next edit is one of the row itself."""
    keeps = " ".join(f"WHEN stays AND c = '{c}' THEN {_ahead(t, 'extra', 'K', 'chr(10) || role || chr(58) || text')}" for c, t in (k.split(">") for k in kept.split()))
    rerole = _ahead(after, "extra + 3", "R", f"chr(10) || '{role}:' || text")
    return f"least({_ahead(state, '4', 'D')}, CASE {keeps} ELSE '~' END, CASE WHEN stays THEN {rerole} ELSE '~' END)"


USER_LINE, ASSISTANT_LINE = "chr(10) || 'user:'", "chr(10) || 'assistant:'"
SQL = rf"""
WITH RECURSIVE t AS (
  SELECT list(c ORDER BY b) AS t FROM (SELECT b, list_reduce([b] || range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(b))),
k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    xor(list_reduce([4294967295] || list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda x: CAST(ord(x) AS BIGINT)),
      lambda c, x: xor(c >> 8, t[xor(c & 255, x) + 1])), 4294967295) % 20 AS kind
  FROM conversations, t),
d AS (SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE kind WHEN 3 THEN 2 ELSE 1 END)) AS copy
  FROM k WHERE kind <> 0),
a AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST) > 1 AS again FROM d),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, again) AS i FROM a),
f AS (SELECT *, left(role, 1) AS c, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS earlier,
    CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 1 WHEN again THEN 2 WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 3 ELSE 0 END AS fault FROM n),
g AS (SELECT conv_id, i, role, text, c, fault NOT IN (1, 2) AS stays, CASE fault WHEN 3 THEN 3 ELSE 0 END AS extra FROM f),
v AS (
  SELECT conv_id, max(i) + 1 AS i, '000000000' || chr(1) AS s0, '000000006II' || chr(1) || {USER_LINE} || {ASSISTANT_LINE} AS s1,
    '000000003I' || chr(1) || {ASSISTANT_LINE} AS s2, '000000000' || chr(1) AS s3 FROM g GROUP BY 1
  UNION ALL
  SELECT conv_id, i, least(b0, {_ahead("v2", "3", "I", USER_LINE)}), least(b1, {_ahead("v2", "3", "I", USER_LINE)}), v2, least(b3, {_ahead("b2", "3", "I", USER_LINE)})
  FROM (SELECT *, least(b2, {_ahead("b3", "3", "I", ASSISTANT_LINE)}) AS v2 FROM (
    SELECT g.conv_id, g.i, {_row("s0", "s>s1 u>s2", "user", "s2")} AS b0, {_row("s1", "u>s2", "user", "s2")} AS b1,
      {_row("s2", "a>s3", "assistant", "s3")} AS b2, {_row("s3", "u>s2", "user", "s2")} AS b3
    FROM v JOIN g ON g.conv_id IS NOT DISTINCT FROM v.conv_id AND g.i = v.i - 1))),
faults AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 1) AS blank,
    count(*) FILTER (WHERE fault = 2) AS duplicate, count(*) FILTER (WHERE fault = 3) AS truncated,
    count(*) FILTER (WHERE earlier || c NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY 1),
ways AS (SELECT conv_id, s0, instr(s0, chr(1)) AS mark FROM v WHERE i = 1)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, coalesce(CAST(s0[1:9] AS BIGINT), 0) AS cost, coalesce(substr(s0, 10, mark - 10), '') AS audit,
  sha256(coalesce(substr(s0, mark + 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c
LEFT JOIN faults ON faults.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN ways ON ways.conv_id IS NOT DISTINCT FROM c.conv_id
"""


@register("op12_conversation_repair", SQL)
def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, dropped = damaged(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))
    return digests(repair(rows, dropped))
