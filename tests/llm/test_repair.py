import hashlib
import random
import zlib
from functools import lru_cache

import pytest

from cohortlens.llm import repair

STEP = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
SPACES = " \t\n\x0b\x0c\r"


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        bare = text.strip(SPACES)
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def brute(rows):
    """Cheapest, then least edit string, from the end of the conversation: whole strings are compared."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    wrong = faults(rows)

    @lru_cache(maxsize=None)
    def best(k, state, inserted):
        ways = []
        if k == len(rows):
            if state in (0, 3):
                ways.append((0, "", ()))
        else:
            _, role, text = rows[k]
            cost, audit, out = best(k + 1, state, 0)
            ways.append((cost + 4, "D" + audit, out))
            if wrong[k] not in ("blank", "duplicate"):
                extra = 3 if wrong[k] == "truncated" else 0
                if (state, role[:1]) in STEP:
                    cost, audit, out = best(k + 1, STEP[state, role[:1]], 0)
                    ways.append((cost + extra, "K" + audit, ((role, text), *out)))
                for new in ("user", "assistant"):
                    if (state, new[0]) in STEP:
                        cost, audit, out = best(k + 1, STEP[state, new[0]], 0)
                        ways.append((cost + extra + 3, "R" + audit, ((new, text), *out)))
        if inserted < 4:
            for new in ("user", "assistant"):
                if (state, new[0]) in STEP:
                    cost, audit, out = best(k, STEP[state, new[0]], inserted + 1)
                    ways.append((cost + 3, "I" + audit, ((new, ""), *out)))
        return min(ways) if ways else (10**9, "", ())

    cost, audit, out = best(0, 0, 0)
    turns = [r[0] for r in rows if r[0] is not None]
    return {
        "gaps": max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
        **{kind: wrong.count(kind) for kind in ("blank", "duplicate", "truncated")},
        "illegal": sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False)),
        "cost": cost, "audit": audit, "repaired_sha256": hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest(),
    }


def some_rows(rng, conv, n):
    roles = ["user", "assistant", "system", "user", "assistant", "tool", "", "usher", "A"]
    texts = ["Yes.", "No!", "cut off", "", " \t\n", "why?", "so. \n", "　", "漢字", "and.\x0b"]
    return [(conv, rng.choice([None, *range(n + 2)]), rng.choice(roles), rng.choice(texts) + rng.choice(["", f" {rng.randrange(9)}."])) for _ in range(n)]


def streamed(rows):
    state, seen = repair.Conversation(), set()
    for turn, role, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode())):
        state.add(turn, role, text, (role, text) in seen)
        seen.add((role, text))
    edits = list(state.edits())
    lines = "\n".join(f"{role}:{text}" for _, _, role, text in edits if role is not None)
    return {**state.summary(), "audit": "".join(e[0] for e in edits), "repaired_sha256": hashlib.sha256(lines.encode()).hexdigest()}


def test_program_equals_comparing_whole_strings():
    rng = random.Random(7)
    for n in range(0, 13):
        for _ in range(250):
            rows = [r[1:] for r in some_rows(rng, 0, n)]
            assert streamed(rows) == brute(rows), rows


@pytest.mark.parametrize("limit", [repair.IN_MEMORY, 300])
def test_streaming_with_and_without_files(spark, monkeypatch, limit):
    rng = random.Random(limit)
    rows = [r for conv in (1, 2, 3, None, 5) for r in some_rows(rng, conv, 40)]
    rows += [(6, 1, None, "x."), (6, 2, "user", None), (6, None, None, None), (7, 2**60, "user", "far."), (7, 2**60 + 3, "assistant", "yes.")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS step", "2 AS conv", "true AS skip", "0 AS cost", "1 AS `a.b`")
    want = {}
    for conv in {r[0] for r in rows}:
        want[conv] = brute([(t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows if c == conv])
    if limit < repair.IN_MEMORY:  # in this process, as the workers import the module anew
        monkeypatch.setattr(repair, "IN_MEMORY", limit)
        monkeypatch.setattr(repair, "BLOCK", 7)
        for conv, result in want.items():
            assert streamed([(t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows if c == conv]) == result
        return
    out = repair.digests(repair.repair(df)).collect()
    assert {r.conv_id: {k: v for k, v in r.asDict().items() if k != "conv_id"} for r in out} == want
    assert repair.digests(repair.repair(df.limit(0))).count() == 0


def test_repaired_rows_are_legal_and_in_order(spark):
    rng = random.Random(3)
    rows = [r for conv in range(30) for r in some_rows(rng, conv, 15)]
    edits = repair.repair(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    for conv in range(30):
        own = [e for e in edits if e.conv_id == conv]
        assert [e.step for e in own] == [*range(len(own) - 1), None] and own[-1].cost is not None
        initials = "".join(e.role[:1] for e in own if e.role is not None)
        assert initials == "" or initials.removeprefix("s") == "ua" * (len(initials) // 2)
        assert sum(e.edit in ("D", "K", "R") for e in own) == 15
        assert all((e.text == "") == (e.edit == "I") for e in own if e.role is not None)


def test_batches_end_inside_conversations(spark):
    rng = random.Random(6)
    rows = [r for conv in (1, 2) for r in some_rows(rng, conv, 60)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        out = {r.conv_id: r.audit for r in repair.digests(repair.repair(df)).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert out == {conv: brute([r[1:] for r in rows if r[0] == conv])["audit"] for conv in (1, 2)}


def test_query_equals_brute_force(spark):
    from cohortlens.llm.registry import QUERIES

    folder = "/root/testdata/sf0.01"
    rows = spark.read.parquet(f"{folder}/conversations.parquet").collect()
    damaged = {}
    for r in rows:
        role, text = " " if r.role is None else r.role, " " if r.text is None else r.text
        key = f"{' ' if r.conv_id is None else r.conv_id}:{' ' if r.turn is None else r.turn}"
        kind = zlib.crc32(key.encode()) % 20
        own = damaged.setdefault(r.conv_id, [])
        text = "" if kind == 1 else "".join(c for c in text if c not in ".!?") if kind == 2 else text
        own += [(r.turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    found = {r.conv_id: {k: v for k, v in r.asDict().items() if k != "conv_id"} for r in QUERIES["op12_conversation_repair"](spark, folder).collect()}
    assert found == {conv: brute(own) for conv, own in damaged.items()}
    assert any(not own for own in damaged.values()) or all(damaged.values())
