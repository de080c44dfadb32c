import random
import re

import numpy as np
import pyarrow as pa
import pytest

from cohortlens.llm import lines as L
from cohortlens.llm.arrays import slices


def words(line):
    return frozenset(re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in line)))


def brute(rows, percent=80):
    """Removed line numbers by row; rows are (doc_id, text)."""
    all_lines = [(doc, k, words(line), at) for at, (doc, text) in enumerate(rows) for k, line in enumerate((text or "").split("\n"))]
    gone = [set() for _ in rows]
    for doc, k, own, at in all_lines:
        for d, j, other, _ in all_lines:
            if own and other and (d, j) < (doc, k) and 100 * len(own & other) >= percent * len(own | other):
                gone[at].add(k)
                break
    return [sorted(g) for g in gone]


def corpus(seed, n=60):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(300)] + ["the", "of", "Straße", "été", "漢字"] * 20
    bases = [[rng.choice(vocabulary) for _ in range(rng.choice([1, 2, 4, 6, 9, 15, 40, 120]))] for _ in range(40)]
    rows = []
    for doc in range(n):
        parts = []
        for _ in range(rng.randrange(1, 9)):
            line = list(rng.choice(bases)) if rng.random() < 0.7 else [rng.choice(vocabulary) for _ in range(rng.randrange(0, 30))]
            for _ in range(rng.choice([0, 0, 1, 2, 4])):
                if line:
                    line[rng.randrange(len(line))] = rng.choice(vocabulary).upper()
            rng.shuffle(line)
            parts.append(rng.choice([" ", "\t ", "  "]).join(line))
        rows.append((doc * 7 % 1000, "\n".join(parts)))
    return rows


@pytest.mark.parametrize("seed,options", [(1, {}), (2, {"nearest": 1}), (3, {"percent": 60})])
def test_decisions_equal_brute_force(spark, seed, options):
    rows = corpus(seed) + [(5000, ""), (5001, None), (5002, "\n\n"), (5003, "of the\nthe OF\n the  of ")]
    df = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, sig int")
    got = {r.doc_id: r for r in L.line_decisions(df, **options).collect()}
    want = brute(rows, options.get("percent", 80))
    for (doc, text), gone in zip(rows, want):
        assert got[doc].removed == gone, doc
        assert got[doc].n_lines == len((text or "").split("\n"))
        assert all(m <= doc for m in got[doc].matched) and bool(got[doc].matched) == bool(gone)
    cut = {r.doc_id: r for r in L.without_lines(df, **options).collect()}
    for (doc, text), gone in zip(rows, want):
        left = "\n".join(line for k, line in enumerate((text or "").split("\n")) if k not in gone)
        assert (cut[doc].text or "") == left and cut[doc].sig == 1


def brute_classes(rows, percent=80):
    """(class_id, n_links) of each row; rows are (doc_id, text) with different ids."""
    own = {doc: {words(line) for line in (text or "").split("\n")} - {frozenset()} for doc, text in rows}
    every = set().union(*own.values())
    linked = {a: {b for b in every if 100 * len(a & b) >= percent * len(a | b)} for a in every}
    name = {doc: doc for doc in own}
    changed = True
    while changed:
        changed = False
        for a in own:
            near = set().union(*(linked[x] for x in own[a]))
            for b in own:
                if name[a] != name[b] and near & own[b]:
                    name[a] = name[b] = min(name[a], name[b])
                    changed = True
    return {doc: (name[doc], sum(len(linked[x]) - 1 for x in own[doc])) for doc in own}


def test_classes_and_links(spark):
    base = [f"k{k}" for k in range(40)]
    near = lambda *at: " ".join(f"z{k}" if k in at else w for k, w in enumerate(base))
    few = [(1, near()), (2, near(3)), (3, near(3, 7))]  # mutually similar; the nearest of the last is not the first
    assert {r.doc_id: (r.class_id, r.n_links) for r in L.line_decisions(spark.createDataFrame(few, "doc_id long, text string")).collect()} == {1: (1, 2), 2: (1, 2), 3: (1, 2)}

    rng = random.Random(5)
    family = [(3000 + k, near(*rng.sample(range(40), rng.choice([0, 1, 2, 4])))) for k in range(25)]  # more partners than NEAREST
    rows = corpus(4, 40)
    rows = [(d, "\n".join(x for x in t.split("\n") if len(words(x)) > 3)) for d, t in rows] + family + [(5000, ""), (5001, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_classes(rows)
    assert len({c for c, _ in want.values()}) > 4 and max(n for _, n in want.values()) > 2 * L.NEAREST
    for options in ({}, {"nearest": 1}):
        assert {r.doc_id: (r.class_id, r.n_links) for r in L.line_decisions(df, **options).collect()} == want
    lone = spark.createDataFrame([(None, "a b c d e"), (None, "q r s t u"), (7, "a b c d e"), (None, "v")], "doc_id long, text string")
    assert sorted(((r.doc_id or 0, r.class_id or 0) for r in L.line_decisions(lone).collect())) == [(0, 0), (0, 0), (0, 7), (7, 7)]


def test_unsettled_lines_are_joined_with_all_partners(spark, monkeypatch):
    """With a sketch that tells nothing apart, the nearest partners are often wrong ones."""
    monkeypatch.setattr(L, "sketches", lambda sets: (np.zeros(len(sets.begin), np.uint64),) * 2)
    monkeypatch.setattr(L, "LONG", 1 << 30)
    rows = corpus(8, 90)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.removed for r in L.line_decisions(df, nearest=1).collect()}
    assert [got[d] for d, _ in rows] == brute(rows)


def test_repeated_and_missing_ids(spark):
    rows = [(1, "a b c d e\nx"), (1, "a b c d e\nx"), (1, "q\nq"), (None, "a b c d f e"), (2, "q")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id or -1, r.n_lines, r.removed) for r in L.line_decisions(df).collect())
    assert got == [(-1, 1, []), (1, 2, [0]), (1, 2, [0]), (1, 2, [1]), (2, 1, [0])]
    assert L.line_decisions(df.limit(0)).count() == 0
    assert L.without_lines(df.limit(0)).count() == 0


def test_line_numbers_and_sets():
    texts = pa.array(["a b\n\nB a b\nc", None, "", "\nz", "A"])
    found = []
    for part in slices(texts, limit=3):
        sets = L.LineSets(part)
        found += [(part.first + d, k, n) for d, k, n in zip(sets.doc.tolist(), sets.line_no.tolist(), sets.size.tolist())]
    assert found == [(0, 0, 2), (0, 2, 2), (0, 3, 1), (3, 1, 1), (4, 0, 1)]
    whole = next(slices(texts))
    assert len(set(L.LineSets(whole).sig.tolist())) == 4


def test_prefix_lengths_leave_no_pair_out():
    for percent in (60, 80, 90):
        for n in range(1, 200):
            for m in range(-(-n * percent // 100), n + 1):
                need = -(-percent * (n + m) // (100 + percent))
                assert L.index_length(m, percent) >= m - need + 1
                assert L.probe_length(n, percent) >= n - need + 1


def test_long_lines(spark):
    rng = random.Random(6)
    base = [f"t{rng.randrange(4000)}" for _ in range(420)]
    rows = []
    for doc in range(14):
        line = list(base) if doc % 2 else [f"u{rng.randrange(3000)}" for _ in range(400)]
        for _ in range(rng.choice([0, 10, 30, 60, 90])):
            line[rng.randrange(len(line))] = f"v{rng.randrange(9000)}"
        rows.append((doc, " ".join(line)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.removed for r in L.line_decisions(df).collect()}
    assert [got[d] for d, _ in rows] == brute(rows)


@pytest.mark.parametrize("percent", [50, 60, 67, 75, 95, 100])
def test_short_lines_at_other_thresholds(spark, percent):
    rng = random.Random(percent)
    rows = [(k, "\n".join(" ".join(rng.choice("abcdef") for _ in range(rng.randrange(1, 6))) for _ in range(3))) for k in range(15)]
    rows += [(100, "p q r"), (101, "p q r s"), (102, "x y"), (103, "x y z"), (104, "u"), (105, "u v")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.removed for r in L.line_decisions(df, percent=percent).collect()}
    assert [got[doc] for doc, _ in rows] == brute(rows, percent)


def test_pairs_stay_inside_tasks(spark, monkeypatch):
    """A group of near copies gives a row a line, never its pairs, also when it is dealt over many blocks."""
    monkeypatch.setattr(L, "BLOCK_TOKENS", 400)
    monkeypatch.setattr(L, "CELLS_AT_ONCE", 500)
    rng = random.Random(9)
    rows = []
    for k in range(40):
        line = [f"k{j}" for j in range(40)]
        for at in rng.sample(range(40), rng.choice([1, 2, 4])):
            line[at] = f"z{at}{k % 5}"
        rows.append((k * 7 % 50, " ".join(line)))
    written = []
    stage = L.stage
    monkeypatch.setattr(L, "stage", lambda df: written.append(stage(df)) or written[-1])
    monkeypatch.setattr(L, "discard", lambda *staged: None)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.doc_id: r for r in L.line_decisions(df).collect()}
    assert [got[d].removed for d, _ in rows] == brute(rows)
    assert {d: (r.class_id, r.n_links) for d, r in got.items()} == brute_classes(rows)
    links = sum(r.n_links for r in got.values())
    assert links > 500 and max(t.count() for t in written) < links / 2
    assert any("split" in t.columns and t.where("split").count() for t in written)


def test_lines_are_ordered_by_all_bits():
    line, token = np.array([1, 0, 1, 1, 0]), np.array([5, 9, 3, 5, 2], np.uint64)
    for key in (token, np.zeros(5, np.uint64), token << np.uint64(40)):
        order = L.by_line(line, key, token)
        assert list(zip(line[order], token[order])) == sorted(zip(line, token))


def test_packed_lines_come_back():
    texts = pa.array([t for _, t in corpus(11, 50)] + ["", None, "one two\none two"])
    for part in slices(texts, limit=3000):
        sets = L.LineSets(part)
        doc = 90 - sets.doc
        keep = L.firsts_of(sets.sig, doc, sets.line_no) & (sets.size >= 4)
        [(back, heads)] = L.opened([L.packed_sets(sets, doc, keep)])
        want = [(sets.sig[k], doc[k], sets.line_no[k], sets.token[sets.begin[k] : sets.begin[k] + sets.size[k]].tolist()) for k in np.flatnonzero(keep)]
        assert [(back.sig[k], h["doc"], h["line"], back.token[back.begin[k] : back.begin[k] + h["n"]].tolist()) for k, h in enumerate(heads)] == want
        assert all(sorted(set(tokens)) == tokens for *_, tokens in want) and len({sig for sig, *_ in want}) == len(want)
    wide = np.zeros(5, dtype=L.STAR)
    wide["token"], wide["pos"] = np.arange(5) << 40, 3
    assert (L.unsqueezed(L.squeezed(wide), L.STAR) == wide).all() and len(L.unsqueezed(L.squeezed(wide[:0]), L.STAR)) == 0


def test_classes_read_the_texts_once(spark, monkeypatch):
    """Counts, postings and the words of family lines come from the lines parsed first."""
    for name in ("all_lines", "rarity", "postings", "line_tokens"):
        monkeypatch.setattr(L, name, lambda *args, **options: pytest.fail("parses the texts again"))
    parsed = []
    whole = L.prepared
    monkeypatch.setattr(L, "parsed_lines", lambda docs, percent, f=getattr(L, "parsed_lines", None): parsed.append(1) or f(docs, percent))
    rows = [(1, "a b c d e f\nx y"), (2, "a b c d e f g"), (3, "p q r s")]
    removed, linked = L.linked_lines(whole(spark.createDataFrame(rows, "doc_id long, text string")))
    assert [(r.id, r.line_no, r.first_doc) for r in removed.collect()] == [(2, 0, 1)]
    assert sorted((r.id, r.class_id, r.n_links) for r in linked.collect()) == [(1, 1, 1), (2, 1, 1)] and parsed == [1]
