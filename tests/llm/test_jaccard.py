import random
import re

import numpy as np
import pytest

from cohortlens.llm import jaccard as j
from cohortlens.llm.graph import components


def shingles(text, size=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return set()
    return {tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))}


def brute(rows, percent=90, size=3):
    sets = [shingles(t, size) for _, t in rows]
    up = list(range(len(rows)))

    def root(k):
        while up[k] != k:
            k = up[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            union = len(sets[a] | sets[b])
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * union:
                up[root(a)] = root(b)
    name = {}
    for k, (doc, _) in enumerate(rows):
        r = root(k)
        name[r] = min(name.get(r, doc), doc)
    return sorted((doc, len(sets[k]), name[root(k)]) for k, (doc, _) in enumerate(rows))


def corpus(seed):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(400)]
    rows = []
    for family in range(25):
        base = [rng.choice(words) for _ in range(rng.choice([1, 2, 3, 8, 12, 25, 60, 150, 400]))]
        for _ in range(rng.choice([1, 2, 3, 12])):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 4])):
                at = rng.randrange(len(copy))
                copy[at : at + rng.choice([0, 1])] = [rng.choice(words).upper()]
            rows.append((len(rows) * 3 % 1009, rng.choice([" ", "\n", " \t"]).join(copy)))
    passage = " ".join(words[:120])
    rows += [(2000 + k, passage + " " + " ".join(rng.choice(words) for _ in range(rng.randrange(3, 30)))) for k in range(20)]
    return rows + [(3000, ""), (3001, None), (3002, " \n"), (3003, "same"), (3004, "SAME")]


@pytest.mark.parametrize("seed,entries,size,percent", [(1, j.BLOCK_ENTRIES, 3, 90), (2, 300, 3, 90), (3, 300, 5, 80), (4, j.BLOCK_ENTRIES, 2, 60), (5, 300, 1, 100)])
def test_components_equal_brute_force(spark, seed, entries, size, percent):
    rows = corpus(seed)
    df = spark.createDataFrame([(d, t, "k") for d, t in rows], "doc_id long, text string, lead string")
    out = j.jaccard_components(df, size, percent, block_entries=entries).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in out) == brute(rows, percent, size)


def test_repeated_rows_and_empty_table(spark):
    rows = [(1, "a b c d"), (1, "a b c d"), (1, "e f g h"), (None, "a b c d"), (5, "A b c D")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = sorted((r.doc_id or -1, r.component_id, r.n_equal) for r in j.jaccard_components(df).collect())
    assert out == [(-1, 1, 4), (1, 1, 1), (1, 1, 4), (1, 1, 4), (5, 1, 4)]
    assert j.jaccard_components(df.limit(0)).count() == 0


def test_size_classes_leave_no_pair_out():
    for percent in (80, 90, 95):
        levels = j.Levels(percent)
        for n in range(1, 3000):
            low = -(-n * percent // 100)
            assert levels.of(n) - levels.of(low) <= 1
            differ = (100 - percent) * (n + low) // (100 + percent)
            count, spare = levels.blocks(levels.of(low))
            assert differ == 0 or count - differ >= spare + 1


@pytest.mark.parametrize("slots", ["counted", "one", "few"])
def test_lead_columns_leave_no_pair_out(slots):
    """Linked sets have a lead column in common, however the columns share slots."""
    rng = np.random.default_rng(7)
    pool = np.unique(rng.integers(0, 1 << 63, 3000, dtype=np.uint64))
    met = 0
    for percent in (50, 80, 90, 95, 100):
        for _ in range(100):
            base = rng.choice(pool, rng.integers(1, 120), replace=False)
            gone = rng.integers(0, 1 + len(base) * (100 - percent) // 100)
            more = rng.integers(0, 1 + len(base) * (100 - percent) // 100)
            a, b = np.unique(base), np.unique(np.concatenate([base[gone:], rng.choice(pool, more)]))
            counts = np.full(1 << j.SLOT_BITS, 2, dtype=np.int32) if slots == "one" else np.zeros(1 << j.SLOT_BITS, dtype=np.int32)
            if slots != "one":
                for part in (a, b):
                    np.add.at(counts, j.slot_of(part), 1)
            if slots == "few":
                counts += np.arange(len(counts), dtype=np.int32) % 3
            if len(b) and 100 * len(np.intersect1d(a, b)) >= percent * len(np.union1d(a, b)) and len(np.union1d(a, b)) > min(len(a), len(b)):
                met += 1
                assert len(np.intersect1d(j.lead_columns(a, counts, percent), j.lead_columns(b, counts, percent)))
    assert met > 80


def test_product_links_connect_what_brute_force_connects():
    rng = np.random.default_rng(4)
    for _ in range(20):
        base = np.unique(rng.integers(0, 400, 60))
        rows = [np.unique(np.concatenate([base[rng.random(len(base)) > 0.06], rng.integers(400, 900, rng.integers(0, 4))])) for _ in range(30)]
        rows += [np.unique(rng.integers(0, 400, rng.integers(1, 90))) for _ in range(10)]
        links = {(a, b) for a in range(len(rows)) for b in range(a) if 100 * len(np.intersect1d(rows[a], rows[b])) >= 90 * len(np.union1d(rows[a], rows[b]))}
        found = j.product_links(rows, 90, column_block=7)
        assert {(max(p), min(p)) for p in found} <= links

        def groups(pairs):
            forest = j.Forest(len(rows))
            for a, b in pairs:
                forest.join(a, b)
            return [forest.root(k) for k in range(len(rows))]

        assert groups(found) == groups(links)
        assert len(found) <= len(rows) - 1


def test_components_of_paths_stars_and_loops(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, 100 + k) for k in range(1, 30)] + [(7, 7), (200, 201), (201, 200), (None, 3)]
    rng = random.Random(1)
    rng.shuffle(edges)
    label = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {label[k] for k in range(41)} == {0}
    assert {label[k] for k in range(100, 130)} == {100}
    assert label[200] == label[201] == 200
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_linked_sets_share_as_many_lead_columns_as_are_asked():
    rng = np.random.default_rng(11)
    pool = np.unique(rng.integers(0, 1 << 63, 2000, dtype=np.uint64))
    met = 0
    for percent in (50, 60, 80, 90):
        shared = j.shared_leads(percent)
        for _ in range(150):
            base = rng.choice(pool, rng.integers(1, 60), replace=False)
            gone = rng.integers(0, 1 + len(base) * (100 - percent) // 100)
            a, b = np.unique(base), np.unique(np.concatenate([base[gone:], rng.choice(pool, rng.integers(0, 4))]))
            counts = rng.integers(2, 5, 1 << j.SLOT_BITS).astype(np.int32)
            both = np.intersect1d(a, b)
            if len(b) and 100 * len(both) >= percent * len(np.union1d(a, b)) and len(np.union1d(a, b)) > min(len(a), len(b)):
                met += 1
                assert len(np.intersect1d(j.lead_columns(a, counts, percent), j.lead_columns(b, counts, percent))) >= shared
    assert met > 100 and [j.shared_leads(p) for p in (50, 60, 80, 90, 100)] == [1, 2, 4, 4, 1]


def test_rows_that_meet_by_chance_are_no_family(spark, monkeypatch):
    """Each text shares one five-word passage with the next one; only the last two are near copies."""
    texts = [[f"p{k}_{w}" for w in range(5)] + [f"t{k}_{w}" for w in range(30)] + [f"p{k + 1}_{w}" for w in range(5)] for k in range(30)]
    texts.append([*texts[-1][:-1], "other"])
    met, links = [], j.family_links
    monkeypatch.setattr(j, "family_links", lambda sets, percent: met.append(sets.count()) or links(sets, percent))
    df = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)], "doc_id long, text string")
    out = {r.doc_id: r.component_id for r in j.jaccard_components(df, 5, 80).collect()}
    assert out == {k: min(k, 29) for k in range(31)} and met == [2]


def test_columns_of_many_rows_connect_them_without_pairs(spark):
    rows = [(sig, lead) for sig in range(j.FEW + 4) for lead in (1,)] + [(s, lead) for s in (100, 101, 102) for lead in (2, 3, 4)] + [(200, 2), (200, 2), (300, 9)]
    df = spark.createDataFrame(rows, "sig long, lead long")
    found = {r.node: r.label for r in j.lead_families(df, 3).collect()}
    assert found == {**{s: 0 for s in range(j.FEW + 4)}, 100: 100, 101: 100, 102: 100}
