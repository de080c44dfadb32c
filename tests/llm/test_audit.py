import random
import re
from itertools import permutations

from cohortlens.llm import audit


def brute(docs, labels):
    """Walks every order over every document."""
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, t in labels if t == 1 and d is not None}
    rows = []
    for doc_id, text, lang in docs:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = {
            "A": len(words) < 200,
            "B": 100 * len(set(words)) < 50 * len(words),
            "C": 100 * len(re.findall("[A-Z]", text)) > 3 * len(text),
            "D": re.search(r"[#$%&*|]", text) is not None,
            "E": any(doc_id is not None and o is not None and o < doc_id and (t or "") == text for o, t, _ in docs),
        }
        rows.append((lang or "", {k for k, v in fails.items() if v}, doc_id in good, doc_id in toxic))
    out = {}
    for part in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == part]
        for order in map("".join, permutations("ABCDE")):
            alive = own
            for step, letter in enumerate(order, 1):
                hit = [r for r in alive if letter in r[1]]
                alive = [r for r in alive if letter not in r[1]]
                out[part, order, step] = [
                    len(alive), len(hit), sum(letter in r[1] for r in own) - len(hit), sum(r[1] == {letter} for r in own),
                    sum(r[2] for r in hit), sum(r[3] for r in hit),
                ]
        for letter in "ABCDE":
            steps = [v for (p, order, step), v in out.items() if p == part and order[step - 1] == letter]
            share = sum(v[1] for v in steps)
            for v in steps:
                v.append(share)
    return out


def found(result):
    return {(r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley] for r in result.collect()}


def test_equals_walking_every_order(spark):
    rng = random.Random(4)
    texts = [
        None, "", " \t\n", "A B # |", " ".join(f"w{k}" for k in range(200)), " ".join(f"w{k}" for k in range(199)), "same " * 400,
        " ".join(f"w{k % 120}" for k in range(240)), " ".join(f"w{k % 119}" for k in range(240)), "X" * 3 + "y" * 97, "X" * 4 + "y" * 96,
        "ÄÖÜ é\x0b\x0cx" * 90, "Word WORD $ " * 300, "word joined " * 250, " ".join(f"Big{k}" for k in range(300)),
    ]
    docs = [(None if k % 19 == 0 else rng.randrange(60), rng.choice(texts), rng.choice([None, "", "en", "de"])) for k in range(150)]
    labels = [(k, rng.randrange(2), rng.randrange(2)) for k in range(0, 60, 2)] + [(4, None, 1), (None, 1, 1)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, lang string").selectExpr("*", "1 AS bits", "'x' AS hash", "2 AS n", "3 AS `a.b`")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").selectExpr("*", "'y' AS part", "1 AS bits", "2 AS n")
    result = audit.interactions(audit.combinations(audit.failing(frame), marks))
    assert found(result) == brute(docs, labels)


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "text", "en")], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert audit.interactions(audit.combinations(audit.failing(docs.limit(0)), labels)).count() == 0
    assert found(audit.interactions(audit.combinations(audit.failing(docs), labels))) == brute([(1, "text", "en")], [])


def test_a_group_of_copies_meets_one_row(spark):
    docs = spark.range(3000).selectExpr("id", "if(id % 3 = 0, 'copy', cast(id AS string)) AS text")
    assert {r.id for r in audit.repeated(docs).collect()} == set(range(3, 3000, 3))
