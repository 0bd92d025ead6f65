import re
from itertools import permutations

import numpy as np

from scholium.llm import filter_audit

COLUMNS = "part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley".split(", ")


def brute(docs, labels):
    """docs: (id, text, lang); every order goes through the documents one filter after another."""
    key = lambda i: -1 if i is None else i
    low = {}
    for i, t, _ in docs:
        low[t or ""] = min(key(i), low.get(t or "", key(i)))
    rows = []
    for i, t, lang in docs:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": key(i) > low[t]}
        own = [x for x in labels if x[0] == i and i is not None]
        rows.append((lang or "", fails, any(q == 1 for _, q, _ in own), any(x == 1 for _, _, x in own)))
    out = []
    for part in {r[0] for r in rows}:
        mine, lines = [r[1:] for r in rows if r[0] == part], []
        for order in permutations("ABCDE"):
            left = list(range(len(mine)))
            for step, f in enumerate(order, 1):
                gone = [x for x in left if mine[x][0][f]]
                before = len(mine) - len(left)
                redundant = sum(r[0][f] for k, r in enumerate(mine) if k not in left)
                assert before >= redundant
                left = [x for x in left if x not in gone]
                only = sum(r[0][f] and sum(r[0].values()) == 1 for r in mine)
                lines.append([part, "".join(order), step, len(left), len(gone), redundant, only, sum(mine[x][1] for x in gone), sum(mine[x][2] for x in gone), f])
        for line in lines:
            out.append((*line[:-1], sum(x[4] for x in lines if x[-1] == line[-1])))
    return sorted(out)


def run(spark, docs, labels):
    d = spark.createDataFrame([(*r, 1, "m") for r in docs], "doc_id long, text string, lang string, n long, mask string")
    found = filter_audit.audit(filter_audit.failure_counts(d, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")))
    assert found.columns == COLUMNS
    return sorted(map(tuple, found.collect()))


def made(n, seed=3):
    rng = np.random.default_rng(seed)
    words = [f"w{i}" for i in range(150)]
    docs = []
    for i in range(n):
        w = [words[k] for k in rng.choice(150, rng.choice([3, 99, 100, 140]), replace=bool(rng.integers(2)))]
        if rng.random() < 0.3:
            w = [x.upper() + "ABC" for x in w]
        if rng.random() < 0.3:
            w[0] = "a" + "#$%&*|"[rng.integers(6)]
        docs.append((i, " ".join(w), [None, "en", "de", ""][rng.integers(4)]))
    return docs


def test_brute_force(spark):
    docs = made(60)
    docs += [(100 + i, docs[4][1], "en") for i in range(20)] + [(200, docs[4][1], "de"), (4, docs[4][1], docs[4][2]), (4, docs[4][1], "fr")]  # many copies, one id twice
    docs += [(300, None, "en"), (301, "", None), (302, "\n\t ", "en"), (None, docs[7][1], "en"), (None, None, None), (303, "é" * 90 + "A" * 10, "en"), (304, "é" * 89 + "A" * 10, "en"), (305, "x\x0by\x0cz ", "en")]
    labels = [(i, i % 2, int(i % 5 == 0)) for i in range(0, 120, 2)] + [(1, None, 1), (1, 1, None), (2, 0, 0), (2, 1, 1), (None, 1, 1), (9999, 1, 1)]
    assert run(spark, docs, labels) == brute(docs, labels)


def test_empty(spark):
    assert run(spark, [], []) == []
    assert run(spark, made(5), []) == brute(made(5), [])


def test_long_text(spark):
    docs = [(1, "word " * 500_000, "en"), (2, "Ab" * 300_000, "en")]
    assert run(spark, docs, []) == brute(docs, [])


def test_steps_are_the_min_plus_product():
    rng = np.random.default_rng(0)
    masks = rng.random((20, 4)) < 0.4
    positions = np.argsort(np.array(list(permutations(range(4)))), axis=1)
    want = [[min([p[f] for f in range(4) if m[f]], default=4) for p in positions] for m in masks]
    assert filter_audit.removal_steps(masks, positions).tolist() == want
