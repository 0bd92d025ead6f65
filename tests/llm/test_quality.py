import os
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from scholium.llm import quality, queries

SF = "/root/testdata/sf0.01"


def stats(*texts):
    raw = [t.encode() for t in texts]
    return quality.statistics(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64))


TEXTS = ["", "a", " \n\t", "One two, two. three\nTWO two!!\n\n| 12 | x9 |", "ÉTÉ été ÇA $$$ &&& été ÇA $$$ &&& 東京 １２", "x" * 3000 + " y", "word " * 5000, "\n\n", "Ab. " * 7 + "\n- item\n- item\n"]


def test_statistics_by_brute_force():
    got = stats(*TEXTS)
    for row, t in zip(got, TEXTS):
        x = dict(zip(quality.STATISTICS, row))
        w, lines = re.findall(r"\S+", t), [s for s in t.split("\n") if s]
        nw, nl, nc = max(1, len(w)), max(1, len(lines)), max(1, len(t))
        other = [c for c in t if not c.isalpha() and not c.isnumeric() and not c.isspace()]
        pairs, fives = (Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) for k in (2, 5))
        again = lambda c: (c.total() - len(c)) / max(1, c.total())
        want = {
            "log_characters": np.log1p(len(t)), "log_words": np.log1p(len(w)), "log_lines": np.log1p(len(lines)), "word_length": sum(map(len, w)) / nw, "word_length_spread": np.std([len(v) for v in w]) if w else 0, "longest_word": max(map(len, w), default=0),
            "letters": sum(c.isalpha() for c in t) / nc, "spaces": sum(c.isspace() for c in t) / nc, "others": len(other) / nc, "capitals": sum(c.isupper() for c in t) / max(1, sum(c.isalpha() for c in t)),
            "commonest_other": max(Counter(other).values(), default=0) / nc, "distinct_words": len(set(w)) / nw, "commonest_word": max(Counter(w).values(), default=0) / nw, "distinct_lines": len(set(lines)) / nl,
            "repeated_pairs": again(pairs), "repeated_fives": again(fives), "symbols_run": sum(a == b and a in other for a, b in zip(t, t[1:])) / nc, "words_short": sum(len(v) <= 2 for v in w) / nw,
            "words_all_capitals": sum(sum(c.isalpha() for c in v) > 1 and all(c.isupper() for c in v if c.isalpha()) for v in w) / nw, "words_without_letter": sum(not any(c.isalpha() for c in v) for v in w) / nw,
            "words_end_repeated": sum(len(v) > 1 and v[-1] == v[-2] for v in w) / nw, "lines_end_stop": sum(s[-1] in ".!?" for s in lines) / nl, "lines_short": sum(len(s) < 20 for s in lines) / nl,
        }
        for k, v in want.items():
            assert x[k] == pytest.approx(v, abs=1e-9), (k, t[:40])


def test_statistics_do_not_depend_on_neighbours():
    assert np.array_equal(stats(*TEXTS), np.concatenate([stats(t) for t in TEXTS]))
    assert not np.any(stats("")) and stats().shape == (0, len(quality.STATISTICS))


def walk(t, x, root):
    at = root
    while t.feature[at] >= 0:
        at = t.left[at] if x[t.feature[at]] <= t.threshold[at] else t.right[at]
    return t.value[at]


def test_traversal_and_first_split():
    rng = np.random.default_rng(5)
    x = np.round(rng.normal(size=(600, 4)), 1)
    y = ((x[:, 1] > 0.3) ^ (x[:, 2] > 1)).astype(float)
    t = quality.boost(x, y, trees=15)
    want = [1 / (1 + np.exp(-sum(walk(t, r, root) for root in t.roots))) for r in x]
    assert t.score(x) == pytest.approx(want, abs=1e-12)
    assert ((t.score(x) >= 0.5) == y).mean() > 0.97
    # the first split by trying every threshold of every statistic
    w = np.where(y == 1, 0.5 / y.sum(), 0.5 / (1 - y).sum()) * len(y)
    g, h = w * (0.5 - y), w * 0.25
    part = lambda m: g[m].sum() ** 2 / (h[m].sum() + quality.RIDGE)
    tried = [(part(m) + part(~m), j, v) for j in range(4) for v in np.unique(x[:, j]) if min((m := x[:, j] <= v).sum(), (~m).sum()) >= quality.LEAST_ROWS]
    _, j, v = max(tried)
    assert t.feature[0] == j and np.array_equal(x[:, j] <= t.threshold[0], x[:, j] <= v)


def frames(spark, docs, labels):
    d = spark.createDataFrame([(*r, 0.1, "k") for r in docs], "doc_id long, text string, score double, key string")
    return d, spark.createDataFrame(labels, "doc_id long, quality int, y int")


def test_cases(spark):
    docs = [(i, ("fine words here, all of them. " if i % 2 else "$$$ ### BAD!! ") * (1 + i % 7)) for i in range(300)]
    odd = [(None, "fine words here."), (500, None), (501, ""), (501, ""), (502, "fine words here, all of them. " * 200_000)]
    d, known = frames(spark, docs + odd, [(i, i % 2, 1) for i in range(300)] + [(None, 1, 1), (5, None, 1), (7, 1, 1), (7, 0, 1)])
    got = sorted(map(tuple, quality.score(d, quality.fit(d, known)).collect()), key=str)
    assert len(got) == len(docs) + len(odd)
    by = {i: (s, p) for i, s, p in got}
    assert all(by[i][1] == i % 2 for i in range(300)) and by[500] == by[501] and by[502][1] == by[None][1] == 1
    assert all(0 <= s <= 1 and p == int(s >= 0.5) for _, s, p in got)


def test_without_labels(spark):
    d, known = frames(spark, [(1, "a"), (2, None)], [])
    assert sorted(map(tuple, quality.score(d, quality.fit(d, known)).collect())) == [(1, 0.5, 1), (2, 0.5, 1)]
    d, known = frames(spark, [], [(1, 1, 1)])
    assert quality.score(d, quality.fit(d, known)).collect() == []


@pytest.mark.skipif(not os.path.isdir(SF), reason="the provided tables aren't here")
def test_held_out_accuracy_of_the_query(spark):
    got = queries.QUERIES["op13_quality"](spark, SF)
    rows = {r.doc_id: r for r in got.collect()}
    assert got.columns[:4] == ["doc_id", "held_out", "score", "predicted"] and len(rows) == 1000
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in rows.items())
    held = [(rows[r.doc_id].predicted, r.quality) for r in spark.read.parquet(f"{SF}/labels.parquet").collect() if rows[r.doc_id].held_out]
    assert len(held) > 90 and np.mean([a == b for a, b in held]) >= 0.97
