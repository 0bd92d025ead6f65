import random
import zlib

import numpy as np

from scholium.llm import toxicity as T


def brute_segments(scores):
    """All maximal-scoring segments by definition: the best segment, then the same left and right of it."""
    best, at = 0.0, None
    n = len(scores)
    for i in range(n):
        s = 0.0
        for j in range(i, n):
            s += scores[j]
            if s > best + 1e-12:
                best, at = s, (i, j + 1)
    if at is None:
        return []
    i, j = at
    return [*brute_segments(scores[:i]), (i, j, best), *[(a + j, b + j, s) for a, b, s in brute_segments(scores[j:])]]


def test_segments():
    rng = np.random.default_rng(4)
    for _ in range(300):
        x = rng.normal(-0.2, 1, rng.integers(0, 25))
        got, want = T.segments(x), brute_segments(x.tolist())
        assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in want]
        assert np.allclose([s for *_, s in got], [s for *_, s in want])


def test_held_out(spark):
    rng = random.Random(5)
    vocab = ["".join(rng.choices("aeiorstnl", k=rng.randint(2, 8))) for _ in range(500)]
    bad = ["vileword", "nastything", "Awfulness", "horridly", "grimmest"]
    docs, labels = [], []
    for i in range(900):
        w = rng.choices(vocab, k=rng.randint(20, 150))
        toxic = i % 4 == 0
        if toxic:
            at = rng.randrange(len(w))
            for _ in range(5):
                w.insert(min(len(w), at + rng.randint(0, 8)), rng.choice(bad))
        docs.append((i, " ".join(w)))
        labels.append((i, int(toxic)))
    odd = [(5000, None), (5001, ""), (5002, "..."), (None, docs[0][1]), docs[1], (5003, docs[0][1] + " calm" * 20_000)]
    df = spark.createDataFrame([(*r, 9.0, "p") for r in docs + odd], "doc_id long, text string, score double, toxic string")
    lab = spark.createDataFrame(labels + [(None, 1), (3, None), (4, 1)], "doc_id long, toxic int")
    model = T.fit(df, lab)
    got = T.score(df, model).collect()
    assert len(got) == len(docs + odd)
    held = {i for i, _ in docs if zlib.crc32(str(i).encode()) % 3 == 1}
    y = dict(labels)
    pairs = [(r.score, r.predicted, y[r.id]) for r in got if r.id in held]
    assert all(p == (s >= 0.7) for s, p, _ in pairs)
    assert sum(p == t for _, p, t in pairs) >= 0.95 * len(pairs)
    low = min(r.score for r in got)
    by = {r.id: r for r in got}
    assert by[5000].score == by[5001].score == by[5002].score == low and not by[5000].passages
    assert all(0 <= r.score <= 1 for r in got)
    assert by[5003].passages and by[5003].passages[0].after < 400


def test_nothing_to_learn(spark):
    df = spark.createDataFrame([(1, "some text")], "doc_id long, text string")
    lab = spark.createDataFrame([], "doc_id long, toxic int")
    assert T.score(df, T.fit(df, lab)).collect()[0].predicted == 0
    assert T.score(df.limit(0), T.fit(df, lab)).collect() == []
