import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from scholium.llm import recompression as R


def brute(rows, window=20):
    words = [re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode()) for _, t in rows]
    first = {}
    key = lambda i: -(2**63) if rows[i][0] is None else rows[i][0]
    for i, w in enumerate(words):
        for s in range(len(w) - window + 1):
            k = tuple(w[s : s + window])
            first[k] = min(first.get(k, (2**64, 0)), (key(i), s))
    out = []
    for i, w in enumerate(words):
        gone = [False] * len(w)
        for s in range(len(w) - window + 1):
            if first[tuple(w[s : s + window])] < (key(i), s):
                gone[s : s + window] = [True] * window
        kept = [x for x, g in zip(w, gone) if not g]
        out.append((rows[i][0], len(w), sum(gone), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return out


def corpus(seed=1):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(40)] + ["é", "ß", "日本", "The"]
    pas = [" ".join(rng.choices(vocab, k=k)) for k in (19, 20, 21, 25, 60, 60, 200)]
    rows = []
    for _ in range(120):
        parts = []
        for _ in range(rng.randint(0, 6)):
            parts.append(rng.choice(pas) if rng.random() < 0.4 else " ".join(rng.choices(vocab, k=rng.randint(1, 70))))
        rows.append("\n".join(parts))
    rows += [rows[3], rows[3], rows[5] + " tail", "x " * 60, "x " * 25, "a b " * 40, None, "", "\t \n", " ".join(pas[6].split()[30:49])]
    ids = list(range(len(rows)))
    rng.shuffle(ids)
    return list(zip([i * 2 for i in ids], rows))


def test_matches_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame([(i, t, "s", 3, None) for i, t in rows], "doc_id long, text string, id string, pos int, seen int").repartition(5)
    got = R.repeat_digests(df).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, brute(rows)))
    cut = R.remove_repeats(df, length_col=None)
    assert cut.columns == df.columns
    want = {i: (removed, n, sha) for i, n, removed, sha in brute(rows)}
    left = {r.doc_id: r.text for r in cut.collect()}
    assert set(left) == {i for i, (removed, n, _) in want.items() if not removed or removed < n}
    text = dict(rows)
    for i, t in left.items():
        if want[i][0]:
            assert hashlib.sha256(t.encode()).hexdigest() == want[i][2]
        else:
            assert t == text[i]


def test_repeated_rows_and_null_ids(spark):
    rows = corpus(2)[:30]
    rows += [rows[4], rows[4], (rows[5][0], rows[6][1]), (None, rows[7][1]), (None, rows[7][1]), (None, rows[8][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = R.repeat_digests(df).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, brute(rows)))


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert R.repeat_digests(df).collect() == []
    assert R.remove_repeats(df).collect() == []


@pytest.mark.parametrize("seed", range(4))
def test_equal_windows_have_equal_certain_symbols(seed):
    rng = np.random.default_rng(seed)
    names = rng.integers(0, 6, 4000).astype(np.uint64)
    first = np.array([0, 700, 700, 2500, 4000])
    for at in (10, 900, 1800, 2600, 3900):
        names[at : at + 40] = names[100:140]
    p = R.parse(R.mix(names), first)
    by = {}
    for s in R.certain(p, 20, 1):
        for w in range(max(p.cb[s] - 20, 0), p.ca[s] + 1):
            if w + 20 <= first[p.doc[s] + 1]:
                by.setdefault(w, set()).add((int(p.a[s] - w), int(p.b[s] - w), int(p.name[s])))
    seen = {}
    for doc in range(4):
        for w in range(first[doc], first[doc + 1] - 19):
            k = names[w : w + 20].tobytes()
            assert seen.setdefault(k, by.get(w, set())) == by.get(w, set())


def _word(rng):
    return "".join(rng.choices("abcdefgh", k=3))


def test_null_ids_with_equal_32_bit_hashes(spark):
    """Rows of one id are told apart by 64 bits of hash: pairs of texts with equal F.hash() once got each other's windows."""
    rng = random.Random(4)
    texts = [" ".join(_word(rng) for _ in range(30)) for _ in range(300_000)]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    pairs = df.withColumn("h", F.hash("text")).groupBy("h").agg(F.collect_set("text").alias("t")).where(F.size("t") > 1).collect()
    assert pairs
    a, b = pairs[0].t[:2]
    # one of the two has a repeat at a place that the other doesn't have
    long = lambda t, n: " ".join([t] * n)
    rows = [(None, a), (None, b), (None, long(a, 3)), (None, long(b, 2)), (5, a), (6, long(b, 4)), (7, " ".join(texts[:2]))]
    for own in (rows, rows[:2], rows[:4]):
        got = R.repeat_digests(spark.createDataFrame(own, "doc_id long, text string")).collect()
        assert sorted(map(str, map(tuple, got))) == sorted(map(str, brute(own)))
        left = R.remove_repeats(spark.createDataFrame(own, "doc_id long, text string")).collect()
        want = [(n, gone) for _, n, gone, _ in brute(own)]
        assert len(left) == sum(not gone or gone < n for n, gone in want)


def test_one_id_and_text_in_a_third_of_the_rows(spark):
    rng = random.Random(5)
    text = lambda n: " ".join(rng.choices([f"v{i}" for i in range(60)], k=n))
    same = text(30)
    hot = [(None, f"{same} {same} x {same}"), (None, ""), (None, None)] * 300
    rows = [*hot, *((i, text(50) + (" " + same if i % 3 else "")) for i in range(900))]
    rng.shuffle(rows)
    df = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, salts int").repartition(8)
    got = R.repeat_digests(df).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, brute(rows)))
    keys = R._hot(df.select(F.coalesce("doc_id", F.lit(R._LOWEST)).alias("id"), F.xxhash64("text").alias("h"))).collect()
    assert len(keys) == 3 and min(r.salts for r in keys) > 50
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        tasks = R.with_repeats(df).where("id < 0").groupBy(F.spark_partition_id()).count().count()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert tasks == 4  # all of them hold rows of the three hot keys
