import hashlib
import random
import re

import numpy as np

from scholium.llm import fm_index as M

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))


def brute(docs, items):
    out = []
    wins = {}
    for i, t in items:
        w = words(t)
        m = min(10, len(w))
        for s in range(len(w) - m + 1) if w else []:
            wins.setdefault(tuple(w[s : s + m]), set()).add(i)
    sizes = sorted({len(k) for k in wins})
    for d, t in docs:
        w = words(t)
        hit, found = [False] * len(w), set()
        for m in sizes:
            for s in range(len(w) - m + 1):
                if (k := tuple(w[s : s + m])) in wins:
                    hit[s : s + m] = [True] * m
                    found |= {str(i) for i in wins[k] if i is not None}
        out.append((d, len(w), sum(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), any(hit)))
    return out


def corpus():
    rng = random.Random(4)
    vocab = [f"w{i}" for i in range(30)] + ["été", "Ünï", "THE", "a1"]
    text = lambda n: " ".join(rng.choice(vocab) + rng.choice(["", "", ",", ".", "\n", "—"]) for _ in range(n))
    items = [(i, text(rng.choice([3, 9, 10, 11, 25, 40]))) for i in range(30)]
    items += [(30, None), (31, ""), (32, "..."), (33, items[4][1]), (None, text(12)), (3, text(15))]
    docs = []
    for d in range(150):
        parts = [text(rng.randint(0, 50))]
        for _ in range(rng.randint(0, 3)):
            t = (rng.choice(items)[1] or "").split()
            k = rng.randint(0, max(0, len(t) - 8))
            parts += [" ".join(t[k : k + rng.randint(5, 30)]).upper(), text(rng.randint(0, 20))]
        docs.append((d, " ".join(parts)))
    return docs + [(900, None), (901, ""), (902, "w1"), docs[7], (None, docs[8][1]), (903, " ".join(items[5][1] for _ in range(40)))], items


def test_matches_brute_force(spark, monkeypatch):
    docs, items = corpus()
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in docs], "doc_id long, text string, item_id string, id int").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = brute(docs, items)
    assert sorted(map(str, map(tuple, M.contamination(df, bench).collect()))) == sorted(map(str, want))
    clean = M.decontaminate(df, bench)
    assert clean.columns == df.columns
    hits = {d: h for d, _, h, *_ in want}
    counts = {d: n for d, n, *_ in want}
    for r in clean.collect():
        assert len(words(r.text)) == counts[r.doc_id] - hits[r.doc_id]
    again = dict(zip([r.doc_id for r in clean.collect()], [r.text for r in clean.collect()]))
    assert all(again[d] == t for d, t in docs if not hits[d])
    real = M.n_blocks
    monkeypatch.setattr(M, "n_blocks", lambda b: real(b, block_bytes=400))
    assert M.n_blocks(bench) > 3
    assert sorted(map(str, map(tuple, M.contamination(df, bench).collect()))) == sorted(map(str, want))


def test_many_blocks_in_one_pass(spark, monkeypatch, tmp_path):
    """Some 64 blocks, null ids in several of them: the texts are read once and no copy of them is stored."""
    docs, items = corpus()
    spark.createDataFrame([(d, t) for d, t in docs], "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/docs")
    items = items + [(None, " ".join(items[k][1].split()[:12])) for k in (5, 6, 7, 9)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    real = M.n_blocks
    monkeypatch.setattr(M, "n_blocks", lambda b: real(b, block_bytes=25))
    monkeypatch.setattr(M, "GROUP_BYTES", 2_000)
    assert M.n_blocks(bench.distinct()) > 60
    df = spark.read.parquet(f"{tmp_path}/docs")
    for made in (M.contamination(df, bench), M.decontaminate(df, bench)):
        plan = made._jdf.queryExecution().executedPlan().toString()
        assert plan.count("FileScan") == plan.count("MapInArrow") == 1 and f"{tmp_path}/docs" in plan
    assert sorted(map(str, map(tuple, M.contamination(df, bench).collect()))) == sorted(map(str, brute(docs, items)))


def test_empty_tables(spark):
    docs, items = corpus()
    df = spark.createDataFrame(docs, "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert not any(r.contaminated for r in M.contamination(df, none).collect())
    assert M.contamination(df.limit(0), none).collect() == []


def test_index_counts_and_places():
    rng = np.random.default_rng(2)
    for n in (1, 2, 50, 400):
        body = rng.integers(1, 5, n)
        body[n // 2 :] = body[: n - n // 2]
        text = np.append(body, 0)
        index = M.FMIndex(text, sample=4)
        s = M.suffix_array(text)
        assert s.tolist() == sorted(range(n + 1), key=lambda i: text[i:].tolist())
        phrases = rng.integers(1, 6, (60, 3))
        lengths = rng.integers(1, 4, 60)
        low, high = index.search(phrases, lengths)
        for p, m, a, b in zip(phrases, lengths, low, high):
            want = [i for i in range(n - m + 1) if (text[i : i + m] == p[:m]).all()]
            assert sorted(index.locate(np.arange(a, b)).tolist()) == want
