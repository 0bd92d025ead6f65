import hashlib
import random

import numpy as np
import xxhash

from scholium.llm import chunk_fingerprint as C


def slow_chunks(b):
    out, s = [], 0
    while s < len(b):
        cut = min(len(b), s + C.GREATEST)
        h = 0
        for i in range(s, min(len(b), s + C.GREATEST - 1)):
            h = ((h << 1) + int(C._GEAR[b[i]])) & 0xFFFF
            n = i + 1 - s
            if n >= C.LEAST and h & (C.STRICT if n < C.NORMAL else C.LOOSE) == 0:
                cut = i + 1
                break
        out.append(b[s:cut])
        s = cut
    return out


def corpus():
    rng = random.Random(8)
    vocab = ["alpha", "bêta", "gamma", "日本", "x", "delta-epsilon", "\n"]
    rows = [(i * 2, " ".join(rng.choices(vocab, k=rng.randint(0, 300)))) for i in range(120)]
    return rows + [(1001, None), (1003, ""), (1005, "a" * 5000), (1007, "ab"), (1009, rows[3][1])]


def like(a, b):
    a, b = ({hashlib.md5(c).digest(): len(c) for c in slow_chunks(x)} for x in (a, b))
    big = max(sum(a.values()), sum(b.values()))
    return sum(n for h, n in a.items() if h in b) / big if big else 1.0


def brute(rows):
    rows = sorted(((-(2**63) if i is None else i, t or "") for i, t in rows), key=lambda r: (r[0], xxhash.xxh64_intdigest(r[1].encode(), 42) % 2**31))
    out = []
    for j, (i, t) in enumerate(rows):
        nxt = rows[(j + 1) % len(rows)][1]
        k = len(t) // 4
        e = t[: len(t) - k] + nxt[:k]
        out.append((None if i == -(2**63) else i, len(t), hashlib.sha256(e.encode()).hexdigest(), round(like(t.encode(), e.encode()), 9), round(like(t.encode(), nxt.encode()), 9)))
    return out


def test_boundaries():
    rng = random.Random(1)
    texts = [bytes(rng.choices(b"abcdefgh \n", k=rng.choice([0, 1, 15, 16, 17, 300, 2000]))) for _ in range(60)] + [b"a" * 1000, b""]
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    ends, counts = C.boundaries(np.frombuffer(b"".join(texts), np.uint8), offsets)
    at = 0
    for t, o, n in zip(texts, offsets, counts):
        want = np.cumsum([len(c) for c in slow_chunks(t)]) if t else np.zeros(0)
        assert (ends[at : at + n] - o).tolist() == want.tolist()
        at += n


def test_matches_brute_force(spark):
    rows = corpus()
    rows += [rows[5], (rows[6][0], "same id, other text"), (None, "no id"), *((1009, f"one of many of this id, {i}") for i in range(40))]
    df = spark.createDataFrame([(i, t, 1, "z") for i, t in rows], "doc_id long, text string, key int, part string").repartition(4)
    for part_bytes in (1 << 20, 9000):
        got = C.with_edited(df, part_bytes=part_bytes).collect()
        assert sorted(map(str, ((r.id, r.n_chars, r.edited_sha256, round(r.near_edited, 9), round(r.near_next, 9)) for r in got))) == sorted(map(str, brute(rows)))
    prints = {}
    text = dict(rows[:-43])
    for r in C.fingerprints(df).collect():
        if r.id in text and r.id not in (rows[5][0], rows[6][0], 1009):
            prints.setdefault(text[r.id] or "", set()).add(r.fingerprint)
    assert all(len(p) == 1 for p in prints.values()) and prints[""] == {""}


def test_edges(spark):
    df = spark.createDataFrame([(1, "only one document here, wrapped around")], "doc_id long, text string")
    r = C.with_edited(df).collect()[0]
    assert r.near_next == 1.0 and 0 <= r.near_edited < 1
    assert C.with_edited(df.limit(0)).collect() == []
