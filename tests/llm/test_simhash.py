import random
import re

import numpy as np
import xxhash

from scholium.llm import common, simhash
from scholium.llm.components import components


def brute_fp(text, k):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    sh = [b" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] if len(words) >= k else [b" ".join(words)] * bool(words)
    h = [xxhash.xxh64_intdigest(s, 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute(rows, k, bits=3):
    fps = [brute_fp(t, k) for _, t in rows]
    comp = list(range(len(rows)))
    changed = True
    while changed:
        changed = False
        for i in range(len(rows)):
            for j in range(len(rows)):
                if bin(fps[i] ^ fps[j]).count("1") <= bits and comp[j] < comp[i]:
                    comp[i] = comp[j]
                    changed = True
    out = []
    for i in range(len(rows)):
        ids = [rows[j][0] for j in range(len(rows)) if comp[j] == comp[i] and rows[j][0] is not None]
        out.append((rows[i][0], f"{fps[i]:016x}", min(ids) if ids else None))
    return out


def corpus():
    rng = random.Random(3)
    vocab = [f"w{i}é" if i % 7 == 0 else f"W{i}" for i in range(300)]
    base = [" ".join(rng.choices(vocab, k=rng.randint(60, 200))) for _ in range(25)]
    rows = []
    for t in base:
        rows.append(t)
        for _ in range(rng.randint(0, 4)):
            w = t.split()
            w[rng.randrange(len(w))] = "edited"
            rows.append("\t".join(w))
    rows += [None, "", "  \n", "one", "one two", "ONE two", "a b c", "a b c"]
    rows = [(i * 3 % 501, t) for i, t in enumerate(rows)]
    return rows + [rows[0], (None, rows[0][1]), (None, "only without an id here")]


def test_matches_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, fp string, component_id int")
    for k in (3, 5):
        got = simhash.near_duplicates(df, words_per_shingle=k).collect()
        assert sorted(map(str, map(tuple, got))) == sorted(map(str, brute(rows, k)))
    kept = simhash.drop_near_duplicates(df, words_per_shingle=3)
    assert kept.columns == df.columns
    assert {r.doc_id for r in kept.collect()} == {c for _, _, c in brute(rows, 3)}


def test_more_bits_and_longer_keys(spark, monkeypatch):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert [simhash.key_blocks(n) for n in (0, 10**5, 10**9, 10**12)] == [2, 2, 3, 4]
    for k in (1, 3):
        monkeypatch.setattr(simhash, "key_blocks", lambda n, b, k=k: k)
        got = simhash.near_duplicates(df, max_bits=5).collect()
        assert sorted(map(str, map(tuple, got))) == sorted(map(str, brute(rows, 5, 5)))


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(df).collect() == []


def test_buckets_and_hot_buckets(spark, monkeypatch):
    rng = np.random.default_rng(5)
    center = rng.integers(0, 2**64, 4, dtype=np.uint64)
    fps = {int(c) for c in center}
    for c in center:
        for _ in range(150):
            x = int(c)
            for b in rng.choice(64, rng.integers(1, 9), replace=False):
                x ^= 1 << int(b)
            fps.add(x)
    fp = np.array(sorted(fps), np.uint64)
    parent = list(range(len(fp)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(fp)):
        for j in np.flatnonzero(np.bitwise_count(fp ^ fp[i]) <= 3):
            a, b = sorted((find(i), find(int(j))))
            parent[b] = a
    want = {}
    for i in range(len(fp)):
        want.setdefault(find(i), set()).add(int(fp[i].view(np.int64)))
    want = {frozenset(x) for x in want.values() if len(x) > 1}
    df = spark.createDataFrame([(int(x),) for x in fp.view(np.int64)], "fp long")
    for hot in (50_000, 20):
        monkeypatch.setattr(simhash, "HOT_BUCKET", hot)
        monkeypatch.setattr(simhash, "CHUNK", 16 if hot == 20 else 8192)
        got = {}
        for r in components(simhash.links(df)).collect():
            got.setdefault(r.root, set()).add(r.node)
        assert {frozenset(x) for x in got.values()} == want


def test_components(spark):
    path = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 101), (7, 3), (200, 150)]
    got = {r.node: r.root for r in components(spark.createDataFrame(path, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100, 150: 150, 200: 150}
    assert components(spark.createDataFrame([], "u long, v long")).collect() == []


def brute_similar(rows, least=0.8):
    """(id, smallest id reached by links of Jaccard similarity of five-word shingle sets) of each row."""

    def shingles(t):
        w = (t or "").lower().split()
        return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])

    sets = [shingles(t) for _, t in rows]
    comp = list(range(len(rows)))
    linked = [(i, j) for i in range(len(rows)) for j in range(i) if sets[i] == sets[j] or len(sets[i] & sets[j]) >= least * len(sets[i] | sets[j])]
    changed = True
    while changed:
        changed = False
        for i, j in linked:
            if comp[i] != comp[j]:
                comp[i] = comp[j] = min(comp[i], comp[j])
                changed = True
    out = []
    for i, (d, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if comp[j] == comp[i] and rows[j][0] is not None]
        out.append((d, min(ids) if ids else None))
    return out


def test_verified_groups(spark, monkeypatch):
    rng = random.Random(8)
    rows = []
    for n in (60, 80, 120, 300):
        t = [f"w{rng.randrange(900)}" for _ in range(n)]
        for edits in (0, 0, 1, 2, 3, 4, 6, 8, 12, 20):
            w = list(t)
            for i in rng.sample(range(n), edits * n // 200 if n > 200 else edits // 4):
                w[i] = f"new{rng.randrange(900)}"
            rows.append(" ".join(w))
    rows += [None, "", "one", "one two", "ONE two"]
    rows = [(i * 7 % 501, t) for i, t in enumerate(rows)] + [(None, rows[3]), (None, "without an id")]

    want = brute_similar(rows)
    changed = [(i, c) for (i, _, c), w in zip(brute(rows, 5, 5), want) if (i, c) != w]
    assert changed  # 5 of 64 bits wouldn't do
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for piece, pieces, chunk in ((64, 8, 1024), (3, 8, 1024), (3, 1, 3)):
        monkeypatch.setattr(simhash, "GROUP_PIECE", piece)
        monkeypatch.setattr(simhash, "GROUP_PIECES", pieces)
        monkeypatch.setattr(simhash, "GROUP_CHUNK", chunk)
        got = simhash.verified_groups(df, 0.8).collect()
        assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    kept = simhash.drop_near_duplicates(df, least=0.8)
    assert {r.doc_id for r in kept.collect()} == {c for _, c in want}
    assert simhash.verified_groups(df.limit(0), 0.8).collect() == []


def grouped(nodes, edges):
    root = {x: x for x in nodes}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for u, v in edges:
        root[find(u)] = find(v)
    out = {}
    for x in nodes:
        out.setdefault(find(x), set()).add(x)
    return {frozenset(x) for x in out.values()}


def as_sets(spark, groups):
    """(root, set, shingles) of lists of shingle numbers; sets are numbered from 1."""
    rows, n = [], 0
    for root, sets in groups:
        for x in sets:
            n += 1
            rows.append((root, n, np.unique(simhash.mix(np.array(sorted(x), np.uint64))).tobytes()))
    return spark.createDataFrame(rows, "root long, set long, shingles binary")


def counted(monkeypatch):
    """How many sets each meeting deals."""
    out, met = [], simhash._met

    def count(cut, least):
        out.append(cut.count())
        return met(cut, least)

    monkeypatch.setattr(simhash, "_met", count)
    return out


def test_large_links_agree_with_brute_force(spark, monkeypatch):
    rng = random.Random(4)
    groups = []
    for root, (families, each, own) in enumerate([(1, 90, 4), (30, 3, 6), (60, 1, 12), (8, 10, 11), (2, 1, 0)]):
        template = [rng.randrange(10**9) for _ in range(80)]
        sets = []
        for _ in range(families):
            base = template + [rng.randrange(10**9) for _ in range(own)]
            for _ in range(each):  # similarities around 0.8, and sizes that differ
                sets.append(set(rng.sample(base, len(base) - rng.randint(0, 6))) | {rng.randrange(10**9) for _ in range(rng.randint(0, 14))})
        groups.append((root, sets + [set()] * (root == 1)))
    monkeypatch.setattr(simhash, "GROUP_CHUNK", 16)
    want = []
    for root, sets in groups:
        first = sum(len(s) for _, s in groups[:root]) + 1
        want += [(first + i, first + j) for i in range(len(sets)) for j in range(i) if sets[i] | sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    nodes = range(1, sum(len(s) for _, s in groups) + 1)
    expected = grouped(nodes, want)
    assert 20 < len(expected) < len(nodes) - 100  # some alone, some together
    for slots in (1 << 16, 4):  # shingles that clash in their counts change no link
        got = [(r.u, r.v) for r in simhash.large_links(as_sets(spark, groups), 0.8, slots).collect()]
        assert grouped(nodes, got) == expected
    assert simhash.large_links(as_sets(spark, groups).limit(0), 0.8).collect() == []


def test_large_groups_move_a_few_times_their_size(spark, monkeypatch):
    """20,000 near copies of a text in one group, and 8,000 texts that share only a template with each other."""
    rng = np.random.default_rng(6)
    base = list(range(100))
    copies = [set(base[:100]) - {int(i)} | {1000 + 3 * k, 1001 + 3 * k} for k, i in enumerate(rng.integers(0, 100, 20_000))]
    alone = [set(range(200, 260)) | set(range(10**6 + 40 * k, 10**6 + 40 * k + 40)) for k in range(8_000)]
    dealt = counted(monkeypatch)
    for sets, groups in ((copies, 1), (alone, 8_000)):
        dealt.clear()
        edges = [(r.u, r.v) for r in simhash.large_links(as_sets(spark, [(1, sets)]), 0.8).collect()]
        assert len(grouped(range(1, len(sets) + 1), edges)) == groups
        assert sum(dealt) <= 2 * len(sets)


def test_marks_grow_with_what_is_marked(spark):
    assert simhash.marks(0) == simhash.marks(1000) == 1 << 20 and simhash.marks(10**6) == 1 << 24 and simhash.marks(10**12) == 1 << 30
    rng = np.random.default_rng(2)
    h = rng.integers(-(2**63), 2**63, 4000)
    table = simhash._marks(spark.createDataFrame([(int(x),) for x in h[:2000]], "h long"), 1 << 20)
    marked = simhash._marked(table, h.view(np.uint64))
    assert marked[:2000].all() and marked[2000:].sum() < 20
    assert not simhash._marked(simhash._marks(spark.createDataFrame([], "h long"), 1 << 20), h.view(np.uint64)).any()


def test_sampled_keys_meet():
    rng = np.random.default_rng(9)
    keys = simhash.sampled_keys(1000, 0.8)
    assert len(simhash.sampled_keys(10**8, 0.8)) > len(keys) == len(simhash.sampled_keys(10**6, 0.8))
    met = 0
    for _ in range(2000):
        differ = sum(1 << int(i) for i in np.flatnonzero(rng.random(128) < np.arccos(8 / 9) / np.pi))
        met += any(not (differ & 2**64 - 1) & a and not (differ >> 64) & b for a, b in keys)
    assert met >= 0.93 * 2000


def test_walk_with_two_words():
    rng = np.random.default_rng(9)
    fp = rng.integers(0, 2**64, (300, 2), dtype=np.uint64)
    fp[200:] = fp[0] ^ (np.uint64(1) << rng.integers(0, 64, (100, 2)).astype(np.uint64))
    want = {frozenset([0, *range(200, 300)])}
    for links in (simhash.link_bucket(fp, 28), simhash._link_sorted(np.zeros(300, np.int64), fp, 28)):
        root = list(range(300))

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for u, v in zip(*(x.tolist() for x in links)):
            root[find(u)] = find(v)
        assert {frozenset(y for y in range(300) if find(y) == find(x)) for x in range(300)} - {frozenset([x]) for x in range(300)} == want


def test_salted_join(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_SHARE", 4)
    rows = [(i, 1 if i % 2 else i % 11) for i in range(300)] + [(7, 1), (7, 1)]
    df = spark.createDataFrame(rows, "id long, k long")
    sizes = df.groupBy("k").count().withColumnRenamed("count", "size").selectExpr("k", "size", "k * 2 as twice")
    got = sorted((r.id, r.k, r.twice) for r in common.join_salted(df, sizes, "k", "size").collect())
    assert got == sorted((i, k, 2 * k) for i, k in rows)
