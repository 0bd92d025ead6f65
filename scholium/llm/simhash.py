"""Near-duplicate documents by SimHash fingerprints, matched through pivot distance tables.

A fingerprint's coordinates are its Hamming distances to ``PIVOTS`` reference fingerprints. By
the triangle inequality two fingerprints at distance d differ by at most d in every coordinate,
so pairs whose largest coordinate difference exceeds the limit are discarded, and only what is
left is verified.

Pairs to look at come from an equality join, not from all pairs: of 5 blocks of a fingerprint, 3
differing bits leave at least 2 untouched, so linked fingerprints share one of 10 keys of two
blocks each (more blocks make longer keys for more fingerprints). Rows with the same key (a bucket) are streamed in key order through the tasks. Of a
bucket, only a spanning forest of its links is emitted, so that thousands of near copies give
thousands of edges rather than millions. A bucket of more than ``HOT_BUCKET`` fingerprints is cut
into chunks, and each two chunks meet in a task of their own. Equal fingerprints are one node.

``verified_groups`` links two texts where their exact shingle sets are similar enough. Its candidates are
what fingerprints of 128 bits connect at a far limit: so wide that unlike texts hardly ever come that near,
however many there are. At such a limit no blocks are sure to stay untouched, so keys are samples of the bits,
as many as it takes for all but a small share of the pairs at the least similarity to meet under one of them.
One representative of each shingle set moves.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations, repeat
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_salted, materialize
from .components import components
from .ragged import chunks, mix, texts

MAX_BITS = 3
BLOCKS = 5
PIVOTS = 16
HOT_BUCKET = 50_000
CHUNK = 8_192
SMALL = 48
_SHINGLES = 1 << 17
#: Groups of candidates are dealt in pieces of so many sets, but at most GROUP_PIECES, which meet pairwise; groups of more
#: than GROUP_PIECES * GROUP_CHUNK sets are first shrunk in pieces of about GROUP_CHUNK that don't meet (large_links).
GROUP_PIECE = 64
GROUP_PIECES = 8
GROUP_CHUNK = 1_024
#: Slots of the table of shingle counts by which large_links puts rare shingles first.
COUNT_SLOTS = 1 << 16
#: Share of the pairs at the least similarity that may meet under no key of sampled bits; nearer pairs are missed far more rarely.
MISSED = 0.05
#: Differing bits of 128 up to which texts are candidates: at a similarity of 0.8 about 19 are expected, give or take 4.
FAR_BITS = 28
#: The tables that tell which rows may be representatives have MARK_BITS bits a representative, within these bounds (128 KB to 128 MB).
MARK_BITS = 16
FEWEST_MARKS, MOST_MARKS = 1 << 20, 1 << 30
_BITMAP = 1 << 15  # bits of a bitmap of Spark's


def _majority(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """For each text, the word whose bits are set in over half of its hashes."""
    ones = np.zeros((len(counts), 64), np.int64)
    cut = np.concatenate([[0], np.cumsum(counts)])
    at = 0
    while at < len(counts):  # a bounded number of hashes at once; one text may need several turns
        end = max(at + 1, int(np.searchsorted(cut, cut[at] + _SHINGLES, "right")) - 1)
        for lo in range(cut[at], cut[end], 8 * _SHINGLES):
            part = hashes[lo : min(cut[end], lo + 8 * _SHINGLES)]
            bits = np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            if end == at + 1:
                ones[at] += bits.sum(axis=0, dtype=np.int64)
            else:
                full = np.flatnonzero(counts[at:end]) + at
                ones[full] += np.add.reduceat(bits, cut[full] - lo, axis=0, dtype=np.int32)
        at = end
    set_bits = 2 * ones > counts[:, None]
    return np.packbits(set_bits, axis=1, bitorder="little").view("<u8").ravel().astype(np.uint64)


def _hashes(text: bytes, words_per_shingle: int) -> list[int]:
    from xxhash import xxh64_intdigest

    words = text.lower().split()  # bytes: A-Z only, and splits at \x20 \x09-\x0D only
    if len(words) < words_per_shingle:
        shingles = [b" ".join(words)] if words else []
        return [xxh64_intdigest(s, 42) for s in shingles]
    return list(map(xxh64_intdigest, map(b" ".join, zip(*(words[i:] for i in range(words_per_shingle)))), repeat(42)))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_per_shingle: int = 3) -> DataFrame:
    """(id, fp long) for each row: the SimHash of all shingles, repeats included.

    A null text, or one without words, gives 0; a text of fewer words than a shingle is one shingle.
    """
    schema = pa.schema([("id", pa.int64()), ("fp", pa.int64())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in chunks(batches, "text"):
            each = [np.array(_hashes(t, words_per_shingle), np.uint64) for t in texts(data, offsets)]
            fp = _majority(np.concatenate(each), np.array([len(x) for x in each]))
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(fp.view(np.int64))], schema=schema)

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id long, fp long")


def pivots(n: int = PIVOTS, words: int = 1) -> np.ndarray:
    """Reference fingerprints of so many 64-bit words: fixed and spread over the space."""
    return np.random.default_rng(64).integers(0, 2**64, (n, words), dtype=np.uint64)


def coordinates(fp: np.ndarray, references: np.ndarray) -> np.ndarray:
    """Hamming distances of fingerprints, rows of 64-bit words, to references of as many words."""
    return np.bitwise_count(fp[:, None, :] ^ references[None, :, :]).sum(axis=2, dtype=np.int16)


def _near(a: np.ndarray, b: np.ndarray, fa: np.ndarray, fb: np.ndarray, max_bits: int) -> np.ndarray:
    """Which rows of coordinates a, b (or a one row) are at most max_bits apart: discard, then verify."""
    out = np.flatnonzero(np.abs(a[..., 0] - b[..., 0]) <= max_bits)
    pick = (lambda x, i: x[i] if x.ndim == b.ndim else x)
    for j in range(1, b.shape[-1], 5):
        if not len(out):
            return out
        out = out[(np.abs(pick(a, out)[..., j : j + 5] - b[out, j : j + 5]) <= max_bits).all(axis=-1)]
    first = fa if fa.ndim < fb.ndim else fa[out]
    return out[np.bitwise_count(first ^ fb[out]).sum(axis=-1) <= max_bits]


def link_bucket(fp: np.ndarray, max_bits: int = MAX_BITS, references: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links among distinct fingerprints (rows of words), as row numbers.

    Each component is walked from a seed; whatever is reached leaves the table, so a cluster of
    near copies costs few comparisons.
    """
    references = pivots(words=fp.shape[1]) if references is None else references
    coords = coordinates(fp, references)
    left = np.arange(len(fp))
    us: list[np.ndarray] = []
    vs: list[np.ndarray] = []
    while len(left) > 1:
        seed, left = left[0], left[1:]
        queue = [seed]
        while queue and len(left):
            x = queue.pop()
            found = _near(coords[x], coords[left], fp[x], fp[left], max_bits)
            if len(found):
                reached = left[found]
                us.append(np.full(len(reached), seed))
                vs.append(reached)
                queue.extend(reached.tolist())
                left = np.delete(left, found)
    empty = np.zeros(0, np.int64)
    return (np.concatenate(us), np.concatenate(vs)) if us else (empty, empty)


def _link_sorted(bucket: np.ndarray, fp: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links within runs of equal ``bucket``, as row numbers: short runs by shifted comparison of all at once."""
    references = pivots(words=fp.shape[1])
    start = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
    size = np.diff(np.concatenate([start, [len(bucket)]]))
    empty = np.zeros(0, np.int64)
    us, vs = [empty], [empty]
    for s, n in zip(start[size > SMALL].tolist(), size[size > SMALL].tolist()):
        u, v = link_bucket(fp[s : s + n], max_bits, references)
        us.append(u + s)
        vs.append(v + s)
    of = np.repeat(size, size)
    few = np.flatnonzero((of > 1) & (of <= SMALL))
    if len(few):
        b, f = bucket[few], fp[few]
        coords = coordinates(f, references)
        for shift in range(1, min(SMALL, int(size[size <= SMALL].max()))):
            at = np.flatnonzero(b[shift:] == b[:-shift])
            if not len(at):
                break
            hit = at[_near(coords[at], coords[at + shift], f[at], f[at + shift], max_bits)]
            us.append(few[hit])
            vs.append(few[hit + shift])
    return np.concatenate(us), np.concatenate(vs)


def _bucket_links(keyed: DataFrame, words: list[str], max_bits: int) -> DataFrame:
    """(u, v): within each bucket of rows (key, node, words) edges that connect what links of at most max_bits connect."""
    hot = keyed.groupBy("key").count().where(F.col("count") > HOT_BUCKET)
    pieces = F.ceil(F.col("count") / CHUNK).cast("int")
    own = F.pmod(F.xxhash64("node"), F.col("pieces")).cast("int")
    cut = (
        keyed.join(hot, "key", "left")
        .withColumn("pieces", F.coalesce(pieces, F.lit(1)))
        .withColumn("own", own)
        .select("key", "node", *words, F.explode(F.expr("transform(sequence(0, pieces - 1), i -> named_struct('a', least(i, own), 'b', greatest(i, own)))")).alias("pair"))
        .select("key", "pair.a", "pair.b", "node", *words)
    )
    by = ["key", "a", "b"]
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def emit(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
            new = np.concatenate([[True], (rows[1:, :3] != rows[:-1, :3]).any(axis=1)])
            u, v = _link_sorted(np.cumsum(new), np.ascontiguousarray(rows[:, 4:]).view(np.uint64), max_bits)
            if len(u):
                yield pa.RecordBatch.from_arrays([pa.array(rows[u, 3]), pa.array(rows[v, 3])], schema=schema)

        for batch in batches:
            if not batch.num_rows:
                continue
            rows = np.ascontiguousarray(np.stack([c.cast(pa.int64()).to_numpy(zero_copy_only=False) for c in batch.columns], axis=1))
            if held:
                rows = np.concatenate([held.pop(), rows])
            last = int(np.flatnonzero((rows[:, :3] != rows[-1, :3]).any(axis=1))[-1:].sum() + 1) if (rows[0, :3] != rows[-1, :3]).any() else 0
            if last:  # the last bucket may go on in the next batch
                yield from emit(rows[:last])
            held.append(rows[last:])
        if held:
            yield from emit(held.pop())

    found = cut.repartition(*by).sortWithinPartitions(*by, "node").mapInArrow(run, "u long, v long")
    return found.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).repartition("v").sortWithinPartitions("v", "u").mapInArrow(_fewer, "u long, v long").distinct()


def _fewer(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of edges in order (v, u), u smaller: each v with its smallest neighbour, and that one with the others, each pair once a batch.

    What was connected stays so. A cluster that meets under many keys has an edge for each of them; after this, about one a node.
    """
    held: np.ndarray | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns], axis=1)
        if held is not None:
            rows = np.concatenate([held, rows])
        last = int(np.searchsorted(rows[:, 1], rows[-1, 1]))  # the last node's edges may go on in the next batch
        held = rows[last:]
        if last:
            yield _star(rows[:last])
    if held is not None:
        yield _star(held)


def _star(rows: np.ndarray) -> pa.RecordBatch:
    first = np.concatenate([[True], rows[1:, 1] != rows[:-1, 1]])
    least = rows[first, 0][np.cumsum(first) - 1]
    pairs = np.unique(np.stack([least, np.where(first, rows[:, 1], rows[:, 0])], axis=1), axis=0)
    pairs = pairs[pairs[:, 0] != pairs[:, 1]]
    return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["u", "v"])


def _signed(x: int) -> int:
    return x - 2**64 if x >= 2**63 else x


def links(distinct: DataFrame, max_bits: int = MAX_BITS, blocks: int = BLOCKS) -> DataFrame:
    """(u, v): edges between distinct fingerprints (fp) that give the same components as all links.

    ``blocks`` must exceed ``max_bits`` by at least one; more blocks make longer keys and more copies
    of each row: blocks - max_bits of them are in a key.
    """
    edges = np.linspace(0, 64, blocks + 1).astype(int)
    mask = [((1 << int(b)) - (1 << int(a))) for a, b in zip(edges, edges[1:])]
    keys = [F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(F.lit(_signed(sum(mask[i] for i in c))))) for i, c in enumerate(combinations(range(blocks), blocks - max_bits))]
    return _bucket_links(distinct.select(F.explode(F.array(*keys)).alias("key"), F.col("fp").alias("node"), "fp"), ["fp"], max_bits)


def sampled_keys(n: int, least: float) -> list[tuple[int, int]]:
    """Masks over two 64-bit words, so many that a pair of the similarity ``least`` shares a key but for MISSED of the cases.

    A bit of two fingerprints differs with probability angle / pi. More bits make a key for more fingerprints, so
    that buckets stay short; it takes more keys then.
    """
    bits = max(14, int(np.ceil(np.log2(max(n, 2)))) - 6)
    apart = np.arccos(min(1.0, 2 * least / (1 + least))) / np.pi
    differing = np.arange(129)
    chance = np.array([comb(128, d) * apart**d * (1 - apart) ** (128 - d) for d in differing])
    clear = np.prod([np.maximum(0, 128 - differing - i) / (128 - i) for i in range(bits)], axis=0)  # no differing bit is in a key
    tables = 1
    while float(chance @ (1 - clear) ** tables) > MISSED:
        tables += 1
    rng = np.random.default_rng(128)
    out: list[tuple[int, int]] = []
    while len(out) < tables:
        order = rng.permutation(128)
        for at in range(0, 128 - bits + 1, bits):
            mask = sum(1 << int(i) for i in order[at : at + bits])
            out.append((mask & (2**64 - 1), mask >> 64))
    return out[:tables]


def candidate_links(nodes: DataFrame, max_bits: int, least: float) -> DataFrame:
    """(u, v): edges among nodes (node, fp, fp2) at most max_bits of 128 apart, that connect what such links under a shared key connect."""
    keys = [F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(F.lit(_signed(a))), F.col("fp2").bitwiseAND(F.lit(_signed(b)))) for i, (a, b) in enumerate(sampled_keys(nodes.count(), least))]
    return _bucket_links(nodes.select(F.explode(F.array(*keys)).alias("key"), "node", "fp", "fp2"), ["fp", "fp2"], max_bits)


def key_blocks(n: int, max_bits: int = MAX_BITS) -> int:
    """How many untouched blocks make a key, so that n spread fingerprints give buckets of few rows. It changes the cost, not the result."""
    k = 2
    while 64 * k / (max_bits + k) < np.log2(max(n, 1)) - 4:
        k += 1
    return k


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_per_shingle: int = 5, max_bits: int = MAX_BITS) -> DataFrame:
    """(id, fingerprint, component_id): one row for each row of ``docs``.

    component_id is the smallest id among all documents that links of at most ``max_bits`` differing
    bits reach, the document's own included. Repeated rows give repeated result rows. A null id takes
    part (its component_id is the smallest id that is not null, or null). Texts without words have
    fingerprint zero and link like any other. A very long text is a chunk of its own, and its shingles are
    counted in turns; other columns of ``docs`` are not read. An empty table gives an empty one.
    """
    own = materialize(fingerprints(docs, id_col, text_col, words_per_shingle), "fingerprints")
    distinct = own.groupBy("fp").agg(F.min("id").alias("least"), F.count("*").alias("size"))
    roots = components(links(distinct.select("fp"), max_bits, max_bits + key_blocks(distinct.count(), max_bits)))
    named = distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "least", "size", F.coalesce("root", "fp").alias("root"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    found = named.join(least, "root").select("fp", "size", "component_id")
    return join_salted(own, found, "fp", "size").select(F.col("id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def _sets(texts_: list[bytes], words_per_shingle: int) -> tuple[list[np.ndarray], np.ndarray]:
    """For each text its shingles' hashes, sorted and distinct, and one hash of these."""
    from xxhash import xxh64_intdigest

    own = [np.unique(np.array(_hashes(t, words_per_shingle), np.uint64)) for t in texts_]
    return own, np.array([xxh64_intdigest(x.tobytes(), 7) for x in own], np.uint64)


def _tags(ids: pa.Array, keys: np.ndarray) -> np.ndarray:
    """One number for each id and set: rows with equal ones are the same."""
    return mix(keys ^ mix(ids.fill_null(-1).to_numpy(zero_copy_only=False).view(np.uint64)))


def set_keys(docs: DataFrame, id_col: str, text_col: str, words_per_shingle: int) -> DataFrame:
    """(id, fp, fp2, set, tag) for each row: its fingerprint of 128 bits over distinct shingles, the hash of its shingle set, and that of id and set."""
    schema = pa.schema([("id", pa.int64()), ("fp", pa.int64()), ("fp2", pa.int64()), ("set", pa.int64()), ("tag", pa.int64())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in chunks(batches, "text"):
            own, keys = _sets(texts(data, offsets), words_per_shingle)
            flat, count = np.concatenate(own), np.array([len(x) for x in own])
            columns = (_majority(flat, count), _majority(mix(flat), count), keys, _tags(rows.column(0), keys))
            yield pa.RecordBatch.from_arrays([rows.column(0), *(pa.array(x.view(np.int64)) for x in columns)], schema=schema)

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id long, fp long, fp2 long, set long, tag long")


def marks(n: int) -> int:
    """The bits of a table for n hashes, a power of two. Beyond MOST_MARKS / MARK_BITS hashes more rows are marked in vain, none is missed."""
    return min(max(1 << int(np.ceil(np.log2(max(1, MARK_BITS * n)))), FEWEST_MARKS), MOST_MARKS)


def _marks(hashes: DataFrame, bits: int) -> np.ndarray:
    """A table of ``bits`` bits, as bytes, with those of the low bits of the hashes (h) set; Spark makes it in pieces of 4 KB."""
    bit = F.col("h").bitwiseAND(F.lit(bits - 1))
    pieces = hashes.groupBy(F.floor(bit / _BITMAP).cast("int").alias("piece")).agg(F.bitmap_construct_agg(bit % _BITMAP).alias("bitmap"))
    table = np.zeros((bits // _BITMAP, _BITMAP // 8), np.uint8)
    for r in pieces.toLocalIterator():  # bits / _BITMAP rows at most
        table[r.piece] = np.frombuffer(r.bitmap, np.uint8)
    return table.ravel()


def _marked(table: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = (hashes & np.uint64(8 * len(table) - 1)).astype(np.int64)
    return (table[at >> 3] >> (at & 7).astype(np.uint8) & np.uint8(1)).astype(bool)


def _marked_sets(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str, words_per_shingle: int) -> DataFrame:
    """(set, shingles binary) of the rows that wanted (id, tag) names, and of few others; only rows with marked ids are cut into shingles."""
    of_id = F.xxhash64(F.coalesce(F.col("id"), F.lit(-1)))
    bits = marks(wanted.count())
    shared = docs.sparkSession.sparkContext.broadcast((_marks(wanted.select(of_id.alias("h")), bits), _marks(wanted.select(F.col("tag").alias("h")), bits)))
    schema = pa.schema([("set", pa.int64()), ("shingles", pa.binary())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, tags = shared.value
        few = (b.filter(pa.array(_marked(ids, b.column(2).to_numpy(zero_copy_only=False).view(np.uint64)))) for b in batches)
        for rows, data, offsets in chunks(few, "text"):
            own, keys = _sets(texts(data, offsets), words_per_shingle)
            hit = np.flatnonzero(_marked(tags, _tags(rows.column(0), keys)))
            if len(hit):
                yield pa.RecordBatch.from_arrays([pa.array(keys[hit].view(np.int64)), pa.array([own[i].tobytes() for i in hit], pa.binary())], schema=schema)

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).withColumn("h", of_id).mapInArrow(run, "set long, shingles binary")


def similar(a: np.ndarray, b: np.ndarray, least: float) -> bool:
    """Whether the Jaccard similarity of two sorted sets is ``least`` or more."""
    if min(len(a), len(b)) < least * max(len(a), len(b)):
        return False
    few, many = (a, b) if len(a) < len(b) else (b, a)
    if not len(few):
        return not len(many)
    at = np.minimum(np.searchsorted(many, few), len(many) - 1)
    both = int((many[at] == few).sum())
    return both >= least * (len(a) + len(b) - both)


def link_sets(keys: list[int], sets: list[np.ndarray], least: float) -> list[tuple[int, int]]:
    """(head, other) for each set that links of similarity ``least`` or more connect with an earlier one, the head being the first it is connected with."""
    size = np.array([len(x) for x in sets])
    left = np.arange(len(sets))
    out = []
    while len(left) > 1:
        head, queue, left = left[0], [left[0]], left[1:]
        while queue and len(left):
            x = queue.pop()
            near = np.flatnonzero((size[left] >= least * size[x]) & (size[x] >= least * size[left]))
            found = [i for i in near if similar(sets[x], sets[left[i]], least)]
            out += [(keys[head], keys[left[i]]) for i in found]
            queue.extend(left[found].tolist())
            left = np.delete(left, found)
    return out


def _met(cut: DataFrame, least: float) -> DataFrame:
    """(u, v): link_sets() of the sets (root, a, b, set, shingles) that share root, a and b."""
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, keys, own = None, [], []

        def emit() -> Iterator[pa.RecordBatch]:
            edges = link_sets(keys, own, least)
            if edges:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*edges)], schema=schema)

        for batch in batches:
            group = list(zip(*(batch.column(i).to_pylist() for i in range(3))))
            for g, key, shingles in zip(group, batch.column(3).to_pylist(), batch.column(4)):
                if g != held:
                    yield from emit()
                    held, keys, own = g, [], []
                keys.append(key)
                own.append(np.frombuffer(shingles.as_py(), np.uint64))
        yield from emit()

    return cut.repartition("root", "a", "b").sortWithinPartitions("root", "a", "b", "set").mapInArrow(run, "u long, v long")


_PAIRS = "transform(sequence(0, pieces - 1), i -> named_struct('a', least(i, own), 'b', greatest(i, own)))"


def set_links(sets: DataFrame, least: float) -> DataFrame:
    """(u, v): edges among the sets (root, n, set, shingles) of a root that give the same components as all similar pairs.

    Each set moves at most GROUP_PIECES times; roots of more than GROUP_PIECES * GROUP_CHUNK sets are for large_links().
    """
    pieces = F.least(F.ceil(F.col("n") / GROUP_PIECE), F.lit(GROUP_PIECES)).cast("int")
    dealt = sets.withColumn("pieces", pieces).withColumn("own", F.pmod(F.xxhash64("set"), F.col("pieces")).cast("int"))
    cut = dealt.select("root", "set", "shingles", F.explode(F.expr(_PAIRS)).alias("pair"))
    return _met(cut.select("root", "pair.a", "pair.b", "set", "shingles"), least).distinct()


def _slots(shingles: np.ndarray, slots: int) -> np.ndarray:
    return (shingles & np.uint64(slots - 1)).astype(np.int64)


def _shingle_counts(sets: DataFrame, slots: int) -> np.ndarray:
    """How often shingles occur, by slots of their hashes: a table of fixed size. Clashes only change what counts as rare."""
    schema = pa.schema([("slot", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(slots, np.int64)
        for batch in batches:
            total += np.bincount(_slots(np.frombuffer(b"".join(batch.column(0).to_pylist()), np.uint64), slots), minlength=slots)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], schema=schema)

    out = np.zeros(slots, np.int64)
    for r in sets.select("shingles").mapInArrow(run, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).collect():  # a row a slot at most
        out[r.slot] = r.n
    return out


def _open(sets: DataFrame, least: float, slots: int) -> DataFrame:
    """(root, set) of those sets (root, head, set, shingles) that may be similar to one of another head in their root; it leaves no such set out.

    With the shingles in any common order, similar sets share one among the first (1 - least) of each: so only sets that share
    one there with another head's remain, and of these only those that have enough shingles from there on.
    """
    shared = sets.sparkSession.sparkContext.broadcast(_shingle_counts(sets, slots))
    schema = pa.schema([("root", pa.int64()), ("head", pa.int64()), ("set", pa.int64()), ("shingle", pa.int64()), ("size", pa.int32()), ("room", pa.int32())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = shared.value
        for batch in batches:
            for root, head, key, x in zip(*(batch.column(i).to_pylist() for i in range(3)), batch.column(3)):
                own = np.frombuffer(x.as_py(), np.uint64)
                first = len(own) - int(np.ceil(least * len(own) - 1e-9)) + 1 if len(own) else 0
                own = own[np.lexsort((own, count[_slots(own, len(count))]))[:first]]
                size = len(x.as_py()) // 8
                columns = [np.full(len(own), c, np.int64) for c in (root, head, key)]
                yield pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array(own.view(np.int64)), pa.array(np.full(len(own), size, np.int32)), pa.array((size - np.arange(len(own))).astype(np.int32))], schema=schema)

    by = ["root", "shingle"]
    rare = sets.select("root", "head", "set", "shingles").mapInArrow(run, "root long, head long, set long, shingle long, size int, room int")
    lists = rare.groupBy(*by).agg(F.min("head").alias("low"), F.max("head").alias("high"), F.min("size").alias("fewest")).where("low <> high")
    both = least / (1 + least) * (F.col("size") + F.greatest(F.col("fewest"), F.lit(least) * F.col("size")))  # shingles that a similar pair shares at least
    return rare.join(lists.select(*by, "fewest"), by).where(F.col("room") >= both - 1e-6).select("root", "set").distinct()


def large_links(sets: DataFrame, least: float, slots: int = COUNT_SLOTS) -> DataFrame:
    """(u, v): what set_links() gives, for roots of very many sets (root, set, shingles); ``sets`` is read several times.

    In rounds the sets of a root are dealt by a hash into pieces of about GROUP_CHUNK, and what is connected in a piece goes on
    as its head, until all heads of a root fit in a piece or no longer half of them go: near copies end under one head, each having moved
    twice or so. Then links between sets of different heads are looked for, among those that _open() leaves: sets under
    the root's largest head meet all others, which also meet one another. Only if many sets of a root stay under different
    heads and yet share rare shingles does what moves grow with their number times that of the others over GROUP_CHUNK.
    """
    found, heads, before = [], sets.select("root", "set", "shingles"), sets.count()
    while True:
        sizes = heads.groupBy("root").agg(F.count("*").alias("n"))
        whole = sizes.where(F.col("n") > GROUP_CHUNK).isEmpty()
        piece = F.pmod(F.xxhash64("set", F.lit(len(found))), F.ceil(F.col("n") / GROUP_CHUNK)).cast("int")
        found.append(materialize(_met(heads.join(sizes, "root").select("root", piece.alias("a"), F.lit(0).alias("b"), "set", "shingles"), least), "heads"))
        gone = found[-1].select(F.col("v").alias("set"))
        heads = heads.join(gone, "set", "left_anti").select("root", "set", "shingles")
        left = heads.count()
        if whole or left > before / 2:
            break
        before = left
    named = sets.select("root", "set", F.col("set").alias("head"))
    for edges in found:
        named = named.join(edges, F.col("head") == F.col("v"), "left").select("root", "set", F.coalesce("u", "head").alias("head"))
    named = materialize(named, "headed")
    several = named.groupBy("root").agg(F.min("head").alias("low"), F.max("head").alias("high")).where("low <> high").select("root")
    unlike = sets.select("set", "shingles").join(named.join(several, "root"), "set")
    kept = materialize(_open(unlike, least, slots).join(named.select("set", "head"), "set"), "open")
    sizes = kept.groupBy("root", "head").agg(F.count("*").alias("n"))
    most = sizes.groupBy("root").agg(F.max(F.struct("n", "head")).alias("m"), F.sum("n").alias("n"))
    parts = most.where("n > m.n").select("root", F.col("m.head").alias("most"), *(F.ceil(c / GROUP_CHUNK).cast("int").alias(p) for c, p in ((F.col("m.n"), "others"), (F.col("n") - F.col("m.n"), "pieces"))))
    dealt = kept.join(parts, "root").withColumn("own", F.pmod(F.xxhash64("set"), F.when(F.col("head") == F.col("most"), F.col("others")).otherwise(F.col("pieces"))).cast("int"))
    across = "transform(sequence(0, {0} - 1), i -> named_struct('a', {1}, 'b', {2}))"
    alone = f"transform({_PAIRS}, p -> named_struct('a', -1 - p.a, 'b', p.b))"  # others among themselves, in tasks below zero
    tasks = F.expr(f"if(head = most, {across.format('pieces', 'own', 'i')}, concat({across.format('others', 'i', 'own')}, {alone}))")
    cut = dealt.select("set", "root", F.explode(tasks).alias("pair")).join(sets.select("set", "shingles"), "set")
    out = _met(cut.select("root", "pair.a", "pair.b", "set", "shingles"), least).distinct()
    for edges in found:
        out = out.union(edges)
    return out


def verified_groups(docs: DataFrame, least: float, id_col: str = "doc_id", text_col: str = "text", words_per_shingle: int = 5, max_bits: int = FAR_BITS) -> DataFrame:
    """(id, component_id) of each row: the smallest id that links of exact Jaccard similarity >= ``least`` reach.

    Candidates are the pairs of texts that chains of links connect, at most ``max_bits`` of 128 fingerprint bits
    long each, that share a key of sampled bits. Ids, null ids, repeated rows and texts without words are treated as by
    near_duplicates(). A very long text is one set of hashes, eight bytes a word, wherever it is compared.
    """
    own = materialize(set_keys(docs, id_col, text_col, words_per_shingle), "sets")
    each = own.groupBy(F.col("set").alias("node")).agg(F.min("fp").alias("fp"), F.min("fp2").alias("fp2"), F.min("id").alias("least"), F.min(F.struct(F.coalesce("id", F.lit(-1)).alias("id"), "tag")).alias("row"), F.count("*").alias("size"))
    each = materialize(each, "shingle-sets")
    roots = components(candidate_links(each.select("node", "fp", "fp2"), max_bits, least)).withColumnRenamed("node", "__node")
    grouped = each.join(roots, each.node == F.col("__node")).select("root", F.col("node").alias("set"), "row.id", "row.tag")  # sets without a candidate are alone
    many = grouped.groupBy("root").agg(F.count("*").alias("n"))
    wanted = materialize(grouped.join(many, "root"), "candidates")

    def with_shingles(part: DataFrame) -> DataFrame:
        shingles = _marked_sets(docs, part.select("id", "tag"), id_col, text_col, words_per_shingle)
        return part.drop("id", "tag").join(shingles.dropDuplicates(["set"]), "set")

    large = F.col("n") > GROUP_PIECES * GROUP_CHUNK
    edges = set_links(with_shingles(wanted.where(~large)), least)
    if not wanted.where(large).isEmpty():
        edges = edges.union(large_links(materialize(with_shingles(wanted.where(large)), "large-groups"), least))
    found = components(edges).withColumnRenamed("node", "__node")
    linked = each.join(found, each.node == F.col("__node"), "left").select("node", "least", "size", F.coalesce("root", "node").alias("group"))
    lowest = linked.groupBy("group").agg(F.min("least").alias("component_id"))
    named = linked.join(lowest, "group").select(F.col("node").alias("set"), "size", "component_id")
    return join_salted(own.select("id", "set"), named, "set", "size").select("id", "component_id")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_per_shingle: int = 5, max_bits: int | None = None, least: float | None = None) -> DataFrame:
    """Rows of ``docs``, all columns, of the one document with the smallest id in each group.

    Rows that repeat one id are the same document: all of them stay or go. Rows with a null id stay
    only where their whole group has no id. With ``least``, groups are verified_groups().
    """
    if least is None:
        found = near_duplicates(docs, id_col, text_col, words_per_shingle, max_bits or MAX_BITS)
    else:
        found = verified_groups(docs, least, id_col, text_col, words_per_shingle, max_bits or FAR_BITS)
    keep = found.where(F.col("id").eqNullSafe(F.col("component_id"))).select(F.col("id").alias("__kept")).distinct()
    return docs.join(keep, docs[id_col].cast("long").eqNullSafe(keep["__kept"]), "left_semi")
