"""Benchmark decontamination: an FM-index of each training shard, searched for benchmark windows.

A shard is a bounded chunk of documents as one sequence of word numbers. Only words of the benchmark
have numbers of their own; a stretch of other words is one separator, and stretches of benchmark words
shorter than the shortest window, which can't hold one, are left out. Over this sequence stand the
Burrows-Wheeler transform in a wavelet matrix, the counts of smaller symbols, and the suffix positions
at every SAMPLE-th place. All windows are searched backwards at once; their occurrences are located by
walking to the nearest sampled position, and the words they cover are merged into spans.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import remove, scratch
from .ragged import chunks, distinct, gather, slice_hashes, spans

WINDOW = 10
SAMPLE = 8
#: Benchmark texts held in one search, in bytes; a larger benchmark is searched in several blocks.
BLOCK_BYTES = 8 << 20
END, BREAK = 0, 1

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_WORD = np.zeros(256, bool)
_WORD[ord("0") : ord("9") + 1] = _WORD[ord("a") : ord("z") + 1] = _WORD[0x80:] = True


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[tuple[np.ndarray, np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """Two hashes, start and end of each word (digits, letters a-z after lowering A-Z, anything beyond ASCII), and each text's first word."""
    low = _LOWER[data]
    starts, ends = spans(_WORD[low], offsets)
    return slice_hashes(low, starts, ends), starts, ends, np.searchsorted(starts, offsets)


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Order of all suffixes of ``text``, whose last symbol is its only END, by prefix doubling."""
    n, bits = len(text), int(text.max()).bit_length() or 1
    k = max(1, min(62 // bits, n))
    key = np.zeros(n, np.int64)
    for j in range(k):
        key <<= bits
        key[: n - j] |= text[j:]
    order = np.argsort(key, kind="stable")
    new = np.ones(n, bool)
    new[1:] = key[order][1:] != key[order][:-1]
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    while True:
        alone = new & np.append(new[1:], True)
        at = np.flatnonzero(~alone)  # only suffixes that still tie are sorted again
        if not len(at):
            return order
        sub = order[at]
        near, far = rank[sub], rank[np.minimum(sub + k, n - 1)]
        by = np.lexsort((far, near))
        sub, near, far = sub[by], near[by], far[by]
        order[at] = sub
        first = np.ones(len(at), bool)
        first[1:] = (near[1:] != near[:-1]) | (far[1:] != far[:-1])
        new[at] = first
        rank[sub] = np.maximum.accumulate(np.where(first, at, 0))
        k *= 2


class WaveletMatrix:
    """Symbol counts in any prefix of a sequence, by one bit array for each bit of the symbols."""

    def __init__(self, symbols: np.ndarray, bits: int):
        self.bits, self.n = bits, len(symbols)
        self.levels: list[tuple[np.ndarray, int]] = []
        now = symbols
        for b in range(bits - 1, -1, -1):
            one = (now >> b) & 1
            ones = np.zeros(self.n + 1, np.int32)
            np.cumsum(one, out=ones[1:])
            self.levels.append((ones, self.n - int(ones[-1])))
            now = np.concatenate([now[one == 0], now[one == 1]])
        self.first = np.zeros((1 << bits) + 1, np.int64)  # where a symbol's copies start below the last level
        if self.n:
            new = np.flatnonzero(np.concatenate([[True], now[1:] != now[:-1]]))
            self.first[now[new]] = new

    def rank(self, symbol: np.ndarray, upto: np.ndarray) -> np.ndarray:
        """How many of the first ``upto`` symbols are ``symbol``, which occurs in the sequence."""
        at = upto.astype(np.int64)
        for level, (ones, zeros) in enumerate(self.levels):
            bit = (symbol >> (self.bits - 1 - level)) & 1
            up = ones[at]
            at = np.where(bit == 1, zeros + up, at - up)
        return at - self.first[symbol]

    def access(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbols at the given places, and how many equal ones stand before each."""
        symbol = np.zeros(len(at), np.int64)
        at = at.astype(np.int64)
        for ones, zeros in self.levels:
            up = ones[at]
            bit = ones[at + 1] - up
            symbol = (symbol << 1) | bit
            at = np.where(bit == 1, zeros + up, at - up)
        return symbol, at - self.first[symbol]


class FMIndex:
    """Counts and places of phrases in a sequence of symbols above BREAK, BREAK between stretches, END at last."""

    def __init__(self, text: np.ndarray, sample: int = SAMPLE):
        text = text.astype(np.int64)
        order = suffix_array(text)
        top = int(text.max()) + 1
        self.counts = np.bincount(text, minlength=top)
        self.smaller = np.concatenate([[0], np.cumsum(self.counts)])
        self.wavelet = WaveletMatrix(text[order - 1], max(1, (top - 1).bit_length()))
        kept = order % sample == 0
        self.marked = np.concatenate([[0], np.cumsum(kept)])
        self.sampled = order[kept]
        self.top, self.n = top, len(text)

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each phrase (a row, filled from the left) the range of suffixes that start with it; empty if none does."""
        low = np.zeros(len(phrases), np.int64)
        high = np.full(len(phrases), self.n, np.int64)
        for step in range(int(lengths.max()) if len(lengths) else 0):
            on = np.flatnonzero((lengths > step) & (low < high))
            symbol = phrases[on, lengths[on] - 1 - step]
            there = (symbol < self.top) & (self.counts[np.minimum(symbol, self.top - 1)] > 0)
            high[on[~there]] = low[on[~there]]
            on, symbol = on[there], symbol[there]
            low[on] = self.smaller[symbol] + self.wavelet.rank(symbol, low[on])
            high[on] = self.smaller[symbol] + self.wavelet.rank(symbol, high[on])
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """The text places of suffixes: walk back to a sampled one and add the steps."""
        place = np.full(len(rows), -1, np.int64)
        at, steps, left = rows.astype(np.int64), 0, np.arange(len(rows))
        while len(left):
            have = self.marked[at + 1] > self.marked[at]
            place[left[have]] = self.sampled[self.marked[at[have]]] + steps
            left, at = left[~have], at[~have]
            symbol, before = self.wavelet.access(at)
            at = self.smaller[symbol] + before
            steps += 1
        return place


@dataclass
class Benchmark:
    """A block of benchmark windows as phrases of word numbers, and the items each comes from."""

    vocabulary: np.ndarray  # sorted hashes; a word's number is its place here, above BREAK
    second: np.ndarray  # the words' other hashes
    phrases: np.ndarray
    lengths: np.ndarray
    item_first: np.ndarray
    item_of: np.ndarray
    items: list[str | None]

    @classmethod
    def of(cls, rows: list[tuple[str | None, str]], window: int = WINDOW) -> Benchmark:
        raw = [t.encode() for _, t in rows]
        offsets = np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
        hashes, _, _, first = words(np.frombuffer(b"".join(raw), np.uint8), offsets)
        known, number = distinct(*hashes)
        number = number + BREAK + 1
        size = np.diff(first)
        length = np.minimum(size, window)
        count = np.where(size > 0, size - length + 1, 0)
        starts = gather(first[:-1], count)
        item, length = np.repeat(np.arange(len(rows)), count), np.repeat(length, count)
        phrases = np.zeros((len(starts), window), np.int32)
        for j in range(window):
            on = length > j
            phrases[on, j] = number[starts[on] + j]
        chosen, which = distinct(*slice_hashes(number.astype(np.uint64), starts, starts + length))
        pairs = np.unique(np.stack([which, item], axis=1), axis=0)
        return cls(hashes[0][known], hashes[1][known], phrases[chosen], length[chosen], np.searchsorted(pairs[:, 0], np.arange(len(chosen) + 1)), pairs[:, 1], [i for i, _ in rows])

    def search(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[list[str]], tuple[np.ndarray, np.ndarray]]:
        """Index a shard and search it: which words are hit, each text's first word, the texts and numbers of items found, word spans."""
        hashes, starts, ends, first = words(data, offsets)
        hit = np.zeros(len(starts), bool)
        found: list[list[str]] = [[] for _ in range(len(offsets) - 1)]
        if not len(starts) or not len(self.lengths):
            return hit, first, starts, found, (starts, ends)
        at = np.minimum(np.searchsorted(self.vocabulary, hashes[0]), len(self.vocabulary) - 1)
        known = (self.vocabulary[at] == hashes[0]) & (self.second[at] == hashes[1])
        begin, end = spans(known, first)
        long = end - begin >= int(self.lengths.min())
        begin, size = begin[long], (end - begin)[long]
        if not len(begin):
            return hit, first, starts, found, (starts, ends)
        place = gather(begin, size)  # the word at each place of the text; a break comes after each stretch
        stretch = np.repeat(np.arange(len(size)), size)
        to = np.arange(len(place)) + stretch
        text = np.full(len(place) + len(size) + 1, BREAK, np.int64)
        text[to] = at[place] + BREAK + 1
        text[-1] = END
        word = np.zeros(len(text), np.int64)
        word[to] = place
        index = FMIndex(text)
        low, high = index.search(self.phrases, self.lengths)
        times = np.maximum(high - low, 0)
        where = word[index.locate(gather(low, times))]
        phrase = np.repeat(np.arange(len(times)), times)
        change = np.zeros(len(starts) + 1, np.int64)
        np.add.at(change, where, 1)
        np.add.at(change, where + self.lengths[phrase], -1)
        hit = np.cumsum(change)[:-1] > 0
        doc = np.searchsorted(first, where, "right") - 1
        pair = np.unique(np.stack([doc, phrase], axis=1), axis=0)
        n = self.item_first[pair[:, 1] + 1] - self.item_first[pair[:, 1]]
        both = np.unique(np.stack([np.repeat(pair[:, 0], n), self.item_of[gather(self.item_first[pair[:, 1]], n)]], axis=1), axis=0)
        for d, i in both.tolist():
            if self.items[i] is not None:
                found[d].append(self.items[i])
        return hit, first, starts, found, (starts, ends)


def n_blocks(benchmark: DataFrame, text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> int:
    """How many blocks of about ``block_bytes`` the benchmark's rows make."""
    return max(1, -(-int(benchmark.agg(F.sum(F.octet_length(text_col))).first()[0] or 0) // block_bytes))


def blocks(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> Iterator[Benchmark]:
    """The benchmark's distinct rows in blocks of about BLOCK_BYTES, one after another.

    Rows are dealt by a hash of id and text, so that neither one id nor null ids gather in one; several blocks are stored
    first, so that each is read without the others.
    """
    spark = benchmark.sparkSession
    own = benchmark.select(F.col(id_col).cast("string").alias("item"), F.col(text_col).alias("text")).where(F.col("text").isNotNull()).distinct()
    n = n_blocks(own)
    path = None
    if n > 1:
        path = scratch(spark, "benchmark")
        own.withColumn("block", F.pmod(F.xxhash64("item", "text"), F.lit(n))).repartition("block").write.partitionBy("block").parquet(path)
    for k in range(n):
        rows = (spark.read.parquet(path).where(F.col("block") == k) if path else own).select("item", "text").collect()  # about BLOCK_BYTES
        yield Benchmark.of(sorted(((r.item, r.text) for r in rows), key=str))
    if path:
        remove(spark, path)


def _spans_of(hit: np.ndarray) -> list[int]:
    """Maximal runs of hit words as start, end, start, end ..."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
    return edge.tolist()


def _unhit(raw: bytes, starts: np.ndarray, ends: np.ndarray, spans_: list[int]) -> str:
    """A text without its hit spans, from the first word's start to the last one's end."""
    out, at = [], 0
    for s, e in zip(spans_[::2], spans_[1::2]):
        out.append(raw[at : starts[s]])
        at = ends[e - 1]
    return b"".join([*out, raw[at:]]).decode()


#: Text that a task holds while it goes through several blocks.
GROUP_BYTES = 32 << 20


def _groups(pieces: Iterable[tuple[pa.RecordBatch, np.ndarray, np.ndarray]], limit: int) -> Iterator[list[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]]:
    """Chunks in lists of about so many bytes, at least one in each."""
    group, size = [], 0
    for piece in pieces:
        group.append(piece)
        size += len(piece[1])
        if size >= limit:
            yield group
            group, size = [], 0
    if group:
        yield group


def _marked(docs: DataFrame, benchmark: DataFrame, last) -> DataFrame:
    """Search every block; ``last`` turns (batch, text spans, items, first words, word borders) into the result of a chunk.

    One pass over the texts, however many blocks there are: each is a broadcast of its own, of which a task loads one at a time.
    With several, a task goes through a block for all chunks of a group before it takes the next one.
    """
    spark: SparkSession = docs.sparkSession
    shared = [spark.sparkContext.broadcast(b) for b in blocks(benchmark)]
    several = len(shared) > 1

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(chunks(batches, last.text), GROUP_BYTES if several else 1):
            hits: list[np.ndarray | None] = [None] * len(group)
            items: list[list[set]] = [[] for _ in group]
            borders: list[tuple] = [()] * len(group)
            for own in shared:
                for j, (_, data, offsets) in enumerate(group):
                    hit, first, _, found, ends = own.value.search(data, offsets)
                    hits[j] = hit if hits[j] is None else hits[j] | hit
                    items[j] = [set(x) for x in found] if not items[j] else [a.union(x) for a, x in zip(items[j], found)]
                    borders[j] = (first, *ends)
                if several and getattr(own, "_path", None) and hasattr(own, "_value"):
                    del own._value  # it is loaded again from the executor's copy for the next group
            for (rows, data, offsets), hit, found, (first, starts, ends) in zip(group, hits, items, borders):
                spans_ = [_spans_of(hit[a:b]) if hit[a:b].any() else [] for a, b in zip(first[:-1].tolist(), first[1:].tolist())]
                yield last(rows, data, offsets, first, starts, ends, spans_, [sorted(x) for x in found])

    return docs.mapInArrow(run, last.schema)


class _Digests:
    text = "text"
    schema = "id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"

    def __call__(self, rows, data, offsets, first, starts, ends, spans_, items):
        hits = [sum(s[1::2]) - sum(s[::2]) for s in spans_]
        sha = [hashlib.sha256(",".join(x).encode()).hexdigest() for x in items]
        return pa.RecordBatch.from_arrays(
            [rows.column(0), pa.array(np.diff(first)), pa.array(hits, pa.int64()), pa.array([len(x) for x in items], pa.int64()), pa.array(sha, pa.string()), pa.array([h > 0 for h in hits], pa.bool_())],
            names=["id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
        )


class _Cleaned:
    def __init__(self, schema, text: str, at: int, length: int | None):
        self.schema, self.text, self.at, self.length = schema, text, at, length

    def __call__(self, rows, data, offsets, first, starts, ends, spans_, items):
        out = list(rows.columns[: len(self.schema)])
        raw, old = data.tobytes(), out[self.at].to_pylist()
        for i, s in enumerate(spans_):
            if s:
                a, b = first[i], first[i + 1]
                old[i] = _unhit(raw[offsets[i] : offsets[i + 1]], starts[a:b] - offsets[i], ends[a:b] - offsets[i], s)
        out[self.at] = pa.array(old, out[self.at].type)
        if self.length is not None:
            size = out[self.length].to_pylist()
            out[self.length] = pa.array([len(t) if s else n for t, s, n in zip(old, spans_, size)], out[self.length].type)
        return pa.RecordBatch.from_arrays(out, names=[f.name for f in self.schema])


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(id, n_words, n_hit, n_items, items_sha256, contaminated) for each row of ``docs``.

    Null or empty texts have no words and no hits; so have all texts if the benchmark has no words. A very long
    text is a shard of its own; other columns of ``docs`` are not read.
    Repeated rows and null ids get a result like any other. Items with a null id hit words but aren't
    counted or listed; several items with one id are one item.
    """
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return _marked(own, benchmark.select(F.col(item_col).alias("item_id"), F.col(item_text_col).alias("text")), _Digests())


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", length_col: str | None = None, item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """``docs`` without the benchmark's passages: every merged span of hit words is cut from its text.

    All rows and columns stay, whatever the columns are called; texts without hits, null and empty ones too, are
    unchanged. A very long text is a shard of its own.
    """
    renamed = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))
    at = docs.columns.index(text_col)
    last = _Cleaned(renamed.schema, f"c{at}", at, docs.columns.index(length_col) if length_col else None)
    return _marked(renamed, benchmark.select(F.col(item_col).alias("item_id"), F.col(item_text_col).alias("text")), last).toDF(*docs.columns)
