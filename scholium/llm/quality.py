"""Document quality by gradient-boosted trees over statistics of a text.

The statistics (lengths, shares of kinds of characters, words and lines, repetition) are computed from whole texts by array
operations. Training puts each statistic into at most 255 bins with about equally many rows, and grows trees leaf-wise from
histograms of gradients and second derivatives of the logistic loss; a child's histogram is its parent's less its sibling's.
The trees are flattened into arrays of features, thresholds and children, which scoring walks for all rows of a chunk at once.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import toxicity
from .common import stored, sweep
from .ragged import LETTER, NUMBER, SPACE, chunks, classes, codepoints, slice_hashes, spans

BINS = 255
TREES, LEAVES, RATE, LEAST_ROWS, RIDGE = 120, 12, 0.1, 20, 1.0
PREDICT_FROM = 0.5

#: The statistics in order. Shares are of all characters, words or lines of the text; nothing of an empty text is 0.
STATISTICS = (
    "log_characters", "log_words", "log_lines", "words_a_line", "word_length", "word_length_spread", "longest_word",
    "letters", "digits", "spaces", "others", "capitals", "commas_stops", "commonest_other", "symbols_run",
    "distinct_words", "commonest_word", "distinct_lines", "repeated_pairs", "repeated_fives",
    "words_all_capitals", "words_first_capital", "words_without_letter", "words_mixed", "words_end_other", "words_end_repeated", "words_short",
    "lines_end_stop", "lines_short", "lines_start_other",
)


def _per(flags: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Sums over consecutive slices."""
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.float64 if flags.dtype.kind == "f" else np.int64)])
    return total[cuts[1:]] - total[cuts[:-1]]


def _share(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a / np.maximum(b, 1)


def _kinds(names: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """For each of n texts the number of different names and how often its commonest one occurs."""
    if not len(names):
        return np.zeros(n), np.zeros(n)
    order = np.lexsort((names, owner))
    a, o = names[order], owner[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (o[1:] != o[:-1])
    at = np.flatnonzero(new)
    size = np.diff(np.append(at, len(a)))
    most = np.zeros(n)
    np.maximum.at(most, o[at], size)
    return np.bincount(o[at], minlength=n).astype(float), most


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Rows of STATISTICS for each text of a chunk."""
    n = len(offsets) - 1
    flat, cuts = codepoints(data, offsets)
    kind = classes()[flat]
    chars = np.diff(cuts)
    letter, space = kind == LETTER, kind == SPACE
    other = ~letter & ~space & (kind != NUMBER)
    capital = letter & _upper()[flat]
    starts, ends = spans(~space, cuts)
    first = np.searchsorted(starts, cuts)
    words, size = np.diff(first), ends - starts
    owner = np.repeat(np.arange(n), words)
    names = slice_hashes(flat, starts, ends)[0]
    line_starts, line_ends = spans(flat != 10, cuts)
    line_first = np.searchsorted(line_starts, cuts)
    lines = np.diff(line_first)
    line_owner = np.repeat(np.arange(n), lines)
    line_names = slice_hashes(flat, line_starts, line_ends)[0]

    of_words = lambda flags: _share(_per(flags, first), words)
    of_lines = lambda flags: _share(_per(flags, line_first), lines)
    of_chars = lambda flags: _share(_per(flags, cuts), chars)
    count = lambda flags: np.concatenate([[0], np.cumsum(flags)])
    inside = lambda total: total[ends] - total[starts]
    letters, capitals = inside(count(letter)), inside(count(capital))
    mean = _share(_per(size, first), words)
    spread = np.sqrt(np.maximum(0, _share(_per(size.astype(float) ** 2, first), words) - mean**2))
    longest = np.zeros(n)
    np.maximum.at(longest, owner, size)
    distinct, commonest = _kinds(names, owner, n)
    at = np.flatnonzero(other)
    char_owner = np.repeat(np.arange(n), chars)
    _, most_other = _kinds(flat[at], char_owner[at], n)
    run = np.zeros(len(flat), bool)
    run[1:] = other[1:] & (flat[1:] == flat[:-1]) & (char_owner[1:] == char_owner[:-1])

    def repeated(width: int) -> np.ndarray:
        """The share of windows of so many words that don't occur for the first time in the text."""
        begin = np.flatnonzero(np.arange(len(starts)) + width <= first[owner + 1]) if len(starts) else np.zeros(0, np.int64)
        total = np.bincount(owner[begin], minlength=n) if len(begin) else np.zeros(n)
        kinds, _ = _kinds(slice_hashes(names, begin, begin + width)[0], owner[begin], n)
        return _share(total - kinds, total)

    last, before = (flat[ends - 1], flat[np.maximum(ends - 2, starts)]) if len(ends) else (np.zeros(0), np.zeros(0))
    line_last = flat[line_ends - 1] if len(line_ends) else np.zeros(0)
    stops = np.array([ord(c) for c in ".!?"])
    columns = (
        np.log1p(chars), np.log1p(words), np.log1p(lines), _share(words, lines), mean, spread, longest,
        of_chars(letter), of_chars(kind == NUMBER), of_chars(space), of_chars(other), _share(_per(capital, cuts), _per(letter, cuts)), of_chars((flat == 44) | (flat == 46)), _share(most_other, chars), of_chars(run),
        _share(distinct, words), _share(commonest, words), _share(_kinds(line_names, line_owner, n)[0], lines), repeated(2), repeated(5),
        of_words((letters > 1) & (capitals == letters)), of_words(capital[starts] if len(starts) else size > 0), of_words(letters == 0), of_words((letters > 0) & (letters < size)),
        of_words(other[ends - 1] if len(ends) else size > 0), of_words((size > 1) & (last == before)), of_words(size <= 2),
        of_lines(np.isin(line_last, stops)), of_lines(line_ends - line_starts < 20), of_lines(other[line_starts] if len(line_starts) else line_ends > 0),
    )
    return np.stack([np.asarray(c, np.float64) for c in columns], axis=1)


_uppercase: list[np.ndarray] = []


def _upper() -> np.ndarray:
    """Which code points are upper-case letters."""
    if not _uppercase:
        _uppercase.append(np.array([chr(c).isupper() if not 0xD800 <= c < 0xE000 else False for c in range(0x110000)]))
    return _uppercase[0]


@dataclass
class Trees:
    """All trees in one set of arrays. A node sends a row left if its statistic is at most the threshold; leaves (feature -1) hold what they add."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """The chance of label 1 for each row of statistics."""
        at = np.broadcast_to(self.roots, (len(x), len(self.roots))).copy()
        row = np.arange(len(x))[:, None]
        while len(x) and len(self.roots):
            f = self.feature[at]
            inner = f >= 0
            if not inner.any():
                break
            below = x[row, np.maximum(f, 0)] <= self.threshold[at]
            at = np.where(inner, np.where(below, self.left[at], self.right[at]), at)
        return 1 / (1 + np.exp(-(self.base + self.value[at].sum(axis=1))))


def _edges(column: np.ndarray) -> np.ndarray:
    """Thresholds between bins: quantiles of the different values, so that each row that ties with another shares its bin."""
    values = np.unique(column)
    if len(values) > BINS:
        values = np.unique(np.quantile(column, np.linspace(0, 1, BINS + 1)[1:-1], method="lower"))
        return values
    return (values[1:] + values[:-1]) / 2


def boost(x: np.ndarray, y: np.ndarray, trees: int = TREES, leaves: int = LEAVES, rate: float = RATE, least_rows: int = LEAST_ROWS) -> Trees:
    """Trees for labels y (0 or 1) of rows x. Both labels weigh half of the whole. Equal gains go to the first statistic and lowest threshold."""
    n, d = x.shape
    edges = [_edges(x[:, j]) for j in range(d)]
    binned = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)], axis=1) + np.arange(d) * (BINS + 1)
    weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum())) * n
    raw = np.zeros(n)
    feature, threshold, left, right, value, roots = [], [], [], [], [], []

    def histogram(rows: np.ndarray) -> np.ndarray:
        flat = binned[rows].ravel()
        return np.stack([np.bincount(flat, np.repeat(v[rows], d), d * (BINS + 1)).reshape(d, -1) for v in (g, h, np.ones(n))])

    def best(hist: np.ndarray) -> tuple[float, int, int]:
        below = hist.cumsum(axis=2)[:, :, :-1]
        all_ = hist[:, :1, :].sum(axis=2, keepdims=True)
        above = all_ - below
        gain = below[0] ** 2 / (below[1] + RIDGE) + above[0] ** 2 / (above[1] + RIDGE) - all_[0] ** 2 / (all_[1] + RIDGE)
        gain = np.where((below[2] >= least_rows) & (above[2] >= least_rows), gain, 0.0)
        at = int(gain.argmax())
        return float(gain.flat[at]), *divmod(at, BINS)

    def node(rows: np.ndarray) -> int:
        feature.append(-1)
        threshold.append(0.0)
        left.append(-1)
        right.append(-1)
        value.append(-rate * g[rows].sum() / (h[rows].sum() + RIDGE))
        return len(feature) - 1

    for _ in range(trees):
        q = 1 / (1 + np.exp(-raw))
        g, h = weight * (q - y), weight * q * (1 - q)
        everything = np.arange(n)
        roots.append(node(everything))
        hist = histogram(everything)
        open_ = [(best(hist), roots[-1], everything, hist)]
        for _ in range(leaves - 1):
            k = max(range(len(open_)), key=lambda i: open_[i][0][0])
            (gain, f, b), at, rows, hist = open_[k]
            if gain <= 1e-9:
                break
            low = binned[rows, f] - f * (BINS + 1) <= b
            parts = rows[low], rows[~low]
            small = histogram(min(parts, key=len))
            hists = (small, hist - small) if len(parts[0]) <= len(parts[1]) else (hist - small, small)
            feature[at], threshold[at], value[at] = f, float(edges[f][b]), 0.0
            left[at], right[at] = node(parts[0]), node(parts[1])
            open_[k] = (best(hists[0]), left[at], parts[0], hists[0])
            open_.append((best(hists[1]), right[at], parts[1], hists[1]))
        for _, at, rows, _ in open_:
            raw[rows] += value[at]
    as_int = lambda v: np.array(v, np.int32)
    return Trees(as_int(feature), np.array(threshold), as_int(left), as_int(right), np.array(value), as_int(roots), 0.0)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Trees:
    """Fit on about toxicity.SAMPLE_PER_CLASS labelled rows of either label, none of them held out, by their whole texts.

    The sample is drawn by a hash of id and text and its statistics are computed in tasks; only those come to the driver. Null ids,
    texts and labels are left out, repeated rows count once; an id with several labels counts as 1 if one of them is 1.
    Without rows of both labels every score is 0.5.
    """
    spark, before = docs.sparkSession, stored()
    sample = toxicity.sampled(docs, labels, id_col, text_col, label_col)

    def measure(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in chunks(batches, "text"):
            x = statistics(data, offsets)
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64()))], names=["key", "y", "x"])

    seen = sample.select("key", "y", "text").mapInArrow(measure, "key long, y int, x array<double>").toPandas().sort_values(["key", "y"])
    sweep(spark, [p for p in stored() if p not in before])
    y = (seen.y.to_numpy() == 1).astype(float)
    if not len(y) or y.min() == y.max():
        return Trees(*(np.zeros(0, t) for t in (np.int32, float, np.int32, np.int32, float, np.int32)), 0.0)
    return boost(np.stack(seen.x.to_list()), y, least_rows=min(LEAST_ROWS, max(1, len(y) // 20)))


def score(docs: DataFrame, model: Trees, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score, predicted) for each row, by its whole text: the chance that its label is 1, and whether it is PREDICT_FROM or more.

    A null text is empty; an empty one is scored by its statistics, all of them 0. Repeated rows and null ids get a result like any other.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for rows, data, offsets in chunks(batches, "text", 2 << 20):
            chance = own.score(statistics(data, offsets))
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(chance), pa.array((chance >= PREDICT_FROM).astype(np.int32))], names=["id", "score", "predicted"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id long, score double, predicted int")
