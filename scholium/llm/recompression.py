"""Repeated passages, found by locally consistent recompression of word sequences.

A word's name is a hash of it. Rounds then rename: a run of equal symbols becomes one symbol, and
a pair of neighbours becomes one where the first's role in that round is left and the second's is
right. Roles and new names are functions of the old names alone, so every task names equal content
equally, without a shared dictionary, and equal substrings get equal symbols inside, away from
their ends. With each symbol goes its context: the words on which its existence depends. A window
that holds a symbol's whole context holds that symbol wherever it occurs.

So a window with a symbol that occurs once in the corpus occurs once. Spark counts the names of the
high-level symbols; documents that share some, or that have windows without any certain symbol, are
joined with them, and only windows without a unique symbol are verified by 95 bits of hash over all
their words; a whole text counts as a copy by as many bits. Both counts treat frequent content alike: within a chunk of documents a content is
reported once and its other occurrences, known to be repeats by then, travel by document.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import HOT_SHARE, materialize
from .ragged import CHUNK_BYTES, chunks, mix, slice_hashes, spans

WINDOW = 20
ROUNDS = 3
LEAST_SPAN = 3
_K1, _K2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words (whatever isn't \\x20 or \\x09-\\x0D), and each text's first word."""
    starts, ends = spans((data != 32) & ((data < 9) | (data > 13)), offsets)
    return starts, ends, np.searchsorted(starts, offsets)


@dataclass
class Parse:
    """Symbols over words [a, b) whose existence depends on words [ca, cb); a text's border is outside."""

    name: np.ndarray
    a: np.ndarray
    b: np.ndarray
    ca: np.ndarray
    cb: np.ndarray
    doc: np.ndarray


def _collapse(p: Parse, head: np.ndarray, name: np.ndarray, ca: np.ndarray, cb: np.ndarray) -> Parse:
    """One symbol for each run that starts at a head."""
    at = np.flatnonzero(head)
    last = np.append(at[1:], len(head)) - 1
    return Parse(name[at], p.a[at], p.b[last], np.minimum.reduceat(ca, at), np.maximum.reduceat(cb, at), p.doc[at])


def _round(p: Parse, first: np.ndarray, level: int) -> Parse:
    n = len(p.name)
    same = np.zeros(n + 1, bool)  # same[i]: symbols i-1 and i are of one text
    same[1:n] = p.doc[1:] == p.doc[:-1]
    before_ca, after_cb = first[p.doc] - 1, first[p.doc + 1] + 1  # beyond the border: in no window
    before_ca[1:] = np.where(same[1:n], p.ca[:-1], before_ca[1:])
    after_cb[:-1] = np.where(same[1:n], p.cb[1:], after_cb[:-1])
    if level == 0:  # runs: each symbol depends on both neighbours being others
        head = np.ones(n, bool)
        head[1:] = ~same[1:n] | (p.name[1:] != p.name[:-1])
        count = np.diff(np.append(np.flatnonzero(head), n)).astype(np.uint64)
        long = np.repeat(count, count.astype(np.int64))
        name = np.where(long > 1, mix(p.name * _K1 + long * _K2), p.name)
        return _collapse(p, head, name, before_ca, after_cb)
    left = (mix(p.name + np.uint64((level * int(_K2)) & (2**64 - 1))) & np.uint64(1)).astype(bool)
    joins = np.zeros(n, bool)  # i is taken up by i-1
    joins[1:] = same[1:n] & left[:-1] & ~left[1:]
    taken = np.zeros(n, bool)
    taken[:-1] = joins[1:]
    name = p.name.copy()
    at = np.flatnonzero(taken)
    name[at] = mix(p.name[at] * _K1 + p.name[at + 1] * _K2 + np.uint64(level))
    alone = ~joins & ~taken
    ca = np.where(alone & ~left, np.minimum(p.ca, before_ca), p.ca)
    cb = np.where(alone & left, np.maximum(p.cb, after_cb), p.cb)
    return _collapse(p, ~joins, name, ca, cb)


def parse(names: np.ndarray, first: np.ndarray, rounds: int = ROUNDS) -> Parse:
    """Recompress the word names of many texts at once; ``first`` holds each text's first word and the end."""
    n = len(names)
    at = np.arange(n, dtype=np.int64)
    p = Parse(names, at, at + 1, at, at + 1, np.repeat(np.arange(len(first) - 1), np.diff(first)))
    for level in range(rounds + 1 if n else 0):
        p = _round(p, first, level)
    return p


def certain(p: Parse, window: int = WINDOW, least_span: int = LEAST_SPAN) -> np.ndarray:
    """Which symbols some window holds with their whole context."""
    return np.flatnonzero((p.cb - p.ca <= window) & (p.b - p.a >= least_span))


_LOWEST = -(2**63)


def _names(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    starts, ends, first = word_spans(data, offsets)
    return slice_hashes(data, starts, ends)[0], first, starts, ends


def _first_of_each(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For rows with keys (most significant first, then in row order): which is the first of its kind, and how many are of its kind."""
    order = np.lexsort(keys[::-1])
    new = np.ones(len(order), bool)
    new[1:] = np.any([k[order][1:] != k[order][:-1] for k in keys], axis=0)
    size = np.diff(np.append(np.flatnonzero(new), len(order)))
    first, many = np.zeros(len(order), bool), np.zeros(len(order), np.int64)
    first[order[new]] = True
    many[order] = np.repeat(size, size)
    return first, many


def _once(batches: Iterable[pa.RecordBatch], limit: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Chunks without the rows whose id and hash an earlier row of the chunk has: such rows are one place."""
    for rows, data, offsets in chunks(batches, "text", limit):
        first, _ = _first_of_each(*(rows.column(i).to_numpy(zero_copy_only=False) for i in (0, 1)))
        if first.all():
            yield rows, data, offsets
        else:
            yield from chunks([rows.filter(pa.array(first))], "text", limit)


def _symbols(batches: Iterable[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """Rows (route, id, h, what) for each certain symbol and each whole text; what is 4 ix + known (ix below 0: bits of a text's second hash).

    Rows of one name have one route; a name seen twice in the chunk sends one row with known = 2 there,
    and its other rows, known = 1, go anywhere.
    """
    schema = pa.schema([("route", pa.int64()), ("id", pa.int64()), ("h", pa.int64()), ("what", pa.int64())])
    for rows, data, offsets in _once(batches):
        names, first, _, _ = _names(data, offsets)
        p = parse(names, first)
        at = certain(p, window)
        ids = rows.column(0).to_numpy(zero_copy_only=False)
        hs = rows.column(1).to_numpy(zero_copy_only=False)
        ix = np.arange(len(at)) - np.searchsorted(p.doc[at], np.arange(len(first)))[p.doc[at]] if len(at) else at
        lead, many = _first_of_each(p.name[at])
        spread = mix(p.doc[at].astype(np.uint64) + np.arange(len(at), dtype=np.uint64) * _K1)
        route = np.where(lead, p.name[at], spread)
        known = np.where(many == 1, 0, np.where(lead, 2, 1))
        # whole texts with at least one window: earlier ones first, so that those known here are copies
        full = np.flatnonzero(np.diff(first) >= window)
        full = full[np.lexsort((hs[full], ids[full]))]
        whole, second = slice_hashes(names, first[full], first[full + 1])
        second = -1 - (second & np.uint64(0x7FFFFFFF)).astype(np.int64)
        lead, _ = _first_of_each(whole, second)
        twin = np.zeros(len(full), bool)  # rows of the same id aren't copies of each other: leave those to Spark
        twin[1:] = ids[full][1:] == ids[full][:-1]
        lead |= twin
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.concatenate([route, np.where(lead, whole, mix(whole + full.astype(np.uint64)))]).view(np.int64)),
                pa.array(np.concatenate([ids[p.doc[at]], ids[full]])),
                pa.array(np.concatenate([hs[p.doc[at]], hs[full]])),
                pa.array(np.concatenate([ix, second]) * 4 + np.concatenate([known, np.where(lead, 0, 1)])),
            ],
            schema=schema,
        )


def _repeated(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows in order (route, whole text or not, id, h): symbols that occur elsewhere, and whole texts that an earlier one equals.

    A group's last row is held until the next batch shows whether the group goes on.
    """
    schema = pa.schema([("id", pa.int64()), ("h", pa.int64()), ("ix", pa.int32())])
    waiting: tuple | None = None  # route, id, h, ix, known of the last row so far, and whether it is known to be repeated
    lead: tuple | None = None  # route, second hash and id of the first whole text of the last group
    for rows in batches:
        if not rows.num_rows:
            continue
        route, ids, hs, what = (rows.column(i).to_numpy(zero_copy_only=False) for i in range(4))
        ix, known = (what >> 2).astype(np.int32), what & 3
        if waiting is not None:
            route, ids, hs, ix, known = (np.concatenate([[w], x]).astype(x.dtype) for w, x in zip(waiting, (route, ids, hs, ix, known)))
        whole, kind = ix < 0, np.minimum(ix, 0)
        same = np.zeros(len(route) + 1, bool)
        same[1:-1] = (route[1:] == route[:-1]) & (kind[1:] == kind[:-1])
        symbol = ~whole & (same[1:] | same[:-1] | (known > 0))
        start = np.maximum.accumulate(np.where(same[:-1], 0, np.arange(len(route))))
        lead_id = ids[start]
        if lead is not None and whole[0] and lead[:2] == (route[0], ix[0]):
            lead_id = np.where(start == 0, lead[2], lead_id)
        copy = whole & ((ids > lead_id) | (known > 0))
        out = symbol | copy
        # the last row: known to be repeated if its group has begun before it, else it waits
        last = len(route) - 1
        if not whole[last] and not out[last]:
            waiting = tuple(x[last].item() for x in (route, ids, hs, ix, known))
        elif not whole[last]:
            waiting = (route[last].item(), ids[last].item(), hs[last].item(), ix[last].item(), 2)
        else:
            waiting = None
        lead = (route[last], ix[last], lead_id[last]) if whole[last] else None
        out[last] &= whole[last]
        yield pa.RecordBatch.from_arrays([pa.array(x[out]) for x in (ids, hs, ix)], schema=schema)
    if waiting is not None and waiting[4] > 0:
        yield pa.RecordBatch.from_arrays([pa.array([waiting[i]], schema.field(i - 1).type) for i in (1, 2, 3)], schema=schema)


def _windows(batches: Iterable[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """Rows (route, at, id, h, known) for the windows to verify: those without a symbol that occurs once; at is check * 2^32 + pos.

    Of equal windows in a chunk only the earliest is sent; the others are known to be repeats and go as
    one list for each text (at -1). A text that an earlier one equals has nothing to verify, nor has one whose
    id and hash the task has seen before.
    """
    schema = pa.schema([("route", pa.int64()), ("at", pa.int64()), ("id", pa.int64()), ("h", pa.int64()), ("known", pa.list_(pa.int32()))])
    met: set[tuple[int, int]] = set()  # all rows of an id and hash are in few tasks: without this each would send its windows
    for rows, data, offsets in _once(batches):
        names, first, _, _ = _names(data, offsets)
        p = parse(names, first)
        at = certain(p, window)
        begin = np.searchsorted(p.doc[at], np.arange(len(first))) if len(at) else np.zeros(len(first), np.int64)
        seen = rows.column(rows.schema.get_field_index("seen"))
        size = np.array([len(x) if x.is_valid else 0 for x in seen], np.int64)
        which = seen.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        owner = np.repeat(np.arange(len(size)), size)
        ids = rows.column(0).to_numpy(zero_copy_only=False)
        hs = rows.column(1).to_numpy(zero_copy_only=False)
        skip = np.zeros(len(size), bool)
        skip[owner[which < 0]] = True
        often = np.zeros(len(at), bool)
        often[begin[owner[which >= 0]] + which[which >= 0]] = True
        alone = at[~often]
        change = np.zeros(len(names) + 1, np.int64)  # windows with a symbol that occurs once start in [cb - window, ca]
        np.add.at(change, np.maximum(p.cb[alone] - window, first[p.doc[alone]]), 1)
        np.add.at(change, p.ca[alone] + 1, -1)
        doc = np.repeat(np.arange(len(size)), np.diff(first))
        open_ = (np.cumsum(change)[:-1] == 0) & (np.arange(len(names)) + window <= first[doc + 1]) & ~skip[doc]
        for i in np.unique(doc[open_]).tolist():
            key = (int(ids[i]), int(hs[i]))
            skip[i] = key in met
            met.add(key)
        pos = np.flatnonzero(open_ & ~skip[doc])
        doc = doc[pos]
        order = np.lexsort((pos, ids[doc]))
        pos, doc = pos[order], doc[order]
        route, check = slice_hashes(names, pos, pos + window)
        check = (check & np.uint64(0x7FFFFFFF)).astype(np.int32)
        lead, _ = _first_of_each(route, check)
        local = (pos - first[doc]).astype(np.int32)
        # what is known: equal windows that start later; one that starts alike, in a row with the same id, isn't a repeat
        tie = ~lead
        if tie.any():
            group = np.lexsort((check, route))
            new = np.ones(len(group), bool)
            new[1:] = (route[group][1:] != route[group][:-1]) | (check[group][1:] != check[group][:-1])
            head = np.empty(len(group), np.int64)
            head[group] = group[np.maximum.accumulate(np.where(new, np.arange(len(group)), 0))]
            twin = tie & (ids[doc] == ids[doc[head]]) & (local == local[head])
            lead |= twin
        known = np.flatnonzero(~lead)
        known = known[np.argsort(doc[known], kind="stable")]
        cut = np.flatnonzero(np.concatenate([[True], doc[known][1:] != doc[known][:-1]])) if len(known) else known
        lists = pa.ListArray.from_arrays(pa.array(np.append(cut, len(known)).astype(np.int32)), pa.array(local[known]))
        of = doc[known][cut]
        n = int(lead.sum())
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.concatenate([route[lead], mix(of.astype(np.uint64) + route[known][cut])]).view(np.int64)),
                pa.array(np.concatenate([(check[lead].astype(np.int64) << 32) | local[lead], np.full(len(of), -1, np.int64)])),
                pa.array(np.concatenate([ids[doc[lead]], ids[of]])),
                pa.array(np.concatenate([hs[doc[lead]], hs[of]])),
                pa.concat_arrays([pa.nulls(n, schema.field("known").type), lists]),
            ],
            schema=schema,
        )


def _later(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows in order (route, check, id, pos): windows that an equal one precedes, and the lists of known ones."""
    schema = pa.schema([("id", pa.int64()), ("h", pa.int64()), ("pos", pa.list_(pa.int32()))])
    lead: tuple | None = None
    for rows in batches:
        if not rows.num_rows:
            continue
        route, at, ids, hs = (rows.column(i).to_numpy(zero_copy_only=False) for i in range(4))
        check, pos = at >> 32, (at & 0xFFFFFFFF).astype(np.int32)
        same = np.zeros(len(route), bool)
        same[1:] = (route[1:] == route[:-1]) & (check[1:] == check[:-1])
        start = np.maximum.accumulate(np.where(same, 0, np.arange(len(route))))
        lead_id, lead_pos = ids[start], pos[start]
        if lead is not None and lead[:2] == (route[0], check[0]):
            lead_id, lead_pos = np.where(start == 0, lead[2], lead_id), np.where(start == 0, lead[3], lead_pos)
        lead = (route[-1], check[-1], lead_id[-1], lead_pos[-1])
        out = np.flatnonzero((check >= 0) & ((ids > lead_id) | (pos > lead_pos)))
        lists = np.flatnonzero(check < 0)
        one = pa.ListArray.from_arrays(pa.array(np.arange(len(out) + 1, dtype=np.int32)), pa.array(pos[out]))
        both = np.concatenate([out, lists])
        yield pa.RecordBatch.from_arrays([pa.array(ids[both]), pa.array(hs[both]), pa.concat_arrays([one, rows.column(4).take(pa.array(lists))])], schema=schema)


def _covered(starts: np.ndarray, n: int, window: int) -> np.ndarray:
    """Which of n words a window at one of the starts covers."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, np.minimum(starts + window, n), -1)
    return np.cumsum(change)[:-1] > 0


def with_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """Rows (id, h, text, c0, c1, ..., copy, pos): each row of ``docs``, its other columns renamed in order.

    pos lists the starts (in words) of windows whose words also start earlier, in a row with a smaller id
    or in the same row; null if none. copy: an earlier text equals this one, so that all of its windows
    repeat; they aren't listed. A null id counts as the smallest. Rows are told apart by id and a hash of 64 bits of their
    text: rows that agree in both are taken for equal, so two unlike texts are confused only if they share an id and a hash
    (odds of 1 in 10^7 for a million rows of one id).
    """
    own = [F.coalesce(F.col(id_col).cast("long"), F.lit(_LOWEST)).alias("id"), F.xxhash64(F.col(text_col)).alias("h"), F.col(text_col).alias("text")]
    rest = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns) if c != text_col]
    hot = _hot(docs.select(*own[:2]))
    salted = docs.select(*own, *rest).join(F.broadcast(hot), ["id", "h"], "left")
    salt = F.when(F.col("salts").isNull(), 0).otherwise(F.pmod(F.spark_partition_id(), F.col("salts"))).cast("int")
    texts = salted.withColumn("salt", salt).drop("salts").repartition("id", "h", "salt")  # moved once: both joins below read it
    each = lambda found: found.join(F.broadcast(hot), ["id", "h"], "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1))).drop("salts")
    symbols = docs.select(*own).mapInArrow(lambda it: _symbols(it, window), "route long, id long, h long, what long")
    seen = symbols.repartition("route").sortWithinPartitions("route", F.least(F.shiftright("what", 2), F.lit(0)), "id").mapInArrow(_repeated, "id long, h long, ix int")
    # stored: both joins below read it, and Spark would otherwise parse all texts once for each
    seen = materialize(seen.groupBy("id", "h").agg(F.collect_list("ix").alias("seen")), "repeated-symbols")
    marked = texts.join(each(seen).hint("shuffle_hash"), ["id", "h", "salt"], "left")
    windows = marked.select("id", "h", "text", "seen").mapInArrow(lambda it: _windows(it, window), "route long, at long, id long, h long, known array<int>")
    later = windows.repartition("route").sortWithinPartitions("route", F.shiftright("at", 32), "id", "at").mapInArrow(_later, "id long, h long, pos array<int>")
    later = each(later.groupBy("id", "h").agg(F.flatten(F.collect_list("pos")).alias("pos"))).hint("shuffle_hash")
    return marked.withColumn("copy", F.coalesce(F.exists("seen", lambda x: x < 0), F.lit(False))).drop("seen").join(later, ["id", "h", "salt"], "left").drop("salt")


def _hot(keys: DataFrame) -> DataFrame:
    """(id, h, salts), stored: keys of over a HOT_SHARE-th of all rows, fewer than HOT_SHARE, and over how many tasks to spread their rows."""
    limit = keys.count() // HOT_SHARE + 1
    found = keys.groupBy("id", "h").count().where(F.col("count") > limit)
    return materialize(found.select("id", "h", F.ceil(F.col("count") / limit).cast("int").alias("salts")), "hot-rows")


def _removed(rows: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray, window: int) -> Iterator[tuple[np.ndarray, list[bytes]]]:
    """For each row: which words go, and the words."""
    starts, ends, first = word_spans(data, offsets)
    raw = data.tobytes()
    copy = rows.column(rows.schema.get_field_index("copy")).to_pylist()
    pos = rows.column(rows.schema.get_field_index("pos"))
    for i, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist())):
        gone = np.ones(b - a, bool) if copy[i] else np.zeros(b - a, bool)
        if not copy[i] and pos[i].is_valid:
            gone = _covered(pos[i].values.to_numpy(zero_copy_only=False).astype(np.int64), b - a, window)
        keep = ~gone
        yield gone, [raw[s:e] for s, e in zip(starts[a:b][keep].tolist(), ends[a:b][keep].tolist())]


def repeat_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """(id, n_words, n_removed, kept_sha256) for each row, null ids and repeated rows included.

    A word is removed if a window of ``window`` words that covers it also starts earlier: in a row with a
    smaller id, or earlier in the row. Rows that share an id count as one place: none of their windows
    at equal starts precedes another. A null or empty text has no words; kept words are joined by a space.
    """
    schema = pa.schema([("id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in chunks(batches, "text"):
            out = [(len(gone), int(gone.sum()), hashlib.sha256(b" ".join(kept)).hexdigest()) for gone, kept in _removed(rows, data, offsets, window)]
            n, removed, sha = zip(*out)
            ids = rows.column(0).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64(), mask=ids == _LOWEST), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(sha, pa.string())], schema=schema)

    own = docs.select(F.col(text_col).alias("text"), F.col(id_col).cast("long").alias("id"))
    found = with_repeats(own.select("text", F.col("id").alias("key")), "key", "text", window)
    return found.select("id", "text", "copy", "pos").mapInArrow(run, "id long, n_words long, n_removed long, kept_sha256 string")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = None, window: int = WINDOW) -> DataFrame:
    """``docs`` with repeated words removed; all columns in their order.

    A text that loses words becomes its kept words joined by a space (and ``length_col`` their code
    points); one that loses all of its words goes. Other texts, null and empty ones too, are unchanged.
    """
    at = docs.columns.index(text_col)
    length = docs.columns.index(length_col) if length_col else None
    found = with_repeats(docs, id_col, text_col, window)
    cols = [f"c{i}" if i != at else "text" for i in range(len(docs.columns))]
    shaped = found.select(*cols).schema

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in chunks(batches, "text"):
            new = [(gone.any(), b" ".join(kept).decode()) for gone, kept in _removed(rows, data, offsets, window)]
            out = [rows.column(i) for i in range(len(cols))]
            out[at] = pa.array([t if changed else old for (changed, t), old in zip(new, out[at].to_pylist())], out[at].type)
            if length is not None:
                out[length] = pa.array([len(t) if changed else old for (changed, t), old in zip(new, out[length].to_pylist())], out[length].type)
            stay = pa.array([not changed or t != "" for changed, t in new], pa.bool_())
            yield pa.RecordBatch.from_arrays(out, names=cols).filter(stay)

    return found.select(*cols, "copy", "pos").mapInArrow(run, shaped).toDF(*docs.columns)
