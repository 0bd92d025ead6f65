"""Document fingerprints by content-defined chunking.

A gear hash rolls over a text's bytes. A chunk ends where the hash meets a mask: a strict one before the
normal length, a loose one after it, and never before the least nor after the greatest length. Since the
hash sees only the last bytes, an insertion or cut changes the chunks beside it and no others. The
fingerprint is the set of the chunks' digests with their lengths; the likeness of two fingerprints is
the length of shared chunks as a share of the larger one: how much of the larger is contained.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ragged import slice_hashes
from .ranges import place, ranges

LEAST, NORMAL, GREATEST = 16, 48, 192
#: Bits of the 16-bit hash that must be zero: its highest depend on the most bytes.
STRICT, LOOSE = 0xFE00, 0xF000
DIGEST_BYTES = 5
PART_BYTES = 16 << 20
_BATCH_BYTES = 3 << 20
_LOWEST = -(2**63)
_GEAR = np.random.default_rng(2016).integers(0, 1 << 16, 256, dtype=np.uint16)


def boundaries(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ends of all chunks of all texts, and each text's number of chunks."""
    h = _GEAR[data]
    for step in (1, 2, 4, 8):
        shifted = np.zeros_like(h)
        shifted[step:] = h[:-step] << np.uint16(step)
        h = h + shifted
    loose = np.flatnonzero((h & np.uint16(LOOSE)) == 0) + 1  # a cut lies after the byte
    strict = loose[(h[loose - 1] & np.uint16(STRICT)) == 0]
    far = len(data) + GREATEST + 1

    def following(starts: np.ndarray) -> np.ndarray:
        """Where the chunk that begins at each start ends, as if the text went on."""
        a = np.append(strict, far)[np.searchsorted(strict, starts + LEAST)]
        b = np.append(loose, far)[np.searchsorted(loose, starts + NORMAL)]
        return np.where(a < starts + NORMAL, a, np.where(b < starts + GREATEST, b, starts + GREATEST))

    after = following(loose)
    place = np.searchsorted(loose, after)
    place[(place >= len(loose)) | (np.append(loose, -1)[np.minimum(place, len(loose))] != after)] = -1
    after_list, place_list, loose_list = after.tolist(), place.tolist(), loose.tolist()
    first = following(offsets[:-1]).tolist()
    index = {}
    ends: list[int] = []
    counts = []
    for start, end, cut in zip(offsets[:-1].tolist(), offsets[1:].tolist(), first):
        n = len(ends)
        if end > start:
            at = -1
            while cut < end:
                ends.append(cut)
                if at < 0:  # after a forced cut: is this one of the hash's places?
                    at = index.get(cut, -1)
                    if at < 0:
                        k = int(np.searchsorted(loose, cut))
                        at = k if k < len(loose_list) and loose_list[k] == cut else -1
                        index[cut] = at
                if at < 0:
                    cut = int(following(np.array([cut]))[0])
                else:
                    cut, at = after_list[at], place_list[at]
            ends.append(end)
        counts.append(len(ends) - n)
    return np.array(ends, np.int64), np.array(counts, np.int64)


class Fingerprints:
    """Chunk digest sets of a batch of texts."""

    def __init__(self, texts: list[bytes]):
        size = np.fromiter(map(len, texts), np.int64, len(texts))
        offsets = np.concatenate([[0], np.cumsum(size)])
        data = np.frombuffer(b"".join(texts), np.uint8)
        ends, counts = boundaries(data, offsets)
        owner = np.repeat(np.arange(len(texts)), counts)
        starts = np.empty_like(ends)
        starts[1:] = ends[:-1]
        starts[(np.cumsum(counts) - counts)[counts > 0]] = offsets[:-1][counts > 0]
        digest = slice_hashes(data, starts, ends)[0] >> np.uint64(64 - 8 * DIGEST_BYTES)
        order = np.lexsort((digest, owner))
        owner, digest, length = owner[order], digest[order], (ends - starts)[order]
        new = np.ones(len(order), bool)
        new[1:] = (owner[1:] != owner[:-1]) | (digest[1:] != digest[:-1])
        self.owner, self.digest, self.length = owner[new], digest[new], length[new]
        self.first = np.searchsorted(self.owner, np.arange(len(texts) + 1))
        self.total = np.bincount(self.owner, weights=self.length, minlength=len(texts))

    def strings(self) -> list[str]:
        """Digests in ascending order, each with its chunk's length in one byte, as hex."""
        raw = np.empty((len(self.digest), DIGEST_BYTES + 1), np.uint8)
        raw[:, :DIGEST_BYTES] = self.digest.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 8 - DIGEST_BYTES :]
        raw[:, DIGEST_BYTES] = self.length
        raw = raw.tobytes().hex()
        cut = (self.first * 2 * (DIGEST_BYTES + 1)).tolist()
        return [raw[a:b] for a, b in zip(cut, cut[1:])]

    def likeness(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For each pair of texts: the length of shared chunks over that of the larger set; 1 if both are empty."""

        def keyed(which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            n = self.first[which + 1] - self.first[which]
            begin = np.repeat(self.first[which] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            pair = np.repeat(np.arange(len(which), dtype=np.uint64), n)
            return (pair << np.uint64(8 * DIGEST_BYTES)) | self.digest[begin], begin

        ka, at = keyed(a)
        kb, _ = keyed(b)
        _, ia, _ = np.intersect1d(ka, kb, assume_unique=True, return_indices=True)
        shared = np.bincount((ka[ia] >> np.uint64(8 * DIGEST_BYTES)).astype(np.int64), weights=self.length[at[ia]], minlength=len(a))
        larger = np.maximum(self.total[a], self.total[b])
        return np.where(larger > 0, shared / np.maximum(larger, 1), 1.0)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint) for each row; a null or empty text has the empty fingerprint, equal texts equal ones."""
    from .ragged import chunks, texts

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in chunks(batches, "text", _BATCH_BYTES):
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(Fingerprints(texts(data, offsets)).strings(), pa.string())], names=["id", "fingerprint"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id long, fingerprint string")


def in_order_with_next(docs: DataFrame, id_col: str, text_col: str, part_bytes: int = PART_BYTES) -> DataFrame:
    """(part, carried, key, text): rows of a part in order, and after them the first row of the next part, carried.

    Parts are ranges of ids, and of a hash of the text where an id has very many rows; after the last part's rows
    comes the table's first row. Only ids and hashes are read to find the ranges, and each text is moved once.
    """
    own = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_LOWEST)).alias("key"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    own = own.withColumn("place", place())
    dealt = ranges(own, "key", "text", part_bytes)

    @F.pandas_udf("int")
    def part_of(key: pd.Series, at: pd.Series) -> pd.Series:
        return pd.Series(dealt.part(key.to_numpy(), at.to_numpy()))

    firsts = own.select("key", "place", part_of("key", "place").alias("part")).groupBy("part").agg(F.min(F.struct("key", "place")).alias("f"))
    least = {r.part: (r.f.key, r.f.place) for r in firsts.collect()}  # one row a part
    order = sorted(least)
    before = {p: order[i - 1] for i, p in enumerate(order)}  # the first part's first row goes to the last part

    @F.pandas_udf("int")
    def carried_to(key: pd.Series, at: pd.Series, part: pd.Series) -> pd.Series:
        return pd.Series([before[p] if (k, a) == least[p] else -1 for k, a, p in zip(key.tolist(), at.tolist(), part.tolist())], dtype="int32")

    placed = own.withColumn("p", part_of("key", "place")).withColumn("c", carried_to("key", "place", "p"))
    here = F.struct(F.col("p").alias("part"), F.lit(0).alias("carried"))
    both = F.when(F.col("c") < 0, F.array(here)).otherwise(F.array(here, F.struct(F.col("c").alias("part"), F.lit(1).alias("carried"))))
    placed = placed.select(F.explode(both).alias("to"), "key", "place", "text").select("to.part", "to.carried", "key", "place", "text")
    return placed.repartitionById(dealt.parts, "part").sortWithinPartitions("part", "carried", "key", "place", "text").drop("place")


def with_edited(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_bytes: int = PART_BYTES) -> DataFrame:
    """(id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) for each row.

    The edited text: the last floor(n_chars / 4) code points replaced by the first as many (or all) of the
    next text, in ascending order of id, then of a hash of the text; after the last comes the first, which may be the row
    itself. A null text is empty; a null id counts as the smallest.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def emit(jobs: list[tuple[int, str, str]]) -> pa.RecordBatch:
            # jobs: key, text, next text, where a job's next text is mostly the following job's text
            texts, nexts, edited = [], [], []
            for i, (_, text, then) in enumerate(jobs):
                texts.append(text.encode())
                k = len(text) // 4
                edited.append((text[: len(text) - k] + then[:k]).encode())
            extra: list[bytes] = []
            for i, (_, _, then) in enumerate(jobs):
                if i + 1 < len(jobs) and jobs[i + 1][1] is then:
                    nexts.append(i + 1)
                else:
                    nexts.append(2 * len(jobs) + len(extra))
                    extra.append(then.encode())
            prints = Fingerprints([*texts, *edited, *extra])
            strings = prints.strings()
            at, n = np.arange(len(jobs)), len(jobs)
            keys = np.array([j[0] for j in jobs], np.int64)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(keys, pa.int64(), mask=keys == _LOWEST),
                    pa.array([len(j[1]) for j in jobs], pa.int64()),
                    pa.array([hashlib.sha256(e).hexdigest() for e in edited], pa.string()),
                    pa.array(strings[:n], pa.string()),
                    pa.array(strings[n : 2 * n], pa.string()),
                    pa.array(prints.likeness(at, at + n)),
                    pa.array(prints.likeness(at, np.array(nexts, np.int64))),
                ],
                names=["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
            )

        jobs: list[tuple[int, str, str]] = []
        size = 0
        last: tuple[int, int, str] | None = None
        for rows in batches:
            for part, carried, key, text in zip(*(rows.column(i).to_pylist() for i in range(4))):
                if last is not None and last[0] == part:
                    jobs.append((last[1], last[2], text))
                    size += 2 * len(last[2]) + len(text)
                    if size > _BATCH_BYTES:
                        yield emit(jobs)
                        jobs, size = [], 0
                last = None if carried else (part, key, text)
        if jobs:
            yield emit(jobs)

    fields = "id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return in_order_with_next(docs, id_col, text_col, part_bytes).mapInArrow(run, fields)
