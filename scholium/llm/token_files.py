"""Token ids in binary files with keyed access through a minimal perfect hash.

Documents are encoded by the tokenizers library (distinct pre-tokens once each), dealt out by ranges of
their ids, and written as shard files in ascending order of id. A shard holds, little-endian:

    magic, then counts: documents, distinct keys, ids, bytes of an id, hash levels
    sizes of the hash levels (in 64-bit words), their bits, and the number of set bits before each word
    for each slot of the hash: fingerprint of its key, offset and length of its document (in ids)
    for each document in order: key, length
    the ids of all documents, one after another

A key's slot is the rank of its bit in the first level where it has a bit of its own, so a look-up
reads a constant number of places; the stored fingerprint tells that a key isn't in the shard.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import CONTRACTIONS
from .common import materialize, scratch
from .ranges import place, ranges
from .ragged import SPACE, chunks, codepoints, distinct, gather, library_classes, mix, owners, slice_hashes

MAGIC = b"TOKSHRD1"
#: Text that goes into one shard, in bytes, and ids after which a shard is closed in any case.
SHARD_BYTES = 16 << 20
SHARD_IDS = 32 << 20
#: Distinct pre-tokens whose ids a worker remembers.
CACHE = 500_000
_NULL_KEY = -(2**63)
#: Shards that one task reads back.
SHARDS_A_TASK = 2


# --- encoding


def pretokens(flat: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of byte-level pre-tokens in code points; together they cover the texts.

    Contractions; runs of letters, of numerals or of other signs, each with one space before it if there
    is one; and what is left of runs of white space.
    """
    n = len(flat)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    kind = library_classes()[flat]
    border = np.zeros(n + 1, bool)
    border[offsets] = True
    change = np.ones(n, bool)
    change[1:] = kind[1:] != kind[:-1]
    change |= border[:-1]
    # the last character of white space before a sign: a space joins what follows, another stands alone
    last = np.zeros(n, bool)
    last[:-1] = (kind[:-1] == SPACE) & (kind[1:] != SPACE) & ~border[1:-1]
    at = np.flatnonzero(last)
    change[at] = True
    change[at[flat[at] == 32] + 1] = False
    quote = np.flatnonzero((flat == 0x27) & change)
    end_of = offsets[1:][owners(quote, offsets)] if len(quote) else quote
    for part in CONTRACTIONS:
        fits = quote + len(part) < end_of
        at, end = quote[fits], end_of[fits]
        for i, c in enumerate(part, 1):
            ok = flat[at + i] == ord(c)
            at, end = at[ok], end[ok]
        for i in range(1, len(part) + 1):
            change[at + i] = False
        after = at + len(part) + 1
        at = after[after < end]
        change[at] = True
        rest = ~np.isin(quote, after - len(part) - 1)
        quote, end_of = quote[rest], end_of[rest]
    cut = np.flatnonzero(change)
    return cut, np.append(cut[1:], n)


class Encoder:
    """Ids of texts by the library's tokenizer, each distinct pre-token encoded once."""

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.width = 2 if self.library.get_vocab_size() <= 1 << 16 else 4
        self._forget()

    def _forget(self) -> None:
        self.known, self.second = np.zeros(0, np.uint64), np.zeros(0, np.uint64)  # sorted by the first hash
        self.first = np.zeros(0, np.int64)
        self.size = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def _find(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place of each pair of hashes, and whether it is known."""
        if not len(self.known):
            return np.zeros(len(a), np.int64), np.zeros(len(a), bool)
        last = len(self.known) - 1
        at = np.searchsorted(self.known, a)
        while True:  # beyond the first of those whose first hashes clash
            here = np.minimum(at, last)
            past = (at <= last) & (self.known[here] == a) & (self.second[here] != b)
            if not past.any():
                return here, (at <= last) & (self.known[here] == a)
            at = at + past

    def _lookup(self, a: np.ndarray, b: np.ndarray, flat: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the ids of distinct pre-tokens lie in ``self.ids``, encoding those not known yet."""
        if len(self.known) + len(a) > CACHE + len(a) // 2:
            self._forget()
        at, have = self._find(a, b)
        new = ~have
        if new.any():
            s, e = starts[new], ends[new]
            text = flat[gather(s, e - s)].astype("<u4").tobytes().decode("utf-32-le")
            cut = np.concatenate([[0], np.cumsum(e - s)]).tolist()
            got = [x.ids for x in self.library.encode_batch_fast([text[a:b] for a, b in zip(cut, cut[1:])], add_special_tokens=False)]
            size = np.fromiter(map(len, got), np.int64, len(got))
            flat_ids = np.fromiter((i for g in got for i in g), np.uint32, int(size.sum()))
            keys, second = np.concatenate([self.known, a[new]]), np.concatenate([self.second, b[new]])
            first = np.concatenate([self.first, len(self.ids) + np.cumsum(size) - size])
            self.ids = np.concatenate([self.ids, flat_ids])
            order = np.argsort(keys)
            self.known, self.second, self.first, self.size = keys[order], second[order], first[order], np.concatenate([self.size, size])[order]
            at, _ = self._find(a, b)
        return self.first[at], self.size[at]

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids, one text after another, and each text's number of ids."""
        flat, cuts = codepoints(data, offsets)
        starts, ends = pretokens(flat, cuts)
        a, b = slice_hashes(flat, starts, ends)
        chosen, which = distinct(a, b)
        first, size = self._lookup(a[chosen], b[chosen], flat, starts[chosen], ends[chosen])
        first, size = first[which], size[which]
        ids = self.ids[gather(first, size)]
        counts = np.bincount(owners(starts, cuts), weights=size, minlength=len(offsets) - 1).astype(np.int64) if len(starts) else np.zeros(len(offsets) - 1, np.int64)
        raw = data.tobytes()
        if any(s.encode() in raw for s in self.special):  # a special string is a token: leave such texts to the library whole
            cut = np.concatenate([[0], np.cumsum(counts)])
            each = [ids[a:b] for a, b in zip(cut, cut[1:])]
            for i, (a, b) in enumerate(zip(offsets.tolist(), offsets[1:].tolist())):
                if any(s.encode() in raw[a:b] for s in self.special):
                    each[i] = np.array(self.library.encode(raw[a:b].decode(), add_special_tokens=False).ids, np.uint32)
            ids, counts = np.concatenate(each), np.array([len(x) for x in each], np.int64)
        return ids, counts


@lru_cache(2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


# --- the hash


@dataclass
class PerfectHash:
    """A minimal perfect hash of distinct 64-bit keys (Limasset et al., 2017): bit arrays by level, and ranks."""

    sizes: np.ndarray  # 64-bit words of each level
    bits: np.ndarray
    before: np.ndarray  # set bits before each word
    GAMMA = 2.0

    @staticmethod
    def _place(keys: np.ndarray, level: int, words: int) -> np.ndarray:
        return (mix(keys + np.uint64((level + 1) * 0x9E3779B97F4A7C15 & (2**64 - 1))) % np.uint64(64 * words)).astype(np.int64)

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        left, sizes, arrays = keys, [], []
        while len(left):
            words = max(1, int(np.ceil(cls.GAMMA * len(left) / 64)))
            at = cls._place(left, len(sizes), words)
            alone = np.bincount(at, minlength=64 * words) == 1
            arrays.append(np.packbits(alone, bitorder="little").view("<u8"))
            sizes.append(words)
            left = left[~alone[at]]
        bits = np.concatenate(arrays) if arrays else np.zeros(0, "<u8")
        count = np.bitwise_count(bits).astype(np.int64)
        return cls(np.array(sizes, np.int64), bits.astype(np.uint64), np.cumsum(count) - count)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """Each key's slot; -1 for some of the keys that weren't in the set (others get any slot)."""
        out = np.full(len(keys), -1, np.int64)
        left, base = np.arange(len(keys)), 0
        for level, words in enumerate(self.sizes.tolist()):
            if not len(left):
                break
            at = self._place(keys[left], level, words)
            word, bit = base + at // 64, (at % 64).astype(np.uint64)
            has = (self.bits[word] >> bit) & np.uint64(1) == 1
            below = np.bitwise_count(self.bits[word[has]] & ((np.uint64(1) << bit[has]) - np.uint64(1)))
            out[left[has]] = self.before[word[has]] + below
            left, base = left[~has], base + words
        return out


def _fingerprints(keys: np.ndarray) -> np.ndarray:
    return (mix(keys ^ np.uint64(0xA0761D6478BD642F)) >> np.uint64(32)).astype(np.uint32)


# --- files


def shard_bytes(keys: np.ndarray, lengths: np.ndarray, payload: bytes, width: int) -> bytes:
    """A shard file. Keys are in order; of documents with one key, the index leads to the first."""
    starts = np.cumsum(lengths) - lengths
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    own = keys[first].view(np.uint64)
    hashed = PerfectHash.build(own)
    slot = hashed.slots(own)
    marks, offset, length = np.empty(len(own), "<u4"), np.empty(len(own), "<u8"), np.empty(len(own), "<u4")
    marks[slot], offset[slot], length[slot] = _fingerprints(own), starts[first], lengths[first]
    head = np.array([len(keys), len(own), int(lengths.sum()), width, len(hashed.sizes)], "<u8")
    parts = [head, hashed.sizes.astype("<u8"), hashed.bits.astype("<u8"), hashed.before.astype("<u4"), marks, offset, length, keys.astype("<i8"), lengths.astype("<u4")]
    return MAGIC + b"".join(p.tobytes() for p in parts) + payload


class Shard:
    """A shard file read back: documents in order, or any one by its key."""

    def __init__(self, raw: bytes):
        if raw[: len(MAGIC)] != MAGIC:
            raise ValueError("not a shard of token ids")
        at = len(MAGIC)

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(raw, kind, n, at)
            at += out.nbytes
            return out

        docs, own, ids, width, levels = take("<u8", 5).tolist()
        sizes = take("<u8", levels).astype(np.int64)
        words = int(sizes.sum())
        self.hash = PerfectHash(sizes, take("<u8", words).astype(np.uint64), take("<u4", words).astype(np.int64))
        self.marks, self.offset, self.length = take("<u4", own), take("<u8", own), take("<u4", own)
        self.keys, self.lengths = take("<i8", docs), take("<u4", docs).astype(np.int64)
        self.payload = take(f"<u{width}", ids)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each key: whether it is here, and its document's offset and length in ids."""
        keys = keys.astype(np.int64).view(np.uint64)
        slot = self.hash.slots(keys)
        here = slot >= 0
        here[here] = self.marks[slot[here]] == _fingerprints(keys[here])
        slot = np.where(here, slot, 0)
        none = np.zeros(len(keys), np.int64)
        return here, self.offset[slot].astype(np.int64) if len(self.offset) else none, self.length[slot].astype(np.int64) if len(self.length) else none


def _open(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def write(docs: DataFrame, path: str, folder: str | None = None, end_id: int | None = 0, id_col: str = "doc_id", text_col: str = "text", shard_bytes_of_text: int = SHARD_BYTES) -> DataFrame:
    """Write every row's ids to shard files; returns the manifest (path, part, piece, n_docs, n_ids, first_key, last_key).

    ``end_id`` is appended to each document. A null or empty text has the end id only, a null id counts as
    the smallest, and rows that share an id follow one another, ordered by a hash of their texts. Rows are dealt
    by ranges of ids; an id with very many rows fills several. The manifest is stored, and names only files of tasks that succeeded: a lost executor's files are written anew under
    other names.
    """
    spark: SparkSession = docs.sparkSession
    folder = folder or scratch(spark, "token-files")
    own = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_NULL_KEY)).alias("key"), F.coalesce(text_col, F.lit("")).alias("text"))
    dealt = ranges(own, "key", "text", shard_bytes_of_text)
    schema = pa.schema([("key", pa.int64()), ("place", pa.int32()), ("n", pa.int64()), ("part", pa.int32()), ("ids", pa.binary())])

    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run = encoder(path)
        for rows, data, offsets in chunks(batches, "text", 2 << 20):
            ids, counts = run(data, offsets)
            if end_id is not None:
                ids = np.insert(ids, np.cumsum(counts), end_id)
                counts = counts + 1
            raw = ids.astype(f"<u{run.width}").tobytes()
            cut = (np.concatenate([[0], np.cumsum(counts)]) * run.width).astype(np.int32)
            part = dealt.part(*(rows.column(i).to_numpy(zero_copy_only=False) for i in (0, 1)))
            binary = pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(cut.tobytes()), pa.py_buffer(raw)])
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(counts), pa.array(part), binary], schema=schema)

    fields = "path string, part int, piece int, n_docs long, n_ids long, first_key long, last_key long"

    def save(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _open(folder)
        fs.create_dir(base, recursive=True)
        held: list[tuple[np.ndarray, np.ndarray, list[bytes]]] = []
        now, piece, ids = -1, 0, 0
        width = encoder(path).width

        def close() -> pa.RecordBatch:
            keys, lengths = (np.concatenate([h[i] for h in held]) for i in (0, 1))
            name = f"part-{now:06d}-{piece:04d}-{uuid.uuid4().hex}.ids"
            with fs.open_output_stream(f"{base}/{name}") as out:
                out.write(shard_bytes(keys, lengths, b"".join(b for h in held for b in h[2]), width))
            row = [f"{folder}/{name}", now, piece, len(keys), int(lengths.sum()), int(keys[0]), int(keys[-1])]
            kinds = [pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, kinds)], names=[f.split()[0] for f in fields.split(", ")])

        for rows in batches:
            part = rows.column(3).to_numpy(zero_copy_only=False)
            edge = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])).tolist() if len(part) else []
            for a, b in zip(edge, [*edge[1:], len(part)]):
                if held and (part[a] != now or ids > SHARD_IDS):
                    yield close()
                    held.clear()
                    piece, ids = (piece + 1 if part[a] == now else 0), 0
                if part[a] != now:
                    now, piece = int(part[a]), 0
                n = rows.column(2).slice(a, b - a).to_numpy(zero_copy_only=False)
                held.append((rows.column(0).slice(a, b - a).to_numpy(zero_copy_only=False).copy(), n.copy(), rows.column(4).slice(a, b - a).to_pylist()))
                ids += int(n.sum())
        if held:
            yield close()

    coded = own.select("key", place().alias("place"), "text").mapInArrow(encode, "key long, place int, n long, part int, ids binary")
    return materialize(coded.repartitionById(dealt.parts, "part").sortWithinPartitions("part", "key", "place", "ids").mapInArrow(save, fields), "token-manifest")


def _numbered(manifest: DataFrame) -> DataFrame:
    """The manifest with each shard's number in order and the ids before it."""
    order = Window.orderBy("part", "piece")  # one row a shard
    return manifest.withColumns({"shard": F.row_number().over(order) - 1, "before": F.coalesce(F.sum("n_ids").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))})


def read_back(manifest: DataFrame) -> DataFrame:
    """(id, start, n_tokens, ids_crc32) of every document in the files, each found through its shard's hash.

    start counts the ids of all documents before it over all shards. A task reads SHARDS_A_TASK shards.
    """
    tasks = max(1, -(-manifest.count() // SHARDS_A_TASK))
    placed = _numbered(manifest).withColumn("task", (F.col("shard") % tasks).cast("int"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for uri, before in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist()):
                fs, name = _open(uri)
                with fs.open_input_file(name) as f:
                    shard = Shard(f.read())
                here, start, n = shard.find(shard.keys)
                order = np.cumsum(shard.lengths) - shard.lengths
                again = np.zeros(len(n), bool)  # further documents of one key are reached from its first
                again[1:] = shard.keys[1:] == shard.keys[:-1]
                start, n = np.where(again, order, start), np.where(again, shard.lengths, n)
                if not here.all():
                    raise ValueError(f"{uri}: a key isn't in its index")
                wide = shard.payload.astype("<u4").tobytes()
                crc = [zlib.crc32(wide[4 * a : 4 * (a + k)]) for a, k in zip(start.tolist(), n.tolist())]
                ids = pa.array(shard.keys, pa.int64(), mask=shard.keys == _NULL_KEY)
                yield pa.RecordBatch.from_arrays([ids, pa.array(start + before), pa.array(n), pa.array(crc, pa.int64())], names=["id", "start", "n_tokens", "ids_crc32"])

    return placed.repartitionById(tasks, "task").select("path", "before").mapInArrow(run, "id long, start long, n_tokens long, ids_crc32 long")


def look_up(manifest: DataFrame, wanted: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, ids array<int>) of the wanted ids that are in the files, by keyed access to the shards that may hold them.

    Of several documents with one id the first is given; null ids are looked up as such; repeats are answered once.
    """
    keys = wanted.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_NULL_KEY)).alias("key")).distinct()
    shards = _numbered(manifest)
    last = shards.select("shard", "last_key").toPandas().sort_values("shard").last_key.to_numpy(np.int64)  # two numbers a shard

    def route(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            at = np.searchsorted(last, rows.column(0).to_numpy(zero_copy_only=False))  # the first shard that may hold it
            there = np.flatnonzero(at < len(last))
            yield pa.RecordBatch.from_arrays([rows.column(0).take(pa.array(there)), pa.array(at[there], pa.int32())], names=["key", "shard"])

    tasks = max(1, -(-len(last) // SHARDS_A_TASK))
    asked = keys.mapInArrow(route, "key long, shard int").join(shards.select("shard", "path"), "shard").withColumn("task", F.col("shard") % tasks)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uri, shard = None, None
        for rows in batches:
            paths = np.array(rows.column(1).to_pylist(), object)
            all_keys = rows.column(0).to_numpy(zero_copy_only=False)
            edge = np.flatnonzero(np.concatenate([[True], paths[1:] != paths[:-1]])).tolist() if len(paths) else []
            for a, b in zip(edge, [*edge[1:], len(paths)]):
                if paths[a] != uri:
                    uri = paths[a]
                    fs, name = _open(uri)
                    with fs.open_input_file(name) as f:
                        shard = Shard(f.read())
                here, start, n = shard.find(all_keys[a:b])
                found = [shard.payload[s : s + k].tolist() for s, k in zip(start[here].tolist(), n[here].tolist())]
                got = all_keys[a:b][here]
                yield pa.RecordBatch.from_arrays([pa.array(got, pa.int64(), mask=got == _NULL_KEY), pa.array(found, pa.list_(pa.int32()))], names=["id", "ids"])

    return asked.repartitionById(tasks, "task").sortWithinPartitions("shard").select("key", "path").mapInArrow(run, "id long, ids array<int>")
