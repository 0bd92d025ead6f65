"""Ragged text batches in numpy: many texts in one flat array with offsets.

Every operator that reads whole texts in Python works on these: an Arrow string column is cut
into chunks of bounded size, its UTF-8 buffer is viewed (not copied) as bytes, and words are
found, hashed and counted by array operations over the chunk.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 4 << 20
LETTER, NUMBER, SPACE, OTHER = 0, 1, 2, 3


def chunks(batches: Iterable[pa.RecordBatch], column: str, limit: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Cut batches so that each chunk holds about ``limit`` bytes of text, or one longer text.

    Yields the rows, their bytes and int64 offsets (one more than rows). A null text is empty.
    """
    for batch in batches:
        at = batch.schema.get_field_index(column)
        if not batch.num_rows:
            continue
        text = batch.column(at).cast(pa.large_string()).fill_null("")
        offsets = np.frombuffer(text.buffers()[1], np.int64, len(text) + 1 + text.offset)[text.offset :]
        raw = text.buffers()[2]
        data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
        start = 0
        while start < batch.num_rows:
            end = max(start + 1, int(np.searchsorted(offsets, offsets[start] + limit, "right")) - 1)
            end = min(end, batch.num_rows)
            own = offsets[start : end + 1]
            yield batch.slice(start, end - start), data[own[0] : own[-1]], own - own[0]
            start = end


def texts(data: np.ndarray, offsets: np.ndarray) -> list[bytes]:
    raw, cut = data.tobytes(), offsets.tolist()
    return [raw[a:b] for a, b in zip(cut, cut[1:])]


def codepoints(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes to uint32 code points, with the offsets counted in code points."""
    starts = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=starts[1:])
    flat = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    return flat, starts[offsets]


@lru_cache(1)
def classes() -> np.ndarray:
    """For each code point: LETTER, NUMBER, SPACE or OTHER, by Unicode's general categories."""
    import regex

    everything = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    out = np.full(0x110000, OTHER, np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\p{White_Space}+")):
        for run in regex.finditer(pattern, everything):
            out[[ord(c) for c in run[0]]] = kind
    return out


@lru_cache(1)
def library_classes() -> np.ndarray:
    """The same as classes(), but as the tokenizers library sees them: its Unicode version is another."""
    from tokenizers import Regex, pre_tokenizers

    out = np.full(0x110000, OTHER, np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
        found = pre_tokenizers.Split(Regex(pattern), "removed", invert=True)
        for base in range(0, 0x110000, 2048):  # not all at once: the library counts in 32 bits, and surrogates fill one block
            if base != 0xD800:
                for _, (a, b) in found.pre_tokenize_str("".join(map(chr, range(base, base + 2048)))):
                    out[base + a : base + b] = kind
    return out


def spans(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of ``inside`` that don't cross a text's border."""
    if not len(inside):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = np.zeros(len(inside) + 1, bool)
    first[offsets] = True
    before = np.zeros(len(inside), bool)
    before[1:] = inside[:-1]
    begins = inside & (~before | first[:-1])
    after = np.zeros(len(inside), bool)
    after[:-1] = inside[1:]
    ends = inside & (~after | first[1:])
    return np.flatnonzero(begins), np.flatnonzero(ends) + 1


def owners(starts: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """For positions in ascending order, the index of the text that holds each."""
    return np.searchsorted(offsets, starts, "right") - 1


def gather(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions of all elements of the given slices, one after another."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    step = np.ones(total, np.int64)
    ends = np.cumsum(lengths)
    keep = lengths > 0
    s, n, e = starts[keep], lengths[keep], ends[keep]
    step[0] = s[0]
    step[e[:-1]] = s[1:] - (s[:-1] + n[:-1] - 1)
    return np.cumsum(step)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: near values get unrelated results."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


#: Slices of more bytes than this are hashed one by one.
_LONG = 1024
_K1, _K2, _K3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xD6E8FEB86659FD93)


def _lanes(flat: np.ndarray) -> np.ndarray:
    """For each place the eight bytes that begin there, as one number; zeros beyond the end."""
    if flat.itemsize == 8:
        return flat.view(np.uint64)
    if flat.itemsize == 4:
        out = flat.astype(np.uint64)
        out[:-1] |= out[1:] << np.uint64(32)
        return out
    padded = np.zeros(len(flat) + 8, np.uint8)
    padded[: len(flat)] = flat
    return np.ascontiguousarray(np.ndarray((len(flat) + 1,), "<u8", padded, strides=(1,)))


def slice_hashes(flat: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes of each slice of a flat array of 1-, 4- or 8-byte numbers.

    The same content gives the same hashes in every task. Eight bytes at a time are mixed into the state of
    all slices at once by a step that isn't linear in them, so regular texts collide no sooner than others.
    """
    size = (ends - starts) * flat.itemsize
    a = size.astype(np.uint64) * _K1
    b = size.astype(np.uint64) ^ _K3
    lanes = _lanes(flat) if len(flat) else np.zeros(0, np.uint64)
    per = 8 // flat.itemsize
    at = np.flatnonzero((size > 0) & (size <= _LONG))
    where, left = starts[at], size[at]
    while len(at):
        lane = lanes[where]
        short = np.flatnonzero(left < 8)
        if len(short):
            lane[short] &= (np.uint64(1) << (left[short] * 8).astype(np.uint64)) - np.uint64(1)
        x = (a[at] ^ lane) * _K2
        a[at] = x ^ (x >> np.uint64(29))
        x = (b[at] + lane * _K1) * _K3
        b[at] = x ^ (x >> np.uint64(32))
        more = left > 8
        at, where, left = at[more], where[more] + per, left[more] - 8
    long = np.flatnonzero(size > _LONG)
    if len(long):
        from xxhash import xxh3_128_intdigest

        raw = memoryview(np.ascontiguousarray(flat)).cast("B")
        for i, s, e in zip(long.tolist(), (starts[long] * flat.itemsize).tolist(), (ends[long] * flat.itemsize).tolist()):
            digest = xxh3_128_intdigest(raw[s:e])
            a[i], b[i] = digest & (2**64 - 1), digest >> 64
    return mix(a), mix(b)


def distinct(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of one member of each set of equal pairs of hashes, and for each element the set's number."""
    if not len(a):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    order = np.argsort(a)
    new = np.ones(len(order), bool)
    new[1:] = a[order][1:] != a[order][:-1]
    ranked = b[order]
    if (ranked[1:][~new[1:]] != ranked[:-1][~new[1:]]).any():  # the first hashes clash: let both decide
        order = np.lexsort((b, a))
        new[1:] = (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])
    inverse = np.empty(len(order), np.int64)
    inverse[order] = np.cumsum(new) - 1
    return order[new], inverse
