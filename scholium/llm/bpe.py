"""Byte-pair encoding of whole texts by batched numpy merge rounds, and decoding.

The vocabulary file is data: its merges become a sorted array of pair keys. Texts are normalised
and cut into pre-tokens by array operations over a chunk, equal pre-tokens of a chunk are encoded
once, and the symbols of all of them lie in one flat array. In each round every word's lowest-rank
pair is merged wherever it occurs in the word; ranks come from a binary search over the sorted
keys, and only pairs beside a merge are searched anew. This gives the merges one at a time because
in a trained vocabulary a pair's parts are always made by earlier merges (checked on loading).
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ragged import NUMBER, SPACE, chunks, distinct, gather, library_classes, owners, slice_hashes

NO_RANK = np.int32(2**31 - 1)
#: The parts after an apostrophe that are pre-tokens of their own.
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")


@lru_cache(1)
def byte_characters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(256, 512))
    return [chr(b) if b in set(plain) else chr(next(spare)) for b in range(256)]


class Vocabulary:
    """A byte-level BPE vocabulary whose last symbol of a word has a suffix (its .json file)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        ids: dict[str, int] = model["vocab"]
        self.suffix: str = model.get("end_of_word_suffix") or ""
        chars = byte_characters()
        self.inner = np.array([ids[c] for c in chars], np.int32)
        self.last = np.array([ids[c + self.suffix] for c in chars], np.int32)
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        size = max([*ids.values(), *self.special.values()]) + 1
        self.tokens: list[bytes] = [b""] * size
        for token, i in [*ids.items(), *self.special.items()]:
            self.tokens[i] = token.encode()
        self.base = np.int64(size)
        self.normalise = Normaliser(path)
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        left = np.array([ids[a] for a, _ in pairs], np.int64)
        right = np.array([ids[b] for _, b in pairs], np.int64)
        made = np.array([ids[a + b] for a, b in pairs], np.int32)
        rank = np.arange(len(pairs), dtype=np.int32)
        born = np.full(size, -1, np.int32)
        born[made] = rank
        if len(np.unique(made)) != len(made) or (born[left] >= rank).any() or (born[right] >= rank).any():
            raise ValueError("the vocabulary's merges aren't in training order")
        keys = left * self.base + right
        order = np.argsort(keys)
        self.keys, self.ranks, self.made = keys[order], rank[order], made
        self.sorted_keys = np.append(self.keys, np.iinfo(np.int64).max)
        self.sorted_ranks = np.append(self.ranks, NO_RANK)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs by binary search over the sorted pair keys; NO_RANK where there is none."""
        wanted = left.astype(np.int64) * self.base + right
        at = np.searchsorted(self.sorted_keys, wanted)
        return np.where(self.sorted_keys[at] == wanted, self.sorted_ranks[at], NO_RANK)


@lru_cache(4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def merge_rounds(symbols: np.ndarray, lengths: np.ndarray, vocab: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of many words, one word after another, merged until no pair has a rank.

    Returns the surviving symbols in the same layout and each word's count of them.
    """
    done_symbols = np.zeros(len(symbols), np.int32)
    final = np.zeros(len(lengths), np.int64)
    begin = np.cumsum(lengths) - lengths
    word = np.flatnonzero(lengths > 0)  # words still at work; of: the word of each symbol, as an index into word
    sizes = lengths[word]
    of = np.repeat(np.arange(len(word)), sizes)
    sym = symbols.astype(np.int32)
    joined = np.zeros(len(sym), bool)
    joined[:-1] = of[1:] == of[:-1]
    rank = np.full(len(sym), NO_RANK, np.int32)
    at = np.flatnonzero(joined)
    rank[at] = vocab.rank(sym[at], sym[at + 1])
    while len(word):
        first = np.cumsum(sizes) - sizes
        lowest = np.minimum.reduceat(rank, first)
        ended = lowest == NO_RANK
        if ended.any():
            out = ended[of]
            gone = sizes[ended]
            done_symbols[gather(begin[word[ended]], gone)] = sym[out]
            final[word[ended]] = gone
            stay = ~out
            sym, rank = sym[stay], rank[stay]
            word, sizes, lowest = word[~ended], sizes[~ended], lowest[~ended]
            of = np.repeat(np.arange(len(word)), sizes)
            if not len(word):
                break
        hit = rank == lowest[of]
        where = np.flatnonzero(hit)
        # in a run such as a a a, where the pair overlaps itself, every second one counts from the left
        gap = np.concatenate([[True], np.diff(where) != 1])
        run = np.cumsum(gap) - 1
        where = where[(np.arange(len(where)) - np.flatnonzero(gap)[run]) % 2 == 0]
        sym[where] = vocab.made[rank[where]]
        keep = np.ones(len(sym), bool)
        keep[where + 1] = False
        changed = np.zeros(len(sym), bool)
        changed[where] = True
        sizes = sizes - np.bincount(of[where], minlength=len(word))
        sym, rank, of, changed = sym[keep], rank[keep], of[keep], changed[keep]
        beside = changed.copy()
        beside[:-1] |= changed[1:]
        at = np.flatnonzero(beside)
        rank[at] = NO_RANK
        at = at[at + 1 < len(sym)]
        at = at[of[at] == of[at + 1]]
        rank[at] = vocab.rank(sym[at], sym[at + 1])
    keep = gather(begin, final)
    return done_symbols[keep], final


def normalise(text: str) -> str:
    """Canonical composition, then lower case of each character by itself."""
    if not unicodedata.is_normalized("NFC", text):
        text = unicodedata.normalize("NFC", text)
    return text.replace("Σ", "σ").lower()


class Normaliser:
    """The vocabulary's normal form of texts, as the library gives it.

    Characters of Unicode 3.2 have kept their canonical forms in all later versions, so texts of those whose
    own form is the same here and there are normalised here; other texts are left to the library, whose
    tables are of another Unicode version.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path).normalizer
        kind = library_classes()
        self.shared = np.zeros(0x110000, bool)
        for c in [*range(0xD800), *range(0xE000, 0x30000), 0xE0001, *range(0xE0020, 0xE0080)]:
            x = chr(c)
            self.shared[c] = kind[c] == SPACE or (unicodedata.ucd_3_2_0.category(x) != "Cn" and self.library.normalize_str(x) == normalise(x))

    def __call__(self, text: str) -> str:
        if text.isascii():
            return text.lower()
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        return normalise(text) if self.shared[points].all() else self.library.normalize_str(text)


def pretokens(flat: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of pre-tokens in normalised code points.

    They are contractions, runs of letters, single numerals, and runs of anything else but white space.
    """
    n = len(flat)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    kind = library_classes()[flat]
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    change = np.ones(n, bool)
    change[1:] = kind[1:] != kind[:-1]
    change |= first[:-1] | (kind == NUMBER)
    quote = np.flatnonzero((flat == 0x27) & change)
    border = offsets[1:][owners(quote, offsets)] if len(quote) else quote
    for part in CONTRACTIONS:
        fits = quote + len(part) < border
        at, end = quote[fits], border[fits]
        for i, c in enumerate(part, 1):
            ok = flat[at + i] == ord(c)
            at, end = at[ok], end[ok]
        for i in range(1, len(part) + 1):
            change[at + i] = False
        after = at + len(part) + 1
        change[after[after < end]] = True
        quote, border = quote[~np.isin(quote, at)], border[~np.isin(quote, at)]
    cut = np.flatnonzero(change)
    cut_end = np.append(cut[1:], n)
    words = kind[cut] != SPACE
    return cut[words], cut_end[words]


def _segments(data: np.ndarray, offsets: np.ndarray, vocab: Vocabulary) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Normalised stretches between special strings; for each its text, and the special id after it or -1."""
    import re

    raw, cut, special = data.tobytes(), offsets.tolist(), vocab.special
    pattern = re.compile(b"(" + b"|".join(re.escape(s.encode()) for s in special) + b")") if special else None
    if pattern is None or not pattern.search(raw):
        pattern = None
    parts: list[str] = []
    doc: list[int] = []
    after: list[int] = []
    for i, (a, b) in enumerate(zip(cut, cut[1:])):
        pieces = pattern.split(raw[a:b]) if pattern else [raw[a:b]]
        for j in range(0, len(pieces), 2):
            parts.append(vocab.normalise(pieces[j].decode()))
            doc.append(i)
            after.append(special[pieces[j + 1].decode()] if j + 1 < len(pieces) else -1)
    return parts, np.array(doc, np.int64), np.array(after, np.int64)


class Words:
    """The pre-tokens of a chunk of texts: distinct ones as symbols, and where each occurs."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, vocab: Vocabulary):
        self.docs = len(offsets) - 1
        parts, self.part_doc, self.part_after = _segments(data, offsets, vocab)
        flat_bytes = np.frombuffer("".join(parts).encode("utf-32-le"), np.uint32)
        lengths = np.fromiter(map(len, parts), np.int64, len(parts))
        cuts = np.concatenate([[0], np.cumsum(lengths)])
        starts, ends = pretokens(flat_bytes, cuts)
        self.part_of = owners(starts, cuts)
        chosen, self.which = distinct(*slice_hashes(flat_bytes, starts, ends))
        s, size = starts[chosen], ends[chosen] - starts[chosen]
        points = flat_bytes[gather(s, size)]
        utf8 = np.frombuffer(points.astype("<u4").tobytes().decode("utf-32-le").encode(), np.uint8)
        begins = np.flatnonzero((utf8 & 0xC0) != 0x80)
        first = np.append(begins, len(utf8))[np.cumsum(size) - size]
        self.lengths = np.diff(np.append(first, len(utf8)))
        self.symbols = vocab.inner[utf8]
        if len(first):
            last = first + self.lengths - 1
            self.symbols[last] = vocab.last[utf8[last]]


def encode_chunk(data: np.ndarray, offsets: np.ndarray, vocab: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """All texts' ids, one text after another, and each text's number of ids."""
    words = Words(data, offsets, vocab)
    symbols, count = merge_rounds(words.symbols, words.lengths, vocab)
    begin = np.cumsum(count) - count
    size = count[words.which]
    ids = symbols[gather(begin[words.which], size)]
    per_part = np.bincount(words.part_of, weights=size, minlength=len(words.part_doc)).astype(np.int64)
    if (words.part_after >= 0).any():  # special ids go between the stretches
        at = np.cumsum(per_part)[words.part_after >= 0]
        ids = np.insert(ids, at, words.part_after[words.part_after >= 0])
        per_part += words.part_after >= 0
    return ids.astype(np.int32), np.bincount(words.part_doc, weights=per_part, minlength=words.docs).astype(np.int64)


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>) for each row; a null text has no ids. Other columns are not read."""
    schema = pa.schema([("id", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path)
        for rows, data, offsets in chunks(batches, "text"):
            ids, counts = encode_chunk(data, offsets, vocab)
            ends = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.ListArray.from_arrays(ends, pa.array(ids))], schema=schema)

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id long, ids array<int>")


def decode_ids(ids: list[int], vocab: Vocabulary) -> bytes:
    """The tokens' strings with a space between, as a vocabulary without a decoder is read."""
    return b" ".join(map(vocab.tokens.__getitem__, ids))


def decode(encoded: DataFrame, path: str, id_col: str = "id", ids_col: str = "ids") -> DataFrame:
    """(id, text) for each row of ids; null ids give the empty text, ids outside the vocabulary an error."""
    schema = pa.schema([("id", pa.int64()), ("text", pa.string())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path)
        for rows in batches:
            out = [decode_ids(x or [], vocab).decode() for x in rows.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(out, pa.string())], schema=schema)

    return encoded.select(F.col(id_col).cast("long").alias("id"), F.col(ids_col).cast("array<int>").alias("ids")).mapInArrow(run, "id long, text string")


def encode_decode_digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256) for each row, repeats and null ids included.

    The digests are of the ids as little-endian unsigned 32-bit integers and of the decoded text in
    UTF-8; a null or empty text has no ids and decodes to the empty text.
    """
    schema = pa.schema([("id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path)
        sha = hashlib.sha256
        for rows, data, offsets in chunks(batches, "text", 3 << 20):
            ids, counts = encode_chunk(data, offsets, vocab)
            raw, listed = ids.astype("<u4").tobytes(), ids.tolist()
            cut = np.concatenate([[0], np.cumsum(counts)]).tolist()
            of_ids = [sha(raw[4 * a : 4 * b]).hexdigest() for a, b in zip(cut, cut[1:])]
            of_text = [sha(decode_ids(listed[a:b], vocab)).hexdigest() for a, b in zip(cut, cut[1:])]
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(counts), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())], schema=schema)

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
