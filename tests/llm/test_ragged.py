import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from scholium.llm import bpe, chunk_fingerprint, fm_index, ragged, recompression, token_counts, token_files, toxicity

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")


def flat(texts):
    raw = [x.encode() for x in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)


def regular(n=2048):
    """The word of Thue and Morse over a and b, and the one with both exchanged: polynomial hashes modulo 2**64 confuse them."""
    word = "".join("ab"[i.bit_count() % 2] for i in range(n))
    return word, word.translate(str.maketrans("ab", "ba"))


def test_slices_of_any_width():
    rng = np.random.default_rng(3)
    for kind in (np.uint8, np.uint32, np.uint64):
        x = rng.integers(0, 3, 5000).astype(kind)
        starts = np.sort(rng.integers(0, 4900, 3000))
        ends = np.minimum(starts + rng.choice([0, 1, 2, 7, 8, 9, 15, 16, 17, 33, 400, 1500], 3000), 5000)
        a, b = ragged.slice_hashes(x, starts, ends)
        seen, back = {}, {}
        for s, e, h in zip(starts, ends, zip(a.tolist(), b.tolist())):
            assert seen.setdefault(x[s:e].tobytes(), h) == h
            assert back.setdefault(h, x[s:e].tobytes()) == x[s:e].tobytes()
        moved = np.concatenate([np.ones(3, kind), x])
        assert (ragged.slice_hashes(moved, starts + 3, ends + 3)[0] == a).all()


def test_regular_texts_have_their_own_results(spark):
    a, b = regular()
    vocab = bpe.vocabulary(WORD)
    for path, run in ((WORD, lambda *x: bpe.encode_chunk(*x, vocab)), (BYTE, token_files.encoder(BYTE))):
        ids, counts = run(*flat([a, b]))
        want = [Tokenizer.from_file(path).encode(x, add_special_tokens=False).ids for x in (a, b)]
        assert ids.tolist() == [i for w in want for i in w] and counts.tolist() == [len(w) for w in want]
    assert token_counts.count_chunk(*flat([a, b]), vocab).tolist() == [len(Tokenizer.from_file(WORD).encode(x).ids) for x in (a, b)]
    names = {c: f"t{c}" for c in "ab"}
    rows = [(1, " ".join(names[c] for c in a) + " tail"), (2, " ".join(names[c] for c in b) + " tail")]
    from .test_recompression import brute

    got = recompression.repeat_digests(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, got)) == sorted(brute(rows))
    hit, *_ = fm_index.Benchmark.of([("1", a)]).search(*flat([b]))
    assert not hit.any()
    whole, _, _ = toxicity.words(*flat([a, b]))
    assert whole[0] != whole[1]
    assert len(set(chunk_fingerprint.Fingerprints([a.encode(), b.encode()]).strings())) == 2


def test_every_code_point_is_read_as_the_library_reads_it():
    t = Tokenizer.from_file(WORD)
    vocab = bpe.vocabulary(WORD)
    points = [*range(0xD800), *range(0xE000, 0x110000)]
    for at in range(0, len(points), 4000):
        texts = [" ".join(f"x{chr(p)}y {chr(p)} 1{chr(p)}1" for p in points[at + k : at + k + 40]) for k in range(0, 4000, 40)]
        texts = [x for x in texts if x]
        ids, counts = bpe.encode_chunk(*flat(texts), vocab)
        want = [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]
        assert counts.tolist() == [len(w) for w in want]
        assert ids.tolist() == [i for w in want for i in w], hex(points[at])
