import zlib

import numpy as np
import public_tokenizers
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from scholium.llm import token_files as T

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)


def flat(texts):
    raw = [x.encode() for x in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from("abel'sdmrtv tL \n\t1!.  é"), st.characters(exclude_categories=["Cs", "Cn", "Co"], max_codepoint=0x2FFF)), max_size=60), min_size=1, max_size=6))
def test_encodes_like_the_library(texts):
    texts = [*texts, "it's we'll ''s  's\n's 'really don't  \n\n x   ", "a<|endoftext|>b c"]
    ids, counts = T.encoder(PATH)(*flat(texts))
    t = LIBRARY
    want = [t.encode(x, add_special_tokens=False).ids for x in texts]
    assert counts.tolist() == [len(w) for w in want]
    assert ids.tolist() == [i for w in want for i in w]


def test_perfect_hash():
    rng = np.random.default_rng(1)
    for n in (0, 1, 5, 10_000):
        keys = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        h = T.PerfectHash.build(keys)
        assert sorted(h.slots(keys).tolist()) == list(range(len(keys)))


def test_round_trip(spark, monkeypatch):
    rng = np.random.default_rng(3)
    words = ["alpha", "don't", "été", "1,234", "\n\n", "  x", "日本"]
    rows = [(int(i) * 7 - 300, " ".join(rng.choice(words, rng.integers(0, 80)))) for i in rng.permutation(200)]
    rows += [(None, "no id"), (5000, None), (5001, ""), rows[0], rows[1], (rows[2][0], "another text under the same id"), (6000, "word " * 3000)]
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, key int, part string").repartition(4)
    monkeypatch.setattr(T, "SHARD_IDS", 500)
    manifest = T.write(df, PATH, shard_bytes_of_text=4000)
    assert manifest.count() > 5
    got = [tuple(r) for r in T.read_back(manifest).collect()]
    t = Tokenizer.from_file(PATH)
    coded = [(i, [*t.encode(x or "", add_special_tokens=False).ids, 0]) for i, x in rows]
    place = {tuple(ids): xxhash.xxh64_intdigest((x or "").encode(), 42) % 2**31 for (_, x), (_, ids) in zip(rows, coded)}
    coded.sort(key=lambda r: (r[0] is not None, r[0] or 0, place[tuple(r[1])]))
    want, at = [], 0
    for i, ids in coded:
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert sorted(map(str, got)) == sorted(map(str, want))
    ask = spark.createDataFrame([(rows[9][0],), (rows[9][0],), (6000,), (123456,), (-299,), (None,), (5000,)], "doc_id long")
    found = {r.id: r.ids for r in T.look_up(manifest, ask).collect()}
    first = {}
    for i, ids in coded:
        first.setdefault(i, ids)
    assert found == {i: first[i] for i in (rows[9][0], 6000, None, 5000)}
    empty = T.write(df.limit(0), PATH)
    assert T.read_back(empty).collect() == []


def test_an_id_with_most_rows_fills_several_parts(spark):
    rows = [(7, f"text number {i} of the same id") for i in range(400)] + [(i, "other") for i in range(100)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    manifest = T.write(df, PATH, shard_bytes_of_text=1500)
    assert max(r.n_docs for r in manifest.collect()) < 150
    got = T.read_back(manifest).orderBy("start").collect()
    t = Tokenizer.from_file(PATH)
    coded = [(i, xxhash.xxh64_intdigest(x.encode(), 42) % 2**31, [*t.encode(x).ids, 0]) for i, x in rows]
    want, at = [], 0
    for i, _, ids in sorted(coded):
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert list(map(tuple, got)) == want
    found = T.look_up(manifest, df.select("doc_id").distinct()).collect()
    assert len(found) == 100
