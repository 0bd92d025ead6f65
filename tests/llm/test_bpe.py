import hashlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from scholium.llm import bpe, token_counts

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)
TEXTS = [
    None, "", "   \n\t", "Hello, world! It's they'LL we've ''s !'s 'd've 'RE i'm you'd don't can'there x'llama 'r 'v '",
    "123 ½ ⅷ 4th 10,000.5", "Straße İstanbul ΣΊΣΥΦΟΣ ΌΔΟΣ naïve étude Å ﬁ", "日本語のテキスト 中文 العربية हिन्दी ไทย",
    "a<|endoftext|>b <|startoftext|><|endoftext|> C <|ENDOFTEXT|>", "<|endoftext|>", "aaaaaaaaaaaaa hahahahaha ......!!!!????----",
    "emoji 👩‍👩‍👧‍👦 🇩🇪 ​   x\x00y\x1cz\x85", "word " * 5000, "x" * 3000, "́leading combining", "don'the 'twas rock'n'roll ''tis",
]


def expect(texts):
    t = Tokenizer.from_file(PATH)
    out = []
    for x in texts:
        ids = t.encode(x or "", add_special_tokens=False).ids
        out.append((len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    return out


def flat(texts):
    raw = [(x or "").encode() for x in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)


def test_same_as_library(spark):
    rows = [(i, x, 5) for i, x in enumerate(TEXTS)] + [(None, "no id", 5), (0, None, 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, id int")
    got = bpe.encode_decode_digests(df, PATH).collect()
    want = [(r[0], *e) for r, e in zip(rows, expect([r[1] for r in rows]))]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    counts = token_counts.token_counts(df, PATH, limit=2048).collect()
    assert sorted(str(tuple(r)) for r in counts) == sorted(str((i, len((x or "").encode()), n, n > 2048)) for (i, x, _), (_, n, *_) in zip(rows, want))
    ids = bpe.encode(df, PATH)
    back = {r.id: r.text for r in bpe.decode(ids, PATH).collect() if r.id not in (None, 0)}
    t = Tokenizer.from_file(PATH)
    for i, x in enumerate(TEXTS):
        if i:
            assert back[i] == t.decode(t.encode(x, add_special_tokens=False).ids, skip_special_tokens=False)
    assert bpe.encode_decode_digests(df.limit(0), PATH).collect() == []
    assert token_counts.token_counts(df.limit(0), PATH).collect() == []


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from("abel'sdmrtv tL \n1!. ΣİéÅ"), st.characters(exclude_categories=["Cs", "Cn", "Co"], max_codepoint=0x2FFF)), max_size=60), min_size=1, max_size=6))
def test_any_text(texts):
    vocab, t = bpe.vocabulary(PATH), LIBRARY
    data, offsets = flat(texts)
    ids, counts = bpe.encode_chunk(data, offsets, vocab)
    want = [t.encode(x, add_special_tokens=False).ids for x in texts]
    assert counts.tolist() == [len(w) for w in want]
    assert ids.tolist() == [i for w in want for i in w]
    assert token_counts.count_chunk(data, offsets, vocab).tolist() == counts.tolist()


def test_vocabulary_order_is_checked(tmp_path):
    import json

    spec = json.load(open(PATH))
    spec["model"]["merges"] = spec["model"]["merges"][::-1]
    (tmp_path / "v.json").write_text(json.dumps(spec))
    with pytest.raises(ValueError):
        bpe.Vocabulary(str(tmp_path / "v.json"))
