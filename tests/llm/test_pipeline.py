import random

import corpus_pipeline
from scholium.llm import bpe, language_id
from scholium.llm.queries import tokenizer

from .test_bpe import expect
from .test_fm_index import brute as brute_hits
from .test_fm_index import words as bench_words
from .test_recompression import brute as brute_repeats
from .test_simhash import brute_similar


def tables(spark, tmp_path):
    rng = random.Random(11)
    vocab = {lang: ["".join(rng.choices(letters, k=rng.randint(2, 8))) for _ in range(400)] for lang, letters in (("en", "aeiothrnsl"), ("de", "ueiäöcknst"), ("fr", "éeaouqivrd"))}
    passage = " ".join(rng.choices(vocab["en"], k=60))
    item = " ".join(rng.choices(vocab["en"], k=30))
    rows = []
    for i in range(150):
        lang = rng.choice(list(vocab))
        text = " ".join(rng.choices(vocab[lang], k=rng.randint(40, 150)))
        if i % 10 == 3:
            text += " " + passage
        if i % 15 == 4:
            text = item + " " + text
        rows.append((i, text, lang, f"s{i % 3}", len(text), i * 2))
    near = rows[7][1].split()
    near[5] = "changed"
    rows += [(200, rows[7][1], "en", "s", 3, 0), (201, " ".join(near * 1), "en", "s", 3, 0), (202, None, "en", "s", None, 0), (203, "12 34 !!", "en", "s", 8, 0), (204, "", None, None, 0, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, fingerprint int")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return rows


def test_stages_and_run(spark, tmp_path):
    rows = tables(spark, tmp_path)
    d = str(tmp_path)
    docs = spark.read.parquet(f"{d}/documents.parquet")
    model = language_id.fit(docs)
    lost = {r.id for r in language_id.identify(docs, model).where("rejected").collect()}
    assert {202, 203, 204} <= lost and len(lost) < 8
    now = [(r[0], r[1]) for r in rows if r[0] not in lost]
    got = corpus_pipeline.STAGES[0][1](spark, docs, d)
    assert got.columns == docs.columns and {r.doc_id for r in got.collect()} == {i for i, _ in now}
    keep = {c for _, c in brute_similar(now, corpus_pipeline.NEAR_LEAST)}
    now = [(i, t) for i, t in now if i in keep]
    assert 200 not in keep
    import hashlib
    import re

    by = {i: (n, gone, sha) for i, n, gone, sha in brute_repeats(now)}
    stage3 = corpus_pipeline.STAGES[2][1](spark, corpus_pipeline.STAGES[1][1](spark, got, d), d)
    assert stage3.columns == docs.columns
    text = {r.doc_id: r for r in stage3.collect()}
    assert set(text) == {i for i, (n, gone, _) in by.items() if not gone or gone < n}
    for i, r in text.items():
        assert r.n_chars == len(r.text) or not by[i][1]
        assert hashlib.sha256(b" ".join(re.findall(rb"[^\x20\x09-\x0D]+", r.text.encode()))).hexdigest() == by[i][2]
    now = sorted((i, r.text) for i, r in text.items())
    hits = {i: h for i, _, h, *_ in brute_hits(now, [(1, rows[4][1][: len(rows[4][1])].split(" ", 30) and " ".join(rows[4][1].split()[:30]))])}
    stage4 = corpus_pipeline.STAGES[3][1](spark, stage3, d)
    clean = {r.doc_id: r.text for r in stage4.collect()}
    assert set(clean) == set(text) and any(hits.values())
    for i, t in now:
        assert len(bench_words(clean[i])) == len(bench_words(t)) - hits[i]
    final = sorted(map(tuple, corpus_pipeline.run(spark, d).collect()))
    ids = sorted(clean)
    assert final == [(i, *e) for i, e in zip(ids, expect([clean[i] for i in ids]))]


def test_empty(spark, tmp_path):
    tables(spark, tmp_path)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.collect() == []
