import random
import zlib

from scholium.llm import language_id as L


def corpus():
    rng = random.Random(2)
    letters = {"en": "aeiothrnsl", "de": "ueiäöcknst", "fr": "éeaouqivrd", "ru": "аеионтсрвл"}
    vocab = {k: ["".join(rng.choices(v, k=rng.randint(1, 8))) for _ in range(300)] for k, v in letters.items()}
    rows = []
    for i in range(400):
        lang = rng.choice(list(vocab))
        rows.append((i, " ".join(rng.choices(vocab[lang], k=rng.randint(8, 120))), lang))
    return rows


def test_held_out_accuracy(spark):
    rows = corpus()
    odd = [(900, None, "en"), (901, "", "de"), (902, "123 ... !!", "fr"), (903, rows[0][1], None), (None, rows[1][1], None), rows[2], (904, rows[3][1] * 400, None)]
    df = spark.createDataFrame([(*r, 0.5, "zz") for r in rows + odd], "doc_id long, text string, lang string, score double, lang_pred string")
    model = L.fit(df)
    got = L.identify(df, model).collect()
    assert len(got) == len(rows + odd)
    held = {i for i, _, _ in rows if zlib.crc32(str(i).encode()) % 5 == 0}
    truth = {i: lang for i, _, lang in rows}
    right = [r.lang_pred == truth[r.id] for r in got if r.id in held]
    assert len(right) > 50 and sum(right) >= 0.98 * len(right)
    for r in got:
        if r.id in (900, 901, 902):
            assert (r.lang_pred, r.score, r.rejected) == ("und", 0.0, True)
        assert 0 <= r.score <= 1
    same = {r.id: r for r in got}
    assert same[903].lang_pred == rows[0][2] and same[904].lang_pred == rows[3][2]
    kept = L.keep_identified(df, model)
    assert kept.columns == df.columns
    assert kept.count() == sum(not r.rejected for r in got) >= 400


def test_labels_are_no_input(spark):
    rows = corpus()[:100]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    other = spark.createDataFrame([(i, t, "de" if zlib.crc32(str(i).encode()) % 5 == 0 else lang) for i, t, lang in rows], "doc_id long, text string, lang string")
    key = lambda r: (r.id, r.lang_pred, r.score)
    assert sorted(map(key, L.identify(df, L.fit(df)).collect())) == sorted(map(key, L.identify(df, L.fit(other)).collect()))


def test_nothing_to_learn(spark):
    df = spark.createDataFrame([(1, "some text", None)], "doc_id long, text string, lang string")
    r = L.identify(df, L.fit(df)).collect()[0]
    assert (r.lang_pred, r.score) == ("und", 0.0)
    assert L.identify(df.limit(0), L.fit(df.limit(0))).collect() == []
