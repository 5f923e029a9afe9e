import binascii

from headwater.llm.language import BITS, GRAM, PLACES, gram_hashes, identify, identify_held_out, learn_filters


def grams(text):
    small = "".join(c.lower() if c.isalpha() else " " for c in text)
    small = " " + " ".join(small.split()) + " " if small.split() else " "
    return [small[i : i + GRAM] for i in range(len(small) - GRAM + 1)]


def test_grams():
    texts = ["Ab, cd!", "", "x", "ÄÖ  ü9z", "ab cd"]
    hashes, owner, lettered = gram_hashes(texts)
    assert [int((owner == i).sum()) for i in range(5)] == [len(grams(t)) for t in texts]
    assert lettered.tolist() == [True, False, True, True, True]
    assert (hashes >= 0).all() and hashes[owner == 0].tolist() == hashes[owner == 4].tolist()


def test_filters_hold_every_kept_gram(spark):
    rows = [(i, "the cat sat on the mat" if i % 2 else "der hund lief in den wald", "en" if i % 2 else "de") for i in range(20)]
    filters = learn_filters(spark.createDataFrame(rows, "doc_id long, text string, lang string"), "doc_id", "text", "lang")
    for number, language in enumerate(filters.languages):
        text = next(t for _, t, w in rows if w == language)
        hashes, _, _ = gram_hashes([text])
        for j in range(PLACES):
            assert ((filters.masks[(hashes >> (BITS * j)) & ((1 << BITS) - 1), 0] >> number) & 1).all()
    assert filters.decide(["the cat", "den wald", "1 2"])[0] == ["en", "de", "und"]


def test_odd_rows(spark):
    rows = [(i, "the cat sat on the mat" if i % 2 else "der hund lief in den wald", "en" if i % 2 else "de", "x") for i in range(20)]
    rows += [(None, None, "en", "x"), (30, "", None, None), (30, "12 !!", "de", "x"), (30, "qqqq", None, "x"), (31, "the cat " * 20_000, None, "x")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, score string")
    got = sorted(((r.doc_id, r.lang_pred) for r in identify(df, df).collect() if r.doc_id is None or r.doc_id >= 30), key=repr)
    assert got == sorted([(None, "und"), (30, "und"), (30, "und"), (30, "de"), (31, "en")], key=repr)
    assert identify(df.limit(0), df).count() == 0
    assert {r.lang_pred for r in identify(df, df.limit(0)).collect()} == {"und"}


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    truth = {r.doc_id: r.lang for r in docs.collect()}
    got = identify_held_out(docs).collect()
    assert len(got) == len(truth)
    for r in got:
        assert r.held_out == (binascii.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1
    held = [r for r in got if r.held_out and truth[r.doc_id]]
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.95 * len(held)
