import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from headwater.llm.pieces import Transducer, decode, encode, plain

PATH = public_tokenizers.path("piece_bpe_32k.model")
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=PATH)
MODEL = Transducer(open(PATH, "rb").read())


def check(text):
    ids = MODEL.encode(text).tolist()
    assert ids == LIBRARY.encode(text)
    assert MODEL.decode(ids) == LIBRARY.decode(ids) == plain(MODEL, text)


@pytest.mark.parametrize("text", ["", " ", "   ", "Hello  world", " x", "x ", "a\n\n b\tc", "é😀 日本語", "<0x0A> <s></s><unk>", "▁a ▁▁b", " " * 70 + "x" + " " * 33, "!!!!!!!====----", "internationalization's", "x" * 400, "\r\n\0"])
def test_like_the_library(text):
    check(text)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=50))
def test_random_texts(text):
    check(text)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="aeinrst h▁.,\n-", max_size=60))
def test_random_words(text):
    check(text)


def test_table(spark):
    rows = [(1, "Two words", "x"), (1, "Two words", "y"), (None, None, "z"), (4, "", None), (5, "word " * 3000, "k")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids string")
    got = encode(df, PATH)
    assert sorted(map(tuple, got.select("doc_id", "n_pieces", "round_trip").collect()), key=repr) == sorted([(k, len(LIBRARY.encode(t or "")), True) for k, t, _ in rows], key=repr)
    assert sorted((r.doc_id or 0, r.text) for r in decode(got, PATH).collect()) == sorted((k or 0, t or "") for k, t, _ in rows)
    assert encode(df.limit(0), PATH).count() == 0


def test_documents(spark, documents):
    texts = {r.doc_id: r.text or "" for r in documents.collect()}
    got = encode(documents, PATH).collect()
    assert all(r.round_trip and r.ids == LIBRARY.encode(texts[r.doc_id]) for r in got) and len(got) == len(texts)


def test_unigram_takes_the_best_path():
    def field(number, value):
        return bytes([number << 3 | 2, len(value)]) + value

    import struct

    pieces = [("<unk>", 0.0, 2), (MARK_A, -1.0, 1), ("b", -1.5, 1), ("ab", -1.0, 1), ("a", -3.0, 1), ("▁", -2.0, 1)]
    raw = b"".join(field(1, field(1, p.encode()) + b"\x15" + struct.pack("<f", s) + bytes([3 << 3, k])) for p, s, k in pieces)
    model = Transducer(raw)
    # mark a + b weighs 2.5; mark + ab weighs 3.
    assert [model.pieces[i] for i in model.encode("ab")] == [MARK_A, "b"]
    assert model.encode("q").tolist() == [5, 0]


MARK_A = "▁a"
