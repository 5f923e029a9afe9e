import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from headwater.llm.token_counts import Counter, count_tokens, whole_tokens

PATH = public_tokenizers.path("word_bpe_49k.json")
SPEC = open(PATH, encoding="utf-8").read()
LIBRARY = Tokenizer.from_file(PATH)
COUNTER = Counter(SPEC, whole_tokens(SPEC))


def expected(text):
    return len(LIBRARY.encode(text, add_special_tokens=False).ids)


@pytest.mark.parametrize("text", ["", " ", "Hello world", "don't we'll", "a\x1cb\x1dc", "ΣΑΣ όσΟΣ", "İstanbul ﬁ", "x<|endoftext|>y <|startoftext|>", "<|endoftext|", "é ́x", "12345 ½ ٣", "日本語 テスト 한국어", "a b c\u0085d", "😀👍🏽 …—", "q" * 5000, "\0 null\0"])
def test_like_the_library(text):
    assert COUNTER.count([text]) == [expected(text)]


@settings(max_examples=400, deadline=None)
@given(st.text(max_size=60))
def test_random_texts(text):
    assert COUNTER.count([text]) == [expected(text)]


def test_every_letter():
    texts = [f"a{chr(c)}b {chr(c)}{chr(c)} '{chr(c)}" for c in range(1, 0x3000) if not 0xD800 <= c < 0xE000]
    assert COUNTER.count(texts) == [expected(t) for t in texts]


def test_table(spark):
    rows = [(1, "Two words", "x"), (1, "Two words", "y"), (None, None, "z"), (4, "", None), (5, "word " * 3000, "k")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, n_tokens string")
    got = sorted(map(tuple, count_tokens(df, PATH).collect()), key=repr)
    want = [(k, len((t or "").encode()), expected(t or ""), expected(t or "") > 2048) for k, t, _ in rows]
    assert got == sorted(want, key=repr)
    assert count_tokens(df.limit(0), PATH).count() == 0


def test_documents(spark, documents):
    got = {r.doc_id: r.n_tokens for r in count_tokens(documents, PATH).collect()}
    assert got == {r.doc_id: expected(r.text or "") for r in documents.collect()}
