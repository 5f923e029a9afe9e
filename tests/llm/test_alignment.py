import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from headwater.llm import alignment

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def pair():
    return alignment._pair(tuple(open(p, "rb").read() for p in (A, B)))


@pytest.fixture(scope="module")
def library(pair):
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=B)

    def encode(text):
        raw = f" {text}".encode()
        found = a.encode(f" {text}", add_special_tokens=False).ids, b.encode(text)
        spelt = b"".join(pair.a.bytes[i] for i in found[0]), b"".join(pair.b.bytes[i] for i in found[1])
        return found if text and spelt == (raw, raw) else ([], [])

    return encode


def groups_of(pair, ids_a, ids_b):
    ends = lambda ids, of: set(np.cumsum([len(of.bytes[i]) for i in ids]).tolist())
    out, at = [], [0, 0, 0, 0]
    for end in sorted(ends(ids_a, pair.a) & ends(ids_b, pair.b)):
        group = []
        for k, (ids, of) in enumerate(((ids_a, pair.a), (ids_b, pair.b))):
            start = at[k]
            while at[2 + k] < end:
                at[2 + k] += len(of.bytes[ids[at[k]]])
                at[k] += 1
            group.append(ids[start : at[k]])
        out.append(group)
    return out


def brute(pair, library, texts):
    found = [groups_of(pair, *library(t or "")) for t in texts]
    links = [Counter((a, b) for ga, gb in groups for a in ga for b in gb) for groups in found]
    counts = Counter(p for c in links for p in c)
    best = {}
    for (a, _), n in counts.items():
        best[a] = max(best.get(a, 0), n)
    out = []
    for groups, c in zip(found, links, strict=True):
        written = ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in groups)
        out.append((
            sum(len(a) for a, _ in groups), sum(len(b) for _, b in groups), len(groups), sum(c.values()),
            sum(n for p, n in c.items() if counts[p] == best[p[0]]), sum(n * counts[p] for p, n in c.items()),
            hashlib.sha256(written.encode()).hexdigest() if written else "",
        ))
    return out


TEXTS = [
    None, "", " ", "  two  blanks  ", "a", "plain words of a text", "don't we'll I'd 's", "<|endoftext|> <s> </s> <unk> <0x41>", "a▁b", "tab\tand\nnew\r\n\r\n  line", "日本語のテキスト、漢字かな", "😀👩‍👩‍👧 é é",
    "x" * 500, "ab1" * 300, "=" * 300 + "!" * 50, " nb sp ", "ÀÉÎÕÜ ßẞ", "0123456789" * 30, "nul\x00in\x1ftext", " \n \n\n", "plain words of a text",
]


def test_against_the_libraries(spark, pair, library, documents):
    texts = TEXTS + [r.text for r in documents.limit(60).collect()]
    rows = [(i if i % 7 else None, t, 1, "c") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, rec int, pairs string")
    got = sorted(map(tuple, alignment.align_documents(df, A, B).collect()), key=repr)
    want = sorted(((i, *b) for (i, *_), b in zip(rows, brute(pair, library, texts), strict=True)), key=repr)
    assert got == want
    assert alignment.align_documents(df.limit(0), A, B).count() == 0


def test_long_texts_over_several_tasks(spark, pair, library, monkeypatch):
    monkeypatch.setattr(alignment, "RANGE", 40)
    rng = random.Random(1)
    words = ["the", "language", "x9y8z7", "Wort", "日本", "'s", "=" * 9, "a1" * 30, "\n\n", "  ", "été", "z" * 90, "▁"]
    texts = [rng.choice(["", " "]).join(rng.choices(words, k=rng.randrange(1, 600))) for _ in range(40)] + ["short", None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    # The workers cut by the constant that was there when they were started, so ranges are made here.
    packs = []
    for i, t in enumerate(texts):
        if t and len(t) > 40:
            packs += [(i, n, i, *r) for n, r in enumerate(alignment.ranges(pair, t))]
    cut = spark.createDataFrame(packs, "rec bigint, chunk int, key int, a_from bigint, b_from bigint, a_text string, b_text string")
    assert max(p[1] for p in packs) > alignment.FAN**2
    scratch = alignment.Scratch(spark)
    shared = spark.sparkContext.broadcast(tuple(open(p, "rb").read() for p in (A, B)))
    got = {r["keys"][0]: (r.n_a[0], r.n_b[0], r.n_groups[0], r.n_links[0], r.digests[0]) for r in alignment._long_packs(cut, shared, scratch).collect()}
    want = {i: (b[0], b[1], b[2], b[3], b[6]) for i, b in enumerate(brute(pair, library, texts)) if texts[i] and len(texts[i]) > 40}
    assert got == want and any(w[0] for w in want.values())
    assert df.count() == 42


def test_composition_is_associative(pair, library):
    rng = random.Random(2)
    same = lambda f, g: all(np.array_equal(getattr(f, n), getattr(g, n)) for n in ("a", "b", "cut_a", "cut_b")) and (f.last, f.whole) == (g.last, g.whole)
    for _ in range(150):
        text = "".join(rng.choices(["a", "b1", " the", " ", "日本", "==", "xyz", "\n", " language"], k=40))
        parts = [alignment.range_fragment(pair, *r) for r in alignment.ranges(pair, text, rng.choice([1, 3, 7, 20]))]
        whole = alignment.range_fragment(pair, 0, 0, f" {text}", f" {text}")
        while len(parts) > 1:
            i = rng.randrange(len(parts) - 1)
            parts[i : i + 2] = [alignment.compose(pair, parts[i], parts[i + 1])]
        assert same(parts[0], whole)


def test_wide_groups_count_like_narrow_ones(pair, library, monkeypatch):
    of = alignment.align_texts(pair, ["été 日本語 xyzzy", "plain", "ab1" * 40])
    want = alignment.linked(of, len(pair.b.bytes))
    monkeypatch.setattr(alignment, "WIDE", 0)
    assert all(np.array_equal(x, y) for x, y in zip(want, alignment.linked(of, len(pair.b.bytes)), strict=True))


def test_long_document_in_the_whole_operator(spark, pair, library):
    long = "word another été 12ab " * 12_000  # four ranges
    unbroken = "x" * 90_000  # no place to cut
    df = spark.createDataFrame([(1, long), (2, "word another"), (3, unbroken), (4, long + "▁")], "doc_id bigint, text string")
    got = sorted(map(tuple, alignment.align_documents(df, A, B).collect()))
    want = brute(pair, library, [long, "word another", unbroken, long + "▁"])
    assert got == [(i + 1, *w) for i, w in enumerate(want)]
    counts = {(r.a_id, r.b_id): (r.n_docs, r.is_best) for r in alignment.count_links(df, A, B).collect()}
    assert max(n for n, _ in counts.values()) == 2 and any(best for _, best in counts.values())
