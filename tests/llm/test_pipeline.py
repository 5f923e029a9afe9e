from pyspark.sql import functions as F

import corpus_pipeline
from headwater.llm import jaccard, secrets
from headwater.llm.common import Scratch, table

FOLDER = "/root/testdata/sf0.001"


def test_stages_hand_on_documents(spark, tmp_path):
    docs = table(spark, FOLDER, "documents")
    columns, given = docs.columns, {r.doc_id for r in docs.select("doc_id").collect()}
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, FOLDER).write.parquet(str(tmp_path / str(number)))
        docs = spark.read.parquet(str(tmp_path / str(number)))
        ids = {r.doc_id for r in docs.select("doc_id").collect()}
        assert ids and ids <= given
        given = ids
        if number < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
        if number == 1:
            assert all(r.n_links == 0 for r in jaccard.similar_documents(docs).collect())
        if number == 2:
            assert all(r.spans == "" for r in secrets.find_secrets(docs).collect())
    assert all(r.round_trip for r in docs.collect())


def test_run(spark):
    out = corpus_pipeline.run(spark, FOLDER)
    assert out.count() > 0 and "ids" in out.columns


def test_empty_input(spark):
    docs = table(spark, FOLDER, "documents").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, FOLDER)
        assert docs.count() == 0


def test_odd_rows_and_names(spark):
    """Null keys and texts, repeated rows, a very long text, thousands of copies, and columns named like helpers."""
    base = table(spark, FOLDER, "documents").limit(60)
    extra = ["row", "rows", "_rows", "_head", "rate", "copy", "p_toxic", "key", "id", "a.b"]
    odd = [(None, "a text without a key that is long enough", "en", "s", 1), (900001, None, "en", "s", 0), (900002, "", None, None, 0), (900003, "word other " * 60_000, "en", "s", 9)]
    odd += [(900010, "said twice in one table with enough words", "en", "s", 3)] * 2 + [(910000 + i, "the very same text of more than five words " * 3, "en", "hot", 4) for i in range(3000)]
    docs = base.unionByName(spark.createDataFrame(odd, base.schema)).select("*", *(F.lit(str(i)).alias(c) for i, c in enumerate(extra)))
    columns = docs.columns
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = Scratch(spark).keep(stage(spark, docs, FOLDER), name)
        ids = [r.doc_id for r in docs.select("doc_id").collect()]
        if number < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
            assert all(tuple(r) == tuple(map(str, range(len(extra)))) for r in docs.select(*(f"`{c}`" for c in extra)).distinct().collect())
        assert {None, 900001, 900002, 900003} <= set(ids)
        if number >= 1:
            assert [i for i in ids if i is not None and i >= 910000][:1] == [910000] and ids.count(910001) == 0
            assert ids.count(900010) >= 1 and (number > 1 or ids.count(900010) == 1)
    assert max(r.n_pieces for r in docs.collect()) > 100_000
