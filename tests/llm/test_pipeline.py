import os

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from palio.llm import queries  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.exists(SF), reason="no test tables")
def test_stages_keep_columns_and_take_effect(spark):
    docs = corpus_pipeline.tables(spark, SF, "documents")
    columns, n = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs, _ = corpus_pipeline.stored(stage(spark, docs, SF), "test")
        assert docs.columns == columns
        assert 0 < docs.count() <= n, name
        n = docs.count()
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert packed.select("doc_id").distinct().count() == n


def test_every_operator_has_a_query():
    assert sorted(int(k[2:].split("_")[0]) for k in queries.QUERIES) == list(range(1, 11))


@pytest.mark.skipif(not os.path.exists(SF), reason="no test tables")
def test_columns_of_any_names_nulls_and_repeated_rows_pass(spark):
    from pyspark.sql import functions as F

    names = ["n_words", "kept", "_row", "spans", "rest", "n_removed", "p_toxic", "_key", "_id", "_text", "carried", "__row__", "label", "h", "k"]
    docs = corpus_pipeline.tables(spark, SF, "documents").limit(40)
    odd = docs.limit(3).withColumn("doc_id", F.lit(None).cast("long")).unionByName(docs.limit(2)).unionByName(docs.limit(1).withColumn("text", F.lit(None).cast("string")))
    docs = docs.unionByName(odd).withColumns({n: F.lit(n) for n in names})
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs, _ = corpus_pipeline.stored(stage(spark, docs, SF), "test")
        assert docs.columns == columns, name
        assert docs.where(" or ".join(f"`{n}` <> '{n}'" for n in names)).count() == 0, name
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() >= docs.count() > 0
