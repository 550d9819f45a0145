import pytest
from tests_support import DATA, same

import corpus_pipeline
from tessellex.llm import registry


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_sql(spark, duck, name):
    sf = str(DATA / "sf0.001")
    same(registry.QUERIES[name](spark, sf).toPandas(), duck(sf).execute(registry.SQL[name]).df())


def test_pipeline(spark):
    sf = str(DATA / "sf0.001")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    n, columns = docs.count(), docs.columns
    from tessellex.llm.common import materialize

    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = materialize(stage(spark, docs, sf))
        assert 0 < docs.count() <= n
        n = docs.count()
        assert i == 4 or docs.columns == columns
    assert docs.where("taken > 0").count() == n


def test_pipeline_stages_on_nothing(spark):
    sf = str(DATA / "sf0.001")
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
        assert docs.count() == 0


def test_held_out_languages(spark):
    sf = str(DATA / "sf0.01")
    got = registry.QUERIES["op3_language_id"](spark, sf).where("held_out").toPandas()
    truth = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").toPandas()
    both = got.merge(truth, on="doc_id")
    assert (both.lang_pred == both.lang).mean() >= 0.95


def test_held_out_toxicity(spark):
    """Precision, recall and area under the curve at sf0.1, where toxic rows are enough to learn from."""
    sf = str(DATA / "sf0.1")
    got = registry.QUERIES["op6_toxicity"](spark, sf).where("held_out").toPandas()
    both = got.merge(spark.read.parquet(f"{sf}/labels.parquet").toPandas(), on="doc_id")
    toxic, found = both.toxic == 1, both.predicted == 1
    rank = both.score.rank()
    auc = (rank[toxic].sum() - toxic.sum() * (toxic.sum() + 1) / 2) / (toxic.sum() * (~toxic).sum())
    assert toxic[found].mean() >= 0.95 and found[toxic].mean() >= 0.9 and auc >= 0.95


@pytest.mark.parametrize("labelled", [False, True])
def test_language_stage_keeps_lettered_texts_when_nothing_is_learned(spark, labelled):
    """lang null throughout, and labels on rows of a null doc_id only."""
    rows = [(i, "some words of a text", None) for i in range(9)] + [(20, "12 !", None), (21, None, None), (22, "", None), (None, "more words", "en" if labelled else None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = corpus_pipeline.language_stage(spark, docs, "")
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, (r for r in rows if r[1] and r[1] != "12 !")))


def test_near_stage_keeps_the_unique_text_of_a_repeated_doc_id(spark):
    copy, own = (" ".join(f"{w}{i}" for i in range(30)) for w in ("copy", "own"))
    docs = spark.createDataFrame([(1, copy), (5, copy), (5, own), (6, copy)], "doc_id long, text string")
    assert sorted(map(tuple, corpus_pipeline.near_stage(spark, docs, "").collect())) == [(1, copy), (5, own)]
