import pytest
from pyspark.sql import functions as F

from tessellex.plans import NormalizationStudy
from tessellex.streaming import streaming_vocabulary


def corpus(spark, f):
    rows = [(i, t, f(t), i % 2) for i, t in enumerate(["Cats and dogs", "Dogs and cats run", "A cat ran", "The Dog runs"] * 5)]
    return spark.createDataFrame(rows, "doc_id long, raw string, norm string, label int")


def test_identity(spark):
    r = NormalizationStudy(corpus(spark, lambda t: t)).evaluate_all().head()
    assert (r.cr, r.irs, r.aes, r.anld, r.delta, r.p) == (1.0, 1.0, 0.0, 0.0, 0.0, 1.0)
    assert r.kl == pytest.approx(0)


def test_lower(spark):
    r = NormalizationStudy(corpus(spark, str.lower)).evaluate_all().head()
    assert r.cr == pytest.approx(12 / 10) and 0 < r.aes < 1 and r.anld > 0 and r.kl > 0


def test_encoder_and_classifiers(spark):
    """Vectors from a hook, and every classifier over the same folds."""
    rows = [(i, w := ("good " if i % 2 else "bad ") * 3 + f"w{i}", w.upper(), i % 2) for i in range(40)]
    d = spark.createDataFrame(rows, "doc_id long, raw string, norm string, label int")
    load = lambda: lambda texts: [[float(t.lower().count("good")), 1.0, float(t.isupper())] for t in texts]
    study = NormalizationStudy(d, encoder=load)
    want = sum((9 * (i % 2) + 1) / (((9 * (i % 2) + 1) ** 0.5) * ((9 * (i % 2) + 2) ** 0.5)) for i in range(40)) / 40
    assert study.irs().head().irs == pytest.approx(want)
    for clf in ("mnb", "lr", "rf"):
        r = study.downstream(k=4, classifier=clf).head()
        assert (r.f1_raw, r.f1_norm, r.delta, r.p) == (1.0, 1.0, 0.0, 1.0)


def test_delimiter_and_tokenizer(spark):
    d = spark.createDataFrame([(1, "a|b|A", "a|b|a")], "doc_id long, raw string, norm string")
    assert NormalizationStudy(d, delimiter="|").cr().head().cr == 3 / 2
    assert NormalizationStudy(d, tokenizer=lambda c: F.split(c, "")).cr().head().cr == 4 / 3


def test_a_missing_side_raises(spark):
    with pytest.raises(ValueError):
        NormalizationStudy(corpus(spark, str.lower).withColumn("norm", F.lit(None).cast("string")))


def test_stream(spark, tmp_path):
    spark.createDataFrame([("en", "a b a"), ("de", "c")], "lang string, text string").write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema("lang string, text string").parquet(str(tmp_path / "in"))
    q = streaming_vocabulary(s, ["lang"]).writeStream.outputMode("complete").format("memory").queryName("types").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {(r.lang, r.token, r.n) for r in spark.table("types").collect()} == {("en", "a", 2), ("en", "b", 1), ("de", "c", 1)}
