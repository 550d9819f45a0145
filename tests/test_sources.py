"""Readers, sinks and lookups."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tessellex import sources
from tessellex.functions import text


def test_lines_are_numbered_across_pieces(spark, tmp_path):
    dev, test = [f"dev {i} é" for i in range(4000)], ["", "b", ""]
    (tmp_path / "dev").write_text("\n".join(dev) + "\n")
    (tmp_path / "test").write_text("\n".join(test) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")  # several pieces a file
    try:
        paths = {"dev": str(tmp_path / "dev"), "test": str(tmp_path / "test")}
        got = {(r.split, r.line): r.text for r in sources.read_lines(spark, paths).collect()}
        assert got == {**{("dev", i): t for i, t in enumerate(dev)}, **{("test", i): t for i, t in enumerate(test)}}
        cut = {(r.split, r.line) for r in sources.read_lines(spark, paths, limit=4002).collect()}
        assert cut == {("dev", i) for i in range(4000)} | {("test", 0), ("test", 1)}
        assert {r.line for r in sources.read_lines(spark, paths, limit=10).collect()} == set(range(10))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_nli(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text("".join(f'{{"premise": "p{i}", "hypothesis": "h{i}", "label": {i % 3}}}\n' for i in range(5)))
    assert [tuple(r) for r in sources.read_nli(spark, str(tmp_path / "x.jsonl"), limit=2).orderBy("line").collect()] == [(0, "p0", "h0", 0), (1, "p1", "h1", 1)]


def test_csv_and_index(spark, tmp_path):
    d = spark.createDataFrame([("a,b", 'say "x"', None), ("line\nbreak", "", 2.5)], "k string, s string, v double")
    sources.write_csv(d, str(tmp_path), "t.csv", "a table")
    sources.write_csv(d.select("k"), str(tmp_path), "u.csv", "another")
    assert {tuple(r) for r in sources.read_csv(spark, str(tmp_path / "t.csv")).select("k", "s", "v").collect()} == {("a,b", 'say "x"', None), ("line\nbreak", None, "2.5")}
    assert {(r.name, r.columns, r.n_rows) for r in sources.read_csv(spark, str(tmp_path / "INDEX")).collect()} == {("t.csv", "k,s,v", "2"), ("u.csv", "k", "2")}
    sources.log_values(d.where("v is not null"), "fig1", "k", "v", "t.csv", str(tmp_path / "log"))
    assert [tuple(r) for r in spark.read.parquet(str(tmp_path / "log")).collect()] == [("fig1", "line\nbreak", 2.5, "t.csv")]


def test_write_once_and_resume(spark, tmp_path):
    d = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    sources.write_once(d, str(tmp_path / "o"), "test")
    sources.write_once(d.where("k = 1"), str(tmp_path / "o"), "again")
    kept = spark.read.parquet(str(tmp_path / "o"))
    assert kept.count() == 2 and kept.select("_source").distinct().head()[0] == "test" and "spark" in kept.head()._versions
    assert [r.k for r in sources.remaining(d, kept.where("k = 1"), ["k"]).collect()] == [2]


def test_sheets_and_cache_must_be_whole(spark):
    a, b = spark.createDataFrame([(1, "x"), (2, "y")], "i int, t string"), spark.createDataFrame([(1, 0), (2, 1)], "i int, label int")
    assert {tuple(r) for r in sources.aligned_sheets(a, b, "i").select("i", "t", "label").collect()} == {(1, "x", 0), (2, "y", 1)}
    with pytest.raises(PySparkException, match="different rows"):
        sources.aligned_sheets(a, b.where("i = 1"), "i").collect()
    cache = spark.createDataFrame([("x", "X")], "t string, norm string")
    assert sources.lookup(a.where("i = 1"), cache, "t", "norm").head().norm == "X"
    with pytest.raises(PySparkException, match="no normalised form"):
        sources.lookup(a, cache, "t", "norm").collect()


def test_text_sets(spark):
    sets = sources.TextSets(a=lambda: spark.createDataFrame([(2, "y"), (1, "x")], "id int, text string"))
    assert [tuple(r) for r in sets("a", limit=1).collect()] == [(1, "x")]
    with pytest.raises(KeyError):
        sets("b")


def test_model_dump(spark, tmp_path):
    from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
    from pyspark.ml.functions import array_to_vector

    d = spark.createDataFrame([(float(i % 2), [float(i % 2)]) for i in range(20)], "label double, x array<double>").select("label", array_to_vector("x").alias("features"))
    m = LogisticRegression().fit(d)
    sources.save_model(m, str(tmp_path / "m"))
    assert LogisticRegressionModel.load(str(tmp_path / "m")).coefficients == m.coefficients


def test_conllu_file(spark, tmp_path):
    (tmp_path / "t.conllu").write_text("# text = A cat\n1\tA\tA#\tDET\n2-3\tx\tx\tX\n2\tcat\tCat\tNOUN\n2.1\ty\ty\tX\n\n# text = B\n1\tB\tb\tX\n\n")
    got = sources.read_conllu(spark, str(tmp_path / "t.conllu")).collect()
    assert [(r.text, [tuple(t) for t in r.tokens]) for r in got] == [("A cat", [("A", "a", "DET"), ("cat", "cat", "NOUN")]), ("B", [("B", "b", "X")])]


def test_p_text_rounds_the_binary_value(spark):
    """0.5065 is stored as a little less, 0.0625 exactly; DuckDB's round gives the same."""
    one = lambda c: spark.range(1).select(c).head()[0]
    assert [one(text.p_text(F.lit(p))) for p in (0.5065, 0.0625, 0.9996, 0.001)] == ["0.506", "0.063", "1.000", "0.001"]


def test_text_reports(spark):
    one = lambda c: spark.range(1).select(c).head()[0]
    assert [one(text.as_printed(F.lit(p), F.lit(v))) for p, v in (("0.12", 0.1249), ("0.12", 0.126), ("1.2e-3", 0.00124), ("1.2e-3", 0.00126), ("-3", -3.4), ("9.2e+2", 918.0))] == [True, False, True, False, True, True]
    assert one(text.numbers(F.lit("a 1.5e-3, -2 and 7E5"))) == ["1.5e-3", "-2", "7E5"]
    assert [one(text.p_text(F.lit(p))) for p in (0.0004, 0.0012, 0.05)] == ["<0.001", "0.001", "0.050"]
    assert one(text.prompt("Q: {q} A: {a}", q=F.lit("x"), a=F.lit(None).cast("string"))) == "Q: x A: "
    assert one(text.clean_lemma(F.lit("كِتَاب#"), F.lit("ar"))) == "كتاب" and one(text.clean_lemma(F.lit("É#a"), F.lit("fr"))) == "éa"
    assert one(text.rouge1(F.array(*map(F.lit, "a a b".split())), F.array(*map(F.lit, "a b b".split())))) == pytest.approx(4 / 6)


def test_result_tables(spark, tmp_path):
    """Nested results of every shape, absent values included."""
    import json

    from tessellex.plans.tables import SHAPES, result_table

    (tmp_path / "d.json").write_text(json.dumps({"u1": {"mnb": {"42": {"n_folds": 10, "delta_mean": 0.5, "delta_ci95": [0.25, 0.75], "mcnemar": {"p": 0.01, "exact": False}}, "7": {"n_folds": 5}}}, "u2": {}}))
    got = {(r.unit, r.classifier, r.seed): (r.n_folds, r.delta_ci95_lo, r.delta_ci95_hi, r.mcnemar_p, r.mcnemar_exact, r.d_z) for r in result_table(spark, str(tmp_path / "d.json"), "downstream").collect()}
    assert got == {("u1", "mnb", "42"): ("10", "0.25", "0.75", "0.01", "false", None), ("u1", "mnb", "7"): ("5", None, None, None, None, None)}
    (tmp_path / "s.json").write_text('{"u": {"0.5": 0.7, "1": 0.6}}')
    assert {tuple(r) for r in result_table(spark, str(tmp_path / "s.json"), "sweep").collect()} == {("u", "0.5", "0.7"), ("u", "1", "0.6")}
    (tmp_path / "r.json").write_text('{"fi": {"tok": {"k1": {"R@1": 0.5, "mean_rank": 3}}}}')
    (r,) = result_table(spark, str(tmp_path / "r.json"), "retrieval").collect()
    assert (r.lang, r.condition, r.params, r["R@1"], r["MRR@10"], r.mean_rank) == ("fi", "tok", "k1", "0.5", None, "3")
    assert all(result_table(spark, str(tmp_path / "s.json"), s).columns == [*k, *f] for s, (k, f) in SHAPES.items())
