import pytest
from pyspark.sql import functions as F

from cohortsmith.functions import cleaning as C
from cohortsmith.functions import labels as L
from cohortsmith.operators import columns as K
from cohortsmith.operators.impute import clinical_features, median_fill, median_table
from cohortsmith.operators.labels import drop_unlabeled, require_two_classes
from cohortsmith.operators.shape import unpivot_features
from cohortsmith.sources import readers, writers


def one(spark, values, dtype, col):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {dtype}")
    return [r[0] for r in df.orderBy("i").select(col(F.col("v"))).collect()]


def test_number_cells(spark):
    cells = ["1.5", " 2 ", "1e3", "-.5", "+3.", "NaN;", "NaN", "nan", "", " ", None, "1d", "2f", "1_000", "Infinity", "inf", "abc", "1e999", "."]
    got = one(spark, cells, "string", C.clean_numeric)
    assert got == [1.5, 2.0, 1000.0, -0.5, 3.0] + [None] * 14


def test_contains_nan(spark):
    assert one(spark, ["xNaNy", "  ", "nan", "1"], "string", C.contains_nan_to_null) == [None, None, "nan", "1"]


def test_nan_is_missing(spark):
    assert one(spark, [1.0, float("nan"), None], "double", C.fill_zero) == [1.0, 0.0, 0.0]


def test_suffix_labels(spark):
    ids = ["A.C", "B.CVC", "LC.1", " LC.2.C ", "LC.3\n", "x", None, "c.c"]
    assert one(spark, ids, "string", L.label_suffix_strict) == [0, 0, 1, 0, 1, None, None, None]
    assert one(spark, ids, "string", L.label_suffix_lenient) == [0, 0, 1, 1, 1, 1, None, 1]


def test_binarize(spark):
    assert one(spark, [0, 1, 2, None, -1], "int", L.binarize_target) == [0, 1, 1, 0, 0]
    assert one(spark, [0, 2, None], "int", lambda c: L.binarize_target(c, "keep")) == [0, 1, None]
    with pytest.raises(ValueError):
        L.binarize_target(F.lit(1), "other")


@pytest.fixture(scope="module")
def messy(spark):
    """Columns named with odd characters: all null, constant, constant and null, half and just over half numeric."""
    rows = [
        (f"LC.{i}" if i % 2 else f"H{i}.C", None, "7", "7" if i % 3 else "NaN;", "1.0" if i < 10 else "x", str(i) if i < 11 else "", f" {i} ")
        for i in range(20)
    ]
    cols = ["x0_LC_ID", "x1_[all]/null", "x1_const.", "x1_const(+null)", "x0_Symp_Survey_half", "x1_51-pct", "x1_good.one"]
    schema = ", ".join(f"`{c}` string" for c in cols)
    return spark.createDataFrame(rows, schema)


def test_filters_on_the_wide_sheet(messy):
    feats = messy.columns[1:]
    long = unpivot_features(messy, ["x0_LC_ID"], feats, cast="string")
    long = long.withColumn("value", C.clean_numeric(F.col("value")))
    p = K.profile_features(long)

    def kept(d):
        return {r["feature"] for r in d.filter("kept").collect()}

    assert kept(K.numeric_rate(p)) == {"x1_const.", "x1_const(+null)", "x1_51-pct", "x1_good.one"}
    assert kept(K.not_all_null(p)) == set(feats) - {"x1_[all]/null"}
    assert kept(K.not_constant(p)) == {"x1_const(+null)", "x0_Symp_Survey_half", "x1_51-pct", "x1_good.one"}
    assert kept(K.not_zero_variance(p)) == {"x1_51-pct", "x1_good.one"}
    assert kept(K.variance_above(p)) == {"x1_51-pct", "x1_good.one"}
    assert "x0_Symp_Survey_half" not in K.drop_by_substring(messy).columns
    assert "x0_LC_ID" not in K.drop_columns(messy).columns
    assert K.drop_features_by_substring(long).filter("feature like '%Survey%'").count() == 0
    picked = K.select_columns(messy, ["x0_LC_ID"], K.variance_above(p).filter("kept"))
    assert picked.columns == ["x0_LC_ID", "x1_51-pct", "x1_good.one"]


def test_unpivot_in_chunks(spark, monkeypatch):
    from cohortsmith.operators import shape

    monkeypatch.setattr(shape, "UNPIVOT_CHUNK", 2)
    df = spark.createDataFrame([(1, 1.0, 2.0, float("nan"))], "id int, a double, b double, c double")
    got = {(r["feature"], r["value"]) for r in shape.unpivot_features(df, ["id"], ["a", "b", "c"]).collect()}
    assert got == {("a", 1.0), ("b", 2.0), ("c", None)}


def test_median_fill_with_empty_feature(spark):
    long = spark.createDataFrame([(1, "a", 1.0), (2, "a", None), (3, "a", 4.0), (1, "b", None)], "id int, feature string, value double")
    filled = {(r["id"], r["feature"]): r["value"] for r in median_fill(long, median_table(long)).collect()}
    assert filled == {(1, "a"): 1.0, (2, "a"): 2.5, (3, "a"): 4.0, (1, "b"): 0.0}


def test_two_classes(spark):
    df = spark.createDataFrame([(1,), (1,), (None,)], "label int")
    assert drop_unlabeled(df).count() == 2
    with pytest.raises(ValueError):
        require_two_classes(df)


def test_text_sources(spark, tmp_path):
    src = spark.createDataFrame([("LC.1", "1.5", 'a "b", c'), ("X.C", "NaN;", None)], "x0_LC_ID string, f string, note string")
    path = str(tmp_path / "sheet")
    writers.write_csv(src, path)
    back = readers.load_cohort(spark, path)
    assert {f.dataType.simpleString() for f in back.schema.fields} == {"string"}
    assert {tuple(r) for r in back.collect()} == {tuple(r) for r in src.collect()}
    assert readers.load_cohort(spark, path, ["a", "b", "c"]).columns == ["a", "b", "c"]
    with pytest.raises(ValueError):
        readers.require_columns(back, ["x0_LC_ID", "absent"])
    with pytest.raises(Exception):
        writers.write_csv(src, path)


def test_clinical_source(spark, tmp_path):
    cols = ["other", *readers.CLINICAL_SCHEMA.names]
    src = spark.createDataFrame([("z", "S1", "44", "", "NaN", "2.5", "1")], ", ".join(f"{c} string" for c in cols))
    path = str(tmp_path / "clinical")
    writers.write_csv(src, path)
    c = readers.load_clinical(spark, path)
    typed = c.select("x0_Sample_ID", *[C.clean_numeric(F.col(x)).alias(x) for x in c.columns[1:]])
    assert tuple(clinical_features(typed, "x0_Sample_ID").first()) == ("S1", 44.0, 0.0, 0.0, 2.5, 1.0)


def test_run_output_is_replaced_not_doubled(spark, tmp_path):
    path = str(tmp_path / "runs")
    df = spark.range(3)
    writers.write_run(df, path, "20260101_000000")
    writers.write_run(df, path, "20260102_000000")
    writers.write_run(df, path, "20260101_000000")
    got = {r["run_id"]: r["count"] for r in spark.read.option("recursiveFileLookup", False).parquet(path).groupBy("run_id").count().collect()}
    assert sorted(got.values()) == [3, 3]
    writers.write_json(df, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 3
