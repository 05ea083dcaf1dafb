"""Application cleaning behaviour notes."""

import pytest
from pyspark.sql import functions as F

from riskloom.functions import credit_exprs as X
from riskloom.operators import clean as C
from riskloom.operators import encode as E

SCHEMA = ("src_seq int, id long, code_gender string, flag_own_car string, flag_own_realty string, "
          "cnt_children long, amt_income_total double, name_income_type string, name_education_type string, "
          "name_family_status string, name_housing_type string, days_birth long, days_employed long, "
          "flag_mobil int, flag_work_phone int, flag_phone int, flag_email int, occupation_type string, "
          "cnt_fam_members double")


def _app(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def _row(seq, i, occ, days_employed=-1000, gender="M", children=1, fam=2.0, days_birth=-12000):
    return (seq, i, gender, "Y", "N", children, 50000.0, "A", "E", "F", "H", days_birth, days_employed,
            1, 0, 1, 0, occ, fam)


def test_unemployed_months_zero_and_flag_one(spark):
    df = _app(spark, [_row(0, 1, "x", days_employed=365243), _row(0, 2, "x", days_employed=-730)])
    out, _ = C.clean_application(df, variant="f")
    r = {x["id"]: x for x in out.collect()}
    assert r[1]["months_employed"] == 0 and r[1]["years_employed"] == 0
    assert r[1]["employment_status_encoded"] == 1
    assert r[2]["months_employed"] == 24 and r[2]["employment_status_encoded"] == 0


def test_dedup_prefers_known_occupation(spark):
    df = _app(spark, [_row(0, 1, None), _row(1, 1, "Cook"), _row(0, 2, None), _row(1, 2, None), _row(0, 3, "A")])
    got = {r["id"]: (r["src_seq"], r["occupation_type"]) for r in C.dedup_prefer_nonnull(df).collect()}
    assert got == {1: (1, "Cook"), 2: (0, None), 3: (0, "A")}
    last = {r["id"]: r["src_seq"] for r in C.dedup_keep_last(df).collect()}
    assert last == {1: 1, 2: 1, 3: 0}


def test_label_encoder_unknown_and_unseen(spark):
    tr = spark.createDataFrame([("b",), ("a",), (None,), ("Unknown",)], "c string")
    enc = E.fit(tr, "c", "label")
    assert enc.categories == ["a", "b"]
    codes = [r[0] for r in E.apply(tr, enc).select("c_encoded").collect()]
    assert codes == [1, 0, -1, -1]
    te = spark.createDataFrame([("z",)], "c string")
    assert E.apply(te, enc, on_unseen="null").first()["c_encoded"] is None
    with pytest.raises(Exception):
        E.apply(te, enc, on_unseen="error").collect()


def test_onehot_unseen_is_all_zero(spark):
    tr = spark.createDataFrame([("x",), ("y",)], "c string")
    enc = E.fit(tr, "c", "onehot")
    te = spark.createDataFrame([("z",), ("x",)], "c string")
    rows = E.apply(te, enc).collect()
    assert (rows[0]["c_x"], rows[0]["c_y"]) == (0.0, 0.0)
    assert (rows[1]["c_x"], rows[1]["c_y"]) == (1.0, 0.0)


def test_age_bins_and_half_even(spark):
    df = spark.createDataFrame([(-912,), (-1277,), (-33000,), (0,)], "days_birth long")
    out = df.select(X.age_years("days_birth").alias("age")).withColumn("bin", X.age_bin_label("age")).collect()
    # 912/365 = 2.498 -> 2 ; 1277/365 = 3.4986 -> 3 ; 33000/365 = 90.4 -> 90 -> '90+'
    assert [(r["age"], r["bin"]) for r in out] == [(2, "0-4"), (3, "0-4"), (90, "90+"), (0, "0-4")]


def test_binary_flags_unmapped_is_null(spark):
    df = spark.createDataFrame([("M",), ("F",), ("X",)], "g string")
    got = [r[0] for r in df.select(X.map_flag("g", X.GENDER_FLAG)).collect()]
    assert got == [0, 1, None]


def test_vocabulary_of_any_size(spark):
    """200,000 categories: dense codes in value order, nulls -1, unseen values an error."""
    from riskloom.operators import encode as E
    n = 200_000
    df = spark.range(n + 1).select(F.when(F.col("id") < n, F.format_string("c%07d", (F.col("id") * 7919) % n)).alias("c"), (F.col("id") % 3).cast("string").alias("d"))
    encs = E.fit_many(df, ["c", "d"])
    out = E.apply(E.apply(df, encs["c"]), encs["d"])
    wrong = out.filter((F.coalesce(F.substring("c", 2, 7).cast("int"), F.lit(-1)) != F.col("c_encoded")) | (F.col("d").cast("int") != F.col("d_encoded")))
    assert wrong.count() == 0 and out.count() == n + 1 and out.agg(F.max("c_encoded")).first()[0] == n - 1
    new = spark.createDataFrame([("never",)], "c string")
    assert E.apply(new, encs["c"], "null").first().c_encoded is None and E.apply(new, encs["c"], "unknown").first().c_encoded == -1
    with pytest.raises(Exception, match="unseen label"):
        E.apply(new, encs["c"]).collect()
