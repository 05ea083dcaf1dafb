"""Cases that were wrong before: null ages, topics, emoji, NaN vectors, CSV order, pruned scans."""
import pytest
from pyspark.sql import functions as F

from riskloom.functions import credit_exprs as X
from riskloom.functions import text as TX
from riskloom.operators import clean, credit, neighbors, ranking
from riskloom.plans import registry
from riskloom.sources import tables


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column).first()[0]


@pytest.mark.parametrize("text,want", [
    ("a→b", "a b"), ("up★down", "up down"), ("tick✓ok", "tick ok"), ("Brand™x", "brandx"), ("1️⃣go", "go"),
    ("so 😀👍🏽 good", "so good"), ("👨‍👩‍👧 family", "family"), ("flag 🇫🇷!", "flag"), ("❤️ love", "love"), ("3 #1 *", "3 1")])
def test_emoji(spark, text, want):
    assert one(spark, TX.clean_text("x"), text) == want


def test_topics(spark):
    assert one(spark, TX.topic_aspects("x"), "['earnings', None]") == ["earnings", "other"]
    assert one(spark, TX.topic_aspects("x"), "[None, 'None of it']") == ["other", "other"]
    assert one(spark, TX.topic_aspects("x"), None) == [] == one(spark, TX.topic_aspects("x"), "[]")
    with pytest.raises(Exception, match="not a list of topics"):
        one(spark, TX.topic_aspects("x"), "earnings")


def test_age_label_of_no_age(spark):
    assert one(spark, X.age_bin_label("x"), None, "int") is None and one(spark, X.age_bin_label("x"), -3, "int") is None
    assert one(spark, X.age_bin_label("x"), 27, "int") == "25-29"


def test_monthly_argument(spark):
    rows = spark.createDataFrame([(1, 0, "0"), (1, -1, "2"), (2, 0, "C")], "id long, months_balance int, status string")
    a = credit.customer_aggregates(rows).orderBy("id").collect()
    b = credit.customer_aggregates(None, monthly=credit.monthly_series(rows)).orderBy("id").collect()
    assert a == b


def test_nan_vectors_are_refused(spark):
    good = spark.createDataFrame([(1, [1.0, 2.0])], "vec_id long, embedding array<double>")
    for v in ([1.0, float("nan")], [1.0, None], None):
        bad = spark.createDataFrame([(1, v)], "vec_id long, embedding array<double>")
        with pytest.raises(Exception, match="NULL or NaN"):
            neighbors.knn_join(good, bad, k=1).collect()


def test_running_totals_of_nothing(spark):
    assert ranking.running_totals(spark.createDataFrame([], "v double, c long"), "v", ["c"]).count() == 0
    assert ranking.quantiles(spark.createDataFrame([], "v double"), "v", [0.5]) == [None]


def test_csv_binds_by_name(spark, tmp_path):
    (tmp_path / "f.csv").write_text('id,label,post_text\n9,1,"Up 5%\n today"\n8,0,Down\n')
    rows = tables.load_fiqa(spark, str(tmp_path / "f.csv")).orderBy("label").collect()
    assert [(r.post_text, r.label, r.cleaned_text) for r in rows] == [("Down", 0, "down"), ("Up 5%\n today", 1, "up 5 today")]
    (tmp_path / "bad.csv").write_text("label,post_text\nseven,x\n")
    with pytest.raises(Exception):
        tables.load_fiqa(spark, str(tmp_path / "bad.csv")).collect()
    (tmp_path / "n.csv").write_text("sentiment_score,extra,headline,sentiment_label\n0.9,z,Profit ™,positive\n-0.1,z,Loss,negative\n")
    news = tables.load_financial_news(spark, str(tmp_path / "n.csv"), 0.5).collect()
    assert [(r.cleaned_headline, r.direction_label, r.description) for r in news] == [("profit", 0, None)]
    (tmp_path / "r.csv").write_text("topics,headline,full_text,split\n\"['earnings', None]\",A,B,train\n")
    assert tables.load_reuters(spark, str(tmp_path / "r.csv")).first().aspects == ["earnings", "other"]


def test_credit_csv_to_clean_application(spark, sf, tmp_path):
    from riskloom.sources import fixtures
    app = fixtures.application_record(spark, "/root/testdata/sf0.001").drop("src_seq")
    app.coalesce(1).write.option("header", True).csv(str(tmp_path / "a"))
    spark.createDataFrame([(1, 0, "0")], "id long, months_balance int, status string").coalesce(1).write.option("header", True).csv(str(tmp_path / "c"))
    apps, credits = tables.load_credit_tables(spark, str(tmp_path / "a"), str(tmp_path / "c"))
    cleaned, _ = clean.clean_application(apps)
    assert cleaned.count() == app.select("id").distinct().count() and credits.first().status == "0"


def test_scans_are_pruned(spark, sf):
    plan = registry.queries()["confidence_filter"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema" in plan and "text" not in plan.split("ReadSchema")[1].split("\n")[0]
    assert F is not None
