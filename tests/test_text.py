"""Text normalisation on literals (emoji and accents are not in the fixture)."""

from pyspark.sql import functions as F

from riskloom.functions import text as TX


def _one(spark, fn, value):
    return spark.createDataFrame([(value,)], "t string").select(fn("t").alias("o")).first()["o"]


def test_clean_text_steps(spark):
    s = "Check https://x.io/a?b=1 <b>NOW</b> 🚀 Café’s $AAPL up 5.5% — €10!"
    assert _one(spark, TX.clean_text, s) == "check now café s $aapl up 5.5 €10"
    assert _one(spark, lambda c: TX.clean_text(c, remove_emojis=False), "a 🚀 b") == "a b"
    assert _one(spark, TX.clean_text, None) == ""


def test_emoji_removed_before_special(spark):
    # the emoji step deletes (no space), the special step replaces with a space
    assert _one(spark, TX.clean_text, "up🚀down") == "updown"
    assert _one(spark, lambda c: TX.clean_text(c, remove_emojis=False), "up🚀down") == "up down"


def test_unicode_whitespace_and_accents(spark):
    assert _one(spark, TX.clean_text, "Ünïcode  words\tend") == "ünïcode words end"


def test_preserve_tickers(spark):
    df = spark.createDataFrame([("$ABC rose, $abc fell $XY",)], "t string")
    got = df.select(TX.preserve_tickers(F.lower("t"), F.col("t")).alias("o")).first()["o"]
    assert got == "$ABC rose, $ABC fell $XY"


def test_map_aspect_order_and_defaults(spark):
    df = spark.createDataFrame([("  Target price cut ",), ("Stock price target price",), ("nothing",), (None,)], "a string")
    got = [r[0] for r in df.select(TX.map_aspect("a")).collect()]
    assert got == ["price_target", "price_action", "other", "other"]


def test_topic_aspects(spark):
    df = spark.createDataFrame([("['Share price', 'Mergers']",), (None,), ("[]",)], "t string")
    got = [r[0] for r in df.select(TX.topic_aspects("t")).collect()]
    assert got == [["price_action", "ma"], [], []]


def test_full_text_null_propagates(spark):
    df = spark.createDataFrame([("h", "b"), ("h", None)], "h string, b string")
    assert [r[0] for r in df.select(TX.full_text("h", "b")).collect()] == ["h b", None]


def test_aspect_is_trimmed_once(spark):
    df = spark.createDataFrame([("  IPO \n",), (" " * 20_000 + "x" + " " * 20_000 + "loss \x85",), ("",), (" \t ",), ("down\ngrade  upgrade",)], "a string")
    out = df.select(TX.map_aspect("a").alias("m"))
    assert [r.m for r in out.collect()] == ["ipo", "profitability", "other", "other", "analyst_rating"]
    assert out._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace(") == 1
