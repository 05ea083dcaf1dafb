"""Registered text-preparation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskloom.functions import text as TX
from riskloom.operators import text_prep as TP
from riskloom.plans.common import Registry, fx, r6, with_fixtures
from riskloom.sources import sinks

R = Registry()
CONF = 0.5  # confidence threshold parameter (the reference reads it from a missing config module)


def sql(body, fixtures, ctes=()):
    return with_fixtures(list(fixtures), body, list(ctes))


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def d_url(x):
    return f"regexp_replace({x}, {q(TX.URL_PATTERN)}, '', 'g')"


def d_html(x):
    return f"regexp_replace({x}, {q(TX.HTML_PATTERN)}, '', 'g')"


def d_emoji(x):
    return f"regexp_replace({x}, {q(TX.EMOJI_PATTERN)}, '', 'g')"


def d_special(x):
    return f"regexp_replace({x}, {q(TX.SPECIAL_PATTERN)}, ' ', 'g')"


def d_collapse(x):
    return f"lower(trim(regexp_replace({x}, {q(TX.UNICODE_SPACE + '+')}, ' ', 'g')))"


def d_clean(x, emoji=True):
    t = d_html(d_url(f"coalesce(CAST({x} AS VARCHAR), '')"))
    if emoji:
        t = d_emoji(t)
    return d_collapse(d_special(t))


def d_aspect(x):
    key = f"lower(regexp_replace({x}, {q('^' + TX.UNICODE_SPACE + '+|' + TX.UNICODE_SPACE + '+$')}, '', 'g'))"
    whens = " ".join(f"WHEN contains({key}, {q(k)}) THEN {q(v)}" for k, v in TX.ASPECT_MAPPING)
    return f"CASE WHEN {x} IS NULL THEN 'other' {whens} ELSE 'other' END"


def d_topics(x):
    lst = f"""from_json(replace({x}, '''', '"'), '["VARCHAR"]')"""
    return f"coalesce(list_transform({lst}, lambda a: {d_aspect('a')}), []::VARCHAR[])"


def d_direction(x):
    return f"CASE {x} WHEN 'positive' THEN 0 WHEN 'neutral' THEN 1 WHEN 'negative' THEN 2 END"


NEWS = ("financial_news",)
REUT = ("reuters",)


def news(spark, sf):
    return fx(spark, sf, "financial_news")


for _name, _fn, _dfn in [("strip_urls", TX.strip_urls, d_url), ("strip_html", TX.strip_html, d_html),
                         ("strip_emoji", TX.strip_emoji, d_emoji), ("strip_special", TX.strip_special, d_special),
                         ("collapse_ws_lower", TX.collapse_ws_lower, d_collapse)]:
    def _make(fn):
        def run(spark, sf):
            n = news(spark, sf)
            return n.select("doc_id", fn("headline").alias("headline"), fn("description").alias("description"))
        return run
    R.add(_name, sql(f"SELECT doc_id, {_dfn('headline')} AS headline, {_dfn('description')} AS description "
                     "FROM financial_news", NEWS))(_make(_fn))


@R.add("clean_text", sql(f"""SELECT doc_id, {d_clean('headline')} AS cleaned_headline,
  {d_clean('description')} AS cleaned_description, {d_clean('headline', False)} AS cleaned_keep_emoji
FROM financial_news""", NEWS))
def q_clean_text(spark, sf):
    return news(spark, sf).select("doc_id", TX.clean_text("headline").alias("cleaned_headline"),
                                  TX.clean_text("description").alias("cleaned_description"),
                                  TX.clean_text("headline", remove_emojis=False).alias("cleaned_keep_emoji"))


@R.add("preserve_tickers", sql(f"""SELECT doc_id, list_reduce(regexp_extract_all(headline, {q(TX.TICKER_PATTERN)}),
  lambda acc, t: replace(acc, lower(t), t), {d_clean('headline')}) AS headline_tickers FROM financial_news""", NEWS))
def q_preserve_tickers(spark, sf):
    n = news(spark, sf)
    return n.select("doc_id", TX.preserve_tickers(TX.clean_text("headline"), F.col("headline"))
                    .alias("headline_tickers"))


@R.add("map_aspect", sql(f"""SELECT doc_id, {d_aspect('description')} AS aspect FROM financial_news""", NEWS))
def q_map_aspect(spark, sf):
    return news(spark, sf).select("doc_id", TX.map_aspect("description").alias("aspect"))


@R.add("direction_label", sql(f"SELECT doc_id, sentiment_label, {d_direction('sentiment_label')} AS direction_label "
                              "FROM financial_news", NEWS))
def q_direction_label(spark, sf):
    return news(spark, sf).select("doc_id", "sentiment_label",
                                  TX.direction_label("sentiment_label").alias("direction_label"))


@R.add("confidence_filter", sql(f"SELECT doc_id, sentiment_score FROM financial_news WHERE abs(sentiment_score) >= {CONF}",
                                NEWS))
def q_confidence_filter(spark, sf):
    return TP.confidence_filter(news(spark, sf), CONF).select("doc_id", "sentiment_score")


@R.add("full_text", sql("SELECT doc_id, headline || ' ' || full_text AS full_text FROM reuters", REUT))
def q_full_text(spark, sf):
    r = fx(spark, sf, "reuters")
    return r.select("doc_id", TX.full_text("headline", "full_text").alias("full_text"))


@R.add("topic_aspects", sql(f"SELECT doc_id, topics, {d_topics('topics')} AS aspects FROM reuters", REUT))
def q_topic_aspects(spark, sf):
    r = fx(spark, sf, "reuters")
    return r.select("doc_id", "topics", TX.topic_aspects("topics").alias("aspects"))


@R.add("src_financial_news", sql(f"""SELECT doc_id, headline, description, sentiment_label, sentiment_score,
  {d_clean('headline')} AS cleaned_headline, {d_clean('description')} AS cleaned_description,
  {d_direction('sentiment_label')} AS direction_label
FROM financial_news WHERE abs(sentiment_score) >= {CONF}""", NEWS))
def q_src_financial_news(spark, sf):
    return TP.prepare_financial_news(news(spark, sf), CONF)


@R.add("src_fiqa", sql(f"""SELECT conv_id, turn, post_text, label, {d_clean('post_text')} AS cleaned_text,
  label AS direction_label FROM fiqa""", ("fiqa",)))
def q_src_fiqa(spark, sf):
    return TP.prepare_fiqa(fx(spark, sf, "fiqa"))


@R.add("src_reuters", sql(f"""SELECT doc_id, headline, headline || ' ' || full_text AS full_text, topics, split,
  {d_clean("headline || ' ' || full_text")} AS cleaned_text, {d_topics('topics')} AS aspects FROM reuters""", REUT))
def q_src_reuters(spark, sf):
    return TP.prepare_reuters(fx(spark, sf, "reuters"))


@R.add("union_splits", sql("""SELECT doc_id, headline, full_text, topics, 'train' AS split FROM reuters WHERE split = 'train'
UNION ALL SELECT doc_id, headline, full_text, NULL, 'test' FROM reuters WHERE split = 'test'""", REUT))
def q_union_splits(spark, sf):
    r = fx(spark, sf, "reuters")
    train = r.filter(F.col("split") == "train").drop("split")
    test = r.filter(F.col("split") == "test").drop("split", "topics")
    return TP.union_splits({"train": train, "test": test})


@R.add("sink_csv_parquet", sql("""SELECT doc_id, headline, full_text, topics, split FROM reuters""", REUT))
def q_sink_csv_parquet(spark, sf):
    import hashlib
    from pyspark.sql import types as T
    r = fx(spark, sf, "reuters")
    tag = hashlib.md5(sf.encode()).hexdigest()[:10]
    pq = sinks.write_splits(r, sinks.output_path(spark, f"reuters-{tag}.parquet"), "parquet")
    csv = sinks.write_splits(r.select("doc_id", "headline", "full_text", "topics", "split"),
                             sinks.output_path(spark, f"reuters-{tag}.csv"), "csv")
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("headline", T.StringType()),
                           T.StructField("full_text", T.StringType()), T.StructField("topics", T.StringType()),
                           T.StructField("split", T.StringType())])
    back_csv = sinks.read_splits(spark, csv, "csv", schema)
    back_pq = sinks.read_splits(spark, pq).select(*schema.fieldNames())
    # both copies must agree row for row; the parquet copy is returned
    if not sinks.same_rows(back_csv, back_pq):
        raise AssertionError("CSV and Parquet copies differ")
    return back_pq
