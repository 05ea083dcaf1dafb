"""Input views of the reference's data model, derived from the driver tables.

Each builder returns a lazy DataFrame; ``FIXTURE_SQL`` holds the same views
in portable SQL so the DuckDB oracle can rebuild them from the same parquet
files. The definitions follow FIXTURES.md.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.sources.tables import read_table


def _year_month(c: Column) -> Column:
    return F.year(c) * 12 + F.month(c)


def credit_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One status per customer and month; the latest order of the month wins.

    ``max_by`` in a grouped aggregate (partial, map-side) instead of a
    row_number window, so a customer with very many orders never lands in a
    single sort task."""
    orders = read_table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority")
    ym = _year_month(F.col("o_orderdate"))
    latest = orders.agg(F.max(ym)).scalar()
    pri = F.col("o_orderpriority")
    # a number until it is chosen: text in the aggregate's buffer would make it sort all orders
    code = (F.when(pri == "1-URGENT", (F.lit(2) + F.col("o_orderkey") % 4).cast("int"))
            .when(pri == "2-HIGH", F.lit(1))
            .when(pri == "3-MEDIUM", F.lit(0))
            .when(pri == "4-NOT SPECIFIED", F.lit(6))
            .otherwise(F.lit(7)))
    status = F.when(F.col("code") == 6, "X").when(F.col("code") == 7, "C").otherwise(F.col("code").cast("string"))
    return (orders
            .select(F.col("o_custkey").alias("id"), ym.alias("ym"),
                    F.col("o_orderkey"), code.alias("code"))
            .groupBy("id", "ym")
            .agg(F.max_by("code", "o_orderkey").alias("code"))
            .select("id", (F.col("ym") - latest).cast("int").alias("months_balance"),
                    status.alias("status")))


def application_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per customer plus a later, changed row for every 20th id."""
    customer = read_table(spark, sf_dir, "customer")
    nation = read_table(spark, sf_dir, "nation")
    region = read_table(spark, sf_dir, "region")
    k = F.col("c_custkey")
    base = (customer
            .join(nation, customer.c_nationkey == nation.n_nationkey)
            .join(region, nation.n_regionkey == region.r_regionkey)
            .select(
                k.alias("id"),
                F.when(k % 2 == 0, "M").otherwise("F").alias("code_gender"),
                F.when(k % 3 == 0, "Y").otherwise("N").alias("flag_own_car"),
                F.when(k % 5 < 3, "Y").otherwise("N").alias("flag_own_realty"),
                (k % 7).alias("cnt_children"),
                F.round(F.abs(F.col("c_acctbal")) * 25 + 27000, 2).alias("amt_income_total"),
                F.col("c_mktsegment").alias("name_income_type"),
                F.concat(F.lit("EDU_"), (k % 5).cast("string")).alias("name_education_type"),
                F.col("r_name").alias("name_family_status"),
                F.concat(F.lit("HOUSE_"), ((k * 7) % 6).cast("string")).alias("name_housing_type"),
                (-(F.lit(7300) + (k * 37) % 18000)).alias("days_birth"),
                F.when(k % 6 == 0, F.lit(365243)).otherwise(-((k * 53) % 15000)).alias("days_employed"),
                F.lit(1).alias("flag_mobil"),
                F.when(k % 4 == 0, 1).otherwise(0).alias("flag_work_phone"),
                F.when(k % 9 < 4, 1).otherwise(0).alias("flag_phone"),
                F.when(k % 10 == 0, 1).otherwise(0).alias("flag_email"),
                F.when(k % 11 < 3, F.lit(None)).otherwise(F.col("n_name")).alias("occupation_type"),
                (F.lit(1) + (k * 3) % 8).cast("double").alias("cnt_fam_members")))
    later = (base.filter(F.col("id") % 20 == 0)
             .withColumn("occupation_type",
                         F.when(F.col("id") % 40 == 0, F.lit(None).cast("string"))
                         .otherwise(F.lit("NATION_X"))))
    return (base.select(F.lit(0).alias("src_seq"), "*")
            .unionByName(later.select(F.lit(1).alias("src_seq"), "*")))


def financial_news(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read_table(spark, sf_dir, "documents")
    return d.select(
        "doc_id",
        F.concat(F.col("lang"), F.lit(" http://ex.com/a?b="), F.col("doc_id").cast("string"),
                 F.lit(" <b>$ABC</b> "), F.col("text")).alias("headline"),
        F.col("text").alias("description"),
        F.when(F.col("doc_id") % 3 == 0, "positive")
         .when(F.col("doc_id") % 3 == 1, "neutral").otherwise("negative").alias("sentiment_label"),
        ((F.col("doc_id") % 201 - 100) / F.lit(100.0)).alias("sentiment_score"))


def reuters(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read_table(spark, sf_dir, "documents")
    m4 = F.col("doc_id") % 4
    return d.select(
        "doc_id",
        F.col("source").alias("headline"),
        F.when(F.col("doc_id") % 17 == 0, F.lit(None)).otherwise(F.col("text")).alias("full_text"),
        F.when(m4 == 0, F.lit(None))
         .when(m4 == 1, F.lit("['Share price', 'Quarterly earnings']"))
         .when(m4 == 2, F.lit("['Mergers and merger talk']"))
         .otherwise(F.lit("[]")).alias("topics"),
        F.when(F.col("doc_id") % 5 < 4, "train").otherwise("test").alias("split"))


def fiqa(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read_table(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", F.col("text").alias("post_text"),
                    (F.col("turn") % 3).alias("label"))


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read_table(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("row_id"),
                    F.when(F.col("event_type") == "error", 1).otherwise(0).alias("y_true"),
                    F.round(F.col("value") / 500, 3).alias("score"),
                    "user_id")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read_table(spark, sf_dir, "embeddings")
    return e.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"),
                    F.when(F.col("label") < 2, 1).otherwise(0).alias("label"))


BUILDERS = {
    "credit_record": credit_record,
    "application_record": application_record,
    "financial_news": financial_news,
    "reuters": reuters,
    "fiqa": fiqa,
    "scored": scored,
    "vectors": vectors,
}


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return BUILDERS[name](spark, sf_dir)


# The same views as SQL over the pre-registered driver tables (DuckDB dialect).
FIXTURE_SQL = {
    "credit_record": """
WITH m AS (SELECT max(year(o_orderdate)*12 + month(o_orderdate)) AS mx FROM orders),
r AS (
  SELECT o_custkey AS id,
         CAST(year(o_orderdate)*12 + month(o_orderdate) - mx AS INTEGER) AS months_balance,
         CASE o_orderpriority
           WHEN '1-URGENT' THEN CAST(2 + o_orderkey % 4 AS VARCHAR)
           WHEN '2-HIGH' THEN '1'
           WHEN '3-MEDIUM' THEN '0'
           WHEN '4-NOT SPECIFIED' THEN 'X'
           ELSE 'C' END AS status,
         row_number() OVER (PARTITION BY o_custkey, year(o_orderdate)*12 + month(o_orderdate)
                            ORDER BY o_orderkey DESC) AS rn
  FROM orders CROSS JOIN m)
SELECT id, months_balance, status FROM r WHERE rn = 1""",
    "application_record": """
WITH base AS (
  SELECT c_custkey AS id,
    CASE WHEN c_custkey % 2 = 0 THEN 'M' ELSE 'F' END AS code_gender,
    CASE WHEN c_custkey % 3 = 0 THEN 'Y' ELSE 'N' END AS flag_own_car,
    CASE WHEN c_custkey % 5 < 3 THEN 'Y' ELSE 'N' END AS flag_own_realty,
    c_custkey % 7 AS cnt_children,
    round(abs(c_acctbal)*25 + 27000, 2) AS amt_income_total,
    c_mktsegment AS name_income_type,
    'EDU_' || CAST(c_custkey % 5 AS VARCHAR) AS name_education_type,
    r_name AS name_family_status,
    'HOUSE_' || CAST((c_custkey*7) % 6 AS VARCHAR) AS name_housing_type,
    -(7300 + (c_custkey*37) % 18000) AS days_birth,
    CASE WHEN c_custkey % 6 = 0 THEN 365243 ELSE -((c_custkey*53) % 15000) END AS days_employed,
    1 AS flag_mobil,
    CASE WHEN c_custkey % 4 = 0 THEN 1 ELSE 0 END AS flag_work_phone,
    CASE WHEN c_custkey % 9 < 4 THEN 1 ELSE 0 END AS flag_phone,
    CASE WHEN c_custkey % 10 = 0 THEN 1 ELSE 0 END AS flag_email,
    CASE WHEN c_custkey % 11 < 3 THEN NULL ELSE n_name END AS occupation_type,
    CAST(1 + (c_custkey*3) % 8 AS DOUBLE) AS cnt_fam_members
  FROM customer JOIN nation ON c_nationkey = n_nationkey
                JOIN region ON n_regionkey = r_regionkey)
SELECT 0 AS src_seq, * FROM base
UNION ALL
SELECT 1, id, code_gender, flag_own_car, flag_own_realty, cnt_children, amt_income_total,
       name_income_type, name_education_type, name_family_status, name_housing_type,
       days_birth, days_employed, flag_mobil, flag_work_phone, flag_phone, flag_email,
       CASE WHEN id % 40 = 0 THEN NULL ELSE 'NATION_X' END, cnt_fam_members
FROM base WHERE id % 20 = 0""",
    "financial_news": """
SELECT doc_id,
  lang || ' http://ex.com/a?b=' || CAST(doc_id AS VARCHAR) || ' <b>$ABC</b> ' || text AS headline,
  text AS description,
  CASE doc_id % 3 WHEN 0 THEN 'positive' WHEN 1 THEN 'neutral' ELSE 'negative' END AS sentiment_label,
  (doc_id % 201 - 100) / CAST(100 AS DOUBLE) AS sentiment_score
FROM documents""",
    "reuters": """
SELECT doc_id, source AS headline,
  CASE WHEN doc_id % 17 = 0 THEN NULL ELSE text END AS full_text,
  CASE doc_id % 4 WHEN 0 THEN NULL
    WHEN 1 THEN '[''Share price'', ''Quarterly earnings'']'
    WHEN 2 THEN '[''Mergers and merger talk'']' ELSE '[]' END AS topics,
  CASE WHEN doc_id % 5 < 4 THEN 'train' ELSE 'test' END AS split
FROM documents""",
    "fiqa": """
SELECT conv_id, turn, text AS post_text, turn % 3 AS label FROM conversations""",
    "scored": """
SELECT event_id AS row_id, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS y_true,
       round(value/500, 3) AS score, user_id FROM events""",
    "vectors": """
SELECT vec_id, CAST(embedding AS DOUBLE[]) AS embedding,
       CASE WHEN label < 2 THEN 1 ELSE 0 END AS label FROM embeddings""",
}


def with_fixtures(names: list[str], body: str, extra: list[tuple[str, str]] | None = None) -> str:
    """Oracle SQL: the named fixture views as CTEs, then ``body``."""
    ctes = [f"{n} AS ({FIXTURE_SQL[n]}\n)" for n in names]
    ctes += [f"{n} AS ({sql}\n)" for n, sql in (extra or [])]
    return "WITH " + ",\n".join(ctes) + "\n" + body
