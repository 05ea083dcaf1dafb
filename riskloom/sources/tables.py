"""Driver tables (parquet) and the reference's CSV inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.session import table_path

TABLES = ("region", "nation", "customer", "supplier", "part", "orders",
          "lineitem", "events", "documents", "embeddings", "pages",
          "benchmark", "labels", "conversations")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name not in TABLES:
        raise ValueError(f"unknown table {name!r}")
    return spark.read.parquet(table_path(sf_dir, name))


# Explicit schemas for the reference's CSV files (no inference at scale).
APPLICATION_SCHEMA = T.StructType([
    T.StructField("ID", T.LongType()),
    T.StructField("CODE_GENDER", T.StringType()),
    T.StructField("FLAG_OWN_CAR", T.StringType()),
    T.StructField("FLAG_OWN_REALTY", T.StringType()),
    T.StructField("CNT_CHILDREN", T.LongType()),
    T.StructField("AMT_INCOME_TOTAL", T.DoubleType()),
    T.StructField("NAME_INCOME_TYPE", T.StringType()),
    T.StructField("NAME_EDUCATION_TYPE", T.StringType()),
    T.StructField("NAME_FAMILY_STATUS", T.StringType()),
    T.StructField("NAME_HOUSING_TYPE", T.StringType()),
    T.StructField("DAYS_BIRTH", T.LongType()),
    T.StructField("DAYS_EMPLOYED", T.LongType()),
    T.StructField("FLAG_MOBIL", T.IntegerType()),
    T.StructField("FLAG_WORK_PHONE", T.IntegerType()),
    T.StructField("FLAG_PHONE", T.IntegerType()),
    T.StructField("FLAG_EMAIL", T.IntegerType()),
    T.StructField("OCCUPATION_TYPE", T.StringType()),
    T.StructField("CNT_FAM_MEMBERS", T.DoubleType()),
])

CREDIT_SCHEMA = T.StructType([
    T.StructField("ID", T.LongType()),
    T.StructField("MONTHS_BALANCE", T.IntegerType()),
    T.StructField("STATUS", T.StringType()),
])

FINANCIAL_NEWS_SCHEMA = T.StructType([
    T.StructField("headline", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("sentiment_label", T.StringType()),
    T.StructField("sentiment_score", T.DoubleType()),
])

FIQA_SCHEMA = T.StructType([
    T.StructField("post_text", T.StringType()),
    T.StructField("label", T.IntegerType()),
])

REUTERS_SCHEMA = T.StructType([
    T.StructField("headline", T.StringType()),
    T.StructField("full_text", T.StringType()),
    T.StructField("topics", T.StringType()),
    T.StructField("split", T.StringType()),
])


def read_csv(spark: SparkSession, path: str, schema: T.StructType, mode: str = "FAILFAST") -> DataFrame:
    """Header CSV with quoted multi-line fields, as the news dumps are.

    Columns are bound by their names in the header, whatever their order;
    columns beyond ``schema`` are dropped, missing ones are NULL. A row that does
    not fit its types fails the read unless another ``mode`` is given."""
    reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"')
    names = reader.csv(path).columns
    types = {f.name.lower(): f for f in schema.fields}
    found = T.StructType([T.StructField(n, types[n.lower()].dataType if n.lower() in types else T.StringType()) for n in names])
    rows = reader.schema(found).option("mode", mode).option("enforceSchema", False).csv(path)
    here = {n.lower(): n for n in names}
    return rows.select(*[F.col(f"`{here[f.name.lower()]}`").alias(f.name) if f.name.lower() in here else F.lit(None).cast(f.dataType).alias(f.name)
                         for f in schema.fields])


def load_financial_news(spark: SparkSession, path: str, threshold: float) -> DataFrame:
    """Cleaned financial news of at least ``threshold`` confidence, from its CSV."""
    from riskloom.operators.text_prep import prepare_financial_news
    return prepare_financial_news(read_csv(spark, path, FINANCIAL_NEWS_SCHEMA), threshold)


def load_fiqa(spark: SparkSession, path: str) -> DataFrame:
    """Cleaned FiQA posts from their CSV."""
    from riskloom.operators.text_prep import prepare_fiqa
    return prepare_fiqa(read_csv(spark, path, FIQA_SCHEMA))


def load_reuters(spark: SparkSession, path: str) -> DataFrame:
    """Cleaned Reuters stories with their aspects from their CSV."""
    from riskloom.operators.text_prep import prepare_reuters
    return prepare_reuters(read_csv(spark, path, REUTERS_SCHEMA))


def load_credit_tables(spark: SparkSession, application_path: str,
                       credit_path: str) -> tuple[DataFrame, DataFrame]:
    """``load_data()``: the two credit CSVs, column names lower-cased. Applications
    get ``src_seq``, their place in the file, which decides between rows of one id."""
    from riskloom.operators.clean import lower_columns
    app = lower_columns(read_csv(spark, application_path, APPLICATION_SCHEMA)).withColumn("src_seq", F.monotonically_increasing_id())
    credit = lower_columns(read_csv(spark, credit_path, CREDIT_SCHEMA))
    return app, credit
