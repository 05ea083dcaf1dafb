"""Dataset loaders of the news-preparation step (``DataLoader``)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.functions import text as TX


def confidence_filter(df: DataFrame, threshold: float, col: str = "sentiment_score") -> DataFrame:
    """Keep rows with ``abs(score) >= threshold`` (threshold is required)."""
    return df.filter(F.abs(F.col(col)) >= F.lit(float(threshold)))


def prepare_financial_news(df: DataFrame, threshold: float) -> DataFrame:
    out = df.withColumn("cleaned_headline", TX.clean_text("headline"))
    if "description" in df.columns:
        out = out.withColumn("cleaned_description", TX.clean_text("description"))
    out = out.withColumn("direction_label", TX.direction_label("sentiment_label"))
    return confidence_filter(out, threshold)


def prepare_fiqa(df: DataFrame) -> DataFrame:
    return (df.withColumn("cleaned_text", TX.clean_text("post_text"))
            .withColumn("direction_label", F.col("label")))


def prepare_reuters(df: DataFrame) -> DataFrame:
    out = (df.withColumn("full_text", TX.full_text("headline", "full_text"))
           .withColumn("cleaned_text", TX.clean_text("full_text")))
    if "topics" in df.columns:
        out = out.withColumn("aspects", TX.topic_aspects("topics"))
    return out


def union_splits(parts: dict[str, DataFrame], col: str = "split") -> DataFrame:
    """Tag each part with its split name and stack them by column name;
    columns missing from a part become NULL."""
    out = None
    for name, df in parts.items():
        tagged = df.withColumn(col, F.lit(name))
        out = tagged if out is None else out.unionByName(tagged, allowMissingColumns=True)
    return out
