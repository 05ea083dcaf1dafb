"""Documents to training sequences: language, toxicity, near duplicates, packing.

Each stage works on all rows that the one before it kept and returns the columns
of documents, the last one the packed pieces. A stage's result is written as
Parquet to the folder that the cluster shares and read again.

Null and empty texts have no language and go in the first stage. Rows with equal
text, or with texts within the bit distance, leave one row: the one with the
least doc_id (a null doc_id counts as the greatest), repeated rows included. An
empty table gives an empty result; extra columns, whatever their names, pass
through to the last stage. Its pieces hold their token ids, so that the sequences
can be written from its rows.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm import byte_gru, kk_packing, simhash_tiles, toxicity_fst
from riskloom.session import checkpoint_dir
from riskloom.sources.tables import read_table

# Pooled probability below which no learned language fits a text. Clean texts of
# two mixed languages stay at about one half.
MIN_LANGUAGE_SCORE = 0.35


def free_names(docs: DataFrame, *names: str) -> list[str]:
    """``names``, each with as many underscores in front as no column of ``docs`` has."""
    taken = {c.lower() for c in docs.columns}
    found = []
    for name in names:
        while name in taken:
            name = "_" + name
        found.append(name)
    return found


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts in one of the languages that the labelled rows teach; others go."""
    model, names = byte_gru.fit_language_model(docs.where(~byte_gru.held_out(3, 1)))
    # positional names: the predictions may not clash with columns of documents
    lang, score = free_names(docs, "_lang", "_score")
    read = byte_gru.predict_language(docs, model, names, docs.columns).toDF(*docs.columns, lang, score)
    return read.where((F.col(lang) != byte_gru.UNKNOWN) & (F.col(score) >= MIN_LANGUAGE_SCORE)).drop(lang, score)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts that the clause grammar does not find toxic."""
    labels = read_table(spark, sf_dir, "labels").where(~byte_gru.held_out(4, 2))
    model = toxicity_fst.fit_toxicity(docs, labels)
    score, toxic = free_names(docs, "_score", "_toxic")
    read = toxicity_fst.score_toxicity(docs, model, docs.columns).toDF(*docs.columns, score, toxic)
    return read.where(~F.col(toxic)).drop(score, toxic)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of near-equal fingerprints."""
    # written once with its row numbers: numbers given again by another job may differ
    table = f"{checkpoint_dir(spark)}/fingerprints-{uuid.uuid4().hex}"
    row, fp = free_names(docs, "_row", "_fp")
    numbered = docs.withColumn(row, F.monotonically_increasing_id())
    simhash_tiles.fingerprints(numbered, simhash_tiles.SHINGLE, numbered.columns).toDF(*numbered.columns, fp).write.parquet(table)
    rows = spark.read.parquet(table)
    groups = simhash_tiles.fingerprint_components(rows.select(F.col(fp).alias("fp")).distinct(), simhash_tiles.RADIUS)
    order = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col(row).alias("row"))
    # the least row of each fingerprint first, so that a hot one is one row in the join
    least = rows.select(F.col(fp).alias("fp"), order.alias("at")).groupBy("fp").agg(F.min("at").alias("least"))
    first = least.join(groups, "fp").groupBy("group").agg(F.min("least").alias("least")).select(F.col("least.row").alias(row))
    return rows.join(first, row, "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of nearly equal windows."""
    return kk_packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("language", language), ("toxicity", toxicity), ("near_duplicates", near_duplicates), ("packing", packing)]

# Learned models and token ids are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
