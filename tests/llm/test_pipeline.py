"""Stages of the corpus pipeline on a small table, against brute force where there is one."""
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as CP
from riskloom.sources.tables import read_table

from test_duplicates import components_of, reference_fingerprint
from test_tokens import check_packing

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return read_table(spark, SMALL, "documents")


def test_stages(spark, docs, tmp_path):
    kept, frames = docs, {}
    for name, stage in CP.STAGES:
        stage(spark, kept, SMALL).write.parquet(f"{tmp_path}/{name}")
        frames[name] = kept
        last, kept = kept, spark.read.parquet(f"{tmp_path}/{name}")
        if name != "packing":
            assert kept.columns == docs.columns and kept.exceptAll(last).count() == 0
    assert frames["toxicity"].count() >= 0.99 * docs.count()
    labels = read_table(spark, SMALL, "labels")
    gone = frames["toxicity"].join(frames["near_duplicates"], "doc_id", "left_anti").join(labels, "doc_id")
    assert gone.where("toxic = 0").count() <= 0.03 * labels.count()
    rows = [(r.doc_id, r.text) for r in frames["near_duplicates"].orderBy("doc_id").collect()]
    fps = np.array([reference_fingerprint(t) for _, t in rows], np.uint64)
    label = components_of(len(rows), np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 3)
    assert sorted(r.doc_id for r in last.collect()) == [rows[i][0] for i in range(len(rows)) if label[i] == i]
    check_packing(last, kept, 2048)


def test_edges(spark, edge_docs, no_docs):
    for docs in (edge_docs, no_docs):
        for name, stage in CP.STAGES[:-1]:
            out = stage(spark, docs, SMALL)
            assert out.columns == docs.columns and out.count() <= docs.count(), name
    # repeated rows and equal texts leave the least doc_id
    left = CP.near_duplicates(spark, edge_docs.where("text = 'same text here'"), SMALL).collect()
    assert [r.doc_id for r in left] == [8]
    assert CP.language(spark, edge_docs, SMALL).where("text IS NULL OR trim(text) = ''").count() == 0


def test_clashing_names(spark, docs):
    """Columns named as the stages' own come through unchanged."""
    names = ["fp", "_fp", "_row", "_lang", "_score", "_toxic", "toxic", "toxicity", "c0", "x0", "least", "group", "fingerprint"]
    some = docs.where("doc_id < 40")
    extra = some.select("*", *[F.concat(F.lit(n), F.col("doc_id").cast("string")).alias(n) for n in names])
    for name, stage in CP.STAGES[:-1]:
        out = stage(spark, extra, SMALL)
        assert out.columns == extra.columns and out.exceptAll(extra).count() == 0, name
        assert out.select(docs.columns).exceptAll(stage(spark, some, SMALL)).count() == 0, name


def test_run(spark):
    got = CP.run(spark, SMALL)
    assert got.agg(F.count_distinct("doc_id")).first()[0] > 100 and CP.ORACLE_SQL is None
