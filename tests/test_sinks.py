"""Copies written by split: odd texts come back unchanged, and copies are compared whole."""

import pytest
from pyspark.sql import functions as F

from riskloom.plans import q_text
from riskloom.sources import sinks

ODD = [" a", "a ", "\ta\n", "a\r\nb", "\r", "", None, " ", '"', 'a""', "a\\", '\\"', 'a\x00"b', "\x00", "﻿a", "a,b", "#a", "null"]


def frame(spark):
    rows = [(i, a, b, "train" if i % 3 else "test") for i, (a, b) in enumerate([(o, "z") for o in ODD] + [("z", o) for o in ODD])]
    return spark.createDataFrame(rows, "doc_id long, headline string, full_text string, split string")


def test_odd_texts_come_back_unchanged(spark, tmp_path):
    df = frame(spark)
    for fmt in ("csv", "parquet"):
        path = sinks.write_splits(df, f"{tmp_path}/{fmt}", fmt)
        back = sinks.read_splits(spark, path, fmt, df.schema).select(*df.columns)
        assert {tuple(r) for r in back.collect()} == {tuple(r) for r in df.collect()} and back.count() == 2 * len(ODD)
        assert sinks.same_rows(back, df)


def test_copies_are_compared_with_their_counts(spark):
    df = frame(spark)
    assert sinks.same_rows(df, df.orderBy(F.rand(1)))
    assert not sinks.same_rows(df, df.unionByName(df.limit(1)))
    assert not sinks.same_rows(df, df.where("doc_id > 0")) and not sinks.same_rows(df, df.drop("split"))
    one = lambda a, b: spark.createDataFrame([(a, b)], "a string, b string")
    for a, b in (("xy", ""), ("x", "y1:"), (None, "xy"), ("", None)):
        assert not sinks.same_rows(one("x", "y"), one(a, b))
    assert not sinks.same_rows(one("", None), one(None, "")) and not sinks.same_rows(one("1:x", "-"), one("1:x", None))


def test_query_takes_texts_with_blanks_at_their_ends(spark, tmp_path):
    docs = [(i, t, "en", f" source {i}", len(t)) for i, t in enumerate([" a", "b\n", "", "c\r\nd", 'e""'])]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = q_text.q_sink_csv_parquet(spark, str(tmp_path)).collect()
    assert sorted(r.full_text for r in got if r.full_text is not None) == sorted(d[1] for d in docs if d[0] % 17)
