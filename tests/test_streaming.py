"""The streaming variant yields the same rows as the batch loader."""

import os
import tempfile

from riskloom.operators import text_prep as TP
from riskloom.sources import fixtures as FX
from riskloom.streaming import news_stream as NS


def test_stream_equals_batch(spark):
    src = tempfile.mkdtemp(prefix="riskloom-stream-src-")
    out = tempfile.mkdtemp(prefix="riskloom-stream-out-")
    batch = FX.fiqa(spark, "/root/testdata/sf0.001")
    batch.write.mode("overwrite").parquet(os.path.join(src, "part1"))
    stream = NS.read_news_stream(spark, os.path.join(src, "part1"), batch.schema)
    q = NS.start_parquet_sink(NS.prepare_stream(stream, "fiqa"), out, "fiqa-test-" + os.path.basename(out),
                              trigger_once=True)
    q.awaitTermination(120)
    got = spark.read.parquet(out)
    exp = TP.prepare_fiqa(batch)
    assert got.count() == exp.count()
    assert got.select(*exp.columns).exceptAll(exp).count() == 0
