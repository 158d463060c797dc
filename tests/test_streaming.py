import os
import tempfile

from conftest import SF_SMALL
from dayspan.operators.intervals import expand_days
from dayspan.plans.spans import clipped_spans
from dayspan.streaming import file_stream, run_incremental


def test_incremental_expansion_equals_batch(spark):
    root = tempfile.mkdtemp(prefix="dayspan-stream-")
    spans = clipped_spans(spark, SF_SMALL).select("contract_id", "worker_id", "span_start", "span_end")
    src = os.path.join(root, "in")
    # two arrivals of span files
    spans.where("contract_id % 2 = 0").write.parquet(os.path.join(src, "a"))
    spans.where("contract_id % 2 = 1").write.parquet(os.path.join(src, "b"))
    stream = file_stream(spark, os.path.join(src, "*"), spans.schema, max_files_per_trigger=1)
    q = run_incremental(stream, lambda b: expand_days(b, "span_start", "span_end", "day"),
                        os.path.join(root, "out"), os.path.join(root, "ckpt"))
    q.awaitTermination(300)
    out = spark.read.parquet(os.path.join(root, "out"))
    assert out.count() == expand_days(spans, "span_start", "span_end", "day").count() == 40731
