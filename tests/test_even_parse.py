"""The parse stage grows with the lines, not with the file's layout, and its code is compiled by the JVM."""

import contextlib
import io
import re

from pyspark.sql import functions as F

from relaylens.operators.parse import recognised_lines
import stand_in_log as S


def _events(spark, n):
    return spark.range(n).select(
        F.col("id").alias("event_id"), F.timestamp_seconds(1_704_067_200 + F.col("id")).alias("ts"), (F.col("id") % 100).alias("user_id"),
        F.element_at(F.array(*[F.lit(t) for t in ("signup", "purchase", "view", "click", "error")]), (F.col("id") % 5 + 1).cast("int")).alias("event_type"))


def test_a_file_of_one_row_group_is_dealt_to_many_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(S, "EVENTS_PER_TASK", 100)
    _events(spark, 5000).coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    lines = S.synthetic_raw_lines(spark, str(tmp_path))
    sizes = [r["count"] for r in lines.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    assert len(sizes) >= 50 and max(sizes) < sum(sizes) / 20


def test_no_generated_method_of_the_parser_is_too_large_to_be_compiled(spark, tmp_path):
    S.raw_lines_from_events(_events(spark, 100)).write.parquet(f"{tmp_path}/raw")
    parsed = recognised_lines(spark.read.parquet(f"{tmp_path}/raw"), log_dates=True)
    shown = io.StringIO()
    with contextlib.redirect_stdout(shown):
        parsed.explain("codegen")
    sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", shown.getvalue())]
    assert sizes and max(sizes) < 8000
