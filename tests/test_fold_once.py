"""A run sums up its splits and folds them once, however many of its results are written."""

from pyspark.sql import functions as F

from relaylens.operators import lifecycle as LC
from relaylens.operators.parse import parse_lines
from relaylens.plans import index_job

from relaylens.plans.sink import read_index
import stand_in_log as S


def _lines(spark, n):
    """Each user goes through all kinds of events in turn."""
    i = F.col("id")
    kinds = F.array(*[F.lit(t) for t in ("signup", "view", "purchase", "error", "click")])
    return S.raw_lines_from_events(spark.range(n).select(
        i.alias("event_id"), F.timestamp_seconds(1_704_067_200 + i).alias("ts"), (i % 20).alias("user_id"),
        F.element_at(kinds, (F.floor(i / 20) % 5 + 1).cast("int")).alias("event_type")))


def test_results_made_from_a_kept_fold_do_not_fold_again(spark):
    parsed = parse_lines(_lines(spark, 3000))
    kept = []

    def keep(df):
        kept.append(df.checkpoint())
        return kept[-1]

    rows, plain = LC.correlate(parsed, materialize="checkpoint", keep=keep), LC.correlate(parsed, materialize="checkpoint")
    assert len(kept) == 1
    for mine, other in ((rows.records, plain.records), (rows.open_queues, plain.open_queues),
                        (LC.ingest_stats(rows.traced), LC.ingest_stats(plain.traced))):
        assert mine.count() and sorted(map(str, mine.collect())) == sorted(map(str, other.collect()))
    assert "Window" in str(plain.records._jdf.queryExecution().optimizedPlan())
    assert "Window" not in str(rows.records._jdf.queryExecution().optimizedPlan())


def test_a_run_folds_once(spark, tmp_path, monkeypatch):
    reads = []

    def correlate(*a, keep=None, **b):
        assert keep is not None

        def counted(df):
            reads.append(keep(df))
            return reads[-1]
        return LC.correlate(*a, keep=counted, **b)

    monkeypatch.setattr(index_job, "correlate", correlate)
    logs = tmp_path / "logs"
    logs.mkdir()
    lines = _lines(spark, 500).orderBy(F.col("rotation").desc(), "line_seq").collect()
    (logs / "mail.log.1").write_text("".join(r.line + "\n" for r in lines))
    index_job.run_index(spark, str(logs), str(tmp_path / "index"))
    assert len(reads) == 1
    assert read_index(spark, str(tmp_path / "index")).count() > 0
