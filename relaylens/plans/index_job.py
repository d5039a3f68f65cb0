"""The indexing job: log directory -> delivery index (one batch run).

list files -> leave out what has not changed since an earlier run -> read the others once -> leave out the prefixes that
earlier runs took in (``sources.prefixes``) -> parse -> correlate, continuing the open queues of the last
committed run -> classify -> write the run's part of every table -> commit (``commits``).

Nothing is lost silently.  There is no size budget unless the caller gives one; files left out are written
to ``skipped_files`` with the reason, also by a run that finds nothing to read; recognised lines that cannot be used go to
``rejected_lines``.  A file is known as unchanged by its first line's digest, size, last bytes and time of last change
together; a file of which any of these differs is read, and its lines decide: known prefixes are left
out, the rest is new.  So the growing live file goes on where the last run stopped, also after rotation and
compression and if it was caught in the middle of a line, and a corrected copy or another file with the same first line is read.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .. import storage
from ..functions import patterns as P
from ..operators.classify import bounce_rule_hits, classify
from ..operators.lifecycle import correlate, drop_rows, ingest_stats, lifecycle_diagnostics, with_log_time
from ..operators.parse import recognised_lines, rejected, usable
from ..operators.status import SKETCHES, estimated_recipients, recipient_sketches
from ..schema import INGESTED_FILES, SKIPPED_FILES
from ..session import checkpoint_dir
from ..sources.logfiles import file_digests, list_log_files, numbered_lines, read_listed_logs, select_log_files
from ..sources.prefixes import FILE_CHAINS, known_lines, prefixes, staged
from ..sources.rules import InvalidRuleList, default_rules, load_bounce_rules
from .commits import commit, read_log
from .pipeline import to_delivery_rows
from .sink import (FOLD, LEDGER, committed_runs, next_run, open_queue_changes, read_open_queues, read_table, write_deliveries,
                   write_open_queues, write_table)

RULE_HITS = "rule_id int, hits long"
DIAGNOSTICS = "file string, line_seq long, queue_id string, kind string, reason string, run_at timestamp"
REJECTED = "file string, line_seq long, queue_id string, reason string, line string"
STATS = "file string, message_id_lines long, client_id_lines long, attempts long, removed_lines long, last_line_ms long, run_at timestamp"
UNCHANGED = "unchanged since an earlier run"
COUNTERS = ("message_id_lines", "client_id_lines", "attempts", "removed_lines")


class RunResult(NamedTuple):
    spark: SparkSession
    index_dir: str
    run: int | None = None
    counters: dict | None = None

    @property
    def files(self) -> list[str]:
        """Names of the files of which the run took lines, as the ledger has them."""
        if self.run is None:
            return []
        mine = read_table(self.spark, self.index_dir, LEDGER, INGESTED_FILES, [self.run]).where("taken > 0")
        return sorted(r.file for r in mine.select("file").collect())

    @property
    def stats(self) -> DataFrame | None:
        if self.run is None:
            return None
        return read_table(self.spark, self.index_dir, "ingest_stats", STATS, [self.run]).drop("run", "run_at")


def read_ledger(spark: SparkSession, index_dir: str) -> DataFrame:
    return read_table(spark, index_dir, LEDGER, INGESTED_FILES)


def read_rule_hits(spark: SparkSession, index_dir: str) -> DataFrame | None:
    """Hit counts of all committed runs, per rule (CLS-3 feedback)."""
    if not committed_runs(spark, index_dir):
        return None
    return read_table(spark, index_dir, "rule_hits", RULE_HITS).groupBy("rule_id").agg(F.sum("hits").alias("hits"))


def current_rules(spark: SparkSession, index_dir: str, rules_path: str | None) -> tuple[DataFrame, str | None]:
    """The rule list and, if it is not the one asked for, why: an invalid list leaves the last valid one in force.

    The last valid list is kept in ``index_dir/rules``."""
    if not rules_path:
        return default_rules(spark), None
    kept = f"{index_dir}/rules"
    try:
        rules = load_bounce_rules(spark, rules_path)
    except InvalidRuleList as e:
        if not storage.runs(spark, kept, committed=True):
            raise
        last = storage.runs(spark, kept, committed=True)[-1]
        return spark.read.parquet(f"{kept}/run={last}"), f"invalid rule list, the last valid one stays in force: {e}"
    rules.write.mode("overwrite").parquet(f"{kept}/run={max([0, *storage.runs(spark, kept)]) + 1}")
    return rules, None


def _notes(spark: SparkSession, notes) -> DataFrame:
    none = F.lit(None)
    return spark.createDataFrame([(n,) for n in notes], "reason string").select(
        none.cast("string").alias("file"), none.cast("long").alias("line_seq"), none.cast("string").alias("queue_id"),
        none.cast("string").alias("kind"), "reason")


def process_lines(spark: SparkSession, lines: DataFrame, index_dir: str, run: int, rules: DataFrame, ledger: DataFrame,
                  time_zone: str = "UTC", hits: DataFrame | None = None, input_bytes: int = 0, notes=(),
                  ttl_ms: int | None = None) -> dict:
    """All tables of one run from its lines (as ``staged`` keeps them), then the commit; returns the run's counters.

    ``ledger``: a row per file, with all columns of the ledger but rows and ingested_at.  Files without a recognised line
    have counters, too: those of which ``ledger`` says that lines were taken."""
    log = read_log(spark, index_dir)
    corr = None
    with storage.Scratch(spark) as scratch:
        try:
            # read once: recognised lines, usable or not
            recognised = scratch.keep(recognised_lines(lines.where("line IS NOT NULL"), time_zone, log_dates=True))
            rows = usable(recognised)
            watermark = recognised.agg(F.max("line_ms")).head()[0]
            if ttl_ms is not None:
                rows = with_log_time(rows, log.watermark)
            # the open queues that these lines touch; the others stay as they are
            state = read_open_queues(spark, f"{index_dir}/open_queues", log=log)
            touched = rows.select("queue_id").distinct()
            seed = None if state is None else scratch.keep(state.join(touched, "queue_id", "left_semi"))
            corr = correlate(rows, seed, materialize="table", input_bytes=input_bytes, ttl_ms=ttl_ms, keep=scratch.keep)
            # staged once: the index and the rule hits both read it; hits count records before the set, as they come
            classified = scratch.keep(classify(corr.records, rules, hits, keep_rule_id=True))
            write_deliveries(to_delivery_rows(classified), f"{index_dir}/deliveries", staged=True, run=run, visible=log.live)
            write_table(bounce_rule_hits(classified, rules).select("rule_id", "hits"), index_dir, "rule_hits", run)
            write_table(recipient_sketches(to_delivery_rows(classified)), index_dir, "recipient_sketches", run)
            latest = max([x for x in (log.watermark, watermark) if x is not None], default=None)
            stays = F.lit(True)
            if ttl_ms is not None and latest is not None:
                # the others have expired: no later line can find them open
                stays = F.col("last_ms").isNull() | (F.lit(latest) - F.col("last_ms") <= ttl_ms)
            others = None if state is None else state.join(touched, "queue_id", "left_anti")
            snapshot = len(log.state) % FOLD == 0
            if snapshot:
                handed = corr.open_queues if others is None else corr.open_queues.unionByName(others)
                handed = handed.where(stays)
            else:
                handed = open_queue_changes(seed, corr.open_queues.where(stays))
                if ttl_ms is not None:
                    handed = handed.unionByName(others.where(~stays).withColumn("closed", F.lit(True)))
            write_open_queues(handed, f"{index_dir}/open_queues", run)
            at = F.current_timestamp().alias("run_at")
            found = lifecycle_diagnostics(corr.traced)
            if notes:
                found = found.unionByName(_notes(spark, notes))
            write_table(found.select("*", at), index_dir, "diagnostics", run)
            write_table(rejected(recognised), index_dir, "rejected_lines", run)
            stats = ledger.where("taken > 0").select("file").join(ingest_stats(corr.traced), "file", "left").na.fill(0, list(COUNTERS))
            seen = Observation()
            # the counters of the whole run come along with the write
            counted = stats.select("*", at).observe(seen, *[F.sum(c).alias(c) for c in COUNTERS], F.max("last_line_ms").alias("last_line_ms"))
            write_table(counted, index_dir, "ingest_stats", run)
            per_file = corr.traced.groupBy("file").agg(F.count(F.lit(1)).alias("rows"))
            rows_of = ledger.join(per_file, "file", "left").withColumns({
                "rows": F.coalesce("rows", F.lit(0)).cast("long"), "ingested_at": F.current_timestamp()})
            write_table(rows_of.select(*INGESTED_FILES.fieldNames()), index_dir, LEDGER, run)
        finally:
            if corr is not None:
                drop_rows(corr)
        commit(spark, index_dir, log, run, state="snapshot" if snapshot else "changes", watermark=watermark)
    return {k: v or 0 if k != "last_line_ms" else v for k, v in seen.get.items()}


def run_index(spark: SparkSession, log_dir: str, index_dir: str, rules_path: str | None = None,
              budget_mb: float | None = None, pattern: str = P.ROTATED_FILE_PATTERN,
              live_file: str = P.LIVE_FILE_NAME, time_zone: str = "UTC",
              include_live: bool = False, adaptive_rule_order: bool = False, ttl_ms: int | None = None,
              trust_times: bool = True) -> RunResult:
    """One indexing run.  ``budget_mb`` limits what is read, newest files first; without it everything is.  With
    ``adaptive_rule_order`` the rules are tried in the order of their hit counts over earlier runs (within soft, then hard),
    like the original agent's self-prioritising list; by default the order is
    the document order, which keeps results independent of history.  ``ttl_ms`` lets queues expire by log time.  With
    ``trust_times=False`` even files of the same size, ends and time of change are read and compared whole."""
    checkpoint_dir(spark)
    run = next_run(spark, index_dir)
    rules, note = current_rules(spark, index_dir, rules_path)
    notes = [note] if note else []
    hits = read_rule_hits(spark, index_dir) if adaptive_rule_order else None
    files = list_log_files(spark, log_dir, pattern, live_file)
    chosen = select_log_files(files, budget_mb)
    small = F.col("size_bytes") < P.MIN_FILE_BYTES
    left_out = chosen.where(~F.col("selected")).select("file", "size_bytes", F.when(small, F.lit("under 10 bytes")).otherwise(
        F.lit("over the size budget")).alias("reason"))
    chosen = chosen.where("selected").drop("selected")
    if include_live:
        chosen = chosen.unionByName(files.where("is_live"))
    with storage.Scratch(spark) as scratch:
        ledger = read_ledger(spark, index_dir)
        # what an earlier run saw of a file; a last line held back while it was live is looked for when it no longer is
        same = ["digest", "size_bytes", "tail", "modified"]
        before = ledger.groupBy(*same).agg(F.min("held").alias("was_held"))
        heads = file_digests(chosen).join(chosen.drop("file"), "path").join(before, same, "left")
        unchanged = F.col("was_held").isNotNull() & (~F.col("was_held") | F.col("is_live")) if trust_times else F.lit(False)
        heads = scratch.keep(heads.withColumn("unchanged", unchanged).drop("was_held"))
        kept_out = F.when(F.col("digest").isNull(), F.lit("empty")).when(F.col("unchanged"), F.lit(UNCHANGED))
        left_out = left_out.unionByName(heads.select("file", "size_bytes", kept_out.alias("reason")).where("reason IS NOT NULL"))
        todo = heads.where("digest IS NOT NULL AND NOT unchanged").drop("unchanged")
        weight = F.when(F.col("file").endswith("gz"), F.lit(P.COMPRESSED_SIZE_FACTOR)).otherwise(F.lit(1)) * F.col("size_bytes")
        input_bytes = todo.agg(F.sum(weight)).head()[0]
        if input_bytes is None:
            if notes or not left_out.where(F.col("reason") != UNCHANGED).isEmpty():
                write_table(left_out, index_dir, "skipped_files", run)
                write_table(_notes(spark, notes).withColumn("run_at", F.current_timestamp()), index_dir, "diagnostics", run)
                commit(spark, index_dir, read_log(spark, index_dir), run)
            return RunResult(spark, index_dir)
        # the files are read once: from here on there are places, hashes and the lines that may matter
        lines = numbered_lines(scratch.keep(staged(read_listed_logs(log_dir, todo, pattern, live_file))))
        counts = lines.groupBy("file").agg(F.count(F.lit(1)).alias("all_lines"))
        todo = scratch.keep(todo.join(counts, "file").withColumn("held", F.col("is_live") & ~F.col("ended")).withColumn(
            "lines", F.col("all_lines") - F.col("held").cast("long")))
        # held lines, and lines that came while the files were read, are for the next run
        ours = todo.select("file", "digest", (F.col("ended") | F.col("held")).alias("ended"), F.col("lines").alias("upto"))
        lines = lines.join(ours.select("file", "upto"), "file").where("line_no < upto").drop("upto")
        chains = scratch.keep(prefixes(lines, ours))
        taken_in = read_table(spark, index_dir, "file_chains", FILE_CHAINS).drop("run")
        whole = chains.where("whole").select("file", F.concat_ws("-", "lo", "hi").alias("fingerprint"))
        seen = todo.join(whole, "file", "left").join(known_lines(lines, chains, taken_in), "file", "left")
        seen = seen.withColumn("known", F.coalesce("known", F.lit(0)))
        # the same lines under two names in one run are read once
        first = seen.groupBy("digest", "lines", "fingerprint").agg(F.min("file").alias("first"))
        seen = seen.join(first, [seen[c].eqNullSafe(first[c]) for c in ("digest", "lines", "fingerprint")]).select(seen["*"], "first")
        twin = (F.col("file") != F.col("first")) & (F.col("lines") > 0)
        seen = scratch.keep(seen.withColumn("twin", twin).withColumn("taken", F.when(twin, 0).otherwise(F.col("lines") - F.col("known"))))
        why = (F.when(F.col("twin"), F.concat(F.lit("the same lines as "), F.col("first")))
               .when(F.col("lines") == 0, F.lit("no line has ended yet")).when(F.col("taken") == 0, F.lit("all lines known"))
               .when(F.col("held"), F.lit("read but for its last line, which has not ended yet")))
        skipped = seen.select("file", "size_bytes", why.alias("reason")).where("reason IS NOT NULL")
        other = ledger.select("digest").distinct().join(seen.where("NOT twin AND known = 0 AND lines > 0"), "digest").select(
            "file", "size_bytes", F.lit("read: shares only its first line with an earlier file").alias("reason"))
        write_table(left_out.unionByName(skipped).unionByName(other), index_dir, "skipped_files", run)
        write_table(chains.select("digest", "lines", "lo", "hi").distinct(), index_dir, "file_chains", run)
        fresh = seen.where("taken > 0").select("file", F.col("known").alias("from_"))
        lines = lines.join(fresh, "file").where("line_no >= from_").drop("from_")
        counters = process_lines(spark, lines, index_dir, run, rules, seen, time_zone, hits, input_bytes, notes, ttl_ms)
    return RunResult(spark, index_dir, run, counters)


def recipient_estimates(spark: SparkSession, index_dir: str, from_day=None, to_day=None) -> DataFrame:
    """Distinct recipients per client from the runs' sketches (AGG-1, estimated)."""
    return estimated_recipients(read_table(spark, index_dir, "recipient_sketches", SKETCHES), from_day, to_day)


def skipped_files(spark: SparkSession, index_dir: str) -> DataFrame:
    return read_table(spark, index_dir, "skipped_files", SKIPPED_FILES)
