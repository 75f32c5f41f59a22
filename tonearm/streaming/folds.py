"""State folds over event tables: the batch form of each stream, and its reference in tests."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: States in order of progress; later ones are not left for earlier ones by repeated completion events.
STATES = ("needs_search", "searching", "candidates_found", "queued", "downloading", "downloaded", "ingesting", "proposal_available", "linked", "failed", "link_failed")
LATE = ("downloaded", "ingesting", "proposal_available", "linked")


def latest_state(events: DataFrame) -> DataFrame:
    """Per key: last state by (ts, id), first and last time of any event, events seen."""
    last = F.struct("ts", "id")
    return events.groupBy("key").agg(F.max_by("state", last).alias("state"), F.min("ts").alias("first_at"), F.max("ts").alias("last_at"), F.count("*").alias("n"))


def set_once(events: DataFrame, state: str) -> DataFrame:
    """Per key the first time of ``state``; repeats change nothing."""
    return events.where(F.col("state") == state).groupBy("key").agg(F.min("ts").alias(f"{state}_at"))


def completion_fold(events: DataFrame, completion: str = "queued", late: tuple[str, ...] = ("linked",)) -> DataFrame:
    """Per key the last state, where a ``completion`` event after a ``late`` state does not set it back."""
    w = W.partitionBy("key").orderBy("ts", "id").rowsBetween(W.unboundedPreceding, -1)
    was_late = F.max(F.col("state").isin(*late).cast("int")).over(w)
    kept = events.withColumn("was_late", F.coalesce(was_late, F.lit(0))).where(~((F.col("state") == completion) & (F.col("was_late") == 1)))
    return latest_state(kept)


def current_attempts(events: DataFrame, attempt: str = "attempt") -> DataFrame:
    """Events of each key's newest attempt; results of older attempts are late and are dropped."""
    return events.withColumn("newest", F.max(attempt).over(W.partitionBy("key"))).where(F.col(attempt) == F.col("newest")).drop("newest")


def reclaimable(rows: DataFrame, now, hours: int = 1, max_attempts: int = 3) -> DataFrame:
    """Pending rows older than the lease with attempts left; another analyzer version starts again at one."""
    stale = (F.col("status") == "pending") & (F.col("updated_at") < F.lit(now) - F.expr(f"INTERVAL {hours} HOURS")) & (F.col("attempts") < max_attempts)
    outdated = ~F.coalesce(F.col("current"), F.lit(False))
    return rows.where(stale | outdated).withColumn("next_attempt", F.when(outdated, F.lit(1).cast("long")).otherwise(F.col("attempts") + 1))


def first_in_window(events: DataFrame, seconds: int) -> DataFrame:
    """Events that are not within ``seconds`` of the last kept one of their key: duplicates with a time to live, exactly.

    The kept chain is sequential within a key: keys are sorted within their partitions and walked once, with the last kept time alone in hand.
    """
    kind = dict(events.dtypes)["key"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, kept = None, None
        for batch in batches:
            keys, out = batch.column(0).to_pylist(), []
            for i, (k, at) in enumerate(zip(keys, batch.column(1).to_pylist())):
                if kept is None or k != key or at - kept >= seconds * 1_000_000:
                    key, kept = k, at
                    out.append(i)
            yield batch.take(pa.array(out, pa.int64())).select(["key", "id"])

    times = events.select("key", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), "id").repartition("key").sortWithinPartitions("key", "at", "id")
    return times.mapInArrow(run, f"key {kind}, id long")


def stable_files(snapshots: DataFrame, needed: int = 10) -> DataFrame:
    """(key, since): files whose last ``needed`` snapshots by time have one size, above zero, and one modification time."""
    w = W.partitionBy("key").orderBy(F.desc("ts"))
    last = snapshots.withColumn("k", F.row_number().over(w)).where(F.col("k") <= needed)
    g = last.groupBy("key").agg(F.count("*").alias("n"), F.min("size").alias("low"), F.max("size").alias("high"), F.countDistinct("mtime").alias("times"), F.min("ts").alias("since"))
    return g.where((F.col("n") == needed) & (F.col("low") == F.col("high")) & (F.col("low") > 0) & (F.col("times") == 1)).select("key", "since")


def stable_runs(looks: DataFrame, needed: int = 10) -> DataFrame:
    """(key, since, ready, size): runs of ``needed`` equal looks in a row of a size above zero, with their first and their ``needed``-th look; a longer run is one."""
    w = W.partitionBy("key").orderBy("ts", "id")
    changed = F.coalesce((F.col("size") != F.lag("size").over(w)) | (F.col("mtime") != F.lag("mtime").over(w)), F.lit(True)) | (F.col("size") <= 0)
    runs = looks.withColumn("run", F.sum(changed.cast("int")).over(w))
    at = W.partitionBy("key", "run").orderBy("ts", "id")
    numbered = runs.withColumn("k", F.row_number().over(at)).withColumn("since", F.first("ts").over(at))
    return numbered.where((F.col("k") == needed) & (F.col("size") > 0)).select("key", "since", F.col("ts").alias("ready"), "size")


def decided_sightings(rows: DataFrame, known: DataFrame) -> DataFrame:
    """``rows`` (key, id, ts, size, mtime, failed) with their decision, and the failure known after each of them (after_size, after_mtime, after_id; null: none).

    A file that looks as it did when it failed is skipped; one that has changed is retried and its failure forgotten; one without a failure is enqueued. A failure
    without a look takes that of the next sighting, which is skipped. ``known`` has the failures from before (key, f_size, f_mtime, f_id), one a key.
    """
    w = W.partitionBy("key").orderBy("ts", "id")
    island = rows.withColumn("island", F.sum(F.col("failed").cast("int")).over(w)).join(known, "key", "left")
    inside = W.partitionBy("key", "island").orderBy("ts", "id")
    # The first row of an island after the first one is its failure.
    failure = lambda own, before: F.when(F.col("island") > 0, F.first(F.when(F.col("failed"), F.col(own)), ignorenulls=True).over(inside)).otherwise(F.col(before))
    x = island.select("key", "id", "ts", "size", "mtime", "failed", "island", failure("id", "f_id").alias("of"), failure("size", "f_size").alias("of_size"), failure("mtime", "f_mtime").alias("of_mtime"))
    seen = ~F.col("failed") & F.col("size").isNotNull() & F.col("mtime").isNotNull()
    blind = F.col("of_size").isNull() | F.col("of_mtime").isNull()
    adopted = lambda c: F.when(blind, F.first(F.when(seen, F.col(c)), ignorenulls=True).over(inside)).otherwise(F.col(f"of_{c}"))
    x = x.withColumn("l_size", adopted("size")).withColumn("l_mtime", adopted("mtime"))
    differs = seen & F.col("of").isNotNull() & ((F.col("size") != F.col("l_size")) | (F.col("mtime") != F.col("l_mtime")))
    x = x.withColumn("differs", F.coalesce(differs, F.lit(False)).cast("int")).withColumn("changes", F.sum("differs").over(inside))
    decision = F.when(F.col("of").isNull() | ~seen, "enqueue").when(F.col("changes") == 0, "skip").when((F.col("changes") == 1) & (F.col("differs") == 1), "retry").otherwise("enqueue")
    known_after = F.col("of").isNotNull() & (F.col("changes") == 0)
    after = lambda c: F.when(known_after, F.col(c))
    return x.select("key", "id", "ts", "failed", F.when(~F.col("failed"), decision).alias("decision"), after("l_size").alias("after_size"), after("l_mtime").alias("after_mtime"), after("of").alias("after_id"))
