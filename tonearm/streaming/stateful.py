"""Streams that keep state of their own: debounce, claims with a time to live, attempts against results, skips of known failures, and a ledger of batches.

Each has a batch form in :mod:`tonearm.streaming.folds` that it must equal, for any split of the rows into micro-batches in order of time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tonearm.streaming.folds import decided_sightings

def debounced(looks: DataFrame, needed: int = 10, idle_ms: int = 30 * 86_400_000, late: str = "0 seconds") -> DataFrame:
    """(key, since, ready, size) of streamed looks (key, id, ts, size, mtime): a file is let through at its ``needed``-th equal look in a row, once.

    Any change, and an empty file, starts again. A look older than the newest one says nothing of the file as it is, and is left out; a file without
    looks for ``idle_ms`` of event time is forgotten.
    """
    kind = looks.schema["key"].dataType.simpleString()
    names = ["key", "since_at", "ready_at", "size"]

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        size, mtime, count, since, last = state.get if state.exists else (None, None, 0, None, None)
        out = []
        for r in pd.concat(list(batches)).sort_values(["at", "id"]).itertuples():
            if last is not None and r.at < last:
                continue
            if (r.size, r.mtime) != (size, mtime) or r.size <= 0:
                size, mtime, count, since = int(r.size), int(r.mtime), 0, int(r.at)
            if size > 0:
                count += 1
                if count == needed:
                    out.append((key[0], since, int(r.at), size))
            last = int(r.at)
        state.update((size, mtime, min(count, needed + 1), since, last))
        state.setTimeoutTimestamp(max(last // 1000 + idle_ms, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=names)

    # Time-outs by the clock would keep a stream that only drains what there is from ever ending.
    rows = looks.withWatermark("ts", late).select("key", "id", "ts", F.unix_micros("ts").alias("at"), F.coalesce("size", F.lit(0)).cast("long").alias("size"), F.coalesce("mtime", F.lit(0)).cast("long").alias("mtime"))
    found = rows.groupBy("key").applyInPandasWithState(step, f"key {kind}, since_at long, ready_at long, size long", "size long, mtime long, looks int, since long, last long", "append", GroupStateTimeout.EventTimeTimeout)
    return found.select("key", F.timestamp_micros("since_at").alias("since"), F.timestamp_micros("ready_at").alias("ready"), "size")


def claimed(events: DataFrame, ttl_seconds: int = 21_600, rest_seconds: int = 30, late: str = "0 seconds", buckets: int = 1024) -> DataFrame:
    """(key, id, answer) of each streamed request: accepted, in_flight or recent. ``events`` has key, id, ts and ends.

    A key is in flight from an accepted request to its end, which releases it early, or for ``ttl_seconds`` at most; for ``rest_seconds`` after its end it was handled just now.
    What has expired by event time is dropped; answers compare times themselves, so they do not hang on when that happens. The state holds the keys of a bucket
    together, as a call for each key and batch costs far more than its few rows; ``buckets`` changes no answer, but must stay as it is for a stream's life.
    """
    kind = events.schema["key"].dataType.simpleString()
    ttl, rest = ttl_seconds * 1_000_000, rest_seconds * 1_000_000

    def step(_: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        known = {k: (held, ended) for k, held, ended in zip(*state.get)} if state.exists else {}
        keys, ids, answers = [], [], []
        if not state.hasTimedOut:
            rows = pd.concat(list(batches), ignore_index=True)
            rows = rows.iloc[np.lexsort((rows["id"], rows["at"]))]
            for k, i, at, ends in zip(rows["key"].tolist(), rows["id"].tolist(), rows["at"].tolist(), rows["ends"].tolist()):
                held, ended = known.get(k, (None, None))
                if ends:
                    # Only a claim still in force can end.
                    known[k] = None, at if held is not None and at < held + ttl else ended
                    continue
                if held is not None and at < held + ttl:
                    answer = "in_flight"
                elif ended is not None and at <= ended + rest:
                    answer = "recent"
                else:
                    answer = "accepted"
                    known[k] = at, ended
                keys.append(k)
                ids.append(i)
                answers.append(answer)
        now, alive, first = state.getCurrentWatermarkMs(), [], None
        for k, (held, ended) in known.items():
            ends_at = [since + length for since, length in ((held, ttl), (ended, rest)) if since is not None]
            # Before the first watermark nothing has expired.
            if ends_at and (now <= 0 or max(ends_at) // 1000 + 1 > now):
                alive.append((k, held, ended))
                until = max(ends_at) // 1000 + 1
                first = until if first is None else min(first, until)
        if alive:
            state.update(tuple(list(c) for c in zip(*alive)))
            state.setTimeoutTimestamp(max(first, now + 1))
        elif state.exists:
            state.remove()
        yield pd.DataFrame({"key": pd.Series(keys, dtype=object), "id": pd.Series(ids, dtype="int64"), "answer": pd.Series(answers, dtype=object)})

    # Keys travel as text, so that a null among numbers rounds none of them.
    rows = events.withWatermark("ts", late).select(F.pmod(F.xxhash64("key"), F.lit(buckets)).alias("bucket"), F.col("key").cast("string").alias("key"), "id", "ts", F.unix_micros("ts").alias("at"), "ends")
    found = rows.groupBy("bucket").applyInPandasWithState(step, "key string, id long, answer string", "keys array<string>, held array<long>, ended array<long>", "append", GroupStateTimeout.EventTimeTimeout)
    return found.select(F.col("key").cast(kind).alias("key"), "id", "answer")


def attempt_outcomes(attempts: DataFrame, results: DataFrame, lease: str = "1 hour", late: str = "0 seconds") -> DataFrame:
    """(job, attempt_id, result_id, outcome) of two streams (job, id, ts): a result within its attempt's lease is accepted; an attempt without one is reclaimed once the lease is over for certain; any other result is stale.

    A full outer interval join: both watermarks bound what is kept, and outer rows come when they pass.
    """
    a = attempts.select("job", F.col("id").alias("attempt_id"), F.col("ts").alias("began")).withWatermark("began", late)
    r = results.select(F.col("job").alias("r_job"), F.col("id").alias("result_id"), F.col("ts").alias("ended")).withWatermark("ended", late)
    within = (F.col("job") == F.col("r_job")) & (F.col("ended") >= F.col("began")) & (F.col("ended") <= F.col("began") + F.expr(f"INTERVAL {lease}"))
    outcome = F.when(F.col("result_id").isNull(), "reclaimed").when(F.col("attempt_id").isNull(), "stale").otherwise("accepted")
    return a.join(r, within, "full").select(F.coalesce("job", "r_job").alias("job"), "attempt_id", "result_id", outcome.alias("outcome"))


def skip_known_failures(spark: SparkSession, root: str) -> Callable[[DataFrame, int], None]:
    """A sink for batches of sightings (key, id, ts, size, mtime, failed): writes their decisions, and the failures known after them, under ``root``.

    Batch n reads the snapshot that batch n-1 left and leaves snapshot n, so the static side is always the newest one, and a batch that runs again finds what it found
    before and writes the same.
    """
    state = "key long, f_size long, f_mtime long, f_id long"

    def each(batch: DataFrame, number: int) -> None:
        path = f"{root}/failures/{number - 1:06d}"
        known = spark.read.schema(state).parquet(path) if number else spark.createDataFrame([], state)
        rows = batch.select("key", "id", "ts", "size", "mtime", "failed")
        judged = decided_sightings(rows, known).persist()
        judged.where("NOT failed").select("key", "id", "decision").write.mode("overwrite").parquet(f"{root}/decisions/batch={number:06d}")
        last = judged.withColumn("k", F.row_number().over(W.partitionBy("key").orderBy(F.desc("ts"), F.desc("id")))).where("k = 1")
        left = last.where("after_id IS NOT NULL").select("key", F.col("after_size").alias("f_size"), F.col("after_mtime").alias("f_mtime"), F.col("after_id").alias("f_id"))
        left.unionByName(known.join(last, "key", "left_anti")).write.mode("overwrite").parquet(f"{root}/failures/{number:06d}")
        judged.unpersist()

    return each


def publishing(root: str, derive: dict[str, Callable[[DataFrame], DataFrame]]) -> Callable[[DataFrame, int], None]:
    """A sink that writes what ``derive`` makes of each batch, table by table, and then enters the batch in a ledger: readers see all of its tables or none.

    The entry is the barrier: what depends on a batch starts when its number is in the ledger. A batch that failed half-way and runs again overwrites its own parts; one
    that was entered already and comes again changes nothing.
    """

    def each(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        if number in entered(spark, root):
            return
        batch.persist()
        try:
            for name, make in derive.items():
                make(batch).write.mode("overwrite").parquet(f"{root}/{name}/batch={number}")
            spark.createDataFrame([(number,)], "entry long").coalesce(1).write.mode("overwrite").parquet(f"{root}/ledger/entry-{number}")
        finally:
            batch.unpersist()

    return each


def entered(spark: SparkSession, root: str) -> set[int]:
    """The numbers in the ledger: one a batch that was published whole."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root}/ledger")
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    done = [s.getPath() for s in fs.listStatus(path)] if fs.exists(path) else []
    marks = [p for p in done if fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
    return {int(p.getName().removeprefix("entry-")) for p in marks}


def published(spark: SparkSession, root: str, name: str, schema: str) -> DataFrame:
    """The rows of a derived table, of the batches in the ledger alone, with their ``batch``."""
    paths = [f"{root}/{name}/batch={n}" for n in sorted(entered(spark, root))]
    if not paths:
        return spark.createDataFrame([], f"{schema}, batch int")
    return spark.read.schema(f"{schema}, batch int").option("basePath", f"{root}/{name}").parquet(*paths)


def arriving(rows: DataFrame, order: str, batches: int, land: str, run: Callable[[], None]) -> None:
    """Lands ``rows`` under ``land`` in ``batches`` slices of rising ``order``, and calls ``run`` after each: what arrives one after the other, by order alone."""
    cuts = rows.agg(F.percentile_approx(F.col(order), [k / batches for k in range(1, batches)], 10_000)).first()[0] or []
    ends = [None, *sorted(set(cuts)), None]
    for low, high in zip(ends, ends[1:]):
        part = rows if low is None else rows.where(F.col(order) > F.lit(low))
        (part if high is None else part.where(F.col(order) <= F.lit(high))).write.mode("append").parquet(land)
        run()
