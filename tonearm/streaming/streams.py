"""Structured Streaming forms: file arrival, failure counters, time-to-live duplicates, and the acquisition state machine."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType


def event_files(spark: SparkSession, path: str, schema: StructType, per_trigger: int = 1) -> DataFrame:
    """Parquet files of events as they arrive."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)


def arriving_audio(spark: SparkSession, path: str, suffixes: tuple[str, ...] = ("mp3", "flac", "wav", "aiff", "aif")) -> DataFrame:
    """(path, length, modificationTime) of audio files as they arrive, hidden ones left out."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("recursiveFileLookup", "true").load(path).select("path", "length", "modificationTime")
    name = F.element_at(F.split("path", "/"), -1)
    return files.where(F.lower(name).rlike(rf"\.({'|'.join(suffixes)})$") & ~name.startswith("."))


def failure_counters(events: DataFrame) -> DataFrame:
    """Running attempts, first and last time, last reason per key."""
    return events.groupBy("key").agg(F.count("*").alias("attempts"), F.min("ts").alias("first_at"), F.max("ts").alias("last_at"), F.max_by("reason", F.struct("ts", "id")).alias("reason"))


def once_within(events: DataFrame, keys: list[str], delay: str = "30 seconds") -> DataFrame:
    """Each key once per time-to-live; state older than the watermark is dropped."""
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(keys)


def windowed_counts(events: DataFrame, length: str = "1 day", late: str = "1 hour") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.window("ts", length).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


def state_machine(events: DataFrame, completion: str = "queued", late: tuple[str, ...] = ("linked",), idle_ms: int | None = None) -> DataFrame:
    """Per key the state after its events so far, in (ts, id) order within a batch.

    A completion does not set a late state back; an event older than the state's own is counted and otherwise ignored. With ``idle_ms`` the state of a key without
    events for that long is dropped; without it every key's five values are kept.
    """
    timeout = GroupStateTimeout.ProcessingTimeTimeout if idle_ms else GroupStateTimeout.NoTimeout

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        status, seen_ts, seen_id, n, was_late = state.get if state.exists else (None, None, -1, 0, False)
        rows = pd.concat(list(batches)).sort_values(["ts", "id"])
        n += len(rows)
        if seen_ts is not None:
            seen = pd.Timestamp(seen_ts)
            rows = rows[(rows["ts"] > seen) | ((rows["ts"] == seen) & (rows["id"] >= seen_id))]
        if len(rows):
            is_late = rows["state"].isin(late)
            before = is_late.cummax().shift(fill_value=False) | was_late
            counted = rows["state"][~((rows["state"] == completion) & before)]
            status = counted.iloc[-1] if len(counted) else status
            was_late = bool(was_late or is_late.any())
            seen_ts, seen_id = rows["ts"].iloc[-1].to_pydatetime(), int(rows["id"].iloc[-1])
        state.update((status, seen_ts, seen_id, n, was_late))
        if idle_ms:
            state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame({"key": [key[0]], "state": [status], "last_at": [seen_ts], "n": [n]})

    return events.select("key", "id", "ts", "state").groupBy("key").applyInPandasWithState(step, "key long, state string, last_at timestamp, n long", "status string, seen_ts timestamp, seen_id long, n long, was_late boolean", "update", timeout)


def drained(stream: DataFrame, mode: str, checkpoint: str, each: Callable[[DataFrame, int], None]) -> None:
    """Run a stream over what there is now, giving each micro-batch to ``each``, and wait for its end."""
    stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(each).start().awaitTermination()


def keep_latest(path: str, keys: list[str]) -> Callable[[DataFrame, int], None]:
    """A sink for update mode: batches are written side by side and read back as the newest row per key."""

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/batch={number:06d}")

    return write


def read_latest(spark: SparkSession, path: str, schema: StructType, keys: list[str]) -> DataFrame:
    rows = spark.read.schema(schema.add("batch", "long")).option("recursiveFileLookup", "true").parquet(path)
    values = F.struct(*[c for c in rows.columns if c not in keys])
    return rows.groupBy(*keys).agg(F.max_by(values, "batch").alias("v")).select(*keys, "v.*").drop("batch")
