"""Queries of event folds and of the streams that must agree with them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonearm.operators.upsert import counted_failures
from tonearm.plans.registry import query
from tonearm.storage import drop_at_exit, fresh_path
from tonearm.streaming import folds, stateful, streams
from tonearm.tables import Tables


@query("SELECT key, arg_max(state, (ts, id)) AS state, min(ts) AS first_at, max(ts) AS last_at, CAST(count(*) AS BIGINT) AS n FROM r_events GROUP BY key")
def latest_state(t: Tables) -> DataFrame:
    return folds.latest_state(t.events)


@query("SELECT key, min(ts) AS linked_at FROM r_events WHERE state = 'linked' GROUP BY key")
def set_once(t: Tables) -> DataFrame:
    return folds.set_once(t.events, "linked")


COMPLETION = "SELECT key, arg_max(state, (ts, id)) AS state, CAST(count(*) AS BIGINT) AS n FROM (SELECT *, coalesce(max(CASE WHEN state = 'linked' THEN 1 ELSE 0 END) OVER (PARTITION BY key ORDER BY ts, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS late FROM r_events) WHERE NOT (state = 'queued' AND late = 1) GROUP BY key"


@query(COMPLETION)
def completion_fold(t: Tables) -> DataFrame:
    return folds.completion_fold(t.events).select("key", "state", "n")


def _is_folder(t: Tables) -> bool:
    path = t.spark._jvm.org.apache.hadoop.fs.Path(f"{t.sf_dir}/events.parquet")
    return path.getFileSystem(t.spark._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory()


def event_stream(t: Tables) -> DataFrame:
    """The event table as a stream: a single file is picked out of its folder by name."""
    schema = t.raw("events").schema
    source = t.spark.readStream.schema(schema)
    raw = source.parquet(f"{t.sf_dir}/events.parquet") if _is_folder(t) else source.option("pathGlobFilter", "events.parquet").parquet(t.sf_dir)
    state = F.when(F.col("event_type") == "signup", "searching").when(F.col("event_type") == "view", "candidates_found").when(F.col("event_type") == "click", "queued").when(F.col("event_type") == "purchase", "linked").otherwise("failed")
    return raw.select(F.col("event_id").alias("id"), F.col("user_id").alias("key"), F.col("ts").cast("timestamp").alias("ts"), "event_type", state.alias("state"), "value")


def _drained(t: Tables, stream: DataFrame, mode: str, keys: list[str], name: str) -> DataFrame:
    out, log = fresh_path(t.spark, name), fresh_path(t.spark, f"{name}-log")
    streams.drained(stream, mode, log, streams.keep_latest(out, keys))
    for path in (out, log):
        drop_at_exit(t.spark, path)
    return streams.read_latest(t.spark, out, stream.schema, keys)


@query("SELECT user_id AS key, CAST(count(*) AS BIGINT) AS attempts, min(ts) AS first_at, max(ts) AS last_at, arg_max(event_type || ':' || CAST(event_id AS VARCHAR), (ts, event_id)) AS reason FROM events GROUP BY user_id")
def stream_failures(t: Tables) -> DataFrame:
    reason = F.concat("event_type", F.lit(":"), F.col("id").cast("string"))
    return _drained(t, streams.failure_counters(event_stream(t).withColumn("reason", reason)), "update", ["key"], "stream-failures")


@query("SELECT user_id AS key, CAST(count(*) AS BIGINT) AS attempts, min(ts) AS first_at, max(ts) AS last_at, arg_max(event_type, (ts, event_id)) AS reason FROM events GROUP BY user_id")
def upsert_counter(t: Tables) -> DataFrame:
    return counted_failures(t.events.withColumn("reason", F.col("event_type")))


@query(COMPLETION.replace("CAST(count(*) AS BIGINT) AS n FROM", "max(n_all) AS n FROM").replace("SELECT *, coalesce", "SELECT *, CAST(count(*) OVER (PARTITION BY key) AS BIGINT) AS n_all, coalesce"))
def stream_state_machine(t: Tables) -> DataFrame:
    return _drained(t, streams.state_machine(event_stream(t)), "update", ["key"], "stream-states").select("key", "state", "n")


@query("SELECT count(DISTINCT (user_id, event_type)) AS n FROM events")
def stream_dedupe(t: Tables) -> DataFrame:
    """With a time-to-live longer than the table each key comes once."""
    once = streams.once_within(event_stream(t), ["key", "event_type"], "365 days").select("key", "event_type", "id")
    return _drained(t, once, "append", ["key", "event_type"], "stream-dedupe").agg(F.count("*").alias("n"))


@query("SELECT date_trunc('day', ts) AS start, event_type, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY 1, 2")
def stream_windows(t: Tables) -> DataFrame:
    return _drained(t, streams.windowed_counts(event_stream(t)), "update", ["start", "event_type"], "stream-windows")


@query("WITH RECURSIVE e AS (SELECT key, id, ts, row_number() OVER (PARTITION BY key ORDER BY ts, id) AS n FROM r_events), k AS (SELECT key, id, ts, n, TRUE AS kept, ts AS last FROM e WHERE n = 1 UNION ALL SELECT e.key, e.id, e.ts, e.n, e.ts >= k.last + INTERVAL 6 HOUR, CASE WHEN e.ts >= k.last + INTERVAL 6 HOUR THEN e.ts ELSE k.last END FROM k JOIN e ON e.key = k.key AND e.n = k.n + 1) SELECT key, id FROM k WHERE kept")
def enqueue_once(t: Tables) -> DataFrame:
    """One event per key in six hours, counted from the last one let through."""
    return folds.first_in_window(t.events.withColumn("ts", F.col("ts").cast("timestamp")), 6 * 3600)


@query("SELECT id, key FROM (SELECT *, max(id % 3) OVER (PARTITION BY key) AS newest FROM r_events) WHERE id % 3 = newest")
def stale_attempts(t: Tables) -> DataFrame:
    return folds.current_attempts(t.events.withColumn("attempt", F.col("id") % 3)).select("id", "key")


@query("SELECT id, CASE WHEN NOT cur THEN 1 ELSE attempts + 1 END AS next_attempt FROM (SELECT id, ts, id % 4 AS attempts, event_type = 'view' AS pending, id % 7 <> 0 AS cur FROM r_events) WHERE NOT cur OR (pending AND ts < TIMESTAMP '2024-01-15 00:00:00' - INTERVAL 1 HOUR AND attempts < 3)")
def lease_reclaim(t: Tables) -> DataFrame:
    rows = t.events.select("id", F.when(F.col("event_type") == "view", "pending").otherwise("ready").alias("status"), F.col("ts").cast("timestamp").alias("updated_at"), (F.col("id") % 4).alias("attempts"), (F.col("id") % 7 != 0).alias("current"))
    return folds.reclaimable(rows, F.to_timestamp(F.lit("2024-01-15 00:00:00"))).select("id", "next_attempt")


#: Events as looks at a file: it grows every eight days, is touched now and then, and some are empty.
LOOKS = "SELECT user_id AS key, event_id AS id, ts, CASE WHEN user_id % 7 = 0 THEN 0 ELSE (epoch_us(ts) // 86400000000 + user_id) // 8 END AS size, CAST(event_id % 101 = 0 AS BIGINT) AS mtime FROM events"


def looks(t: Tables) -> DataFrame:
    day = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 86_400_000_000)
    size = F.when(F.col("key") % 7 == 0, 0).otherwise(F.floor((day + F.col("key")) / 8))
    return t.events.select("key", "id", F.col("ts").cast("timestamp").alias("ts"), size.cast("long").alias("size"), (F.col("id") % 101 == 0).cast("long").alias("mtime"))


def _looked(needed: str) -> str:
    return f"WITH l AS ({LOOKS}), c AS (SELECT *, coalesce(size <> lag(size) OVER w OR mtime <> lag(mtime) OVER w, TRUE) OR size <= 0 AS changed FROM l WINDOW w AS (PARTITION BY key ORDER BY ts, id)), r AS (SELECT *, sum(CAST(changed AS INTEGER)) OVER (PARTITION BY key ORDER BY ts, id) AS run FROM c), n AS (SELECT *, row_number() OVER (PARTITION BY key, run ORDER BY ts, id) AS k, first(ts) OVER (PARTITION BY key, run ORDER BY ts, id) AS since FROM r) SELECT key, {needed}"


@query(_looked("min(since) AS since FROM n WHERE k = 10 AND size > 0 GROUP BY key"))
def stable_files(t: Tables) -> DataFrame:
    """Files that ever stood still for ten looks, and since when they first did."""
    return folds.stable_runs(looks(t), 10).groupBy("key").agg(F.min("since").alias("since"))


def arrivals(t: Tables, rows: DataFrame, make, each, batches: int = 3, mode: str = "append", last: DataFrame | None = None) -> None:
    """Lets ``rows`` arrive in slices by time and runs the stream that ``make`` builds on them after each, ``last`` after all others."""
    land, log = fresh_path(t.spark, "arrivals"), fresh_path(t.spark, "arrivals-log")
    for path in (land, log):
        drop_at_exit(t.spark, path)
    run = lambda: streams.drained(make(t.spark.readStream.schema(rows.schema).parquet(land)), mode, log, each)
    stateful.arriving(rows, "ts", batches, land, run)
    if last is not None:
        last.write.mode("append").parquet(land)
        run()


def _side_by_side(t: Tables, name: str):
    """(a sink that writes batches side by side, the folder)."""
    out = fresh_path(t.spark, name)
    drop_at_exit(t.spark, out)
    return (lambda batch, number: batch.write.mode("overwrite").parquet(f"{out}/batch={number:06d}")), out


@query(_looked("since, ts AS ready, size FROM n WHERE k = 10 AND size > 0"))
def stream_stable_runs(t: Tables) -> DataFrame:
    """Looks that arrive in three batches; a file is let through at its tenth equal look in a row, however the batches cut its run."""
    each, out = _side_by_side(t, "stable-runs")
    arrivals(t, looks(t), stateful.debounced, each)
    return t.spark.read.schema("key long, since timestamp, ready timestamp, size long").parquet(f"{out}/batch=*")


CLAIMED = """
WITH RECURSIVE e AS (SELECT user_id AS key, event_id AS id, ts, event_type = 'purchase' AS ends, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
k AS (SELECT key, id, n, ends, 'accepted' AS answer, CASE WHEN NOT ends THEN ts END AS claimed, CAST(NULL AS TIMESTAMP) AS ended FROM e WHERE n = 1
UNION ALL SELECT e.key, e.id, e.n, e.ends,
    CASE WHEN k.claimed IS NOT NULL AND e.ts < k.claimed + INTERVAL 6 HOUR THEN 'in_flight' WHEN k.ended IS NOT NULL AND e.ts <= k.ended + INTERVAL 1 HOUR THEN 'recent' ELSE 'accepted' END,
    CASE WHEN e.ends THEN NULL WHEN k.claimed IS NOT NULL AND e.ts < k.claimed + INTERVAL 6 HOUR THEN k.claimed WHEN k.ended IS NOT NULL AND e.ts <= k.ended + INTERVAL 1 HOUR THEN k.claimed ELSE e.ts END,
    CASE WHEN e.ends AND k.claimed IS NOT NULL AND e.ts < k.claimed + INTERVAL 6 HOUR THEN e.ts ELSE k.ended END
FROM k JOIN e ON e.key = k.key AND e.n = k.n + 1)
SELECT key, id, answer FROM k WHERE NOT ends
"""


@query(CLAIMED)
def stream_claims(t: Tables) -> DataFrame:
    """Requests in three batches: one claim in flight for six hours at most, released early by a purchase, after which the key rests for an hour."""
    each, out = _side_by_side(t, "claims")
    rows = t.events.select("key", "id", F.col("ts").cast("timestamp").alias("ts"), (F.col("event_type") == "purchase").alias("ends"))
    arrivals(t, rows, lambda s: stateful.claimed(s, 6 * 3600, 3600), each)
    return t.spark.read.schema("key long, id long, answer string").parquet(f"{out}/batch=*")


OUTCOMES = """
WITH a AS (SELECT event_id // 5 AS job, event_id AS id, ts FROM events WHERE event_id % 5 = 0), r AS (SELECT event_id // 5 AS job, event_id AS id, ts FROM events WHERE event_id % 5 = 3 AND event_type <> 'error')
SELECT coalesce(a.job, r.job) AS job, a.id AS attempt_id, r.id AS result_id, CASE WHEN r.id IS NULL THEN 'reclaimed' WHEN a.id IS NULL THEN 'stale' ELSE 'accepted' END AS outcome
FROM a FULL JOIN r ON a.job = r.job AND r.ts >= a.ts AND r.ts <= a.ts + INTERVAL 10 MINUTE
"""


@query(OUTCOMES)
def stream_attempts(t: Tables) -> DataFrame:
    """Every fifth event starts an attempt, the third after it may bring its result, within ten minutes or too late; a heartbeat from long after them ends all leases."""
    each, out = _side_by_side(t, "attempts")
    rows = t.events.select(F.floor(F.col("id") / 5).alias("job"), "id", F.col("ts").cast("timestamp").alias("ts"), (F.col("id") % 5).alias("part"), (F.col("event_type") != "error").alias("good"))
    beat = rows.agg((F.max("ts") + F.expr("INTERVAL 30 DAYS")).alias("ts")).select(F.lit(-1).cast("long").alias("job"), F.lit(-1).cast("long").alias("id"), "ts", F.explode(F.array(F.lit(0).cast("long"), F.lit(3).cast("long"))).alias("part"), F.lit(True).alias("good"))
    outcomes = lambda s: stateful.attempt_outcomes(s.where("part = 0").select("job", "id", "ts"), s.where("part = 3 AND good").select("job", "id", "ts"), "10 minutes")
    arrivals(t, rows, outcomes, each, last=beat)
    return t.spark.read.schema("job long, attempt_id long, result_id long, outcome string").parquet(f"{out}/batch=*").where("job >= 0")


SKIPS = """
WITH e AS (SELECT user_id AS key, event_id AS id, ts, event_type = 'error' AS failed, CASE WHEN event_id % 3 <> 0 THEN user_id % 5 + event_id % 2 END AS size, CAST(value AS BIGINT) // 60 AS mtime FROM events),
i AS (SELECT *, sum(CAST(failed AS INTEGER)) OVER (PARTITION BY key ORDER BY ts, id) AS island FROM e),
f AS (SELECT *, max(CASE WHEN failed THEN id END) OVER g AS o, max(CASE WHEN failed THEN size END) OVER g AS o_size, max(CASE WHEN failed THEN mtime END) OVER g AS o_mtime FROM i WINDOW g AS (PARTITION BY key, island)),
l AS (SELECT *, NOT failed AND size IS NOT NULL AS seen, CASE WHEN o_size IS NULL THEN first_value(CASE WHEN NOT failed AND size IS NOT NULL THEN size END IGNORE NULLS) OVER w ELSE o_size END AS l_size, CASE WHEN o_size IS NULL THEN first_value(CASE WHEN NOT failed AND size IS NOT NULL THEN mtime END IGNORE NULLS) OVER w ELSE o_mtime END AS l_mtime FROM f WINDOW w AS (PARTITION BY key, island ORDER BY ts, id)),
d AS (SELECT *, coalesce(seen AND o IS NOT NULL AND (size <> l_size OR mtime <> l_mtime), FALSE) AS differs FROM l),
c AS (SELECT *, sum(CAST(differs AS INTEGER)) OVER (PARTITION BY key, island ORDER BY ts, id) AS changes FROM d)
SELECT key, id, CASE WHEN o IS NULL OR NOT seen THEN 'enqueue' WHEN changes = 0 THEN 'skip' WHEN changes = 1 AND differs THEN 'retry' ELSE 'enqueue' END AS decision FROM c WHERE NOT failed
"""


@query(SKIPS)
def stream_skips(t: Tables) -> DataFrame:
    """Sightings and failures in three batches, each joined with the failures that the one before it left."""
    root = fresh_path(t.spark, "skips")
    drop_at_exit(t.spark, root)
    size = F.when(F.col("id") % 3 != 0, F.col("key") % 5 + F.col("id") % 2)
    rows = t.events.select("key", "id", F.col("ts").cast("timestamp").alias("ts"), size.alias("size"), F.floor(F.bround("value") / 60).alias("mtime"), (F.col("event_type") == "error").alias("failed"))
    arrivals(t, rows, lambda s: s, stateful.skip_known_failures(t.spark, root))
    return t.spark.read.schema("key long, id long, decision string").parquet(f"{root}/decisions/batch=*")


@query("SELECT 'states' AS source, event_type AS name, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY 2 UNION ALL SELECT 'users', CAST(user_id % 10 AS VARCHAR), CAST(count(*) AS BIGINT) FROM events GROUP BY 2")
def stream_published(t: Tables) -> DataFrame:
    """Two derived tables that each batch publishes together, summed over the batches in the ledger."""
    root = fresh_path(t.spark, "published")
    drop_at_exit(t.spark, root)
    counted = lambda name, source: lambda b: b.groupBy(name.alias("name")).agg(F.count("*").alias("n")).select(F.lit(source).alias("source"), "name", "n")
    derive = {"states": counted(F.col("event_type"), "states"), "users": counted((F.col("key") % 10).cast("string"), "users")}
    arrivals(t, t.events.select("key", "id", F.col("ts").cast("timestamp").alias("ts"), "event_type"), lambda s: s, stateful.publishing(root, derive))
    both = [stateful.published(t.spark, root, name, "source string, name string, n long") for name in derive]
    return both[0].unionByName(both[1]).groupBy("source", "name").agg(F.sum("n").alias("n"))
