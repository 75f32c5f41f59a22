"""Streams with state against their batch forms, for several splits into micro-batches, with failures and repeats."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tonearm.streaming import folds, stateful, streams

START = datetime(2024, 1, 1)


def at(seconds):
    return START + timedelta(seconds=seconds)


def arrived(spark, tmp_path, rows, kinds, splits, make, each, mode="append"):
    """Lands ``rows`` in the given splits, running the stream after each."""
    schema = spark.createDataFrame([], kinds).schema
    land = str(tmp_path / "land")
    for a, b in zip([0, *splits], [*splits, len(rows)]):
        if a == b:
            continue
        spark.createDataFrame(rows[a:b], schema).write.mode("append").parquet(land)
        streams.drained(make(spark.readStream.schema(schema).parquet(land)), mode, str(tmp_path / "log"), each)


def beside(path):
    return lambda batch, number: batch.write.mode("overwrite").parquet(f"{path}/batch={number:06d}")


def look_rows():
    rng = random.Random(3)
    rows, size = [], {}
    for k in range(300):
        key = rng.randrange(5)
        if rng.random() < 0.08:
            size[key] = rng.choice([0, 1, 2])
        rows.append((key, k, at(k), size.get(key, 1), int(rng.random() < 0.02)))
    return rows


@pytest.mark.parametrize("splits", [[], [150], [7, 8, 100, 299]])
def test_stable_runs(spark, tmp_path, splits):
    rows = look_rows()
    kinds = "key long, id long, ts timestamp, size long, mtime long"
    arrived(spark, tmp_path, rows, kinds, splits, stateful.debounced, beside(tmp_path / "out"))
    got = {tuple(r) for r in spark.read.parquet(str(tmp_path / "out" / "batch=*")).collect()}
    assert got == {tuple(r) for r in folds.stable_runs(spark.createDataFrame(rows, kinds)).collect()} and len(got) > 3


def test_ten_looks_and_no_fewer(spark, tmp_path):
    """Nine equal looks say nothing, the tenth lets the file through, further ones add nothing; an empty file never comes through."""
    rows = [("a", k, at(k), 5, 1) for k in range(9)] + [("b", 20 + k, at(20 + k), 5, 1) for k in range(14)] + [("c", 40 + k, at(40 + k), 0, 1) for k in range(12)]
    arrived(spark, tmp_path, rows, "key string, id long, ts timestamp, size long, mtime long", [9, 15, 30], stateful.debounced, beside(tmp_path / "out"))
    assert [tuple(r) for r in spark.read.parquet(str(tmp_path / "out" / "batch=*")).collect()] == [("b", at(20), at(29), 5)]


def plain_answers(rows, ttl, rest):
    out, state = {}, {}
    for key, i, ts, ends in rows:
        held, ended = state.get(key, (None, None))
        live = held is not None and ts < held + timedelta(seconds=ttl)
        if ends:
            state[key] = (None, ts if live else ended)
        elif live:
            out[i] = "in_flight"
        elif ended is not None and ts <= ended + timedelta(seconds=rest):
            out[i] = "recent"
        else:
            out[i] = "accepted"
            state[key] = (ts, ended)
    return out


@pytest.mark.parametrize("splits", [[], [200], [1, 50, 51, 300]])
def test_claims(spark, tmp_path, splits):
    rng = random.Random(8)
    rows = [(rng.randrange(6), k, at(10 * k + rng.randrange(9)), rng.random() < 0.2) for k in range(400)]
    arrived(spark, tmp_path, rows, "key long, id long, ts timestamp, ends boolean", splits, lambda s: stateful.claimed(s, 300, 30), beside(tmp_path / "out"))
    got = {r.id: r.answer for r in spark.read.parquet(str(tmp_path / "out" / "batch=*")).collect()}
    assert got == plain_answers(rows, 300, 30) and set(got.values()) == {"accepted", "in_flight", "recent"}


def test_claims_without_ends_are_the_batch_form(spark, tmp_path):
    """Without ends the accepted requests are those of the fold with a time to live: none within it of the last one let through."""
    rng = random.Random(9)
    rows = [(rng.randrange(4), k, at(7 * k), False) for k in range(200)]
    kinds = "key long, id long, ts timestamp, ends boolean"
    arrived(spark, tmp_path, rows, kinds, [90], lambda s: stateful.claimed(s, 60, 30), beside(tmp_path / "out"))
    got = {r.id for r in spark.read.parquet(str(tmp_path / "out" / "batch=*")).where("answer = 'accepted'").collect()}
    assert got == {r.id for r in folds.first_in_window(spark.createDataFrame(rows, kinds), 60).collect()}


def test_a_released_claim_is_free_at_once(spark, tmp_path):
    """An end clears the key, and once the rest is over the same key is accepted again, long before the claim's own time is up."""
    rows = [(1, 1, at(0), False), (1, 2, at(5), False), (1, 3, at(6), True), (1, 4, at(36), False), (1, 5, at(37), False)]
    arrived(spark, tmp_path, rows, "key long, id long, ts timestamp, ends boolean", [2, 3], lambda s: stateful.claimed(s, 21_600, 30), beside(tmp_path / "out"))
    assert {r.id: r.answer for r in spark.read.parquet(str(tmp_path / "out" / "batch=*")).collect()} == {1: "accepted", 2: "in_flight", 4: "recent", 5: "accepted"}


@pytest.mark.parametrize("buckets", [1, 7])
def test_claims_of_keys_that_share_a_bucket(spark, tmp_path, buckets):
    """Keys of one bucket keep to themselves, the null key and very large ones too, and those that expired make room."""
    rng = random.Random(10)
    keys = [None, 2**60 + 1, 2**60 + 2, 3, 4]
    rows = [(rng.choice(keys), k, at(10 * k), rng.random() < 0.2) for k in range(200)]
    arrived(spark, tmp_path, rows, "key long, id long, ts timestamp, ends boolean", [40, 90], lambda s: stateful.claimed(s, 120, 30, buckets=buckets), beside(tmp_path / "out"))
    got = [(r.key, r.id, r.answer) for r in spark.read.schema("key long, id long, answer string").parquet(str(tmp_path / "out" / "batch=*")).collect()]
    want = plain_answers(rows, 120, 30)
    assert sorted(got, key=lambda x: x[1]) == [(k, i, want[i]) for k, i, _, ends in rows if not ends]


def plain_decisions(rows):
    out, failure = {}, {}
    for key, i, _, size, mtime, failed in rows:
        if failed:
            failure[key] = (size, mtime)
        elif size is None or mtime is None or key not in failure:
            out[i] = "enqueue"
        elif None in failure[key]:
            failure[key] = (size, mtime)
            out[i] = "skip"
        elif failure[key] == (size, mtime):
            out[i] = "skip"
        else:
            del failure[key]
            out[i] = "retry"
    return out


SIGHT = "key long, id long, ts timestamp, size long, mtime long, failed boolean"


def sightings():
    rng = random.Random(4)
    return [(rng.randrange(6), k, at(k), rng.choice([1, 1, 2, None]), rng.choice([0, 0, 1]), rng.random() < 0.25) for k in range(300)]


@pytest.mark.parametrize("splits", [[], [120], [3, 4, 5, 200]])
def test_known_failures_are_skipped(spark, tmp_path, splits):
    rows, root = sightings(), str(tmp_path / "skips")
    arrived(spark, tmp_path, rows, SIGHT, splits, lambda s: s, stateful.skip_known_failures(spark, root))
    got = {r.id: r.decision for r in spark.read.parquet(f"{root}/decisions/batch=*").collect()}
    assert got == plain_decisions(rows) and set(got.values()) == {"skip", "retry", "enqueue"}


def test_a_batch_of_sightings_that_runs_again(spark, tmp_path):
    rows, root = sightings(), str(tmp_path / "skips")
    each = stateful.skip_known_failures(spark, root)
    parts = [spark.createDataFrame(r, SIGHT) for r in (rows[:100], rows[100:180], rows[180:])]
    for number in (0, 0, 1, 1, 2, 2):
        each(parts[number], number)
    assert {r.id: r.decision for r in spark.read.parquet(f"{root}/decisions/batch=*").collect()} == plain_decisions(rows)


def test_a_batch_that_fails_between_two_tables(spark, tmp_path):
    """Nothing of it is seen until it has run again; then it is what one run would have given, and running once more changes nothing."""
    root, calls = str(tmp_path / "tables"), []

    def second(batch):
        calls.append(1)
        if len(calls) == 2:
            raise RuntimeError("lost")
        return batch.groupBy().agg(F.sum("n").alias("n"))

    derive = {"one": lambda b: b.select("n"), "two": second}
    each = stateful.publishing(root, derive)
    batch = lambda k: spark.createDataFrame([(k,), (10 * k,)], "n long")
    seen = lambda: [sorted((r.batch, r.n) for r in stateful.published(spark, root, t, "n long").collect()) for t in derive]
    assert seen() == [[], []]
    each(batch(1), 0)
    first = [[(0, 1), (0, 10)], [(0, 11)]]
    assert seen() == first
    with pytest.raises(RuntimeError):
        each(batch(2), 1)
    assert seen() == first and stateful.entered(spark, root) == {0}
    each(batch(2), 1)
    whole = [[(0, 1), (0, 10), (1, 2), (1, 20)], [(0, 11), (1, 22)]]
    assert seen() == whole
    each(batch(7), 1)
    assert seen() == whole


def test_attempts_and_results(spark, tmp_path):
    """A result in time, one too late, one without an attempt, an attempt without a result."""
    kinds = "job long, id long, ts timestamp, part long"
    rows = [(1, 10, at(0), 0), (2, 20, at(1), 0), (3, 30, at(2), 0), (1, 11, at(50), 3), (9, 91, at(60), 3), (2, 21, at(200), 3), (-1, -1, at(9000), 0), (-1, -1, at(9000), 3)]
    make = lambda s: stateful.attempt_outcomes(s.where("part = 0").select("job", "id", "ts"), s.where("part = 3").select("job", "id", "ts"), "100 seconds")
    arrived(spark, tmp_path, rows, kinds, [4, 6], make, beside(tmp_path / "out"))
    got = {tuple(r) for r in spark.read.parquet(str(tmp_path / "out" / "batch=*")).where("job > 0").collect()}
    assert got == {(1, 10, 11, "accepted"), (2, 20, None, "reclaimed"), (2, None, 21, "stale"), (3, 30, None, "reclaimed"), (9, None, 91, "stale")}
