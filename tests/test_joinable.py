"""Large tables are merged, whatever the bytes of their files; small ones are left to Spark."""

import pytest

from tonearm import storage
from tonearm.tables import Tables

SF = "/root/testdata/sf0.001"
plan = lambda df: df._jdf.queryExecution().executedPlan().toString()


def test_what_comes_of_a_large_table_is_not_broadcast(spark, monkeypatch):
    monkeypatch.setattr(storage, "SENT_ROWS", 100)
    other = spark.range(10_000).withColumnRenamed("id", "k")
    for rows, kind in ((101, "SortMergeJoin"), (100, "BroadcastHashJoin")):
        table = storage.joinable(storage.materialize(spark.range(rows).selectExpr("id AS k", "1 AS v"), "rows"))
        for side in (table, table.where("k > 3").select("k").distinct(), table.selectExpr("k", "explode(array(1, 2)) AS x")):
            for how in ("inner", "left_semi", "left_anti"):
                assert kind in plan(other.join(side, "k", how))
                assert other.join(side, "k", how).count() == other.join(side.hint("merge"), "k", how).count()


@pytest.mark.parametrize("least", [0, 10**9])
def test_stored_playlists(spark, monkeypatch, least):
    from tonearm.plans.reading import active_track_ids

    monkeypatch.setattr(storage, "SENT_ROWS", least)
    found = active_track_ids(Tables(spark, SF))
    assert ("Broadcast" in plan(found)) == (least > 0) and found.count() > 50


def test_suggestions_send_no_large_table(spark, monkeypatch):
    """No barred pair, member or class goes through the driver where they are many; the rows stay the same."""
    from tonearm.operators import first_pairs as P

    seen = []
    members = [(0, 0, i, f"c{i % 3}", i % 40) for i in range(80)] + [(1, 100, 100 + i, None, 100 + i) for i in range(80)]
    classes = [(0, 0, 0, 1.0), (100, 100, 1, 0.95)]
    known, final = [(i, i + 1) for i in range(60)], [(100, 101 + i) for i in range(40)]
    for sent in (10**9, 1):
        monkeypatch.setattr(storage, "SENT_ROWS", sent)
        frame = lambda rows, schema: storage.joinable(storage.materialize(spark.createDataFrame(rows, schema), "rows"))
        got = P.first_pairs(frame(members, "bucket long, class long, id long, code string, component long"), frame(classes, "a_class long, b_class long, bucket long, score double"), frame(known, "a long, b long"), frame(final, "lower_id long, higher_id long"), 5)
        anti = [x for x in plan(got).splitlines() if "LeftAnti" in x]
        assert anti and all(("BroadcastHashJoin" in x) == (sent > 1) for x in anti)
        seen.append(sorted(map(tuple, got.collect())))
    assert seen[0] == seen[1] and len(seen[0]) == 10
