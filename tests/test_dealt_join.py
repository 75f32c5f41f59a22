"""Joins dealt by pairs: the same rows as a plain join, and no task with most of them."""

from pyspark.sql import functions as F

from tonearm.operators.dealt_join import dealt_join
from tonearm.plans import entities


def test_same_rows_in_many_tasks(spark):
    left = spark.createDataFrame([("hot", i) for i in range(900)] + [("cold", 1000), (None, 1001), ("left", 1002)], "k string, a long")
    right = spark.createDataFrame([("hot", i) for i in range(400)] + [("cold", 1000), ("cold", 1000), (None, 1001), ("right", 1)], "k string, b long")
    got = dealt_join(left, right, ["k"], cell=100, pairs=20_000)
    want = left.join(right, "k")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    shares = [r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()]
    assert max(shares) < sum(shares) / 3
    assert dealt_join(left.where("a < 0"), right, ["k"]).count() == 0


def test_blocked_pairs_of_one_class_are_spread(spark):
    class Rows:
        tracks = spark.createDataFrame([(i, "Same", "One Artist") for i in range(4000)], "id long, title string, artist string")

    found = entities.blocked_pairs(Rows())
    shares = [r["count"] for r in found.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(shares) == 4000 * 3999 // 2 and max(shares) < sum(shares) / 2


def test_band_pairs_come_once_and_spread(spark):
    """Each pair once without a look for repeats, from many tasks even where all rows share one number."""
    from tonearm.operators import entity as E

    rows = [(i, v) for i, v in enumerate([0, 1, 4, 5, 6, 9, 10, 10, 11, -1, -5, None])]
    got = sorted((r.lower_id, r.higher_id) for r in E.band_pairs(spark.createDataFrame(rows, "id long, v long"), "v", 5).collect())
    assert got == [(a, b) for a, v in rows for b, w in rows if a < b and v is not None and w is not None and abs(v - w) <= 5]
    same = E.band_pairs(spark.range(3000).withColumn("v", F.lit(7)), "v", 5)
    shares = [r["count"] for r in same.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(shares) == 3000 * 2999 // 2 and max(shares) < sum(shares) / 2
    assert "delta" not in "".join(x for x in same._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange" in x)


def test_fuzzy_pairs_of_one_title_are_spread(spark):
    from tonearm.operators import entity as E

    tracks = spark.range(3000).selectExpr("id", "'Same' AS title", "'One Artist' AS artist", "CAST(NULL AS STRING) AS album", "CAST(1000 AS BIGINT) AS duration_ms", "CAST(NULL AS STRING) AS isrc")
    shares = [r["count"] for r in E.fuzzy_pairs(tracks).groupBy(F.spark_partition_id()).count().collect()]
    assert sum(shares) == 3000 * 2999 // 2 and max(shares) < sum(shares) / 2


def _joined(plan) -> int:
    """Rows that the joins of a plan that has run made."""
    name = plan.nodeName()
    if name == "AdaptiveSparkPlan":
        return _joined(plan.executedPlan())
    if "QueryStage" in name:
        return _joined(plan.plan())
    below = plan.children()
    return (plan.metrics().apply("numOutputRows").value() if "Join" in name else 0) + sum(_joined(below.apply(i)) for i in range(below.size()))


def test_pairs_within_classes(spark):
    from tonearm.operators.dealt_join import pairs_within

    rows = [(i, "hot", i % 2) for i in range(120)] + [(200 + i, "cold", 0) for i in range(3)] + [(300, "alone", 0), (301, None, 0), (302, None, 0), (None, "hot", 0)]
    df = spark.createDataFrame(rows, "id long, k string, b int")
    got = sorted(map(tuple, pairs_within(df, ["k", "b"], cell=7, pairs=500).collect()))
    assert got == sorted((a[0], b[0]) for a in rows for b in rows if None not in (a[0], b[0], a[1]) and a[0] < b[0] and a[1:] == b[1:])
    assert pairs_within(df.where("id > 299"), ["k", "b"]).count() == 0


def test_blocked_pairs_joins_make_no_pairs(spark):
    """Joins match rows with cells; their rows grow with the rows times the cells, not with the pairs."""

    class Rows:
        tracks = spark.createDataFrame([(i, "Same", "One Artist") for i in range(2500)], "id long, title string, artist string")

    run = entities.blocked_pairs(Rows())._jdf.queryExecution()
    assert run.toRdd().count() == 2500 * 2499 // 2
    assert _joined(run.executedPlan()) < 2500 * 10
