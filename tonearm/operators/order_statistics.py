"""Exact order statistics by histograms that narrow a bracket around each wanted rank: no sort of all values, no copy of them.

A pass counts the values of each bracket in buckets of equal width, within tasks before the shuffle; the bucket that holds the rank becomes the next bracket, from its least to its
largest value. Both ends of a bracket are values of it and fall into different buckets, so each pass leaves fewer. Brackets of few values, or of one, however
often it occurs, are settled by counting their different values.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tonearm.storage import materialize

#: Values of a bracket that are looked at one by one, and buckets of a pass.
FEW, BUCKETS = 10_000, 1024


def order_statistics(rows: DataFrame, ranks: dict[str, Callable[[Column], Column]], few: int = FEW, buckets: int = BUCKETS) -> DataFrame:
    """(pos, n, low, high, and a column for each of ``ranks``) of the finite values x of each pos; a rank is a whole number from 0, out of the count n. Nulls are left out."""
    values = rows.select("pos", "x").where("x IS NOT NULL AND NOT isnan(x)")
    if (values.groupBy("pos").count().agg(F.max("count")).first()[0] or 0) <= few:
        return _counted(values, ranks)
    of = values.groupBy("pos").agg(F.count("*").alias("n"), F.min("x").alias("low"), F.max("x").alias("high"))
    zero = F.lit(0).cast("long")
    wanted = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), rank(F.col("n")).cast("long").alias("rank")) for k, rank in ranks.items()])).alias("w")
    asked = of.select("pos", "n", "low", "high", wanted).select("pos", "w.k", "w.rank", zero.alias("below"), F.col("low").alias("lo"), F.col("high").alias("hi"), F.col("n").alias("held"))
    open_ = (F.col("held") > few) & (F.col("lo") < F.col("hi"))
    asked = materialize(asked, "ranks")
    while not (wide := asked.where(open_)).isEmpty():
        bucket = F.least(F.floor((F.col("x") - F.col("lo")) / (F.col("hi") - F.col("lo")) * buckets), F.lit(buckets - 1))
        inside = values.join(wide, "pos").where("x BETWEEN lo AND hi")
        counts = inside.groupBy("pos", "k", "rank", "below", bucket.alias("bucket")).agg(F.count("*").alias("held"), F.min("x").alias("lo"), F.max("x").alias("hi"))
        upto = F.sum("held").over(W.partitionBy("pos", "k").orderBy("bucket"))
        first = counts.withColumn("upto", F.col("below") + upto).where((F.col("upto") > F.col("rank")) & (F.col("upto") - F.col("held") <= F.col("rank")))
        asked = materialize(asked.where(~open_).unionByName(first.select("pos", "k", "rank", (F.col("upto") - F.col("held")).alias("below"), "lo", "hi", "held")), "ranks")
    # Equal values are one row each, however many they are.
    inside = values.join(asked, "pos").where("x BETWEEN lo AND hi").groupBy("pos", "k", "rank", "below", "x").agg(F.count("*").alias("c"))
    upto = F.col("below") + F.sum("c").over(W.partitionBy("pos", "k").orderBy("x"))
    found = inside.withColumn("upto", upto).where((F.col("upto") > F.col("rank")) & (F.col("upto") - F.col("c") <= F.col("rank")))
    wide = found.groupBy("pos").agg(*[F.max(F.when(F.col("k") == k, F.col("x"))).alias(k) for k in ranks])
    return of.join(wide, "pos")


def _counted(values: DataFrame, ranks: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """All ranks out of the counts of different values, where no pos has many."""
    each = W.partitionBy("pos")
    counts = values.groupBy("pos", "x").agg(F.count("*").alias("c")).withColumns({"upto": F.sum("c").over(each.orderBy("x")), "n": F.sum("c").over(each)})
    at = lambda rank: F.max(F.when((F.col("upto") > rank) & (F.col("upto") - F.col("c") <= rank), F.col("x")))
    return counts.groupBy("pos").agg(F.max("n").alias("n"), F.min("x").alias("low"), F.max("x").alias("high"), *[at(rank(F.col("n")).cast("long")).alias(k) for k, rank in ranks.items()])
