"""Exact global row numbers without a single-task window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tonearm.storage import materialize


def numbered(df: DataFrame, order: list[Column], name: str = "number", parts: int | None = None) -> DataFrame:
    """``df`` with row numbers from 1 over the whole table in ``order``.

    Rows are dealt to ranges of the order by Spark's own sampling and written, since a second evaluation could sample other bounds; each
    range is numbered on its own, from where the ranges before it end: one small row a range passes through the driver.
    """
    spark = df.sparkSession
    n = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    # Rows that are equal in the order are told apart by a hash of all they hold, so very many of them fill several ranges.
    tie = F.xxhash64(*[c for c, kind in df.dtypes if "map<" not in kind and kind != "variant"])
    ranged = materialize(df.repartitionByRange(n, *order, tie).withColumn("__range", F.spark_partition_id()), "numbered")
    before, at = {}, 0
    for r in sorted(ranged.groupBy("__range").agg(F.count("*").alias("n")).collect()):
        before[r["__range"]], at = at, at + r.n
    offset = F.array(*[F.lit(before.get(k, 0)).cast("long") for k in range(max(before, default=0) + 1)])
    own = F.row_number().over(W.partitionBy("__range").orderBy(*order, tie))
    return ranged.withColumn(name, own + F.get(offset, F.col("__range"))).drop("__range")
