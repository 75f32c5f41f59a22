"""Intermediates, and global row numbers."""

import os

from pyspark.sql import functions as F

from tonearm import storage
from tonearm.operators.ranking import numbered


def test_materialize_goes_to_the_shared_folder(spark):
    df = spark.createDataFrame([(1, "a"), (2, None)], "id long, x string")
    out = storage.materialize(df, "case")
    path = out.inputFiles()[0].removeprefix("file:").split("/case-")[0]
    assert os.path.realpath(path.replace("//", "/")) == os.path.realpath(storage.shared_dir(spark).removeprefix("file:"))
    assert out.schema == df.schema and sorted(map(tuple, out.collect()), key=str) == sorted(map(tuple, df.collect()), key=str)
    where = out.inputFiles()[0].rsplit("/", 1)[0]
    storage.remove(spark, where)
    assert not os.path.exists(where.replace("file://", ""))


def test_numbered(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1009).alias("v"), (F.col("id") % 3).alias("k"))
    got = [(r.number, r.k, r.v) for r in numbered(df, [F.col("k").desc(), F.col("v")]).orderBy("number").collect()]
    want = sorted(((r.k, r.v) for r in df.collect()), key=lambda x: (-x[0], x[1]))
    assert got == [(i, *x) for i, x in enumerate(want, 1)]
    assert numbered(df.limit(0), [F.col("v")]).count() == 0
