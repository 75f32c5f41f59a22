"""Equality joins whose result is far larger than their inputs: dealt over tasks by pairs, not by bytes read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of one key that a cell takes from either side, and pairs and rows for each task. They change no result.
CELL, PAIRS, ROWS = 1000, 40_000_000, 500_000


def _tasks(made: int | None, sent: int | None, pairs: int) -> int:
    return max(8, -(-(made or 0) // pairs), -(-(sent or 0) // ROWS))


def _blocks(rows: str, cell: int) -> Column:
    return F.ceil(F.col(rows) / cell).cast("int")


def _own(of: list[str], blocks: str) -> Column:
    """A row's block among those of its key."""
    return F.pmod(F.xxhash64(*of), F.col(blocks)).cast("int")


def _met(one: DataFrame, cells: DataFrame, keys: list[str], n: int) -> DataFrame:
    """Each row of ``one`` with each element of the array ``__held`` of its cell. A cell comes as one row, so a pair costs a step of a loop and no row of a join.

    Merged, as Spark judges the cells by the files that they come from, and would send all their copies through the driver.
    """
    return one.repartition(n, *keys).join(cells.repartition(n, *keys).hint("merge"), keys)


def dealt_join(left: DataFrame, right: DataFrame, on: list[str], cell: int = CELL, pairs: int = PAIRS) -> DataFrame:
    """``left.join(right, on)``; the sides share no other column, and each is read twice. Null keys meet nothing.

    A join cuts its work by the bytes of its inputs, so a few rows that make very many pairs would stay in one task. Here the rows of a key are
    cut into blocks of about ``cell``, each pair of blocks is a key of its own, and the number of tasks follows the number of pairs. Rows are
    dealt by block before they are copied to the blocks that they meet, as a small table may come in one task.
    """
    sizes = left.groupBy(*on).agg(F.count("*").alias("__l")).join(right.groupBy(*on).agg(F.count("*").alias("__r")), on)
    cut = sizes.select(*on, _blocks("__l", cell).alias("__x"), _blocks("__r", cell).alias("__y"))
    made, sent = sizes.agg(F.sum(F.col("__l") * F.col("__r")), F.sum(F.col("__l") * _blocks("__r", cell) + F.col("__r") * _blocks("__l", cell))).first()
    n = _tasks(made, sent, pairs)
    whole = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    rest = [c for c in right.columns if c not in on]
    one = left.join(cut, on).withColumn("__i", _own(left.columns, "__x")).repartition(n, *on, "__i").select(*left.columns, "__i", whole("__y").alias("__j"))
    cells = right.join(cut, on).withColumn("__j", _own(right.columns, "__y")).groupBy(*on, "__j", "__x").agg(F.collect_list(F.struct(*rest)).alias("__held"))
    met = _met(one, cells.select(*on, "__j", "__held", whole("__x").alias("__i")), [*on, "__i", "__j"], n)
    return met.select(*on, *[c for c in left.columns if c not in on], F.inline("__held").alias(*rest))


def pairs_within(rows: DataFrame, on: list[str], cell: int = CELL, pairs: int = PAIRS) -> DataFrame:
    """(lower_id, higher_id): each two different ids of ``rows`` (id, *on) that are equal in ``on``, once; no other pair is made. ``rows`` is read twice. Null keys and ids meet nothing."""
    rows = rows.where("id IS NOT NULL").select(*on, "id")
    sizes = rows.groupBy(*on).agg(F.count("*").alias("__n")).where("__n > 1")
    blocks = _blocks("__n", cell)
    made, sent = sizes.agg(F.sum(F.col("__n") * (F.col("__n") - 1) / 2).cast("long"), F.sum(F.col("__n") * (blocks + 1))).first()
    n = _tasks(made, sent, pairs)
    dealt = rows.join(sizes.select(*on, blocks.alias("__x")), on).withColumn("__own", _own(["id"], "__x"))
    # Block i meets block j only where i <= j, so a pair of ids has one place.
    one = dealt.repartition(n, *on, "__own").select(*on, "id", F.col("__own").alias("__i"), F.explode(F.sequence(F.col("__own"), F.col("__x") - 1)).alias("__j"))
    cells = dealt.groupBy(*on, "__own").agg(F.collect_list("id").alias("__held")).select(*on, "__held", F.col("__own").alias("__j"), F.explode(F.sequence(F.lit(0), F.col("__own"))).alias("__i"))
    met = _met(one, cells, [*on, "__i", "__j"], n).select("id", "__i", "__j", F.explode("__held").alias("other")).where("__i < __j OR id < other")
    return met.select(F.least("id", "other").alias("lower_id"), F.greatest("id", "other").alias("higher_id"))
