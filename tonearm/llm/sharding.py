"""Sharding by sampled splitters, in DataFrame functions only.

Records are ordered by the hash of their text, then by id, then by place, so equal texts stand together. A size-weighted sample of
those keys gives quantile boundaries; records are dealt to the ranges between them; ranges that came out overfull are
subdivided by a second, denser sample of their own. Bytes and rows are then counted per range (one small row each), which
places every record on one exact byte line, and the line is cut into shards of equal length.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tonearm.storage import materialize


Key = tuple[int, int, int]


def _range_of(bounds: list[Key], h: Column, i: Column, p: Column) -> Column:
    """How many of the sorted ``bounds`` are at most ``(h, i, p)``: a binary search over a constant array."""
    if not bounds:
        return F.lit(0)
    table = F.array(*[F.struct(F.lit(a).alias("h"), F.lit(b).alias("i"), F.lit(c).alias("p")) for a, b, c in bounds])
    steps, step = [], 1 << (len(bounds).bit_length() - 1)
    while step:
        steps.append(step)
        step >>= 1

    def down(at: Column, by: Column) -> Column:
        b = F.get(table, at + by - 1)
        before = (b["h"] < h) | ((b["h"] == h) & ((b["i"] < i) | ((b["i"] == i) & (b["p"] <= p))))
        return at + F.when(before, by).otherwise(0)

    return F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), down)


def _draw(rows: DataFrame, share: float, seed: int) -> list[Key]:
    """A size-weighted sample of keys: a record is drawn with a chance of ``size * share``."""
    chance = F.pmod(F.xxhash64("h", "i", "p", F.lit(seed)), F.lit(1 << 40)) / F.lit(float(1 << 40))
    return sorted((r.h, r.i, r.p) for r in rows.where(chance < F.col("size") * share).select("h", "i", "p").collect())


def _quantiles(sample: list[Key], parts: int) -> list[Key]:
    """At most ``parts - 1`` sorted boundaries; a text's hash that fills several parts is cut by id and place, any other stays whole."""
    picked = [sample[len(sample) * k // parts] for k in range(1, parts)] if sample else []
    seen = Counter(h for h, _, _ in picked)
    return sorted({(h, i, p) if seen[h] > 1 else (h, -(1 << 63), 0) for h, i, p in picked})


def shard_by_bytes(docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text", ranges_per_shard: int = 8, rows_per_range: int = 2_000_000, sample_per_range: int = 20, whole_share: float = 0.01, overhead: int = 8) -> DataFrame:
    """One row per row of ``docs``: ``(id, size, text_crc32, shard, slot)``; the ``bytes`` law.

    ``size`` is the UTF-8 length of the text (null: none) plus ``overhead``. Shards differ in bytes by no more than the records or groups of
    equal texts at their edges: a group that takes under ``whole_share`` of a shard stays whole, a larger one may be
    cut anywhere, even between rows that are equal in all columns. ``slot`` numbers the rows of a shard from 0 without gaps. Null ids sort first; repeated rows each get a
    place; an empty table gives no rows; other columns are not read. There are ``ranges_per_shard`` ranges a shard, and more where that would be over
    ``rows_per_range`` rows; the driver holds about ``sample_per_range`` keys of each, twice.
    """
    order = F.coalesce(F.xxhash64(id_col), F.lit(0)) if dict(docs.dtypes)[id_col] not in ("bigint", "int", "smallint", "tinyint") else F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63)))
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = materialize(docs.select(F.col(id_col).alias("id"), order.alias("i"), F.monotonically_increasing_id().alias("p"), (F.octet_length(text) + overhead).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("crc"), F.xxhash64(text).alias("h")), "shard-keys")
    total, count = rows.agg(F.sum("size"), F.count("*")).first()
    total = total or 0
    parts = max(shards * ranges_per_shard, -(-count // rows_per_range))
    bounds = _quantiles(_draw(rows, parts * sample_per_range / max(total, 1), 1), parts)
    ranged = rows.withColumn("r", _range_of(bounds, F.col("h"), F.col("i"), F.col("p")))
    full = [r.r for r in ranged.groupBy("r").agg(F.sum("size").alias("b")).where(F.col("b") > 2 * total / parts).collect()]
    if full:
        more = _draw(ranged.where(F.col("r").isin(full)), parts * sample_per_range / max(total, 1) * 4, 2)
        bounds = sorted({*bounds, *_quantiles(more, max(2, len(more) // sample_per_range))})
        ranged = rows.withColumn("r", _range_of(bounds, F.col("h"), F.col("i"), F.col("p")))
    begin, at_bytes, at_rows = {}, 0, 0
    for r in sorted(ranged.groupBy("r").agg(F.sum("size").alias("b"), F.count("*").alias("n")).collect()):
        begin[r.r] = (at_bytes, at_rows)
        at_bytes, at_rows = at_bytes + r.b, at_rows + r.n
    offsets = F.array(*[F.struct(F.lit(begin.get(k, (0, 0))[0]).cast("long").alias("b"), F.lit(begin.get(k, (0, 0))[1]).cast("long").alias("n")) for k in range(len(bounds) + 1)])
    line = W.partitionBy("r").orderBy("h", "i", "p")
    group = W.partitionBy("r", "h")
    placed = (
        ranged.withColumn("rank", F.get(offsets, F.col("r"))["n"] + F.row_number().over(line) - 1)
        .withColumn("end", F.get(offsets, F.col("r"))["b"] + F.sum("size").over(line.rowsBetween(W.unboundedPreceding, 0)))
        .withColumn("middle", F.when(F.sum("size").over(group) * shards < total * whole_share, F.max("end").over(group) - F.sum("size").over(group) / 2).otherwise(F.col("end") - F.col("size") / 2))
        .withColumn("shard", F.least(F.floor(F.col("middle") * shards / F.lit(float(max(total, 1)))), F.lit(shards - 1)).cast("int"))
        .select("id", "size", "crc", "shard", "rank")
    )
    placed = materialize(placed, "shard-placed")
    first = {r.shard: r.f for r in placed.groupBy("shard").agg(F.min("rank").alias("f")).collect()}
    start = F.array(*[F.lit(first.get(k, 0)).cast("long") for k in range(shards)])
    return placed.select(F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), "shard", (F.col("rank") - F.get(start, F.col("shard"))).alias("slot"))
