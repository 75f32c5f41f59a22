"""Views, paging and row picking over fixed-schema tables."""

from __future__ import annotations

import base64
import json
from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def one_or_none(df: DataFrame, condition: Column):
    """The only row that meets ``condition``, or None; more than one is an error."""
    found = df.where(condition).limit(2).collect()
    if len(found) > 1:
        raise ValueError("more than one row")
    return found[0] if found else None


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per key, the first in ``order``; Spark prunes to it before the shuffle."""
    return top_per_key(df, keys, order, 1)


def top_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    return df.withColumn("__n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("__n") <= n).drop("__n")


def earliest(df: DataFrame, keys: Sequence[str], id_col: str = "id") -> DataFrame:
    """Smallest id per key, by a partial aggregation."""
    return df.groupBy(*keys).agg(F.min(id_col).alias(id_col))


def library_rows(local: DataFrame, final: DataFrame, tracks: DataFrame, suggested: DataFrame) -> DataFrame:
    """The star view: each local track with its link, linked track, earliest pending proposal, proposed track and derived status."""
    named = lambda p: tracks.select(F.col("id").alias(f"{p}_track"), F.col("title").alias(f"{p}_title"), F.col("artist").alias(f"{p}_artist"))
    links = final.select(F.col("local_id").alias("id"), F.col("id").alias("final_id"), F.col("track_id").alias("f_track"))
    pending = suggested.where(F.col("status") == "pending").groupBy("local_id").agg(F.min_by(F.struct("id", "track_id", "score"), "id").alias("p")).select(F.col("local_id").alias("id"), F.col("p.id").alias("pending_id"), F.col("p.track_id").alias("p_track"), F.col("p.score").alias("pending_score"))
    rows = local.select("id", "path").join(links, "id", "left").join(named("f"), "f_track", "left").join(pending, "id", "left").join(named("p"), "p_track", "left")
    status = F.when(F.col("final_id").isNotNull(), "linked").when(F.col("pending_id").isNotNull(), "pending").otherwise("unlinked")
    return rows.select("id", "path", F.coalesce("f_title", "p_title", "path", F.lit("")).alias("title"), F.coalesce("f_artist", "p_artist", F.lit("")).alias("artist"), status.alias("link_status"), "final_id", "pending_id", "pending_score")


def encode_cursor(**parts) -> str:
    """URL-safe base64 without padding over compact JSON with sorted keys."""
    return base64.urlsafe_b64encode(json.dumps(parts, sort_keys=True, separators=(",", ":")).encode()).decode().rstrip("=")


def decode_cursor(text: str, **must: object) -> dict:
    """The parts of a cursor; a broken one, or one made for another order, is a ValueError."""
    try:
        got = json.loads(base64.urlsafe_b64decode(text + "=" * (-len(text) % 4)))
        assert isinstance(got, dict)
    except Exception as e:
        raise ValueError("invalid cursor") from e
    if any(got.get(k) != v for k, v in must.items()):
        raise ValueError("the cursor belongs to another order")
    return got


def page(df: DataFrame, key: Column, id_col: str = "id", limit: int = 100, descending: bool = False, after: tuple | None = None) -> DataFrame:
    """A keyset page of ``limit + 1`` rows by ``key`` then ascending id; the extra row tells that there is a next page."""
    if after is not None:
        value, last = after
        past = key < F.lit(value) if descending else key > F.lit(value)
        df = df.where(past | ((key == F.lit(value)) & (F.col(id_col) > F.lit(last))))
    return df.orderBy(key.desc() if descending else key.asc(), F.col(id_col).asc()).limit(limit + 1)


def matches(df_columns: Sequence[str], needle: str, numeric: Sequence[str] = ()) -> Column:
    """Case-blind substring over any of the columns, wildcards live, and equality of ids if the needle is a number; blank matches all."""
    needle = needle.strip()
    if not needle:
        return F.lit(True)
    out = F.lit(False)
    for c in df_columns:
        out = out | F.coalesce(F.col(c).ilike(f"%{needle}%"), F.lit(False))
    for c in numeric if needle.isdecimal() else ():
        out = out | (F.col(c) == int(needle))
    return out


def literal_like(text: str) -> str:
    """``text`` with its wildcards escaped."""
    return text.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")


def facets(df: DataFrame, column: str) -> DataFrame:
    """Counts per value with a row ``all``."""
    return df.rollup(column).agg(F.count("*").alias("n"), F.grouping(column).alias("g")).select(F.when(F.col("g") == 1, "all").otherwise(F.col(column)).alias(column), "n")


def band(score: Column) -> Column:
    return F.when(score > 0.85, "high").when(score >= 0.5, "medium").otherwise("low")


def unpivot(df: DataFrame, id_col: str) -> DataFrame:
    """(id, key, value) of every other column, values as text: booleans in lower case, timestamps in ISO 8601."""
    kinds = dict(df.dtypes)
    shown = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss") if kinds[c].startswith("timestamp") else F.col(c).cast("string")
    pairs = F.array(*[F.struct(F.lit(c).alias("key"), shown(c).alias("value")) for c in df.columns if c != id_col])
    return df.select(id_col, F.explode(pairs).alias("x")).select(id_col, "x.key", "x.value")


def between_rows(df: DataFrame, order: list[Column], one: Column, other: Column) -> DataFrame:
    """The rows from ``one`` to ``other`` in ``order``, both included and either first; conditions that each meet one row. None if either row is missing."""
    from tonearm.operators.ranking import numbered

    rows = numbered(df, order, "__at")
    ends = rows.where(one | other).agg(F.min("__at").alias("a"), F.max("__at").alias("b"), F.max(one.cast("int")).alias("x"), F.max(other.cast("int")).alias("y")).first()
    if not (ends.x and ends.y):
        return df.limit(0)
    return rows.where(F.col("__at").between(ends.a, ends.b)).drop("__at")


def chunks(df: DataFrame, size: int) -> Iterator[list]:
    """Rows in lists of ``size``, in the table's order of partitions; the driver holds one partition at a time."""
    held = []
    for row in df.toLocalIterator(prefetchPartitions=True):
        held.append(row)
        if len(held) == size:
            yield held
            held = []
    if held:
        yield held
