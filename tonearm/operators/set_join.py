"""Joins of sets by Jaccard similarity, with prefix, size and place filters.

Tokens are ranked by rarity over both sides. Two sets of similarity ``t`` share a token among the first ``n - ceil(t n) + 1`` of either, so only these
prefixes meet, in an equality join; the commonest tokens stand at the ends of the sets and do not take part while any rarer one can. Pairs whose sizes, or whose places of the common token, leave room for too small an overlap
go before they are compared in full.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Keeps rounding from shortening a prefix.
SLACK = 1e-9


def _prefix(n: Column, threshold: float) -> Column:
    return n - F.greatest(F.ceil(n * threshold - SLACK), F.lit(1)) + 1


def candidates(left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """Distinct (a, b) that may reach ``threshold``: ``left`` has (a, tokens), ``right`` (b, tokens), keys distinct and tokens distinct within a set. None that reaches it is missing."""
    one = left.select("a", F.size("tokens").alias("a_n"), F.explode("tokens").alias("token"))
    other = right.select("b", F.size("tokens").alias("b_n"), F.explode("tokens").alias("token"))
    often = one.select("token").union(other.select("token")).groupBy("token").agg(F.count("*").alias("often"))

    def prefixes(rows: DataFrame, key: str) -> DataFrame:
        place = F.row_number().over(W.partitionBy(key).orderBy("often", "token"))
        return rows.join(often, "token").withColumn(f"{key}_at", place).where(F.col(f"{key}_at") <= _prefix(F.col(f"{key}_n"), threshold)).drop("often")

    met = prefixes(one, "a").join(prefixes(other, "b"), "token")
    sizes = F.least("a_n", "b_n") >= F.greatest("a_n", "b_n") * threshold - SLACK
    # With the pair's first common token at these places no more than the rest of either set can follow.
    room = 1 + F.least(F.col("a_n") - F.col("a_at"), F.col("b_n") - F.col("b_at"))
    fits = room >= (F.col("a_n") + F.col("b_n")) * (threshold / (1 + threshold)) - SLACK
    return met.where(sizes & fits).select("a", "b").distinct()


def similar_sets(left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """(a, b, sim) of all pairs whose sets have a similarity of at least ``threshold``, and share a token. Empty and null sets are in no pair."""
    one, other = (d.where(F.size("tokens") > 0) for d in (left, right))
    pairs = candidates(one, other, threshold).join(one.withColumnRenamed("tokens", "a_tokens"), "a").join(other.withColumnRenamed("tokens", "b_tokens"), "b")
    both = F.size(F.array_intersect("a_tokens", "b_tokens"))
    return pairs.select("a", "b", (both / (F.size("a_tokens") + F.size("b_tokens") - both)).alias("sim")).where((F.col("sim") >= threshold) & (F.col("sim") > 0))
