"""Connected components of an undirected edge table, by min-label hooking and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonearm.storage import joinable, shared_dir


#: Tasks that the nodes of one label are spread over.
SALTS = 16


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """Rows ``(node, component)`` for every node of ``edges``; a component is named by its smallest node.

    Null ends and self loops are ignored; repeated edges change nothing; no edge gives no row. Each round a node takes
    the smallest label among its own and its neighbours' (an aggregation with map-side combine, so a node with
    very many edges is no hot task), then the label of its label. Rounds are checkpointed in the shared folder; labels halve
    their distance to the root each round, so long chains take a logarithmic number of rounds.
    """
    shared_dir(edges.sparkSession)
    pairs = edges.select(F.col(a).alias("x"), F.col(b).alias("y")).where("x IS NOT NULL AND y IS NOT NULL AND x <> y")
    both = joinable(pairs.union(pairs.select("y", "x")).distinct().checkpoint())
    labels = both.groupBy("x").agg(F.min("y").alias("m")).select(F.col("x").alias("node"), F.least("x", "m").alias("component")).checkpoint()
    nodes = labels.count()
    labels = joinable(labels, nodes)
    for _ in range(max_rounds):
        near = both.join(labels.withColumnRenamed("node", "y"), "y").groupBy("x").agg(F.min("component").alias("m"))
        hooked = labels.join(near.withColumnRenamed("x", "node"), "node").select("node", "component", F.least("component", "m").alias("low"))
        # The old root hears of the smaller label too, so a whole tree moves at once.
        told = hooked.where("low < component").groupBy(F.col("component").alias("node")).agg(F.min("low").alias("told"))
        merged = hooked.join(told, "node", "left").select("node", F.col("component").alias("before"), F.least("low", F.coalesce("told", "low")).alias("low"))
        # Very many nodes may share a label: they are salted, and the labels that moved are copied to each salt. Label and salt are hashed
        # into one long, whose hash tables are small, and labels are compared in full beside it.
        spread = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
        roots = merged.where("low < node").select(F.col("node").alias("label"), F.col("low").alias("root"), spread).select("label", "root", F.xxhash64("label", "salt").alias("key"))
        asked = merged.select("*", F.xxhash64("low", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int")).alias("key"))
        same = (asked["key"] == roots["key"]) & (asked["low"] >= roots["label"]) & (asked["low"] <= roots["label"])
        after = asked.join(roots, same, "left").select("node", "before", F.least("low", F.coalesce("root", "low")).alias("component")).checkpoint()
        moved = after.where("component <> before").limit(1).count()
        labels = joinable(after.select("node", "component"), nodes)
        if not moved:
            return labels
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
