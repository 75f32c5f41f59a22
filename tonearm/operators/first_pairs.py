"""The first pairs of each bucket that nothing suppresses, without making all pairs.

Members of one class are alike for the order, so the pairs of two classes differ in their ids alone, and only few members of a class can be in one of the
first pairs. Let (u, v) be among the first ``k``. Fewer than ``k`` smaller members of v's class go with u, as each makes an earlier pair. Those that do not go
with u share its code or component, have a component that is barred with u's, or are decided with u; of the members of one code and component no more than
``k`` and the decided ones need be kept, which bounds them too. Both sides are cut so, then all pairs that are left are looked at.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tonearm.operators.dealt_join import dealt_join
from tonearm.storage import joinable, materialize

#: Members of each class that a first look takes, which finds where a bucket's list ends at the latest. It changes no result.
GLANCE = 3


def _needed(members: DataFrame, known: DataFrame, final: DataFrame, k: int) -> DataFrame:
    """``members`` that can be in a first pair, with ``place`` in their class and ``reach``, the last place of a partner."""
    homes = members.select("bucket", "component").distinct()
    ways = known.where("a <> b").select(F.col("a").alias("x"), F.col("b").alias("component"))
    ways = ways.union(ways.select("component", "x"))
    at_x = homes.withColumnRenamed("component", "x")
    barred = ways.join(at_x, "x").join(homes, ["bucket", "component"], "left_semi").groupBy("bucket", F.col("x").alias("component")).agg(F.count("*").alias("barred"))
    end = lambda name: members.select(F.col("id").alias(f"{name}_id"), F.col("bucket").alias(f"{name}_bucket"), F.col("component").alias(f"{name}_c"))
    apart = final.join(end("lower"), "lower_id").join(end("higher"), "higher_id").where("lower_bucket = higher_bucket AND lower_c <> higher_c")
    apart = apart.withColumn("a", F.least("lower_c", "higher_c")).withColumn("b", F.greatest("lower_c", "higher_c")).join(known, ["a", "b"], "left_anti")
    decided = apart.select(F.explode(F.array("lower_id", "higher_id")).alias("id")).groupBy("id").agg(F.count("*").alias("decided"))
    x = members.join(barred, ["bucket", "component"], "left").join(decided, "id", "left").na.fill(0, ["barred", "decided"]).withColumn("same", F.coalesce("code", F.concat(F.lit("#"), F.col("id").cast("string"))))
    x = materialize(x, "pair-members")
    most_barred, most_decided = (n or 0 for n in x.agg(F.max("barred"), F.max("decided")).first())
    alike = k + most_decided
    of_code, of_component = alike + alike * (1 + most_barred), 2 * alike
    place = lambda *by: F.row_number().over(W.partitionBy("class", *by).orderBy("id"))
    x = x.withColumn("n", place("same", "component")).where(F.col("n") <= alike)
    x = x.withColumn("n_code", place("same")).withColumn("n_component", place("component")).where((F.col("n_code") <= of_code) & (F.col("n_component") <= of_component))
    reach = k + F.col("decided") + of_code + of_component * (1 + F.col("barred"))
    furthest = k + most_decided + of_code + of_component * (1 + most_barred)
    x = x.withColumn("place", place()).where(F.col("place") <= furthest)
    return joinable(materialize(x.select("class", "id", "code", "component", "place", reach.alias("reach")), "pair-needed"))


def first_pairs(members: DataFrame, classes: DataFrame, known: DataFrame, final: DataFrame, k: int) -> DataFrame:
    """(bucket, lower_id, higher_id, score, *rest): of each bucket the first ``k`` pairs by falling score, then ids.

    ``members``: bucket, class, id, code, component. ``classes``: each unordered pair of classes whose members make pairs once, as a_class, b_class, bucket, score
    and what else a row shall hold; a class is named by its smallest id. Two members make no pair if they share a code or a component, if ``known``
    (a <= b) bars their components, or ``final`` (lower_id, higher_id) holds them.
    """
    rest = [c for c in classes.columns if c not in ("a_class", "b_class")]
    needed = _needed(members, known, final, k)

    def free(at: DataFrame, some: DataFrame, within=F.lit(True)) -> DataFrame:
        side = lambda p, cols: at.select("a_class", "b_class", *cols).join(some.select(F.col("class").alias(f"{p}_class"), *[F.col(c).alias(f"{p}_{c}") for c in ("id", "code", "component", "place", "reach")]), f"{p}_class")
        met = dealt_join(side("a", [c for c in at.columns if c not in ("a_class", "b_class")]), side("b", []), ["a_class", "b_class"])
        met = met.where("(a_class <> b_class OR a_id < b_id) AND a_place <= b_reach AND b_place <= a_reach AND a_component <> b_component AND coalesce(a_code <> b_code, true)")
        met = met.withColumn("lower_id", F.least("a_id", "b_id")).withColumn("higher_id", F.greatest("a_id", "b_id")).where(within)
        met = met.select(*rest, "lower_id", "higher_id", F.least("a_component", "b_component").alias("a"), F.greatest("a_component", "b_component").alias("b"))
        order = F.row_number().over(W.partitionBy("bucket").orderBy(F.desc("score"), "lower_id", "higher_id"))
        left = met.join(known, ["a", "b"], "left_anti").join(final.select("lower_id", "higher_id"), ["lower_id", "higher_id"], "left_anti")
        return left.withColumn("n", order).where(F.col("n") <= k)

    # The last of k free pairs of a bucket, whichever they are, bounds its list: no later pair is in it.
    last = free(classes, needed.where(F.col("place") <= GLANCE)).where(F.col("n") == k).select("bucket", F.col("score").alias("s_last"), F.col("lower_id").alias("l_last"), F.col("higher_id").alias("h_last"))
    bound = classes.join(materialize(last, "pair-bounds"), "bucket", "left").where("s_last IS NULL OR score > s_last OR (score = s_last AND least(a_class, b_class) <= l_last)")
    early = F.expr("s_last IS NULL OR score > s_last OR lower_id < l_last OR (lower_id = l_last AND higher_id <= h_last)")
    return free(materialize(bound, "pair-classes"), needed, early).select("bucket", "lower_id", "higher_id", *[c for c in rest if c != "bucket"])
