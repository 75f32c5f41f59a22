"""Names of clusters by strategy: lists of patterns over what a cluster is like, the first that nobody before has taken."""

from __future__ import annotations

from string import Formatter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonearm.operators.summaries import unique_by_rounds
from tonearm.storage import materialize

#: The patterns of each strategy, for clusters on top and below, best first. A pattern counts where all of its parts are known; the last has none.
PATTERNS = {
    "dj_utility": (
        ("{relative} / {tempo}", "{relative} / {style}", "{relative} / {band}", "{relative}", "{style} / {tempo}", "{tempo} / {style} / {traits}", "{role} / {distinctive}", "{role} / {tempo} / {distinctive}", "{tempo} / {distinctive}", "{tempo} / {band}", "{tempo} / {traits}", "{style} / {band}", "{style}", "{tempo}", "{band} / {traits}", "{band}", "Sonic DJ Crate"),
        ("{relative} / {role}", "{relative} / {tempo}", "{relative}", "{role} / {utility}", "{role} / {tempo} / {utility}", "{role} / {style} + {utility}", "{tempo} / {style} / {traits}", "{tempo} / {band}", "{traits}", "{role}", "DJ Utility Split"),
    ),
    "crate_label": (
        ("{style} {range}", "{role} {relative}", "{relative} {traits}", "{style} {distinctive}", "{relative}", "{role} {tempo}", "{band} {traits}", "{role}", "{style}", "{tempo}", "Sonic Crate"),
        ("{style} {range}", "{role} {relative}", "{relative} {traits}", "{style} {distinctive}", "{relative}", "{role} {tempo}", "{band} {traits}", "{role}", "{style}", "{tempo}", "Crate Split"),
    ),
    "metadata_tagline": (
        ("{style}: {tempo}", "{style}: {distinctive}", "{style}: {band}", "{relative}: {style}", "{relative}: {tempo}", "{style}", "{role}: {traits}", "{tempo}: {traits}", "{tempo}: {band}", "Tagged Sonic Crate"),
        ("{style}: {tempo}", "{style}: {distinctive}", "{style}: {band}", "{relative}: {style}", "{relative}: {tempo}", "{style}", "{role}: {traits}", "{tempo}: {traits}", "{tempo}: {band}", "Tagged Split"),
    ),
    "functional_slot": (
        ("{role} / {relative}", "{role} / {utility}", "{role} / {tempo}", "{role} / {style}", "{role}", "{band} / {relative}", "{band} / {traits}", "{relative}", "{tempo} / {style}", "{tempo}", "Set Slot"),
        ("{role} / {relative}", "{role} / {utility}", "{role} / {tempo}", "{role} / {style}", "{role}", "{band} / {relative}", "{band} / {traits}", "{relative}", "{tempo} / {style}", "{tempo}", "Set Slot Split"),
    ),
}
#: Labels that say the same kind of thing; any other is a kind of its own, and any with "energy" in it is of that.
KINDS = {"brightness": ("bright", "brightest", "warm", "warmest"), "density": ("dense", "densest", "sparse", "sparsest", "open", "most open"), "attack": ("punchy", "punchiest", "percussive", "most percussive"), "smoothness": ("smooth", "smoothest"), "tempo": ("fastest", "slowest")}


def kind(label: Column) -> Column:
    low = F.lower(label)
    found = F.when(F.contains(low, F.lit("energy")), "energy")
    for name, labels in KINDS.items():
        found = found.when(low.isin(*labels), name)
    return found.otherwise(low)


def two_kinds(labels: Column) -> Column:
    """The first label and the first after it of another kind, joined; null without any."""
    first = F.get(labels, F.lit(0))
    return F.nullif(F.array_join(F.array_compact(F.array(first, F.get(F.filter(labels, lambda x: kind(x) != kind(first)), F.lit(0)))), " + "), F.lit(""))


def with_parts(clusters: DataFrame) -> DataFrame:
    """``clusters`` with ``parts``, what patterns can hold, out of role, tempo, band, style (texts) and traits, differentiators (lists); the empty text counts as null.

    Columns are made step by step: what several patterns use is worked out once.
    """
    text = lambda c: F.nullif(F.col(c), F.lit("")).alias(c)
    held = lambda c: F.filter(F.coalesce(F.col(c), F.array().cast("array<string>")), lambda x: x.isNotNull() & (x != ""))
    x = clusters.withColumns({"_traits": held("traits"), "_told": held("differentiators")}).withColumn("_both", F.concat("_told", "_traits"))
    x = x.withColumns({"_phrase": F.nullif(F.array_join(F.slice("_traits", 1, 2), " + "), F.lit("")), "_relative": two_kinds(F.col("_told")), "_distinctive": two_kinds(F.col("_both"))})
    utility = F.when(F.size("_told") > 0, F.col("_distinctive")).when(F.size("_traits") >= 2, F.col("_phrase")).otherwise(F.coalesce(F.concat(text("band"), F.lit(" + "), F.col("_phrase")), F.col("_phrase"), text("band"), text("tempo")))
    known = F.struct(text("role"), text("tempo"), F.regexp_replace(text("tempo"), " BPM$", "").alias("range"), text("band"), text("style"), F.col("_phrase").alias("traits"), F.col("_relative").alias("relative"), F.col("_distinctive").alias("distinctive"), utility.alias("utility"))
    return x.withColumn("parts", known).drop("_traits", "_told", "_both", "_phrase", "_relative", "_distinctive")


def _filled(pattern: str) -> Column:
    pieces = [x for literal, name, _, _ in Formatter().parse(pattern) for x in ([F.lit(literal)] if literal else []) + ([F.col(f"parts.{name}")] if name else [])]
    return F.concat(*pieces)


def clean(name: Column) -> Column:
    return F.trim(F.regexp_replace(F.btrim(name, F.lit(" -")), r"(?U)\s+", " "))


def _distinct(df: DataFrame, column: str) -> DataFrame:
    """``column`` with clean names, without nulls, empty ones and repeats in another case; the first spelling stays."""
    df = df.withColumn(column, F.transform(F.array_compact(column), clean)).withColumn("_low", F.transform(column, F.lower))
    return df.withColumn(column, F.filter(column, lambda x, i: (x != "") & (F.array_position("_low", F.lower(x)) == i + 1))).drop("_low")


def with_options(clusters: DataFrame, strategy: str) -> DataFrame:
    """``clusters`` with ``options``, the names that each would take, best first; an unknown strategy is that of utility."""
    above, below = PATTERNS.get(strategy, PATTERNS["dj_utility"])
    filled = lambda patterns: F.array(*[_filled(p) for p in patterns])
    return _distinct(with_parts(clusters).withColumn("options", F.when(F.col("depth") == 0, filled(above)).otherwise(filled(below))), "options").drop("parts")


def strategy_names(clusters: DataFrame, strategy: str = "dj_utility") -> DataFrame:
    """(path, name) of (path, parent, depth, role, tempo, band, style, traits, differentiators): unique in the whole tree, blind to case.

    A cluster takes its first option that is free, else the first of them with its parent's name behind a stroke, else the first option with the smallest
    free number. Levels take turns from the top and paths in a level, so a parent's name is known before its children's; the loop is over depths.
    """
    known = materialize(with_options(clusters, strategy).select("path", "parent", "depth", "options"), "options")
    depths = sorted(r.depth for r in known.select("depth").distinct().collect())
    given = None
    for depth in depths:
        level = known.where(F.col("depth") == depth)
        if given is None:
            level = level.withColumn("above", F.lit(None).cast("string"))
        else:
            level = level.join(given.select(F.col("path").alias("parent"), F.col("name").alias("above")), "parent", "left")
        level = _distinct(level.withColumn("behind", F.transform("options", lambda x: F.concat(x, F.lit(" / "), F.col("above")))), "behind")
        level = level.select(F.struct("depth", "path").alias("place"), F.concat("options", "behind").alias("options"), F.get("options", F.lit(0)).alias("base"))
        if given is not None:
            level = level.unionByName(given.select("place", F.array("name").alias("options"), F.col("name").alias("base")))
        given = unique_by_rounds(level, "place").select("place", F.col("place.path").alias("path"), "name")
    return clusters.sparkSession.createDataFrame([], "path string, name string") if given is None else given.select("path", "name")
