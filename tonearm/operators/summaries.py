"""Feature profiles, scaled matrices, and the summaries, traits, roles and names of clusters."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tonearm.functions import numeric as N
from tonearm.operators.cluster import robust_limits
from tonearm.storage import materialize

#: Descriptor keys in vector order.
SCALARS = ("tempo_bpm", "onset_strength_mean", "onset_strength_std", "rms_mean", "rms_std", "spectral_centroid_mean", "spectral_centroid_std", "spectral_bandwidth_mean", "spectral_rolloff_mean", "spectral_flatness_mean", "zero_crossing_rate_mean")
KEYS = (*SCALARS, *(f"spectral_contrast_{i:02d}_mean" for i in range(1, 8)), *(f"mfcc_{i:02d}_mean" for i in range(1, 13)), *(f"chroma_{i:02d}_mean" for i in range(12)))
#: Base weight and own weights of each profile.
PROFILES = {
    "balanced_v1": (1.0, {}),
    "energy_v1": (0.25, {"tempo_bpm": 2.0, "onset_strength_mean": 2.0, "onset_strength_std": 1.2, "rms_mean": 1.8, "rms_std": 1.0, "zero_crossing_rate_mean": 0.9, "spectral_rolloff_mean": 0.75}),
    "texture_v1": (0.2, {"spectral_centroid_mean": 1.8, "spectral_centroid_std": 1.2, "spectral_bandwidth_mean": 1.4, "spectral_rolloff_mean": 1.5, "spectral_flatness_mean": 1.8, "zero_crossing_rate_mean": 1.2, **{f"spectral_contrast_{i:02d}_mean": 1.3 for i in range(1, 8)}}),
    "harmony_v1": (0.15, {**{f"chroma_{i:02d}_mean": 1.8 for i in range(12)}, **{f"mfcc_{i:02d}_mean": 0.9 for i in range(1, 13)}}),
}
#: Groups by key prefix, and their weights.
GROUPS = {"tempo_": "tempo", "rms_": "energy", "onset_strength_": "attack", "zero_crossing_rate_": "attack", "spectral_centroid_": "brightness", "spectral_rolloff_": "brightness", "spectral_bandwidth_": "density", "spectral_contrast_": "density", "spectral_flatness_": "density", "chroma_": "harmony", "mfcc_": "harmony"}
GROUP_WEIGHTS = {"attack": 1.0, "brightness": 0.95, "density": 0.9, "energy": 1.25, "harmony": 0.75, "tempo": 1.15, "texture": 0.85}
RAW_TEMPO_SHARE = 0.35
#: Descriptor, label and limit of low, label and limit of high.
TRAITS = (("spectral_centroid_mean", "Warm", 1500.0, "Bright", 2600.0), ("spectral_rolloff_mean", "Warm", 3000.0, "Bright", 6000.0), ("spectral_bandwidth_mean", "Sparse", 1600.0, "Dense", 3000.0), ("onset_strength_mean", "Smooth", 0.4, "Punchy", 1.2), ("zero_crossing_rate_mean", "Smooth", 0.035, "Percussive", 0.08), ("mfcc_01_mean", "Open", -2.0, "Dense", 2.0))
#: Key prefix, label of a higher and of a lower cluster.
DELTAS = (("spectral_centroid", "Bright", "Warm"), ("spectral_rolloff", "Bright", "Warm"), ("spectral_bandwidth", "Dense", "Sparse"), ("mfcc", "Dense", "Open"), ("onset_strength", "Punchy", "Smooth"), ("zero_crossing", "Percussive", "Smooth"), ("spectral_flatness", "Textured", "Smooth"), ("spectral_contrast", "Punchy", "Smooth"), ("chroma", "Tonal", "Open"), ("tempo_bpm", "Faster", "Slower"), ("rms_", "High Energy", "Low Energy"))


def weights_of(profile: str | None, own: dict | None = None) -> dict[str, float]:
    """Weight per key: stored positive weights win over the named profile; an unknown name is balanced."""
    if own and (kept := {k: float(v) for k, v in own.items() if isinstance(v, (int, float)) and not isinstance(v, bool) and v > 0}):
        return kept
    base, special = PROFILES.get((profile or "").strip(), PROFILES["balanced_v1"])
    return {k: special.get(k, base) for k in KEYS}


def group_of(key: str) -> str:
    return next((g for p, g in GROUPS.items() if key.startswith(p)), "texture")


def spread(rows: DataFrame, descriptors: str = "descriptors") -> DataFrame:
    """(id, key, x) of finite values of a map column."""
    return rows.select("id", F.explode(descriptors).alias("key", "x")).withColumn("x", N.finite(F.col("x"))).where("x IS NOT NULL")


def _gathered(cells: DataFrame, order: list[str]) -> DataFrame:
    place = F.create_map(*[F.lit(v) for i, k in enumerate(order) for v in (k, i)])
    held = cells.select("id", place[F.col("key")].alias("pos"), "v").where("pos IS NOT NULL").groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("pos", "v"))).alias("m"))
    return held.select("id", F.transform(F.sequence(F.lit(0), F.lit(len(order) - 1)), lambda i: F.coalesce(F.element_at("m", i), F.lit(0.0))).alias("vector"))


def profile_matrix(rows: DataFrame, weights: dict[str, float]) -> DataFrame:
    """(id, vector): z-scores by the population deviation, times weight; missing values are zero before scaling."""
    keys = list(weights)
    known = F.array(*[F.lit(k) for k in keys])
    x = rows.select("id", F.explode(F.transform(known, lambda k: F.struct(k.alias("key"), F.coalesce(F.element_at("descriptors", k), F.lit(0.0)).alias("x")))).alias("c")).select("id", "c.*")
    s = x.groupBy("key").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s"))
    w = F.create_map(*[F.lit(v) for k in keys for v in (k, weights[k])])
    cells = x.join(F.broadcast(s), "key").select("id", "key", ((F.col("x") - F.col("m")) / F.when(F.col("s") == 0, 1.0).otherwise(F.col("s")) * w[F.col("key")]).alias("v"))
    return _gathered(cells, keys)


def grouped_matrix(rows: DataFrame, weights: dict[str, float], raw_tempo: bool = False) -> DataFrame:
    """(id, vector): robustly scaled, times weight and group weight over the root of the group's size. Tempo counts folded into one octave and,
    with a share of its weight, as it is; a missing value sits at the centre."""
    specs = {}
    for k, v in weights.items():
        if k == "tempo_bpm":
            specs |= {"tempo_raw_bpm": v} if raw_tempo else {"tempo_mix_bpm": v, "tempo_raw_bpm": v * RAW_TEMPO_SHARE}
        else:
            specs[k] = v
    sizes: dict[str, int] = {}
    for k in specs:
        sizes[group_of(k)] = sizes.get(group_of(k), 0) + 1
    final = {k: v * GROUP_WEIGHTS[group_of(k)] / math.sqrt(sizes[group_of(k)]) for k, v in specs.items()}
    x = spread(rows)
    tempo = x.where("key = 'tempo_bpm'")
    extra = tempo.select("id", F.lit("tempo_raw_bpm").alias("key"), "x").unionByName(tempo.select("id", F.lit("tempo_mix_bpm").alias("key"), N.octave_fold(F.col("x")).alias("x")))
    cells = x.where("key <> 'tempo_bpm'").unionByName(extra).where(F.col("key").isin(*final) & F.col("x").isNotNull())
    limits = robust_limits(cells.withColumnRenamed("key", "pos")).withColumnRenamed("pos", "key")
    w = F.create_map(*[F.lit(v) for k in final for v in (k, final[k])])
    scaled = cells.join(F.broadcast(limits), "key").select("id", "key", ((F.col("x") - F.col("centre")) / F.col("scale") * w[F.col("key")]).alias("v"))
    found = _gathered(scaled, list(final))
    return rows.select("id").join(found, "id", "left").select("id", F.coalesce("vector", F.array_repeat(F.lit(0.0), len(final))).alias("vector"))


def descriptor_means(rows: DataFrame, by: str = "path") -> DataFrame:
    """(by, key, mean, n) over the rows that have the key."""
    x = rows.select(by, F.explode("descriptors").alias("key", "x")).withColumn("x", N.finite(F.col("x"))).where("x IS NOT NULL")
    return x.groupBy(by, "key").agg(F.avg("x").alias("mean"), F.count("*").alias("n"))


def delta_label(key: Column, delta: Column) -> Column:
    pick = lambda high, low: F.when(delta >= 0, high).otherwise(low)
    return F.coalesce(*[F.when(key.startswith(p), pick(h, low)) for p, h, low in DELTAS], pick("Higher", "Lower"))


def top_deltas(means: DataFrame, parent: DataFrame, weights: dict[str, float], by: str = "path", n: int = 5) -> DataFrame:
    """(by, key, delta, label, rank): the ``n`` keys in which a cluster is farthest from its parent (key, mean), weighted at least 0.1."""
    w = F.coalesce(F.create_map(*[F.lit(v) for k, x in weights.items() for v in (k, x)])[F.col("key")], F.lit(0.0))
    d = means.join(F.broadcast(parent.select("key", F.col("mean").alias("all"))), "key").withColumn("delta", F.col("mean") - F.col("all")).where("abs(delta) >= 1e-9")
    rank = F.row_number().over(W.partitionBy(by).orderBy((F.abs("delta") * F.greatest(w, F.lit(0.1))).desc(), F.abs("delta").desc(), F.desc("key")))
    return d.withColumn("rank", rank).where(F.col("rank") <= n).select(by, "key", "delta", delta_label(F.col("key"), F.col("delta")).alias("label"), "rank")


def threshold_traits(descriptors: Column) -> Column:
    """Up to three distinct labels of a descriptor map by fixed limits, in the order of the rules."""
    found = [F.when(descriptors[k] <= low, low_label).when(descriptors[k] >= high, high_label) for k, low_label, low, high_label, high in TRAITS]
    return F.slice(F.array_distinct(F.array_compact(F.array(*found))), 1, 3)


def role(bpm: Column, score: Column, delta: Column, traits: Column, band: Column) -> Column:
    """What a cluster is for: the first rule that holds."""
    has = lambda *names: reduce(lambda a, b: a | b, [F.array_contains(traits, n) for n in names])
    sure = lambda c: F.coalesce(c, F.lit(False))
    tools = F.array_contains(traits, "Sparse") & has("Percussive", "Punchy") & (bpm.isNull() | (bpm >= 105))
    return (
        F.when(sure(tools), "Tools")
        .when(sure(score >= 0.72) | sure(bpm >= 128), "Peak")
        .when(sure(score <= 0.38) & has("Open", "Sparse", "Smooth"), "Afterhours")
        .when(sure(score <= 0.38), "Warm-up")
        .when(sure((score >= 0.42) & (score < 0.72) & (bpm >= 108)) & has("Smooth", "Warm"), "Rolling")
        .when(sure(delta >= 0.12) | sure(score >= 0.55), "Build")
        .when(sure(bpm >= 108), "Rolling")
        .when(band == "Low Energy", "Warm-up")
        .when(band == "High Energy", "Peak")
        .otherwise(band)
    )


def cluster_summaries(rows: DataFrame, by: str = "path") -> DataFrame:
    """One row per cluster of (by, id, descriptors): size, tempo figures, energy, traits, role; a few numbers per cluster."""
    means = descriptor_means(rows, by).groupBy(by).agg(F.map_from_entries(F.collect_list(F.struct("key", "mean"))).alias("means"))
    bpm = rows.select(by, F.element_at("descriptors", "tempo_bpm").alias("t")).groupBy(by).agg(F.count("*").alias("n"), F.median(F.when(F.col("t") > 0, F.col("t"))).alias("m"), F.min(F.when(F.col("t") > 0, F.col("t"))).alias("low"), F.max(F.when(F.col("t") > 0, F.col("t"))).alias("high"))
    x = bpm.join(means, by, "left")
    at = lambda k: F.element_at("means", k)
    x = x.withColumn("score", N.energy_score(at("tempo_bpm"), at("rms_mean"), at("onset_strength_mean"))).withColumn("traits", threshold_traits(F.col("means")))
    x = x.withColumn("band", N.energy_band(F.col("score"))).withColumn("bpm", F.bround("m").cast("long"))
    label = F.when(F.bround("high") - F.bround("low") <= 2, F.concat(F.col("bpm").cast("string"), F.lit(" BPM"))).otherwise(F.concat(F.bround("low").cast("long").cast("string"), F.lit("-"), F.bround("high").cast("long").cast("string"), F.lit(" BPM")))
    return x.select(by, "n", "bpm", label.alias("tempo"), F.bround("score", 3).alias("score"), "band", "traits", role(F.col("bpm"), F.col("score"), F.lit(None).cast("double"), F.col("traits"), F.col("band")).alias("role"))


def unique_by_rounds(rows: DataFrame, by: str = "path") -> DataFrame:
    """(by, name) of rows (by, options): in order of ``by`` each takes its first option that none before it took, blind to case; without one ``base``, if there is such a column, or its last with the smallest free number from 2 on.

    In rounds: each row proposes, the smallest ``by`` holds the name, all others go on in their lists, which the numbers continue. Since every name prefers the same rows, the outcome is that of
    taking turns. Of rows with one list that lose together each later one goes a place further, as those before it take the places between; so equal lists need
    no more rounds than different ones. Rows travel, none through the driver.
    """
    base = "base" if "base" in rows.columns else F.element_at("options", -1).alias("base")
    name = F.when(F.col("at") < F.size("options"), F.get("options", F.col("at"))).otherwise(F.concat("base", F.lit(" "), (F.col("at") - F.size("options") + 2).cast("string")))
    state = rows.select(by, "options", base, F.lit(0).alias("at"))
    while True:
        asked = state.withColumn("name", name).withColumn("key", F.replace(F.lower("name"), F.lit("ß"), F.lit("ss")))
        first = W.partitionBy("key").orderBy(by)
        alike = W.partitionBy("key", "options", "base").orderBy(by)
        lists = F.struct("options", "base")
        ranked = asked.withColumn("first", F.first(lists).over(first)).withColumn("r", F.row_number().over(first)).withColumn("k", F.row_number().over(alike))
        further = F.when(F.col("r") == 1, 0).when(F.col("first") == lists, F.col("k") - 1).otherwise(F.col("k"))
        judged = materialize(ranked.select(by, "options", "base", "name", F.col("at"), further.cast("int").alias("further")), "names")
        if judged.where("further > 0").isEmpty():
            return judged.select(by, "name")
        state = judged.select(by, "options", "base", (F.col("at") + F.col("further")).alias("at"))


def named(summaries: DataFrame, by: str = "path", fallback: str = "Sonic Set") -> DataFrame:
    """(by, name): names unique in the whole tree, blind to case, out of each cluster's role, tempo, traits and band."""
    traits = F.nullif(F.array_join(F.slice("traits", 1, 2), " "), F.lit(""))
    parts = [("role", traits), ("role", "tempo"), ("tempo", "band"), ("role", "tempo", traits), ("tempo",), ("band",)]
    column = lambda p: F.col(p) if isinstance(p, str) else p
    options = [F.when(reduce(lambda a, b: a & b, [column(p).isNotNull() & (column(p) != "") for p in each]), F.concat_ws(" / ", *map(column, each))) for each in parts]
    return unique_by_rounds(summaries.select(by, F.filter(F.array(*options, F.lit(fallback)), lambda o: o.isNotNull()).alias("options")), by)


#: Share of a cluster's rows that a common tag occurs in, and how many are shown.
COMMON_SHARE, COMMON_MOST = 0.2, 5


def common_tags(rows: DataFrame, share: float = COMMON_SHARE, most: int = COMMON_MOST) -> DataFrame:
    """(tag, value, n): the most frequent tag values of each cluster, of those that occur at least ``share`` times its number of rows, and once.

    ``rows`` has tag (the cluster), id and tags, a list of texts that semicolons and commas part. Values are told apart without case and shown as the first of them by id and place is spelt; equally
    frequent ones go by their folded form. Null lists and empty values count as none.
    """
    sizes = rows.groupBy("tag").agg(F.count("*").alias("size"))
    texts = rows.select("tag", "id", F.posexplode("tags").alias("i", "text"))
    parts = texts.select("tag", "id", "i", F.posexplode(F.split("text", "[;,]")).alias("j", "part")).withColumn("part", F.regexp_replace("part", r"(?U)^\s+|\s+$", "")).where("part <> ''")
    n = parts.groupBy("tag", F.replace(F.lower("part"), F.lit("ß"), F.lit("ss")).alias("folded")).agg(F.count("*").alias("n"), F.min_by("part", F.struct("id", "i", "j")).alias("value"))
    often = n.join(sizes, "tag").where(F.col("n") >= F.greatest(F.lit(1), F.ceil(F.col("size") * F.lit(share))))
    return often.withColumn("k", F.row_number().over(W.partitionBy("tag").orderBy(F.desc("n"), "folded"))).where(F.col("k") <= most).select("tag", "value", "n")
