"""Queries of vector analytics: clusters, trees, orders and summaries of the feature table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonearm.functions.numeric import distance
from tonearm.operators import cluster as C
from tonearm.operators import summaries
from tonearm.plans.registry import query
from tonearm.tables import Tables

SPREAD = "SELECT id, tag, CAST(generate_subscripts(vector, 1) - 1 AS INTEGER) AS pos, CAST(unnest(vector) AS DOUBLE) AS x FROM r_features"


@query(f"SELECT tag, pos, round(avg(x), 6) AS m FROM ({SPREAD}) GROUP BY tag, pos")
def centroid_means(t: Tables) -> DataFrame:
    return C.centroids(t.features, "tag").select("tag", F.posexplode("centroid").alias("pos", "m")).withColumn("m", F.round("m", 6))


@query(f"WITH c AS (SELECT tag, pos, avg(x) AS m FROM ({SPREAD}) GROUP BY tag, pos), d AS (SELECT s.id, s.tag, sqrt(sum((s.x - c.m) * (s.x - c.m))) AS d FROM ({SPREAD}) s JOIN c ON c.tag = s.tag AND c.pos = s.pos GROUP BY s.id, s.tag) SELECT id, tag, position FROM (SELECT id, tag, CAST(row_number() OVER (PARTITION BY tag ORDER BY round(d, 9), id) AS INTEGER) AS position FROM d) WHERE position <= 3")
def representatives(t: Tables) -> DataFrame:
    """The three rows nearest to each centroid."""
    return C.centre_out(t.features, "tag").where("position <= 3").select("id", "tag", "position")


@query(f"WITH c AS (SELECT tag, pos, avg(x) AS m FROM ({SPREAD}) GROUP BY tag, pos), i AS (SELECT avg(d) AS intra FROM (SELECT tag, avg(d) AS d FROM (SELECT s.id, s.tag, sqrt(sum((s.x - c.m) * (s.x - c.m))) AS d FROM ({SPREAD}) s JOIN c ON c.tag = s.tag AND c.pos = s.pos GROUP BY s.id, s.tag) GROUP BY tag)), o AS (SELECT min(d) AS gap FROM (SELECT sqrt(sum((a.m - b.m) * (a.m - b.m))) AS d FROM c a JOIN c b ON a.pos = b.pos AND a.tag < b.tag GROUP BY a.tag, b.tag)) SELECT round(gap / greatest(intra, 1e-9), 6) AS separation FROM i, o")
def separation_ratio(t: Tables) -> DataFrame:
    """Least gap between centroids over the mean distance to them; pairs of centroids only, a few dozen rows."""
    c = C.centroids(t.features, "tag")
    inner = t.features.join(c, "tag").groupBy("tag").agg(F.avg(distance(F.col("vector"), F.col("centroid"))).alias("d")).agg(F.avg("d").alias("intra"))
    other = c.select(F.col("tag").alias("other"), F.col("centroid").alias("oc"))
    gap = c.join(other, F.col("tag") < F.col("other")).agg(F.min(distance(F.col("centroid"), F.col("oc"))).alias("gap"))
    return inner.join(gap, F.lit(True)).select(F.round(F.col("gap") / F.greatest("intra", F.lit(1e-9)), 6).alias("separation"))


@query(f"WITH p AS (SELECT pos, avg(x) AS m FROM ({SPREAD}) GROUP BY pos), c AS (SELECT tag, pos, avg(x) AS m FROM ({SPREAD}) GROUP BY tag, pos), r AS (SELECT c.tag, c.pos, c.m - p.m AS delta, row_number() OVER (PARTITION BY c.tag ORDER BY round(abs(c.m - p.m), 9) DESC, c.pos) AS n FROM c JOIN p ON p.pos = c.pos WHERE abs(c.m - p.m) >= 1e-9) SELECT tag, pos, round(delta, 6) AS delta FROM r WHERE n <= 5")
def top_deltas(t: Tables) -> DataFrame:
    """The five positions in which a cluster is farthest from all rows."""
    from pyspark.sql import Window as W

    x = t.features.select("tag", F.posexplode("vector").alias("pos", "x")).withColumn("x", F.col("x").cast("double"))
    everyone = x.groupBy("pos").agg(F.avg("x").alias("all"))
    d = x.groupBy("tag", "pos").agg(F.avg("x").alias("m")).join(F.broadcast(everyone), "pos").withColumn("delta", F.col("m") - F.col("all")).where("abs(delta) >= 1e-9")
    n = F.row_number().over(W.partitionBy("tag").orderBy(F.round(F.abs("delta"), 9).desc(), "pos"))
    return d.withColumn("n", n).where("n <= 5").select("tag", "pos", F.round("delta", 6).alias("delta"))


@query("SELECT id, CAST(least(3, (n - 1) // k) AS INTEGER) AS label FROM (SELECT id, row_number() OVER (ORDER BY vector[1], id) AS n, CAST(ceil(count(*) OVER () / 4.0) AS BIGINT) AS k FROM r_features)")
def chunk_labels(t: Tables) -> DataFrame:
    """Four equal chunks by the first coordinate, out of exact ranks."""
    from tonearm.operators.ranking import numbered

    rows = numbered(t.features.select("id", F.col("vector")[0].alias("v")), [F.col("v"), F.col("id")])
    size = max(1, -(-t.features.count() // 4))
    return rows.select("id", F.least(F.lit(3), F.floor((F.col("number") - 1) / size)).cast("int").alias("label"))


@query()
def kmeans_clusters(t: Tables) -> DataFrame:
    """Spark ML k-means over all features; labels depend on the seeding, so only sizes and cost are compared in tests."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    x = t.features.select("id", array_to_vector(F.transform("vector", lambda v: v.cast("double"))).alias("features"))
    return KMeans(k=10, seed=7, maxIter=20).fit(x).transform(x).select("id", F.col("prediction").alias("label"))


@query()
def playlist_tree(t: Tables) -> DataFrame:
    """Recursive Ward splits of all features."""
    from tonearm.operators.cluster_features import playlist_tree as grown

    return grown(t.features.select("id", "vector"), target=24, least=8, most_children=4, max_depth=3)


@query()
def ordered_playlists(t: Tables) -> DataFrame:
    names = t.parts.select("id", "artist", "album")
    rows = t.features.join(names, "id").select(F.concat(F.lit("tag-"), F.col("tag").cast("string")).alias("path"), "id", "vector", "artist", "album")
    return C.ordered_leaves(rows)


SIBLINGS = "WITH e AS (SELECT user_id % 12 AS parent, event_type AS child, avg(value) AS tempo, avg(value) / 40 AS energy, sum(value) AS brightness FROM events GROUP BY 1, 2), m AS (SELECT parent, child, 'tempo' AS metric, tempo AS value FROM e UNION ALL SELECT parent, child, 'energy', energy FROM e UNION ALL SELECT parent, child, 'brightness', brightness FROM e), spec(metric, low, lower_, higher_, high, spread, priority) AS (VALUES ('tempo', 'Slowest', 'Slower', 'Faster', 'Fastest', 8.0, 0), ('energy', 'Lowest Energy', 'Lower Energy', 'Higher Energy', 'Highest Energy', 0.08, 1), ('brightness', 'Warmest', 'Warm', 'Bright', 'Brightest', 350.0, 3)), x AS (SELECT m.*, low, lower_, higher_, high, spread, priority, row_number() OVER (PARTITION BY parent, m.metric ORDER BY value, child) AS k, count(*) OVER w AS n, max(value) OVER w - min(value) OVER w AS width, avg(value) OVER w AS mid FROM m JOIN spec ON spec.metric = m.metric WINDOW w AS (PARTITION BY parent, m.metric)), named AS (SELECT *, CASE WHEN k = 1 THEN low WHEN k = n THEN high WHEN n >= 4 AND value < mid THEN lower_ WHEN n >= 4 AND value > mid THEN higher_ END AS label, CAST(round_even(CASE WHEN k = 1 OR k = n THEN 1.0::DOUBLE ELSE abs(value - mid) / width END, 3) AS DOUBLE) AS score FROM x WHERE n >= 2 AND width >= spread), one AS (SELECT *, row_number() OVER (PARTITION BY parent, child, label ORDER BY score DESC, priority) AS r FROM named WHERE label IS NOT NULL AND score >= 0.12) SELECT parent, child, metric, label, score FROM (SELECT *, row_number() OVER (PARTITION BY parent, child ORDER BY score DESC, priority, label) AS r2 FROM one WHERE r = 1) WHERE r2 <= 3"


@query(SIBLINGS)
def sibling_labels(t: Tables) -> DataFrame:
    e = t.events.groupBy((F.col("key") % 12).alias("parent"), F.col("event_type").alias("child")).agg(F.avg("value").alias("tempo"), (F.avg("value") / 40).alias("energy"), (F.sum("value")).alias("brightness"))
    long = e.select("parent", "child", F.explode(F.create_map(F.lit("tempo"), F.col("tempo"), F.lit("energy"), F.col("energy"), F.lit("brightness"), F.col("brightness"))).alias("metric", "value"))
    return C.sibling_labels(long)


ENERGY = "CASE pos WHEN 0 THEN 2.0 WHEN 1 THEN 2.0 WHEN 2 THEN 1.2 WHEN 3 THEN 1.8 WHEN 4 THEN 1.0 WHEN 10 THEN 0.9 WHEN 8 THEN 0.75 ELSE 0.25 END"


def described(t: Tables) -> DataFrame:
    """Features under descriptor keys: the first 42 numbers of a vector, tempo on a scale of its own."""
    from tonearm.operators.summaries import KEYS

    keys = F.array(*[F.lit(k) for k in KEYS])
    values = F.transform(F.slice("vector", 1, len(KEYS)), lambda v, i: F.when(i == 0, F.abs(v.cast("double")) * 100 + 40).otherwise(v.cast("double")))
    return t.features.select("id", "tag", F.map_from_arrays(keys, values).alias("descriptors"))


@query(f"SELECT id, pos, round((x - avg(x) OVER w) / CASE WHEN stddev_pop(x) OVER w = 0 THEN 1 ELSE stddev_pop(x) OVER w END * {ENERGY}, 6) AS v FROM (SELECT id, pos, CASE WHEN pos = 0 THEN abs(x) * 100 + 40 ELSE x END AS x FROM ({SPREAD}) WHERE pos < 42) WINDOW w AS (PARTITION BY pos)")
def profile_matrix(t: Tables) -> DataFrame:
    from tonearm.operators.summaries import profile_matrix as matrix
    from tonearm.operators.summaries import weights_of

    m = matrix(described(t), weights_of("energy_v1"))
    return m.select("id", F.posexplode("vector").alias("pos", "v")).withColumn("v", F.round("v", 6))


GROUPED = "CASE WHEN f = 0 THEN 1.15 / sqrt(2.0) WHEN f = 1 THEN 0.35 * 1.15 / sqrt(2.0) WHEN f IN (2, 3, 11) THEN 1.0 / sqrt(3.0) WHEN f IN (4, 5) THEN 1.25 / sqrt(2.0) WHEN f IN (6, 7, 9) THEN 0.95 / sqrt(3.0) WHEN f IN (8, 10) OR f BETWEEN 12 AND 18 THEN 0.9 / sqrt(9.0) ELSE 0.75 / sqrt(24.0) END"


@query(f"WITH r AS (SELECT id, pos, CASE WHEN pos = 0 THEN abs(x) * 100 + 40 ELSE x END AS x FROM ({SPREAD}) WHERE pos < 42), c AS (SELECT id, pos + 1 AS f, x FROM r UNION ALL SELECT id, 0, CASE WHEN x < 85 THEN x * pow(2, ceil(log2(85 / x))) WHEN x > 170 THEN x / pow(2, ceil(log2(x / 170))) ELSE x END FROM r WHERE pos = 0), s AS (SELECT f, list_sort(list(x)) AS v, median(x) AS m, count(*) AS n FROM c GROUP BY f), q AS (SELECT f, m, v[CAST(round_even((n - 1) * 0.75, 0) AS INTEGER) + 1] - v[CAST(round_even((n - 1) * 0.25, 0) AS INTEGER) + 1] AS iqr, (v[n] - v[1]) / 2 AS half FROM s) SELECT id, c.f AS pos, round((x - m) / CASE WHEN iqr > 1e-9 THEN iqr WHEN half > 1e-9 THEN half ELSE 1 END * CAST({GROUPED.replace('f ', 'c.f ')} AS DOUBLE), 6) AS v FROM c JOIN q ON q.f = c.f")
def grouped_matrix(t: Tables) -> DataFrame:
    from tonearm.operators.summaries import grouped_matrix as matrix
    from tonearm.operators.summaries import weights_of

    m = matrix(described(t), weights_of("balanced_v1"))
    return m.select("id", F.posexplode("vector").alias("pos", "v")).withColumn("v", F.round("v", 6))


SUMMARY = f"WITH r AS (SELECT id, tag, pos, CASE WHEN pos = 0 THEN abs(x) * 100 + 40 ELSE x END AS x FROM ({SPREAD}) WHERE pos < 42), m AS (SELECT tag, pos, avg(x) AS m FROM r GROUP BY tag, pos), w AS (SELECT tag, max(CASE WHEN pos = 0 THEN m END) AS t, max(CASE WHEN pos = 3 THEN m END) AS rms, max(CASE WHEN pos = 1 THEN m END) AS onset, max(CASE WHEN pos = 5 THEN m END) AS a, max(CASE WHEN pos = 8 THEN m END) AS b, max(CASE WHEN pos = 7 THEN m END) AS c, max(CASE WHEN pos = 10 THEN m END) AS d, max(CASE WHEN pos = 18 THEN m END) AS e FROM m GROUP BY tag), s AS (SELECT tag, (greatest(0.0, least(1.0, (t - 85) / 50)) + greatest(0.0, least(1.0, (rms - 0.08) / 0.28)) + greatest(0.0, least(1.0, onset / 2))) / 3 AS score, list_filter([CASE WHEN a <= 1500 THEN 'Warm' WHEN a >= 2600 THEN 'Bright' END, CASE WHEN b <= 3000 THEN 'Warm' WHEN b >= 6000 THEN 'Bright' END, CASE WHEN c <= 1600 THEN 'Sparse' WHEN c >= 3000 THEN 'Dense' END, CASE WHEN onset <= 0.4 THEN 'Smooth' WHEN onset >= 1.2 THEN 'Punchy' END, CASE WHEN d <= 0.035 THEN 'Smooth' WHEN d >= 0.08 THEN 'Percussive' END, CASE WHEN e <= -2 THEN 'Open' WHEN e >= 2 THEN 'Dense' END], lambda x: x IS NOT NULL) AS all_traits FROM w), k AS (SELECT *, list_filter(all_traits, lambda x, i: list_position(all_traits, x) = i)[:3] AS traits, CASE WHEN score < 0.4 THEN 'Low Energy' WHEN score < 0.72 THEN 'Medium Energy' ELSE 'High Energy' END AS band FROM s), g AS (SELECT tag, CAST(count(*) AS BIGINT) AS n, CAST(round_even(median(x), 0) AS BIGINT) AS bpm, CAST(round_even(min(x), 0) AS BIGINT) AS low, CAST(round_even(max(x), 0) AS BIGINT) AS high FROM r WHERE pos = 0 GROUP BY tag) SELECT 'tag-' || CAST(g.tag AS VARCHAR) AS path, n, bpm, CASE WHEN high - low <= 2 THEN CAST(bpm AS VARCHAR) ELSE CAST(low AS VARCHAR) || '-' || CAST(high AS VARCHAR) END || ' BPM' AS tempo, CAST(round_even(score, 3) AS DOUBLE) AS score, band, array_to_string(traits, ',') AS traits, CASE WHEN list_contains(traits, 'Sparse') AND list_has_any(traits, ['Percussive', 'Punchy']) AND bpm >= 105 THEN 'Tools' WHEN score_3 >= 0.72 OR bpm >= 128 THEN 'Peak' WHEN score_3 <= 0.38 AND list_has_any(traits, ['Open', 'Sparse', 'Smooth']) THEN 'Afterhours' WHEN score_3 <= 0.38 THEN 'Warm-up' WHEN score_3 >= 0.42 AND score_3 < 0.72 AND bpm >= 108 AND list_has_any(traits, ['Smooth', 'Warm']) THEN 'Rolling' WHEN score_3 >= 0.55 THEN 'Build' WHEN bpm >= 108 THEN 'Rolling' WHEN band = 'Low Energy' THEN 'Warm-up' WHEN band = 'High Energy' THEN 'Peak' ELSE band END AS role FROM g JOIN (SELECT *, score AS score_3 FROM k) k ON k.tag = g.tag"


@query(SUMMARY)
def cluster_summary(t: Tables) -> DataFrame:
    from tonearm.operators.summaries import cluster_summaries

    return cluster_summaries(described(t).withColumn("path", F.concat(F.lit("tag-"), F.col("tag").cast("string")))).withColumn("traits", F.array_join("traits", ","))


@query()
def playlist_names(t: Tables) -> DataFrame:
    from tonearm.operators.summaries import cluster_summaries, named

    return named(cluster_summaries(described(t).withColumn("path", F.concat(F.lit("tag-"), F.col("tag").cast("string")))))


@query()
def utility_names(t: Tables) -> DataFrame:
    """Names of a tree of two levels, labels and thirds of them, out of what tells siblings apart, tempo, energy, traits, style and role."""
    from pyspark.sql import Window as W

    from tonearm.operators.naming import strategy_names

    rows = described(t).withColumn("root", F.concat(F.lit("tag-"), F.col("tag").cast("string")))
    both = rows.select("id", "descriptors", F.explode(F.array(F.col("root"), F.concat("root", F.lit("-"), (F.col("id") % 3).cast("string")))).alias("path"))
    s = summaries.cluster_summaries(both)
    parent = F.when(F.col("path").rlike("^tag-[^-]+-"), F.regexp_extract("path", "^(tag-[^-]+)-", 1))
    tree = s.withColumn("parent", parent).withColumn("depth", F.col("parent").isNotNull().cast("int"))
    values = F.create_map(F.lit("tempo"), F.col("bpm").cast("double"), F.lit("energy"), F.col("score").cast("double"))
    told = C.sibling_labels(tree.select(F.coalesce("parent", F.lit("")).alias("parent"), F.col("path").alias("child"), F.explode(values).alias("metric", "value")))
    told = told.groupBy(F.col("child").alias("path")).agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "metric", "label"))), lambda x: x["label"]).alias("differentiators"))
    styles = both.join(t.parts.select("id", F.initcap(F.get(F.split("album", " "), F.lit(0))).alias("style")), "id").groupBy("path", "style").count()
    style = styles.withColumn("k", F.row_number().over(W.partitionBy("path").orderBy(F.desc("count"), "style"))).where("k = 1").select("path", "style")
    return strategy_names(tree.join(told, "path", "left").join(style, "path", "left"))


COMMON = """
WITH t AS (SELECT label AS tag, vec_id AS id, [p_type || ' ; ' || split_part(p_name, ' ', 1) || ',' || CASE WHEN vec_id % 2 = 0 THEN upper(split_part(p_name, ' ', 2)) ELSE split_part(p_name, ' ', 2) END, CASE p_size % 3 WHEN 0 THEN 'Even' WHEN 1 THEN 'EVEN;;odd ' END, CASE WHEN p_size % 4 = 0 THEN ' Deep , ' || lower(p_type) END] AS tags FROM embeddings JOIN part ON p_partkey = vec_id),
x AS (SELECT tag, id, unnest(tags) AS v, generate_subscripts(tags, 1) AS i FROM t), p AS (SELECT tag, id, i, unnest(string_split_regex(v, '[;,]')) AS part, generate_subscripts(string_split_regex(v, '[;,]'), 1) AS j FROM x WHERE v IS NOT NULL),
n AS (SELECT tag, lower(trim(part)) AS folded, CAST(count(*) AS BIGINT) AS n, arg_min(trim(part), (id, i, j)) AS value FROM p WHERE trim(part) <> '' GROUP BY 1, 2),
k AS (SELECT n.*, row_number() OVER (PARTITION BY tag ORDER BY n DESC, folded) AS k FROM n JOIN (SELECT tag, count(*) AS size FROM t GROUP BY tag) USING (tag) WHERE n >= greatest(1, ceil(size * CAST(0.2 AS DOUBLE))))
SELECT tag, value, n FROM k WHERE k <= 5
"""


@query(COMMON)
def common_tags(t: Tables) -> DataFrame:
    """The tag values that a fifth of a cluster's rows have; lists are built out of the part table, with both separators and in both cases."""
    size, word = F.col("p_size"), lambda k: F.split_part("p_name", F.lit(" "), F.lit(k))
    second = F.when(F.col("p_partkey") % 2 == 0, F.upper(word(2))).otherwise(word(2))
    tags = F.array(F.concat("p_type", F.lit(" ; "), word(1), F.lit(","), second), F.when(size % 3 == 0, "Even").when(size % 3 == 1, "EVEN;;odd "), F.when(size % 4 == 0, F.concat(F.lit(" Deep , "), F.lower("p_type"))))
    rows = t.features.select("id", "tag").join(t.raw("part").select(F.col("p_partkey").alias("id"), tags.alias("tags")), "id")
    return summaries.common_tags(rows)
