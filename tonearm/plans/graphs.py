"""Queries over the relationship graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tonearm.operators import graph as G
from tonearm.plans.registry import query
from tonearm.tables import Tables


@query("SELECT * FROM r_components")
def components(t: Tables) -> DataFrame:
    return t.components


@query("SELECT track_id, component, CAST(count(*) OVER (PARTITION BY component) AS BIGINT) AS size FROM r_components WHERE component IN (SELECT component FROM r_components WHERE track_id IN (SELECT lower_id FROM r_edges WHERE type = 'equivalent'))")
def component_members(t: Tables) -> DataFrame:
    """Members of the components of some tracks, without walking from each."""
    seeds = t.edges.where("type = 'equivalent'").select(F.col("lower_id").alias("track_id")).distinct()
    wanted = t.components.join(seeds, "track_id", "left_semi").select("component").distinct()
    return t.components.join(wanted, "component", "left_semi").select("track_id", "component", F.count("*").over(W.partitionBy("component")).alias("size"))


@query("SELECT * FROM r_resolved")
def resolved_links(t: Tables) -> DataFrame:
    return t.resolved


def _pairs(t: Tables) -> DataFrame:
    """Candidate merges: tracks in a row within a title."""
    return t.tracks.select(F.col("id").alias("lower_id"), F.lead("id").over(W.partitionBy("title").orderBy("id")).alias("higher_id")).where("higher_id IS NOT NULL")


PAIRS = "SELECT lower_id, higher_id FROM (SELECT id AS lower_id, lead(id) OVER (PARTITION BY title ORDER BY id) AS higher_id FROM r_tracks) WHERE higher_id IS NOT NULL"


@query(f"WITH l AS (SELECT component, list(DISTINCT local_id) AS ids FROM r_final JOIN r_components USING (track_id) GROUP BY component), x AS (SELECT p.lower_id, p.higher_id, a.component AS first, b.component AS second, list_sort(list_distinct(list_concat(coalesce(la.ids, []), coalesce(lb.ids, [])))) AS ids FROM ({PAIRS}) p JOIN r_components a ON a.track_id = p.lower_id JOIN r_components b ON b.track_id = p.higher_id LEFT JOIN l la ON la.component = a.component LEFT JOIN l lb ON lb.component = b.component) SELECT lower_id, higher_id, first, second, CAST(len(ids) AS BIGINT) AS n_locals, array_to_string(ids, ',') AS locals FROM x WHERE len(ids) > 1")
def merge_conflicts(t: Tables) -> DataFrame:
    return G.merge_conflicts(_pairs(t), t.components, t.final)


@query(f"WITH k AS (SELECT DISTINCT least(a.component, b.component) AS x, greatest(a.component, b.component) AS y FROM r_edges e JOIN r_components a ON a.track_id = e.lower_id JOIN r_components b ON b.track_id = e.higher_id) SELECT p.lower_id, p.higher_id FROM ({PAIRS}) p JOIN r_components a ON a.track_id = p.lower_id JOIN r_components b ON b.track_id = p.higher_id WHERE a.component <> b.component AND NOT EXISTS (SELECT 1 FROM r_edges e WHERE e.lower_id = p.lower_id AND e.higher_id = p.higher_id) AND NOT EXISTS (SELECT 1 FROM k WHERE k.x = least(a.component, b.component) AND k.y = greatest(a.component, b.component))")
def suppressed_pairs(t: Tables) -> DataFrame:
    """Candidate pairs that survive the suppression closure."""
    return G.not_suppressed(_pairs(t), t.components, t.edges)


@query("SELECT DISTINCT p.id AS playlist_id FROM r_playlists p JOIN r_membership m ON m.playlist_id = p.id JOIN r_components c ON c.track_id = m.track_id WHERE p.sync_mode = 'full' AND c.component IN (SELECT component FROM r_components WHERE track_id % 100 = 1)")
def impact_playlists(t: Tables) -> DataFrame:
    return G.impacted_playlists(t.tracks.where("id % 100 = 1").select(F.col("id").alias("track_id")), t.components, t.membership, t.playlists)


@query("SELECT component, CAST(count(DISTINCT local_id) AS BIGINT) AS n_locals FROM r_suggested JOIN r_components USING (track_id) WHERE status = 'approved' GROUP BY component HAVING count(DISTINCT local_id) > 1")
def crowded_components(t: Tables) -> DataFrame:
    """The one-local rule over all approved suggestions, where it is broken."""
    return G.crowded_components(t.components, t.suggested.where("status = 'approved'"))


@query("SELECT e.lower_id, e.higher_id, e.type FROM r_edges e JOIN r_components a ON a.track_id = e.lower_id JOIN r_components b ON b.track_id = e.higher_id WHERE a.component <> b.component ORDER BY e.higher_id - e.lower_id DESC, e.lower_id LIMIT 101")
def list_pending_relationships(t: Tables) -> DataFrame:
    """Stale pairs go before the page is cut, so a page is never short."""
    comp = lambda end, name: t.components.select(F.col("track_id").alias(end), F.col("component").alias(name))
    fresh = t.edges.join(comp("lower_id", "a"), "lower_id").join(comp("higher_id", "b"), "higher_id").where("a <> b")
    return fresh.orderBy((F.col("higher_id") - F.col("lower_id")).desc(), "lower_id").limit(101).select("lower_id", "higher_id", "type")


@query("SELECT e.type, CAST(count(*) AS BIGINT) AS n FROM r_edges e JOIN r_components a ON a.track_id = e.lower_id JOIN r_components b ON b.track_id = e.higher_id WHERE a.component <> b.component GROUP BY e.type")
def pending_relationship_count(t: Tables) -> DataFrame:
    comp = lambda end, name: t.components.select(F.col("track_id").alias(end), F.col("component").alias(name))
    return t.edges.join(comp("lower_id", "a"), "lower_id").join(comp("higher_id", "b"), "higher_id").where("a <> b").groupBy("type").agg(F.count("*").alias("n"))


@query("WITH RECURSIVE n AS (SELECT p_partkey AS id, p_partkey // 4 AS parent_id, CAST(p_partkey % 4 AS BIGINT) AS position FROM part WHERE p_partkey > 0), w AS (SELECT id, 0 AS depth, id AS root FROM n WHERE parent_id NOT IN (SELECT id FROM n) UNION ALL SELECT n.id, w.depth + 1, w.root FROM n JOIN w ON n.parent_id = w.id) SELECT id, depth, root FROM w")
def tree_walk(t: Tables) -> DataFrame:
    nodes = t.parts.where("id > 0").select("id", F.expr("id div 4").alias("parent_id"), (F.col("id") % 4).alias("position"))
    return G.walk_tree(nodes).select("id", "depth", "root")


@query("SELECT e.lower_id, e.higher_id, CASE WHEN ra.local_id IS NOT NULL AND rb.local_id IS NOT NULL AND ra.local_id <> rb.local_id THEN 'different_local_links' ELSE 'none' END AS conflict, ra.local_id AS first_local, rb.local_id AS second_local FROM r_edges e LEFT JOIN r_resolved ra ON ra.track_id = e.lower_id LEFT JOIN r_resolved rb ON rb.track_id = e.higher_id")
def suggestion_context(t: Tables) -> DataFrame:
    side = lambda end, name: t.resolved.select(F.col("track_id").alias(end), F.col("local_id").alias(name))
    both = t.edges.join(side("lower_id", "first_local"), "lower_id", "left").join(side("higher_id", "second_local"), "higher_id", "left")
    return both.select("lower_id", "higher_id", F.when(F.col("first_local") != F.col("second_local"), "different_local_links").otherwise("none").alias("conflict"), "first_local", "second_local")
