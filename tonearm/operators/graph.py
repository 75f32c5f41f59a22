"""The relationship graph: components, link resolution, conflicts, suppression, impact, trees."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonearm.operators.components import connected_components


def component_of_each(tracks: DataFrame, edges: DataFrame) -> DataFrame:
    """(track_id, component) for every track: the smallest track it reaches over ``equivalent`` edges, itself if none."""
    parts = connected_components(edges.where(F.col("type") == "equivalent"), "lower_id", "higher_id")
    return tracks.join(parts.withColumnRenamed("node", "track_id"), "track_id", "left").select("track_id", F.coalesce("component", "track_id").alias("component"))


def single_local(components: DataFrame, links: DataFrame) -> DataFrame:
    """(component, local_id) of the components whose links name exactly one local track; the first link by (track, link) gives it."""
    held = links.join(components, "track_id").groupBy("component").agg(F.min("local_id").alias("least"), F.max("local_id").alias("most"), F.min_by("local_id", F.struct("track_id", "id")).alias("local_id"))
    return held.where("least = most").select("component", "local_id")


def resolve_links(components: DataFrame, links: DataFrame) -> DataFrame:
    """(track_id, local_id, source): a direct link wins, then the only local of the component, else null."""
    direct = links.select("track_id", F.col("local_id").alias("direct"))
    shared = single_local(components, links).withColumnRenamed("local_id", "shared")
    both = components.join(direct, "track_id", "left").join(shared, "component", "left")
    return both.select("track_id", F.coalesce("direct", "shared").alias("local_id"), F.when(F.col("direct").isNotNull(), "direct").when(F.col("shared").isNotNull(), "equivalent").alias("source"))


def merge_conflicts(pairs: DataFrame, components: DataFrame, links: DataFrame) -> DataFrame:
    """For candidate merges (lower_id, higher_id): the two components and how many local tracks their union would have, if over one."""
    locals_of = links.join(components, "track_id").groupBy("component").agg(F.collect_set("local_id").alias("locals"))
    side = lambda end, name: components.select(F.col("track_id").alias(end), F.col("component").alias(name))
    both = pairs.join(side("lower_id", "first"), "lower_id").join(side("higher_id", "second"), "higher_id")
    for name in ("first", "second"):
        both = both.join(locals_of.select(F.col("component").alias(name), F.col("locals").alias(f"{name}_locals")), name, "left")
    empty = F.array().cast("array<bigint>")
    union = F.array_sort(F.array_union(F.coalesce("first_locals", empty), F.coalesce("second_locals", empty)))
    return both.withColumn("locals", union).where(F.size("locals") > 1).select("lower_id", "higher_id", "first", "second", F.size("locals").cast("long").alias("n_locals"), F.array_join(F.transform("locals", lambda x: x.cast("string")), ",").alias("locals"))


def _between(pairs: DataFrame, components: DataFrame) -> DataFrame:
    """``pairs`` with the components ``x`` and ``y`` of their ends, and in order as ``a`` and ``b``."""
    comp = lambda d, end, name: d.join(components.select(F.col("track_id").alias(end), F.col("component").alias(name)), end, "left").withColumn(name, F.coalesce(name, end))
    return comp(comp(pairs, "lower_id", "x"), "higher_id", "y").withColumn("a", F.least("x", "y")).withColumn("b", F.greatest("x", "y"))


def suppressing(components: DataFrame, edges: DataFrame, decided: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """What :func:`not_suppressed` leaves out: pairs of components (a, b), a <= b, and single pairs (lower_id, higher_id)."""
    own = edges.select("lower_id", "higher_id")
    final, barring = own, own
    if decided is not None:
        final = own.union(decided.where(F.col("status").isin("accepted", "rejected")).select("lower_id", "higher_id"))
        barring = own.union(decided.where("status = 'rejected'").select("lower_id", "higher_id"))
    return _between(barring, components).select("a", "b").distinct(), final


def outside(pairs: DataFrame, components: DataFrame, known: DataFrame, final: DataFrame) -> DataFrame:
    """``pairs`` without those within one component, between components of ``known``, or in ``final``."""
    return _between(pairs, components).where("x <> y").join(final, ["lower_id", "higher_id"], "left_anti").join(known, ["a", "b"], "left_anti").select(*pairs.columns)


def not_suppressed(pairs: DataFrame, components: DataFrame, edges: DataFrame, decided: DataFrame | None = None) -> DataFrame:
    """Candidate pairs (lower_id, higher_id) that are not already an edge, nor within one component, nor joined by an edge between their components.

    ``decided`` (lower_id, higher_id, status) are stored suggestions: pairs ``accepted`` or ``rejected`` before are left out, and so are those between the components of a rejected pair.
    """
    return outside(pairs, components, *suppressing(components, edges, decided))


def impacted_playlists(changed: DataFrame, components: DataFrame, membership: DataFrame, playlists: DataFrame) -> DataFrame:
    """Ids of the fully synced playlists that hold any track of a component with a changed track."""
    touched = components.join(components.join(changed.select("track_id"), "track_id", "left_semi").select("component").distinct(), "component", "left_semi").select("track_id")
    held = membership.join(touched, "track_id", "left_semi").select("playlist_id").distinct()
    return playlists.where(F.col("sync_mode") == "full").join(held.withColumnRenamed("playlist_id", "id"), "id", "left_semi").select(F.col("id").alias("playlist_id"))


def crowded_components(components: DataFrame, links: DataFrame) -> DataFrame:
    """Components with more than one linked local track, which break the one-local rule."""
    return links.join(components, "track_id").groupBy("component").agg(F.countDistinct("local_id").alias("n_locals")).where("n_locals > 1")


def with_children(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """``stored`` (id, parent_id, name) with new nodes (parent, name) under the stored nodes of that name, numbered on from the greatest id by parent, then name.

    Nodes whose parent is not stored are left out; of stored nodes with one name the smallest id is the parent; a child that its parent has already is not added again.
    """
    from tonearm.operators.ranking import numbered

    parents = stored.groupBy(F.col("name").alias("parent")).agg(F.min("id").alias("parent_id"))
    new = incoming.distinct().join(parents, "parent").select("parent_id", "name").join(stored.select("parent_id", "name"), ["parent_id", "name"], "left_anti")
    last = stored.agg(F.max("id")).first()[0] or 0
    ranked = numbered(new, [F.col("parent_id"), F.col("name")], "k").select((F.col("k") + last).cast("long").alias("id"), "parent_id", "name")
    return stored.select("id", "parent_id", "name").unionByName(ranked)


def walk_tree(nodes: DataFrame, max_depth: int = 20) -> DataFrame:
    """(id, depth, path, root) of a forest (id, parent_id, position), depth first by path; a node without a stored parent is a root.

    One join a level; ``path`` sorts as the walk goes. Raises if a level past ``max_depth`` has nodes, as a cycle would.
    """
    step = lambda pos, node: F.concat(F.lpad(pos.cast("string"), 6, "0"), F.lit("."), F.lpad(node.cast("string"), 12, "0"))
    known = nodes.select(F.col("id").alias("parent_id"))
    level = nodes.join(known, "parent_id", "left_anti").select("id", F.lit(0).alias("depth"), step(F.col("position"), F.col("id")).alias("path"), F.col("id").alias("root"))
    out = level
    for depth in range(1, max_depth + 1):
        above = level.select(F.col("id").alias("parent_id"), F.col("path").alias("above"), "root")
        level = nodes.join(above, "parent_id").select("id", F.lit(depth).alias("depth"), F.concat("above", F.lit("/"), step(F.col("position"), F.col("id"))).alias("path"), "root").checkpoint()
        if level.isEmpty():
            return out
        out = out.unionByName(level)
    raise ValueError(f"tree deeper than {max_depth} levels, or a cycle")
