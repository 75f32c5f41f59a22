"""Role views: the stored tables seen as playlists, tracks, links and features.

Each role exists twice, as a DataFrame here and as SQL text for the oracle, so that a comparison of results checks both.
"""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

ROLE_SQL = {
    "r_playlists": "SELECT o_orderkey AS id, o_custkey AS account_id, CASE o_orderstatus WHEN 'F' THEN 'full' WHEN 'P' THEN 'match_only' ELSE 'off' END AS sync_mode, o_orderpriority AS title, o_orderdate AS synced_at FROM orders",
    "r_accounts": "SELECT c_custkey AS id, c_mktsegment AS provider, c_name AS display_name FROM customer",
    "r_parts": "SELECT p_partkey AS id, p_name AS title, p_brand AS artist, p_type AS album, CAST(p_size AS BIGINT) * 1000 AS duration_ms, CASE WHEN p_partkey % 11 = 0 THEN 'N/A' WHEN p_partkey % 3 = 0 THEN 'us-abc-24-' || lpad(CAST(p_partkey % 697 AS VARCHAR), 5, '0') ELSE 'USABC24' || lpad(CAST(p_partkey % 697 AS VARCHAR), 5, '0') END AS isrc FROM part",
    "r_tracks": "SELECT * FROM r_parts WHERE id % 5 <> 0",
    "r_local": "SELECT *, artist || '/' || title || ' ' || CAST(id AS VARCHAR) || '.mp3' AS path FROM r_parts WHERE id % 5 = 0",
    "r_membership": "SELECT l_orderkey AS playlist_id, l_partkey AS track_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice) AS BIGINT) AS position FROM lineitem WHERE l_partkey % 5 <> 0",
    "r_suggested": "SELECT l * 1000000000 + s AS id, l AS local_id, s AS track_id, round(1 - d, 6) AS score, CASE f WHEN 'A' THEN 'approved' WHEN 'N' THEN 'pending' ELSE 'rejected' END AS status, CASE WHEN s % 2 = 0 THEN 'tags' ELSE 'isrc' END AS method FROM (SELECT l_suppkey * 5 AS l, l_partkey AS s, max(l_discount) AS d, max(l_returnflag) AS f FROM lineitem WHERE l_partkey % 5 <> 0 GROUP BY 1, 2)",
    "r_final": "SELECT id, id AS local_id, id + 1 AS track_id FROM r_local WHERE id % 10 = 0 AND id + 1 IN (SELECT id FROM r_tracks)",
    "r_edges": "SELECT lower_id, higher_id, type FROM (SELECT id AS lower_id, lead(id) OVER w AS higher_id, CASE WHEN album = lead(album) OVER w THEN 'equivalent' ELSE 'related' END AS type FROM r_tracks WINDOW w AS (PARTITION BY title, artist ORDER BY id)) WHERE higher_id IS NOT NULL",
    "r_features": "SELECT vec_id AS id, embedding AS vector, label AS tag FROM embeddings",
    "r_docs": "SELECT doc_id AS id, sha256(text) AS fingerprint, source AS title, lang AS artist, n_chars AS duration_ms FROM documents",
    "r_events": "SELECT event_id AS id, user_id AS key, ts, event_type, CASE event_type WHEN 'signup' THEN 'searching' WHEN 'view' THEN 'candidates_found' WHEN 'click' THEN 'queued' WHEN 'purchase' THEN 'linked' ELSE 'failed' END AS state, value, props FROM events",
    # Components of the equivalent edges, named by their smallest member; a track without an edge is alone.
    "r_components": "SELECT t.id AS track_id, coalesce(c.component, t.id) AS component FROM r_tracks t LEFT JOIN (WITH RECURSIVE e AS (SELECT lower_id AS a, higher_id AS b FROM r_edges WHERE type = 'equivalent' UNION SELECT higher_id, lower_id FROM r_edges WHERE type = 'equivalent'), walk AS (SELECT a AS node, a AS reached FROM e UNION SELECT w.node, e.b FROM walk w JOIN e ON e.a = w.reached) SELECT node, min(reached) AS component FROM walk GROUP BY node) c ON c.node = t.id",
    # A direct link wins; else the only local of the component, through its first link.
    "r_resolved": "SELECT t.id AS track_id, coalesce(d.local_id, s.local_id) AS local_id, CASE WHEN d.local_id IS NOT NULL THEN 'direct' WHEN s.local_id IS NOT NULL THEN 'equivalent' END AS source FROM r_tracks t LEFT JOIN r_final d ON d.track_id = t.id LEFT JOIN r_components c ON c.track_id = t.id LEFT JOIN (SELECT component, min(f.local_id) AS local_id FROM r_final f JOIN r_components USING (track_id) GROUP BY component HAVING count(DISTINCT f.local_id) = 1) s ON s.component = c.component",
    "r_first_pending": "SELECT local_id, min(id) AS id FROM r_suggested WHERE status = 'pending' GROUP BY local_id",
    "r_library": "SELECT l.id, l.path, coalesce(ft.title, pt.title, l.path, '') AS title, coalesce(ft.artist, pt.artist, '') AS artist, CASE WHEN f.id IS NOT NULL THEN 'linked' WHEN p.id IS NOT NULL THEN 'pending' ELSE 'unlinked' END AS link_status, f.id AS final_id, p.id AS pending_id, p.score AS pending_score FROM r_local l LEFT JOIN r_final f ON f.local_id = l.id LEFT JOIN r_tracks ft ON ft.id = f.track_id LEFT JOIN r_first_pending fp ON fp.local_id = l.id LEFT JOIN r_suggested p ON p.id = fp.id LEFT JOIN r_tracks pt ON pt.id = p.track_id",
}


def with_roles(sql: str) -> str:
    """``sql`` with the roles that it names, and those that they name, as common table expressions in front."""
    needed: dict[str, None] = {}

    def visit(text: str) -> None:
        for name in dict.fromkeys(re.findall(r"\br_\w+", text)):
            if name in ROLE_SQL and name not in needed:
                visit(ROLE_SQL[name])
                needed[name] = None

    visit(sql)
    heads = [f"{n} AS MATERIALIZED ({ROLE_SQL[n]})" for n in needed]
    body = sql.strip()
    if body[:5].upper() == "WITH ":
        rest = body[5:]
        recursive = rest[:10].upper() == "RECURSIVE "
        return f"WITH {'RECURSIVE ' * recursive}{', '.join([*heads, rest[10:] if recursive else rest])}"
    return f"WITH {', '.join(heads)} {body}" if heads else body


#: Stored rows for each task of a shuffle of a large table, and the least number of such tasks. They change no result.
TASK_ROWS, LEAST_TASKS = 1_000_000, 8


class Tables:
    """Lazy role DataFrames over one folder of Parquet tables."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def dealt(self, rows: DataFrame, name: str, *keys: str) -> DataFrame:
        """``rows`` of the stored table ``name`` by ``keys`` in as many tasks as its rows ask for; those of a small table as they are.

        Spark merges shuffled partitions by their compressed bytes, which few-valued columns keep small, so a task's hash tables would grow large.
        """
        n = -(-self.raw(name).count() // TASK_ROWS)
        return rows.repartition(n, *keys) if n > LEAST_TASKS else rows

    @cached_property
    def playlists(self) -> DataFrame:
        mode = F.when(F.col("o_orderstatus") == "F", "full").when(F.col("o_orderstatus") == "P", "match_only").otherwise("off")
        return self.raw("orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("account_id"), mode.alias("sync_mode"), F.col("o_orderpriority").alias("title"), F.col("o_orderdate").alias("synced_at"))

    @cached_property
    def accounts(self) -> DataFrame:
        return self.raw("customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("provider"), F.col("c_name").alias("display_name"))

    @cached_property
    def parts(self) -> DataFrame:
        number = F.lpad((F.col("p_partkey") % 697).cast("string"), 5, "0")
        code = F.when(F.col("p_partkey") % 11 == 0, "N/A").when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("us-abc-24-"), number)).otherwise(F.concat(F.lit("USABC24"), number))
        return self.raw("part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), F.col("p_brand").alias("artist"), F.col("p_type").alias("album"), (F.col("p_size").cast("long") * 1000).alias("duration_ms"), code.alias("isrc"))

    @cached_property
    def tracks(self) -> DataFrame:
        return self.parts.where("id % 5 <> 0")

    @cached_property
    def local(self) -> DataFrame:
        return self.parts.where("id % 5 = 0").withColumn("path", F.concat("artist", F.lit("/"), "title", F.lit(" "), F.col("id").cast("string"), F.lit(".mp3")))

    @cached_property
    def membership(self) -> DataFrame:
        order = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice")
        rows = self.raw("lineitem").where("l_partkey % 5 <> 0").withColumn("position", F.row_number().over(order).cast("long"))
        return rows.select(F.col("l_orderkey").alias("playlist_id"), F.col("l_partkey").alias("track_id"), "position")

    @cached_property
    def suggested(self) -> DataFrame:
        rows = self.raw("lineitem").where("l_partkey % 5 <> 0").select((F.col("l_suppkey") * 5).alias("local_id"), F.col("l_partkey").alias("track_id"), "l_discount", "l_returnflag")
        # The greatest flag by its place among those that count, as Spark sorts all rows for the greatest of a text but hashes them for that of a number.
        flag = F.col("l_returnflag")
        rows = rows.withColumn("f", F.when(flag < "A", 0).when(flag == "A", 1).when(flag < "N", 2).when(flag == "N", 3).when(flag > "N", 4)).drop("l_returnflag")
        pairs = self.dealt(rows, "lineitem", "local_id", "track_id").groupBy("local_id", "track_id").agg(F.max("l_discount").alias("d"), F.max("f").alias("f"))
        status = F.when(F.col("f") == 1, "approved").when(F.col("f") == 3, "pending").otherwise("rejected")
        return pairs.select((F.col("local_id") * 1_000_000_000 + F.col("track_id")).alias("id"), "local_id", "track_id", F.round(1 - F.col("d"), 6).alias("score"), status.alias("status"), F.when(F.col("track_id") % 2 == 0, "tags").otherwise("isrc").alias("method"))

    @cached_property
    def final(self) -> DataFrame:
        links = self.local.where("id % 10 = 0").select("id", F.col("id").alias("local_id"), (F.col("id") + 1).alias("track_id"))
        return links.join(self.tracks.select(F.col("id").alias("track_id")), "track_id", "left_semi").select("id", "local_id", "track_id")

    @cached_property
    def edges(self) -> DataFrame:
        w = W.partitionBy("title", "artist").orderBy("id")
        kind = F.when(F.col("album") == F.lead("album").over(w), "equivalent").otherwise("related")
        return self.tracks.select(F.col("id").alias("lower_id"), F.lead("id").over(w).alias("higher_id"), kind.alias("type")).where("higher_id IS NOT NULL")

    @cached_property
    def features(self) -> DataFrame:
        return self.raw("embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), F.col("label").alias("tag"))

    @cached_property
    def docs(self) -> DataFrame:
        return self.raw("documents").select(F.col("doc_id").alias("id"), F.sha2("text", 256).alias("fingerprint"), F.col("source").alias("title"), F.col("lang").alias("artist"), F.col("n_chars").alias("duration_ms"))

    @cached_property
    def events(self) -> DataFrame:
        state = F.when(F.col("event_type") == "signup", "searching").when(F.col("event_type") == "view", "candidates_found").when(F.col("event_type") == "click", "queued").when(F.col("event_type") == "purchase", "linked").otherwise("failed")
        return self.raw("events").select(F.col("event_id").alias("id"), F.col("user_id").alias("key"), "ts", "event_type", state.alias("state"), "value", "props")

    @cached_property
    def components(self) -> DataFrame:
        from tonearm.operators.graph import component_of_each

        return component_of_each(self.tracks.select(F.col("id").alias("track_id")), self.edges)

    @cached_property
    def resolved(self) -> DataFrame:
        from tonearm.operators.graph import resolve_links

        return resolve_links(self.components, self.final)

    @cached_property
    def library(self) -> DataFrame:
        from tonearm.operators.relational import library_rows

        return library_rows(self.local, self.final, self.tracks, self.suggested)
