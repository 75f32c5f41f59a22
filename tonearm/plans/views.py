"""Composite read views."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tonearm.operators import relational as R
from tonearm.plans.registry import query
from tonearm.tables import Tables

FIRST_PENDING = "SELECT track_id, min(id) AS id FROM r_suggested WHERE status = 'pending' GROUP BY track_id"


def first_pending_of_track(t: Tables) -> DataFrame:
    p = t.suggested.where("status = 'pending'").groupBy("track_id").agg(F.min_by(F.struct("id", "local_id"), "id").alias("p"))
    return p.select("track_id", F.col("p.id").alias("proposal_id"), F.col("p.local_id").alias("proposed"))


@query(f"SELECT m.playlist_id, m.position, m.track_id, CASE WHEN r.local_id IS NOT NULL THEN 'linked' WHEN p.id IS NOT NULL THEN 'pending' ELSE 'unlinked' END AS status, CASE WHEN r.local_id IS NULL THEN p.id END AS proposal_id, coalesce(r.local_id, s.local_id) AS local_id FROM r_membership m LEFT JOIN r_resolved r ON r.track_id = m.track_id LEFT JOIN ({FIRST_PENDING}) p ON p.track_id = m.track_id LEFT JOIN r_suggested s ON s.id = p.id")
def playlist_tracks_status(t: Tables) -> DataFrame:
    """Rows in playlist order: linked hides the proposal, pending shows the proposal's local track."""
    per_track = t.resolved.join(first_pending_of_track(t), "track_id", "left")
    linked, pending = F.col("local_id").isNotNull(), F.col("proposal_id").isNotNull()
    state = per_track.select("track_id", F.when(linked, "linked").when(pending, "pending").otherwise("unlinked").alias("status"), F.when(~linked, F.col("proposal_id")).alias("proposal_id"), F.coalesce("local_id", "proposed").alias("local_id"))
    return t.membership.join(state, "track_id", "left").select("playlist_id", "position", "track_id", F.coalesce("status", F.lit("unlinked")).alias("status"), "proposal_id", "local_id")


@query("SELECT x.id, x.title, CASE WHEN r.local_id IS NOT NULL THEN 'linked' WHEN EXISTS (SELECT 1 FROM r_suggested s WHERE s.track_id = x.id AND s.status = 'pending') THEN 'pending' ELSE 'unlinked' END AS status FROM (SELECT id, title FROM r_tracks WHERE title ILIKE '%red%' ORDER BY title, id LIMIT 40) x LEFT JOIN r_resolved r ON r.track_id = x.id")
def track_search_status(t: Tables) -> DataFrame:
    """The page is cut first; only its rows meet the link tables."""
    found = t.tracks.where(R.matches(["title"], "red")).orderBy("title", "id").limit(40).select(F.col("id").alias("track_id"), "title")
    pending = t.suggested.where("status = 'pending'").select("track_id", F.lit(1).alias("p")).distinct()
    both = F.broadcast(found).join(t.resolved, "track_id", "left").join(pending, "track_id", "left")
    return both.select(F.col("track_id").alias("id"), "title", F.when(F.col("local_id").isNotNull(), "linked").when(F.col("p").isNotNull(), "pending").otherwise("unlinked").alias("status"))


@query("SELECT t.id, r.local_id, (SELECT count(*) - 1 FROM r_components c2 WHERE c2.component = c.component) AS peers, CAST(coalesce(m.n, 0) AS BIGINT) AS appearances, CAST(coalesce(s.n, 0) AS BIGINT) AS pending FROM r_tracks t JOIN r_components c ON c.track_id = t.id LEFT JOIN r_resolved r ON r.track_id = t.id LEFT JOIN (SELECT track_id, count(DISTINCT playlist_id) AS n FROM r_membership GROUP BY 1) m ON m.track_id = t.id LEFT JOIN (SELECT track_id, count(*) AS n FROM r_suggested WHERE status = 'pending' GROUP BY 1) s ON s.track_id = t.id")
def track_detail(t: Tables) -> DataFrame:
    size = t.components.withColumn("peers", F.count("*").over(W.partitionBy("component")) - 1).select("track_id", "peers")
    seen = t.membership.groupBy("track_id").agg(F.countDistinct("playlist_id").alias("appearances"))
    pending = t.suggested.where("status = 'pending'").groupBy("track_id").agg(F.count("*").alias("pending"))
    both = t.tracks.select(F.col("id").alias("track_id")).join(size, "track_id").join(t.resolved, "track_id", "left").join(seen, "track_id", "left").join(pending, "track_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return both.select(F.col("track_id").alias("id"), "local_id", "peers", zero("appearances"), zero("pending"))


@query("SELECT m.track_id, p.title, p.id AS playlist_id, m.position, CAST(row_number() OVER (PARTITION BY m.track_id ORDER BY p.title, p.id, m.position) AS BIGINT) AS n FROM r_membership m JOIN r_playlists p ON p.id = m.playlist_id")
def track_appearances(t: Tables) -> DataFrame:
    rows = t.membership.join(t.playlists.select(F.col("id").alias("playlist_id"), "title"), "playlist_id")
    return rows.select("track_id", "title", "playlist_id", "position", F.row_number().over(W.partitionBy("track_id").orderBy("title", "playlist_id", "position")).cast("long").alias("n"))


@query("SELECT s.track_id, s.id, l.path, s.score, CAST(row_number() OVER (PARTITION BY s.track_id ORDER BY s.score DESC, s.id) AS BIGINT) AS n FROM r_suggested s LEFT JOIN r_local l ON l.id = s.local_id WHERE s.status = 'pending'")
def pending_locals_of_track(t: Tables) -> DataFrame:
    rows = t.suggested.where("status = 'pending'").join(t.local.select(F.col("id").alias("local_id"), "path"), "local_id", "left")
    return rows.select("track_id", "id", "path", "score", F.row_number().over(W.partitionBy("track_id").orderBy(F.desc("score"), "id")).cast("long").alias("n"))


@query("SELECT id, unnest(['acctbal', 'name', 'nation', 'segment']) AS key, unnest([CAST(CAST(c_acctbal * 100 AS BIGINT) AS VARCHAR), c_name, CAST(c_nationkey AS VARCHAR), c_mktsegment]) AS value FROM (SELECT *, c_custkey AS id FROM customer)")
def unpivot_detail(t: Tables) -> DataFrame:
    c = t.raw("customer").select(F.col("c_custkey").alias("id"), F.bround(F.col("c_acctbal") * 100).cast("long").alias("acctbal"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment"))
    return R.unpivot(c, "id")


@query("SELECT id, coalesce(nullif(title, ''), path) AS title, nullif(duration_ms, 0) AS duration_ms, coalesce(nullif(artist, 'Brand#1'), 'Unknown artist') AS artist FROM r_local")
def display_rows(t: Tables) -> DataFrame:
    """Fall-backs that take empty and zero for missing, unlike COALESCE."""
    return t.local.select("id", F.coalesce(F.nullif("title", F.lit("")), "path").alias("title"), F.nullif("duration_ms", F.lit(0)).alias("duration_ms"), F.coalesce(F.nullif("artist", F.lit("Brand#1")), F.lit("Unknown artist")).alias("artist"))


@query("SELECT CAST((SELECT count(*) FROM r_tracks) AS BIGINT) AS tracks, CAST((SELECT count(*) FROM r_local l WHERE l.id NOT IN (SELECT local_id FROM r_final)) AS BIGINT) AS unlinked, CAST((SELECT count(*) FROM r_suggested s WHERE s.status = 'pending' AND s.local_id NOT IN (SELECT local_id FROM r_final)) AS BIGINT) AS proposals, CAST((SELECT count(*) FROM r_edges) AS BIGINT) AS edges, CAST((SELECT count(*) FROM r_playlists WHERE sync_mode = 'full') AS BIGINT) AS full_playlists")
def dashboard(t: Tables) -> DataFrame:
    """Five counters, each an aggregate of one row; the joins are of single rows."""
    linked = t.final.select("local_id")
    one = [t.tracks.agg(F.count("*").alias("tracks")), t.local.withColumnRenamed("id", "local_id").join(linked, "local_id", "left_anti").agg(F.count("*").alias("unlinked")), t.suggested.where("status = 'pending'").join(linked, "local_id", "left_anti").agg(F.count("*").alias("proposals")), t.edges.agg(F.count("*").alias("edges")), t.playlists.agg(F.count_if(F.col("sync_mode") == "full").alias("full_playlists"))]
    out = one[0]
    for d in one[1:]:
        out = out.join(d, F.lit(True))
    return out


@query("SELECT l.id FROM r_local l WHERE l.id NOT IN (SELECT local_id FROM r_final) AND l.id NOT IN (SELECT key FROM r_events WHERE event_type = 'click' AND value > 10)")
def rematch_targets(t: Tables) -> DataFrame:
    queued = t.events.where("event_type = 'click' AND value > 10").select(F.col("key").alias("id")).distinct()
    return t.local.select("id").join(t.final.select(F.col("local_id").alias("id")), "id", "left_anti").join(queued, "id", "left_anti")


@query("SELECT id, CASE WHEN regexp_matches(s, 'error|reject|cancel|fail') THEN 'failed' WHEN regexp_matches(s, 'succeeded|completed|purchase') THEN 'downloaded' WHEN regexp_matches(s, 'inprogress|initializing|click') THEN 'downloading' ELSE 'queued' END AS state FROM (SELECT id, lower(event_type) AS s FROM r_events)")
def transfer_state(t: Tables) -> DataFrame:
    s = F.lower("event_type")
    return t.events.select("id", F.when(s.rlike("error|reject|cancel|fail"), "failed").when(s.rlike("succeeded|completed|purchase"), "downloaded").when(s.rlike("inprogress|initializing|click"), "downloading").otherwise("queued").alias("state"))


@query("SELECT local_id, CAST(count(*) AS BIGINT) AS n, string_agg(CAST(id AS VARCHAR), ',' ORDER BY score DESC, id) AS ids FROM (SELECT s.*, l.path, t.title FROM r_suggested s JOIN r_local l ON l.id = s.local_id JOIN r_tracks t ON t.id = s.track_id WHERE s.status = 'pending' AND s.method = 'tags' AND s.score > 0.85) WHERE contains(lower(path || ' ' || title), 'blue') GROUP BY local_id")
def proposal_groups(t: Tables) -> DataFrame:
    """Band, method and substring filters, then groups by local track in order of score."""
    rows = t.suggested.where("status = 'pending' AND method = 'tags' AND score > 0.85").join(t.local.select(F.col("id").alias("local_id"), "path"), "local_id").join(t.tracks.select(F.col("id").alias("track_id"), "title"), "track_id")
    hit = rows.where(F.lower(F.concat_ws(" ", "path", "title")).contains("blue"))
    g = hit.groupBy("local_id").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "id"))).alias("x"))
    return g.select("local_id", "n", F.array_join(F.transform("x", lambda v: v["id"].cast("string")), ",").alias("ids"))


@query("SELECT p.id AS playlist_id, string_agg(CASE WHEN l.id IS NULL THEN '' ELSE '#EXTINF:' || CAST(l.duration_ms // 1000 AS VARCHAR) || ',' || l.artist || ' - ' || l.title || chr(10) || l.path || chr(10) END, '' ORDER BY m.position) AS body, CAST(sum(CASE WHEN l.id IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS skipped FROM r_playlists p JOIN r_membership m ON m.playlist_id = p.id LEFT JOIN r_resolved r ON r.track_id = m.track_id LEFT JOIN r_local l ON l.id = r.local_id WHERE p.sync_mode = 'full' GROUP BY p.id")
def m3u_bodies(t: Tables) -> DataFrame:
    from tonearm.sources.playlists import m3u_text

    full = t.membership.join(t.playlists.where("sync_mode = 'full'").select(F.col("id").alias("playlist_id")), "playlist_id", "left_semi")
    entries = full.join(t.resolved, "track_id", "left").join(t.local.select(F.col("id").alias("local_id"), "path", "artist", "title", "duration_ms"), "local_id", "left")
    text = m3u_text(entries)
    return text.select("playlist_id", F.regexp_replace("text", "^#EXTM3U\n", "").alias("body"), "skipped")


@query("SELECT p.id, CASE WHEN count(DISTINCT s.local_id) = 0 THEN 'none' WHEN count(DISTINCT s.local_id) = 1 THEN 'one' ELSE 'conflict' END AS kind, CASE WHEN count(DISTINCT s.local_id) = 1 THEN min(s.local_id) END AS local_id FROM r_tracks p LEFT JOIN r_suggested s ON s.track_id = p.id AND s.status = 'approved' AND s.score >= 0.99 GROUP BY p.id")
def ambiguity(t: Tables) -> DataFrame:
    """No, one, or several answers."""
    s = t.suggested.where("status = 'approved' AND score >= 0.99").groupBy(F.col("track_id").alias("id")).agg(F.countDistinct("local_id").alias("n"), F.min("local_id").alias("least"))
    n = F.coalesce("n", F.lit(0))
    return t.tracks.select("id").join(s, "id", "left").select("id", F.when(n == 0, "none").when(n == 1, "one").otherwise("conflict").alias("kind"), F.when(n == 1, F.col("least")).alias("local_id"))


@query("SELECT f.id, f.local_id, f.track_id, m.playlist_id, m.account_id FROM r_final f LEFT JOIN (SELECT * FROM (SELECT m.track_id, p.id AS playlist_id, p.account_id, row_number() OVER (PARTITION BY m.track_id ORDER BY p.account_id, p.id) AS n FROM r_membership m JOIN r_playlists p ON p.id = m.playlist_id) WHERE n = 1) m ON m.track_id = f.track_id")
def rescue_source(t: Tables) -> DataFrame:
    """Each link with the first playlist, by account then id, that holds its track; the pick is a partial aggregation."""
    held = t.membership.join(t.final.select("track_id"), "track_id", "left_semi").join(t.playlists.select(F.col("id").alias("playlist_id"), "account_id"), "playlist_id")
    first = held.groupBy("track_id").agg(F.min(F.struct("account_id", "playlist_id")).alias("x"))
    return t.final.join(first, "track_id", "left").select("id", "local_id", "track_id", "x.playlist_id", "x.account_id")


@query("SELECT o.id, o.account_id, CASE WHEN p.id IS NOT NULL THEN 'proposal_available' ELSE o.sync_mode END AS status FROM (SELECT id, account_id, sync_mode FROM r_playlists) o LEFT JOIN (SELECT DISTINCT local_id AS id FROM r_suggested WHERE status = 'pending') p ON p.id = o.id")
def derived_status(t: Tables) -> DataFrame:
    """A pending proposal overrides the stored status."""
    pending = t.suggested.where("status = 'pending'").select(F.col("local_id").alias("id"), F.lit(True).alias("p")).distinct()
    return t.playlists.join(pending, "id", "left").select("id", "account_id", F.when(F.col("p"), "proposal_available").otherwise(F.col("sync_mode")).alias("status"))


@query("SELECT CAST(sum(CASE WHEN state <> 'linked' THEN 1 ELSE 0 END) AS BIGINT) AS open, CAST((SELECT count(*) FROM r_tracks t WHERE t.id NOT IN (SELECT key FROM r_events) AND t.id < 1000) AS BIGINT) AS unsearched FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ts DESC, id DESC) AS n FROM r_events) WHERE n = 1")
def unlinked_counter(t: Tables) -> DataFrame:
    last = t.events.groupBy("key").agg(F.max_by("state", F.struct("ts", "id")).alias("state"))
    unsearched = t.tracks.where("id < 1000").select(F.col("id").alias("key")).join(t.events.select("key").distinct(), "key", "left_anti").agg(F.count("*").alias("unsearched"))
    return last.agg(F.count_if(F.col("state") != "linked").alias("open")).join(unsearched, F.lit(True))


@query("SELECT f, CAST(count(*) AS BIGINT) AS n, CAST(sum(attempts) AS BIGINT) AS attempts FROM (SELECT user_id, max(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) = 0 AS f, count(*) AS attempts FROM events GROUP BY user_id) GROUP BY f")
def ignored_split(t: Tables) -> DataFrame:
    per = t.events.groupBy("key").agg((F.max((F.col("event_type") == "error").cast("int")) == 0).alias("f"), F.count("*").alias("attempts"))
    return per.groupBy("f").agg(F.count("*").alias("n"), F.sum("attempts").alias("attempts"))
