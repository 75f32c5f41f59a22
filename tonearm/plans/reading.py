"""Scans, predicates, joins, aggregates, windows, paging and set operations over the role tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tonearm.operators import relational as R
from tonearm.operators.ranking import numbered
from tonearm.plans.registry import query
from tonearm.storage import joinable
from tonearm.tables import Tables

ACTIVE = ("full", "match_only")


@query("SELECT m.playlist_id, CAST(count(*) AS BIGINT) AS n_tracks, CAST(count(DISTINCT m.track_id) AS BIGINT) AS n_distinct, CAST(sum(CASE WHEN r.local_id IS NOT NULL THEN 1 ELSE 0 END) AS BIGINT) AS linked, CAST(sum(CASE WHEN r.local_id IS NULL AND p.track_id IS NOT NULL THEN 1 ELSE 0 END) AS BIGINT) AS pending, CAST(sum(CASE WHEN r.local_id IS NULL AND p.track_id IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS unlinked FROM r_membership m LEFT JOIN r_resolved r ON r.track_id = m.track_id LEFT JOIN (SELECT DISTINCT track_id FROM r_suggested WHERE status = 'pending') p ON p.track_id = m.track_id GROUP BY m.playlist_id")
def playlist_coverage(t: Tables) -> DataFrame:
    """Linked, pending and unlinked rows per playlist: track states are settled once per track, then counted."""
    pending = t.suggested.where("status = 'pending'").select("track_id", F.lit(1).alias("p")).distinct()
    state = t.resolved.join(pending, "track_id", "left").select("track_id", F.when(F.col("local_id").isNotNull(), "linked").when(F.col("p").isNotNull(), "pending").otherwise("unlinked").alias("s"))
    rows = t.dealt(t.dealt(t.membership, "lineitem", "track_id").join(state, "track_id", "left"), "lineitem", "playlist_id")
    of = lambda s: F.count_if(F.coalesce("s", F.lit("unlinked")) == s)
    return rows.groupBy("playlist_id").agg(F.count("*").alias("n_tracks"), F.countDistinct("track_id").alias("n_distinct"), of("linked").alias("linked"), of("pending").alias("pending"), of("unlinked").alias("unlinked"))


@query("SELECT id, title, artist, album, duration_ms FROM r_tracks")
def track_scan(t: Tables) -> DataFrame:
    return t.tracks.select("id", "title", "artist", "album", "duration_ms")


@query("SELECT id, title FROM r_parts WHERE id = 77")
def point_lookup(t: Tables) -> DataFrame:
    return t.parts.where("id = 77").select("id", "title").limit(2)


@query("SELECT f.id, f.local_id, f.track_id FROM r_final f WHERE f.local_id IN (SELECT DISTINCT local_id FROM r_suggested WHERE status = 'approved')")
def batched_lookup(t: Tables) -> DataFrame:
    """Many keys at once: a semi join in place of a statement per key."""
    return t.final.join(t.suggested.where("status = 'approved'").select("local_id").distinct(), "local_id", "left_semi").select("id", "local_id", "track_id")


@query("SELECT * FROM r_library")
def library_rows(t: Tables) -> DataFrame:
    return t.library


@query("SELECT CAST(count(*) AS BIGINT) AS total, CAST(coalesce(sum(CASE WHEN link_status = 'linked' THEN 1 ELSE 0 END), 0) AS BIGINT) AS linked, CAST(coalesce(sum(CASE WHEN link_status = 'pending' THEN 1 ELSE 0 END), 0) AS BIGINT) AS pending, CAST(count(*) - coalesce(sum(CASE WHEN link_status IN ('linked', 'pending') THEN 1 ELSE 0 END), 0) AS BIGINT) AS unlinked FROM r_library")
def library_stats(t: Tables) -> DataFrame:
    of = lambda *s: F.count_if(F.col("link_status").isin(*s))
    return t.library.agg(F.count("*").alias("total"), of("linked").alias("linked"), of("pending").alias("pending"), (F.count("*") - of("linked", "pending")).alias("unlinked"))


@query("SELECT id, title, link_status FROM r_library WHERE title ILIKE '%blue%' OR artist ILIKE '%blue%' OR path ILIKE '%blue%' ORDER BY lower(title), id LIMIT 51")
def library_page_first(t: Tables) -> DataFrame:
    found = t.library.where(R.matches(["title", "artist", "path"], "blue"))
    return R.page(found, F.lower("title"), limit=50).select("id", "title", "link_status")


@query("SELECT id, title, link_status FROM r_library WHERE lower(title) > 'm' OR (lower(title) = 'm' AND id > 100) ORDER BY lower(title), id LIMIT 101")
def library_page_next(t: Tables) -> DataFrame:
    cursor = R.decode_cursor(R.encode_cursor(sort="title", direction="asc", value="m", id=100), sort="title", direction="asc")
    return R.page(t.library, F.lower("title"), after=(cursor["value"], cursor["id"])).select("id", "title", "link_status")


@query("SELECT id, title, pending_score FROM r_library WHERE coalesce(pending_score, -1) < 0.99 OR (coalesce(pending_score, -1) = 0.99 AND id > 50) ORDER BY coalesce(pending_score, -1) DESC, id LIMIT 101")
def library_page_desc(t: Tables) -> DataFrame:
    return R.page(t.library, F.coalesce("pending_score", F.lit(-1.0)), descending=True, after=(0.99, 50)).select("id", "title", "pending_score")


def _open_proposals(t: Tables) -> DataFrame:
    return t.suggested.where("status = 'pending'").join(t.final.select("local_id"), "local_id", "left_anti")


PROPOSALS = "SELECT s.* FROM r_suggested s WHERE s.status = 'pending' AND NOT EXISTS (SELECT 1 FROM r_final f WHERE f.local_id = s.local_id)"


@query(f"SELECT id, score, CASE WHEN score > 0.85 THEN 'high' WHEN score >= 0.5 THEN 'medium' ELSE 'low' END AS band FROM ({PROPOSALS}) ORDER BY score DESC, id LIMIT 101")
def proposal_queue(t: Tables) -> DataFrame:
    return R.page(_open_proposals(t), F.col("score"), descending=True).select("id", "score", R.band(F.col("score")).alias("band"))


@query(f"SELECT id, score FROM ({PROPOSALS}) WHERE score < 0.97 OR (score = 0.97 AND id > 5000000000) ORDER BY score DESC, id LIMIT 101")
def proposal_page_next(t: Tables) -> DataFrame:
    return R.page(_open_proposals(t), F.col("score"), descending=True, after=(0.97, 5_000_000_000)).select("id", "score")


@query(f"SELECT CASE WHEN score > 0.95 THEN 'high' WHEN score >= 0.92 THEN 'medium' ELSE 'low' END AS band, CAST(count(*) AS BIGINT) AS n, round(min(score), 6) AS least, round(max(score), 6) AS most FROM ({PROPOSALS}) GROUP BY 1")
def proposal_bands(t: Tables) -> DataFrame:
    """The band rule with the edges that these scores need."""
    band = F.when(F.col("score") > 0.95, "high").when(F.col("score") >= 0.92, "medium").otherwise("low")
    return _open_proposals(t).groupBy(band.alias("band")).agg(F.count("*").alias("n"), F.round(F.min("score"), 6).alias("least"), F.round(F.max("score"), 6).alias("most"))


@query("SELECT p.id, p.title, p.sync_mode, CAST(count(m.track_id) AS BIGINT) AS imported FROM r_playlists p LEFT JOIN r_membership m ON m.playlist_id = p.id GROUP BY p.id, p.title, p.sync_mode")
def playlist_summary(t: Tables) -> DataFrame:
    """Members are counted before the join, so the join is one row to one row."""
    n = t.membership.groupBy(F.col("playlist_id").alias("id")).agg(F.count("track_id").alias("imported"))
    return t.playlists.join(n, "id", "left").select("id", "title", "sync_mode", F.coalesce("imported", F.lit(0)).cast("long").alias("imported"))


def active_track_ids(t: Tables) -> DataFrame:
    active = joinable(t.playlists, t.raw("orders").count()).where(F.col("sync_mode").isin(*ACTIVE)).select(F.col("id").alias("playlist_id"))
    return t.membership.join(active, "playlist_id", "left_semi").select("track_id").distinct()


@query("SELECT id, title, artist FROM r_tracks t WHERE EXISTS (SELECT 1 FROM r_membership m JOIN r_playlists p ON p.id = m.playlist_id WHERE m.track_id = t.id AND p.sync_mode IN ('full', 'match_only'))")
def active_tracks(t: Tables) -> DataFrame:
    return t.tracks.join(active_track_ids(t).withColumnRenamed("track_id", "id"), "id", "left_semi").select("id", "title", "artist")


@query("SELECT l.id, l.path FROM r_local l LEFT JOIN r_final f ON f.local_id = l.id WHERE f.id IS NULL")
def unresolved_local(t: Tables) -> DataFrame:
    return t.local.join(t.final.select(F.col("local_id").alias("id")), "id", "left_anti").select("id", "path")


@query("SELECT id, title, artist FROM r_tracks WHERE title ILIKE '%bolt%' OR artist ILIKE '%bolt%' OR album ILIKE '%bolt%' ORDER BY title, id LIMIT 50")
def track_search(t: Tables) -> DataFrame:
    return t.tracks.where(R.matches(["title", "artist", "album"], "bolt", ["id"])).orderBy("title", "id").limit(50).select("id", "title", "artist")


@query("SELECT id, title FROM r_tracks WHERE title ILIKE '%42%' OR id = 42 ORDER BY title, id LIMIT 50")
def track_search_number(t: Tables) -> DataFrame:
    return t.tracks.where(R.matches(["title"], " 42 ", ["id"])).orderBy("title", "id").limit(50).select("id", "title")


@query("SELECT id, title, tier FROM (SELECT id, title, CASE WHEN lower(title) = 'small green' THEN 0 WHEN starts_with(lower(title), 'small') THEN 1 WHEN contains(lower(title), 'small') THEN 2 ELSE 3 END AS tier FROM r_tracks) ORDER BY tier, CASE WHEN tier < 3 THEN title END, id LIMIT 100")
def track_search_ranked(t: Tables) -> DataFrame:
    """Exact, prefix and substring hits in that order, then others to fill the page."""
    low = F.lower("title")
    tier = F.when(low == "small green", 0).when(low.startswith("small"), 1).when(low.contains("small"), 2).otherwise(3)
    ranked = t.tracks.select("id", "title", tier.alias("tier"))
    return ranked.orderBy("tier", F.when(F.col("tier") < 3, F.col("title")), "id").limit(100)


@query("SELECT e.focus AS track_id, e.peer AS peer_id, t.title, t.artist, e.type FROM (SELECT lower_id AS focus, higher_id AS peer, type FROM r_edges UNION ALL SELECT higher_id, lower_id, type FROM r_edges) e JOIN r_tracks t ON t.id = e.peer")
def relationship_peers(t: Tables) -> DataFrame:
    """The other end of each edge by an equality on the exploded ends, not by arithmetic in the join condition."""
    ends = t.edges.select("type", F.explode(F.array(F.struct(F.col("lower_id").alias("track_id"), F.col("higher_id").alias("peer_id")), F.struct(F.col("higher_id").alias("track_id"), F.col("lower_id").alias("peer_id")))).alias("x"))
    peers = t.tracks.select(F.col("id").alias("peer_id"), "title", "artist")
    return ends.select("x.*", "type").join(peers, "peer_id").select("track_id", "peer_id", "title", "artist", "type")


@query("SELECT e.lower_id, e.higher_id, a.title AS first_title, b.title AS second_title, a.album AS first_album, b.album AS second_album FROM r_edges e JOIN r_tracks a ON a.id = e.lower_id JOIN r_tracks b ON b.id = e.higher_id")
def edge_context(t: Tables) -> DataFrame:
    side = lambda end, name: t.tracks.select(F.col("id").alias(end), F.col("title").alias(f"{name}_title"), F.col("album").alias(f"{name}_album"))
    return t.edges.join(side("lower_id", "first"), "lower_id").join(side("higher_id", "second"), "higher_id").select("lower_id", "higher_id", "first_title", "second_title", "first_album", "second_album")


@query("SELECT local_id, min(id) AS id FROM r_suggested WHERE status = 'pending' GROUP BY local_id")
def first_suggestion_per_local(t: Tables) -> DataFrame:
    return R.earliest(t.suggested.where("status = 'pending'"), ["local_id"])


@query("SELECT f.local_id, f.track_id, s.score, s.status FROM r_final f JOIN r_suggested s ON s.local_id = f.local_id AND s.track_id = f.track_id")
def composite_key_join(t: Tables) -> DataFrame:
    return t.final.join(t.suggested.drop("id"), ["local_id", "track_id"]).select("local_id", "track_id", "score", "status")


@query("SELECT key, id, state FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ts DESC, id DESC) AS n FROM r_events) WHERE n = 1")
def latest_event_per_user(t: Tables) -> DataFrame:
    return R.first_per_key(t.events, ["key"], [F.desc("ts"), F.desc("id")]).select("key", "id", "state")


@query("SELECT key, id, value FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY value DESC, id) AS n FROM r_events) WHERE n <= 5")
def top5_events_per_user(t: Tables) -> DataFrame:
    return R.top_per_key(t.events, ["key"], [F.desc("value"), F.asc("id")], 5).select("key", "id", "value")


@query("SELECT id, number FROM (SELECT id, CAST(row_number() OVER (ORDER BY synced_at, id) AS BIGINT) AS number, sync_mode FROM r_playlists) WHERE sync_mode = 'match_only'")
def run_numbering(t: Tables) -> DataFrame:
    """A global number, given before the filter, without a single-task window."""
    rows = numbered(t.playlists.select("id", "synced_at", "sync_mode"), [F.col("synced_at"), F.col("id")])
    return rows.where("sync_mode = 'match_only'").select("id", "number")


@query("SELECT id, CASE WHEN n = 1 THEN s ELSE s || '-' || CAST(n AS VARCHAR) END AS name FROM (SELECT id, title AS s, row_number() OVER (PARTITION BY lower(title) ORDER BY id) AS n FROM r_parts)")
def filename_dedupe(t: Tables) -> DataFrame:
    n = F.row_number().over(W.partitionBy(F.lower("title")).orderBy("id"))
    return t.parts.select("id", F.when(n == 1, F.col("title")).otherwise(F.concat("title", F.lit("-"), n.cast("string"))).alias("name"))


@query("SELECT title, CAST(row_number() OVER (ORDER BY first_id) AS BIGINT) AS number FROM (SELECT title, min(id) AS first_id FROM r_parts GROUP BY title)")
def first_seen_ids(t: Tables) -> DataFrame:
    """Dense numbers of values in order of first place."""
    first = t.parts.groupBy("title").agg(F.min("id").alias("first_id"))
    return numbered(first, [F.col("first_id")]).select("title", "number")


@query("SELECT m.playlist_id, m.position, round(CAST(0 AS DOUBLE) + CASE WHEN t.artist = lag(t.artist, 1) OVER w THEN 0.35 ELSE 0 END + CASE WHEN t.artist = lag(t.artist, 2) OVER w THEN 0.2 ELSE 0 END + CASE WHEN t.artist = lag(t.artist, 3) OVER w THEN 0.1 ELSE 0 END + CASE WHEN t.album = lag(t.album, 1) OVER w THEN 0.2 ELSE 0 END + CASE WHEN t.album = lag(t.album, 2) OVER w THEN 0.1 ELSE 0 END + CASE WHEN t.album = lag(t.album, 3) OVER w THEN 0.05 ELSE 0 END, 6) AS penalty FROM r_membership m JOIN r_tracks t ON t.id = m.track_id WINDOW w AS (PARTITION BY m.playlist_id ORDER BY m.position)")
def recent_repeat_penalty(t: Tables) -> DataFrame:
    w = W.partitionBy("playlist_id").orderBy("position")
    rows = t.membership.join(t.tracks.select(F.col("id").alias("track_id"), "artist", "album"), "track_id")
    part = lambda c, k, x: F.when(F.col(c) == F.lag(c, k).over(w), x).otherwise(0.0)
    total = sum((part("artist", k, x) for k, x in ((1, 0.35), (2, 0.2), (3, 0.1))), F.lit(0.0)) + sum((part("album", k, x) for k, x in ((1, 0.2), (2, 0.1), (3, 0.05))), F.lit(0.0))
    return rows.select("playlist_id", "position", F.round(total, 6).alias("penalty"))


@query("SELECT m.track_id, string_agg(p.title || ':' || CAST(p.id AS VARCHAR), ',' ORDER BY p.title, p.id) AS playlists FROM (SELECT DISTINCT track_id, playlist_id FROM r_membership) m JOIN r_playlists p ON p.id = m.playlist_id WHERE p.sync_mode = 'full' GROUP BY m.track_id")
def playlist_usage_lists(t: Tables) -> DataFrame:
    used = t.membership.select("track_id", F.col("playlist_id").alias("id")).distinct().join(t.playlists.where("sync_mode = 'full'").select("id", "title"), "id")
    listed = used.groupBy("track_id").agg(F.array_sort(F.collect_list(F.struct("title", "id"))).alias("x"))
    return listed.select("track_id", F.array_join(F.transform("x", lambda v: F.concat(v["title"], F.lit(":"), v["id"].cast("string"))), ",").alias("playlists"))


@query("WITH latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ts DESC, id DESC) AS n FROM r_events) WHERE n = 1), ids AS (SELECT key AS id FROM latest UNION SELECT id FROM r_tracks WHERE id < 500) SELECT i.id, CASE WHEN l.state IS NULL OR l.state IN ('searching', 'failed') THEN 'needs_search' WHEN l.state = 'candidates_found' THEN 'review' WHEN l.state = 'queued' THEN 'active' ELSE 'linked' END AS bucket, CASE l.state WHEN 'queued' THEN 0 WHEN 'candidates_found' THEN 1 WHEN 'searching' THEN 2 WHEN 'failed' THEN 3 WHEN 'linked' THEN 4 ELSE 5 END AS status_rank FROM ids i LEFT JOIN latest l ON l.key = i.id")
def queue_items(t: Tables) -> DataFrame:
    latest = R.first_per_key(t.events, ["key"], [F.desc("ts"), F.desc("id")]).select(F.col("key").alias("id"), "state")
    ids = latest.select("id").union(t.tracks.where("id < 500").select("id")).distinct()
    s = F.col("state")
    bucket = F.when(s.isNull() | s.isin("searching", "failed"), "needs_search").when(s == "candidates_found", "review").when(s == "queued", "active").otherwise("linked")
    rank = F.when(s == "queued", 0).when(s == "candidates_found", 1).when(s == "searching", 2).when(s == "failed", 3).when(s == "linked", 4).otherwise(5)
    return ids.join(latest, "id", "left").select("id", bucket.alias("bucket"), rank.alias("status_rank"))


@query("SELECT id FROM r_parts WHERE lower(artist) = 'brand#12' INTERSECT SELECT id FROM r_parts WHERE album ILIKE '%a%' INTERSECT SELECT DISTINCT l_partkey FROM lineitem")
def source_tracks_intersection(t: Tables) -> DataFrame:
    """All filters must hold: one scan for those of a table, semi joins for the others. An unknown column selects nothing."""
    def by(df: DataFrame, column: str, test) -> DataFrame:
        return df.where(test(F.col(column).cast("string"))) if column in df.columns else df.limit(0)

    found = by(by(t.parts, "artist", lambda c: F.lower(c) == "brand#12"), "album", lambda c: c.ilike("%a%"))
    return found.join(t.raw("lineitem").select(F.col("l_partkey").alias("id")).distinct(), "id", "left_semi").select("id").distinct()


@query("SELECT coalesce(a.id, b.id) AS id, CASE WHEN b.id IS NULL THEN 'stale' WHEN a.id IS NULL THEN 'inserted' WHEN a.title = b.title AND a.n = b.n THEN 'same' ELSE 'updated' END AS action FROM (SELECT id, title, duration_ms AS n FROM r_parts WHERE id % 7 <> 0) a FULL JOIN (SELECT id, title, duration_ms + CASE WHEN id % 4 = 0 THEN 1 ELSE 0 END AS n FROM r_parts WHERE id % 3 <> 0) b ON a.id = b.id")
def stale_mirror(t: Tables) -> DataFrame:
    """Drift of a mirror from its source: stale, inserted, updated and unchanged rows out of one full outer join."""
    from tonearm.operators.upsert import drift

    mirror = t.parts.where("id % 7 <> 0").select("id", "title", F.col("duration_ms").alias("n"))
    source = t.parts.where("id % 3 <> 0").select("id", "title", (F.col("duration_ms") + F.when(F.col("id") % 4 == 0, 1).otherwise(0)).alias("n"))
    return drift(mirror, source, ["id"])


@query("SELECT playlist_id, track_id, CAST(row_number() OVER (PARTITION BY playlist_id ORDER BY p) AS BIGINT) AS position FROM (SELECT playlist_id, track_id, min(position) AS p FROM r_membership GROUP BY 1, 2)")
def ordered_distinct(t: Tables) -> DataFrame:
    first = t.membership.groupBy("playlist_id", "track_id").agg(F.min("position").alias("p"))
    return first.select("playlist_id", "track_id", F.row_number().over(W.partitionBy("playlist_id").orderBy("p")).cast("long").alias("position"))


@query("SELECT sync_mode, CAST(count(*) AS BIGINT) AS n FROM r_playlists GROUP BY sync_mode UNION ALL SELECT 'all', CAST(count(*) AS BIGINT) FROM r_playlists")
def facets_with_all(t: Tables) -> DataFrame:
    return R.facets(t.playlists, "sync_mode")


@query("SELECT reason, CAST(count(*) AS BIGINT) AS n FROM (SELECT CASE WHEN l_returnflag = 'R' THEN 'returned' WHEN l_quantity < 5 THEN 'few' WHEN l_discount > 0.08 THEN 'cheap' WHEN l_tax = 0 THEN 'untaxed' END AS reason FROM lineitem) WHERE reason IS NOT NULL GROUP BY reason")
def rejection_reasons(t: Tables) -> DataFrame:
    """The first failing rule is the reason."""
    rules = (("returned", F.col("l_returnflag") == "R"), ("few", F.col("l_quantity") < 5), ("cheap", F.col("l_discount") > 0.08), ("untaxed", F.col("l_tax") == 0))
    reason = F.coalesce(*[F.when(test, name) for name, test in rules])
    return t.raw("lineitem").select(reason.alias("reason")).where("reason IS NOT NULL").groupBy("reason").agg(F.count("*").alias("n"))


@query("SELECT local_id, track_id, score FROM (SELECT *, max(score) OVER (PARTITION BY local_id) AS best, row_number() OVER (PARTITION BY local_id ORDER BY score DESC, track_id) AS n FROM r_suggested WHERE status <> 'rejected') WHERE score >= 0.97 OR (best < 0.97 AND n <= 2)")
def two_tier_shortlist(t: Tables) -> DataFrame:
    """All strong candidates of a local track, or its best two where none is strong."""
    w = W.partitionBy("local_id")
    ranked = t.suggested.where("status <> 'rejected'").withColumn("best", F.max("score").over(w)).withColumn("n", F.row_number().over(w.orderBy(F.desc("score"), "track_id")))
    return ranked.where("score >= 0.97 OR (best < 0.97 AND n <= 2)").select("local_id", "track_id", "score")


@query("SELECT local_id, track_id, max(score) AS score FROM (SELECT local_id, track_id, score FROM r_suggested WHERE method = 'tags' UNION ALL SELECT local_id, track_id, 1.0 - score / 10 FROM r_suggested WHERE track_id % 3 = 0) GROUP BY 1, 2 ORDER BY score DESC, local_id, track_id LIMIT 50")
def ranked_merge(t: Tables) -> DataFrame:
    """Two lists of proposals, by method and by a remainder that stands for a second source, merged by best score; the 50 best are the report."""
    first = t.suggested.where("method = 'tags'").select("local_id", "track_id", "score")
    second = t.suggested.where("track_id % 3 = 0").select("local_id", "track_id", (F.lit(1.0) - F.col("score") / 10).alias("score"))
    return first.unionByName(second).groupBy("local_id", "track_id").agg(F.max("score").alias("score")).orderBy(F.desc("score"), "local_id", "track_id").limit(50)


@query("SELECT id, ignored FROM (SELECT id, ts IS NOT NULL AND event_type = 'error' AS ignored, value FROM r_events) ORDER BY ignored, value DESC, id LIMIT 200")
def active_first(t: Tables) -> DataFrame:
    """A null test as the leading sort key."""
    ignored = F.col("ts").isNotNull() & (F.col("event_type") == "error")
    return t.events.select("id", ignored.alias("ignored"), "value").orderBy("ignored", F.desc("value"), "id").limit(200).select("id", "ignored")


@query("SELECT id, title FROM r_tracks WHERE contains(lower(title), '100%') OR starts_with(title, 'large_') OR title LIKE '%e b%'")
def literal_search(t: Tables) -> DataFrame:
    """Wildcards in the needle are text."""
    like = lambda needle, pattern: F.col("title").like(pattern.format(R.literal_like(needle)))
    return t.tracks.where(F.lower("title").like("%" + R.literal_like("100%") + "%") | like("large_", "{}%") | like("e b", "%{}%")).select("id", "title")


@query("SELECT CAST((SELECT count(*) FROM r_local l WHERE NOT EXISTS (SELECT 1 FROM r_final f WHERE f.local_id = l.id)) AS BIGINT) AS unresolved, CAST((SELECT coalesce(max(id), 0) FROM r_final) AS BIGINT) AS last_link, (SELECT count(id) > 0 FROM r_suggested WHERE status = 'pending') AS any_pending")
def scalar_aggregates(t: Tables) -> DataFrame:
    a = t.local.join(t.final.select(F.col("local_id").alias("id")), "id", "left_anti").agg(F.count("*").alias("unresolved"))
    b = t.final.agg(F.coalesce(F.max("id"), F.lit(0)).cast("long").alias("last_link"))
    c = t.suggested.where("status = 'pending'").agg((F.count("id") > 0).alias("any_pending"))
    return a.join(b, F.lit(True)).join(c, F.lit(True))
