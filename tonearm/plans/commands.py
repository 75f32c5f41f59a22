"""Queries of snapshot writes, commands and data migrations: each returns the table after the change."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonearm.operators import reducers as D
from tonearm.operators import upsert as U
from tonearm.plans.registry import query
from tonearm.tables import Tables

INCOMING = "SELECT id + 500 AS id, 'new ' || title AS title, CASE WHEN id % 4 = 0 THEN NULL ELSE isrc END AS isrc, duration_ms + 1 AS duration_ms FROM r_parts WHERE id % 3 = 0"


def incoming(t: Tables) -> DataFrame:
    return t.parts.where("id % 3 = 0").select((F.col("id") + 500).alias("id"), F.concat(F.lit("new "), "title").alias("title"), F.when(F.col("id") % 4 != 0, F.col("isrc")).alias("isrc"), (F.col("duration_ms") + 1).alias("duration_ms"))


def stored(t: Tables) -> DataFrame:
    return t.parts.select("id", "title", "isrc", "duration_ms")


@query(f"SELECT coalesce(s.id, o.id) AS id, coalesce(s.title, o.title) AS title, CASE WHEN s.id IS NULL THEN o.isrc ELSE coalesce(s.isrc, o.isrc) END AS isrc, coalesce(s.duration_ms, o.duration_ms) AS duration_ms FROM r_parts o FULL JOIN ({INCOMING}) s ON s.id = o.id")
def upsert_keep_old(t: Tables) -> DataFrame:
    """A null code does not erase a known one."""
    return U.merge(stored(t), incoming(t), ["id"], {"isrc": "coalesce"})


@query(f"SELECT coalesce(s.id, o.id) AS id, coalesce(o.title, s.title) AS title, CASE WHEN o.id IS NULL OR o.duration_ms > 20000 THEN s.isrc ELSE o.isrc END AS isrc FROM (SELECT * FROM r_parts) o FULL JOIN ({INCOMING}) s ON s.id = o.id WHERE s.id IS NOT NULL UNION ALL SELECT id, title, isrc FROM r_parts WHERE id NOT IN (SELECT id FROM ({INCOMING}))")
def upsert_guarded(t: Tables) -> DataFrame:
    """Titles stay; codes change only where the stored row passes the guard."""
    out = U.merge(stored(t), incoming(t), ["id"], {"title": "old"}, guard=F.col("old.duration_ms") > 20000)
    return out.select("id", "title", "isrc")


@query(f"SELECT coalesce(s.id, o.id) AS id, coalesce(s.title, o.title) AS title FROM (SELECT * FROM r_parts) o FULL JOIN ({INCOMING}) s ON s.id = o.id WHERE s.id IS NOT NULL OR o.id % 2 = 0")
def reconcile_listing(t: Tables) -> DataFrame:
    """Of odd ids the listing is complete: those that it lacks go."""
    return U.reconcile(stored(t), incoming(t), ["id"], F.col("id") % 2 != 0).select("id", "title")


@query("SELECT playlist_id, track_id, position FROM r_membership WHERE playlist_id % 10 <> 0 UNION ALL SELECT playlist_id, track_id, CAST(row_number() OVER (PARTITION BY playlist_id ORDER BY position DESC) AS BIGINT) FROM r_membership WHERE playlist_id % 10 = 0")
def replace_groups(t: Tables) -> DataFrame:
    """Members of some playlists replaced by the same in reverse."""
    from pyspark.sql import Window as W

    new = t.membership.where("playlist_id % 10 = 0").select("playlist_id", "track_id", F.row_number().over(W.partitionBy("playlist_id").orderBy(F.desc("position"))).cast("long").alias("position"))
    return U.replace_groups(t.membership, new, "playlist_id").select("playlist_id", "track_id", "position")


@query("SELECT s.id, s.status FROM r_suggested s WHERE NOT (s.status = 'pending' AND EXISTS (SELECT 1 FROM r_final f WHERE f.local_id = s.local_id))")
def delete_resolved(t: Tables) -> DataFrame:
    gone = t.suggested.where("status = 'pending'").join(t.final.select("local_id"), "local_id", "left_semi").select("id")
    return t.suggested.join(gone, "id", "left_anti").select("id", "status")


@query("SELECT id, CASE WHEN hit THEN 'failed' ELSE status END AS status, hit AS matched FROM (SELECT id, status, status = 'pending' AND score > 0.95 AND track_id % 2 = 0 AS hit FROM r_suggested)")
def compare_and_set(t: Tables) -> DataFrame:
    out = U.compare_and_set(t.suggested, (F.col("status") == "pending") & (F.col("score") > 0.95) & (F.col("track_id") % 2 == 0), {"status": F.lit("failed")})
    return out.select("id", "status", "matched")


@query("SELECT user_id AS key, arg_max(event_type, (ts, event_id)) AS reason, CAST(sum(coalesce(nullif(event_id % 3, 0), 1)) AS BIGINT) AS attempts, min(ts) AS first_at FROM events GROUP BY user_id")
def collapse_failures(t: Tables) -> DataFrame:
    last = F.struct("ts", "id")
    n = F.coalesce(F.nullif(F.col("id") % 3, F.lit(0)), F.lit(1))
    return t.events.groupBy("key").agg(F.max_by("event_type", last).alias("reason"), F.sum(n).alias("attempts"), F.min("ts").alias("first_at"))


@query("SELECT m.playlist_id, k.keeper AS track_id, m.position FROM r_membership m JOIN (SELECT id, min(id) OVER (PARTITION BY title, artist) AS keeper FROM r_tracks) k ON k.id = m.track_id")
def dedupe_parents(t: Tables) -> DataFrame:
    """Members point to the smallest track of each (title, artist)."""
    rows = t.tracks.withColumn("k", F.concat_ws("|", "title", "artist"))
    return D.merged_duplicates(rows, "k", {"m": (t.membership, "track_id")})[1]["m"]


@query("SELECT id, CASE WHEN method = 'isrc' THEN 'manual' ELSE method END AS method FROM r_suggested WHERE NOT (method = 'isrc' AND status = 'pending')")
def enum_rewrite(t: Tables) -> DataFrame:
    kept = t.suggested.where(~((F.col("method") == "isrc") & (F.col("status") == "pending")))
    return kept.select("id", F.when(F.col("method") == "isrc", "manual").otherwise(F.col("method")).alias("method"))


@query("SELECT p.id, CASE WHEN p.sync_mode = 'full' AND EXISTS (SELECT 1 FROM r_membership m WHERE m.playlist_id = p.id) THEN 'full' WHEN p.sync_mode <> 'off' THEN 'match_only' ELSE 'off' END AS mode, coalesce(CASE WHEN p.id % 2 = 0 THEN p.synced_at END, p.synced_at) AS at FROM r_playlists p")
def mode_backfill(t: Tables) -> DataFrame:
    held = t.membership.select(F.col("playlist_id").alias("id"), F.lit(True).alias("any")).distinct()
    x = t.playlists.join(held, "id", "left")
    return x.select("id", F.when((F.col("sync_mode") == "full") & F.col("any"), "full").when(F.col("sync_mode") != "off", "match_only").otherwise("off").alias("mode"), F.coalesce(F.when(F.col("id") % 2 == 0, F.col("synced_at")), "synced_at").alias("at"))


@query("SELECT id, path FROM (SELECT id, CASE WHEN id % 2 = 0 THEN replace(path, 'Brand#1', 'Brand#2') ELSE path END AS path, path AS old FROM r_local) x WHERE NOT (path <> old AND EXISTS (SELECT 1 FROM r_local y WHERE y.path = x.path))")
def unique_rename(t: Tables) -> DataFrame:
    """A value is renamed unless its target is taken; then the row goes."""
    x = t.local.select("id", F.when(F.col("id") % 2 == 0, F.replace("path", F.lit("Brand#1"), F.lit("Brand#2"))).otherwise(F.col("path")).alias("path"), F.col("path").alias("old"))
    taken = t.local.select("path", F.lit(True).alias("taken")).distinct()
    return x.join(taken, "path", "left").where((F.col("path") == F.col("old")) | F.col("taken").isNull()).select("id", "path")


@query("SELECT page_id, url FROM pages WHERE regexp_matches(lower(url), '[.](html|mp3|flac|wav|aiff)$')")
def pattern_delete(t: Tables) -> DataFrame:
    return t.raw("pages").where(F.lower("url").rlike("[.](html|mp3|flac|wav|aiff)$")).select("page_id", "url")


APPROVED = "SELECT min(id) AS id, local_id FROM r_suggested s WHERE status = 'pending' AND score >= 0.97 AND local_id NOT IN (SELECT local_id FROM r_final) GROUP BY local_id"


@query(f"WITH asked AS ({APPROVED}), x AS (SELECT s.id, s.local_id, s.track_id, CASE WHEN EXISTS (SELECT 1 FROM r_final f WHERE f.track_id = s.track_id) THEN 'conflict' END AS reason FROM asked a JOIN r_suggested s ON s.id = a.id), k AS (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY id) AS n FROM x WHERE reason IS NULL) SELECT x.id, CASE WHEN k.n = 1 THEN 'approved' ELSE coalesce(x.reason, 'stale') END AS outcome FROM x LEFT JOIN k ON k.id = x.id")
def approve_batch(t: Tables) -> DataFrame:
    """One command per open local track: its first strong proposal; outcomes."""
    asked = t.suggested.where("status = 'pending' AND score >= 0.97").join(t.final.select("local_id"), "local_id", "left_anti").groupBy("local_id").agg(F.min("id").alias("id"))
    return D.approve(t.suggested, t.final, asked.select("id", F.col("id").alias("n")))[2]


@query("SELECT id, CASE WHEN id % 7 = 0 AND status = 'pending' THEN 'rejected' ELSE status END AS status FROM r_suggested")
def reject_batch(t: Tables) -> DataFrame:
    return D.reject(t.suggested, t.suggested.where("id % 7 = 0").select("id")).select("id", "status")


@query("SELECT id, local_id, status, method FROM r_suggested UNION ALL SELECT -local_id, local_id, 'rejected', 'manual_break' FROM r_final WHERE local_id % 20 = 0")
def unlink_batch(t: Tables) -> DataFrame:
    return D.unlink(t.final, t.suggested, t.final.where("local_id % 20 = 0").select("local_id"))[1].select("id", "local_id", "status", "method")


@query("WITH c AS (SELECT track_id * 2 AS n, (track_id // 5) * 5 + 5 AS local_id, track_id FROM r_components WHERE track_id % 9 = 2), h AS (SELECT component, min(local_id) AS low, max(local_id) AS high FROM r_final JOIN r_components USING (track_id) GROUP BY component), x AS (SELECT c.*, k.component, CASE WHEN EXISTS (SELECT 1 FROM r_final f WHERE f.local_id = c.local_id) THEN 'local_taken' WHEN EXISTS (SELECT 1 FROM r_final f WHERE f.track_id = c.track_id) THEN 'track_taken' WHEN h.low <> c.local_id OR h.high <> c.local_id THEN 'component_taken' END AS reason FROM c JOIN r_components k ON k.track_id = c.track_id LEFT JOIN h ON h.component = k.component), a AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY local_id ORDER BY n) AS i FROM x WHERE reason IS NULL) WHERE i = 1), b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY component ORDER BY n) AS j FROM a) WHERE j = 1) SELECT x.n, CASE WHEN b.n IS NOT NULL THEN 'created' ELSE coalesce(x.reason, 'stale') END AS outcome FROM x LEFT JOIN b ON b.n = x.n")
def link_batch(t: Tables) -> DataFrame:
    asked = t.components.where("track_id % 9 = 2").select((F.col("track_id") * 2).alias("n"), F.expr("(track_id div 5) * 5 + 5").alias("local_id"), "track_id")
    return D.link(t.final, t.components, asked)[1]


@query("WITH x AS (SELECT least(a.id, b.id) AS lower_id, greatest(a.id, b.id) AS higher_id FROM r_tracks a JOIN r_tracks b ON b.id = a.id + 10 WHERE a.id % 10 = 1), l AS (SELECT component, list(DISTINCT local_id) AS ids FROM r_final JOIN r_components USING (track_id) GROUP BY component) SELECT x.lower_id, x.higher_id, CASE WHEN EXISTS (SELECT 1 FROM r_edges e WHERE e.lower_id = x.lower_id AND e.higher_id = x.higher_id) OR p.component = q.component THEN 'stale' WHEN len(list_distinct(list_concat(coalesce(lp.ids, []), coalesce(lq.ids, [])))) > 1 THEN 'conflict' ELSE 'accepted' END AS outcome FROM x JOIN r_components p ON p.track_id = x.lower_id JOIN r_components q ON q.track_id = x.higher_id LEFT JOIN l lp ON lp.component = p.component LEFT JOIN l lq ON lq.component = q.component")
def accept_batch(t: Tables) -> DataFrame:
    b = t.tracks.select((F.col("id") - 10).alias("a"), F.col("id").alias("b"))
    asked = t.tracks.where("id % 10 = 1").select(F.col("id").alias("a")).join(b, "a").select("a", "b", F.lit("equivalent").alias("type"), F.lit(None).cast("long").alias("winner"))
    return D.accept_edges(t.edges, t.components, t.final, asked)[1]


@query("SELECT id, CASE WHEN status IS NULL OR NOT cur THEN 1 ELSE attempts + 1 END AS attempt FROM (SELECT doc_id AS id, CASE doc_id % 4 WHEN 0 THEN NULL WHEN 1 THEN 'failed' WHEN 2 THEN 'ready' ELSE 'pending' END AS status, doc_id % 5 AS attempts, doc_id % 11 <> 0 AS cur FROM documents) WHERE status IS NULL OR (status = 'failed' AND attempts < 3) OR NOT cur ORDER BY id LIMIT 200")
def claim_work(t: Tables) -> DataFrame:
    i = F.col("id")
    rows = t.docs.select("id", F.when(i % 4 == 1, "failed").when(i % 4 == 2, "ready").when(i % 4 == 3, "pending").alias("status"), (i % 5).alias("attempts"), (i % 11 != 0).alias("current"))
    return D.claim(rows, 200)


@query("SELECT id, id = (SELECT min(id) FROM r_accounts WHERE id % 100 = 7) AS is_default FROM r_accounts")
def default_profile(t: Tables) -> DataFrame:
    return D.with_default(t.accounts.select("id", (F.col("id") % 100 == 7).alias("is_default")))


@query("SELECT id, CASE WHEN track_id % 6 = 1 THEN NULL ELSE track_id END AS track_id FROM r_suggested")
def detached_history(t: Tables) -> DataFrame:
    return D.detached(t.suggested.select("id", "track_id"), "track_id", t.tracks.where("id % 6 = 1").select("id"))
