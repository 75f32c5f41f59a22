"""Queries of provider sources: conversations as playlists, their turns as tracks, read through the data source of ``sources/provider.py``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonearm.plans.registry import query
from tonearm.sources import provider as P
from tonearm.storage import drop_at_exit, fresh_path, materialize
from tonearm.tables import Tables

#: Twenty accounts; a seventh of the payloads hold no list, an eleventh of the calls fail, a thirteenth of the playlists come empty, a fifth are off.
LISTED = "SELECT conv_id, conv_id % 20 AS account_id, CAST(conv_id AS VARCHAR) AS playlist_id, CASE conv_id % 5 WHEN 0 THEN 'off' WHEN 1 THEN 'match_only' ELSE 'full' END AS sync_mode, CASE WHEN conv_id % 11 = 5 THEN 'OSError: status 503' WHEN conv_id % 7 = 3 THEN 'malformed payload' END AS error, conv_id % 13 = 4 AS bare FROM (SELECT DISTINCT conv_id FROM conversations)"
TURNS = "SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS INTEGER) AS position, turn, role FROM conversations"


def fetched(t: Tables) -> DataFrame:
    """The active playlists of all accounts, asked for once and written."""
    c = F.col("conv_id")
    item = F.struct("turn", F.concat_ws("-", c, "turn").alias("videoId"), F.when(F.col("role") != "system", F.col("role")).alias("title"), F.array(F.struct(F.col("role").alias("name"))).alias("artists"))
    bodies = t.raw("conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(item)).alias("tracks"))
    payload = F.when(c % 7 == 3, F.lit('{"tracks": "none"}')).when(c % 13 == 4, F.lit('{"tracks": []}')).otherwise(F.to_json(F.struct("tracks")))
    mode = F.when(c % 5 == 0, "off").when(c % 5 == 1, "match_only").otherwise("full")
    items = bodies.select((c % 20).alias("account_id"), c.cast("string").alias("playlistId"), F.concat(F.lit("talk "), c.cast("string")).alias("title"), mode.alias("mode"), F.when(c % 11 == 5, 503).otherwise(200).alias("status"), payload.alias("payload"))
    path = fresh_path(t.spark, "landed")
    P.land(items, path)
    drop_at_exit(t.spark, path)
    return materialize(P.read_provider(t.spark, "landed_playlists", lambda: P.LandedClient(path), only={"sync_mode": P.ACTIVE_MODES}), "fetched")


def stored(t: Tables) -> DataFrame:
    """What an earlier run stored: one track of each playlist."""
    return t.raw("conversations").select(F.col("conv_id").cast("string").alias("playlist_id")).distinct().select("playlist_id", F.lit(1).alias("position"), F.concat(F.lit("old-"), "playlist_id").alias("track_id"))


@query(f"SELECT l.account_id, l.playlist_id, CASE WHEN l.error IS NULL THEN CASE WHEN l.bare THEN 0 ELSE count(t.turn) FILTER (t.role <> 'system') END END AS n_tracks, l.error FROM ({LISTED}) l JOIN ({TURNS}) t USING (conv_id) WHERE l.sync_mode <> 'off' GROUP BY l.account_id, l.playlist_id, l.error, l.bare")
def provider_states(t: Tables) -> DataFrame:
    """What became of each active playlist: its tracks, or why there are none."""
    return P.synced(stored(t), fetched(t))[1]


@query(f"SELECT playlist_id, 1 AS position, 'old-' || playlist_id AS track_id FROM ({LISTED}) WHERE sync_mode = 'off' OR error IS NOT NULL UNION ALL SELECT l.playlist_id, t.position, l.playlist_id || '-' || CAST(t.turn AS VARCHAR) FROM ({LISTED}) l JOIN ({TURNS}) t USING (conv_id) WHERE l.sync_mode <> 'off' AND l.error IS NULL AND NOT l.bare AND t.role <> 'system'")
def provider_sync(t: Tables) -> DataFrame:
    """Memberships after a sync in which failing playlists keep theirs and no other playlist is touched by them."""
    return P.synced(stored(t), fetched(t))[0]
