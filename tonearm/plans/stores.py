"""Queries of landed sources, snapshot writes, sinks, scalar rules and job reducers, over the stored tables as stand-ins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonearm.functions import numeric as N
from tonearm.functions import text as X
from tonearm.operators import entity as E
from tonearm.operators import graph as G
from tonearm.operators import reducers as D
from tonearm.operators import relational as R
from tonearm.operators import summaries as M
from tonearm.operators import upsert as U
from tonearm.plans.commands import INCOMING, incoming, stored
from tonearm.plans.entities import CODE
from tonearm.plans.registry import query
from tonearm.sources import catalogue_store as C
from tonearm.sources import playlists as P
from tonearm.tables import Tables

# Landed sources.


@query("SELECT id AS entity_id, artist AS brand, CASE WHEN id % 7 = 0 THEN '' ELSE album END AS kind FROM r_parts")
def attribute_rows(t: Tables) -> DataFrame:
    """Key-value rows, some null and some repeated, folded to one row of attributes per entity."""
    i = F.col("id").alias("entity_id")
    rows = t.parts.select(i, F.lit("brand").alias("key"), F.col("artist").alias("value")).union(t.parts.select(i, F.lit("kind"), F.when(F.col("id") % 7 != 0, F.col("album")))).union(t.parts.select(i, F.lit("brand"), F.lit("")))
    return C.attributes(rows).select("entity_id", F.element_at("attributes", "brand").alias("brand"), F.element_at("attributes", "kind").alias("kind"))


@query("SELECT o_orderkey AS n, o_orderkey * 1000000 + 500000 AS micros, CASE o_orderkey % 4 WHEN 0 THEN false WHEN 1 THEN true WHEN 2 THEN false ELSE true END AS flag, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_custkey + 0.25 END::DOUBLE AS x, o_orderpriority AS s FROM orders")
def typed_rows(t: Tables) -> DataFrame:
    """Stored text as integers, times, booleans, numbers and text, by a registry of field types."""
    i = F.col("o_orderkey")
    words = F.element_at(F.array(*[F.lit(x) for x in ("No", "yes", " off ", "1")]), (i % 4 + 1).cast("int"))
    raw = t.raw("orders").select(F.concat(F.lit(" "), i.cast("string"), F.lit(".2")).alias("n"), F.concat(i.cast("string"), F.lit(".5")).alias("at"), words.alias("flag"), F.when(i % 5 == 0, "none").otherwise((F.col("o_custkey") + 0.25).cast("string")).alias("x"), F.col("o_orderpriority").alias("s"))
    out = C.typed(raw, {"n": "Integer", "at": "DateType", "flag": "Boolean", "x": "Float", "s": "String"})
    return out.select("n", F.unix_micros("at").alias("micros"), "flag", "x", "s")


@query("SELECT CAST(id AS VARCHAR) AS id, title, CAST(CASE WHEN id % 5 > 1 THEN id * 100 END AS INTEGER) AS count FROM r_playlists WHERE id % 11 <> 0")
def listed_playlists(t: Tables) -> DataFrame:
    """A provider's listing, one payload per account: counts with commas, broken or negative ones, rows without a title."""
    i = F.col("id")
    count = F.when(i % 5 == 0, "n/a").when(i % 5 == 1, "-3").otherwise(F.format_number(i * 100, 0))
    item = F.struct(i.cast("string").alias("playlistId"), F.when(i % 11 != 0, F.col("title")).alias("title"), count.alias("count"))
    return C.provider_playlists(t.playlists.groupBy("account_id").agg(F.to_json(F.collect_list(item)).alias("payload")))


@query("SELECT m.playlist_id, CAST(m.position AS INTEGER) AS position, CAST(t.id AS VARCHAR) AS id, t.title, t.artist || ', X' AS artist, CASE WHEN t.id % 4 <> 0 THEN t.album END AS album, t.duration_ms, t.isrc FROM r_membership m JOIN r_tracks t ON t.id = m.track_id WHERE t.id % 13 <> 0")
def listed_tracks(t: Tables) -> DataFrame:
    """A provider's tracks, one payload per playlist: several artists, missing names, albums and titles."""
    i = F.col("id")
    named = lambda x: F.struct(x.alias("name"))
    item = F.struct(F.col("position"), i.cast("string").alias("videoId"), F.when(i % 13 != 0, F.col("title")).alias("title"), F.array(named(F.col("artist")), named(F.lit(None).cast("string")), named(F.lit("X"))).alias("artists"), F.struct(F.when(i % 4 != 0, F.col("album")).alias("name")).alias("album"), (F.col("duration_ms") / 1000).cast("long").alias("duration_seconds"), F.col("isrc").alias("isrc"))
    held = t.membership.join(t.tracks.withColumnRenamed("id", "track_id"), "track_id").withColumn("id", F.col("track_id")).groupBy("playlist_id").agg(F.array_sort(F.collect_list(item)).alias("tracks"))
    return C.provider_tracks(held.select("playlist_id", F.to_json(F.struct("tracks")).alias("payload")))


@query("SELECT CAST(id AS VARCHAR) AS id, CASE WHEN id % 3 = 2 THEN 'USX' || CAST(id AS VARCHAR) END AS isrc, CASE WHEN id % 3 = 0 THEN 'OSError: unreachable' END AS error FROM r_tracks WHERE id % 3 <> 1")
def enriched_codes(t: Tables) -> DataFrame:
    """One call per track, of which a third fail and a third answer nothing."""

    def lookup(i: str) -> str | None:
        if int(i) % 3 == 0:
            raise OSError("unreachable")
        return f"USX{i}" if int(i) % 3 == 2 else None

    return C.looked_up(t.tracks.select(F.col("id").cast("string").alias("id")), lookup)


@query("SELECT id, CASE WHEN (id % 7) * (id % 5) >= (id % 4) * 6 THEN 'a' ELSE 'd' END || CAST(id AS VARCHAR) AS url FROM r_tracks")
def best_thumbnails(t: Tables) -> DataFrame:
    i = F.col("id")
    shot = lambda name, w, h: F.struct(F.concat(F.lit(name), i.cast("string")).alias("url"), w.cast("int").alias("width"), h.cast("int").alias("height"))
    return t.tracks.select("id", C.best_thumbnail(F.array(shot("a", i % 7, i % 5), shot("b", i % 5, i % 7), shot("c", F.lit(3), F.lit(None)), shot("d", i % 4, F.lit(6)))).alias("url"))


@query("SELECT id, CASE id % 6 WHEN 0 THEN NULL WHEN 4 THEN 'A\"B\\C ' || isrc WHEN 5 THEN 'é' || title ELSE isrc END AS isrc FROM r_tracks")
def nested_codes(t: Tables) -> DataFrame:
    """A code found at any depth of a payload, under either of its names: behind other values, with escapes, after a value that is no text, and given twice."""
    i, code = F.col("id"), F.col("isrc")
    deep = F.to_json(F.struct(F.struct(F.array(F.struct(F.lit("").alias("isrc"), code.alias("ISRC"))).alias("list")).alias("deep"), F.lit("late").alias("isrc")))
    escaped = F.to_json(F.struct(F.lit(7).alias("isrc"), F.struct(F.concat(F.lit('A"B\\C '), code).alias("Isrc")).alias("z")))
    coded = F.concat(F.lit('{"\\u0069src": "\\u00e9'), "title", F.lit('", "isrc2": "x"}'))
    twice = F.concat(F.lit('{"isrc": "first", "a": {"isrc": "between"}, "isrc": "'), code, F.lit('"}'))
    plain = F.to_json(F.struct(F.lit(1).alias("n"), code.alias("internationalStandardRecordingCode")))
    payload = F.when(i % 6 == 0, F.to_json(F.struct("title"))).when(i % 6 == 2, deep).when(i % 6 == 3, twice).when(i % 6 == 4, escaped).when(i % 6 == 5, coded).otherwise(plain)
    return t.tracks.select("id", C.recursive_code(payload).alias("isrc"))


# Snapshot writes.


@query(f"SELECT coalesce(s.id, o.id) AS id, CASE WHEN s.id IS NULL THEN o.title ELSE s.title END AS title, CASE WHEN s.id IS NULL THEN o.isrc ELSE s.isrc END AS isrc, CASE WHEN s.id IS NULL THEN o.duration_ms ELSE s.duration_ms END AS duration_ms FROM r_parts o FULL JOIN ({INCOMING}) s ON s.id = o.id")
def upsert_last_wins(t: Tables) -> DataFrame:
    """Every column of an incoming row counts, nulls too."""
    return U.merge(stored(t), incoming(t), ["id"])


@query(f"SELECT coalesce(s.id, o.id) AS id, coalesce(s.title, o.title) AS title, o.isrc, o.duration_ms FROM r_parts o FULL JOIN ({INCOMING}) s ON s.id = o.id")
def upsert_partial(t: Tables) -> DataFrame:
    """Only the columns that the incoming rows have are set."""
    return U.merge(stored(t), incoming(t).select("id", "title"), ["id"])


@query(f"SELECT coalesce(s.id, o.id) AS id, CASE WHEN s.id IS NULL THEN 'stale' WHEN o.id IS NULL THEN 'inserted' WHEN o.title IS NOT DISTINCT FROM s.title AND o.isrc IS NOT DISTINCT FROM s.isrc AND o.duration_ms IS NOT DISTINCT FROM s.duration_ms THEN 'same' ELSE 'updated' END AS action FROM r_parts o FULL JOIN (SELECT * FROM ({INCOMING}) WHERE id % 2 = 0 UNION ALL SELECT id, title, isrc, duration_ms FROM r_parts WHERE id % 5 = 1 AND id NOT IN (SELECT id FROM ({INCOMING}) WHERE id % 2 = 0)) s ON s.id = o.id")
def drift_report(t: Tables) -> DataFrame:
    """Mirror against source: what a delta import would insert, change, keep or call missing."""
    new = incoming(t).where("id % 2 = 0")
    same = stored(t).where("id % 5 = 1").join(new.select("id"), "id", "left_anti")
    return U.drift(stored(t), new.unionByName(same), ["id"])


@query("WITH roots AS (SELECT artist AS name, CAST(row_number() OVER (ORDER BY artist) AS BIGINT) AS id FROM (SELECT DISTINCT artist FROM r_parts)), kids AS (SELECT DISTINCT artist, album FROM r_parts) SELECT id, CAST(NULL AS BIGINT) AS parent_id, name FROM roots UNION ALL SELECT (SELECT count(*) FROM roots) + row_number() OVER (ORDER BY r.id, k.album), r.id, k.album FROM kids k JOIN roots r ON r.name = k.artist")
def tree_insert(t: Tables) -> DataFrame:
    """New nodes under the stored nodes that they name; ids go on from the greatest."""
    from tonearm.operators.ranking import numbered

    roots = numbered(t.parts.select(F.col("artist").alias("name")).distinct(), [F.col("name")], "id").select(F.col("id").cast("long").alias("id"), F.lit(None).cast("long").alias("parent_id"), "name")
    return G.with_children(roots, t.parts.select(F.col("artist").alias("parent"), F.col("album").alias("name")).distinct())


# Sinks.


@query("SELECT id, 'file://localhost' || replace(url_encode('/' || path), '%2F', '/') AS url FROM r_local")
def path_urls(t: Tables) -> DataFrame:
    return t.local.select("id", P.file_url(F.concat(F.lit("/"), "path")).alias("url"))


@query("WITH e AS (SELECT m.playlist_id, m.position, t.id, 'm/' || CAST(t.id AS VARCHAR) || ' x.mp3' AS path, t.artist, t.title, t.duration_ms FROM r_membership m JOIN r_tracks t ON t.id = m.track_id JOIN r_playlists p ON p.id = m.playlist_id AND p.sync_mode = 'full'), first AS (SELECT path, playlist_id, position, artist, title, duration_ms, row_number() OVER (PARTITION BY path ORDER BY playlist_id, position) AS k FROM e), keyed AS (SELECT *, row_number() OVER (ORDER BY playlist_id, position, path) AS n FROM first WHERE k = 1) SELECT 0 AS part, CAST(n AS BIGINT) AS n, '<TRACK TrackID=\"' || n || '\" Name=\"' || title || '\" Artist=\"' || artist || '\" TotalTime=\"' || duration_ms // 1000 || '\" Location=\"file://localhost' || replace(url_encode(path), '%2F', '/') || '\"/>' AS line FROM keyed UNION ALL SELECT 1, e.playlist_id, '<NODE Type=\"1\" KeyType=\"0\" Name=\"' || max(p.title) || '\" Entries=\"' || count(*) || '\">' || string_agg('<TRACK Key=\"' || k.n || '\"/>', '' ORDER BY e.position, k.n) || '</NODE>' FROM e JOIN keyed k ON k.path = e.path JOIN r_playlists p ON p.id = e.playlist_id GROUP BY e.playlist_id")
def collection_lines(t: Tables) -> DataFrame:
    """The lines of an XML collection: each location once with a dense key, then the playlists with their keys."""
    full = t.playlists.where("sync_mode = 'full'").select(F.col("id").alias("playlist_id"), "title")
    tracks = t.tracks.select(F.col("id").alias("track_id"), F.concat(F.lit("m/"), F.col("id").cast("string"), F.lit(" x.mp3")).alias("path"), "artist", "title", "duration_ms")
    entries = t.membership.join(full.select("playlist_id"), "playlist_id", "left_semi").join(tracks, "track_id")
    return P.rekordbox_lines(entries, full).select(F.col("part").cast("int").alias("part"), "n", "line")


@query("WITH f AS (SELECT id, regexp_replace(title, '[^A-Za-z0-9._ -]+', '-', 'g') AS stem FROM r_playlists WHERE sync_mode = 'full' AND id % 3 = 0), n AS (SELECT id, stem || CASE WHEN k > 1 THEN '-' || CAST(k AS VARCHAR) ELSE '' END || '.m3u8' AS file FROM (SELECT *, row_number() OVER (PARTITION BY lower(stem) ORDER BY id) AS k FROM f)) SELECT n.id AS playlist_id, n.file, '#EXTM3U' || chr(10) || string_agg('#EXTINF:' || CAST(t.duration_ms // 1000 AS VARCHAR) || ',' || t.artist || ' - ' || t.title || chr(10) || 'm/' || CAST(t.id AS VARCHAR) || '.mp3' || chr(10), '' ORDER BY m.position) AS text FROM n JOIN r_membership m ON m.playlist_id = n.id JOIN r_tracks t ON t.id = m.track_id GROUP BY n.id, n.file")
def export_texts(t: Tables) -> DataFrame:
    """An export package of the fully synced playlists asked for, each with its file name."""
    playlists = t.playlists.select(F.col("id").alias("playlist_id"), "title", "sync_mode")
    tracks = t.tracks.select(F.col("id").alias("track_id"), F.concat(F.lit("m/"), F.col("id").cast("string"), F.lit(".mp3")).alias("path"), "artist", "title", "duration_ms")
    wanted = playlists.where("sync_mode = 'full' AND playlist_id % 3 = 0").select("playlist_id")
    return P.export_package(wanted, playlists, t.membership.join(tracks, "track_id"))[0]


@query("SELECT id, path AS source, '/q/s1/local-' || CAST(id AS VARCHAR) || '/' || path AS target FROM r_local")
def quarantine_targets(t: Tables) -> DataFrame:
    return P.quarantine_plan(t.local, "/q/", "s1")


# Scalar rules.


@query("SELECT id, trim(regexp_replace(lower(strip_accents('Café ' || title || ' (No. 1)')), '[^a-z0-9]+', ' ', 'g')) AS key FROM r_parts")
def ascii_keys(t: Tables) -> DataFrame:
    return t.parts.select("id", X.ascii_key(F.concat(F.lit("Café "), "title", F.lit(" (No. 1)"))).alias("key"))


@query("SELECT id, trim(regexp_replace(regexp_replace(title || ' [' || artist || '] & o''clock!  x', '[^\\w\\s'']+', ' ', 'g'), '\\s+', ' ', 'g')) AS q FROM r_parts")
def query_texts(t: Tables) -> DataFrame:
    return t.parts.select("id", X.query_text(F.concat("title", F.lit(" ["), "artist", F.lit("] & o'clock!  x"))).alias("q"))


@query("SELECT id, array_to_string(list_filter(list_transform(string_split(replace(album || ';' || artist || ', ' || title || ' ;,', ',', ';'), ';'), lambda x: trim(x)), lambda x: x <> ''), '|') AS tags FROM r_parts")
def tag_lists(t: Tables) -> DataFrame:
    """Text with two kinds of separators as trimmed parts."""
    return t.parts.select("id", F.array_join(X.split_tags(F.concat("album", F.lit(";"), "artist", F.lit(", "), "title", F.lit(" ;,"))), "|").alias("tags"))


@query("SELECT id, CAST(trunc(duration_ms / CAST(7 AS DOUBLE) * 1000) AS BIGINT) AS ms, CAST(floor(duration_ms / CAST(1000 AS DOUBLE)) AS BIGINT) AS seconds, greatest(CAST(5000 AS BIGINT), least(duration_ms, 20000)) AS clamped, CASE WHEN id % 3 = 0 THEN NULL ELSE CAST(id AS DOUBLE) END AS finite FROM r_parts")
def duration_units(t: Tables) -> DataFrame:
    i, ms = F.col("id"), F.col("duration_ms")
    odd = F.when(i % 6 == 0, float("nan")).when(i % 6 == 3, float("inf")).otherwise(i.cast("double"))
    return t.parts.select("id", N.milliseconds(ms / F.lit(7.0)).alias("ms"), F.floor(ms / F.lit(1000.0)).alias("seconds"), N.clamp(ms, 5000, 20000).alias("clamped"), N.finite(odd).alias("finite"))


@query("SELECT id, round(least(t * 0.68 + a * 0.26 + coalesce(b * 0.04, 0) + CASE WHEN abs(duration_ms - 20000) <= 10000 THEN 0.02 ELSE 0 END, 1), 9) AS score FROM (SELECT id, duration_ms, CAST(id % 101 AS DOUBLE) / 100 AS t, CAST(id % 7 AS DOUBLE) / 6 AS a, CASE WHEN id % 4 <> 0 THEN CAST(id % 11 AS DOUBLE) / 10 END AS b FROM r_parts)")
def composed_scores(t: Tables) -> DataFrame:
    """The score of a match out of its similarities, with unknown albums and durations near or far."""
    i = F.col("id")
    return t.parts.select("id", F.round(N.tag_score((i % 101) / 100.0, (i % 7) / 6.0, F.when(i % 4 != 0, (i % 11) / 10.0), F.col("duration_ms"), F.lit(20_000)), 9).alias("score"))


def _described(t: Tables) -> DataFrame:
    """Descriptor maps of the parts: tempo, loudness, brightness; some missing, some not finite."""
    i = F.col("id")
    pairs = [("tempo_bpm", F.when(i % 5 != 0, (i % 80 + 80).cast("double"))), ("rms_mean", F.when(i % 7 == 0, float("nan")).otherwise((i % 10) / 20.0)), ("spectral_centroid_mean", (i % 40 * 100).cast("double")), ("onset_strength_mean", (i % 20) / 10.0)]
    held = F.filter(F.array(*[F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in pairs]), lambda p: p["value"].isNotNull())
    return t.parts.select("id", F.col("artist").alias("path"), F.map_from_entries(held).alias("descriptors"))


DESCRIBED = "SELECT id, path, key, x FROM (SELECT id, artist AS path, 'tempo_bpm' AS key, CASE WHEN id % 5 <> 0 THEN CAST(id % 80 + 80 AS DOUBLE) END AS x FROM r_parts UNION ALL SELECT id, artist, 'rms_mean', CASE WHEN id % 7 <> 0 THEN CAST(id % 10 AS DOUBLE) / 20 END FROM r_parts UNION ALL SELECT id, artist, 'spectral_centroid_mean', CAST(id % 40 * 100 AS DOUBLE) FROM r_parts UNION ALL SELECT id, artist, 'onset_strength_mean', CAST(id % 20 AS DOUBLE) / 10 FROM r_parts) WHERE x IS NOT NULL"


@query(f"SELECT id, key, x FROM ({DESCRIBED})")
def descriptor_cells(t: Tables) -> DataFrame:
    """Typed cells out of ragged maps; what is missing or not finite is no cell."""
    return M.spread(_described(t))


@query(f"SELECT path, key, round(avg(x), 9) AS mean, count(*) AS n FROM ({DESCRIBED}) GROUP BY path, key")
def ragged_means(t: Tables) -> DataFrame:
    return M.descriptor_means(_described(t)).select("path", "key", F.round("mean", 9).alias("mean"), "n")


TRAIT_SQL = ", ".join(f"CASE WHEN m['{k}'] <= {low} THEN '{a}' WHEN m['{k}'] >= {high} THEN '{b}' END" for k, a, low, b, high in M.TRAITS)


@query(f"WITH d AS (SELECT id, map_from_entries(list((key, x))) AS m FROM ({DESCRIBED}) GROUP BY id), a AS (SELECT id, list_filter([{TRAIT_SQL}], lambda x: x IS NOT NULL) AS l FROM d) SELECT id, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i)[1:3], ',') AS traits FROM a")
def trait_labels(t: Tables) -> DataFrame:
    """Up to three labels of a descriptor map by its limits. Values that are not finite are no descriptors."""
    clean = _described(t).select("id", F.map_filter("descriptors", lambda _, v: ~F.isnan(v)).alias("d"))
    return clean.select("id", F.array_join(M.threshold_traits(F.col("d")), ",").alias("traits"))


@query("SELECT id FROM r_tracks WHERE title ILIKE '%an%' OR artist ILIKE '%an%' OR album ILIKE '%an%' UNION SELECT id FROM r_tracks WHERE id = 17 OR title ILIKE '%17%' OR artist ILIKE '%17%' OR album ILIKE '%17%'")
def matching_rows(t: Tables) -> DataFrame:
    """A table filtered by a word in any column or by a number."""
    columns = ["title", "artist", "album"]
    return t.tracks.where(R.matches(columns, " An ", ["id"]) | R.matches(columns, "17", ["id"])).select("id")


@query("WITH l AS (SELECT id, duration_ms AS size, lower(path) AS p FROM r_local), r AS (SELECT id, duration_ms AS size, lower(CASE WHEN id % 2 = 0 THEN 'disk/' || path WHEN id % 3 = 0 THEN 'other/' || title || ' ' || CAST(id AS VARCHAR) || '.mp3' ELSE title || ' ' || CAST(id AS VARCHAR) || '.mp3' END) AS p FROM r_local) SELECT l.id AS left_id, r.id AS right_id FROM l JOIN r ON string_split(l.p, '/')[-1] = string_split(r.p, '/')[-1] AND l.size = r.size WHERE string_split(l.p, '/')[-2] = string_split(r.p, '/')[-2] OR len(string_split(l.p, '/')) = 1 OR len(string_split(r.p, '/')) = 1")
def suffix_paths(t: Tables) -> DataFrame:
    """Paths that end alike, of equal size."""
    i, name = F.col("id"), F.concat("title", F.lit(" "), F.col("id").cast("string"), F.lit(".mp3"))
    other = F.when(i % 2 == 0, F.concat(F.lit("disk/"), "path")).when(i % 3 == 0, F.concat(F.lit("other/"), name)).otherwise(name)
    right = t.local.select("id", other.alias("path"), F.col("duration_ms").alias("size"), i.alias("updated_at"))
    return E.suffix_path_join(t.local.select("id", "path", F.col("duration_ms").alias("size")), right)


# Jobs.


@query("SELECT lower_id, higher_id, CASE WHEN lower_id % 2 = 0 THEN CASE type WHEN 'related' THEN 'equivalent' ELSE 'related' END ELSE type END AS type FROM r_edges WHERE lower_id % 7 <> 0 UNION ALL SELECT a.id, b.id, 'related' FROM r_tracks a JOIN r_tracks b ON b.id = a.id + 10 WHERE a.id % 10 = 1 AND NOT EXISTS (SELECT 1 FROM r_edges e WHERE e.lower_id = a.id AND e.higher_id = b.id)")
def edge_commands(t: Tables) -> DataFrame:
    """Edges after one batch of changes of type, deletions and creations; what is there is not created again."""
    flipped = F.when(F.col("type") == "related", "equivalent").otherwise("related")
    changed = t.edges.where("lower_id % 2 = 0").select("lower_id", "higher_id", flipped.alias("type"))
    created = t.tracks.where("id % 10 = 1").select(F.col("id").alias("lower_id"), (F.col("id") + 10).alias("higher_id"), F.lit("related").alias("type")).join(t.tracks.select(F.col("id").alias("higher_id")), "higher_id", "left_semi")
    return D.changed_edges(t.edges, created, changed, t.edges.where("lower_id % 7 = 0"))


@query("SELECT 'suggested' AS name, id FROM r_suggested WHERE track_id % 6 <> 1 UNION ALL SELECT 'final', id FROM r_final WHERE track_id % 6 <> 1")
def cascade_delete(t: Tables) -> DataFrame:
    """Rows that outlive the removal of some tracks."""
    left = D.without_references({"suggested": (t.suggested, "track_id"), "final": (t.final, "track_id")}, t.tracks.where("id % 6 = 1").select("id"))
    return left["suggested"].select(F.lit("suggested").alias("name"), "id").union(left["final"].select(F.lit("final"), "id"))


RUNS = "SELECT doc_id AS id, CASE doc_id % 4 WHEN 0 THEN 'queued' WHEN 1 THEN 'running' WHEN 2 THEN 'done' ELSE 'failed' END AS status, n_chars AS done FROM documents"


@query(f"SELECT id, CASE WHEN status = 'running' AND id % 3 = 0 THEN 'done' WHEN status = 'running' AND id % 3 = 1 THEN 'failed' WHEN status = 'queued' THEN 'running' ELSE status END AS status, CASE WHEN status = 'queued' THEN 0 ELSE done END AS done FROM ({RUNS})")
def run_states(t: Tables) -> DataFrame:
    """A run's life: queued ones start from nothing, running ones end well or badly, ended ones stay."""
    i = F.col("id")
    runs = t.docs.select("id", F.when(i % 4 == 0, "queued").when(i % 4 == 1, "running").when(i % 4 == 2, "done").otherwise("failed").alias("status"), F.col("duration_ms").alias("done"))
    running = F.col("status") == "running"
    ended = U.compare_and_set(runs, running & (i % 3 < 2), {"status": F.when(i % 3 == 0, "done").otherwise("failed")}).drop("matched")
    return U.compare_and_set(ended, F.col("status") == "queued", {"status": F.lit("running"), "done": F.lit(0).cast("long")}).drop("matched")


@query("SELECT key, attempts, CASE WHEN key % 3 = 0 THEN true WHEN key % 3 = 1 THEN false END AS ignored FROM (SELECT user_id AS key, count(*) AS attempts FROM events WHERE event_type <> 'view' GROUP BY user_id) WHERE NOT key % 5 = 4")
def failure_controls(t: Tables) -> DataFrame:
    """Counted failures after commands that ignore, restore and clear some."""
    held = U.counted_failures(t.events.where("event_type <> 'view'").select("key", "id", "ts", F.col("event_type").alias("reason"))).select("key", "attempts", F.lit(None).cast("boolean").alias("ignored"))
    k = F.col("key")
    told = U.compare_and_set(held, k % 3 < 2, {"ignored": k % 3 == 0}).drop("matched")
    return told.join(told.where(k % 5 == 4).select("key"), "key", "left_anti").select("key", "attempts", "ignored")


FEATURES = "SELECT doc_id AS id, CASE doc_id % 3 WHEN 0 THEN 'pending' WHEN 1 THEN 'ready' ELSE 'failed' END AS status, doc_id % 5 AS attempts, 'old' AS payload, CASE WHEN doc_id % 3 = 2 THEN 'bad' END AS failure FROM documents WHERE doc_id % 7 <> 0"
RESULTS = "SELECT doc_id AS id, CASE WHEN doc_id % 2 = 0 THEN doc_id % 5 ELSE doc_id % 5 + 1 END AS attempt, CASE doc_id % 4 WHEN 0 THEN 'ready' WHEN 1 THEN 'pending' WHEN 2 THEN 'failed' ELSE 'ready' END AS kind FROM documents WHERE doc_id % 3 <> 1"


@query(f"WITH x AS (SELECT coalesce(f.id, r.id) AS id, f.status, f.attempts, f.payload, f.failure, r.attempt, CASE WHEN r.kind = 'pending' THEN 'pending' WHEN f.status = 'pending' AND f.attempts = r.attempt THEN r.kind END AS k FROM ({FEATURES}) f FULL JOIN ({RESULTS}) r ON r.id = f.id) SELECT id, coalesce(k, status) AS status, CASE WHEN k = 'pending' THEN attempt ELSE attempts END AS attempts, CASE WHEN k = 'pending' THEN NULL WHEN k = 'ready' THEN 'new' ELSE payload END AS payload, CASE WHEN k = 'failed' THEN 'worse' WHEN k IS NOT NULL THEN NULL ELSE failure END AS failure FROM x WHERE status IS NOT NULL OR k = 'pending'")
def feature_writes(t: Tables) -> DataFrame:
    """Feature rows after results, of which late ones count for nothing."""
    i = F.col("id")
    rows = t.docs.where("id % 7 <> 0").select("id", F.when(i % 3 == 0, "pending").when(i % 3 == 1, "ready").otherwise("failed").alias("status"), (i % 5).alias("attempts"), F.lit("old").alias("payload"), F.when(i % 3 == 2, "bad").alias("failure"))
    kind = F.when(i % 4 == 1, "pending").when(i % 4 == 2, "failed").otherwise("ready")
    results = t.docs.where("id % 3 <> 1").select("id", F.when(i % 2 == 0, i % 5).otherwise(i % 5 + 1).alias("attempt"), kind.alias("kind"), F.lit("new").alias("payload"), F.lit("worse").alias("failure"))
    return D.written_features(rows, results)


@query("WITH g AS (SELECT fingerprint, min(id) AS low, list(id) AS ids FROM r_docs GROUP BY fingerprint HAVING count(*) > 1) SELECT * FROM (SELECT low, unnest(ids) AS id FROM g WHERE low % 2 = 0) WHERE id <> low")
def removed_duplicates(t: Tables) -> DataFrame:
    """Members that go where the smallest of a group is chosen as keeper; groups with an odd smallest one are dismissed."""
    g = E.merged_groups([E.equal_groups(t.docs, "fingerprint", "fingerprint_exact", 1.0)])
    low = F.split("ids", ",")[0].cast("long")
    removed, decisions = D.resolved_duplicates(g, g.select("group_key", F.when(low % 2 == 0, low).alias("keeper")))
    return removed.join(decisions.select("group_key", F.col("keeper").alias("low")), "group_key").select("low", "id")


@query(f"WITH c AS (SELECT {CODE} AS code, min(id) AS track_id FROM r_tracks GROUP BY 1), m AS (SELECT l.id AS local_id, c.track_id FROM (SELECT id, {CODE} AS code FROM r_local) l JOIN c ON c.code = l.code WHERE NOT EXISTS (SELECT 1 FROM r_suggested s WHERE s.status = 'rejected' AND s.local_id = l.id AND s.track_id = c.track_id)) SELECT local_id, track_id, status FROM r_suggested WHERE status IN ('approved', 'rejected') OR local_id NOT IN (SELECT local_id FROM m) UNION ALL SELECT local_id, track_id, 'pending' FROM m")
def rematch_by_code(t: Tables) -> DataFrame:
    """Stored proposals after matching the local tracks with a code again: their open proposals give way to the new one."""
    rejected = t.suggested.where("status = 'rejected'").select("local_id", "track_id")
    found = E.match_by_code(t.local, t.tracks).join(rejected, ["local_id", "track_id"], "left_anti")
    return D.rematched(t.suggested.select("local_id", "track_id", "status"), found)


STAGED = f"""
WITH x AS (SELECT t.id, {CODE} IS NOT NULL AS coded, EXISTS (SELECT 1 FROM r_membership m WHERE m.track_id = t.id) AS listed, EXISTS (SELECT 1 FROM r_suggested s WHERE s.track_id = t.id) AS suggested, EXISTS (SELECT 1 FROM r_suggested s WHERE s.track_id = t.id AND s.status <> 'rejected') AS alive, EXISTS (SELECT 1 FROM r_final f WHERE f.track_id = t.id) AS linked FROM r_tracks t),
s AS (SELECT *, CASE WHEN coded THEN 'succeeded' ELSE 'failed' END AS a FROM x), u AS (SELECT *, CASE WHEN a = 'failed' THEN 'skipped' WHEN listed THEN 'succeeded' ELSE 'failed' END AS b FROM s),
v AS (SELECT *, CASE WHEN b IN ('failed', 'skipped') THEN 'skipped' WHEN NOT suggested THEN 'not_applicable' WHEN alive THEN 'succeeded' ELSE 'failed' END AS c FROM u),
w AS (SELECT *, CASE WHEN c IN ('failed', 'skipped') THEN 'skipped' WHEN NOT alive THEN 'not_applicable' WHEN linked THEN 'succeeded' ELSE 'failed' END AS d FROM v)
SELECT place, stage, status, CAST(count(*) AS BIGINT) AS n FROM (SELECT 0 AS place, 'code' AS stage, a AS status FROM w UNION ALL SELECT 1, 'listing', b FROM w UNION ALL SELECT 2, 'suggestion', c FROM w UNION ALL SELECT 3, 'link', d FROM w) GROUP BY 1, 2, 3
"""


@query(STAGED)
def workflow_report(t: Tables) -> DataFrame:
    """Each track through four stages: a valid code, a place on a playlist, a suggestion that was not rejected where there is any, a link where one is alive; it stops at its first failure."""
    mark = lambda rows, name: rows.select(F.col("track_id").alias("id")).distinct().withColumn(name, F.lit(True))
    found = t.suggested.groupBy(F.col("track_id").alias("id")).agg(F.lit(True).alias("suggested"), F.max((F.col("status") != "rejected").cast("int")).alias("alive"))
    x = t.tracks.select("id", X.valid_isrc(F.col("isrc")).isNotNull().alias("coded")).join(mark(t.membership, "listed"), "id", "left").join(found, "id", "left").join(mark(t.final, "linked"), "id", "left")
    alive, yes = F.col("alive") == 1, F.lit(True)
    return D.staged_report(x, [("code", yes, F.col("coded")), ("listing", yes, F.col("listed")), ("suggestion", F.col("suggested"), alive), ("link", alive, F.col("linked"))])


@query(f"WITH c AS (SELECT {CODE} AS code, min(id) AS track_id FROM r_tracks GROUP BY 1), m AS (SELECT l.id AS local_id, c.track_id, 'isrc' AS method FROM (SELECT id, {CODE} AS code FROM r_local) l JOIN c ON c.code = l.code WHERE NOT EXISTS (SELECT 1 FROM r_suggested s WHERE s.status = 'rejected' AND s.local_id = l.id AND s.track_id = c.track_id)) SELECT local_id, track_id, method FROM m UNION ALL SELECT l.id, min(t.id), 'same' FROM r_local l JOIN r_tracks t ON t.artist = l.artist AND t.album = l.album WHERE l.id NOT IN (SELECT local_id FROM m) GROUP BY l.id")
def injected_matchers(t: Tables) -> DataFrame:
    """The matching pipeline with a matcher of the caller's own behind the one for codes."""

    def same(local: DataFrame, tracks: DataFrame, rejected: DataFrame) -> DataFrame:
        both = local.select(F.col("id").alias("local_id"), "artist", "album").join(tracks.select(F.col("id").alias("track_id"), "artist", "album"), ["artist", "album"])
        return both.groupBy("local_id").agg(F.min("track_id").alias("track_id")).withColumn("score", F.lit(0.5))

    rejected = t.suggested.where("status = 'rejected'")
    return E.match_all(t.local, t.tracks, rejected, (("isrc", E.by_code), ("same", same))).select("local_id", "track_id", "method")


@query("SELECT s.id, s.status, CASE WHEN s.id % 3 = 0 AND s.track_id % 4 = s.local_id % 4 THEN 'seen' ELSE s.method END AS method, s.track_id % 4 + CASE WHEN s.id % 3 = 0 AND s.track_id % 4 = s.local_id % 4 THEN 1 ELSE 0 END AS version FROM r_suggested s")
def versioned_update(t: Tables) -> DataFrame:
    """Updates that name the version they have read; those of another version change nothing."""
    rows = t.suggested.select("id", "status", "method", (F.col("track_id") % 4).alias("version"))
    asked = t.suggested.where("id % 3 = 0").select("id", (F.col("local_id") % 4).alias("version"), F.lit("seen").alias("value"))
    return U.versioned(rows, asked, "method")[0]


@query("SELECT s.id, CASE WHEN s.track_id % 4 = s.local_id % 4 THEN 'done' ELSE 'conflict' END AS outcome FROM r_suggested s WHERE s.id % 3 = 0 UNION ALL SELECT -id, 'not_found' FROM r_local WHERE id % 50 = 0 AND id > 0")
def versioned_outcomes(t: Tables) -> DataFrame:
    rows = t.suggested.select("id", "method", (F.col("track_id") % 4).alias("version"))
    asked = t.suggested.where("id % 3 = 0").select("id", (F.col("local_id") % 4).alias("version"), F.lit("seen").alias("value"))
    lost = t.local.where("id % 50 = 0 AND id > 0").select((-F.col("id")).alias("id"), F.lit(0).cast("long").alias("version"), F.lit("seen").alias("value"))
    return U.versioned(rows, asked.unionByName(lost), "method")[1]


@query("SELECT id, title AS name, CAST(duration_ms AS VARCHAR) AS duration_ms, TRY_CAST(substr(isrc, 8) AS INTEGER) AS isrc, CAST(NULL AS VARCHAR) AS note FROM (SELECT id, title, duration_ms, CASE WHEN isrc LIKE 'USABC24%' THEN isrc ELSE 'xxxxxxx' || isrc END AS isrc FROM r_parts)")
def schema_migration(t: Tables) -> DataFrame:
    """Rows under a new schema: a column renamed, one of another type, one new, others gone."""
    old = t.parts.withColumn("isrc", F.when(F.col("isrc").startswith("USABC24"), F.substr("isrc", F.lit(8))).otherwise(F.col("isrc")))
    return U.migrated(old, {"id": "bigint", "name": "string", "duration_ms": "string", "isrc": "int", "note": "string"}, {"title": "name"})


@query("SELECT id, title, link_status FROM (SELECT *, row_number() OVER (ORDER BY title, id) AS n FROM r_library) WHERE n BETWEEN (SELECT least(max(CASE WHEN id = 150 THEN n END), max(CASE WHEN id = 20 THEN n END)) FROM (SELECT id, row_number() OVER (ORDER BY title, id) AS n FROM r_library)) AND (SELECT greatest(max(CASE WHEN id = 150 THEN n END), max(CASE WHEN id = 20 THEN n END)) FROM (SELECT id, row_number() OVER (ORDER BY title, id) AS n FROM r_library))")
def range_selection(t: Tables) -> DataFrame:
    """The rows of a sorted view between two that were picked."""
    view = t.library.select("id", "title", "link_status")
    return R.between_rows(view, [F.col("title"), F.col("id")], F.col("id") == 150, F.col("id") == 20)


@query("SELECT id, json_object('id', id, 'title', title, 'match', json_object('status', link_status, 'known', final_id IS NOT NULL)) AS body FROM r_library")
def record_bodies(t: Tables) -> DataFrame:
    """Records as the nested bodies of a response."""
    body = F.struct("id", "title", F.struct(F.col("link_status").alias("status"), F.col("final_id").isNotNull().alias("known")).alias("match"))
    return t.library.select("id", F.to_json(body).alias("body"))


@query("SELECT state, count(*) AS n, min(id) AS oldest FROM (SELECT key AS id, arg_max(state, (ts, id)) AS state FROM r_events GROUP BY key) GROUP BY state")
def queue_depth(t: Tables) -> DataFrame:
    """How many jobs wait in each state, and the first of each."""
    from tonearm.streaming.folds import latest_state

    return latest_state(t.events).groupBy("state").agg(F.count("*").alias("n"), F.min("key").alias("oldest"))
