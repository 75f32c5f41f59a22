"""Playlist text and XML sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tonearm.functions.text import file_name
from tonearm.operators.ranking import numbered


def m3u_text(entries: DataFrame, extended: bool = True) -> DataFrame:
    """(playlist_id, text, skipped) of (playlist_id, position, path, artist, title, duration_ms); rows without a path are skipped and counted."""
    seconds = F.coalesce(F.floor(F.col("duration_ms") / 1000).cast("string"), F.lit("-1"))
    info = F.concat(F.lit("#EXTINF:"), seconds, F.lit(","), F.coalesce("artist", F.lit("")), F.lit(" - "), F.coalesce("title", F.lit("")), F.lit("\n")) if extended else F.lit("")
    line = F.when(F.col("path").isNotNull(), F.concat(info, "path", F.lit("\n")))
    g = entries.groupBy("playlist_id").agg(F.array_sort(F.collect_list(F.struct("position", line.alias("line")))).alias("x"), F.count_if(F.col("path").isNull()).alias("skipped"))
    body = F.array_join(F.filter(F.transform("x", lambda v: v["line"]), lambda v: v.isNotNull()), "")
    return g.select("playlist_id", F.concat(F.lit("#EXTM3U\n"), body).alias("text"), "skipped")


def file_names(playlists: DataFrame) -> DataFrame:
    """(playlist_id, file): safe stems; the nth playlist of a stem, blind to case, gets ``-n``."""
    stem = playlists.select("playlist_id", file_name(F.col("title"), F.lit("playlist")).alias("stem"))
    n = F.row_number().over(W.partitionBy(F.lower("stem")).orderBy("playlist_id"))
    return stem.select("playlist_id", F.concat("stem", F.when(n > 1, F.concat(F.lit("-"), n.cast("string"))).otherwise(F.lit("")), F.lit(".m3u8")).alias("file"))


def write_m3u(entries: DataFrame, playlists: DataFrame, path: str) -> None:
    """One folder per playlist file under ``path``, each with its text."""
    named = m3u_text(entries).join(file_names(playlists), "playlist_id")
    named.select("file", F.col("text").alias("value")).write.partitionBy("file").option("lineSep", "\n").text(path)


def file_url(path: Column) -> Column:
    """``file://localhost/...`` with blanks and reserved characters percent-encoded, slashes kept."""
    return F.concat(F.lit("file://localhost"), F.replace(F.replace(F.url_encode(path), F.lit("%2F"), F.lit("/")), F.lit("+"), F.lit("%20")))


def _xml(x: Column) -> Column:
    out = F.coalesce(x.cast("string"), F.lit(""))
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def rekordbox_lines(entries: DataFrame, playlists: DataFrame) -> DataFrame:
    """(part, n, line): collection tracks with dense ids in first-seen order, then playlist nodes with their track keys.

    Only distinct locations are numbered; nodes are then joined back.
    """
    found = entries.where(F.col("path").isNotNull())
    first = found.groupBy("path").agg(F.min(F.struct("playlist_id", "position", "artist", "title", "duration_ms")).alias("x"))
    ranked = numbered(first.select("path", "x.*"), [F.col("playlist_id"), F.col("position"), F.col("path")], "track_key")
    seconds = F.coalesce(F.floor(F.col("duration_ms") / 1000), F.lit(0)).cast("string")
    track = F.concat(F.lit('<TRACK TrackID="'), F.col("track_key").cast("string"), F.lit('" Name="'), _xml(F.col("title")), F.lit('" Artist="'), _xml(F.col("artist")), F.lit('" TotalTime="'), seconds, F.lit('" Location="'), _xml(file_url(F.col("path"))), F.lit('"/>'))
    tracks = ranked.select(F.lit(0).alias("part"), F.col("track_key").cast("long").alias("n"), track.alias("line"))
    keys = found.join(ranked.select("path", "track_key"), "path").groupBy("playlist_id").agg(F.array_sort(F.collect_list(F.struct("position", "track_key"))).alias("x"))
    inner = F.array_join(F.transform("x", lambda v: F.concat(F.lit('<TRACK Key="'), v["track_key"].cast("string"), F.lit('"/>'))), "")
    node = F.concat(F.lit('<NODE Type="1" KeyType="0" Name="'), _xml(F.col("title")), F.lit('" Entries="'), F.size("x").cast("string"), F.lit('">'), inner, F.lit("</NODE>"))
    nodes = keys.join(playlists.select("playlist_id", "title"), "playlist_id").select(F.lit(1).alias("part"), F.col("playlist_id").alias("n"), node.alias("line"))
    return tracks.unionByName(nodes)


def rekordbox_xml(entries: DataFrame, playlists: DataFrame, path: str) -> None:
    """One XML document: sorted lines between fixed heads, written as one file; the text is proportional to the export asked for."""
    lines = rekordbox_lines(entries, playlists)
    spark = lines.sparkSession
    n = {r.part: r.n for r in lines.groupBy("part").agg(F.count("*").alias("n")).collect()}
    heads = [(-1, 0, f'<?xml version="1.0" encoding="UTF-8"?>\n<DJ_PLAYLISTS Version="1.0.0">\n<COLLECTION Entries="{n.get(0, 0)}">'), (0, 1 << 62, f'</COLLECTION>\n<PLAYLISTS>\n<NODE Type="0" Name="ROOT" Count="{n.get(1, 0)}">'), (2, 0, "</NODE>\n</PLAYLISTS>\n</DJ_PLAYLISTS>")]
    whole = lines.unionByName(spark.createDataFrame(heads, "part int, n long, line string"))
    whole.orderBy("part", "n").coalesce(1).select(F.col("line").alias("value")).write.text(path)


def zipped(texts: DataFrame, target) -> int:
    """Write (file, text) rows into the open binary file ``target`` as a ZIP archive, one entry at a time; returns the entries. Rows pass through the driver one by one."""
    import zipfile

    n = 0
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for r in texts.select("file", "text").orderBy("file").toLocalIterator():
            z.writestr(r.file, r.text)
            n += 1
    return n


def quarantine_plan(tracks: DataFrame, root: str, stamp: str) -> DataFrame:
    """(id, source, target): where each file of (id, path) would be moved; moving is not the engine's part."""
    return tracks.select("id", F.col("path").alias("source"), F.concat(F.lit(f"{root.rstrip('/')}/{stamp}/local-"), F.col("id").cast("string"), F.lit("/"), "path").alias("target"))


def export_package(wanted: DataFrame, playlists: DataFrame, entries: DataFrame) -> tuple[DataFrame, dict]:
    """(texts, totals) of the ids in ``wanted``: a missing or not fully synced id is an error that names the smallest one."""
    known = playlists.where(F.col("sync_mode") == "full").select("playlist_id")
    if (lost := wanted.join(known, "playlist_id", "left_anti").agg(F.min("playlist_id")).first()[0]) is not None:
        raise ValueError(f"no fully synced playlist {lost}")
    own = wanted.select("playlist_id").distinct()
    names = file_names(playlists.join(own, "playlist_id", "left_semi").select("playlist_id", "title"))
    texts = m3u_text(entries.join(own, "playlist_id", "left_semi")).join(names, "playlist_id")
    t = entries.join(own, "playlist_id", "left_semi").agg(F.count("path").alias("exported"), F.count_if(F.col("path").isNull()).alias("skipped")).first()
    return texts.select("playlist_id", "file", "text"), {"exported": t.exported, "skipped": t.skipped}
