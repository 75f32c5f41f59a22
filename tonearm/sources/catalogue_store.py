"""Landed sources: attribute rows, typed decoding, provider JSON, folder listings, per-key lookups that may fail."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words that mean false.
FALSE_WORDS = ("0", "false", "f", "no", "n", "off", "")
#: Catalogue field types and their columns.
FIELD_TYPES = {"Integer": "bigint", "PaddedInt": "bigint", "Float": "double", "String": "string", "PathType": "string", "Boolean": "boolean", "DateType": "timestamp", "DurationType": "double"}


def read_table(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def schema_of(fields: dict[str, str]) -> str:
    """A schema out of a registry of field types; an unknown type is an error."""
    if unknown := {t for t in fields.values() if t not in FIELD_TYPES}:
        raise ValueError(f"unknown field types: {sorted(unknown)}")
    return ", ".join(f"`{n}` {FIELD_TYPES[t]}" for n, t in fields.items())


def attributes(rows: DataFrame) -> DataFrame:
    """(entity_id, attributes): key-value rows as a map; null values are empty, of repeated keys the greatest value stays."""
    one = rows.groupBy("entity_id", "key").agg(F.max(F.coalesce("value", F.lit(""))).alias("value"))
    return one.groupBy("entity_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "value")))).alias("attributes"))


def decoded(x: Column, kind: str) -> Column:
    """A stored text as its type: epoch seconds to time, words to booleans, numbers rounded half-even to integers, bytes to text."""
    t = F.trim(x.cast("string"))
    number = t.try_cast("double")
    return {"timestamp": F.timestamp_micros((number * 1_000_000).cast("long")), "boolean": ~F.lower(t).isin(*FALSE_WORDS), "bigint": F.bround(number).cast("long"), "double": number, "string": x.cast("string")}[kind]


def typed(df: DataFrame, fields: dict[str, str]) -> DataFrame:
    return df.select(*[decoded(F.col(n), FIELD_TYPES[t]).alias(n) for n, t in fields.items()])


def provider_playlists(raw: DataFrame, column: str = "payload") -> DataFrame:
    """(id, title, count) of listed playlists; rows without id or title go, counts lose their commas."""
    x = raw.select(F.explode(F.from_json(column, "array<struct<playlistId:string,title:string,count:string>>")).alias("x"))
    count = F.replace("x.count", F.lit(","), F.lit("")).try_cast("int")
    return x.select(F.col("x.playlistId").alias("id"), F.col("x.title").alias("title"), F.when(count >= 0, count).alias("count")).where("id IS NOT NULL AND title IS NOT NULL")


def provider_tracks(raw: DataFrame, column: str = "payload") -> DataFrame:
    """(playlist_id, position, id, title, artist, album, duration_ms, isrc) of listed tracks; rows without id, title or artist go; artists are joined with commas."""
    item = "struct<videoId:string,title:string,artists:array<struct<name:string>>,album:struct<name:string>,duration_seconds:bigint,isrc:string>"
    x = raw.select("playlist_id", F.posexplode(F.from_json(column, f"struct<tracks:array<{item}>>")["tracks"]).alias("pos", "x"))
    artist = F.array_join(F.filter(F.transform("x.artists", lambda a: a["name"]), lambda n: n.isNotNull()), ", ")
    out = x.select("playlist_id", (F.col("pos") + 1).alias("position"), F.col("x.videoId").alias("id"), F.col("x.title").alias("title"), F.nullif(artist, F.lit("")).alias("artist"), F.col("x.album.name").alias("album"), (F.col("x.duration_seconds") * 1000).alias("duration_ms"), F.col("x.isrc").alias("isrc"))
    return out.where("id IS NOT NULL AND title IS NOT NULL AND artist IS NOT NULL")


def best_thumbnail(x: Column) -> Column:
    """Url of the largest area in array<struct<url,width,height>>; missing sizes are zero, the first of equals wins."""
    ranked = F.transform(x, lambda v, i: F.struct((F.coalesce(v["width"], F.lit(0)) * F.coalesce(v["height"], F.lit(0))).alias("a"), (-i).alias("i"), v["url"].alias("u")))
    return F.array_max(ranked)["u"]


def looked_up(ids: DataFrame, lookup: Callable[[str], str | None], out: str = "isrc") -> DataFrame:
    """(id, out, error) of one call per distinct id: an answer, or what the call that failed said; an id without an answer is absent. One failing id fails no other."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for i in pdf["id"]:
                value, error = None, None
                try:
                    value = lookup(i)
                except Exception as e:  # noqa: BLE001  whatever a source raises becomes a row
                    error = f"{type(e).__name__}: {e}"
                if value or error:
                    rows.append((i, value or None, error))
            yield pd.DataFrame(rows, columns=["id", out, "error"])

    return ids.select("id").distinct().mapInPandas(run, f"id string, {out} string, error string")


def listing(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, modificationTime) of all files under ``path``; contents are not read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length", "modificationTime")


#: The names, in lower case, that a code goes by in payloads.
CODE_NAMES = ("isrc", "internationalstandardrecordingcode")


def nested_code(payload: str | None) -> str | None:
    """The first non-empty text under a code's name, in any case and at any depth, in the order of the document: a name's own value comes before what is nested in it.

    Escapes are read as JSON has them; of a name given twice the last value counts, at the first one's place. A text that is no JSON, or nested deeper than the parser goes, has no code.
    """
    try:
        waiting = [json.loads(payload)] if payload else []
    except (ValueError, RecursionError):
        return None
    while waiting:
        held = waiting.pop()
        if isinstance(held, tuple):
            name, held = held
            if name.lower() in CODE_NAMES and isinstance(held, str) and held:
                return held
        if isinstance(held, dict):
            waiting.extend(reversed(held.items()))
        elif isinstance(held, list):
            waiting.extend(reversed(held))
    return None


def recursive_code(x: Column) -> Column:
    """:func:`nested_code` of each JSON text, in Arrow batches: no SQL function keeps the order of a document's names."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(nested_code, na_action="ignore")

    return run(x)
