"""Provider sources through Spark's Python Data Source API: one partition per account, no call for what is not wanted, failing playlists as rows.

A client is any object with three methods: ``accounts()`` gives the ids; ``playlists(account)`` gives the listing, an iterable of mappings with
``playlistId``, ``title`` and ``mode``; ``tracks(account, item)`` gives the payload of a listed playlist as JSON text. A client raises
:class:`RefusedAccount` where a provider no longer accepts an account: that ends the job. What else ``tracks`` raises becomes the playlist's ``error``.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Collection, Iterator, Mapping
from dataclasses import dataclass
from urllib.parse import quote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tonearm.sources.catalogue_store import provider_tracks

SCHEMA = "account_id bigint, playlist_id string, title string, sync_mode string, payload string, error string"
#: Columns known before a playlist's tracks are asked for.
KNOWN = ("account_id", "playlist_id", "sync_mode")
#: Modes in which a playlist's tracks are fetched.
ACTIVE_MODES = ("full", "match_only")


class RefusedAccount(Exception):
    """The provider refuses the account's credentials; no playlist of it can be read."""


@dataclass
class Account(InputPartition):
    value: int


class _Reader(DataSourceReader):
    def __init__(self, make_client: Callable[[], object], only: Mapping[str, Collection], fetch: bool):
        self.make_client, self.only, self.fetch = make_client, only, fetch

    def _asked(self, **known: object) -> bool:
        return all(value in self.only[name] for name, value in known.items() if name in self.only)

    def partitions(self) -> list[InputPartition]:
        # A reader without partitions is read once as a whole; an account of its own stands for none.
        return [Account(int(a)) for a in self.make_client().accounts() if self._asked(account_id=int(a))] or [Account(-1)]

    def read(self, partition: Account) -> Iterator[tuple]:
        account = partition.value
        if account < 0:
            return
        client = self.make_client()
        for item in client.playlists(account):
            key, mode = item.get("playlistId"), item.get("mode")
            if key is None or not self._asked(playlist_id=str(key), sync_mode=mode):
                continue
            payload, error = None, None
            if self.fetch:
                try:
                    payload = client.tracks(account, item)
                except RefusedAccount:
                    raise
                except Exception as e:  # noqa: BLE001  whatever else a provider raises is this playlist's alone
                    error = f"{type(e).__name__}: {e}"
            yield account, str(key), item.get("title"), mode, payload, error


def provider_source(name: str, make_client: Callable[[], object], only: Mapping[str, Collection] | None = None, tracks: bool = True) -> type[DataSource]:
    """A data source called ``name`` that reads through the clients that ``make_client`` makes in each task."""
    wanted = {k: frozenset(v) for k, v in (only or {}).items()}
    if unknown := set(wanted) - set(KNOWN):
        raise ValueError(f"not known before a call: {sorted(unknown)}")

    class Provider(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return SCHEMA

        def reader(self, schema) -> DataSourceReader:
            return _Reader(make_client, wanted, tracks)

    return Provider


def read_provider(spark: SparkSession, name: str, make_client: Callable[[], object], only: Mapping[str, Collection] | None = None, tracks: bool = True) -> DataFrame:
    """(account_id, playlist_id, title, sync_mode, payload, error) of all listed playlists, lazily: every action calls the provider again, so write the result once.

    ``only`` gives the wanted values of ``account_id``, ``playlist_id`` or ``sync_mode``; nothing else is asked for. Without ``tracks`` playlists are
    listed and no payload is fetched. The wish is an argument and no filter that Spark pushes, since Spark 4.1 keeps the pushed filters of a Python
    source's last planned scan for all other scans of it: a union of two filtered reads gave the rows of one of them twice.
    """
    spark.dataSource.register(provider_source(name, make_client, only, tracks))
    return spark.read.format(name).load()


def outcome(payload: Column, error: Column) -> Column:
    """The error of a fetched playlist: the call's own, or that of a payload without a list of tracks; null where it can be used."""
    listed = F.coalesce(F.trim(F.get_json_object(payload, "$.tracks")).startswith("["), F.lit(False))
    return F.coalesce(error, F.when(~listed, F.lit("malformed payload")))


def synced(stored: DataFrame, fetched: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(membership, states) once the tracks of ``fetched`` replace those in ``stored`` (playlist_id, position, track_id).

    A playlist with an error keeps what is stored, one that came empty loses its tracks, one that was not fetched stays. States are
    (account_id, playlist_id, n_tracks, error). Listed twice, a playlist counts once: an answer before an error, then the smallest account.
    """
    judged = fetched.withColumn("error", outcome(F.col("payload"), F.col("error")))
    best = F.min(F.struct(F.col("error").isNotNull().alias("failed"), "account_id", "error", "payload"))
    one = judged.groupBy("playlist_id").agg(best.alias("x")).select("playlist_id", "x.account_id", "x.payload", "x.error")
    good = one.where("error IS NULL")
    tracks = provider_tracks(good).select("playlist_id", "position", F.col("id").alias("track_id"))
    kept = stored.join(good.select("playlist_id"), "playlist_id", "left_anti")
    counts = tracks.groupBy("playlist_id").agg(F.count("*").alias("n"))
    states = one.join(counts, "playlist_id", "left").select("account_id", "playlist_id", F.when(F.col("error").isNull(), F.coalesce("n", F.lit(0))).alias("n_tracks"), "error")
    return kept.select("playlist_id", "position", "track_id").unionByName(tracks), states


def land(items: DataFrame, path: str) -> None:
    """Write (account_id, playlistId, title, mode, status, payload) as one folder of JSON lines per account, the form that :class:`LandedClient` reads."""
    line = F.to_json(F.struct("playlistId", "title", "mode", "status", "payload")).alias("value")
    items.select(line, F.col("account_id").cast("long").alias("account_id")).repartition("account_id").write.partitionBy("account_id").text(path)


class LandedClient:
    """A provider's answers as :func:`land` wrote them, read file by file and line by line: status 401 refuses the account, others over 399 fail the call."""

    def __init__(self, path: str):
        self.path = path

    def _at(self, inside: str = ""):
        from pyarrow import fs

        path = f"{self.path.rstrip('/')}/{inside}".rstrip("/")
        if path.startswith("file:/") and not path.startswith("file:///"):
            path = path[len("file:") :]
        return fs.FileSystem.from_uri(path if path.startswith("/") else quote(path, safe=":/=%@-._~"))

    def _children(self, inside: str = ""):
        from pyarrow import fs

        files, path = self._at(inside)
        return files, files.get_file_info(fs.FileSelector(path, allow_not_found=True))

    def accounts(self) -> list[int]:
        return sorted(int(x.base_name.split("=")[1]) for x in self._children()[1] if x.base_name.startswith("account_id="))

    def playlists(self, account: int) -> Iterator[dict]:
        import io

        files, found = self._children(f"account_id={account}")
        for x in sorted((x for x in found if not x.base_name.startswith(("_", "."))), key=lambda x: x.path):
            with files.open_input_stream(x.path) as f:
                for line in io.TextIOWrapper(f, encoding="utf-8", newline="\n"):
                    yield json.loads(line)

    def tracks(self, account: int, item: dict) -> str | None:
        status = item.get("status") or 200
        if status == 401:
            raise RefusedAccount(f"account {account} was refused")
        if status > 399:
            raise OSError(f"status {status}")
        return item.get("payload")
