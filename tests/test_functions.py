"""Scalar functions, similarity, sources and sinks."""

import pytest
from pyspark.sql import functions as F

from tonearm.functions import numeric as N
from tonearm.functions import similarity as S
from tonearm.functions import text as X
from tonearm.sources import catalogue_store as K
from tonearm.sources import playlists as P


def one(spark, value, column, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x"))).first()[0]


@pytest.mark.parametrize("raw, want", [("GB-UM7-21-05976", "GBUM72105976"), (" gbum72105976 ", "GBUM72105976"), ("N/A", None), ("unknown", None), ("ISRC-track-3", None), ("ABC123456789", "ABC123456789"), (None, None), ("", None)])
def test_codes(spark, raw, want):
    assert one(spark, raw, X.valid_isrc) == want


def test_text_keys(spark):
    assert one(spark, "  A \t B  ", X.match_text) == "a b" and one(spark, "  ", X.match_text) is None
    assert one(spark, "onlyl ft. tsha & nimmo (original mix)", X.title_identity) == "onlyl"
    assert one(spark, "(original mix)", X.title_identity) == "(original mix)"
    assert one(spark, "blue train - live at home", X.title_key) == "blue train"
    assert one(spark, "song (live) remix", X.version_words) == ["live", "remix"]
    assert one(spark, "Straße", X.casefolded) == "strasse"
    assert one(spark, "Café & Ñandú!", X.ascii_key) == "cafe nandu"


@pytest.mark.parametrize("artist, title, album, want", [("Jon Hopkins", "Open Eye Signal", "Immunity", ["Jon Hopkins Open Eye Signal", "Jon Hopkins Immunity", "Open Eye Signal"]), ("Daphni", "Cloudy (Kelbin Remix)", None, ["Daphni Cloudy Kelbin Remix", "Daphni Cloudy", "Cloudy Kelbin Remix", "Cloudy"])])
def test_query_variants(spark, artist, title, album, want):
    d = spark.createDataFrame([(artist, title, album)], "a string, t string, l string")
    assert d.select(X.query_variants(F.col("a"), F.col("t"), F.col("l"))).first()[0] == want


def test_paths(spark):
    p = r"Jon Hopkins\Immunity (2013)\01 - Open Eye Signal.FLAC"
    assert one(spark, p, X.suffix) == ".flac" and one(spark, p, X.basename) == "01 - Open Eye Signal.FLAC"
    assert one(spark, p, X.title_in_path) == "Open Eye Signal" and one(spark, p, lambda x: X.context_in_path(x, False)) == "Jon Hopkins Immunity"
    assert [one(spark, x, X.unsafe_path) for x in ("/a", r"\a", "a//b", "a/../b", "./a", "a/b")] == [True, True, False, True, True, False]
    assert one(spark, "a/b #1 (x).mp3", lambda x: X.file_name(x, F.lit("playlist"))) == "a-b -1 -x-.mp3"
    assert one(spark, "***", lambda x: X.file_name(x, F.lit("playlist"))) == "playlist"
    assert one(spark, "music/a b/ü&.mp3", P.file_url) == "file://localhostmusic/a%20b/%C3%BC%26.mp3"


def test_similarity():
    assert S.token_set_ratio("a b c", "c b") == 100 and S.token_set_ratio("", "a") == 0
    assert S.token_sort_ratio("new york mets", "mets york new") == 100
    assert S.indel_ratio("kitten", "sitting") == pytest.approx(100 - 100 * 5 / 13)
    assert S.lcs_length("abcbdab", "bdcaba") == 4


def test_numbers(spark):
    assert [one(spark, x, N.octave_fold, "double") for x in (42.5, 85.0, 170.0, 171.0, 0.0, 700.0)] == [85.0, 85.0, 170.0, 85.5, None, 87.5]
    assert one(spark, 123456789, lambda x: N.seeded_rank(x, 7), "long") == (123456789 * 1103515245 + 7 * 12345) & 0xFFFFFFFF
    assert one(spark, [3.0, 1.0, 2.0, 10.0], lambda x: N.nearest_rank(x, 0.5), "array<double>") == 3.0
    assert one(spark, float("inf"), N.finite, "double") is None
    assert one(spark, 0.41, N.energy_band, "double") == "Medium Energy"


def test_attributes_and_decoding(spark):
    rows = spark.createDataFrame([(1, "a", None), (1, "b", "2"), (2, "a", "x")], "entity_id long, key string, value string")
    assert {r.entity_id: r.attributes for r in K.attributes(rows).collect()} == {1: {"a": "", "b": "2"}, 2: {"a": "x"}}
    raw = spark.createDataFrame([("2.5", "No", "86400.5", "1.25", "p")], "n string, b string, t string, d string, s string")
    out = K.typed(raw, {"n": "Integer", "b": "Boolean", "t": "DateType", "d": "Float", "s": "String"}).first()
    assert (out.n, out.b, out.d, out.s) == (2, False, 1.25, "p") and out.t.isoformat() == "1970-01-02T00:00:00.500000"
    assert K.schema_of({"a": "Integer"}) == "`a` bigint"
    with pytest.raises(ValueError):
        K.schema_of({"a": "Unheard"})


def test_provider_json(spark):
    lists = spark.createDataFrame([('[{"playlistId":"p","title":"T","count":"1,234"},{"title":"no id"},{"playlistId":"q","title":"U","count":"many"}]',)], "payload string")
    assert sorted((r.id, r["count"]) for r in K.provider_playlists(lists).collect()) == [("p", 1234), ("q", None)]
    tracks = spark.createDataFrame([("p", '{"tracks":[{"videoId":"v","title":"T","artists":[{"name":"A"},{"name":"B"}],"album":{"name":"L"},"duration_seconds":3},{"videoId":"w","title":"no artist","artists":[]}]}')], "playlist_id string, payload string")
    out = K.provider_tracks(tracks).collect()
    assert [(r.id, r.artist, r.duration_ms, r.position) for r in out] == [("v", "A, B", 3000, 1)]
    thumb = spark.createDataFrame([([("a", 2, 2), ("b", 4, 1), ("c", None, 9)],)], "x array<struct<url:string,width:int,height:int>>")
    assert thumb.select(K.best_thumbnail(F.col("x"))).first()[0] == "a"
    assert one(spark, '{"a":{"ISRC":"US1"}}', K.recursive_code) == "US1" and one(spark, "{}", K.recursive_code) is None


def test_failing_lookups_are_rows_of_their_own(spark):
    def lookup(i):
        if i == "bad":
            raise OSError("down")
        return {"a": "X"}.get(i)

    ids = spark.createDataFrame([("a",), ("a",), ("bad",), ("none",)], "id string")
    found = {r.id: (r.isrc, r.error) for r in K.looked_up(ids, lookup).collect()}
    assert found.pop("a") == ("X", None) and all(value is None and error for value, error in found.values())


ENTRIES = "playlist_id long, position long, path string, artist string, title string, duration_ms long"


def test_m3u(spark, tmp_path):
    e = spark.createDataFrame([(7, 1, "b.mp3", "B", "Two", 121000), (7, 3, "a.mp3", "A", "One", None), (7, 2, None, "C", "Gone", 1)], ENTRIES)
    r = P.m3u_text(e).first()
    assert r.text == "#EXTM3U\n#EXTINF:121,B - Two\nb.mp3\n#EXTINF:-1,A - One\na.mp3\n" and r.skipped == 1
    names = spark.createDataFrame([(7, "My/List"), (8, "my-list")], "playlist_id long, title string")
    assert sorted(x.file for x in P.file_names(names).collect()) == ["My-List.m3u8", "my-list-2.m3u8"]
    P.write_m3u(e, names, str(tmp_path / "m3u"))
    assert [p.name for p in (tmp_path / "m3u").iterdir() if p.is_dir()] == ["file=My-List.m3u8"]


def test_rekordbox(spark, tmp_path):
    import xml.etree.ElementTree as ET

    e = spark.createDataFrame([(1, 1, "x/b&.mp3", "B", "T<w>o", 121000), (1, 2, "x/a.mp3", "A", "One", None), (2, 1, "x/b&.mp3", "B", "Two", 121000)], ENTRIES)
    P.rekordbox_xml(e, spark.createDataFrame([(1, "first"), (2, "second")], "playlist_id long, title string"), str(tmp_path / "xml"))
    text = "".join(p.read_text() for p in sorted((tmp_path / "xml").glob("part-*")))
    root = ET.fromstring(text)
    assert [t.get("TrackID") for t in root.iter("TRACK") if t.get("TrackID")] == ["1", "2"]
    assert [[t.get("Key") for t in n.findall("TRACK")] for n in root.iter("NODE") if n.get("Type") == "1"] == [["1", "2"], ["1"]]


def test_state_machine_matches_fold(spark, tmp_path):
    from tonearm.streaming import folds, streams

    rows = [(1, i, f"2024-01-01 00:00:{i:02d}", s) for i, s in enumerate(["searching", "queued", "linked", "queued", "failed"])] + [(2, 9, "2024-01-01 00:00:09", "queued")]
    d = spark.createDataFrame(rows, "key long, id long, t string, state string").selectExpr("key", "id", "CAST(t AS TIMESTAMP) AS ts", "state")
    for k in range(3):
        d.where(F.col("id") % 3 == k).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    s = streams.state_machine(streams.event_files(spark, str(tmp_path / "in"), d.schema, 10))
    streams.drained(s, "update", str(tmp_path / "log"), streams.keep_latest(str(tmp_path / "out"), ["key"]))
    got = {r.key: (r.state, r.n) for r in streams.read_latest(spark, str(tmp_path / "out"), s.schema, ["key"]).collect()}
    assert got == {1: ("failed", 5), 2: ("queued", 1)}
    assert {r.key: r.state for r in folds.completion_fold(d).collect()} == {1: "failed", 2: "queued"}


def test_audio_arrival(spark, tmp_path):
    from tonearm.streaming import streams

    for n in ("a.mp3", ".hidden.mp3", "b.txt", "c.FLAC"):
        (tmp_path / n).write_bytes(b"x")
    found = []
    streams.drained(streams.arriving_audio(spark, str(tmp_path)), "append", str(tmp_path.parent / "audio-log"), lambda b, i: found.extend(r.path.rsplit("/", 1)[1] for r in b.collect()))
    assert sorted(found) == ["a.mp3", "c.FLAC"]


def test_query_variants_work_out_each_part_once(spark):
    """The artist's spellings are split once a row, not once for each comparison of spellings."""
    from pyspark.sql import functions as F

    d = spark.range(1).selectExpr("'a' AS a", "'t' AS t", "'l' AS l").repartition(1)
    plan = d.select(X.query_variants(F.col("a"), F.col("t"), F.col("l")).alias("q"))._jdf.queryExecution().analyzed().toString()
    assert plan.count("split(") == 1
