"""Summaries, settings, suffix joins, exports and feature writes."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from tonearm.functions import config as G
from tonearm.operators import entity as E
from tonearm.operators import reducers as D
from tonearm.operators import summaries as M
from tonearm.sources import playlists as P


def test_profiles():
    assert len(M.KEYS) == 42 and set(M.weights_of(None).values()) == {1.0} and M.weights_of("nothing") == M.weights_of("balanced_v1")
    assert M.weights_of("energy_v1")["tempo_bpm"] == 2.0 and M.weights_of("energy_v1", {"a": 2, "b": -1, "c": True}) == {"a": 2.0}
    assert M.group_of("mfcc_03_mean") == "harmony" and M.group_of("x") == "texture"


def test_grouped_matrix(spark):
    rows = spark.createDataFrame([(1, {"tempo_bpm": 60.0, "rms_mean": 1.0}), (2, {"tempo_bpm": 120.0, "rms_mean": 3.0}), (3, {"rms_mean": float("nan")}), (4, {})], "id long, descriptors map<string,double>")
    out = {r.id: r.vector for r in M.grouped_matrix(rows, {"tempo_bpm": 1.0, "rms_mean": 2.0}).collect()}
    assert out[3] == out[4] == [0.0, 0.0, 0.0]
    assert out[1][0] == out[2][0] == 0.0 and out[1][1] == -out[2][1] != 0 and out[2][2] == pytest.approx(2.0 * 1.25 * 0.5)


@pytest.mark.parametrize("bpm, score, delta, traits, band, want", [(110, 0.5, None, ["Sparse", "Punchy"], "Medium Energy", "Tools"), (130, 0.1, None, [], "Low Energy", "Peak"), (90, 0.3, None, ["Open"], "Low Energy", "Afterhours"), (90, 0.3, None, [], "Low Energy", "Warm-up"), (110, 0.5, None, ["Warm"], "Medium Energy", "Rolling"), (100, 0.5, 0.2, [], "Medium Energy", "Build"), (109, None, None, [], None, "Rolling"), (None, None, None, [], None, None)])
def test_roles(spark, bpm, score, delta, traits, band, want):
    d = spark.createDataFrame([(bpm, score, delta, traits, band)], "b long, s double, d double, t array<string>, e string")
    assert d.select(M.role(*[F.col(c) for c in "bsdte"])).first()[0] == want


def test_traits_and_deltas(spark):
    d = spark.createDataFrame([({"spectral_centroid_mean": 3000.0, "onset_strength_mean": 0.1, "zero_crossing_rate_mean": 0.01, "mfcc_01_mean": 5.0},)], "m map<string,double>")
    assert d.select(M.threshold_traits(F.col("m"))).first()[0] == ["Bright", "Smooth", "Dense"]
    k = spark.createDataFrame([("rms_mean", -1.0), ("tempo_bpm", 1.0), ("other", -1.0)], "k string, d double")
    assert [r[0] for r in k.select(M.delta_label(F.col("k"), F.col("d"))).collect()] == ["Low Energy", "Faster", "Lower"]


def test_names_are_unique(spark):
    rows = spark.createDataFrame([(f"p{i}", i, {"tempo_bpm": 130.0}) for i in range(9)], "path string, id long, descriptors map<string,double>")
    names = [r.name.casefold() for r in M.named(M.cluster_summaries(rows)).collect()]
    assert len(set(names)) == 9


def test_settings():
    c = G.generation_config({"max_depth": 99, "clustering_method": "odd", "min_playlist_size": 0})
    assert (c["max_depth"], c["clustering_method"], c["min_playlist_size"]) == (5, "dj_hierarchical", 1)
    told = []
    assert [G.bounded_int(x, 5, 1, 9, told.append) for x in (None, "x", "0", "12", "7")] == [5, 5, 1, 9, 7] and len(told) == 3
    assert G.preflight({"A": "1", "C": "x"}, ("A", "B"), (("C", "D"),)) == ["B is required", "C and D go together"]
    assert G.request_ids([3, 3, 1]) == [3, 1]
    for bad in ([], [0], list(range(1, 102))):
        with pytest.raises(ValueError):
            G.request_ids(bad)
    assert [G.absolute_path(x) for x in ("/a/../b/", "C:\\a\\.\\b", "\\\\h\\s\\x\\..")] == ["/b", "C:\\a\\b", "\\\\h\\s\\"]
    for bad in ("a/b", ""):
        with pytest.raises(ValueError):
            G.absolute_path(bad)
    with pytest.raises(ValueError):
        G.export_request(None, " ", ["m3u"])
    with pytest.raises(ValueError):
        G.analyzers.get("none")


def test_suffix_paths(spark):
    a = spark.createDataFrame([(1, "/in/Artist/Song.mp3", 5), (2, "/in/x/Other.mp3", 5), (3, "lone.mp3", 5)], "id long, path string, size long")
    b = spark.createDataFrame([(10, r"@@u\artist\song.MP3", 5, 1), (11, r"more\Artist\Song.mp3", 5, 2), (12, r"y\other.mp3", 5, 1), (13, r"q\LONE.mp3", 5, 1), (14, r"q\lone.mp3", 6, 9)], "id long, path string, size long, updated_at long")
    assert sorted(tuple(r) for r in E.suffix_path_join(a, b).collect()) == [(1, 11), (3, 13)]


def test_export_package(spark):
    lists = spark.createDataFrame([(7, "One", "full"), (8, "Two", "off")], "playlist_id long, title string, sync_mode string")
    e = spark.createDataFrame([(7, 1, "a.mp3", "A", "T", 1000), (7, 2, None, "A", "T", 1000)], "playlist_id long, position long, path string, artist string, title string, duration_ms long")
    texts, totals = P.export_package(spark.createDataFrame([(7,)], "playlist_id long"), lists, e)
    assert totals == {"exported": 1, "skipped": 1}
    buffer = io.BytesIO()
    assert P.zipped(texts, buffer) == 1 and zipfile.ZipFile(buffer).namelist() == ["One.m3u8"]
    with pytest.raises(ValueError, match="8"):
        P.export_package(spark.createDataFrame([(7,), (8,), (9,)], "playlist_id long"), lists, e)
    assert P.quarantine_plan(spark.createDataFrame([(1, "a/b.mp3")], "id long, path string"), "/q/", "t").first().target == "/q/t/local-1/a/b.mp3"


def test_feature_writes(spark):
    rows = spark.createDataFrame([(1, "pending", 1, None, None), (2, "pending", 2, "old", None), (3, "ready", 1, "keep", None), (4, "pending", 1, "p", None)], "id long, status string, attempts long, payload string, failure string")
    res = spark.createDataFrame([(1, 1, "ready", "new", None), (2, 1, "ready", "late", None), (3, 2, "pending", None, None), (4, 1, "failed", None, "boom"), (5, 1, "pending", None, None), (6, 1, "ready", "x", None)], "id long, attempt long, kind string, payload string, failure string")
    out = {r.id: (r.status, r.attempts, r.payload, r.failure) for r in D.written_features(rows, res).collect()}
    assert out == {1: ("ready", 1, "new", None), 2: ("pending", 2, "old", None), 3: ("pending", 2, None, None), 4: ("failed", 1, "p", "boom"), 5: ("pending", 1, None, None)}


def test_duplicate_resolution(spark):
    g = spark.createDataFrame([("k", "1,2,3"), ("m", "4,5"), ("n", "6,7")], "group_key string, ids string")
    c = spark.createDataFrame([("k", 2), ("m", None), ("n", 9)], "group_key string, keeper long")
    removed, done = D.resolved_duplicates(g, c)
    assert sorted(r.id for r in removed.collect()) == [1, 3] and sorted((r.group_key, r.action) for r in done.collect()) == [("k", "resolved"), ("m", "dismissed")]
    left = D.without_references({"links": (spark.createDataFrame([(1, "a"), (2, "b")], "local_id long, v string"), "local_id")}, removed)
    assert [r.v for r in left["links"].collect()] == ["b"]


def test_defaults_and_merges(spark):
    p = spark.createDataFrame([(1, False), (2, True), (3, True)], "id long, is_default boolean")
    assert [r.id for r in D.with_default(p).collect() if r.is_default] == [2]
    assert [r.id for r in D.with_default(p, 3).collect() if r.is_default] == [3]
    rows = spark.createDataFrame([(1, "a"), (2, "a"), (3, None), (4, None)], "id long, k string")
    kept, refs = D.merged_duplicates(rows, "k", {"r": (spark.createDataFrame([(9, 2), (8, 3)], "n long, parent long"), "parent")})
    assert sorted(r.id for r in kept.collect()) == [1, 3, 4] and sorted((r.n, r.parent) for r in refs["r"].collect()) == [(8, 3), (9, 1)]


def test_chunks(spark):
    from tonearm.operators.relational import chunks

    got = list(chunks(spark.range(0, 25, 1, 3), 10))
    assert [len(x) for x in got] == [10, 10, 5] and sorted(r.id for x in got for r in x) == list(range(25))


def test_stages_stop_at_the_first_failure(spark):
    from pyspark.sql import functions as F

    from tonearm.operators.reducers import staged_outcomes, staged_report

    rows = spark.createDataFrame([(1, True, True, True), (2, True, False, True), (3, False, None, True), (4, None, False, None)], "id long, a boolean, b boolean, c boolean")
    yes = F.lit(True)
    stages = [("one", yes, F.col("a")), ("two", F.col("b").isNotNull(), F.col("b")), ("three", F.col("b"), F.col("c"))]
    got = {i: [] for i in range(1, 5)}
    for r in sorted(staged_outcomes(rows, stages).collect(), key=lambda r: (r.id, r.place)):
        got[r.id].append(r.status)
    assert got == {1: ["succeeded"] * 3, 2: ["succeeded", "failed", "skipped"], 3: ["failed", "skipped", "skipped"], 4: ["failed", "skipped", "skipped"]}
    none = staged_outcomes(rows.where("id = 1").withColumn("b", F.lit(None).cast("boolean")), stages)
    assert [r.status for r in sorted(none.collect(), key=lambda r: r.place)] == ["succeeded", "not_applicable", "not_applicable"]
    assert {(r.stage, r.status): r.n for r in staged_report(rows, stages).collect()}[("one", "failed")] == 2
