"""Small cases with known answers: matching, relationships, resolution, duplicates, ranking, clustering."""

import numpy as np
import pytest

from tonearm.operators import cluster as C
from tonearm.operators import cluster_features as CF
from tonearm.operators import entity as E
from tonearm.operators import graph as G
from tonearm.operators import reducers as D
from tonearm.operators import relational as R
from tonearm.operators import upsert as U

TRACK = "id long, title string, artist string, album string, duration_ms long, isrc string"


def tracks(spark, *rows):
    return spark.createDataFrame([(i, t, a, al, ms, code) for i, t, a, al, ms, code in rows], TRACK)


def pairs(df, *extra):
    return sorted(tuple(r[c] for c in ("lower_id", "higher_id", *extra)) for r in df.collect())


def test_code_star(spark):
    t = tracks(spark, (1, "a", "b", None, None, "GB-UM7-21-05976"), (2, "a", "b", None, None, "GBUM72105976"), (3, "a", "b", None, None, "gbum72105976"), (4, "a", "b", None, None, "ISRC-track-3"), (5, "c", "d", None, None, "N/A"), (6, "c", "d", None, None, None))
    assert pairs(E.code_star(t)) == [(1, 2), (1, 3)]


def test_fuzzy_equivalent_and_related(spark):
    t = tracks(spark, (1, "North Star", "June", "Night", 180000, None), (2, "North Star", "June", "Night", 180500, None), (3, "Blue Train", "Cole", "Trane", 220000, None), (4, "Blue Train - Live", "Cole", "Trane", 248000, None), (5, "North Star", "Other June", "Night", 180000, None))
    out = E.relationship_suggestions(t)
    assert pairs(out, "type") == [(1, 2, "equivalent"), (3, 4, "related")]
    assert {r.lower_id: round(r.score, 3) for r in out.collect()} == {1: 1.0, 3: 0.98} or all(r.score >= 0.93 for r in out.collect())


def test_album_difference_is_no_equivalence(spark):
    t = tracks(spark, (1, "Same Song", "One", "Studio Sessions", 180000, None), (2, "Same Song", "One", "Compilation Sessions", 180000, None))
    assert E.relationship_suggestions(t).count() == 0


def test_bucket_and_global_caps(spark):
    same = tracks(spark, *[(i, "Song", "One", "Album", 1000, None) for i in range(9)])
    assert E.relationship_suggestions(same).count() == 5
    coded = tracks(spark, *[(i, f"s{i}", "One", "Album", 1000, "USABC2400001") for i in range(4)])
    assert E.relationship_suggestions(coded, most=2).count() == 2


@pytest.mark.parametrize("left, right, want", [(("Track", "ARTIST", "Album", None), ("Track", "Artist", "Album", 1000), 0.98), (("T", "A", "Same", 180000), ("T", "A", "Same", 183000), 1.0), (("T", "A", "Same", 180000), ("T", "A", "Different Album", 260000), None)])
def test_tag_scores(spark, left, right, want):
    rows = spark.createDataFrame([tuple(x.lower() if isinstance(x, str) else x for x in (*left, *right))], "l_title string, l_artist string, l_album string, l_ms long, r_title string, r_artist string, r_album string, r_ms long")
    got = E.scored(rows, "l", "r").first().score
    assert got == pytest.approx(want) if want else 0.94 < got < 1.0


def test_noisy_titles_rank(spark):
    rows = spark.createDataFrame([(t.lower(), "the artist") for t in ("OnlyL (feat. NIMMO)", "L'amour Toujours(Small Mix)")], "r_title string, r_artist string").selectExpr("'onlyl ft. tsha & nimmo (original mix)' AS l_title", "'the artist' AS l_artist", "CAST(NULL AS STRING) AS l_album", "CAST(NULL AS BIGINT) AS l_ms", "r_title", "r_artist", "CAST(NULL AS STRING) AS r_album", "CAST(NULL AS BIGINT) AS r_ms")
    got = {r.r_title: r.score for r in E.scored(rows, "l", "r").collect()}
    assert got["onlyl (feat. nimmo)"] > got["l'amour toujours(small mix)"]


def graph(spark, edges, links, n=6):
    comp = G.component_of_each(spark.range(1, n).withColumnRenamed("id", "track_id"), spark.createDataFrame(edges, "lower_id long, higher_id long, type string"))
    final = spark.createDataFrame([(k, *x) for k, x in enumerate(links)], "id long, local_id long, track_id long")
    return comp, final


@pytest.mark.parametrize("edges, links, track, want", [([(1, 2, "equivalent")], [(100, 1), (200, 2)], 1, (100, "direct")), ([(1, 2, "equivalent")], [(100, 1)], 2, (100, "equivalent")), ([(1, 2, "equivalent"), (2, 3, "equivalent")], [(100, 1)], 3, (100, "equivalent")), ([(1, 2, "related")], [(100, 1)], 2, (None, None)), ([(1, 2, "equivalent")], [], 1, (None, None)), ([(1, 2, "equivalent"), (2, 3, "equivalent")], [(100, 1), (200, 2)], 3, (None, None))])
def test_resolver(spark, edges, links, track, want):
    comp, final = graph(spark, edges, links)
    r = {x.track_id: x for x in G.resolve_links(comp, final).collect()}[track]
    assert (r.local_id, r.source) == want


def test_conflicts(spark):
    comp, final = graph(spark, [(1, 3, "equivalent"), (2, 4, "equivalent")], [(100, 3), (200, 4)])
    asked = spark.createDataFrame([(1, 2)], "lower_id long, higher_id long")
    r = G.merge_conflicts(asked, comp, final).first()
    assert (r.first, r.second, r.locals) == (1, 2, "100,200")
    comp, final = graph(spark, [(1, 3, "equivalent"), (2, 3, "equivalent")], [(100, 3)])
    assert G.merge_conflicts(asked, comp, final).count() == 0


def test_components_of_long_chains_and_stars(spark):
    from tonearm.operators.components import connected_components

    rng = np.random.default_rng(2)
    names = rng.permutation(400).tolist()
    chain = [(names[i], names[i + 1]) for i in range(299)]
    star = [(names[300], names[k]) for k in range(301, 400)]
    out = {r.node: r.component for r in connected_components(spark.createDataFrame(chain + star + [(5, 5), (None, 3)], "a long, b long")).collect()}
    assert {out[x] for x in names[:300]} == {min(names[:300])} and {out[x] for x in names[300:]} == {min(names[300:])}


def test_duplicate_detectors(spark):
    d = spark.createDataFrame([(1, "f", "k", 180), (2, "f", "k", 181), (3, "", "k", 400), (4, None, "m", 245), (5, None, "m", 247), (6, None, "m", 250), (7, None, "m", 900)], "id long, fp string, key string, sec long")
    exact = E.equal_groups(d, "fp", "fingerprint_exact", 1.0)
    chained = E.chained_groups(d, ["key"], "sec", 10, "metadata", 0.72)
    out = sorted((r.source, r.ids) for r in E.merged_groups([exact, chained]).collect())
    assert out == [("fingerprint_exact", "1,2"), ("metadata", "4,5,6")]
    assert pairs(E.band_pairs(d, "sec", 3)) == [(1, 2), (4, 5), (5, 6)]
    linked = E.linked_groups(spark.createDataFrame([(1, 2, 0.8), (2, 3, 0.9), (7, 9, 0.86)], "lower_id long, higher_id long, score double"), "fingerprint_similar")
    assert sorted((tuple(r.ids), r.score) for r in linked.collect()) == [((1, 2, 3), 0.9), ((7, 9), 0.86)]


def test_peer_ranking(spark):
    kinds = "search_id string, username string, filename string, size long, extension string, length_s int, bit_rate int, bit_depth int, locked boolean, free_slot boolean, queue int, speed int"
    rows = [("s", "u", r"Jon Hopkins\Immunity\01 - Open Eye Signal.flac", 10, None, 270, None, 16, False, True, 0, 2_000_000), ("s", "u", r"..\Open Eye Signal.flac", 10, None, 270, None, 16, False, True, 0, 1), ("s", "v", r"Jon Hopkins\Open Eye Signal.mp3", 10, None, 270, 320, None, True, True, 0, 1), ("s", "w", r"Jon Hopkins\Open Eye Signal.mp3", 10, None, 30, 320, None, False, True, 0, 1), ("s", "x", r"Bicep\Cloudy\01 - Cloudy.flac", 10, None, 270, None, 16, False, True, 0, 1), ("s", "y", r"Jon Hopkins\Open Eye Signal.txt", 10, None, 270, None, None, False, True, 0, 1)]
    ranked, rejected = E.rank_peer_files(spark.createDataFrame(rows, kinds), {"title": "Open Eye Signal", "artist": "Jon Hopkins", "album": "Immunity", "duration_ms": 270_000})
    out = ranked.collect()
    assert [r.filename for r in out] == [rows[0][2]] and out[0].score > 0.7
    assert {r.reason: r.n for r in rejected.collect()} == {"unsafe_path": 1, "locked": 1, "duration_mismatch": 1, "weak_text_match": 1, "unsupported_extension": 1}


def test_peer_names_are_judged_once(spark):
    """Files of one name share its judgement, a missing name has none, and one task does not hold all names."""
    kinds = "search_id string, username string, filename string, size long, extension string, length_s int, bit_rate int, bit_depth int, locked boolean, free_slot boolean, queue int, speed int"
    names = [rf"June\Night\0{i} - North Star.mp3" for i in range(40)]
    rows = [("s", f"u{k}", name, 10, None, 200, 320, None, False, True, 0, 1) for name in names for k in range(3)] + [("s", "v", None, 10, None, 200, 320, None, False, True, 0, 1)]
    files, track = spark.createDataFrame(rows, kinds), {"title": "North Star", "artist": "June", "album": "Night", "duration_ms": 200_000}
    ranked, rejected = E.rank_peer_files(files, track, most=500)
    assert ranked.count() == 120 and {r.reason: r.n for r in rejected.collect()} == {"missing_file_data": 1}
    wanted = {k: E.X.match_text(E.F.lit(track[k])) for k in ("title", "artist", "album")}
    judged = E._judged_names(files.select("filename"), wanted)
    assert judged.count() == 40 and judged.select(E.F.input_file_name()).distinct().count() > 1


def test_cursor_round_trip():
    cursor = R.encode_cursor(sort="title", direction="asc", value="é/+", id=7)
    assert "=" not in cursor and R.decode_cursor(cursor, sort="title")["value"] == "é/+"
    for bad in ("%%%", "", R.encode_cursor(sort="artist")):
        with pytest.raises(ValueError):
            R.decode_cursor(bad, sort="title")


def test_upserts(spark):
    old = spark.createDataFrame([(1, "a", "X", 1), (2, "b", "Y", 1)], "id int, title string, code string, n int")
    new = spark.createDataFrame([(2, "c", None), (3, "d", "Z")], "id int, title string, code string")
    out = {r.id: (r.title, r.code, r.n) for r in U.merge(old, new, ["id"], {"code": "coalesce"}).collect()}
    assert out == {1: ("a", "X", 1), 2: ("c", "Y", 1), 3: ("d", "Z", None)}
    empty = U.reconcile(old, new.limit(0), ["id"], old.n == 1)
    assert empty.count() == 0
    hit = U.compare_and_set(old, old.title == "a", {"code": old.title}).collect()
    assert sorted((r.code, r.matched) for r in hit) == [("Y", False), ("a", True)]


def test_approval_rules(spark):
    s = spark.createDataFrame([(1, 10, 20, "pending"), (2, 10, 21, "pending"), (3, 11, 20, "pending"), (4, 12, 22, "rejected"), (5, 13, 23, "pending")], "id long, local_id long, track_id long, status string")
    f = spark.createDataFrame([(13, 13, 99)], "id long, local_id long, track_id long")
    after, links, outcome = D.approve(s, f, spark.createDataFrame([(1, 1), (2, 3), (3, 4), (4, 5), (5, 77)], "n long, id long"))
    assert {r.id: r.outcome for r in outcome.collect()} == {1: "approved", 3: "stale", 4: "stale", 5: "conflict", 77: "not_found"}
    assert sorted((r.id, r.status) for r in after.collect()) == [(1, "approved"), (3, "pending"), (4, "rejected"), (5, "pending")]
    assert sorted(r.local_id for r in links.collect()) == [10, 13]


def test_tree_membership_and_order(spark):
    rows = [(i, [90.0 + i, (i % 5) / 10]) for i in range(32)]
    d = spark.createDataFrame(rows, "id long, vector array<double>")
    for method in ("ward", "kmeans"):
        tree = CF.playlist_tree(d, target=6, least=3, most_children=4, max_depth=2, method=method).collect()
        assert sorted(r.id for r in tree) == list(range(32)) and len({r.path for r in tree}) > 1
    large = CF.playlist_tree(d, target=6, least=3, most_children=4, max_depth=2, max_leaves=10).collect()
    assert sorted(r.id for r in large) == list(range(32))


def test_weak_split_and_auto_k():
    assert C.best_split(np.ones((16, 3)), 8, 3, 4) is None
    rng = np.random.default_rng(0)
    for k in (2, 3, 4):
        m = np.concatenate([rng.normal(10 * j, 0.1, (8, 2)) for j in range(k)])
        assert sorted(np.bincount(C.best_split(m, 8, 3, 5))) == [8] * k


def test_orders():
    m = np.array([[0.0], [1.0], [2.0], [3.0], [10.0]])
    out = C.rolling_order(m, np.arange(5), ["a", "a", "b", "c", "d"], [None] * 5)
    assert sorted(out) == [0, 1, 2, 3, 4] and out[-1] == 4
    assert C.rolling_order(m, np.arange(5), ["a"] * 5, [None] * 5) == C.rolling_order(m, np.arange(5), ["a"] * 5, [None] * 5)


def test_sizes_and_shape():
    assert C.adaptive_sizes(58) == {"target": 24, "least": 8, "depth": 2, "children": 4}
    big = C.adaptive_sizes(900)
    assert big["depth"] == 3 and big["children"] == 5
    shape = C.projected_shape(96, 24, 8, 4, 2)
    assert shape == {"per_depth": {0: 1, 1: 4}, "min": 24, "median": 24.0, "max": 24}
    assert C.unique_names([["Fast", "Fast Bright"], ["fast", "Fast Bright"], ["FAST", "fast bright"]]) == ["Fast", "Fast Bright", "fast bright 2"]


def test_equal_rows_are_numbered_in_several_ranges(spark):
    """All rows tie in the order: numbers are still gapless, and no range holds most rows."""
    from pyspark.sql import functions as F

    from tonearm.operators import ranking

    seen = []
    keep = ranking.materialize

    def counted(df, name):
        out = keep(df, name)
        seen.extend(r["count"] for r in out.groupBy("__range").count().collect())
        return out

    ranking.materialize = counted
    try:
        rows = ranking.numbered(spark.range(4000).withColumn("same", F.lit(1)), [F.col("same")], parts=4).collect()
    finally:
        ranking.materialize = keep
    assert sorted(r.number for r in rows) == list(range(1, 4001)) and max(seen) < 2000


def plain_order(m, ids, artists, albums, scale=1.0):
    """Every row left is sorted anew at each step."""
    squares = (m * m).sum(1)
    far = lambda i: np.sqrt(np.maximum(squares[i] + squares - 2 * m @ m[i], 0))
    rank, key = C.seeded(ids, 7), lambda x: x.casefold() if x else None
    total = [far(i).sum() for i in range(len(m))]
    out = [min(range(len(m)), key=lambda i: (total[i], rank[i], ids[i]))]
    while len(out) < len(m):
        near, back = far(out[-1]), out[:-4:-1]
        costs = {}
        for i in set(range(len(m))) - set(out):
            c = near[i]
            for p, x, y in zip(back, C.ARTIST_PENALTY, C.ALBUM_PENALTY):
                c += scale * (x * (key(artists[i]) is not None and key(artists[i]) == key(artists[p])) + y * (key(albums[i]) is not None and key(albums[i]) == key(albums[p])))
            costs[i] = c
        out.append(min(costs, key=lambda i: (costs[i], near[i], rank[i], ids[i])))
    return out


@pytest.mark.parametrize("seed", range(6))
def test_orders_with_copies(seed):
    rng = np.random.default_rng(seed)
    n = 60 + seed
    m = rng.normal(size=(20, 8))[rng.integers(20, size=n)]
    ids, artists, albums = rng.permutation(1000)[:n], [rng.choice(["a", "B", "b", None, ""]) for _ in range(n)], [rng.choice(["x", "X", "y", None]) for _ in range(n)]
    assert C.rolling_order(m, ids, artists, albums) == plain_order(m, ids, artists, albums)


def test_an_order_sorts_ties_only(monkeypatch):
    """Each step sorted all rows left: 2,000 rows were two million sorted."""
    rng, held, sort = np.random.default_rng(1), [], np.lexsort
    monkeypatch.setattr(C.np, "lexsort", lambda keys: held.append(len(keys[0])) or sort(keys))
    order = C.rolling_order(rng.normal(size=(2000, 4)), np.arange(2000), ["a", "b"] * 1000, ["x"] * 2000)
    assert sorted(order) == list(range(2000)) and sum(held) < 4000


def test_an_order_of_broken_vectors_is_whole():
    m = np.arange(12.0).reshape(6, 2)
    m[3, 0] = np.nan
    assert sorted(C.rolling_order(m, np.arange(6), ["a"] * 6, [None] * 6)) == list(range(6))
