"""Matching and suggestions over whole small tables against plain versions that look at every pair."""

import itertools
from collections import defaultdict

import pytest

from tonearm.functions import similarity as S
from tonearm.functions import text as X
from tonearm.operators import entity as E
from tonearm.plans import entities
from tonearm.plans.reading import active_track_ids
from tonearm.tables import Tables

SF = "/root/testdata/sf0.001"
TRACK = "id long, title string, artist string, album string, duration_ms long, isrc string"


def facts(rows):
    """id -> the texts that the rules speak of."""
    from pyspark.sql import functions as F

    title = X.match_text(F.col("title"))
    out = rows.select("id", F.col("title").alias("raw"), title.alias("title"), X.match_text(F.col("artist")).alias("artist"), X.match_text(F.col("album")).alias("album"), "duration_ms", X.valid_isrc(F.col("isrc")).alias("code"), X.title_identity(title).alias("identity"), X.title_key(title).alias("key"), X.version_words(title).alias("versions"), S.trigrams(F.col("title")).alias("grams"), S.trigrams(X.title_identity(title)).alias("own"))
    return {r.id: r for r in out.collect()}


def scores(left, right, pairs):
    """Score of each of ``pairs``, every one put to the scoring function."""
    spark = left.sparkSession
    asked = spark.createDataFrame(list(pairs), "l_id long, r_id long")
    both = asked.join(E._prefixed(left, "l"), "l_id").join(E._prefixed(right, "r"), "r_id")
    return {(r.l_id, r.r_id): r.score for r in E.scored(both, "l", "r").collect()}


def similar(a, b):
    a, b = set(a or ()), set(b or ())
    return len(a & b) / len(a | b) if a & b else 0.0


def plain_matches(local, tracks, rejected):
    a, b = facts(local), facts(tracks)
    score = scores(local, tracks, itertools.product(a, b))
    out = set()
    for i, x in a.items():
        same = sorted(t for t, y in b.items() if x.code and y.code == x.code)
        if same and (i, same[0]) not in rejected:
            out.add((i, same[0], "isrc"))
            continue
        if not x.title or not x.artist:
            continue
        free = [t for t in b if (i, t) not in rejected]
        ranked = sorted(free, key=lambda t: (-similar(x.own, b[t].grams), t))
        near = [t for t in ranked if similar(x.own, b[t].grams) >= 0.3][:100]
        taken = near or ranked[:100]
        taken += [t for t in sorted(free) if t not in taken][: max(0, 3 - len(taken))]
        named = [t for t in taken if b[t].title and b[t].artist]
        best = sorted(named, key=lambda t: (-score[i, t], named.index(t)))[:3]
        out |= {(i, t, "tags") for t in ([t for t in best if score[i, t] >= 0.5] or best[:2])}
    return out


def rows_of(df):
    return {(r.local_id, r.track_id, r.method) for r in df.collect()}


def test_match_pipeline(spark):
    t = Tables(spark, SF)
    rejected = {(r.local_id, r.track_id) for r in t.suggested.where("status = 'rejected'").collect()}
    want = plain_matches(t.local, t.tracks, rejected)
    assert rows_of(entities.match_pipeline(t)) == want and len(want) > 50


def test_rejections_and_fallbacks(spark):
    local = spark.createDataFrame([(100, "Blue Train", "Cole", "Trane", 1000, None), (101, "Zzyzx", "Nobody", None, None, None), (102, "Coded", "Some", None, None, "USABC2400001"), (103, None, "Some", None, None, None), (104, "Blue", "Cole", None, None, None)], TRACK)
    tracks = spark.createDataFrame([(i, "Blue Train", "Cole", "Trane", 1000, None) for i in range(1, 8)] + [(8, "Coded", "Some", None, None, "us-abc-24-00001"), (9, "Coded too", "Some", None, None, "USABC2400002"), (10, "Qqq", "Www", None, None, None)], TRACK)
    for rejected in ({(100, 1), (100, 2), (100, 3), (102, 8)}, {(100, i) for i in range(1, 8)} | {(101, 1), (101, 2)}, set()):
        gone = spark.createDataFrame(sorted(rejected), "local_id long, track_id long")
        got = rows_of(E.match_all(local, tracks, gone))
        assert got == plain_matches(local, tracks, rejected)
        if (102, 8) in rejected:
            assert {x for x in got if x[0] == 100} == {(100, i, "tags") for i in (4, 5, 6)}
            assert (102, 9, "tags") in got and not any(x[1] == 8 for x in got if x[0] == 102)
        assert sum(x[0] == 101 for x in got) == 2


def plain_suggestions(tracks, edges, decided, most=1000):
    f = {i: x for i, x in facts(tracks).items() if x.title and x.artist}
    parent = {}

    def root(x):
        while parent.get(x, x) != x:
            x = parent[x]
        return x

    for a, b, kind in edges:
        if kind == "equivalent":
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    group = lambda a, b: tuple(sorted((root(a), root(b))))
    barred = {group(a, b) for a, b, _ in edges} | {group(a, b) for a, b, s in decided if s == "rejected"}
    final = {(a, b) for a, b, s in decided if s != "pending"}
    free = lambda a, b: (a, b) not in final and root(a) != root(b) and group(a, b) not in barred
    out, codes, blocks = {}, defaultdict(list), defaultdict(list)
    for i, x in sorted(f.items()):
        if x.code:
            codes[x.code].append(i)
        blocks[x.artist, x.key.split(" ")[0]].append(i)
    for ids in codes.values():
        out |= {(ids[0], j): (1.0, "equivalent", "isrc") for j in ids[1:] if free(ids[0], j)}
    wanted = [(a, b) for ids in blocks.values() for a, b in itertools.combinations(ids, 2) if not (f[a].code and f[a].code == f[b].code) and free(a, b) and (f[a].key == f[b].key or S.token_sort_ratio(f[a].key, f[b].key) >= 90)]
    score = scores(tracks, tracks, wanted) if wanted else {}
    for ids in blocks.values():
        found = []
        for a, b in itertools.combinations(ids, 2):
            if (a, b) not in score:
                continue
            x, y, s = f[a], f[b], score[a, b]
            late = x.duration_ms is not None and y.duration_ms is not None and abs(x.duration_ms - y.duration_ms) > 10_000
            album = x.album is not None and y.album is not None and S.token_sort_ratio(x.album, y.album) < 98
            if s >= 0.94 and not late and not album and x.versions == y.versions:
                found.append((-s, a, b, "equivalent"))
            elif s >= 0.93 and x.versions != y.versions:
                found.append((-s, a, b, "related"))
        out |= {(a, b): (-s, kind, "tags") for s, a, b, kind in sorted(found)[:5]}
    return {(a, b, kind, method) for (a, b), (_, kind, method) in sorted(out.items(), key=lambda x: (-x[1][0], x[0]))[:most]}


def suggestions(df):
    return {(r.lower_id, r.higher_id, r.type, r.method) for r in df.collect()}


@pytest.mark.parametrize("sf", [SF, "/root/testdata/sf0.01"])
def test_relationship_suggestions(spark, sf):
    t = Tables(spark, sf)
    scope = t.tracks.join(active_track_ids(t).withColumnRenamed("track_id", "id"), "id", "left_semi")
    edges = [(r.lower_id, r.higher_id, r.type) for r in t.edges.collect()]
    decided = [(r.lower_id, r.higher_id, r.status) for r in entities.decided_suggestions(t).collect()]
    assert suggestions(entities.relationship_suggestions(t)) == plain_suggestions(scope, edges, decided)


def test_suppression_comes_before_the_caps(spark):
    same = [(i, "Song", "One", "Album", 1000, None) for i in range(1, 10)]
    coded = [(i, "Song", "One", "Album", 1000, "USABC2400001") for i in range(20, 24)]
    titled = [(30, "North Star", "June", "Night", 1000, None), (31, "North Star Over The Quiet Valley", "June", "Night", 1000, None), (32, "North Star (Live)", "June", "Night", 1000, None), (33, "North Star", None, "Night", 1000, None)]
    tracks = spark.createDataFrame(same + coded + titled, TRACK)
    edges, decided = [(1, 2, "equivalent"), (3, 4, "related"), (20, 21, "related")], [(1, 5, "rejected"), (1, 6, "accepted"), (1, 7, "pending")]
    from tonearm.operators.graph import component_of_each

    stored = spark.createDataFrame(edges, "lower_id long, higher_id long, type string")
    got = suggestions(E.relationship_suggestions(tracks, component_of_each(tracks.selectExpr("id AS track_id"), stored), stored, spark.createDataFrame(decided, "lower_id long, higher_id long, status string")))
    assert got == plain_suggestions(tracks, edges, decided)
    assert sum(method == "tags" and a < 30 for a, _, _, method in got) == 5 and not {(1, 2), (1, 5), (2, 5), (1, 6), (3, 4)} & {x[:2] for x in got}
    assert (20, 22, "equivalent", "isrc") in got and (21, 22, "equivalent", "tags") not in got and (30, 31) not in {x[:2] for x in got}
    assert (30, 32, "related", "tags") in got


def test_fuzzy_pairs(spark):
    """Every pair of a block of the whole table that is near, with its score and what speaks against it."""
    t = Tables(spark, SF)
    f = {i: x for i, x in facts(t.tracks).items() if x.title and x.artist}
    blocks = defaultdict(list)
    for i, x in sorted(f.items()):
        blocks[x.artist, x.key.split(" ")[0]].append(i)
    wanted = [(a, b) for ids in blocks.values() for a, b in itertools.combinations(ids, 2) if not (f[a].code and f[a].code == f[b].code) and (f[a].key == f[b].key or S.token_sort_ratio(f[a].key, f[b].key) >= 90)]
    score = scores(t.tracks, t.tracks, wanted)
    want = set()
    for a, b in wanted:
        x, y = f[a], f[b]
        late = x.duration_ms is not None and y.duration_ms is not None and abs(x.duration_ms - y.duration_ms) > 10_000
        album = x.album is not None and y.album is not None and S.token_sort_ratio(x.album, y.album) < 98
        want.add((a, b, round(score[a, b], 9), x.versions != y.versions, late, album))
    got = {(r.lower_id, r.higher_id, round(r.score, 9), r.version_conflict, r.duration_conflict, r.album_conflict) for r in entities.fuzzy_pairs(t).collect()}
    assert got == want and got


def test_near_titles_of_all_lengths(spark):
    """Keys around the limit of the ratio, of one block: the length bound drops none that the ratio keeps."""
    import random

    rng = random.Random(2)
    titles = ["night " + "".join(rng.choice("abc") for _ in range(rng.choice([8, 9, 10, 11, 20]))) for _ in range(60)] + ["night abcabcabca", "night abcabcabcab", "night abcabcabcabc", "night"]
    rows = spark.createDataFrame([(i, x, "June", None, None, None) for i, x in enumerate(titles)], TRACK)
    f = facts(rows)
    want = {(a, b) for a, b in itertools.combinations(sorted(f), 2) if f[a].key == f[b].key or S.token_sort_ratio(f[a].key, f[b].key) >= 90}
    assert {(r.lower_id, r.higher_id) for r in E.near_titles(rows).collect()} == want and len(want) > 5


def test_query_variants(spark):
    """The searches of every track of the whole table, built one after the other."""
    import re

    from tonearm.plans import scalars

    def plain(text):
        return re.sub(r"\s+", " ", re.sub(r"[^\w\s']+", " ", text)).strip()

    def distinct(texts):
        seen, out = set(), []
        for x in texts:
            if x and x.lower() not in seen:
                seen.add(x.lower())
                out.append(x)
        return out

    def searches(artist, title, album):
        artists = distinct([*map(plain, re.split(rf"\s*(?:{X.ARTIST_JOINTS})\s*", artist, flags=re.I)), plain(artist)])
        without = re.sub(X.FEATURE_TO_END, "", re.sub(X.FEATURE_IN_BRACKETS, "", title, flags=re.I), flags=re.I)
        bare = re.sub(X.QUERY_TO_END, "", re.sub(X.QUERY_IN_BRACKETS, "", without, flags=re.I), flags=re.I)
        names = distinct([plain(title), plain(without), plain(bare)])
        both = [plain(f"{a} {n}") for a in artists for n in names]
        albums = [plain(f"{a} {album}") if album and plain(album) else "" for a in artists]
        alone = [n for n in names if len(n) >= 4 and n.lower() not in X.GENERIC_TITLES]
        return distinct([*both, *albums, *alone])[:12]

    t = Tables(spark, SF)
    got = {r.id: r.queries for r in scalars.query_variants(t).collect()}
    want = {r.id: searches(r.artist, r.title, r.album) for r in scalars.titles(t).collect()}
    assert got == want and max(map(len, want.values())) > 3
    hard = [(1, "Intro", "A & B feat. C, D / E", None), (2, "It's (with X) [Remix] - Radio Edit", "Mixx and Match", ""), (3, "Ab", "x", "!!"), (4, "Song - feat. Y", "Y vs. Z", "Album")]
    df = spark.createDataFrame(hard, "id long, title string, artist string, album string")
    rows = {r.id: r.q for r in df.select("id", X.query_variants(df.artist, df.title, df.album).alias("q")).collect()}
    assert rows == {i: searches(a, t_, al) for i, t_, a, al in hard}
