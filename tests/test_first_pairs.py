"""The first pairs of a bucket are those of all its pairs, and few members of a large class meet."""

import itertools
import random

import pytest

from tonearm.operators import entity as E
from tonearm.operators import first_pairs as P
from tonearm.operators.graph import component_of_each

from test_plain import TRACK, plain_suggestions, suggestions


def plain_first(members, classes, known, final, k):
    by_class, out = {}, {}
    for row in members:
        by_class.setdefault(row[1], []).append(row)
    for a, b, bucket, score in classes:
        for x, y in itertools.combinations(by_class[a], 2) if a == b else itertools.product(by_class[a], by_class[b]):
            ids, parts = tuple(sorted((x[2], y[2]))), tuple(sorted((x[4], y[4])))
            if not (x[3] and x[3] == y[3]) and parts[0] != parts[1] and parts not in known and ids not in final:
                out.setdefault(bucket, []).append((-score, *ids))
    return {(bucket, low, high, -s) for bucket, found in out.items() for s, low, high in sorted(found)[:k]}


@pytest.mark.parametrize("seed", range(4))
def test_first_pairs(spark, seed):
    """Classes of one or two codes and components, barred components with a hub, decided pairs: the reduction loses none."""
    rng = random.Random(seed)
    members, classes = [], []
    ids = iter(rng.sample(range(1000), 400))
    for bucket in range(3):
        held = []
        for _ in range(3):
            own = sorted(next(ids) for _ in range(rng.choice([1, 20, 60])))
            held.append(own[0])
            common = rng.choice([0.1, 0.97])
            members += [(bucket, own[0], i, None if rng.random() < 0.2 and seed % 2 else "c0" if rng.random() < common else f"c{rng.randrange(6)}", bucket if rng.random() < common else rng.randrange(12)) for i in own]
        classes += [(a, b, bucket, rng.choice([1.0, 0.95])) for a, b in itertools.combinations_with_replacement(held, 2)]
    known = {tuple(sorted((rng.choice([0, 1, rng.randrange(12)]), rng.randrange(12)))) for _ in range(25)}
    of = [[m for m in members if m[0] == b] for b in range(3)]
    final = {tuple(sorted(x[2] for x in rng.sample(g, 2))) for g in of if len(g) > 2 for _ in range(100)}
    final |= {tuple(sorted((g[0][2], x[2]))) for g in of for x in g[1:30]}
    want = plain_first(members, classes, known, final, 5)
    df = spark.createDataFrame
    got = P.first_pairs(df(members, "bucket long, class long, id long, code string, component long"), df(classes, "a_class long, b_class long, bucket long, score double"), df(sorted(known), "a long, b long"), df(sorted(final), "lower_id long, higher_id long"), 5)
    assert {(r.bucket, r.lower_id, r.higher_id, r.score) for r in got.select("bucket", "lower_id", "higher_id", "score").collect()} == want and len(want) > 5


@pytest.mark.parametrize("seed", range(2))
def test_random_suggestions(spark, seed):
    rng = random.Random(seed)
    pick = rng.choice
    rows = [(i, pick(["North Star", "North Star (Live)", "North Stars", "North Star"]), "June", pick(["Night", "Night", "Day", None]), pick([None, 1000, 9000, 15000, 40000]), pick([None, "N/A", "USABC2400001", "USABC2400002"])) for i in range(90)]
    pairs = lambda n: {tuple(sorted(rng.sample(range(90), 2))) for _ in range(n)}
    edges = [(*p, pick(["equivalent", "related"])) for p in sorted(pairs(60))]
    decided = [(*p, pick(["accepted", "rejected", "pending"])) for p in sorted(pairs(300))]
    tracks, stored = spark.createDataFrame(rows, TRACK), spark.createDataFrame(edges, "lower_id long, higher_id long, type string")
    got = E.relationship_suggestions(tracks, component_of_each(tracks.selectExpr("id AS track_id"), stored), stored, spark.createDataFrame(decided, "lower_id long, higher_id long, status string"))
    assert suggestions(got) == plain_suggestions(tracks, edges, decided)


def test_a_large_class_makes_few_pairs(spark):
    """30,000 equal tracks are 450 million pairs; of one class no more than a bounded number of members meet."""
    n = 30_000
    tracks = spark.range(n).selectExpr("id", "'Song' AS title", "'One' AS artist", "'Album' AS album", "1000L AS duration_ms", "CASE WHEN id < 20000 THEN 'USABC2400001' END AS isrc")
    members, classes = E._suggestible(tracks, spark.createDataFrame([], "track_id long, component long"))
    none = spark.createDataFrame([], "a long, b long")
    assert members.count() == n and classes.count() == 1
    assert P._needed(members, none, none.toDF("lower_id", "higher_id"), 5).count() < 100
    got = P.first_pairs(members, classes, none, none.toDF("lower_id", "higher_id"), 5)
    assert sorted((r.lower_id, r.higher_id) for r in got.collect()) == [(0, 20000 + i) for i in range(5)]
