"""The similarity join of sets, and the fallbacks of candidate lists, against all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from tonearm.operators import entity, set_join


def sets(seed, n, words):
    """Sets of few and many tokens, of which some stand in nearly all of them."""
    rng = random.Random(seed)
    return {f"k{i}": sorted({*rng.sample(["the", "of", "and", "a"], rng.randrange(5)), *(f"w{rng.randrange(words)}" for _ in range(rng.randrange(7)))}) for i in range(n)}


@pytest.mark.parametrize("threshold", [1.0, 0.8, 0.5, 0.3, 1 / 3, 0.1, 0.0])
def test_pairs_are_those_of_all_pairs(spark, threshold):
    left, right = sets(1, 120, 25), sets(2, 150, 25)
    table = lambda s, k: spark.createDataFrame(list(s.items()), f"{k} string, tokens array<string>")
    got = {(r.a, r.b, round(r.sim, 9)) for r in set_join.similar_sets(table(left, "a"), table(right, "b"), threshold).collect()}
    want = set()
    for a, x in left.items():
        for b, y in right.items():
            n = len(set(x) & set(y))
            if n and n / (len(x) + len(y) - n) >= threshold:
                want.add((a, b, round(n / (len(x) + len(y) - n), 9)))
    assert got == want and got


def test_common_tokens_do_not_meet(spark):
    """Three tokens stand in every set; a join on shared tokens has 3 n^2 rows, the prefixes have none of them in common."""
    rng = random.Random(5)
    make = lambda k: spark.createDataFrame([(f"{k}{i}", ["x", "y", "z", *(f"w{rng.randrange(10**6)}" for _ in range(7))]) for i in range(400)], f"{k} string, tokens array<string>")
    left, right = make("a"), make("b")
    shared = left.select("a", F.explode("tokens").alias("t")).join(right.select("b", F.explode("tokens").alias("t")), "t").count()
    assert shared >= 3 * 400 * 400 and set_join.candidates(left, right, 0.5).count() < shared / 1000


def plain_lists(local, tracks, rejected, most, least, threshold=0.3):
    """One list after the other, every track put in order."""
    grams = lambda t: {("  " + w + " ")[i : i + 3] for w in t.lower().split() for i in range(len(w) + 1)}
    out = set()
    for i, t in local:
        sim = {j: (len(grams(t) & grams(u)) / len(grams(t) | grams(u)) if grams(t) & grams(u) else 0) for j, u in tracks if (i, j) not in rejected}
        order = sorted(sim, key=lambda j: (-sim[j], j))
        near = [j for j in order if sim[j] >= threshold][:most]
        # Without any near one all are taken by similarity; what shares nothing comes by id.
        taken = near or order[:most]
        taken += [j for j in sorted(sim) if j not in taken][: max(0, least - len(taken))]
        out |= {(i, j, k + 1) for k, j in enumerate(taken)}
    return out


@pytest.mark.parametrize("most, least", [(4, 3), (12, 3), (40, 5)])
def test_lists_and_their_fallbacks(spark, most, least):
    """Titles near many, near few, near none, and unlike all; rejections longer than a list."""
    rng = random.Random(most)
    words = ["alpha", "alpine", "beta", "better", "gamma", "gamble", "delta", "zeta"]
    tracks = [(i, " ".join(rng.sample(words, rng.choice([1, 2, 3])))) for i in range(1, 61)]
    local = [(100 + i, " ".join(rng.sample(words, 2))) for i in range(6)] + [(110, "alphabetical xylophone quintessence"), (111, "qqq"), (112, "zzzeta kkkkkkkkkkkkkkk")]
    rejected = {(100, j) for j, _ in tracks[:30]} | {(110, j) for j, _ in tracks[::2]} | {(111, 1), (111, 2), (100, 9999)}
    frame = lambda rows: spark.createDataFrame([(i, t, None, None, None, None) for i, t in rows], "id long, title string, artist string, album string, duration_ms long, isrc string")
    got = entity.shared_trigram_candidates(frame(local), frame(tracks), spark.createDataFrame(sorted(rejected), "local_id long, track_id long"), most=most, least=least)
    assert {(r.local_id, r.track_id, r.k) for r in got.collect()} == plain_lists(local, tracks, rejected, most, least)
