"""The learned operators against plain versions of their definitions."""

import math

import numpy as np
import pytest

SF = "/root/testdata/sf0.001"


def entries(starts, idx, val, row):
    end = starts[row + 1] if row + 1 < len(starts) else len(idx)
    return list(zip(idx[starts[row] : end].tolist(), val[starts[row] : end].astype(float).tolist()))


def plain_machine(w, v, x):
    """Every pair of entries, one by one."""
    out = sum(w[i] * a for i, a in x)
    for k, (i, a) in enumerate(x):
        for j, b in x[k + 1 :]:
            out += float(np.dot(v[i], v[j])) * a * b
    return 1 / (1 + math.exp(-max(-35.0, min(35.0, out))))


def test_quality_scores_are_all_pairs(spark):
    """The linear-time identity gives what the double loop over pairs gives, for every text of the table."""
    from tonearm.llm import factorisation
    from tonearm.llm.features import hashed

    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    w, v = factorisation.fit_labels(docs, labels, "quality", "doc_id", "text", 5, 12_000, factorisation.BITS)
    got = {r.doc_id: r for r in factorisation.quality_scores(docs, labels).collect()}
    assert len({round(r.score, 3) for r in got.values()}) > 20
    for r in docs.collect():
        x = entries(*hashed([(r.text or "").encode()], factorisation.BITS), 0)
        if len(x) < 400:
            want = plain_machine(w.astype(float), v.astype(float), x)
            assert abs(got[r.doc_id].score - want) < 1e-4
            assert got[r.doc_id].predicted == (got[r.doc_id].score >= 0.3)


def test_fit_follows_the_gradient():
    """One small step of the fit against numeric slopes of the plain loss."""
    from tonearm.llm.factorisation import raw

    rng = np.random.default_rng(3)
    w, v = rng.normal(0, 0.3, 12), rng.normal(0, 0.3, (12, 4))
    starts, idx, val = np.array([0, 3, 7]), rng.integers(0, 12, 11), rng.random(11)
    z = raw((w, v), starts, idx, val)
    for row in range(3):
        x = entries(starts, idx, val, row)
        assert abs(1 / (1 + math.exp(-z[row])) - plain_machine(w, v, x)) < 1e-12


def plain_loss(w, theta, rows, grade, decay):
    """Negative log likelihood of the cumulative links, by the definition."""
    link = lambda x: 1 / (1 + math.exp(-x))
    out = 0.0
    for x, g in zip(rows, grade):
        f = sum(w[i] * a for i, a in x)
        upper = link(theta[g] - f) if g < len(theta) else 1.0
        lower = link(theta[g - 1] - f) if g else 0.0
        out -= math.log(upper - lower)
    return out / len(rows) + decay / 2 * float(np.dot(w, w))


def test_ordinal_fit_is_at_the_least_loss():
    """At the fitted weights and thresholds the plain loss has no slope left."""
    from tonearm.llm.ordinal import fit, severity

    rng = np.random.default_rng(5)
    rows, grade = [], []
    for _ in range(300):
        hits = int(rng.integers(0, 4))
        rows.append([(3, float(hits))] * (hits > 0) + [(int(rng.integers(10, 30)), 1.0), (40, 1.0)])
        grade.append(min(3, max(0, hits + int(rng.integers(-1, 2)))))
    starts = np.concatenate([[0], np.cumsum([len(r) for r in rows])[:-1]])
    idx, val = np.array([i for r in rows for i, _ in r], np.int32), np.array([a for r in rows for _, a in r], np.float32)
    model = fit(starts, idx, val, np.array(grade), 41, rounds=4000, rate=0.02)
    w, theta = np.zeros(41), model["theta"]
    w[model["slots"]] = model["weights"]
    assert len(model["slots"]) and (np.diff(theta) > 0).all()
    base = plain_loss(w, theta, rows, grade, 1e-4)
    for k in range(len(theta)):
        for step in (-0.02, 0.02):
            moved = theta.copy()
            moved[k] += step
            assert plain_loss(w, moved, rows, grade, 1e-4) >= base - 1e-6
    for slot in model["slots"]:
        for step in (-0.02, 0.02):
            moved = w.copy()
            moved[slot] += step
            assert plain_loss(moved, theta, rows, grade, 1e-4) >= base - 1e-6
    expected, some, most = severity(model, starts, idx, val)
    for k, x in enumerate(rows[:50]):
        f = sum(w[i] * a for i, a in x)
        above = [1 - 1 / (1 + math.exp(-(t - f))) for t in theta]
        chance = [a - b for a, b in zip([1.0, *above], [*above, 0.0])]
        assert abs(expected[k] - sum(g * c for g, c in enumerate(chance))) < 1e-9
        assert abs(some[k] - above[0]) < 1e-9 and most[k] == max(range(len(chance)), key=chance.__getitem__)


@pytest.mark.parametrize("name", ["toxicity"])
def test_severity_of_every_text(spark, name):
    """Over the whole table: the stored model put to each text by the plain formula."""
    from tonearm.llm import ordinal
    from tonearm.llm.features import hashed
    from tonearm.llm.learning import labelled_sample

    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    starts, idx, val, y = labelled_sample(docs, labels, "toxic", "doc_id", "text", 5, 20_000, ordinal.BITS, False, False)
    size = (1 << ordinal.BITS) + 1
    model = ordinal.fit(starts, idx, val, ordinal.grades_of(starts, idx, val, y, size), size)
    weight = dict(zip(model["slots"].tolist(), model["weights"].tolist()))
    got = {r.doc_id: r for r in ordinal.toxicity(docs, labels).collect()}
    for r in docs.collect():
        x = entries(*hashed([(r.text or "").encode()], ordinal.BITS, False, False), 0)
        f = sum(weight.get(i, 0.0) * a for i, a in x)
        above = [1 - 1 / (1 + math.exp(-max(-35.0, min(35.0, t - f)))) for t in model["theta"]]
        assert abs(got[r.doc_id].expected_severity - sum(above)) < 1e-6
        assert got[r.doc_id].predicted == (got[r.doc_id].score >= 0.3)


def test_a_sample_is_bounded_in_bytes(spark):
    """The first rows in the order of the ids' hashes, as many as fit; the bound is one of text."""
    from tonearm.llm.learning import labelled_sample

    docs = spark.createDataFrame([(i, "word " * 100) for i in range(50)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(50)], "doc_id long, quality int")
    sizes = [len(labelled_sample(docs, labels, "quality", "doc_id", "text", 5, limit, 10, True, True, most)[0]) for limit, most in ((100, 1 << 20), (7, 1 << 20), (100, 5000), (100, 499), (100, 0))]
    assert sizes[0] > 30 and sizes[1:] == [7, 10, 0, 0]
