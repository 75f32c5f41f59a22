"""Toxicity by cumulative-link ordinal regression.

``P(grade <= k) = sigmoid(theta_k - f(x))`` with one weight vector shared by all ordered thresholds ``theta``; the expected severity is
``sum_k P(grade > k)``. Inputs are hashed counts of words and of their stems; a screen on the training rows keeps the word slots whose presence
goes with the grade well past chance, so the many neutral words of a long text add no noise.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonearm.llm.factorisation import sigmoid
from tonearm.llm.learning import held_out, labelled_sample, score_all

BITS = 18


def screen(starts: np.ndarray, idx: np.ndarray, bad: np.ndarray, size: int, least_z: float = 4.0, least_rows: int = 5) -> np.ndarray:
    """Signed z of each slot's presence in rows with ``bad`` against the others; zero where it is under ``least_z`` or in few rows."""
    row = np.repeat(np.arange(len(starts), dtype=np.int32), np.diff(np.append(starts, len(idx))))
    both = np.bincount(idx, minlength=size).astype(float)
    hits = np.bincount(idx[bad[row]], minlength=size).astype(float)
    share = bad.mean()
    z = (hits - both * share) / np.sqrt(np.maximum(both * share * (1 - share), 1e-9))
    z[(both < least_rows) | (np.abs(z) < least_z)] = 0
    z[-1] = 0
    return z


def grades_of(starts: np.ndarray, idx: np.ndarray, val: np.ndarray, toxic: np.ndarray, size: int, grades: int = 4) -> np.ndarray:
    """Severity grades where labels are only 0 or 1: 0 for clean rows; toxic rows by how many telling words they hold, in equal shares."""
    telling = screen(starts, idx, toxic > 0, size) > 0
    row = np.repeat(np.arange(len(starts), dtype=np.int32), np.diff(np.append(starts, len(idx))))
    hits = np.bincount(row, (val * val) * telling[idx], len(starts))
    out = np.zeros(len(starts), np.int64)
    bad = toxic > 0
    if bad.any():
        cuts = np.quantile(hits[bad], np.arange(1, grades - 1) / (grades - 1))
        out[bad] = 1 + np.searchsorted(cuts, hits[bad], side="left")
    return out


def fit(starts: np.ndarray, idx: np.ndarray, val: np.ndarray, grade: np.ndarray, size: int, rounds: int = 400, rate: float = 0.1, decay: float = 1e-4) -> dict:
    """Full-batch Adam on the ordinal log loss over the screened slots. The thresholds stay ordered: the gaps between them are exponentials."""
    levels = int(grade.max()) if len(grade) else 0
    if not levels or (grade == grade.min()).all():
        return {"slots": np.empty(0, np.int64), "weights": np.empty(0), "theta": np.full(max(1, levels), 6.0)}
    z = screen(starts, idx, grade > 0, size)
    slots = np.flatnonzero(z)
    place = np.full(size, -1, np.int64)
    place[slots] = np.arange(len(slots))
    row = np.repeat(np.arange(len(starts), dtype=np.int32), np.diff(np.append(starts, len(idx))))
    use = place[idx] >= 0
    r, c, x = row[use], place[idx[use]], val[use].astype(float)
    n = len(starts)
    p = np.concatenate([np.zeros(len(slots)), [2.0], np.zeros(levels - 1)])
    m1, m2 = np.zeros_like(p), np.zeros_like(p)
    for t in range(1, rounds + 1):
        w, theta = p[: len(slots)], np.cumsum(np.concatenate([[p[len(slots)]], np.exp(p[len(slots) + 1 :])]))
        f = np.bincount(r, x * w[c], n)
        below = sigmoid(theta - f[:, None])
        upper, lower = np.concatenate([below, np.ones((n, 1))], 1), np.concatenate([np.zeros((n, 1)), below], 1)
        prob = np.maximum(np.take_along_axis(upper - lower, grade[:, None], 1)[:, 0], 1e-9)
        slope = below * (1 - below)
        pad_u, pad_l = np.concatenate([slope, np.zeros((n, 1))], 1), np.concatenate([np.zeros((n, 1)), slope], 1)
        du, dl = np.take_along_axis(pad_u, grade[:, None], 1)[:, 0] / prob, np.take_along_axis(pad_l, grade[:, None], 1)[:, 0] / prob
        gw = np.bincount(c, ((du - dl) / n)[r] * x, len(slots)) + decay * w
        gt = np.zeros(levels)
        np.add.at(gt, np.minimum(grade, levels - 1), np.where(grade < levels, -du / n, 0))
        np.add.at(gt, np.maximum(grade - 1, 0), np.where(grade > 0, dl / n, 0))
        tail = np.cumsum(gt[::-1])[::-1]
        g = np.concatenate([gw, [tail[0]], tail[1:] * np.exp(p[len(slots) + 1 :])])
        m1, m2 = 0.9 * m1 + 0.1 * g, 0.999 * m2 + 0.001 * g * g
        p -= rate * (m1 / (1 - 0.9**t)) / (np.sqrt(m2 / (1 - 0.999**t)) + 1e-8)
    return {"slots": slots, "weights": p[: len(slots)], "theta": np.cumsum(np.concatenate([[p[len(slots)]], np.exp(p[len(slots) + 1 :])]))}


def severity(model: dict, starts: np.ndarray, idx: np.ndarray, val: np.ndarray) -> list[np.ndarray]:
    """Expected severity, chance of any severity (grade over 0), and most likely grade."""
    n = len(starts)
    if not n:
        return [np.empty(0)] * 3
    row = np.repeat(np.arange(n), np.diff(np.append(starts, len(idx))))
    at = np.searchsorted(model["slots"], idx)
    at[at == len(model["slots"])] = 0
    use = model["slots"][at] == idx if len(model["slots"]) else np.zeros(len(idx), bool)
    f = np.bincount(row[use], val[use] * model["weights"][at[use]], n) if use.any() else np.zeros(n)
    above = 1 - sigmoid(model["theta"] - f[:, None])
    prob = np.concatenate([np.ones((n, 1)), above], 1) - np.concatenate([above, np.zeros((n, 1))], 1)
    return [above.sum(axis=1), above[:, 0], prob.argmax(axis=1)]


def toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic", id_col: str = "doc_id", text_col: str = "text", folds: int = 5, max_train: int = 20_000, grades: int = 4, binary: bool = True, toxic_at: float = 0.3, bits: int = BITS) -> DataFrame:
    """One row per row of ``docs``: id, held_out, expected_severity (0 to grades - 1), score (chance of any severity), grade, predicted (1 if ``score >= toxic_at``).

    ``binary``: the label is 0 or 1, and grades of the toxic training rows come from how many telling words they hold; else the
    label is the grade. Labels are learnt from at most ``max_train`` rows outside the held-out fold. Null and empty texts hold no word and
    get the severity of a text without any; null ids are scored and not held out; repeated rows are scored alike; an empty table gives no rows; without
    labels the severity is next to none; other columns are not read.
    """
    starts, idx, val, y = labelled_sample(docs, labels, label, id_col, text_col, folds, max_train, bits, False, False)
    size = (1 << bits) + 1
    grade = grades_of(starts, idx, val, y, size, grades) if binary and len(y) else y
    model = fit(starts, idx, val, grade, size)
    out = score_all(docs, [id_col], text_col, model, severity, ["expected_severity", "score", "top"], bits, False, False)
    return out.select(id_col, held_out(id_col, folds).alias("held_out"), "expected_severity", "score", F.col("top").cast("int").alias("grade"), (F.col("score") >= toxic_at).cast("int").alias("predicted"))
