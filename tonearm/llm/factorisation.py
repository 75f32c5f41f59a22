"""Quality classifier: a factorisation machine over hashed words, structure statistics and text metadata.

``score = sigmoid(w0 + sum w_i x_i + 1/2 sum_f [(sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2])``: the sum-of-squares identity gives all
pairwise interactions in time linear in the entries. Length in words and characters is the metadata; labels, language, source and id are
no inputs.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonearm.llm.features import width
from tonearm.llm.learning import held_out, labelled_sample, rows_of, score_all

BITS = 16


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def raw(model: tuple[np.ndarray, np.ndarray], starts: np.ndarray, idx: np.ndarray, val: np.ndarray) -> np.ndarray:
    if not len(starts):
        return np.empty(0)
    w, v = model
    vx = v[idx] * val[:, None]
    total, squares = np.add.reduceat(vx, starts, axis=0), np.add.reduceat(vx * vx, starts, axis=0)
    return np.add.reduceat(w[idx] * val, starts) + 0.5 * (total * total - squares).sum(axis=1)


def fit(starts: np.ndarray, idx: np.ndarray, val: np.ndarray, y: np.ndarray, size: int, factors: int = 8, updates: int = 1500, batch: int = 128, rate: float = 0.3, decay: float = 2e-5, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """AdaGrad on the log loss: at least ``updates`` small batches, in an order fixed by ``seed``. Without labels of both kinds the model is the constant prior."""
    rng = np.random.default_rng(seed)
    w = np.zeros(size, np.float32)
    v = rng.normal(0, 0.02, (size, factors)).astype(np.float32)
    prior = (y.sum() + 0.5) / (len(y) + 1)
    w[-1] = np.log(prior / (1 - prior))
    if len(np.unique(y)) < 2:
        return w, np.zeros_like(v)
    gw, gv = np.full(size, 1e-3, np.float32), np.full((size, factors), 1e-3, np.float32)
    batches = max(1, len(y) // batch)
    for _ in range(-(-updates // batches)):
        for at in np.array_split(rng.permutation(len(y)), batches):
            entries, begin = rows_of(starts, len(idx), at)
            i, x = idx[entries], val[entries]
            vi = v[i]
            vx = vi * x[:, None]
            total = np.add.reduceat(vx, begin, axis=0)
            z = np.add.reduceat(w[i] * x, begin) + 0.5 * (total * total - np.add.reduceat(vx * vx, begin, axis=0)).sum(axis=1)
            g = ((sigmoid(z) - y[at]) / len(at)).astype(np.float32)
            row = np.repeat(np.arange(len(at)), np.diff(np.append(begin, len(i))))
            slots, of = np.unique(i, return_inverse=True)
            dw = np.bincount(of, g[row] * x, len(slots)).astype(np.float32) + decay * w[slots]
            each = (g[row] * x)[:, None] * (total[row] - vx)
            dv = np.stack([np.bincount(of, each[:, f], len(slots)) for f in range(factors)], axis=1).astype(np.float32) + decay * v[slots]
            gw[slots] += dw * dw
            gv[slots] += dv * dv
            w[slots] -= rate * dw / np.sqrt(gw[slots])
            v[slots] -= rate * 0.3 * dv / np.sqrt(gv[slots])
    return w, v


def fit_labels(docs: DataFrame, labels: DataFrame, label: str, id_col: str, text_col: str, folds: int, max_train: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    starts, idx, val, y = labelled_sample(docs, labels, label, id_col, text_col, folds, max_train, bits, True, True)
    return fit(starts, idx, val, y, width(bits))


def quality_scores(docs: DataFrame, labels: DataFrame, label: str = "quality", id_col: str = "doc_id", text_col: str = "text", folds: int = 5, max_train: int = 12_000, keep_at: float = 0.3, bits: int = BITS) -> DataFrame:
    """One row per row of ``docs``: id, held_out, score (0 to 1, higher: label 1 is likelier), predicted (1 if ``score >= keep_at``).

    Labels are learnt from at most ``max_train`` labelled rows outside the held-out fold (crc32 of the id, modulo ``folds``, not 0). Null and empty
    texts are scored by their statistics alone; null ids are scored and not held out; repeated rows get equal scores; an empty
    table gives no rows; without labels every score is the prior; other columns are not read.
    """
    model = fit_labels(docs, labels, label, id_col, text_col, folds, max_train, bits)
    out = score_all(docs, [id_col], text_col, model, lambda m, *x: [sigmoid(raw(m, *x))], ["score"], bits, True, True)
    return out.select(id_col, held_out(id_col, folds).alias("held_out"), "score", (F.col("score") >= keep_at).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, label: str = "quality", id_col: str = "doc_id", text_col: str = "text", folds: int = 5, max_train: int = 12_000, keep_at: float = 0.3, bits: int = BITS) -> DataFrame:
    """The rows of ``docs`` that score at least ``keep_at``, in one pass without a shuffle."""
    model = fit_labels(docs, labels, label, id_col, text_col, folds, max_train, bits)
    plain = docs.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(docs.columns)])
    scored = score_all(plain, plain.columns, f"c{docs.columns.index(text_col)}", model, lambda m, *x: [sigmoid(raw(m, *x))], ["quality_score"], bits, True, True)
    return scored.where(F.col("quality_score") >= keep_at).select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)])
