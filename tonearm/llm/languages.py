"""Language identification as a mixture: which languages is a text made of, and in what proportions?

Each language has a distribution over hashed byte n-grams of letters. A text's n-grams are taken as drawn from a mixture of these
distributions; expectation-maximisation gives the proportions of greatest likelihood. The set of languages grows from the best single one and keeps
a further one only if the likelihood gains more than a penalty. The log-likelihood is concave in the proportions, so what a further language may
gain at most is known from the slope towards it: sets that cannot pay need no EM, and no answer changes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tonearm.llm.worker import tidy

ORDER = 3
BITS = 16
#: Bytes of a text that are worked on at a time, and languages whose counts a task holds.
PART, HELD = 1 << 20, 64
#: ASCII bytes that are no letters part words; all other bytes stay.
_BARE = np.array([b if b > 127 or chr(b).isalpha() else 32 for b in range(256)], np.uint8)
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def grams(text: str, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """(slots, counts) of the byte n-grams of a text: lower case, words parted by one space, a space at each end."""
    data = np.frombuffer(text.lower().encode("utf-8", "surrogatepass"), np.uint8)
    total = np.zeros(1 << bits, np.int64)
    held = np.full(1, 32, np.uint8)
    for at in range(0, len(data), PART):
        part = np.concatenate([held, _BARE[data[at : at + PART]], np.full(int(at + PART >= len(data)), 32, np.uint8)])
        # A space after a space goes; the first byte has been looked at before.
        part = part[np.concatenate([[True], (part[1:] != 32) | (part[:-1] != 32)])]
        total += np.bincount(_slots(part, bits), minlength=1 << bits)
        held = part[-(ORDER - 1) :]
    slots = np.flatnonzero(total)
    return slots, total[slots]


def _slots(part: np.ndarray, bits: int) -> np.ndarray:
    if len(part) < ORDER:
        return np.empty(0, np.int64)
    code = np.zeros(len(part) - ORDER + 1, np.uint64)
    for k in range(ORDER):
        code = code << np.uint64(8) | part[k : len(part) - ORDER + 1 + k]
    return ((code + np.uint64(1)) * _FACTOR >> np.uint64(64 - bits)).astype(np.int64)


def not_learnt(id_col: str, folds: int, fold: int) -> Column:
    """True for the ids that nothing is learnt from. Null ids are false."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == fold, F.lit(False))


def learn(docs: DataFrame, text_col: str, lang_col: str, bits: int, weight: float, max_languages: int) -> tuple[list[str], np.ndarray]:
    """(languages in order, (slots, languages) of probabilities) from all rows of ``docs`` with a text and a language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}

        def told() -> Iterator[pa.RecordBatch]:
            for lang, n in counts.items():
                slot = np.flatnonzero(n)
                yield pa.record_batch([pa.array([lang] * len(slot), pa.string()), pa.array(slot, pa.int32()), pa.array(n[slot])], names=["lang", "slot", "n"])
            counts.clear()

        for batch in batches:
            for text, lang in zip(batch.column(0), batch.column(1).to_pylist()):
                slot, n = grams(text.as_py(), bits)
                if lang not in counts:
                    if len(counts) >= HELD:
                        yield from told()
                    counts[lang] = np.zeros(1 << bits, np.int64)
                counts[lang][slot] += n
        yield from told()

    own = docs.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(text_col, F.col(lang_col).cast("string").alias("lang"))
    table = own.mapInArrow(tidy(run), "lang string, slot int, n long").groupBy("lang", "slot").agg(F.sum("n").alias("n"))
    names = sorted(r.lang for r in own.select("lang").distinct().limit(max_languages + 1).collect())
    if len(names) > max_languages:
        raise ValueError(f"over {max_languages} different languages; the model has {4 << bits} bytes for each, so raise max_languages if that fits the executors")
    place = {lang: k for k, lang in enumerate(names)}
    seen = np.zeros((1 << bits, len(names)))
    got = table.toArrow()
    seen[got.column("slot").to_numpy(), np.array([place[x] for x in got.column("lang").to_pylist()], np.int64)] = got.column("n").to_numpy()
    return names, smoothed(seen, weight)


def smoothed(seen: np.ndarray, weight: float) -> np.ndarray:
    """Each language's shares of its n-grams, with ``weight`` n-grams of the average language added."""
    size = len(seen)
    both = (seen.sum(axis=1) + 1.0) / (seen.sum() + size)
    return ((seen + weight * both[:, None]) / (seen.sum(axis=0) + weight)).astype(np.float32)


def log_likelihood(p: np.ndarray, n: np.ndarray, share: np.ndarray) -> float:
    return float(np.dot(n, np.log(p @ share)))


def expectation_maximisation(p: np.ndarray, n: np.ndarray, share: np.ndarray, rounds: int = 200, least: float = 1e-7) -> np.ndarray:
    """Proportions of greatest likelihood of the mixture of the columns of ``p``, from ``share`` on; ``n`` says how often each row occurred."""
    total = n.sum()
    for _ in range(rounds):
        after = share * (p.T @ (n / (p @ share))) / total
        if np.abs(after - share).max() < least:
            return after
        share = after
    return share


def mixture(p: np.ndarray, n: np.ndarray, penalty: float) -> tuple[np.ndarray, np.ndarray]:
    """(languages, their proportions, in falling order of these) of one text; ``p`` is (n-grams, languages), ``n`` how often each n-gram occurred.

    A text of N n-grams holds about N / ORDER independent ones, since they overlap; counts are scaled by that. No language more and no language less
    than in the answer gives a better penalised likelihood.
    """
    n = n / ORDER
    cost = penalty * np.log(max(n.sum(), 2.0))
    alone = np.log(p).T @ n
    chosen = [int(np.argmax(alone))]
    share, reached = np.ones(1), float(alone[chosen[0]])

    def fitted(some: list[int], start: np.ndarray) -> tuple[list[int], np.ndarray, float]:
        best = expectation_maximisation(p[:, some], n, start / start.sum())
        return some, best, log_likelihood(p[:, some], n, best)

    while True:
        # The slope towards a further language bounds what it can add.
        slope = p.T @ (n / (p[:, chosen] @ share)) - n.sum()
        slope[chosen] = -np.inf
        wider = [fitted([*chosen, int(k)], np.append(share, 1.0)) for k in np.flatnonzero(slope > cost)]
        better = max(wider, key=lambda f: f[2], default=None)
        if better is None or better[2] - reached <= cost:
            return _ordered(chosen, share)
        chosen, share, reached = better
        # One that came in early may be needless beside the others.
        while len(chosen) > 1:
            less = max((fitted(chosen[:k] + chosen[k + 1 :], np.delete(share, k) + 1e-3) for k in range(len(chosen))), key=lambda f: f[2])
            if reached - less[2] >= cost:
                break
            chosen, share, reached = less


def _ordered(chosen: list[int], share: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.lexsort((chosen, -share))
    return np.array(chosen)[at], share[at]


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = 3, fold: int = 1, penalty: float = 1.0, weight: float = 2000.0, bits: int = BITS, max_languages: int = 500) -> DataFrame:
    """One row per row of ``docs``: id, held_out, lang_pred, score, languages, proportions.

    Learns from the texts and non-null ``lang_col`` of all rows but those of the held-out fold (crc32 of the id as text, modulo ``folds``, is ``fold``; null ids are learnt from).
    ``languages`` and ``proportions`` are the selected set, in falling order of proportion; ``lang_pred`` and ``score`` are the first of them (of equal proportions the
    language that sorts first). A null text, or one without a letter, is ``und`` with score 0 and no languages; so is every text where
    nothing can be learnt. A further language costs ``penalty`` times the logarithm of the text's length. Texts are read whole; repeated rows get equal results; an
    empty table gives no rows; other columns are not read. The model is 2^bits floats for each language, at most ``max_languages``
    of them (more are an error, since the model goes to all tasks).
    """
    held = not_learnt(id_col, folds, fold)
    names, model = learn(docs.where(~held), text_col, lang_col, bits, weight, max_languages)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), *T.StructType.fromDDL("held_out boolean, lang_pred string, score double, languages array<string>, proportions array<double>").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets, shares = [], []
            for cell in batch.column(2):
                text = cell.as_py()
                found, share = (), ()
                if names and text and has_letter(text):
                    slots, n = grams(text, bits)
                    if len(slots):
                        found, share = mixture(shared.value[slots].astype(float), n, penalty)
                sets.append([names[k] for k in found])
                shares.append(list(map(float, share)))
            yield pa.record_batch(
                [batch.column(0), batch.column(1), pa.array([s[0] if s else "und" for s in sets], pa.string()), pa.array([min(1.0, s[0]) if s else 0.0 for s in shares], pa.float64()), pa.array(sets, pa.list_(pa.string())), pa.array(shares, pa.list_(pa.float64()))],
                names=kind.names,
            )

    return docs.select(id_col, held.alias("held_out"), text_col).mapInArrow(tidy(run), kind)
