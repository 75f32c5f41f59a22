"""Numbers, durations, vectors and labels as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the scoring rules.
TITLE_WEIGHT, ARTIST_WEIGHT, ALBUM_WEIGHT, DURATION_WEIGHT, DURATION_TOLERANCE_MS = 0.68, 0.26, 0.04, 0.02, 10_000
SEVERE_DURATION_MS = 60_000


def clamp(x: Column, low, high) -> Column:
    return F.greatest(F.lit(low), F.least(x, F.lit(high)))


def finite(x: Column) -> Column:
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def milliseconds(seconds: Column) -> Column:
    """Truncated."""
    return (seconds * 1000).cast("long")


def nearest_rank(values: Column, p: float) -> Column:
    """Of an array: its element at the half-even rounded rank."""
    s = F.array_sort(values)
    return F.element_at(s, F.bround((F.size(s) - 1) * F.lit(p)).cast("int") + 1)


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x))


def octave_fold(bpm: Column, low: float = 85.0, high: float = 170.0) -> Column:
    """Doubled to at least ``low`` or halved to at most ``high``; null if not positive."""
    up = bpm * F.pow(F.lit(2.0), F.ceil(F.log2(F.lit(low) / bpm)))
    down = bpm / F.pow(F.lit(2.0), F.ceil(F.log2(bpm / F.lit(high))))
    return F.when(bpm <= 0, None).when(bpm < low, up).when(bpm > high, down).otherwise(bpm)


def seeded_rank(id_col: Column, seed: int) -> Column:
    """A seeded tie-break in 32 bits; the product is taken modulo 2**32 in halves, so no id overflows."""
    a = 1103515245
    low, high = id_col.bitwiseAND(F.lit(0xFFFF)), F.shiftright(id_col, 16).bitwiseAND(F.lit(0xFFFF))
    return (low * a + F.shiftleft((high * a).bitwiseAND(F.lit(0xFFFF)), 16) + F.lit(seed * 12345 & 0xFFFFFFFF)).bitwiseAND(F.lit(0xFFFFFFFF))


def energy_score(tempo: Column, rms: Column, onset: Column) -> Column:
    parts = F.array_compact(F.array(clamp((tempo - 85) / 50, 0.0, 1.0), clamp((rms - 0.08) / 0.28, 0.0, 1.0), clamp(onset / 2, 0.0, 1.0)))
    return F.when(F.size(parts) > 0, F.aggregate(parts, F.lit(0.0), lambda s, x: s + x) / F.size(parts))


def energy_band(score: Column) -> Column:
    return F.when(score < 0.4, "Low Energy").when(score < 0.72, "Medium Energy").when(score.isNotNull(), "High Energy")


def ladder(x: Column, steps: list[tuple[Column, float]], otherwise: float) -> Column:
    return reduce(lambda out, s: out.when(s[0], s[1]), steps[1:], F.when(steps[0][0], steps[0][1])).otherwise(F.lit(otherwise))


def duration_bonus(expected_ms: Column, found_ms: Column) -> Column:
    d = F.abs(expected_ms - found_ms)
    return F.when(d.isNull() | (d >= SEVERE_DURATION_MS), 0.0).when(d <= 5000, 1.0).otherwise(1.0 - d / SEVERE_DURATION_MS)


def severe_mismatch(expected_ms: Column, found_ms: Column) -> Column:
    return F.coalesce(F.abs(expected_ms - found_ms) > F.greatest(F.lit(SEVERE_DURATION_MS), (expected_ms * 0.25).cast("long")), F.lit(False))


def queue_bonus(n: Column) -> Column:
    return ladder(n, [(n.isNull(), 0.2), (n <= 0, 1.0), (n <= 5, 0.75), (n <= 20, 0.45)], 0.1)


def speed_bonus(n: Column) -> Column:
    return ladder(n, [(n.isNull() | (n <= 0), 0.0), (n >= 1_000_000, 1.0), (n >= 250_000, 0.7), (n >= 50_000, 0.4)], 0.15)


def quality_bonus(depth: Column, rate: Column, lossless: Column) -> Column:
    return ladder(depth, [(F.coalesce(depth >= 16, F.lit(False)), 1.0), (lossless, 0.9), (rate.isNull(), 0.2), (rate >= 320, 1.0), (rate >= 256, 0.75), (rate >= 192, 0.55)], 0.25)


def tag_score(title: Column, artist: Column, album: Column, left_ms: Column, right_ms: Column) -> Column:
    """From similarities (album null if unknown) and durations, in plain double arithmetic and this order."""
    near = F.coalesce(F.abs(left_ms - right_ms) <= DURATION_TOLERANCE_MS, F.lit(False))
    return F.least(title * TITLE_WEIGHT + artist * ARTIST_WEIGHT + F.coalesce(album * ALBUM_WEIGHT, F.lit(0.0)) + F.when(near, DURATION_WEIGHT).otherwise(0.0), F.lit(1.0))
