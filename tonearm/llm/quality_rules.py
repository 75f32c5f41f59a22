"""Quality rules with adaptive thresholds, in DataFrame functions only.

Each text gets its statistics inside its own row, without a shuffle. Mergeable KLL quantile sketches of each rule's measure, per
language and source, are built with map-side combine and merged per language and for the whole table. A group's quantiles shrink towards
its parent's by its size, and the limits they give replace fixed cutoffs and are joined back on (language, source).

A limit lies ``reach`` spreads past a quantile, the spread being its distance from a second quantile. For all rules but one that is on the side away from
the bad end, so a group's own junk does not widen it, and a group may be laxer than its language by one spread of that at most.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonearm.storage import materialize

#: White space between words, and characters that count as symbols.
SPACE = " \t\n\u000b\f\r"
WORD_GAP = "[\\x20\\x09-\\x0D]+"
NOT_SYMBOL = "[^#*$%&|<>]+"


class Rule(NamedTuple):
    """``limit = centre + reach * (centre - other)``, both quantiles; ``margin`` is the least spread, against groups of equal texts."""

    measure: Callable[[], Column]
    end: str
    centre: float
    other: float
    reach: float
    margin: float
    count: str


def _share(count: str) -> Column:
    """Log of a count's share of the words; the ones added keep texts without any apart by how much they could have shown."""
    return F.log((F.col(count) + 1) / (F.col("n_words") + 1))


RULES = {
    "symbols": Rule(lambda: _share("n_symbols"), "high", 0.5, 0.25, 5.0, 0.25, "n_symbols"),
    "dup_lines": Rule(lambda: _share("n_dup_lines"), "high", 0.5, 0.25, 5.0, 0.25, "n_dup_lines"),
    "repeats": Rule(lambda: F.col("n_repeat_words") / F.col("n_words"), "high", 0.99, 0.5, 2.0, 0.05, "n_repeat_words"),
    "word_length": Rule(lambda: F.col("word_chars") / F.col("n_words"), "high", 0.5, 0.25, 14.0, 0.05, "n_words"),
    "short_words": Rule(lambda: F.col("word_chars") / F.col("n_words"), "low", 0.5, 0.75, 14.0, 0.05, "n_words"),
}


def split_words(text: Column) -> Column:
    """Maximal runs of characters other than the six white-space ones; none for null and empty texts."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), WORD_GAP), lambda w: w != "")


def _repeated_words(words: Column) -> Column:
    """Words inside 3-word windows that occur at least twice.

    Windows are hashed to 64 bits and sorted as plain longs; only texts in which two neighbours are equal go on to the
    exact positions, in a second sort of (hash, position).
    """
    n = F.size(words)
    hashes = lambda w: F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))

    def covered(h: Column) -> Column:
        placed = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
        hits = lambda s: F.filter(F.transform(s, lambda v, k: F.when((F.get(s, k - 1)["x"] == v["x"]) | (F.get(s, k + 1)["x"] == v["x"]), v["i"])), lambda p: p.isNotNull())
        wide = lambda p: F.size(F.array_distinct(F.concat(p, F.transform(p, lambda x: x + 1), F.transform(p, lambda x: x + 2))))
        return _let(placed, lambda s: _let(hits(s), wide))

    def count(h: Column) -> Column:
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(h))

    return F.when(n < 4, F.lit(0)).otherwise(_let(hashes(words), count))


def _let(value: Column, then) -> Column:
    """``then(value)`` with ``value`` computed once per row."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def text_statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with a struct ``stats``: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, all long."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.trim(x, F.lit(SPACE)) != "")
    stats = _let(
        split_words(text),
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.aggregate(w, F.lit(0).cast("long"), lambda a, x: a + F.length(x)).alias("word_chars"),
            F.length(F.regexp_replace(text, NOT_SYMBOL, "")).cast("long").alias("n_symbols"),
            _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
            _repeated_words(w).cast("long").alias("n_repeat_words"),
        ),
    )
    return docs.withColumn("stats", stats)


def _quantiles(sketches: DataFrame, k: int, *keys: str) -> DataFrame:
    """Per group of ``keys``: n, and by rule its (centre, other); nulls for the whole of an empty table."""
    merged = sketches.groupBy(*keys).agg(F.sum("n").alias("n"), *[F.kll_merge_agg_double(F.col(r), F.lit(k)).alias(r) for r in RULES])
    return merged.select(*keys, "n", *[F.when(F.col("n") > 0, F.kll_sketch_get_quantile_double(F.col(r), F.array(F.lit(rule.centre), F.lit(rule.other)))).alias(r) for r, rule in RULES.items()])


def _shrunk(own: Column, n: Column, parent: Column, weight: float) -> Column:
    """Quantiles of a group of ``n`` texts, drawn to the parent's as if that were ``weight`` more texts."""
    return F.coalesce(F.transform(own, lambda q, i: (q * n + F.get(parent, i) * weight) / (n + weight)), parent)


def _limit(rule: Rule, q: Column) -> tuple[Column, Column]:
    """(limit, spread), the spread signed towards the bad end."""
    gap = F.greatest(F.abs(F.get(q, F.lit(0)) - F.get(q, F.lit(1))), F.lit(rule.margin)) * (1 if rule.end == "high" else -1)
    return F.get(q, F.lit(0)) + rule.reach * gap, gap


def adaptive_limits(passed: DataFrame, weight: float = 100.0, k: int = 800) -> DataFrame:
    """(lang, source, one limit per rule) for each pair in ``passed``, which has lang, source and the rules' measures."""
    cells = passed.groupBy("lang", "source").agg(F.count("*").alias("n"), *[F.kll_sketch_agg_double(F.col(r), F.lit(k)).alias(r) for r in RULES])
    cells = materialize(cells, "quality-sketches")
    whole = _quantiles(cells, k).first()
    by_lang = _quantiles(cells, k, "lang").select(F.col("lang").alias("l"), *[_shrunk(F.col(r), F.col("n"), F.lit(whole[r] or [0.0, 0.0]), weight).alias(f"{r}_l") for r in RULES])
    own = _quantiles(cells, k, "lang", "source").join(by_lang, F.col("lang").eqNullSafe(F.col("l")))
    out = []
    for r, rule in RULES.items():
        limit, _ = _limit(rule, _shrunk(F.col(r), F.col("n"), F.col(f"{r}_l"), weight))
        theirs, gap = _limit(rule, F.col(f"{r}_l"))
        out.append((F.least if rule.end == "high" else F.greatest)(limit, theirs + gap).alias(r))
    return own.select("lang", "source", *out)


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", min_words: int = 50, max_repeat_percent: int = 50, weight: float = 100.0, k: int = 800) -> DataFrame:
    """One row per row of ``docs``: id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, reasons.

    ``base_failed``: fewer than ``min_words`` words, or ``100 * n_repeat_words > max_repeat_percent * n_words``. A text that passes is
    dropped by each rule whose measure lies past its group's limit; a text without any symbol, doubled line or repeat breaks no rule on those. ``weight``
    is how many texts the parent's quantiles count for in a group's, ``k`` the sketches' size. Null texts
    have no words and fail; null languages and sources are groups of their own; repeated rows are judged alike; an
    empty table gives no rows. Only the four named columns are read, so extra ones cannot clash.
    """
    own = docs.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(source_col).alias("source"), F.col(text_col).alias("text"))
    base = text_statistics(own).select("id", "lang", "source", "stats.*")
    base = base.withColumn("base_failed", (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words")))
    base = base.withColumns({r: F.when(F.col("n_words") > 0, rule.measure()).cast("double") for r, rule in RULES.items()})
    base = materialize(base, "quality-statistics")
    limits = adaptive_limits(base.where(~F.col("base_failed")), weight, k)
    limits = limits.select(F.col("lang").alias("l"), F.col("source").alias("s"), F.struct(*RULES).alias("limit"))
    judged = base.join(limits, F.col("lang").eqNullSafe(F.col("l")) & F.col("source").eqNullSafe(F.col("s")), "left")
    past = lambda r, rule: F.col(r) > F.col("limit")[r] if rule.end == "high" else F.col(r) < F.col("limit")[r]
    broken = F.filter(F.array(*[F.when(past(r, rule) & (F.col(rule.count) > 0), F.lit(r)) for r, rule in RULES.items()]), lambda x: x.isNotNull())
    return judged.select(F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & (F.size(broken) == 0)).alias("kept"), broken.alias("reasons"))
