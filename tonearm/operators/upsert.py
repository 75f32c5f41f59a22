"""Snapshot writes: each takes stored and incoming rows and returns the new snapshot, which overwrites the old in one step."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def merge(stored: DataFrame, incoming: DataFrame, keys: Sequence[str], rules: dict[str, str] | None = None, guard: Column | None = None) -> DataFrame:
    """Full outer join on ``keys``; per column ``new`` (default: incoming wins), ``old`` (stored wins), ``coalesce`` (incoming unless null).

    ``guard`` is a condition on stored rows (columns named ``old.x`` there): rows that fail it keep all stored values. Incoming keys must be unique.
    """
    rules = rules or {}
    a = stored.select(F.struct(*stored.columns).alias("old"), *[F.col(k).alias(k) for k in keys])
    b = incoming.select(F.struct(*incoming.columns).alias("new"), *[F.col(k).alias(k) for k in keys])
    both = a.join(b, list(keys), "full")
    touched = F.col("new").isNotNull() & (F.coalesce(guard, F.lit(False)) | F.col("old").isNull() if guard is not None else F.lit(True))
    out = []
    for c in stored.columns:
        if c in keys:
            out.append(F.col(c))
            continue
        old, new = F.col(f"old.{c}"), F.col(f"new.{c}") if c in incoming.columns else F.lit(None)
        rule = rules.get(c, "new" if c in incoming.columns else "old")
        value = {"new": new, "old": F.coalesce(old, new), "coalesce": F.coalesce(new, old)}[rule]
        out.append(F.when(F.col("old").isNull(), new).when(touched, value).otherwise(old).alias(c))
    return both.select(*out)


def reconcile(stored: DataFrame, listing: DataFrame, keys: Sequence[str], scope: Column, **how) -> DataFrame:
    """Upsert a complete listing, then drop the stored rows in ``scope`` that it lacks."""
    gone = stored.where(scope).join(listing.select(*keys), list(keys), "left_anti").select(*keys)
    return merge(stored, listing, keys, **how).join(gone, list(keys), "left_anti")


def replace_groups(stored: DataFrame, incoming: DataFrame, parent: str) -> DataFrame:
    """All rows of the incoming parents are replaced; others stay."""
    return stored.join(incoming.select(parent).distinct(), parent, "left_anti").select(*stored.columns).unionByName(incoming.select(*stored.columns))


def drift(mirror: DataFrame, source: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Key and action: stale, inserted, updated or same."""
    values = [c for c in mirror.columns if c not in keys]
    a = mirror.select(*keys, F.struct(*values).alias("a"))
    b = source.select(*keys, F.struct(*values).alias("b"))
    action = F.when(F.col("b").isNull(), "stale").when(F.col("a").isNull(), "inserted").when(F.col("a").eqNullSafe(F.col("b")), "same").otherwise("updated")
    return a.join(b, list(keys), "full").select(*keys, action.alias("action"))


def compare_and_set(stored: DataFrame, condition: Column, values: dict[str, Column]) -> DataFrame:
    """Rows that meet ``condition`` take ``values``; a column ``matched`` tells which did."""
    hit = F.coalesce(condition, F.lit(False))
    return stored.select(*[F.when(hit, values[c]).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in stored.columns], hit.alias("matched"))


def counted_failures(events: DataFrame) -> DataFrame:
    """Per key of (key, id, ts, reason): attempts, first and last time, last reason; ties by id."""
    last = F.struct("ts", "id")
    return events.groupBy("key").agg(F.count("*").alias("attempts"), F.min("ts").alias("first_at"), F.max("ts").alias("last_at"), F.max_by("reason", last).alias("reason"))


def versioned(stored: DataFrame, commands: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
    """(rows, outcomes) of commands (id, version, value) on rows with id and version: a row changes only if the command knows its version, which then goes up by one.

    This stands in for row locks: of two writers that read one version the second is told ``conflict``. One command per id.
    """
    x = stored.join(commands.select("id", F.col("version").alias("known"), "value"), "id", "left")
    hit = F.col("known") == F.col("version")
    changed = {column: F.when(hit, F.col("value")).otherwise(F.col(column)), "version": F.when(hit, F.col("version") + 1).otherwise(F.col("version"))}
    rows = x.select(*[changed[c].alias(c) if c in changed else F.col(c) for c in stored.columns])
    outcomes = commands.select("id", "version").join(stored.select("id", F.col("version").alias("now")), "id", "left")
    return rows, outcomes.select("id", F.when(F.col("now").isNull(), "not_found").when(F.col("now") == F.col("version"), "done").otherwise("conflict").alias("outcome"))


def migrated(stored: DataFrame, fields: dict[str, str], renamed: dict[str, str] | None = None) -> DataFrame:
    """``stored`` under a new schema of name -> type: renamed columns keep their values, new ones are null, others go; values that do not fit are null."""
    source = {new: old for old, new in (renamed or {}).items()}
    have = set(stored.columns)
    return stored.select(*[(F.col(source.get(n, n)).try_cast(kind) if source.get(n, n) in have else F.lit(None).cast(kind)).alias(n) for n, kind in fields.items()])
