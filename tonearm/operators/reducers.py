"""Commands as pure functions of tables: each takes rows and a table of commands and returns new rows, with an outcome per command.

Commands of one batch are applied in order of their number; where two touch one row, the first wins and the other is stale.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def approve(suggested: DataFrame, final: DataFrame, commands: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(suggested, final, outcomes) after approving ``commands`` (n, id).

    A proposal must be pending, its pair not rejected, and neither side linked; of several for one local or one track the first counts. The other
    pending proposals of an approved local track go.
    """
    asked = commands.groupBy("id").agg(F.min("n").alias("n")).join(suggested, "id", "left")
    rejected = suggested.where("status = 'rejected'").select("local_id", "track_id", F.lit(True).alias("was_rejected")).distinct()
    taken_l, taken_t = final.select("local_id", F.lit(True).alias("l")), final.select("track_id", F.lit(True).alias("t"))
    x = asked.join(rejected, ["local_id", "track_id"], "left").join(taken_l, "local_id", "left").join(taken_t, "track_id", "left")
    x = x.withColumn("reason", F.when(F.col("status").isNull(), "not_found").when(F.col("status") != "pending", "stale").when(F.col("was_rejected"), "rejected").when(F.col("l") | F.col("t"), "conflict"))
    good = x.where("reason IS NULL")
    first = good.withColumn("kl", F.row_number().over(W.partitionBy("local_id").orderBy("n"))).where("kl = 1").withColumn("kt", F.row_number().over(W.partitionBy("track_id").orderBy("n"))).where("kt = 1")
    done = first.select("id", "local_id", "track_id")
    outcomes = x.join(done.select("id", F.lit(True).alias("done")), "id", "left").select("id", F.when(F.col("done"), "approved").otherwise(F.coalesce("reason", F.lit("stale"))).alias("outcome"))
    kept = suggested.join(done.select("local_id", F.lit(True).alias("linked")), "local_id", "left").join(done.select("id", F.lit(True).alias("own")), "id", "left")
    kept = kept.where(F.col("own").isNotNull() | F.col("linked").isNull() | (F.col("status") != "pending"))
    after = kept.select(*[F.when(F.col("own"), "approved").otherwise(F.col("status")).alias("status") if c == "status" else F.col(c) for c in suggested.columns])
    links = final.unionByName(done.select(F.col("local_id").alias("id"), "local_id", "track_id"))
    return after, links, outcomes


def reject(suggested: DataFrame, commands: DataFrame) -> DataFrame:
    """Pending proposals named by ``commands`` (id) become rejected; others stay."""
    hit = suggested.join(commands.select("id", F.lit(True).alias("hit")).distinct(), "id", "left")
    return hit.select(*[F.when(F.col("hit") & (F.col("status") == "pending"), "rejected").otherwise(F.col("status")).alias("status") if c == "status" else F.col(c) for c in suggested.columns])


def unlink(final: DataFrame, suggested: DataFrame, commands: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Links named by ``commands`` (local_id) go; each leaves a rejected suggestion of score 0, method manual_break."""
    gone = final.join(commands.select("local_id").distinct(), "local_id", "left_semi")
    log = gone.select((-F.col("local_id")).alias("id"), "local_id", "track_id", F.lit(0.0).alias("score"), F.lit("rejected").alias("status"), F.lit("manual_break").alias("method"))
    return final.join(gone.select("local_id"), "local_id", "left_anti").select(*final.columns), suggested.unionByName(log.select(*suggested.columns))


def link(final: DataFrame, components: DataFrame, commands: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(final, outcomes) of new links (n, local_id, track_id): a local track has one link, and a component one local track."""
    held = final.join(components, "track_id", "left").select("component", F.col("local_id").alias("holder"))
    one = held.groupBy("component").agg(F.min("holder").alias("low"), F.max("holder").alias("high"))
    x = commands.join(components, "track_id").join(final.select("local_id", F.lit(True).alias("l")), "local_id", "left").join(final.select("track_id", F.lit(True).alias("t")), "track_id", "left").join(one, "component", "left")
    x = x.withColumn("reason", F.when(F.col("l"), "local_taken").when(F.col("t"), "track_taken").when((F.col("low") != F.col("local_id")) | (F.col("high") != F.col("local_id")), "component_taken"))
    first = x.where("reason IS NULL").withColumn("a", F.row_number().over(W.partitionBy("local_id").orderBy("n"))).where("a = 1").withColumn("b", F.row_number().over(W.partitionBy("component").orderBy("n"))).where("b = 1")
    done = first.select("n", "local_id", "track_id")
    outcomes = x.join(done.select("n", F.lit(True).alias("done")), "n", "left").select("n", F.when(F.col("done"), "created").otherwise(F.coalesce("reason", F.lit("stale"))).alias("outcome"))
    return final.unionByName(done.select(F.col("local_id").alias("id"), "local_id", "track_id")), outcomes


def accept_edges(edges: DataFrame, components: DataFrame, final: DataFrame, commands: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges, outcomes) of accepted pairs (a, b, type, winner): known pairs and pairs within a component are stale; an equivalence of
    components with different local tracks needs a winning local id among them."""
    from tonearm.operators.graph import merge_conflicts

    x = commands.select(F.least("a", "b").alias("lower_id"), F.greatest("a", "b").alias("higher_id"), "type", "winner").where("lower_id <> higher_id")
    comp = lambda end, name: components.select(F.col("track_id").alias(end), F.col("component").alias(name))
    x = x.join(comp("lower_id", "x"), "lower_id").join(comp("higher_id", "y"), "higher_id")
    x = x.join(edges.select("lower_id", "higher_id", F.lit(True).alias("known")), ["lower_id", "higher_id"], "left")
    clash = merge_conflicts(x.select("lower_id", "higher_id"), components, final).select("lower_id", "higher_id", "locals")
    x = x.join(clash, ["lower_id", "higher_id"], "left")
    among = F.coalesce(F.array_contains(F.split("locals", ","), F.col("winner").cast("string")), F.lit(False))
    outcome = F.when(F.col("known") | (F.col("x") == F.col("y")), "stale").when((F.col("type") == "equivalent") & F.col("locals").isNotNull() & ~among, "conflict").otherwise("accepted")
    x = x.withColumn("outcome", outcome)
    return edges.unionByName(x.where("outcome = 'accepted'").select("lower_id", "higher_id", "type")), x.select("lower_id", "higher_id", "outcome")


def claim(rows: DataFrame, limit: int, max_attempts: int = 3) -> DataFrame:
    """(id, attempt): up to ``limit`` rows by id that are missing, failed with attempts left, or of another version; the last start at one."""
    ready = F.col("status").isNull() | ((F.col("status") == "failed") & (F.col("attempts") < max_attempts)) | ~F.coalesce(F.col("current"), F.lit(True))
    fresh = F.col("status").isNull() | ~F.coalesce(F.col("current"), F.lit(True))
    return rows.where(ready).orderBy("id").limit(limit).select("id", F.when(fresh, F.lit(1).cast("long")).otherwise(F.col("attempts") + 1).alias("attempt"))


def with_default(profiles: DataFrame, wanted: int | None = None) -> DataFrame:
    """Exactly one default: ``wanted`` if stored, else the smallest marked id, else the smallest id."""
    best = profiles.agg(F.coalesce(F.min(F.when(F.col("id") == F.lit(wanted), F.col("id"))), F.min(F.when(F.col("is_default"), F.col("id"))), F.min("id")).alias("best"))
    return profiles.drop("is_default").join(F.broadcast(best), F.lit(True)).select(*[(F.col("id") == F.col("best")).alias("is_default") if c == "is_default" else F.col(c) for c in profiles.columns])


def merged_duplicates(rows: DataFrame, key: str, references: dict[str, tuple[DataFrame, str]]) -> tuple[DataFrame, dict[str, DataFrame]]:
    """Parents with one row per key, the smallest id, and reference tables with their column mapped to it. Null keys are no duplicates."""
    keep = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.min("id").alias("keeper"))
    mapping = rows.join(keep, key).where("id <> keeper").select("id", "keeper")
    kept = rows.join(mapping.select("id"), "id", "left_anti").select(*rows.columns)
    out = {}
    for name, (table, column) in references.items():
        moved = table.join(mapping.select(F.col("id").alias(column), "keeper"), column, "left")
        out[name] = moved.select(*[F.coalesce("keeper", column).alias(c) if c == column else F.col(c) for c in table.columns])
    return kept, out


def detached(table: DataFrame, column: str, gone: DataFrame) -> DataFrame:
    """``table`` with null in place of references to ``gone`` (id): history outlives what it names."""
    hit = table.join(gone.select(F.col("id").alias(column), F.lit(True).alias("gone")), column, "left")
    return hit.select(*[F.when(F.col("gone").isNull(), F.col(c)).alias(c) if c == column else F.col(c) for c in table.columns])


def written_features(rows: DataFrame, results: DataFrame) -> DataFrame:
    """Feature rows (id, status, attempts, payload, failure) after ``results`` (id, attempt, kind, payload, failure).

    ``pending`` clears the payload and takes the attempt; ``ready`` and ``failed`` count only for the pending attempt that they name, a failure keeps
    the payload. Ids without a row are added by ``pending``. Of several results for an id the last kind in that order wins.
    """
    rank = F.when(F.col("kind") == "pending", 0).when(F.col("kind") == "failed", 1).otherwise(2)
    last = results.groupBy("id").agg(F.max_by(F.struct("attempt", "kind", "payload", "failure"), F.struct("attempt", rank)).alias("r"))
    both = rows.join(last, "id", "full")
    live = (F.col("status") == "pending") & (F.col("attempts") == F.col("r.attempt"))
    kind = F.when(F.col("r.kind") == "pending", "pending").when(F.col("r").isNotNull() & live, F.col("r.kind"))
    x = both.withColumn("k", kind)
    return x.where("status IS NOT NULL OR k = 'pending'").select(
        "id",
        F.coalesce("k", "status").alias("status"),
        F.when(F.col("k") == "pending", F.col("r.attempt")).otherwise(F.col("attempts")).alias("attempts"),
        F.when(F.col("k") == "pending", None).when(F.col("k") == "ready", F.col("r.payload")).otherwise(F.col("payload")).alias("payload"),
        F.when(F.col("k") == "failed", F.col("r.failure")).when(F.col("k").isNotNull(), None).otherwise(F.col("failure")).alias("failure"),
    )


def resolved_duplicates(groups: DataFrame, choices: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(removed, decisions) of choices (group_key, keeper or null): a keeper must be a member; null dismisses the group."""
    x = choices.join(groups.select("group_key", F.transform(F.split("ids", ","), lambda v: v.cast("long")).alias("members")), "group_key")
    good = x.where(F.col("keeper").isNull() | F.array_contains("members", F.col("keeper")))
    removed = good.where("keeper IS NOT NULL").select("group_key", F.explode(F.array_remove("members", F.col("keeper"))).alias("id"))
    return removed, good.select("group_key", F.when(F.col("keeper").isNull(), "dismissed").otherwise("resolved").alias("action"), "keeper")


def without_references(tables: dict[str, tuple[DataFrame, str]], gone: DataFrame) -> dict[str, DataFrame]:
    """Each table without the rows whose column names a removed id: the cascade, in any order."""
    return {n: t.join(gone.select(F.col("id").alias(c)).distinct(), c, "left_anti").select(*t.columns) for n, (t, c) in tables.items()}


def changed_edges(edges: DataFrame, created: DataFrame, changed: DataFrame, deleted: DataFrame) -> DataFrame:
    """Edges (lower_id, higher_id, type) after a batch: types change, deleted ones go, and pairs that were not there are created."""
    pair = ["lower_id", "higher_id"]
    kept = edges.join(deleted.select(*pair).distinct(), pair, "left_anti").join(changed.select(*pair, F.col("type").alias("new")), pair, "left")
    return kept.select(*pair, F.coalesce("new", "type").alias("type")).unionByName(created.join(edges.select(*pair), pair, "left_anti").select(*pair, "type"))


def rematched(suggested: DataFrame, found: DataFrame) -> DataFrame:
    """Proposals (local_id, track_id, status) after a new match of the local tracks in ``found`` (local_id, track_id): their open ones give way, decided ones stay."""
    again = found.select("local_id", F.lit(True).alias("again")).distinct()
    kept = suggested.join(again, "local_id", "left").where(F.col("again").isNull() | F.col("status").isin("approved", "rejected"))
    return kept.select("local_id", "track_id", "status").unionByName(found.select("local_id", "track_id", F.lit("pending").alias("status")))


def staged_outcomes(rows: DataFrame, stages: list[tuple[str, Column, Column]], key: str = "id") -> DataFrame:
    """(key, place, stage, status) of each row and each of ``stages`` (name, whether it applies, whether it succeeds), in order.

    A stage succeeded, failed, or was not_applicable; after the first one that failed all others are skipped. A test that is null does not hold.
    """
    sure = lambda c: F.coalesce(c, F.lit(False))
    failed, cells = F.lit(False), []
    for place, (name, applies, succeeds) in enumerate(stages):
        status = F.when(failed, "skipped").when(~sure(applies), "not_applicable").when(sure(succeeds), "succeeded").otherwise("failed")
        cells.append(F.struct(F.lit(place).alias("place"), F.lit(name).alias("stage"), status.alias("status")))
        failed = failed | (sure(applies) & ~sure(succeeds))
    return rows.select(key, F.explode(F.array(*cells)).alias("s")).select(key, "s.*")


def staged_report(rows: DataFrame, stages: list[tuple[str, Column, Column]], key: str = "id") -> DataFrame:
    """(place, stage, status, n): how many rows each stage left in each status, in one pass."""
    return staged_outcomes(rows, stages, key).groupBy("place", "stage", "status").agg(F.count("*").alias("n"))
