"""Information-theoretic sanitisation of personal data.

Protected entities are found by pattern: the base kinds, and secrets (long random runs). Corpus co-occurrence then estimates how strongly a word reveals an entity that
shares a text with it: with N texts, n_c holding entity c, n_t holding term t and n_ct holding both,

    PMI(c, t) = log2(N n_ct / ((n_c + a) (n_t + a))),   IC(c) = log2(N / n_c).

``a`` makes little evidence weak: a word seen once, in the one text of an entity, reveals it only in a corpus large enough
for that to be no accident. A term whose PMI is at least ``threshold`` of the entity's information content discloses it, and is
sanitised wherever it stands in a text that holds the entity. Counts cover every text and all of it. Terms are known by 64-bit hashes.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tonearm.llm.pii_core import KINDS, ORDER, TERM, base_spans, entity, generalised, joined, places, secrets, signed_hash, terms_of
from tonearm.llm.worker import tidy
from tonearm.storage import materialize

FOUND = "n_email long, n_ip long, n_card long, n_phone long, base string, base_sha256 string, own string, entities array<long>, terms array<long>, places array<array<int>>"
#: Different terms that a task counts before it hands them on.
HELD_TERMS = 500_000


def detect(docs: DataFrame, text_col: str, keep: list[str]) -> DataFrame:
    """The columns ``keep`` of ``docs`` (none may be named like those of FOUND) with base spans, all own spans, entities, and the terms of texts with entities and their places."""
    columns = docs.columns
    at, kept = columns.index(text_col), [columns.index(c) for c in keep]
    added = T.StructType.fromDDL(FOUND)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, base, sha, own, who, terms, where = {k: [] for k in KINDS}, [], [], [], [], [], []
            for cell in batch.column(at):
                text = cell.as_py() or ""
                spans = base_spans(text)
                for k in KINDS:
                    counts[k].append(sum(s[0] == k for s in spans))
                base.append(joined(spans))
                sha.append(hashlib.sha256(base[-1].encode()).hexdigest())
                spans = sorted([*spans, *secrets(text, spans)], key=lambda s: (s[1], ORDER[s[0]], s[2]))
                own.append(joined(spans))
                who.append(sorted({entity(k, text[a:b]) for k, a, b in spans}))
                held = places(text, spans) if spans else {}
                terms.append([signed_hash(w) for w in held])
                where.append(list(held.values()))
            yield pa.record_batch([*(batch.columns[i] for i in kept), *[pa.array(counts[k], pa.int64()) for k in KINDS], pa.array(base, pa.string()), pa.array(sha, pa.string()), pa.array(own, pa.string()), pa.array(who, pa.list_(pa.int64())), pa.array(terms, pa.list_(pa.int64())), pa.array(where, pa.list_(pa.list_(pa.int32())))], names=[*(batch.schema.names[i] for i in kept), *added.names])

    return docs.mapInArrow(tidy(run), T.StructType([*(docs.schema[c] for c in keep), *added.fields]))


def term_counts(docs: DataFrame, text_col: str) -> DataFrame:
    """(term, n_t): how many rows of ``docs`` hold each term; counted within tasks before the shuffle."""

    def counted(n: Counter) -> pa.RecordBatch:
        return pa.record_batch([pa.array(np.fromiter(map(signed_hash, n), np.int64, len(n))), pa.array(np.fromiter(n.values(), np.int64, len(n)))], names=["term", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: Counter = Counter()
        for batch in batches:
            for cell in batch.column(0):
                n.update(terms_of(cell.as_py() or ""))
                if len(n) > HELD_TERMS:
                    yield counted(n)
                    n.clear()
        yield counted(n)

    return docs.select(text_col).mapInArrow(tidy(run), "term long, n long").groupBy("term").agg(F.sum("n").alias("n_t"))


def _holders(holding: DataFrame) -> DataFrame:
    """(rid, same, n_c): for each text the different sets of texts that its entities are in, and their sizes.

    Entities with the same set are equally disclosed by any term, so a list of addresses, or copies of it, count once. A set is known by its size and two sums of hashes.
    """
    each = holding.select("rid", F.explode("entities").alias("entity"))
    sets = each.groupBy("entity").agg(F.count("*").alias("n_c"), F.bit_xor(F.xxhash64("rid", F.lit(1))).alias("x"), F.bit_xor(F.xxhash64("rid", F.lit(2))).alias("y"))
    return each.join(sets, "entity").select("rid", F.struct("x", "y", "n_c").alias("same"), "n_c").distinct()


def with_spans(rows: DataFrame, docs: DataFrame, text_col: str, threshold: float, added: float) -> DataFrame:
    """``rows`` (written, from :func:`detect`, with a row number ``rid``) with ``spans``, an array of (start, ord, stop, kind) by start, then kind.

    As n_ct is at most n_c and n_t, a term can disclose an entity of n_c texts only if n_t is small enough; other pairs are never made.
    """
    own = F.transform(F.filter(F.split("own", ","), lambda s: s != ""), _parsed)
    total = float(rows.count())
    holding = rows.where(F.size("entities") > 0)
    if total < 1 or holding.isEmpty():
        return rows.withColumn("spans", own)
    # Terms travel by their number in their text; their places stay with it.
    known = materialize(holding.select("rid", F.posexplode("terms").alias("at", "term")).join(term_counts(docs, text_col), "term").select("rid", "at", "term", "n_t"), "pii-terms")
    tells = lambda n_ct: (F.lit(total) > F.col("n_c")) & (F.log2(F.lit(total) * n_ct / ((F.col("n_c") + added) * (F.col("n_t") + added))) >= threshold * F.log2(F.lit(total) / F.col("n_c")))
    holders = materialize(_holders(holding), "pii-holders")
    by_one = known.join(holders.where("n_c = 1"), "rid").where(tells(F.lit(1))).select("rid", "at")
    near = materialize(known.join(holders.where("n_c > 1"), "rid").where(tells(F.least("n_c", "n_t"))), "pii-pairs")
    telling = near.groupBy("same", "term", "n_c", "n_t").agg(F.count("*").alias("n_ct")).where(tells(F.col("n_ct"))).select("same", "term")
    by_more = near.join(telling, ["same", "term"], "left_semi").select("rid", "at")
    found = by_one.union(by_more).groupBy("rid").agg(F.collect_set("at").alias("telling"))
    pairs = lambda p: F.transform(F.sequence(F.lit(0), F.size(p) - 1, F.lit(2)), lambda i: F.struct(F.get(p, i).alias("start"), F.lit(ORDER[TERM]).alias("ord"), F.get(p, i + 1).alias("stop"), F.lit(TERM).alias("kind")))
    extra = F.flatten(F.transform(F.coalesce("telling", F.array().cast("array<int>")), lambda i: pairs(F.get("places", i))))
    return rows.join(found, "rid", "left").withColumn("spans", F.array_sort(F.concat(own, extra))).drop("telling")


def _parsed(s: Column) -> Column:
    part = F.split(s, ":")
    kinds = F.array(*[F.lit(k) for k in ORDER])
    return F.struct(F.get(part, F.lit(1)).cast("int").alias("start"), (F.array_position(kinds, F.get(part, F.lit(0))).cast("int") - 1).alias("ord"), F.get(part, F.lit(2)).cast("int").alias("stop"), F.get(part, F.lit(0)).alias("kind"))


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8, added: float = 0.75) -> DataFrame:
    """One row per row of ``docs``: id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_spans.

    ``spans`` joins all spans, base and added (secret, term), as kind:start:end by start, then kind; ``n_spans`` is how many. Null texts are empty and have none; null ids come back null;
    repeated rows are rows of their own and count as such; an empty table gives no rows; other columns are not read.
    """
    own = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"))
    rows = materialize(detect(own, "__text", ["__id"]).withColumn("rid", F.monotonically_increasing_id()), "pii-rows")
    found = with_spans(rows, own, "__text", threshold, added)
    text = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")
    return found.select(F.col("__id").alias(id_col), "n_email", "n_ip", "n_card", "n_phone", "base_sha256", text.alias("spans"), F.size("spans").cast("long").alias("n_spans"))


def sanitise(docs: DataFrame, text_col: str = "text", threshold: float = 0.8, added: float = 0.75, place: Column | None = None) -> DataFrame:
    """``docs`` with personal data generalised to its kind in brackets; texts without spans, nulls among them, stay as they are.

    ``place`` is a column that tells the rows of ``docs`` apart and is the same whenever they are read, as a file's name and row are; without it the rows are numbered and written
    once more. Only ids and places of spans are written beside that. Repeated rows come back repeated; an empty table gives no rows.
    """
    plain = [F.col(c).alias(f"__{i}") for i, c in enumerate(docs.columns)]
    rows = docs.select(*plain, place.alias("rid")) if place is not None else materialize(docs.select(*plain, F.monotonically_increasing_id().alias("rid")), "pii-docs")
    at = docs.columns.index(text_col)
    marked = materialize(detect(rows.select("rid", f"__{at}"), f"__{at}", ["rid"]).select("rid", "own", "entities", "terms", "places"), "pii-rows")
    mark = F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["stop"].alias("stop"), s["kind"].alias("kind")))
    spans = with_spans(marked, rows, f"__{at}", threshold, added).select("rid", mark.alias("spans")).where(F.size("spans") > 0)
    found = rows.join(materialize(spans, "pii-spans"), "rid", "left").drop("rid")
    kind = T.StructType(found.schema.fields[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, marks = batch.column(at).to_pylist(), batch.column(batch.num_columns - 1)
            for i in np.flatnonzero(marks.is_valid().to_numpy(zero_copy_only=False)).tolist():
                texts[i] = generalised(texts[i], [(m["start"], m["stop"], m["kind"]) for m in marks[i].as_py()])
            columns = batch.columns[:-1]
            columns[at] = pa.array(texts, batch.schema.field(at).type)
            yield pa.record_batch(columns, names=batch.schema.names[:-1])

    clean = found.mapInArrow(tidy(run), kind)
    return clean.select(*[F.col(f"__{i}").alias(c) for i, c in enumerate(docs.columns)])
