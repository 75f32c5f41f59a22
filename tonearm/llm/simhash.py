"""SimHash near-duplicates by multi-index hashing.

Each text gets a 64-bit fingerprint. The fingerprint is cut into segments; if two fingerprints differ in at most ``radius``
bits, some segment differs in at most ``radius // segments`` of them (pigeonhole), so each fingerprint enumerates
that small Hamming ball within each segment, fetches the fingerprints that hold such a segment, and verifies the complete
distance. Of two segments that differ in mask ``m`` exactly one has the lowest bit of ``m`` clear, and only that one
probes, which halves the ball without losing a pair.

All of this runs on distinct fingerprints, so copies cost nothing. A segment value shared by more than ``hot`` distinct
fingerprints would make pairs in the square of its size; its members look up their whole Hamming ball instead, a constant
number of exact lookups each, so no link is lost and the work stays linear.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tonearm.llm.simhash_core import fingerprints
from tonearm.llm.worker import tidy
from tonearm.operators.components import connected_components
from tonearm.storage import materialize

HOT = 1024


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def masks(width: int, radius: int) -> list[int]:
    """All masks of at most ``radius`` of ``width`` bits, the empty one first."""
    return [sum(1 << i for i in c) for r in range(radius + 1) for c in combinations(range(width), r)]


def with_fingerprint(docs: DataFrame, id_col: str, text_col: str, width: int = 3) -> DataFrame:
    """Rows ``(id_col, fp)``; null and empty texts have fingerprint zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = fingerprints(batch.column(1).cast(pa.binary()).to_pylist(), width)
            yield pa.record_batch([batch.column(0), pa.array(found.view("int64"))], names=[id_col, "fp"])

    kind = docs.schema[id_col].dataType
    return docs.select(id_col, text_col).mapInArrow(tidy(run), T.StructType([T.StructField(id_col, kind), T.StructField("fp", T.LongType())]))


def _segment(value: Column, k: int, width: int) -> Column:
    return F.shiftrightunsigned(value, k * width).bitwiseAND(F.lit((1 << width) - 1))


def hamming_links(fps: DataFrame, radius: int = 2, segments: int = 2, hot: int = HOT) -> DataFrame:
    """Pairs ``(a, b)``, ``a < b`` signed, of the distinct fingerprints in column ``fp`` that differ in 1 to ``radius`` bits."""
    if 64 % segments:
        raise ValueError("segments must divide 64")
    width, near = 64 // segments, radius // segments
    ball = F.array(*[F.lit(m) for m in masks(width, near)])
    key = lambda k, v: F.struct(F.lit(k).cast("byte").alias("k"), v.alias("v"))

    def asked_in(k: int) -> Column:
        value = _segment(F.col("fp"), k, width)
        flips = F.filter(ball, lambda m: value.bitwiseAND(m).bitwiseAND(-m) == 0)
        return F.transform(flips, lambda m: key(k, value.bitwiseXOR(m)))

    probes = F.flatten(F.array(*[asked_in(k) for k in range(segments)]))
    tables = fps.select("fp", F.explode(F.array(*[key(k, _segment(F.col("fp"), k, width)) for k in range(segments)])).alias("key"))
    crowded = materialize(tables.groupBy("key").count().where(F.col("count") > hot).select("key"), "simhash-crowded")
    is_crowded = not crowded.isEmpty()
    held = tables.join(crowded, "key", "left_anti") if is_crowded else tables
    asked = fps.select(F.col("fp").alias("other"), F.explode(probes).alias("key"))
    close = lambda a, b: F.bit_count(a.bitwiseXOR(b)).between(1, radius)
    pairs = asked.join(held, "key").where(close(F.col("other"), F.col("fp"))).select(F.least("other", "fp").alias("a"), F.greatest("other", "fp").alias("b"))
    if is_crowded:
        whole = F.array(*[F.lit(signed(m)) for m in masks(64, radius)[1:]])
        members = tables.join(crowded, "key", "left_semi").select(F.col("fp").alias("other")).distinct()
        looked = members.select("other", F.explode(F.transform(whole, lambda m: F.col("other").bitwiseXOR(m))).alias("fp")).join(fps, "fp")
        pairs = pairs.union(looked.select(F.least("other", "fp").alias("a"), F.greatest("other", "fp").alias("b")))
    return pairs.distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 2, segments: int = 2, width: int = 3, hot: int = HOT) -> DataFrame:
    """One row per row of ``docs``: ``(id, fingerprint, component_id, n_links)``.

    ``fingerprint`` is 16 lower-case hex digits; ``component_id`` the smallest id that is reachable over links (rows with equal
    fingerprints are linked); ``n_links`` the number of different fingerprints linked to the row's own. Null
    and empty texts have fingerprint zero and are linked like any other; repeated rows come back repeated; a null id is
    never a component's name unless all its ids are null; an empty table gives no rows. Other columns of ``docs`` are not read.
    """
    rows = materialize(with_fingerprint(docs, id_col, text_col, width).withColumnRenamed(id_col, "id"), "simhash-rows")
    fps = materialize(rows.groupBy("fp").agg(F.min("id").alias("low")), "simhash-distinct")
    links = materialize(hamming_links(fps.select("fp"), radius, segments, hot), "simhash-links")
    parts = connected_components(links)
    named = parts.join(fps, parts.node == fps.fp).groupBy("component").agg(F.min("low").alias("least"))
    degree = links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("n"))
    linked = parts.join(named, "component").join(degree, "node").select(F.col("node").alias("fp"), "least", "n")
    classes = fps.join(linked, "fp", "left").select("fp", F.coalesce("least", "low").alias("component_id"), F.coalesce("n", F.lit(0)).cast("long").alias("n_links"))
    # Written first, so the last join is one plain shuffle join, which Spark can split where a fingerprint has very many rows.
    classes = materialize(classes, "simhash-classes")
    return rows.join(classes, "fp").select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "n_links")
