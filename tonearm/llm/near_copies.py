"""Near copies by their five-word shingles: SimHash fingerprints under multi-index hashing and MinHash bands propose pairs, exact Jaccard similarity decides.

Fingerprints of 64 bits that differ in at most RADIUS bits are found whole, through segments and Hamming balls, with their full distance checked. Bands add the pairs beyond: one of similarity 0.8 shares one of the 24 bands of five minima with a chance above 0.9999 (a SimHash radius that holds such pairs, 11 of 64 bits,
would make every segment value common and the candidates quadratic). Texts of equal shingle sets are one node. Each bucket first
meets its most central node only, the one whose buckets are the fullest, so a group around a common original costs linear work. What this leaves apart in a bucket
is compared in cells: blocks of the nodes outside the bucket's largest component against blocks of all its nodes, each pair of blocks within a task, which returns no more
links than join components. So the components are those of all candidate pairs, and no list of pairs is ever made.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tonearm.llm.simhash import hamming_links
from tonearm.llm.simhash_core import shingles
from tonearm.llm.worker import tidy
from tonearm.operators.components import connected_components
from tonearm.storage import fresh_path, materialize, remove

WIDTH, BANDS, ROWS = 5, 24, 5
#: Bits that fingerprints may differ in, and segments that they are looked up by.
RADIUS, SEGMENTS = 3, 2
#: Nodes of a block, and shingles that a task compares at a time.
BLOCK, COLUMNS = 256, 8192
_rng = np.random.default_rng(42)
_FACTORS = _rng.integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFTS = _rng.integers(0, 1 << 63, BANDS * ROWS, np.uint64)
_PLACES = np.arange(BANDS, dtype=np.uint64)[:, None]


def shingle_set(text: bytes | None, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct hashes of the text's windows; none for null and empty texts."""
    words = text.lower().split() if text else []
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(s) for s in shingles(words, width)), np.uint64))


def bands(hashes: np.ndarray) -> np.ndarray:
    """One signed key for each band; no shingles give no keys."""
    if not len(hashes):
        return np.empty(0, np.int64)
    least = np.array([(hashes * a + b).min() for a, b in zip(_FACTORS, _SHIFTS)])
    rows = np.concatenate([_PLACES, least.reshape(BANDS, ROWS)], axis=1)
    return np.array([xxhash.xxh64_intdigest(r.tobytes()) for r in rows], np.uint64).view(np.int64)


def fingerprint(hashes: np.ndarray) -> int:
    """The signed SimHash of a shingle set: a bit is one if it is one in over half the hashes; no shingles give zero."""
    sums = np.zeros(64, np.int64)
    for start in range(0, len(hashes), COLUMNS):
        sums += np.unpackbits(hashes[start : start + COLUMNS].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * sums > len(hashes), bitorder="little").view(np.int64)[0])


def _with_bands(docs: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """(id, sig, n, fp, bands): ``sig`` stands for the whole shingle set, ``n`` is its size, ``fp`` its fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sig, n, fp, keys = [], [], [], []
            for cell in batch.column(1).cast(pa.binary()):
                found = shingle_set(cell.as_py(), width)
                sig.append(xxhash.xxh64_intdigest(found.tobytes()))
                n.append(len(found))
                fp.append(fingerprint(found))
                keys.append(bands(found))
            yield pa.record_batch([batch.column(0), pa.array(np.array(sig, np.uint64).view(np.int64)), pa.array(n, pa.int32()), pa.array(fp, pa.int64()), pa.array(keys, pa.list_(pa.int64()))], names=["id", "sig", "n", "fp", "bands"])

    kind = T.StructType([T.StructField("id", docs.schema[id_col].dataType), *T.StructType.fromDDL("sig long, n int, fp long, bands array<long>").fields])
    return docs.select(id_col, text_col).mapInArrow(tidy(run), kind)


def near_fingerprints(nodes: DataFrame) -> DataFrame:
    """(a, b), ``a < b``: ``nodes`` (sig, n, fp) whose fingerprints differ in at most RADIUS bits, by the smallest sig of each fingerprint; those of one fingerprint meet that one. Nodes without shingles are left out."""
    held = nodes.where("n > 0").select("sig", "fp")
    first = materialize(held.groupBy("fp").agg(F.min("sig").alias("one")), "copies-fingerprints")
    same = held.join(first, "fp").select("one", F.col("sig").alias("other"))
    found = materialize(hamming_links(first.select("fp"), RADIUS, SEGMENTS), "copies-near")
    near = found.join(first.select(F.col("fp").alias("a"), "one"), "a").join(first.select(F.col("fp").alias("b"), F.col("one").alias("other")), "b").select("one", "other")
    return same.union(near).where("one <> other").select(F.least("one", "other").alias("a"), F.greatest("one", "other").alias("b"))


def _sets(texts: DataFrame, width: int) -> DataFrame:
    """(sig, held) from (sig, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = [shingle_set(cell.as_py(), width).view(np.int64) for cell in batch.column(1).cast(pa.binary())]
            yield pa.record_batch([batch.column(0), pa.array(held, pa.list_(pa.int64()))], names=["sig", "held"])

    return texts.select("sig", "text").mapInArrow(tidy(run), "sig long, held array<long>")


def _verified(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Those of ``pairs`` (a, b) whose exact similarity is at least ``least``."""
    one, other = (sets.select(F.col("sig").alias(c), F.col("held").alias(f"h{c}")) for c in "ab")
    both = pairs.join(one, "a").join(other, "b").select("a", "b", F.size(F.array_intersect("ha", "hb")).alias("i"), (F.size("ha") + F.size("hb")).alias("n"))
    return both.where(F.col("i") >= least * (F.col("n") - F.col("i"))).select("a", "b")


class _Joined:
    """Components by union of roots."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        while (y := self.up.get(x, x)) != x:
            self.up[x] = x = self.up.get(y, y)
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.root(x), self.root(y)
        self.up[y] = x
        return x != y


def _shared(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """How many shingles each set of ``a`` shares with each of ``b``: products of membership matrices, some columns at a time."""
    entries = []
    for sets in (a, b):
        values = np.concatenate(sets)
        entries.append((values, np.repeat(np.arange(len(sets)), [len(x) for x in sets])))
    common = np.intersect1d(entries[0][0], entries[1][0])
    out = np.zeros((len(a), len(b)))
    placed = []
    for values, row in entries:
        column = np.searchsorted(common, values)
        known = column < len(common)
        known[known] = common[column[known]] == values[known]
        order = np.argsort(column[known], kind="stable")
        placed.append((column[known][order], row[known][order]))
    for start in range(0, len(common), COLUMNS):
        parts = []
        for (column, row), n in zip(placed, (len(a), len(b))):
            x, y = np.searchsorted(column, [start, start + COLUMNS])
            held = np.zeros((n, min(COLUMNS, len(common) - start)), np.float32)
            held[row[x:y], column[x:y] - start] = 1
            parts.append(held)
        out += parts[0] @ parts[1].T
    return out


def cell_links(rows: list[tuple[int, int, int, np.ndarray]], i: int, j: int, least: float) -> list[tuple[int, int]]:
    """Links (sig, sig) of similarity ``least`` between blocks ``i`` and ``j`` of a cell, as many as join components: rows are (block, sig, component, sorted set)."""
    a = [r for r in rows if r[0] == i]
    b = a if i == j else [r for r in rows if r[0] == j]
    if not a or not b:
        return []
    n_a, n_b = (np.array([len(r[3]) for r in x], float) for x in (a, b))
    apart = np.array([r[2] for r in a])[:, None] != np.array([r[2] for r in b])[None, :]
    apart &= np.minimum(n_a[:, None], n_b[None, :]) >= least * np.maximum(n_a[:, None], n_b[None, :])
    if i == j:
        apart = np.triu(apart)
    asked = np.argwhere(apart)
    joined, out = _Joined(), []
    if len(asked) > 64:
        both = _shared([r[3] for r in a], [r[3] for r in b])
        asked = np.argwhere(apart & (both >= least * (n_a[:, None] + n_b[None, :] - both)))
    else:
        both = None
    for x, y in asked.tolist():
        one, other = a[x], b[y]
        if joined.root(one[2]) == joined.root(other[2]):
            continue
        if both is None:
            n = len(np.intersect1d(one[3], other[3], assume_unique=True))
            if n < least * (len(one[3]) + len(other[3]) - n):
                continue
        joined.join(one[2], other[2])
        out.append((one[1], other[1]))
    return out


def _in_cells(member: DataFrame, least: float) -> DataFrame:
    """(a, b) links of ``member``, which has key, block, i, j, sig, part, held: the rows of blocks i and j of a bucket, cell by cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, rows = None, []

        def found() -> pa.RecordBatch:
            links = cell_links(rows, cell[1], cell[2], least) if cell else []
            return pa.record_batch([pa.array([min(x) for x in links], pa.int64()), pa.array([max(x) for x in links], pa.int64())], names=["a", "b"])

        for batch in batches:
            sets = batch.column(6)
            ends, values = sets.offsets.to_numpy(), sets.values.to_numpy()
            for k, (key, i, j, block, sig, part) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(6)))):
                if cell != (key, i, j):
                    if cell:
                        yield found()
                    cell, rows = (key, i, j), []
                rows.append((block, sig, part, values[ends[k] : ends[k + 1]].copy()))
        yield found()

    cells = member.select("key", "i", "j", "block", "sig", "part", "held").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    return cells.mapInArrow(tidy(run), "a long, b long").distinct()


def groups(docs: DataFrame, id_col: str, text_col: str, width: int = WIDTH, least: float = 0.8, block: int = BLOCK) -> DataFrame:
    """Rows ``(id, component_id)``, one per row of ``docs``: the smallest id that is reachable over pairs of similarity ``least`` or more. Ids differ and are not null. ``block`` changes no result."""
    rows = materialize(_with_bands(docs, id_col, text_col, width), "copies-rows")
    # All but the rows and the classes goes as soon as those are written.
    spark = docs.sparkSession
    own_folder = fresh_path(spark, "copies")
    kept = lambda df, name: materialize(df, name, own_folder)
    nodes = kept(rows.groupBy("sig").agg(F.min("id").alias("low"), F.first("n").alias("n"), F.first("fp").alias("fp"), F.first("bands").alias("bands")), "nodes")
    places = nodes.select("sig", "n", F.explode("bands").alias("key"))
    sizes = places.groupBy("key").agg(F.count("*").alias("m")).where("m > 1")
    placed = kept(places.join(sizes, "key"), "places")
    weights = placed.groupBy("sig").agg(F.sum("m").alias("weight"))
    pivots = placed.join(weights, "sig").groupBy("key").agg(F.max_by(F.struct("sig", "n"), F.struct("weight", "sig")).alias("pivot"))
    # Sets whose sizes alone keep them under the similarity need no look.
    fits = lambda x, y: F.least(x, y) >= least * F.greatest(x, y)
    stars = placed.join(pivots, "key").where((F.col("sig") != F.col("pivot.sig")) & fits(F.col("n"), F.col("pivot.n"))).select(F.col("pivot.sig").alias("a"), F.col("sig").alias("b"))
    size = lambda c: nodes.select(F.col("sig").alias(c), F.col("n").alias(f"n{c}"))
    alike = near_fingerprints(nodes).join(size("a"), "a").join(size("b"), "b").where(fits(F.col("na"), F.col("nb"))).select("a", "b")
    stars = kept(stars.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).union(alike).distinct(), "stars")
    needed = placed.select("sig").union(stars.select("a")).union(stars.select("b")).distinct().join(nodes.select("sig", F.col("low").alias("own")), "sig")
    texts = docs.select(F.col(id_col).alias("own"), F.col(text_col).alias("text"))
    sets = kept(_sets(needed.join(texts, "own"), width), "sets")
    links = kept(_verified(stars, sets, least), "links")
    parts = connected_components(links)
    member = kept(placed.select("key", "sig").join(parts.withColumnRenamed("node", "sig"), "sig", "left").select("key", "sig", F.coalesce("component", "sig").alias("part")), "members")
    # Buckets of one component need no second look, and of buckets with the same nodes one stands for all.
    inside = member.groupBy("key", "part").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("sig")).alias("x"))
    several = inside.groupBy("key").agg(F.sum("n").alias("m"), F.max("n").alias("most"), F.count("*").alias("k"), F.max_by("part", F.struct("n", "part")).alias("main"), F.bit_xor("x").alias("x")).where("k > 1")
    once = several.groupBy("m", "x").agg(F.min(F.struct("key", "main", "most")).alias("one")).select("one.*", "m")
    blocks = lambda n: F.ceil(n / F.lit(block)).cast("int")
    once = once.select("key", "main", blocks(F.col("m") - F.col("most")).alias("outside"), blocks(F.col("most")).alias("within"))
    apart = F.col("part") != F.col("main")
    own = F.when(apart, F.pmod(F.xxhash64("sig"), F.col("outside"))).otherwise(F.col("outside") + F.pmod(F.xxhash64("sig"), F.col("within"))).cast("int")
    others = F.sequence(F.lit(0), F.when(apart, F.col("outside") + F.col("within")).otherwise(F.col("outside")) - 1)
    dealt = member.join(once, "key").join(sets, "sig").select("key", "sig", "part", "held", own.alias("block"), F.explode(others).alias("other"))
    dealt = dealt.select("*", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    more = kept(_in_cells(dealt, least), "more")
    parts = connected_components(links.union(more))
    named = parts.join(nodes, parts.node == nodes.sig).groupBy("component").agg(F.min("low").alias("least"))
    linked = parts.join(named, "component").select(F.col("node").alias("sig"), "least")
    classes = materialize(nodes.join(linked, "sig", "left").select("sig", F.coalesce("least", "low").alias("component_id")), "copies-classes")
    remove(spark, own_folder)
    return rows.join(classes, "sig").select(F.col("id").alias(id_col), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, least: float = 0.8, place: Column | None = None) -> DataFrame:
    """``docs`` with one row of each group of texts that share ``least`` of their ``width``-word shingles: that with the smallest id (null ids last, rows with one id by place).

    ``place`` is a column that tells the rows of ``docs`` apart and is the same whenever they are read, as a file's name and row are; without it the rows are numbered and
    written once more. Empty and null texts are one group; repeated rows are one group; an empty table gives no rows; the columns stay as they are.
    """
    columns = [F.col(c).alias(f"c{i}") for i, c in enumerate(docs.columns)]
    rows = docs.select(*columns, place.alias("rid")) if place is not None else materialize(docs.select(*columns, F.monotonically_increasing_id().alias("rid")), "copies-docs")
    at, text = f"c{docs.columns.index(id_col)}", f"c{docs.columns.index(text_col)}"
    keyed = rows.select(F.struct(F.col(at).isNull().alias("none"), F.col(at).alias("id"), "rid").alias("key"), F.col(text).alias("text"))
    found = groups(keyed, "key", "text", width, least)
    gone = found.where(F.col("key") != F.col("component_id")).select(F.col("key.rid").alias("rid"))
    return rows.join(gone, "rid", "left_anti").select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)])
