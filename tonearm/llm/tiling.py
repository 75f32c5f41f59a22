"""Benchmark decontamination by greedy string tiling.

Texts are words, bare of ASCII punctuation and case. Every window of ``seed`` words of a benchmark item is a seed; a text that shares one is compared with the item: running
Karp-Rabin hashes find all common windows, matches are grown as far as they go, the longest ones not yet covered are
marked first, and so on until none of ``seed`` words is left. The share of the item's words under marks is its coverage, whatever the
order of the passages, so reordered copies are caught.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tonearm.llm.worker import tidy
from tonearm.storage import materialize

#: ASCII letters, digits and all non-ASCII bytes stay, in lower case; other bytes part words.
BARE = bytes(b if b > 127 else ord(chr(b).lower()) if chr(b).isalnum() else 32 for b in range(256))
#: Up to so many bytes of benchmark text are sent to every task; a larger benchmark is joined through a shuffle of seeds.
MAX_BROADCAST_BYTES = 4 << 20
#: Multiplier of the rolling hash, modulo 2**64.
ROLL = 0x9E3779B97F4A7C15
#: What is said of a pair of text and item.
PAIR = "item_words int, matched int, tiles int, coverage double"


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(BARE).split() if text else []


def rolling(ids: np.ndarray, width: int) -> np.ndarray:
    """Hash of each window of ``width`` numbers."""
    n = len(ids) - width + 1
    if n < 1:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(width):
            out = out * np.uint64(ROLL) + ids[k : k + n].astype(np.uint64) + np.uint64(1)
    return out


def _common(text: np.ndarray, item: np.ndarray, t: int, p: int) -> int:
    """How many words agree from ``t`` and ``p`` on."""
    n, step = 0, 32
    while True:
        a, b = text[t + n : t + n + step], item[p + n : p + n + step]
        k = min(len(a), len(b))
        differ = a[:k] != b[:k]
        if differ.any():
            return n + int(differ.argmax())
        n += k
        if k < step:
            return n
        step *= 2


def matches(text: np.ndarray, item: np.ndarray, width: int) -> Iterator[tuple[int, int, int]]:
    """(place in text, place in item, words) of the common runs of at least ``width`` words that go on neither way.

    A run is met at its start alone: windows of the item are kept by the word before them, and a window of the text meets those with another one. So repeated
    words cost their runs and not their pairs of windows.
    """
    starts: dict[int, dict[int, list[int]]] = defaultdict(lambda: defaultdict(list))
    for p, h in enumerate(rolling(item, width).tolist()):
        starts[h][int(item[p - 1]) if p else -2].append(p)
    hashes = rolling(text, width)
    for t in np.flatnonzero(np.isin(hashes, np.fromiter(starts, np.uint64, len(starts)))).tolist():
        before = int(text[t - 1]) if t else -3
        for word, places in starts[int(hashes[t])].items():
            if word != before:
                for p in places:
                    n = _common(text, item, t, p)
                    if n >= width:
                        yield t, p, n


def tile(text: np.ndarray, item: np.ndarray, seed: int) -> list[tuple[int, int, int]]:
    """(place in text, place in item, words) of greedy tiles: longest first, ties by place; every word of either is in one tile at most.

    Runs wait by length; one that marks have cut since is put back as its free parts, so each is looked at when its turn comes. Tiles hold no more words than
    the item, so they can bar only so many places of the text: of runs alike in the item that many first ones are all that can ever be chosen.
    """
    width = min(seed, len(item))
    if not width:
        return []
    most = 1 + len(item) + len(item) * (len(item) // width)
    alike: dict[tuple[int, int], int] = defaultdict(int)
    waiting = []
    for t, p, n in matches(text, item, width):
        alike[p, n] += 1
        if alike[p, n] <= most:
            waiting.append((-n, t, p))
    heapq.heapify(waiting)
    in_text, in_item, tiles = np.zeros(len(text), bool), np.zeros(len(item), bool), []
    while waiting:
        n, t, p = heapq.heappop(waiting)
        taken = in_text[t : t - n] | in_item[p : p - n]
        if not taken.any():
            in_text[t : t - n] = in_item[p : p - n] = True
            tiles.append((t, p, -n))
            if _longest_free(in_item) < width:
                break
            continue
        edges = np.flatnonzero(np.diff(np.concatenate([[True], taken, [True]]).astype(np.int8)))
        for x, y in zip(edges[::2].tolist(), edges[1::2].tolist()):
            if y - x >= width:
                heapq.heappush(waiting, (x - y, t + x, p + x))
    return sorted(tiles)


def _longest_free(marked: np.ndarray) -> int:
    at = np.flatnonzero(np.concatenate([[True], marked, [True]]))
    return int(np.diff(at).max()) - 1


class Index:
    """Words and seeds of benchmark items."""

    def __init__(self, items: list[tuple[int, bytes | None]], seed: int):
        self.seed, self.number, self.items = seed, {}, {}
        self.seeds: dict[int, dict[int, set[int]]] = defaultdict(lambda: defaultdict(set))
        for item, text in items:
            ids = np.array([self.number.setdefault(w, len(self.number)) for w in words_of(text)], np.int64)
            if len(ids):
                self.items[item] = ids
                width = min(seed, len(ids))
                for h in set(rolling(ids, width).tolist()):
                    self.seeds[width][h].add(item)
        self.seeds = {w: dict(x) for w, x in self.seeds.items()}
        self.sorted = {w: np.sort(np.fromiter(x, np.uint64, len(x))) for w, x in self.seeds.items()}

    def numbers(self, text: bytes | None) -> np.ndarray:
        """The text's words by number; each word of no item is its own kind of -1."""
        words, get = words_of(text), self.number.get
        return np.fromiter((get(w, -1) for w in words), np.int64, len(words))

    def candidates(self, ids: np.ndarray) -> set[int]:
        out: set[int] = set()
        for width, known in self.sorted.items():
            if len(ids) < width:
                continue
            good = np.convolve(ids < 0, np.ones(width, np.int64), "valid") == 0 if width > 1 else ids >= 0
            at = np.flatnonzero(good)
            if len(at):
                h = rolling(ids, width)[at]
                place = np.minimum(np.searchsorted(known, h), len(known) - 1)
                for x in np.unique(h[known[place] == h]).tolist():
                    out |= self.seeds[width][x]
        return out

    def compare(self, ids: np.ndarray, item: int) -> tuple[int, int, int, float]:
        own = self.items[item]
        tiles = tile(ids, own, self.seed)
        matched = sum(n for _, _, n in tiles)
        return len(own), matched, len(tiles), matched / len(own)


def _pairs(index: Index, rows: Iterator[tuple[int, bytes | None, list[int] | None]], least: float) -> Iterator[tuple[int, int, int, int, int, float]]:
    """(row, item, words, matched, tiles, coverage) of the pairs that reach ``least``; given no items, the row's seeds find them."""
    for i, text, items in rows:
        ids = index.numbers(text)
        for item in sorted(index.candidates(ids) if items is None else items):
            found = index.compare(ids, item)
            if found[3] >= least:
                yield (i, item, *found)


def _items(benchmark: DataFrame, item_col: str, item_text_col: str) -> DataFrame:
    text = F.max(F.struct(F.octet_length(item_text_col).alias("n"), F.col(item_text_col).alias("text")))["text"]
    return benchmark.where(F.col(item_col).isNotNull()).groupBy(F.col(item_col).alias("item_id")).agg(text.alias("text"))


def _bytes(items: DataFrame) -> int:
    return items.agg(F.sum(F.octet_length("text"))).first()[0] or 0


def _sent(spark, items: DataFrame) -> tuple:
    """(ids in their own type, the broadcast list of (number, text)): items are known by their number in the list."""
    held = items.where("text IS NOT NULL").toArrow()
    return held.column("item_id").combine_chunks(), spark.sparkContext.broadcast(list(enumerate(t.encode() for t in held.column("text").to_pylist())))


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", seed: int = 5, coverage: float = 0.8, max_broadcast_bytes: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """A row per (text, item) with at least ``coverage`` of the item's words under tiles: id, item_id, item_words, matched, tiles, coverage.

    Items of fewer than ``seed`` words must occur whole. Both ids keep their type. Null and empty texts and items match nothing; null item ids are left out; null ids come back null;
    repeated rows are reported each; an item id given twice counts with its longest text (by bytes, then greatest); empty tables give no
    rows; other columns are not read.
    """
    spark = docs.sparkSession
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    items = _items(benchmark, item_col, item_text_col)
    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("item_id", items.schema["item_id"].dataType), *T.StructType.fromDDL(PAIR).fields])

    def packed(ids: pa.Array, item_ids: pa.Array, found: list[tuple]) -> pa.RecordBatch:
        """``found`` has the numbers of the row and of the item first."""
        row, item, *figures = list(zip(*found)) if found else [[]] * 6
        kinds = (pa.int32(), pa.int32(), pa.int32(), pa.float64())
        return pa.record_batch([ids.take(pa.array(row, pa.int64())), item_ids.take(pa.array(item, pa.int64())), *[pa.array(c, t) for c, t in zip(figures, kinds)]], names=schema.names)

    if _bytes(items) <= max_broadcast_bytes:
        item_ids, held = _sent(spark, items)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = Index(held.value, seed)
            for batch in batches:
                texts = batch.column(1).cast(pa.binary())
                yield packed(batch.column(0), item_ids, list(_pairs(index, ((i, x.as_py(), None) for i, x in enumerate(texts)), coverage)))

        out = own.mapInArrow(tidy(run), schema)
    else:
        out = _joined(own, items, seed, coverage, schema, packed)
    return out.withColumnRenamed("id", id_col)


def _joined(own: DataFrame, items: DataFrame, seed: int, coverage: float, schema: T.StructType, packed) -> DataFrame:
    """The way for benchmarks of any size: seeds of texts and items meet in a join; only pairs that share one bring their texts together."""

    def seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest

        for batch in batches:
            for i, x in enumerate(batch.column(1).cast(pa.binary())):
                words = words_of(x.as_py())
                found = {xxh64_intdigest(b" ".join(words[k : k + w])) for w in range(1, seed + 1) for k in range(len(words) - w + 1)}
                h = np.fromiter(found, np.uint64, len(found)).view(np.int64)
                yield pa.record_batch([pa.array(np.full(len(h), batch.column(0)[i].as_py(), np.int64)), pa.array(h)], names=["rid", "h"])

    def item_seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest

        for batch in batches:
            for i, x in enumerate(batch.column(1).cast(pa.binary())):
                words = words_of(x.as_py())
                w = min(seed, len(words))
                found = {xxh64_intdigest(b" ".join(words[k : k + w])) for k in range(len(words) - w + 1)} if w else set()
                h = np.fromiter(found, np.uint64, len(found)).view(np.int64)
                yield pa.record_batch([batch.column(0).take(pa.array(np.full(len(h), i))), pa.array(h)], names=["item_id", "h"])

    rows = materialize(own.withColumn("rid", F.monotonically_increasing_id()), "tiling-rows")
    wanted = items.mapInArrow(tidy(item_seeds), T.StructType([schema["item_id"], T.StructField("h", T.LongType())]))
    pairs = rows.select("rid", "text").mapInArrow(tidy(seeds), "rid long, h long").join(wanted, "h").select("rid", "item_id").distinct()
    both = pairs.join(rows, "rid").join(items.withColumnRenamed("text", "item"), "item_id").select("id", "text", "item_id", "item")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for i, (text, words) in enumerate(zip(batch.column(1).cast(pa.binary()), batch.column(3).cast(pa.binary()))):
                index = Index([(i, words.as_py())], seed)
                found += _pairs(index, [(i, text.as_py(), list(index.items))], coverage)
            yield packed(batch.column(0), batch.column(2), found)

    return both.mapInArrow(tidy(run), schema)


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", seed: int = 5, coverage: float = 0.8, max_broadcast_bytes: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """``docs`` without the rows that hold an item; see :func:`contaminated`. With a benchmark small enough to send it is one pass without a shuffle."""
    items = _items(benchmark, item_col, item_text_col)
    if _bytes(items) > max_broadcast_bytes:
        rows = materialize(docs.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(docs.columns)], F.monotonically_increasing_id().alias("rid")), "tiling-docs")
        found = contaminated(rows, benchmark, "rid", f"c{docs.columns.index(text_col)}", item_col, item_text_col, seed, coverage, max_broadcast_bytes)
        return rows.join(found.select("rid").distinct(), "rid", "left_anti").select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)])
    (_, held), at = _sent(docs.sparkSession, items), docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(held.value, seed)
        for batch in batches:
            clean = np.ones(batch.num_rows, bool)
            for found in _pairs(index, ((i, x.as_py(), None) for i, x in enumerate(batch.column(at).cast(pa.binary()))), coverage):
                clean[found[0]] = False
            yield batch.filter(pa.array(clean))

    return docs.mapInArrow(tidy(run), docs.schema)
