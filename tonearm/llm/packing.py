"""Best-fit packing with certified lower bounds and exchange between partitions.

Documents become token pieces of at most one sequence. Pieces are dealt to partitions of bounded size; each is packed by best-fit
decreasing, and dual-feasible functions give a lower bound on the sequences that it needs. A partition whose
count equals its bound is certified and keeps all but its half-empty sequences. The others give up sequences that have room. These pieces are dealt anew among
fewer partitions and packed again; an exchange that costs sequences is undone, and several rounds on end that save none end it.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tonearm.llm.worker import tidy
from tonearm.storage import materialize

#: Tokens of one Arrow batch out of the tokenizer.
BATCH_TOKENS = 2 << 20
#: The fast encoder's pattern matcher recurses on white space and overflows its stack on runs far longer than this.
LONG_GAP = 10_000
_LONG_GAP = re.compile(rf"(?<!\s)\s{{{LONG_GAP}}}")
#: Shares of the sequences with room that are given up, round by round, the emptiest first.
RELEASED = (1.0, 0.7, 0.4, 0.2)
PIECE = "piece int, start long, length int, ids binary"


def _byte_of() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies: printable Latin-1 bytes stand for themselves, the rest follow from U+0100."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def encoder(definition: bytes):
    """text -> ids, as the tokenizer file says.

    Ordinary text goes through the byte-pair merges with the file's own vocabulary as ranks, which gives the same ids several times
    faster; texts that hold one of the file's special tokens go through the general library.
    """
    import tiktoken
    from public_tokenizers import PATTERN
    from tokenizers import Tokenizer

    spec = json.loads(definition)
    special = {t["content"] for t in spec.get("added_tokens", [])}
    byte_of = _byte_of()
    ranks = {bytes(byte_of[c] for c in token): rank for token, rank in spec["model"]["vocab"].items() if token not in special}
    fast = tiktoken.Encoding("packing", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    general: list[Tokenizer] = []

    def encode(text: str) -> list[int]:
        if any(s in text for s in special) or (len(text) >= LONG_GAP and _LONG_GAP.search(text)):
            if not general:
                general.append(Tokenizer.from_str(definition.decode("utf-8")))
            return general[0].encode(text, add_special_tokens=False).ids
        return fast.encode_ordinary(text)

    return encode


def token_pieces(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 1024, end_id: int = 2) -> DataFrame:
    """Rows ``(id, piece, start, length, ids)``: ids as little-endian unsigned 32-bit integers, ``end_id`` last.

    Only documents over ``capacity`` tokens are cut; all their pieces are full but the first. A null or empty text is its end token alone.
    """
    with open(tokenizer_path, "rb") as f:
        definition = docs.sparkSession.sparkContext.broadcast(f.read())
    kind = docs.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(definition.value)
        own, rows, tokens = None, [], 0

        def out() -> pa.RecordBatch:
            where, piece, start, length, ids = zip(*rows)
            return pa.record_batch([own.take(pa.array(where)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int32()), pa.array(ids, pa.binary())], names=[id_col, "piece", "start", "length", "ids"])

        for batch in batches:
            own = batch.column(0)
            for i, text in enumerate(batch.column(1)):
                ids = np.array([*encode(text.as_py() or ""), end_id], "<u4")
                first = len(ids) % capacity or capacity
                cuts = [0, *range(first, len(ids), capacity), len(ids)]
                for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
                    rows.append((i, k, a, b - a, ids[a:b].tobytes()))
                tokens += len(ids)
                if tokens > BATCH_TOKENS:
                    yield out()
                    rows, tokens = [], 0
            if rows:
                yield out()
                rows, tokens = [], 0

    schema = T.StructType([T.StructField(id_col, kind), *T.StructType.fromDDL(PIECE).fields])
    return docs.select(id_col, text_col).mapInArrow(tidy(run), schema)


def lower_bound(counts: np.ndarray, capacity: int) -> int:
    """Bins that any packing needs; ``counts[n]`` pieces have length n.

    The largest of the plain volume bound and two families of dual-feasible functions: rounding to k-ths, and dropping what is under a
    threshold while what is over its complement counts as a whole bin.
    """
    sizes = np.flatnonzero(counts)
    sizes = sizes[sizes > 0]
    if not len(sizes):
        return 0
    n = counts[sizes].astype(np.int64)
    best = -(-int((sizes * n).sum()) // capacity)
    for k in range(1, 21):
        x = sizes * (k + 1)
        # u_k(s) is s where (k+1)s/C is whole, else floor((k+1)s/C) * C/k; here times k.
        value = np.where(x % capacity == 0, sizes * k, (x // capacity) * capacity)
        best = max(best, -(-int((value * n).sum()) // (capacity * k)))
    for low in sizes[sizes <= capacity // 2]:
        value = np.where(sizes > capacity - low, capacity, np.where(sizes < low, 0, sizes))
        best = max(best, -(-int((value * n).sum()) // capacity))
    return best


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bin of each piece, its offset there, free room of each bin). The fullest bin with room gets the next longest piece."""
    order = np.argsort(-lengths, kind="stable")
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    some, free = 0, []
    for i in order.tolist():
        need = int(lengths[i])
        fits = some >> need
        if fits:
            room = need + (fits & -fits).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                some &= ~(1 << room)
        else:
            room, b = capacity, len(free)
            free.append(capacity)
        bins[i], offsets[i] = b, capacity - room
        room -= need
        free[b] = room
        by_room[room].append(b)
        some |= 1 << room
    return bins, offsets, np.array(free, np.int64)


def _pack_parts(dealt: DataFrame, capacity: int) -> DataFrame:
    """``dealt`` has pid, length, part; adds bin, offset, the free room of the bin, and the partition's sequences and bound."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("pid", ignore_index=True)
        bins, offsets, free = best_fit_decreasing(rows["length"].to_numpy(), capacity)
        bound = lower_bound(np.bincount(rows["length"], minlength=capacity + 1), capacity)
        return rows.assign(bin=bins, offset=offsets, free=free[bins], part_sequences=len(free), part_bound=bound)

    return dealt.groupBy("part").applyInPandas(run, "pid long, length int, part long, bin long, offset long, free long, part_sequences long, part_bound long")


def _dealt(pool: DataFrame, pieces: int, per_part: int, salt: int) -> DataFrame:
    return pool.select("pid", "length", F.pmod(F.xxhash64("pid", F.lit(salt)), F.lit(max(1, -(-pieces // per_part)))).alias("part"))


def _packed(dealt: DataFrame, capacity: int, first: int) -> tuple[DataFrame, int, int]:
    """(the packed pieces, written, with sequence numbers from ``first`` on; how many sequences they are; the first number after them)."""
    done = materialize(_pack_parts(dealt, capacity), "pack-round")
    parts, most, used = done.agg(F.max("part"), F.max("bin"), F.count(F.when(F.col("offset") == 0, True))).first()
    stride = (most or 0) + 1
    numbered = done.withColumn("sequence_id", F.lit(first) + F.col("part") * stride + F.col("bin")).drop("part", "bin")
    return numbered, used, first + ((parts or 0) + 1) * stride


def pack(pieces: DataFrame, capacity: int = 1024, per_part: int = 20_000, patience: int = 3) -> DataFrame:
    """``pieces`` (with a column ``length`` of 1 to ``capacity``) with ``sequence_id``, ``offset`` and certificates.

    Pieces never overlap and leave no gap within a sequence. ``part_sequences`` and ``part_bound`` are what the piece's partition took when it was
    packed, and the least it could have; ``all_sequences`` and ``all_bound`` are those of the whole table. In the exchange, partitions above their bound give up sequences with room:
    first all of them, then the emptier ones by the shares of ``RELEASED`` in turn; partitions at their bound give up those at least half empty. The exchange ends
    when ``patience`` rounds on end save no sequence, or the whole meets its bound. ``per_part`` bounds the pieces in one task. No pieces give no rows.
    """
    rows = materialize(pieces.withColumn("pid", F.monotonically_increasing_id()), "pack-pieces")
    counts = np.zeros(capacity + 1, np.int64)
    for r in rows.groupBy("length").count().collect():
        counts[r["length"]] = r["count"]
    small = rows.where(F.col("length") < capacity).select("pid", "length")
    placed, total, number = _packed(_dealt(small, int(counts[:capacity].sum()), per_part, 0), capacity, 0)
    bound, total, unlucky, k = lower_bound(counts, capacity), total + int(counts[capacity]), 0, 0
    while total > bound and unlucky < patience:
        share = RELEASED[k % len(RELEASED)]
        k += 1
        over = F.col("part_sequences") > F.col("part_bound")
        least = placed.where(over & (F.col("free") > 0) & (F.col("offset") == 0)).agg(F.percentile_approx("free", 1 - share, 1000)).first()[0]
        gone = F.when(over, F.col("free") >= F.lit(least or 1)).otherwise(F.col("free") * 2 >= capacity)
        pool = placed.where(gone)
        in_pool, held = pool.agg(F.count("*"), F.count(F.when(F.col("offset") == 0, True))).first()
        again, used, after = _packed(_dealt(pool, in_pool, per_part, k), capacity, number)
        if used > held:
            unlucky += 1
            continue
        # Another arrangement of as many sequences is taken too: it may be the better one to go on from.
        unlucky = 0 if used < held else unlucky + 1
        placed, total, number = materialize(placed.where(~gone).unionByName(again), "pack-placed"), total - held + used, after
    of_small = placed.select("pid", "sequence_id", "offset", "part_sequences", "part_bound")
    one = F.lit(1).cast("long")
    full = rows.where(F.col("length") >= capacity).withColumns({"sequence_id": -F.col("pid") - 1, "offset": F.lit(0).cast("long"), "part_sequences": one, "part_bound": one})
    return rows.where(F.col("length") < capacity).join(of_small, "pid").unionByName(full).drop("pid").withColumns({"all_sequences": F.lit(total).cast("long"), "all_bound": F.lit(bound).cast("long")})


def pack_documents(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 1024, end_id: int = 2, keep_ids: bool = True) -> DataFrame:
    """Pack whole documents: id, piece, start, length, ids (or their CRC-32 as ``ids_crc32`` without ``keep_ids``), sequence_id, offset, and the certificates of :func:`pack`.

    Texts may be of any length and kind, also of white space alone. Null ids come back null; repeated rows are packed as often as they occur; an empty table gives no rows; other columns are not read.
    """
    pieces = token_pieces(docs, tokenizer_path, id_col, text_col, capacity, end_id)
    if not keep_ids:
        pieces = pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return pack(pieces, capacity)
