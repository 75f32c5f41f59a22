"""Language-model scoring: a byte-level context-tree-weighting model, beside a smoothed word unigram.

Both learn from every training text, and both keep every word and every context that occurs, however rare. Counts are summed within tasks before they are shuffled. The
tree is weighed where its codes are (see ``ctw_core``): only its nodes of depth two, whose number is bounded, come to the driver. For scoring, the
most frequent words and codes are sent to the tasks, a bounded number of each; all others meet their values in a join.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonearm.llm import ctw_core
from tonearm.llm.worker import tidy
from tonearm.storage import materialize

#: Bytes of text handled at a time.
CHUNK_BYTES = 1 << 20
#: Distinct codes that a task sums before it hands them on, and that a part of the tree is weighed with at a time.
HELD_CODES, PART_CODES = 1 << 20, 1 << 17
WORD, CONTEXT, TOKENS = 0, 1, 2


def _signed_hash(word: bytes) -> int:
    h = xxhash.xxh64_intdigest(word)
    return h - (1 << 64) if h >> 63 else h


END_TOKEN = _signed_hash(b" end")


def _chunks(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, list[bytes]]]:
    """(number of the first row, lower-cased texts): runs of rows of about CHUNK_BYTES."""
    held, size, first = [], 0, 0
    for i, cell in enumerate(batch.column(column).cast(pa.binary())):
        text = (cell.as_py() or b"").lower()
        held.append(text)
        size += len(text)
        if size > CHUNK_BYTES:
            yield first, held
            held, size, first = [], 0, i + 1
    if held:
        yield first, held


def count_corpus(docs: DataFrame) -> DataFrame:
    """(kind, key, n) over ``docs``, which has text and held_out: hashed words with the end token and all tokens of the texts that are not held out; codes of all texts, n being their number in the former."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            out = batch.column(1).to_pylist()
            for first, texts in _chunks(batch, 0):
                own = [t for t, h in zip(texts, out[first : first + len(texts)]) if not h]
                tf: Counter = Counter()
                for text in own:
                    tf.update(text.split())
                keys = np.fromiter(map(_signed_hash, tf), np.int64, len(tf))
                n = np.fromiter(tf.values(), np.int64, len(tf))
                if own:
                    kind = np.repeat(np.array([WORD, TOKENS], np.int8), [len(keys) + 1, 1])
                    yield pa.record_batch([pa.array(kind), pa.array(np.concatenate([keys, [END_TOKEN, 0]])), pa.array(np.concatenate([n, [len(own), n.sum() + len(own)]]))], names=["kind", "key", "n"])
                held.append(ctw_core.count(own))
                code, n = ctw_core.count([t for t, h in zip(texts, out[first : first + len(texts)]) if h])
                held.append((code, np.zeros(len(code), np.int64)))
                size += len(held[-1][0]) + len(held[-2][0])
                if size > HELD_CODES:
                    held = [ctw_core.summed(*(np.concatenate(x) for x in zip(*held)))]
                    size = len(held[0][0])
                    if size > HELD_CODES // 2:
                        yield _codes(*held[0])
                        held, size = [], 0
        if held:
            yield _codes(*ctw_core.summed(*(np.concatenate(x) for x in zip(*held))))

    return docs.select("text", "held_out").mapInArrow(tidy(run), "kind byte, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n"))


def _codes(code: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    return pa.record_batch([pa.array(np.full(len(code), CONTEXT, np.int8)), pa.array(code), pa.array(n)], names=["kind", "key", "n"])


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Runs of sorted codes and counts that end where a context of depth CUT + 1 does."""
    held, size = [], 0
    for batch in batches:
        code, n = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        held.append((code, n))
        size += len(code)
        if size < PART_CODES:
            continue
        code, n = (np.concatenate(x) for x in zip(*held))
        part = code >> ctw_core.PART_BITS
        cut = int(np.searchsorted(part, part[-1]))
        if cut:
            yield code[:cut], n[:cut]
        held, size = [(code[cut:], n[cut:])], len(code) - cut
    if size:
        yield tuple(np.concatenate(x) for x in zip(*held))


def weighed(codes: DataFrame) -> DataFrame:
    """(key, n, v) from (key, n): v is log10 of the chance that the tree gives to the code's byte. A context of depth CUT + 1 is in one task whole, and has at most 256 ** 3 codes."""
    spark = codes.sparkSession
    sorted_codes = lambda: codes.select("key", "n").repartition(F.shiftright("key", ctw_core.PART_BITS)).sortWithinPartitions("key")

    def up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for code, n in _parts(batches):
            yield pa.record_batch([pa.array(x) for x in ctw_core.upwards(code, n)], names=["key", "a", "b", "below"])

    nodes = sorted_codes().mapInArrow(tidy(up), "key long, a long, b long, below double").groupBy("key").agg(F.sum("a").alias("a"), F.sum("b").alias("b"), F.sum("below").alias("below")).toArrow()
    above = spark.sparkContext.broadcast(ctw_core.top(*(nodes.column(c).to_numpy() for c in ("key", "a", "b", "below"))))

    def down(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for code, n in _parts(batches):
            yield pa.record_batch([pa.array(code), pa.array(n), pa.array(ctw_core.downwards(code, n, above.value))], names=["key", "n", "v"])

    return sorted_codes().mapInArrow(tidy(down), "key long, n long, v double")


def most_frequent(codes: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys and values of all codes that occur at least so often that no more than ``most`` do, by powers of two."""
    steps = sorted(codes.groupBy(F.length(F.bin("n")).alias("k")).count().collect(), reverse=True)
    total, least = 0, None
    for k, rows in steps:
        total += rows
        if total > most:
            break
        least = k
    got = codes.where(F.length(F.bin("n")) >= least if least is not None else F.lit(False)).select("key", "v").toArrow()
    return got.column("key").to_numpy(), got.column("v").to_numpy()


def language_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 10, add: float = 0.1, top_words: int = 50_000, top_codes: int = 1 << 20) -> DataFrame:
    """One row per row of ``docs``: id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte.

    Texts are lower-cased in A-Z. ``base_score`` is the log10 probability of the words and one end under the unigram of the
    training texts (those whose crc32 of the id, modulo ``folds``, is not 0) with ``add`` added to each count; ``score`` that of
    the bytes and their end under the context-tree model; ``bits_per_byte`` its code length. ``top_words`` and ``top_codes`` bound what is sent to the tasks and change no
    result. Null texts are empty: one token, the end. Null ids are not held
    out and are learnt from; repeated rows count as often as they occur; with no training text all counts are 0 and bytes are equally likely; an empty
    table gives no rows; other columns are not read. Words are known by 64-bit hashes.
    """
    from tonearm.llm.learning import held_out

    spark = docs.sparkSession
    own = docs.select(F.col(id_col).alias("id"), held_out(id_col, folds).alias("held_out"), F.col(text_col).alias("text"))
    counts = materialize(count_corpus(own), "lm-counts")
    words = counts.where(F.col("kind") == WORD).select("key", "n")
    n_all = counts.where(F.col("kind") == TOKENS).agg(F.sum("n")).first()[0] or 0
    # The end is a distinct token as soon as there is a training text.
    distinct = words.count()
    frequent = words.orderBy(F.desc("n"), "key").limit(top_words).toArrow()
    codes = materialize(weighed(counts.where(F.col("kind") == CONTEXT)), "lm-codes")
    total = n_all + add * (distinct + 1)
    log_total = float(np.log10(total)) if total > 0 else 0.0
    held = spark.sparkContext.broadcast((most_frequent(codes, top_codes), dict(zip(frequent.column("key").to_pylist(), frequent.column("n").to_pylist()))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top_chances, top = held.value
        chances = ctw_core.Table(*top_chances)
        logs = {k: float(np.log10(n + add)) for k, n in top.items()}
        end = logs.get(END_TOKEN)
        for batch in batches:
            for first, texts in _chunks(batch, 2):
                data, starts = ctw_core.block(texts)
                code = ctw_core.codes(data, starts)
                found, lost = chances.find(code)
                score, size = np.add.reduceat(found, starts), np.diff(np.append(starts, len(data)))
                rare_codes, times_codes = _per_text(code[lost], np.searchsorted(starts, lost, "right") - 1, len(texts))
                tokens, known, base, rare, times = [], [], [], [], []
                hashes: dict[bytes, int] = {}
                for text in texts:
                    tf = Counter(text.split())
                    # The end is a token like any other: if it is not among the frequent ones, it meets its count in the join.
                    k, b, r, t = (0, 0.0, [END_TOKEN], [1]) if end is None else (1, end, [], [])
                    for word, n in tf.items():
                        h = hashes.get(word)
                        if h is None:
                            h = hashes[word] = _signed_hash(word)
                        log = logs.get(h)
                        if log is None:
                            r.append(h)
                            t.append(n)
                        else:
                            k += n
                            b += n * log
                    tokens.append(sum(tf.values()) + 1)
                    known.append(k)
                    base.append(b)
                    rare.append(r)
                    times.append(t)
                part = batch.slice(first, len(texts))
                yield pa.record_batch([part.column(0), part.column(1), pa.array(tokens, pa.int64()), pa.array(known, pa.int64()), pa.array(np.array(base, np.float64)), pa.array(score), pa.array(size), pa.array(rare, pa.list_(pa.int64())), pa.array(times, pa.list_(pa.int32())), rare_codes, times_codes], names=["id", "held_out", "n_tokens", "known", "base", "score", "bytes", "rare", "times", "rare_codes", "times_codes"])

    kind = dict(own.dtypes)["id"]
    rows = own.mapInArrow(tidy(run), f"id {kind}, held_out boolean, n_tokens long, known long, base double, score double, bytes long, rare array<long>, times array<int>, rare_codes array<long>, times_codes array<int>")
    rows = materialize(rows.withColumn("rid", F.monotonically_increasing_id()), "lm-rows")

    def places(keys: str, times: str) -> DataFrame:
        return rows.select("rid", F.explode(F.arrays_zip(keys, times)).alias("x")).select("rid", F.col(f"x.{keys}").alias("key"), F.col(f"x.{times}").alias("times"))

    met = places("rare", "times").join(words, "key", "left").groupBy("rid").agg(F.sum(F.when(F.col("n").isNotNull(), F.col("times")).otherwise(0)).cast("long").alias("k"), F.sum(F.col("times") * F.log10(F.coalesce("n", F.lit(0)) + add)).alias("b"))
    coded = places("rare_codes", "times_codes").join(codes.select("key", "v"), "key").groupBy("rid").agg(F.sum(F.col("times") * F.col("v")).alias("c"))
    score = F.col("score") + F.coalesce("c", F.lit(0.0))
    # Base terms all lack the division by the total, which is the same for every token.
    return rows.drop("rare", "times", "rare_codes", "times_codes").join(met, "rid", "left").join(coded, "rid", "left").select(
        F.col("id").alias(id_col),
        "held_out",
        "n_tokens",
        (F.col("known") + F.coalesce("k", F.lit(0))).alias("n_known"),
        F.lit(n_all).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("b", F.lit(0.0)) - F.col("n_tokens") * log_total).alias("base_score"),
        score.alias("score"),
        (-score * float(np.log2(10)) / F.col("bytes")).alias("bits_per_byte"),
    )


def _per_text(code: np.ndarray, text: np.ndarray, texts: int) -> tuple[pa.Array, pa.Array]:
    """Per text its distinct codes and how often each occurs, as list arrays; ``text`` says, in order, which text each code is from."""
    order = np.lexsort((code, text))
    code, text = code[order], text[order]
    first = np.flatnonzero(np.concatenate([[True], (code[1:] != code[:-1]) | (text[1:] != text[:-1])])) if len(code) else np.empty(0, np.int64)
    n = np.diff(np.append(first, len(code))).astype(np.int32)
    offsets = pa.array(np.searchsorted(text[first], np.arange(texts + 1)).astype(np.int32))
    return pa.ListArray.from_arrays(offsets, pa.array(code[first])), pa.ListArray.from_arrays(offsets, pa.array(n))
