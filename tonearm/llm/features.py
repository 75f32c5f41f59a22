"""Sparse text features for the linear-time classifiers: hashed words, and structure statistics cut into buckets."""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np

#: Bytes of the word beginnings that bare words also count under: families of words share a stem.
STEM = 4
#: Buckets of one statistic.
BUCKETS = 12
UPPER = bytes(range(65, 91))
DIGITS = bytes(range(48, 58))
SYMBOLS = b"#*$%&|<>@{}[]\\^~_=+"
EXCLAIM = b"!?"
#: ASCII letters, digits and all non-ASCII bytes stay, other bytes part words.
BARE = bytes(b if b > 127 or chr(b).isalnum() else 32 for b in range(256))
#: Upper ends of the buckets: shares on a log-like scale, sizes on a log scale.
SHARES = np.array([0.001, 0.003, 0.01, 0.03, 0.06, 0.12, 0.2, 0.35, 0.5, 0.7, 0.9])
SIZES = np.array([1, 5, 15, 40, 80, 160, 320, 640, 1300, 2600, 5200])
LENGTHS = np.array([1.5, 2.5, 3.2, 3.8, 4.4, 5.0, 6.0, 7.0, 8.5, 11.0, 16.0])
STATISTICS = ("words", "characters", "word_length", "upper", "digits", "symbols", "exclaims", "distinct", "top_word", "dup_lines", "lines", "non_ascii", "twins")


def structure(text: bytes, words: list[bytes], tf: Counter) -> list[int]:
    """The bucket of each statistic of one text."""
    size, n = max(1, len(text)), max(1, len(words))
    share = lambda chars: (len(text) - len(text.translate(None, chars))) / size
    lines = [x for x in text.split(b"\n") if x.strip()]
    ascii_only = text.isascii()
    values = (
        (SIZES, len(words)),
        (SIZES, len(text) / 5),
        (LENGTHS, sum(map(len, words)) / n),
        (SHARES, share(UPPER)),
        (SHARES, share(DIGITS)),
        (SHARES, share(SYMBOLS)),
        (SHARES, share(EXCLAIM)),
        (SHARES, len(tf) / n),
        (SHARES, max(tf.values(), default=0) / n),
        (SHARES, 1 - len(set(lines)) / max(1, len(lines))),
        (SIZES, len(lines)),
        (SHARES, 0.0 if ascii_only else len(text.translate(None, bytes(range(128)))) / size),
        (SHARES, sum(map(bytes.__eq__, words, words[1:])) / n),
    )
    return [int(np.searchsorted(ends, v)) for ends, v in values]


def hashed(texts: list[bytes | None], bits: int, with_structure: bool = True, normal: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """CSR ``(starts, indices, values)``: 2**bits word slots, then the statistics' buckets.

    Word values are square roots of counts, scaled to length one if ``normal``. Without ``with_structure`` words are bare of ASCII punctuation and
    longer ones also count under their first STEM bytes. Every row has at least one entry: a constant slot at the end.
    """
    mask, base = (1 << bits) - 1, 1 << bits
    last = base + len(STATISTICS) * BUCKETS * with_structure
    starts, indices, values, at = [], [], [], 0
    flag = 1 / np.sqrt(len(STATISTICS))
    for text in texts:
        text = text or b""
        words = (text if with_structure else text.translate(BARE)).lower().split()
        tf = Counter(words)
        idx = [zlib.crc32(w) & mask for w in tf]
        if not with_structure:
            stems: Counter = Counter()
            for w, n in tf.items():
                if len(w) > STEM:
                    stems[w[:STEM]] += n
            idx += [zlib.crc32(w, STEM) & mask for w in stems]
        val = np.sqrt(np.array([*tf.values(), *(() if with_structure else stems.values())], np.float32))
        if normal and len(val):
            val /= np.sqrt((val * val).sum())
        extra = [base + k * BUCKETS + b for k, b in enumerate(structure(text, words, tf))] if with_structure else []
        starts.append(at)
        indices.append(np.array([*idx, *extra, last], np.int32))
        values.append(np.concatenate([val, np.full(len(extra), flag, np.float32), np.ones(1, np.float32)]))
        at += len(indices[-1])
    return np.array(starts, np.int64), np.concatenate(indices) if indices else np.empty(0, np.int32), np.concatenate(values) if values else np.empty(0, np.float32)


def width(bits: int, with_structure: bool = True) -> int:
    return (1 << bits) + len(STATISTICS) * BUCKETS * with_structure + 1
