"""Per-text 64-bit SimHash, shared by the near-duplicate operator and its tests."""

from __future__ import annotations

import numpy as np
import xxhash

#: Shingles hashed before their bits are added up; bounds the working memory of one text.
BLOCK = 1 << 18


def _bit_sums(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Column sums of the 64 bits of ``hashes``, one row for each run that begins at ``starts``."""
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.add.reduceat(bits, starts, axis=0, dtype=np.int64)


def shingles(words: list[bytes], width: int) -> list[bytes]:
    """Space-joined word windows, repeats included; a shorter text is one window, an empty one has none."""
    if len(words) >= width:
        return [b" ".join(w) for w in zip(*(words[i:] for i in range(width)))]
    return [b" ".join(words)] if words else []


def fingerprints(texts: list[bytes | None], width: int = 3, seed: int = 42) -> np.ndarray:
    """Unsigned 64-bit fingerprints: a bit is one if it is one in over half the window hashes."""
    digest = xxhash.xxh64_intdigest
    out = np.zeros(len(texts), np.uint64)
    weights = np.uint64(1) << np.arange(64, dtype=np.uint64)
    pending: list[int] = []
    rows: list[int] = []
    starts: list[int] = []

    def settle(sums: np.ndarray, totals: np.ndarray, at: list[int]) -> None:
        ones = sums * 2 > totals[:, None]
        out[at] = (ones * weights).sum(axis=1, dtype=np.uint64)

    def flush() -> None:
        if rows:
            begin = np.array(starts)
            settle(_bit_sums(np.array(pending, np.uint64), begin), np.diff(np.append(begin, len(pending))), rows)
            pending.clear(), rows.clear(), starts.clear()

    for i, text in enumerate(texts):
        words = text.lower().split() if text else []
        if not words:
            continue
        if len(words) > BLOCK:
            sums, total = np.zeros((1, 64), np.int64), 0
            for k in range(0, len(words) - width + 1, BLOCK):
                part = np.array([digest(s, seed) for s in shingles(words[k : k + BLOCK + width - 1], width)], np.uint64)
                sums += _bit_sums(part, np.array([0]))
                total += len(part)
            settle(sums, np.array([total]), [i])
            continue
        rows.append(i)
        starts.append(len(pending))
        pending += [digest(s, seed) for s in shingles(words, width)]
        if len(pending) > BLOCK:
            flush()
    flush()
    return out
