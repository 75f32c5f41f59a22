"""Context-tree weighting over bytes, as sorted arrays.

A byte is eight binary decisions, so each of the 255 inner nodes of the byte's binary tree has a context tree of its own. A context of
depth d is the d bytes before, nearest first; every context that occurs, to ``DEPTH``, is a node. A node holds a Krichevsky-Trofimov estimate of
its counts; with P_e its estimate and P_w the children's weighted product,

    P_w(s) = 1/2 P_e(s) + 1/2 prod P_w(child),

and, counts being final after training, the chance of a bit is the same mixture with weights 1/2 P_e(s) / P_w(s) along
the path of contexts. A place in a text is one code: its five bytes of context and its byte. Codes that only texts to be scored hold have a
count of zero, which leaves the model as it is and gives them their chances like any other.

The tree is weighed in parts, each of which holds all codes of some contexts of depth ``CUT + 1``: upwards, what each adds to the nodes of depth ``CUT``; then those
nodes and the ones above, of which there are at most 256 ** CUT * 255; then downwards, each part's codes.
"""

from __future__ import annotations

import numpy as np

DEPTH, CUT = 5, 2
#: Ends every text, and stands before it; no byte of UTF-8 has this value.
END = 255
#: Bits of a code below the part that it belongs to.
PART_BITS = 8 * (DEPTH - CUT)
HALF = float(np.log(0.5))


def block(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Texts end to end, each followed by END, and where each begins."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]) if len(texts) else np.empty(0, np.int64)
    data = np.frombuffer(b"\xff".join(texts) + b"\xff", np.uint8) if len(texts) else np.empty(0, np.uint8)
    return data, starts


def codes(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """For each byte of ``data`` (texts that begin at ``starts``) its context, nearest byte first, and then itself."""
    out = np.zeros(len(data), np.int64)
    for d in range(1, DEPTH + 1):
        back = np.full(len(data), END, np.uint8)
        back[d:] = data[:-d]
        for k in range(d):
            at = starts + k
            back[at[at < len(data)]] = END
        out = (out << 8) | back
    return (out << 8) | data


def summed(code: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct codes with their counts."""
    order = np.argsort(code)
    code, n = code[order], n[order]
    first = _firsts(code)
    return code[first], np.add.reduceat(n, first) if len(first) else n


def count(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted codes and how often each occurs."""
    full = np.sort(codes(*block(texts)))
    first = _firsts(full)
    return full[first], np.diff(np.append(first, len(full)))


def _firsts(key: np.ndarray) -> np.ndarray:
    """Where each run of equal numbers begins."""
    return np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.empty(0, np.int64)


def _lgamma(x: np.ndarray) -> np.ndarray:
    """Log gamma for x >= 0.5: Stirling's series past a shift by eight."""
    shift = np.zeros_like(x)
    for k in range(8):
        shift += np.log(x + k)
    y = x + 8
    return (y - 0.5) * np.log(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - shift


#: Log gamma of n + 1/2 and of n + 1 for the small counts that most nodes have.
_SMALL = 4096
_WITH_HALF, _WITH_ONE = _lgamma(np.arange(_SMALL) + 0.5), _lgamma(np.arange(_SMALL) + 1.0)


def _at(counts: np.ndarray, shift: float, table: np.ndarray) -> np.ndarray:
    """Log gamma of whole ``counts`` plus ``shift``, out of ``table`` where they are small."""
    out = table[np.minimum(counts, _SMALL - 1)]
    large = counts >= _SMALL
    if large.any():
        out[large] = _lgamma(counts[large] + shift)
    return out


def _block_estimate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Log P_e of ``a`` zeros and ``b`` ones; exactly 0 without any."""
    log = _at(a, 0.5, _WITH_HALF) + _at(b, 0.5, _WITH_HALF) - _at(a + b, 1.0, _WITH_ONE) - 1.1447298858494002
    log[a + b == 0] = 0.0
    return log


def _next_one(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (b + 0.5) / (a + b + 1)


class _Level:
    """Nodes of one depth for one level of the byte's tree: sorted keys (context * 256 + byte node), counts, estimates and weights."""

    def __init__(self, key: np.ndarray, a: np.ndarray, b: np.ndarray, below: np.ndarray | None):
        """``below``: the sum of the children's log P_w; none at the greatest depth."""
        self.key, self.a, self.b = key, a, b
        self.estimate = _block_estimate(a, b)
        self.weighted = self.estimate if below is None else np.logaddexp(HALF + self.estimate, HALF + below)
        self.up = np.empty(0, np.int64)

    def parent(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Key, counts and children's sum of the nodes one byte of context shorter; ``up`` gets each node's parent."""
        key, self.up = np.unique((self.key >> 16 << 8) | (self.key & 255), return_inverse=True)
        total = lambda x: np.bincount(self.up, x, len(key))
        return key, total(self.a).astype(np.int64), total(self.b).astype(np.int64), total(self.weighted)

    def mixed(self, so_far: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What the path down to here gives to the chance of a 1, and the weight left, from the same of each node's parent."""
        own = np.exp(HALF + self.estimate - self.weighted)
        return so_far + left * own * _next_one(self.a, self.b), left * (1 - own)


def _lowest(code: np.ndarray, n: np.ndarray, bit: int) -> tuple[_Level, np.ndarray, np.ndarray]:
    """The nodes of depth DEPTH at the given bit of the byte, the node of each of the sorted codes, and the codes' bits there."""
    key = (code >> 8 << 8) | (1 << bit) | ((code & 255) >> (8 - bit))
    one = (code >> (7 - bit)) & 1
    first = _firsts(key)
    seen, b = np.add.reduceat(n, first), np.add.reduceat(n * one, first)
    node = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(key))))
    return _Level(key[first], seen - b, b, None), node, one


def _grown(code: np.ndarray, n: np.ndarray, bit: int) -> tuple[list[_Level], np.ndarray, np.ndarray]:
    lowest, node, one = _lowest(code, n, bit)
    levels = [lowest]
    while len(levels) < DEPTH - CUT:
        levels.append(_Level(*levels[-1].parent()))
    return levels, node, one


def upwards(code: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of sorted codes that make up whole contexts of depth CUT + 1: key, counts and children's sum that they add to nodes of depth CUT."""
    if not len(code):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
    parts = [_grown(code, n, bit)[0][-1].parent() for bit in range(8)]
    return tuple(np.concatenate(x) for x in zip(*parts))


def top(key: np.ndarray, a: np.ndarray, b: np.ndarray, below: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """From all nodes of depth CUT, with distinct keys: sorted keys, and what the path from the root gives and leaves there."""
    order = np.argsort(key)
    levels = [_Level(key[order], a[order], b[order], below[order])]
    while len(levels) <= CUT:
        levels.append(_Level(*levels[-1].parent()))
    so_far, left = np.zeros(len(levels[-1].key)), np.ones(len(levels[-1].key))
    for k in range(CUT, -1, -1):
        so_far, left = levels[k].mixed(so_far, left)
        if k:
            so_far, left = so_far[levels[k - 1].up], left[levels[k - 1].up]
    return levels[0].key, so_far, left


def downwards(code: np.ndarray, n: np.ndarray, above: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    """log10 chance of the byte of each of the sorted codes in its context; the codes make up whole contexts of depth CUT + 1."""
    out = np.zeros(len(code))
    if not len(code):
        return out
    keys, far, rest = above
    for bit in range(8):
        levels, node, one = _grown(code, n, bit)
        at = np.searchsorted(keys, levels[-1].parent()[0])
        so_far, left = far[at], rest[at]
        for level in levels[:0:-1]:
            so_far, left = level.mixed(so_far[level.up], left[level.up])
        lowest = levels[0]
        p = so_far[lowest.up] + left[lowest.up] * _next_one(lowest.a, lowest.b)
        out += np.log10(np.where(one, p[node], 1 - p[node]))
    return out


class Table:
    """Numbers of known codes, found by hashing: codes are kept by the top bits of a product, so a look-up reads a few neighbours."""

    def __init__(self, code: np.ndarray, value: np.ndarray):
        self.bits = max(1, int(len(code)).bit_length())
        slot = self._slot(code)
        order = np.argsort(slot, kind="stable")
        self.code, self.value = code[order], value[order]
        self.first = np.searchsorted(slot[order], np.arange((1 << self.bits) + 1)).astype(np.int32)
        self.most = int(np.diff(self.first).max()) if len(code) else 0

    def _slot(self, code: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((code.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The value of each code, zero where it is not known, and where that is."""
        out = np.zeros(len(code))
        if not len(self.code):
            return out, np.arange(len(code))
        slot = self._slot(code)
        at, end = self.first[slot], self.first[slot + 1]
        todo, lost = None, []
        for _ in range(self.most + 1):
            over = at >= end
            if over.any():
                lost.append(np.flatnonzero(over) if todo is None else todo[over])
                keep = np.flatnonzero(~over)
                todo, at, end = keep if todo is None else todo[keep], at[keep], end[keep]
            wanted = code if todo is None else code[todo]
            hit = self.code[at] == wanted
            if todo is None:
                todo = np.arange(len(code))
            out[todo[hit]] = self.value[at[hit]]
            miss = np.flatnonzero(~hit)
            if not len(miss):
                break
            todo, at, end = todo[miss], at[miss] + 1, end[miss]
        return out, np.sort(np.concatenate(lost)) if lost else np.empty(0, np.int64)
