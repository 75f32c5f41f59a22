"""Personal data in one text: base spans by pattern, secrets, and the words beside them."""

from __future__ import annotations

import re

import xxhash

#: The base kinds, in their order, and the kinds that are added: entities that disclose themselves, and terms that disclose an entity.
KINDS = ("email", "ip", "card", "phone")
SECRET, TERM = "secret", "term"
ORDER = {k: i for i, k in enumerate((*KINDS, SECRET, TERM))}

_LOCAL_RUN = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_DIGIT = re.compile(r"[0-9]")
# Digit runs are taken whole, so no start inside a run is tried again: the same matches, in linear time.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_WORD = re.compile(r"[^\W_]+(?:['-][^\W_]+)*")
# Keys and tokens: long runs of one alphabet in which letters and digits take turns.
_RUN = re.compile(r"(?<![A-Za-z0-9_+/-])[A-Za-z0-9_+/-]{20,}")
_TURN = re.compile(r"(?=[A-Za-z][0-9]|[0-9][A-Za-z])")
#: Changes between letter and digit that make a run a secret: words with a number at the end have one, random ones of 20 have nine on average if hexadecimal.
TURNS = 8


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches around each at-sign: its local part is the longest run before it that no earlier match holds."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > free and text[begin - 1] in _LOCAL:
            begin -= 1
        if begin < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((begin, m.end()))
            free = m.end()
        # A run that this at-sign ends cannot begin another match before it.
        free = max(free, at + 1)
        at = text.find("@", max(at + 1, free))
    return out


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by start, then kind; code points, end exclusive."""
    out = [("email", a, b) for a, b in emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p) <= 3 and int(p or "0") <= 255 for p in (p.lstrip("0") for p in m[0].split("."))):
                out.append(("ip", *m.span()))
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", *m.span()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                    out.append(("phone", *m.span()))
    return sorted(out, key=lambda s: (s[1], ORDER[s[0]], s[2]))


def secrets(text: str, spans: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Runs that look random and overlap none of ``spans`` (by start)."""
    out, k, reach = [], 0, 0
    for m in _RUN.finditer(text):
        x, y = m.span()
        while k < len(spans) and spans[k][1] < y:
            reach = max(reach, spans[k][2])
            k += 1
        if reach <= x and sum(1 for _ in _TURN.finditer(m[0])) >= TURNS:
            out.append((SECRET, x, y))
    return out


def generalised(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with (start, end, kind) spans, in order, as their kinds in brackets; a span that begins inside the one before goes with it."""
    out, done = [], 0
    for a, b, kind in spans:
        if a >= done:
            out += text[done:a], f"[{kind.upper()}]"
        done = max(done, b)
    return "".join([*out, text[done:]])


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def signed_hash(data: str) -> int:
    h = xxhash.xxh64_intdigest(data)
    return h - (1 << 64) if h >> 63 else h


def entity(kind: str, value: str) -> int:
    """A signed 64-bit stand-in for a protected entity; spelling variants of numbers are one entity."""
    value = value.lower() if kind == "email" else value if kind == SECRET else re.sub(r"[^0-9.]" if kind == "ip" else r"[^0-9]", "", value)
    return signed_hash(f"{kind}:{value}")


def places(text: str, spans: list[tuple[str, int, int]]) -> dict[str, list[int]]:
    """Term -> its starts and ends in turn: the words, of any length, that overlap no span (by start)."""
    out: dict[str, list[int]] = {}
    k, reach = 0, 0
    for m in _WORD.finditer(text):
        x, y = m.span()
        while k < len(spans) and spans[k][1] < y:
            reach = max(reach, spans[k][2])
            k += 1
        if reach <= x:
            out.setdefault(m[0].lower(), []).extend((x, y))
    return out


def terms_of(text: str) -> set[str]:
    """All terms of a text, spelt as in :func:`places`."""
    return {w.lower() for w in set(_WORD.findall(text))}
