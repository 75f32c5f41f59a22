"""The operators' results against plain versions of the same rules, over the smallest tables."""

import re
import zlib
from collections import Counter

import pytest
import xxhash

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text or "" for r in docs.collect()}


def plain_fingerprint(text: str) -> int:
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    parts = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(p.encode(), seed=42) for p in parts]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def plain_components(fps: dict[int, int], radius: int) -> dict[int, int]:
    parent = {i: i for i in fps}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(fps)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if (fps[a] ^ fps[b]).bit_count() <= radius:
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {i: root(i) for i in ids}


def test_simhash(docs, texts):
    from tonearm.llm.simhash import near_duplicates

    got = {r.doc_id: r for r in near_duplicates(docs).collect()}
    fps = {i: plain_fingerprint(t) for i, t in texts.items()}
    assert {i: r.fingerprint for i, r in got.items()} == {i: f"{f:016x}" for i, f in fps.items()}
    assert {i: r.component_id for i, r in got.items()} == plain_components(fps, 2)


def test_simhash_blocks_add_up(monkeypatch):
    from tonearm.llm import simhash_core

    text = b" ".join(b"w%d" % (i % 977) for i in range(5000))
    whole = simhash_core.fingerprints([text, b"", None, b"one two"])
    monkeypatch.setattr(simhash_core, "BLOCK", 700)
    assert (simhash_core.fingerprints([text, b"", None, b"one two"]) == whole).all()
    assert whole[1] == whole[2] == 0


@pytest.mark.parametrize("hot", [1024, 3])
def test_hamming_links(spark, hot):
    """With a low crowding mark the whole-ball way serves the same pairs."""
    import random

    from tonearm.llm.simhash import hamming_links, signed

    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(30)]
    fps = sorted({b ^ (1 << rng.randrange(64)) ^ (rng.randrange(2) << rng.randrange(64)) for b in base for _ in range(12)} | set(base))
    want = {tuple(sorted((signed(a), signed(b)))) for a in fps for b in fps if a < b and (a ^ b).bit_count() <= 2}
    got = [(r.a, r.b) for r in hamming_links(spark.createDataFrame([(signed(f),) for f in fps], "fp long"), hot=hot).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_packing(spark, docs, texts):
    import numpy as np
    import public_tokenizers
    from tokenizers import Tokenizer

    from tonearm.llm.packing import pack_documents

    path = public_tokenizers.path("byte_bpe_50k.json")
    general = Tokenizer.from_file(path)
    odd = {10**6: "ends <|endoftext|> inside", 10**6 + 1: "tabs\t\tand  blanks\n\n  x", 10**6 + 2: ""}
    more = docs.select("doc_id", "text").union(spark.createDataFrame(list(odd.items()), "doc_id long, text string"))
    rows = pack_documents(more, path).collect()
    pieces: dict = {}
    for r in rows:
        pieces.setdefault(r.doc_id, []).append(r)
    for i, text in {**texts, **odd}.items():
        ids = [*general.encode(text, add_special_tokens=False).ids, 2]
        own = sorted(pieces[i], key=lambda r: r.piece)
        assert np.concatenate([np.frombuffer(r.ids, "<u4") for r in own]).tolist() == ids
        assert [r.piece for r in own] == list(range(len(own)))
        assert all(r.length == 1024 for r in own[1:]) and len(own) == -(-len(ids) // 1024)
        assert [r.start for r in own] == [sum(x.length for x in own[:k]) for k in range(len(own))]
    bins: dict = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for x in bins.values():
        at = 0
        for offset, length in sorted(x):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(bins) <= -(-sum(r.length for r in rows) // 1024) + 2


@pytest.mark.parametrize("text", ["x" + " " * 2_000_000 + "y", "\n" * 2_000_000, "x" * 2_000_000, " " * 9_999 + "a" + "\u00a0\t" * 6_000, "\x1c \n" * 5_000], ids=["blanks", "newlines", "letter", "edges", "separators"])
def test_encoder_on_long_runs(text):
    import public_tokenizers
    from tokenizers import Tokenizer

    from tonearm.llm.packing import encoder

    path = public_tokenizers.path("byte_bpe_50k.json")
    with open(path, "rb") as f:
        assert encoder(f.read())(text) == Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("pieces, low, high, per_part, within", [(3000, 150, 600, 40, 1.035), (3000, 260, 500, 30, 1.035), (200_000, 20, 1024, 2000, 1.012)])
def test_exchange_over_many_partitions(spark, pieces, low, high, per_part, within):
    """A hundred partitions come close to best-fit decreasing of all pieces in one task, very small ones less so; no gap, no overlap, each number one sequence."""
    import numpy as np

    from tonearm.llm.packing import best_fit_decreasing, pack

    lengths = np.random.default_rng(per_part).integers(low, high, pieces)
    df = spark.createDataFrame([(int(n),) for n in lengths], "length int").repartition(8)
    held: dict = {}
    out = pack(df, per_part=per_part).collect()
    for r in out:
        held.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert sorted(r.length for r in out) == sorted(lengths.tolist())
    for sequence in held.values():
        ends = 0
        for offset, length in sorted(sequence):
            assert offset == ends
            ends += length
        assert ends <= 1024
    assert len(held) == out[0].all_sequences >= out[0].all_bound
    assert len(held) <= within * len(best_fit_decreasing(lengths, 1024)[2])


def test_packing_bound_and_exchange(spark):
    import numpy as np

    from tonearm.llm import packing

    rng = np.random.default_rng(1)
    lengths = rng.integers(1, 1024, 3000)
    df = spark.createDataFrame([(int(x),) for x in lengths], "length int")
    out = packing.pack(df, per_part=1000).collect()
    n = len({r.sequence_id for r in out})
    bound = packing.lower_bound(np.bincount(lengths, minlength=1025), 1024)
    assert {(r.all_sequences, r.all_bound) for r in out} == {(n, bound)}
    assert all(r.part_sequences >= r.part_bound for r in out)
    assert len(out) == 3000 and bound <= n <= bound * 1.02 + 2
    # Thirds just over a half and a third: volume alone would promise too few.
    assert packing.lower_bound(np.bincount([513] * 10, minlength=1025), 1024) == 10
    for _ in range(200):
        x = rng.integers(1, 1025, 9)
        bins, offsets, free = packing.best_fit_decreasing(x, 1024)
        assert packing.lower_bound(np.bincount(x, minlength=1025), 1024) <= len(free)


def test_sharding(spark, docs, texts):
    from tonearm.llm.sharding import shard_by_bytes

    rows = shard_by_bytes(docs, 24).collect()
    size = {i: len(t.encode()) + 8 for i, t in texts.items()}
    assert {r.doc_id: (r.size, r.text_crc32) for r in rows} == {i: (size[i], zlib.crc32(t.encode())) for i, t in texts.items()}
    slots: dict = {}
    for r in rows:
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    totals = Counter()
    for r in rows:
        totals[r.shard] += r.size
    mean = sum(size.values()) / 24
    assert max(abs(totals[k] - mean) for k in range(24)) <= 2 * max(size.values())


def test_sharding_cuts_a_hot_group_and_keeps_small_ones(spark):
    from tonearm.llm.sharding import shard_by_bytes

    rows = [(i, "same text over and over") for i in range(4000)] + [(10_000 + i, f"text number {i // 2} of a pair") for i in range(8000)]
    out = shard_by_bytes(spark.createDataFrame(rows, "doc_id long, text string"), 6).collect()
    totals, where = Counter(), {}
    for r in out:
        totals[r.shard] += r.size
        where.setdefault(r.text_crc32, set()).add(r.shard)
    mean = sum(totals.values()) / 6
    assert all(abs(x - mean) < 0.01 * mean for x in totals.values())
    assert sum(len(s) > 1 for s in where.values()) <= 1


def test_sharding_cuts_equal_rows(spark):
    """A text with one id, or none, over and over: only its places tell its rows apart."""
    from tonearm.llm.sharding import shard_by_bytes

    rows = [(7, "the same row again and again")] * 3000 + [(None, "a text without an id, again and again")] * 3000
    out = shard_by_bytes(spark.createDataFrame(rows, "doc_id long, text string"), 6, rows_per_range=100).collect()
    totals, slots = Counter(), {}
    for r in out:
        totals[r.shard] += r.size
        slots.setdefault(r.shard, []).append(r.slot)
    assert len(out) == 6000 and all(abs(x - sum(totals.values()) / 6) < 100 for x in totals.values())
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())


def plain_stats(text: str) -> tuple:
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    n = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if n[w] > 1 for k in range(3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_quality_rules(docs, texts, spark):
    from tonearm.llm.quality_rules import quality_rules

    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = quality_rules(docs).collect()
    for r in rows:
        s = plain_stats(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == s
        assert r.base_failed == (s[0] < 50 or 100 * s[4] > 50 * s[0])
        assert not (r.base_failed and r.kept)
    good = [r for r in rows if labels.get(r.doc_id) == 1 and not r.base_failed]
    assert sum(r.kept for r in good) >= 0.97 * len(good)


def plain_verdicts(rows: list[tuple], weight: float = 100.0) -> tuple[dict, dict]:
    """(kept by id, limits by (lang, source)) of (id, lang, source, text), from exact quantiles."""
    import math

    rules = {
        "symbols": (lambda s: math.log((s[2] + 1) / (s[0] + 1)), 1, 0.5, 0.25, 5, 0.25, 2),
        "dup_lines": (lambda s: math.log((s[3] + 1) / (s[0] + 1)), 1, 0.5, 0.25, 5, 0.25, 3),
        "repeats": (lambda s: s[4] / s[0], 1, 0.99, 0.5, 2, 0.05, 4),
        "word_length": (lambda s: s[1] / s[0], 1, 0.5, 0.25, 14, 0.05, 0),
        "short_words": (lambda s: s[1] / s[0], -1, 0.5, 0.75, 14, 0.05, 0),
    }
    stats = {i: (lang, source, plain_stats(text)) for i, lang, source, text in rows}
    passed = {i: x for i, x in stats.items() if x[2][0] >= 50 and 100 * x[2][4] <= 50 * x[2][0]}

    def quantiles(group, parent=None):
        out = {}
        for r, (measure, _, c, o, *_) in rules.items():
            v = sorted(measure(x[2]) for x in group)
            q = [v[max(0, math.ceil(p * len(v)) - 1)] for p in (c, o)]
            out[r] = q if parent is None else [(a * len(v) + b * weight) / (len(v) + weight) for a, b in zip(q, parent[r])]
        return out

    def limit(r, q):
        _, sign, _, _, reach, margin, _ = rules[r]
        gap = sign * max(margin, abs(q[r][0] - q[r][1]))
        return q[r][0] + reach * gap, gap

    everyone, limits = quantiles(passed.values()), {}
    for lang in {x[0] for x in passed.values()}:
        of_lang = quantiles([x for x in passed.values() if x[0] == lang], everyone)
        for source in {x[1] for x in passed.values() if x[0] == lang}:
            own = quantiles([x for x in passed.values() if x[:2] == (lang, source)], of_lang)
            limits[lang, source] = {r: (min if rules[r][1] > 0 else max)(limit(r, own)[0], sum(limit(r, of_lang))) for r in rules}
    past = lambda x, r: rules[r][1] * (rules[r][0](x[2]) - limits[x[:2]][r]) > 0 and x[2][rules[r][6]] > 0
    return {i: i in passed and not any(past(x, r) for r in rules) for i, x in stats.items()}, limits


def test_adaptive_verdicts(docs):
    """The thresholds are those of exact quantiles (the sketches are exact at this size), and they decide."""
    from tonearm.llm.quality_rules import quality_rules

    rows = [(r.doc_id, r.lang, r.source, r.text or "") for r in docs.select("doc_id", "lang", "source", "text").collect()]
    want, limits = plain_verdicts(rows)
    got = quality_rules(docs).collect()
    assert {r.doc_id: r.kept for r in got} == want
    assert any(not r.kept and not r.base_failed for r in got)
    assert len({round(x["word_length"], 6) for x in limits.values()}) > 1


def test_limits_follow_their_group_and_not_its_junk(spark):
    """A ratio that is usual in one source is junk in another; a source with a third of junk keeps none of it."""
    import random

    from tonearm.llm.quality_rules import quality_rules

    rng = random.Random(4)

    def text(marks: float, size: int) -> str:
        return " ".join(f"w{rng.randrange(10**6)}" + ("#" if rng.random() < marks else "") for _ in range(size))

    rows, kinds = [], {}
    for source, marks, junk in (("plain", 0.0, 0), ("code", 0.5, 0), ("dirty", 0.0, 200)):
        for k in range(400 + junk):
            i = len(rows)
            kinds[i] = (source, k >= 400)
            rows.append((i, text(0.6 if k >= 400 else marks, rng.randrange(60, 600)), "en" if source != "code" else "xx", source))
    odd = len(rows)
    rows += [(odd, text(0.5, 200), "en", "plain"), (odd + 1, text(0.5, 200), "xx", "code")]
    out = {r.doc_id: r.kept for r in quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert not out[odd] and out[odd + 1]
    assert not any(out[i] for i, (_, junk) in kinds.items() if junk)
    assert sum(out[i] for i, (_, junk) in kinds.items() if not junk) >= 0.99 * 1200


def plain_spans(text: str) -> list:
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append((m.start(), 0, "email", m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(x) <= 255 for x in m[0].split(".")):
            out.append((m.start(), 1, "ip", m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m[0] if c in "0123456789"]
        total = sum(d[-1::-2]) + sum(sum(divmod(2 * x, 10)) for x in d[-2::-2])
        if 12 <= len(d) <= 19 and total % 10 == 0:
            out.append((m.start(), 2, "card", m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= sum(c in "0123456789" for c in m[0]) <= 15:
            out.append((m.start(), 3, "phone", m.end()))
    return [(k, a, b) for a, _, k, b in sorted(out)]


HARD = ["a@b.c@d.e", "x@@y.z", "a.b+c@d-e.f.g.", "1.2.3.4.5.6.7.8", "1..2.3.4.5", "256.1.1.1 255.255.255.255", "+1 (23) 456-78-90. +12+345678901", "4111-1111 1111 1111 4111111111111112", "--9@1.2", "é@a.b ü1.1.1.1", "0001.02.3.4", "@a.b", "a@b", "a@.b", "12 34  56", "+1234567 8", "1@2.3.4.5@6.7"]


@pytest.mark.parametrize("text", HARD)
def test_base_spans_of_hard_texts(text):
    from tonearm.llm.pii_core import base_spans

    assert base_spans(text) == plain_spans(text)


def test_base_spans_random():
    import random

    from tonearm.llm.pii_core import base_spans

    rng = random.Random(5)
    for _ in range(3000):
        text = "".join(rng.choice("12 3-.@+a(é)%") for _ in range(rng.randrange(60)))
        assert base_spans(text) == plain_spans(text)


def plain_secrets(text: str) -> list:
    base = [(a, b) for _, a, b in plain_spans(text)]
    out = []
    for m in re.finditer(r"(?<![A-Za-z0-9_+/-])[A-Za-z0-9_+/-]{20,}", text):
        turns = len(re.findall(r"(?=[A-Za-z][0-9]|[0-9][A-Za-z])", m[0]))
        if turns >= 8 and not any(a < m.end() and b > m.start() for a, b in base):
            out.append(("secret", *m.span()))
    return out


def plain_terms(texts: dict, threshold: float = 0.8, added: float = 0.75) -> dict:
    """Term spans of each text by counting every pair of an entity and a word that share a text."""
    import math

    entities, words = {}, {}
    for i, text in texts.items():
        spans = plain_spans(text) + plain_secrets(text)
        entities[i] = {(k, text[a:b].lower() if k == "email" else text[a:b] if k == "secret" else re.sub("[^0-9.]" if k == "ip" else "[^0-9]", "", text[a:b])) for k, a, b in spans}
        words[i] = [(m[0].lower(), *m.span()) for m in re.finditer(r"[^\W_]+(?:['-][^\W_]+)*", text)]
        words[i] = [(w, a, b, any(x < b and y > a for _, x, y in spans)) for w, a, b in words[i]]
    n_c, n_t, n_ct = Counter(), Counter(), Counter()
    for i in texts:
        free = {w for w, _, _, inside in words[i] if not inside}
        n_c.update(entities[i])
        n_t.update({w for w, *_ in words[i]})
        n_ct.update((c, w) for c in entities[i] for w in free)
    n, out = len(texts), {}
    for i in texts:
        tells = lambda w, i=i: any(n > n_c[c] and math.log2(n * n_ct[c, w] / ((n_c[c] + added) * (n_t[w] + added))) >= threshold * math.log2(n / n_c[c]) for c in entities[i])
        out[i] = {("term", a, b) for w, a, b, inside in words[i] if not inside and tells(w)}
    return out


@pytest.mark.parametrize("threshold", [0.8, 0.7])
def test_personal_data(docs, texts, threshold):
    """Whole tables: base spans, secrets, and the terms of an exhaustive count of pairs."""
    import hashlib

    from tonearm.llm.pii import personal_data

    terms, added = plain_terms(texts, threshold), 0
    for r in personal_data(docs, threshold=threshold).collect():
        spans = plain_spans(texts[r.doc_id])
        n = Counter(k for k, _, _ in spans)
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(n[k] for k in ("email", "ip", "card", "phone"))
        base = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        assert r.base_sha256 == hashlib.sha256(base.encode()).hexdigest()
        got = [(k, int(a), int(b)) for k, a, b in (s.split(":") for s in r.spans.split(",") if s)]
        assert [s for s in got if s[0] not in ("secret", "term")] == spans
        assert [s for s in got if s[0] == "secret"] == plain_secrets(texts[r.doc_id])
        assert {s for s in got if s[0] == "term"} == terms[r.doc_id]
        assert got == sorted(got, key=lambda s: s[1]) and r.n_spans == len(got)
        added += len(terms[r.doc_id])
    assert added > 0


def test_secrets():
    from tonearm.llm.pii_core import base_spans, generalised, secrets

    key = "9807b3c6a43eb78aa99cbd7049c572391524f37a8"
    for text, want in ((f"x = '{key}'", [("secret", 5, 5 + len(key))]), ("Donaudampfschifffahrtsgesellschaft2024", []), (f"{key}@mail.example.org", []), ("a1" * 9, [])):
        assert secrets(text, base_spans(text)) == want == plain_secrets(text)
    assert generalised("ab 12 cd", [(0, 2, "x"), (1, 5, "y"), (6, 8, "z")]) == "[X] [Z]"


def test_a_long_list_of_addresses():
    """Linear in the spans: minutes otherwise."""
    from tonearm.llm.pii_core import base_spans, generalised, places, secrets

    text = ", ".join(f"user{i}@host{i % 999}.example.org is number {i}" for i in range(60_000))
    spans = base_spans(text)
    assert len(spans) == 60_000 and not secrets(text, spans) and len(places(text, spans)["number"]) == 120_000
    assert generalised(text, [(a, b, k) for k, a, b in spans]).count("[EMAIL]") == 60_000


def test_disclosing_terms(spark):
    """A name beside one address in several texts reveals it; common words beside it do not, nor does a name seen once."""
    from tonearm.llm.pii import personal_data, sanitise

    rows = [(i, f"number {i} mister Zaphod writes from zb@heart.example.org about the weather today") for i in range(5)]
    rows += [(100 + i, f"number {i} someone writes from home about the weather today and mister Nobody number {i}") for i in range(60)]
    rows += [(200, "only once Trillian writes from tm@earth.example.org about things")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    out = {r.doc_id: r.spans for r in personal_data(d).collect()}
    for i in range(5):
        text = rows[i][1]
        found = [text[int(a) : int(b)] for k, a, b in (s.split(":") for s in out[i].split(",")) if k == "term"]
        assert found == ["Zaphod"]
    assert "term" not in out[200] and out[130] == ""
    clean = {r.doc_id: r.text for r in sanitise(d).collect()}
    assert clean[3] == "number 3 mister [TERM] writes from [EMAIL] about the weather today" and clean[130] == rows[35][1]


@pytest.mark.parametrize("top_words", [50, 1])
def test_language_model(docs, texts, top_words):
    import math

    from tonearm.llm.lm_scoring import language_scores

    token = lambda t: [*t.encode().lower().split(), None]
    n = Counter()
    for i, t in texts.items():
        if zlib.crc32(str(i).encode()) % 10:
            n.update(token(t))
    total, kinds = sum(n.values()), len(n)
    rows = {r.doc_id: r for r in language_scores(docs, top_words=top_words).collect()}
    for i, t in texts.items():
        want = sum(math.log10((n[w] + 0.1) / (total + 0.1 * (kinds + 1))) for w in token(t))
        r = rows[i]
        assert r.held_out == (zlib.crc32(str(i).encode()) % 10 == 0)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(token(t)), sum(n[w] > 0 for w in token(t)), total)
        assert abs(r.base_score - want) < 1e-6 * max(1, abs(want))
        assert -math.inf < r.score < 0


def plain_places(text: bytes) -> list[tuple]:
    """(context, nearest byte first, byte) of each place of a text and its end."""
    whole = b"\xff" * 5 + text + b"\xff"
    return [(tuple(whole[i - 1 : i - 6 : -1]) if i > 5 else tuple(whole[4::-1]), whole[i]) for i in range(5, len(whole))]


def plain_tree(training: list[bytes], depth: int = 5):
    """log10 of the chance of a byte after a context, by the recursive definition over every context."""
    import functools
    import math

    import numpy as np

    seen: dict = {}
    for text in training:
        for context, byte in plain_places(text):
            for d in range(depth + 1):
                for bit in range(8):
                    node = seen.setdefault((context[:d], bit, byte >> (8 - bit)), [0, 0])
                    node[byte >> (7 - bit) & 1] += 1
    children: dict = {}
    for context, bit, prefix in seen:
        if context:
            children.setdefault((context[:-1], bit, prefix), set()).add(context)

    @functools.cache
    def weighted(context, bit, prefix):
        a, b = seen[context, bit, prefix]
        own = math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)
        if len(context) == depth:
            return own, own
        return float(np.logaddexp(math.log(0.5) + own, math.log(0.5) + sum(weighted(c, bit, prefix)[0] for c in children[context, bit, prefix]))), own

    def one(context, d, bit, prefix):
        key = (context[:d], bit, prefix)
        if key not in seen:
            return 0.5
        a, b = seen[key]
        p = (b + 0.5) / (a + b + 1)
        if d == depth:
            return p
        both, own = weighted(*key)
        w = math.exp(math.log(0.5) + own - both)
        return w * p + (1 - w) * one(context, d + 1, bit, prefix)

    def chance(context, byte):
        p = [one(context, 0, bit, byte >> (8 - bit)) for bit in range(8)]
        return sum(math.log10(x if byte >> (7 - bit) & 1 else 1 - x) for bit, x in enumerate(p))

    return chance


def test_context_tree_matches_recursion():
    """Every code, seen or only to be scored, weighed in parts, against the recursive definition over all contexts."""
    import numpy as np

    from tonearm.llm import ctw_core

    training, others = [b"abab", b"abba ab", b"ba", b"", "ä\u20ac ab".encode()], [b"abz", b"q", b""]
    chance = plain_tree(training)
    some, more = ctw_core.count(training), ctw_core.count(others)
    code, n = ctw_core.summed(np.concatenate([some[0], more[0]]), np.concatenate([some[1], np.zeros(len(more[0]), np.int64)]))
    cuts = [0, *(np.flatnonzero(np.diff(code >> ctw_core.PART_BITS)) + 1), len(code)]
    parts = list(zip(cuts, cuts[1:]))
    nodes = [np.concatenate(x) for x in zip(*(ctw_core.upwards(code[a:b], n[a:b]) for a, b in parts))]
    key, at = np.unique(nodes[0], return_inverse=True)
    above = ctw_core.top(key, *(np.bincount(at, x).astype(x.dtype) for x in nodes[1:]))
    got = np.concatenate([ctw_core.downwards(code[a:b], n[a:b], above) for a, b in parts])
    known = {}
    for text in training + others:
        for (context, byte), c in zip(plain_places(text), ctw_core.codes(*ctw_core.block([text])).tolist()):
            assert abs(got[np.searchsorted(code, c)] - chance(context, byte)) < 1e-9
            known[c] = (context, byte)
    assert sorted(known) == code.tolist() and len(parts) > 5
    assert abs(sum(10 ** chance(tuple(b"baba "), x) for x in range(256)) - 1) < 1e-9


def test_table_of_codes():
    import numpy as np

    from tonearm.llm.ctw_core import Table

    rng = np.random.default_rng(2)
    code = np.unique(rng.integers(0, 1 << 48, 5000))
    value = rng.random(len(code))
    asked = rng.permutation(np.concatenate([code[::2], code[::3], rng.integers(0, 1 << 48, 3000)]))
    found, lost = Table(code[::2], value[::2]).find(asked)
    known = dict(zip(code[::2].tolist(), value[::2].tolist()))
    assert found.tolist() == [known.get(x, 0.0) for x in asked.tolist()]
    assert lost.tolist() == [i for i, x in enumerate(asked.tolist()) if x not in known]
    assert Table(code[:0], value[:0]).find(asked)[1].tolist() == list(range(len(asked)))


def test_language_model_keeps_every_context(spark, monkeypatch):
    """Scores are those of the recursion over all contexts of the training texts, whatever is sent to the tasks and however texts are chunked."""
    import random

    from tonearm.llm import lm_scoring

    rng = random.Random(8)
    rows = [(i, " ".join(rng.choice(["Rain", "falls", "on", "the", "ämne", "x"]) for _ in range(rng.randrange(12)))) for i in range(60)] + [(60, None), (61, "never \u20ac seen")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    low = {i: (t or "").encode().lower() for i, t in rows}
    chance = plain_tree([t for i, t in low.items() if zlib.crc32(str(i).encode()) % 10])
    want = {i: sum(chance(*x) for x in plain_places(t)) for i, t in low.items()}
    for most in (1 << 20, 50, 0):
        for r in lm_scoring.language_scores(docs, top_codes=most).collect():
            assert abs(r.score - want[r.doc_id]) < 1e-8
    monkeypatch.setattr(lm_scoring, "CHUNK_BYTES", 300)
    monkeypatch.setattr(lm_scoring, "HELD_CODES", 200)
    monkeypatch.setattr(lm_scoring, "PART_CODES", 20)
    for r in lm_scoring.language_scores(docs, top_codes=30).collect():
        assert abs(r.score - want[r.doc_id]) < 1e-8


def plain_tiling(text: list, item: list) -> int:
    """Words under greedy tiles, by trying every pair of places, longest first."""
    used_t, used_i, total = [False] * len(text), [False] * len(item), 0
    least = min(5, len(item))
    while True:
        best = (0, 0, 0)
        for t in range(len(text)):
            for p in range(len(item)):
                n = 0
                while t + n < len(text) and p + n < len(item) and text[t + n] == item[p + n] and not used_t[t + n] and not used_i[p + n]:
                    n += 1
                if n > best[0]:
                    best = (n, t, p)
        if best[0] < least or not best[0]:
            return total
        n, t, p = best
        used_t[t : t + n] = [True] * n
        used_i[p : p + n] = [True] * n
        total += n


@pytest.mark.parametrize("sent", [4 << 20, 0])
@pytest.mark.parametrize("kind, ids", [("string", ["b-17", "", "7"]), ("decimal(20,2)", None), ("struct<a:int,b:string>", [(1, "x"), (1, "y"), (2, None)])])
def test_items_of_any_kind_of_id(spark, sent, kind, ids):
    """Ids of items keep their type, sent or joined."""
    from decimal import Decimal

    from tonearm.llm.tiling import contaminated, decontaminate

    ids = ids or [Decimal("1.50"), Decimal("-2.00"), Decimal("0.00")]
    passages = ["one two three four five six", "seven eight nine ten eleven twelve", "never to be found in here at all"]
    bench = spark.createDataFrame([*zip(ids, passages), (None, passages[0])], f"item_id {kind}, text string")
    docs = spark.createDataFrame([("a", f"so {passages[0]} and {passages[1]}"), ("b", "nothing"), (None, passages[1])], "doc_id string, text string")
    out = contaminated(docs, bench, max_broadcast_bytes=sent)
    assert out.schema["item_id"].dataType == bench.schema["item_id"].dataType
    assert sorted((r.doc_id or "", str(r.item_id)) for r in out.collect()) == sorted((d, str(r.item_id)) for d, k in (("a", 0), ("a", 1), ("", 1)) for r in bench.where("item_id IS NOT NULL").collect() if r.text == passages[k])
    assert [r.doc_id for r in decontaminate(docs, bench, max_broadcast_bytes=sent).collect()] == ["b"]


def test_tiles_of_repeated_words():
    """Few kinds of words, so that seeds repeat, runs overlap and marks cut them."""
    import random

    import numpy as np

    from tonearm.llm.tiling import tile

    rng = random.Random(11)
    for _ in range(300):
        kinds = rng.choice([1, 2, 3])
        text = [rng.randrange(kinds) for _ in range(rng.randrange(60))]
        item = [rng.randrange(kinds) for _ in range(rng.randrange(1, 25))]
        if rng.random() < 0.5:
            at = rng.randrange(len(item))
            text = text[:20] + item[at:] + [9] + item[:at] + text[20:]
        tiles = tile(np.array(text, np.int64), np.array(item, np.int64), 5)
        assert sum(n for _, _, n in tiles) == plain_tiling(text, item)
        for t, p, n in tiles:
            assert text[t : t + n] == item[p : p + n]


def test_tiles_of_one_word_over_and_over():
    """Every window of the text meets every one of the item: as pairs these would be 10 ** 8."""
    import numpy as np

    from tonearm.llm.tiling import tile

    assert tile(np.zeros(200_000, np.int64), np.concatenate([np.zeros(500, np.int64), [7]]), 5) == [(0, 0, 500)]


def test_tiling(spark, docs, texts):
    from tonearm.llm.tiling import contaminated, tile, words_of

    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    items = {r.item_id: words_of(r.text.encode()) for r in bench.collect()}

    got = {(r.doc_id, r.item_id): r for r in contaminated(docs, bench, coverage=0.1).collect()}
    for i, text in texts.items():
        words = words_of(text.encode())
        seeds = {tuple(words[k : k + 5]) for k in range(len(words) - 4)}
        for item, own in items.items():
            if any(tuple(own[k : k + 5]) in seeds for k in range(max(0, len(own) - 4))):
                r = got[i, item]
                if len(words) < 400:
                    assert r.matched == plain_tiling(words, own)
            else:
                assert (i, item) not in got
    joined = {(r.doc_id, r.item_id): r.matched for r in contaminated(docs, bench, coverage=0.1, max_broadcast_bytes=0).collect()}
    assert joined == {k: r.matched for k, r in got.items()}
    import numpy as np

    a = np.array([1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12])
    reordered = np.concatenate([a[6:], [99], a[:6]])
    assert sum(n for _, _, n in tile(reordered, a, 5)) == 12 and len(tile(reordered, a, 5)) == 2


def test_classifiers_on_held_out_rows(spark):
    from tonearm.llm.factorisation import quality_scores
    from tonearm.llm.ordinal import toxicity

    sf = "/root/testdata/sf0.01"
    d, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    y = {r.doc_id: (r.quality, r.toxic) for r in labels.collect()}
    q = [(r.score, y[r.doc_id][0]) for r in quality_scores(d, labels).collect() if r.held_out and r.doc_id in y]
    pos, neg = [s for s, v in q if v], [s for s, v in q if not v]
    assert sum(p > n for p in pos for n in neg) >= 0.97 * len(pos) * len(neg)
    assert sum(s >= 0.3 for s in pos) >= 0.98 * len(pos)
    x = [(r.expected_severity, r.predicted, y[r.doc_id]) for r in toxicity(d, labels).collect() if r.held_out and r.doc_id in y]
    clean = [p for _, p, (_, t) in x if not t]
    toxic = [p for _, p, (g, t) in x if t and g]
    assert sum(clean) <= 0.03 * len(clean) and sum(toxic) >= 0.8 * len(toxic)


def test_ordinal_thresholds_are_shared_and_ordered():
    import numpy as np

    from tonearm.llm.ordinal import fit, severity

    rng = np.random.default_rng(0)
    n = 600
    k = rng.integers(0, 4, n)
    idx = np.concatenate([np.concatenate([np.full(g, 3), [rng.integers(5, 40)], [64]]) for g in k]).astype(np.int32)
    starts = np.concatenate([[0], np.cumsum(k + 2)[:-1]])
    val = np.ones(len(idx), np.float32)
    model = fit(starts, idx, val, k, 65)
    assert (np.diff(model["theta"]) > 0).all()
    expected, _, top = severity(model, starts, idx, val)
    assert np.corrcoef(expected, k)[0, 1] > 0.9 and (top == k).mean() > 0.8


@pytest.mark.parametrize("empty", [False, True])
def test_pipeline_of_hard_rows(spark, tmp_path, empty):
    """Nulls, empty and repeated rows, ids that repeat, and columns with clashing names go through all stages; what quality lets pass is packed."""
    import corpus_pipeline

    good = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").limit(6).collect()]
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(good)] + [(2, good[2], "en", "s", 1), (None, good[3], None, None, None), (7, None, "en", "s", None), (8, "", "en", "s", 0), (None, None, None, None, None)]
    names = ("rid", "key", "piece", "c0", "own", "spans", "part", "x")
    docs = spark.createDataFrame([(*r, *names) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} string" for n in names))
    (docs.limit(0) if empty else docs).write.parquet(str(tmp_path / "documents.parquet"))
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{SF}/{name}.parquet").write.parquet(str(tmp_path / f"{name}.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    if empty:
        assert out == []
        return
    read = spark.read.parquet(str(tmp_path / "documents.parquet"))
    kept = corpus_pipeline.quality(spark, read, str(tmp_path))
    assert kept.columns == docs.columns
    for stage in (corpus_pipeline.near_duplicates, corpus_pipeline.decontaminate, corpus_pipeline.personal_data):
        for table in (read, docs):
            assert stage(spark, table, str(tmp_path)).columns == docs.columns
    assert corpus_pipeline.place_of(read) is not None and corpus_pipeline.place_of(docs) is None
    one = corpus_pipeline.near_duplicates(spark, read, str(tmp_path)).collect()
    other = corpus_pipeline.near_duplicates(spark, docs, str(tmp_path)).collect()
    # Of the rows that share an id and a text either may stay.
    assert sorted((r.doc_id, r.text or "") for r in one) == sorted((r.doc_id, r.text or "") for r in other) and {r.doc_id for r in one} == {0, 1, 2, 3, 4, 5, 7}
    same = lambda t: sorted(map(tuple, corpus_pipeline.personal_data(spark, t, str(tmp_path)).collect()), key=repr)
    assert same(read) == same(docs) and len(same(read)) == len(rows)
    assert {r.doc_id for r in out if r.piece == 0} == {r.doc_id for r in kept.collect()} & {r.doc_id for r in one}


def test_keep_good(spark):
    """The rows that the scores keep, with all their columns; a document without words is scored like any other."""
    from tonearm.llm import factorisation

    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    scores = {r.doc_id: r.score for r in factorisation.quality_scores(docs, labels).collect()}
    kept = factorisation.keep_good(docs, labels)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, s in scores.items() if s >= 0.3}
    assert 0 < kept.count() < len(scores)


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        path = str(tmp_path / name)
        stage(spark, kept, sf).write.parquet(path)
        after = spark.read.parquet(path)
        assert after.columns == docs.columns and after.count() <= kept.count()
        kept = after
    texts = [r.text for r in kept.collect()]
    fps = {i: plain_fingerprint(t) for i, t in enumerate(texts)}
    assert len(texts) > 50 and not any("@mail" in t for t in texts)
    assert corpus_pipeline.run(spark, sf).where("piece = 0").count() == len(fps)


def test_pipeline_is_its_plain_stages(spark):
    """run() over the whole smallest table: each document kept, its text, its tokens and its pieces, from plain versions of the stages."""
    import struct

    import corpus_pipeline
    import public_tokenizers
    from tokenizers import Tokenizer

    from tonearm.llm.factorisation import quality_scores
    from tonearm.llm.tiling import words_of

    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    good = {r.doc_id for r in quality_scores(docs, labels).collect() if r.score >= 0.3}
    kept = {r.doc_id: r.text or "" for r in docs.collect() if r.doc_id in good}
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if (w := t.lower().split()) else set() for i, t in kept.items()}
    low = {i: i for i in sets}
    for a in sorted(sets):
        for b in sorted(sets):
            if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                x, y = sorted((low[a], low[b]))
                low = {i: x if c == y else c for i, c in low.items()}
    kept = {i: t for i, t in kept.items() if low[i] == i}
    items = [words_of(r.text.encode()) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]

    def leaks(text: str) -> bool:
        words = words_of(text.encode())
        seeds = {tuple(words[k : k + 5]) for k in range(len(words) - 4)}
        near = [x for x in items if x and any(tuple(x[k : k + 5]) in seeds for k in range(max(1, len(x) - 4)))]
        return any(plain_tiling(words, x) >= 0.8 * len(x) for x in near)

    kept = {i: t for i, t in kept.items() if not leaks(t)}
    terms, order = plain_terms(kept), ("email", "ip", "card", "phone", "secret", "term")
    clean = {}
    for i, text in kept.items():
        out, at = "", 0
        for kind, a, b in sorted([*plain_spans(text), *plain_secrets(text), *terms[i]], key=lambda s: (s[1], order.index(s[0]))):
            if a >= at:
                out += text[at:a] + f"[{kind.upper()}]"
            at = max(at, b)
        clean[i] = out + text[at:]
    general = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = set()
    for i, text in clean.items():
        ids = [*general.encode(text, add_special_tokens=False).ids, 2]
        first = len(ids) % 1024 or 1024
        for k, (a, b) in enumerate(zip([0, *range(first, len(ids), 1024)], [*range(first, len(ids), 1024), len(ids)])):
            want.add((i, k, a, b - a, zlib.crc32(struct.pack(f"<{b - a}I", *ids[a:b]))))
    rows = corpus_pipeline.run(spark, SF).collect()
    assert {(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows} == want and len(rows) == len(want)
    assert any(clean[i] != kept[i] for i in clean) and len(good) < docs.count()
