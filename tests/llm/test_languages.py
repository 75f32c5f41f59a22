"""Language mixtures against plain versions of their definitions."""

import math
import zlib
from itertools import combinations

import numpy as np
import pytest

SF = "/root/testdata/sf0.01"


def plain_grams(text: str, bits: int) -> dict[int, int]:
    """One n-gram after the other."""
    data = bytes(b if b > 127 or chr(b).isalpha() else 32 for b in text.lower().encode())
    data = b" ".join([b"", *data.split(b" "), b""]) if data.strip(b" ") else b" "
    while b"  " in data:
        data = data.replace(b"  ", b" ")
    out: dict[int, int] = {}
    for k in range(len(data) - 2):
        code = int.from_bytes(data[k : k + 3], "big")
        slot = ((code + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1) >> (64 - bits)
        out[slot] = out.get(slot, 0) + 1
    return out


TEXTS = ["", "a", " ", "Hello,   World", "été\n\n où?", "x" * 50, "1 2 3", "über 90% der Fälle" * 9, "\U0001f600 a"]


@pytest.mark.parametrize("part", [1 << 20, 7, 3])
def test_grams_of_whole_texts(monkeypatch, part):
    """Texts in parts of any size give the n-grams of the whole."""
    from tonearm.llm import languages

    monkeypatch.setattr(languages, "PART", part)
    for text in TEXTS:
        slots, n = languages.grams(text, 12)
        assert dict(zip(slots.tolist(), n.tolist())) == plain_grams(text, 12)


def plain_best(p, n):
    """Proportions of greatest likelihood by exponentiated gradient steps that halve until they rise."""
    share = np.full(p.shape[1], 1 / p.shape[1])
    like = lambda s: float(np.dot(n, np.log(p @ s)))
    rate = 1.0
    for _ in range(20_000):
        slope = p.T @ (n / (p @ share)) / n.sum()
        after = share * np.exp(rate * (slope - 1))
        after /= after.sum()
        if like(after) < like(share):
            rate /= 2
            if rate < 1e-9:
                break
        share = after
    return share, like(share)


@pytest.mark.parametrize("seed", range(12))
def test_mixture_is_that_of_all_sets(seed):
    """EM reaches the greatest likelihood, and the selected set is that of greatest penalised likelihood among all sets."""
    from tonearm.llm.languages import ORDER, expectation_maximisation, mixture

    rng = np.random.default_rng(seed)
    p = rng.dirichlet(np.full(60, 0.3), 4).T + 1e-4
    p /= p.sum(axis=0)
    true = np.array([[1, 0, 0, 0], [0.7, 0.3, 0, 0], [0.5, 0.3, 0.2, 0]][seed % 3])
    n = np.bincount(rng.choice(60, 900, p=p @ true), minlength=60)
    keep = n > 0
    p, n = p[keep], n[keep].astype(float)
    best = {}
    for size in (1, 2, 3, 4):
        for s in combinations(range(4), size):
            share, like = plain_best(p[:, s], n / ORDER)
            best[s] = like
            found = expectation_maximisation(p[:, s], n, np.full(size, 1 / size))
            assert float(np.dot(n / ORDER, np.log(p[:, s] @ found))) >= like - 1e-3
    cost = math.log(n.sum() / ORDER)
    chosen = max(best, key=lambda s: best[s] - cost * len(s))
    found, share = mixture(p, n, 1.0)
    assert set(found.tolist()) == set(chosen)
    assert abs(share.sum() - 1) < 1e-9 and (np.diff(share) <= 0).all()
    assert set(found.tolist()) == set(np.flatnonzero(true).tolist())


def crc(i) -> int:
    return zlib.crc32(str(i).encode())


def test_languages_of_held_out_documents(spark):
    from tonearm.llm import queries

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = queries.op12_languages(spark, SF)
    assert dict(out.dtypes) == {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double", "languages": "array<string>", "proportions": "array<double>"}
    got = {r.doc_id: r for r in out.collect()}
    lang = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    assert got.keys() == lang.keys()
    held = [i for i in lang if crc(i) % 3 == 1]
    assert all(got[i].held_out == (crc(i) % 3 == 1) and 0 <= got[i].score <= 1 for i in lang)
    assert sum(got[i].lang_pred == lang[i] for i in held) >= 0.99 * len(held)


def table(spark, rows):
    return spark.createDataFrame([(*r, "a", "b") for r in rows], "doc_id long, text string, lang string, held_out string, score string")


EN, FR = "the house is on the hill and the weather was fine", "la maison est sur la colline et le temps fut beau"


def test_labels_of_held_out_rows_are_not_learnt(spark):
    """Nor is anything else of them: other labels there, or none, change no score; and a text of two languages shows both."""
    from tonearm.llm.languages import identify

    rows = [(i, (EN if i % 2 else FR) + f" w{i}", "en" if i % 2 else "fr") for i in range(60)]
    rows.append((next(i for i in range(100, 200) if crc(i) % 3 == 1), " ".join([EN] * 8 + [FR] * 4), None))
    other = [(i, t, "xx" if crc(i) % 3 == 1 else lang) for i, t, lang in rows]
    one, two = (sorted(map(tuple, identify(table(spark, r)).collect())) for r in (rows, other))
    assert one == two
    mixed = next(r for r in one if r[0] >= 100)
    assert mixed[4] == ["en", "fr"] and abs(mixed[5][0] - 2 / 3) < 0.05 and mixed[2] == "en" and mixed[3] == mixed[5][0]


def test_hard_rows(spark):
    from tonearm.llm.languages import identify

    rows = [(1, None, "en"), (2, "", "en"), (3, "12 345 !? \U0001f600", "en"), (4, EN, "en"), (4, EN, "en"), (None, FR, "fr"), (6, "wort " * 400_000, "de"), (7, "漢字", None), (8, "ÿ", "fr")]
    got = {r.doc_id: r for r in identify(table(spark, rows)).collect()}
    assert len(identify(table(spark, rows)).collect()) == len(rows)
    assert [got[i].lang_pred for i in (1, 2, 3)] == ["und"] * 3 and got[1].score == 0 and got[1].languages == []
    assert got[None].held_out is False and got[7].lang_pred in ("de", "en", "fr") and got[8].lang_pred in ("de", "en", "fr")
    nothing = identify(table(spark, [(i, t, None) for i, t, _ in rows])).collect()
    assert {(r.lang_pred, r.score) for r in nothing} == {("und", 0.0)} and len(nothing) == len(rows)
    assert identify(table(spark, [])).collect() == []
    with pytest.raises(ValueError):
        identify(table(spark, [(i, EN, f"l{i}") for i in range(30)]), max_languages=3)
