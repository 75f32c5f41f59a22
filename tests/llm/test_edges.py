"""Every operator over nulls, empty and long texts, repeated rows, clashing column names, and empty tables."""

import pytest

LONG = "wort " * 30_000 + "ende. " + "satz eins zwei drei\n" * 2_000
NAMES = ("id", "fp", "rid", "key", "n", "h", "i", "r", "spans", "stats", "shard", "size", "score", "piece", "label", "c0", "k0", "pid", "text_key")


def tables(spark, rows):
    kinds = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` string" for n in NAMES)
    return spark.createDataFrame([(*r, *["x"] * len(NAMES)) for r in rows], kinds)


ROWS = [
    (1, "Hello there, good people of the world. Write to ann.lee@mail.example.com or +49 30 1234567.", "en", "s0", 10),
    (1, "Hello there, good people of the world. Write to ann.lee@mail.example.com or +49 30 1234567.", "en", "s0", 10),
    (2, None, "en", "s0", None),
    (3, "", None, None, 0),
    (4, LONG, "de", None, 9),
    (None, "a lone text without an id but with words enough to be hashed", "en", "s1", 5),
    (5, " \n\t ", "en", "s1", 4),
    (6, "ümläut \U0001f600 naïve 4111 1111 1111 1111 and 10.0.0.1 too", "fr", "s1", 4),
]


def operators(spark):
    import public_tokenizers

    from tonearm.llm import factorisation, lm_scoring, near_copies, ordinal, packing, pii, quality_rules, sharding, simhash, tiling

    labels = spark.createDataFrame([(1, 1, 0), (4, 0, 1), (None, 1, 1), (6, None, None), (7, 1, 0)], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(1, "good people of the world"), (1, "good people of the"), (None, "x"), (2, None), (3, ""), (4, "ende")], "item_id long, text string")
    return {
        "simhash": lambda d: simhash.near_duplicates(d),
        "keep_one": lambda d: near_copies.keep_one(d),
        "packing": lambda d: packing.pack_documents(d, public_tokenizers.path("byte_bpe_50k.json")).where("piece = 0"),
        "sharding": lambda d: sharding.shard_by_bytes(d, 3),
        "quality": lambda d: factorisation.quality_scores(d, labels),
        "toxicity": lambda d: ordinal.toxicity(d, labels),
        "pii": lambda d: pii.personal_data(d),
        "sanitise": lambda d: pii.sanitise(d),
        "rules": lambda d: quality_rules.quality_rules(d),
        "lm": lambda d: lm_scoring.language_scores(d),
        "tiling": lambda d: tiling.contaminated(d, bench),
        "tiling_joined": lambda d: tiling.contaminated(d, bench, max_broadcast_bytes=0),
        "decontaminate": lambda d: tiling.decontaminate(d, bench),
    }


COUNTS = {"keep_one": 5, "tiling": 3, "tiling_joined": 3, "decontaminate": 5}
ALL = ["simhash", "keep_one", "packing", "sharding", "quality", "toxicity", "pii", "sanitise", "rules", "lm", "tiling", "tiling_joined", "decontaminate"]


@pytest.mark.parametrize("name", ALL)
def test_hard_rows(spark, name):
    out = operators(spark)[name](tables(spark, ROWS)).collect()
    assert len(out) == COUNTS.get(name, len(ROWS))


@pytest.mark.parametrize("name", ALL)
def test_empty_table(spark, name):
    assert operators(spark)[name](tables(spark, []).limit(0)).count() == 0


@pytest.mark.parametrize("name", ["keep_one", "sanitise", "decontaminate"])
def test_columns_stay(spark, name):
    docs = tables(spark, ROWS)
    assert operators(spark)[name](docs).columns == docs.columns


def test_pages(spark):
    from tonearm.llm import warc

    rows = [(1, "http://a/ b\nc", "x" * 200, "q"), (2, None, "x" * 200, "q"), (None, "http://c", "x" * 200, "q"), (4, "http://d", None, "q"), (5, "", "", "q"), (2, None, "x" * 200, "q"), (6, "u", "x" * 99, "q"), (7, "u", "x" * 99, "q"), (8, "u", "WARC/1.1\r\n\r\n\r\n\r\n" * 20 + "é", "q")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, path string")
    for version in (1, 2):
        out = [r.asDict() for r in warc.round_trip(pages, version).collect()]
        assert len(out) == len(rows)
        big = [r for r in out if r["payload_bytes"] == 200]
        assert sorted((r["page_id"] or 0, r["record_type"]) for r in big) == [(0, "revisit"), (1, "response"), (2, "revisit"), (2, "revisit")]
        assert all(r["refers_to"] == (1 if r["record_type"] == "revisit" else None) for r in big)
        assert all(r["record_type"] == "response" for r in out if r["payload_bytes"] != 200)
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_base_failed_rules_need_no_limits(spark):
    from tonearm.llm.quality_rules import quality_rules

    out = {r.doc_id: r for r in quality_rules(tables(spark, ROWS)).collect()}
    assert out[2].n_words == 0 and not out[2].kept and out[2].base_failed
