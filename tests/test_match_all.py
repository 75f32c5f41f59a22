"""The matching pipeline reads what it is given once, and works texts out once for distinct ones."""

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from tonearm.functions import text as X
from tonearm.operators import entity as E
from tonearm.tables import Tables

TRACK = "id long, title string, artist string, album string, duration_ms long, isrc string"
CODES = ("USABC2400001", "us-abc-24-00002", "US ABC 24 00002", "N/A", "", None)
WORDS = ("blue train", "blue ring", "red bolt", "cold plate")


def frames(spark):
    rows = lambda ids: spark.createDataFrame([(i, WORDS[i % 4], f"Artist {i % 3}", "Album", 1000 * (i % 5), CODES[i % 6]) for i in ids], TRACK)
    return rows(range(500, 560)), rows(range(1, 201))


def counted(rows, seen):
    def look(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    return rows.mapInArrow(look, rows.schema)


def test_rejections_are_worked_out_once(spark):
    local, tracks = frames(spark)
    rejected = spark.createDataFrame([(500 + i, j) for i in range(0, 60, 2) for j in range(1, 20)], "local_id long, track_id long")
    want = sorted(map(tuple, E.match_all(local, tracks, rejected).collect()))
    seen = spark.sparkContext.accumulator(0)
    assert sorted(map(tuple, E.match_all(local, tracks, counted(rejected, seen)).collect())) == want and {x[3] for x in want} == {"isrc", "tags"}
    assert seen.value == rejected.count()


def test_codes_are_worked_out_for_distinct_texts(spark, monkeypatch):
    local, tracks = frames(spark)
    code = {0: CODES[0], 1: "USABC2400002", 2: "USABC2400002"}
    first = lambda c: min(i for i in range(1, 201) if code.get(i % 6) == c)
    want = {(i, first(code[i % 6])) for i in range(500, 560) if i % 6 in code}
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def valid(x):
        seen.add(1)
        plain = "".join(c for c in x or "" if c.isalnum()).upper()
        return plain if len(plain) == 12 else None

    monkeypatch.setattr(X, "valid_isrc", valid)
    assert {(r.local_id, r.track_id) for r in E.match_by_code(local, tracks).collect()} == want
    # Six texts on either side; 260 rows.
    assert seen.value == 12


def test_titles_are_worked_out_for_distinct_texts(spark, monkeypatch):
    local, tracks = frames(spark)
    real, seen = X.title_identity, spark.sparkContext.accumulator(0)

    @F.udf("string")
    def passed(x):
        seen.add(1)
        return x

    want = sorted(map(tuple, E.shared_trigram_candidates(local, tracks).collect()))
    monkeypatch.setattr(X, "title_identity", lambda x: real(passed(x)))
    assert sorted(map(tuple, E.shared_trigram_candidates(local, tracks).collect())) == want and want
    assert 0 < seen.value <= 8 * len(WORDS), seen.value


FLAGS = [("A",), ("N",), ("R",), ("A", "N"), ("N", "R"), ("A", "B"), ("A", "AB"), ("N", "B"), ("N", "NA"), ("", "A"), ("", None), (None,), (None, "A"), ("N", "a"), ("A", "Z", "N"), ("0",)]


def test_states_of_proposals(spark, tmp_path):
    """The greatest flag as text decides; the plan finds it without sorting rows."""
    lines = [(1, 5 * k + 2, 0.1 * i, f) for k, flags in enumerate(FLAGS) for i, f in enumerate(flags)]
    kinds = [("l_suppkey", pa.int64()), ("l_partkey", pa.int64()), ("l_discount", pa.float64()), ("l_returnflag", pa.string())]
    pq.write_table(pa.table([pa.array(c, t) for c, (_, t) in zip(zip(*lines), kinds)], [n for n, _ in kinds]), tmp_path / "lineitem.parquet")
    rows = Tables(spark, str(tmp_path)).suggested
    greatest = [max((f for f in flags if f is not None), default=None) for flags in FLAGS]
    want = [(5, 5 * k + 2, {"A": "approved", "N": "pending"}.get(f, "rejected"), round(1 - 0.1 * (len(FLAGS[k]) - 1), 6)) for k, f in enumerate(greatest)]
    assert sorted((r.local_id, r.track_id, r.status, r.score) for r in rows.collect()) == want
    assert "SortAggregate" not in rows._jdf.queryExecution().executedPlan().toString()
