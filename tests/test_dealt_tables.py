"""Large tables are dealt by their rows, with the same results."""

from tonearm import tables
from tonearm.tables import Tables

SF = "/root/testdata/sf0.001"


def test_proposals_are_dealt_by_rows(spark, monkeypatch):
    before = sorted(map(tuple, Tables(spark, SF).suggested.collect()))
    monkeypatch.setattr(tables, "TASK_ROWS", 300)
    dealt = Tables(spark, SF).suggested
    assert sorted(map(tuple, dealt.collect())) == before and dealt.rdd.getNumPartitions() == -(-spark.read.parquet(f"{SF}/lineitem.parquet").count() // 300)


def test_coverage_is_dealt_by_rows(spark, monkeypatch):
    from tonearm.plans.reading import playlist_coverage

    before = sorted(map(tuple, playlist_coverage(Tables(spark, SF)).collect()))
    monkeypatch.setattr(tables, "TASK_ROWS", 300)
    dealt = playlist_coverage(Tables(spark, SF))
    assert sorted(map(tuple, dealt.collect())) == before and dealt.rdd.getNumPartitions() == -(-spark.read.parquet(f"{SF}/lineitem.parquet").count() // 300)
