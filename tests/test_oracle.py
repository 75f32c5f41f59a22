"""Every query with SQL gives the SQL's rows; every other query gives rows."""

import glob
import math
import os

import duckdb
import pytest

from tonearm.plans import catalogue

SF = "/root/testdata/sf0.001"
SQL = catalogue.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


#: Queries without SQL that have no rows over the smallest tables: these must have some over the next larger ones; test_plain and test_golden compare them with known rows.
SPARSE = {"peer_ranking", "relationship_suggestions"}


def plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 6) + 0.0
    return x


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, duck, name):
    df = catalogue.queries()[name](spark, "/root/testdata/sf0.01" if name in SPARSE else SF)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    if name not in SQL:
        assert got
        return
    found = duck.execute(SQL[name])
    names = [x[0] for x in found.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    want = sorted((tuple(plain(r[i]) for i in at) for r in found.fetchall()), key=repr)
    assert got == want


@pytest.mark.parametrize("pipeline", [False, True])
def test_entry_survives_without_the_subpackage(tmp_path, pipeline):
    """With or without the file of the pipeline at the top."""
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(f"{root}/tonearm", tmp_path / "tonearm", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    if pipeline:
        (tmp_path / "corpus_pipeline.py").write_text("from tonearm.llm import simhash\n")
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(k.startswith('op1') or k == 'pipeline' for k in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})
