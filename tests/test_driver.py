"""The driver contract, and a sample of queries against their SQL on the smallest tables."""

import os
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as driver
from demandscope.plans.catalog import QUERIES

SF = Path(driver.SMOKE_DIR)
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()
SAMPLE = ["rank_movement", "popularity_lookup", "descriptor_tails", "decode_suggestions", "harvest_objects", "name_matches",
          "traffic_trend", "keyword_upsert", "hidden_terms", "verdict_replies", "overlap_pairs", "fuzzy_pairs", "niche_score"]
pytestmark = pytest.mark.skipif(not SF.exists(), reason="no driver tables here")


def test_every_query_of_the_catalog_has_sql():
    assert set(QUERIES) <= set(driver.oracle_sql()) <= set(driver.queries())


def test_entry(spark):
    assert driver.entry(spark).count() > 0


def test_entry_runs_outside_the_repository(tmp_path):
    """Python workers must not need the package on their path."""
    code = (f"import sys; sys.path.insert(0, {str(Path(driver.__file__).parent)!r})\n"
            "import __spark_entry__ as driver\n"
            "from pyspark.sql import SparkSession\n"
            "spark = SparkSession.builder.master('local[2]').config('spark.ui.enabled', 'false').getOrCreate()\n"
            "print('rows', driver.entry(spark).count())")
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    run = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True)
    assert run.returncode == 0 and int(run.stdout.split("rows ")[1]) > 0, run.stderr[-2000:]


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    expected = con.sql(driver.oracle_sql()[name])
    got = driver.queries()[name](spark, str(SF))
    columns = sorted(got.columns)
    assert columns == sorted(expected.columns)
    rounded = lambda rows: sorted(
        [tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in rows], key=repr)
    assert rounded(got.select(columns).collect()) == rounded(expected.select(*[f'"{c}"' for c in columns]).fetchall())
