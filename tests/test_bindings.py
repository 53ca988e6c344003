"""The bindings of the driver's tables: what is asked for comes out the same, with less work."""

import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as driver
from demandscope.operators import popularity as P
from demandscope.plans import bindings as B, catalog

SF = driver.SMOKE_DIR
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no driver tables here")


def _rows(df):
    return sorted(map(repr, df.select(*sorted(df.columns)).collect()))


def test_lists_of_wanted_keywords_are_those_of_the_whole_table(spark):
    wanted = F.col("status") == "queued"
    whole = B.keyword_lists(spark, SF)
    assert _rows(B.keyword_lists(spark, SF, wanted)) == _rows(whole.filter(wanted))
    assert 0 < whole.filter(wanted).count() < whole.count()


def test_line_items_are_not_grouped_by_part_and_supplier_first(spark):
    plan = B.lists(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"HashAggregate\(keys=\[l_partkey#\d+L?, l_suppkey#\d+L?\]", plan)


def test_only_the_newest_month_of_keywords_is_ranked(spark, monkeypatch):
    ranked, ranking = [], B.keyword_popularity
    monkeypatch.setattr(B, "keyword_popularity", lambda rows: ranked.append(rows) or ranking(rows))
    got = catalog._popularity_of_terms(spark, SF)
    every = ranking(B.keyword_orders(spark, SF))
    newest = P.period_list(every, "WEEKLY_SUN_SAT")[-1]
    assert _rows(got) == _rows(P.newest_popularity(every, newest, "WEEKLY_SUN_SAT"))
    assert [r.period for r in ranked[0].select("period").distinct().collect()] == [newest]
