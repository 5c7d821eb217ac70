"""Tables of elements are never sent whole through the driver, however small their files are."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from domspark.shared import settle, settle_large

DATA = Path("/root/testdata/sf0.001")


def planned(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_large_tables_are_merged(spark):
    rows = spark.range(100_000).select(F.lit(1).alias("page_id"), F.col("id").alias("nid"), F.lit("a").alias("tag"))
    own = lambda df: df.where("tag = 'a'").groupBy("nid").agg(F.count("*").alias("n"))
    assert "BroadcastHashJoin" in planned(settle(rows).join(own(settle(rows)), "nid"))
    assert "Broadcast" not in planned(settle_large(rows).join(own(settle_large(rows)), "nid"))


@pytest.mark.parametrize("name", ["label_names", "hop_returns"])
def test_queries_are_merged(spark, name):
    if not DATA.exists():
        pytest.skip("no tables here")
    assert "Broadcast" not in planned(entry.queries()[name](spark, str(DATA)))


def test_pages_are_parsed_once(spark, pages):
    from domspark.operators.strategies import locators, sibling_locators
    from domspark.sources.dom import nodes

    n = nodes(pages("<ul id='l'><li>a</li><li>b</li></ul><button>Go</button>"))
    assert "MapInArrow" in planned(n)
    assert "MapInArrow" not in planned(locators(n)) and locators(n).count() == 4
    assert "MapInArrow" not in planned(sibling_locators(n)) and sibling_locators(n).count() == 2


def test_paths_keep_edges_and_names_only(spark):
    if not DATA.exists():
        pytest.skip("no tables here")
    plan = planned(entry.queries()["absolute_paths"](spark, str(DATA)))
    assert "attrs" not in plan and "head" not in plan
