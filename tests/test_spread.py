"""Queries that work out much for each row of a small file deal its rows out first."""

import pytest

import __spark_entry__
from lakescreen.sources.shared import spread


@pytest.mark.parametrize("query", ["visual_field_map", "passport_field_map", "validation_checks", "mrz_zone_read", "mrz_parse_td2", "ocr_shapes"])
def test_rows_of_a_small_file_are_not_one_task(spark, query):
    plan = __spark_entry__.queries()[query](spark, __spark_entry__.SMOKE_DIR)._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan


def test_spread_keeps_every_row(spark):
    df = spark.range(100, numPartitions=1)
    dealt = spread(df, "id")
    assert dealt.rdd.getNumPartitions() >= 4 and sorted(r.id for r in dealt.collect()) == list(range(100))
