import os

import pytest
from pyspark.sql import functions as F

from ledgerline.bindings import view
from ledgerline.plans import catalog

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def test_whole_views_are_run(spark):
    run = lambda name: catalog.QUERIES[name](spark, SF)
    table = lambda name: view(spark, SF, name)
    assert run("asof_curve_whole").count() == table("prices").count()
    assert run("fill_merge_whole").count() == table("instruments").count()
    assert run("snapshot_diff_whole").select("company_id").distinct().count() == table("instruments").select("company_id").distinct().count()
    known, linked = ({r[0] for r in table("guarantees").select(c).distinct().collect()} for c in ("instrument_id", "guarantor_id"))
    assert {r.id for r in run("semi_join_has_guarantor_whole").collect()} == {r.id for r in table("instruments").select("id").collect()} & known
    alone = table("entities").where(F.col("company_id").isNull() | ~F.col("company_id").isin(list(linked)))
    assert {r.id for r in run("anti_join_unlinked_whole").collect()} == {r.id for r in alone.collect()}
