"""Queries with several results look at the given tables once, and plans stay small enough for the driver."""

import pytest
from pyspark.sql import functions as F

from creelstat import sinks
from creelstat.domains import AREA_METHOD, SURVEY
from creelstat.operators import sparse
from creelstat.plans import estimate_inst
from workload import catalogue
from workload.fixtures import JULY


def plan(df):
    return df._jdf.queryExecution().toString()


@pytest.mark.parametrize("name", ["agg_total_variance_long", "agg_specific_variance_long", "job_month_log"])
def test_results_come_from_kept_tables(small, name):
    assert "FileScan" not in plan(catalogue.CATALOGUE[name](small))


@pytest.mark.parametrize("name, writer", [("sink_bundle", "write_bundle"), ("sink_annual", "write_annual")])
def test_written_tables_come_from_kept_tables(small, monkeypatch, name, writer):
    seen, write = [], getattr(sinks, writer)

    def watched(tables, path, *rest):
        seen.extend(plan(table) for table in tables.values())
        return write(tables, path, *rest)

    monkeypatch.setattr(sinks, writer, watched)
    catalogue.CATALOGUE[name](small)
    assert len(seen) == 8 and not any("FileScan" in text for text in seen)


def test_long_states_need_no_functions_of_elements(spark):
    rows = spark.createDataFrame(
        [("a", "k1", "x", "y", False, 1, 0, 2.5), ("a", "k1", "x", "y", False, 1, None, -0.0), ("a", "k2", None, None, True, 0, 0, 0.0)],
        "survey_id string, surveykey string, area string, method string, did_not_fish boolean, effort_days int, "
        "finfish_a int, finfish_b double",
    )
    states = sparse.long_states(rows, "surveykey", AREA_METHOD)
    text = plan(states)
    assert "lambdafunction" not in text and text.split("Physical Plan")[1].count("flatten") == 1
    got = {(r.surveykey, r.place): (r.total, r.counted, r.gap, r.surveyed) for r in states.collect()}
    assert got == {
        ("k1", 0): (2.0, 2.0, False, True), ("k1", 1): (2.0, 2.0, False, True), ("k1", 2): (0.0, 0.0, True, True),
        ("k1", 3): (2.5, 2.5, False, True), ("k2", 0): (1.0, 1.0, False, True),
    }
    assert sparse.long_states(rows.drop("effort_days", "finfish_a", "finfish_b").withColumn(
        "effort_days", F.lit(0)), "surveykey", AREA_METHOD).count() == 2


def test_a_job_cleans_the_registry_once(small):
    kept = []

    def keep(df):
        kept.append(plan(df))
        return df.checkpoint()

    bundle = estimate_inst([JULY], small.clean, small.modern, AREA_METHOD, keep)
    tables = [bundle.pop, bundle.sums, bundle.violations]
    assert SURVEY in tables[0].columns
    assert sum("fisher_id" in text for text in kept) == 1
