"""Staged results, registry snapshots, gates counted as the responses are read, and the long layout."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from creelstat import sinks
from creelstat.operators import estimate as est
from creelstat.operators import sparse, strata
from creelstat.operators.intake import Intake
from creelstat.operators.quality import QualityError
from creelstat.plans import RegistrySnapshots, estimate_inst
from creelstat.domains import AREA_METHOD, PERIOD_STRATA, SURVEY, measure_cols
from tests.helpers import same_rows
from workload import catalogue
from workload.fixtures import JULY, YEAR


def test_all_tables_or_none(spark, tmp_path):
    good, bad = spark.range(3), spark.range(3).select(F.raise_error(F.lit("no")).alias("x"))
    with pytest.raises(Exception, match="no"):
        sinks.write_bundle({"a": good, "b": bad}, f"{tmp_path}/out")
    assert not any(p.name[0] != "." for p in (tmp_path / "out").iterdir())
    with pytest.raises(FileNotFoundError):
        sinks.read_bundle(spark, f"{tmp_path}/out")
    sinks.write_bundle({"a": good, "b": good}, f"{tmp_path}/out")
    assert {n: t.count() for n, t in sinks.read_bundle(spark, f"{tmp_path}/out").items()} == {"a": 3, "b": 3}
    with pytest.raises(FileExistsError, match="already exists"):
        sinks.write_bundle({"b": good}, f"{tmp_path}/out")


def test_snapshots(spark, small, tmp_path):
    snapshots = RegistrySnapshots(spark, f"{tmp_path}/registry", YEAR)
    assert snapshots.current is None and snapshots.read() is None
    snapshots.refresh(small.licence_raw, "a")
    snapshots.refresh(small.licence_raw.where("fisher_id <> 1"), "b")  # unsold licences may go
    with pytest.raises(QualityError, match="registry_regression"):
        snapshots.refresh(small.licence_raw.limit(5), "c")
    assert snapshots.current == "b" and not (tmp_path / "registry" / "c").exists()
    assert snapshots.read().where("fisher_id = 1").count() == 0


def gates(spark, rows, exclude=None):
    raw = spark.createDataFrame(rows, "surveykey string, didnotfish int, completesurvey string, area string, salmon_x string")
    intake = Intake.of("2020-07", raw, True, exclude)
    intake.watched().groupBy("area").count().checkpoint()
    return intake, sorted(((r.check, r.severity, r.key, r.detail) for r in intake.violations().collect()), key=str)


def test_gates_of_an_intake(spark):
    good = (" K1 ", 1, "Complete ", "a", "1,234")
    assert gates(spark, [good])[1] == []
    assert gates(spark, [])[1] == [("empty_input", "ERROR", "2020-07", "no rows")]
    _, found = gates(spark, [good, (None, 7, "x", "a", "2"), ("K2", 7, " Incomplete", "a", "two"), ("K3", None, "odd", "a", "")])
    assert found == [
        ("domain", "ERROR", "7", "didnotfish is not a known value"),
        ("domain", "ERROR", "odd", "completesurvey is not a known value"),
        ("domain", "ERROR", None, "didnotfish is not a known value"),
        ("incomplete_responses", "INFO", "2020-07", "2 rows of surveys not completed"),
        ("missing_key_ratio", "ERROR", "surveykey", "1 of 4"),
        ("unread_value", "ERROR", "two", "responses: salmon_x can't be read"),
    ]
    listed = spark.createDataFrame([("K2",)], "survey_access_key string")
    _, found = gates(spark, [good, ("K2", 7, "odd", "a", "2")], listed)
    assert found == [("excluded_responses", "INFO", "2020-07", "1 rows of excluded keys")]


def test_long_layout_agrees_with_the_wide_one(small):
    rows = small.modern.withColumn(SURVEY, F.lit(JULY.survey_id)).withColumn(
        "halibut_kept", F.when(F.col("salmon_chinook_kept") != 13, F.col("halibut_kept"))
    )
    registry = small.july.unionByName(small.july.where("annual_flag"))  # annual licences are listed twice
    wide = est.variance_from_cells(
        est.stratum_cells(rows, registry, "surveykey", "survey_access_key", PERIOD_STRATA, AREA_METHOD), PERIOD_STRATA, AREA_METHOD
    )
    states = sparse.long_states(rows, "surveykey", AREA_METHOD)
    table = sparse.long_cells(states, registry, "surveykey", "survey_access_key", PERIOD_STRATA, AREA_METHOD, measure_cols(rows))
    long = sparse.specific_variance(table, PERIOD_STRATA, AREA_METHOD)
    keys = [SURVEY, *PERIOD_STRATA, *AREA_METHOD]
    unpivoted = wide.unpivot(keys, measure_cols(rows), "measure", "variance").where("variance <> 0")
    shown = [F.col(c) for c in [*keys, "measure"]] + [F.round("variance", 6).alias("variance")]
    assert same_rows(long.where("variance <> 0").select(*shown), unpivoted.select(*shown))


def test_strata_sets_agree_with_single_surveys(small):
    rows = catalogue._year_responses(small)
    both = estimate_inst(catalogue.MIXED[:2], small.clean, rows.where(F.col(SURVEY).isin("2020-06", "2020-07")), AREA_METHOD)
    for period in catalogue.MIXED[:2]:
        one = estimate_inst([period], small.clean, rows.where(F.col(SURVEY) == period.survey_id), AREA_METHOD)
        own = both.summary_estimated_catch.where(F.col(SURVEY) == period.survey_id)
        places = [F.round(c, 4).alias(c) if c in catalogue.MEASURES else F.col(c) for c in own.columns]
        assert same_rows(own.select(*places), one.summary_estimated_catch.select(*places))
    assert strata.stamp_sets(strata.period_strata(strata.eligible(small.clean, catalogue.MIXED))).where(
        "strata_set = 0 AND stamp IS NOT NULL"
    ).count() == 0
    assert dt.date(2020, 6, 15) in {p.split_date for p in catalogue.MIXED}
