"""Each gate on input that passes and input that does not."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from creelstat.config import LicenceYear, SurveyPeriod, calendar_frame
from creelstat.domains import MONTHS
from creelstat.operators import quality as dq
from workload.fixtures import YEAR

D = dt.date


def found(df):
    return sorted((r.severity, r.key, r.detail) for r in df.collect())


def test_domain(spark):
    df = spark.createDataFrame([(1,), (2,), (3,), (None,)], "code int")
    assert found(dq.domain(df.where("code < 3"), "code", [1, 2])) == []
    assert {r.key for r in dq.domain(df, "code", [1, 2]).collect()} == {"3", None}


def test_completion_ignores_space(spark):
    df = spark.createDataFrame([("Complete ",), (" Incomplete",)], "completesurvey string")
    assert found(dq.completion(df)) == []
    assert len(found(dq.completion(df.union(spark.createDataFrame([("Done",)], "completesurvey string"))))) == 1


def test_category_codes(spark):
    df = spark.createDataFrame([("RAA",), ("NA",), ("X2Q",)], "lic_type_cat_code string")
    assert [(k, d) for _, k, d in found(dq.category_codes(df))] == [
        ("2", "unknown code for licence type"), ("Q", "unknown code for age"), ("X", "unknown code for residency"),
    ]
    assert found(dq.category_codes(df.limit(2))) == []


def test_mixed_answers(spark):
    df = spark.createDataFrame([("a", True), ("a", True), ("b", True), ("b", False), ("c", None), ("c", True)],
                               "surveykey string, did_not_fish boolean")
    assert [k for _, k, _ in found(dq.mixed_dnf(df, "surveykey"))] == ["b", "c"]
    by_survey = df.where("surveykey = 'b'").withColumn("survey_id", F.col("did_not_fish").cast("string"))
    assert found(dq.mixed_dnf(by_survey, "surveykey")) == []


def test_mixed_missing_values(spark):
    df = spark.createDataFrame([("a", 1, None), ("a", None, None), ("b", 1, 1)],
                               "surveykey string, salmon_a int, salmon_b int")
    assert found(dq.mixed_null(df, "surveykey", ["salmon_a", "salmon_b"])) == [("ERROR", "a", "salmon_a")]
    status = {(r.surveykey, r.col_name): r.status for r in dq.unpivot_status(df, "surveykey", ["salmon_a", "salmon_b"]).collect()}
    assert status == {("a", "salmon_a"): False, ("a", "salmon_b"): True, ("b", "salmon_a"): True, ("b", "salmon_b"): True}


@pytest.mark.parametrize(("missing", "level"), [(0, None), (1, "WARNING"), (2, "ERROR")])
def test_missing_keys(spark, missing, level):
    df = spark.range(100).select(F.when(F.col("id") >= missing, F.col("id")).alias("k"))
    got = found(dq.missing_key_ratio(df, "k"))
    assert got == ([] if level is None else [(level, "k", f"{missing} of 100")])


def test_empty_input(spark):
    df = spark.range(3)
    assert found(dq.empty_input(df, "x")) == []
    assert found(dq.empty_input(df.where("id > 5"), "x")) == [("ERROR", "x", "no rows")]


def test_catch_without_area(spark):
    df = spark.createDataFrame([(None, "X", 0, None), ("A", "X", 3, 1)], "area string, stratum string, effort_days int, salmon_a int")
    assert found(dq.catch_without_area(df)) == []
    bad = df.union(spark.createDataFrame([(None, "Y", None, 2)], df.schema))
    assert found(dq.catch_without_area(bad)) == [("ERROR", "Y", "2")]


def test_sample_sizes_must_be_positive(spark):
    cells = spark.createDataFrame([("X",), ("X",), ("Y",), (None,)], "stratum string")
    sizes = spark.createDataFrame([("X", 2, 0), (None, 1, 1), ("Z", 0, 0)], "stratum string, n_salmon_a long, n_salmon_b long")
    got = found(dq.nonpositive_sample(cells, sizes, ["stratum"], ["salmon_a", "salmon_b"]))
    assert [(k, d) for _, k, d in got] == [("X", "salmon_b"), ("Y", "salmon_a"), ("Y", "salmon_b")]


def test_unknown_and_lost_ids(spark):
    a = spark.createDataFrame([("a",), ("b",), ("b",), (None,)], "full_licence_id string")
    b = spark.createDataFrame([("a",), (None,)], "full_licence_id string")
    assert found(dq.unknown_ids(a, b, "full_licence_id")) == [("WARNING", "b", "not in the registry")]
    assert [k for _, k, _ in found(dq.registry_regression(a, b))] == ["b"]
    assert found(dq.registry_regression(b, a)) == []


def test_registry_counts(small):
    got = {r.key: int(r.detail) for r in dq.registry_counts(small.registry, YEAR).collect()}
    assert got["kept"] == small.clean.count() == 1401
    assert got["unsold"] == 16
    assert got["start_date_fixed"] + got["start_date_unfixable"] == 30


def test_duplicates(spark):
    df = spark.createDataFrame([("1", "X"), ("1", "X"), ("1", "Y"), ("2", "X")], "licence_id string, stratum string")
    assert found(dq.duplicate_licences(df, "licence_id", ["stratum"])) == [("INFO", "licence_id", "1")]
    assert found(dq.duplicate_licences(df.distinct(), "licence_id", ["stratum"])) == []


def test_calendar_gates(spark):
    july = SurveyPeriod.month_from(D(2020, 7, 1), period_stratify=True, split_date=D(2020, 6, 1))
    good = calendar_frame(spark, YEAR, [july])
    assert found(dq.period_same_month(good)) == found(dq.split_date_in_year(good)) == []
    periods = [
        SurveyPeriod("a", D(2020, 7, 1), D(2020, 8, 1), True, D(2020, 3, 31)),
        SurveyPeriod("b", D(2020, 8, 1), D(2020, 8, 31), True, D(2021, 4, 1)),
        SurveyPeriod("c", D(2020, 9, 1), D(2020, 9, 30), False, D(2020, 9, 1)),
    ]
    bad = calendar_frame(spark, YEAR, periods)
    assert [k for _, k, _ in found(dq.period_same_month(bad))] == ["a"]
    assert [k for _, k, _ in found(dq.split_date_in_year(bad))] == ["a", "b", "c"]


def test_vendor_gates(spark):
    row = ("Resident", "Annual", "Senior (65+)", *[0] * 12)
    schema = "resident_status string, licence_type string, age_category string, " + ", ".join(f"{m} int" for m in MONTHS)
    df = spark.createDataFrame([row], schema)
    assert found(dq.vendor_domains(df)) == found(dq.vendor_months(df, "July", YEAR)) == []
    old = LicenceYear.ending(D(2014, 3, 31))
    assert [k for _, k, _ in found(dq.vendor_months(df, "July", old))] == ["July"]
    assert found(dq.vendor_months(df.withColumn("July", F.lit(3)), "July", old)) == []
    assert found(dq.vendor_months(df.withColumnRenamed("May", "Sum"), "July", YEAR)) == [
        ("ERROR", "May", "month missing"), ("ERROR", "Sum", "not a month"),
    ]
    assert len(found(dq.vendor_domains(df.withColumn("licence_type", F.lit("Weekly"))))) == 1


def test_missing_columns(spark):
    df = spark.createDataFrame([("Area 1", "Boat")], "area string, method string")
    assert [k for _, k, _ in found(dq.missing_strata_cols(df, ["area", "lodge"]))] == ["lodge"]
    assert found(dq.missing_strata_cols(df, ["area"])) == []


def test_period_outside(spark):
    rows = [("L1", "1", D(2017, 6, 1), D(2017, 6, 3)), ("L2", "2", D(2017, 6, 1), D(2017, 6, 3)), ("L3", "3", D(2017, 7, 1), D(2017, 7, 1))]
    licences = spark.createDataFrame(rows, "full_licence_id string, licence_id string, start_date date, end_date date")
    licences = licences.withColumns({"survey_start": F.lit(D(2017, 7, 1)), "survey_end": F.lit(D(2017, 7, 31))})
    responses = spark.createDataFrame([("1",), ("3",)], "licence_id string")
    assert [k for _, k, _ in found(dq.period_outside(licences, responses))] == ["L1"]


def test_sample_text(spark):
    df = spark.range(25).select(F.lit("g").alias("g"), F.format_string("%02d", F.col("id")).alias("v"))
    row = dq.sample_text(df.union(df), ["g"], "v", 3, ",").first()
    assert (row.n_values, row["sample"]) == (25, "00,01,02,...+22 more...")
    assert dq.sample_text(df.limit(2), ["g"], "v", 3, ",").first()["sample"] == "00,01"


def test_diagnostics_and_enforce(spark):
    warn = dq.message(spark, "missing_survey", dq.WARNING, "2020-05", "no survey data")
    dq.enforce(warn)
    bad = dq.domain(spark.createDataFrame([("x",)], "a string"), "a", ["y"])
    log = {(r.severity, r.code): (r.n, r["sample"]) for r in dq.diagnostics(warn, bad).collect()}
    assert log == {("WARNING", "missing_survey"): (1, "2020-05"), ("ERROR", "domain"): (1, "x")}
    with pytest.raises(dq.QualityError, match="domain: x"):
        dq.enforce(bad)
