"""Files in, jobs, files out."""

import datetime as dt

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from creelstat import sinks
from creelstat.operators.quality import QualityError
from creelstat.plans import JobConfig, estimate_inst, refresh_registry, run_annual, run_month
from creelstat.sources import (
    normalise_registry, read_adjustments, read_exclude, read_labels, read_registry, read_responses, read_vendor_sales,
)
from tests.helpers import same_rows
from workload.fixtures import DRAW_JULY, DRAW_YEAR, JULY, LABELS, MONTHLY, YEAR


@pytest.fixture(scope="module")
def files(small, tmp_path_factory):
    root = tmp_path_factory.mktemp("inputs")
    small.licence_raw.write.csv(f"{root}/registry", header=True)
    small.licence_draw.write.csv(f"{root}/registry_draw", header=True)
    small.response_raw.write.parquet(f"{root}/july")
    small.legacy_raw.write.parquet(f"{root}/legacy")
    small.exclude_ids.write.csv(f"{root}/exclude", header=True)
    small.vendor_wide.withColumnsRenamed({
        "resident_status": "resident.status", "licence_type": "licence.type", "age_category": "age.category",
    }).write.csv(f"{root}/vendor", header=True)
    for month in ("2020-04", "2020-07"):
        responses = small.response_year.where(F.col("survey_id") == month).drop("survey_id")
        # Halibut was not asked in April.
        responses.drop(*(["halibut_kept"] if month == "2020-04" else [])).write.parquet(f"{root}/{month}")
    return root


def config(files, output, **changes):
    settings = dict(
        year=YEAR, periods=[JULY], registry=f"{files}/registry", responses={"2020-07": f"{files}/july"},
        output=str(output), labels=LABELS,
    )
    return JobConfig(**{**settings, **changes})


def test_month_job(spark, small, files, tmp_path):
    cfg = config(files, tmp_path / "out", exclude=f"{files}/exclude")
    run_month(spark, cfg)
    written = spark.read.parquet(f"{tmp_path}/out/summary_estimated_catch")
    responses = small.modern.join(small.exclude_ids.withColumnRenamed("survey_access_key", "surveykey"), "surveykey", "left_anti")
    # The registry came from a CSV file, where the category code NA reads as missing.
    registry = small.clean.where("lic_type_cat_code <> 'NA'")
    assert same_rows(written, estimate_inst([JULY], registry, responses).summary_estimated_catch)
    log = spark.read.parquet(f"{tmp_path}/out/log")
    assert {"registry_counts", "unknown_ids", "missing_strata_cols", "missing_key_ratio"} <= {r.code for r in log.collect()}
    with pytest.raises((AnalysisException, FileExistsError), match="already exists"):
        run_month(spark, cfg)
    with pytest.raises(ValueError, match="one survey"):
        run_month(spark, config(files, tmp_path / "x", periods=MONTHLY))


def test_annual_job_skips_missing_months(spark, files, tmp_path):
    paths = {m: f"{files}/{m}" for m in ("2020-04", "2020-05", "2020-07")}
    run_annual(spark, config(files, tmp_path / "year", periods=MONTHLY, responses=paths))
    population = spark.read.parquet(f"{tmp_path}/year/licence_summary")
    assert {(r.year, r.month, r.month_id) for r in population.select("year", "month", "month_id").distinct().collect()} == {
        (2020, "April", 4), (2020, "July", 7),
    }
    log = {r.code: r for r in spark.read.parquet(f"{tmp_path}/year/log").collect()}
    assert log["missing_survey"].n == 10
    assert (log["missing_measure"]["sample"], log["missing_measure"].detail) == ("2020-04", "halibut_kept")
    totals = spark.read.parquet(f"{tmp_path}/year/summary_estimated_catch").groupBy("month").agg(F.sum("halibut_kept").alias("t"))
    got = {r.month: r.t for r in totals.collect()}
    assert got["April"] is None and got["July"] > 0
    sizes = spark.read.parquet(f"{tmp_path}/year/survey_sample_sizes")
    assert sizes.where("month = 'April' and n_halibut_kept is not null").count() == 0
    assert sizes.where("month = 'July' and n_halibut_kept is not null").count() > 0


def test_prepost_job(spark, files, tmp_path):
    cfg = config(
        files, tmp_path / "draw", year=DRAW_YEAR, periods=[DRAW_JULY], registry=f"{files}/registry_draw",
        responses={"2017-07": f"{files}/july"}, vendor_sales=f"{files}/vendor",
    )
    with pytest.raises(ValueError, match="vendor"):
        run_month(spark, config(files, tmp_path / "none", year=DRAW_YEAR, periods=[DRAW_JULY],
                                registry=f"{files}/registry_draw", responses={"2017-07": f"{files}/july"}))
    raw = read_responses(spark, f"{files}/july").withColumn("licence_id", F.regexp_replace("surveykey", "K", "")).drop("surveykey")
    raw = raw.withColumn("totaljuveniles", F.when(F.col("didnotfish") == 2, F.col("totaljuveniles")))
    raw.write.parquet(f"{tmp_path}/keyed")
    run_month(spark, JobConfig(**{**cfg.__dict__, "responses": {"2017-07": f"{tmp_path}/keyed"}}))
    got = spark.read.parquet(f"{tmp_path}/draw/summary_estimated_catch")
    assert got.where("area is not null").count() == 10


def test_job_stops_on_errors(spark, small, files, tmp_path):
    small.response_raw.withColumn("didnotfish", F.lit(3)).write.parquet(f"{tmp_path}/bad")
    with pytest.raises(QualityError, match="domain"):
        run_month(spark, config(files, tmp_path / "bad_out", responses={"2020-07": f"{tmp_path}/bad"}))
    assert spark.read.parquet(f"{tmp_path}/bad_out/violations").where("check = 'domain'").count() > 0
    with pytest.raises(ValueError, match="No survey data"):
        run_month(spark, config(files, tmp_path / "out", responses={}))


def test_registry_file(spark, small, files):
    assert same_rows(read_registry(spark, f"{files}/registry", na_is_missing=False),
                     small.registry.withColumn("lic_type_cat_code", F.nullif("lic_type_cat_code", F.lit(""))))
    missing = read_registry(spark, f"{files}/registry").where("lic_type_cat_code is null").count()
    blank = small.registry.where("lic_type_cat_code = ''").count()
    assert missing == blank + small.registry.where("lic_type_cat_code = 'NA'").count()


def test_source_zone_moves_the_day(spark):
    df = spark.createDataFrame([("x", dt.datetime(2020, 7, 1, 1, 0))], "full_licence_id string, purchase_dtt timestamp")
    assert normalise_registry(df, partial=True).first().purchase_date == dt.date(2020, 7, 1)
    assert normalise_registry(df, "+03:00", "UTC", partial=True).first().purchase_date == dt.date(2020, 6, 30)


def test_side_files(spark, tmp_path):
    (tmp_path / "exclude.csv").write_text("licence.id,why\n12,NA\n")
    assert read_exclude(spark, str(tmp_path / "exclude.csv")).first().licence_id == "12"
    (tmp_path / "wrong.csv").write_text("id\n12\n")
    with pytest.raises(ValueError, match="licence_id or survey_access_key"):
        read_exclude(spark, str(tmp_path / "wrong.csv"))
    assert read_exclude(spark, str(tmp_path / "none.csv")) is None and read_exclude(spark, None) is None
    (tmp_path / "adj.csv").write_text("SurveyKey,did_not_fish,salmon_x,,\nK1,YES,3,,\nK2,maybe,,,\n")
    adj = read_adjustments(spark, str(tmp_path / "adj.csv"))
    assert adj.columns == ["surveykey", "did_not_fish", "salmon_x"]
    assert [tuple(r) for r in adj.orderBy("surveykey").collect()] == [("K1", True, "3"), ("K2", None, None)]
    assert read_adjustments(spark, str(tmp_path / "none.csv")) is None
    (tmp_path / "labels.csv").write_text("col_name,code,label\narea,1,NA\n")
    assert tuple(read_labels(spark, str(tmp_path / "labels.csv")).first()) == ("area", 1, "NA")


def test_vendor_file(spark, small, files):
    got = read_vendor_sales(spark, f"{files}/vendor")
    assert got.columns == small.vendor_wide.columns
    total = F.sum("July").cast("long").alias("n")
    assert got.agg(total).first().n == small.vendor_wide.agg(total).first().n


def test_csv_sink_blanks_and_never_overwrites(spark, tmp_path):
    df = spark.createDataFrame([("a", None), (None, 2)], "x string, y int").coalesce(1)
    sinks.write_csv(df, f"{tmp_path}/out")
    text = next((tmp_path / "out").glob("part-*.csv")).read_text()
    assert text == "x,y\na,\n,2\n"
    with pytest.raises((AnalysisException, FileExistsError), match="already exists"):
        sinks.write_csv(df, f"{tmp_path}/out")


def test_refresh_refuses_lost_licences(spark, tmp_path):
    old = spark.createDataFrame([("a",), ("b",)], "full_licence_id string")
    new = spark.createDataFrame([("a",), ("b",), ("c",)], "full_licence_id string")
    with pytest.raises(QualityError, match="registry_regression"):
        refresh_registry(old, new, f"{tmp_path}/bad")
    assert spark.read.parquet(refresh_registry(new, old, f"{tmp_path}/good")).count() == 3
