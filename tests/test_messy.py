"""Files as people deliver them: spaces, quotes, grouped numbers, numeric ids, other date layouts."""

import datetime as dt

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from creelstat import sinks
from creelstat.operators import quality as dq
from creelstat.operators.joins import raw_join
from creelstat.operators.registry import short_id
from creelstat.operators.responses import normalise_legacy, normalise_modern
from creelstat.sources import (
    normalise_registry, read_adjustments, read_exclude, read_labels, read_vendor_sales, unread_dates, unread_numbers,
    unread_sales,
)


def test_missing_registry_columns_stop(spark):
    df = spark.createDataFrame([("x", dt.date(2020, 1, 1))], "full_licence_id string, start_dt date")
    with pytest.raises(ValueError, match="fisher_id"):
        normalise_registry(df)


def test_date_text_is_read_whole(spark):
    texts = [" 2020-07-01 ", "7/1/2020 0:00", "2020-07-01 05:00:00", "2020-07-01T05:00:00", "01 Jul 2020", "soon", "", None]
    df = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "full_licence_id string, start_dt string")
    days = [r.start_date for r in normalise_registry(df, partial=True).orderBy("full_licence_id").collect()]
    assert days == [dt.date(2020, 7, 1)] * 5 + [None] * 3
    moved = normalise_registry(df, "+09:00", "UTC", partial=True).orderBy("full_licence_id").collect()
    assert [r.start_date for r in moved[:4]] == [dt.date(2020, 7, 1), *[dt.date(2020, 6, 30)] * 3]
    assert [tuple(r) for r in unread_dates(df).collect()] == [("start_dt", "soon")]


def test_text_files_are_trimmed_and_quotes_doubled(spark, tmp_path):
    (tmp_path / "exclude.csv").write_text(' survey_access_key , why\n K1,"said ""no"", twice"\n" K2 ",x\n')
    assert sorted(r.survey_access_key for r in read_exclude(spark, str(tmp_path / "exclude.csv")).collect()) == ["K1", "K2"]
    (tmp_path / "adj.csv").write_text("surveykey,did_not_fish\n K2, YES \n")
    assert [tuple(r) for r in read_adjustments(spark, str(tmp_path / "adj.csv")).collect()] == [("K2", True)]
    (tmp_path / "labels.csv").write_text('col_name,code,label\narea,1,"Area ""A"", north\nend"\n')
    assert read_labels(spark, str(tmp_path / "labels.csv")).first().label == 'Area "A", north\nend'
    sinks.write_csv(spark.createDataFrame([('a "b", c',)], "x string"), f"{tmp_path}/out")
    assert '"a ""b"", c"' in "".join(r.value for r in spark.read.text(f"{tmp_path}/out").collect())


def test_grouped_sales(spark, tmp_path):
    head = "resident_status,licence_type,age_category,July,June\n"
    (tmp_path / "v.csv").write_text(head + 'Resident,Annual,Adult,"1,234",many\n')
    assert read_vendor_sales(spark, str(tmp_path / "v.csv")).first().July == 1234
    bad = unread_sales(spark, str(tmp_path / "v.csv"))
    assert [tuple(r) for r in bad.collect()] == [("June", "many")]
    with pytest.raises(dq.QualityError, match="June"):
        dq.enforce(dq.unread_values(bad, "vendor sales"))


def test_numeric_ids_and_text_measures(spark, small):
    raw = small.response_raw.limit(20)
    numbered = raw.drop("surveykey").withColumn("licence_id", F.lit(12345.0))
    assert {r.licence_id for r in normalise_modern(numbered).collect()} <= {"12345"}
    measure = "salmon_chinook_kept"
    name = next(c for c in raw.columns if c.lower() == measure)
    texts = raw.withColumn(name, F.when(F.col(name) > 0, F.concat(F.lit(" "), F.col(name).cast("string"))))
    want = normalise_modern(raw.withColumn(name, F.when(F.col(name) > 0, F.col(name))))
    got = normalise_modern(texts)
    assert got.where(F.col(measure).isNull()).count() == 0
    assert got.agg(F.sum(measure)).first()[0] == want.agg(F.sum(measure)).first()[0]
    odd = spark.createDataFrame([("1",), (" x ",), ("",), (None,)], "salmon string")
    assert [tuple(r) for r in unread_numbers(odd, ["salmon"]).collect()] == [("salmon", "x")]


def test_legacy_codes_stay_whole(spark, small):
    raw = small.legacy_raw.limit(10).withColumn("Licence_ID", F.lit(77.0))
    assert {r.licence_id for r in normalise_legacy(raw).collect()} <= {"77"}


@pytest.mark.parametrize("full,short", [
    ("A-B-C-3000000000", "3000000000"), ("A-B-C-", "A-B-C-"), ("A-B-C-12-", "12"), ("A-B", "A-B"), ("A-B-C-12.5", "12"),
])
def test_short_ids(spark, full, short):
    assert spark.range(1).select(short_id(F.lit(full)).alias("s")).first().s == short


def test_sinks_write_all_or_nothing(spark, tmp_path):
    one = spark.range(1)
    sinks.write_bundle({"c": one}, str(tmp_path / "out"))
    with pytest.raises(FileExistsError, match="already exists"):
        sinks.write_bundle({"a": one, "b": one, "c": one}, str(tmp_path / "out"))
    with pytest.raises(AnalysisException):
        spark.read.parquet(f"{tmp_path}/out/a").count()


def test_raw_join_streams_the_responses(spark):
    registry = spark.createDataFrame([("K1", 1), ("K1", 2), ("K2", 3), (None, 4)], "survey_access_key string, r int")
    responses = spark.createDataFrame([("K1", 10), ("K1", 11), ("K3", 12), (None, 13)], "surveykey string, s int")
    got = sorted((tuple(r) for r in raw_join(registry, responses).collect()), key=repr)
    want = [("K1", r, s) for r in (1, 2) for s in (10, 11)] + [("K2", 3, None), (None, 4, None), ("K3", None, 12), (None, None, 13)]
    assert got == sorted(want, key=repr)
