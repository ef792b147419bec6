"""Row-level rules: missing values, dates, text and casts."""

import datetime as dt

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from creelstat.config import LicenceYear, SurveyPeriod, licence_year_label, months_of, shift_months
from creelstat.domains import measure_cols, sample_cols
from creelstat.functions import ascii_fold, parse_date, strip, yes_no
from creelstat.functions.conform import conform, to_integer, to_logical
from creelstat.operators import estimate as est
from creelstat.operators import joins, registry, strata, vendor
from creelstat.operators import responses as resp
from tests.helpers import table

D = dt.date
YEAR = LicenceYear.ending(D(2021, 3, 31))


def values(df):
    return [r[0] for r in df.collect()]


def one(spark, schema, rows, expr):
    return values(spark.createDataFrame(rows, schema).coalesce(1).select(expr))


def test_full_join_matches_null_keys(spark):
    a = spark.createDataFrame([(None, "Boat", 1), ("A", "Boat", 2)], "area string, method string, x int")
    b = spark.createDataFrame([(None, "Boat", 5), ("B", None, 6)], "area string, method string, y int")
    got = {(r.area, r.method): (r.x, r.y) for r in joins.full_join_ns(a, b, ["area", "method"]).collect()}
    assert got == {(None, "Boat"): (1, 5), ("A", "Boat"): (2, None), ("B", None): (None, 6)}


def test_sum_of_missing_is_zero(spark):
    df = spark.createDataFrame([("s", None), ("s", None)], "k string, salmon_x int")
    assert est.respondent_sums(df, "k", [], []).first().salmon_x == 0


def test_variance_of_one_is_null_and_zero_size_is_safe(spark):
    expr = F.expr(est.padded_variance("k", "m", "v", "n"))
    rows = [(1, 3.0, 0.0, 1), (1, 3.0, 0.0, 0), (1, 3.0, 0.0, None), (1, 4.0, 0.0, 2)]
    assert one(spark, "k long, m double, v double, n long", rows, expr) == [None, None, None, 8.0]


def test_start_date_repair(spark):
    rows = [
        (D(2018, 1, 1), D(2020, 7, 5), "R5A", 2020), (D(2018, 1, 1), D(2021, 3, 31), "RAA", 2020),
        (D(2020, 7, 5), D(2020, 7, 9), "R5A", 2020), (None, D(2020, 7, 9), "R5A", 2020),
    ]
    df = spark.createDataFrame(rows, "start_date date, expiry_date date, lic_type_cat_code string, lic_year int")
    got = values(registry.fix_start(df.coalesce(1)).select("start_date"))
    assert got == [D(2020, 7, 1), D(2021, 4, 1), D(2020, 7, 5), None]


def test_short_id_and_term(spark):
    ids = [("BC-20-S-00012",), ("77",), ("a-b-c",), ("BC-20-S-xx",)]
    assert one(spark, "i string", ids, registry.short_id(F.col("i"))) == ["12", "77", "a-b-c", None]
    codes = [("R5A",), ("RA",), ("",), (None,)]
    assert one(spark, "c string", codes, registry.term_length(F.col("c"))) == [5, None, None, None]


def test_purchase_and_stamp_dates(spark):
    rows = [(D(2020, 2, 29), D(2020, 2, 29), D(2020, 5, 1)), (D(2020, 3, 1), D(2021, 3, 31), D(2020, 5, 1)),
            (None, None, D(2020, 5, 1))]
    df = spark.createDataFrame(rows, "purchase_date date, stamp_purchase_date date, start_date date").coalesce(1)
    assert values(registry.clean_purchase(df, YEAR).select("purchase_date")) == [None, D(2020, 3, 1), None]
    assert values(registry.clean_stamp(df, YEAR).select("stamp_purchase_date")) == [D(2020, 5, 1), D(2021, 3, 31), None]
    assert values(registry.effective_start(df).select("start_date")) == [D(2020, 5, 1)] * 3


def test_unsold_drops_missing_fisher(spark):
    df = spark.createDataFrame([(1,), (2,), (None,)], "fisher_id long")
    assert values(registry.drop_unsold(df)) == [2]


def test_category_na_is_a_code(spark):
    df = spark.createDataFrame([("NA",), ("R3S",), ("X1Q",), ("FAA",), ("",), (None,)], "lic_type_cat_code string")
    got = [tuple(r) for r in registry.decode_category(registry.drop_blank_family(df.coalesce(1))).collect()]
    assert got == [
        ("NA", "Non-Resident", "All Ages above 15 (Pacific)", "Annual", True),
        ("R3S", "Resident", "Senior (65+)", "3 Days", False), ("X1Q", None, None, "1 Day", False),
    ]


def test_end_dates(spark):
    rows = [("Annual",), ("5 Days",), ("3 Days",), ("1 Day",), (None,)]
    df = spark.createDataFrame(rows, "licence_type string").withColumn("start_date", F.lit(D(2020, 7, 30))).coalesce(1)
    got = values(registry.end_date(df, YEAR).select("end_date"))
    assert got == [D(2021, 3, 31), D(2020, 8, 3), D(2020, 8, 1), D(2020, 7, 30), None]


def _licences(spark, rows):
    return spark.createDataFrame(
        rows, "id string, licence_type string, annual_flag boolean, start_date date, end_date date, "
              "stamp_purchase_date date"
    ).coalesce(1)


def test_stamp_draw_and_period(spark):
    df = _licences(spark, [
        ("a", "Annual", True, D(2020, 7, 31), D(2021, 3, 31), D(2020, 7, 31)),
        ("b", "Annual", True, D(2020, 7, 1), D(2021, 3, 31), D(2020, 7, 30)),
        ("c", "5 Days", False, D(2020, 6, 28), D(2020, 7, 2), D(2020, 7, 31)),
        ("d", "1 Day", False, D(2020, 8, 1), D(2020, 8, 1), None),
        ("e", "Annual", True, None, D(2021, 3, 31), None),
    ])
    d1, d2 = D(2020, 7, 1), D(2020, 7, 31)
    assert values(strata.stamp_flag(df, d2).select("stamp")) == [False, True, True, False, False]
    assert values(strata.draw_type(df, d1, d2).select("draw_type")) == ["Pre", "Post", "Post", None, None]
    def periods(on, split=None):
        return values(strata.purchase_period(df, d1, d2, on, split).select("purchase_period"))
    assert periods(True) == ["Pre-Survey", "In Survey", "Not Specified", "Not Specified", "Pre-Survey"]
    assert periods(True, D(2020, 8, 1)) == ["Early Season", "In Survey"] + ["Not Specified"] * 3
    assert periods(True, D(2020, 7, 31))[0] == "Late Season"
    assert periods(False) == ["Not Specified"] * 5


def test_eligibility_by_era(spark):
    rows = [
        ("a", "Annual", True, D(2020, 7, 31), D(2021, 3, 31), None),
        ("b", "Annual", True, D(2020, 7, 30), D(2021, 3, 31), None),
        ("c", "5 Days", False, D(2020, 7, 29), D(2020, 8, 2), None),
        ("d", "5 Days", False, D(2020, 7, 30), D(2020, 8, 3), None),
        ("e", "1 Day", False, D(2020, 5, 1), D(2020, 5, 1), None),
        ("f", "1 Day", False, D(2020, 8, 1), D(2020, 8, 1), None),
    ]
    july = SurveyPeriod.month_from(D(2020, 7, 1))
    got = strata.eligible(_licences(spark, rows), [july])
    assert values(got.select("id")) == ["b", "c"]
    shifted = [(*r[:3], r[3].replace(year=2017), r[4].replace(year=r[4].year - 3), None) for r in rows]
    old = strata.eligible(_licences(spark, shifted), [SurveyPeriod.month_from(D(2017, 7, 1))])
    assert values(old.select("id")) == ["b", "c", "d", "e"]


def test_collapse_age_needs_sales(spark):
    df = spark.createDataFrame(
        [("Non-Resident", "Annual", "Senior (65+)"), ("Resident", "Annual", "Senior (65+)")],
        "resident_status string, licence_type string, age_category string",
    )
    def ages(sold):
        sales = spark.createDataFrame(
            [("Non-Resident", "Annual", "All Ages above 15 (Pacific)", sold)],
            "resident_status string, licence_type string, age_category string, month_total double",
        )
        return sorted(values(strata.collapse_age(df, sales).select("age_category")))
    assert ages(3.0) == ["All Ages above 15 (Pacific)", "Senior (65+)"]
    assert ages(0.0) == ages(None) == ["Senior (65+)", "Senior (65+)"]


def test_exclusion_keeps_null_keys(spark):
    df = spark.createDataFrame([("a",), ("b",), (None,)], "surveykey string")
    exclude = spark.createDataFrame([("b",), (None,)], "survey_access_key string")
    assert sorted(values(joins.drop_excluded(df, exclude, "surveykey")), key=str) == [None, "a"]
    assert joins.drop_excluded(df, None, "surveykey") is df


def test_casts(spark):
    texts = [("3.9",), ("abc",), ("-2",), (None,)]
    assert one(spark, "x string", texts, to_integer(F.col("x"))) == [3, None, -2, None]
    flags = [("yes",), ("TRUE",), ("f",), ("False",), ("T",)]
    assert one(spark, "x string", flags, to_logical(F.col("x"))) == [None, True, None, False, True]
    df = spark.createDataFrame([("1.5", "2", "T", "13/07/2020", 7)], "a string, b string, c string, d string, e int")
    got = conform(df, T._parse_datatype_string("a double, b int, c boolean, d date, e string, other int"))
    assert tuple(got.first()) == (1.5, 2, True, D(2020, 7, 13), "7")
    with pytest.raises(TypeError, match="decimal"):
        conform(df, T._parse_datatype_string("a decimal(10,2)"))


def test_dates_in_any_layout(spark):
    texts = ["2020-07-13", "20200713", "7/13/2020", "13/07/2020", "13-Jul-2020", "13 july 2020", "13JUL20", "soon", None]
    got = one(spark, "x string", [(t,) for t in texts[:6] + texts[7:]], parse_date(F.col("x")))
    assert got == [D(2020, 7, 13)] * 6 + [None, None]
    assert one(spark, "x string", [("03/04/2020",)], parse_date(F.col("x"))) == [D(2020, 3, 4)]


def test_text(spark):
    assert one(spark, "x string", [("\t a b \n",)], strip(F.col("x"))) == ["a b"]
    assert one(spark, "x string", [("Æsir Łódź naïve straße é",)], ascii_fold(F.col("x"))) == ["AEsir Lodz naive strasse e"]
    assert one(spark, "x boolean", [(True,), (False,), (None,)], yes_no(F.col("x"))) == ["yes", "no", None]


def test_calendar_parameters():
    assert licence_year_label(2008) == "2008-9" and licence_year_label(2099) == "2099-0"
    assert LicenceYear(D(2020, 4, 1), D(2021, 3, 31)) == YEAR and YEAR.sales_open == D(2020, 3, 1)
    assert shift_months(D(2020, 3, 31), -1) == D(2020, 2, 29)
    months = months_of(YEAR)
    assert [m.month_name for m in months][:2] == ["April", "May"] and months[-1].end == D(2021, 3, 31)
    assert SurveyPeriod.month_from(D(2018, 3, 1)).instant_selection is False
    assert SurveyPeriod.month_from(D(2018, 4, 1)).instant_selection is True
    assert SurveyPeriod.month_from(D(2015, 6, 1)).modern_responses is False


def test_vendor_month_order():
    assert vendor.months_before("April", YEAR) == []
    assert vendor.months_before("June", YEAR) == ["April", "May"]
    assert len(vendor.months_before("March", YEAR)) == 11
    december = LicenceYear.ending(D(2020, 12, 31))
    assert vendor.months_before("February", december) == ["January"]


def test_measure_names(spark):
    df = spark.createDataFrame([], "area string, effort_days_x int, salmon_a int, n_salmon_a int, xsalmon_b int")
    assert measure_cols(df) == ["effort_days_x", "salmon_a"] and sample_cols(df) == ["n_salmon_a"]


def test_modern_layout(spark):
    raw = spark.createDataFrame(
        [(" K1. ", 2, "Complete ", " Area 1", "", 1, None, None, 3), ("K2", 1, "Incomplete", "", "", 1, 1, 1, 1),
         (None, 2, "Complete", "", "", 1, 1, 1, 1), ("K3", 1, "Complete", "\t", "Boat", 9, 2, None, None)],
        "SurveyKey string, DIDNOTFISH int, completesurvey string, area string, method string, fishedfromlodge int, "
        "fishedwithguide int, totaljuveniles int, Salmon_x int",
    )
    got = resp.normalise_modern(raw, {"lodge": {1: "Yes"}, "guided": {2: "No"}})
    assert got.columns == ["surveykey", "did_not_fish", "area", "method", "lodge", "guided",
                           "effort_days", "juv_effort_days", "salmon_x"]
    assert sorted(tuple(r) for r in got.collect()) == [
        ("K1.", False, "Area 1", None, "Yes", "Unspecified", 1, 0, 3),
        ("K3", True, None, "Boat", "9", "No", 0, 0, 0),
    ]
    with pytest.raises(ValueError, match="key column"):
        resp.normalise_modern(raw.drop("SurveyKey"))


def test_licence_ids_lose_their_dots(spark):
    df = spark.createDataFrame([(" 12.34 ",), (None,)], "licence_id string")
    assert values(resp.clean_key(df, "licence_id")) == ["1234"]


def test_labels_from_table_or_mapping_agree(spark, small):
    rows = small.response_raw.select(F.col("fishedfromlodge").alias("lodge"), F.col("fishedwithguide").alias("guided"))
    mapping = {"lodge": {1: "Yes", 2: "No"}, "guided": {1: "Yes", 2: "No"}}
    a = resp.decode_labels(rows, small.label_codes, ["lodge", "guided"], "Unspecified")
    b = resp.decode_labels(rows, mapping, ["lodge", "guided"], "Unspecified")
    assert table(a.groupBy("lodge", "guided").count()) == table(b.groupBy("lodge", "guided").count())


def test_adjustments_replace_whole_keys_and_again_change_nothing(spark, small):
    once = resp.apply_adjustments(small.modern, small.adjustments)
    twice = resp.apply_adjustments(once.drop("datefished"), small.adjustments)
    assert table(once.groupBy(*once.columns).count()) == table(twice.select(*once.columns).groupBy(*once.columns).count())
    assert resp.apply_adjustments(small.modern, None) is small.modern


def test_null_key_adjustment_replaces_null_keys(spark):
    base = spark.createDataFrame([(None, 1), ("a", 2)], "surveykey string, salmon_x int")
    adjusted = spark.createDataFrame([(None, 9)], "surveykey string, salmon_x int")
    assert sorted(r.salmon_x for r in joins.replace_by_key(base, adjusted, "surveykey").collect()) == [2, 9]


def test_id_lists_and_templates(spark, small):
    ids = resp.parse_ids(spark.createDataFrame([("K2, K5  K8,",), (" K2 ",), ("",), (None,)], "t string"), "t")
    assert sorted(values(ids)) == ["K2", "K5", "K8"]
    assert resp.adjustment_template(small.modern, None).count() == 0
    got = resp.adjustment_template(small.modern, ids)
    assert {r.surveykey for r in got.collect()} <= {"K2", "K5", "K8"}


def test_raw_join_keeps_everything(spark):
    reg = spark.createDataFrame([("L1", "a"), ("L2", None), ("L3", "b")], "id string, survey_access_key string")
    res = spark.createDataFrame([("a", 1), ("a", 2), (None, 3), ("z", 4)], "surveykey string, x int")
    got = sorted(((r.id, r.survey_access_key, r.x) for r in joins.raw_join(reg, res).collect()), key=str)
    want = [("L1", "a", 1), ("L1", "a", 2), ("L2", None, None), ("L3", "b", None), (None, "z", 4), (None, None, 3)]
    assert got == sorted(want, key=str)
    paired = joins.raw_join(reg, res, null_keys=True).where("id = 'L2'").first()
    assert paired.x == 3
    assert [r.null_keys for r in joins.null_key_counts(reg, res).collect()] == [1, 1]
