"""Estimates against plain Python, and properties they must have."""

import datetime as dt
import random
import statistics
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from creelstat.config import LicenceYear, SurveyPeriod, months_of
from creelstat.operators import estimate as est
from creelstat.operators import joins, strata
from creelstat.plans import estimate_inst, estimate_prepost
from tests.helpers import same_rows, table
from workload import catalogue as cat
from workload.fixtures import DRAW_JULY, DRAW_YEAR, JULY, MONTHLY, Fixture

AM = ["area", "method"]
STRATA = ["stratum"]
REGISTRY = "survey_id string, licence_id string, key string, stratum string"
RESPONSES = (
    "survey_id string, key string, did_not_fish boolean, area string, method string, effort_days int, salmon_a int, "
    "halibut_b double"
)


def hand_made(spark, hot=0):
    """Two strata with responses, one without; a key listed twice, one unknown, one partly missing."""
    registry = [
        ("s", "1", "a", "X"), ("s", "2", "b", "X"), ("s", "3", "c", "X"), ("s", "4", None, "X"), ("s", "5", "d", "Y"),
        ("s", "6", "e", "Y"), ("s", "7", "d", "Y"), ("s", "8", "d", "X"), ("s", "9", None, "Z"), ("s", "9", None, "Z"),
    ]
    responses = [
        ("s", "a", False, "A1", "Boat", 1, 3, 1.5), ("s", "a", False, "A1", "Boat", 1, 4, 0.0),
        ("s", "a", False, "A2", "Shore", 1, 1, 2.0), ("s", "b", True, None, None, 0, 0, 0.0),
        ("s", "c", False, "A1", "Boat", 1, None, 4.0), ("s", "d", False, "A2", "Boat", 1, 7, 1.0),
        ("s", "e", None, "A2", "Boat", 0, 2, 1.0), ("s", "zz", False, "A1", "Boat", 1, 9, 9.0),
    ]
    responses += [("s", "a", False, "A1", "Boat", 1, 1, 0.5)] * hot
    return spark.createDataFrame(registry, REGISTRY), spark.createDataFrame(responses, RESPONSES)


def by_hand(registry, responses, measures):
    """Sample sizes, cell sums and zero-padded variances, evaluated row by row."""
    members = [(r.key, r.stratum) for r in registry.collect() if r.key is not None]
    rows = [(k, s, x) for x in responses.collect() for k, s in members if k == x.key]
    surveyed = defaultdict(lambda: defaultdict(list))
    totals, sums = defaultdict(lambda: defaultdict(lambda: defaultdict(float))), defaultdict(lambda: defaultdict(float))
    for k, s, x in rows:
        if (x.effort_days or 0) > 0 or x.did_not_fish:
            surveyed[s][k].append(x)
        for m in measures:
            totals[s, x.area, x.method][m][k] += x[m] or 0
            if x.did_not_fish is not None:
                sums[s, x.area, x.method][m] += x[m] or 0
    n = {s: {m: sum(all(x[m] is not None for x in xs) for xs in keys.values()) for m in measures} for s, keys in surveyed.items()}
    variance = {}
    for cell, per in totals.items():
        variance[cell] = {}
        for m in measures:
            size, known = n.get(cell[0], {}).get(m, 0), list(per[m].values())
            if size < 2:
                variance[cell][m] = None
                continue
            mean = sum(known) / size
            squares = sum((v - mean) ** 2 for v in known) + (size - len(known)) * mean ** 2
            variance[cell][m] = squares / (size - 1)
    return n, sums, variance


MEASURES = ["effort_days", "salmon_a", "halibut_b"]


@pytest.mark.parametrize("hot", [0, 4000])
def test_one_pass_against_plain_python(spark, hot):
    registry, responses = hand_made(spark, hot)
    n, sums, variance = by_hand(registry, responses, MEASURES)
    cells = est.stratum_cells(responses, registry, "key", "key", STRATA, AM).cache()
    spread = {(r.stratum, r.area, r.method): r for r in est.variance_from_cells(cells, STRATA, AM).collect()}
    assert set(spread) == set(variance)
    for cell, expected in variance.items():
        for m in MEASURES:
            got = spread[cell][m]
            assert got == expected[m] or got == pytest.approx(expected[m], rel=1e-12)
    pop = est.population(registry, "licence_id", STRATA)
    full = est.full_from_cells(cells, pop, STRATA, AM).collect()
    assert {(r.stratum, r.area, r.method) for r in full} == set(sums) | {("Z", None, None)}
    for r in full:
        if r.stratum != "Z":
            assert [r[f"n_{m}"] for m in MEASURES] == [n[r.stratum][m] for m in MEASURES]
            assert [r[m] for m in MEASURES] == pytest.approx([sums[r.stratum, r.area, r.method][m] for m in MEASURES])
        else:
            assert (r.lic_total, r.n_salmon_a, r.salmon_a) == (1, None, None)


@pytest.mark.parametrize("seed", [1, 2])
def test_one_pass_on_random_data(spark, seed):
    draw = random.Random(seed)
    pick = draw.choice
    registry = spark.createDataFrame(
        [("s", str(draw.randrange(60)), pick([None, *"abcdefghij"]), pick(["X", "Y", "Z", None])) for _ in range(60)], REGISTRY
    )
    responses = spark.createDataFrame([
        ("s", pick("aaaaabcdefghijklm"), pick([True, False, False, None]), pick(["A", "B", None]), pick(["Boat", None]),
         pick([0, 1, 1, None]), pick([None, *range(9)]), pick([None, 0.0, 1.5, 2.25])) for _ in range(200)
    ], RESPONSES)
    n, sums, variance = by_hand(registry, responses, MEASURES)
    cells = est.stratum_cells(responses, registry, "key", "key", STRATA, AM)
    spread = {(r.stratum, r.area, r.method): r for r in est.variance_from_cells(cells, STRATA, AM).collect()}
    assert set(spread) == set(variance)
    for cell, expected in variance.items():
        for m in MEASURES:
            assert spread[cell][m] == expected[m] or spread[cell][m] == pytest.approx(expected[m], rel=1e-9)
    pop = est.population(registry, "licence_id", STRATA)
    full = est.full_from_cells(cells, pop, STRATA, AM).collect()
    got = {(r.stratum, r.area, r.method): [r[m] for m in MEASURES] for r in full if r.salmon_a is not None}
    assert set(got) == set(sums)
    for cell, values in got.items():
        assert values == pytest.approx([sums[cell][m] for m in MEASURES])
    for r in full:
        if r.stratum in n:
            assert [r[f"n_{m}"] for m in MEASURES] == [n[r.stratum][m] for m in MEASURES]


@pytest.mark.parametrize("hot", [0, 4000])
def test_one_pass_equals_single_steps(spark, hot):
    registry, responses = hand_made(spark, hot)
    joined = responses.join(registry.select("survey_id", "key", "stratum"), ["survey_id", "key"])
    sizes = est.sample_sizes(joined, "key", STRATA)
    spread = est.specific_variance(est.respondent_sums(joined, "key", STRATA, AM), sizes, STRATA, AM)
    pop = est.population(registry, "licence_id", STRATA)
    full = est.survey_full(pop, est.cell_sums(joined, STRATA, AM), sizes, STRATA)
    cells = est.stratum_cells(responses, registry, "key", "key", STRATA, AM)
    assert same_rows(est.full_from_cells(cells, pop, STRATA, AM).select(*full.columns), full)
    assert same_rows(est.variance_from_cells(cells, STRATA, AM), spread)
    assert same_rows(est.total_from_cells(cells, pop, STRATA, AM), est.total_variance(spread, sizes, pop, STRATA, AM))
    from_full = est.survey_sample_sizes(full)
    assert same_rows(est.total_variance(spread, from_full, pop, STRATA, AM), est.total_variance(spread, sizes, pop, STRATA, AM))


def test_variance_is_that_of_the_padded_sample(spark):
    values, n = [3, 5, 0, 9], 11
    df = spark.createDataFrame([(v,) for v in values], "x int")
    kernel = F.expr(est.padded_variance("count(*)", "avg(x)", "var_pop(x)", str(n)))
    assert df.agg(kernel.alias("v")).first().v == pytest.approx(statistics.variance(values + [0] * (n - len(values))))


def test_zero_respondents_equal_a_larger_sample(spark):
    df = spark.createDataFrame([(3,), (5,), (0,), (0,)], "x int")
    kernel = F.expr(est.padded_variance("count(*)", "avg(x)", "var_pop(x)", "6"))
    assert df.agg(kernel.alias("v")).first().v == pytest.approx(df.where("x > 0").agg(kernel.alias("v")).first().v)


def test_census_has_no_variance(spark):
    registry = spark.createDataFrame([("s", str(i), f"k{i}", "X") for i in range(5)], REGISTRY)
    responses = spark.createDataFrame([("s", f"k{i}", False, "A", "Boat", 1, i, 1.0) for i in range(5)], RESPONSES)
    cells = est.stratum_cells(responses, registry, "key", "key", STRATA, AM)
    pop = est.population(registry, "licence_id", STRATA)
    row = est.total_from_cells(cells, pop, STRATA, AM).first()
    assert (row.salmon_a, row.effort_days) == (0.0, 0.0)
    detail = est.estimate_detail(est.full_from_cells(cells, pop, STRATA, AM)).first()
    assert detail.salmon_a == pytest.approx(10.0)


def test_known_totals(spark):
    """Checkpoint values of the July estimate."""
    want = {
        "0.001": {("Area 0", "Boat"): (1811.888645, 63313.1669), ("Area 4", "Shore"): (2104.755678, 64267.5194)},
        "0.01": {("Area 0", "Boat"): (17705.857558, 519029.6868), ("Area 4", "Shore"): (18306.09862, 472520.8259)},
    }
    for scale, cells in want.items():
        fx = Fixture(spark, f"/root/testdata/sf{scale}")
        bundle = estimate_inst([JULY], fx.clean, fx.modern, AM)
        estimates = {(r.area, r.method): r for r in bundle.summary_estimated_catch.collect()}
        variances = {(r.area, r.method): r for r in bundle.total_variance.collect()}
        assert estimates[None, None].salmon_chinook_kept == variances[None, None].salmon_chinook_kept == 0
        assert len(estimates) == len(variances) == 11
        for cell, (total, spread) in cells.items():
            assert estimates[cell].salmon_chinook_kept == pytest.approx(total, abs=1e-6)
            assert variances[cell].salmon_chinook_kept == pytest.approx(spread, abs=1e-4)


def test_summary_adds_up(small):
    bundle = estimate_inst([JULY], small.clean, small.modern)
    detail = bundle.detail_estimated_catch.agg(F.sum("salmon_chinook_kept").alias("t")).first().t
    assert bundle.summary_estimated_catch.agg(F.sum("salmon_chinook_kept").alias("t")).first().t == pytest.approx(detail)


def test_year_is_the_union_of_its_months(small):
    responses = cat._year_responses(small).cache()
    registry = small.clean.cache()
    year = estimate_inst(MONTHLY, registry, responses, AM)
    for period in (MONTHLY[0], MONTHLY[3]):
        month = estimate_inst([period], registry, responses.where(F.col("survey_id") == period.survey_id), AM)
        for name in ("summary_estimated_catch", "total_variance", "licence_summary"):
            part = getattr(year, name).where(F.col("survey_id") == period.survey_id)
            assert same_rows(part, getattr(month, name)), name


def test_eligible_per_month(small):
    counts = strata.eligible(small.clean, MONTHLY).groupBy("survey_id").count().collect()
    got = [r["count"] for r in sorted(counts, key=lambda r: r.survey_id)]
    assert got == [112, 147, 172, 207, 238, 264, 299, 329, 355, 390, 410, 433]


def test_stamp_strata_and_mixed_calendars(small):
    stamped = SurveyPeriod.month_from(dt.date(2020, 7, 1), period_stratify=True, stamp_stratify=True)
    bundle = estimate_inst([stamped], small.clean, small.modern, AM)
    assert "stamp" in bundle.licence_summary.columns
    assert bundle.licence_summary.agg(F.sum("lic_total").alias("n")).first().n == 207
    plain = SurveyPeriod.month_from(dt.date(2020, 8, 1), period_stratify=True)
    both = estimate_inst([stamped, plain], small.clean, small.modern.withColumn("survey_id", F.lit("2020-07")), AM)
    sets = both.licence_summary.select("survey_id", "strata_set", F.col("stamp").isNull()).distinct().collect()
    assert {tuple(r) for r in sets} == {("2020-07", 1, False), ("2020-08", 0, True)}
    with pytest.raises(ValueError, match="survey_id"):
        estimate_inst(MONTHLY, small.clean, small.modern)


def test_prepost_leaves_juveniles_and_unplaced_catch_out(small):
    bundle = estimate_prepost([DRAW_JULY], small.draw_clean, small.legacy, small.vendor_wide, DRAW_YEAR)
    ages = {r.age_category for r in bundle.licence_summary.select("age_category").distinct().collect()}
    assert "Juvenile (under 16 years)" not in ages
    shown = bundle.survey_summary.where("area is null and salmon_chinook_kept is not null")
    assert shown.count() == 0
    assert bundle.total_variance.where("area is null").count() == 1


def test_duplicate_access_keys_fan_out(spark):
    registry = spark.createDataFrame([("k", "L1"), ("k", "L2"), (None, "L3")], "survey_access_key string, id string")
    responses = spark.createDataFrame([("k", 1), ("z", 2)], "surveykey string, salmon_x int")
    got = joins.attach_responses(responses, registry)
    assert sorted((r.survey_access_key, r.id) for r in got.where("id is not null").collect()) == [("k", "L1"), ("k", "L2")]
    assert [r.survey_access_key for r in joins.drop_invalid_keys(got.withColumn("resident_status", F.col("id"))).collect()] == ["k", "k"]


def test_period_filter_drops_all_rows_of_a_licence(spark):
    rows = [("L1", dt.date(2017, 6, 1), dt.date(2017, 6, 3)), ("L1", dt.date(2017, 7, 1), dt.date(2017, 7, 3)),
            ("L2", dt.date(2017, 7, 1), dt.date(2017, 7, 3)), (None, dt.date(2017, 6, 1), dt.date(2017, 6, 3))]
    df = spark.createDataFrame(rows, "full_licence_id string, start_date date, end_date date")
    kept = joins.drop_out_of_period(df, F.lit(dt.date(2017, 7, 1)), F.lit(dt.date(2017, 7, 31)))
    assert [r.full_licence_id for r in kept.where("full_licence_id is not null").collect()] == ["L2"]


def test_months_helper_matches_calendar():
    assert [p.survey_id for p in months_of(LicenceYear.ending(dt.date(2021, 3, 31)))][::11] == ["2020-04", "2021-03"]


def test_tables_are_stable(small):
    bundle = estimate_inst([JULY], small.clean, small.modern, AM)
    assert set(bundle.tables()) == {
        "licence_summary", "survey_summary", "survey_sample_sizes", "survey_specific_variance",
        "detail_estimated_catch", "summary_estimated_catch", "total_variance", "log",
    }
    assert table(bundle.survey_sample_sizes) == table(bundle.survey_sample_sizes)
