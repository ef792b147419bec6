"""What the physical plans must and must not contain."""

import pytest
from pyspark.sql import functions as F

from creelstat.operators import estimate as est
from creelstat.operators import joins
from creelstat.operators import quality as dq
from creelstat.operators import registry as reg
from creelstat.plans import JobConfig, estimate_inst, run_month
from creelstat.sources import normalise_registry
from workload import catalogue, oracle
from workload.fixtures import JULY, LABELS, MONTHLY, YEAR, Fixture

FORBIDDEN = ["CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython", "MapInPandas"]
HEAVY = [
    "job_month_inst", "job_month_inst_variance", "job_month_prepost", "job_annual", "job_month", "join_full_raw",
    "join_calendar_range", "join_replace_by_key", "agg_total_variance", "prj_label_decode", "prj_collapse_age",
]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", HEAVY)
def test_no_cross_join_and_no_python(small, name):
    text = plan(catalogue.CATALOGUE[name](small))
    assert [f for f in FORBIDDEN if f in text] == []


def test_cleaning_is_one_narrow_stage(spark, small, tmp_path):
    small.licence_raw.write.parquet(f"{tmp_path}/registry")
    table = normalise_registry(spark.read.parquet(f"{tmp_path}/registry"))
    text = plan(joins.union_aligned(reg.clean_registry(table, YEAR).select("licence_id", "end_date")))
    assert "Exchange" not in text
    assert "survey_access_key" not in text.split("ReadSchema")[-1]
    assert "LessThanOrEqual" not in text and "Not(EqualTo(fisher_id,1))" in text


def test_a_year_reads_the_registry_as_often_as_a_month(small):
    responses = catalogue._year_responses(small)
    def scans(periods, df):
        bundle = estimate_inst(periods, small.clean, df, ["area", "method"])
        return plan(bundle.summary_estimated_catch).count("FileScan")
    july = responses.where(F.col("survey_id") == JULY.survey_id)
    assert scans(MONTHLY, responses) == scans([JULY], july)


def test_responses_are_combined_before_they_are_shuffled(small):
    responses = small.modern.withColumn("survey_id", F.lit("s"))
    text = plan(est.respondent_cells(responses, "surveykey", ["area"], est.is_counted()))
    first_exchange = text.rindex("Exchange hashpartitioning")
    assert "partial_sum" in text[first_exchange:]


def final_plan(df):
    df.collect()
    return plan(df).split("== Initial Plan ==")[0]


def test_flags_need_no_second_read(small):
    """Validity comes from the registry: one read of each input, where equal exchanges are used again."""
    for name, scans in {"join_anti_invalid_key": 3, "join_anti_period": 3, "agg_total_variance": 4}.items():
        assert final_plan(catalogue.CATALOGUE[name](small)).count("FileScan") <= scans, name


def test_the_draw_analysis_looks_at_respondents_once(small):
    bundle = catalogue.draw_estimate(small)
    bundle.states = bundle.states.checkpoint()
    for table in (bundle.sums, bundle.spread, bundle.survey_specific_variance):
        assert "l_orderkey" not in plan(table)


def test_a_job_reads_the_responses_twice_at_most(spark, small, tmp_path):
    store = spark._jsparkSession.sharedState().statusStore()
    before = store.executionsCount()
    small.licence_raw.write.parquet(f"{tmp_path}/registry")
    small.response_raw.write.parquet(f"{tmp_path}/july")
    small.response_raw.where("completesurvey = 'Complete ' and surveykey is not null").write.parquet(f"{tmp_path}/clean")
    reads = {}
    for name in ("july", "clean"):
        run_month(spark, JobConfig(
            year=YEAR, periods=[JULY], registry=f"{tmp_path}/registry", registry_format="parquet", labels=LABELS,
            responses={JULY.survey_id: f"{tmp_path}/{name}"}, output=f"{tmp_path}/{name}-out",
        ))
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    plans = [x.physicalPlanDescription() for x in _listed(store.executionsList(before, 10_000))]
    for name in ("july", "clean"):
        location = f"{tmp_path}/{name}]"
        reads[name] = sum(p.split("== Initial Plan ==")[0].count(location) for p in plans)
    assert 1 <= reads["july"] <= 2 and reads["clean"] == 1


def _listed(seq):
    return [seq.apply(i) for i in range(seq.size())]


def test_samples_are_limited_before_the_shuffle(small):
    text = plan(dq.sample_text(small.clean, ["licence_type"], "full_licence_id", 10))
    assert text.count("WindowGroupLimit") == 2


def test_every_query_has_an_oracle():
    assert set(catalogue.CATALOGUE) == set(oracle.SQL)


def test_oracle_sample(spark, small):
    import duckdb

    con = duckdb.connect()
    for table in ("orders", "customer", "lineitem", "supplier", "documents"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '/root/testdata/sf0.001/{table}.parquet'")
    for name in ("job_month_inst", "agg_total_variance", "join_full_raw", "prj_registry_clean", "dq_registry_counts"):
        frame = catalogue.run(name, spark, "/root/testdata/sf0.001")
        answer = con.execute(oracle.statement(name))
        columns = [d[0] for d in answer.description]
        want = sorted(str([r[columns.index(c)] for c in sorted(columns)]) for r in answer.fetchall())
        got = sorted(str([r[c] for c in sorted(frame.columns)]) for r in frame.collect())
        assert sorted(columns) == sorted(frame.columns) and got == want, name


def test_fixture_names():
    assert not set(Fixture.__dict__) & set(oracle.VIEWS)
