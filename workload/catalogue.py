"""The registered queries: one for each operator, over inputs derived from the given tables."""

from __future__ import annotations

import datetime as dt
import tempfile
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from creelstat import sinks
from creelstat.config import SurveyPeriod
from creelstat.domains import (
    AREA_METHOD, DRAW_STRATA, DRAW_SUM_CELLS, MONTHS, PERIOD_STRATA, SENIOR, SURVEY, measure_cols, sample_cols,
)
from creelstat.functions import (
    ascii_fold, licence_year_end, licence_year_start, licence_year_text, month_end, parse_date, yes_no,
)
from creelstat.functions.conform import conform
from creelstat.functions.dates import licence_year_number
from creelstat.operators import estimate as est
from creelstat.operators import joins, sparse, strata, vendor
from creelstat.operators import quality as dq
from creelstat.operators import registry as reg
from creelstat.operators import responses as resp
from creelstat.plans import (
    JobConfig, RegistrySnapshots, estimate_inst, estimate_prepost, export_responses, raw_export, run_annual, run_month,
)
from creelstat.plans.bundle import checkpointed, ensure_checkpoint_dir, stack_periods, stacked_tables
from creelstat.sources import normalise_registry, read_adjustments, read_exclude, read_registry, read_vendor_sales

from .fixtures import DRAW_JULY, DRAW_YEAR, JULY, LABELS, MONTHLY, YEAR, Fixture

Query = Callable[[Fixture], DataFrame]
CATALOGUE: dict[str, Query] = {}
CELLS = ["area", "method", "lodge", "guided"]
MEASURES = ["effort_days", "juv_effort_days", "salmon_chinook_kept", "halibut_kept"]
SURVEY_STRATA = [SURVEY, *PERIOD_STRATA]


def query(name: str) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        CATALOGUE[name] = fn
        return fn
    return register


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Doubles rounded for comparison between engines; a negative zero becomes zero."""
    return df.select(*(
        (F.round(f.name, places) + F.lit(0.0)).alias(f.name) if isinstance(f.dataType, T.DoubleType) else F.col(f.name)
        for f in df.schema
    ))


def run(name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(CATALOGUE[name](Fixture(spark, sf_dir)))


# --- sources -----------------------------------------------------------------------------------------------


@query("src_registry")
def src_registry(fx):
    """A registry file with headings in capitals and spaces around them, read back; NA and blanks are missing."""
    path = _scratch(fx)
    sinks.write_csv(fx.licence_raw.toDF(*(f" {c.upper()} " for c in fx.licence_raw.columns)), path)
    return read_registry(fx.spark, path)


@query("src_registry_jdbc")
def src_registry_jdbc(fx):
    """The normaliser of the database source, on clock times five hours behind UTC."""
    rows = fx.orders.select(
        F.col("o_orderkey").cast("string").alias("FULL_LICENCE_ID"),
        F.year("o_orderdate").alias("LIC_YEAR"),
        (F.col("o_orderdate") + F.make_dt_interval(hours=(F.col("o_orderkey") % 24).cast("int"))).alias("PURCHASE_DTT"),
        F.col("o_orderdate").alias("START_DT"),
    )
    zoned = normalise_registry(rows, source_zone="-05:00", zone="UTC", partial=True)
    return zoned.select("full_licence_id", "start_date", "purchase_date", "lic_year")


@query("src_responses_modern")
def src_responses_modern(fx):
    return fx.modern


@query("src_responses_legacy")
def src_responses_legacy(fx):
    return fx.legacy


@query("src_responses_dispatch")
def src_responses_dispatch(fx):
    """Surveys on both sides of the change of layout, each read the way its start says, in one table."""
    side = {
        SurveyPeriod.month_from(dt.date(2014, 7, 1)): (fx.legacy_raw, None, None),
        JULY: (fx.response_raw, fx.exclude_ids, fx.adjustments),
    }
    loaded = [
        resp.load_responses(raw, period.modern_responses, LABELS, exclude, adjustments)
        for period, (raw, exclude, adjustments) in side.items()
    ]
    return resp.drop_pii(joins.union_aligned(*loaded), dates=True)


@query("src_exclude")
def src_exclude(fx):
    """An exclusion file under its alias heading, read and applied to the registry."""
    path = _scratch(fx)
    sinks.write_csv(fx.exclude_ids.withColumnRenamed("survey_access_key", "licence.id"), path)
    ids = fx.clean.select(F.concat(F.lit("K"), "licence_id").alias("licence_id"), "licence_type")
    return joins.drop_excluded(ids, read_exclude(fx.spark, path), "licence_id")


@query("src_adjustments")
def src_adjustments(fx):
    """An adjustment file with headings in capitals and a column without one."""
    path = _scratch(fx)
    messy = fx.adjust_raw.withColumn("_c8", F.lit(None).cast("string"))
    sinks.write_csv(messy.toDF(*(c.upper() if c != "_c8" else c for c in messy.columns)), path)
    return read_adjustments(fx.spark, path)


@query("src_vendor_sales")
def src_vendor_sales(fx):
    """A sales file with dotted headings and commas between thousands."""
    path = _scratch(fx)
    months = {m: F.format_number(m, 0) for m in MONTHS}
    messy = fx.vendor_wide.withColumns(months).withColumnsRenamed({c: c.replace("_", ".") for c in vendor.CATEGORY})
    sinks.write_csv(messy, path)
    return vendor.vendor_summary(read_vendor_sales(fx.spark, path), [JULY], YEAR).drop(SURVEY)


# --- projections and filters -------------------------------------------------------------------------------


@query("prj_measure_columns")
def prj_measure_columns(fx):
    return fx.modern.select("surveykey", *measure_cols(fx.modern))


@query("prj_sample_size_columns")
def prj_sample_size_columns(fx):
    sizes = _july_full(fx)
    return sizes.select(*PERIOD_STRATA, *sample_cols(sizes))


@query("prj_drop_pii")
def prj_drop_pii(fx):
    return resp.drop_pii(fx.legacy, dates=True)


@query("prj_licence_id_part")
def prj_licence_id_part(fx):
    return fx.registry.select("full_licence_id", reg.short_id(F.col("full_licence_id")).alias("licence_id"))


@query("prj_term_length")
def prj_term_length(fx):
    return fx.registry.select("full_licence_id", reg.term_length(F.col("lic_type_cat_code")).alias("term_length"))


@query("prj_fix_start_date")
def prj_fix_start_date(fx):
    return reg.fix_start(fx.registry).select("full_licence_id", "start_date")


@query("prj_null_bad_purchase")
def prj_null_bad_purchase(fx):
    return reg.clean_purchase(fx.registry, YEAR).select("full_licence_id", "purchase_date")


@query("prj_fix_stamp_date")
def prj_fix_stamp_date(fx):
    return reg.clean_stamp(reg.fix_start(fx.registry), YEAR).select("full_licence_id", "stamp_purchase_date")


@query("prj_effective_start")
def prj_effective_start(fx):
    return reg.effective_start(reg.date_registry(fx.registry, YEAR)).select("full_licence_id", "start_date")


@query("flt_unsold")
def flt_unsold(fx):
    return reg.drop_unsold(fx.registry).select("full_licence_id", "fisher_id")


@query("flt_licence_year")
def flt_licence_year(fx):
    return reg.in_licence_year(fx.registry, YEAR).select("full_licence_id", "start_date")


@query("flt_blank_and_family")
def flt_blank_and_family(fx):
    return reg.drop_blank_family(fx.registry).select("full_licence_id", "lic_type_cat_code")


@query("prj_decode_category")
def prj_decode_category(fx):
    decoded = reg.decode_category(reg.drop_blank_family(fx.registry))
    return decoded.select("full_licence_id", "resident_status", "age_category", "licence_type", "annual_flag")


@query("prj_end_date")
def prj_end_date(fx):
    decoded = reg.decode_category(reg.drop_blank_family(fx.registry))
    return reg.end_date(decoded, YEAR).select("full_licence_id", "start_date", "end_date")


@query("prj_registry_clean")
def prj_registry_clean(fx):
    return fx.clean


@query("prj_stamp_flag")
def prj_stamp_flag(fx):
    return strata.stamp_flag(fx.clean, JULY.end).select("full_licence_id", "stamp")


@query("prj_draw_type")
def prj_draw_type(fx):
    return strata.draw_type(fx.clean, JULY.start, JULY.end).select("full_licence_id", "draw_type")


@query("prj_purchase_period")
def prj_purchase_period(fx):
    split = F.make_date(F.lit(2020), F.lit(6), F.lit(1))
    plain = strata.purchase_period(fx.clean, JULY.start, JULY.end, True).withColumnRenamed("purchase_period", "no_split")
    off = strata.purchase_period(plain, JULY.start, JULY.end, False).withColumnRenamed("purchase_period", "off")
    return strata.purchase_period(off, JULY.start, JULY.end, True, split).select(
        "full_licence_id", "no_split", "off", "purchase_period"
    )


@query("flt_eligible")
def flt_eligible(fx):
    return strata.eligible(fx.clean, [JULY]).select("full_licence_id", "start_date", "end_date")


@query("prj_collapse_age")
def prj_collapse_age(fx):
    sales = vendor.vendor_summary(fx.vendor_wide, [JULY], YEAR).drop(SURVEY)
    return strata.collapse_age(fx.clean, sales).select("full_licence_id", "licence_type", "age_category")


@query("prj_key_cleanup")
def prj_key_cleanup(fx):
    keys = resp.clean_key(fx.response_raw, "surveykey").select("surveykey")
    dotted = fx.response_raw.select(F.concat("surveykey", F.lit(".1 ")).alias("licence_id"))
    return joins.union_aligned(keys, resp.clean_key(dotted, "licence_id"))


@query("prj_blank_to_null")
def prj_blank_to_null(fx):
    return resp.blank_cells(fx.response_raw).select("surveykey", "area", "method")


@query("prj_fishing_flags")
def prj_fishing_flags(fx):
    flags = resp.fishing_flags(fx.response_raw)
    return flags.select("surveykey", F.col("didnotfish").alias("did_not_fish"), "effort_days")


@query("flt_complete_modern")
def flt_complete_modern(fx):
    return resp.complete_modern(fx.response_raw).select("surveykey", "area", "method")


@query("flt_complete_legacy")
def flt_complete_legacy(fx):
    rows = fx.legacy_raw.select(
        "Licence_ID", F.col("DNF_1").isNotNull().alias("did_not_fish"), F.col("COMPLETE").alias("effort_days")
    )
    return resp.complete_legacy(rows)


@query("prj_zero_fill")
def prj_zero_fill(fx):
    return resp.zero_fill(fx.response_raw).select("surveykey", "salmon_chinook_kept", "halibut_kept", "totaljuveniles")


@query("prj_label_decode")
def prj_label_decode(fx):
    """Codes through a label table, with the spelling fixed."""
    rows = fx.response_raw.select(
        "surveykey", F.col("fishedfromlodge").alias("lodge"), F.col("fishedwithguide").alias("guided"),
        F.col("fishedwithguide").alias("checkcrabsprawns"),
    )
    return resp.fix_label_typo(
        resp.decode_labels(rows, fx.label_codes, ["lodge", "guided", "checkcrabsprawns"], "Unspecified")
    )


@query("prj_cast_to_schema")
def prj_cast_to_schema(fx):
    target = "surveykey string, effort_days int, salmon_chinook_kept double, halibut_kept bigint, datefished date"
    return conform(fx.adjustments, T._parse_datatype_string(target))


@query("prj_parse_date_multi")
def prj_parse_date_multi(fx):
    """Every order date written in one of several layouts, and read back."""
    day = F.col("o_orderdate")
    layouts = ["yyyy-MM-dd", "MM/dd/yyyy", "dd/MM/yyyy", "dd-MMM-yyyy", "yyyyMMdd"]
    which = F.col("o_orderkey") % len(layouts)
    text = F.lit("no date")
    for i, layout in enumerate(layouts):
        text = F.when(which == i, F.date_format(day, layout)).otherwise(text)
    rows = fx.orders.select("o_orderkey", text.alias("written"))
    return rows.select("o_orderkey", "written", parse_date(F.col("written")).alias("day"))


@query("prj_bool_to_yesno")
def prj_bool_to_yesno(fx):
    return fx.adjustments.select("surveykey", yes_no(F.col("did_not_fish")).alias("did_not_fish"))


@query("prj_ascii_fold")
def prj_ascii_fold(fx):
    return fx.documents.select("doc_id", ascii_fold(F.col("text")).alias("text"))


# --- joins -------------------------------------------------------------------------------------------------


def _legacy_keyed(fx: Fixture) -> DataFrame:
    return resp.drop_pii(fx.legacy, dates=True)


@query("join_inner_responses")
def join_inner_responses(fx):
    return joins.attach_inner(_legacy_keyed(fx), fx.clean).select(
        "licence_id", "full_licence_id", "licence_type", "age_category", "start_date", "area", "method", *MEASURES
    )


@query("join_right_responses")
def join_right_responses(fx):
    registry = fx.july.select("survey_access_key", *PERIOD_STRATA)
    return joins.attach_responses(fx.modern, registry)


def _july_joined(fx: Fixture) -> DataFrame:
    """July responses of known respondents, with their strata, row by row."""
    return joins.attach_valid(fx.modern, fx.july.select("survey_access_key", *PERIOD_STRATA))


def _july_population(fx: Fixture) -> DataFrame:
    return est.population(fx.july.drop(SURVEY), "licence_id", PERIOD_STRATA)


def _july_sizes(fx: Fixture) -> DataFrame:
    return est.sample_sizes(_july_joined(fx), "survey_access_key", PERIOD_STRATA)


def _july_full(fx: Fixture) -> DataFrame:
    joined = _july_joined(fx)
    return est.survey_full(
        _july_population(fx), est.cell_sums(joined, PERIOD_STRATA, AREA_METHOD),
        est.sample_sizes(joined, "survey_access_key", PERIOD_STRATA), PERIOD_STRATA,
    )


@query("join_full_strata")
def join_full_strata(fx):
    return _july_full(fx)


@query("join_full_cells")
def join_full_cells(fx):
    """Reported and possible cells side by side, the NULL cell matched with itself."""
    joined = _july_joined(fx)
    lodge = joined.where(F.col("lodge") == "Yes").groupBy(*AREA_METHOD).agg(F.count("*").alias("at_lodge"))
    guided = joined.where(F.col("guided") == "Yes").groupBy(*AREA_METHOD).agg(F.count("*").alias("with_guide"))
    return joins.full_join_ns(lodge, guided, AREA_METHOD)


@query("join_full_totals")
def join_full_totals(fx):
    electronic = vendor.electronic_population(fx.draw_licences)
    return vendor.merge_populations(vendor.vendor_population(fx.draw_sales), electronic).drop(SURVEY)


@query("join_full_raw")
def join_full_raw(fx):
    registry = fx.licence_raw.select("full_licence_id", "survey_access_key", "lic_type_cat_code")
    keyed = resp.clean_key(fx.response_raw, "surveykey")
    loose = fx.response_raw.where(F.col("surveykey").isNull())
    responses = keyed.unionByName(loose).select("surveykey", "area", "method", "salmon_chinook_kept")
    return joins.raw_join(registry, responses)


@query("join_anti_period")
def join_anti_period(fx):
    members = joins.licences_in_period(fx.draw_licences.drop(SURVEY), F.lit(DRAW_JULY.start), F.lit(DRAW_JULY.end))
    return joins.attach_inner(_legacy_keyed(fx), members).select(
        "full_licence_id", "licence_id", "draw_type", "area", "method", *MEASURES
    )


@query("join_anti_exclude")
def join_anti_exclude(fx):
    return joins.drop_excluded(fx.modern, fx.exclude_ids, "surveykey")


@query("join_anti_invalid_key")
def join_anti_invalid_key(fx):
    return _july_joined(fx)


@query("join_replace_by_key")
def join_replace_by_key(fx):
    return resp.apply_adjustments(fx.modern, fx.adjustments)


@query("join_semi_ids")
def join_semi_ids(fx):
    return joins.keep_ids(fx.modern, fx.exclude_ids, "surveykey")


@query("join_calendar_range")
def join_calendar_range(fx):
    return strata.period_strata(strata.eligible(fx.clean, MONTHLY)).select(
        SURVEY, "full_licence_id", "stamp", "purchase_period"
    )


# --- set operations ----------------------------------------------------------------------------------------


@query("set_union_by_name")
def set_union_by_name(fx):
    annual = fx.clean.where("annual_flag").select("licence_id", "end_date", "licence_type")
    term = fx.clean.where("not annual_flag").select("licence_type", "licence_id", "start_date")
    return joins.union_aligned(annual, term)


@query("set_distinct")
def set_distinct(fx):
    return joins.distinct_keys(fx.modern, ["surveykey", "did_not_fish"])


@query("set_diff_unknown_ids")
def set_diff_unknown_ids(fx):
    keys = fx.july.select(F.col("survey_access_key").alias("surveykey"))
    return joins.missing_ids(fx.modern, keys, "surveykey")


@query("set_union_periods")
def set_union_periods(fx):
    bundle = estimate_inst(MONTHLY, fx.clean, _year_responses(fx), AREA_METHOD)
    return stack_periods(bundle.licence_summary, MONTHLY)


# --- aggregations ------------------------------------------------------------------------------------------


@query("agg_population")
def agg_population(fx):
    return _july_population(fx)


@query("agg_population_elic")
def agg_population_elic(fx):
    return vendor.electronic_population(fx.draw_licences).drop(SURVEY)


@query("agg_vendor_months")
def agg_vendor_months(fx):
    return vendor.vendor_summary(fx.vendor_wide, MONTHLY, YEAR)


@query("agg_vendor_population")
def agg_vendor_population(fx):
    return vendor.vendor_population(fx.draw_sales).drop(SURVEY)


@query("agg_licence_population")
def agg_licence_population(fx):
    return vendor.adult_population(fx.draw_licences, fx.draw_sales).drop(SURVEY)


@query("agg_respondent_sums")
def agg_respondent_sums(fx):
    return est.respondent_sums(_july_joined(fx), "survey_access_key", PERIOD_STRATA, AREA_METHOD)


@query("agg_cell_sums")
def agg_cell_sums(fx):
    return est.cell_sums(_july_joined(fx), PERIOD_STRATA, CELLS)


@query("agg_cell_sums_draw")
def agg_cell_sums_draw(fx):
    members = joins.licences_in_period(fx.draw_licences.drop(SURVEY), F.lit(DRAW_JULY.start), F.lit(DRAW_JULY.end))
    sums = est.cell_sums(joins.attach_inner(_legacy_keyed(fx), members), DRAW_STRATA, DRAW_SUM_CELLS, est.is_surveyed())
    return sums.where(F.col("area").isNotNull())


@query("agg_sample_sizes")
def agg_sample_sizes(fx):
    """With adjustments, so that measures differ in completeness."""
    adjusted = resp.apply_adjustments(fx.modern, fx.adjustments)
    joined = joins.attach_valid(adjusted, fx.july.select("survey_access_key", *PERIOD_STRATA))
    return est.sample_sizes(joined, "survey_access_key", PERIOD_STRATA)


@query("agg_zero_padded_variance")
def agg_zero_padded_variance(fx):
    """Line quantities per supplier and status, padded with zeros to the supplier's line count."""
    per_cell = fx.lineitem.groupBy("l_suppkey", "l_linestatus", "l_returnflag").agg(
        F.count("*").alias("k"), F.avg("l_quantity").alias("mean"), F.var_pop("l_quantity").alias("spread")
    )
    n = fx.lineitem.groupBy("l_suppkey").agg(F.count("*").alias("n"))
    value = F.expr(est.padded_variance("k", "mean", "spread", "n"))
    return per_cell.join(n, "l_suppkey").select(
        "l_suppkey", "l_linestatus", "l_returnflag", "k", "n", F.round(value, 4).alias("variance")
    )


def _july_cells(fx: Fixture) -> DataFrame:
    """Sums, spreads and sample sizes of July per stratum and cell, from one pass over the responses."""
    responses = fx.modern.withColumn(SURVEY, F.lit(JULY.survey_id))
    return est.stratum_cells(responses, fx.july, "surveykey", "survey_access_key", PERIOD_STRATA, AREA_METHOD)


@query("agg_specific_variance")
def agg_specific_variance(fx):
    return est.variance_from_cells(_july_cells(fx), PERIOD_STRATA, AREA_METHOD).drop(SURVEY)


SPARSE_MEASURES = [f"finfish_kind{i:03d}" for i in range(300)]


def _many_measures(fx: Fixture) -> DataFrame:
    """July responses that report one of 300 measures a row, and lack another one here and there."""
    lines = fx.response_raw.select(
        F.trim("surveykey").alias("surveykey"), (F.col("didnotfish") == 1).alias("did_not_fish"),
        F.nullif(F.trim("area"), F.lit("")).alias("area"), F.nullif(F.trim("method"), F.lit("")).alias("method"),
        F.when(F.col("didnotfish") == 1, 0).otherwise(1).alias("effort_days"),
        F.coalesce("salmon_chinook_kept", F.lit(0)).alias("caught"), F.coalesce("halibut_kept", F.lit(0)).alias("other"),
    ).where("surveykey IS NOT NULL").withColumn(SURVEY, F.lit(JULY.survey_id)).withColumns({
        "kind": F.expr("(caught * 7 + other) % 300"), "lacking": F.expr("if(caught = 13, other * 75, -1)"),
    })
    kinds = [
        F.expr(f"CASE WHEN lacking = {i} THEN NULL WHEN kind = {i} THEN caught ELSE 0 END AS {m}")
        for i, m in enumerate(SPARSE_MEASURES)
    ]
    # rows of 300 columns, as such responses arrive
    return lines.select(SURVEY, "surveykey", "did_not_fish", "area", "method", "effort_days", *kinds)


def _sparse_cells(fx: Fixture) -> tuple[DataFrame, DataFrame]:
    """The cells of the long layout and the licences that they are estimated for, both computed once."""
    _shared_folder(fx)
    rows = _many_measures(fx)
    licences = checkpointed(fx.july.select(SURVEY, "licence_id", "survey_access_key", *PERIOD_STRATA))
    states = checkpointed(sparse.long_states(rows, "surveykey", AREA_METHOD))
    return checkpointed(sparse.long_cells(
        states, licences, "surveykey", "survey_access_key", PERIOD_STRATA, AREA_METHOD, measure_cols(rows)
    )), licences


@query("agg_specific_variance_long")
def agg_specific_variance_long(fx):
    """The variance of 301 measures in the long layout, for the cells in which they are not zero."""
    table, _ = _sparse_cells(fx)
    return sparse.specific_variance(table, PERIOD_STRATA, AREA_METHOD).drop(SURVEY)


@query("agg_total_variance_long")
def agg_total_variance_long(fx):
    """Expanded totals and their variances of 301 measures in the long layout."""
    table, licences = _sparse_cells(fx)
    pop = checkpointed(est.population(licences, "licence_id", PERIOD_STRATA))
    detail = sparse.estimate_detail(table, pop, PERIOD_STRATA, AREA_METHOD)
    spread = sparse.total_variance(table, pop, PERIOD_STRATA, AREA_METHOD)
    keys = [SURVEY, *AREA_METHOD, sparse.MEASURE]
    return rounded(joins.full_join_ns(sparse.estimate_summary(detail), spread, keys), 4)


@query("agg_total_variance")
def agg_total_variance(fx):
    pop = est.population(fx.july, "licence_id", PERIOD_STRATA)
    return rounded(est.total_from_cells(_july_cells(fx), pop, PERIOD_STRATA, AREA_METHOD).drop(SURVEY), 4)


@query("agg_max_sample_size")
def agg_max_sample_size(fx):
    return est.max_sample_sizes(est.survey_sample_sizes(_july_full(fx)), PERIOD_STRATA)


@query("agg_expansion_rate")
def agg_expansion_rate(fx):
    rates = est.expansion_rate(_july_full(fx))
    return rates.select(*PERIOD_STRATA, *AREA_METHOD, "lic_total", *sample_cols(rates))


@query("agg_estimate_detail")
def agg_estimate_detail(fx):
    return est.estimate_detail(_july_full(fx))


@query("agg_estimate_summary")
def agg_estimate_summary(fx):
    return est.estimate_summary(est.estimate_detail(_july_full(fx)))


@query("agg_survey_summary")
def agg_survey_summary(fx):
    return est.survey_summary(_july_full(fx))


@query("agg_survey_sample_sizes")
def agg_survey_sample_sizes(fx):
    return est.survey_sample_sizes(_july_full(fx))


def _adjusted_lines(fx: Fixture) -> DataFrame:
    """Adjustments with a row per order line, some of them without catch."""
    return fx.lineitem.select(
        F.concat(F.lit("K"), F.col("l_orderkey").cast("string")).alias("surveykey"),
        F.when(F.col("l_quantity") > 10, F.col("l_quantity")).alias("salmon_chinook_kept"),
        F.when(F.col("l_partkey") % 4 > 0, F.col("l_partkey")).alias("halibut_kept"),
        (F.col("l_returnflag") == "N").alias("did_not_fish"),
    )


@query("agg_unpivot_status")
def agg_unpivot_status(fx):
    return dq.unpivot_status(_adjusted_lines(fx), "surveykey", ["salmon_chinook_kept", "halibut_kept"])


@query("agg_first_n_text")
def agg_first_n_text(fx):
    rows = fx.clean.select("licence_type", "full_licence_id")
    return dq.sample_text(rows, ["licence_type"], "full_licence_id", 10, ", ")


# --- data-quality gates ------------------------------------------------------------------------------------


@query("dq_domain")
def dq_domain(fx):
    rows = fx.response_raw.withColumn("area", F.nullif(F.trim("area"), F.lit("")))
    return dq.domain(rows, "area", ["Area 0", "Area 1", "Area 2"])


@query("dq_category_codes")
def dq_category_codes(fx):
    return dq.category_codes(fx.registry)


@query("dq_mixed_dnf")
def dq_mixed_dnf(fx):
    return dq.mixed_dnf(_adjusted_lines(fx), "surveykey")


@query("dq_mixed_null")
def dq_mixed_null(fx):
    return dq.mixed_null(_adjusted_lines(fx), "surveykey", ["salmon_chinook_kept", "halibut_kept"])


@query("dq_missing_key_ratio")
def dq_missing_key_ratio(fx):
    return joins.union_aligned(
        dq.missing_key_ratio(fx.response_raw, "surveykey"), dq.missing_key_ratio(fx.registry, "survey_access_key")
    )


@query("dq_empty_input")
def dq_empty_input(fx):
    return joins.union_aligned(
        dq.empty_input(fx.response_raw, "responses"),
        dq.empty_input(fx.response_raw.where(F.col("area") == "Area 9"), "responses of Area 9"),
    )


@query("dq_catch_without_area")
def dq_catch_without_area(fx):
    """Fishers whose area is withheld wherever they fished from shore."""
    rows = _july_joined(fx).withColumn("area", F.when(F.col("method") == "Boat", F.col("area")))
    return dq.catch_without_area(est.cell_sums(rows, PERIOD_STRATA, AREA_METHOD), MEASURES)


@query("dq_nonpositive_sample")
def dq_nonpositive_sample(fx):
    """Sizes from guided respondents below the senior age only, cells from all."""
    joined = _july_joined(fx)
    sizes = est.sample_sizes(
        joined.where((F.col("lodge") == "Yes") & (F.col("guided") == "Yes") & (F.col("age_category") != SENIOR)),
        "survey_access_key", PERIOD_STRATA,
    )
    cells = est.cell_sums(joined, PERIOD_STRATA, AREA_METHOD)
    return dq.nonpositive_sample(cells, sizes, PERIOD_STRATA, MEASURES)


@query("dq_unknown_ids")
def dq_unknown_ids(fx):
    keys = fx.july.select(F.col("survey_access_key").alias("surveykey"))
    return dq.unknown_ids(fx.modern, keys, "surveykey")


@query("dq_registry_counts")
def dq_registry_counts(fx):
    return dq.registry_counts(fx.registry, YEAR)


@query("dq_duplicate_licences")
def dq_duplicate_licences(fx):
    rows = fx.lineitem.select("l_orderkey", "l_returnflag")
    return dq.duplicate_licences(rows, "l_orderkey", ["l_returnflag"])


@query("dq_registry_regression")
def dq_registry_regression(fx):
    return dq.registry_regression(fx.registry, fx.clean)


@query("dq_period_same_month")
def dq_period_same_month(fx):
    return dq.period_same_month(fx.order_calendar)


@query("dq_split_date_in_year")
def dq_split_date_in_year(fx):
    return dq.split_date_in_year(fx.order_calendar)


@query("dq_vendor_months")
def dq_vendor_months(fx):
    """A sales table without March, with a stray column, and nothing sold in July for 2014."""
    year = type(YEAR).ending(YEAR.end.replace(year=2014))
    table = fx.vendor_wide.withColumnRenamed("March", "Total").withColumn("July", F.col("July") * 0)
    return dq.vendor_months(table, "July", year)


@query("dq_missing_strata_cols")
def dq_missing_strata_cols(fx):
    """A year of surveys of which the earlier ones did not ask about guides and one had no lodges filled in."""
    rows = _year_responses(fx)
    early = rows.where(F.col(SURVEY) < "2020-08").drop("guided")
    late = rows.where(F.col(SURVEY) >= "2020-08").withColumn("lodge", F.when(F.col(SURVEY) != "2020-11", F.col("lodge")))
    return dq.missing_strata_cols(joins.union_aligned(early, late))


# --- calendar functions ------------------------------------------------------------------------------------


@query("fn_licence_year")
def fn_licence_year(fx):
    day = F.col("o_orderdate").cast("date")
    return fx.orders.select(
        "o_orderkey", licence_year_start(day).alias("lic_start"), licence_year_end(day).alias("lic_end"),
        licence_year_text(licence_year_number(day)).alias("lic_label"),
    )


@query("fn_month_end")
def fn_month_end(fx):
    return fx.orders.select("o_orderkey", month_end(F.col("o_orderdate").cast("date")).alias("month_end"))


# --- jobs --------------------------------------------------------------------------------------------------


def _year_responses(fx: Fixture) -> DataFrame:
    return resp.normalise_modern(fx.response_year, LABELS)


def july_estimate(fx: Fixture):
    responses = resp.load_responses(fx.response_raw, True, LABELS, fx.exclude_ids)
    return estimate_inst([JULY], fx.clean, responses)


@query("job_month_inst")
def job_month_inst(fx):
    return july_estimate(fx).summary_estimated_catch


@query("job_month_inst_detail")
def job_month_inst_detail(fx):
    return july_estimate(fx).detail_estimated_catch


@query("job_month_inst_specific_variance")
def job_month_inst_specific_variance(fx):
    return july_estimate(fx).survey_specific_variance


@query("job_month_inst_variance")
def job_month_inst_variance(fx):
    return rounded(july_estimate(fx).total_variance, 4)


def draw_estimate(fx: Fixture):
    return estimate_prepost([DRAW_JULY], fx.draw_clean, fx.legacy, fx.vendor_wide, DRAW_YEAR)


@query("job_month_prepost")
def job_month_prepost(fx):
    return draw_estimate(fx).summary_estimated_catch


@query("job_month_prepost_population")
def job_month_prepost_population(fx):
    return draw_estimate(fx).licence_summary


@query("job_month_prepost_variance")
def job_month_prepost_variance(fx):
    return rounded(draw_estimate(fx).total_variance, 4)


@query("job_month_log")
def job_month_log(fx):
    """All checks of a month as its message table, with adjustments and exclusions in place."""
    _shared_folder(fx)
    responses = resp.load_responses(fx.response_raw, True, LABELS, fx.exclude_ids, fx.adjustments)
    bundle = estimate_inst([JULY], fx.clean, responses, AREA_METHOD, checkpointed)
    return bundle.log


RESULT_KEYS = ["year", "month_id", "strata_set"]


def long_tables(tables: dict[str, DataFrame]) -> DataFrame:
    """Result tables stacked as (table, key, name, value)."""
    frames = []
    for name, df in tables.items():
        values = [f.name for f in df.schema if isinstance(f.dataType, T.NumericType) and f.name not in RESULT_KEYS]
        keys = sorted(c for c in df.columns if c not in values)
        key = F.concat_ws("|", *(F.coalesce(F.col(k).cast("string"), F.lit("-")) for k in keys))
        # a little off halves, which engines that add in another order would round both ways
        rows = df.select(key.alias("key"), *((F.col(v) * 1.000000001).cast("double").alias(v) for v in values))
        rows = rows.unpivot("key", values, "name", "value")
        frames.append(rounded(rows, 4).select(F.lit(name).alias("table"), "key", "name", "value"))
    return joins.union_aligned(*frames)


@query("job_month")
def job_month(fx):
    """A month from files to files: registry, responses, exclusions and adjustments in, all eight tables out."""
    root = _scratch(fx)
    fx.licence_raw.write.parquet(f"{root}/registry")
    fx.response_raw.write.parquet(f"{root}/july")
    sinks.write_csv(fx.exclude_ids, f"{root}/exclude")
    sinks.write_csv(fx.adjust_raw, f"{root}/adjusted")
    run_month(fx.spark, JobConfig(
        year=YEAR, periods=[JULY], registry=f"{root}/registry", registry_format="parquet", labels=LABELS,
        responses={JULY.survey_id: f"{root}/july"}, exclude=f"{root}/exclude",
        adjustments={JULY.survey_id: f"{root}/adjusted"}, output=f"{root}/results",
    ))
    return long_tables(sinks.read_bundle(fx.spark, f"{root}/results"))


# Every other survey of the summer stratifies by the stamp, and the later ones have a split date.
MIXED = [
    replace(p, stamp_stratify=i % 2 == 0, split_date=dt.date(2020, 6, 15) if i > 1 else None)
    for i, p in enumerate(MONTHLY[2:6])
]


@query("job_annual_run")
def job_annual_run(fx):
    """Surveys of different strata in one run from files to files, all tables read back."""
    root = _scratch(fx)
    fx.licence_raw.write.parquet(f"{root}/registry")
    fx.response_year.write.partitionBy(SURVEY).parquet(f"{root}/responses")
    run_annual(fx.spark, JobConfig(
        year=YEAR, periods=MIXED, registry=f"{root}/registry", registry_format="parquet", labels=LABELS,
        responses={p.survey_id: f"{root}/responses/{SURVEY}={p.survey_id}" for p in MIXED}, output=f"{root}/results",
    ))
    return long_tables(sinks.read_bundle(fx.spark, f"{root}/results"))


@query("job_annual")
def job_annual(fx):
    bundle = estimate_inst(MONTHLY, fx.clean, _year_responses(fx), AREA_METHOD)
    return stack_periods(bundle.summary_estimated_catch, MONTHLY)


@query("job_annual_variance")
def job_annual_variance(fx):
    bundle = estimate_inst(MONTHLY, fx.clean, _year_responses(fx), AREA_METHOD)
    return rounded(stack_periods(bundle.total_variance, MONTHLY), 4)


@query("job_export_responses")
def job_export_responses(fx):
    responses = resp.load_responses(fx.response_raw, True, LABELS, fx.exclude_ids, fx.adjustments)
    return export_responses(fx.clean, responses, JULY).select(
        "survey_access_key", "full_licence_id", "licence_type", "stamp", "did_not_fish", "area", "method", *MEASURES
    )


@query("job_adjustment_template")
def job_adjustment_template(fx):
    return resp.adjustment_template(fx.modern, fx.exclude_ids)


@query("job_adjustment_unknown_ids")
def job_adjustment_unknown_ids(fx):
    """Ids asked for a template that the survey does not have."""
    return resp.unknown_template_ids(fx.modern, fx.exclude_ids)


@query("job_raw_export")
def job_raw_export(fx):
    registry = fx.licence_raw.select("full_licence_id", "survey_access_key", "start_dt", "lic_year")
    responses = fx.response_raw.select("surveykey", "didnotfish", "halibut_kept")
    return raw_export(registry, responses)


@query("job_refresh_registry")
def job_refresh_registry(fx):
    """Three deliveries: a first one, one without its unsold licences, and one that lost licences and is refused."""
    snapshots = RegistrySnapshots(fx.spark, _scratch(fx), YEAR)
    snapshots.refresh(fx.licence_raw.where(F.col("start_dt") < "2020-10-01"), "first")
    snapshots.refresh(fx.licence_raw.where(F.col("fisher_id") != 1), "second")
    try:
        snapshots.refresh(fx.licence_raw.where(F.col("start_dt") < "2020-10-01"), "third")
        refused = False
    except dq.QualityError:
        refused = True
    return snapshots.read().select(
        "full_licence_id", "start_dt", "fisher_id", F.lit(snapshots.current).alias("snapshot"), F.lit(refused).alias("refused")
    )


@query("job_parse_id_list")
def job_parse_id_list(fx):
    """Ids written into order notes with commas and spaces."""
    text = F.concat_ws(", ", F.col("l_orderkey").cast("string"), F.concat(
        F.lit(" "), F.col("l_suppkey").cast("string"), F.lit(" "), F.col("l_partkey").cast("string"), F.lit(",")
    ))
    return resp.parse_ids(fx.lineitem.select(text.alias("ids")), "ids")


# --- sinks -------------------------------------------------------------------------------------------------


def _shared_folder(fx: Fixture) -> str:
    """Where the session's checkpoints go, which all executors share."""
    context = fx.spark.sparkContext
    if context.getCheckpointDir() is None and context.master.startswith("local["):  # one machine, as in tests
        context.setCheckpointDir(fx.spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="sink-"))
    ensure_checkpoint_dir(fx.spark)
    return context.getCheckpointDir()


def _scratch(fx: Fixture) -> str:
    """A new folder next to the session's checkpoints."""
    return f"{_shared_folder(fx)}/sink-{fx.spark.sql('select uuid() as u').first().u}"


@query("sink_bundle")
def sink_bundle(fx):
    path = _scratch(fx)
    sinks.write_bundle(estimate_inst([JULY], fx.clean, fx.modern, AREA_METHOD, checkpointed).tables(), path)
    return long_tables(sinks.read_bundle(fx.spark, path))


@query("sink_annual")
def sink_annual(fx):
    path = _scratch(fx)
    bundle = estimate_inst(MONTHLY, fx.clean, _year_responses(fx), AREA_METHOD, checkpointed)
    sinks.write_annual(stacked_tables(bundle, MONTHLY), path)
    return long_tables(sinks.read_bundle(fx.spark, path))


@query("sink_csv")
def sink_csv(fx):
    """A registry written as CSV and read back."""
    path = _scratch(fx)
    sinks.write_csv(fx.licence_raw, path)
    return read_registry(fx.spark, path, na_is_missing=False)


@query("sink_diagnostics")
def sink_diagnostics(fx):
    return dq.diagnostics(
        dq.registry_counts(fx.registry, YEAR), dq.category_codes(fx.registry),
        dq.mixed_null(_adjusted_lines(fx), "surveykey", ["salmon_chinook_kept", "halibut_kept"]),
        dq.grouped_ages(strata.combined_sales(fx.draw_sales, [SURVEY])), dq.strata_settings(fx.order_calendar.withColumn(
            "stamp_stratify", F.month("survey_start") > 6
        )),
    )
