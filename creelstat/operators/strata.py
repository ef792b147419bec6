"""Stratum assignment and survey eligibility, as column expressions over the cleaned registry."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import SurveyPeriod
from ..domains import (
    ADULT_OR_SENIOR, ANNUAL, EARLY_SEASON, IN_SURVEY, LATE_SEASON, NON_RESIDENT, NOT_SPECIFIED,
    POST_DRAW, PRE_DRAW, PRE_SURVEY, SURVEY, TERM_TYPES,
)

Bound = Column | dt.date | None


def _date(value: Bound) -> Column:
    return value if isinstance(value, Column) else F.lit(value).cast("date")


def stamp_flag(df: DataFrame, survey_end: Bound) -> DataFrame:
    """Whether the salmon stamp was bought in time for the survey."""
    bought, end = F.col("stamp_purchase_date"), _date(survey_end)
    in_time = F.when(F.col("licence_type") == ANNUAL, bought < end).when(
        F.col("licence_type") != ANNUAL, bought <= end
    )
    return df.withColumn("stamp", F.coalesce(in_time, F.lit(False)))


def draw_type(df: DataFrame, survey_start: Bound, survey_end: Bound) -> DataFrame:
    """Whether a licence was drawn before or after the survey month began; NULL for other months."""
    d1, d2 = _date(survey_start), _date(survey_end)
    start, end, annual = F.col("start_date"), F.col("end_date"), F.col("annual_flag")
    in_month = (start >= d1) & (start < d2)
    touches = start.between(d1, d2) | end.between(d1, d2)
    return df.withColumn(
        "draw_type",
        F.when(annual & in_month, POST_DRAW).when(annual & ~in_month, PRE_DRAW).when(~annual & touches, POST_DRAW),
    )


def purchase_period(
    df: DataFrame, survey_start: Bound, survey_end: Bound, stratify: Column | bool, split_date: Bound = None
) -> DataFrame:
    """Part of the season in which an annual licence was bought."""
    d1, d2, split = _date(survey_start), _date(survey_end), _date(split_date)
    on = stratify if isinstance(stratify, Column) else F.lit(bool(stratify))
    start, annual = F.col("start_date"), F.col("annual_flag") & on
    period = (
        F.when(annual & (start >= d1) & (start < d2), IN_SURVEY)
        .when(annual & split.isNull(), PRE_SURVEY)
        .when(annual & (start < split), EARLY_SEASON)
        .when(annual & (start >= split), LATE_SEASON)
        .otherwise(NOT_SPECIFIED)
    )
    return df.withColumn("purchase_period", period)


def _is_eligible(d1: Column, d2: Column, instant: Column) -> Column:
    start = F.col("start_date")
    half = F.floor(F.datediff("end_date", "start_date") / 2).cast("int")
    annual = (F.col("licence_type") == ANNUAL) & (start < d2)
    term = F.col("licence_type").isin(TERM_TYPES) & (~instant | F.date_add(start, half).between(d1, d2))
    return (start <= d2) & (annual | term)


def eligible(df: DataFrame, periods: Sequence[SurveyPeriod]) -> DataFrame:
    """Licences that count for each survey, one row per licence and survey.

    The calendar is a short job parameter, so it is an array literal exploded in place: each licence is
    tested against every survey inside its own task, with no join, no broadcast and no shuffle.
    """
    surveys = F.array(*(
        F.struct(
            F.lit(p.survey_id).alias(SURVEY),
            F.lit(p.start).alias("survey_start"),
            F.lit(p.end).alias("survey_end"),
            F.lit(p.instant_selection).alias("instant"),
            F.lit(p.period_stratify).alias("period_stratify"),
            F.lit(p.split_date).cast("date").alias("split_date"),
            F.lit(p.stamp_stratify).alias("stamp_stratify"),
        )
        for p in periods
    ))
    columns = [c for c in df.columns if c != SURVEY]
    fields = [SURVEY, "survey_start", "survey_end", "period_stratify", "split_date", "stamp_stratify"]
    rows = df.withColumn("survey", F.explode(surveys))
    rows = rows.where(_is_eligible(F.col("survey.survey_start"), F.col("survey.survey_end"), F.col("survey.instant")))
    return rows.select(*(F.col(f"survey.{f}") for f in fields), *columns)


def stamp_sets(df: DataFrame) -> DataFrame:
    """Strata of surveys with and without the stamp in one key, as grouping sets have it.

    The stamp is NULL in surveys that don't stratify by it; ``strata_set`` is 1 in those that do and 0 elsewhere.
    """
    return df.withColumns({
        "stamp": F.when(F.col("stamp_stratify"), F.col("stamp")),
        "strata_set": F.coalesce(F.col("stamp_stratify"), F.lit(False)).cast("int"),
    })


CALENDAR_COLUMNS = ["survey_start", "survey_end", "period_stratify", "split_date", "stamp_stratify"]


def period_strata(df: DataFrame) -> DataFrame:
    """Stamp and purchase period of eligible licences, from the survey dates they carry."""
    df = stamp_flag(df, F.col("survey_end")) if "stamp_purchase_date" in df.columns else df
    return purchase_period(
        df, F.col("survey_start"), F.col("survey_end"), F.col("period_stratify"), F.col("split_date")
    )


def combined_sales(vendor: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Sales of the category that stands for adults and seniors together, per survey."""
    together = (
        (F.col("resident_status") == NON_RESIDENT)
        & (F.col("licence_type") == ANNUAL)
        & (F.col("age_category") == ADULT_OR_SENIOR)
    )
    return vendor.where(together).groupBy(*keys).agg(F.max("month_total").alias("combined_sales"))


def collapse_age(df: DataFrame, vendor: DataFrame) -> DataFrame:
    """Follow vendors who report adult and senior non-resident annual sales as one category.

    The vendor side is at most one row per survey after its filter and grouping, whatever its input
    size, so it is broadcast: a shuffle on residency and type would put a third of the registry in one task.
    """
    keys = [c for c in (SURVEY,) if c in df.columns and c in vendor.columns] + ["resident_status", "licence_type"]
    combined = combined_sales(vendor, keys)
    joined = df.join(F.broadcast(combined), keys, "left")
    age = F.when(F.col("combined_sales") > 0, ADULT_OR_SENIOR).otherwise(F.col("age_category"))
    return joined.withColumn("age_category", age).select(*df.columns)
