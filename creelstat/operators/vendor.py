"""Paper licence sales reported by vendors, and the population they add up to."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import LicenceYear, SurveyPeriod
from ..domains import ANNUAL, DRAW_STRATA, JUVENILE, MONTHS, POST_DRAW, PRE_DRAW, SURVEY
from .joins import full_join_ns

CATEGORY = ["resident_status", "licence_type", "age_category"]


def months_before(month: str, year: LicenceYear) -> list[str]:
    """Months of the licence year that come before ``month``."""
    first = year.end.month % 12
    order = MONTHS[first:] + MONTHS[:first]
    return order[: order.index(month)]


def _sales(months: Sequence[str]) -> Column:
    total = F.lit(0.0)
    for month in months:
        total = total + F.coalesce(F.col(month).cast("double"), F.lit(0.0))
    return total


def vendor_summary(vendor: DataFrame, periods: Sequence[SurveyPeriod], year: LicenceYear) -> DataFrame:
    """Sales in each survey's month and in the months before it, one row per survey and category."""
    per_survey = F.array(*(
        F.struct(
            F.lit(p.survey_id).alias(SURVEY),
            _sales(months_before(p.month_name, year)).alias("before_month_total"),
            F.col(p.month_name).cast("double").alias("month_total"),
        )
        for p in periods
    ))
    return vendor.select(*CATEGORY, F.inline(per_survey)).select(
        SURVEY, *CATEGORY, "before_month_total", "month_total"
    )


def vendor_population(summary: DataFrame) -> DataFrame:
    """Vendor sales by draw: the month's sales after the draw, earlier annual sales before it."""
    draws = F.array(
        F.struct(F.lit(POST_DRAW).alias("draw_type"), F.col("month_total").alias("sold"),
                 (F.col("month_total") > 0).alias("counts")),
        F.struct(F.lit(PRE_DRAW).alias("draw_type"), F.col("before_month_total").alias("sold"),
                 (F.col("licence_type") == ANNUAL).alias("counts")),
    )
    rows = summary.select(SURVEY, *CATEGORY, F.inline(draws)).where("counts")
    return rows.groupBy(SURVEY, *DRAW_STRATA).agg(F.coalesce(F.sum("sold"), F.lit(0.0)).alias("vlic_total"))


def electronic_population(registry: DataFrame) -> DataFrame:
    """Electronic licences per draw stratum."""
    drawn = registry.where(F.col("draw_type").isNotNull())
    return drawn.groupBy(SURVEY, *DRAW_STRATA).agg(F.count("*").cast("double").alias("elic_total"))


def merge_populations(vendor: DataFrame, electronic: DataFrame) -> DataFrame:
    """Vendor and electronic licences per draw stratum and their sum."""
    merged = full_join_ns(vendor, electronic, [SURVEY, *DRAW_STRATA])
    merged = merged.fillna(0.0, ["vlic_total", "elic_total"])
    return merged.withColumn("lic_total", F.col("vlic_total") + F.col("elic_total"))


def licence_population(registry: DataFrame, summary: DataFrame) -> DataFrame:
    """Whole licence population per draw stratum."""
    return merge_populations(vendor_population(summary), electronic_population(registry))


def adult_population(registry: DataFrame, summary: DataFrame) -> DataFrame:
    """The licence population that surveys are expanded to: juveniles are not surveyed."""
    return licence_population(registry, summary).where(F.col("age_category") != JUVENILE)
