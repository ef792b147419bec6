"""Estimates in a long layout, for surveys of hundreds of measures of which a response reports a few.

Measures become rows (measure, value) and zeros are left out: the zero-padded kernel adds them back from the sample
size, whichever of them were reported. Plans stay as small as for one measure, and the rows that are shuffled follow
the values reported instead of the columns. All tables are long too; a measure without a row is zero in its cell.
The layout is chosen by the caller.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..domains import AREA_METHOD, SURVEY, measure_cols
from .estimate import is_counted, is_surveyed, padded_variance
from .joins import full_join_ns, quoted

MEASURE = "measure"
PRESENT = 0  # the place of a value that every row has, ahead of the measures


def long_states(responses: DataFrame, unit: str, cells: Sequence[str], counted: Column | None = None) -> DataFrame:
    """Per survey, respondent, cell and ``place`` of a measure that is not zero everywhere: ``total``, the total over
    the rows that count, and whether a row of a surveyed respondent lacks it. One pass, combined before the shuffle.
    """
    counted = is_counted() if counted is None else counted
    # zeros go before rows are made of the columns, so that a response costs as many rows as it reports values;
    # short lists are flattened in a projection, which is compiled, unlike functions of elements or a generator
    value, none = "CAST({m} AS DOUBLE)", "CAST(array() AS ARRAY<STRUCT<place: INT, value: DOUBLE>>)"
    reported = ", ".join(
        f"if({x} <=> 0D, {none}, array(named_struct('place', {i}, 'value', {x})))"
        for i, x in enumerate((value.format(m=quoted(m)) for m in measure_cols(responses)), PRESENT + 1)
    )
    long = responses.select(
        SURVEY, unit, *cells, counted.alias("_counted"), F.coalesce(is_surveyed(), F.lit(False)).alias("_surveyed"),
        F.expr(f"flatten(array({none}, {reported}))" if reported else none).alias("_values"),
    )
    present = f"array(named_struct('place', {PRESENT}, 'value', 1D))"
    # of the bare list Spark would first ask whether it is empty, which computes it twice
    rows = F.expr(f"inline(concat({present}, _values))")
    long = long.select(SURVEY, unit, *cells, "_counted", "_surveyed", rows)
    return long.groupBy(SURVEY, unit, *cells, "place").agg(
        F.expr("coalesce(sum(value), 0D) AS total"),
        F.expr("coalesce(sum(value) FILTER (WHERE _counted), 0D) AS counted"),
        F.expr("bool_or(value IS NULL AND _surveyed) AS gap"),
        F.bool_or("_surveyed").alias("surveyed"),
    )


def long_cells(
    states: DataFrame, registry: DataFrame, response_unit: str, registry_unit: str, strata: Sequence[str],
    cells: Sequence[str], measures: Sequence[str],
) -> DataFrame:
    """(survey, strata, cells, measure, k, total, spread, counted, n): the kernel's inputs for values that are not
    zero, ``n`` the respondents of the stratum with a value in every row.

    A respondent listed several times in the registry counts once per stratum, with as many times its totals.
    """
    members = registry.where(F.col(registry_unit).isNotNull()).groupBy(
        SURVEY, F.col(registry_unit).alias(response_unit), *strata
    ).agg(F.count("*").alias("copies"))
    names = F.array(*map(F.lit, ["", *measures]))

    # sample sizes: all surveyed respondents, less those with a gap in the measure
    people = states.where((F.col("place") == PRESENT) | F.col("gap")).groupBy(SURVEY, response_unit, "place").agg(
        F.bool_or("surveyed").alias("surveyed")
    ).where("surveyed").join(members, [SURVEY, response_unit])
    counts = people.groupBy(SURVEY, *strata, "place").agg(F.count("*").alias("people"))
    whole = counts.where(F.col("place") == PRESENT).select(SURVEY, *strata, F.col("people").alias("surveyed"))
    gaps = counts.where(F.col("place") != PRESENT).select(SURVEY, *strata, "place", F.col("people").alias("gaps"))

    table = states.where(F.col("place") != PRESENT).join(members, [SURVEY, response_unit]).groupBy(
        SURVEY, *strata, *cells, "place"
    ).agg(
        F.count("*").alias("k"), F.expr("sum(total * copies) AS total"), F.expr("var_pop(total * copies) AS spread"),
        F.expr("sum(counted * copies) AS counted"),
    )
    a, b, c = table.alias("a"), whole.alias("b"), gaps.alias("c")
    same = " AND ".join(f"a.{quoted(k)} <=> {{0}}.{quoted(k)}" for k in [SURVEY, *strata])
    joined = a.join(b, F.expr(same.format("b")), "left").join(c, F.expr(same.format("c") + " AND a.place = c.place"), "left")
    return joined.select(
        *(F.col(f"a.{quoted(k)}") for k in [SURVEY, *strata, *cells]), F.get(names, F.col("a.place")).alias(MEASURE),
        "a.k", "a.total", "a.spread", "a.counted", F.expr("b.surveyed - coalesce(c.gaps, 0L) AS n"),
    )


def specific_variance(table: DataFrame, strata: Sequence[str], cells: Sequence[str]) -> DataFrame:
    """Variance of each measure per stratum and cell, from ``long_cells``."""
    kernel = padded_variance("k", "(total / k)", "spread", "n")
    return table.select(SURVEY, *strata, *cells, MEASURE, F.expr(f"{kernel} AS variance"))


def estimate_detail(table: DataFrame, pop: DataFrame, strata: Sequence[str], cells: Sequence[str]) -> DataFrame:
    """Expanded totals per stratum, cell and measure."""
    joined = full_join_ns(pop, table.where("counted <> 0"), [SURVEY, *strata]).where(F.col(MEASURE).isNotNull())
    total = "counted * try_divide(CAST(coalesce(lic_total, 0) AS DOUBLE), n) AS estimate"
    return joined.select(SURVEY, *strata, *cells, MEASURE, F.expr(total))


def estimate_summary(detail: DataFrame, cells: Sequence[str] = AREA_METHOD) -> DataFrame:
    """Expanded totals per cell and measure over all strata."""
    return detail.groupBy(SURVEY, *cells, MEASURE).agg(F.expr("coalesce(sum(estimate), 0D) AS estimate"))


def total_variance(table: DataFrame, pop: DataFrame, strata: Sequence[str], cells: Sequence[str]) -> DataFrame:
    """Variance of the expanded total per cell and measure, with the finite population correction."""
    kernel = padded_variance("k", "(total / k)", "spread", "n")
    joined = full_join_ns(pop.select(SURVEY, *strata, "lic_total"), table, [SURVEY, *strata])
    weighted = F.expr(f"try_divide(CAST(lic_total AS DOUBLE) * (lic_total - n), n) * ({kernel}) AS part")
    return joined.where(F.col(MEASURE).isNotNull()).select(SURVEY, *cells, MEASURE, weighted).groupBy(
        SURVEY, *cells, MEASURE
    ).agg(F.expr("coalesce(sum(part), 0D) AS variance"))
