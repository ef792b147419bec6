"""Stratified expansion estimates and their variances.

Expressions that repeat for every measure are SQL text: a survey has up to some hundred measures, and building
such plans column by column takes longer than running them.

Two forms are offered. The single-step operators (``respondent_sums`` to ``total_variance``) each take and
return one table. ``stratum_cells`` computes everything an estimate needs in one pass over the responses; the
jobs are built on it. Both give the same numbers.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..domains import AREA_METHOD, SURVEY, measure_cols, sample_cols, size_col
from .joins import full_join_ns, quoted

BITS = 62
ANSWERS, COPIES, COUNTED, LEADER, SURVEYED = "_answers", "_copies", "_counted", "_leader", "_surveyed"


def per_measure(measures: Sequence[str], template: str) -> list[Column]:
    """One expression per measure: ``{m}`` is its column, ``{x}`` its bare name in derived names."""
    return [F.expr(template.replace("{m}", quoted(m)).replace("{x}", m)) for m in measures]


def is_counted() -> Column:
    """Rows that say whether the respondent fished."""
    return F.col("did_not_fish").isNotNull()


def is_surveyed() -> Column:
    """Rows that report effort, or that there was none."""
    return (F.col("effort_days") > 0) | F.col("did_not_fish")


# Missing values, even all of them, count as zero.
TOTAL = "coalesce(sum({m}), 0) AS {m}"


def by_survey(df: DataFrame, cols: Sequence[str]) -> list[str]:
    return [*(c for c in (SURVEY,) if c in df.columns), *cols]


def population(registry: DataFrame, unit: str, strata: Sequence[str]) -> DataFrame:
    """Units per stratum, each counted once."""
    keys = by_survey(registry, strata)
    units = registry.select(*keys, unit).distinct()
    return units.groupBy(*keys).agg(F.count("*").alias("lic_total"))


def respondent_sums(df: DataFrame, unit: str, strata: Sequence[str], cells: Sequence[str]) -> DataFrame:
    """Measure totals per respondent, stratum and cell."""
    keys = by_survey(df, [unit, *strata, *cells])
    return df.groupBy(*keys).agg(*per_measure(measure_cols(df), TOTAL))


def cell_sums(df: DataFrame, strata: Sequence[str], cells: Sequence[str], counted: Column | None = None) -> DataFrame:
    """Measure totals per stratum and cell over the rows that count."""
    rows = df.where(is_counted() if counted is None else counted)
    return rows.groupBy(*by_survey(df, [*strata, *cells])).agg(*per_measure(measure_cols(df), TOTAL))


def sample_sizes(df: DataFrame, unit: str, strata: Sequence[str]) -> DataFrame:
    """Respondents per stratum whose every row has a value, measure by measure."""
    measures, keys = measure_cols(df), by_survey(df, strata)
    complete = df.where(is_surveyed()).groupBy(*keys, unit).agg(
        *per_measure(measures, "bool_and({m} IS NOT NULL) AS {m}")
    )
    return complete.groupBy(*keys).agg(*per_measure(measures, "count_if({m}) AS `n_{x}`"))


def max_sample_sizes(sizes: DataFrame, strata: Sequence[str]) -> DataFrame:
    """One row of sample sizes per stratum from a table that may repeat them."""
    known = sizes.where(F.col(size_col("effort_days")).isNotNull())
    return known.groupBy(*by_survey(sizes, strata)).agg(*(F.max(n).alias(n) for n in sample_cols(sizes)))


def padded_variance(k: str, mean: str, spread: str, n: str) -> str:
    """Sample variance of ``n`` values of which ``k`` are known and the others are zero, as SQL text.

    ``mean`` and ``spread`` are the average and population variance of the known ones. NULL for ``n <= 1``.
    """
    centre = f"({k} * {mean} / if({n} > 1, {n}, NULL))"
    squares = f"{k} * {spread} + {k} * pow({mean} - {centre}, 2) + ({n} - {k}) * pow({centre}, 2)"
    return f"({squares}) / if({n} > 1, {n} - 1, NULL)"


def specific_variance(sums: DataFrame, sizes: DataFrame, strata: Sequence[str], cells: Sequence[str]) -> DataFrame:
    """Variance of each measure per stratum and cell, from respondent totals and sample sizes."""
    measures, keys = measure_cols(sums), by_survey(sums, strata)
    spread = sums.groupBy(*keys, *cells).agg(
        F.count("*").alias("k"),
        *per_measure(measures, "avg({m}) AS `avg_{x}`"),
        *per_measure(measures, "var_pop({m}) AS `var_{x}`"),
    )
    joined = full_join_ns(sizes, spread, keys)
    kernel = padded_variance("k", "`avg_{x}`", "`var_{x}`", "`n_{x}`")
    return joined.select(*keys, *cells, *per_measure(measures, kernel + " AS {m}"))


CELL_VARIANCE = (
    "coalesce(sum(try_divide(CAST(lic_total AS DOUBLE) * (lic_total - `n_{x}`), `n_{x}`) * {m}), 0) AS {m}"
)


def total_variance(
    variance: DataFrame, sizes: DataFrame, pop: DataFrame, strata: Sequence[str], cells: Sequence[str]
) -> DataFrame:
    """Variance of the expanded total per cell, with the finite population correction.

    Strata without responses join with a NULL cell, so that cell appears with a zero.
    """
    measures, keys = measure_cols(variance), by_survey(variance, strata)
    weights = full_join_ns(max_sample_sizes(sizes, strata), pop.select(*keys, "lic_total"), keys)
    joined = full_join_ns(weights, variance, keys)
    return joined.groupBy(*by_survey(variance, cells)).agg(*per_measure(measures, CELL_VARIANCE))


def survey_full(pop: DataFrame, sums: DataFrame, sizes: DataFrame, strata: Sequence[str]) -> DataFrame:
    """Population, cell sums and sample sizes side by side; every stratum of any of them is kept."""
    keys = by_survey(sums, strata)
    return full_join_ns(full_join_ns(pop, sums, keys), sizes, keys)


def expansion_rate(full: DataFrame) -> DataFrame:
    """Each sample size replaced by the population units that one respondent stands for."""
    sizes = sample_cols(full)
    rest = [c for c in full.columns if c not in sizes]
    rate = "try_divide(CAST(coalesce(lic_total, 0) AS DOUBLE), {m}) AS {m}"
    return full.select(*rest, *per_measure(sizes, rate))


def estimate_detail(full: DataFrame) -> DataFrame:
    """Expanded totals per stratum and cell."""
    rates = expansion_rate(full)
    measures = measure_cols(full)
    rest = [c for c in full.columns if c not in measures and c not in sample_cols(full)]
    return rates.select(*rest, *per_measure(measures, "{m} * `n_{x}` AS {m}"))


def estimate_summary(detail: DataFrame, cells: Sequence[str] = AREA_METHOD) -> DataFrame:
    """Expanded totals per cell over all strata."""
    return detail.groupBy(*by_survey(detail, cells)).agg(*per_measure(measure_cols(detail), TOTAL))


def survey_summary(full: DataFrame) -> DataFrame:
    return full.drop(*sample_cols(full))


def survey_sample_sizes(full: DataFrame) -> DataFrame:
    return full.drop(*measure_cols(full))


# --- one pass over the responses ---------------------------------------------------------------------------


def _gap_words(measures: Sequence[str]) -> dict[str, str]:
    """Which measures are missing in a row, one bit per measure, as SQL text per word."""
    return {
        f"_gaps{at // BITS}": " | ".join(
            f"if({quoted(m)} IS NULL, {1 << bit}L, 0L)" for bit, m in enumerate(measures[at:at + BITS])
        )
        for at in range(0, len(measures), BITS)
    }


def _complete(i: int) -> str:
    """Whether the respondent has a value of measure ``i`` in every row."""
    return f"(_gaps{i // BITS} & {1 << (i % BITS)}L) = 0"


# Which answers to "did you fish" a respondent gave, one bit each.
ANSWER = "CASE WHEN did_not_fish IS NULL THEN 4 WHEN did_not_fish THEN 1 ELSE 2 END"


def respondent_states(responses: DataFrame, unit: str, cells: Sequence[str], counted: Column) -> DataFrame:
    """One row per survey, respondent and cell, with sums, counts and flags that merge into coarser cells.

    Rows are combined before they are shuffled, so neither a respondent nor a cell with a large part of all rows
    reaches one task. This is the only look that an analysis takes at the responses.
    """
    measures = measure_cols(responses)
    flagged = responses.withColumns({COUNTED: counted, SURVEYED: F.coalesce(is_surveyed(), F.lit(False))})
    return flagged.groupBy(SURVEY, unit, *cells).agg(
        *(F.expr(f"bit_or(if({SURVEYED}, {word}, 0L)) AS {g}") for g, word in _gap_words(measures).items()),
        *per_measure(measures, TOTAL),
        *per_measure(measures, f"coalesce(sum({{m}}) FILTER (WHERE {COUNTED}), 0) AS `counted_{{x}}`"),
        F.count_if(F.col(COUNTED)).alias(COUNTED),
        F.bool_or(SURVEYED).alias(SURVEYED),
        F.expr(f"bit_or({ANSWER}) AS {ANSWERS}"),
    )


def rolled_up(states: DataFrame, unit: str, cells: Sequence[str]) -> DataFrame:
    """``respondent_states`` of fewer cell columns, from those of more."""
    measures = measure_cols(states)
    return states.groupBy(SURVEY, unit, *cells).agg(
        *(F.bit_or(g).alias(g) for g in _gap_words(measures)),
        *per_measure(measures, "sum({m}) AS {m}"),
        *per_measure(measures, "sum(`counted_{x}`) AS `counted_{x}`"),
        F.sum(COUNTED).alias(COUNTED),
        F.bool_or(SURVEYED).alias(SURVEYED),
        F.bit_or(ANSWERS).alias(ANSWERS),
    )


def respondents(states: DataFrame, unit: str, cells: Sequence[str]) -> DataFrame:
    """States beside what the respondent reported over all cells. At most one row per cell meets per respondent."""
    ordered = Window.partitionBy(SURVEY, unit).orderBy(*cells)
    whole = ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return states.withColumns({
        SURVEYED: F.bool_or(SURVEYED).over(whole),
        **{g: F.bit_or(g).over(whole) for g in _gap_words(measure_cols(states))},
        LEADER: F.row_number().over(ordered) == 1,
    })


def respondent_cells(responses: DataFrame, unit: str, cells: Sequence[str], counted: Column) -> DataFrame:
    """One row per survey, respondent and cell, with what the respondent reported over all cells."""
    return respondents(respondent_states(responses, unit, cells, counted), unit, cells)


def stratum_cells(
    responses: DataFrame,
    registry: DataFrame,
    response_unit: str,
    registry_unit: str,
    strata: Sequence[str],
    cells: Sequence[str],
    counted: Column | None = None,
) -> DataFrame:
    """Everything an estimate needs, per stratum and cell, from responses: see ``cells_from_states``."""
    counted = is_counted() if counted is None else counted
    states = respondent_states(responses, response_unit, cells, counted)
    return cells_from_states(states, registry, response_unit, registry_unit, strata, cells)


def cells_from_states(
    states: DataFrame, registry: DataFrame, response_unit: str, registry_unit: str, strata: Sequence[str],
    cells: Sequence[str],
) -> DataFrame:
    """Everything an estimate needs, per stratum and cell.

    ``k`` respondents, their totals (``sum_``), the spread of their totals (``var_``), the totals over the
    rows that count (measure name) and the stratum's sample sizes (``n_``). A respondent listed several
    times in the registry counts once per stratum, with as many times its totals.
    """
    measures = measure_cols(states)
    people = respondents(states, response_unit, cells)
    members = registry.where(F.col(registry_unit).isNotNull()).select(
        SURVEY, F.col(registry_unit).alias(response_unit), *strata
    )
    members = members.groupBy(SURVEY, response_unit, *strata).agg(F.count("*").alias(COPIES))
    joined = people.join(members, [SURVEY, response_unit])

    first = f"{LEADER} AND {SURVEYED}"
    table = joined.groupBy(SURVEY, *strata, *cells).agg(
        F.count("*").alias("k"),
        F.sum(COUNTED).alias(COUNTED),
        F.expr(f"count_if({first}) AS {SURVEYED}"),
        *(F.expr(f"count_if({first} AND {_complete(i)}) AS {quoted(size_col(m))}") for i, m in enumerate(measures)),
        *per_measure(measures, f"sum({{m}} * {COPIES}) AS `sum_{{x}}`"),
        *per_measure(measures, f"var_pop({{m}} * {COPIES}) AS `var_{{x}}`"),
        *per_measure(measures, f"sum(`counted_{{x}}` * {COPIES}) AS {{m}}"),
    )
    keys = ", ".join(quoted(k) for k in [SURVEY, *strata])
    over = f"OVER (PARTITION BY {keys})"
    sizes = per_measure(
        measures, f"if(sum({SURVEYED}) {over} > 0, sum(`n_{{x}}`) {over}, NULL) AS `n_{{x}}`"
    )
    kept = [c for c in table.columns if c != SURVEYED and c not in map(size_col, measures)]
    return table.select(*kept, *sizes)


def full_from_cells(
    table: DataFrame, pop: DataFrame, strata: Sequence[str], cells: Sequence[str], need_area: bool = False
) -> DataFrame:
    """``survey_full`` from ``stratum_cells``: strata without a counted cell keep one row without a cell."""
    measures, keys = measure_cols(table), [SURVEY, *strata]
    shown = F.col(COUNTED) > 0
    if need_area:
        shown = shown & F.col("area").isNotNull()
    sizes = sample_cols(table)
    stratum = Window.partitionBy(*keys)
    spare = (F.row_number().over(stratum.orderBy(*cells)) == 1) & ~F.bool_or(shown).over(stratum)
    rows = table.withColumns({"_shown": shown, "_spare": spare}).where("_shown or _spare")
    blank = per_measure([*cells, *measures], "if(_shown, {m}, NULL) AS {m}")
    return full_join_ns(pop, rows.select(*keys, *blank, *sizes), keys)


CELL_KERNEL = padded_variance("k", "(`sum_{x}` / k)", "`var_{x}`", "`n_{x}`") + " AS {m}"


def variance_from_cells(table: DataFrame, strata: Sequence[str], cells: Sequence[str]) -> DataFrame:
    """``specific_variance`` from ``stratum_cells``."""
    return table.select(SURVEY, *strata, *cells, *per_measure(measure_cols(table), CELL_KERNEL))


def total_from_cells(table: DataFrame, pop: DataFrame, strata: Sequence[str], cells: Sequence[str]) -> DataFrame:
    """``total_variance`` from ``stratum_cells``."""
    measures, keys = measure_cols(table), [SURVEY, *strata]
    variance = table.select(*keys, *cells, *map(size_col, measures), *per_measure(measures, CELL_KERNEL))
    joined = full_join_ns(pop.select(*keys, "lic_total"), variance, keys)
    return joined.groupBy(SURVEY, *cells).agg(*per_measure(measures, CELL_VARIANCE))
