"""Data-quality gates.

Each gate returns a table of violations ``(check, severity, key, detail)``, with the ``survey_id`` in front where
the checked rows have one; an empty table is a pass. Gates are lazy. ``enforce`` is the one action: it stops the job when any violation is an error.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import LicenceYear
from ..domains import (
    ADULT_OR_SENIOR, AGES, COMPLETE, DETAIL_CELLS, INCOMPLETE, LICENCE_TYPES, MAX_MISSING_KEY_RATIO, MONTHS, RESIDENCY, SURVEY,
    UNSOLD_FISHER_ID, VENDOR_SALES_OPTIONAL_FROM, measure_cols, size_col,
)
from ..functions.text import strip
from .estimate import ANSWERS, by_survey
from .joins import missing_ids, union_aligned
from .registry import AGE_CODES, CODE, FAMILY_CODE, RESIDENCY_CODES, TYPE_CODES, date_registry, term_length
from .vendor import CATEGORY

ERROR, WARNING, INFO = "ERROR", "WARNING", "INFO"
SAMPLE = 10
# Counts reported for the record: none of them stops a job, whatever its severity.
REPORT_ONLY = ["registry_counts"]
SCHEMA = "check string, severity string, key string, detail string"


class QualityError(ValueError):
    """Raised by ``enforce`` when a gate found an error."""


def _violations(df: DataFrame, check: str, severity: Column | str, key: Column | None, detail: Column | str) -> DataFrame:
    level = severity if isinstance(severity, Column) else F.lit(severity)
    text = detail if isinstance(detail, Column) else F.lit(detail)
    shown = F.lit(None) if key is None else key
    return df.select(
        *(c for c in (SURVEY,) if c in df.columns),
        F.lit(check).alias("check"), level.alias("severity"), shown.cast("string").alias("key"), text.alias("detail")
    )


def message(spark: SparkSession, check: str, severity: str, key: str, detail: str) -> DataFrame:
    """A finding that is known before any data is read."""
    return spark.createDataFrame([(check, severity, key, detail)], SCHEMA)


def domain(df: DataFrame, column: str, values: Sequence) -> DataFrame:
    """Distinct values outside a domain; a missing value is outside."""
    inside = F.coalesce(F.col(column).isin(list(values)), F.lit(False))
    bad = df.select(column).where(~inside).distinct()
    return _violations(bad, "domain", ERROR, F.col(column), f"{column} is not a known value")


def completion(df: DataFrame, column: str = "completesurvey") -> DataFrame:
    """Completion answers outside their domain, white space aside."""
    return domain(df.withColumn(column, strip(F.col(column))), column, [COMPLETE, INCOMPLETE])


def category_codes(df: DataFrame) -> DataFrame:
    """Unknown letters in licence category codes."""
    code = F.col(CODE)
    tests = [
        ("residency", F.substring(code, 1, 1), RESIDENCY_CODES),
        ("age", F.substring(code, 3, 1), AGE_CODES),
        ("licence type", F.substring(code, 2, 1), TYPE_CODES),
    ]
    letters = F.array(*(
        F.struct(F.lit(name).alias("part"), letter.alias("letter"), letter.isin(list(known)).alias("known"))
        for name, letter, known in tests
    ))
    bad = df.select(F.inline(letters)).where(~F.coalesce("known", F.lit(False))).select("part", "letter").distinct()
    return _violations(bad, "category_codes", ERROR, F.col("letter"), F.concat(F.lit("unknown code for "), "part"))


def mixed_dnf(df: DataFrame, key: str) -> DataFrame:
    """Keys that both fished and did not fish; a missing answer counts as a third one."""
    flag = F.col("did_not_fish")
    answers = [flag, ~flag, flag.isNull()]
    seen = df.groupBy(*by_survey(df, [key])).agg(*(F.coalesce(F.bool_or(a), F.lit(False)).alias(f"a{i}") for i, a in enumerate(answers)))
    kinds = reduce(Column.__add__, (F.col(f"a{i}").cast("int") for i in range(len(answers))))
    return _violations(seen.where(kinds > 1), "mixed_dnf", ERROR, F.col(key), "fished and did not fish")


def mixed_null(df: DataFrame, key: str, measures: Sequence[str]) -> DataFrame:
    """Adjusted keys with a measure that is missing in some of their rows only."""
    counts = df.groupBy(key).agg(F.count("*").alias("rows"), *(F.count(m).alias(m) for m in measures))
    long = counts.unpivot([key, "rows"], list(measures), "measure", "filled")
    partly = long.where((F.col("filled") > 0) & (F.col("filled") < F.col("rows")))
    return _violations(partly, "mixed_null", ERROR, F.col(key), F.col("measure"))


def unpivot_status(df: DataFrame, key: str, measures: Sequence[str]) -> DataFrame:
    """Per key and measure, whether its values are all missing or all present."""
    counts = df.groupBy(key).agg(F.count("*").alias("rows"), *(F.count(m).alias(m) for m in measures))
    long = counts.unpivot([key, "rows"], list(measures), "col_name", "filled")
    whole = (F.col("filled") == 0) | (F.col("filled") == F.col("rows"))
    return long.select(key, "col_name", whole.alias("status"))


def missing_key_ratio(df: DataFrame, key: str, limit: float = MAX_MISSING_KEY_RATIO) -> DataFrame:
    """Responses without a key: an error when they exceed a share of all responses."""
    counts = df.agg(F.count_if(F.col(key).isNull()).alias("missing"), F.count("*").alias("n"))
    level = F.when(F.col("missing") > F.col("n") * limit, ERROR).otherwise(WARNING)
    detail = F.concat_ws(" of ", F.col("missing").cast("string"), F.col("n").cast("string"))
    return _violations(counts.where(F.col("missing") > 0), "missing_key_ratio", level, F.lit(key), detail)


def empty_input(df: DataFrame, name: str) -> DataFrame:
    """An input without rows."""
    counted = df.limit(1).agg(F.count("*").alias("n")).where(F.col("n") == 0)
    return _violations(counted, "empty_input", ERROR, F.lit(name), "no rows")


def counted(df: DataFrame, check: str, key: str, detail: str) -> DataFrame:
    """How many rows there are, for the record; nothing if there are none."""
    n = df.agg(F.count("*").alias("n")).where(F.col("n") > 0)
    return _violations(n, check, INFO, F.lit(key), F.concat_ws(" ", F.col("n").cast("string"), F.lit(detail)))


def unread_values(values: DataFrame, source: str) -> DataFrame:
    """Text of a source, as (column, value), that should be a date or a number and isn't."""
    detail = F.concat(F.lit(f"{source}: "), "column", F.lit(" can't be read"))
    return _violations(values, "unread_value", ERROR, F.col("value"), detail)


def missing_licence_ids(registry: DataFrame) -> DataFrame:
    """Licences without an id of their own, which would count as one."""
    bad = registry.where(F.col("licence_id").isNull()).select("full_licence_id").distinct()
    return _violations(bad, "missing_licence_id", ERROR, F.col("full_licence_id"), "no licence id")


def catch_without_area(sums: DataFrame, measures: Sequence[str] | None = None) -> DataFrame:
    """Catch or effort in cells without an area."""
    names = measure_cols(sums) if measures is None else measures
    caught = reduce(Column.__add__, (F.coalesce(F.col(m), F.lit(0)) for m in names))
    bad = sums.where(F.col("area").isNull()).withColumn("caught", caught).where(F.col("caught") > 0)
    key = F.concat_ws(", ", *(c for c in sums.columns if c not in measure_cols(sums)))
    return _violations(bad, "catch_without_area", ERROR, key, F.col("caught").cast("string"))


def nonpositive_sample(cells: DataFrame, sizes: DataFrame, strata: Sequence[str], measures: Sequence[str]) -> DataFrame:
    """Strata with data in a cell and no respondent with a value, measure by measure."""
    keys = by_survey(sizes, strata)
    present = cells.select(*keys, F.lit(True).alias("has_cells"), *(F.lit(None).cast("bigint").alias(size_col(m)) for m in measures))
    known = sizes.select(*keys, F.lit(False).alias("has_cells"), *(F.col(size_col(m)).cast("bigint") for m in measures))
    merged = present.unionByName(known).groupBy(*keys).agg(
        F.bool_or("has_cells").alias("has_cells"), *(F.max(size_col(m)).alias(size_col(m)) for m in measures)
    )
    merged = merged.where("has_cells").select(
        F.concat_ws(", ", *(F.coalesce(F.col(k).cast("string"), F.lit("?")) for k in keys)).alias("stratum"),
        *(F.coalesce(F.col(size_col(m)), F.lit(0)).alias(m) for m in measures),
    )
    long = merged.unpivot(["stratum"], list(measures), "measure", "n")
    return _violations(long.where(F.col("n") <= 0), "nonpositive_sample", ERROR, F.col("stratum"), F.col("measure"))


def nonpositive_cells(table: DataFrame, strata: Sequence[str]) -> DataFrame:
    """``nonpositive_sample`` for a ``stratum_cells`` table, which carries its sample sizes."""
    measures = measure_cols(table)
    survey = by_survey(table, [])
    rows = table.select(
        *survey,
        F.concat_ws(", ", *(F.coalesce(F.col(k).cast("string"), F.lit("?")) for k in strata)).alias("stratum"),
        *(F.coalesce(F.col(size_col(m)), F.lit(0)).alias(m) for m in measures),
    )
    long = rows.unpivot([*survey, "stratum"], measures, "measure", "n").where(F.col("n") <= 0).distinct()
    return _violations(long, "nonpositive_sample", ERROR, F.col("stratum"), F.col("measure"))


def unknown_ids(responses: DataFrame, registry: DataFrame, key: str) -> DataFrame:
    """Response keys that the registry lacks."""
    keys = by_survey(responses, [key])
    return _violations(missing_ids(responses, registry, keys), "unknown_ids", WARNING, F.col(key), "not in the registry")


def registry_counts(df: DataFrame, year: LicenceYear) -> DataFrame:
    """How many registry rows each cleaning rule touched, from one pass over the normalised registry."""
    open_, end = F.lit(year.sales_open), F.lit(year.end)
    early = F.year("start_date") < F.col("lic_year")
    term = term_length(F.col(CODE))
    raw = df.withColumns({
        "early": F.coalesce(early, F.lit(False)),
        "term": term,
        "stamp_in": F.coalesce(F.col("stamp_purchase_date").between(open_, end), F.lit(False)),
        "stamp_given": F.col("stamp_purchase_date").isNotNull(),
    })
    rows = date_registry(raw, year).withColumn("good_from", F.greatest("start_date", "purchase_date"))

    sold = F.coalesce(F.col("fisher_id") != UNSOLD_FISHER_ID, F.lit(False))
    in_year = sold & F.coalesce(F.col("good_from").between(year.start, year.end), F.lit(False))
    blank = F.coalesce(F.col(CODE), F.lit("")) == ""
    family = F.col(CODE).startswith(FAMILY_CODE)
    named = in_year & ~blank
    rules = [
        ("start_date_unfixable", ERROR, F.col("early") & F.col("term").isNull()),
        ("start_date_fixed", WARNING, F.col("early") & F.col("term").isNotNull()),
        ("purchase_date_invalid", WARNING, F.col("purchase_date").isNull()),
        ("stamp_date_invalid", WARNING, F.col("stamp_given") & ~F.col("stamp_in")),
        ("unsold", INFO, ~sold),
        ("blank", INFO, sold & blank),
        ("out_of_year", WARNING, sold & ~in_year),
        ("family", INFO, named & family),
        ("kept", INFO, named & ~family),
    ]
    counts = rows.agg(*(F.count_if(test).alias(name) for name, _, test in rules))
    listed = F.array(*(
        F.struct(F.lit(level).alias("severity"), F.lit(name).alias("key"), F.col(name).cast("string").alias("detail"))
        for name, level, _ in rules
    ))
    found = counts.select(F.inline(listed)).where((F.col("severity") == INFO) | (F.col("detail") != "0"))
    return found.select(F.lit("registry_counts").alias("check"), "severity", "key", "detail")


def duplicate_licences(registry: DataFrame, unit: str, strata: Sequence[str]) -> DataFrame:
    """How many registry rows repeat a unit within its stratum."""
    copies = registry.groupBy(*by_survey(registry, [unit, *strata])).agg((F.count("*") - 1).alias("extra"))
    counted = copies.groupBy(*by_survey(registry, [])).agg(F.coalesce(F.sum("extra"), F.lit(0)).alias("extra")).where(F.col("extra") > 0)
    return _violations(counted, "duplicate_licences", INFO, F.lit(unit), F.col("extra").cast("string"))


def registry_regression(old: DataFrame, new: DataFrame, unit: str = "full_licence_id") -> DataFrame:
    """Ids of the previous snapshot that the new one lacks."""
    return _violations(
        missing_ids(old, new, unit), "registry_regression", ERROR, F.col(unit), "missing from the new snapshot"
    )


def period_same_month(calendar: DataFrame) -> DataFrame:
    """Surveys that start and end in different months."""
    apart = F.date_format("survey_start", "yyyy-MM") != F.date_format("survey_end", "yyyy-MM")
    return _violations(
        calendar.where(apart), "period_same_month", WARNING, F.col("survey_id"), "start and end in different months"
    )


def split_date_in_year(calendar: DataFrame) -> DataFrame:
    """Split dates outside the licence year, or given without period strata."""
    split = F.col("period_stratify_date")
    reasons = (
        F.when(~F.coalesce("period_stratify", F.lit(False)), "split date without period strata")
        .when(split < F.col("lic_start"), "split date before the licence year")
        .when(split > F.col("lic_end"), "split date after the licence year")
    )
    bad = calendar.where(split.isNotNull()).withColumn("reason", reasons).where(F.col("reason").isNotNull())
    return _violations(bad, "split_date_in_year", ERROR, F.col("survey_id"), F.col("reason"))


def period_outside(licences: DataFrame, responses: DataFrame) -> DataFrame:
    """Licences of respondents that were not good in their survey's period."""
    outside = licences.where((F.col("end_date") < F.col("survey_start")) | (F.col("start_date") > F.col("survey_end")))
    keys = by_survey(licences, ["licence_id"])
    bad = outside.select(*keys, "full_licence_id").distinct().join(responses.select(*keys).distinct(), keys, "left_semi")
    return _violations(bad, "period_outside", WARNING, F.col("full_licence_id"), "not good in the survey period")


def vendor_months(vendor: DataFrame, month: str, year: LicenceYear) -> DataFrame:
    """Vendor sales need the twelve months, and sales in the survey month in years before 2015."""
    names = [c for c in vendor.columns if c not in CATEGORY]
    problems = [(c, "not a month") for c in names if c not in MONTHS]
    problems += [(m, "month missing") for m in MONTHS if m not in names]
    found = [
        _violations(vendor.sparkSession.range(1), "vendor_months", ERROR, F.lit(key), detail) for key, detail in problems
    ]
    if month in names:
        required = year.end.year < VENDOR_SALES_OPTIONAL_FROM
        sold = vendor.agg(F.coalesce(F.sum(month), F.lit(0)).alias("sold")).where((F.col("sold") == 0) & F.lit(required))
        found.append(_violations(sold, "vendor_months", ERROR, F.lit(month), "no sales in the survey month"))
    return union_aligned(*found)


def vendor_domains(vendor: DataFrame) -> DataFrame:
    """Residency, type and age labels of the vendor sales."""
    return union_aligned(
        domain(vendor, "resident_status", RESIDENCY),
        domain(vendor, "licence_type", LICENCE_TYPES),
        domain(vendor, "age_category", AGES),
    )


def missing_strata_cols(responses: DataFrame, expected: Sequence[str] = DETAIL_CELLS) -> DataFrame:
    """Cell columns that a survey's responses lack: absent, or without any value, in one aggregate over all surveys.

    Where surveys are stacked, a column that only some of them have is NULL in the others, so those have one cell of
    it and their estimates are as if it were not there.
    """
    held = [F.count(c).alias(c) if c in responses.columns else F.lit(0).cast("long").alias(c) for c in expected]
    surveys = by_survey(responses, [])
    counts = responses.groupBy(*surveys).agg(F.count("*").alias("rows"), *held).where(F.col("rows") > 0)
    long = counts.unpivot(surveys, list(expected), "column", "n").where(F.col("n") == 0)
    return _violations(long, "missing_strata_cols", WARNING, F.col("column"), "column missing")


def mixed_answers(states: DataFrame, key: str) -> DataFrame:
    """``mixed_dnf`` from respondent states, which carry a bit for each kind of answer."""
    seen = states.groupBy(*by_survey(states, [key])).agg(F.bit_or(ANSWERS).alias(ANSWERS))
    return _violations(
        seen.where(F.bit_count(ANSWERS) > 1), "mixed_dnf", ERROR, F.col(key), "fished and did not fish"
    )


def grouped_ages(collapsed: DataFrame) -> DataFrame:
    """Surveys whose vendors report adult and senior non-resident annual sales as one category."""
    sold = collapsed.where(F.col("combined_sales") > 0).select(*by_survey(collapsed, [])).distinct()
    return _violations(
        sold, "ages_grouped", WARNING, F.lit(ADULT_OR_SENIOR), "adult and senior non-resident licences are grouped"
    )


def strata_settings(calendar: DataFrame) -> DataFrame:
    """What each survey stratifies by, for the record."""
    settings = F.array(
        F.struct(F.lit("stamp_stratify").alias("key"), F.col("stamp_stratify").cast("string").alias("value")),
        F.struct(F.lit("period_stratify").alias("key"), F.col("period_stratify").cast("string").alias("value")),
        F.struct(
            F.lit("period_stratify_date").alias("key"), F.col("period_stratify_date").cast("string").alias("value")
        ),
    )
    rows = calendar.select(SURVEY, F.inline(settings))
    return _violations(
        rows, "strata_settings", INFO, F.col("key"), F.concat(F.lit("set to "), F.coalesce("value", F.lit("nothing")))
    )


def sample_text(df: DataFrame, group: Sequence[str], column: str, n: int = SAMPLE, collapse: str = "\n") -> DataFrame:
    """The first ``n`` distinct values of each group as text, with how many more there are.

    Values are ranked with a limit, which Spark applies before the shuffle too, so no group is gathered whole.
    """
    values = df.select(*group, F.col(column).cast("string").alias("value")).where("value is not null").distinct()
    counts = values.groupBy(*group).agg(F.count("*").alias("n_values"))
    rank = F.row_number().over(Window.partitionBy(*(F.col(g) for g in group)).orderBy("value"))
    shown = values.withColumn("rank", rank).where(F.col("rank") <= n)
    texts = shown.groupBy(*group).agg(F.array_join(F.array_sort(F.collect_list("value")), collapse).alias("shown"))
    joined = counts.join(texts, list(group))
    more = F.col("n_values") - n
    # fixed value: how messages end that leave keys out
    text = F.when(more > 0, F.concat("shown", F.lit(f"{collapse}...+"), more.cast("string"), F.lit(" more...")))
    return joined.select(*group, "n_values", text.otherwise(F.col("shown")).alias("sample"))


def diagnostics(*violations: DataFrame) -> DataFrame:
    """The message table of a job: per finding, how many keys it concerns and a sample of them."""
    found = union_aligned(*violations).withColumn("key", F.coalesce("key", F.lit("(none)")))
    if SURVEY not in found.columns:
        found = found.withColumn(SURVEY, F.lit(None).cast("string"))
    group = [SURVEY, "severity", "check", "detail"]
    found = found.withColumns({c: F.coalesce(c, F.lit("")) for c in group})
    messages = sample_text(found, group, "key", SAMPLE, ", ")
    return messages.select(
        F.nullif(SURVEY, F.lit("")).alias(SURVEY), "severity", F.col("check").alias("code"), "detail",
        F.col("n_values").alias("n"), "sample",
    )


def enforce(violations: DataFrame) -> None:
    """Stop when any violation is an error, naming the first few."""
    fatal = (F.col("severity") == ERROR) & ~F.col("check").isin(REPORT_ONLY)
    errors = violations.where(fatal).limit(SAMPLE).collect()
    if errors:
        raise QualityError("; ".join(f"{r['check']}: {r['key']} {r['detail']}" for r in errors))
