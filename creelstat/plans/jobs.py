"""User-facing jobs: load, check, estimate, write."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import sinks
from ..config import LicenceYear, SurveyPeriod, calendar_frame
from ..domains import FIRST_INSTANT_YEAR, SURVEY, measure_cols, size_col
from ..functions.text import ascii_fold
from ..operators import quality as dq
from ..operators.intake import Intake
from ..operators.joins import attach_inner, attach_responses, raw_join, union_aligned
from ..operators.registry import clean_registry
from ..operators.responses import Labels, drop_pii, load_responses, response_key
from ..operators.strata import CALENDAR_COLUMNS, eligible, stamp_flag
from ..sources import (
    normalise_registry, read_adjustments, read_exclude, read_registry_source, read_responses, read_vendor_sales,
    unread_dates, unread_sales,
)
from .bundle import ESTIMATES, Bundle, checkpointed, ensure_checkpoint_dir, stacked_tables
from .estimators import estimate_inst, estimate_prepost


@dataclass(frozen=True)
class JobConfig:
    """Where the inputs of a licence year are and where its results go.

    ``responses`` and ``adjustments`` map a survey id to a path.
    """

    year: LicenceYear
    periods: Sequence[SurveyPeriod]
    registry: str
    responses: Mapping[str, str]
    output: str
    registry_format: str = "csv"
    responses_format: str = "parquet"
    output_format: str = "parquet"
    exclude: str | None = None
    adjustments: Mapping[str, str] = field(default_factory=dict)
    vendor_sales: str | None = None
    labels: Labels = None


def load_registry(spark: SparkSession, cfg: JobConfig) -> tuple[DataFrame, DataFrame]:
    """The cleaned registry and what its checks found."""
    source = read_registry_source(spark, cfg.registry, cfg.registry_format)
    raw = normalise_registry(source)
    clean = clean_registry(raw, cfg.year)
    return clean, union_aligned(
        dq.unread_values(unread_dates(source), "registry"), dq.registry_counts(raw, cfg.year),
        dq.category_codes(clean), dq.empty_input(clean, "cleaned registry"), dq.missing_licence_ids(clean),
    )


def _find_responses(spark: SparkSession, cfg: JobConfig, period: SurveyPeriod) -> DataFrame | None:
    path = cfg.responses.get(period.survey_id)
    if path is None:
        return None
    try:
        return read_responses(spark, path, cfg.responses_format)
    except AnalysisException as problem:
        if problem.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def _load_survey(
    spark: SparkSession, cfg: JobConfig, period: SurveyPeriod, raw: DataFrame, exclude: DataFrame | None
) -> tuple[DataFrame, Intake, list[DataFrame]]:
    """Normalised responses, the gates that are counted as they are read, and the findings of the side files."""
    intake = Intake.of(period.survey_id, raw, period.modern_responses, exclude)
    adjusted = cfg.adjustments.get(period.survey_id)
    adjustments = read_adjustments(spark, adjusted)
    if adjustments is not None:
        adjustments = adjustments.withColumn(SURVEY, F.lit(period.survey_id))
    loaded = load_responses(intake.watched(), period.modern_responses, cfg.labels, exclude, adjustments)
    found = []
    if adjusted and adjustments is None:
        found.append(dq.message(spark, "no_adjustments", dq.WARNING, period.survey_id, "no adjusted rows at the given path"))
    if adjustments is not None:
        name = response_key(adjustments)
        found.append(dq.mixed_dnf(adjustments, name))
        found.append(dq.mixed_null(adjustments, name, measure_cols(adjustments)))
    return loaded, intake, found


Unasked = dict[str, list[str]]


@dataclass
class Surveys:
    """Surveys that have responses, and those responses stacked.

    ``intakes`` are their gates, to be asked once the responses were read; ``found`` is what other checks found.
    ``unasked`` has by measure the surveys that did not ask it. Such measures are zero while they are counted;
    ``withhold`` takes them out of the results.
    """

    periods: list[SurveyPeriod]
    responses: DataFrame
    intakes: list[Intake]
    found: list[DataFrame]
    unasked: Unasked


def load_surveys(spark: SparkSession, cfg: JobConfig) -> Surveys:
    exclude = read_exclude(spark, cfg.exclude)
    present, frames, intakes, found = [], [], [], []
    if exclude is None:
        found.append(dq.message(spark, "no_exclusions", dq.WARNING, cfg.exclude or "(none)", "nobody is excluded"))
    for period in cfg.periods:
        raw = _find_responses(spark, cfg, period)
        if raw is None:
            found.append(dq.message(spark, "missing_survey", dq.WARNING, period.survey_id, "no survey data"))
            continue
        responses, intake, findings = _load_survey(spark, cfg, period, raw, exclude)
        present.append(period)
        frames.append(responses)
        intakes.append(intake)
        found += findings
    if not frames:
        raise ValueError("No survey data for any period.")
    asked = list(dict.fromkeys(m for frame in frames for m in measure_cols(frame)))
    unasked: Unasked = {}
    for i, (period, frame) in enumerate(zip(present, frames)):
        for measure in (m for m in asked if m not in frame.columns):
            found.append(dq.message(spark, "missing_measure", dq.WARNING, period.survey_id, measure))
            frames[i] = frames[i].withColumn(measure, F.lit(0))
            unasked.setdefault(measure, []).append(period.survey_id)
    return Surveys(present, union_aligned(*frames), intakes, found, unasked)


def withhold(df: DataFrame, unasked: Unasked) -> DataFrame:
    """NULL in the columns of a measure, and of its sample size, for the surveys that did not ask it."""
    return df.withColumns({
        c: F.when(~F.col(SURVEY).isin(surveys), F.col(c))
        for measure, surveys in unasked.items() for c in (measure, size_col(measure)) if c in df.columns
    })


def _publish_and_enforce(cfg: JobConfig, fatal: DataFrame, everything: DataFrame | None = None) -> None:
    """Stop at errors, with every violation written whole first. Without errors only ``everything`` is written."""
    try:
        dq.enforce(fatal)
    except dq.QualityError:
        sinks.write_table(fatal if everything is None else everything, f"{cfg.output}/violations", cfg.output_format)
        raise
    if everything is not None:
        sinks.write_table(everything, f"{cfg.output}/violations", cfg.output_format)


def run(spark: SparkSession, cfg: JobConfig) -> Bundle:
    """Load and estimate, with the small tables checkpointed so that all results share one pass.

    The responses are read once, to combine them per respondent, and a survey in which that read counted violations
    a second time to spell them out. All violations with all their keys go to the dataset ``violations`` of the output
    before an error stops the job; the log keeps a short form.
    """
    ensure_checkpoint_dir(spark)
    registry, registry_findings = load_registry(spark, cfg)
    surveys = load_surveys(spark, cfg)
    periods, unasked = surveys.periods, surveys.unasked
    calendar = calendar_frame(spark, cfg.year, periods)
    found = [
        registry_findings, dq.period_same_month(calendar), dq.split_date_in_year(calendar), dq.strata_settings(calendar),
        *surveys.found,
    ]
    if cfg.year.start.year < FIRST_INSTANT_YEAR:
        if cfg.vendor_sales is None:
            raise ValueError("A vendor sales file must exist.")
        vendor = read_vendor_sales(spark, cfg.vendor_sales)
        found.append(dq.unread_values(unread_sales(spark, cfg.vendor_sales), "vendor sales"))
        found += [dq.vendor_months(vendor, p.month_name, cfg.year) for p in periods]
        bundle = estimate_prepost(periods, registry, surveys.responses, vendor, cfg.year, checkpointed)
    else:
        bundle = estimate_inst(periods, registry, surveys.responses, keep=checkpointed)
    bundle.states  # the read of the responses, in which their gates are counted
    before = checkpointed(union_aligned(*found, *(intake.violations() for intake in surveys.intakes)))
    _publish_and_enforce(cfg, before)
    _publish_and_enforce(cfg, bundle.violations, union_aligned(before, bundle.violations))
    for name in ESTIMATES[1:] if unasked else ():  # the first, the population, has no measures
        setattr(bundle, name, withhold(getattr(bundle, name), unasked))
    log = dq.diagnostics(before, bundle.violations)
    bundle.log = log.withColumns({c: ascii_fold(F.col(c)) for c in ("detail", "sample")})
    return bundle


def run_month(spark: SparkSession, cfg: JobConfig) -> Bundle:
    """Analyse one survey and write its tables."""
    if len(cfg.periods) != 1:
        raise ValueError("A month has exactly one survey.")
    bundle = run(spark, cfg)
    sinks.write_bundle(bundle.tables(), cfg.output, cfg.output_format)
    return bundle


def run_annual(spark: SparkSession, cfg: JobConfig) -> Bundle:
    """Analyse all surveys of a licence year in one plan and write the stacked tables."""
    bundle = run(spark, cfg)
    sinks.write_annual(stacked_tables(bundle, cfg.periods), cfg.output, cfg.output_format)
    return bundle


def export_responses(registry: DataFrame, responses: DataFrame, period: SurveyPeriod) -> DataFrame:
    """Adjusted responses with the licence they belong to, without personal columns."""
    licences = stamp_flag(eligible(registry, [period]), period.end).drop(SURVEY, *CALENDAR_COLUMNS)
    own = drop_pii(responses)
    if response_key(own) == "surveykey":
        return attach_responses(own, licences)
    return attach_inner(own, licences)


def raw_export(registry: DataFrame, responses: DataFrame, null_keys: bool = False) -> DataFrame:
    """Registry and responses as delivered, matched on the access key, with everything unmatched."""
    return raw_join(
        registry.toDF(*(c.lower() for c in registry.columns)),
        responses.toDF(*(c.lower() for c in responses.columns)),
        null_keys,
    )


def refresh_registry(new: DataFrame, old: DataFrame | None, path: str, unit: str = "full_licence_id") -> str:
    """Write a new registry snapshot; refused when it lost ids of the previous one or the path exists."""
    if old is not None:
        dq.enforce(dq.registry_regression(old, new, unit))
    sinks.write_table(new, path)
    return path
