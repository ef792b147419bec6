"""The two analyses. Both are one lazy plan over any number of surveys."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import LicenceYear, SurveyPeriod
from ..domains import (
    AREA_METHOD, DETAIL_CELLS, DRAW_STRATA, DRAW_SUM_CELLS, PERIOD_STRATA, SURVEY, measure_cols,
)
from ..operators import estimate as est
from ..operators import quality as dq
from ..operators.joins import attach_inner, attach_responses, licences_in_period, union_aligned
from ..operators.responses import drop_pii
from ..operators.strata import (
    CALENDAR_COLUMNS, collapse_age, combined_sales, draw_type, eligible, period_strata, stamp_sets,
)
from ..operators.vendor import adult_population, vendor_summary
from .bundle import Bundle

Keep = Callable[[DataFrame], DataFrame]


def lazy(df: DataFrame) -> DataFrame:
    return df


def with_survey(responses: DataFrame, periods: Sequence[SurveyPeriod]) -> DataFrame:
    """Responses of a single survey need not name it."""
    if SURVEY in responses.columns:
        return responses
    if len(periods) != 1:
        raise ValueError(f"Responses of several surveys need a {SURVEY} column.")
    return responses.withColumn(SURVEY, F.lit(periods[0].survey_id))


def instant_strata(periods: Sequence[SurveyPeriod]) -> list[str]:
    """Purchase period strata, with the stamp where surveys ask for it; where only some do, with the set of strata."""
    stamped = {p.stamp_stratify for p in periods}
    extra = ["stamp", "strata_set"] if len(stamped) > 1 else ["stamp"] if stamped == {True} else []
    return [*PERIOD_STRATA, *extra]


class _Analysis(Bundle):
    """What both analyses share once the stratum-by-cell tables are there.

    Subclasses give ``strata``, ``pop``, and two tables: ``sums`` per ``sum_cells`` for the estimates and
    ``spread`` per ``spread_cells`` for the variances.
    """

    strata: Sequence[str]
    sum_cells: Sequence[str]
    spread_cells: Sequence[str]
    need_area = False

    @cached_property
    def full(self) -> DataFrame:
        return est.full_from_cells(self.sums, self.pop, self.strata, self.sum_cells, self.need_area)

    @cached_property
    def survey_summary(self) -> DataFrame:
        return est.survey_summary(self.full)

    @cached_property
    def survey_sample_sizes(self) -> DataFrame:
        return est.survey_sample_sizes(self.full)

    @cached_property
    def survey_specific_variance(self) -> DataFrame:
        return est.variance_from_cells(self.spread, self.strata, self.spread_cells)

    @cached_property
    def detail_estimated_catch(self) -> DataFrame:
        return est.estimate_detail(self.full)

    @cached_property
    def summary_estimated_catch(self) -> DataFrame:
        return est.estimate_summary(self.detail_estimated_catch)

    @cached_property
    def total_variance(self) -> DataFrame:
        return est.total_from_cells(self.spread, self.pop, self.strata, self.spread_cells)

    @cached_property
    def log(self) -> DataFrame:
        return dq.diagnostics(self.violations)


class InstantAnalysis(_Analysis):
    """Instant-selection analysis: responses carry the access key of a licence."""

    def __init__(
        self, periods: Sequence[SurveyPeriod], registry: DataFrame, responses: DataFrame,
        cell_cols: Sequence[str] = DETAIL_CELLS, keep: Keep = lazy,
    ) -> None:
        self.responses = drop_pii(with_survey(responses, periods))
        self.strata = instant_strata(periods)
        licences = period_strata(eligible(registry, periods))
        self.eligible = stamp_sets(licences) if "strata_set" in self.strata else licences
        self.expected_cells = cell_cols
        self.sum_cells = self.spread_cells = [c for c in cell_cols if c in responses.columns]
        self.keep = keep

    @cached_property
    def licences(self) -> DataFrame:
        """Keys and strata of the eligible licences: the registry is cleaned once for all that asks for them."""
        return self.keep(self.eligible.select(SURVEY, "licence_id", "survey_access_key", *self.strata))

    @cached_property
    def pop(self) -> DataFrame:
        return self.keep(est.population(self.licences, "licence_id", self.strata))

    @property
    def licence_summary(self) -> DataFrame:
        return self.pop

    @cached_property
    def states(self) -> DataFrame:
        return self.keep(est.respondent_states(self.responses, "surveykey", self.sum_cells, est.is_counted()))

    @cached_property
    def sums(self) -> DataFrame:
        return self.keep(est.cells_from_states(
            self.states, self.licences, "surveykey", "survey_access_key", self.strata, self.sum_cells
        ))

    @property
    def spread(self) -> DataFrame:
        return self.sums

    @cached_property
    def violations(self) -> DataFrame:
        known = self.licences.select(SURVEY, F.col("survey_access_key").alias("surveykey"))
        known = known.where(F.col("surveykey").isNotNull())
        return self.keep(union_aligned(
            dq.unknown_ids(self.states, known, "surveykey"),
            dq.mixed_answers(self.states, "surveykey").join(
                known.select(SURVEY, F.col("surveykey").alias("key")).distinct(), [SURVEY, "key"], "left_semi"
            ),
            dq.duplicate_licences(self.licences, "licence_id", self.strata),
            dq.duplicate_licences(known, "surveykey", []),
            dq.missing_strata_cols(self.states, self.expected_cells),
            dq.nonpositive_cells(self.sums, self.strata),
        ))

    @cached_property
    def raw_data(self) -> DataFrame:
        return attach_responses(self.responses, self.licences.select(SURVEY, "survey_access_key", *self.strata))


class DrawAnalysis(_Analysis):
    """Pre/post-draw analysis: responses carry a licence id, and vendor sales add to the population."""

    strata = DRAW_STRATA
    spread_cells = AREA_METHOD
    need_area = True

    def __init__(
        self, periods: Sequence[SurveyPeriod], registry: DataFrame, responses: DataFrame,
        vendor: DataFrame, year: LicenceYear, keep: Keep = lazy,
    ) -> None:
        self.responses = drop_pii(with_survey(responses, periods), dates=True)
        self.vendor = vendor
        self.sales = vendor_summary(vendor, periods, year)
        licences = collapse_age(eligible(registry, periods), self.sales)
        self.licences = draw_type(licences, F.col("survey_start"), F.col("survey_end"))
        self.sum_cells = [c for c in DRAW_SUM_CELLS if c in responses.columns]
        self.keep = keep

    @cached_property
    def licence_summary(self) -> DataFrame:
        return self.keep(adult_population(self.licences, self.sales))

    @cached_property
    def pop(self) -> DataFrame:
        return self.licence_summary.select(SURVEY, *DRAW_STRATA, "lic_total")

    @cached_property
    def members(self) -> DataFrame:
        return licences_in_period(self.licences, F.col("survey_start"), F.col("survey_end"))

    @cached_property
    def states(self) -> DataFrame:
        return self.keep(est.respondent_states(self.responses, "licence_id", self.sum_cells, est.is_surveyed()))

    def _cells(self, cells: Sequence[str]) -> DataFrame:
        states = self.states if list(cells) == self.sum_cells else est.rolled_up(self.states, "licence_id", cells)
        return self.keep(est.cells_from_states(states, self.members, "licence_id", "licence_id", DRAW_STRATA, cells))

    @cached_property
    def sums(self) -> DataFrame:
        return self._cells(self.sum_cells)

    @cached_property
    def spread(self) -> DataFrame:
        return self._cells(self.spread_cells)

    @cached_property
    def violations(self) -> DataFrame:
        counted = self.sums.where(F.col(est.COUNTED) > 0)
        return self.keep(union_aligned(
            dq.unknown_ids(self.states, self.licences, "licence_id"),
            dq.catch_without_area(
                counted.select(SURVEY, *DRAW_STRATA, *self.sum_cells, *measure_cols(counted))
            ),
            dq.period_outside(self.licences, self.states),
            dq.grouped_ages(combined_sales(self.sales, [SURVEY])),
            dq.vendor_domains(self.vendor),
            dq.nonpositive_cells(self.spread, DRAW_STRATA),
        ))

    @cached_property
    def raw_data(self) -> DataFrame:
        return attach_inner(self.responses, self.members.drop(*CALENDAR_COLUMNS))


def estimate_inst(
    periods: Sequence[SurveyPeriod], registry: DataFrame, responses: DataFrame,
    cell_cols: Sequence[str] = DETAIL_CELLS, keep: Keep = lazy,
) -> Bundle:
    """Instant-selection analysis of a cleaned registry and normalised responses.

    ``keep`` is applied to the small tables that all results derive from. Jobs pass a checkpoint, so that the
    responses are read once for all results.
    """
    return InstantAnalysis(periods, registry, responses, cell_cols, keep)


def estimate_prepost(
    periods: Sequence[SurveyPeriod], registry: DataFrame, responses: DataFrame, vendor: DataFrame,
    year: LicenceYear, keep: Keep = lazy,
) -> Bundle:
    """Pre/post-draw analysis of a cleaned registry, normalised responses and vendor sales."""
    return DrawAnalysis(periods, registry, responses, vendor, year, keep)
