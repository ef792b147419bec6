"""Job parameters: licence years and survey periods."""

from __future__ import annotations

import calendar as _cal
import datetime as dt
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from .domains import FIRST_INSTANT_YEAR, FIRST_MODERN_SURVEY, MONTHS, SURVEY, YEAR_START_MONTH


def shift_months(day: dt.date, months: int) -> dt.date:
    """``day`` moved by whole months, held to the last day of a shorter month."""
    index = day.year * 12 + day.month - 1 + months
    year, month = divmod(index, 12)
    last = _cal.monthrange(year, month + 1)[1]
    return dt.date(year, month + 1, min(day.day, last))


def licence_year_label(year: int) -> str:
    """``2020 -> '2020-21'``; the second part is not padded (``2008-9``)."""
    return f"{year}-{(year + 1) % 100}"


@dataclass(frozen=True)
class LicenceYear:
    start: dt.date
    end: dt.date

    @classmethod
    def ending(cls, end: dt.date) -> LicenceYear:
        return cls(shift_months(end, -12) + dt.timedelta(days=1), end)

    @property
    def sales_open(self) -> dt.date:
        """Licences go on sale up to a month before the year starts."""
        return shift_months(self.start, -1)

    @property
    def label(self) -> str:
        return licence_year_label(self.start.year)


@dataclass(frozen=True)
class SurveyPeriod:
    """One survey: usually a calendar month inside a licence year."""

    survey_id: str
    start: dt.date
    end: dt.date
    period_stratify: bool = False
    split_date: dt.date | None = None
    stamp_stratify: bool = False

    @classmethod
    def month_from(cls, start: dt.date, **options) -> SurveyPeriod:
        end = shift_months(start, 1) - dt.timedelta(days=1)
        return cls(f"{start:%Y-%m}", start, end, **options)

    @property
    def month_name(self) -> str:
        return MONTHS[self.start.month - 1]

    @property
    def licence_year_start(self) -> dt.date:
        year = self.start.year if self.start.month >= YEAR_START_MONTH else self.start.year - 1
        return dt.date(year, YEAR_START_MONTH, 1)

    @property
    def instant_selection(self) -> bool:
        """Term licences belong to the month that holds their midpoint."""
        return self.licence_year_start.year >= FIRST_INSTANT_YEAR

    @property
    def modern_responses(self) -> bool:
        return self.start >= FIRST_MODERN_SURVEY


def months_of(year: LicenceYear, **options) -> list[SurveyPeriod]:
    """The twelve monthly surveys of a licence year."""
    return [SurveyPeriod.month_from(shift_months(year.start, i), **options) for i in range(12)]


def calendar_frame(spark: SparkSession, year: LicenceYear, periods: Sequence[SurveyPeriod]) -> DataFrame:
    """The job calendar as a table, for the calendar gates."""
    schema = (
        f"{SURVEY} string, survey_start date, survey_end date, lic_start date, lic_end date, "
        "period_stratify boolean, period_stratify_date date, stamp_stratify boolean"
    )
    rows = [
        (p.survey_id, p.start, p.end, year.start, year.end, p.period_stratify, p.split_date, p.stamp_stratify)
        for p in periods
    ]
    return spark.createDataFrame(rows, schema)
