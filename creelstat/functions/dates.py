"""Date column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..domains import YEAR_START_MONTH

# Accepted date layouts in order of priority (year first, then US, then day first).
DATE_LAYOUTS = ["yyyy M d", "yyyyMMdd", "M d yyyy", "d M yyyy", "d MMM yyyy", "d MMMM yyyy", "d MMM yy", "d MMMM yy"]
# End of fixed values.


def parse_date(col: Column) -> Column:
    """Date text in any accepted layout and with any separators; whatever matches none is NULL."""
    words = F.initcap(F.trim(F.regexp_replace(col, "[^0-9A-Za-z]+", " ")))
    return F.coalesce(*(F.try_to_date(words, layout) for layout in DATE_LAYOUTS))


def month_end(day: Column) -> Column:
    return F.last_day(day)


def licence_year_number(day: Column) -> Column:
    """Calendar year in which the licence year holding ``day`` starts."""
    return F.year(day) - F.when(F.month(day) >= YEAR_START_MONTH, 0).otherwise(1)


def licence_year_start(day: Column) -> Column:
    return F.make_date(licence_year_number(day), F.lit(YEAR_START_MONTH), F.lit(1))


def licence_year_end(day: Column) -> Column:
    return F.date_sub(F.add_months(licence_year_start(day), 12), 1)


def licence_year_text(year: Column) -> Column:
    """``2020 -> '2020-21'``, second part not padded."""
    return F.concat_ws("-", year.cast("string"), ((year + 1) % 100).cast("string"))
