"""Category labels, codes and column naming rules shared by every operator."""

from __future__ import annotations

import datetime as dt
import re

# Category labels, response codes and dates that results depend on.
RESIDENT = "Resident"
NON_RESIDENT = "Non-Resident"
RESIDENCY = [RESIDENT, NON_RESIDENT]

ANNUAL = "Annual"
FIVE_DAYS = "5 Days"
THREE_DAYS = "3 Days"
ONE_DAY = "1 Day"
TERM_TYPES = [FIVE_DAYS, THREE_DAYS, ONE_DAY]
LICENCE_TYPES = [ANNUAL, FIVE_DAYS, THREE_DAYS, ONE_DAY]

JUVENILE = "Juvenile (under 16 years)"
ADULT = "Adult (16-64)"
SENIOR = "Senior (65+)"
ADULT_OR_SENIOR = "All Ages above 15 (Pacific)"
AGES = [JUVENILE, ADULT, SENIOR, ADULT_OR_SENIOR]

POST_DRAW = "Post"
PRE_DRAW = "Pre"

IN_SURVEY = "In Survey"
PRE_SURVEY = "Pre-Survey"
EARLY_SEASON = "Early Season"
LATE_SEASON = "Late Season"
NOT_SPECIFIED = "Not Specified"

UNSPECIFIED = "Unspecified"

DID_NOT_FISH_CODE = 1
DID_FISH_CODE = 2
COMPLETE = "Complete"
INCOMPLETE = "Incomplete"

FIRST_MODERN_SURVEY = dt.date(2015, 7, 1)
FIRST_INSTANT_YEAR = 2018
YEAR_START_MONTH = 4
UNSOLD_FISHER_ID = 1
MAX_MISSING_KEY_RATIO = 0.01
VENDOR_SALES_OPTIONAL_FROM = 2015

MONTHS = [
    "January", "February", "March", "April", "May", "June",
    "July", "August", "September", "October", "November", "December",
]

MEASURE_PREFIXES = [
    "effort_days", "juv_effort_days", "salmon_", "halibut_",
    "finfish_", "prawncrab_", "bivalves_", "othshellfish_",
]
SIZE_PREFIX = "n_"

PERIOD_STRATA = ["resident_status", "licence_type", "age_category", "purchase_period"]
DRAW_STRATA = ["draw_type", "resident_status", "licence_type", "age_category"]
DETAIL_CELLS = ["area", "method", "lodge", "guided", "checkcrabs", "checkprawns", "checkcrabsprawns"]
DRAW_SUM_CELLS = ["area", "method", "lodge", "guided"]
AREA_METHOD = ["area", "method"]

PERSONAL_COLUMNS = ["first_name", "last_name", "email"]
FISHED_ON_COLUMNS = ["year", "month", "day"]
# End of fixed values.

SURVEY = "survey_id"

_MEASURE = re.compile("|".join(map(re.escape, MEASURE_PREFIXES)))


def measure_cols(df) -> list[str]:
    """Names of the measure columns, found by prefix."""
    return [c for c in df.columns if _MEASURE.match(c)]


def size_col(measure: str) -> str:
    return SIZE_PREFIX + measure


def sample_cols(df) -> list[str]:
    """Names of the sample size columns, one per measure."""
    return [c for c in df.columns if c.startswith(SIZE_PREFIX) and _MEASURE.match(c[len(SIZE_PREFIX):])]
