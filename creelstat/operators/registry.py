"""Registry cleaning. Every step is a projection or a filter, so the whole chain is one narrow stage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import LicenceYear
from ..domains import (
    ADULT, ADULT_OR_SENIOR, ANNUAL, FIVE_DAYS, NON_RESIDENT, ONE_DAY, RESIDENT, SENIOR, THREE_DAYS,
    UNSOLD_FISHER_ID,
)
from ..functions.conform import to_integer

# Letters of the licence category code, and extra days a term licence runs.
RESIDENCY_CODES = {"R": RESIDENT, "N": NON_RESIDENT}
TYPE_CODES = {"A": ANNUAL, "5": FIVE_DAYS, "3": THREE_DAYS, "1": ONE_DAY}
AGE_CODES = {"A": ADULT, "S": SENIOR, "": ADULT_OR_SENIOR}
FAMILY_CODE = "F"
EXTRA_DAYS = {FIVE_DAYS: 4, THREE_DAYS: 2, ONE_DAY: 0}
# End of fixed values.

CODE = "lic_type_cat_code"


def _lookup(col: Column, table: dict[str, str]) -> Column:
    result = F
    for code, label in table.items():
        result = result.when(col == code, label)
    return result


def term_length(code: Column) -> Column:
    """Days of a term licence, from the second letter of its category code."""
    return F.substring(code, 2, 1).try_cast("int")


def short_id(full_id: Column) -> Column:
    """Number in the fourth part of a licence id, or the whole id when it has fewer parts."""
    parts = F.split(F.regexp_replace(full_id, "-+$", ""), "-")  # empty parts at the end don't count
    number = F.get(parts, F.lit(3))
    whole = F.coalesce(number.try_cast("bigint"), to_integer(number, "bigint"))
    return F.when(F.size(parts) >= 4, whole.cast("string")).otherwise(full_id)


def fix_start(df: DataFrame) -> DataFrame:
    """Start dates before the licence year are worked back from the expiry date."""
    early = F.year("start_date") < F.col("lic_year")
    from_expiry = F.date_add(
        F.date_sub(F.col("expiry_date"), F.coalesce(term_length(F.col(CODE)), F.lit(0))), 1
    )
    fixed = F.when(early, from_expiry).when(~early, F.col("start_date"))
    return df.withColumn("start_date", fixed)


def clean_purchase(df: DataFrame, year: LicenceYear) -> DataFrame:
    """Purchase dates outside the sales season become NULL."""
    day = F.col("purchase_date")
    return df.withColumn("purchase_date", F.when(day.between(year.sales_open, year.end), day))


def clean_stamp(df: DataFrame, year: LicenceYear) -> DataFrame:
    """Stamp dates outside the sales season become the licence start date."""
    day = F.col("stamp_purchase_date")
    outside = ~day.between(year.sales_open, year.end)
    return df.withColumn("stamp_purchase_date", F.when(outside, F.col("start_date")).otherwise(day))


def drop_unsold(df: DataFrame) -> DataFrame:
    return df.where(F.col("fisher_id") != UNSOLD_FISHER_ID)


def effective_start(df: DataFrame) -> DataFrame:
    """A licence is good from its start or its purchase, whichever is later."""
    return df.withColumn("start_date", F.greatest("start_date", "purchase_date"))


def in_licence_year(df: DataFrame, year: LicenceYear) -> DataFrame:
    return df.where(F.col("start_date").between(year.start, year.end))


def drop_blank_family(df: DataFrame) -> DataFrame:
    return df.where((F.col(CODE) != "") & ~F.col(CODE).startswith(FAMILY_CODE))


def decode_category(df: DataFrame) -> DataFrame:
    """Residency, age and licence type from the category code; unknown letters give NULL."""
    code = F.col(CODE)
    return df.withColumns({
        "resident_status": _lookup(F.substring(code, 1, 1), RESIDENCY_CODES),
        "age_category": _lookup(F.substring(code, 3, 1), AGE_CODES),
        "licence_type": _lookup(F.substring(code, 2, 1), TYPE_CODES),
        "annual_flag": F.coalesce(F.substring(code, 2, 1) == "A", F.lit(False)),
    })


def end_date(df: DataFrame, year: LicenceYear) -> DataFrame:
    """Annual licences end with the year, term licences after their days."""
    kind = F.col("licence_type")
    end = F.when(kind == ANNUAL, F.lit(year.end))
    for label, days in EXTRA_DAYS.items():
        end = end.when(kind == label, F.date_add("start_date", days))
    return df.withColumn("end_date", end)


def date_registry(df: DataFrame, year: LicenceYear) -> DataFrame:
    """The per-row date repairs and the short id, before any row is dropped."""
    df = fix_start(df).drop("expiry_date").withColumn("licence_id", short_id(F.col("full_licence_id")))
    return clean_stamp(clean_purchase(df, year), year)


def clean_registry(df: DataFrame, year: LicenceYear) -> DataFrame:
    """A normalised registry as the estimators need it."""
    df = effective_start(drop_unsold(date_registry(df, year)))
    df = drop_blank_family(in_licence_year(df, year))
    return end_date(decode_category(df), year)
