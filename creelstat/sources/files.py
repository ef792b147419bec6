"""File sources. Text files are read as text and cast explicitly; nothing is inferred."""

from __future__ import annotations

import logging

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.conform import to_number, ungrouped
from ..functions.text import strip
from ..operators.responses import normalise_adjustments
from ..operators.vendor import CATEGORY
from .registry import normalise_registry

log = logging.getLogger(__name__)

# Alternative headings and the text that stands for a missing value.
EXCLUDE_ALIAS = {"licence.id": "licence_id"}
EXCLUDE_KEYS = ["licence_id", "survey_access_key"]
VENDOR_ALIAS = {
    "resident.status": "resident_status", "licence.type": "licence_type", "age.category": "age_category",
}
MISSING_TEXT = "NA"
# End of fixed values.


def _read_text(spark: SparkSession, path: str, missing: str | None, lines_in_values: bool) -> DataFrame:
    """CSV as text: headings and values trimmed, doubled quotes inside quoted values."""
    df = spark.read.csv(
        path, header=True, inferSchema=False, escape='"', multiLine=lines_in_values, ignoreLeadingWhiteSpace=True,
        ignoreTrailingWhiteSpace=True,
    )
    df = df.toDF(*(c.strip() for c in df.columns))
    return df.select(*(
        (value if missing is None else F.nullif(value, F.lit(missing))).alias(c)
        for c in df.columns for value in [strip(F.col(f"`{c}`"))]
    ))


def _read(
    spark: SparkSession, path: str, fmt: str, missing: str | None = MISSING_TEXT, lines_in_values: bool = True
) -> DataFrame:
    """lines_in_values allows line ends inside quotes; such a file can't be split, so large files go without."""
    if fmt == "csv":
        return _read_text(spark, path, missing, lines_in_values)
    return spark.read.format(fmt).load(path)


def read_registry_source(
    spark: SparkSession, path: str, fmt: str = "csv", na_is_missing: bool = True
) -> DataFrame:
    """A registry snapshot with its own columns, as delivered."""
    return _read(spark, path, fmt, MISSING_TEXT if na_is_missing else None, lines_in_values=False)


def read_registry(spark: SparkSession, path: str, fmt: str = "csv", na_is_missing: bool = True) -> DataFrame:
    """A registry snapshot. ``NA`` is also a licence category code; ``na_is_missing=False`` keeps it."""
    return normalise_registry(read_registry_source(spark, path, fmt, na_is_missing))


def read_responses(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Raw responses as delivered."""
    return _read(spark, path, fmt, lines_in_values=False)


def read_labels(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    """The label table: ``col_name, code, label``."""
    df = _read(spark, path, fmt, None)
    return df.select("col_name", F.col("code").cast("int").alias("code"), "label")


def normalise_exclude(df: DataFrame) -> DataFrame:
    """An exclusion list under its usual headings; it needs one of the two keys."""
    df = df.withColumnsRenamed(EXCLUDE_ALIAS)
    if not any(k in df.columns for k in EXCLUDE_KEYS):
        raise ValueError(f"No {' or '.join(EXCLUDE_KEYS)} column in the exclude file")
    return df


def read_exclude(spark: SparkSession, path: str | None, fmt: str = "csv") -> DataFrame | None:
    """An exclusion list, or None when there is no such file."""
    if not path:
        return None
    try:
        return normalise_exclude(_read(spark, path, fmt))
    except AnalysisException as problem:
        if problem.getCondition() != "PATH_NOT_FOUND":
            raise
        log.warning("no exclusion list at %s: nobody is excluded", path)
        return None


def read_adjustments(spark: SparkSession, path: str | None, fmt: str = "csv") -> DataFrame | None:
    """Adjusted response rows, or None when there is no such file."""
    if not path:
        return None
    try:
        return normalise_adjustments(_read(spark, path, fmt))
    except AnalysisException as problem:
        if problem.getCondition() != "PATH_NOT_FOUND":
            raise
        log.warning("no adjusted rows at %s: responses stay as delivered", path)
        return None


def read_vendor_sales(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    """Vendor sales with one column per month."""
    df = _read(spark, path, fmt)
    df = df.toDF(*(VENDOR_ALIAS.get(c, c) for c in df.columns))
    months = [c for c in df.columns if c not in CATEGORY]
    return df.select(*CATEGORY, *(to_number(ungrouped(F.col(f"`{m}`"))).alias(m) for m in months))


def unread_sales(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    """``(column, value)``: the distinct sales that are neither blank nor a number."""
    df = _read(spark, path, fmt)
    months = [c for c in df.toDF(*(VENDOR_ALIAS.get(c, c) for c in df.columns)).columns if c not in CATEGORY]
    return unread_numbers(df, months)


def unread_numbers(df: DataFrame, columns: list[str]) -> DataFrame:
    """``(column, value)``: distinct text in these columns that is neither blank nor a number."""
    text = [f.name for f in df.schema if f.name in columns and isinstance(f.dataType, T.StringType)]
    pairs = F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").alias("value")) for c in text))
    if not text:
        return df.sparkSession.createDataFrame([], "column string, value string")
    rows = df.select(F.explode(pairs).alias("p")).select("p.column", strip(F.col("p.value")).alias("value"))
    return rows.where((F.col("value") != "") & to_number(ungrouped(F.col("value"))).isNull()).distinct()
