"""Registry projection shared by the file and the database source."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.conform import to_integer
from ..functions.dates import parse_date
from ..functions.text import strip

# Registry columns, the names they get here, and their types.
REGISTRY_COLUMNS = {
    "full_licence_id": ("full_licence_id", "string"),
    "start_dt": ("start_date", "date"),
    "expiry_dt": ("expiry_date", "date"),
    "purchase_dtt": ("purchase_date", "date"),
    "stamp_purchase_dtt": ("stamp_purchase_date", "date"),
    "lic_type_cat_code": ("lic_type_cat_code", "string"),
    "survey_access_key": ("survey_access_key", "string"),
    "survey_definition_id": ("survey_definition_id", "int"),
    "lic_year": ("lic_year", "int"),
    "fisher_id": ("fisher_id", "bigint"),
}
# A column that no estimator reads, the database view's own names, and layouts of text with a time of day.
UNUSED = ["survey_definition_id"]
DATABASE_NAMES = {"lic_no": "full_licence_id"}
TIMES = ["M/d/yyyy H:mm[:ss]", "yyyy/M/d H:mm[:ss]", "yyyy-M-d H:mm[:ss]"]
# End of fixed values.


def _as_date(col: Column, kind: T.DataType, source_zone: str | None, zone: str | None) -> Column:
    def moved(time: Column) -> Column:
        return F.from_utc_timestamp(F.to_utc_timestamp(time, source_zone), zone or "UTC") if source_zone else time

    if isinstance(kind, T.StringType):
        text = strip(col)
        times = [text.try_cast("timestamp_ntz"), *(F.try_to_timestamp(text, F.lit(x)).cast("timestamp_ntz") for x in TIMES)]
        day = F.coalesce(text.try_cast("date"), parse_date(text))
        return F.when(text.rlike("[0-9]:[0-9]"), F.to_date(moved(F.coalesce(*times)))).otherwise(day)
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        col = moved(col)
    return F.to_date(col)


def unread_dates(df: DataFrame) -> DataFrame:
    """``(column, value)``: distinct text in the date columns of a registry that is neither blank nor a date."""
    df = df.toDF(*(c.lower() for c in df.columns))
    text = [
        f.name for f in df.schema
        if isinstance(f.dataType, T.StringType) and REGISTRY_COLUMNS.get(f.name, ("", ""))[1] == "date"
    ]
    if not text:
        return df.sparkSession.createDataFrame([], "column string, value string")
    pairs = F.array(*(
        F.struct(F.lit(c).alias("column"), strip(F.col(c)).alias("value"),
                 _as_date(F.col(c), T.StringType(), None, None).alias("day"))
        for c in text
    ))
    rows = df.select(F.explode(pairs).alias("p")).select("p.*").where("value <> '' and day is null")
    return rows.select("column", "value").distinct()


def normalise_registry(
    df: DataFrame, source_zone: str | None = None, zone: str | None = None, partial: bool = False
) -> DataFrame:
    """Lower-case headings, the ten columns the estimators use, whole numbers and dates.

    ``source_zone`` is the zone the source's clock times are in, ``zone`` the one whose days are wanted. A column that
    the estimators need and the source lacks is an error; with ``partial`` it is NULL.
    """
    df = df.toDF(*(c.lower() for c in df.columns))
    missing = [name for name in REGISTRY_COLUMNS if name not in df.columns]
    if not partial and any(name not in UNUSED for name in missing):
        raise ValueError(f"The registry has no {', '.join(missing)}")
    columns = []
    for name, (new, kind) in REGISTRY_COLUMNS.items():
        if name in missing:
            columns.append(F.lit(None).cast(kind).alias(new))
            continue
        own = df.schema[name].dataType
        if kind == "date":
            value = _as_date(F.col(name), own, source_zone, zone)
        elif kind in ("int", "bigint") and isinstance(own, T.StringType):
            value = to_integer(F.col(name), kind)
        else:
            value = F.col(name).cast(kind)
        columns.append(value.alias(new))
    return df.select(*columns)


def read_registry_jdbc(
    spark: SparkSession,
    options: Mapping[str, str],
    lic_year: int,
    source_zone: str | None = None,
    zone: str | None = None,
) -> DataFrame:
    """One licence year of a database view. The year filter and the columns are pushed to the database;
    ``partitionColumn`` with its bounds in ``options`` makes the read parallel."""
    view = spark.read.format("jdbc").options(**options).load()
    year = next(c for c in view.columns if c.lower() == "lic_year")
    rows = view.where(F.col(year) == lic_year)
    return normalise_registry(
        rows.toDF(*(DATABASE_NAMES.get(c.lower(), c) for c in rows.columns)), source_zone, zone
    )
