"""Casts that read text the way the survey files were written."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .dates import parse_date
from .text import strip

# Spellings of a logical value; anything else is missing.
TRUE_TEXT = ["T", "TRUE", "true", "True"]
FALSE_TEXT = ["F", "FALSE", "false", "False"]
# End of fixed values.


def to_number(col: Column) -> Column:
    return col.try_cast("double")


def ungrouped(col: Column) -> Column:
    """Numbers without the commas between groups of three digits."""
    text = strip(col.cast("string"))
    grouped = text.rlike(r"^[+-]?[0-9]{1,3}(,[0-9]{3})+([.][0-9]*)?$")
    return F.when(grouped, F.replace(text, F.lit(","))).otherwise(text)


def to_integer(col: Column, kind: str = "int") -> Column:
    """Drops the fraction: ``'3.9' -> 3``; text that is no number is NULL."""
    return to_number(col).try_cast(kind)


def to_logical(col: Column) -> Column:
    return F.when(col.isin(TRUE_TEXT), True).when(col.isin(FALSE_TEXT), False)


def _cast_text(col: Column, target: T.DataType) -> Column:
    if isinstance(target, T.DoubleType):
        return to_number(col)
    if isinstance(target, (T.IntegerType, T.LongType)):
        return to_integer(col, target.simpleString())
    if isinstance(target, T.BooleanType):
        return to_logical(col)
    return parse_date(col)


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Cast the columns of ``df`` to the types of the same-named columns in ``schema``."""
    known = (T.StringType, T.DoubleType, T.IntegerType, T.LongType, T.BooleanType, T.DateType)
    wanted = {f.name: f.dataType for f in schema}
    bad = [f"{n} {t.simpleString()}" for n, t in wanted.items() if not isinstance(t, known)]
    if bad:
        raise TypeError(f"Unknown column types: {', '.join(bad)}")

    columns = []
    for field in df.schema:
        col, target = F.col(field.name), wanted.get(field.name)
        if target is None or target == field.dataType:
            columns.append(col)
        elif isinstance(target, T.StringType) or not isinstance(field.dataType, T.StringType):
            columns.append(col.try_cast(target).alias(field.name))
        else:
            columns.append(_cast_text(col, target).alias(field.name))
    return df.select(*columns)
