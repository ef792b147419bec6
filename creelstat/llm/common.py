"""Helpers that several of these operators share."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable
from contextlib import suppress

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word rules, as the inside of a regular expression class: space, \t, \n, \x0B, \x0C and \r.
SPACE = r"\x20\x09-\x0D"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a temporary one only where a local session names none, as in tests."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoints-"))
    return context.getCheckpointDir()


def stored(df: DataFrame) -> DataFrame:
    """The rows written as a table to the shared folder and read back: computed once, and lost executors cost nothing.

    The table is compressed by column, unlike a checkpoint. It stays until the folder is cleared.
    """
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def checkpointed(df: DataFrame) -> DataFrame:
    """A reliable checkpoint, for small frames that later steps read more than once."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def small_batches(spark: SparkSession, rows: int = 500) -> None:
    """Lets Spark hand Python whole texts a few at a time: ten thousand long ones at once don't fit a worker.

    It lowers the session's setting and never raises it.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(name))
    if now <= 0 or now > rows:
        spark.conf.set(name, str(rows))


def give_back() -> None:
    """Hands memory that a worker has freed back to the system: it stays alive for later stages, which need it too."""
    pa.default_memory_pool().release_unused()
    with suppress(AttributeError, OSError):  # elsewhere than on Linux with the GNU library
        ctypes.CDLL(None).malloc_trim(0)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value computed once a row, however often and wherever the body uses it."""
    return F.transform(F.array(value), body)[0]


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, every other character as it is."""
    plain = F.octet_length(text) == F.length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def words(text: Column, pattern: str = f"[^{SPACE}]+") -> Column:
    """The words of a text in order; none for NULL."""
    return F.coalesce(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.array().cast("array<string>"))


def pick(df: DataFrame, *names: str) -> DataFrame:
    """Only these columns, so that further columns of the input can't clash with the operator's own."""
    return df.select(*[F.col(f"`{n}`") for n in names])


def literal_rows(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A few rows of parameters as a frame, made in the plan itself."""
    fields = [x.strip().split(" ", 1) for x in schema.split(",")]
    items = [
        F.struct(*[
            (F.array(*map(F.lit, v)) if isinstance(v, (list, tuple)) else F.lit(v)).cast(kind).alias(name)
            for v, (name, kind) in zip(row, fields, strict=True)
        ])
        for row in rows
    ]
    struct = ", ".join(f"{name}: {kind}" for name, kind in fields)
    return spark.range(1).select(F.inline(F.array(*items).cast(f"array<struct<{struct}>>")))
