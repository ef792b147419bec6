"""Writers. Results are never overwritten, and a failed write leaves nothing visible."""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession

from .storage import Folder

NEVER_OVERWRITE = "errorifexists"
MANIFEST = "_manifest.json"


def write_table(df: DataFrame, path: str, fmt: str = "parquet", by: Sequence[str] = ()) -> None:
    writer = df.write.mode(NEVER_OVERWRITE)
    if by:
        writer = writer.partitionBy(*by)
    if fmt == "csv":
        writer.csv(path, header=True, nullValue="", emptyValue="", escape='"')
    else:
        writer.format(fmt).save(path)


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with headings and blank for missing values."""
    write_table(df, path, "csv")


def _commit(tables: Mapping[str, DataFrame], path: str, fmt: str, by: Mapping[str, Sequence[str]]) -> list[str]:
    """All datasets or none: written to a hidden folder, moved into place when the last is there, manifest last.

    What readers take for results is what the manifest names. If a write or a move fails, the datasets of this call
    are taken away again, and so is the hidden folder; other content of ``path`` is left alone.
    """
    spark = next(iter(tables.values())).sparkSession
    place = Folder(spark, path)
    taken = [name for name in [*tables, MANIFEST] if place.exists(name)]
    if taken:
        raise FileExistsError(f"{path} already exists with {', '.join(taken)}; results are never overwritten")
    staging = f"_staging-{uuid.uuid4().hex}"
    moved: list[str] = []
    try:
        for name, table in tables.items():
            write_table(table, f"{path}/{staging}/{name}", fmt, by[name])
        for name in tables:
            place.rename(f"{staging}/{name}", name)
            moved.append(name)
        place.write_new(MANIFEST, json.dumps({
            "format": fmt, "tables": [{"name": name, "partitioned_by": list(by[name])} for name in tables],
        }))
    except BaseException:
        for name in moved:
            place.delete(name)
        raise
    finally:
        place.delete(staging)
    return [f"{path}/{name}" for name in tables]


def write_bundle(tables: Mapping[str, DataFrame], path: str, fmt: str = "parquet") -> list[str]:
    """One dataset per result table below ``path``, all of them or none; returns where they went."""
    return _commit(tables, path, fmt, {name: [] for name in tables})


def write_annual(tables: Mapping[str, DataFrame], path: str, fmt: str = "parquet") -> list[str]:
    """Like ``write_bundle`` for tables tagged with their month; files are laid out by year and month."""
    by = {name: [c for c in ("year", "month") if c in table.columns] for name, table in tables.items()}
    return _commit(tables, path, fmt, by)


def read_bundle(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The published datasets below ``path``, as its manifest lists them."""
    text = Folder(spark, path).read(MANIFEST)
    if text is None:
        raise FileNotFoundError(f"{path} has no finished results")
    manifest = json.loads(text)
    reader = spark.read.format(manifest["format"])
    if manifest["format"] == "csv":
        reader = reader.options(header=True, escape='"')
    return {table["name"]: reader.load(f"{path}/{table['name']}") for table in manifest["tables"]}
