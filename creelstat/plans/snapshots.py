"""Registry snapshots: dated datasets of which one is the current one."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession

from .. import sinks
from ..config import LicenceYear
from ..operators import quality as dq
from ..operators.registry import clean_registry
from ..sources import normalise_registry
from ..storage import Folder

CURRENT = "CURRENT"


class RegistrySnapshots:
    """Snapshots of a licence year's registry below one folder.

    Every delivery becomes a dataset of its own that is never changed. A small file names the current one, and it is
    replaced in one step after the dataset is whole, so that readers see the old snapshot or the new one.
    """

    def __init__(self, spark: SparkSession, folder: str, year: LicenceYear) -> None:
        self.spark, self.folder, self.year = spark, folder, year
        self._files = Folder(spark, folder)

    @property
    def current(self) -> str | None:
        """Name of the current snapshot."""
        return self._files.read(CURRENT)

    def read(self) -> DataFrame | None:
        """The current snapshot as it was delivered."""
        name = self.current
        return None if name is None else self.spark.read.parquet(f"{self.folder}/{name}")

    def lost(self, new: DataFrame, unit: str = "full_licence_id") -> DataFrame:
        """Violations: licences of the current snapshot, once cleaned, that a delivery lacks.

        Rows that cleaning drops (unsold, out of the year, family) may disappear.
        """
        old = clean_registry(normalise_registry(self.read()), self.year)
        return dq.registry_regression(old, new.toDF(*(c.lower() for c in new.columns)), unit)

    def refresh(self, new: DataFrame, name: str | None = None, unit: str = "full_licence_id") -> str:
        """Make a delivery the current snapshot; refused, with the current one as it was, if it lost licences."""
        name = name or f"snapshot-{dt.datetime.now(dt.UTC):%Y%m%dT%H%M%S%f}"
        if self.current is not None:
            dq.enforce(self.lost(new, unit))
        sinks.write_table(new, f"{self.folder}/{name}")
        self._files.publish(CURRENT, name)
        return name
