"""Gates on responses as delivered.

They are counted by observation metrics while the estimate reads the responses, so a clean survey is read once. Only
where a count is above zero, or a list of exclusions is to be accounted for, is the survey read again, by one
aggregate that gives every violation with its number of rows. Spark counts a task's metrics again if the task has to
be run again, so what is published always comes from the aggregate.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..domains import COMPLETE, INCOMPLETE, MAX_MISSING_KEY_RATIO, SURVEY, measure_cols
from ..functions.conform import to_number, ungrouped
from ..functions.text import strip
from .joins import listed_ids
from .quality import ERROR, INFO, SCHEMA, WARNING, message
from .responses import LEGACY_MEASURE_LETTER, LEGACY_NAMES, VALID_FISHING_CODES, key_text

ROWS = "rows"
#: Seconds to wait for metrics after the action that they belong to has ended.
PATIENCE = 10


@dataclass(frozen=True)
class Intake:
    """The gates of one survey's delivered responses, which carry the survey's id."""

    survey_id: str
    raw: DataFrame
    modern: bool
    exclude: DataFrame | None
    seen: Observation

    @classmethod
    def of(cls, survey_id: str, raw: DataFrame, modern: bool, exclude: DataFrame | None = None) -> Intake:
        return cls(survey_id, raw.withColumn(SURVEY, F.lit(survey_id)), modern, exclude, Observation(f"intake {survey_id}"))

    @property
    def lower(self) -> DataFrame:
        return self.raw.toDF(*(c.lower() for c in self.raw.columns))

    @property
    def key(self) -> str:
        return "licence_id" if "licence_id" in self.lower.columns else "surveykey"

    def watched(self) -> DataFrame:
        """The responses, with their gates counted by the first action that reads them."""
        suspect = F.lit(False)
        for _, condition, _, _ in self._problems(lambda name: F.col(f"`{self._own(name)}`")):
            suspect = suspect | F.coalesce(condition, F.lit(False))
        return self.raw.observe(self.seen, F.count("*").alias(ROWS), F.count_if(suspect).alias("suspect"))

    def _own(self, name: str) -> str:
        """A column's name as delivered."""
        return next(c for c in self.raw.columns if c.lower() == name.lower())

    def _measures(self) -> list[str]:
        """Measures that came as text."""
        names = measure_cols(self.lower) if self.modern else [
            c.lower() for c in self.raw.columns if c.startswith(LEGACY_MEASURE_LETTER) and c not in LEGACY_NAMES
        ]
        kinds = dict(self.lower.dtypes)
        return [c for c in names if kinds[c] == "string"]

    def _problems(self, col, excluded: Column | None = None) -> list[tuple[str, Column, Column, str]]:
        """(check, condition, key, detail) of what can be wrong with a row, column by column."""
        keyed = col(self.key).isNotNull()
        found = [("missing_key_ratio", ~keyed, F.lit(self.key), "")]
        for name in self._measures():
            value = strip(col(name))
            unread = (value != "") & to_number(ungrouped(value)).isNull()
            found.append(("unread_value", unread, value, f"responses: {name} can't be read"))
        if not self.modern:
            return found
        if excluded is not None:
            found.append(("excluded_responses", keyed & excluded, F.lit(self.survey_id), "rows of excluded keys"))
            keyed = keyed & ~excluded
        completion = strip(col("completesurvey"))
        fishing = col("didnotfish")
        return [
            *found,
            ("incomplete_responses", keyed & ~F.coalesce(completion == COMPLETE, F.lit(False)),
             F.lit(self.survey_id), "rows of surveys not completed"),
            ("domain", keyed & ~F.coalesce(fishing.isin(VALID_FISHING_CODES), F.lit(False)),
             fishing, "didnotfish is not a known value"),
            ("domain", keyed & ~F.coalesce(completion.isin(COMPLETE, INCOMPLETE), F.lit(False)),
             completion, "completesurvey is not a known value"),
        ]

    def metrics(self) -> dict[str, int] | None:
        """What the read counted; None if Spark left the read out because nothing came of it."""
        until = time.monotonic() + PATIENCE
        while not self.seen._jo.future().isCompleted():
            if time.monotonic() > until:
                return None
            time.sleep(0.02)
        return self.seen.get if self.seen._jo.getRow().length() else None

    def violations(self) -> DataFrame:
        """All violations of the gates, to be asked for after ``watched`` was read."""
        counted = self.metrics()
        spark = self.raw.sparkSession
        if self.raw.isEmpty() if counted is None else not counted[ROWS]:
            return message(spark, "empty_input", ERROR, self.survey_id, "no rows")
        if counted is not None and not counted["suspect"] and self.exclude is None:
            return spark.createDataFrame([], SCHEMA)
        return self.findings()

    def findings(self) -> DataFrame:
        """Every violation from one pass over the responses, grouped before the shuffle."""
        rows = self.lower
        excluded = None
        if self.modern and self.exclude is not None:
            ids = listed_ids(self.exclude, "_named").withColumn("_excluded", F.lit(True))
            rows = rows.withColumn("_named", key_text(rows, self.key)).join(ids, "_named", "left")
            excluded = F.coalesce("_excluded", F.lit(False))
        problems = self._problems(lambda name: F.col(f"`{name}`"), excluded)
        each = [F.struct(F.lit(ROWS).alias("check"), F.lit(None).cast("string").alias("key"), F.lit("").alias("detail"))]
        for check, condition, key, detail in problems:
            one = F.struct(F.lit(check).alias("check"), key.cast("string").alias("key"), F.lit(detail).alias("detail"))
            each.append(F.when(condition, one))
        found = rows.select(SURVEY, F.inline(F.filter(F.array(*each), lambda x: x.isNotNull())))
        found = found.groupBy(SURVEY, "check", "key", "detail").agg(F.count("*").alias("n"))
        found = found.checkpoint()  # read twice below
        total = found.where(F.col("check") == ROWS).select(SURVEY, F.col("n").alias("total"))
        found = found.where(F.col("check") != ROWS).join(F.broadcast(total), SURVEY)  # one row a survey
        n, share = F.col("n").cast("string"), F.col("check") == "missing_key_ratio"
        noted = F.col("check").isin("excluded_responses", "incomplete_responses")
        many = F.col("n") > F.col("total") * MAX_MISSING_KEY_RATIO
        level = F.when(noted, INFO).when(share & ~many, WARNING).otherwise(ERROR)
        text = (
            F.when(share, F.concat_ws(" of ", n, F.col("total").cast("string")))
            .when(noted, F.concat_ws(" ", n, "detail")).otherwise(F.col("detail"))
        )
        return found.select(SURVEY, "check", level.alias("severity"), "key", text.alias("detail"))
