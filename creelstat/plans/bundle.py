"""What an analysis offers: its published tables, its checks and the joined raw data."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import SurveyPeriod
from ..domains import SURVEY

ESTIMATES = [
    "licence_summary", "survey_summary", "survey_sample_sizes", "survey_specific_variance",
    "detail_estimated_catch", "summary_estimated_catch", "total_variance",
]
PUBLISHED = [*ESTIMATES, "log"]


class Bundle:
    """Result tables by attribute. Each is a lazy frame that carries ``survey_id``, and it is only planned
    when asked for; a month has one survey, a year twelve."""

    licence_summary: DataFrame
    survey_summary: DataFrame
    survey_sample_sizes: DataFrame
    survey_specific_variance: DataFrame
    detail_estimated_catch: DataFrame
    summary_estimated_catch: DataFrame
    total_variance: DataFrame
    log: DataFrame
    violations: DataFrame
    raw_data: DataFrame

    def tables(self) -> dict[str, DataFrame]:
        """The eight published tables."""
        return {name: getattr(self, name) for name in PUBLISHED}


def stack_periods(df: DataFrame, periods: Sequence[SurveyPeriod]) -> DataFrame:
    """Tag rows with the year and month of their survey, and sort by them."""
    tags = F.create_map(*(
        part
        for p in periods
        for part in (
            F.lit(p.survey_id),
            F.struct(F.lit(p.start.year).alias("year"), F.lit(p.start.month).alias("month_id"),
                     F.lit(p.month_name).alias("month")),
        )
    ))
    rows = df.withColumn("_tag", F.element_at(tags, F.col(SURVEY)))
    rest = [c for c in df.columns if c != SURVEY]
    return rows.select("_tag.year", "_tag.month_id", "_tag.month", *rest).orderBy("year", "month_id")


def stacked_tables(bundle: Bundle, periods: Sequence[SurveyPeriod]) -> dict[str, DataFrame]:
    """The published tables of a year, estimates tagged with their month; the log keeps its survey id."""
    tables = bundle.tables()
    return {n: t if n == "log" else stack_periods(t, periods) for n, t in tables.items()}


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Checkpoints go to the folder the cluster names."""
    context = spark.sparkContext
    if context.getCheckpointDir() is not None:
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None:
        raise ValueError("Set spark.checkpoint.dir to a folder that all executors share.")
    context.setCheckpointDir(shared)


def checkpointed(df: DataFrame) -> DataFrame:
    """The frame computed once and read back from the shared checkpoint folder."""
    return df.checkpoint()
