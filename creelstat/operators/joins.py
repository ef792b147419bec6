"""Joins and set operations that keep NULL keys where the survey rules need them."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..domains import SURVEY

REGISTRY_ONLY = ["lic_year", "survey_definition_id", "fisher_id"]


def quoted(name: str, side: str | None = None) -> str:
    """A column name as SQL text."""
    plain = "`" + name.replace("`", "``") + "`"
    return f"{side}.{plain}" if side else plain


def full_join_ns(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Full outer join in which NULL keys match NULL keys and each key comes out once."""
    a, b = left.alias("a"), right.alias("b")
    condition = F.expr(" AND ".join(f"{quoted(k, 'a')} <=> {quoted(k, 'b')}" for k in keys))
    merged = [f"coalesce({quoted(k, 'a')}, {quoted(k, 'b')}) AS {quoted(k)}" for k in keys]
    rest = [quoted(c, side) for side, df in (("a", left), ("b", right)) for c in df.columns if c not in keys]
    return a.join(b, condition, "full").selectExpr(*merged, *rest)


def _key_list(key: str | Sequence[str]) -> list[str]:
    return [key] if isinstance(key, str) else list(key)


def attach_inner(responses: DataFrame, registry: DataFrame, key: str = "licence_id") -> DataFrame:
    """Registry columns next to each response; responses without a registry row drop out."""
    keys = [c for c in (SURVEY,) if c in responses.columns and c in registry.columns] + [key]
    registry = registry.drop(*REGISTRY_ONLY)
    taken = [c for c in responses.columns if c in keys or c not in registry.columns]
    return registry.join(responses.select(*taken), keys, "inner")


def attach_responses(responses: DataFrame, registry: DataFrame, key: str = "surveykey") -> DataFrame:
    """Every response with its registry columns, NULL where the access key is unknown.

    The response side is the streamed side, so adaptive execution can split a hot key.
    """
    registry = registry.where(F.col("survey_access_key").isNotNull())
    responses = responses.withColumnRenamed(key, "survey_access_key")
    keys = [c for c in (SURVEY,) if c in responses.columns and c in registry.columns] + ["survey_access_key"]
    joined = responses.join(registry, keys, "left")
    own = [c for c in responses.columns if c not in keys]
    return joined.select(*keys, *(c for c in registry.columns if c not in keys), *own)


def raw_join(registry: DataFrame, responses: DataFrame, null_keys: bool = False) -> DataFrame:
    """Every registry row and every response, side by side where the access key agrees.

    Built as a left join of the responses plus the registry rows that match nothing: the responses, of which one key
    may have many, are on the side that adaptive execution splits. Rows without a key match nothing, so they skip the
    joins rather than meet in one task. ``null_keys`` also pairs NULL keys with NULL keys; its
    result grows with the product of the two NULL-key counts, so look at ``null_key_counts`` first.
    """
    key = "survey_access_key"
    responses = responses.withColumnRenamed("surveykey", key)
    clashes = [c for c in responses.columns if c in registry.columns and c != key]
    responses = responses.withColumnsRenamed({c: f"{c}_response" for c in clashes})
    own = [c for c in responses.columns if c != key]
    if null_keys:
        return full_join_ns(registry, responses, [key])

    keyed, loose = registry.where(F.col(key).isNotNull()), registry.where(F.col(key).isNull())
    asked = responses.where(F.col(key).isNotNull())
    left = asked.join(keyed, key, "left").select(*registry.columns, *own)
    unmatched = keyed.join(asked.select(key).distinct(), key, "left_anti")
    return union_aligned(left, unmatched, loose, responses.where(F.col(key).isNull()))


def null_key_counts(registry: DataFrame, responses: DataFrame) -> DataFrame:
    """How many rows of each side of ``raw_join`` have no key."""
    def one(df: DataFrame, key: str, side: str) -> DataFrame:
        return df.agg(F.count_if(F.col(key).isNull()).alias("null_keys"), F.count("*").alias("n")).select(
            F.lit(side).alias("side"), "null_keys", "n"
        )

    return one(registry, "survey_access_key", "registry").unionByName(one(responses, "surveykey", "responses"))


def drop_out_of_period(df: DataFrame, survey_start, survey_end, key: str = "full_licence_id") -> DataFrame:
    """Drop every row of a licence that has a row outside the survey period."""
    outside = df.where((F.col("end_date") < survey_start) | (F.col("start_date") > survey_end))
    keys = [c for c in (SURVEY,) if c in df.columns] + [key]
    return df.join(outside.select(*keys).distinct(), keys, "left_anti")


def licences_in_period(registry: DataFrame, survey_start, survey_end, key: str = "full_licence_id") -> DataFrame:
    """Registry rows of licences none of whose rows lies outside the survey period.

    Equal rows are grouped first and the flag is taken over a licence's groups, so the registry is read once and
    many copies of one licence arrive as one row.
    """
    keys = [c for c in (SURVEY,) if c in registry.columns] + [key]
    grouped = registry.groupBy(*registry.columns).agg(F.count("*").alias("_copies"))
    outside = (F.col("end_date") < survey_start) | (F.col("start_date") > survey_end)
    licence = Window.partitionBy(*keys)
    kept = grouped.withColumn("_outside", F.bool_or(F.coalesce(outside, F.lit(False))).over(licence))
    kept = kept.where(~F.col("_outside") | F.col(key).isNull())
    return kept.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int")))).select(*registry.columns)


def attach_valid(responses: DataFrame, registry: DataFrame, key: str = "surveykey") -> DataFrame:
    """``attach_responses`` without the responses of keys that have no match, or one without a residency.

    The registry says which keys are bad, so neither input is read twice.
    """
    grouped = registry.where(F.col("survey_access_key").isNotNull()).groupBy(*registry.columns).agg(
        F.count("*").alias("_copies")
    )
    keys = [c for c in (SURVEY,) if c in registry.columns] + ["survey_access_key"]
    bad = F.bool_or(F.col("resident_status").isNull()).over(Window.partitionBy(*keys))
    joined = attach_responses(responses, grouped.withColumn("_bad", bad), key)
    rest = [c for c in joined.columns if c not in ("_copies", "_bad")]
    good = joined.where(F.col("survey_access_key").isNull() | ~F.coalesce("_bad", F.lit(True)))
    copies = F.explode(F.sequence(F.lit(1), F.coalesce(F.col("_copies"), F.lit(1)).cast("int")))
    return good.withColumn("_copy", copies).select(*rest)


def listed_ids(exclude: DataFrame, key: str) -> DataFrame:
    """The distinct keys of an exclusion list, in a column ``key``."""
    listed = "licence_id" if "licence_id" in exclude.columns else "survey_access_key"
    return exclude.select(F.col(listed).cast("string").alias(key)).where(F.col(key).isNotNull()).distinct()


def drop_excluded(responses: DataFrame, exclude: DataFrame | None, key: str) -> DataFrame:
    """Drop responses on the exclusion list; NULL keys stay."""
    if exclude is None:
        return responses
    return responses.join(listed_ids(exclude, key), key, "left_anti")


def keep_excluded(responses: DataFrame, exclude: DataFrame, key: str) -> DataFrame:
    """The responses that ``drop_excluded`` drops."""
    return responses.join(listed_ids(exclude, key), key, "left_semi")


def drop_invalid_keys(df: DataFrame, key: str = "survey_access_key") -> DataFrame:
    """Drop every response of a key that has no registry match."""
    keys = [c for c in (SURVEY,) if c in df.columns] + [key]
    return df.join(df.where(F.col("resident_status").isNull()).select(*keys).distinct(), keys, "left_anti")


def replace_by_key(base: DataFrame, adjusted: DataFrame, key: str) -> DataFrame:
    """Swap all rows of each adjusted key for the adjusted rows; a NULL key counts as a key."""
    keys = [c for c in (SURVEY,) if c in base.columns and c in adjusted.columns] + [key]
    listed = adjusted.select(*keys).distinct()
    condition = reduce(Column.__and__, (F.col(f"b.{k}").eqNullSafe(F.col(f"l.{k}")) for k in keys))
    kept = base.alias("b").join(listed.alias("l"), condition, "left_anti")
    return kept.unionByName(adjusted, allowMissingColumns=True)


def keep_ids(responses: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Responses whose key is on a list."""
    return responses.join(ids.select(F.col(ids.columns[0]).alias(key)).distinct(), key, "left_semi")


def union_aligned(*frames: DataFrame) -> DataFrame:
    """Stack frames by column name; columns a frame lacks are NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def distinct_keys(df: DataFrame, cols: str | Sequence[str]) -> DataFrame:
    return df.select(*_key_list(cols)).distinct()


def missing_ids(a: DataFrame, b: DataFrame, key: str | Sequence[str]) -> DataFrame:
    """Distinct keys of ``a`` that ``b`` lacks, NULL counted as a key.

    One grouping over both sides: copies of a hot key are combined before the shuffle.
    """
    keys = _key_list(key)
    tagged = a.select(*keys, F.lit(False).alias("in_b")).unionByName(b.select(*keys, F.lit(True).alias("in_b")))
    return tagged.groupBy(*keys).agg(F.bool_or("in_b").alias("in_b")).where(~F.col("in_b")).select(*keys)
