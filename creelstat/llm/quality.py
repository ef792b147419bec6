"""Quality rules with risk-controlled thresholds.

Each rule rejects a document whose measure is above a cutoff. Cutoffs come from a fixed grid and are certified, per
stratum and rule, on labelled documents: of those labelled good, a cutoff may reject so few that the exact binomial
test rules out a false rejection rate above ``risk``. A grid is tested from its highest cutoff down and stops at the
first that fails, so one grid is one hypothesis family; Bonferroni's correction covers strata x rules. With
probability ``1 - error`` no rule of any stratum then rejects more than its share of the good documents. Of the
certified cutoffs the one that best tells bad from good documents is used, and a rule that tells nothing, or whose
stratum has too few labels for any certificate, rejects nothing.

All measures are expressions over one row: no words are exploded. Labelled documents are counted per stratum, rule and
grid cell before the shuffle, so the thresholds are made from strata x rules x grid rows at most.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, checkpointed, let, pick, stored, words

WINDOW = 5
#: Above this number of strata x rules the thresholds are joined by a shuffle instead of a broadcast.
BROADCAST_ROWS = 10_000


@dataclass(frozen=True)
class Rule:
    """Rejects documents whose ``measure`` (SQL over the columns of :func:`measured`) lies above a cutoff."""

    name: str
    measure: str
    cutoffs: tuple[float, ...]


def grid(low: float, high: float, steps: int) -> tuple[float, ...]:
    return tuple(low + (high - low) * i / steps for i in range(steps + 1))


RULES = (
    Rule("symbols", "n_symbols / greatest(n_words, 1)", grid(0.02, 1.0, 49)),
    Rule("duplicate_lines", "n_dup_lines / greatest(n_words, 1)", grid(0.005, 0.25, 49)),
    Rule("repeated_words", "n_repeat_words / greatest(n_words, 1)", grid(0.01, 0.5, 49)),
    Rule("long_words", "word_chars / greatest(n_words, 1)", grid(6.0, 30.0, 48)),
    Rule("short_words", "-word_chars / greatest(n_words, 1)", grid(-6.0, -1.0, 50)),
)


def repeated_words(tokens: Column) -> Column:
    """The number of words inside windows of five that occur at least twice, the first occurrence included.

    Windows are compared by 64-bit hashes of their five words. Most texts repeat none, which one pass shows; only
    for the others the windows are sorted.
    """
    size = F.size(tokens)
    starts = F.when(size >= WINDOW, F.sequence(F.lit(0), size - WINDOW)).otherwise(F.array().cast("array<int>"))
    hashes = F.transform(starts, lambda i: F.xxhash64(*[F.get(tokens, i + k) for k in range(WINDOW)]))

    def covered(h: Column) -> Column:
        ordered = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return let(ordered, lambda s: let(
            F.array_sort(F.transform(
                F.filter(
                    F.transform(s, lambda x, k: F.struct(
                        x["i"].alias("i"),
                        (x["h"].eqNullSafe(F.get(s, k - 1)["h"]) | x["h"].eqNullSafe(F.get(s, k + 1)["h"])).alias("d"),
                    )),
                    lambda x: x["d"],
                ),
                lambda x: x["i"],
            )),
            lambda at: F.aggregate(
                F.transform(at, lambda i, k: F.least(F.coalesce(F.get(at, k + 1) - i, F.lit(WINDOW)), F.lit(WINDOW))),
                F.lit(0).cast("long"), lambda a, x: a + x,
            ),
        ))

    return let(hashes, lambda h: F.when(
        F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")
    ).otherwise(covered(h)))


def measured(documents: DataFrame, extra: tuple[str, ...] = ("lang",)) -> DataFrame:
    """doc_id, the extra columns, n_words and the four base measures of every row; NULL texts have no words."""
    text = F.coalesce("text", F.lit(""))
    lines = F.filter(F.split(text, F.lit("\n")), lambda x: F.regexp_like(x, F.lit(f"[^{SPACE}]")))
    blank = F.length(F.regexp_replace(text, f"[^{SPACE}]+", ""))
    return pick(documents, "doc_id", "text", *extra).select(
        "doc_id", *extra,
        let(words(F.col("text")), lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"), repeated_words(w).alias("n_repeat_words")
        )).alias("w"),
        (F.length(text) - blank).cast("long").alias("word_chars"),
        F.length(F.regexp_replace(text, "[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
    ).select("doc_id", *extra, "w.n_words", "word_chars", "n_symbols", "n_dup_lines", "w.n_repeat_words")


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def cells(rules: tuple[Rule, ...]) -> Column:
    """Per rule, how many cutoffs of its grid the measure exceeds."""
    def cell(rule: Rule) -> Column:
        cutoffs = F.array(*map(F.lit, rule.cutoffs))
        exceeded = let(F.expr(rule.measure).cast("double"), lambda x: F.size(F.filter(cutoffs, lambda at: x > at)))
        return F.struct(
            F.lit(rule.name).alias("rule"), F.lit(len(rule.cutoffs)).alias("steps"), exceeded.alias("cell")
        )

    return F.array(*map(cell, rules))


def binomial_tail(k: Column, n: Column, rate: float) -> Column:
    """P(X <= k) of a binomial variable, summed in logarithms term by term."""
    odds = F.log(F.lit(rate / (1 - rate)))
    first = n * F.log(F.lit(1 - rate))
    return F.aggregate(
        F.when(k >= 1, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<bigint>")),
        F.struct(first.alias("term"), first.alias("sum")),
        lambda a, i: let(a["term"] + F.log((n - i + 1) / i) + odds, lambda t: F.struct(
            t.alias("term"),
            (F.greatest(t, a["sum"]) + F.log1p(F.exp(-F.abs(t - a["sum"])))).alias("sum"),
        )),
        lambda a: F.exp(a["sum"]),
    )


def thresholds(
    labelled: DataFrame, strata: int, rules: tuple[Rule, ...] = RULES, risk: float = 0.05, error: float = 0.1
) -> DataFrame:
    """(stratum, rule, cell, cutoff, good, rejected_good, bad, rejected_bad) of the rules in force.

    labelled has (stratum, good, cells). A document is rejected if its cell is at least the returned one. ``risk`` is
    shared evenly among the rules and ``error`` among strata x rules.
    """
    share, level = risk / len(rules), error / max(1, strata * len(rules))
    counts = (
        labelled.select("stratum", "good", F.explode("cells").alias("c"))
        .groupBy("stratum", "c.rule", "c.steps", "c.cell")
        .agg(F.count_if("good").alias("g"), F.count_if(~F.col("good")).alias("b"))
    )
    group = Window.partitionBy("stratum", "rule")
    # every cutoff of a grid gets a row, so that cells without documents are tested as well
    whole = counts.groupBy("stratum", "rule", "steps").agg(
        F.collect_list(F.struct("cell", "g", "b")).alias("seen"), F.sum("g").alias("good"), F.sum("b").alias("bad")
    ).select(
        "stratum", "rule", "good", "bad", "seen", F.explode(F.sequence(F.lit(1), F.col("steps"))).alias("cell")
    )

    def above(name: str) -> Column:
        return F.aggregate(
            F.filter("seen", lambda s: s["cell"] >= F.col("cell")), F.lit(0).cast("long"), lambda a, s: a + s[name]
        )

    tested = whole.select("stratum", "rule", "cell", "good", "bad", above("g").alias("rejected_good"),
                          above("b").alias("rejected_bad"))
    # a cutoff that rejects the expected share or more can't be certified: no sum is needed
    sure = F.when(
        F.col("rejected_good") >= F.col("good") * share, F.lit(1.0)
    ).otherwise(binomial_tail(F.col("rejected_good"), F.col("good"), share)) <= level
    certified = tested.withColumn("sure", sure).withColumn(
        "held", F.min(F.col("sure").cast("int")).over(group.orderBy(F.desc("cell")))
    ).where("held = 1")
    gain = F.col("rejected_bad") / F.greatest("bad", F.lit(1)) - F.col("rejected_good") / F.greatest("good", F.lit(1))
    best = certified.withColumn("gain", gain).where("gain > 0").groupBy("stratum", "rule").agg(
        F.max(F.struct("gain", "cell", "good", "rejected_good", "bad", "rejected_bad")).alias("best")
    )
    cutoffs = F.create_map(*[
        x for r in rules for x in (F.lit(r.name), F.array(*map(F.lit, r.cutoffs)))
    ])
    return best.select(
        "stratum", "rule", "best.cell", F.element_at(F.element_at(cutoffs, F.col("rule")), F.col("best.cell")).alias("cutoff"),
        "best.good", "best.rejected_good", "best.bad", "best.rejected_bad",
    )


def judge(
    documents: DataFrame, labels: DataFrame, rules: tuple[Rule, ...] = RULES, risk: float = 0.05, error: float = 0.1
) -> DataFrame:
    """Every row of documents with its measures, base_failed, rejected_by (names of rules) and kept.

    documents has (doc_id, text, lang), labels (doc_id, quality). The stratum is the language; NULL is one too.
    Labels without a quality count for nothing; a document labelled both ways counts as good. Documents that fail
    the base rules are no part of the calibration, since no threshold decides about them. Rows of one stratum, doc_id
    and text are one trial however often they are listed: the binomial bound holds for independent trials only.
    """
    texts = pick(documents, "doc_id", "text", "lang").withColumn("digest", F.xxhash64("text"))
    frame = stored(measured(texts, ("lang", "digest")).withColumn("base_failed", base_failed()))
    frame = frame.withColumn("stratum", F.coalesce("lang", F.lit("\0")))
    known = pick(labels, "doc_id", "quality").where("quality is not null").groupBy("doc_id").agg(
        (F.max("quality") > 0).alias("good")
    )
    labelled = (
        frame.where("not base_failed").join(known, "doc_id").dropDuplicates(["stratum", "doc_id", "digest"])
        .select("stratum", "good", cells(rules).alias("cells"))
    )
    strata = frame.select("stratum").distinct().count()
    rows = checkpointed(thresholds(labelled, strata, rules, risk, error))
    limits = rows.groupBy("stratum").agg(
        F.map_from_entries(F.collect_list(F.struct("rule", "cell"))).alias("limits")
    )
    if strata * len(rules) <= BROADCAST_ROWS:
        limits = F.broadcast(limits)
    hit = F.transform(
        F.filter(cells(rules), lambda c: c["cell"] >= F.element_at(F.col("limits"), c["rule"])), lambda c: c["rule"]
    )
    none = F.array().cast("array<string>")
    return (
        frame.join(limits, "stratum", "left")
        .withColumn("rejected_by", F.when(F.col("limits").isNull(), none).otherwise(F.coalesce(hit, none)))
        .withColumn("kept", ~F.col("base_failed") & (F.size("rejected_by") == 0))
        .drop("stratum", "digest", "limits")
    )
