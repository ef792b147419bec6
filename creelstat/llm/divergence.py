"""How far the sources of a language are apart in their words, and which words set a source off.

Each language keeps the terms that stand in ``least`` of its documents or more. Every group (a source in a language)
and every language gives each kept term a smoothed share ``p = 1 + floor(SCALE * (n + 5) / (N + 5 V))`` from its
``n`` occurrences, all ``N`` of kept terms and the ``V`` kept terms; the language's N and n sum over its groups.
All of it is integers.

The groups of a language are the rows and its kept terms the columns of a count matrix that is mostly zeros. The
distance of two groups, the sum of ``|p - q|`` over all kept terms, is taken on a quadtree of that matrix: pairs of
row blocks go down it together over the same columns. Where both blocks hold only zeros, every column costs the same
for a pair of rows, so the quadrant is priced by its number of columns; the other quadrants are split, down to
single cells. Terms are dealt out by a hash into stripes of about ``STRIPE`` columns, groups into tiles of ``TILE``
rows, and each pair of tiles over one stripe is a Spark group, in which columns are ordered by how frequent they are
so that zeros stand together. A group therefore holds at most ``2 * TILE`` rows of about ``STRIPE`` cells, whatever
the size of the corpus, and a source with a third of all documents is one row like any other.

Words are counted per batch of texts before anything is shuffled.

Defined results: NULL text, lang and source are ''. A group without kept terms has zero counts, a language without
kept terms has distances of zero. Repeated rows count as documents of their own. A language with one source has no
pairs. Without documents there are no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import small_batches, stored
from .token_arrays import byte_class, slices, string_column, tokens

SCALE = 1_000_000_000
BATCH_BYTES = 4_000_000
STRIPE, TILE = 1024, 32
#: Tables of languages and of groups are broadcast up to so many rows, each of two names and a few numbers.
SMALL_ROWS = 200_000
GROUP = ("lang", "source")
#: Every byte below 0x80 but the letters.
NOT_LETTERS = bytes(b for b in range(128) if not chr(b).isalpha())


def term_counts(documents: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences of every term and documents with it; term NULL once a group."""
    small_batches(documents.sparkSession)
    inside = byte_class(NOT_LETTERS)
    named = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in (*GROUP, "text")]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang, source, text = (string_column(c) for c in batch.columns)
            for start, end in slices(text, BATCH_BYTES):
                yield _counted(*(c.slice(start, end - start) for c in (lang, source, text)), inside)

    rows = documents.select(*named).mapInArrow(count, "lang string, source string, term string, n long, docs long")
    return rows.groupBy(*GROUP, "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _counted(lang: pa.Array, source: pa.Array, text: pa.Array, inside: np.ndarray) -> pa.RecordBatch:
    names = [c.dictionary_encode() for c in (lang, source)]
    codes = [c.indices.to_numpy(zero_copy_only=False).astype(np.int64) for c in names]
    width = len(names[1].dictionary)
    groups, group = np.unique(codes[0] * width + codes[1], return_inverse=True)
    words, bounds = tokens(text, inside)
    words = pc.ascii_lower(words).dictionary_encode()
    terms = max(1, len(words.dictionary))
    doc = np.repeat(np.arange(len(text)), np.diff(bounds))
    seen, n = np.unique(doc * terms + words.indices.to_numpy(zero_copy_only=False), return_counts=True)
    cell, at = np.unique(group[seen // terms] * terms + seen % terms, return_inverse=True)
    total = np.bincount(at, weights=n, minlength=len(cell)).astype(np.int64)
    docs = np.bincount(at, minlength=len(cell)).astype(np.int64)
    of = np.concatenate([groups, groups[cell // terms]])
    zero = np.zeros(len(groups), np.int64)
    return pa.RecordBatch.from_arrays([
        names[0].dictionary.take(pa.array(of // width)), names[1].dictionary.take(pa.array(of % width)),
        pa.concat_arrays([pa.nulls(len(groups), pa.string()), words.dictionary.take(pa.array(cell % terms))]),
        pa.array(np.concatenate([zero, total])), pa.array(np.concatenate([zero, docs])),
    ], ["lang", "source", "term", "n", "docs"])


def _small(df: DataFrame) -> DataFrame:
    """The rows, stored, and broadcast where they are few."""
    df = stored(df)
    return F.broadcast(df) if df.count() <= SMALL_ROWS else df


def share(n: Column, total: Column, terms: Column) -> Column:
    """The smoothed share, by exact integers; 0 where there is no term at all."""
    whole = (total + 5 * terms).cast("decimal(20,0)")
    part = F.lit(SCALE).cast("decimal(10,0)") * (n + 5).cast("decimal(20,0)")
    return F.when(terms > 0, 1 + F.call_function("div", part, whole)).otherwise(F.lit(0).cast("long"))


def _halved(cells: np.ndarray) -> np.ndarray:
    """Whether any of the four cells of each quadrant is set."""
    grown = np.zeros([x + x % 2 for x in cells.shape], bool)
    grown[:cells.shape[0], :cells.shape[1]] = cells
    return grown[::2, ::2] | grown[1::2, ::2] | grown[::2, 1::2] | grown[1::2, 1::2]


def quadtree(cells: np.ndarray) -> list[np.ndarray]:
    """Which quadrants hold a nonzero cell: single cells first, the root last."""
    levels = [cells]
    while max(levels[-1].shape) > 1:
        levels.append(_halved(levels[-1]))
    return levels


def distances(share: np.ndarray, nonzero: np.ndarray, zero: np.ndarray, first: int, width: int) -> np.ndarray:
    """Sums of |p - q| between the first ``first`` rows and the others, or among all rows if ``first`` is 0.

    ``share`` has a row per group and a column per term that some group holds, ``zero`` each row's share of a term
    it lacks, and ``width`` is the number of terms with those that no group holds. Only pairs of an earlier and a
    later row are filled in.
    """
    rows, columns = share.shape
    total = np.zeros((rows, rows), np.int64)
    blank = np.full((rows, rows), width - columns, np.int64)  # priced columns of each pair of rows
    levels = quadtree(nonzero) if columns else []
    a = b = c = np.zeros(min(1, columns), np.int64)
    for depth in range(len(levels) - 1, -1, -1):
        held, edge = levels[depth], levels[depth].shape
        empty = ~(held[a, c] | held[b, c])
        if empty.any():
            wide = np.minimum((c[empty] + 1) << depth, columns) - (c[empty] << depth)
            priced = np.bincount(a[empty] * edge[0] + b[empty], weights=wide, minlength=edge[0] ** 2).astype(np.int64)
            block = np.arange(rows) >> depth
            blank += priced.reshape(edge[0], edge[0])[block][:, block]
        a, b, c = a[~empty], b[~empty], c[~empty]
        if depth:
            below = levels[depth - 1].shape
            a, b, c = (
                np.concatenate([2 * x + (corner >> i & 1) for corner in range(8)]) for i, x in enumerate((a, b, c))
            )
            real = (a <= b) & (b < below[0]) & (c < below[1])
            if first:  # blocks of the one tile against blocks of the other
                real &= ((a << depth - 1) < first) & ((b + 1 << depth - 1) > first)
            a, b, c = a[real], b[real], c[real]
    if len(a):
        apart = np.abs(share[a, c] - share[b, c]).astype(np.float64)  # sums of at most 2**53 are exact
        total += np.bincount(a * rows + b, weights=apart, minlength=rows * rows).astype(np.int64).reshape(rows, rows)
    return total + blank * np.abs(zero[:, None] - zero)


def _tile_pair(key: tuple, groups: pd.DataFrame, cells: pd.DataFrame, tile: int) -> pd.DataFrame:
    """Distances of the groups of one tile to those of another, over one stripe of terms."""
    _, _, one, other = key
    groups = groups.sort_values("g")
    number = groups["g"].to_numpy()
    zero = groups["zero"].to_numpy(np.int64)
    columns, column = np.unique(cells["term_id"].to_numpy(np.int64), return_inverse=True)
    order = np.empty(len(columns), np.int64)
    order[np.argsort(-np.bincount(column, minlength=len(columns)), kind="stable")] = np.arange(len(columns))
    row, column = np.searchsorted(number, cells["g"].to_numpy(np.int64)), order[column]
    nonzero = np.zeros((len(groups), len(columns)), bool)
    nonzero[row, column] = True
    values = np.repeat(zero[:, None], len(columns), 1)
    values[row, column] = cells["p"].to_numpy(np.int64)
    first = 0 if one == other else int((number // tile == one).sum())
    table = distances(values, nonzero, zero, first, int(groups["width"].iloc[0]))
    a, b = np.triu_indices(len(groups), 1)
    if first:
        a, b = a[between := (a < first) & (b >= first)], b[between]
    return pd.DataFrame({"lang": key[0], "a": number[a], "b": number[b], "value": table[a, b]})


@dataclass(frozen=True)
class Divergence:
    """Counts and shares of all groups; ``pairs`` and ``terms`` report on them.

    ``groups`` has (lang, source, g, total, zero), ``g`` numbering the groups of a language and ``zero`` the share of a
    term that the group lacks; ``cells`` has (lang, source, term, term_id, stripe, g, n, p, q), a row for each kept
    term of a group, ``q`` the language's share.
    """

    groups: DataFrame
    cells: DataFrame
    stripes: DataFrame

    @classmethod
    def of(cls, documents: DataFrame, least: int = 30) -> Divergence:
        counts = stored(term_counts(documents))
        kept = counts.where(F.col("term").isNotNull()).groupBy("lang", "term").agg(
            F.sum("n").alias("in_lang"), F.sum("docs").alias("docs")
        ).where(F.col("docs") >= least).select("lang", "term", "in_lang")
        kept = stored(kept.withColumn("term_id", F.monotonically_increasing_id()))
        langs = _small(kept.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("in_lang").alias("lang_total")))
        parts = F.ceil(F.col("terms") / STRIPE)
        placed = kept.join(langs, "lang").withColumn("stripe", F.pmod(F.xxhash64("term"), parts).cast("int"))
        stripes = stored(placed.groupBy("lang", "stripe").agg(F.count("*").alias("width")))
        plain = stored(
            counts.join(placed, ["lang", "term"])
            .withColumn("q", share(F.col("in_lang"), F.col("lang_total"), F.col("terms")))
            .select(*GROUP, "term", "term_id", "stripe", "n", "q")
        )
        totals = plain.groupBy(*GROUP).agg(F.sum("n").alias("total"))
        groups = (
            counts.where(F.col("term").isNull()).select(*GROUP).join(totals, [*GROUP], "left").join(langs, "lang", "left")
            .select(*GROUP, *[F.coalesce(c, F.lit(0)).alias(c) for c in ("total", "terms")])
        )
        order = Window.partitionBy("lang").orderBy(F.desc("total"), "source")
        zero = share(F.lit(0).cast("long"), F.col("total"), F.col("terms"))
        groups = _small(groups.select(
            *GROUP, "total", "terms", zero.alias("zero"), (F.row_number().over(order) - 1).alias("g")
        ))
        cells = plain.join(groups.drop("zero"), [*GROUP]).withColumn(
            "p", share(F.col("n"), F.col("total"), F.col("terms"))
        ).drop("total", "terms")
        return cls(groups, stored(cells), stripes)

    def pairs(self) -> DataFrame:
        """(lang, source, other, value): the distance of every group to every other one of its language."""
        tile = TILE
        tiles = _small(self.groups.groupBy("lang").agg(F.floor(F.max("g") / tile).cast("int").alias("last")))
        group = ("lang", "stripe", "one", "other")

        def dealt(rows: DataFrame) -> DataFrame:
            """Each row once for every pair of tiles that its own is one of."""
            own, every = F.floor(F.col("g") / tile).cast("int"), F.explode(F.sequence(F.lit(0), F.col("last")))
            return rows.join(tiles, "lang").withColumn("_own", own).withColumn("_every", every).withColumns(
                {"one": F.least("_own", "_every"), "other": F.greatest("_own", "_every")}
            )

        def tile_pair(key: tuple, rows: pd.DataFrame, cells: pd.DataFrame) -> pd.DataFrame:
            return _tile_pair(key, rows, cells, tile)

        rows = self.groups.join(self.stripes, "lang", "left").withColumns(
            {c: F.coalesce(c, F.lit(0)) for c in ("stripe", "width")}
        )
        rows = dealt(rows).select(*group, "g", "zero", "width")
        cells = dealt(self.cells.select("lang", "stripe", "g", "term_id", "p")).select(*group, "g", "term_id", "p")
        part = rows.groupBy(*group).cogroup(cells.groupBy(*group)).applyInPandas(
            tile_pair, "lang string, a int, b int, value long"
        )
        whole = stored(part.groupBy("lang", "a", "b").agg(F.sum("value").alias("value")))
        named = self.groups.select("lang", "source", "g")
        return whole.unionByName(whole.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), "value")).join(
            named.select("lang", "source", F.col("g").alias("a")), ["lang", "a"]
        ).join(named.select("lang", F.col("source").alias("other"), F.col("g").alias("b")), ["lang", "b"]).select(
            *GROUP, "other", "value"
        )

    def terms(self) -> DataFrame:
        """(lang, source, term, value): the terms that a group has, and more often than its language."""
        over = self.cells.where("n > 0 AND p > q")
        return over.select(*GROUP, "term", (F.col("p") - F.col("q")).alias("value"))


def ranked(rows: DataFrame, item: str, top: int | None = None) -> DataFrame:
    """(lang, source, item, value, rank): by value, then by the bytes of the item; all ranks without ``top``."""
    order = Window.partitionBy(*GROUP).orderBy(F.desc("value"), item)
    found = rows.select(*GROUP, F.col(item).alias("item"), "value", F.row_number().over(order).alias("rank"))
    return found if top is None else found.where(F.col("rank") <= top)
