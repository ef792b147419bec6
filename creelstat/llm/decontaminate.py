"""Benchmark decontamination by a positional inverted index.

The postings (document, term, position) of every term that the test items use are written once as a table. The rarest
terms of each window are looked up first: their postings, shifted by the term's place in the window, name the only
places where the window can begin. Each further term's list is intersected with them, in order of rarity, until all
terms of the window have been met, which is an exact phrase match. Proximity matches come from the same table.

A document's row keeps its place in the index by a posting of the empty term at its end, whose position is the number
of its words. Rows are named by doc_id and a hash of the text, so repeated rows share their postings and equal ids
with different texts do not.

The items are the query set, but no size of theirs is taken for granted: term lists are broadcast while they have
fewer than ``BROADCAST_TERMS`` rows and joined by a shuffle beyond.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower, checkpointed, pick, stored, words

#: Words are runs of letters and digits of ASCII and of all characters beyond it.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SIZE = 10
BROADCAST_TERMS = 200_000
KEY = ("doc_id", "digest")


def tokens(text: Column) -> Column:
    return words(ascii_lower(text), WORD)


def small(df: DataFrame, rows: int) -> DataFrame:
    """For a stored frame of so many rows: broadcast below the bound, else left to Spark."""
    return F.broadcast(df) if rows < BROADCAST_TERMS else df


def windows_of(items: DataFrame, size: int = SIZE) -> DataFrame:
    """(window, place, term) of the distinct windows and (item_id, window), as two frames.

    An item of fewer words than a window is one window; an item without words has none.
    """
    w = pick(items, "item_id", "text").select("item_id", tokens(F.col("text")).alias("w")).where(F.size("w") > 0)
    at = F.sequence(F.lit(1), F.greatest(F.size("w") - size + 1, F.lit(1)))
    return w.select("item_id", F.explode(F.transform(at, lambda i: F.array_join(F.slice("w", i, size), " "))).alias("window"))


def postings_of(documents: DataFrame, terms: DataFrame, n_terms: int) -> DataFrame:
    """(doc_id, digest, term, pos): one row for every use of a term, and the end of each row of documents as term 0.

    terms has (word, term) with the empty word as 0. Positions count from zero.
    """
    text = F.col("text")
    rows = pick(documents, "doc_id", "text").select(
        "doc_id", F.xxhash64(text).alias("digest"), F.posexplode(F.concat(tokens(text), F.array(F.lit("")))).alias("pos", "word")
    )
    return rows.join(small(terms, n_terms), "word").select(*KEY, "term", "pos")


class Index:
    """The inverted index of a set of documents for the terms of the given items."""

    def __init__(self, documents: DataFrame, items: DataFrame, size: int = SIZE):
        """documents has (doc_id, text) and items (item_id, text)."""
        self.size = size
        self.uses = checkpointed(windows_of(items, size).distinct())
        self.windows = self.uses.select("window").distinct().select(
            "window", F.split("window", " ").alias("w")
        )
        names = self.windows.select(F.explode("w").alias("word")).distinct()
        ids = F.row_number().over(Window.partitionBy("part").orderBy("word")) * 64 + F.col("part")
        spark = documents.sparkSession
        self.terms = checkpointed(
            names.withColumn("part", F.pmod(F.hash("word"), F.lit(64))).select("word", ids.cast("int").alias("term"))
            .unionByName(spark.range(1).select(F.lit("").alias("word"), F.lit(0).alias("term")))
        )
        self.n_terms = self.terms.count()
        self.postings = stored(postings_of(documents, self.terms, self.n_terms))
        counts = self.postings.where("term > 0").groupBy("term").count()
        # each window's terms from the rarest on; a window with a term that no document uses can't occur
        placed = self.windows.select("window", F.posexplode("w").alias("place", "word")).join(self.terms, "word")
        ranked = placed.join(counts, "term", "left").groupBy("window").agg(
            F.sort_array(F.collect_list(F.struct(
                F.coalesce("count", F.lit(0)).alias("n"), "term", "place"
            ))).alias("lists"),
        )
        self.lists = checkpointed(
            ranked.where(F.col("lists")[0]["n"] > 0).select(F.xxhash64("window").alias("wid"), "window", "lists")
        )
        self.n_windows = self.lists.count()

    def rows(self) -> DataFrame:
        """(doc_id, digest, n_words) of every row of the documents."""
        return self.postings.where("term = 0").select(*KEY, F.col("pos").cast("long").alias("n_words"))

    def phrases(self) -> DataFrame:
        """(doc_id, digest, window, begin, length): every place where a window occurs, exactly."""
        def entry(k: int) -> DataFrame:
            e = F.get(F.col("lists"), F.lit(k))
            return self.lists.select(
                "wid", e["term"].alias("term"), e["place"].alias("place")
            ).where("term is not null")

        found = self.postings.join(small(entry(0), self.n_windows), "term").select(
            *KEY, "wid", (F.col("pos") - F.col("place")).alias("begin")
        ).where("begin >= 0").distinct()
        lengths = self.lists.select("wid", F.size("lists").alias("length"))
        # the second rarest terms leave few false places
        found = checkpointed(self._met(found, entry(1), lengths, 2))
        rest = self.lists.select("wid", F.posexplode("lists").alias("k", "e")).where("k >= 2").select(
            "wid", "e.term", "e.place"
        )
        whole = self._met(found, rest, lengths, None)
        return whole.join(self._bound(self.lists.select("wid", "window", F.size("lists").alias("length"))), "wid").select(
            *KEY, "window", "begin", "length"
        )

    def _bound(self, df: DataFrame) -> DataFrame:
        return small(df, self.n_windows * self.size)

    def _met(self, found: DataFrame, entries: DataFrame, lengths: DataFrame, upto: int | None) -> DataFrame:
        """The places at which all the given terms of the window stand."""
        probes = found.join(self._bound(entries), "wid").select(
            *KEY, "wid", "begin", "term", (F.col("begin") + F.col("place")).alias("pos")
        )
        places = found.select(*KEY).distinct()
        n = places.count()
        lists = (
            self.postings.join(self._bound(entries.select("term").distinct()), "term", "left_semi")
            .join(small(places.withColumnsRenamed({k: f"p_{k}" for k in KEY}), n),
                  F.col("doc_id").eqNullSafe(F.col("p_doc_id")) & (F.col("digest") == F.col("p_digest")), "left_semi")
            .distinct()
        )
        hits = probes.alias("a").join(
            lists.alias("b"),
            F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("a.digest") == F.col("b.digest"))
            & (F.col("a.pos") == F.col("b.pos")) & (F.col("a.term") == F.col("b.term")),
        ).groupBy("a.doc_id", "a.digest", "a.wid", "a.begin").count()
        need = F.col("length") - 2 if upto is None else F.least(F.col("length"), F.lit(upto)) - 1
        met = hits.join(self._bound(lengths), "wid").where(F.col("count") == need)
        # windows with no further term have nothing left to meet
        done = found.join(self._bound(lengths.where(F.col("length") <= (2 if upto is None else 1))), "wid", "left_semi")
        return met.select(*KEY, "wid", "begin").unionByName(done)

    def near(self, distance: int) -> DataFrame:
        """(doc_id, digest, window, begin): places whose two rarest terms stand within the distance, in any order.

        begin is the position of the rarest term. Windows of one word match wherever it stands.
        """
        e = [F.get(F.col("lists"), F.lit(k))["term"] for k in (0, 1)]
        pairs = self.lists.select("wid", "window", e[0].alias("first"), e[1].alias("second"))
        a = self.postings.join(small(pairs, self.n_windows), F.col("term") == F.col("first")).select(
            *KEY, "window", "second", F.col("pos").alias("begin")
        )
        cell = F.lit(distance + 1)
        probes = a.withColumn("cell", F.explode(F.transform(
            F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: F.floor(F.col("begin") / cell) + d
        )))
        b = self.postings.select(
            F.col("doc_id").alias("b_doc"), F.col("digest").alias("b_digest"), F.col("term").alias("b_term"),
            F.col("pos").alias("b_pos"), F.floor(F.col("pos") / cell).alias("b_cell"),
        )
        close = probes.join(
            b,
            F.col("doc_id").eqNullSafe(F.col("b_doc")) & (F.col("digest") == F.col("b_digest"))
            & (F.col("second") == F.col("b_term")) & (F.col("cell") == F.col("b_cell"))
            & (F.col("begin") != F.col("b_pos")) & (F.abs(F.col("begin") - F.col("b_pos")) <= distance),
        )
        return close.select(*KEY, "window", "begin").unionByName(
            a.where("second is null").select(*KEY, "window", "begin")
        ).distinct()

    def report(self) -> DataFrame:
        """(doc_id, n_words, n_hit, items, contaminated) of every row of the documents.

        n_hit counts the words inside any occurrence of a window, items are the distinct item ids as sorted strings.
        """
        found = checkpointed(self.phrases())
        runs = Window.partitionBy(*KEY).orderBy("begin").rowsBetween(Window.unboundedPreceding, -1)
        ends = found.groupBy(*KEY, "begin").agg(F.max(F.col("begin") + F.col("length")).alias("end"))
        covered = ends.withColumn("before", F.max("end").over(runs)).groupBy(*KEY).agg(
            F.sum(F.greatest(
                F.lit(0), F.col("end") - F.greatest("begin", F.coalesce("before", F.lit(0)))
            )).cast("long").alias("n_hit")
        )
        items = (
            found.select(*KEY, "window").distinct().join(self._bound(self.uses), "window")
            .groupBy(*KEY).agg(F.collect_set(F.coalesce(F.col("item_id").cast("string"), F.lit(""))).alias("items"))
        )
        same = lambda a, b: F.col(f"{a}.doc_id").eqNullSafe(F.col(f"{b}.doc_id")) & (
            F.col(f"{a}.digest") == F.col(f"{b}.digest"))
        hits = covered.alias("c").join(items.alias("i"), same("c", "i"), "left").select("c.*", "i.items")
        return self.rows().alias("r").join(hits.alias("h"), same("r", "h"), "left").select(
            "r.doc_id", "r.digest", "r.n_words",
            F.coalesce("h.n_hit", F.lit(0).cast("long")).alias("n_hit"),
            F.coalesce(F.sort_array("h.items"), F.array().cast("array<string>")).alias("items"),
            F.coalesce(F.col("h.n_hit") > 0, F.lit(False)).alias("contaminated"),
        )
