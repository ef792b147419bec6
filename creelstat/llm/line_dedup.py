"""Line dedup that can be taken back: exact reference counts behind sharded cuckoo filters.

The state is a table of references, one row per document and distinct line key, a table of exact counts per key, and one
cuckoo filter per shard of the keys. The filter of a shard holds the keys that at least two documents refer to. Inserting
documents adds the keys that become shared, deleting documents takes out those that stop being shared, so the state after
a deletion is the state without these documents. Only the counts of keys in the change are made anew: after an insertion
by adding up, after a deletion from the references left. A filter says no for certain and yes with a small error, so only
the lines that pass are joined with the exact counts; the filters spare that join for all lines that are found once.

References are counted with partial aggregation, so a line in every document costs one row a task. Keys with more than
``GROUP_ROWS`` references are known to be shared and need no filter: there are few of them, and their references are
joined with their counts at once. The others are probed shard by shard; the number of shards follows the number of
references, so that a shard holds about ``GROUP_ROWS``. No filter is sent to tasks that do not read its shard.

Defined results: a NULL or empty text is one empty line. Rows with the same doc_id are one document; those with a NULL
doc_id are one document that comes after all others. Keys shorter than ``shortest`` code points are never dropped.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import pick, small_batches, stored

GROUP_ROWS = 200_000
#: Up to so many frequent keys are broadcast; beyond, they are joined by a shuffle.
BROADCAST_ROWS = 1_000_000
KEYS = ("hi", "lo")
BLANK = b" \t\n\x0b\x0c\r"


class CuckooFilter:
    """16-bit fingerprints in buckets of four; a new table of twice the size is opened when one is full."""

    SLOTS, KICKS = 4, 200

    def __init__(self, capacity: int = 64):
        self.tables: list[np.ndarray] = []
        self._open(capacity)

    def _open(self, capacity: int) -> None:
        buckets = 1 << max(2, int(capacity / self.SLOTS / 0.85)).bit_length()
        self.tables.append(np.zeros((buckets, self.SLOTS), np.uint16))

    @staticmethod
    def _place(hi: np.ndarray, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Fingerprint, first place and the step between the two places; masked by the table's size later."""
        mark = ((lo >> np.uint64(48)) | np.uint64(1)).astype(np.uint64)
        return mark, hi, (mark * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(20)

    def contains(self, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
        mark, first, step = self._place(hi.astype(np.uint64), lo.astype(np.uint64))
        found = np.zeros(len(mark), bool)
        for t in self.tables:
            mask = np.uint64(len(t) - 1)
            a, b = (first & mask).astype(np.int64), ((first ^ step) & mask).astype(np.int64)
            m = mark.astype(np.uint16)[:, None]
            found |= (t[a] == m).any(1) | (t[b] == m).any(1)
        return found

    def insert(self, hi: np.ndarray, lo: np.ndarray) -> None:
        mark, first, step = self._place(hi.astype(np.uint64), lo.astype(np.uint64))
        for m, at in zip(mark.tolist(), first.tolist(), strict=True):
            if (left := self._put(self.tables[-1], m, at)) is not None:
                self._open(2 * self.tables[-1].size)
                self._put(self.tables[-1], *left)

    def _put(self, t: np.ndarray, mark: int, at: int) -> tuple[int, int] | None:
        """None if the fingerprint and the ones it pushed out found places; else, with the table as it was, its key."""
        mask = len(t) - 1
        step = ((mark * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF) >> 20
        for i in (at & mask, (at ^ step) & mask):
            free = np.flatnonzero(t[i] == 0)
            if len(free):
                t[i, free[0]] = mark
                return None
        trail, i, m = [], at & mask, mark
        for k in range(self.KICKS):
            slot = (m + k) % self.SLOTS
            trail.append((i, slot, int(t[i, slot])))
            m, t[i, slot] = int(t[i, slot]), m
            i = (i ^ (((m * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF) >> 20)) & mask
            free = np.flatnonzero(t[i] == 0)
            if len(free):
                t[i, free[0]] = m
                return None
        for j, slot, old in reversed(trail):  # nothing was placed: take all moves back
            t[j, slot] = old
        return mark, at

    def delete(self, hi: np.ndarray, lo: np.ndarray) -> None:
        """Takes out keys that were inserted before."""
        mark, first, step = self._place(hi.astype(np.uint64), lo.astype(np.uint64))
        for m, at, s in zip(mark.tolist(), first.tolist(), step.tolist(), strict=True):
            for t in reversed(self.tables):
                mask = len(t) - 1
                spot = next(((i, k) for i in (at & mask, (at ^ s) & mask) for k in np.flatnonzero(t[i] == m)), None)
                if spot:
                    t[spot] = 0
                    break

    def dump(self) -> bytes:
        return b"".join(struct.pack("<I", len(t)) + t.tobytes() for t in self.tables)

    @classmethod
    def load(cls, data: bytes) -> CuckooFilter:
        out, at = cls.__new__(cls), 0
        out.tables = []
        while at < len(data):
            (n,) = struct.unpack_from("<I", data, at)
            size = n * cls.SLOTS * 2
            out.tables.append(np.frombuffer(data, np.uint16, n * cls.SLOTS, at + 4).reshape(n, cls.SLOTS).copy())
            at += 4 + size
        return out


def line_key(line: bytes, shortest: int) -> bytes | None:
    """The 16-byte key of a line; None if the line is too short to be dropped."""
    key = line.strip(BLANK).lower()  # of bytes: A-Z only
    if len(key) < 4 * shortest and len(key.decode("utf-8")) < shortest:
        return None
    return xxhash.xxh3_128_digest(key)


def references(documents: DataFrame, shortest: int) -> DataFrame:
    """(doc_id, hi, lo): the distinct keys of each row of (doc_id, text)."""
    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, found = [], []
            for text in batch.column(1):
                lines = (text.as_py() or "").encode("utf-8").split(b"\n")
                own = {k for x in lines if (k := line_key(x, shortest)) is not None}
                counts.append(len(own))
                found.extend(own)
            pair = np.frombuffer(b"".join(found), np.int64).reshape(-1, 2)
            rows = np.repeat(np.arange(len(counts)), counts)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows)), pa.array(pair[:, 0]), pa.array(pair[:, 1])],
                names=["doc_id", *KEYS],
            )

    small_batches(documents.sparkSession)
    docs = pick(documents, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return docs.mapInArrow(keys, "doc_id long, hi long, lo long")


def counted(refs: DataFrame) -> DataFrame:
    """(hi, lo, refs, owner, last, unnamed) by key: the rows that refer to it, the smallest and the largest doc_id, and
    whether one is NULL."""
    return refs.groupBy(*KEYS).agg(
        F.count("*").alias("refs"), F.min("doc_id").alias("owner"), F.max("doc_id").alias("last"),
        F.max(F.col("doc_id").isNull()).alias("unnamed"),
    )


def added_up(counts: DataFrame) -> DataFrame:
    """Counts of the same keys made one."""
    return counts.groupBy(*KEYS).agg(
        F.sum("refs").alias("refs"), F.min("owner").alias("owner"), F.max("last").alias("last"),
        F.max("unnamed").alias("unnamed"),
    )


def shared() -> Column:
    """Whether at least two documents refer to a counted key."""
    return F.coalesce((F.col("owner") != F.col("last")) | F.col("unnamed") & F.col("owner").isNotNull(), F.lit(False))


@dataclass(frozen=True)
class LineIndex:
    """References and filters of a set of documents. Every change gives a new index; the old one stays valid."""

    refs: DataFrame
    counts: DataFrame
    filters: DataFrame
    shards: int
    shortest: int

    @classmethod
    def build(cls, documents: DataFrame, shortest: int = 10) -> LineIndex:
        refs = stored(references(documents, shortest))
        shards = max(16, refs.count() // GROUP_ROWS)
        counts = stored(counted(refs))
        empty = documents.sparkSession.createDataFrame([], "shard int, filter binary")
        index = cls(refs, counts, empty, shards, shortest)
        return replace(index, filters=index._changed(counts.where(shared()), None))

    def _shard(self) -> Column:
        return F.pmod(F.col("hi"), F.lit(self.shards)).cast("int").alias("shard")

    def _changed(self, added: DataFrame | None, removed: DataFrame | None) -> DataFrame:
        """The filters after keys were added and removed, shard by shard."""
        frames = [
            f.select(self._shard(), *KEYS, F.lit(kind).alias("added"))
            for f, kind in ((added, True), (removed, False)) if f is not None
        ]
        changes = frames[0] if len(frames) == 1 else frames[0].unionByName(frames[1])

        def change(key: tuple, old: pd.DataFrame, keys: pd.DataFrame) -> pd.DataFrame:
            new = keys[keys.added]
            own = CuckooFilter.load(old["filter"][0]) if len(old) else CuckooFilter(len(new))
            gone = keys[~keys.added]
            own.delete(gone.hi.to_numpy().view(np.uint64), gone.lo.to_numpy().view(np.uint64))
            own.insert(new.hi.to_numpy().view(np.uint64), new.lo.to_numpy().view(np.uint64))
            return pd.DataFrame({"shard": [key[0]], "filter": [own.dump()]})

        return stored(
            self.filters.groupBy("shard").cogroup(changes.groupBy("shard"))
            .applyInPandas(change, "shard int, filter binary")
        )

    def _after(self, refs: DataFrame, old: DataFrame, now: DataFrame, keys: DataFrame) -> LineIndex:
        """The index of refs, whose counts differ from these in keys alone: there they were old and are now."""
        was, is_ = old.where(shared()), now.where(shared())
        added, removed = is_.join(was, [*KEYS], "left_anti"), was.join(is_, [*KEYS], "left_anti")
        counts = stored(self.counts.join(keys, [*KEYS], "left_anti").unionByName(now))
        return replace(self, refs=refs, counts=counts, filters=self._changed(added, removed))

    def insert(self, documents: DataFrame) -> LineIndex:
        new = stored(references(documents, self.shortest))
        own = stored(counted(new))
        old = stored(self.counts.join(own.select(*KEYS), [*KEYS], "left_semi"))
        now = stored(added_up(old.unionByName(own)))
        return self._after(stored(self.refs.unionByName(new)), old, now, own.select(*KEYS))

    def delete(self, doc_ids: DataFrame) -> LineIndex:
        """Without the documents of a column doc_id; ids that are not there change nothing."""
        gone = pick(doc_ids, "doc_id").distinct().select(F.col("doc_id").cast("long").alias("gone"))
        hit = F.col("doc_id").eqNullSafe(F.col("gone"))
        keys = stored(self.refs.join(gone, hit, "left_semi").select(*KEYS).distinct())
        refs = stored(self.refs.join(gone, hit, "left_anti"))
        old = stored(self.counts.join(keys, [*KEYS], "left_semi"))
        return self._after(refs, old, stored(counted(refs.join(keys, [*KEYS], "left_semi"))), keys)

    def passing(self, refs: DataFrame) -> DataFrame:
        """The references whose keys pass the filters."""
        probes = refs.select(self._shard(), F.col("doc_id").cast("string").alias("doc_id"), *KEYS)

        def probe(own: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
            if not len(own) or not len(rows):
                return rows.iloc[:0][["doc_id", *KEYS]].astype({"doc_id": object})
            held = CuckooFilter.load(own["filter"][0]).contains(
                rows.hi.to_numpy().view(np.uint64), rows.lo.to_numpy().view(np.uint64)
            )
            return rows.loc[held, ["doc_id", *KEYS]].astype({"doc_id": object})  # Arrow strings fail without rows

        return self.filters.groupBy("shard").cogroup(  # numbers with NULLs lose digits in pandas
            probes.groupBy("shard")
        ).applyInPandas(probe, "doc_id string, hi long, lo long").withColumn("doc_id", F.col("doc_id").cast("long"))

    def drops(self) -> DataFrame:
        """(doc_id, keys): per document the keys, 16 bytes each, of the lines that it loses."""
        counts = self.counts.where(shared()).select(*KEYS, "refs", "owner")
        often = stored(counts.where(F.col("refs") > GROUP_ROWS))
        few = F.broadcast(often) if often.count() <= BROADCAST_ROWS else often
        passed = self.passing(self.refs.join(few.select(*KEYS), [*KEYS], "left_anti"))
        found = self.refs.join(few, [*KEYS]).unionByName(passed.join(counts, [*KEYS]))
        lost = found.where(~F.col("doc_id").eqNullSafe(F.col("owner")))
        return lost.groupBy("doc_id").agg(F.collect_set(F.struct(*KEYS)).alias("keys"))

    def apply(self, documents: DataFrame) -> DataFrame:
        """All columns of documents, in ``row``, with line_text, n_lines and n_dropped beside it."""
        shortest = self.shortest
        small_batches(documents.sparkSession)

        @F.pandas_udf("line_text string, n_lines long, n_dropped long")
        def cleaned(text: pd.Series, keys: pd.Series) -> pd.DataFrame:
            out = []
            for value, drop in zip(text, keys, strict=True):
                lines = (value or "").split("\n")
                if drop is None or not len(drop):
                    out.append((value or "", len(lines), 0))
                    continue
                gone = {struct.pack("<qq", k["hi"], k["lo"]) for k in drop}
                kept = [x for x in lines if line_key(x.encode("utf-8"), shortest) not in gone]
                out.append(("\n".join(kept), len(lines), len(lines) - len(kept)))
            return pd.DataFrame(out, columns=["line_text", "n_lines", "n_dropped"], dtype=object)

        docs = documents.select(F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("row"))
        return docs.alias("d").join(
            self.drops().alias("k"), F.col("d.row.doc_id").cast("long").eqNullSafe(F.col("k.doc_id")), "left"
        ).select("d.row", cleaned(F.col("d.row.text"), F.col("k.keys")).alias("out")).select("row", "out.*")


def dedup_lines(documents: DataFrame, shortest: int = 10) -> DataFrame:
    """See :meth:`LineIndex.apply`, over an index of these documents alone."""
    return LineIndex.build(documents, shortest).apply(documents)
