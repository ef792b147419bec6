"""Exact top-k by inner product: the three-phase uniform threshold over lists of partial scores.

The components of the vectors are dealt to ``LISTS`` lists, component ``i`` to list ``i % LISTS``. A list scores every
pair of a query and a vector by its own components, and a pair's score is the sum over the lists.

1. Every list reports each query's best partial scores. The vectors named so get their whole scores; the k-th best of
   them is a cutoff that no result can be under.
2. The cutoff goes back to the lists. A sum of ``LISTS`` numbers reaches it only if one of them reaches its
   ``LISTS``-th part, so every list reports all entries from there on. Pairs that no list reports are out.
3. What remains gets whole scores, of which the best are the result.

Vectors are dealt to stripes, queries to blocks. All lists of a stripe meet in one task, which goes through the stripe
a few thousand vectors at a time and keeps each query's k + 1 best so far. They are the cutoff of phase 2 for the next
vectors; phase 1 is for the first ones. So what lists report stays in the task, and only the k + 1 best rows of a query
and stripe leave it. A stripe is copied for every block and a block for every stripe: the number of tasks follows the
product of both sides in steps of ``PAIRS``, and ``_grid`` divides it so that the copies are the fewest.

The partial scores are matrix products, ``CHUNK`` scores at a time. Neither side is held whole anywhere; a task holds
one block, of ``CELLS`` bytes of vectors at most. Vectors travel as bytes, a component in the least of 1, 2, 4 or 8
that its vector fits.

Equal vectors are scored once: a class of them travels with its k + 1 smallest ids, the only ones that can be
among anyone's results. A vector that a third of all rows share is therefore one vector to the lists. A query's
own row is taken out of its k + 1 best, known by its id and the query's score with itself: rows of equal id and
score stand for each other.

Defined results: components become floor(scale * x), held at the ends of 64 bits, and so are scores; sums are exact
before. Vectors that are NULL, or have a NULL or non-finite component, take no part. Missing components of a
shorter vector count as zero. Repeated ids are rows of their own; a query leaves out one row with its id.
Ties go to the smaller id, NULL ids last. Fewer candidates than k: all of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

LISTS = 2
SHARD, BLOCK = 4096, 262_144
FIRST = 512  # vectors that the first cutoffs are taken from
CHUNK = 1 << 19
CELLS = 1 << 25
PAIRS, STRIPE = 1 << 36, 1 << 20  # of a task: scores, and vectors at most
LOW, HIGH = -(1 << 63), (1 << 63) - 1
TYPES = np.int8, np.int16, np.int32, np.int64


def _quantised(lists: pa.Array, scale: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Offsets and floor(scale * x) of all components of lists of doubles, and which lists take part."""
    offsets, values = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
    odd = ~np.isfinite(values)  # NULL is NaN here
    before = np.concatenate([[0], np.cumsum(odd)])
    with np.errstate(over="ignore"):
        floor = np.floor(np.where(odd, 0, values) * scale)
    whole = np.where((floor < -LOW) & (floor >= LOW), floor, 0).astype(np.int64)
    whole[floor >= -LOW], whole[floor < LOW] = HIGH, LOW
    return offsets, whole, before[offsets[1:]] == before[offsets[:-1]]


def _bound(x: np.ndarray) -> int:
    return max(int(x.max(initial=0)), -int(x.min(initial=0)))


def _kind(most: int) -> type:
    """The fastest type that holds sums up to this exactly."""
    return next((kind for kind, exact in ((np.float32, 1 << 24), (np.float64, 1 << 53), (np.int64, 1 << 63)) if most < exact), object)


def product(a: np.ndarray, b: np.ndarray, kind: type | None = None, out: np.ndarray | None = None) -> np.ndarray:
    """Inner products of the rows of two integer matrices, exact; Python's integers where 64 bits could overflow."""
    width = min(a.shape[1], b.shape[1])
    a, b = a[:, :width], b[:, :width]
    kind = kind or _kind(_bound(a) * _bound(b) * max(1, width))
    return np.matmul(a.astype(kind, copy=False), b.astype(kind, copy=False).T, out=out)


def _whole(scores: np.ndarray) -> np.ndarray:
    """As 64-bit numbers, held at their ends."""
    if scores.dtype == object:
        return np.array([min(max(int(x), LOW), HIGH) for x in scores.ravel()], np.int64).reshape(scores.shape)
    return scores.astype(np.int64)


def _encoded(offsets: np.ndarray, values: np.ndarray) -> pa.Array:
    """Lists of 64-bit components as bytes: which of TYPES, then the components in it. Equal lists have equal bytes."""
    sizes = np.diff(offsets)
    rows, parts = [], []
    for size in np.unique(sizes):
        same = np.flatnonzero(sizes == size)
        matrix = values[offsets[same][:, None] + np.arange(size)]
        most = np.maximum(matrix.max(axis=1, initial=0), ~matrix.min(axis=1, initial=0))
        code = np.searchsorted([np.iinfo(x).max for x in TYPES], most)
        for at in np.unique(code):
            own = matrix[code == at].astype(TYPES[at])
            data = np.empty((len(own), 1 + size * own.itemsize), np.uint8)
            data[:, 0] = at
            data[:, 1:] = own.view(np.uint8).reshape(len(own), -1)
            ends = np.arange(len(own) + 1, dtype=np.int32) * data.shape[1]
            parts.append(pa.Array.from_buffers(pa.binary(), len(own), [None, pa.py_buffer(ends), pa.py_buffer(data.tobytes())]))
            rows.append(same[code == at])
    if not rows:
        return pa.array([], pa.binary())
    return pa.concat_arrays(parts).take(pa.array(np.argsort(np.concatenate(rows))))


def _matrix(vectors: pa.Array) -> np.ndarray:
    """Encoded vectors as rows of the type that all fit, filled up with zeros to the longest."""
    if not len(vectors):
        return np.zeros((0, 0), np.int8)
    offsets = np.frombuffer(vectors.buffers()[1], np.int32)[vectors.offset:vectors.offset + len(vectors) + 1].astype(np.int64)
    data = np.frombuffer(vectors.buffers()[2], np.uint8)
    code, length = data[offsets[:-1]], np.diff(offsets) - 1
    out = np.zeros((len(vectors), int((length >> code).max(initial=0))), TYPES[code.max(initial=0)])
    shapes, which = np.unique(length * len(TYPES) + code, return_inverse=True)
    for shape, (size, at) in enumerate(zip(*np.divmod(shapes, len(TYPES)), strict=True)):
        same = np.flatnonzero(which == shape)
        own = data[offsets[same][:, None] + np.arange(1, 1 + size)].view(TYPES[at])
        out[same, :own.shape[1]] = own
    return out


def _packed(rows: DataFrame, scale: int) -> DataFrame:
    """(id, vector): the rows whose vector of doubles takes part, quantised, as bytes."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = batch.filter(batch.column(1).is_valid())
            offsets, values, usable = _quantised(held.column(1), scale)
            yield pa.RecordBatch.from_arrays([held.column(0), _encoded(offsets, values)], ["id", "vector"]).filter(pa.array(usable))

    return rows.mapInArrow(pack, "id long, vector binary")


def _with_itself(queries: DataFrame) -> DataFrame:
    """(query, vector, self): with each query's score with itself."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a = _matrix(batch.column(1))
            a = a.astype(np.int64 if _bound(a) ** 2 * max(1, a.shape[1]) < 1 << 63 else object)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(_whole((a * a).sum(axis=1)), pa.int64())], ["query", "vector", "self"]
            )

    return queries.mapInArrow(score, "query long, vector binary, self long")


def _grid(total: int, different: int, size: int, cores: int) -> tuple[int, int]:
    """Numbers of stripes and blocks, for queries of a size. What a copied query leaves counts as two copies more."""
    tasks = max(1, min(2 * cores, -(-total // 2048)), -(-total * different // PAIRS))
    blocks = -(-different // max(1, min(BLOCK, CELLS // size)))
    fewest = max(1, round((tasks * total / (3 * different)) ** 0.5))
    stripes = max(-(-total // STRIPE), min(fewest, -(-tasks // blocks)))
    return stripes, max(blocks, round(tasks / stripes))


def _dealt(classes: DataFrame, wanted: DataFrame, stripes: int, blocks: int) -> DataFrame:
    """(task, side, ids, vector): a partition for each stripe and block, its queries (side 0) ahead of its vectors."""

    def part(key: str, n: int) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(n)).cast("int")

    def every(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    asking = wanted.select(
        every(stripes).alias("stripe"), part("query", blocks).alias("block"), F.lit(0).alias("side"),
        F.array("query").alias("ids"), "vector",
    )
    held = classes.select(
        part("vector", stripes).alias("stripe"), every(blocks).alias("block"), F.lit(1).alias("side"), "ids", "vector"
    )
    task = (F.col("stripe") * blocks + F.col("block")).alias("task")
    both = asking.unionByName(held).select(task, "side", "ids", "vector")
    return both.repartitionById(stripes * blocks, "task").sortWithinPartitions("task", "side")


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, pa.Array, pa.Array]]:
    """Batches cut where the task or the side changes."""
    for batch in batches:
        task, side = (batch.column(i).to_numpy() for i in range(2))
        edges = np.flatnonzero(np.diff(2 * task.astype(np.int64) + side, prepend=-1, append=-1))
        for start, end in zip(edges[:-1], edges[1:], strict=True):
            cut = batch.slice(start, end - start)
            yield int(task[start]), int(side[start]), cut.column(2), cut.column(3)


def _stacked(parts: list[np.ndarray]) -> np.ndarray:
    """Matrices one below the other, filled up with zeros to the widest."""
    width = max(x.shape[1] for x in parts)
    out = np.zeros((sum(map(len, parts)), width), np.result_type(*parts))
    at = 0
    for x in parts:
        out[at:at + len(x), :x.shape[1]] = x
        at += len(x)
    return out


def _named(lists: list[np.ndarray], total: np.ndarray, k: int) -> np.ndarray:
    """Phase 1: the k-th best whole score of the vectors that the lists' k best partial scores name."""
    n = total.shape[1]
    top = [np.argsort(-x, axis=1)[:, :k] if x.dtype == object else np.argpartition(x, n - k, axis=1)[:, n - k:] for x in lists]
    named = np.sort(np.concatenate(top, axis=1), axis=1)
    score = _whole(np.take_along_axis(total, named, 1))
    score[:, 1:][named[:, 1:] == named[:, :-1]] = LOW
    return np.sort(score, axis=1)[:, -k]


class Stripe:
    """The k best classes of a stripe for each query of a block."""

    def __init__(self, queries: list[tuple[pa.Array, np.ndarray]], k: int):
        self.queries = np.concatenate([ids.flatten().to_numpy() for ids, _ in queries])
        matrix = _stacked([x for _, x in queries])
        self.width, self.k = matrix.shape[1], k
        self.lists = [np.ascontiguousarray(matrix[:, at::LISTS]) for at in range(LISTS)]
        self.score = np.full((len(matrix), k), LOW, np.int64)
        self.at = np.full((len(matrix), k), -1, np.int64)  # places in the stripe
        self.ids: list[pa.Array] = []
        self.first, self.null = np.zeros(0, np.int64), np.zeros(0, bool)  # the smallest id of each class
        self.waiting: list[tuple[pa.Array, np.ndarray]] = []

    def add(self, ids: pa.Array, vectors: pa.Array) -> None:
        self.waiting.append((ids, _matrix(vectors)))
        if sum(len(x) for x, _ in self.waiting) >= SHARD:
            self.search()

    def search(self) -> None:
        """Takes in what waits: few at first, so that phase 1 is short."""
        if not self.waiting:
            return
        matrix = _stacked([x for _, x in self.waiting])
        start, past = 0, len(self.first)
        for ids, _ in self.waiting:
            self.ids.append(ids)
            smallest = ids.flatten().take(pa.array(np.cumsum([0, *ids.value_lengths().to_numpy()[:-1]])))
            self.first = np.append(self.first, smallest.fill_null(0).to_numpy())
            self.null = np.append(self.null, smallest.is_null().to_numpy(zero_copy_only=False))
        while start < len(matrix):
            size = min(SHARD, max(FIRST, 8 * self.k, past + start))
            self._score(matrix[start:start + size], past + start)
            start += size
        self.waiting = []

    def _score(self, matrix: np.ndarray, past: int) -> None:
        vectors = [np.ascontiguousarray(matrix[:, at::LISTS]) for at in range(LISTS)]
        bound, width = _bound(matrix), max(1, min(self.width, matrix.shape[1]))
        step = max(1, CHUNK // len(matrix))
        room = min(step, len(self.queries)), len(matrix)
        typed: dict[type, tuple[list[np.ndarray], list[np.ndarray]]] = {}  # the vectors, and room for the scores
        for start in range(0, len(self.queries), step):
            own = slice(start, start + step)
            cutoff = self.score[own, -1].copy()
            kind = _kind(max(_bound(x[own]) for x in self.lists) * bound * width)
            if kind not in typed:
                typed[kind] = [x.astype(kind) for x in vectors], [np.empty(room, kind) for _ in range(LISTS + 1)]
            lists = [
                product(x[own], y, kind, out[:len(cutoff)]) for x, y, out in zip(self.lists, *typed[kind], strict=False)
            ]
            total = typed[kind][1][-1][:len(cutoff)]
            np.copyto(total, lists[0])
            for x in lists[1:]:
                total += x
            bare = self.at[own, -1] < 0
            if bare.any() and len(matrix) >= self.k:
                cutoff[bare] = _named([x[bare] for x in lists], total[bare], self.k)
            least = cutoff // LISTS + (cutoff % LISTS > 0)
            floor = cutoff
            if total.dtype.kind == "f":  # scores are under this limit, so it loses nothing
                limit = 1 << (24 if total.dtype == np.float32 else 53)
                floor, least = (np.clip(x, -limit, limit).astype(total.dtype) for x in (cutoff, least))
            some = np.flatnonzero((total.max(axis=1) >= floor) | (cutoff == LOW))  # the others have no pair in either phase
            if len(some):
                reported = np.any([x[some] >= least[some, None] for x in lists], axis=0)
                reported &= total[some] >= floor[some, None]
                reported[cutoff[some] == LOW] = True
                row, column = np.nonzero(reported)
                self._keep(start + some[row], past + column, _whole(total[some[row], column]))

    def _keep(self, row: np.ndarray, at: np.ndarray, score: np.ndarray) -> None:
        """Phase 3: the best of what was kept and of these whole scores."""
        changed = np.unique(row)
        row = np.concatenate([np.repeat(changed, self.k), row])
        at = np.concatenate([self.at[changed].ravel(), at])
        score = np.concatenate([self.score[changed].ravel(), score])
        order = _best_first(row, score, self.null[at], self.first[at], at < 0)
        order = order[_places(row[order]) < self.k]
        self.at[changed] = at[order].reshape(-1, self.k)
        self.score[changed] = score[order].reshape(-1, self.k)

    def found(self) -> Iterator[pa.RecordBatch]:
        """(query, id, score): the k best rows of each query."""
        self.search()
        row, column = np.nonzero(self.at >= 0)
        own = pa.concat_arrays(self.ids).take(pa.array(self.at[row, column]))
        sizes, ids = own.value_lengths().to_numpy(), own.flatten()
        row, score = np.repeat(row, sizes), np.repeat(self.score[row, column], sizes)
        null, id_ = ids.is_null().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy()
        order = _best_first(row, score, null, id_)
        order = order[_places(row[order]) < self.k]
        for some in np.array_split(order, -(-len(order) // 65_536)) if len(order) else ():
            yield pa.RecordBatch.from_arrays([
                pa.array(self.queries[row[some]]), pa.array(id_[some], pa.int64(), mask=null[some]), pa.array(score[some]),
            ], ["query", "id", "score"])


def _best_first(row: np.ndarray, score: np.ndarray, null: np.ndarray, id_: np.ndarray, *last: np.ndarray) -> np.ndarray:
    """The order by row, then score downwards, then id upwards with NULL last."""
    return np.lexsort((id_, null, ~score, *last, row))


def _places(row: np.ndarray) -> np.ndarray:
    """The place of each entry among those of its row."""
    start = np.flatnonzero(np.diff(row, prepend=-1))
    return np.arange(len(row)) - np.repeat(start, np.diff(start, append=len(row)))


def _found(dealt: DataFrame, k: int) -> DataFrame:
    """(query, id, score): the k best rows of each query and stripe."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, queries, stripe = None, [], None
        for task, side, ids, vectors in _runs(batches):
            if task != now:
                if stripe:
                    yield from stripe.found()
                now, queries, stripe = task, [], None
            if side == 0:
                queries.append((ids, _matrix(vectors)))
            elif queries:
                stripe = stripe or Stripe(queries, k)
                stripe.add(ids, vectors)
        if stripe:
            yield from stripe.found()

    return dealt.mapInArrow(find, "query long, id long, score long")


def search(
    vectors: DataFrame, queries: DataFrame, k: int = 5, scale: int = 256, id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """(query_id, rank, id, score): the k rows of ``vectors`` with the best scores for each row of ``queries``.

    ``queries`` are rows of ``vectors`` with the same columns; a query is not among its own results.
    """
    given, asked = (_packed(x.select(
        F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vector_col}`").cast("array<double>").alias("vector")
    ), scale) for x in (vectors, queries))
    smallest = Window.partitionBy("vector").orderBy(F.col("id").asc_nulls_last())
    members = given.withColumn("place", F.row_number().over(smallest)).where(F.col("place") <= k + 1)
    classes = stored(members.groupBy("vector").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("place", "id"))), lambda x: x["id"]).alias("ids")
    ))
    asked = stored(asked.withColumnRenamed("id", "query_id"))
    wanted = asked.select("vector").distinct().select(F.monotonically_increasing_id().alias("query"), "vector")
    wanted = stored(_with_itself(wanted))

    total, widest = classes.agg(F.count("*"), F.max(F.octet_length("vector"))).first()
    different = wanted.count()
    if not different:
        return asked.select("query_id", F.lit(1).alias("rank"), F.col("query_id").alias("id"), F.col("query_id").alias("score"))
    cores = vectors.sparkSession.sparkContext.defaultParallelism
    grid = _grid(total, different, max(widest or 1, 16 * (k + 1)), cores)
    found = _found(_dealt(classes, wanted, *grid), k + 1)
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.col("id").asc_nulls_last())
    results = stored(found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k + 1))
    lists = results.groupBy("query").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("place", "id", "score"))), lambda x: F.struct(
            x["id"].alias("id"), x["score"].alias("score"))).alias("found")
    )
    own = F.array_position(F.transform("found", lambda x: (
        x["id"].eqNullSafe(F.col("query_id")) & (x["score"] == F.col("self"))
    )), F.lit(True))
    rest = F.filter("found", lambda x, i: i + 1 != F.col("own"))
    return asked.join(wanted, "vector").join(lists, "query").withColumn("own", own).select(
        "query_id", F.posexplode(F.slice(rest, 1, k)).alias("at", "one")
    ).select("query_id", (F.col("at") + 1).alias("rank"), "one.id", "one.score")
