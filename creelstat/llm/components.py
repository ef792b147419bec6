"""Connected components of links between numbers."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed

#: Links that a task is meant to hold, the least number of tasks, and links that a task unites at a time.
TASK_LINKS = 50_000
TASKS = 8
SLICE = 1 << 20


class Forest:
    """Union-find over the places of an array; the root of a tree is its smallest place."""

    def __init__(self, size: int):
        self.parent = np.arange(size)

    def roots(self, at: np.ndarray) -> np.ndarray:
        parent = self.parent
        out = parent[at]
        while True:
            up = parent[out]
            if (up == out).all():
                parent[at] = out
                return out
            out = up

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        """Unites a[i] with b[i], for all i."""
        while len(a):
            a, b = self.roots(a), self.roots(b)
            apart = a != b
            a, b = a[apart], b[apart]
            if not len(a):
                return
            high, low = np.maximum(a, b), np.minimum(a, b)
            np.minimum.at(self.parent, high, low)

    def join(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Unites a[i] with b[i], for all i; the places i of those pairs that joined two trees."""
        left, out = np.arange(len(a)), []
        while True:
            x, y = self.roots(a[left]), self.roots(b[left])
            apart = x != y
            left, x, y = left[apart], x[apart], y[apart]
            if not len(left):
                return np.concatenate([*out, left])
            high, at = np.unique(np.maximum(x, y), return_index=True)
            self.parent[high] = np.minimum(x, y)[at]
            out.append(left[at])


def stars(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what the links u[i], v[i] do: from every node to the smallest that it reaches by them."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    forest = Forest(len(nodes))
    forest.link(at[:len(u)], at[len(u):])
    place = np.arange(len(nodes))
    roots = forest.roots(place)
    moved = roots != place
    return nodes[moved], nodes[roots[moved]]


def _united(links: DataFrame, some: int = SLICE) -> DataFrame:
    """links (u, v) with those of each task replaced by their stars, ``some`` links or a batch more at a time."""

    def unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, size = [], 0
        for batch in batches:
            pairs.append([np.asarray(batch.column(i)) for i in range(2)])
            size += len(batch)
            if size >= some:
                pairs = [stars(*map(np.concatenate, zip(*pairs, strict=True)))]
                size = len(pairs[0][0])
                if 2 * size >= some:  # too many nodes to go on with
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in pairs[0]], ["u", "v"])
                    pairs, size = [], 0
        if size:
            found = stars(*map(np.concatenate, zip(*pairs, strict=True)))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], ["u", "v"])

    return links.mapInArrow(unite, "u long, v long")


def components(links: DataFrame) -> DataFrame:
    """(node, root): for every node of links (a, b) the smallest node that it reaches.

    Each round hangs every node's larger neighbours on its smallest one, then unites every node's smaller neighbours and
    itself. Both keep what is connected, and the number of rounds grows with the logarithm of the longest chain. For
    the latter, links meet by their larger node, and a task unites all that it gets, which is as much or more. It sends
    a node once for SLICE links at most, so even a node with a third of all links meets in few rows; the join of the
    smaller nodes is one that adaptive execution splits. Nothing is left to do when no node hangs on two others.

    The number of tasks follows the number of links: a few thousand don't take hundreds of tasks in each of the steps,
    of which the driver keeps a record. Every round is checkpointed to the shared folder.
    """
    edges = checkpointed(_united(
        links.select(F.col("a").cast("long").alias("u"), F.col("b").cast("long").alias("v")).where("u != v")
    ))
    tasks = max(TASKS, math.ceil(edges.count() / TASK_LINKS))
    while True:
        edges = checkpointed(_united(edges.repartition(tasks, "u").coalesce(tasks)))
        ends = edges.select(F.explode(F.array("u", "v")).alias("node"), "v")
        least = checkpointed(
            ends.groupBy("node").agg(F.min("v").alias("root"), F.max("v").alias("most")).coalesce(tasks)
        )
        if least.where("root != most").isEmpty():
            return least.select("node", "root")
        up = least.select(F.col("node").alias("v"), "root")
        edges = _united(edges.join(up, "v").select("u", F.col("root").alias("v")).coalesce(tasks))
