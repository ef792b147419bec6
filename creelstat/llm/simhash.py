"""SimHash near-dedup by a self-join of binary tries.

Distinct fingerprints are the leaves of a binary trie. The join walks down pairs of nodes of equal depth from the root,
adds up the bits in which the two paths differ, and drops a pair once they exceed the budget. The top of the trie is
walked by Spark: nodes at a depth that follows the number of fingerprints are the blocks, and a pair of blocks within
the budget is one group, or several where a block is too full. Inside a group numpy walks the rest of both subtries,
all pairs of a depth at once and in bounded slices.

Links of a group are not returned as such but as a forest: at most one link per fingerprint. A group of near copies
as large as a third of all documents therefore costs its size, not its square, in rows. Where all fingerprints below
two nodes must lie within the budget of each other, they are linked without being paired.

Exact copies meet in one fingerprint before the join; that count is pre-aggregated. NULL texts have no words, hence
fingerprint zero. NULL ids take part, but the smallest id of a component is the smallest that isn't NULL.
"""

from __future__ import annotations

import math
from itertools import accumulate, combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, pick, small_batches, stored
from .components import Forest, components

BITS = 64
SEED = 42
#: Fingerprints that a block of the trie is meant to hold.
BLOCK = 500_000
#: The same where fingerprints carry lanes of their sketches: a group of two such blocks has some 50 bytes a row.
LIKELY_BLOCK = 2_000_000
#: Node pairs that are walked at a time, and leaf pairs compared at a time.
SLICE = 1 << 16
LEAF = 8


#: For each byte value its bits, the lowest first.
BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def shingle_hashes(text: str | None, size: int) -> np.ndarray:
    """XXH64 of every shingle of ``size`` words, repeats included; the whole text if it has fewer words."""
    words = (text or "").encode("utf-8").lower().split()  # of bytes: A-Z, and \x20\x09-\x0D
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    ends = list(accumulate(len(w) + 1 for w in words))
    starts = [0, *ends[:-1]]
    if len(words) > size:
        pieces = [joined[a:b - 1] for a, b in zip(starts, ends[size - 1:], strict=False)]
    else:
        pieces = [joined]
    return np.array([xxhash.xxh64_intdigest(p, SEED) for p in pieces], np.uint64)


def sketch(hashes: np.ndarray, lanes: int = 1) -> np.ndarray:
    """``lanes`` 64-bit SimHashes of hashes; the first is of the hashes themselves, the others of mixtures of them."""
    if not len(hashes):
        return np.zeros(lanes, np.uint64)
    counts = np.zeros((lanes * 8, 256), np.int64)
    row = np.arange(lanes * 8, dtype=np.int64) << 8
    for at in range(0, len(hashes), 1 << 14):
        part = hashes[at:at + (1 << 14), None]
        mixed = np.repeat(part, lanes, axis=1)
        if lanes > 1:
            mixed[:, 1:] += np.arange(1, lanes, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            rest = mixed[:, 1:]
            rest ^= rest >> np.uint64(30)
            rest *= np.uint64(0xBF58476D1CE4E5B9)
            rest ^= rest >> np.uint64(27)
            rest *= np.uint64(0x94D049BB133111EB)
            rest ^= rest >> np.uint64(31)
        values = mixed.view(np.uint8).reshape(len(part), lanes * 8)
        counts += np.bincount((values + row).ravel(), minlength=counts.size).reshape(counts.shape)
    bits = (2 * (counts @ BYTE_BITS) > len(hashes)).astype(np.uint8)
    return np.packbits(bits.ravel(), bitorder="little").view(np.uint64)


def fingerprint(text: str | None, size: int) -> int:
    """The 64-bit SimHash of a text's shingles."""
    return int(sketch(shingle_hashes(text, size))[0])


def set_hash(distinct: np.ndarray) -> int:
    """A signed number for a set of shingles, given their sorted distinct hashes."""
    return int(np.array([xxhash.xxh64_intdigest(distinct.tobytes(), SEED)], np.uint64).view(np.int64)[0])


def set_sketches(documents: DataFrame, size: int, lanes: int, text: str = "text") -> DataFrame:
    """All columns of documents, ``sketch`` of the distinct shingles, and ``node``, a number for the set of them."""
    small_batches(documents.sparkSession)

    @F.pandas_udf("sketch array<long>, node long")
    def hashed(texts: pd.Series) -> pd.DataFrame:
        sets = [np.unique(shingle_hashes(t, size)) for t in texts]
        return pd.DataFrame({
            "sketch": pd.Series([sketch(x, lanes).view(np.int64) for x in sets], dtype=object),
            "node": pd.Series([set_hash(x) for x in sets], dtype="int64"),
        })

    return documents.withColumn("__set", hashed(F.col(f"`{text}`"))).select(
        *[F.col(f"`{c}`") for c in documents.columns], "__set.sketch", "__set.node"
    )


def fingerprints(documents: DataFrame, size: int = 4, lanes: int = 1, text: str = "text") -> DataFrame:
    """All columns of documents and ``sketch``, the SimHashes as an array of signed numbers."""
    small_batches(documents.sparkSession)

    @F.pandas_udf("array<long>")
    def hashed(texts: pd.Series) -> pd.Series:
        return pd.Series([sketch(shingle_hashes(t, size), lanes).view(np.int64) for t in texts], dtype=object)

    return documents.withColumn("sketch", hashed(F.col(f"`{text}`")))


def walk(own: np.ndarray, other: np.ndarray | None, depth: int, spent: int, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """Links between sorted distinct fingerprints (uint64) that share their first ``depth`` bits on each side.

    other is None for the pairs within one block. spent is the number of bits in which the two blocks' paths differ.
    Returns the ends of a forest's links, as fingerprints.
    """
    fps = own if other is None else np.concatenate([own, other])
    forest = Forest(len(fps))
    for sure, ends in _descend(fps, None if other is None else len(own), depth, spent, budget):
        if sure:
            _chain(forest, *ends)
        else:
            for x, y in _leaves(fps, *ends, budget):
                forest.link(x, y)
    at = np.arange(len(fps))
    roots = forest.roots(at)
    moved = roots != at
    return fps[at[moved]], fps[roots[moved]]


def _descend(fps: np.ndarray, first: int | None, depth: int, spent: int, budget: int, settled=None):
    """(sure, (a, a_end, b, b_end)): pairs of ranges of fps, in bounded slices, that hold all pairs within the budget.

    fps are sorted within their block; equal ones are allowed. The second block begins at ``first``; None means pairs
    within one block. Whatever lies in sure ranges is within the budget, the others hold LEAF fingerprints at most.
    settled(a, a_end, b, b_end) marks the pairs of ranges that need no look.
    """
    own = len(fps) if first is None else first
    # a pair of nodes: [a, a_end) and [b, b_end) of fps, bits spent so far, depth
    todo = [(
        np.array([0]), np.array([own]), np.array([first or 0]), np.array([len(fps)]), np.array([spent]), depth,
    )]
    while todo:
        a, a_end, b, b_end, used, deep = todo.pop()
        if len(a) > SLICE:
            half = len(a) // 2
            todo += [
                tuple(x[half:] for x in (a, a_end, b, b_end, used)) + (deep,),
                tuple(x[:half] for x in (a, a_end, b, b_end, used)) + (deep,),
            ]
            continue
        if settled is not None:
            left = ~settled(a, a_end, b, b_end)
            a, a_end, b, b_end, used = (x[left] for x in (a, a_end, b, b_end, used))
        rest = BITS - deep
        sure = used + rest <= budget  # whatever follows, these lie within the budget
        if sure.any():
            yield True, (a[sure], a_end[sure], b[sure], b_end[sure])
        small = ~sure & ((a_end - a) <= LEAF) & ((b_end - b) <= LEAF)
        if small.any():
            yield False, (a[small], a_end[small], b[small], b_end[small])
        more = ~sure & ~small
        if not more.any():
            continue
        a, a_end, b, b_end, used = (x[more] for x in (a, a_end, b, b_end, used))
        bit = np.uint64(1) << np.uint64(BITS - 1 - deep)
        a_mid, b_mid = _split(fps, a, a_end, bit), _split(fps, b, b_end, bit)
        same = a == b
        parts = []
        for x, x_end, y, y_end, cost, keep in (
            (a, a_mid, b, b_mid, 0, None), (a_mid, a_end, b_mid, b_end, 0, None),
            (a, a_mid, b_mid, b_end, 1, None), (a_mid, a_end, b, b_mid, 1, ~same),
        ):
            ok = (x < x_end) & (y < y_end) & (used + cost <= budget)
            if keep is not None:  # the pair of one node with itself has one mixed pair of children
                ok &= keep
            # a single fingerprint paired with itself says nothing
            ok &= ~((x == y) & (x_end - x == 1))
            parts.append(tuple(v[ok] for v in (x, x_end, y, y_end, used + cost)))
        todo.append(tuple(np.concatenate(v) for v in zip(*parts, strict=True)) + (deep + 1,))


class Likely:
    """Pairs of places whose sketches differ in at most ``most`` bits.

    Without trees, the pairs found are those that joined two trees of a forest, and pairs within one tree are passed
    over. With trees, a number for each place, they are all pairs between different trees.
    """

    def __init__(self, sketches: np.ndarray, most: float, trees: np.ndarray | None = None):
        self.sketches, self.most, self.frozen = sketches, most, trees is not None
        self.forest = Forest(len(sketches))
        if self.frozen:
            _, head, inverse = np.unique(trees, return_index=True, return_inverse=True)
            self.forest.parent = head[inverse]
        self.found: list[tuple[np.ndarray, np.ndarray]] = []
        self.looks, self.state = None, None

    def look(self, x: np.ndarray, y: np.ndarray) -> None:
        apart = self.forest.roots(x) != self.forest.roots(y)
        x, y = x[apart], y[apart]
        bits = np.zeros(len(x), np.int64)
        for lane in self.sketches.T:
            bits += np.bitwise_count(lane[x] ^ lane[y])
        near = bits <= self.most
        x, y = x[near], y[near]
        if not self.frozen:
            at = self.forest.join(x, y)
            x, y = x[at], y[at]
        if len(x):
            self.found.append((x, y))

    def settled(self, a, a_end, b, b_end) -> np.ndarray:
        """Which pairs of ranges lie in one tree; as of some looks ago, which stays true."""
        size = len(self.sketches)
        if self.looks is None or (self.looks >= size and not self.frozen):
            roots = self.forest.roots(np.arange(size))
            self.state, self.looks = (roots, np.cumsum(np.diff(roots, prepend=roots[:1]) != 0)), 0
        self.looks += len(a)
        roots, turns = self.state
        return (roots[a] == roots[b]) & (turns[a] == turns[a_end - 1]) & (turns[b] == turns[b_end - 1])

    def ranges(self, a, a_end, b, b_end) -> None:
        """Looks at all pairs of both ranges of each pair."""
        many = np.maximum(a_end - a, b_end - b) > LEAF
        for x, y in _leaves(None, a[~many], a_end[~many], b[~many], b_end[~many], 0):
            self.look(x, y)
        for i in np.flatnonzero(many):
            own, other = np.arange(a[i], a_end[i]), np.arange(b[i], b_end[i])
            # tree by tree as they are now, without the others that have joined meanwhile
            own_tree, other_tree = self.forest.roots(own), self.forest.roots(other)
            for tree in np.unique(own_tree):
                mine = own[own_tree == tree]
                rest = other[other_tree > tree] if a[i] == b[i] else other
                rest = rest[self.forest.roots(rest) != self.forest.roots(mine[:1])]
                if not len(rest):
                    continue
                step = max(1, SLICE * LEAF // len(rest))
                for k in range(0, len(mine), step):
                    for j in range(0, len(rest), SLICE * LEAF):
                        x, y = mine[k:k + step], rest[j:j + SLICE * LEAF]
                        self.look(np.repeat(x, len(y)), np.tile(y, len(x)))

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.found:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        x, y = map(np.concatenate, zip(*self.found, strict=True))
        return x, y


def walk_likely(
    fps: np.ndarray, first: int | None, depth: int, spent: int, budget: int, sketches: np.ndarray, most: float,
    trees: np.ndarray | None = None,
) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of places within the budget by fps and within most bits by sketches, as Likely tells them."""
    likely = Likely(sketches, most, trees)
    if trees is None:  # large groups of near copies become one tree before their pairs are walked
        for step in (1, 2, 3):
            likely.look(np.arange(len(fps) - step), np.arange(step, len(fps)))
    for sure, ends in _descend(fps, first, depth, spent, budget, likely.settled):
        if sure:
            likely.ranges(*ends)
        else:
            for x, y in _leaves(fps, *ends, budget):
                likely.look(x, y)
    return likely.pairs()


def _split(fps: np.ndarray, start: np.ndarray, end: np.ndarray, bit: np.uint64) -> np.ndarray:
    """The first place in each sorted range whose fingerprint has the bit, by bisection of all ranges at once."""
    low, high = start.copy(), end.copy()
    while (open_ := low < high).any():
        mid = (low + high) // 2
        has = (fps[np.minimum(mid, len(fps) - 1)] & bit) != 0
        high = np.where(open_ & has, mid, high)
        low = np.where(open_ & ~has, mid + 1, low)
    return low


def _chain(forest: Forest, a: np.ndarray, a_end: np.ndarray, b: np.ndarray, b_end: np.ndarray) -> None:
    """Unites everything below both nodes of each pair."""
    for start, end in ((a, a_end), (b, b_end)):
        for chunk in np.array_split(np.arange(len(start)), max(1, int((end - start).sum()) // (SLICE * LEAF) + 1)):
            if len(chunk):
                size = (end - start)[chunk]
                at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
                forest.link(np.repeat(start[chunk], size) + at, np.repeat(start[chunk], size))
    forest.link(a, b)


def _leaves(fps: np.ndarray | None, a, a_end, b, b_end, budget: int):
    """All pairs (x, y) of the few fingerprints of both nodes of each pair; without fps, whatever their distance."""
    if not len(a):
        return
    for i in range(LEAF):
        for j in range(LEAF):
            ok = (a + i < a_end) & (b + j < b_end) & (a + i < b + j)
            x, y = (a + i)[ok], (b + j)[ok]
            near = slice(None) if fps is None else np.bitwise_count(fps[x] ^ fps[y]) <= budget
            x, y = x[near], y[near]
            if len(x):
                yield x, y


def _dealt(prints: DataFrame, budget: int, top: int, block: int) -> tuple[DataFrame, int]:
    """prints with (at, mask, s, t), the groups of its join, and the depth of the nodes that they pair.

    A node pair of the top of the trie is named by the smaller node and the bits in which the two differ. The depth
    follows the number of fingerprints. A node that holds more than a block all the same, such as of near copies, is
    dealt out into salts, and a group has one salt s of its one node and one salt t of the other.
    """
    n = prints.groupBy("part").count().agg(F.max("count")).first()[0] or 0
    depth = max(top, int(np.ceil(np.log2(max(1, n / block)))))
    masks = [0, *(
        sum(1 << i for i in c) for k in range(1, min(budget, depth) + 1) for c in combinations(range(depth), k)
    )]
    node = F.shiftrightunsigned("fp", BITS - depth)
    sent = prints.withColumn("mask", F.explode(F.array(*map(F.lit, masks)))).withColumn(
        "at", F.least(node, node.bitwiseXOR(F.col("mask")))
    )
    full = prints.groupBy("part", node.alias("at")).count().where(F.col("count") > block).collect()  # n / block a part
    if not full:
        return sent.withColumns({"s": F.lit(0), "t": F.lit(0)}), depth
    salts = F.create_map(*(F.lit(x) for r in full for x in (f"{r['part']} {r['at']}", math.ceil(r["count"] / block))))
    of = lambda at: F.coalesce(salts[F.concat_ws(" ", "part", at)], F.lit(1))
    sent = sent.withColumn("salts", F.greatest(of(F.col("at")), of(F.col("at").bitwiseXOR(F.col("mask")))))
    own = F.pmod(F.xxhash64("fp", "node"), F.col("salts")).cast("int")
    sent = sent.withColumn("own", own).withColumn("other", F.explode(F.expr("sequence(0, salts - 1)")))
    left = F.when(F.col("mask") == 0, F.col("own") <= F.col("other")).otherwise(node == F.col("at"))
    return sent.withColumns({
        "s": F.when(left, F.col("own")).otherwise(F.col("other")),
        "t": F.when(left, F.col("other")).otherwise(F.col("own")),
    }).drop("salts", "own", "other"), depth


def trie_join(prints: DataFrame, budget: int = 4, top: int = 4, block: int = BLOCK) -> DataFrame:
    """(a, b): links between nodes that connect whatever lies within the budget.

    prints has (part, fp, node), fp distinct within a part, with a trie for every part. ``top`` is the least depth at
    which Spark deals out the nodes of a trie.
    """
    sent, depth = _dealt(prints.select("part", "fp", "node"), budget, top, block)

    def join(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        _, at, mask, *_ = key
        order = np.argsort(group["fp"].to_numpy().view(np.uint64), kind="stable")
        fps, nodes = group["fp"].to_numpy().view(np.uint64)[order], group["node"].to_numpy()[order]
        if mask == 0:
            a, b = walk(fps, None, depth, 0, budget)
        else:
            here = (fps >> np.uint64(BITS - depth)) == np.uint64(at)
            if here.all() or not here.any():
                return pd.DataFrame({"a": [], "b": []}, dtype="int64")
            a, b = walk(fps[here], fps[~here], depth, int(mask).bit_count(), budget)
        return pd.DataFrame({"a": nodes[np.searchsorted(fps, a)], "b": nodes[np.searchsorted(fps, b)]})

    return sent.groupBy("part", "at", "mask", "s", "t").applyInPandas(join, "a long, b long")


def likely_join(
    prints: DataFrame, budget: int, lanes: int, most: float, trees: bool = False, top: int = 1,
    block: int = LIKELY_BLOCK, nearest: bool = False,
) -> DataFrame:
    """(a, b): pairs of nodes within the budget by fp and within most bits by the lanes that they carry.

    prints has (part, fp, node, s0, s1, ...), and tree if trees. The pairs connect all such pairs; with trees, they are
    all of them whose trees differ, or if nearest the nearest one of each two trees in a group.
    """
    sent, depth = _dealt(prints, budget, top, block)
    sent = sent.withColumns({"part": F.col("part").cast("int"), "at": F.col("at").cast("int")})

    def join(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        _, at, mask, *_ = key
        # the smaller block comes first, as the depth's bits are the highest
        group = group.iloc[np.argsort(group["fp"].to_numpy().view(np.uint64), kind="stable")]
        fps, nodes = group["fp"].to_numpy().view(np.uint64), group["node"].to_numpy()
        first = None if mask == 0 else int(((fps >> np.uint64(BITS - depth)) == np.uint64(at)).sum())
        if len(fps) < 2 or first in (0, len(fps)):
            return pd.DataFrame({"a": [], "b": []}, dtype="int64")
        sketches = np.column_stack([group[f"s{i}"].to_numpy().view(np.uint64) for i in range(lanes)])
        a, b = walk_likely(
            fps, first, depth, int(mask).bit_count(), budget, np.asfortranarray(sketches), most,
            group["tree"].to_numpy() if trees else None,
        )
        if nearest and len(a):
            x, y = group["tree"].to_numpy()[a], group["tree"].to_numpy()[b]
            low, high = np.minimum(x, y), np.maximum(x, y)
            order = np.lexsort((np.bitwise_count(sketches[a] ^ sketches[b]).sum(axis=1, dtype=np.int64), high, low))
            low, high = low[order], high[order]
            new = np.append(True, (low[1:] != low[:-1]) | (high[1:] != high[:-1]))
            a, b = a[order[new]], b[order[new]]
        return pd.DataFrame({"a": nodes[a], "b": nodes[b]})

    found = sent.groupBy("part", "at", "mask", "s", "t").applyInPandas(join, "a long, b long")
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def near_duplicates(documents: DataFrame, size: int = 4, budget: int = 4) -> DataFrame:
    """(doc_id, fp, component_id) of every row of (doc_id, text); repeated rows stay repeated.

    component_id is the smallest doc_id that links reach, the row's own included.
    """
    rows = stored(
        fingerprints(pick(documents, "doc_id", "text"), size).select("doc_id", F.col("sketch")[0].alias("fp"))
    )
    prints = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("first")))
    links = trie_join(prints.select(F.lit(0).alias("part"), "fp", F.col("fp").alias("node")), budget)
    named = _named(prints.withColumn("node", F.col("fp")), links)
    return rows.join(named, "fp", "left").select("doc_id", "fp", "component_id")


def _named(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """nodes (node, first, ...) with component_id, the smallest first that links (a, b) reach."""
    roots = components(links)
    placed = checkpointed(
        nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    )
    least = placed.groupBy("root").agg(F.min("first").alias("component_id"))
    return placed.join(least, "root").drop("root", "first")


def similar_documents(
    documents: DataFrame, size: int = 5, similarity: float = 0.8, lanes: int = 8, bits: int = 32, budget: int = 3,
    slack: float = 2.5, carried: int = 2, carried_slack: float = 4.0, block: int = LIKELY_BLOCK,
) -> DataFrame:
    """(doc_id, digest, component_id, stays) of every row: documents linked by a resemblance of shingle sets.

    digest is xxhash64 of the text, component_id the smallest doc_id of the group, and stays marks the one document
    of each group that has it; of several texts under that id the one with the smallest digest. NULL ids come last.
    Repeated rows have equal results.

    One fingerprint of 64 bits can't tell a resemblance of 0.8 from chance within a budget that a trie can prune by. So
    ``lanes`` SimHashes are cut into pieces of ``bits``; each piece has a trie of its own, whose self-join within the
    small budget finds pairs. Such a pair is proposed if two sketches differ in no more bits than the resemblance lets
    expect, with so many standard deviations: for the angle t between two shingle sets of resemblance r,
    cos t = 2r / (1 + r), and the share of bits is t / pi. Fingerprints go to several groups of a trie, so they take
    only ``carried`` lanes with them, which are compared with ``carried_slack``; one pair of strangers in seven
    million passes. The pairs left are joined with their whole sketches, compared with ``slack``, and the shingle sets
    themselves decide at last. A pair at 0.8 is found by some piece with a probability
    over 0.99. Sketches are of distinct shingles, as the resemblance is of sets.

    Documents with equal shingle sets meet in one node first. Each trie proposes a forest of likely pairs, not all of
    them. A pair that the sets refuse may have hidden others of its tree, so the nodes of the components at both its
    ends go through the tries again, twice: first the nearest pair of each two components is decided, which unites most
    that belong together, and then every likely pair between components that are still different.
    """
    share = math.acos(2 * similarity / (1 + similarity)) / math.pi

    def most(of: int, deviations: float) -> float:
        """Bits in which sketches of so many lanes may differ."""
        return (share + deviations * math.sqrt(share * (1 - share) / (of * BITS))) * of * BITS

    near = most(carried, carried_slack)
    texts = pick(documents, "doc_id", "text").withColumn("digest", F.xxhash64("text"))
    rows = stored(set_sketches(texts, size, lanes).select("doc_id", "digest", "sketch", "node"))
    nodes = stored(
        rows.groupBy("node")
        .agg(
            F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "digest")).alias("first"),
            F.min("digest").alias("digest"), F.min("sketch").alias("sketch"),
        )
    )
    per = BITS // bits
    pieces = F.transform(F.sequence(F.lit(0), F.lit(lanes * per - 1)), lambda i: F.struct(
        i.alias("part"),
        # a piece becomes the first bits of a fingerprint that ends in zeros
        F.call_function(
            "shiftleft",
            F.call_function("shiftrightunsigned", F.col("sketch")[F.floor(i / per).cast("int")], (i % per) * bits),
            F.lit(BITS - bits),
        ).alias("fp"),
    ))

    def prints(of: DataFrame, taken: int, *more: str) -> DataFrame:
        some = [F.col("sketch")[i].alias(f"s{i}") for i in range(taken)]
        names = ["node", *more, *[f"s{i}" for i in range(taken)]]
        return of.select("node", *more, *some, F.explode(pieces).alias("p")).select("p.part", "p.fp", *names)

    @F.pandas_udf("double")
    def resemblance(x: pd.Series, y: pd.Series) -> pd.Series:
        sets = lambda t: set(shingle_hashes(t, size).tolist())
        return pd.Series([len(a & b) / max(1, len(a | b)) for a, b in zip(map(sets, x), map(sets, y), strict=True)])

    def decided(likely: DataFrame) -> DataFrame:
        """likely (a, b) with alike, whether their whole sketches and then their shingle sets are."""
        own = nodes.select("node", "digest", "sketch")
        differing = F.aggregate(
            F.zip_with("x", "y", lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda n, bits: n + bits
        )
        sketched = stored(
            likely.join(own.toDF("a", "text_a", "x"), "a").join(own.toDF("b", "text_b", "y"), "b")
            .select("a", "b", "text_a", "text_b", (differing <= most(lanes, slack)).alias("close"))
        )
        pairs = sketched.where("close")
        wanted = pairs.select(F.explode(F.array("text_a", "text_b")).alias("digest")).distinct()
        found = texts.join(wanted, "digest", "left_semi").groupBy("digest").agg(F.min("text").alias("text"))
        return stored(
            pairs.join(found.toDF("text_a", "x"), "text_a").join(found.toDF("text_b", "y"), "text_b")
            .select("a", "b", (resemblance("x", "y") >= similarity).alias("alike"))
            .unionByName(sketched.where("not close").select("a", "b", F.lit(False).alias("alike")))
        )

    proposed = decided(likely_join(prints(nodes, carried), budget, carried, near, block=block))
    links = proposed.where("alike").select("a", "b")
    refused = proposed.where("not alike").select("a", "b")
    for nearest in (True, False):
        if refused.isEmpty():
            break
        roots = stored(components(links))
        tree = lambda end: roots.toDF(end, f"tree_{end}")  # noqa: B023, E731
        torn = refused.join(tree("a"), "a", "left").join(tree("b"), "b", "left").select(
            F.coalesce("tree_a", "a").alias("x"), F.coalesce("tree_b", "b").alias("y")
        ).where("x != y").select(F.explode(F.array("x", "y")).alias("tree")).distinct()
        again = nodes.join(roots.withColumnRenamed("root", "tree"), "node", "left").withColumn(
            "tree", F.coalesce("tree", "node")
        ).join(torn, "tree", "left_semi")
        # these few nodes take their whole sketches, as pairs are not only those of a forest
        late = likely_join(
            prints(stored(again), lanes, "tree"), budget, lanes, most(lanes, slack), trees=True, block=block,
            nearest=nearest,
        )
        late = decided(late.join(refused, ["a", "b"], "left_anti"))
        links = stored(links.unionByName(late.where("alike").select("a", "b")))
        refused = stored(refused.unionByName(late.where("not alike").select("a", "b")))
    named = _named(nodes.select("node", "first"), links)
    head = F.col("component_id")
    return rows.join(named.select("node", "component_id"), "node", "left").select(
        "doc_id", "digest", head["doc_id"].alias("component_id"),
        (F.col("doc_id").eqNullSafe(head["doc_id"]) & (F.col("digest") == head["digest"])).alias("stays"),
    )


def hexadecimal(fp: Column) -> Column:
    """A signed number as 16 lower-case hexadecimal digits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
