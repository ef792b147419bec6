"""Exact-substring dedup: shard Burrows-Wheeler transforms merged by interleave refinement.

A byte goes if a string of ``length`` bytes around it starts at another place too. Texts are first cut into windows at
content-defined places, so that equal strings always fall into windows of one key wherever they stand:

* The anchor of a string is the gram of ``GRAM`` bytes in it with the least hash, the first among equals. Equal strings have
  equal anchors at equal offsets, and the strings of one anchor start at consecutive places, so a run of starts with the
  bytes under them is a window. Every start lies in exactly one window.
* Windows are counted by content, with partial aggregation. All starts of a window that occurs twice are repeated; one
  copy of it goes on. A window whose anchor occurs nowhere else can hold no repeated string and is done.
* The windows left are distinct texts under shared anchors. They are dealt out by anchor into groups of bounded size.
  In a group, shards of windows get a Burrows-Wheeler transform each, and the transforms are merged: starting from
  blocks of equal first bytes, the interleave is refined one byte deeper a round, and only blocks whose followers were
  split are looked at again. The depth at which two neighbours part is their common prefix, and blocks that are still
  whole at ``length`` are the repeated intervals. No merged suffixes are sorted again.

The windows of an anchor with more than ``KEY_ROWS`` distinct ones, such as the edges of a passage that a third of all
documents share, don't fit a group. They are cut into single starts, and these are counted by content like windows,
which needs no group at all. Nothing is dropped: both ways give the same answer.

Defined results: NULL texts are empty. Rows are told apart by doc_id and the hash of the text; a repeated row is another
place of the same strings. Texts shorter than ``length`` lose nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import pick, small_batches, stored

LENGTH = 400
GRAM = 200
#: Bytes of texts that are cut into windows at a time.
PIECE = 1 << 15
#: Windows in a shard and, on average, in a group; the most that one anchor may bring into a group.
SHARD_ROWS = 500
GROUP_ROWS = 2_000
KEY_ROWS = 4_000
#: Up to so many rows a side is broadcast; beyond, it is joined by a shuffle.
BROADCAST_ROWS = 1_000_000
KEY = ("doc_id", "digest")
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15 | 1)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first powers of the multiplier and of its inverse."""
    out = []
    for factor in (MULTIPLIER, np.uint64(pow(int(MULTIPLIER), -1, 1 << 64))):
        x = np.full(n, factor, np.uint64)
        x[0] = 1
        out.append(np.multiply.accumulate(x))
    return out[0], out[1]


_usual_powers = lru_cache(maxsize=1)(_powers)


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers of all ranges, each from its start on."""
    sizes = sizes.astype(np.int64)
    return np.arange(sizes.sum()) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)


def gram_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """A hash of every gram of ``size`` bytes, equal for equal grams."""
    n = len(data) - size + 1
    # hash(i) = sum data[i + k] * m^(size - 1 - k): sums over m^-j, taken apart and raised by m^(i + size - 1)
    powers, inverse = _usual_powers(2 * PIECE) if len(data) <= 2 * PIECE else _powers(len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * inverse[:len(data)], out=sums[1:])
    h = (sums[size:] - sums[:n]) * powers[size - 1:size - 1 + n]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h


def first_minima(values: np.ndarray, width: int) -> np.ndarray:
    """For each run of ``width`` values the place of its least value by the upper 32 bits, the first among equals.

    The lower bits carry the places, which therefore decide among equals.
    """
    n = len(values) - width + 1
    low = np.uint64((1 << 32) - 1)
    v = np.full(len(values) + -len(values) % width, np.iinfo(np.uint64).max, np.uint64)
    v[:len(values)] = (values & ~low) | np.arange(len(values), dtype=np.uint64)
    rows = v.reshape(-1, width)
    head = np.minimum.accumulate(rows, axis=1).ravel()
    tail = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return (np.minimum(tail[:n], head[width - 1:width - 1 + n]) & low).astype(np.int64)


def windows(texts: list[bytes], length: int, gram: int) -> tuple[np.ndarray, ...]:
    """The windows of texts: text number, anchor hash, anchor's distance from the first start, first start, starts.

    The texts are hashed in one piece; a string that would reach beyond its text is no start.
    """
    size = np.array([len(t) for t in texts])
    data = np.frombuffer(b"".join(texts), np.uint8)
    if not len(texts) or size.max() < length:
        return np.empty(0, np.int64), np.empty(0, np.uint64), *[np.empty(0, np.int64)] * 3
    base = np.cumsum(size) - size
    starts = np.maximum(size - length + 1, 0)
    own = np.repeat(np.arange(len(texts)), starts)
    at = _ranges(base, starts)
    hashes = gram_hashes(data, gram)
    anchors = first_minima(hashes, length - gram + 1)[at]
    new = np.flatnonzero(np.concatenate([[True], (anchors[1:] != anchors[:-1]) | (own[1:] != own[:-1])]))
    count = np.diff(np.append(new, len(anchors)))
    own, first, anchor = own[new], at[new], anchors[new]
    return own, hashes[anchor], anchor - first, first - base[own], count


def pieces(texts: list[bytes], size: int = PIECE) -> Iterator[tuple[int, list[bytes]]]:
    """The texts in pieces of about so many bytes, with the number of the first; a longer text is a piece alone."""
    first, held = 0, 0
    for i, text in enumerate(texts):
        if i > first and held + len(text) > size:
            yield first, texts[first:i]
            first, held = i, 0
        held += len(text)
    if texts:
        yield first, texts[first:]


def cut(documents: DataFrame, length: int, gram: int) -> DataFrame:
    """(doc_id, digest, anchor, content, start, n): the windows of every row."""
    def windows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [(t.as_py() or "").encode("utf-8") for t in part.column(2)]
                for first, some in pieces(texts):
                    own, anchor, offset, start, count = windows(some, length, gram)
                    content = [
                        xxhash.xxh3_64_intdigest(some[i][a:b], seed=s)
                        for i, a, b, s in zip(
                            own.tolist(), start.tolist(), (start + count + length - 1).tolist(), offset.tolist(),
                            strict=True,
                        )
                    ]
                    index = pa.array(own + first)
                    yield pa.RecordBatch.from_arrays([
                        part.column(0).take(index), part.column(1).take(index), pa.array(anchor.view(np.int64)),
                        pa.array(np.array(content, np.uint64).view(np.int64)), pa.array(start.astype(np.int32)),
                        pa.array(count.astype(np.int32)),
                    ], names=["doc_id", "digest", "anchor", "content", "start", "n"])

    return documents.select("doc_id", "digest", "text").mapInArrow(
        windows_of, "doc_id long, digest long, anchor long, content long, start int, n int"
    )


# Transforms. Suffixes are numbered within their shard; letters are bytes + 1, and 0 ends a window.


def transform(texts: list[bytes]) -> np.ndarray:
    """Burrows-Wheeler transform of a shard of windows.

    The letter before each suffix in order, the ends of windows first. Suffixes are sorted by prefix doubling; ends of
    different windows differ and keep the windows' order.
    """
    letters = np.frombuffer(b"\0".join(texts) + b"\0", np.uint8).astype(np.int64)
    ends = np.cumsum([len(t) + 1 for t in texts]) - 1
    letters += 1
    letters[ends] = 0
    n = len(letters)
    # seven letters at once; what follows a window's end is left out, and ends are told apart below
    rank = np.zeros(n, np.int64)
    ended = np.zeros(n, bool)
    step = 7
    for k in range(step):
        ahead = np.zeros(n, np.int64)
        ahead[:max(n - k, 0)] = letters[k:]
        ended |= ahead == 0
        rank = rank * 256 + np.where(ended, 0, ahead)
    tail = np.zeros(n, np.int64)  # suffixes that end within these letters are ordered by their windows
    near = np.flatnonzero(ended)
    tail[near] = np.searchsorted(ends, near) + 1
    order = np.lexsort((tail, rank))
    while True:
        differ = (rank[order[1:]] != rank[order[:-1]]) | (tail[order[1:]] != tail[order[:-1]])
        fresh = np.concatenate([[0], np.cumsum(differ)])
        rank = np.empty(n, np.int64)
        rank[order] = fresh
        if fresh[-1] == n - 1:
            break
        tail = np.zeros(n, np.int64)
        tail[:max(n - step, 0)] = rank[step:] + 1
        order = np.argsort(rank * (n + 1) + tail)
        step *= 2
    last = letters[order - 1]
    return last.astype(np.uint8)


def followers(last: np.ndarray) -> np.ndarray:
    """By the transform alone, the number of the suffix that is one letter longer; -1 at the start of a window."""
    order = np.argsort(last, kind="stable")
    before = np.empty(len(last), np.int64)
    before[order] = np.arange(len(last))
    before[last == 0] = -1
    return before


class Merge:
    """Interleaves the suffixes of several shards by refinement, down to a depth.

    order has the suffixes in merged order, and block[s] is the number of the block of suffix s, the suffixes that share
    the letters compared so far: the place at which it begins, until rounds of one letter start. common[p] is the common prefix of the neighbours at p - 1 and p
    once they have parted.
    """

    def __init__(self, shards: list[np.ndarray]):
        sizes = np.array([len(x) for x in shards])
        base = np.cumsum(sizes) - sizes
        self.n = int(sizes.sum())
        before = np.concatenate([np.where((b := followers(x)) >= 0, b + o, -1) for x, o in zip(shards, base, strict=True)])
        before = before.astype(np.int32)
        self.before = before
        after = np.full(self.n, -1, np.int32)
        has = before >= 0
        after[before[has]] = np.flatnonzero(has)
        self.after = after  # of a window's end: nothing
        first = np.concatenate([np.sort(x) for x in shards])  # the letter with which each suffix begins
        self.block = np.zeros(self.n, np.int32)
        self.sizes = np.zeros(self.n, np.int32)
        self.common = np.full(self.n, -1, np.int16)
        self._open(first, sum(int((x == 0).sum()) for x in shards))

    def _open(self, first: np.ndarray, windows_: int) -> None:
        """Packs the first letters of each suffix into a number; an end inside carries its window's number."""
        room = max(1, int(windows_).bit_length())
        self.packed = packed = (63 - room) // 8
        key, at = np.zeros(self.n, np.int64), np.arange(self.n)
        end = np.zeros(self.n, np.int64)
        for _ in range(packed):
            letter = np.where(at >= 0, first[np.maximum(at, 0)], 0).astype(np.int64)
            stops = (at >= 0) & (letter == 0)
            end[stops] = np.cumsum(first == 0)[at[stops]]
            key = key << 8 | letter
            at = np.where((at >= 0) & (letter > 0), self.after[np.maximum(at, 0)], -1)
        self.room, self.ahead = room, at.astype(np.int32)
        self.key = key << room | end
        self.order = np.argsort(self.key).astype(np.int32)
        ordered = self.key[self.order]
        fresh = np.concatenate([[0], np.cumsum(ordered[1:] != ordered[:-1])]).astype(np.int32)
        self.rank = np.empty(self.n, np.int32)
        self.rank[self.order] = fresh

    def _letters(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many of the packed letters of suffixes a[i] and b[i] agree before one differs or ends."""
        x, y = self.key[a] >> self.room, self.key[b] >> self.room
        out, same = np.zeros(len(a), np.int16), np.ones(len(a), bool)
        for k in range(self.packed - 1, -1, -1):
            p, q = x >> (8 * k) & 255, y >> (8 * k) & 255
            same &= (p == q) & (p > 0)
            out += same
        return out

    def _split(self, at: np.ndarray, own: np.ndarray, by: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Orders the places ``at`` of whole blocks ``own`` by ``by`` and opens a block for every value.

        Returns the suffixes that left the largest part of their block, and the places of new blocks. Whatever is told
        apart by what stayed in the largest part is told apart by what left it, so only that is followed up.
        """
        sort = np.argsort(own.astype(np.int64) * self.n + by)
        members, by = self.order[at][sort], by[sort]
        cutting = np.concatenate([[True], (own[1:] != own[:-1]) | (by[1:] != by[:-1])])
        heads = at[cutting]
        size = np.diff(np.append(np.flatnonzero(cutting), len(at)))
        self.order[at] = members
        self.block[members] = np.repeat(heads, size)
        self.sizes[heads] = size
        part_own = own[cutting]
        first = np.flatnonzero(np.concatenate([[True], part_own[1:] != part_own[:-1]]))
        parts = np.diff(np.append(first, len(size)))
        largest = np.repeat(np.maximum.reduceat(size, first), parts) == size
        seen = np.cumsum(largest)
        largest &= seen == np.repeat(seen[first] - largest[first] + 1, parts)  # one among equals
        return members[np.repeat(~largest, size)], heads[self.common[heads] < 0]

    def _places(self, blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All places of the blocks, and the block of each."""
        return _ranges(blocks, self.sizes[blocks]), np.repeat(blocks, self.sizes[blocks])

    def refine(self, depth: int) -> None:
        """Splits blocks until they share ``depth`` letters: the first rounds a few letters deeper, later ones by one.

        A round of one letter looks only at suffixes whose followers were split off in the round before.
        """
        step = self.packed
        if depth < step:  # as deep as one packed number: cut it short
            keep = np.int64(-1) << np.int64(self.room + 8 * (step - depth))
            ended = self._letters(np.arange(self.n), np.arange(self.n)) < depth
            key = np.where(ended, self.key, self.key & keep)
            self.order = np.argsort(key).astype(np.int32)
            ordered = key[self.order]
            self.rank[self.order] = np.concatenate([[0], np.cumsum(ordered[1:] != ordered[:-1])])
        at, own = np.arange(self.n), np.zeros(self.n, np.int32)
        _, new = self._split(at, own, self.rank[self.order])
        self.common[new[1:]] = self._letters(self.order[new[1:] - 1], self.order[new[1:]])
        self.common[0] = 0
        shared, ahead = step, self.ahead
        while shared + step <= min(depth, 3 * step):
            at, own = self._places(np.flatnonzero(self.sizes > 1))
            if not len(at):
                return
            _, new = self._split(at, own, self.rank[ahead[self.order[at]]])
            self.common[new] = shared + self._letters(ahead[self.order[new - 1]], ahead[self.order[new]])
            ahead = np.where(ahead >= 0, self.ahead[np.maximum(ahead, 0)], -1)
            shared += step
        self._number_blocks()
        touched = np.arange(self.n)
        for deep in range(shared, depth):
            ask = self.before[touched]
            touched, new = self._part(ask[ask >= 0])
            if not len(touched):
                return
            self.common[new[self.common[new] < 0]] = deep

    def _number_blocks(self) -> None:
        """From here on a block has a number that its largest part keeps, and start[b] is the place at which b begins."""
        heads = np.flatnonzero(self.sizes > 0)
        number = np.zeros(self.n, np.int32)
        number[heads] = np.arange(len(heads))
        self.block = number[self.block]
        self.start, sizes = np.zeros(self.n, np.int32), np.zeros(self.n, np.int32)
        self.start[:len(heads)], sizes[:len(heads)] = heads, self.sizes[heads]
        self.sizes, self.blocks = sizes, len(heads)
        self.place = np.empty(self.n, np.int32)
        self.place[self.order] = np.arange(self.n)
        self.origin = self.block.copy()  # the block that a suffix left last
        self.moving, self.taken = np.zeros(self.n, bool), np.zeros(self.n, bool)

    def _leaving(self, ask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The suffixes that leave the largest parts of their blocks, with their blocks and the places of their followers
        and of the followers of the largest part, in the order of blocks and followers.

        ask are the suffixes whose followers left a largest part. Where they are the lesser half of a block, the rest of
        it follows that part and is the largest itself; it isn't looked at. Other blocks are looked at as a whole.
        """
        own = self.block[ask]
        asked, back, count = np.unique(own, return_inverse=True, return_counts=True)
        size = self.sizes[asked]
        whole, few = 2 * count > size, (2 * count <= size)[back]
        wanted = asked[whole & (size > 1)]
        members = self.order[_ranges(self.start[wanted], self.sizes[wanted])]
        lesser = ask[few]
        both = np.concatenate([members, lesser])
        after = self.after[both]
        own, by = self.block[both], self.start[self.block[after]]
        rest = self.start[self.origin[after]]
        sort = np.argsort(own.astype(np.int64) * self.n + by)
        both, own, by, rest = both[sort], own[sort], by[sort], rest[sort]
        if len(members):  # blocks as a whole: the largest of the parts, one among equals
            cutting = np.flatnonzero(np.concatenate([[True], (own[1:] != own[:-1]) | (by[1:] != by[:-1])]))
            parts = np.diff(np.append(cutting, len(own)))
            first = np.flatnonzero(np.concatenate([[True], own[cutting[1:]] != own[cutting[:-1]]]))
            most = np.repeat(np.maximum.reduceat(parts, first), np.diff(np.append(first, len(parts))))
            largest = np.flatnonzero(parts == most)
            block = np.searchsorted(asked, own)
            follows = np.zeros(len(asked), np.int32)
            follows[block[cutting[largest[::-1]]]] = by[cutting[largest[::-1]]]
            rest = np.where(whole[block], follows[block], rest)
        go = by != rest
        return both[go], own[go], by[go], rest[go]

    def _part(self, ask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Splits the blocks of ask by their followers; the suffixes that left largest parts, and where blocks begin now.

        What leaves is moved to the front or the back of its block, and what stood there takes the places left, so
        that a round costs what moves and not the blocks it moves in.
        """
        gone, own, by, rest = self._leaving(ask)
        if not len(gone):
            return gone, gone
        first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        shrunk = own[first]
        count = np.diff(np.append(first, len(own)))
        front = np.add.reduceat((by < rest).astype(np.int32), first)
        rank = np.arange(len(own)) - np.repeat(first, count)
        ends = np.repeat(self.sizes[shrunk] - count, count)
        to = np.repeat(self.start[shrunk], count) + rank + np.where(by < rest, 0, ends)
        held = self.place[gone]
        self.moving[gone], self.taken[to] = True, True
        there = self.order[to]
        there, holes = there[~self.moving[there]], held[~self.taken[held]]
        self.moving[gone], self.taken[to] = False, False
        self.order[holes], self.place[there] = there, holes
        self.order[to], self.place[gone] = gone, to
        cutting = np.flatnonzero(np.concatenate([[True], (own[1:] != own[:-1]) | (by[1:] != by[:-1])]))
        size = np.diff(np.append(cutting, len(own)))
        numbers = np.arange(self.blocks, self.blocks + len(cutting))
        self.blocks += len(cutting)
        self.start[numbers], self.sizes[numbers] = to[cutting], size
        self.start[shrunk] += front
        self.sizes[shrunk] -= count
        self.origin[gone] = own
        self.block[gone] = np.repeat(numbers, size)
        return gone, np.concatenate([to[cutting], self.start[shrunk]])


def repeated_starts(shards: list[tuple[np.ndarray, np.ndarray]], length: int) -> dict[int, np.ndarray]:
    """For each window of shards (transform, window numbers) which of its starts begin a string found elsewhere."""
    merge = Merge([last for last, _ in shards])
    merge.refine(length)
    repeated = merge.sizes[merge.block] > 1
    out, offset = {}, 0
    for last, numbers in shards:
        count = len(numbers)
        # the end of window w is suffix w; walking back from all ends at once reads the windows from right to left
        walk = np.arange(count) + offset
        steps, size = [], np.zeros(count, np.int64)
        while (walk >= 0).any():
            size += walk >= 0
            steps.append(np.where(walk >= 0, repeated[np.maximum(walk, 0)], False))
            walk = np.where(walk >= 0, merge.before[np.maximum(walk, 0)], -1)
        flags = np.array(steps)[::-1] if steps else np.zeros((0, count), bool)
        for w, number in enumerate(numbers.tolist()):
            out[number] = flags[len(flags) - size[w]:-1, w]  # without the end itself
        offset += len(last)
    return out


def runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true flags."""
    edge = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def _bound(df: DataFrame, rows: int) -> DataFrame:
    """For a stored frame of so many rows: broadcast below the bound, else left to Spark."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def _same(a: str, b: str) -> Column:
    return F.col(f"{a}.doc_id").eqNullSafe(F.col(f"{b}.doc_id")) & (F.col(f"{a}.digest") == F.col(f"{b}.digest"))


def _window_texts(rows: DataFrame, distinct: DataFrame, length: int) -> DataFrame:
    """(anchor, content, hot, body): the bytes of one copy of each window."""
    per = distinct.groupBy("rep.doc_id", "rep.digest").agg(
        F.collect_list(F.struct("anchor", "content", "hot", "rep.start", "rep.n")).alias("w")
    )
    one = rows.alias("r").join(_bound(per, distinct.count()).alias("p"), _same("r", "p")).select("r.text", "p.w")

    @F.pandas_udf("array<binary>")
    def bodies(texts: pd.Series, lists: pd.Series) -> pd.Series:
        def own(text: str, ws: list) -> list[bytes]:
            data = text.encode("utf-8")
            return [data[w["start"]:w["start"] + w["n"] + length - 1] for w in ws]

        return pd.Series([own(t, ws) for t, ws in zip(texts, lists, strict=True)], dtype=object)

    # repeated rows give the same window more than once
    return one.select(F.explode(F.arrays_zip("w", bodies("text", "w").alias("body"))).alias("x")).select(
        "x.w.anchor", "x.w.content", "x.w.hot", "x.body"
    ).dropDuplicates(["anchor", "content"])


def _merged(texts: DataFrame, n: int, length: int) -> DataFrame:
    """(anchor, content, runs) of windows: the starts of strings that other windows, or other places in them, hold."""
    groups = max(1, -(-n // GROUP_ROWS))
    shards = -(-(GROUP_ROWS + KEY_ROWS) // SHARD_ROWS)
    dealt = texts.select(
        F.pmod(F.xxhash64("anchor"), F.lit(groups)).alias("grp"), F.pmod("content", F.lit(shards)).alias("shard"),
        "anchor", "content", "body",
    )

    def shard(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({
            "grp": [key[0]], "last": [transform(rows["body"].tolist()).tobytes()],
            "anchors": [rows["anchor"].to_numpy()], "contents": [rows["content"].to_numpy()],
        })

    transforms = dealt.groupBy("grp", "shard").applyInPandas(
        shard, "grp long, last binary, anchors array<long>, contents array<long>"
    )

    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        anchors, contents = np.concatenate(rows["anchors"].tolist()), np.concatenate(rows["contents"].tolist())
        parts, base = [], 0
        for last, own in zip(rows["last"], rows["anchors"], strict=True):
            parts.append((np.frombuffer(last, np.uint8), np.arange(base, base + len(own))))
            base += len(own)
        found = repeated_starts(parts, length)
        out = []
        for i in range(base):
            out.append([{"a": int(a), "b": int(b)} for a, b in zip(*runs(found[i]), strict=True)])
        return pd.DataFrame({"anchor": anchors, "content": contents, "runs": out})

    return transforms.groupBy("grp").applyInPandas(
        merge, "anchor long, content long, runs array<struct<a: int, b: int>>"
    )


def _counted_starts(texts: DataFrame, length: int) -> DataFrame:
    """(anchor, content, runs) like _merged, by counting every start's string by a 128-bit hash."""
    def starts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for anchor, content, body in zip(batch.anchor, batch.content, batch.body, strict=True):
                n = len(body) - length + 1
                pair = np.frombuffer(
                    b"".join(xxhash.xxh3_128_digest(body[i:i + length]) for i in range(n)), np.int64
                ).reshape(-1, 2)
                yield pd.DataFrame({
                    "anchor": anchor, "content": content, "at": np.arange(n, dtype=np.int32),
                    "hi": pair[:, 0], "lo": pair[:, 1],
                })

    single = stored(texts.mapInPandas(starts, "anchor long, content long, at int, hi long, lo long"))
    again = single.groupBy("hi", "lo").agg(F.count("*").alias("k")).where("k > 1")
    return single.join(again, ["hi", "lo"], "left_semi").groupBy("anchor", "content").agg(
        F.collect_list(F.struct(F.col("at").alias("a"), (F.col("at") + 1).alias("b"))).alias("runs")
    )


def repeated_ranges(rows: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(doc_id, digest, ranges): byte ranges [a, b), perhaps overlapping, covered by strings found elsewhere.

    rows has (doc_id, digest, text).
    """
    cuts = stored(cut(rows, length, gram))
    anchors = stored(cuts.groupBy("anchor").agg(
        F.count("*").alias("k"), (F.min("content") != F.max("content")).alias("mixed"),
    ).where("k > 1").drop("k"))
    again = stored(cuts.join(_bound(anchors, anchors.count()), "anchor"))
    sure = again.where("not mixed")
    mixed = again.where("mixed").drop("mixed")

    contents = mixed.groupBy("anchor", "content").agg(
        F.count("*").alias("k"), F.min(F.struct("doc_id", "digest", "start", "n")).alias("rep")
    )
    contents = stored(contents)
    sizes = contents.groupBy("anchor").agg((F.count("*") > KEY_ROWS).alias("hot"))
    distinct = stored(contents.join(sizes, "anchor"))
    texts = stored(_window_texts(rows, distinct, length))
    usual = texts.where("not hot")
    runs_ = _merged(usual, usual.count(), length).unionByName(_counted_starts(texts.where("hot"), length))
    found = stored(
        distinct.select("anchor", "content", "k").join(runs_, ["anchor", "content"], "left")
        .where((F.col("k") > 1) | (F.size("runs") > 0))
    )
    whole = F.array(F.struct(F.lit(0).alias("a"), F.col("n").alias("b")))
    placed = mixed.join(found, ["anchor", "content"]).select(
        "doc_id", "digest", "start", F.explode(F.when(F.col("k") > 1, whole).otherwise(F.col("runs"))).alias("r")
    )
    ranges = placed.select(
        "doc_id", "digest", (F.col("start") + F.col("r.a")).alias("a"),
        (F.col("start") + F.col("r.b") - 1 + length).alias("b"),
    ).unionByName(sure.select(
        "doc_id", "digest", F.col("start").alias("a"), (F.col("start") + F.col("n") - 1 + length).alias("b")
    ))
    return ranges.groupBy("doc_id", "digest").agg(F.collect_set(F.struct("a", "b")).alias("ranges"))


def dedup_substrings(documents: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(doc_id, kept, n_bytes, n_removed, n_spans, spans) of every row of (doc_id, text).

    kept has the bytes that stay, spans the maximal runs [a, b) that go.
    """
    rows = pick(documents, "doc_id", "text").select(
        F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("digest"), "text"
    )
    small_batches(documents.sparkSession)
    found = repeated_ranges(rows, length, gram)

    @F.pandas_udf("kept binary, n_bytes long, n_removed long, n_spans long, spans array<struct<a: int, b: int>>")
    def removed(texts: pd.Series, ranges: pd.Series) -> pd.DataFrame:
        out = []
        for text, own in zip(texts, ranges, strict=True):
            data = (text or "").encode("utf-8")
            spans: list[list[int]] = []
            for a, b in sorted((r["a"], r["b"]) for r in own) if own is not None else ():
                if spans and a <= spans[-1][1]:
                    spans[-1][1] = max(b, spans[-1][1])
                else:
                    spans.append([a, b])
            edges = [0, *(x for s in spans for x in s), len(data)]
            kept = b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
            out.append((
                kept, len(data), len(data) - len(kept), len(spans), [{"a": a, "b": b} for a, b in spans],
            ))
        return pd.DataFrame(out, columns=["kept", "n_bytes", "n_removed", "n_spans", "spans"], dtype=object)

    return rows.alias("r").join(found.alias("f"), _same("r", "f"), "left").select(
        "r.doc_id", removed("r.text", "f.ranges").alias("out")
    ).select("doc_id", "out.*")
