"""Periodic runs: stretches of words that repeat with a period, found without looking at every pair of words.

A run of period ``p`` and ``max(least, exponent * p)`` words or more holds a point of the grid of that many words less
``p``, together with the word ``p`` further on. The grids of all periods of a text have about n log n points. For each
point the two words are compared, then a few words on either side; what is still equal asks for the longest common
extension (LCE) of two places forwards and, on the reversed words, backwards.

LCE goes by a difference cover: only suffixes that begin at sampled places are sorted, about a fifth of all. Two
places are compared word by word until both are sampled, at most ``COVER`` words further; from there a sparse table
of minima over the common prefixes of neighbours in the sorted order answers. Both parts run as arrays over all
points of a batch of texts, whose texts are parted by words that occur once.

Texts are handled whole, each inside its row's task; batches hold about ``BATCH_BYTES`` of text, and the grid points of a
long text are gone through ``POINTS`` at a time, so that memory follows the longest text and not its points.

Defined results: a NULL or empty text has no words, no runs and an empty ``collapsed``. Repeated rows are handled each
for itself. Ties between runs of the same words go to the smallest period.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small_batches
from .token_arrays import byte_class, slices, string_column, tokens

BATCH_BYTES = 2_000_000
POINTS = 250_000
#: Every distance modulo the cover's size is the difference of two of its members, each in one way only.
COVER, MEMBERS = 31, (0, 1, 3, 8, 12, 18)
#: Words compared on either side of a grid point before a batch's samples are sorted at all.
NEAR = 8
RUNS = T.ArrayType(T.StructType([T.StructField(name, T.LongType()) for name in ("start", "length", "period")]))


def _shifts() -> np.ndarray:
    """For two places modulo COVER, how far on both are members."""
    table = np.full((COVER, COVER), COVER, np.int64)
    for shift in range(COVER - 1, -1, -1):
        at = [(m - shift) % COVER for m in MEMBERS]
        table[np.ix_(at, at)] = shift
    return table


SHIFT = _shifts()


class Lce:
    """How many words from two places on are equal, in ``word`` codes whose last is found nowhere else."""

    def __init__(self, word: np.ndarray):
        self.word = word
        n = len(word)
        blocks = -(-n // COVER)
        places = (np.arange(blocks)[:, None] * COVER + np.array(MEMBERS)).ravel()
        places = places[places < n]
        self.sample = np.full(blocks * COVER, -1, np.int64)
        self.sample[places] = np.arange(len(places))
        padded = np.concatenate([word, np.full(COVER, -1, word.dtype)])
        window = np.ascontiguousarray(padded[places[:, None] + np.arange(COVER)])
        window = window.view(np.dtype((np.void, window.itemsize * COVER))).ravel()
        rank = np.unique(window, return_inverse=True)[1].astype(np.int64)
        del window
        # ranks by 1, 2, 4... windows of COVER words, until no two are equal
        follow = self.sample[np.minimum(places + COVER, len(self.sample) - 1)]
        follow[places + COVER >= n] = -1
        levels = [rank]
        m = len(places)
        while m and levels[-1].max() < m - 1:
            rank = levels[-1]
            then = np.where(follow >= 0, rank[follow], -1)
            levels.append(np.unique(rank * (m + 1) + then + 1, return_inverse=True)[1].astype(np.int64))
            follow = np.where(follow >= 0, follow[follow], -1)
        self.rank = levels[-1]
        order = np.empty(m, np.int64)
        order[self.rank] = np.arange(m)
        common = self._neighbours(places, order, levels)
        self.minima = [common]
        step = 1
        while 2 * step < len(common) + 1:
            last = self.minima[-1]
            self.minima.append(np.minimum(last[:-step], last[step:]))
            step *= 2

    def _neighbours(self, places: np.ndarray, order: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
        """Words that each sampled suffix shares with the next in order."""
        a, b = order[:-1].copy(), order[1:].copy()
        length = np.zeros(len(a), np.int64)
        for k in range(len(levels) - 1, -1, -1):
            live = np.flatnonzero((a >= 0) & (b >= 0))
            live = live[levels[k][a[live]] == levels[k][b[live]]]
            if not len(live):
                continue
            length[live] += COVER << k
            for side in (a, b):
                on = places[side[live]] + (COVER << k)
                side[live] = np.where(on < len(self.word), self.sample[np.minimum(on, len(self.sample) - 1)], -1)
        x, y = places[order[:-1]] + length, places[order[1:]] + length
        return length + self._plain(x, y, np.full(len(x), COVER))

    def _plain(self, x: np.ndarray, y: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Equal words from x and y on, at most ``most``, one word after the other."""
        same = np.zeros(len(x), np.int64)
        live = np.flatnonzero(most > 0)
        last = len(self.word) - 1
        while len(live):
            t = same[live]
            i, j = x[live] + t, y[live] + t
            inside = (i <= last) & (j <= last)
            live = live[inside & (self.word[np.minimum(i, last)] == self.word[np.minimum(j, last)])]
            same[live] += 1
            live = live[same[live] < most[live]]
        return same

    def __call__(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """For places x < y."""
        shift = SHIFT[x % COVER, y % COVER]
        same = self._plain(x, y, shift)
        far = np.flatnonzero((same == shift) & (y + shift < len(self.word)))
        a, b = (self.rank[self.sample[side[far] + shift[far]]] for side in (x, y))
        low, high = np.minimum(a, b), np.maximum(a, b)
        level = np.frexp((high - low).astype(np.float64))[1] - 1
        for k in np.unique(level):
            at = level == k
            table = self.minima[k]
            same[far[at]] += np.minimum(table[low[at]], table[high[at] - (1 << k)])
        return same


def _points(lengths: np.ndarray, least: int, exponent: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(text, place in it, period) of all grids, about POINTS at a time."""
    periods = lengths // exponent
    text = np.repeat(np.arange(len(lengths)), periods)
    period = np.arange(len(text)) - np.repeat(np.cumsum(periods) - periods, periods) + 1
    fits = np.maximum(least, exponent * period) <= lengths[text]
    text, period = text[fits], period[fits]
    grid = np.maximum(least, exponent * period) - period
    count = (lengths[text] - period - 1) // grid + 1
    done = np.cumsum(count)
    at = 0
    while at < len(text):
        to = max(at + 1, int(np.searchsorted(done, (done[at - 1] if at else 0) + POINTS, "right")))
        c = count[at:to]
        row = np.repeat(np.arange(at, to), c)
        j = np.arange(len(row)) - np.repeat(np.cumsum(c) - c, c)
        yield text[row], j * grid[row], period[row]
        at = to


def _extent(word: np.ndarray, x: np.ndarray, y: np.ndarray, step: int) -> np.ndarray:
    """Equal words on from x and y in one direction, counted up to NEAR. Texts are parted by words of their own."""
    same = np.zeros(len(x), np.int64)
    live = np.arange(len(x))
    for t in range(1, NEAR + 1):
        i, j = x[live] + step * t, y[live] + step * t
        inside = (i >= 0) & (j < len(word))
        live = live[inside]
        live = live[word[i[inside]] == word[j[inside]]]
        same[live] += 1
    return same


def _parted(word: np.ndarray, bounds: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of these texts with one of its own after each; where each text begins; and the texts' lengths."""
    lengths = np.diff(bounds)[which]
    begin = np.cumsum(lengths + 1) - lengths - 1
    out = np.empty(int((lengths + 1).sum()), np.int32)
    inside = np.ones(len(out), bool)
    inside[begin + lengths] = False
    out[inside] = word[np.repeat(bounds[which] - begin, lengths) + np.flatnonzero(inside)]
    out[begin + lengths] = int(word.max(initial=0)) + 1 + np.arange(len(which))
    return out, begin, lengths


def find_runs(
    word: np.ndarray, bounds: np.ndarray, least: int = 24, exponent: int = 3
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, length, period) of all runs of texts given as word codes, by text, start and period."""
    lengths = np.diff(bounds)
    which = np.flatnonzero(lengths >= least)
    none = (np.zeros(0, np.int64),) * 4
    if not len(which):
        return none
    flat, begin, sizes = _parted(word, bounds, which)
    likely = []
    for text, place, period in _points(sizes, least, exponent):
        x = begin[text] + place
        hit = np.flatnonzero(flat[x] == flat[x + period])
        text, place, x, period = text[hit], place[hit], x[hit], period[hit]
        ahead, back = _extent(flat, x, x + period, 1), _extent(flat, x, x + period, -1)
        need = np.maximum(least, exponent * period) - period
        keep = (ahead == NEAR) | (back == NEAR) | (1 + ahead + back >= need)
        if keep.any():
            likely.append([part.astype(np.int32) for part in (text[keep], place[keep], period[keep])])
    if not likely:
        return none
    some = np.unique(np.concatenate([np.unique(part[0]) for part in likely]))
    flat, begin, sizes = _parted(word, bounds, which[some])
    forward, backward = Lce(flat), Lce(flat[::-1].copy())
    last = len(flat) - 1
    found = []
    while likely:
        text, place, p = (part.astype(np.int64) for part in likely.pop())
        number = np.searchsorted(some, text)
        x = begin[number] + place
        ahead = forward(x, x + p)
        back = np.zeros(len(x), np.int64)
        inner = np.flatnonzero(x > 0)
        back[inner] = backward(last - (x + p - 1)[inner], last - (x - 1)[inner])
        size = p + ahead + back
        keep = size >= np.maximum(least, exponent * p)
        rows = np.stack([number[keep], (x - back - begin[number])[keep], size[keep], p[keep]])
        found.append(np.unique(rows, axis=1))
    rows = np.concatenate(found, axis=1)
    rows = rows[:, np.lexsort((rows[3], rows[2], rows[1], rows[0]))]
    # a stretch that repeats with a multiple of its smallest period is found again: the smallest one comes first
    first = np.ones(rows.shape[1], bool)
    first[1:] = (rows[:3, 1:] != rows[:3, :-1]).any(0)
    rows = rows[:, first]
    rows = rows[:, np.lexsort((rows[3], rows[1], rows[0]))]
    return which[some[rows[0]]], rows[1], rows[2], rows[3]


def _kept(bounds: np.ndarray, runs: tuple[np.ndarray, ...]) -> np.ndarray:
    """False for words that a run contains after its first period."""
    text, start, length, period = runs
    change = np.zeros(int(bounds[-1]) + 1, np.int64)
    np.add.at(change, bounds[text] + start + period, 1)
    np.add.at(change, bounds[text] + start + length, -1)
    return np.cumsum(change[:-1]) == 0


def _rows_of(batch: pa.Array, inside: np.ndarray, least: int, exponent: int) -> list[pa.Array]:
    """The new columns for one slice of texts."""
    words, bounds = tokens(batch, inside)
    code = words.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int32)
    runs = find_runs(code, bounds, least, exponent)
    keep = _kept(bounds, runs)
    at = np.concatenate([[0], np.cumsum(keep)])[bounds].astype(np.int32)
    kept = pa.ListArray.from_arrays(pa.array(at), words if keep.all() else words.filter(pa.array(keep)))
    ends = np.searchsorted(runs[0], np.arange(len(batch) + 1)).astype(np.int32)
    items = pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in runs[1:]], ["start", "length", "period"])
    return [
        pa.array(np.diff(bounds), pa.int64()), pa.ListArray.from_arrays(pa.array(ends), items), pc.binary_join(kept, " "),
    ]


def periodic_runs(
    documents: DataFrame, separators: bytes = b" \t\n\x0b\x0c\r", least: int = 24, exponent: int = 3
) -> DataFrame:
    """All columns of documents, in ``row``, with n_words, runs and collapsed beside it.

    ``runs`` holds (start, length, period) in words, by start and period; a run has at least ``least`` words and
    ``exponent`` periods (2 or more), and no shorter period. ``collapsed`` is the words outside of the runs and the
    first period of each, with a space between. Words are what stands between ``separators``.
    """
    if exponent < 2:
        raise ValueError("A run has at least two periods.")
    small_batches(documents.sparkSession)
    inside = byte_class(separators)
    row = F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("row")
    given = documents.select(row, F.col("text").alias("text"))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = string_column(batch.column(1))
            for start, end in slices(text, BATCH_BYTES):
                new = _rows_of(text.slice(start, end - start), inside, least, exponent)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(start, end - start), *new], ["row", "n_words", "runs", "collapsed"]
                )

    schema = T.StructType([
        T.StructField("row", given.schema["row"].dataType), T.StructField("n_words", T.LongType()),
        T.StructField("runs", RUNS), T.StructField("collapsed", T.StringType()),
    ])
    return given.mapInArrow(add, schema)
