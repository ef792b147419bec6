"""BPE encoding and decoding by speculation and verification.

For every distinct word of a batch a greedy longest match proposes tokens. A tokenisation is the one that merging by
rank would give if and only if each token merges to itself and each pair of neighbours keeps its boundary, so the
distinct pairs are checked together, as arrays. Only words with a pair that fails are merged exactly.

A boundary between tokens a and b falls if some merge across it comes before the merges inside a and b that would
hide its parts. Its parts are a piece on the right edge of a and one on the left edge of b; their merge has a lower
rank than the one that makes the next larger piece of a, and no higher rank than the one of b, since equal merges go
from left to right. Edges are short lists, so all combinations of pieces are compared as arrays.

The vocabulary file of the tokenizers library is read where tasks run; its path is a parameter. A Python worker remembers
up to ``CACHE`` words and ``PAIRS`` pairs, some 100 MB. Encoding is one narrow stage. NULL texts are empty, empty
texts have no tokens and decode to empty texts. A word of n letters costs n log n, however long it is.
"""

from __future__ import annotations

import json
import re
import sys
import unicodedata
from functools import lru_cache
from heapq import heapify, heappop, heappush
from itertools import chain, pairwise

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, small_batches

CACHE = 600_000
PAIRS = 100_000
#: Words of more letters are merged with a heap.
LONG_WORD = 200
#: Characters of text split into words at a time.
PART = 1_000_000
#: Texts whose letters all lie below this code point are split by a pattern of plain classes.
NEAR = 0x250
BEYOND = re.compile(f"[^\\x00-{chr(NEAR - 1)}]")
NEVER = sys.maxsize


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters = {b: chr(b) for b in plain}
    letters |= {b: chr(0x100 + i) for i, b in enumerate(x for x in range(256) if x not in letters)}
    return [letters[b] for b in range(256)]


class Tokenizer:
    """Encodes and decodes with a byte-level BPE vocabulary whose words end in a suffix."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        model = data["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model["end_of_word_suffix"] or ""
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        if self.special:
            self.special_pattern = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))))
        split = next(p for p in data["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        pattern = split["pattern"]["Regex"].replace(r"\s", r"\p{White_Space}")
        self.word_pattern = regex.compile(pattern)
        #: The same for texts of the first letters alone, with their classes spelt out: several times as fast.
        for name in ("White_Space", "L", "N"):
            own = regex.findall(rf"\p{{{name}}}", "".join(map(chr, range(NEAR))))
            pattern = pattern.replace(rf"\p{{{name}}}", "".join(map(re.escape, own)))
        self.near_pattern = re.compile(pattern)
        self.letters = byte_letters()
        self.names = {i: t for t, i in (self.vocab | self.special).items()}

        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.size = size = max(self.names) + 1
        self.made = np.array([self.vocab[a + b] for a, b in merges], np.int64).tolist()
        keys = np.array([self.vocab[a] * size + self.vocab[b] for a, b in merges], np.int64)
        self.ranks = dict(zip(keys.tolist(), range(len(merges)), strict=True))
        self.rank = np.full(size, -1, np.int64)  # of the merge that makes a token
        self.left = np.full(size, -1, np.int64)
        self.right = np.full(size, -1, np.int64)
        self.rank[self.made[::-1]] = np.arange(len(merges))[::-1]
        self.left[self.made[::-1]], self.right[self.made[::-1]] = keys[::-1] // size, keys[::-1] % size
        order = np.argsort(keys)
        self.pair_keys, self.pair_ranks = keys[order], order
        #: Tokens by their symbols, the suffix as a character of its own; only tokens that merge to themselves.
        self.tokens: dict[str, int] = {}
        self.longest = 1
        for name, t in self.vocab.items():
            symbols = self._symbols(name)
            if symbols and self.merge([self.vocab[s] for s in symbols]) == [t]:
                self.tokens[self._plain(name)] = t
                self.longest = max(self.longest, len(self._plain(name)))
        self.words: dict[str, bytes] = {}
        self.pairs: dict[tuple[int, int], bool] = {}

    # vocabulary

    def _plain(self, name: str) -> str:
        """The token's text with the suffix as one closing newline, which never stands for a byte."""
        return name[: -len(self.suffix)] + "\n" if self.suffix and name.endswith(self.suffix) else name

    def _symbols(self, name: str) -> list[str]:
        closed = bool(self.suffix) and name.endswith(self.suffix)
        body = name[: -len(self.suffix)] if closed else name
        out = list(body)
        if closed and out:
            out[-1] += self.suffix
        return out if all(s in self.vocab for s in out) else []

    # words

    def merge(self, ids: list[int]) -> list[int]:
        """Exact merging: the pair of lowest rank first, the leftmost among equals."""
        if len(ids) > LONG_WORD:
            return self._merge_long(ids)
        ids, size, ranks = list(ids), self.size, self.ranks
        open_ = [ranks.get(a * size + b, NEVER) for a, b in pairwise(ids)]
        while open_ and (best := min(open_)) < NEVER:
            at = open_.index(best)
            ids[at:at + 2] = [self.made[best]]
            del open_[at]
            if at:
                open_[at - 1] = ranks.get(ids[at - 1] * size + ids[at], NEVER)
            if at < len(open_):
                open_[at] = ranks.get(ids[at] * size + ids[at + 1], NEVER)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        """``merge`` by a heap of (rank, place) over a linked list, n log n for a word of n letters."""
        ids, size, ranks, n = list(ids), self.size, self.ranks, len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i) for i, (a, b) in enumerate(pairwise(ids)) if (r := ranks.get(a * size + b)) is not None]
        heapify(heap)
        while heap:
            rank, i = heappop(heap)
            if ids[i] < 0 or (j := after[i]) >= n or ranks.get(ids[i] * size + ids[j]) != rank:
                continue  # one of the two has been merged since
            ids[i], ids[j], after[i] = self.made[rank], -1, after[j]
            if after[i] < n:
                before[after[i]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b < n and (r := ranks.get(ids[a] * size + ids[b])) is not None:
                    heappush(heap, (r, a))
        return [x for x in ids if x >= 0]

    def propose(self, word: str) -> list[int] | None:
        """Greedy longest match over the letters of a word; None if some letter begins no token."""
        text, at, out = word + "\n" if self.suffix else word, 0, []
        end = len(text)
        while at < end:
            for stop in range(min(end, at + self.longest), at, -1):
                if (t := self.tokens.get(text[at:stop])) is not None:
                    out.append(t)
                    at = stop
                    break
            else:
                return None
        return out

    def _edges(self, tokens: np.ndarray, inner: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Pieces on one edge of each token, from the token down, and the rank of the merge that hides each."""
        pieces, hidden = [tokens], [np.full(len(tokens), NEVER)]
        while True:
            last = pieces[-1]
            next_ = np.where(last >= 0, inner[np.maximum(last, 0)], -1)
            if (next_ < 0).all():
                return pieces, hidden
            hidden.append(np.where(next_ >= 0, self.rank[np.maximum(last, 0)], -1))
            pieces.append(next_)

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the boundary between neighbours a[i] and b[i] stays."""
        stays = np.ones(len(a), bool)
        rights, over_right = self._edges(a, self.right)
        lefts, over_left = self._edges(b, self.left)
        for x, hx in zip(rights, over_right, strict=True):
            for y, hy in zip(lefts, over_left, strict=True):
                both = (x >= 0) & (y >= 0) & stays
                if not both.any():
                    continue
                key = np.where(both, x * self.size + y, -1)
                at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
                r = np.where(self.pair_keys[at] == key, self.pair_ranks[at], NEVER)
                stays &= ~(both & (r < NEVER) & (r < hx) & (r <= hy))
        return stays

    def learn_words(self, words: set[str]) -> None:
        """Puts the encoding of these words into the cache."""
        spelt = {
            w: w if w.isascii() and w.isprintable() else "".join([self.letters[x] for x in w.encode("utf-8")])
            for w in words
        }
        proposed = {w: self.propose(x) for w, x in spelt.items()}
        if len(self.pairs) > PAIRS:
            self.pairs = {}
        pairs = list({p for ids in proposed.values() if ids for p in pairwise(ids)} - self.pairs.keys())
        if pairs:
            both = np.array(pairs, np.int64)
            self.pairs.update(zip(pairs, self.compatible(both[:, 0], both[:, 1]).tolist(), strict=True))
        for w, ids in proposed.items():
            if ids is None or not all([self.pairs[p] for p in pairwise(ids)]):
                letters = list(spelt[w])
                letters[-1] += self.suffix
                ids = self.merge([self.vocab[x] for x in letters if x in self.vocab])
            self.words[w] = np.array(ids, "<u4").tobytes()

    # texts

    def normalised(self, text: str) -> str:
        """Composed and lower-cased, a letter at a time: a word's last sigma is lowered like any other.

        Runs of white space stay as they are, since no word holds any.
        """
        return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()

    def pieces(self, text: str) -> list[str]:
        """The words of a text; special tokens as themselves behind a space."""
        out: list[str] = []
        at = 0
        for m in self.special_pattern.finditer(text) if self.special else ():
            out += self._words(text[at:m.start()])
            out.append(" " + m[0])
            at = m.end()
        return out + self._words(text[at:]) if at else self._words(text)

    def _words(self, text: str) -> list[str]:
        text = self.normalised(text)
        return (self.word_pattern if BEYOND.search(text) else self.near_pattern).findall(text)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids as little-endian 32-bit numbers. Texts are taken a few at a time, which bounds the words held."""
        out: list[bytes] = []
        part: list[str] = []
        size = 0
        for text in texts:
            part.append(text)
            size += len(text)
            if size >= PART:
                out += self._encode(part)
                part, size = [], 0
        return out + self._encode(part)

    def _encode(self, texts: list[str]) -> list[bytes]:
        split = list(map(self.pieces, texts))
        if len(self.words) > CACHE:
            self.words = {}
        for name, t in self.special.items():
            self.words[" " + name] = np.array([t], "<u4").tobytes()
        fresh = set(chain.from_iterable(split)) - self.words.keys()
        if fresh:
            self.learn_words(fresh)
        known = self.words
        return [b"".join([known[w] for w in ws]) for ws in split]

    def decode(self, ids: bytes) -> str:
        """Token texts with spaces between, as a vocabulary without a decoder of its own has them."""
        return " ".join([self.names.get(i, "") for i in np.frombuffer(ids, "<u4").tolist()])


@lru_cache(maxsize=2)
def tokenizer(path: str) -> Tokenizer:
    return Tokenizer(path)


def encode_texts(documents: DataFrame, path: str, text: str = "text", name: str = "ids") -> DataFrame:
    """All columns of documents and the ids of the text, as little-endian 32-bit numbers in a binary column."""
    small_batches(documents.sparkSession)

    @F.pandas_udf("binary")
    def encode(texts: pd.Series) -> pd.Series:
        coded = pd.Series(tokenizer(path).encode([t or "" for t in texts]), dtype=object)
        give_back()
        return coded

    return documents.withColumn(name, encode(F.col(f"`{text}`")))


def decode_ids(encoded: DataFrame, path: str, ids: str = "ids", name: str = "decoded") -> DataFrame:
    """All columns and the text of the ids."""
    small_batches(encoded.sparkSession)

    @F.pandas_udf("string")
    def decode(values: pd.Series) -> pd.Series:
        return pd.Series([tokenizer(path).decode(bytes(v)) for v in values], dtype=object)

    return encoded.withColumn(name, decode(F.col(f"`{ids}`")))
