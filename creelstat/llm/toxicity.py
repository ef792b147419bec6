"""Toxicity by a weighted lexicon with exceptions, matched by an Aho-Corasick automaton.

Texts are folded first: lower case, look-alike letters of other scripts, digits and signs used as letters, letters
spaced out by punctuation, and letters drawn out. ``1``, ``i`` and ``l`` fold to one letter, in the lexicon too. The
folded words are searched for the terms of the lexicon: whole words, and beginnings of words for languages that put
endings on them. A word counts with its heaviest term unless an exception phrase covers it. The sum of the weights, its
logarithm and its share of the text's length go through a logistic function.

Lexicon, exceptions and the three factors are learnt from labelled texts. At most ``sample`` labelled ids, chosen by a
hash of doc_id, are used, each with its different texts; that bounds the lexicon. They are folded once and kept folded
for the four passes over them. The driver sees terms and counts, no texts. Everything else covers all rows:
scoring is one narrow stage without a shuffle.

Defined results: NULL and empty texts have no words and get the score of a text without hits. Without any labels, or
with labels of one kind, the lexicon is empty and the score is the smoothed share of toxic labels.
"""

from __future__ import annotations

import math
import re
import sys
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import give_back, pick, small_batches, stored

# Letters of other scripts that look like Latin ones.
LOOKALIKES = dict(zip(
    "абвеёзикмнорстухіјѕԁһⅼαβγδεηικνοπρτυχω",
    "abbee3ukmhopctyxijsdhlabydenikvonptuxw", strict=True,
)) | {"с": "c", "р": "p", "у": "y", "т": "t", "и": "u", "ı": "i", "ł": "l", "ø": "o", "ß": "ß"}
# Digits and signs that stand for letters inside words.
SIGNS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "|": "i"}
FOLD = str.maketrans(LOOKALIKES)
SPELT = re.compile(r"(?<![^\W_])((?:[^\W\d_][.\-_*·]+){2,}[^\W\d_])(?![^\W_])")
#: In every text that SPELT matches; found much faster.
MAYBE_SPELT = re.compile(r"[.\-_*·][^\W\d_][.\-_*·]")
#: Signs that belong to a word where letters or digits stand on both sides.
INNER = "@$!|"
SIGNED = re.compile(r"[0-9@$!|]")
DRAWN = re.compile(r"(.)\1{2,}")
SHORTEST, LONGEST = 3, 8


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """By code point: look-alikes folded; letters, digits and signs as they are; a space for everything else."""
    n = sys.maxunicode + 1
    codes = np.arange(n, dtype="<u4")
    codes[~np.fromiter((chr(c).isalnum() for c in range(n)), bool, n)] = ord(" ")
    for c in INNER:
        codes[ord(c)] = ord(c)
    for a, b in LOOKALIKES.items():
        codes[ord(a)] = ord(b)
    return codes


@lru_cache(maxsize=50_000)
def fold_word(word: str) -> str:
    """One lower-case word in folded letters; words of digits alone stay."""
    if SIGNED.search(word) and any(c.isalpha() for c in word):
        word = "".join(SIGNS.get(c, c) for c in word)
    return DRAWN.sub(r"\1", word).replace("l", "i")


def folded(text: str) -> str:
    """The folded words of a text, each between two single spaces; empty without words.

    Letters are folded for the whole text at once; only words with digits or signs are looked at one by one.
    """
    low = unicodedata.normalize("NFKC", text).lower()
    if MAYBE_SPELT.search(low):
        low = SPELT.sub(lambda m: re.sub(r"[.\-_*·]+", "", m[1]), low.translate(FOLD))
    codes = _letters()[np.frombuffer(low.encode("utf-32-le", "surrogatepass"), "<u4")]
    same = codes[1:] == codes[:-1]
    drawn = (same[1:] & same[:-1] & (codes[2:] != ord(" "))).any()
    raw = codes.tobytes().decode("utf-32-le").split()
    plain = " ".join(raw)
    words = (DRAWN.sub(r"\1", plain) if drawn else plain).replace("l", "i")
    if SIGNED.search(plain):
        each = (
            fold_word(w.strip(INNER)) if SIGNED.search(w) else other for w, other in zip(raw, words.split(" "), strict=True)
        )
        words = " ".join(filter(None, each))
    return f" {words} " if words else ""


def fold(text: str) -> list[str]:
    """The folded words of a text."""
    return folded(text).split()


def features(word: str) -> Iterator[str]:
    """Terms of the lexicon that a word can match: its beginnings and, closed by a space, the whole word."""
    yield f" {word} "
    for n in range(SHORTEST, min(LONGEST, len(word)) + 1):
        yield f" {word[:n]}"


def all_terms(words: str) -> set[str]:
    """The terms that folded words can match."""
    return {f for w in set(words.split()) for f in features(w)}


def _outside(found: dict[int, float], spans: list[tuple[int, int]]) -> dict[int, float]:
    """The entries whose place lies in none of the spans [a, b), by one sweep over both in order."""
    spans.sort()
    kept, reach, i = {}, -1, 0
    for at in sorted(found):
        while i < len(spans) and spans[i][0] <= at:
            reach = max(reach, spans[i][1])
            i += 1
        if at >= reach:
            kept[at] = found[at]
    return kept


def _automaton(found: Iterable[tuple[str, object]]) -> ahocorasick.Automaton:
    """Matches strings and gives what stands for each."""
    a = ahocorasick.Automaton()
    for string, value in found:
        a.add_word(string, value)
    if len(a):
        a.make_automaton()
    return a


@dataclass(frozen=True)
class Model:
    """Terms with weights, exception phrases, and the logistic function's intercept and factors."""

    terms: dict[str, float]
    exceptions: frozenset[str] = frozenset()
    intercept: float = 0.0
    factors: tuple[float, float, float] = (0.0, 0.0, 0.0)
    _built: dict = field(default_factory=dict, compare=False, repr=False)

    def __getstate__(self):
        return (self.terms, self.exceptions, self.intercept, self.factors)

    def __setstate__(self, state):
        for name, value in zip(("terms", "exceptions", "intercept", "factors"), state, strict=True):
            object.__setattr__(self, name, value)
        object.__setattr__(self, "_built", {})

    def _matcher(self):
        if "a" not in self._built:
            self._built["a"] = _automaton([
                *((term, (len(term), weight, False)) for term, weight in self.terms.items()),
                *((f" {phrase} ", (len(phrase) + 2, 0.0, True)) for phrase in self.exceptions),
            ])
        return self._built["a"]

    def hits(self, words: str) -> dict[int, float]:
        """Weight by the place in the folded words at which a matched word begins, its space included."""
        automaton = self._matcher()
        if not len(automaton) or not words:
            return {}
        found, covered = {}, []
        for end, (size, weight, exception) in automaton.iter(words):
            at = end - size + 1
            if exception:
                covered.append((at, end))
            elif weight > found.get(at, 0.0):
                found[at] = weight
        return _outside(found, covered) if covered else found

    def measures(self, words: str) -> tuple[float, float, float]:
        """Of a text's folded words."""
        total = sum(self.hits(words).values())
        return total, math.log1p(total), 10 * total / (max(0, words.count(" ") - 1) + 10)

    def score(self, text: str | None) -> float:
        x = self.intercept + sum(f * m for f, m in zip(self.factors, self.measures(folded(text or "")), strict=True))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, x))))


def _frame(seen: dict[bool, Counter]) -> pd.DataFrame:
    terms = list(seen[True].keys() | seen[False].keys())
    return pd.DataFrame({
        "term": pd.Series(terms, dtype=object),
        "toxic": pd.Series([seen[True][t] for t in terms], dtype="int64"),
        "clean": pd.Series([seen[False][t] for t in terms], dtype="int64"),
    })


def _summed(rows: DataFrame, count) -> DataFrame:
    return rows.mapInPandas(count, "term string, toxic long, clean long").groupBy("term").agg(
        F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")
    )


def _counted(rows: DataFrame, terms_of) -> DataFrame:
    """(term, toxic, clean): texts that hold each term, summed inside tasks before the shuffle."""
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            seen = {True: Counter(), False: Counter()}
            for words, toxic in zip(batch.words, batch.toxic, strict=True):
                seen[bool(toxic)].update(terms_of(words))
            yield _frame(seen)

    return _summed(rows, count)


def _counted_up_to(rows: DataFrame, most: dict[str, int]) -> DataFrame:
    """(term, toxic, clean) of the terms in most.

    A task may stop counting a term once more than ``most`` of its clean texts hold it: the sum is above ``most`` then as
    well, and a lower count of toxic texts makes the term no more toxic.
    """
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        left, seen = dict(most), {True: Counter(), False: Counter()}
        automaton = _automaton((t, t) for t in left)
        for batch in batches:
            for words, toxic in zip(batch.words, batch.toxic, strict=True):
                if words and left:
                    seen[bool(toxic)].update({t for _, t in automaton.iter(words)})
            left = {t: limit for t, limit in left.items() if seen[False][t] <= limit}
            if len(left) < 0.9 * len(automaton):
                automaton = _automaton((t, t) for t in left)
        yield _frame(seen)

    return _summed(rows, count)


def _logistic(x: np.ndarray, y: np.ndarray, n: np.ndarray, ridge: float = 1.0) -> tuple[float, np.ndarray]:
    """Intercept and factors by Newton's method on standardised columns; row i stands for n[i] texts."""
    mean = np.average(x, 0, n)
    sd = np.maximum(np.sqrt(np.average((x - mean) ** 2, 0, n)), 1e-9)
    z = np.column_stack([np.ones(len(x)), (x - mean) / sd])
    b = np.zeros(z.shape[1])
    penalty = ridge * np.diag([0.0] + [1.0] * x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(z @ b, -30, 30)))
        step = np.linalg.solve(
            (z.T * (n * p * (1 - p))) @ z + penalty + 1e-9 * np.eye(len(b)), z.T @ (n * (y - p)) - penalty @ b
        )
        b += step
        if np.abs(step).max() < 1e-8:
            break
    factors = b[1:] / sd
    return float(b[0] - factors @ mean), factors


def learn(
    documents: DataFrame, labels: DataFrame, sample: int = 50_000, support: int = 4, share: float = 0.01, odds: float = 8.0,
    exceptions: tuple[str, ...] = (), error: float = 0.05,
) -> Model:
    """A model of (doc_id, text) and (doc_id, toxic).

    A term needs ``support`` toxic texts and to be ``odds`` times as frequent there as in clean ones. If it stands in
    less than ``share`` of the toxic texts, chance must be excluded as well: so large a part of its texts may be toxic
    with a probability of ``error`` at most, over all candidates together. That bar does not rise with the input, so a
    language with few toxic labels has terms too. A phrase of two
    words around a term becomes an exception if ``support`` clean texts hold it and no larger share of toxic ones.
    Labels that are NULL, or belong to no document, count for nothing; a document labelled both ways is toxic.
    """
    small_batches(documents.sparkSession)
    known = pick(labels, "doc_id", "toxic").where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(
        (F.max("toxic") > 0).alias("toxic")
    )
    part = min(1.0, sample / max(1, known.count()))
    chosen = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(part * (1 << 30)))
    texts = pick(documents, "doc_id", "text").withColumn("text", F.coalesce("text", F.lit("")))
    # copies of a document under one id are one; different texts under it stay
    # and words are folded once for all passes
    rows = stored(
        texts.join(F.broadcast(chosen), "doc_id").withColumn("digest", F.xxhash64("text"))
        .dropDuplicates(["doc_id", "digest"]).select(_folded_words("text").alias("words"), "toxic")
    )
    n = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    toxic, clean = n.get(True, 0), n.get(False, 0)
    if not toxic or not clean:
        prior = (toxic + 0.01) / (toxic + clean + 1)
        return Model({}, intercept=math.log(prior / (1 - prior)))

    least, prior = max(support, math.ceil(share * toxic)), toxic / (toxic + clean)

    first = _counted(rows.where("toxic"), all_terms).where(F.col("toxic") >= support).select("term", "toxic").collect()
    # one more than the clean texts a term may have at these odds, so that rounding decides nothing
    most = {r["term"]: math.ceil((r["toxic"] + 0.5) / (toxic + 1) * (clean + 1) / odds) for r in first}
    ratio = (F.col("toxic") + 0.5) / (toxic + 1) / ((F.col("clean") + 0.5) / (clean + 1))
    both = _counted_up_to(rows, most).where(ratio >= odds).collect()
    both = [
        r for r in both if r["toxic"] >= least or _by_chance(r["toxic"], r["clean"], prior) * len(most) <= error
    ]
    weight = {
        r["term"]: math.log((r["toxic"] + 0.5) / (toxic + 1) / ((r["clean"] + 0.5) / (clean + 1))) for r in both
    }
    terms = _chosen(weight, {r["term"]: r["toxic"] for r in both})
    lexicon = Model(terms)

    def phrases(words: str) -> set[str]:
        out = set()
        for at in lexicon.hits(words):
            end = words.index(" ", at + 1)
            if (before := words.rfind(" ", 0, at)) >= 0:
                out.add(words[before + 1:end])
            if (after := words.find(" ", end + 1)) >= 0:
                out.add(words[at + 1:after])
        return out

    spared = _counted(rows, phrases).where(
        (F.col("clean") >= support) & (F.col("toxic") * clean <= F.col("clean") * toxic)
    ).collect()
    own = {" ".join(fold(x)) for x in exceptions}
    model = Model(terms, frozenset({r["term"] for r in spared} | own))

    @F.pandas_udf("a double, b double, c double")
    def measure(words: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([model.measures(w) for w in words], columns=["a", "b", "c"])

    # the driver sees how many texts have the same measures, to four digits, not the texts
    seen = rows.select(measure("words").alias("m"), F.col("toxic").cast("double").alias("y")).groupBy(
        *[F.round(f"m.{c}", 4).alias(c) for c in "abc"], "y"
    ).count().orderBy("a", "b", "c", "y").toPandas()
    intercept, factors = _logistic(*(seen[c].to_numpy(float) for c in (["a", "b", "c"], "y", "count")))
    return Model(terms, model.exceptions, intercept, tuple(map(float, factors)))


def _folded_words(text: str) -> Column:
    @F.pandas_udf("string")
    def fold_texts(texts: pd.Series) -> pd.Series:
        words = pd.Series([folded(t) for t in texts], dtype=object)
        give_back()
        return words

    return fold_texts(text)


def _by_chance(toxic: int, clean: int, prior: float) -> float:
    """Chernoff's bound of the probability that so many of a term's texts are toxic, each with the prior."""
    n = toxic + clean
    if toxic <= n * prior:
        return 1.0
    log = toxic * math.log(toxic / n / prior) + (clean * math.log(clean / n / (1 - prior)) if clean else 0.0)
    return math.exp(-log)


def _stems(term: str) -> Iterator[str]:
    """The beginnings of a term, shorter than itself."""
    yield from (term[:n] for n in range(SHORTEST + 1, len(term.rstrip(" ")) + (term[-1] == " ")))


def _chosen(weight: dict[str, float], texts: dict[str, int]) -> dict[str, float]:
    """The terms worth keeping among those that match the same words.

    A beginning goes if one longer term stands for nine tenths of its toxic texts. A longer term goes if a beginning
    left outweighs it.
    """
    narrow = {p for term, n in texts.items() for p in _stems(term) if n >= 0.9 * texts.get(p, n * 2)}
    left = {t: w for t, w in weight.items() if t not in narrow}
    return {t: w for t, w in left.items() if all(left.get(p, 0.0) < w for p in _stems(t))}


def score_texts(documents: DataFrame, model: Model, text: str = "text", name: str = "score") -> DataFrame:
    """All columns of documents and the score, from 0 to 1; a column of that name is replaced."""
    small_batches(documents.sparkSession)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        scores = pd.Series([model.score(t) for t in texts], dtype="float64")
        give_back()
        return scores

    return documents.withColumn(name, score(F.col(f"`{text}`")))
