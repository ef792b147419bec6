"""Periodic runs, source divergence and top-k search against brute force, with every odd case in small tables."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from creelstat.llm import divergence, periodic_runs, queries, topk_search

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def plain_runs(words, least=24, exponent=3):
    """Every period's maximal stretches, those of the same words under their smallest period."""
    best = {}
    for p in range(1, len(words) // 2 + 1):
        i = 0
        while i + p < len(words):
            start = i
            while i + p < len(words) and words[i] == words[i + p]:
                i += 1
            if i - start + p >= max(least, exponent * p):
                best.setdefault((start, i - start + p), p)
            i += 1
    return sorted(((s, n, p) for (s, n), p in best.items()), key=lambda r: (r[0], r[2]))


def coded(texts):
    names = {w: i for i, w in enumerate(dict.fromkeys(itertools.chain(*texts)))}
    word = np.array([names[w] for t in texts for w in t], np.int32)
    return word, np.cumsum([0, *map(len, texts)])


def found_runs(texts, **options):
    out = defaultdict(list)
    for text, *run in zip(*periodic_runs.find_runs(*coded(texts), **options), strict=True):
        out[int(text)].append(tuple(map(int, run)))
    return [out[i] for i in range(len(texts))]


def test_every_distance_is_in_the_cover():
    shift = periodic_runs.SHIFT
    assert shift.max() < periodic_runs.COVER
    for x, y in itertools.product(range(periodic_runs.COVER), repeat=2):
        assert {(x + shift[x, y]) % periodic_runs.COVER, (y + shift[x, y]) % periodic_runs.COVER} <= set(periodic_runs.MEMBERS)


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**9), st.sampled_from([(24, 3), (6, 2), (2, 2), (10, 4)]), st.sampled_from([40, 250_000]))
def test_runs_of_random_texts(seed, bounds, points):
    random.seed(seed)
    texts = []
    for _ in range(random.randint(1, 4)):
        n, k = random.choice([0, 1, 9, 24, 70, 300]), random.choice([1, 2, 3, 40])
        t = [random.randrange(k) for _ in range(n)]
        for _ in range(random.randint(0, 3) if n else 0):
            a, p = random.randrange(n), random.randint(1, n)
            for i in range(a + p, random.randint(a, n)):
                t[i] = t[i - p]
        texts.append(t)
    kept, periodic_runs.POINTS = periodic_runs.POINTS, points
    try:
        got = found_runs(texts, least=bounds[0], exponent=bounds[1])
    finally:
        periodic_runs.POINTS = kept
    assert got == [plain_runs(t, *bounds) for t in texts]


@settings(max_examples=30, deadline=None)
@given(st.integers(0, 10**9))
def test_common_extensions(seed):
    rng = np.random.default_rng(seed)
    word = np.append(np.tile(rng.integers(0, 3, rng.integers(1, 90)), 6)[:400], 99).astype(np.int32)
    x = rng.integers(0, len(word) - 1, 200)
    y = rng.integers(x + 1, len(word))
    want = [next(t for t in itertools.count() if j + t >= len(word) or word[i + t] != word[j + t]) for i, j in zip(x, y)]
    assert periodic_runs.Lce(word)(x, y).tolist() == want


def test_a_run_of_a_long_text():
    words = [f"w{i}" for i in range(60_000)] + ["a", "b", "c"] * 40_000 + [f"v{i}" for i in range(60_000)]
    assert found_runs([words]) == [[(60_000, 120_000, 3)]]


RUN_DOCS = [
    (1, " ".join(["x", "y"] * 20), "en", "a", 1), (2, None, None, None, None), (3, "", "en", "a", 0),
    (4, " \t\n\x0b\x0c\r ", "en", "a", 0), (5, "one " * 24 + "two " * 23 + "é é " * 30, "en", "a", 5),
    (5, "one " * 24 + "two " * 23 + "é é " * 30, "en", "a", 5), (None, "z\t" * 30, None, None, 9),
    (6, "a b c d e f g h i\n" * 9 + "tail", "en", "b", 7), (7, "plain words of a text", "fr", "b", 7),
    *((i, f"{'p q ' * (i % 9)} some {i} " + "word other " * (i % 17) + "r s t " * (i % 23), "de", "c", i) for i in range(8, 90)),
]


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def run_row(doc_id, text):
    """The contract's row by brute force."""
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and n:
        a = h // 10 % n
        p = 1 + (n - a) // (3 + h // 10 % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(words)
    lost = {i for s, length, p in runs for i in range(s + p, s + length)}
    best = (None,) * 3
    for run in runs:
        if best[0] is None or run[1] * best[2] > best[1] * run[2]:
            best = run
    listed = "".join("%d,%d,%d\n" % run for run in runs)
    exponent = None if best[0] is None else 1000 * best[1] // best[2]
    kept = " ".join(w for i, w in enumerate(words) if i not in lost)
    return doc_id, len(runs), *best, exponent, digest(listed), digest(kept)


def in_order(rows):
    return sorted(map(tuple, rows), key=repr)


def test_op12_against_brute_force(spark, tmp_path):
    spark.createDataFrame(RUN_DOCS, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op12_periodic_runs(spark, str(tmp_path))
    assert in_order(got.collect()) == in_order(run_row(d[0], d[1]) for d in RUN_DOCS)
    assert dict(got.dtypes) | {"doc_id": "bigint"} == {
        "doc_id": "bigint", "n_runs": "bigint", "start": "bigint", "length": "bigint", "period": "bigint",
        "exponent_milli": "bigint", "runs_sha256": "string", "collapsed_sha256": "string",
    }
    assert any(zlib.crc32(str(d[0]).encode()) % 10 == 0 for d in RUN_DOCS if d[0])


def test_runs_keep_all_columns(spark):
    docs = spark.createDataFrame(RUN_DOCS, SCHEMA).selectExpr("*", "'x' AS runs", "1 AS row", "n_chars AS n_words", "2 AS collapsed")
    got = periodic_runs.periodic_runs(docs)
    assert got.columns == ["row", "n_words", "runs", "collapsed"]
    assert got.select("row.*").columns == docs.columns
    assert got.count() == len(RUN_DOCS)
    assert periodic_runs.periodic_runs(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        periodic_runs.periodic_runs(docs, exponent=1)


# --- divergence --------------------------------------------------------------------------------------------


def texts_of_groups():
    random.seed(11)
    rows = [(1, None, None, None), (2, "", "en", "empty"), (3, "  123 @[]`{}~ ", "en", "empty"), (4, "lonely words", "xx", "only")]
    common = [f"common{chr(97 + i)}" for i in range(12)]
    for i in range(400):
        lang, source = random.choice(["en", "de"]), f"s{random.randrange(9)}"
        own = [f"{source}{chr(97 + j)}X" for j in range(3)]
        words = random.choices(common, k=random.randint(0, 30)) + random.choices(own, k=random.randint(0, 4))
        rows.append((i + 10, "1 ".join(words) + random.choice(["", " ÄÖ ÄÖ", " İ ß\u0001Kelvin K"]), lang, source))
    return [(*row, 1) for row in rows] + [(10, "commona commonb", "en", "s1", 1)] * 2


def plain_divergence(rows, least, top):
    """Parts pair and term straight from their definitions."""
    words = [
        (r[2] or "", r[3] or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), r[1] or "")))
        for r in rows
    ]
    out = []
    for lang in {w[0] for w in words}:
        docs = Counter(t for w in words if w[0] == lang for t in set(w[2]))
        kept = [t for t, n in docs.items() if n >= least]
        counts = {s: Counter() for x, s, _ in words if x == lang}
        for x, s, terms in words:
            if x == lang:
                counts[s].update(t for t in terms if docs[t] >= least)
        whole = sum(counts.values(), Counter())

        def shares(c):
            total = sum(c.values())
            return {t: 1 + 10**9 * (c[t] + 5) // (total + 5 * len(kept)) for t in kept}

        p, q = {s: shares(c) for s, c in counts.items()}, shares(whole)
        for s in counts:
            parts = {
                "pair": [(sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in counts if o != s],
                "term": [(p[s][t] - q[t], t) for t in kept if counts[s][t] and p[s][t] > q[t]],
            }
            for part, items in parts.items():
                items.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, v, i + 1) for i, (v, item) in enumerate(items) if part == "pair" or i < top]
    return out


@pytest.mark.parametrize("tile,stripe", [(32, 1024), (2, 4), (3, 1)])
def test_op11_against_brute_force(spark, tmp_path, monkeypatch, tile, stripe):
    monkeypatch.setattr(divergence, "TILE", tile)
    monkeypatch.setattr(divergence, "STRIPE", stripe)
    rows = texts_of_groups()
    docs = spark.createDataFrame(rows, SCHEMA)
    docs.repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op11_source_divergence(spark, str(tmp_path))
    assert in_order(got.collect()) == in_order(plain_divergence(rows, 30, 50))
    assert dict(got.dtypes)["value"] == "bigint" and dict(got.dtypes)["rank"] == "int"


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**9), st.integers(1, 9), st.integers(0, 13), st.integers(0, 8))
def test_distances_on_the_quadtree(seed, rows, columns, first):
    rng = np.random.default_rng(seed)
    first = min(first, rows - 1)
    nonzero = rng.random((rows, columns)) < rng.choice([0.02, 0.2, 0.9])
    zero = rng.integers(0, 1000, rows)
    share = np.where(nonzero, rng.integers(0, 10**9, (rows, columns)), zero[:, None])
    width = columns + int(rng.integers(0, 5))
    got = divergence.distances(share, nonzero, zero, first, width)
    for a, b in itertools.combinations(range(rows), 2):
        if not first or a < first <= b:
            assert got[a, b] == np.abs(share[a] - share[b]).sum() + (width - columns) * abs(zero[a] - zero[b])


def test_divergence_of_nothing(spark):
    docs = spark.createDataFrame([], SCHEMA)
    found = divergence.Divergence.of(docs)
    assert found.pairs().count() == found.terms().count() == 0


# --- top-k -------------------------------------------------------------------------------------------------


def plain_search(rows, chosen, k, scale=256):
    usable = [
        (i, id_, [int(np.floor(float(x) * scale)) for x in v]) for i, (id_, v) in enumerate(rows)
        if v is not None and all(x is not None and np.isfinite(x) for x in v)
    ]
    out = []
    for i, id_, q in usable:
        if not chosen(id_):
            continue
        scores = [(-sum(a * b for a, b in zip(q, x)), other is None, other or 0, other) for j, other, x in usable if j != i]
        for rank, (score, _, _, other) in enumerate(sorted(scores)[:k]):
            out.append((id_, rank + 1, other, -score))
    return out


def vectors(seed, n, width=8):
    rng = np.random.default_rng(seed)
    rows = [(i, rng.normal(0, 1, width).tolist()) for i in range(n)]
    rows += [(n + i, rows[50][1]) for i in range(60)] + [(n + 100 + i, rows[3][1]) for i in range(3)]  # copies
    rows += [(1000, None), (1050, [1.0] * (width - 1) + [None]), (1100, [float("nan")] * width), (1150, [float("inf")] * width)]
    return [*rows, (1200, [0.0] * width), (1250, [-0.0] * width), (1300, [1e6] * width), (1350, [-1e6] * width)]


def search_rows(spark, rows, chosen, k=5, schema="vec_id long, embedding array<float>, class int, id string"):
    frame = spark.createDataFrame([(*r, 7, "x") for r in rows], schema).repartition(4)
    got = topk_search.search(frame, frame.where(chosen), k=k)
    assert got.columns == ["query_id", "rank", "id", "score"]
    return got


@pytest.mark.parametrize("shard,block,chunk", [(32_768, 16_384, 8_000_000), (40, 3, 50)])
def test_op13_against_brute_force(spark, tmp_path, monkeypatch, shard, block, chunk):
    for name, value in {"SHARD": shard, "BLOCK": block}.items():
        monkeypatch.setattr(topk_search, name, value)
    rows = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in vectors(5, 600)]
    frame = spark.createDataFrame([(*r, 7) for r in rows], "vec_id long, embedding array<float>, label int")
    frame.repartition(4).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = queries.op13_topk_search(spark, str(tmp_path))
    assert in_order(got.collect()) == in_order(plain_search(rows, lambda i: i % 50 == 0, 5))
    assert [t for _, t in got.dtypes] == ["bigint", "int", "bigint", "bigint"]


def test_few_equal_short_and_missing_vectors(spark):
    few = [(0, [1.0, 2.0]), (50, [1.0, 2.0]), (1, [1.0]), (None, [5.0, 5.0, 5.0]), (2, []), (0, [3.0, -4.0])]
    got = search_rows(spark, few, "vec_id % 50 = 0")
    assert in_order(got.collect()) == in_order(plain_search(few, lambda i: i is not None and i % 50 == 0, 5))
    assert search_rows(spark, few, "false").count() == 0
    assert search_rows(spark, [(0, None), (50, None)], "vec_id % 50 = 0").count() == 0
    assert search_rows(spark, [(0, [1.0])], "vec_id % 50 = 0").count() == 0


def test_scores_beyond_64_bits_are_held(spark):
    huge = [(0, [1e14, 1e14]), (1, [1e14, 1e14]), (2, [-1e14, 1e13]), (3, [0.01, 0.0])]
    got = search_rows(spark, huge, "vec_id = 0", schema="vec_id long, embedding array<double>, class int, id string")
    assert sorted((r["rank"], r["id"], r["score"]) for r in got.collect()) == [
        (1, 1, 2**63 - 1), (2, 3, 2 * 256 * 10**14), (3, 2, -(2**63)),
    ]


def test_phases_lose_nothing(spark):
    """The cutoff is no higher than the k-th best score, and every pair that reaches it was reported by a list."""
    rng = np.random.default_rng(2)
    a, b = rng.integers(-300, 300, (40, 9)), rng.integers(-300, 300, (200, 9))
    parts = [topk_search.product(a[:, i::topk_search.LISTS], b[:, i::topk_search.LISTS]) for i in range(topk_search.LISTS)]
    whole = topk_search.product(a, b)
    assert (sum(parts) == whole).all()
    kth = np.sort(whole, axis=1)[:, -5]
    reached = np.any([p >= np.ceil(kth / topk_search.LISTS)[:, None] for p in parts], axis=0)
    assert (reached | (whole < kth[:, None])).all()


def test_what_lists_report_stays_in_the_task(spark):
    """Vectors without structure, of which lists report many: disk follows the vectors, not the pairs."""
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(0, 1, 8).tolist()) for i in range(12_000)]
    frame = spark.createDataFrame([(*r, 7, "x") for r in rows], "vec_id long, embedding array<double>, class int, id string")
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def kept():
        found = files.getAllFiles().iterator()
        held = {}
        while found.hasNext():
            file = found.next()
            held[file.getName()] = file.length()
        return held

    before = kept()
    got = topk_search.search(frame, frame.where("vec_id % 4 = 0"), k=5).collect()
    written = sum(size for name, size in kept().items() if name not in before)
    assert written < 6_000_000  # two million, of 768,000 bytes of vectors; entries of lists as rows are forty
    whole = np.floor(np.array([v for _, v in rows]) * 256).astype(np.int64)
    score = whole[::4] @ whole.T
    score[np.arange(3000), np.arange(0, 12_000, 4)] = -(1 << 40)
    want = np.argsort(-score, axis=1, kind="stable")[:, :5]  # ties: the smaller id
    assert sorted(got) == [
        (4 * q, rank + 1, int(i), int(score[q, i])) for q, ids in enumerate(want) for rank, i in enumerate(ids)
    ]


@pytest.mark.parametrize("grid", [(1, 1), (3, 1), (1, 4), (5, 3)])
def test_any_grid_gives_the_same(spark, monkeypatch, grid):
    """Small integers, so that scores tie across stripes, with copies, NULL ids and a query of zeros."""
    monkeypatch.setattr(topk_search, "_grid", lambda *_: grid)
    monkeypatch.setattr(topk_search, "SHARD", 64)
    monkeypatch.setattr(topk_search, "FIRST", 16)
    rng = np.random.default_rng(4)
    rows = [(i % 400, rng.integers(-1, 2, rng.integers(2, 5)).astype(float).tolist()) for i in range(500)]
    rows += [(None, [1.0, 1.0]), (None, [1.0]), (100, [0.0, 0.0]), (2**63 - 1, [1.0, 1.0, 1.0]), (450, [200.0, -3000.0])]
    got = search_rows(spark, rows, "vec_id % 50 = 0", k=7)
    assert in_order(got.collect()) == in_order(plain_search(rows, lambda i: i is not None and i % 50 == 0, 7))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.one_of(
    st.integers(-130, 130), st.integers(-(2**15) - 1, 2**15), st.integers(-(2**31) - 1, 2**31), st.integers(-(2**63), 2**63 - 1)
), max_size=4), max_size=8))
def test_vectors_as_bytes(lists):
    offsets = np.cumsum([0, *map(len, lists)])
    coded = topk_search._encoded(offsets, np.array([x for v in lists for x in v], np.int64))
    back = topk_search._matrix(coded)
    assert [list(map(int, row[:len(v)])) for row, v in zip(back, lists, strict=True)] == lists
    assert not any(row[len(v):].any() for row, v in zip(back, lists, strict=True))
    for a, b in itertools.combinations(range(len(lists)), 2):
        assert (coded[a] == coded[b]) == (lists[a] == lists[b])
