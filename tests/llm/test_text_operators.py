"""The operators for training text against brute force, on small tables with every odd case in them."""

import html
import itertools
import random
import re
import time
import unicodedata
from collections import Counter

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer as Reference

import corpus_pipeline
from creelstat.llm import (
    bpe, chat_format, components, decontaminate, html_extract, line_dedup, oracle, quality, queries, simhash,
    suffix_dedup, toxicity, url_filter,
)

random.seed(7)
LONG = " ".join(random.choice("alpha beta gamma delta epsilon zeta eta theta".split()) + str(i % 97) for i in range(30_000))
PASSAGE = " ".join(f"shared{i} words of a passage" for i in range(30))
DOCS = [
    (1, f"Own first line here\n{PASSAGE}\nlast line", "en", "a", 1),
    (2, f"Another beginning of this\n{PASSAGE}\nlast line\n\nOWN FIRST LINE HERE  ", "en", "a", 2),
    (3, None, None, None, None),
    (4, "", "fr", "a", 0),
    (5, LONG, "en", "b", len(LONG)),
    (5, LONG, "en", "b", len(LONG)),
    (6, "  \t\n\x0b \r", "en", "a", 6),
    (None, f"no id but the same {PASSAGE}", None, "a", 5),
    (7, "one two three four five one two three four five one two three four five", "en", None, 3),
    (8, "Ünïcödé ÄÖÜ łłł 日本語テキスト 😀 a\\b </turn> <turn>\nÜnïcödé ÄÖÜ łłł 日本語テキスト 😀 a\\b </turn> <turn>", "de", "a", 9),
    (9, LONG + " with another end", "en", "b", 1),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def clashing(docs):
    """The same rows with further columns under names that the operators use themselves."""
    names = (
        "digest term pos w words sketch fp node first keys hi lo row kept out ids decoded score host path stratum good "
        "n_words base_failed anchor content start n ranges log turn message component_id stays count"
    ).split()
    return docs.withColumns({n: F.lit("x") for n in names})


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def rows(df, *names):
    return sorted((tuple(r) for r in df.select(*names).collect()), key=repr)


def expected(one):
    return sorted((one(*d[:2]) for d in DOCS), key=repr)


def test_same_with_clashing_columns_and_none_without_rows(docs, clashing, nothing, spark):
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1), (None, 1, 1), (3, None, None)],
                                   "doc_id long, quality int, toxic int")
    items = spark.createDataFrame([(1, PASSAGE), (2, None), (3, "")], "item_id long, text string")
    path = public_tokenizers.path("word_bpe_49k.json")
    model = toxicity.Model({" idiot ": 5.0}, intercept=-1.0, factors=(1.0, 0.0, 0.0))
    runs = {
        "simhash": (simhash.near_duplicates, ("doc_id", "fp", "component_id")),
        "similar": (simhash.similar_documents, ("doc_id", "component_id", "stays")),
        "lines": (line_dedup.dedup_lines, ("row.doc_id", "line_text", "n_lines", "n_dropped")),
        "suffix": (suffix_dedup.dedup_substrings, ("doc_id", "n_bytes", "n_removed", "n_spans", "kept")),
        "quality": (lambda d: quality.judge(d, labels), ("doc_id", "n_words", "kept")),
        "index": (lambda d: decontaminate.Index(d, items).report(), ("doc_id", "n_words", "n_hit", "contaminated")),
        "bpe": (lambda d: bpe.decode_ids(bpe.encode_texts(d, path), path), ("doc_id", "ids", "decoded")),
        "toxicity": (lambda d: toxicity.score_texts(d, model), ("doc_id", "score")),
    }
    for name, (run, columns) in runs.items():
        usual = rows(run(docs), *columns)
        assert len(usual) == len(DOCS), name
        assert rows(run(clashing), *columns) == usual, name
        assert rows(run(nothing), *columns) == [], name


# 1


PAGE = """<html><body class="has-sidebar"><header><a href=x>Home</a> Site</header><div id="cookie-notice">We use cookies</div>
<div class="menu"><ul><li>a<li>b</ul></div><main><article class="post-12"><header><h1>Title &eacute;</h1><i>by me</i></header>
<p>First&nbsp;para <a href="x">link</a> text,   with   spaces<p>Second<br>line &lt;tag&gt; <script>var x="<p>no</p>"</script>
more<ul><li>one<li>two</ul><table><tr><td>a<td>b<tr><td>c</table><form><input><label>Name</label></form><aside>side</aside>
<blockquote>quoted</blockquote></article><section class="comments"><p>Reader says hi</p></section></main>
<div class=sidebar>links</div><footer>foot</footer></body></html>"""


def test_pages(spark):
    pages = [
        (1, "http://a.example/x", PAGE), (2, "http://a.example/y", PAGE.replace("post-12", "post-99")), (3, None, None),
        (4, "http://b.example", ""), (4, "http://b.example", ""), (5, "nothing", "plain text only"),
        (6, "http://a.example/z", "<p>" + "long &amp; winding " * 50_000),
    ]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("host", F.lit("x"))
    got = rows(html_extract.extract(df), "page_id", "text")
    text = "Title é\nFirst para link text, with spaces\nSecond line <tag> more\none\ntwo\na b\nc\nquoted"
    want = {1: text, 2: text, 3: "", 4: "", 5: "plain text only", 6: ("long & winding " * 50_000).strip()}
    assert got == sorted(((i, want[i]) for i, _, _ in pages), key=repr)
    paths = dict(rows(html_extract.host_paths(df), "host", "path"))
    assert paths["a.example"] == "/html/body.has-sidebar/main/article.post-#"
    assert html_extract.extract(df.limit(0)).count() == 0


@pytest.mark.parametrize("page", ["<", "<a href=\"x", "<div><p title='>'>q</p></div>", "</p></div>", "<!--", "<p>" * 500])
def test_broken_pages(page):
    assert html_extract.page_text(page, None) in ("", "q", "<")


def test_pages_of_the_table_against_their_articles(spark):
    pages = pd.read_parquet("/root/testdata/sf0.001/pages.parquet")

    def article(page):
        inside = page.split("<article>")[1].split("</article>")[0].split("<footer>")[0]
        lines = re.sub(r"</?(p|h1)>", "\n", re.sub(r"</?b>", "", inside.replace("<br>", " "))).split("\n")
        return "\n".join(x for x in (" ".join(html.unescape(y).split()) for y in lines) if x)

    got = dict(rows(queries.op1_html_extraction(spark, "/root/testdata/sf0.001"), "page_id", "text"))
    assert got == {i: article(h) for i, h in zip(pages.page_id, pages.html, strict=True)}


# 2


def brute_components(prints, budget):
    parent = {p: p for p in prints}

    def root(p):
        while parent[p] != p:
            p = parent[p]
        return p

    for a, b in itertools.combinations(parent, 2):
        if (a ^ b).bit_count() <= budget:
            parent[max(root(a), root(b))] = min(root(a), root(b))
    return {p: root(p) for p in prints}


def plain_print(text, size):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    grams = [b" ".join(words[i:i + size]) for i in range(max(1, len(words) - size + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints_and_components(docs, spark):
    short = [(i, t) for i, t, *_ in DOCS if t is None or len(t) < 5000]
    got = {(r[0], r[1] % 2**64, r[2]) for r in rows(simhash.near_duplicates(docs), "doc_id", "fp", "component_id")}
    prints = {(i, plain_print(t, 4)) for i, t in short}
    assert prints <= {x[:2] for x in got}
    roots = brute_components({x[1] for x in got}, 4)
    ids = {}
    for i, p, _ in got:
        if i is not None:
            ids[roots[p]] = min(ids.get(roots[p], i), i)
    assert got == {(i, p, ids.get(roots[p])) for i, p, _ in got}


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 2**32), st.integers(1, 6), st.integers(0, 3))
def test_trie_walk(seed, spread, depth):
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 1 << 64, 12, dtype=np.uint64)
    near = [base ^ (np.uint64(1) << rng.integers(0, 64, 12, dtype=np.uint64)) for _ in range(spread)]
    dense = base[0] ^ rng.integers(0, 64, 30, dtype=np.uint64)
    fps = np.unique(np.concatenate([base, *near, dense]))
    prefix = fps >> np.uint64(63) if depth else fps * np.uint64(0)
    links = []
    for p in np.unique(prefix):
        links += list(zip(*simhash.walk(fps[prefix == p], None, int(bool(depth)), 0, 4), strict=True))
    if len(np.unique(prefix)) == 2:
        links += list(zip(*simhash.walk(fps[prefix == 0], fps[prefix == 1], 1, 1, 4), strict=True))
    parent = {int(f): int(f) for f in fps}

    def root(p):
        while parent[p] != p:
            p = parent[p]
        return p

    for a, b in links:
        parent[max(root(int(a)), root(int(b)))] = min(root(int(a)), root(int(b)))
    assert {p: root(p) for p in parent} == brute_components(list(parent), 4)


def test_full_blocks_are_dealt_out(spark):
    rng = np.random.default_rng(8)
    dense = np.unique(rng.integers(0, 1 << 20, 900, dtype=np.uint64)) | np.uint64(0xABC << 52)
    fps = np.concatenate([dense, rng.integers(0, 1 << 64, 100, dtype=np.uint64)])
    fps = np.unique(np.concatenate([fps, fps[-50:] ^ np.uint64(1 << 63 | 1)]))
    prints = spark.createDataFrame([(0, int(f), int(f)) for f in fps.view(np.int64)], "part int, fp long, node long")
    sent, _ = simhash._dealt(prints, 4, 4, 100)
    assert sent.groupBy("at", "mask", "s", "t").count().agg(F.max("count")).first()[0] <= 300
    links = rows(simhash.trie_join(prints, block=100), "a", "b")
    forest = simhash.Forest(len(fps))
    place = {int(f): i for i, f in enumerate(fps)}
    forest.link(*(np.array([place[x[k] % 2**64] for x in links]) for k in (0, 1)))
    roots, whole = forest.roots(np.arange(len(fps))), brute_components([int(f) for f in fps], 4)
    assert {int(f): int(fps[r]) for f, r in zip(fps, roots, strict=True)} == whole


def test_components_of_a_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 150)] + [(7, 7)]
    got = dict(rows(components.components(spark.createDataFrame(links, "a long, b long")), "node", "root"))
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 150)}


def test_components_of_shuffled_chains(spark):
    rng = random.Random(11)
    names = rng.sample(range(-10**12, 10**12), 3_000)
    chains = [names[i:i + 300] for i in range(0, 3_000, 300)]
    links = [x for c in chains for x in zip(c, c[1:], strict=False)] + [(names[0], n) for n in names[1:300:7]] * 2
    links += [(chains[1][5], chains[2][9]), (names[-1], names[-1])]
    rng.shuffle(links)
    want = {n: min(c) for c in [chains[0], chains[1] + chains[2], *chains[3:]] for n in c}
    frame = spark.createDataFrame(links, "a long, b long").repartition(5)
    got = rows(components.components(frame), "node", "root")
    assert len(got) == len(want) and dict(got) == want
    some = rows(components._united(frame.coalesce(1).toDF("u", "v"), some=64), "u", "v")
    parent = {n: n for n in names}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in some:
        parent[max(root(a), root(b))] = min(root(a), root(b))
    assert {n: root(n) for n in names} == want


def test_components_of_few_links_take_few_tasks(spark):
    context, held = spark.sparkContext, {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k) for k in held}
    links = [(i, i + 1) for i in range(500)] + [(1_000, i) for i in range(1_001, 1_500)]
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        context.setJobGroup("few links", "")
        got = dict(rows(components.components(spark.createDataFrame(links, "a long, b long").coalesce(4)), "node", "root"))
        tracker = context.statusTracker()
        stages = {s for j in tracker.getJobIdsForGroup("few links") for s in tracker.getJobInfo(j).stageIds}
        tasks = sum(x.numTasks for s in stages if (x := tracker.getStageInfo(s)))
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
        for k, v in old.items():
            spark.conf.set(k, v)
    assert got == {i: 0 for i in range(501)} | {i: 1_000 for i in range(1_000, 1_500)}
    assert 0 < tasks < 700


def test_similar_documents_at_four_fifths(spark):
    rng = random.Random(3)
    words = [f"w{rng.randrange(10**6)}" for _ in range(600)]
    texts = [(0, " ".join(words))]
    for i in range(1, 6):  # one changed word costs five shingles of 596: all far above 0.8
        own = list(words)
        for k in rng.sample(range(600), 2 * i):
            own[k] = f"x{i}{k}"
        texts.append((i, " ".join(own)))
    texts += [(10 + i, " ".join(f"u{rng.randrange(10**6)}" for _ in range(80))) for i in range(20)]
    half = words[:300] + [f"y{k}" for k in range(300)]
    texts.append((90, " ".join(half)))
    got = rows(simhash.similar_documents(spark.createDataFrame(texts, "doc_id long, text string")),
               "doc_id", "component_id", "stays")
    assert got == sorted(((i, 0 if i < 6 else i, i == 0 or i >= 6) for i, _ in texts), key=repr)


def shingle_set(text, size=5):
    words = text.split()
    return {" ".join(words[i:i + size]) for i in range(max(1, len(words) - size + 1))}


def brute_similar(texts, similarity=0.8):
    sets = {i: shingle_set(t) for i, t in texts}
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in itertools.combinations(sets, 2):
        if len(sets[a] & sets[b]) >= similarity * len(sets[a] | sets[b]):
            parent[max(root(a), root(b))] = min(root(a), root(b))
    return {i: root(i) for i in sets}


@pytest.mark.parametrize("many", [150, 600])
def test_similar_documents_among_chance_neighbours(spark, many):
    # pieces of 16 bits have a hundredth of all others within 3 bits, as many as pieces of 32 bits have in a large corpus
    rng = random.Random(many)
    texts = []
    for k in range(many):
        words = [f"w{k}x{i}" for i in range(120)]
        texts.append((2 * k, " ".join(words)))
        for i in (20, 70):
            words[i] = f"y{k}"
        if k % 3:  # at about 0.85
            texts.append((2 * k + 1, " ".join(words)))
    rng.shuffle(texts)
    got = dict(rows(simhash.similar_documents(spark.createDataFrame(texts, "doc_id long, text string"), bits=16),
                    "doc_id", "component_id"))
    assert got == brute_similar(texts)


@pytest.mark.parametrize("block", [simhash.LIKELY_BLOCK, 20])  # tries of depth 1, and of depth 3 with full blocks
def test_similar_documents_beside_pairs_that_the_sets_refuse(spark, block):
    # families at about 0.75 to their head, so near in bits, with pairs of their own at over 0.8
    texts = []
    for k in range(12):
        words = [f"w{k}x{i}" for i in range(200)]
        texts.append((100 * k, " ".join(words)))
        for v in range(1, 6):
            own = list(words)
            for i in range(6):
                own[10 + 30 * i + v] = f"y{k}v{v}n{i}"
            texts.append((100 * k + v, " ".join(own)))
            own[9] = f"z{k}{v}"
            texts.append((100 * k + 50 + v, " ".join(own)))
    got = dict(rows(simhash.similar_documents(spark.createDataFrame(texts, "doc_id long, text string"), block=block),
                    "doc_id", "component_id"))
    assert got == brute_similar(texts)


def test_likely_pairs_connect_what_all_pairs_do():
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 64, (30, 8), dtype=np.uint64)
    near = np.repeat(base, 20, axis=0)
    for _ in range(40):
        near[np.arange(600), rng.integers(0, 8, 600)] ^= np.uint64(1) << rng.integers(0, 64, 600, dtype=np.uint64)
    fps = near[:, 0] & np.uint64(0xFF << 56)
    order = np.argsort(fps)
    fps, near = fps[order], np.asfortranarray(near[order])
    far = lambda x, y: sum(int(p ^ q).bit_count() for p, q in zip(near[x], near[y], strict=True))
    all_ = {(x, y) for x, y in itertools.combinations(range(600), 2)
            if int(fps[x] ^ fps[y]).bit_count() <= 3 and far(x, y) <= 60}
    trees = rng.integers(0, 50, 600)
    found = simhash.walk_likely(fps, None, 0, 0, 3, near, 60, trees)
    got = {(min(x, y), max(x, y)) for x, y in zip(*found, strict=True)}
    assert got == {(x, y) for x, y in all_ if trees[x] != trees[y]}
    forest, whole = simhash.Forest(600), simhash.Forest(600)
    a, b = simhash.walk_likely(fps, None, 0, 0, 3, near, 60)
    forest.link(a, b)
    assert all(far(x, y) <= 60 for x, y in zip(a, b, strict=True)) and len(a) < 600
    whole.link(*map(np.array, zip(*all_, strict=True)))
    roots, at = forest.roots(np.arange(600)), whole.roots(np.arange(600))
    assert all(roots[x] == roots[at[x]] for x in range(600))


def test_similar_documents_of_one_filler_stay_apart(spark):
    filler = "0 " * 300
    texts = [(i, filler + " ".join(f"w{i}x{k}" for k in range(100))) for i in range(3)]
    got = dict(rows(simhash.similar_documents(spark.createDataFrame(texts, "doc_id long, text string")),
                    "doc_id", "component_id"))
    assert got == {0: 0, 1: 1, 2: 2} == brute_similar(texts)


def test_similar_documents_count_a_repeated_shingle_once(spark):
    half = [" ".join(f"{h}{i}" for i in range(50)) for h in "ab"]
    texts = [(10, " ".join(half)), (11, " ".join([half[0]] * 10 + half[1:]))]
    got = dict(rows(simhash.similar_documents(spark.createDataFrame(texts, "doc_id long, text string")),
                    "doc_id", "component_id"))
    assert got == {10: 10, 11: 10} == brute_similar(texts)


# 3


def fold_plain(events):
    """Messages by a loop over the sorted events."""
    logs = {}
    for conv, seq, message, kind, role, text in events:
        logs.setdefault(conv, []).append((message, seq, 0 if kind == "message" else 1, role or "", text or "", kind))
    out = {}
    for conv, log in logs.items():
        done, last = [], object()
        for message, seq, _, role, text, kind in sorted(log):
            if kind == "message" or message != last:
                done.append([seq, message, role, text])
            elif kind == "delta":
                done[-1][3] += text
            else:
                done[-1][3] = text
            last = message
        out[conv] = [(r, t) for _, _, r, t in sorted(map(tuple, done))]
    return out


EVENT = st.tuples(
    st.integers(0, 2), st.integers(0, 6), st.integers(0, 3), st.sampled_from(["message", "delta", "edit", "regenerate"]),
    st.sampled_from(["user", "assistant", "", None, "sys<turn>tem"]),
    st.sampled_from(["a", "", None, "</turn>\n", "\\", "<text>", "<\\turn>", "é\n<turn>x"]),
)


def test_fold_render_and_parse(spark):
    found = []

    @settings(max_examples=25, deadline=None)
    @given(st.lists(EVENT, max_size=12))
    def collect(events):
        found.append(events)

    collect()
    events = [(100 * i + e[0], *e[1:]) for i, case in enumerate(found) for e in case]
    df = spark.createDataFrame(events, "conv_id long, seq long, message long, kind string, role string, text string")
    back = chat_format.parse(chat_format.format_chats(df.repartition(4)))
    want = fold_plain(events)
    got = {r.conv_id: r for r in back.collect()}
    assert {c: [tuple(t) for t in r.turns] for c, r in got.items()} == want
    assert {c: list(r.loss_texts) for c, r in got.items()} == {
        c: [t for r, t in turns if r == "assistant"] for c, turns in want.items()
    }
    assert chat_format.format_chats(df.limit(0)).count() == 0


# 4


def test_urls(spark):
    urls = [
        None, "", "nothing", "http://EXAMPLE.com/en/x", "http://www.example.com/en/x?y", "https://net/es/", "http://a.net/fr/b#c",
        "http://net.example/es/", "http://xcom/", "http://a.com", "http://a.org/ads/x", "http://a.org/reads/x",
        "http://ads.a.org/", "http://a.org/AD/", "http://a.org/x?ads", "http://a.net/ES/", "ftp://host:80/p://q", "http://a.net/es/",
    ]
    pages = [(i, u) for i, u in enumerate(urls)] + [(0, None), (3, urls[3])]
    df = spark.createDataFrame(pages, "page_id long, url string").withColumn("token", F.lit("x"))
    sites = {"com/": "allow", "example.com/en/": "block", "www.example.com/en/": "allow", "net/es/": "block", "net/fr/": "block"}

    def plain(url):
        m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
        host, path = (m[1].lower(), m[2]) if m else ("", "")
        fits = []
        for rule in sites:
            h, p = rule.split("/", 1)
            if (host == h or host.endswith("." + h)) and path.startswith("/" + p):
                fits.append(rule)
        words = set(re.split(r"[./_-]", (host + path).lower()))
        other = "block" if words & {r.tokens[0] for r in url_filter.WORDS} else "allow"
        best = max(fits, key=len, default=None)
        return host, path, best, sites.get(best, other)

    got = rows(url_filter.filter_urls(spark, df), "page_id", "host", "path", "rule", "verdict")
    assert got == sorted(((i, *plain(u)) for i, u in pages), key=repr)
    assert url_filter.filter_urls(spark, df.limit(0)).count() == 0


def test_a_hundred_thousand_rules(spark):
    """Rules as a table: few candidates a url, and verdicts as by walking up the hosts of each."""
    n = 100_000
    sites = spark.range(n).select(
        F.when(F.col("id") % 3 == 0, "allow").otherwise("block").alias("action"),
        F.concat(F.lit("Site"), "id", F.lit(".group"), F.col("id") % 50, F.lit(".com")).alias("host"),
        F.when(F.col("id") % 2 == 0, "/a.b/c").otherwise("").alias("path"),
    ).unionByName(spark.createDataFrame([(None, "x.com", ""), ("block", "x.com", None)], "action string, host string, path string"))
    rules = url_filter.site_rules(sites)
    rules = rules.unionByName(rules.limit(5)).withColumn("number", F.lit("x"))
    rules = rules.unionByName(spark.createDataFrame(
        [(None, "block", None, None, "x"), ("(?i)zzz", "block", None, [None], "x")], rules.select(
            "expression", "action", "site", "tokens", "number").schema
    ).select(*rules.columns))
    rng = random.Random(4)
    urls = [(i, f"http://{rng.choice(['', 'www.'])}site{k}.group{rng.choice([k % 50, 3])}.com{rng.choice(['', '/', '/a.b/cd', '/aXb/c', '/ZZZ'])}")
            for i, k in enumerate(rng.sample(range(n + 1000), 400))]

    def plain(url):
        host, _, path = url.removeprefix("http://").partition("/")
        path = "/" + path if "/" in url.removeprefix("http://") else ""
        number, group = map(int, re.findall(r"site(\d+)\.group(\d+)", host)[0])
        want = "/a.b/c" if number % 2 == 0 else ""
        if number < n and group == number % 50 and path.startswith(want):
            return f"site{number}.group{group}.com{want}", "allow" if number % 3 == 0 else "block"
        return None, "block" if "ZZZ" in path else "allow"

    df = spark.createDataFrame(urls, "page_id long, url string")
    got = rows(url_filter.filter_urls(spark, df, rules), "page_id", "rule", "verdict")
    assert got == sorted(((i, *plain(u)) for i, u in urls), key=repr)
    host, path = url_filter.split_url(F.col("url"))
    found = url_filter.candidates(spark, df.select("url", host.alias("host"), path.alias("path")), rules)
    assert found.count() <= 3 * len(urls)  # the rule of its number, the one without tokens, and what ties file elsewhere


# 5


def test_copies_are_one_trial(spark):
    """A labelled document that is listed a thousand times certifies nothing that one listing doesn't."""
    rng = random.Random(9)
    data = [(i, " ".join(["word"] * 6 + [f"w{rng.randrange(10**6)}" for _ in range(30)] + ["#" * (60 if i % 5 == 0 else 1)]), "en")
            for i in range(300)]
    labels = spark.createDataFrame([(i, int(i % 5 > 0)) for i, *_ in data], "doc_id long, quality int")
    once = spark.createDataFrame(data, "doc_id long, text string, lang string")
    often = spark.createDataFrame(data + [data[1]] * 1000 + [data[5]] * 1000, once.schema).repartition(4)
    names = ("doc_id", "rejected_by", "kept")
    single, many = (quality.judge(d, labels).select(*names).distinct() for d in (once, often))
    assert rows(single, *names) == rows(many, *names)
    assert quality.judge(often, labels).count() == 2300


def test_measures(docs):
    def plain(i, text):
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        grams = [tuple(words[k:k + 5]) for k in range(len(words) - 4)]
        seen = Counter(grams)
        inside = {k + j for k, g in enumerate(grams) if seen[g] > 1 for j in range(5)}
        lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        return (i, len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)),
                len(inside))

    got = rows(quality.measured(docs), "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    assert got == expected(plain)


def test_thresholds_keep_the_promise(spark):
    """Certified cutoffs reject few good documents, and none is certified without enough labels."""
    rng = random.Random(5)
    data = [(("en" if i % 3 else "xx"), i % 10 > 0, rng.random() * (0.3 if i % 10 else 1.0)) for i in range(6000)]
    data += [("few", True, 0.9), ("few", False, 0.9)]
    rule = quality.Rule("symbols", "x", quality.grid(0.0, 1.0, 50))
    df = spark.createDataFrame(data, "stratum string, good boolean, x double").withColumn("cells", quality.cells((rule,)))
    found = {r.stratum: r for r in quality.thresholds(df, 3, (rule,), risk=0.05, error=0.1).collect()}
    assert set(found) == {"en", "xx"}
    for s, r in found.items():
        good = [x for t, g, x in data if t == s and g]
        assert sum(x > r.cutoff for x in good) == r.rejected_good <= 0.05 * len(good)
        assert r.rejected_bad > 0.5 * r.bad


@pytest.mark.parametrize("n,k,p", [(50, 0, 0.05), (500, 12, 0.05), (20000, 150, 0.01)])
def test_binomial_tail(spark, n, k, p):
    import math
    want = sum(math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p)
                        + (n - i) * math.log(1 - p)) for i in range(k + 1))
    got = spark.range(1).select(quality.binomial_tail(F.lit(k).cast("long"), F.lit(n).cast("long"), p)).first()[0]
    assert got == pytest.approx(want, rel=1e-9)


# 6


def brute_spans(texts, length):
    seen = Counter(t[i:i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - length + 1):
            if seen[t[i:i + length]] > 1:
                gone[i:i + length] = True
        out.append(bytes(np.frombuffer(t, np.uint8)[~gone]))
    return out


@pytest.mark.parametrize("most", [4000, 1])
def test_substrings(spark, monkeypatch, most):
    monkeypatch.setattr(suffix_dedup, "KEY_ROWS", most)
    rng = random.Random(11)
    shared = ["".join(rng.choice("abcé") for _ in range(60)) for _ in range(4)]
    texts = [None, "", "short", "a" * 500, "ab" * 200]
    for _ in range(60):
        texts.append("".join(
            rng.choice(shared)[rng.randrange(20):] + "".join(rng.choice("xyz") for _ in range(rng.randrange(30)))
            for _ in range(rng.randrange(4))
        ))
    data = [(i, t) for i, t in enumerate(texts)] + [(7, texts[7]), (None, texts[8])]
    df = spark.createDataFrame(data, "doc_id long, text string")
    got = rows(suffix_dedup.dedup_substrings(df, 30, 17), "doc_id", "kept", "n_removed")
    raw = [(t or "").encode() for _, t in data]
    want = [(i, bytearray(k), len(t) - len(k)) for (i, _), t, k in zip(data, raw, brute_spans(raw, 30), strict=True)]
    assert got == sorted(want, key=repr)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("ab", min_size=1, max_size=25), min_size=1, max_size=9), st.integers(1, 3), st.integers(2, 9))
def test_merged_transforms(texts, shards, length):
    texts = [t.encode() for t in texts]
    parts = [texts[i::shards] for i in range(shards) if texts[i::shards]]
    given_, base = [], 0
    for p in parts:
        given_.append((suffix_dedup.transform(p), np.arange(base, base + len(p))))
        base += len(p)
    flat = [t for p in parts for t in p]
    seen = Counter(t[i:i + length] for t in flat for i in range(len(t) - length + 1))
    found = suffix_dedup.repeated_starts(given_, length)
    for i, t in enumerate(flat):
        assert found[i].tolist() == [len(t[k:k + length]) == length and seen[t[k:k + length]] > 1 for k in range(len(t))]


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text("ab", min_size=1, max_size=40), min_size=1, max_size=7), st.integers(1, 3))
def test_merged_order_and_common_prefixes(texts, shards):
    parts = [p for i in range(shards) if (p := [t.encode() for t in texts[i::shards]])]
    merge = suffix_dedup.Merge([suffix_dedup.transform(p) for p in parts])
    merge.refine(1000)
    # windows end in letters of their own, lower than any other and in the order of shards and windows
    flat = [[(1, c) for c in t] + [(0, i)] for i, t in enumerate(t for p in parts for t in p)]
    suffixes = sorted(t[i:] for t in flat for i in range(len(t)))
    want = [0] + [sum(1 for _ in itertools.takewhile(lambda p: p[0] == p[1], zip(a, b, strict=False)))
                  for a, b in itertools.pairwise(suffixes)]
    assert merge.common.tolist() == want
    assert (merge.sizes == 1).all()


# 7


def brute_lines(data, shortest=10):
    keys = {}
    for i, text in data:
        for line in (text or "").split("\n"):
            keys.setdefault(line.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)}), set()).add(i)

    def lost(i, line):
        k = line.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})
        first = min(keys[k], key=lambda x: (x is None, x))
        return len(k) >= shortest and len(keys[k]) > 1 and i != first

    return sorted(((
        i, "\n".join(x for x in (t or "").split("\n") if not lost(i, x)), len((t or "").split("\n")),
        sum(lost(i, x) for x in (t or "").split("\n")),
    ) for i, t in data), key=repr)


@pytest.mark.parametrize("group", [200_000, 1])
def test_lines_inserted_and_deleted(docs, spark, monkeypatch, group):
    monkeypatch.setattr(line_dedup, "GROUP_ROWS", group)  # with 1, all shared keys are frequent ones
    data = [d[:2] for d in DOCS]
    show = ("row.doc_id", "line_text", "n_lines", "n_dropped")
    index = line_dedup.LineIndex.build(docs)
    assert rows(index.apply(docs), *show) == brute_lines(data)
    more = [(20, "own first line here\nlast line"), (0, "Another beginning of this\nnew line of its own")]
    extra = spark.createDataFrame(more, "doc_id long, text string")
    both = docs.select("doc_id", "text").unionByName(extra)
    grown = index.insert(extra)
    assert rows(grown.apply(both), *show) == brute_lines(data + more)
    back = grown.delete(extra)
    assert rows(back.apply(docs), *show) == brute_lines(data)
    assert rows(back.counts, "hi", "lo", "refs", "owner", "last", "unnamed") == rows(
        index.counts, "hi", "lo", "refs", "owner", "last", "unnamed")
    fewer = back.delete(spark.createDataFrame([(1,), (99,)], "doc_id long"))
    assert rows(fewer.apply(docs.where("doc_id <> 1 or doc_id is null")), *show) == brute_lines([d for d in data if d[0] != 1])


def test_cuckoo_filter_grows_and_forgets():
    rng = np.random.default_rng(2)
    hi, lo = (rng.integers(0, 1 << 63, 5000, dtype=np.uint64) for _ in range(2))
    f = line_dedup.CuckooFilter(64)
    f.insert(hi, lo)
    f = line_dedup.CuckooFilter.load(f.dump())
    assert f.contains(hi, lo).all()
    f.delete(hi[:2500], lo[:2500])
    assert f.contains(hi[2500:], lo[2500:]).all()
    assert f.contains(hi[:2500], lo[:2500]).mean() < 0.05
    other = rng.integers(0, 1 << 63, 20000, dtype=np.uint64)
    assert f.contains(other, other[::-1]).mean() < 0.01


# 8


def test_folding_and_exceptions():
    model = toxicity.Model({f" {toxicity.fold_word(w)} ": 5.0 for w in ("idiot", "loser")} | {" iowei": 4.0},
                           frozenset({"sore ioser"}), -1.0, (1.0, 0.0, 0.0))
    for text in ("You IDIOT!", "an 1d10t", "іdіоt", "i.d.i.o.t", "idiooooot", "L0SER", "loweiten", "@ idi0t"):
        assert model.score(text) > 0.9, text
    for text in (None, "", "idiots" if False else "idio", "a sore loser", "1010 2020", "xlowei"):
        assert model.score(text) < 0.5, text
    assert model.score(LONG + " idiot") > 0.9


def fold_by_word(text):
    """Folding word by word, by the rules alone."""
    low = unicodedata.normalize("NFKC", text).lower().translate(toxicity.FOLD)
    low = toxicity.SPELT.sub(lambda m: re.sub(r"[.\-_*·]+", "", m[1]), low)
    return [toxicity.fold_word(w) for w in re.findall(r"[^\W_]+(?:[@$!|]+(?=[^\W_])[^\W_]+)*", low)]


def test_folding_whole_texts_equals_folding_words():
    codes = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = [" ".join(f"a{c}b {c}{c}{c}{c} 1{c}l {c}.{c}-x" for c in codes[i:i + 2000]) for i in range(0, len(codes), 2000)]
    rng = np.random.default_rng(8)
    letters = list("abl1i0$@!|._-*· \nlLéßжοсǅ%½²_³i")
    texts += ["".join(rng.choice(letters, n)) for n in rng.integers(0, 40, 20_000)]
    texts += ["", " ", "lll", "llli", "l1li", "a!!!b", "$$$", "@a@", "a$$$ b", "i.d.i.o.t", "\ud800a"]
    for text in texts:
        assert toxicity.fold(text) == fold_by_word(text)


def test_folding_costs_less_than_word_by_word():
    rng = np.random.default_rng(9)
    words = ["".join(rng.choice(list("abcdefghijklmnopéèü"), n)) for n in rng.integers(2, 9, 200_000)]
    texts = [" ".join(words[i:i + 500]) + "." for i in range(0, len(words), 500)]

    def seconds(fold):
        toxicity.fold_word.cache_clear()
        began = time.process_time()
        for text in texts:
            fold(text)
        return time.process_time() - began

    toxicity.fold("")
    assert min(seconds(toxicity.fold) for _ in range(3)) < 0.6 * min(seconds(fold_by_word) for _ in range(3))


def test_learning_folds_a_text_once(spark, monkeypatch):
    kept = []
    monkeypatch.setattr(toxicity, "stored", lambda df, keep=toxicity.stored: kept.append(keep(df)) or kept[-1])
    texts = [(i, f"You 1d1ot number{i}, goes!", 1) for i in range(20)] + [(100 + i, f"Lovely FRIEND{i}", 0) for i in range(30)]
    table = spark.createDataFrame(texts, "doc_id long, text string, toxic int")
    assert " idiot " in toxicity.learn(table, table).terms
    (table,) = kept
    assert sorted(r["words"] for r in table.collect()) == sorted(" " + " ".join(fold_by_word(t)) + " " for _, t, _ in texts)


def test_counts_end_early_only_above_the_limit(spark):
    texts = [(f" a b{i % 7} ccc{i % 3} ", i % 5 == 0) for i in range(2_000)]
    table = spark.createDataFrame(texts, "words string, toxic boolean").repartition(3)
    want = {}
    for words, toxic in texts:
        for term in toxicity.all_terms(words):
            want.setdefault(term, [0, 0])[not toxic] += 1
    for part in (0.0, 0.2, 0.7, 1.0):
        most = {t: int(part * clean) for t, (_, clean) in want.items()} | {" never": 3}
        got = {r["term"]: [r["toxic"], r["clean"]] for r in toxicity._counted_up_to(table, most).collect()}
        assert set(got) == set(want)
        for term, (toxic, clean) in got.items():
            assert [toxic, clean] == want[term] or clean > most[term] and toxic <= want[term][0], term


def test_held_out_accuracy(spark):
    data = "/root/testdata/sf0.1"
    scored = queries.op8_toxicity(spark, data).join(queries.table(spark, data, "labels"), "doc_id").where("held_out")
    n = {(r.toxic, r.predicted): r["count"] for r in scored.groupBy("toxic", "predicted").count().collect()}
    assert n[1, 1] / (n[1, 1] + n.get((1, 0), 0)) > 0.9
    assert n.get((0, 1), 0) / (n[0, 0] + n.get((0, 1), 0)) < 0.02


def test_learning_without_labels(docs, spark):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.learn(docs, none)
    assert model.terms == {} and 0 <= model.score("idiot") < 0.5


def test_a_language_with_few_toxic_labels_has_terms(spark):
    texts = [(i, f"you idiot number{i} goes there", 1) for i in range(1000)]
    texts += [(1000 + i, f"ty zlobivec cislo{i} bezi tam", 1) for i in range(9)]
    texts += [(2000 + i, f"you friend number{i} goes there", 0) for i in range(2000)]
    texts += [(5000 + i, f"ty kamarad cislo{i} bezi tam", 0) for i in range(1000)]
    table = spark.createDataFrame(texts, "doc_id long, text string, toxic int")
    model = toxicity.learn(table, table)
    for text in ("ten zlobivec tam bezi", "an idiot goes"):
        assert model.score(text) > 0.5, text
    for text in ("ten kamarad tam bezi", "a friend goes"):
        assert model.score(text) < 0.5, text


def test_copies_of_a_labelled_document_count_once(spark):
    texts = [(i, f"you idiot number{i} goes there", 1) for i in range(40)]
    texts += [(100 + i, f"you friend number{i} goes there {'idiot' if i < 3 else ''}", 0) for i in range(60)]
    table = spark.createDataFrame(texts, "doc_id long, text string, toxic int")
    copied = table.withColumn("k", F.explode(F.sequence(F.lit(1), F.when(F.col("doc_id") == 100, 500).otherwise(1))))
    once, often = toxicity.learn(table, table), toxicity.learn(copied, table)
    assert once.terms == often.terms and once.exceptions == often.exceptions
    assert (once.intercept, *once.factors) == pytest.approx((often.intercept, *often.factors))


# 9


@pytest.fixture(scope="module")
def tokenizers_pair():
    path = public_tokenizers.path("word_bpe_49k.json")
    reference = Reference.from_file(path)
    reference.no_truncation()
    reference.no_padding()
    return bpe.Tokenizer(path), reference


def test_encoding_of_the_tables_and_odd_texts(tokenizers_pair):
    own, reference = tokenizers_pair
    texts = pd.read_parquet("/root/testdata/sf0.01/documents.parquet").text.fillna("").tolist()
    texts += [t or "" for _, t, *_ in DOCS]
    texts += ["it's we'll 'S", "a<|endoftext|>b <|startoftext|>", "ΑΣ ΟΔΟΣ", "İstanbul", "x</w>y", "\x00\x01\x1c\x85", "½ ² ǅ ſ K Å"]
    ids = own.encode(texts)
    want = reference.encode_batch(texts, add_special_tokens=False)
    assert [np.frombuffer(x, "<u4").tolist() for x in ids] == [x.ids for x in want]
    assert [own.decode(x) for x in ids] == [reference.decode(x.ids, skip_special_tokens=False) for x in want]


@settings(max_examples=300, deadline=None)
@given(st.text(st.characters(max_codepoint=0x24F), max_size=60))
def test_encoding_of_any_text(tokenizers_pair, text):
    own, reference = tokenizers_pair
    want = reference.encode(text, add_special_tokens=False)
    assert np.frombuffer(own.encode([text])[0], "<u4").tolist() == want.ids


# 10


def test_phrases(docs, spark):
    items = [
        (1, PASSAGE), (2, "shared3 words of a passage shared4 words of a passage shared5 gone"), (3, None), (4, ""), (5, "THREE four"),
        (6, "one"), (1, PASSAGE), (7, "ünïcödé äöü"), (8, "never seen at all"), (None, "alpha0"),
    ]
    table = spark.createDataFrame(items, "item_id long, text string").withColumn("window", F.lit(1))
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

    def split(text):
        return word.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))

    wins = {}
    for i, text in items:
        w = split(text)
        for k in range(max(1, len(w) - 9)) if w else ():
            wins.setdefault(tuple(w[k:k + 10]), set()).add("" if i is None else str(i))

    def plain(i, text):
        w = split(text)
        inside, found = set(), set()
        for n in {len(x) for x in wins}:
            for k in range(len(w) - n + 1):
                if (own := wins.get(tuple(w[k:k + n]))) is not None:
                    inside |= set(range(k, k + n))
                    found |= own
        return i, len(w), len(inside), sorted(found), bool(inside)

    index = decontaminate.Index(docs, table)
    assert rows(index.report(), "doc_id", "n_words", "n_hit", "items", "contaminated") == expected(plain)
    near = {(r.doc_id, r.window) for r in index.near(2).collect()}
    assert (7, "three four") in near and not any(w.startswith("never") for _, w in near)


# the pipeline and the registered queries


def test_stages(spark, tmp_path, docs):
    toxic = [(100 + i, f"word{i} you idiot and loser {i} more{i} text{i}", "en", "a", 1) for i in range(30)]
    clean = [(200 + i, f"calm{i} sentence about river{i} and hill{i} today", "en", "a", 1) for i in range(60)]
    hit = [(300, "before " + PASSAGE, "en", "a", 1)]
    twins = [(400 + i, " ".join(f"twin{k}" for k in range(200 + i)), "en", "a", 1) for i in range(3)]
    table = spark.createDataFrame(toxic + clean + hit + twins, SCHEMA)
    table.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i < 200)) for i, *_ in toxic[:20] + clean], "doc_id long, quality int, toxic int").write.parquet(
        f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, PASSAGE)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "simhash_near_dedup", "decontamination", "bpe"]
    out = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert set(out) == {i for i, *_ in clean} | {400}
    own, texts = bpe.tokenizer(public_tokenizers.path("word_bpe_49k.json")), dict(d[:2] for d in clean)
    assert bytes(out[200].ids) == own.encode([texts[200]])[0] and out[200].n_tokens == len(out[200].ids) // 4
    (tmp_path / "odd").mkdir()
    stage_docs = docs.unionByName(table)
    for _, stage in corpus_pipeline.STAGES[:-1]:  # nulls, empty texts and repeated rows go through every stage
        got = stage(spark, stage_docs, str(tmp_path))
        assert got.columns == stage_docs.columns and got.count() > 0
        assert stage(spark, stage_docs.limit(0), str(tmp_path)).count() == 0
    assert corpus_pipeline.encode(spark, stage_docs, str(tmp_path)).count() == stage_docs.count()


def test_every_query_is_registered():
    import __spark_entry__ as entry

    assert set(queries.QUERIES) | {"pipeline"} <= set(entry.queries())
    assert set(oracle.SQL) <= set(queries.QUERIES)
    assert [q.split("_")[0] for q in queries.QUERIES] == [f"op{i}" for i in range(1, 14)]
