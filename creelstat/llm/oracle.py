"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from . import quality, url_filter

WORDS = r"'[^\x20\x09-\x0D]+'"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _chat() -> str:
    def escaped(x: str) -> str:
        out = rf"replace({x}, '\', '\\')"
        for mark in ("<turn>", "<text>", "</turn>"):
            out = rf"replace({out}, '{mark}', '<\{mark[1:]}')"
        return out

    return rf"""
WITH t AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT * FROM (VALUES
        (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok'))
)
SELECT conv_id, count(*) AS n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
    coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), ''))
        AS loss_sha256,
    sum(length('<turn><text></turn>') + 1 + length({escaped('role')}) + length({escaped('text')}))::BIGINT
        AS formatted_chars
FROM t GROUP BY conv_id
"""


def _urls() -> str:
    lower = "translate(regexp_extract(url, p, 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    words = "|".join(r.tokens[0] for r in url_filter.WORDS)
    return rf"""
WITH parts AS (
    SELECT page_id, coalesce({lower}, '') AS host, coalesce(regexp_extract(url, p, 2), '') AS path
    FROM pages, (SELECT '(?s)^.*?://([^/?#]*)([^?#]*)' AS p)
),
rules(action, rhost, rpath) AS (VALUES
    ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'),
    ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
fits AS (
    SELECT DISTINCT host, path, rhost || rpath AS rule, action
    FROM (SELECT DISTINCT host, path FROM parts), rules
    WHERE (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
),
best AS (
    SELECT host, path, rule, action FROM fits
    QUALIFY row_number() OVER (PARTITION BY host, path ORDER BY length(rule) DESC, action = 'block' DESC, rule DESC) = 1
)
SELECT page_id, p.host, p.path, b.rule,
    coalesce(b.action, CASE WHEN regexp_matches(p.host || p.path, '(?i)(^|[./_-])({words})([./_-]|$)')
        THEN 'block' ELSE 'allow' END) AS verdict
FROM parts p LEFT JOIN best b ON p.host = b.host AND p.path = b.path
"""


def _quality(risk: float = 0.05, error: float = 0.1) -> str:
    rules = quality.RULES
    share = risk / len(rules)
    cells = " UNION ALL ".join(
        f"SELECT rid, stratum, good, {_quoted(r.name)} AS rule, {len(r.cutoffs)} AS steps, "
        f"len(list_filter([{', '.join(map(repr, r.cutoffs))}]::DOUBLE[], lambda c: {r.measure} > c)) AS cell FROM frame"
        for r in rules
    )
    return rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text, lang FROM documents),
w AS (SELECT rid, regexp_extract_all(text, {WORDS}) AS w FROM d),
win AS (
    SELECT rid, i, array_to_string(w[i:i + 4], ' ') AS win
    FROM (SELECT rid, w, unnest(generate_series(1, len(w) - 4)) AS i FROM w)
),
again AS (SELECT rid, unnest(list(i)) AS i FROM win GROUP BY rid, win HAVING count(*) > 1),
covered AS (
    SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, i + unnest([0, 1, 2, 3, 4]) AS p FROM again) GROUP BY rid
),
lines AS (
    SELECT rid, count(*) - count(DISTINCT line) AS n
    FROM (SELECT rid, unnest(string_split(text, chr(10))) AS line FROM d)
    WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY rid
),
base AS (
    SELECT rid, doc_id, coalesce(lang, chr(0)) AS stratum, len(w) AS n_words,
        length(array_to_string(w, ''))::BIGINT AS word_chars,
        length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
        coalesce(lines.n, 0)::BIGINT AS n_dup_lines, coalesce(covered.n, 0)::BIGINT AS n_repeat_words
    FROM d JOIN w USING (rid) LEFT JOIN lines USING (rid) LEFT JOIN covered USING (rid)
),
judged AS (
    SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM base
),
known AS (
    SELECT doc_id, max(quality) > 0 AS good FROM labels WHERE quality IS NOT NULL GROUP BY doc_id
),
frame AS (SELECT j.*, good FROM judged j LEFT JOIN known USING (doc_id)),
cells AS ({cells}),
counts AS (
    SELECT stratum, rule, steps, cell, count(*) FILTER (good) AS g, count(*) FILTER (NOT good) AS b
    FROM cells JOIN judged USING (rid, stratum) WHERE good IS NOT NULL AND NOT base_failed GROUP BY ALL
),
grids AS (
    SELECT stratum, rule, unnest(generate_series(1, max(steps))) AS cell, sum(g) AS good, sum(b) AS bad
    FROM counts GROUP BY stratum, rule
),
above AS (
    SELECT x.stratum, x.rule, x.cell, any_value(good) AS good, any_value(bad) AS bad,
        coalesce(sum(g), 0) AS k, coalesce(sum(b), 0) AS kb
    FROM grids x LEFT JOIN counts c ON x.stratum = c.stratum AND x.rule = c.rule AND c.cell >= x.cell
    GROUP BY x.stratum, x.rule, x.cell
),
tails AS (
    SELECT *, CASE WHEN k >= good * {share!r} THEN 1.0 ELSE list_sum(list_transform(
        generate_series(0, k::BIGINT),
        lambda i: exp(lgamma(good + 1) - lgamma(i + 1) - lgamma(good - i + 1)
            + i * ln({share!r}) + (good - i) * ln(1 - {share!r})))) END AS tail
    FROM above
),
held AS (
    SELECT *, min((tail <= {error!r} / (
        (SELECT count(DISTINCT stratum) FROM base) * {len(rules)}))::INT)
        OVER (PARTITION BY stratum, rule ORDER BY cell DESC) AS held
    FROM tails
),
best AS (
    SELECT stratum, rule, cell AS first_cell FROM held WHERE held = 1 AND kb / greatest(bad, 1) > k / greatest(good, 1)
    QUALIFY row_number() OVER (PARTITION BY stratum, rule
        ORDER BY kb / greatest(bad, 1) - k / greatest(good, 1) DESC, cell DESC) = 1
),
hits AS (SELECT DISTINCT rid FROM cells JOIN best USING (stratum, rule) WHERE cell >= first_cell)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    NOT base_failed AND rid NOT IN (SELECT rid FROM hits) AS kept
FROM judged
"""


def _decontamination() -> str:
    words = (
        "regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
        r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    )
    return rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce({words}, []) AS w FROM documents),
b AS (SELECT coalesce(item_id::VARCHAR, '') AS item, {words} AS w FROM benchmark),
win AS (
    SELECT DISTINCT item, array_to_string(w[i:i + 9], ' ') AS win, least(len(w), 10) AS n
    FROM (SELECT item, w, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS i FROM b WHERE len(w) > 0)
),
sizes AS (SELECT DISTINCT n FROM win),
places AS (
    SELECT rid, n, i, array_to_string(w[i:i + n - 1], ' ') AS win
    FROM (SELECT rid, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM d, sizes)
),
hits AS (SELECT rid, item, n, i FROM places JOIN win USING (win, n)),
covered AS (
    SELECT rid, count(DISTINCT p) AS n FROM (
        SELECT rid, unnest(generate_series(i, i + n - 1)) AS p FROM (SELECT DISTINCT rid, i, n FROM hits)) GROUP BY rid
),
items AS (
    SELECT rid, count(DISTINCT item) AS n, string_agg(item, ',' ORDER BY item) AS s
    FROM (SELECT DISTINCT rid, item FROM hits) GROUP BY rid
)
SELECT doc_id, len(w) AS n_words, coalesce(c.n, 0) AS n_hit, coalesce(x.n, 0) AS n_items,
    sha256(coalesce(s, '')) AS items_sha256, coalesce(c.n, 0) > 0 AS contaminated
FROM d LEFT JOIN covered c USING (rid) LEFT JOIN items x USING (rid)
"""


def _lines() -> str:
    return r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
lines AS (
    SELECT rid, doc_id, i, l[i] AS line, translate(regexp_replace(l[i],
        '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
    FROM (SELECT rid, doc_id, l, unnest(generate_series(1, len(l))) AS i FROM d)
),
keys AS (
    SELECT key, min(doc_id) AS owner FROM lines WHERE length(key) >= 10 GROUP BY key
    HAVING count(DISTINCT doc_id) + count(DISTINCT CASE WHEN doc_id IS NULL THEN 1 END) > 1
),
marked AS (
    SELECT l.*, k.key IS NOT NULL AND l.doc_id IS DISTINCT FROM k.owner AS dropped
    FROM lines l LEFT JOIN keys k ON l.key = k.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped,
    sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY rid, doc_id
"""


def _divergence() -> str:
    p = "(1 + (1000000000::HUGEINT * ({n} + 5)) // greatest({total} + 5 * v, 1))::BIGINT"
    return rf"""
WITH d AS (
    SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
        regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w
    FROM documents
),
w AS (SELECT rid, lang, source, unnest(w) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS n FROM w GROUP BY lang, term HAVING count(DISTINCT rid) >= 30),
langs AS (SELECT lang, count(*) AS v, sum(n) AS total FROM kept GROUP BY lang),
counts AS (SELECT lang, source, term, count(*) AS n FROM w JOIN kept k USING (lang, term) GROUP BY lang, source, term),
groups AS (
    SELECT lang, source, coalesce(sum(n), 0) AS total
    FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN counts USING (lang, source) GROUP BY lang, source
),
cells AS (
    SELECT lang, source, term, coalesce(c.n, 0) AS n, {p.format(n="coalesce(c.n, 0)", total="g.total")} AS p,
        {p.format(n="k.n", total="l.total")} AS q
    FROM groups g JOIN kept k USING (lang) JOIN langs l USING (lang) LEFT JOIN counts c USING (lang, source, term)
),
found AS (
    SELECT g.lang, g.source, 'pair' AS part, h.source AS item, coalesce(x.value, 0)::BIGINT AS value
    FROM groups g JOIN groups h ON g.lang = h.lang AND g.source <> h.source LEFT JOIN (
        SELECT a.lang, a.source, b.source AS other, sum(abs(a.p - b.p)) AS value
        FROM cells a JOIN cells b USING (lang, term) GROUP BY ALL) x
        ON g.lang = x.lang AND g.source = x.source AND h.source = x.other
    UNION ALL
    SELECT lang, source, 'term', term, p - q FROM cells WHERE n > 0 AND p > q
)
SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM found
QUALIFY part = 'pair' OR rank <= 50
"""


def _topk() -> str:
    return """
WITH v AS (
    SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
    FROM embeddings WHERE len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
)
SELECT q.vec_id AS query_id, x.vec_id, list_inner_product(q.v, x.v)::BIGINT AS score,
    (row_number() OVER (PARTITION BY q.rid ORDER BY list_inner_product(q.v, x.v) DESC, x.vec_id))::INTEGER AS rank
FROM v q JOIN v x ON q.vec_id % 50 = 0 AND q.rid <> x.rid QUALIFY rank <= 5
"""


SQL: dict[str, str] = {
    "op3_chat_format": _chat(),
    "op4_url_filter": _urls(),
    "op5_quality_rules": _quality(),
    "op7_line_dedup": _lines(),
    "op10_decontamination": _decontamination(),
    "op11_source_divergence": _divergence(),
    "op13_topk_search": _topk(),
}
