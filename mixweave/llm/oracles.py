"""DuckDB SQL for the corpus queries that SQL can express, written apart from the Spark code."""

from __future__ import annotations

#: Which five bits of four base-32 characters stand in twenty bits, as divisors (fixed values).
FIVES = (32768, 1024, 32, 1)


def base32_sql(digest: str) -> str:
    chars = (f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST((CAST('0x' || substr({digest}, {5 * g + 1}, 5) AS BIGINT) // {d}) % 32 AS INT), 1)" for g in range(8) for d in FIVES)
    return " || ".join(chars)


OP4 = f"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
d AS (SELECT page_id, CAST(octet_length(body) AS BIGINT) AS payload_bytes, sha1(body) AS h, sha256(body) AS k FROM p),
w AS (SELECT *, max(page_id) OVER (PARTITION BY k) AS top FROM d)
SELECT page_id, payload_bytes, {base32_sql('h')} AS payload_digest,
       CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> top THEN top END AS refers_to
FROM w
"""

OP9 = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS t FROM documents),
ws AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words FROM d),
w AS (SELECT rid, unnest(words) AS w, generate_subscripts(words, 1) AS i FROM ws),
tri AS (SELECT rid, i, w AS a, lead(w, 1) OVER q AS b, lead(w, 2) OVER q AS c FROM w WINDOW q AS (PARTITION BY rid ORDER BY i)),
rep AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, a, b, c) AS n FROM tri WHERE c IS NOT NULL) WHERE n >= 2),
cov AS (SELECT rid, count(DISTINCT i + k) AS n FROM rep, (VALUES (0), (1), (2)) AS o(k) GROUP BY rid),
ln AS (SELECT rid, unnest(string_split(t, chr(10))) AS line FROM d),
dup AS (SELECT rid, count(*) AS lines, count(*) - count(DISTINCT line) AS n FROM ln WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY rid),
m AS (SELECT ws.rid, doc_id, source, CAST(len(words) AS BIGINT) AS n_words,
        CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
        CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
        CAST(coalesce(dup.lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(dup.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words
      FROM ws LEFT JOIN cov ON ws.rid = cov.rid LEFT JOIN dup ON ws.rid = dup.rid),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m),
f AS (SELECT *, base_failed OR 100 * n_symbols > 25 * word_chars OR 100 * n_dup_lines > 30 * n_lines OR word_chars < 3 * n_words OR word_chars > 10 * n_words AS rule_failed FROM b),
h AS (SELECT source, count(*) AS n, sum(CASE WHEN rule_failed THEN 1 ELSE 0 END) AS bad FROM f GROUP BY source),
p AS (SELECT avg(bad / n) AS mean, var_pop(bad / n) - avg(bad / n) * (1 - avg(bad / n)) * avg(1.0 / n) AS between_hosts FROM h),
s AS (SELECT mean, CASE WHEN between_hosts > 0 THEN least(greatest(mean * (1 - mean) / between_hosts - 1, 0), 1000) ELSE 1000 END AS weight FROM p),
r AS (SELECT source, (bad + mean * weight) / (n + weight) AS rate, mean - 0.1 * sqrt(mean * (1 - mean) / (weight + 1)) AS trusted_below FROM h, s),
v AS (SELECT *, CASE WHEN rate > 0.5 THEN 'rejected' WHEN rate <= 0.02 OR rate < trusted_below THEN 'trusted' ELSE 'normal' END AS host_verdict FROM r)
SELECT doc_id, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, base_failed, rule_failed, round(rate, 6) AS host_rate, host_verdict,
       NOT base_failed AND host_verdict <> 'rejected' AND (NOT rule_failed OR host_verdict = 'trusted') AS kept
FROM f JOIN v ON f.source IS NOT DISTINCT FROM v.source
"""


def op6(events: tuple[tuple[str, ...], ...], listed_from: str, listed_days: int, start: str, days: int) -> str:
    rows = ", ".join("(" + ", ".join(f"'{x}'" for x in e) + ")" for e in events)
    return f"""
WITH hosts AS (SELECT key, CAST('0x' || substr(md5(key), 1, 6) AS BIGINT) AS h FROM (SELECT DISTINCT lower(regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1)) AS key FROM pages) WHERE key <> ''),
e AS (SELECT list_name, kind, key, action, CAST(day AS TIMESTAMP) AS ts FROM (VALUES {rows}) AS v(list_name, kind, key, action, day)
    UNION ALL SELECT 'hosts', 'domain', key, CASE WHEN j % 2 = 0 THEN 'add' ELSE 'remove' END, TIMESTAMP '{listed_from}' + to_days(CAST((h + j * 97) % {listed_days} AS INT))
    FROM hosts, range(5) AS n(j) WHERE h % 3 = 0 AND j <= h // 3 % 5),
c AS (SELECT page_id, url, TIMESTAMP '{start}' + to_days(CAST(page_id % {days} AS INT)) AS t,
        lower(regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1)) AS host, lower(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1)) AS path FROM pages),
s AS (SELECT *, string_split(host, '.') AS labels, list_filter(string_split(path, '/'), lambda x: x <> '') AS steps FROM c),
k AS (SELECT page_id, t, 'domain' AS kind, unnest([array_to_string(labels[i:], '.') for i in range(1, len(labels) + 1)]) AS key FROM s
    UNION ALL SELECT page_id, t, 'prefix', unnest([host || '/' || array_to_string(steps[1:i], '/') for i in range(1, len(steps) + 1)]) FROM s),
last AS (SELECT page_id, list_name, kind, key, arg_max(action, ts) AS state FROM k JOIN e USING (kind, key) WHERE ts <= t GROUP BY ALL),
hit AS (SELECT page_id, count(*) AS n, string_agg(DISTINCT list_name, ',' ORDER BY list_name) AS lists FROM last WHERE state = 'add' GROUP BY page_id)
SELECT c.page_id, n IS NOT NULL AS blocked, coalesce(n, 0) AS n_entries, coalesce(lists, '') AS lists FROM c LEFT JOIN hit USING (page_id)
"""


OP12 = """
WITH v AS (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS q FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.rid AS arid, a.vec_id AS query_id, b.rid AS brid, b.vec_id AS vec_id, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score FROM v a JOIN v b ON a.rid <> b.rid WHERE a.vec_id % 50 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY arid ORDER BY score DESC, vec_id, brid) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""

OP13 = r"""
WITH d AS (SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
w AS (SELECT rid, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term FROM w GROUP BY lang, term HAVING count(DISTINCT rid) >= 30),
vs AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
c AS (SELECT lang, source, term, count(*) AS n FROM w JOIN kept USING (lang, term) GROUP BY ALL),
g AS (SELECT DISTINCT lang, source FROM d),
t AS (SELECT lang, source, sum(n) AS total FROM c GROUP BY lang, source),
f AS (SELECT g.lang, g.source, kept.term, coalesce(c.n, 0) AS n, CAST(1 + (CAST(1000000000 AS HUGEINT) * (coalesce(c.n, 0) + 5)) // (coalesce(t.total, 0) + 5 * v) AS BIGINT) AS p
    FROM g JOIN kept USING (lang) JOIN vs USING (lang) LEFT JOIN t ON t.lang = g.lang AND t.source = g.source LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = kept.term),
o AS (SELECT lang, term, CAST(1 + (CAST(1000000000 AS HUGEINT) * (sum(n) + 5)) // (sum(sum(n)) OVER (PARTITION BY lang) + 5 * count(*) OVER (PARTITION BY lang)) AS BIGINT) AS q FROM f GROUP BY lang, term),
apart AS (SELECT a.lang, a.source, b.source AS item, CAST(sum(abs(a.p - b.p)) AS BIGINT) AS value FROM f a JOIN f b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce(value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN apart ON apart.lang = a.lang AND apart.source = a.source AND apart.item = b.source),
terms AS (SELECT lang, source, term AS item, p - q AS value FROM f JOIN o USING (lang, term) WHERE n > 0 AND p > q),
ranked AS (SELECT *, 'pair' AS part, CAST(row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS INTEGER) AS rank FROM pairs
    UNION ALL SELECT *, 'term', CAST(row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS INTEGER) FROM terms)
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 50
"""
