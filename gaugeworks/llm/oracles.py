"""DuckDB SQL of the URL filter, hard-negative mining and ranked search, written from their rules."""

from __future__ import annotations

_ASCII = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
_TERMS = rf"unnest(regexp_extract_all(translate(text, {_ASCII}), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'))"

LEXICAL = f"""
WITH words AS (SELECT doc_id, {_TERMS} AS t FROM documents),
wanted AS (SELECT DISTINCT item_id, {_TERMS} AS t FROM benchmark),
sizes AS (SELECT doc_id, count(*) AS n FROM words GROUP BY doc_id),
total AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM sizes),
tfs AS (SELECT doc_id, t, count(*) AS tf FROM words SEMI JOIN wanted USING (t) GROUP BY doc_id, t),
weights AS (
    SELECT t, CAST(floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w
    FROM tfs, total GROUP BY t),
gains AS (
    SELECT doc_id, t, w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * docs) // terms))) AS gain
    FROM tfs JOIN sizes USING (doc_id) JOIN weights USING (t), total),
scores AS (SELECT item_id, doc_id, CAST(sum(gain) AS BIGINT) AS score FROM wanted JOIN gains USING (t) GROUP BY item_id, doc_id)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM scores WHERE score > 0
QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 50"""

HARD_NEGATIVES = """
WITH v AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
           list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
    FROM embeddings WHERE label IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
scored AS (
    SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same,
           CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2])) AS BIGINT) AS score
    FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id AND len(a.q) = len(b.q)),
positives AS (
    SELECT anchor_id, other AS positive_id, score AS positive_score FROM scored WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5)
SELECT p.anchor_id, positive_id,
       CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, other) AS INTEGER) AS rank,
       other AS negative_id, positive_score, score AS negative_score
FROM positives p JOIN scored s ON p.anchor_id = s.anchor_id AND NOT same
     AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, other) <= 10"""

# The longest rule first.
_RULES = [("example.org/en/1", "block"), ("example.org/es/", "block"), ("com/fr/", "allow"), ("com/de/", "block"), ("org/", "allow")]


def _first_rule(give) -> str:
    whens = []
    for rule, verdict in _RULES:
        host, path = rule.split("/", 1)
        whens.append(f"WHEN (host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '/{path}') THEN '{give(rule, verdict)}'")
    return f"CASE {' '.join(whens)} END"


def _level(j: int) -> str:
    """Probabilities of the grams with ``j`` characters of context, from those with one less."""
    back_a, back_r = ("b.pa", "b.pr") if j else ("(1.0::DOUBLE / 256)",) * 2
    shorter = f"JOIN p{j - 1} b ON b.gram = substr(g.gram, 2)" if j else ""
    return f"""
p{j} AS (
    SELECT g.gram, CASE WHEN na > 0 THEN (ca + ta * {back_a}) / (na + ta) ELSE {back_a} END AS pa,
           CASE WHEN nr > 0 THEN (cr + tr * {back_r}) / (nr + tr) ELSE {back_r} END AS pr
    FROM grams g JOIN totals t ON g.level = t.level AND g.context = t.context {shorter}
    WHERE g.level = {j})"""


URL_FILTER = f"""
WITH cutting AS (
    SELECT page_id, url, position('://' IN url) AS mark, CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) END AS rest
    FROM pages),
named AS (SELECT *, coalesce(regexp_extract(rest, '^[^/?#]*'), '') AS raw FROM cutting),
judged AS (
    SELECT page_id, translate(raw, {_ASCII}) AS host, coalesce(regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*'), '') AS path,
           coalesce(CASE WHEN rest IS NULL THEN url ELSE left(url, CAST(mark + 2 AS INTEGER)) || translate(raw, {_ASCII}) || substr(rest, length(raw) + 1) END,
                    '') AS text
    FROM named),
ruled AS (SELECT *, {_first_rule(lambda rule, verdict: rule)} AS rule, {_first_rule(lambda rule, verdict: verdict)} AS ruling FROM judged),
texts AS (
    SELECT text, CASE any_value(ruling) WHEN 'allow' THEN 1 WHEN 'block' THEN 0 END AS side, substr(md5(text), 1, 1) IN ('0', '1', '2') AS checks
    FROM ruled GROUP BY text),
cut AS (
    SELECT text, side, checks, substr(repeat(chr(2), 5) || text || chr(3), i, 6) AS win
    FROM (SELECT *, unnest(generate_series(1, length(text) + 1)) AS i FROM texts)),
seen AS (SELECT win, count(*) FILTER (side = 1 AND NOT checks) AS a, count(*) FILTER (side = 0 AND NOT checks) AS r FROM cut GROUP BY win),
grams AS (
    SELECT level, gram, left(gram, CAST(level AS INTEGER)) AS context, CAST(sum(a) AS BIGINT) AS ca, CAST(sum(r) AS BIGINT) AS cr
    FROM (SELECT a, r, level, right(win, CAST(level + 1 AS INTEGER)) AS gram FROM (SELECT *, unnest(generate_series(0, 5)) AS level FROM seen)) GROUP BY ALL),
totals AS (
    SELECT level, context, CAST(sum(ca) AS BIGINT) AS na, CAST(sum(cr) AS BIGINT) AS nr, count(*) FILTER (ca > 0) AS ta, count(*) FILTER (cr > 0) AS tr
    FROM grams GROUP BY level, context),{",".join(_level(j) for j in range(6))},
scores AS (
    SELECT text, any_value(side) AS side, any_value(checks) AS checks,
           CAST(floor(sum(CAST(floor(1000000.0::DOUBLE * (ln(pa) - ln(pr)) + 0.5) AS BIGINT))::DOUBLE / count(*)) AS BIGINT) AS score
    FROM cut JOIN p5 ON p5.gram = cut.win GROUP BY text),
bins AS (
    SELECT bin, count(*) FILTER (side = 1) AS a, count(*) FILTER (side = 0) AS r
    FROM (SELECT side, floor(score::DOUBLE / 1000) AS bin FROM scores WHERE checks AND side IS NOT NULL) GROUP BY bin),
marks AS (SELECT bin, a, r FROM bins UNION ALL SELECT 1e18, 0, 0),
quality AS (
    SELECT greatest(least(0, bin), lag(bin) OVER (ORDER BY bin) + 1) AS bin, (SELECT sum(a) FROM bins) AS all_a, (SELECT sum(r) FROM bins) AS all_r,
           sum(a) OVER (ORDER BY bin DESC) AS above, sum(r) OVER (ORDER BY bin) - r AS under FROM marks),
least AS (
    SELECT coalesce(arg_min(bin, (-(above * all_r + under * all_a), abs(bin), bin)), 0) * 1000 AS score
    FROM quality WHERE all_a > 0 AND all_r > 0)
SELECT page_id, host, path, rule, coalesce(ruling, CASE WHEN s.score >= (SELECT score FROM least) THEN 'allow' ELSE 'block' END) AS verdict
FROM ruled JOIN scores s USING (text)"""
