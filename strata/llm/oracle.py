"""DuckDB twins of the queries that SQL can express."""

from __future__ import annotations

from .license_scan import MIN_SHARE, TEMPLATES
from .mixing import SEED
from .quality import GRIDS
from .url_rules import RULES

WORD = r"[^\x20\x09-\x0D]+"

_TESTS = sum(len(g) for g in GRIDS.values())
_RISK = 0.05 / len(GRIDS)
_GRID_ROWS = ", ".join(f"('{m}', CAST({c} AS DOUBLE))" for m, g in GRIDS.items() for c in g)

OP1_CTES = rf"""
w AS (SELECT doc_id, lang, text, regexp_extract_all(coalesce(text, ''), '{WORD}') AS ws FROM documents),
win AS (SELECT doc_id, i, ws[i] AS a, ws[i + 1] AS b, ws[i + 2] AS c
        FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) > 3)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM win) WHERE n > 1),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words
            FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM twice) GROUP BY doc_id),
base AS (
  SELECT w.doc_id, lang, len(ws) AS n_words,
         CAST(length(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(coalesce(text, '')) - length(regexp_replace(coalesce(text, ''), '[#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls,
         coalesce(n_repeat_words, 0) AS n_repeat_words
  FROM w LEFT JOIN covered ON w.doc_id = covered.doc_id),
stats AS (
  SELECT *, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, len(ls) AS n_lines,
         n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM base),
m AS (
  SELECT doc_id, lang, base_failed, unnest(['symbols_per_word', 'dup_line_share', 'repeat_share', 'word_length']) AS measure,
         unnest([CASE WHEN n_words > 0 THEN n_symbols / n_words ELSE 0 END, CASE WHEN n_lines > 0 THEN n_dup_lines / n_lines ELSE 0 END,
                 CASE WHEN n_words > 0 THEN n_repeat_words / n_words ELSE 0 END, CASE WHEN n_words > 0 THEN word_chars / n_words ELSE 0 END]) AS v
  FROM stats),
good AS (SELECT doc_id FROM labels WHERE quality IS NOT NULL GROUP BY doc_id HAVING min(quality) = 1),
grid(measure, cutoff) AS (VALUES {_GRID_ROWS}),
calib AS (SELECT m.lang, m.measure, m.v FROM m JOIN good ON m.doc_id = good.doc_id WHERE NOT base_failed),
counts AS (SELECT c.lang, g.measure, g.cutoff, count(*) AS n, count(*) FILTER (WHERE c.v > g.cutoff) AS k
           FROM calib c JOIN grid g ON c.measure = g.measure GROUP BY ALL),
tail AS (SELECT *, list_sum(list_transform(range(0, k + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1)
                   + i * ln({_RISK}) + (n - i) * ln(1 - {_RISK})))) AS p FROM counts),
cut AS (SELECT lang, measure, min(cutoff) AS cutoff FROM tail
        WHERE p <= 0.05 / ({_TESTS} * (SELECT count(*) FROM (SELECT DISTINCT lang FROM calib))) GROUP BY lang, measure),
failed AS (SELECT DISTINCT m.doc_id FROM m JOIN cut ON m.measure = cut.measure AND m.lang IS NOT DISTINCT FROM cut.lang WHERE m.v > cut.cutoff),
judged AS (SELECT stats.*, NOT base_failed AND failed.doc_id IS NULL AS kept FROM stats LEFT JOIN failed ON stats.doc_id = failed.doc_id)
"""

OP1 = f"""WITH {OP1_CTES}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept FROM judged"""

OP4 = rf"""WITH RECURSIVE d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS BIGINT) AS size,
         length(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS chars,
         length(coalesce(text, '')) - length(regexp_replace(coalesce(text, ''), '[0-9#*$%&|<>]+', '', 'g')) AS noise
  FROM documents),
e AS (SELECT doc_id, source, size,
             -ln((CAST(('0x' || substr(md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13)) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE)
               / greatest(0.1::DOUBLE, CASE WHEN chars > 0 THEN 1.0::DOUBLE - noise / chars ELSE 1.0::DOUBLE END) AS k,
             coalesce(CAST(doc_id AS VARCHAR), '') AS tie FROM d),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
             CAST((row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 + 1 AS DOUBLE) AS w FROM e GROUP BY source),
levels(step, level) AS (
  SELECT 0, 0.0::DOUBLE
  UNION ALL
  SELECT step + 1, (SELECT (sum(source_size) - coalesce(sum(3 * source_size) FILTER (WHERE w * level > 3 * source_size), 0))::DOUBLE
                           / sum(w) FILTER (WHERE NOT w * level > 3 * source_size) FROM s)
  FROM levels WHERE step < 200),
t AS (SELECT source, source_size, CASE WHEN w * lv > 3 * source_size THEN (3 * source_size)::DOUBLE ELSE w * lv END AS target
      FROM s, (SELECT max(level) AS lv FROM levels)),
p AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS epochs FROM t),
o AS (SELECT e.*, source_size, target, epochs, target - epochs * source_size AS rest,
             sum(size) OVER (PARTITION BY e.source ORDER BY k, tie RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto,
             sum(size) OVER (PARTITION BY e.source, k, tie) AS own
      FROM e JOIN p ON e.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target,
       CAST(size * (epochs + CASE WHEN rest > 0 AND upto - own + own / 2 < rest THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM o"""

_URL_RULES = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in RULES)

OP10 = rf"""WITH rules(verdict, rhost, rpath) AS (VALUES {_URL_RULES}),
u AS (SELECT page_id, url,
             translate(coalesce(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
fit AS (SELECT page_id, arg_max(rhost || rpath, (length(rhost || rpath), rhost || rpath)) AS rule,
               arg_max(rules.verdict, (length(rhost || rpath), rhost || rpath)) AS verdict
        FROM u JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY page_id),
tk AS (SELECT page_id, unnest(list_distinct(
         list_concat(list_transform(list_filter(string_split(host, '.'), lambda x: x <> ''), lambda x: 'h:' || x),
         list_concat(list_transform(list_filter(string_split(path, '/'), lambda x: x <> ''), lambda x: 'p:' || regexp_replace(x, '[0-9]+', '0', 'g')),
         list_concat(list_transform(list_filter(string_split(coalesce(regexp_extract(url, '^[^?#]*\?([^#]*)', 1), ''), '&'), lambda x: x <> ''),
                                    lambda x: 'q:' || string_split(x, '=')[1]),
         CASE WHEN contains(url, '://') THEN ['s:' || string_split(url, '://')[1]] ELSE [] END))))) AS tok FROM u),
sets AS (
  SELECT page_id, [tok] AS items FROM tk
  UNION ALL SELECT a.page_id, [a.tok, b.tok] FROM tk a JOIN tk b ON a.page_id = b.page_id AND a.tok < b.tok
  UNION ALL SELECT a.page_id, [a.tok, b.tok, c.tok] FROM tk a JOIN tk b ON a.page_id = b.page_id AND a.tok < b.tok
            JOIN tk c ON a.page_id = c.page_id AND b.tok < c.tok),
lab AS (SELECT doc_id AS page_id, bool_or(quality = 0 OR toxic = 1) AS bad FROM labels GROUP BY doc_id),
taught AS (SELECT u.page_id, bad FROM u JOIN lab ON u.page_id = lab.page_id WHERE bad IS NOT NULL),
tot AS (SELECT count(*) AS n, count(*) FILTER (WHERE bad) AS nb FROM taught),
cand AS (SELECT items, count(*) AS freq, count(*) FILTER (WHERE bad) AS n_bad FROM sets JOIN taught ON sets.page_id = taught.page_id GROUP BY items),
good_rules AS (SELECT items, n_bad / freq AS conf FROM cand, tot
               WHERE n_bad >= ceil(0.002 * n) AND n_bad >= 8 AND n_bad / freq >= 0.6 AND n_bad / freq >= 1.5 * (nb / n)),
kept AS (SELECT items FROM good_rules r WHERE NOT EXISTS (
           SELECT 1 FROM good_rules q WHERE len(q.items) < len(r.items) AND list_has_all(r.items, q.items) AND q.conf >= r.conf)),
hits AS (SELECT page_id, count(*) AS rule_hits FROM sets JOIN kept ON sets.items = kept.items GROUP BY page_id)
SELECT u.page_id, host, path, fit.rule, coalesce(fit.verdict, CASE WHEN rule_hits > 0 THEN 'block' ELSE 'allow' END) AS verdict,
       coalesce(rule_hits, 0) AS rule_hits
FROM u LEFT JOIN fit ON u.page_id = fit.page_id LEFT JOIN hits ON u.page_id = hits.page_id"""

_TEMPLATES = ", ".join(f"('{t.label}', {str(t.base).lower()}, {t.words}, {t.key})" for t in TEMPLATES)

OP12 = rf"""WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                                '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
t(label, base, words, key) AS (VALUES {_TEMPLATES}),
able AS (SELECT rid, label, base, words, key, ws FROM d JOIN t ON list_has_all(ws, list_transform(key, lambda k: words[k + 1]))),
start AS (SELECT *, unnest(list_filter(range(0, len(ws)), lambda i: ws[i + 1] = words[key[1] + 1])) - key[1] AS o FROM able),
m AS (SELECT rid, label, base, o, len(list_filter(range(0, len(words)), lambda k: o + k >= 0 AND ws[o + k + 1] = words[k + 1])) / len(words) AS share
      FROM start WHERE len(list_filter(key, lambda k: o + k >= 0 AND ws[o + k + 1] = words[k + 1])) = len(key)),
f AS (SELECT rid, count(*) FILTER (WHERE base) AS n_base, min(o) FILTER (WHERE base) AS first_word, max(o) FILTER (WHERE base) AS last_word,
             string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE base) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels,
             max(share) AS score FROM m WHERE share >= {MIN_SHARE} GROUP BY rid)
SELECT doc_id, len(ws) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels,
       coalesce(labels, '') AS labels, coalesce(score, 0.0::DOUBLE) AS score
FROM d LEFT JOIN f ON d.rid = f.rid"""

SQL = {"op1_quality_rules": OP1, "op4_mix_sources": OP4, "op10_url_rules": OP10, "op12_license_scan": OP12}
