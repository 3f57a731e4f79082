"""DuckDB SQL for the queries of this package that SQL can express on whole tables."""

from __future__ import annotations

from variscope.llm.quality import MAX_REPEAT_PERCENT, MIN_WORDS, RULES, STOP_WORDS, SYMBOLS
from variscope.llm.urls import LOWER, UPPER

WORD = r"[^\x20\x09-\x0D]+"
_STOP = ", ".join(f"'{w}'" for w in STOP_WORDS)
_RATIOS = {
    "mean_word_chars": ("word_chars", "n_words"),
    "symbols_per_word": ("n_symbols", "n_words"),
    "stop_words_per_word": ("n_stop_words", "n_words"),
    "dup_line_ratio": ("n_dup_lines", "n_lines"),
    "repeat_word_ratio": ("n_repeat_words", "n_words"),
}


def _breach(rule) -> str:
    a, b = _RATIOS[rule.measure]
    ratio = f"(CASE WHEN {b} > 0 THEN {a} / {b} ELSE 0.0 END)"
    sides = [f"{ratio} < {rule.low}"] * (rule.low is not None) + [f"{ratio} > {rule.high}"] * (rule.high is not None)
    return f"CASE WHEN {' OR '.join(sides)} THEN '{rule.name}' END"


OP3 = f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, regexp_extract_all(text, '{WORD}') AS w,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{WORD}')) AS lines FROM t),
g AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM w, unnest(range(1, len(w) - 1)) AS u(i)),
r AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS c FROM g) WHERE c > 1),
covered AS (SELECT doc_id, count(DISTINCT i + d) AS n FROM r, (VALUES (0), (1), (2)) AS v(d) GROUP BY doc_id),
m AS (SELECT w.doc_id, len(w) AS n_words, cast(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
    length(text) - length(regexp_replace(text, '[{SYMBOLS}]', '', 'g')) AS n_symbols, len(lines) AS n_lines,
    len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(covered.n, 0) AS n_repeat_words,
    len(list_filter(w, lambda x: lower(x) IN ({_STOP}))) AS n_stop_words
  FROM w LEFT JOIN covered USING (doc_id)),
j AS (SELECT *, n_words < {MIN_WORDS} OR n_repeat_words * 100 > n_words * {MAX_REPEAT_PERCENT} AS base_failed,
    concat_ws(',', {", ".join(_breach(r) for r in RULES)}) AS failed_rules FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND failed_rules = '' AS kept, failed_rules FROM j"""

OP4 = f"""
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size, doc_id = max(doc_id) OVER same AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS t FROM documents)
WINDOW same AS (PARTITION BY t)"""

OP6 = f"""
WITH rules AS (SELECT * FROM (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'),
    ('net', '/es/', 'block'), ('net', '/fr/', 'block')) AS v(rule_host, rule_path, rule_verdict)),
u AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
f AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY length(rule_host || rule_path) DESC) AS n
  FROM p LEFT JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path))
SELECT page_id, host, path, rule_host || rule_path AS rule, coalesce(rule_verdict, 'allow') AS verdict FROM f WHERE n = 1"""

ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_LOWER_WORDS = f"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{ALNUM}')"

OP11 = f"""
WITH d AS (SELECT doc_id, {_LOWER_WORDS} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_LOWER_WORDS} AS w FROM benchmark),
p AS (SELECT DISTINCT item, w[i:i + least(len(w), 10) - 1] AS p FROM b, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS u(i) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT len(p) AS k FROM p),
placed AS (SELECT doc_id, k, i, w[i:i + k - 1] AS p FROM d, sizes, unnest(range(1, len(w) - k + 2)) AS u(i) WHERE len(w) >= k),
hit AS (SELECT placed.doc_id, placed.i, placed.k, p.item FROM placed JOIN p USING (p)),
marked AS (SELECT doc_id, count(DISTINCT j) AS n FROM hit, unnest(range(i, i + k)) AS u(j) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(marked.n, 0) AS n_hit, coalesce(named.n, 0) AS n_items,
  sha256(coalesce(named.items, '')) AS items_sha256, marked.n IS NOT NULL AS contaminated
FROM d LEFT JOIN marked USING (doc_id) LEFT JOIN named USING (doc_id)"""

OP12 = f"""
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang,
    unnest(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM pieces),
totals AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY lang),
grams AS (SELECT lang, w[i:i + k - 1] AS g FROM w, unnest(range(1, 6)) AS s(k), unnest(range(1, len(w) - k + 2)) AS u(i) WHERE len(w) >= k),
f AS (SELECT lang, g, count(*) AS f FROM grams GROUP BY lang, g HAVING count(*) >= 100),
cuts AS (SELECT c.lang, c.g, c.f AS a, k, x.f AS l, y.f AS r, n, CAST(1000::HUGEINT * c.f * n // (x.f::HUGEINT * y.f) AS BIGINT) AS score
  FROM f AS c JOIN totals USING (lang), unnest(range(1, len(c.g))) AS u(k)
  JOIN f AS x ON x.lang = c.lang AND x.g = c.g[1:k] JOIN f AS y ON y.lang = c.lang AND y.g = c.g[k + 1:] WHERE len(c.g) > 1),
lowest AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1),
inner_parts AS (SELECT lang, g[i:i + k - 1] AS g, f FROM f, unnest(range(2, 5)) AS s(k), unnest(range(1, len(g) - k + 2)) AS u(i) WHERE len(g) > k),
kept AS (SELECT lowest.* FROM lowest LEFT JOIN (SELECT lang, g, max(f) AS longer FROM inner_parts GROUP BY lang, g) USING (lang, g)
  WHERE longer IS NULL OR 100 * longer < 100 * a),
ranked AS (SELECT *, array_to_string(g, ' ') AS phrase, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(g, ' ')) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked WHERE rank <= 2000"""

OP13 = f"""
WITH d AS (SELECT doc_id, {_LOWER_WORDS} AS w FROM documents),
dw AS (SELECT doc_id, unnest(w) AS word FROM d),
bw AS (SELECT unnest({_LOWER_WORDS}) AS word FROM benchmark),
spelled AS (SELECT word, hex(encode(word)) AS h FROM (SELECT word FROM dw UNION SELECT word FROM bw)),
bucketed AS (SELECT word, xor(list_reduce(list_prepend(4294967295, list_transform(range(len(h) // 2), lambda i: CAST('0x' || h[2 * i + 1:2 * i + 2] AS BIGINT))),
    lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295) % 10000 AS bucket FROM spelled),
s AS (SELECT bucket, count(*) AS s FROM dw JOIN bucketed USING (word) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS t FROM bw JOIN bucketed USING (word) GROUP BY bucket),
gain AS (SELECT bucket, CAST(floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT sum(s) FROM s) + 10000)::DOUBLE
    / ((coalesce(s, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(t), 0) FROM t) + 10000)::DOUBLE))) AS BIGINT) AS gain FROM s LEFT JOIN t USING (bucket)),
sums AS (SELECT doc_id, count(*) AS n, sum(gain) AS g FROM dw JOIN bucketed USING (word) JOIN gain USING (bucket) GROUP BY doc_id),
weighed AS (SELECT d.doc_id, len(w) AS n_features, CAST(coalesce(floor(g / n), 0) AS BIGINT) AS weight,
    CAST('0x' || substr(sha256('2024:' || d.doc_id), 1, 8) AS BIGINT) AS h FROM d LEFT JOIN sums USING (doc_id)),
scored AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score FROM weighed),
placed AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS place, count(*) OVER (PARTITION BY n_features >= 20) AS many FROM scored)
SELECT doc_id, CAST(n_features AS BIGINT) AS n_features, weight, score, CASE WHEN n_features >= 20 AND place <= 10 * many // 100 THEN place END AS rank FROM placed"""
