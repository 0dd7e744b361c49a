"""DuckDB SQL for the registered queries that SQL can express, written from their definitions."""

from __future__ import annotations

from .quality_rules import ALPHA, CUTOFFS, DELTA, RULES, STRATA
from .secrets import BASE
from .secrets import RULES as SECRETS
from .url_filter import FLOOR, PRIOR, RISK, SECOND, STRONGEST, WEAKEST
from .url_filter import RULES as URL_RULES

ORACLE: dict[str, str] = {}


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _re2(pattern: str) -> str:
    """A pattern without possessive repeats, which RE2 has no need of."""
    for kind in ("*", "+", "}", "?"):
        pattern = pattern.replace(f"{kind}+", kind)
    return pattern


# pieces between matches and the matches themselves, alternating, give each match's place
_MATCHES = " UNION ALL ".join(
    f"SELECT doc_id, '{r.kind}' AS kind, {k} AS rank, {r.least} AS least_, string_split_regex(t, {_quoted(_re2(r.pattern))}) AS gaps, regexp_extract_all(t, {_quoted(_re2(r.pattern))}) AS hits, regexp_extract_all(t, {_quoted(_re2(r.pattern))}, {r.group}) AS vals FROM d"
    for k, r in enumerate(SECRETS)
)
ORACLE["op5_secrets"] = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), m AS ({_MATCHES}),
each_ AS (SELECT *, unnest(range(1, len(hits) + 1)) AS i FROM m WHERE len(hits) > 0),
placed AS (SELECT doc_id, kind, rank, least_, length(hits[i]) AS n, length(vals[i]) AS v, CAST(list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS a FROM each_),
spans AS (SELECT doc_id, kind, rank, a, kind || ':' || a || ':' || (a + n) AS span FROM placed WHERE v >= least_),
per AS (SELECT doc_id, {", ".join(f"count(*) FILTER (kind = '{r.kind}') AS n_{r.kind}" for r in BASE)}, string_agg(span, ',' ORDER BY a, rank) FILTER (rank < {len(BASE)}) AS base, string_agg(span, ',' ORDER BY a, rank) AS spans FROM spans GROUP BY doc_id)
SELECT d.doc_id, {", ".join(f"coalesce(n_{r.kind}, 0) AS n_{r.kind}" for r in BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN per USING (doc_id)
"""

_KEPT_BY = "len(list_filter([" + ", ".join(map(str, CUTOFFS)) + "], lambda x: x >= {}))"
_STEP = "least(" + ", ".join(f"{_KEPT_BY.format(r)} * {len(RULES)} + {j}" for j, r in enumerate(RULES)) + ")"
_CHOSEN = ", ".join(f"[{', '.join(map(str, CUTOFFS))}][CAST(floor((last - {j}) / {len(RULES)}) AS INTEGER) + 1] AS cut_{r}" for j, r in enumerate(RULES))
ORACLE["op8_quality_rules"] = f"""
WITH d AS (SELECT doc_id, CASE WHEN lang IN ({", ".join(f"'{s}'" for s in STRATA)}) THEN lang ELSE 'other' END AS stratum, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, stratum, t, list_filter(string_split_regex(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM d),
grams AS (SELECT doc_id, i, w[i:i + 4] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM w WHERE len(w) >= 5)),
twice AS (SELECT doc_id, i FROM grams QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
covered AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, (SELECT unnest(range(0, 5)) AS k) GROUP BY doc_id),
m AS (SELECT w.doc_id, stratum, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words,
    length(t) - length(replace(t, '!', '')) AS n_exclaims, length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) AS n_upper, len(lines) AS n_lines FROM w LEFT JOIN covered c ON c.doc_id = w.doc_id),
judged AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, coalesce(n_symbols / nullif(n_words, 0), 0.0) AS symbol_rate, coalesce(n_exclaims / nullif(n_words, 0), 0.0) AS exclaim_rate, coalesce(n_upper / nullif(word_chars, 0), 0.0) AS upper_share, coalesce(n_dup_lines / nullif(n_lines, 0), 0.0) AS dup_line_share FROM m),
held AS (SELECT j.* FROM judged j WHERE NOT base_failed AND doc_id IN (SELECT doc_id FROM labels GROUP BY doc_id HAVING max(quality) = 1)),
counts AS (SELECT stratum, {_STEP} AS step, count(*) AS n FROM held GROUP BY ALL),
tests AS (SELECT stratum, t AS step, sum(n) AS n, coalesce(sum(n) FILTER (step <= t), 0) AS k FROM counts, (SELECT unnest(range(0, {len(RULES) * len(CUTOFFS)})) AS t) GROUP BY stratum, t),
tails AS (SELECT *, CASE WHEN k >= n * {ALPHA} THEN 1.0 ELSE list_sum(list_transform(range(0, CAST(k AS BIGINT) + 1), lambda j: exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln({ALPHA}) + (n - j) * ln(1 - {ALPHA})))) END AS p FROM tests),
chosen AS (SELECT stratum, {_CHOSEN} FROM (SELECT stratum, max(step) AS last FROM tails WHERE p <= {DELTA / (len(STRATA) + 1)!r} GROUP BY stratum))
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
    NOT (base_failed OR {" OR ".join(f"coalesce({r} > cut_{r}, false)" for r in RULES)}) AS kept FROM judged LEFT JOIN chosen USING (stratum)
"""

ORACLE["op10_vector_search"] = """
WITH v AS (
    SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
    FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scores AS (
    SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
    FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id
), ranked AS (
    SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM scores
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""


def _strength(groups: str) -> str:
    """Prior strength of groups (n, good, above) by the method of moments."""
    return f"""(SELECT CASE WHEN k < 2 OR n <= k THEN {STRONGEST} WHEN b + (typical - 1) * w <= 0 OR b <= w THEN {STRONGEST} ELSE least({STRONGEST}, greatest({WEAKEST}, (1 - (b - w) / (b + (typical - 1) * w)) / ((b - w) / (b + (typical - 1) * w)))) END
        FROM (SELECT k, n, (n - n2 / n) / (k - 1) AS typical, b / (k - 1) AS b, w / (n - k) AS w FROM (SELECT count(*) AS k, sum(n) AS n, CAST(sum(n * n) AS DOUBLE) AS n2, sum(n * (good / n - above) * (good / n - above)) AS b, sum(n * (good / n) * (1 - good / n)) AS w FROM {groups} WHERE n > 0)))"""




def _below(a: str, b: str, x: float) -> str:
    """P(Beta(a, b) < x) by the series in x, where the mean is x or more."""
    terms = f"range(0, CAST(ceil(10 * sqrt(({a} + {b}) / {1 - x})) + ceil(45 / -ln({x})) AS BIGINT) + 1)"
    return f"exp(lgamma({a} + {b}) - lgamma({a} + 1) - lgamma({b}) + {a} * ln({x}) + {b} * ln({1 - x})) * list_sum(list_transform({terms}, lambda m: exp(lgamma({a} + {b} + m) - lgamma({a} + {b}) - lgamma({a} + 1 + m) + lgamma({a} + 1) + m * ln({x}))))"


_SECOND = ", ".join(f"'{s}'" for s in SECOND)
_FITS = " UNION ALL ".join(f"SELECT page_id, '{r.text}' AS rule, '{r.verdict}' AS verdict FROM p WHERE (host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}')" for r in URL_RULES)
ORACLE["op6_url_filter"] = f"""
WITH rest AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS u FROM pages),
p AS (SELECT page_id, coalesce(translate(regexp_extract(u, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host, coalesce(regexp_extract(u, '^[^/?#]*([^?#]*)', 1), '') AS path FROM rest),
best AS (SELECT page_id, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict FROM ({_FITS}) GROUP BY page_id),
one AS (SELECT doc_id AS page_id, min(quality) AS good FROM labels WHERE quality IS NOT NULL GROUP BY doc_id),
lab AS (SELECT host, count(*) AS n, CAST(sum(good) AS BIGINT) AS good FROM p JOIN one USING (page_id) GROUP BY host),
h0 AS (SELECT host, coalesce(n, 0) AS n, coalesce(good, 0) AS good, string_split(host, '.') AS l FROM (SELECT DISTINCT host FROM p) LEFT JOIN lab USING (host)),
parts AS (SELECT host, n, good, l, len(l) < 2 OR regexp_matches(host, '^[0-9.]+$|:|^\\[') AS figures, CASE WHEN len(l) > 2 AND regexp_full_match(l[-1], '[a-z]{{2}}') AND l[-2] IN ({_SECOND}) THEN 2 ELSE 1 END AS k FROM h0),
h AS (SELECT host, n, good, CASE WHEN figures THEN host ELSE array_to_string(l[-(k + 1):], '.') END AS domain, CASE WHEN figures THEN host ELSE array_to_string(l[-k:], '.') END AS suffix FROM parts),
s0 AS (SELECT suffix, sum(n) AS n, sum(good) AS good, (SELECT (coalesce(sum(good), 0) + {PRIOR}) / (coalesce(sum(n), 0) + 1) FROM h) AS above FROM h GROUP BY suffix),
s AS (SELECT suffix, (good + m * above) / (n + m) AS mean FROM s0, (SELECT {_strength("s0")} AS m)),
d0 AS (SELECT domain, any_value(s.mean) AS above, sum(n) AS n, sum(good) AS good FROM h JOIN s USING (suffix) GROUP BY domain),
d AS (SELECT domain, (good + m * above) / (n + m) AS mean FROM d0, (SELECT {_strength("d0")} AS m)),
l0 AS (SELECT host, n, good, d.mean AS above FROM h JOIN d USING (domain)),
l AS (SELECT host, mean * strength AS a, (1 - mean) * strength AS b FROM (SELECT host, (good + m * above) / (n + m) AS mean, n + m AS strength FROM l0, (SELECT {_strength("l0")} AS m))),
sure AS (SELECT host, 1 - CASE WHEN a >= (a + b) * {FLOOR} THEN {_below("a", "b", FLOOR)} ELSE 1 - {_below("b", "a", 1 - FLOOR)} END AS sure FROM l)
SELECT p.page_id, p.host, p.path, rule, coalesce(best.verdict, CASE WHEN sure < 1 - {RISK} THEN 'block' ELSE 'allow' END) AS verdict, round(sure, 9) AS reputation
FROM p JOIN sure ON sure.host = p.host LEFT JOIN best ON best.page_id = p.page_id
"""

# the CRC of each distinct word by its bytes, with the table that the polynomial gives
ORACLE["op11_importance_resampling"] = """
WITH crc_table AS (SELECT list_transform(range(0, 256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: xor(c >> 1, (c & 1) * 3988292384))) AS tab),
texts AS (SELECT true AS own, doc_id AS id, coalesce(text, '') AS t FROM documents UNION ALL SELECT false, item_id, coalesce(text, '') FROM benchmark),
w AS (SELECT own, id, unnest(list_filter(string_split_regex(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')) AS w FROM texts),
spelt AS (SELECT w, hex(encode(w)) AS h FROM (SELECT DISTINCT w FROM w)),
crcs AS (SELECT w, xor(list_reduce(list_prepend(4294967295, list_transform(range(0, length(h) // 2), lambda i: CAST('0x' || substr(h, 2 * i + 1, 2) AS BIGINT))), lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295) % 10000 AS bucket FROM spelt, crc_table),
hit AS (SELECT own, id, bucket, count(*) AS n FROM w JOIN crcs USING (w) GROUP BY ALL),
sums AS (SELECT bucket, coalesce(sum(n) FILTER (own), 0) AS s, coalesce(sum(n) FILTER (NOT own), 0) AS t FROM hit GROUP BY bucket),
gain AS (SELECT bucket, CAST(floor(1000 * ln((CAST(t AS DOUBLE) + 1) * CAST((SELECT sum(s) FROM sums) + 10000 AS DOUBLE) / ((CAST(s AS DOUBLE) + 1) * CAST((SELECT sum(t) FROM sums) + 10000 AS DOUBLE)))) AS BIGINT) AS g FROM sums),
per AS (SELECT id AS doc_id, CAST(sum(n) AS BIGINT) AS n_features, CAST(sum(n * g) AS BIGINT) AS weight FROM hit JOIN gain USING (bucket) WHERE own GROUP BY id),
noisy AS (SELECT doc_id, CAST(coalesce(n_features, 0) AS BIGINT) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight, CAST('0x' || substr(sha256('2024:' || doc_id), 1, 8) AS BIGINT) AS h FROM documents LEFT JOIN per USING (doc_id)),
scored AS (SELECT doc_id, n_features, weight, weight + CAST(floor(-1000 * ln(-ln((h + 0.5) / 4294967296.0))) AS BIGINT) AS score FROM noisy),
best AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM scored WHERE n_features >= 20 QUALIFY rank <= 10 * count(*) OVER () // 100)
SELECT doc_id, n_features, weight, score, rank FROM scored LEFT JOIN best USING (doc_id)
"""

ORACLE["op12_collocations"] = """
WITH cut AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS x FROM documents),
w AS (SELECT lang, list_filter(string_split_regex(x, '[\\x20\\x09]+'), lambda e: e <> '') AS w FROM cut),
totals AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY lang),
g AS (SELECT lang, k, w[i:i + k - 1] AS p FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM w, (SELECT unnest(range(1, 5)) AS k) WHERE len(w) >= k)),
f AS (SELECT lang, k, array_to_string(p, ' ') AS phrase, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= 30),
c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1),
cuts AS (SELECT lang, phrase, a, j, array_to_string(w[1:j], ' ') AS lp, array_to_string(w[j + 1:k], ' ') AS rp FROM (SELECT *, unnest(range(1, k)) AS j FROM c)),
s AS (SELECT cuts.lang, cuts.phrase, a, j, l.f AS l, r.f AS r, 2000000 * CAST(a AS HUGEINT) // (l.f + r.f) AS score FROM cuts JOIN f l ON l.lang = cuts.lang AND l.phrase = lp JOIN f r ON r.lang = cuts.lang AND r.phrase = rp),
lowest AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
inside AS (SELECT lang, array_to_string(w[i:i + n - 1], ' ') AS phrase, max(a) AS cover FROM (SELECT lang, w, k, a, n, unnest(range(1, k - n + 2)) AS i FROM c, (SELECT unnest(range(2, 4)) AS n) WHERE n < k) GROUP BY ALL),
kept AS (SELECT lowest.* FROM lowest LEFT JOIN inside USING (lang, phrase) WHERE cover IS NULL OR 100 * CAST(cover AS HUGEINT) < 80 * CAST(a AS HUGEINT))
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score FROM kept JOIN totals USING (lang) QUALIFY rank <= 2000
"""

# all pairs that share a shingle, and the closure of those that link
ORACLE["op13_jaccard_join"] = """
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda e: e <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, w[i:i + 4] AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM common JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * k >= 80 * (na.n + nb.n - k)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM w UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a)
SELECT a AS doc_id, CAST(coalesce(any_value(n), 0) AS BIGINT) AS n_shingles, min(b) AS component_id FROM reach LEFT JOIN n ON n.doc_id = a GROUP BY a
"""
