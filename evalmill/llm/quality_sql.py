"""SQL twin of the quality rules: the same features, exact binomial tails by lgamma, the same choice of cutoffs."""

from __future__ import annotations

from evalmill.llm.quality import ALPHA, DELTA, RULES

RATIOS = {
    "symbol_ratio": ("n_symbols", "word_chars"),
    "upper_ratio": ("n_upper", "word_chars"),
    "bang_ratio": ("n_bang", "n_words"),
    "digit_ratio": ("n_digits", "word_chars"),
    "dup_line_ratio": ("n_dup_lines", "n_lines"),
    "repeat_ratio": ("n_repeat_words", "n_words"),
}


def _over(name: str) -> str:
    a, b = RATIOS[name]
    return f"coalesce(CAST({a} AS DOUBLE) / nullif(CAST({b} AS DOUBLE), 0), 0)"


_CELLS = ", ".join(f"('{name}', {cut}::DOUBLE)" for name, cuts in RULES.items() for cut in cuts)
_COUNT = lambda others: f"length(regexp_replace(text, '{others}', '', 'g'))"
_SHARE = ALPHA / len(RULES)
_RATIO_CASE = "CASE c.rule " + " ".join(f"WHEN '{n}' THEN {_over(n)}" for n in RULES) + " END"

OP2_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(lang, 'und') AS stratum, coalesce(text, '') AS text FROM documents),
w AS (SELECT rid, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM d),
tri AS (SELECT rid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS t FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
dup AS (SELECT rid, i FROM (SELECT *, count(*) OVER (PARTITION BY rid, t) AS c FROM tri) WHERE c > 1),
rep AS (SELECT rid, count(DISTINCT j) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS j FROM dup) GROUP BY rid),
lines AS (SELECT rid, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
f AS (SELECT d.rid, doc_id, stratum, len(w) AS n_words, {_COUNT("[\\x20\\x09-\\x0D]+")} AS word_chars, {_COUNT("[^#*$%&|<>]+")} AS n_symbols,
  len(l) AS n_lines, len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words,
  {_COUNT("[^\\p{Lu}]+")} AS n_upper, {_COUNT("[^!?]+")} AS n_bang, {_COUNT("[^0-9]+")} AS n_digits
  FROM d JOIN w USING (rid) JOIN lines USING (rid) LEFT JOIN rep USING (rid)),
good AS (SELECT doc_id FROM labels WHERE quality IS NOT NULL GROUP BY doc_id HAVING max(quality) = 1),
held AS (SELECT * FROM f WHERE doc_id IN (SELECT doc_id FROM good)),
cuts AS (SELECT * FROM (VALUES {_CELLS}) AS t(rule, cut)),
counted AS (SELECT stratum, c.rule, c.cut, count(*) AS n, count(*) FILTER (WHERE {_RATIO_CASE} > c.cut) AS k FROM held CROSS JOIN cuts c GROUP BY ALL),
size AS (SELECT greatest(1, count(DISTINCT stratum)) * {sum(map(len, RULES.values()))} AS m FROM held),
terms AS (SELECT stratum, rule, cut, n, k, unnest(range(0, k + 1)) AS i FROM counted),
tails AS (SELECT stratum, rule, cut, n, k, sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({_SHARE}) + (n - i) * ln(1 - {_SHARE}))) AS p FROM terms GROUP BY ALL),
safe AS (SELECT stratum, rule, min(cut) AS cut FROM tails CROSS JOIN size WHERE k < n * {_SHARE} AND p <= {DELTA} / m GROUP BY ALL),
hit AS (SELECT DISTINCT rid FROM f JOIN safe c USING (stratum) WHERE {_RATIO_CASE} > c.cut),
base AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM f)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
  CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed, NOT base_failed AND rid NOT IN (SELECT rid FROM hit) AS kept FROM base
"""
