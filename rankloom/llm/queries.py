"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from importlib import import_module

NAMES = {
    "op1_simhash": "simhash",
    "op2_embedding_lsh": "embeddings",
    "op3_mix_sources": "mixing",
    "op4_language_id": "langid",
    "op5_lm_score": "lm",
    "op6_pack": "packing",
    "op7_token_tables": "sstable",
    "op8_pii": "pii",
    "op9_html_text": "html",
    "op10_quality": "quality",
}


def queries() -> dict:
    return {name: getattr(import_module(f"{__package__}.{module}"), name) for name, module in NAMES.items()}


def oracle_sql() -> dict[str, str]:
    return {"op10_quality": QUALITY_SQL}


def _quality_sql() -> str:
    from .quality import GAMMA, LEAST, QUANTILES, RATIOS, SPREAD, UPPER

    ratios = ", ".join(f"coalesce({a} / nullif({b}, 0), 0.0) {r}" for r, (a, b, _) in RATIOS.items())
    long = " UNION ALL ".join(f"SELECT lang, source, '{r}' ratio, {r} x FROM c WHERE NOT base_failed" for r in RATIOS)
    bucket = lambda x: f"ceil(ln(greatest({x}, {LEAST}) / {LEAST}) / ln({GAMMA}))"
    middle = lambda b: f"CASE WHEN {b} <= 0 THEN 0.0 ELSE {LEAST} * pow({GAMMA}, {b} - 0.5) END"
    value = middle("bucket")
    quantiles = lambda name, by: (
        f"{name} AS (SELECT {by} ratio, max(docs) docs, {', '.join(f'min(v) FILTER (below >= docs * {x}) {q}' for q, x in QUANTILES.items())} FROM "
        f"(SELECT {by} ratio, {value} v, sum(n) OVER (PARTITION BY {by} ratio ORDER BY bucket) below, sum(n) OVER (PARTITION BY {by} ratio) docs FROM (SELECT {by} ratio, bucket, sum(n) n FROM sk GROUP BY ALL)) GROUP BY ALL)"
    )
    pick = ", ".join(f"CASE WHEN a.docs >= 30 THEN a.{q} WHEN b.docs >= 30 THEN b.{q} ELSE o.{q} END {q}" for q in QUANTILES)
    tail = f"coalesce({', '.join(f'CASE WHEN {q} > q50 THEN {q} END' for q in UPPER)}, q50)"
    fence = ", ".join(
        f"max(q50 + {SPREAD} * ({tail} - q50)) FILTER (ratio = '{r}') hi_{r}, " + (f"max(q50 - {SPREAD} * (q50 - q25)) FILTER (ratio = '{r}') lo_{r}" if lower else f"-1.0 lo_{r}")
        for r, (_, _, lower) in RATIOS.items()
    )
    within = " AND ".join(f"{middle(bucket(r))} BETWEEN lo_{r} AND hi_{r}" for r in RATIOS)
    return f"""
WITH t AS (SELECT row_number() OVER () rid, doc_id, lang, source, coalesce(text, '') t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') ws FROM documents),
lines AS (SELECT rid, list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\\x20\\x09-\\x0D]')) ls FROM t),
g AS (SELECT rid, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] w FROM (SELECT rid, ws, unnest(range(1, len(ws) - 1)) i FROM t WHERE len(ws) > 2)),
many AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, w) k FROM g) WHERE k > 1),
rep AS (SELECT rid, count(DISTINCT i + j) n FROM many CROSS JOIN (SELECT unnest([0, 1, 2]) j) GROUP BY rid),
n AS (SELECT rid, doc_id, lang, source, CAST(len(ws) AS BIGINT) n_words, CAST(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT) word_chars,
        CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) n_symbols, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) n_dup_lines, coalesce(rep.n, 0) n_repeat_words
      FROM t JOIN lines USING (rid) LEFT JOIN rep USING (rid)),
c AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words base_failed, {ratios} FROM n),
sk AS (SELECT lang, source, ratio, {bucket("x")} bucket, count(*) n FROM ({long}) GROUP BY ALL),
{quantiles("own", "lang, source,")}, {quantiles("by_lang", "lang,")}, {quantiles("overall", "")},
f AS (SELECT lang, source, {fence} FROM (SELECT a.lang, a.source, a.ratio, {pick} FROM own a JOIN by_lang b ON a.lang IS NOT DISTINCT FROM b.lang AND a.ratio = b.ratio JOIN overall o ON o.ratio = a.ratio) GROUP BY ALL)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND coalesce({within}, false) kept
FROM c LEFT JOIN f ON c.lang IS NOT DISTINCT FROM f.lang AND c.source IS NOT DISTINCT FROM f.source"""


QUALITY_SQL = _quality_sql()
