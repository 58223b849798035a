"""The queries of queries.py as SQL for DuckDB. One set of common table expressions serves all of them."""

from __future__ import annotations

PRELUDE = """
WITH RECURSIVE
articles AS (
  SELECT CAST(p_partkey AS VARCHAR) article_id, 'STAR' dataset, coalesce(p_name, '') title, coalesce(p_brand, '') subtitle, CAST(NULL AS VARCHAR) body,
         coalesce(p_type, 'unknown') category, CASE WHEN p_partkey % 7 <> 0 THEN TIMESTAMP '1994-06-01' + to_days(CAST(p_partkey % 1000 AS INT)) END published_time
  FROM part),
grouped AS (
  SELECT l_orderkey, l_partkey, max(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS label, round(sum(l_quantity), 0) AS score, sum(l_quantity) AS qty, avg(l_discount) AS disc
  FROM lineitem GROUP BY ALL),
cand AS (
  SELECT CAST(o_orderkey AS VARCHAR) impression_id, CAST(o_custkey AS VARCHAR) user_id, 'STAR' dataset, o_orderdate impression_time, CAST(l_partkey AS VARCHAR) article_id, label,
         CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey) AS INT) cand_pos, score, qty, disc
  FROM grouped JOIN orders ON l_orderkey = o_orderkey),
late AS (SELECT DISTINCT impression_id, impression_time FROM cand WHERE impression_time >= TIMESTAMP '1999-01-01'),
halves AS (SELECT impression_id, CASE WHEN row_number() OVER (ORDER BY impression_time, impression_id) <= (SELECT count(*) // 2 FROM late) THEN 'val' ELSE 'test' END split FROM late),
imp AS (SELECT c.*, coalesce(h.split, 'train') split FROM cand c LEFT JOIN halves h USING (impression_id)),
hist AS (SELECT user_id, dataset, article_id, min(impression_time) click_time, sum(qty) read_time, 1000 * avg(disc) scroll_pct FROM cand WHERE label = 1 GROUP BY ALL),
win AS (
  SELECT * FROM (SELECT i.impression_id, i.user_id, i.impression_time, h.article_id, h.click_time, h.read_time, h.scroll_pct,
    CAST(row_number() OVER (PARTITION BY i.impression_id ORDER BY h.click_time DESC, h.article_id) AS INT) rn
    FROM (SELECT DISTINCT impression_id, user_id, impression_time FROM cand) i JOIN hist h ON h.user_id = i.user_id AND h.click_time < i.impression_time) WHERE rn <= 50),
ev AS (SELECT CAST(user_id AS VARCHAR) user_id, ts, event_type, value, json_extract_string(props, '$.k') article_id FROM events WHERE event_type IN ('click', 'view')),
ev_hist AS (SELECT user_id, article_id, ts click_time, value read_time, CAST(NULL AS DOUBLE) scroll_pct FROM ev WHERE event_type = 'click'),
ev_time AS (SELECT user_id, CAST(ts AS DATE) d, min(ts) impression_time FROM ev GROUP BY ALL),
ev_art AS (SELECT user_id, CAST(ts AS DATE) d, article_id, max(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END) AS label FROM ev GROUP BY ALL),
ev_imp AS (
  SELECT user_id || '_' || CAST(d AS VARCHAR) impression_id, user_id, impression_time, article_id, label,
         row_number() OVER (PARTITION BY user_id, d ORDER BY CAST(article_id AS INT)) cand_pos
  FROM ev_art JOIN ev_time USING (user_id, d)),
ev_win AS (
  SELECT * FROM (SELECT i.impression_id, i.user_id, i.impression_time, h.article_id, h.click_time, h.read_time, h.scroll_pct,
    row_number() OVER (PARTITION BY i.impression_id ORDER BY h.click_time DESC, h.article_id) rn
    FROM (SELECT DISTINCT impression_id, user_id, impression_time FROM ev_imp) i JOIN ev_hist h ON h.user_id = i.user_id AND h.click_time < i.impression_time) WHERE rn <= 50),
vec AS (SELECT CAST(vec_id AS VARCHAR) article_id, CAST(embedding AS DOUBLE[]) vec FROM embeddings),
vec_long AS (SELECT article_id, unnest(range(len(vec))) AS dim, unnest(vec) AS x FROM vec),
unit_long AS (SELECT article_id, dim, x / CASE WHEN n = 0 THEN 1 ELSE n END x FROM (SELECT *, sqrt(sum(x * x) OVER (PARTITION BY article_id)) n FROM vec_long)),
pool AS (SELECT impression_id, dim, avg(x) x FROM ev_win JOIN vec_long USING (article_id) GROUP BY ALL),
uvec AS (SELECT impression_id, dim, x / CASE WHEN n = 0 THEN 1 ELSE n END x FROM (SELECT *, sqrt(sum(x * x) OVER (PARTITION BY impression_id)) n FROM pool)),
win_feat AS (
  SELECT impression_id, count(*) user_click_count, sum(exp(-ln(2.0) * age / 7)) user_hist_recency_sum, count(*) FILTER (age <= 1.0 / 24) session_clicks_1h,
         count(*) FILTER (age <= 1) session_clicks_24h, avg(read_time) hist_mean_read_time, avg(scroll_pct) hist_mean_scroll
  FROM (SELECT *, (epoch_us(impression_time) - epoch_us(click_time)) / 86400000000.0 age FROM win) GROUP BY ALL),
ev_feat AS (
  SELECT impression_id, count(*) user_click_count, sum(exp(-ln(2.0) * age / 7)) user_hist_recency_sum, count(*) FILTER (age <= 1.0 / 24) session_clicks_1h, count(*) FILTER (age <= 1) session_clicks_24h
  FROM (SELECT *, (epoch_us(impression_time) - epoch_us(click_time)) / 86400000000.0 age FROM ev_win) GROUP BY ALL),
cat_n AS (SELECT impression_id, category, count(*) n, sum(count(*)) OVER (PARTITION BY impression_id) total FROM win JOIN articles USING (article_id) WHERE category <> '' GROUP BY impression_id, category),
affinity AS (
  SELECT c.impression_id, c.article_id, CASE WHEN n IS NULL THEN 0 ELSE 1 END category_match, coalesce(n / total, 0.0) cat_affinity
  FROM (SELECT cand.*, coalesce(category, '') category FROM cand LEFT JOIN articles USING (article_id)) c LEFT JOIN cat_n USING (impression_id, category)),
fresh AS (
  SELECT impression_id, article_id, coalesce(greatest(0.0, (epoch_us(impression_time) - epoch_us(published_time)) / 86400000000.0), -1.0) freshness_days
  FROM cand LEFT JOIN articles USING (article_id)),
pct AS (SELECT article_id, (rank() OVER (ORDER BY c) + (count(*) OVER (PARTITION BY c) - 1) / 2.0) / count(*) OVER () pop_pct FROM (SELECT article_id, count(*) c FROM hist GROUP BY ALL)),
pct_cut AS (SELECT article_id, (rank() OVER (ORDER BY c) + (count(*) OVER (PARTITION BY c) - 1) / 2.0) / count(*) OVER () pop_pct FROM (SELECT article_id, count(*) c FROM hist WHERE click_time < (SELECT min(impression_time) FROM imp WHERE split = 'val') GROUP BY ALL)),
feat AS (
  SELECT i.impression_id, i.article_id, coalesce(user_click_count, 0) user_click_count, coalesce(user_hist_recency_sum, 0) user_hist_recency_sum, coalesce(session_clicks_1h, 0) session_clicks_1h,
         coalesce(session_clicks_24h, 0) session_clicks_24h, category_match, cat_affinity, coalesce(pop_pct, 0) article_popularity, freshness_days, hist_mean_read_time, hist_mean_scroll
  FROM cand i JOIN affinity USING (impression_id, article_id) JOIN fresh USING (impression_id, article_id) LEFT JOIN pct_cut USING (article_id) LEFT JOIN win_feat USING (impression_id)),
pop AS (SELECT article_id, count(*) AS pop FROM imp WHERE label = 1 AND split = 'train' GROUP BY ALL),
late_rows AS (SELECT * FROM imp WHERE split <> 'train'),
ranked AS (SELECT *, row_number() OVER (PARTITION BY impression_id ORDER BY score DESC NULLS LAST, cand_pos) AS rk, count(*) OVER (PARTITION BY impression_id) n FROM late_rows),
ideal AS (SELECT k, sum(1 / log2(i + 1)) OVER (ORDER BY k) idcg FROM (SELECT unnest(range(1, 11)) k, unnest(range(1, 11)) i)),
docs_tok AS (SELECT CAST(doc_id AS VARCHAR) article_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]{2,}') tokens FROM documents),
doc_long AS (SELECT article_id, len(tokens) dl, unnest(tokens) term FROM docs_tok),
post AS (SELECT article_id, dl, term, count(*) tf FROM doc_long GROUP BY ALL),
corpus AS (SELECT count(*) n_docs, avg(len(tokens)) avgdl FROM docs_tok),
idf_raw AS (SELECT term, count(*) df, ln((SELECT n_docs FROM corpus) - count(*) + 0.5) - ln(count(*) + 0.5) AS raw FROM post GROUP BY ALL),
idf AS (SELECT term, df, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM idf_raw) ELSE raw END idf FROM idf_raw),
art_tok AS (SELECT article_id, regexp_extract_all(lower(concat_ws(' ', nullif(title, ''), nullif(subtitle, ''))), '[\\p{L}\\p{N}_]{2,}') tokens FROM articles),
art_long AS (SELECT article_id, len(tokens) dl, unnest(tokens) term FROM art_tok),
art_post AS (SELECT article_id, dl, term, count(*) tf FROM art_long GROUP BY ALL),
art_corpus AS (SELECT count(*) n_docs, avg(len(tokens)) avgdl FROM art_tok),
art_raw AS (SELECT term, count(*) df, ln((SELECT n_docs FROM art_corpus) - count(*) + 0.5) - ln(count(*) + 0.5) AS raw FROM art_post GROUP BY ALL),
art_idf AS (SELECT term, df, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM art_raw) ELSE raw END idf FROM art_raw),
hist_query AS (
  SELECT impression_id, regexp_extract_all(lower(string_agg(concat_ws(' ', nullif(title, ''), nullif(subtitle, '')), ' ' ORDER BY rn)), '[\\p{L}\\p{N}_]{2,}')[1:100] tokens
  FROM win JOIN articles USING (article_id) GROUP BY ALL),
hist_terms AS (SELECT impression_id, term, count(*) qtf FROM (SELECT impression_id, unnest(tokens) term FROM hist_query) GROUP BY ALL),
bench_terms AS (SELECT query_id, term, count(*) qtf FROM (SELECT item_id query_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]{2,}')[1:100]) term FROM benchmark) GROUP BY ALL),
bench_scores AS (
  SELECT query_id, article_id, round(sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) score
  FROM bench_terms JOIN idf USING (term) JOIN post USING (term) CROSS JOIN corpus GROUP BY ALL),
bench_rank AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, article_id) AS rk FROM bench_scores),
emb_scores AS (SELECT impression_id, article_id, sum(u.x * v.x) score FROM uvec u JOIN unit_long v USING (dim) GROUP BY ALL),
emb_rank AS (SELECT *, row_number() OVER (PARTITION BY impression_id ORDER BY round(score, 9) DESC, article_id) AS rk FROM emb_scores),
class AS (SELECT user_id, coalesce(c, 0) clicks, CASE WHEN coalesce(c, 0) <= 5 THEN 'cold' ELSE 'warm' END slice FROM (SELECT DISTINCT user_id FROM cand) LEFT JOIN (SELECT user_id, count(*) c FROM hist GROUP BY ALL) USING (user_id)),
head AS (SELECT article_id FROM pop WHERE pop >= (SELECT quantile_cont(pop, 0.8) FROM pop)),
sliced AS (
  SELECT l.*, unnest(['all', class.slice, CASE WHEN head.article_id IS NULL THEN 'tail' ELSE 'head' END]) slice
  FROM late_rows l JOIN class USING (user_id) LEFT JOIN head ON head.article_id = l.article_id),
s_rank AS (SELECT *, row_number() OVER (PARTITION BY slice, impression_id ORDER BY score DESC NULLS LAST, cand_pos) AS rk, count(*) OVER (PARTITION BY slice, impression_id) n FROM sliced)
"""


def _metrics(ranked: str, key: str) -> str:
    """Per impression of a table with rk and n."""
    dcg = lambda k: f"sum(CASE WHEN rk <= {k} THEN label / log2(rk + 1) ELSE 0 END) / (SELECT idcg FROM ideal WHERE k = least(sum(label), {k}))"
    return f"""SELECT {key}, user_id, CASE WHEN count(*) > sum(label) THEN (sum(CASE WHEN label = 1 THEN n + 1 - rk END) - sum(label) * (sum(label) + 1) / 2) / (sum(label) * (count(*) - sum(label))) END auc,
      1 / min(CASE WHEN label = 1 THEN rk END) mrr, {dcg(5)} ndcg5, {dcg(10)} ndcg10 FROM {ranked} GROUP BY {key}, user_id HAVING sum(label) > 0"""


_R = lambda *names: ", ".join(f"round({n}, 6) {n}" for n in names)
_PER = _metrics("ranked", "impression_id")
_MEANS = "round(coalesce(avg(auc), 0.5), 6) auc, round(coalesce(avg(mrr), 0), 6) mrr, round(coalesce(avg(ndcg5), 0), 6) ndcg5, round(coalesce(avg(ndcg10), 0), 6) ndcg10, count(*) n_impressions"
_NOVELTY = "avg(-log2(coalesce(pop / (SELECT sum(pop) FROM pop), 1 / ((SELECT sum(pop) FROM pop) + 1))))"
_CODE = "CAST('0x' || substr(md5(b || '_' || j || '_42'), 1, 8) AS BIGINT)"


def _bootstrap(per: list[str], select: str) -> str:
    """per: SELECTs of per-impression metrics; replicas r0, r1 of each under the same draws."""
    users = " INTERSECT ".join(f"SELECT DISTINCT user_id FROM per{i}" for i in range(len(per)))
    sums = ", ".join(f"sum(w * s_{m}) / nullif(sum(w * c_{m}), 0) {m}" for m in ("auc", "mrr", "ndcg5", "ndcg10"))
    cols = ", ".join(f"coalesce(sum({m}), 0) s_{m}, count({m}) c_{m}" for m in ("auc", "mrr", "ndcg5", "ndcg10"))
    out = ""
    for i, p in enumerate(per):
        out += f", per{i} AS ({p}), sums{i} AS (SELECT user_id, {cols} FROM per{i} GROUP BY ALL)"
    out += f", us AS (SELECT user_id, row_number() OVER (ORDER BY md5(user_id), user_id) - 1 i, count(*) OVER () n FROM ({users}))"
    out += f", draws AS (SELECT b, {_CODE} % n i FROM (SELECT unnest(range(1, 1001)) b) CROSS JOIN (SELECT max(n) n FROM us) CROSS JOIN (SELECT unnest(range(1, (SELECT max(n) + 1 FROM us))) j))"
    out += ", weights AS (SELECT b, user_id, count(*) w FROM draws JOIN us USING (i) GROUP BY ALL)"
    for i in range(len(per)):
        out += f", r{i} AS (SELECT b, {sums} FROM weights JOIN sums{i} USING (user_id) GROUP BY ALL)"
    return out + select


_LONG = "UNPIVOT ({}) ON auc, mrr, ndcg5, ndcg10 INTO NAME metric VALUE x"

_QUERIES = {
    "articles_normalized": "SELECT * FROM articles",
    "history_normalized": f"SELECT user_id, dataset, article_id, click_time, {_R('read_time', 'scroll_pct')} FROM hist",
    "impressions_normalized": "SELECT impression_id, user_id, dataset, impression_time, article_id, label, split, cand_pos FROM imp",
    "parse_history_string": "SELECT user_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY click_time, article_id) AS INT) pos, article_id FROM hist",
    "parse_impressions_string": "SELECT impression_id, article_id, label, cand_pos FROM cand",
    "parse_event_time_text": "SELECT event_id, CASE WHEN event_id % 10 <> 0 THEN date_trunc('second', ts) END parsed FROM events",
    "zip_parallel_arrays": "SELECT user_id, CAST(row_number() OVER w AS INT) pos, article_id, CASE WHEN CAST(user_id AS BIGINT) % 5 <> 0 OR count(*) OVER (PARTITION BY user_id) = 1 THEN click_time END click_time FROM hist WINDOW w AS (PARTITION BY user_id ORDER BY click_time, article_id)",
    "dedup_keep_first": "SELECT l_orderkey, l_partkey, l_shipdate, l_linenumber, l_suppkey FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_partkey ORDER BY l_shipdate, l_linenumber, l_suppkey, l_extendedprice, l_quantity, l_discount, l_tax, l_returnflag, l_linestatus) n FROM lineitem) WHERE n = 1",
    "dedup_min_click": "SELECT user_id, dataset, article_id, click_time FROM hist",
    "chronological_val_test_split": "SELECT impression_id, split FROM halves",
    "history_window_asof": "SELECT cap, impression_id, article_id, click_time, rn FROM win CROSS JOIN (SELECT unnest([10, 50]) AS cap) WHERE rn <= cap",
    "user_click_count": "SELECT impression_id, user_click_count FROM win_feat",
    "recency_sum": f"SELECT impression_id, {_R('user_hist_recency_sum')} FROM ev_feat",
    "session_clicks": "SELECT impression_id, session_clicks_1h, session_clicks_24h FROM ev_feat",
    "dwell_means": f"SELECT impression_id, {_R('hist_mean_read_time', 'hist_mean_scroll')} FROM win_feat",
    "category_affinity": f"SELECT impression_id, article_id, category_match, {_R('cat_affinity')} FROM affinity",
    "freshness_days": f"SELECT impression_id, article_id, {_R('freshness_days')} FROM fresh",
    "popularity_count": "SELECT article_id, pop FROM pop",
    "popularity_percentile": f"SELECT article_id, {_R('pop_pct')} FROM pct",
    "popularity_percentile_cutoff": f"SELECT article_id, {_R('pop_pct')} FROM pct_cut",
    "behavioural_features_full": f"SELECT impression_id, article_id, user_click_count, session_clicks_1h, session_clicks_24h, category_match, {_R('user_hist_recency_sum', 'cat_affinity', 'article_popularity', 'freshness_days', 'hist_mean_read_time', 'hist_mean_scroll')} FROM feat",
    "tokenize_bm25": "SELECT doc_id, array_to_string(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]{2,}'), ' ') tokens FROM documents",
    "tokenize_alnum": "SELECT doc_id, array_to_string(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+'), ' ') tokens FROM documents",
    "vocab_topn": "SELECT term, n, CAST(row_number() OVER (ORDER BY n DESC, term) + 1 AS INT) id FROM (SELECT term, count(*) n FROM (SELECT unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) term FROM documents) GROUP BY ALL HAVING count(*) >= 2) ORDER BY n DESC, term LIMIT 50000",
    "encode_titles_padded": """, vocab AS (SELECT term, row_number() OVER (ORDER BY n DESC, term) + 1 id FROM (SELECT term, count(*) n FROM (SELECT unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) term FROM documents) GROUP BY ALL HAVING count(*) >= 2) ORDER BY n DESC, term LIMIT 50000),
        t AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')[1:20] t FROM documents),
        l AS (SELECT doc_id, unnest(range(1, 21)) pos, t FROM t)
        SELECT CAST(doc_id AS VARCHAR) article_id, string_agg(CAST(CASE WHEN pos > len(t) THEN 0 ELSE coalesce(id, 1) END AS VARCHAR), ' ' ORDER BY pos) ids FROM l LEFT JOIN vocab ON vocab.term = t[pos] GROUP BY doc_id""",
    "bm25_term_stats": f"SELECT term, df, {_R('idf')} FROM idf",
    "bm25_query_terms": "SELECT impression_id, term, qtf FROM hist_terms",
    "bm25_candidate_scores": """, s AS (SELECT impression_id, article_id, sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) score FROM cand JOIN art_post USING (article_id) JOIN hist_terms USING (impression_id, term) JOIN art_idf USING (term) CROSS JOIN art_corpus GROUP BY ALL)
        SELECT impression_id, article_id, round(coalesce(s.score, 0), 6) bm25_score FROM cand LEFT JOIN s USING (impression_id, article_id)""",
    "bm25_topk": "SELECT query_id, CAST(rk AS INT) AS rank, article_id, score FROM bench_rank WHERE rk <= 10",
    "bm25_recall_at_k": """, q AS (SELECT *, least(len(t), 8) m FROM (SELECT item_id query_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]{2,}') t FROM benchmark)),
        qg AS (SELECT DISTINCT query_id, m, array_to_string(t[i:i + m - 1], ' ') gram FROM (SELECT *, unnest(range(1, len(t) - m + 2)) i FROM q WHERE m > 0)),
        g AS (SELECT article_id, m, array_to_string(tokens[i:i + m - 1], ' ') gram FROM (SELECT article_id, tokens, m, unnest(range(1, len(tokens) - m + 2)) i FROM docs_tok CROSS JOIN (SELECT DISTINCT m FROM qg) WHERE len(tokens) >= m)),
        truth AS (SELECT DISTINCT query_id, article_id FROM qg JOIN g USING (m, gram)),
        per AS (SELECT query_id, avg(CASE WHEN rk <= 50 THEN 1.0 ELSE 0 END) r50, avg(CASE WHEN rk <= 100 THEN 1.0 ELSE 0 END) r100, avg(CASE WHEN rk <= 200 THEN 1.0 ELSE 0 END) r200 FROM truth LEFT JOIN bench_rank USING (query_id, article_id) GROUP BY ALL)
        SELECT round(coalesce(avg(r50), 0), 6) recall_50, round(coalesce(avg(r100), 0), 6) recall_100, round(coalesce(avg(r200), 0), 6) recall_200, count(*) n_queries FROM per""",
    "vectors_l2_normalized": "SELECT article_id, CAST(dim AS INT) dim, round(x, 6) x FROM unit_long",
    "user_vector_mean": "SELECT impression_id, CAST(dim AS INT) dim, round(x, 6) x FROM uvec",
    "user_vector_recency_weighted": """, o AS (SELECT impression_id, article_id, row_number() OVER (PARTITION BY impression_id ORDER BY rn DESC) - 1 a, count(*) OVER (PARTITION BY impression_id) n FROM ev_win WHERE article_id IN (SELECT article_id FROM vec)),
        p AS (SELECT impression_id, dim, sum(w * x) / sum(w) x FROM (SELECT *, CASE WHEN n > 1 THEN 0.5 + a / (n - 1) ELSE 0.5 END w FROM o) JOIN vec_long USING (article_id) GROUP BY ALL)
        SELECT impression_id, CAST(dim AS INT) dim, round(x / CASE WHEN nn = 0 THEN 1 ELSE nn END, 6) x FROM (SELECT *, sqrt(sum(x * x) OVER (PARTITION BY impression_id)) nn FROM p)""",
    "user_vector_engagement_weighted": """, o AS (SELECT user_id, article_id, read_time, scroll_pct, row_number() OVER (PARTITION BY user_id ORDER BY click_time, article_id) - 1 a, count(*) OVER (PARTITION BY user_id) n FROM ev_hist),
        p AS (SELECT user_id, dim, sum(w * x) / sum(w) x FROM (SELECT *, CASE WHEN n > 1 THEN 0.5 + a / (n - 1) ELSE 0.5 END * (1 + least(coalesce(read_time, 10) / 30, 2) + coalesce(scroll_pct, 50) / 100) w FROM o) JOIN vec_long USING (article_id) GROUP BY ALL)
        SELECT user_id, CAST(dim AS INT) dim, round(x / CASE WHEN nn = 0 THEN 1 ELSE nn END, 6) x FROM (SELECT *, sqrt(sum(x * x) OVER (PARTITION BY user_id)) nn FROM p)""",
    "emb_candidate_scores": "SELECT i.impression_id, i.article_id, round(coalesce(score, 0), 6) emb_score FROM ev_imp i LEFT JOIN emb_scores USING (impression_id, article_id)",
    "emb_max_sim": """, s AS (SELECT i.impression_id, i.article_id, w.article_id h, sum(a.x * b.x) d FROM ev_imp i JOIN (SELECT DISTINCT impression_id, article_id FROM ev_win) w USING (impression_id) JOIN unit_long a ON a.article_id = i.article_id JOIN unit_long b ON b.article_id = w.article_id AND a.dim = b.dim GROUP BY ALL),
        m AS (SELECT impression_id, article_id, max(d) d FROM s GROUP BY ALL)
        SELECT i.impression_id, i.article_id, round(coalesce(d, 0), 6) emb_max_sim FROM ev_imp i LEFT JOIN m USING (impression_id, article_id)""",
    "stage1_scores": """, s AS (SELECT i.impression_id, i.article_id, w.article_id h, sum(a.x * b.x) d FROM ev_imp i JOIN (SELECT DISTINCT impression_id, article_id FROM ev_win) w USING (impression_id) JOIN unit_long a ON a.article_id = i.article_id JOIN unit_long b ON b.article_id = w.article_id AND a.dim = b.dim GROUP BY ALL),
        m AS (SELECT impression_id, article_id, max(d) d FROM s GROUP BY ALL)
        SELECT i.impression_id, i.article_id, label, round(coalesce(score, 0), 6) emb_score, round(coalesce(d, 0), 6) emb_max_sim
        FROM ev_imp i LEFT JOIN m USING (impression_id, article_id) LEFT JOIN emb_scores USING (impression_id, article_id)""",
    "stream_score_impressions": """, lab AS (SELECT CAST(vec_id AS VARCHAR) article_id, CAST(label AS VARCHAR) category FROM embeddings),
        c AS (SELECT impression_id, category, count(*) n, sum(count(*)) OVER (PARTITION BY impression_id) total FROM ev_win JOIN lab USING (article_id) WHERE category <> '' GROUP BY impression_id, category),
        k AS (SELECT impression_id, count(*) user_click_count FROM ev_win GROUP BY ALL)
        SELECT i.impression_id, i.article_id, i.label, coalesce(user_click_count, 0) user_click_count, round(coalesce(n / total, 0.0), 6) cat_affinity
        FROM ev_imp i LEFT JOIN lab USING (article_id) LEFT JOIN c ON c.impression_id = i.impression_id AND c.category = coalesce(lab.category, '') LEFT JOIN k ON k.impression_id = i.impression_id""",
    "emb_topk": "SELECT impression_id, CAST(rk AS INT) AS rank, article_id, round(score, 6) score FROM emb_rank WHERE rk <= 10",
    "emb_recall_at_k": """, per AS (SELECT impression_id, avg(CASE WHEN rk <= 50 THEN 1.0 ELSE 0 END) r50, avg(CASE WHEN rk <= 100 THEN 1.0 ELSE 0 END) r100, avg(CASE WHEN rk <= 200 THEN 1.0 ELSE 0 END) r200 FROM (SELECT impression_id, article_id FROM ev_imp WHERE label = 1) LEFT JOIN emb_rank USING (impression_id, article_id) GROUP BY ALL)
        SELECT round(coalesce(avg(r50), 0), 6) recall_50, round(coalesce(avg(r100), 0), 6) recall_100, round(coalesce(avg(r200), 0), 6) recall_200, count(*) n_queries FROM per""",
    "rank_within_impression": "SELECT impression_id, article_id, score, CAST(row_number() OVER (PARTITION BY impression_id ORDER BY score DESC NULLS LAST, cand_pos) AS INT) AS rank FROM cand",
    "minmax_blend": "SELECT impression_id, article_id, round((1 / 3e0) * disc + (1 - 1 / 3e0) * CASE WHEN hi > lo THEN (score - lo) / (hi - lo) ELSE 0 END, 6) blend FROM (SELECT *, min(score) OVER (PARTITION BY impression_id) lo, max(score) OVER (PARTITION BY impression_id) hi FROM cand)",
    "impression_metrics": f"SELECT impression_id, user_id, {_R('auc', 'mrr', 'ndcg5', 'ndcg10')} FROM ({_PER})",
    "eval_ranking_all": f"SELECT {_MEANS} FROM ({_PER})",
    "auc_tie_aware": """, t AS (SELECT impression_id, label, rank() OVER (PARTITION BY impression_id ORDER BY score) + (count(*) OVER (PARTITION BY impression_id, score) - 1) / 2.0 r FROM late_rows),
        u AS (SELECT impression_id, (sum(CASE WHEN label = 1 THEN r END) - sum(label) * (sum(label) + 1) / 2.0) / (sum(label) * (count(*) - sum(label))) auc FROM t GROUP BY ALL HAVING sum(label) > 0 AND sum(label) < count(*))
        SELECT round(avg(auc), 6) auc, count(*) n_impressions FROM u""",
    "auc_flat": """, t AS (SELECT label, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 r FROM late_rows)
        SELECT round((sum(CASE WHEN label = 1 THEN r END) - sum(label) * (sum(label) + 1) / 2.0) / nullif(sum(label) * (count(*) - sum(label)), 0), 6) auc FROM t""",
    "novelty": f"SELECT 'quantity' ranker, round({_NOVELTY}, 6) novelty FROM ranked LEFT JOIN pop USING (article_id) WHERE rk <= 10",
    "coverage": "SELECT 'quantity' ranker, round(count(DISTINCT article_id) / (SELECT count(DISTINCT article_id) FROM articles), 6) coverage FROM ranked WHERE rk <= 10",
    "intra_list_diversity": """, c AS (SELECT impression_id, category, count(*) c FROM ranked JOIN articles USING (article_id) WHERE rk <= 10 GROUP BY ALL), l AS (SELECT impression_id, sum(c) n, sum(c * (c - 1) / 2) same FROM c GROUP BY ALL HAVING sum(c) >= 2)
        SELECT 'quantity' ranker, round(avg(1 - same / (n * (n - 1) / 2)), 6) ild FROM l""",
    "slice_cold_warm": "SELECT user_id, clicks, slice FROM class",
    "slice_head_tail": "SELECT a.article_id, CASE WHEN h.article_id IS NULL THEN 'tail' ELSE 'head' END slice FROM articles a LEFT JOIN head h ON h.article_id = a.article_id",
    "evaluation_by_slice": f""", m AS (SELECT slice, {_MEANS} FROM ({_metrics('s_rank', 'slice, impression_id')}) GROUP BY ALL),
        nov AS (SELECT slice, round({_NOVELTY}, 6) novelty FROM s_rank LEFT JOIN pop USING (article_id) WHERE rk <= 10 GROUP BY ALL),
        cov AS (SELECT slice, round(count(DISTINCT article_id) / (SELECT count(DISTINCT article_id) FROM articles), 6) coverage FROM s_rank WHERE rk <= 10 GROUP BY ALL),
        c AS (SELECT slice, impression_id, category, count(*) c FROM s_rank JOIN articles USING (article_id) WHERE rk <= 10 GROUP BY ALL), l AS (SELECT slice, impression_id, sum(c) n, sum(c * (c - 1) / 2) same FROM c GROUP BY ALL HAVING sum(c) >= 2),
        ild AS (SELECT slice, round(avg(1 - same / (n * (n - 1) / 2)), 6) ild FROM l GROUP BY ALL)
        SELECT * FROM m JOIN nov USING (slice) JOIN cov USING (slice) JOIN ild USING (slice)""",
    "bootstrap_ci": _bootstrap([_PER], f", x AS ({_LONG.format('SELECT auc, mrr, ndcg5, ndcg10 FROM r0')}) SELECT metric, round(quantile_cont(x, 0.025), 6) ci_lo, round(quantile_cont(x, 0.975), 6) ci_hi FROM x GROUP BY metric"),
    "paired_bootstrap_ci": ", disc_rank AS (SELECT * REPLACE (row_number() OVER (PARTITION BY impression_id ORDER BY disc DESC NULLS LAST, cand_pos) AS rk) FROM ranked)"
    + _bootstrap(
        [_metrics("disc_rank", "impression_id"), _PER],
        f", x AS ({_LONG.format('SELECT r1.auc - r0.auc auc, r1.mrr - r0.mrr mrr, r1.ndcg5 - r0.ndcg5 ndcg5, r1.ndcg10 - r0.ndcg10 ndcg10 FROM r0 JOIN r1 USING (b)')}) SELECT metric, round(quantile_cont(x, 0.025), 6) ci_lo, round(quantile_cont(x, 0.975), 6) ci_hi, quantile_cont(x, 0.025) > 0 OR quantile_cont(x, 0.975) < 0 excludes_0 FROM x GROUP BY metric",
    ),
    "sample_impressions_seeded": "SELECT impression_id, article_id, label FROM cand WHERE impression_id IN (SELECT impression_id FROM (SELECT DISTINCT impression_id FROM cand) ORDER BY md5(impression_id || '_42'), impression_id LIMIT 500)",
    "negative_sampling": """, n AS (SELECT p.impression_id, p.article_id pos_id, q.article_id neg_id, row_number() OVER w rn, count(*) OVER (PARTITION BY p.impression_id, p.article_id) n FROM cand p JOIN cand q ON p.impression_id = q.impression_id AND p.label = 1 AND q.label = 0
          WINDOW w AS (PARTITION BY p.impression_id, p.article_id ORDER BY md5(p.impression_id || '_' || p.article_id || '_' || q.article_id || '_42'), q.article_id))
        SELECT impression_id, pos_id, CAST(slot AS INT) slot, neg_id FROM n JOIN (SELECT unnest([1, 2, 3, 4]) slot) ON (slot - 1) % n = rn - 1
        UNION ALL SELECT impression_id, pos_id, CAST(slot AS INT), a.article_id FROM
          (SELECT c.impression_id, c.article_id pos_id, slot, '0x' || substr(md5(c.impression_id || '_' || c.article_id || '_' || slot || '_42'), 1, 8) code
           FROM cand c CROSS JOIN (SELECT unnest([1, 2, 3, 4]) slot) WHERE label = 1 AND impression_id NOT IN (SELECT impression_id FROM cand WHERE label = 0))
          JOIN (SELECT article_id, row_number() OVER (ORDER BY md5(article_id), article_id) - 1 i, count(*) OVER () size FROM articles) a ON CAST(code AS BIGINT) % a.size = a.i""",
    "position_bias_verdict": """, t AS (SELECT cand_pos, label, count(*) OVER (PARTITION BY impression_id) n_cand FROM cand), b AS (SELECT n_cand, cand_pos, avg(label) ctr, count(*) shown FROM t GROUP BY ALL),
        r AS (SELECT n_cand, CASE WHEN count(*) > 2 THEN corr(cand_pos, ctr) END rho FROM b GROUP BY n_cand HAVING max(shown) >= 100)
        SELECT round(avg(rho) FILTER (NOT isnan(rho)), 6) mean_rho, coalesce(abs(avg(rho) FILTER (NOT isnan(rho))) >= 0.3, false) biased FROM r""",
    "position_bias": """, t AS (SELECT cand_pos, label, count(*) OVER (PARTITION BY impression_id) n_cand FROM cand), b AS (SELECT n_cand, cand_pos, avg(label) ctr, count(*) shown FROM t GROUP BY ALL)
        SELECT n_cand, max(shown) impressions, round(CASE WHEN count(*) > 2 THEN corr(cand_pos, ctr) END, 6) rho FROM b GROUP BY n_cand HAVING max(shown) >= 100""",
    "ctr_by_position": "SELECT cand_pos, count(*) shown, round(avg(label), 6) ctr FROM cand WHERE cand_pos <= 12 GROUP BY ALL",
    "leakage_violations": "SELECT impression_id, count(*) leaks FROM win WHERE click_time >= impression_time GROUP BY ALL",
    "split_order_violations": "SELECT user_id, max(impression_time) FILTER (split = 'train') last_train, min(impression_time) FILTER (split = 'val') first_val FROM imp GROUP BY ALL HAVING last_train >= first_val",
    "integrity_checks": "SELECT count(*) n_rows, count(*) FILTER (impression_id IS NULL OR user_id IS NULL OR article_id IS NULL) null_ids, count(*) FILTER (label NOT IN (0, 1)) bad_labels, CAST(sum(label) AS BIGINT) positives FROM imp",
    "feature_degeneracy": "".join(
        [", f AS (SELECT impression_id, " + _R("cat_affinity", "article_popularity", "freshness_days") + " FROM feat) "]
        + [" UNION ALL ".join(f"SELECT '{c}' feature, round((SELECT var_samp({c}) FROM f), 6) variance, round((SELECT avg(CASE WHEN d > 1 THEN 1.0 ELSE 0 END) FROM (SELECT count(DISTINCT {c}) d FROM f GROUP BY impression_id)), 6) varies, (SELECT var_samp({c}) FROM f) > 1e-12 ok" for c in ("cat_affinity", "article_popularity", "freshness_days"))]
    ),
    "submission_rank_lists": "SELECT impression_id, impression_id || ' [' || string_agg(CAST(CASE WHEN split = 'test' THEN rk ELSE cand_pos END AS VARCHAR), ',' ORDER BY cand_pos) || ']' line FROM ranked GROUP BY impression_id",
    "submission_ordered_ids": "SELECT impression_id, impression_id || ' [' || string_agg(article_id, ',' ORDER BY rk) || ']' line FROM ranked WHERE split = 'test' GROUP BY impression_id",
    "parse_predictions": "SELECT impression_id, CAST(cand_pos - 1 AS INT) pos, CAST(CASE WHEN split = 'test' THEN rk ELSE cand_pos END AS INT) AS rank FROM ranked",
    "serving_cost_model": """, p AS (SELECT quantile_cont(value / 10, 0.5) p50, quantile_cont(value / 10, 0.95) p95, quantile_cont(value / 10, 0.99) p99 FROM events WHERE value > 0)
        SELECT round(p50, 6) p50, round(p95, 6) p95, round(p99, 6) p99, round(1000 / p99, 6) qps, round(CAST(0.068 AS DOUBLE) / 2 / 3600 / (1000 / p99) * 1000, 9) usd_per_1k, p99 < 100 meets_sla FROM p""",
    "dataset_summary": "SELECT split, count(*) n_rows, count(DISTINCT impression_id) impressions, count(DISTINCT user_id) users, CAST(sum(label) AS BIGINT) positives FROM imp GROUP BY ALL",
}


def oracle_sql() -> dict[str, str]:
    return {k: PRELUDE + q for k, q in _QUERIES.items()}
