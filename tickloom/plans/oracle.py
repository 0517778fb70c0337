"""The registered queries in SQL, over the same tables."""

from __future__ import annotations

from tickloom.operators.routing import REASONING, ROUTINE

TRADES = """trades AS (SELECT p_brand AS ticker, l_shipdate AS ts, l_extendedprice / nullif(l_quantity, 0) AS px, l_quantity AS qty,
  row(l_orderkey, l_linenumber, l_partkey, l_suppkey) AS k FROM lineitem JOIN part ON l_partkey = p_partkey)"""
BARS = f"""{TRADES}, bars AS (SELECT ticker, ts, arg_min(px, k) AS open, max(px) AS high, min(px) AS low, arg_max(px, k) AS close, sum(qty) AS volume,
  false AS adjusted, '1d' AS freq FROM trades GROUP BY ALL)"""
MARKET = f"""{TRADES}, both_trades AS (SELECT * FROM trades UNION ALL SELECT 'SECTOR#' || (regexp_extract(ticker, '([0-9]+)$', 1)::INT % 5), ts, px, qty, k FROM trades),
 closes AS (SELECT ticker, ts, arg_max(px, k) AS close FROM both_trades GROUP BY ALL),
 mbars AS (SELECT *, CASE WHEN ticker = 'Brand#25' THEN 'SECTOR#0' WHEN ticker LIKE 'Brand#%' THEN 'SECTOR#' || (regexp_extract(ticker, '([0-9]+)$', 1)::INT % 5) END AS bench FROM closes),
 rets AS (SELECT *, close / nullif(lag(close) OVER (PARTITION BY ticker ORDER BY ts), 0) - 1 AS ret FROM mbars),
 ars AS (SELECT r.*, r.ret - b.ret AS ar FROM rets r LEFT JOIN rets b ON r.bench = b.ticker AND r.ts = b.ts),
 raw AS (SELECT *, lead(close, 5) OVER w / nullif(close, 0) - 1 AS fwd,
   CASE WHEN count(ar) OVER f = 5 THEN sum(ar) OVER f END AS car,
   CASE WHEN count(ar) OVER b60 >= 20 AND stddev_samp(ar) OVER b60 > 0 THEN stddev_samp(ar) OVER b60 END AS ar_vol,
   CASE WHEN count(ret) OVER b20 >= 10 AND stddev_samp(ret) OVER b20 > 0 THEN stddev_samp(ret) OVER b20 END AS vol
   FROM ars WINDOW w AS (PARTITION BY ticker ORDER BY ts), f AS (PARTITION BY ticker ORDER BY ts ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING),
   b60 AS (PARTITION BY ticker ORDER BY ts ROWS BETWEEN 59 PRECEDING AND CURRENT ROW), b20 AS (PARTITION BY ticker ORDER BY ts ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)),
 feats AS (SELECT *, car / (ar_vol * sqrt(5.0)) AS z FROM raw)"""
EVENTS = "ev AS (SELECT DISTINCT 'Brand#' || (o_orderkey % 25 + 1) AS ticker, o_orderdate AS as_of FROM orders WHERE o_orderpriority = '1-URGENT')"
EVALUATED = f"{MARKET}, {EVENTS}, rows_ AS (SELECT e.ticker, e.as_of, f.fwd, f.car AS ar, f.vol AS score, f.z FROM ev e ASOF LEFT JOIN feats f ON e.ticker = f.ticker AND e.as_of >= f.ts)"
STATS = """count(r) AS n, round(avg((r > 0)::INT::DOUBLE), 4) AS hit_rate, round(avg(r), 6) AS avg_fwd, round(median(r), 6) AS median_fwd,
 round(CASE WHEN stddev_samp(r) > 0 THEN avg(r) / (stddev_samp(r) / sqrt(count(r))) END, 3) AS t_stat"""
SCORED = f"{EVALUATED}, scored AS (SELECT ticker, strftime(as_of, '%Y-%m-%d') AS as_of, z, coalesce(abs(z), 0.0) + 0.5 * exp(-greatest(0, date_diff('day', as_of::DATE, DATE '2001-12-31')) / 365.0) AS score FROM rows_)"
BEST = f"{SCORED}, best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY round(score, 9) DESC, as_of) = 1)"
TAGS = """tags AS (SELECT o_orderkey AS node_id, 'ticker:' || p_brand AS tag FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
 UNION ALL SELECT o_orderkey, 'asof:' || strftime(o_orderdate, '%Y-%m-%d') FROM orders)"""
PAIRS = f"{TAGS}, pairs AS (SELECT DISTINCT a.tag[8:] AS ticker, b.tag[6:] AS as_of FROM tags a JOIN tags b USING (node_id) WHERE starts_with(a.tag, 'ticker:') AND starts_with(b.tag, 'asof:'))"
GRAPH = """v AS (SELECT 'Region:' || r_regionkey AS id, 'Region' AS label, r_name AS name FROM region UNION ALL SELECT 'Nation:' || n_nationkey, 'Nation', n_name FROM nation
 UNION ALL SELECT 'Customer:' || c_custkey, 'Customer', c_name FROM customer),
 e AS (SELECT 'Nation:' || n_nationkey AS src, 'Region:' || n_regionkey AS dst, 'IN_REGION' AS type FROM nation
 UNION ALL SELECT 'Customer:' || c_custkey, 'Nation:' || c_nationkey, 'IN_NATION' FROM customer),
 first AS (SELECT * FROM e ORDER BY src, type, dst LIMIT 40),
 seen AS (SELECT src, left(a.name, 28) AS src_label, a.label AS src_group, type, dst, left(b.name, 28) AS dst_label, b.label AS dst_group FROM first JOIN v a ON src = a.id JOIN v b ON dst = b.id)"""
CALLS = """calls AS (SELECT event_id AS request_id, ts AS end_time, CASE WHEN event_id % 3 = 0 THEN '' WHEN event_id % 3 = 1 THEN event_type END AS model_group, 'vendor/' || event_type AS model,
 value AS spend, (props->>'$.k')::BIGINT AS total_tokens, 'key-' || (user_id % 7) AS alias FROM events),
 keyed AS (SELECT *, coalesce(nullif(model_group, ''), nullif(split_part(model, '/', -1), ''), '—') AS key FROM calls)"""
LOG = "log AS (SELECT event_id, ts, strftime(ts, '%Y-%m-%d') AS date, (props->>'$.k')::BIGINT + floor(value)::BIGINT AS used FROM events)"
OVERVIEW = f"""{CALLS}, keys AS (SELECT alias, sum(spend) AS spend, CASE WHEN alias <> 'key-3' THEN 100000.0::DOUBLE END AS budget FROM calls GROUP BY alias),
 view_ AS (SELECT p.alias, budget, round(coalesce(spend, 0.0), 5) AS spend, round(budget - coalesce(spend, 0.0), 5) AS remaining FROM (SELECT 'key-' || range AS alias FROM range(10)) p LEFT JOIN keys USING (alias))"""
DOCS = """marks AS (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id),
 docs AS (SELECT d.doc_id, d.text, d.source AS doc_type, d.lang, CASE quality WHEN 1 THEN 'high' WHEN 0 THEN 'low' END AS relevance,
 strftime(DATE '1996-01-01' + (d.doc_id % 1500)::INT, '%Y-%m-%d') AS as_of, CASE WHEN d.doc_id % 25 = d.doc_id * 7 % 25 THEN ['Brand#' || (d.doc_id % 25 + 1)]
 ELSE ['Brand#' || (d.doc_id % 25 + 1), 'Brand#' || (d.doc_id * 7 % 25 + 1)] END AS tickers FROM documents d LEFT JOIN marks m ON d.doc_id = m.doc_id)"""
ROUTED = f"""{DOCS}, picked AS (SELECT *, CASE WHEN relevance = 'high' AND length(text) >= 400 THEN 'extractor-pro' WHEN lang IN ('de', 'fr') AND length(coalesce(text, '')) <= 300 THEN 'short-eu'
 WHEN doc_type IN ('src1', 'src2', 'src3') AND regexp_matches(text, 'copyright|license', 'i') THEN 'legal' ELSE 'extractor' END AS model FROM docs)"""
MESSAGES = "messages AS (SELECT conv_id, string_agg(coalesce(text, ''), chr(10) ORDER BY turn, role, text) AS text, conv_id % 3 = 0 AS tools FROM conversations GROUP BY conv_id)"
PROPOSALS = """p AS (SELECT 'sig_' || (c_custkey % 500) AS id, c_name AS thesis, c_custkey AS key, CASE WHEN c_custkey % 6 = 0 THEN 'flat' WHEN c_custkey % 7 = 0 THEN NULL WHEN c_custkey % 2 = 0 THEN 'long' ELSE 'short' END AS direction,
 printf('%08d', c_custkey) AS created_at, CASE WHEN c_custkey % 3 = 0 THEN ['Brand#' || (c_custkey * 2 % 30 + 1), 'Brand#' || (c_custkey * 3 % 30 + 1)] ELSE ['Brand#' || (c_custkey % 30 + 1)] END AS tickers FROM customer)"""


def unicode_words(pattern: str) -> str:
    """A pattern with word borders and word characters for an engine whose own know ASCII only."""
    edge = r"[^\p{L}\p{M}\p{Nd}\p{Pc}]"
    inner = pattern.removeprefix(r"\b").removesuffix(r"\b").replace(r"\w", r"[\p{L}\p{M}\p{Nd}\p{Pc}]")
    return f"(?:^|{edge}){inner}(?:$|{edge})"


def _found(column: str, words: str) -> str:
    return f"regexp_matches(coalesce({column}, ''), '{unicode_words(words)}', 'i')"


def slug(x: str, keep: str, to: str, default: str) -> str:
    return f"coalesce(nullif(trim(regexp_replace({x}, '[^{keep}]+', '{to}', 'g'), '{to}'), ''), '{default}')"


_RAW_SLUG = "(' ^' || p_type || '/' || p_brand || '! ')"
_OUT = """(['DROP', ' drop. ', 'Drop it now', 'dropping this whole document', 'It is below par', 'LOW', ''])[doc_id % 7 + 1] || CASE WHEN doc_id % 5 = 0 THEN chr(10) || 'second line' ELSE '' END"""
_DATES = "CASE o_orderkey % 10 WHEN 9 THEN NULL ELSE strftime(o_orderdate, '%Y-%m-%d') END"
_FOLD = """d AS (SELECT doc_id, text, source, length(text) AS n, trim(coalesce(text, '')) <> '' AS live, lower(text) AS low FROM documents),
 typed AS (SELECT *, CASE WHEN NOT live THEN source WHEN n < 800 THEN 'note' ELSE 'essay' END AS kind, CASE WHEN live AND n < 500 THEN 'short' WHEN live AND n < 4000 THEN 'long' END AS size_label FROM d),
 gated AS (SELECT *, kind = 'note' AS g, kind = 'note' AND live AND n % 10 = 3 AS failed FROM typed),
 done AS (SELECT *, coalesce(g AND live AND NOT failed AND n < 60, false) AS dropped FROM gated)"""

FROM_LATEST = f"""{BARS}, both_ AS (SELECT *, 0 AS b FROM bars WHERE ts < '1999-01-01' UNION ALL SELECT * REPLACE (close * 2 AS close), 1 FROM bars WHERE ts >= '1998-01-01'),
 latest AS (SELECT ticker, strftime(ts, '%Y-%m-%d') AS day, round(close, 6) AS close FROM both_ QUALIFY row_number() OVER (PARTITION BY ticker, ts ORDER BY b DESC) = 1)"""

SQL = {
    "backtest_stats": f"WITH {EVALUATED} SELECT {STATS} FROM (SELECT fwd AS r FROM rows_)",
    "event_rows": f"WITH {EVALUATED} SELECT ticker, strftime(as_of, '%Y-%m-%d') AS as_of, round(fwd, 6) AS fwd, round(ar, 6) AS ar FROM rows_",
    "stats_by_ticker_short": f"WITH {EVALUATED} SELECT ticker, {STATS} FROM (SELECT ticker, -fwd AS r FROM rows_) GROUP BY ticker",
    "skipped_no_data": f"WITH {EVALUATED} SELECT ticker, strftime(as_of, '%Y-%m-%d') AS as_of FROM rows_ WHERE fwd IS NULL",
    "information_coefficient": f"WITH {EVALUATED}, ranked AS (SELECT row_number() OVER (ORDER BY score, as_of, ticker) AS s, row_number() OVER (ORDER BY fwd, as_of, ticker) AS f FROM rows_ WHERE score IS NOT NULL AND fwd IS NOT NULL) SELECT count(*) AS n_pairs, CASE WHEN count(*) >= 3 THEN round(corr(s, f), 4) END AS ic FROM ranked",
    "equity_curve": f"WITH {EVALUATED} SELECT ticker, strftime(as_of, '%Y-%m-%d') AS as_of, round(CASE WHEN e > 0 THEN log10(e) END, 6) AS log10_equity FROM (SELECT ticker, as_of, product(1 + fwd) OVER (ORDER BY as_of, ticker ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS e FROM rows_ WHERE fwd IS NOT NULL)",
    "bars_daily": f"WITH {BARS} SELECT ticker, strftime(ts, '%Y-%m-%d') AS day, round(open, 6) AS open, round(high, 6) AS high, round(low, 6) AS low, round(close, 6) AS close, round(volume, 2) AS volume, adjusted, freq FROM bars",
    "bar_coverage": f"WITH {BARS} SELECT ticker, count(*) AS n_rows, strftime(min(ts), '%Y-%m-%d') AS first_day, strftime(max(ts), '%Y-%m-%d') AS last_day, bool_and(adjusted) AS adjusted FROM bars GROUP BY ticker",
    "read_bars_filtered": f"WITH {BARS} SELECT ticker, strftime(ts, '%Y-%m-%d') AS day, round(close, 6) AS close FROM bars WHERE ticker IN ('Brand#1', 'Brand#12', 'Brand#25') AND ts BETWEEN '1996-03-01' AND '1998-06-30'",
    "upsert_latest_wins": f"WITH {FROM_LATEST} SELECT * FROM latest",
    "store_round_trip": f"WITH {FROM_LATEST} SELECT * FROM latest WHERE ticker IN ('Brand#1', 'Brand#12', 'Brand#25')",
    "returns": f"WITH {MARKET} SELECT ticker, strftime(ts, '%Y-%m-%d') AS day, round(ret, 6) AS ret, round(ar, 6) AS ar FROM ars WHERE bench IS NOT NULL",
    "raw_return_mode": f"WITH {MARKET} SELECT ticker, strftime(ts, '%Y-%m-%d') AS day, round(ret, 6) AS ret, round(ret, 6) AS ar FROM ars WHERE bench IS NOT NULL",
    "price_features": f"WITH {MARKET} SELECT ticker, strftime(ts, '%Y-%m-%d') AS day, round(ret, 6) AS ret, round(ar, 6) AS ar, round(fwd, 6) AS fwd, round(car, 6) AS car, round(ar_vol, 6) AS ar_vol, round(vol, 6) AS vol, round(z, 6) AS z FROM feats WHERE bench IS NOT NULL",
    "label_from_value": f"WITH {MARKET} SELECT ticker, strftime(ts, '%Y-%m-%d') AS day, CASE WHEN round(z, 6) IS NULL THEN NULL WHEN abs(round(z, 6)) >= 1.5 THEN 'high' ELSE 'low' END AS label, CASE WHEN z IS NULL THEN NULL WHEN round(z, 6) >= 0.5 THEN 'up' ELSE 'rest' END AS signed_label, NULL::VARCHAR AS no_label FROM feats WHERE bench IS NOT NULL",
    "registry_compute": f"WITH {MARKET}, {EVENTS}, v30 AS (SELECT ticker, ts, CASE WHEN count(ret) OVER w >= 10 AND stddev_samp(ret) OVER w > 0 THEN stddev_samp(ret) OVER w END AS v FROM rets WINDOW w AS (PARTITION BY ticker ORDER BY ts ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)) SELECT e.ticker, strftime(e.as_of, '%Y-%m-%d') AS as_of, 'realized_vol' AS name, '1.0' AS version, round(v, 6) AS value FROM ev e ASOF LEFT JOIN v30 f ON e.ticker = f.ticker AND e.as_of >= f.ts",
    "asof_close": f"WITH {BARS}, ev AS (SELECT DISTINCT 'Brand#' || (o_orderkey % 25 + 1) AS ticker, o_orderdate AS as_of FROM orders) SELECT e.ticker, strftime(e.as_of, '%Y-%m-%d') AS as_of, strftime(b.ts, '%Y-%m-%d') AS bar_day, round(b.close, 6) AS close FROM ev e ASOF LEFT JOIN bars b ON e.ticker = b.ticker AND e.as_of >= b.ts",
    "events_two_hop": f"WITH {PAIRS} SELECT * FROM pairs",
    "trigger_filter": f"WITH {PAIRS}, blobs AS (SELECT t.tag[8:] AS ticker, string_agg(lower(concat_ws(' ', o_orderpriority, o_orderstatus, o_custkey)), chr(10)) AS blob FROM tags t JOIN orders ON node_id = o_orderkey WHERE starts_with(tag, 'ticker:') GROUP BY ALL) SELECT p.* FROM pairs p JOIN blobs USING (ticker) WHERE ticker IN ('Brand#1', 'Brand#2', 'Brand#3') AND contains(blob, 'urgent f 11') AND (contains(blob, 'high o 2') OR contains(blob, 'nothing'))",
    "sweep_rank": f"WITH {BEST} SELECT ticker, as_of, round(z, 6) AS z, round(score, 6) AS score FROM best",
    "sweep_top": f"WITH {BEST} SELECT ticker, as_of, round(score, 6) AS score FROM best ORDER BY round(best.score, 9) DESC, ticker LIMIT 3",
    "chunk_lookup": f"WITH {TAGS}, m AS (SELECT a.tag[8:] AS ticker, b.tag[6:] AS as_of, min(node_id) AS id FROM tags a JOIN tags b USING (node_id) WHERE starts_with(a.tag, 'ticker:') AND starts_with(b.tag, 'asof:') GROUP BY ALL) SELECT ticker, as_of, left(concat_ws(' ', o_orderpriority, o_orderstatus, o_orderkey), 600) AS chunk FROM m JOIN orders ON id = o_orderkey",
    "benchmark_map": "SELECT DISTINCT p_brand AS ticker, CASE WHEN p_brand = 'Brand#25' THEN 'SECTOR#0' ELSE 'SECTOR#' || (regexp_extract(p_brand, '([0-9]+)$', 1)::INT % 5) END AS bench FROM part",
    "link_tickers": f"SELECT doc_id, concat_ws(',', CASE WHEN doc_id % 10 = 0 THEN 'WATER,OTHER' END, CASE WHEN {_found('text', '(?:DATA|data set|table)')} THEN 'DATA' END, CASE WHEN {_found('text', '(?:TIME|day|year)')} THEN 'TIME' END, CASE WHEN doc_id % 10 <> 0 AND {_found('text', '(?:WATER|river|sea)')} THEN 'WATER' END) AS tickers FROM documents",
    "normalized_dates": f"SELECT o_orderkey, {_DATES} AS as_of FROM orders",
    "provenance_tags": f"WITH {DOCS} SELECT doc_id, array_to_string(list_transform(tickers, lambda x: 'ticker:' || x), '|') || CASE WHEN doc_id % 4 <> 0 THEN '|asof:' || as_of ELSE '' END AS tags FROM docs",
    "route_documents": f"WITH {ROUTED} SELECT doc_id, CASE WHEN doc_id % 50 = 2 THEN 'manual' ELSE model END AS model, length(coalesce(text, '')) <= 5000 AS fits FROM picked",
    "bucket_tokens": f"WITH {ROUTED} SELECT model, count(*) AS items, sum(greatest(1, length(coalesce(text, '')) // 4))::BIGINT AS tokens FROM picked GROUP BY model",
    "gates_and_labels": f"WITH o AS (SELECT doc_id, {_OUT} AS out FROM documents), h AS (SELECT *, trim(out, ' ' || chr(10)) AS whole FROM o) SELECT doc_id, whole <> '' AND (upper(trim(trim(split_part(whole, chr(10), 1)), '.:!\"'' ')) = 'DROP' OR (starts_with(upper(whole), 'DROP') AND length(whole) <= 16)) AS dropped, CASE WHEN contains(lower(out), 'high') THEN 'high' WHEN contains(lower(out), 'low') THEN 'low' END AS label FROM h",
    "feature_step": f"WITH {MARKET}, {DOCS}, x AS (SELECT doc_id, unnest(tickers) AS ticker, generate_subscripts(tickers, 1) AS ord, as_of::TIMESTAMP AS at FROM docs), j AS (SELECT x.*, f.vol FROM x ASOF LEFT JOIN feats f ON x.ticker = f.ticker AND x.at >= f.ts), top AS (SELECT * FROM j WHERE vol IS NOT NULL QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY abs(vol) DESC, ord) = 1) SELECT doc_id, ticker, round(vol, 6) AS value, CASE WHEN vol >= 1.0 THEN 'high' ELSE 'low' END AS label FROM top",
    "pipeline_fold": f"WITH {_FOLD}, texted AS (SELECT *, CASE WHEN dropped THEN NULL WHEN g AND live AND NOT failed THEN '> ' || text WHEN kind = 'essay' AND live THEN low ELSE text END AS new FROM done) SELECT doc_id, dropped, kind AS doc_type, size_label, (2 + coalesce(kind = 'note', false)::INT + coalesce(kind = 'essay', false)::INT)::INT AS n_steps, coalesce(failed, false) AS failed, length(new)::INT AS n_chars, md5(new) AS text_md5 FROM texted",
    "tier_router": f"WITH {MESSAGES}, r AS (SELECT *, CASE WHEN conv_id % 11 = 0 THEN 'explicit:low' WHEN {_found('text', REASONING)} THEN 'reasoning_pattern' WHEN tools AND length(text) > 1500 THEN 'tools_with_long_context' WHEN {_found('text', ROUTINE)} THEN 'routine_pattern' WHEN length(text) < 800 AND NOT tools THEN 'short_request' ELSE 'default' END AS reason FROM messages) SELECT conv_id, CASE reason WHEN 'reasoning_pattern' THEN 'high' WHEN 'explicit:low' THEN 'low' WHEN 'routine_pattern' THEN 'low' WHEN 'short_request' THEN 'low' ELSE 'mid' END AS tier, reason FROM r",
    "spend_by_model": f"WITH {CALLS} SELECT key AS model, count(*) AS n, round(sum(spend), 6) AS spend, sum(total_tokens)::BIGINT AS tokens FROM keyed GROUP BY key",
    "ledger_recent": f"WITH {CALLS} SELECT request_id, strftime(end_time, '%Y-%m-%d %H:%M:%S') AS end_time, key AS model, round(spend, 6) AS spend FROM keyed ORDER BY keyed.end_time DESC NULLS LAST, request_id LIMIT 200",
    "ledger_totals": f"WITH {CALLS} SELECT count(*) AS n, round(sum(spend), 6) AS spend, sum(total_tokens)::BIGINT AS tokens FROM calls",
    "daily_tokens": f"WITH {LOG} SELECT date, sum(used)::BIGINT AS tokens, CASE WHEN sum(used) >= 90000 THEN 'exhausted' WHEN sum(used) >= 60000 THEN 'warn' ELSE 'ok' END AS state FROM log GROUP BY date",
    "budget_gate": f"WITH {LOG}, r AS (SELECT *, sum(used) OVER (PARTITION BY date ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM log) SELECT event_id, (upto - used)::BIGINT AS spent_before, upto - used >= 50000 AS refused, upto >= 30000 AS soft_warn FROM r",
    "overview": f"WITH {OVERVIEW} SELECT * FROM view_",
    "overview_totals": f"WITH {OVERVIEW} SELECT round(sum(coalesce(budget, 0.0)), 2) AS total_budget, round(sum(spend), 5) AS total_spend FROM view_",
    "recent_20_per_key": f"WITH {CALLS} SELECT alias, request_id FROM calls QUALIFY row_number() OVER (PARTITION BY alias ORDER BY end_time DESC, request_id) <= 20",
    "graph_counts": f"WITH {GRAPH} SELECT (SELECT count(*) FROM v) AS nodes, (SELECT count(*) FROM e) AS edges",
    "graph_labels": f"WITH {GRAPH} SELECT DISTINCT 'label' AS kind, label AS name FROM v UNION ALL SELECT DISTINCT 'relation', type FROM e",
    "graph_preview": f"WITH {GRAPH} SELECT * FROM seen",
    "graph_preview_nodes": f'WITH {GRAPH} SELECT src AS id, src_label AS label, src_group AS "group" FROM seen UNION SELECT dst, dst_label, dst_group FROM seen',
    "signal_upsert": f"WITH {PROPOSALS} SELECT id, thesis, direction, created_at FROM p QUALIFY row_number() OVER (PARTITION BY id ORDER BY created_at >= '00000300' DESC, created_at DESC) = 1",
    "signal_edges": f"WITH {PROPOSALS}, {TAGS} SELECT DISTINCT id, tag FROM (SELECT id, 'ticker:' || unnest(tickers) AS tag FROM p) WHERE tag IN (SELECT tag FROM tags)",
    "validate_proposals": f"WITH {PROPOSALS} SELECT thesis, concat_ws('; ', CASE WHEN key % 9 = 0 THEN 'missing ''id''' END, CASE WHEN direction IS NULL THEN 'missing ''direction''' END, CASE WHEN key % 4 = 0 THEN 'missing ''trigger''' END, CASE WHEN direction = 'flat' THEN 'direction must be long|short' END, CASE WHEN key % 4 = 0 OR key % 5 = 0 THEN 'trigger.match required' END) AS problems FROM p",
    "horizons": "SELECT o_orderkey, ([5, 10, 3, 5, 5, 5, 7, 5])[o_orderkey % 8 + 1]::INT AS horizon FROM orders",
    "missing_models": f"SELECT pool_name, min(p_type) AS model FROM (SELECT p_type, 'or--' || {slug('lower(p_type)', 'a-z0-9', '-', 'model')} AS pool_name FROM part) WHERE pool_name NOT IN (SELECT 'or--' || {slug('lower(p_type)', 'a-z0-9', '-', 'model')} FROM part WHERE p_type < 'M') GROUP BY pool_name",
    "allow_list": "SELECT p_brand AS name FROM part UNION SELECT c_mktsegment FROM customer",
    "slugs": f"SELECT p_partkey, {slug(_RAW_SLUG, 'A-Za-z0-9', '_', 'ticker')} AS safe, {slug(f'lower({_RAW_SLUG})', 'a-z0-9', '-', 'model')} AS slug, 'or--' || {slug(f'lower({_RAW_SLUG})', 'a-z0-9', '-', 'model')} AS pool, regexp_replace(trim({_RAW_SLUG}), '[^A-Za-z0-9_]', '_', 'g') AS onto, split_part({_RAW_SLUG}, '/', -1) AS last, left({slug(f'lower({_RAW_SLUG})', 'a-z0-9', '-', 'signal')}, 24) AS proposal, regexp_replace({_RAW_SLUG}, '[^A-Za-z0-9._-]', '_', 'g') AS file FROM part",
    "inventory_drift": "WITH n AS (SELECT p_partkey AS k, CASE WHEN p_size % 10 = 0 THEN 0 ELSE p_size END AS size, p_size * 100 + p_partkey % 5 AS rows_, CASE WHEN p_partkey % 7 <> 0 THEN (p_size * 100)::BIGINT END AS prev_rows FROM part), d AS (SELECT *, CASE WHEN prev_rows > 0 THEN abs(rows_ - prev_rows) / prev_rows * 100 END AS drift FROM n) SELECT 'f' || k AS path, prev_rows, round(drift, 6) AS drift, CASE WHEN size = 0 THEN 'ZERO-BYTE' WHEN drift > 1 THEN 'ROW-DRIFT' END AS anomaly FROM d",
    "inventory_anomalies": "SELECT count(*) AS files, count(*) FILTER (p_size % 10 = 0) AS zero_bytes, count(*) FILTER (p_size > 0 AND (p_partkey % 5) / (p_size * 100) * 100 > 1) AS drifts FROM part",
    "vector_topk": f"SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], {[((k * 37) % 11 - 5) / 5 for k in range(64)]}::DOUBLE[]), 6) AS score FROM embeddings ORDER BY list_cosine_similarity(embedding::DOUBLE[], {[((k * 37) % 11 - 5) / 5 for k in range(64)]}::DOUBLE[]) DESC, vec_id LIMIT 10",
    "message_previews": f"WITH {MESSAGES} SELECT conv_id, left(text, 300) AS preview, greatest(1, length(text) // 4)::BIGINT AS tokens FROM messages",
    "log_tails": "SELECT doc_id, right(array_to_string(list_filter(string_split(regexp_replace('red line' || chr(10) || chr(10) || coalesce(text, ''), chr(27) || '\\[[0-9;]*m', '', 'g'), chr(10)), lambda x: NOT regexp_matches(x, '^\\s*(\\d{4}-\\d\\d-\\d\\dT|$)')), chr(10)), 80) AS tail FROM documents",
    "log_tails_whole": "SELECT doc_id, right(array_to_string(list_filter(string_split(regexp_replace('red line' || chr(10) || chr(10) || coalesce(text, ''), chr(27) || '\\[[0-9;]*m', '', 'g'), chr(10)), lambda x: NOT regexp_matches(x, '^\\s*(\\d{4}-\\d\\d-\\d\\dT|$)')), chr(10)), 6000) AS tail FROM documents",
    "role_models": f"WITH m AS (SELECT DISTINCT p_brand, CASE p_brand WHEN 'Brand#1' THEN 'vendor/One' WHEN 'Brand#2' THEN 'vendor/Two.1' ELSE p_brand END AS model FROM part) SELECT p_brand, model, 'or--' || {slug('lower(model)', 'a-z0-9', '-', 'model')} AS gateway FROM m",
    "ids_and_maps": f"SELECT o_orderkey, 'sig_' || epoch(o_orderdate)::BIGINT || '_' || left({slug('lower(o_orderpriority)', 'a-z0-9', '-', 'signal')}, 24) AS id, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') || '+00:00' AS at, CASE WHEN o_orderkey % 3 = 0 THEN 'judge=mid,reader=small,writer=huge' ELSE 'reader=small,writer=big' END AS roles FROM orders",
    "fuzzy_names": "WITH n AS (SELECT unnest(['Economical', 'Standard', 'PROMOS', 'smal', 'medium', 'largest']) AS name), d AS (SELECT DISTINCT p_type FROM part), e AS (SELECT p_type, name, levenshtein(lower(p_type), lower(name)) AS edits FROM d, n), b AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY p_type ORDER BY edits, name) = 1) SELECT p_type, CASE WHEN edits <= 2 THEN name END AS name, CASE WHEN edits <= 9 THEN name END AS any_name FROM b",
    "calls_of_key": f"WITH {CALLS} SELECT count(*) AS n, round(sum(spend), 6) AS spend, sum(total_tokens)::BIGINT AS tokens FROM calls WHERE alias = 'key-2'",
    "ontology_triples": "WITH n AS (SELECT n_name || ' x' AS name, replace(n_name, ' ', '_') || '_x' AS s FROM nation), r AS (SELECT 'in ' || r_name AS name, 'in_' || replace(r_name, ' ', '_') AS s, r_regionkey, replace(r_name, ' ', '_') AS target FROM region) SELECT s, 'rdf:type' AS p, 'owl:Class' AS o FROM n UNION SELECT s, 'rdfs:label', name FROM n UNION SELECT s, 'rdf:type', 'owl:ObjectProperty' FROM r UNION SELECT s, 'rdfs:label', name FROM r UNION SELECT s, 'rdfs:domain', 'Nation' FROM r WHERE r_regionkey <> 1 UNION SELECT s, 'rdfs:range', target FROM r",
}
