"""Registered queries that go through files, stores and streams, and whole plans; each stands beside its SQL."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom import schema
from tickloom.functions import text
from tickloom.operators import graph, inventory, ledger, linker, proposals, routing, steps, vectors
from tickloom.plans import tables as t
from tickloom.plans.backtest import backtest
from tickloom.plans.oracle import BARS, DOCS, EVENTS, FROM_LATEST, LOG, MARKET, PAIRS
from tickloom.plans.queries import PICKED, TODAY, _day, _market, toy_model
from tickloom.shared import new_path
from tickloom.sources import files
from tickloom.sources.bars import make_adapter
from tickloom.sources.store import close_series, coverage, ingest, read_bars, summary
from tickloom.streaming import bars as streams

TRIGGER = {"match": {"tickers": ["Brand#1", "Brand#2", "Brand#3"], "entityAny": ["urgent f 11"], "keywordAny": ["HIGH O 2", "nothing"]}}


def csv_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All bars as CSV with foreign names and some closes missing, read by the adapter for some tickers and years."""
    path = new_path(spark, "csv")
    close = F.when(F.dayofmonth("ts") != 13, F.col("close"))
    t.bars(spark, sf_dir).select(F.col("ticker").alias("symbol"), _day("ts").alias("day"), "open", "high", "low", close.alias("last"), "volume").write.option("header", True).csv(path)
    source = make_adapter({"kind": "csvdir", "path": path, "column_map": {"ticker": "symbol", "ts": "day", "close": "last"}, "adjusted": True})
    bars = source.load_history(spark, PICKED, "1995-01-01", "1997-12-31")
    return bars.select("ticker", _day("ts").alias("day"), F.round("open", 6).alias("open"), F.round("close", 6).alias("close"), "adjusted", "freq")


def parquet_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All bars from a Parquet folder into a store: what was upserted, its summary, coverage and closes."""
    path, store = new_path(spark, "bars-in"), new_path(spark, "bars")
    t.bars(spark, sf_dir).withColumnRenamed("ts", "date").drop("adjusted", "freq").write.parquet(path)
    detail = ingest(spark, {"kind": "parquetdir", "path": path}, store)
    row = lambda kind, n, value: (F.lit(kind).alias("kind"), n.cast("long").alias("n"), value.alias("value"))
    parts = [
        detail.select("ticker", *row("upserted", F.col("rows"), F.col("freq"))),
        summary(detail).select(F.lit("all").alias("ticker"), *row("summary", F.col("rows"), F.col("tickers").cast("string"))),
        coverage(read_bars(spark, store)).select("ticker", *row("covered", F.col("rows"), F.concat_ws(" ", _day("first"), _day("last")))),
        close_series(spark, store, PICKED).groupBy("ticker").agg(F.count("*").alias("rows"), F.max("close").alias("c")).select("ticker", *row("closes", F.col("rows"), F.round("c", 2).cast("decimal(18,2)").cast("string"))),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


def _log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.token_log(spark, sf_dir).select(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("ts"), "date", "input_tokens", "output_tokens")


def token_log_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The token log appended twice as JSON lines, with broken lines between: days, and what one day spent."""
    path, log = new_path(spark, "log"), _log_lines(spark, sf_dir)
    for half in ("date < '2024-01-16'", "date >= '2024-01-16'"):
        files.append_jsonl(log.where(half), path)
        spark.createDataFrame([("{broken",), ("not json",)], "value string").write.mode("append").text(path)
    read = files.read_jsonl(spark, path, files.TOKEN_LOG)
    return ledger.daily_tokens(read).unionByName(ledger.spent_on(read, "2024-01-15").withColumn("date", F.lit("on the 15th")))


def file_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A text file for each nation: its size and hash, as a snapshot finds them."""
    path = new_path(spark, "files")
    t.table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("value")).repartition(1).write.partitionBy("n_nationkey").text(path)
    found = inventory.snapshot(spark, path).where("path LIKE '%.txt'")
    return found.select(F.regexp_extract("path", "n_nationkey=([0-9]+)", 1).cast("int").alias("nation"), "size", "sha256")


def text_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts of files with an allowed suffix."""
    path = new_path(spark, "texts")
    rows = t.table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("value")).repartition(1)
    rows.write.partitionBy("n_nationkey").text(path)
    rows.write.mode("append").parquet(f"{path}/other")  # no text suffix
    return files.read_texts(spark, path).select(F.btrim("text", F.lit("\n")).alias("text"), F.regexp_extract("name", "([.]txt)$", 1).alias("suffix"))


def proposals_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proposals as one JSON file each, and a broken one, read back as the queue with their trigger's tickers."""
    path = new_path(spark, "proposals")
    some = lambda *x: F.array(*[F.lit(v) for v in x])
    wanted = F.when(F.col("r_regionkey") % 2 == 0, some("A", "B")).otherwise(some().cast("array<string>"))
    rows = t.table(spark, sf_dir, "region").select("r_regionkey", F.concat(F.lit("sig_"), "r_name").alias("id"), F.lit("long").alias("direction"), some("U").alias("universe"), F.when(F.col("r_regionkey") != 3, F.format_string("2024-01-%02d", F.col("r_regionkey") + 1)).alias("created_at"), F.struct(F.struct(wanted.alias("tickers")).alias("match")).alias("trigger"))
    rows.repartition(1).write.partitionBy("r_regionkey").json(path)
    spark.createDataFrame([("{broken",)], "value string").write.text(f"{path}/r_regionkey=9")
    queue = proposals.queue(files.read_proposals(spark, path))
    return queue.select("id", "created_at", F.concat_ws(",", proposals.trigger_tickers(F.col("trigger.match.tickers"), F.col("universe"))).alias("tickers"))


def message_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text of every message, whose content is a string on even turns and parts on odd ones."""
    c = t.table(spark, sf_dir, "conversations")
    part = lambda x: F.struct(x.cast("string").alias("text"))
    content = F.when(F.col("turn") % 2 == 1, F.array(part(F.col("role")), part(F.lit(None)), part(F.col("text"))))
    return c.select("conv_id", "turn", F.md5(text.message_text(content, F.when(F.col("turn") % 2 == 0, F.col("text"))).cast("binary")).alias("text_md5"))


def backtest_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship plan with a trigger and a score feature: statistics, curve and versions in one row."""
    nodes = t.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.concat_ws(" ", "o_orderpriority", "o_orderstatus", F.col("o_custkey").cast("string")).alias("name"), F.lit(None).cast("string").alias("text"))
    run = backtest(_market(spark, sf_dir), trigger=TRIGGER, tags=t.order_tags(spark, sf_dir), vertices=nodes, score_feature="realized_vol", curve_rows=1_000_000)
    versions = ",".join(f"{k}={v}" for k, v in sorted(run.feature_versions.items()))
    return run.stats.select("n", "hit_rate", "avg_fwd", "median_fwd", "t_stat", "ic", F.size("equity_curve").cast("long").alias("n_curve"), F.get("equity_curve", F.lit(0)).alias("first_equity"), F.lit(versions).alias("versions"))


def feature_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fold with a text step and two feature steps: a label by threshold, and the value where there is none."""
    docs = t.documents(spark, sf_dir).select("doc_id", "text", "tickers", "as_of")
    fold = [
        {"id": "size", "output": "signal", "metaKey": "size", "labels": ["short", "long"], "prompt": "size"},
        {"engine": "feature", "feature": "realized_vol", "metaKey": "vol"},
        {"engine": "feature", "feature": "realized_vol", "metaKey": "risk", "thresholds": {"high": 1.0}},
        {"engine": "feature", "metaKey": "none"},
    ]
    out = steps.run_steps(docs, fold, toy_model, bars=_market(spark, sf_dir))
    mark = lambda k: F.try_element_at("meta", F.lit(k))
    return out.select("doc_id", mark("size").alias("size_label"), mark("vol").cast("double").alias("vol"), mark("risk").alias("risk"), F.size("trace").alias("n_steps"))


def capture_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars that arrive in two files, the later with restated days, captured by two runs from one checkpoint."""
    incoming, store, checkpoint = (new_path(spark, x) for x in ("incoming", "bars", "capture"))
    bars = t.bars(spark, sf_dir)
    for part in (bars.where("ts < '1999-01-01'"), bars.where("ts >= '1998-01-01'").withColumn("close", F.col("close") * 2)):
        part.coalesce(1).write.mode("append").parquet(incoming)
        streams.capture(spark, incoming, store, checkpoint).awaitTermination()
    return read_bars(spark, store).select("ticker", _day("ts").alias("day"), F.round("close", 6).alias("close"))


def token_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The days of the streamed token log, each as the stream last gave it."""
    path, out, checkpoint = (new_path(spark, x) for x in ("log", "days", "stream"))
    files.append_jsonl(_log_lines(spark, sf_dir), path)
    days = streams.daily_tokens(spark, path).writeStream.outputMode("complete").option("checkpointLocation", checkpoint).trigger(availableNow=True)
    days.foreachBatch(lambda batch, n: batch.withColumn("batch", F.lit(n)).write.mode("append").parquet(out)).start().awaitTermination()
    return spark.read.parquet(out).groupBy("day").agg(F.max_by("tokens", "batch").alias("tokens"))


def model_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model ids with their display names, the hidden one left out."""
    part = t.table(spark, sf_dir, "part")
    ids = part.select(F.lower("p_type").alias("id")).distinct().unionByName(spark.createDataFrame([("embed",), ("other",)], "id string"))
    info = part.where("p_type < 'M'").select(F.lower("p_type").alias("id"), F.concat(F.lit("The "), "p_type").alias("name"))
    return ledger.with_display(ids, info)


def output_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = F.when(F.col("event_id") % 5 != 0, (F.col("event_id") % 7) * 1000)
    return t.table(spark, sf_dir, "events").select("event_id", routing.output_cap(asked).cast("long").alias("cap"))


def symbol_config(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A symbol map kept as a seed, materialised as the local copy and loaded from there: a row for each alias."""
    known = t.symbols(spark, sf_dir).collect()  # a config: one row a brand
    seed, local = new_path(spark, "seed"), new_path(spark, "local")
    files.save_config(spark, seed, {"tickers": {r["ticker"]: {"benchmark": r["benchmark"], "aliases": [r["ticker"].lower()]} for r in known}})
    files.materialise(spark, local, seed, {"defaultBenchmark": t.DEFAULT, "tickers": {}})
    loaded = files.load_symbols(spark, [local, seed])
    rows = linker.symbol_table(spark, loaded)
    return rows.select("ticker", "alias", "benchmark", F.lit(loaded["defaultBenchmark"]).alias("fallback"))


def missing_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What tables lack to be bars: columns, and how many of their rows can't be one."""
    bars = t.bars(spark, sf_dir)
    holes = bars.withColumn("close", F.when(F.dayofmonth("ts") != 13, F.col("close"))).withColumn("ticker", F.when(F.month("ts") != 2, F.col("ticker")))
    frames = {"bars": bars, "holes": holes, "events": t.table(spark, sf_dir, "events"), "nation": t.table(spark, sf_dir, "nation")}
    out = [df.agg(F.count("*").alias("n"), F.count_if(schema.incomplete(df)).alias("incomplete")).select(F.lit(name).alias("name"), F.lit(",".join(schema.missing(df))).alias("lacking"), "n", "incomplete") for name, df in frames.items()]
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3])


def recall_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest of all vectors for every vector whose id is divisible by 20."""
    e = t.table(spark, sf_dir, "embeddings")
    queries = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    return vectors.recall_each(e, queries, 10).select("query_id", "vec_id", F.round("score", 6).alias("score"))


def integrity_exit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exit code of three checks: clean files, some with an anomaly, none at all."""
    part = t.table(spark, sf_dir, "part")
    row = lambda rows: part.select(F.col("p_partkey").alias("path"), F.lit(1).cast("long").alias("size"), rows.cast("long").alias("rows"))
    now, before = row(F.col("p_size") * 100 + F.col("p_partkey") % 5), row(F.col("p_size") * 100)
    runs = {"clean": (before, before), "drifted": (now, before), "empty": (now.limit(0), before)}
    out = [inventory.exit_code(inventory.anomalies(inventory.compare(a, b))).select(F.lit(k).alias("run"), F.col("code").cast("int").alias("code")) for k, (a, b) in runs.items()]
    return out[0].unionByName(out[1]).unionByName(out[2])


_TRIGGERED = """blobs AS (SELECT t.tag[8:] AS ticker, string_agg(lower(concat_ws(' ', o_orderpriority, o_orderstatus, o_custkey)), chr(10)) AS blob FROM tags t JOIN orders ON node_id = o_orderkey WHERE starts_with(tag, 'ticker:') GROUP BY ALL),
 hit AS (SELECT p.ticker, p.as_of::TIMESTAMP AS as_of FROM pairs p JOIN blobs USING (ticker) WHERE ticker IN ('Brand#1', 'Brand#2', 'Brand#3') AND contains(blob, 'urgent f 11') AND (contains(blob, 'high o 2') OR contains(blob, 'nothing')))"""
_RECORD = f"""WITH {MARKET}, {PAIRS}, {_TRIGGERED}, rows_ AS (SELECT e.ticker, e.as_of, f.fwd, f.vol AS score FROM hit e ASOF LEFT JOIN feats f ON e.ticker = f.ticker AND e.as_of >= f.ts),
 ranked AS (SELECT row_number() OVER (ORDER BY score, as_of, ticker) AS s, row_number() OVER (ORDER BY fwd, as_of, ticker) AS f FROM rows_ WHERE score IS NOT NULL AND fwd IS NOT NULL)
 SELECT count(fwd) AS n, round(avg((fwd > 0)::INT::DOUBLE), 4) AS hit_rate, round(avg(fwd), 6) AS avg_fwd, round(median(fwd), 6) AS median_fwd,
 round(CASE WHEN stddev_samp(fwd) > 0 THEN avg(fwd) / (stddev_samp(fwd) / sqrt(count(fwd))) END, 3) AS t_stat, (SELECT CASE WHEN count(*) >= 3 THEN round(corr(s, f), 4) END FROM ranked) AS ic,
 count(fwd) AS n_curve, round(1 + arg_min(fwd, (as_of, ticker)) FILTER (fwd IS NOT NULL), 6) AS first_equity, 'cum_abnormal_return=1.0,forward_return=1.0,realized_vol=1.0' AS versions FROM rows_"""
_WALK = """d AS (SELECT day, row_number() OVER (ORDER BY day) - 1 AS n FROM (SELECT (DATE '2024-01-01' + range::INT)::DATE AS day FROM range(100)) WHERE isodow(day) <= 5 QUALIFY n < 60),
 g AS (SELECT ticker, d.day, n, x FROM (SELECT DISTINCT p_brand AS ticker FROM part) v, d, (VALUES ('close'), ('open'), ('high'), ('low')) k(x)),
 u AS (SELECT *, (CAST('0x' || substr(md5(ticker || ':0:' || n || ':' || x || ':1'), 1, 13) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS a, (CAST('0x' || substr(md5(ticker || ':0:' || n || ':' || x || ':2'), 1, 13) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS b FROM g),
 z AS (SELECT ticker, day, n, x, sqrt(-2 * ln(a)) * cos(2 * pi() * b) AS z FROM u), p AS (SELECT * FROM (PIVOT z ON x IN ('close', 'open', 'high', 'low') USING first(z) GROUP BY ticker, day, n)),
 c AS (SELECT *, 100 * exp(sum(0.0003::DOUBLE + 0.015::DOUBLE * "close") OVER (PARTITION BY ticker ORDER BY n)) AS last FROM p)"""

SQL = {
    "csv_source": f"WITH {BARS} SELECT ticker, strftime(ts, '%Y-%m-%d') AS day, round(open, 6) AS open, round(close, 6) AS close, true AS adjusted, freq FROM bars WHERE day(ts) <> 13 AND ticker IN ('Brand#1', 'Brand#12', 'Brand#25') AND ts BETWEEN '1995-01-01' AND '1997-12-31'",
    "parquet_ingest": f"WITH {BARS} SELECT ticker, 'upserted' AS kind, count(*) AS n, '1d' AS value FROM bars GROUP BY ticker UNION ALL SELECT 'all', 'summary', count(*), count(DISTINCT ticker)::VARCHAR FROM bars UNION ALL SELECT ticker, 'covered', count(*), strftime(min(ts), '%Y-%m-%d') || ' ' || strftime(max(ts), '%Y-%m-%d') FROM bars GROUP BY ticker UNION ALL SELECT ticker, 'closes', count(*), round(max(close), 2)::DECIMAL(18,2)::VARCHAR FROM bars WHERE ticker IN ('Brand#1', 'Brand#12', 'Brand#25') GROUP BY ticker",
    "token_log_files": f"WITH {LOG} SELECT date, sum(used)::BIGINT AS tokens FROM log GROUP BY date UNION ALL SELECT 'on the 15th', coalesce(sum(used), 0)::BIGINT FROM log WHERE date = '2024-01-15'",
    "file_snapshot": "SELECT n_nationkey::INT AS nation, strlen(n_name) + 1 AS size, sha256(n_name || chr(10)) AS sha256 FROM nation",
    "text_files": "SELECT n_name AS text, '.txt' AS suffix FROM nation",
    "proposals_queue": "SELECT 'sig_' || r_name AS id, CASE WHEN r_regionkey <> 3 THEN '2024-01-' || printf('%02d', r_regionkey + 1) END AS created_at, CASE WHEN r_regionkey % 2 = 0 THEN 'A,B' ELSE 'U' END AS tickers FROM region",
    "message_texts": "SELECT conv_id, turn, md5(CASE WHEN turn % 2 = 0 THEN coalesce(text, '') ELSE concat_ws(chr(10), role, text) END) AS text_md5 FROM conversations",
    "backtest_record": _RECORD,
    "feature_marks": f"WITH {MARKET}, {DOCS}, x AS (SELECT doc_id, unnest(tickers) AS ticker, generate_subscripts(tickers, 1) AS ord, as_of::TIMESTAMP AS at FROM docs), j AS (SELECT x.*, f.vol FROM x ASOF LEFT JOIN feats f ON x.ticker = f.ticker AND x.at >= f.ts), best AS (SELECT * FROM j WHERE vol IS NOT NULL QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY abs(vol) DESC, ord) = 1) SELECT d.doc_id, CASE WHEN trim(coalesce(text, '')) = '' THEN NULL WHEN length(text) < 500 THEN 'short' WHEN length(text) < 4000 THEN 'long' END AS size_label, round(vol, 4) AS vol, CASE WHEN vol >= 1.0 THEN 'high' WHEN vol IS NOT NULL THEN 'low' END AS risk, 3 AS n_steps FROM docs d LEFT JOIN best b ON d.doc_id = b.doc_id",
    "capture_stream": f"WITH {FROM_LATEST} SELECT * FROM latest",
    "token_stream": f"WITH {LOG} SELECT date AS day, sum(used)::BIGINT AS tokens FROM log GROUP BY date",
    "model_names": "SELECT DISTINCT lower(p_type) AS id, CASE WHEN p_type < 'M' THEN 'The ' || p_type ELSE '' END AS name FROM part UNION ALL SELECT 'other', ''",
    "output_caps": f"SELECT event_id, CASE WHEN event_id % 5 = 0 OR event_id % 7 = 0 THEN {routing.MAX_OUTPUT_TOKENS} ELSE least(event_id % 7 * 1000, {routing.MAX_OUTPUT_TOKENS}) END::BIGINT AS cap FROM events",
    "symbol_config": "SELECT DISTINCT p_brand AS ticker, unnest([p_brand, lower(p_brand)]) AS alias, 'SECTOR#' || (regexp_extract(p_brand, '([0-9]+)$', 1)::INT % 5) AS benchmark, 'SECTOR#0' AS fallback FROM part WHERE p_brand <> 'Brand#25'",
    "missing_columns": f"WITH {BARS} SELECT 'bars' AS name, '' AS lacking, count(*) AS n, count(*) FILTER (close IS NULL) AS incomplete FROM bars UNION ALL SELECT 'holes', '', count(*), count(*) FILTER (close IS NULL OR day(ts) = 13 OR month(ts) = 2) FROM bars UNION ALL SELECT 'events', 'close,freq,ticker', count(*), count(*) FROM events UNION ALL SELECT 'nation', 'close,freq,ticker,ts', count(*), count(*) FROM nation",
    "recall_queries": "SELECT q.vec_id AS query_id, v.vec_id, round(list_cosine_similarity(v.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS score FROM embeddings q, embeddings v WHERE q.vec_id % 20 = 0 QUALIFY row_number() OVER (PARTITION BY q.vec_id ORDER BY list_cosine_similarity(v.embedding::DOUBLE[], q.embedding::DOUBLE[]) DESC, v.vec_id) <= 10",
    "integrity_exit": "SELECT 'clean' AS run, 0 AS code UNION ALL SELECT 'drifted', CASE WHEN bool_or((p_partkey % 5) / (p_size * 100) * 100 > 1) THEN 1 ELSE 0 END FROM part UNION ALL SELECT 'empty', 2",
    "json_extract": "SELECT event_id, '{\"k\": ' || (props->>'$.k') || '}' AS found FROM events",
    "synthetic_bars": f"WITH {_WALK} SELECT ticker, strftime(day, '%Y-%m-%d') AS day, round(last * (1 - 0.002::DOUBLE * \"open\"), 6) AS open, round(last * (1 + abs(0.004::DOUBLE * \"high\")), 6) AS high, round(last * (1 - abs(0.004::DOUBLE * \"low\")), 6) AS low, round(last, 6) AS close, true AS adjusted FROM c",
}

NAMES = (
    "csv_source parquet_ingest token_log_files file_snapshot text_files proposals_queue message_texts backtest_record feature_marks capture_stream token_stream "
    "model_names output_caps symbol_config missing_columns recall_queries integrity_exit"
).split()


def queries() -> dict:
    return {name: globals()[name] for name in NAMES}
