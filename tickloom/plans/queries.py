"""The registered queries over the star-schema tables; oracle.py has the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.functions import prices, text
from tickloom.functions.dates import normalize_asof
from tickloom.operators import documents as docs_ops
from tickloom.operators import evidence, graph, inventory, ledger, linker, proposals, routing, steps, vectors
from tickloom.operators.asof import asof_join
from tickloom.operators.events import events_from_tags, triggered
from tickloom.operators.returns import benchmark_of, compute, featured
from tickloom.plans import tables as t
from tickloom.plans.backtest import evaluate
from tickloom.plans.sweep import best_by_ticker, chunk_of, recent_per_key, scored_events, top
from tickloom.shared import cut, new_path
from tickloom.sources.bars import Synthetic, within
from tickloom.sources.store import coverage, latest_wins, read_bars, upsert_bars

TODAY = "2001-12-31"
PICKED = ("Brand#1", "Brand#12", "Brand#25")
SYMBOLS = {
    "defaultBenchmark": "SECTOR#0",
    "tickers": {
        "DATA": {"aliases": ["data set", "table"], "benchmark": "SECTOR#1", "sector": "x"},
        "TIME": {"aliases": ["day", "year"], "benchmark": "", "sector": "y"},
        "WATER": {"aliases": ["river", "sea"], "benchmark": "SECTOR#3", "sector": "x"},
    },
}
ROUTES = {
    "defaultModel": "extractor",
    "routing": {
        "enabled": True,
        "rules": [
            {"if": {"relevance": "high", "minLength": 400}, "model": "extractor-pro"},
            {"if": {"tag": ["DE", "fr"], "maxLength": 300}, "model": "short-eu"},
            {"if": {"pattern": "copyright|license", "docType": ["src1", "src2", "src3"]}, "model": "legal"},
            {"if": {"signal": {"relevance": ["low"]}}},
            {"if": {}, "model": "never"},
            {"if": {"pattern": "("}, "model": "never"},
        ],
    },
}
STEPS = [
    {"id": "lang", "name": "mark length", "output": "signal", "metaKey": "size", "labels": ["short", "long"], "prompt": "size"},
    {"id": "type", "kind": "classify", "metaKey": "docType", "prompt": "type"},
    {"id": "gate", "output": "rewrite", "prompt": "gate", "appliesTo": {"docTypes": ["note"]}},
    {"id": "never", "output": "rewrite", "prompt": "lower", "enabled": False},
    {"id": "lower", "output": "rewrite", "prompt": "lower", "appliesTo": {"docTypes": ["essay"]}},
]


def toy_model(content, step):
    """A stand-in for a text model with fixed rules, so that the fold around it can be checked."""
    n = F.length(content)
    outputs = {
        "size": F.when(n < 500, "It is SHORT.").when(n < 4000, "quite long"),
        "type": F.when(n < 800, "note").otherwise("essay"),
        "gate": F.when(n < 60, "DROP.").otherwise(F.concat(F.lit("> "), content)),
        "lower": F.lower(content),
    }
    error = F.when(n % 10 == 3, F.lit("timeout")) if step["prompt"] == "gate" else None
    return outputs[step["prompt"]], error


def _market(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars with benchmarks, written: they are few beside trades and read several times."""
    return cut(t.market_bars(spark, sf_dir))


def _day(c: str):
    return F.date_format(c, "yyyy-MM-dd")


def backtest_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.event_stats(evaluated(spark, sf_dir))


def evaluated(spark: SparkSession, sf_dir: str, direction: str = "long") -> DataFrame:
    """Orders as events with fwd, ar and a point-in-time score. One frame of features serves all three."""
    frame = featured(_market(spark, sf_dir), fwd=prices.forward_return(), ar_5=prices.cum_abnormal_return(), score=prices.realized_vol())
    values = frame.select("ticker", "ts", "fwd", F.col("ar_5").alias("ar"), "score")
    return asof_join(t.order_events(spark, sf_dir), values, ["ticker"], "as_of", "ts", ["fwd", "ar", "score"])


def event_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = evaluate(_market(spark, sf_dir), t.order_events(spark, sf_dir))
    return rows.select("ticker", _day("as_of").alias("as_of"), F.round("fwd", 6).alias("fwd"), F.round("ar", 6).alias("ar"))


def stats_by_ticker_short(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.event_stats(evaluated(spark, sf_dir), "short", ["ticker"])


def skipped_no_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.skipped(evaluated(spark, sf_dir)).select("ticker", _day("as_of").alias("as_of"))


def information_coefficient(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.information_coefficient(cut(evaluated(spark, sf_dir)))


def equity_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The curve of all events, with its height as a base-10 logarithm: products of thousands of returns leave 6 decimals far behind."""
    rows = evidence.equity_curve(cut(evaluated(spark, sf_dir)))
    return rows.select("ticker", _day("as_of").alias("as_of"), F.round(F.when(F.col("equity") > 0, F.log10("equity")), 6).alias("log10_equity"))


def bars_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.bars(spark, sf_dir).select("ticker", _day("ts").alias("day"), *[F.round(c, 6).alias(c) for c in ("open", "high", "low", "close")], F.round("volume", 2).alias("volume"), "adjusted", "freq")


def bar_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage(t.bars(spark, sf_dir)).select("ticker", F.col("rows").alias("n_rows"), _day("first").alias("first_day"), _day("last").alias("last_day"), "adjusted")


def read_bars_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return within(t.bars(spark, sf_dir), PICKED, "1996-03-01", "1998-06-30").orderBy("ticker", "ts").select("ticker", _day("ts").alias("day"), F.round("close", 6).alias("close"))


def upsert_latest_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = t.bars(spark, sf_dir)
    old, new = bars.where("ts < '1999-01-01'"), bars.where("ts >= '1998-01-01'").withColumn("close", F.col("close") * 2)
    return latest_wins(old, new).select("ticker", _day("ts").alias("day"), F.round("close", 6).alias("close"))


def store_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same through the store on disk: two upserts, then a read of some tickers."""
    path = new_path(spark, "bars")
    bars = t.bars(spark, sf_dir)
    upsert_bars(bars.where("ts < '1999-01-01'"), path)
    upsert_bars(bars.where("ts >= '1998-01-01'").withColumn("close", F.col("close") * 2), path)
    return read_bars(spark, path, PICKED).select("ticker", _day("ts").alias("day"), F.round("close", 6).alias("close"))


def _features(spark: SparkSession, sf_dir: str, use_benchmark: bool = True, **features) -> DataFrame:
    frame = featured(_market(spark, sf_dir), use_benchmark, **features)
    return frame.where("bench IS NOT NULL").select("ticker", _day("ts").alias("day"), *[F.round(c, 6).alias(c) for c in ("ret", "ar", *features)])


def returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _features(spark, sf_dir)


def raw_return_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _features(spark, sf_dir, use_benchmark=False)


def price_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _features(spark, sf_dir, fwd=prices.forward_return(), car=prices.cum_abnormal_return(), ar_vol=prices.trailing_ar_vol(), vol=prices.realized_vol(), z=prices.car_zscore())


def label_from_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = _features(spark, sf_dir, z=prices.car_zscore())
    return z.select("ticker", "day", text.label_from_value(F.col("z"), {"high": 1.5}).alias("label"), text.label_from_value(F.col("z"), {"high": 0.5, "by": "value", "highLabel": "up", "lowLabel": "rest"}).alias("signed_label"), text.label_from_value(F.col("z"), {}).alias("no_label"))


def registry_compute(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = compute("realized_vol", _market(spark, sf_dir), t.order_events(spark, sf_dir), {"window": 30})
    return out.select("ticker", _day("as_of").alias("as_of"), "name", "version", F.round("value", 6).alias("value"))


def asof_close(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = t.bars(spark, sf_dir).select("ticker", "ts", "close").withColumn("bar_ts", F.col("ts"))
    joined = asof_join(t.order_events(spark, sf_dir, None), bars, ["ticker"], "as_of", "ts", ["bar_ts", "close"], bucket_days=90)
    return joined.select("ticker", _day("as_of").alias("as_of"), _day("bar_ts").alias("bar_day"), F.round("close", 6).alias("close"))


def events_two_hop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events_from_tags(t.order_tags(spark, sf_dir))


def trigger_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    tags = t.order_tags(spark, sf_dir)
    nodes = t.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.concat_ws(" ", "o_orderpriority", "o_orderstatus", F.col("o_custkey").cast("string")).alias("name"), F.lit(None).cast("string").alias("text"))
    match = {"tickers": ["Brand#1", "Brand#2", "Brand#3"], "entityAny": ["urgent f 11"], "keywordAny": ["HIGH O 2", "nothing"]}
    return triggered(events_from_tags(tags), match, tags, nodes)


def sweep_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = t.order_events(spark, sf_dir).withColumn("as_of", _day("as_of"))
    scored = scored_events(_market(spark, sf_dir), events, TODAY)
    return best_by_ticker(scored).select("ticker", "as_of", F.round("z", 6).alias("z"), F.round("score", 6).alias("score"))


def sweep_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = t.order_events(spark, sf_dir).withColumn("as_of", _day("as_of"))
    return top(scored_events(_market(spark, sf_dir), events, TODAY)).select("ticker", "as_of", F.round("score", 6).alias("score"))


def chunk_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    tags = t.order_tags(spark, sf_dir)
    nodes = t.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.concat_ws(" ", "o_orderpriority", "o_orderstatus", F.col("o_orderkey").cast("string")).alias("text"))
    return chunk_of(tags, nodes, events_from_tags(tags))


def benchmark_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    brands = t.table(spark, sf_dir, "part").select(F.col("p_brand").alias("ticker")).distinct()
    return benchmark_of(brands, t.symbols(spark, sf_dir), t.DEFAULT).select("ticker", "bench")


def link_tickers(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = t.table(spark, sf_dir, "documents")
    given = F.when(F.col("doc_id") % 10 == 0, F.array(F.lit("WATER"), F.lit(" OTHER "))).otherwise(F.array().cast("array<string>"))
    return docs.select("doc_id", F.concat_ws(",", linker.resolve_tickers(F.col("text"), SYMBOLS, given)).alias("tickers"))


def normalized_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = t.table(spark, sf_dir, "orders")
    forms = ["yyyy-MM-dd", "yyyy/MM/dd", "dd-MM-yyyy", "d/M/yyyy", "d MMM yyyy", "d MMMM yyyy", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss"]
    raw = F.when(F.col("o_orderkey") % 10 == 8, F.concat(_day("o_orderdate"), F.lit("Z?"))).when(F.col("o_orderkey") % 10 == 9, F.lit("soon"))
    for n, form in enumerate(forms):
        raw = F.when(F.col("o_orderkey") % 10 == n, F.date_format("o_orderdate", form)).otherwise(raw)
    return orders.select("o_orderkey", normalize_asof(raw).alias("as_of"))


def provenance_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = t.documents(spark, sf_dir)
    return docs.select("doc_id", F.concat_ws("|", linker.provenance_tags(F.col("tickers"), F.when(F.col("doc_id") % 4 != 0, F.col("as_of")))).alias("tags"))


def route_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    manual = F.when(F.col("doc_id") % 50 == 1, "auto").when(F.col("doc_id") % 50 == 2, "manual").otherwise("")
    return routing.route(t.documents(spark, sf_dir), ROUTES, manual).select("doc_id", "model", routing.fits(F.col("text"), 5000).alias("fits"))


def bucket_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs_ops.bucket_tokens(routing.route(t.documents(spark, sf_dir), ROUTES))


def gates_and_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    outputs = F.concat(F.element_at(F.array(*[F.lit(x) for x in ("DROP", " drop. ", "Drop it now", "dropping this whole document", "It is below par", "LOW", "")]), (F.col("doc_id") % 7 + 1).cast("int")), F.when(F.col("doc_id") % 5 == 0, F.lit("\nsecond line")).otherwise(F.lit("")))
    docs = t.table(spark, sf_dir, "documents").select("doc_id", outputs.alias("out"))
    return docs.select("doc_id", text.is_drop(F.col("out")).alias("dropped"), text.match_label(F.col("out"), ["high", "low"]).alias("label"))


def feature_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = t.documents(spark, sf_dir)
    best = steps.feature_values(docs, _market(spark, sf_dir), "realized_vol")
    return best.select("doc_id", "ticker", F.round("value", 6).alias("value"), text.label_from_value(F.col("value"), {"high": 1.0}).alias("label"))


def pipeline_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = t.table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    out = steps.run_steps(docs, STEPS, toy_model, F.col("source"))
    return out.select("doc_id", "dropped", F.col("cur_type").alias("doc_type"), F.try_element_at("meta", F.lit("size")).alias("size_label"), F.size("trace").alias("n_steps"), F.exists("trace", lambda e: e["error"].isNotNull()).alias("failed"), F.length("text").alias("n_chars"), F.md5(F.col("text").cast("binary")).alias("text_md5"))


def tier_router(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = F.when(F.col("conv_id") % 11 == 0, "low").otherwise("auto")
    return t.messages(spark, sf_dir).select("conv_id", routing.tier(F.col("text"), F.col("tools"), asked).alias("r")).select("conv_id", "r.tier", "r.reason")


def spend_by_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.spend_by_model(t.calls(spark, sf_dir))


def ledger_recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.recent(t.calls(spark, sf_dir)).select("request_id", F.date_format("end_time", "yyyy-MM-dd HH:mm:ss").alias("end_time"), ledger.model_key(F.col("model_group"), F.col("model")).alias("model"), F.round("spend", 6).alias("spend"))


def ledger_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.totals(t.calls(spark, sf_dir))


def daily_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.daily_tokens(t.token_log(spark, sf_dir)).withColumn("state", ledger.budget_state(F.col("tokens"), 60_000, 90_000))


def budget_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.budget_gate(t.token_log(spark, sf_dir), "ts", ("event_id",), 30_000, 50_000).select("event_id", "spent_before", "refused", "soft_warn")


def overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = t.calls(spark, sf_dir).groupBy("alias").agg(F.sum("spend").alias("spend")).withColumn("max_budget", F.when(F.col("alias") != "key-3", F.lit(100000.0)))
    projects = spark.range(10).select(F.concat(F.lit("key-"), F.col("id").cast("string")).alias("alias"))
    return ledger.overview(projects, keys)


def overview_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.overview_totals(overview(spark, sf_dir))


def recent_20_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recent_per_key(t.calls(spark, sf_dir), "alias", [F.desc("end_time"), "request_id"]).select("alias", "request_id")


def graph_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.counts(t.vertices(spark, sf_dir), t.edges(spark, sf_dir))


def graph_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = graph.labels(t.vertices(spark, sf_dir)).select(F.lit("label").alias("kind"), F.col("label").alias("name"))
    return names.unionByName(graph.relation_types(t.edges(spark, sf_dir)).select(F.lit("relation").alias("kind"), F.col("type").alias("name")))


def graph_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.preview(t.vertices(spark, sf_dir), t.edges(spark, sf_dir))


def graph_preview_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.preview_nodes(graph_preview(spark, sf_dir))


def _proposals(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = t.table(spark, sf_dir, "customer")
    brand = lambda k: F.concat(F.lit("Brand#"), ((F.col("c_custkey") * k) % 30 + 1).cast("string"))
    none = F.array().cast("array<string>")
    return c.select(F.concat(F.lit("sig_"), (F.col("c_custkey") % 500).cast("string")).alias("id"), F.col("c_name").alias("thesis"), F.when(F.col("c_custkey") % 6 == 0, "flat").when(F.col("c_custkey") % 7 == 0, F.lit(None)).when(F.col("c_custkey") % 2 == 0, "long").otherwise("short").alias("direction"), F.format_string("%08d", F.col("c_custkey")).alias("created_at"), F.when(F.col("c_custkey") % 3 == 0, none).otherwise(F.array(brand(1))).alias("match_tickers"), F.array(brand(2), brand(3)).alias("universe"))


def signal_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _proposals(spark, sf_dir).select("id", "thesis", "direction", "created_at", F.col("created_at").alias("approved_at"))
    held, new = p.where("created_at < '00000400'"), p.where("created_at >= '00000300'")
    return graph.upsert_signals(graph.upsert_signals(held.limit(0), held), new).select("id", "thesis", "direction", "created_at")


def signal_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.signal_edges(_proposals(spark, sf_dir), t.order_tags(spark, sf_dir))


def validate_proposals(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.substring("thesis", 10, 20).cast("long")
    found = proposals.problems(F.when(key % 9 != 0, F.col("id")), F.col("direction"), key % 4 != 0, (key % 4 != 0) & (key % 5 != 0))
    return _proposals(spark, sf_dir).select("thesis", F.concat_ws("; ", found).alias("problems"))


def horizons(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.element_at(F.array(*[F.lit(x) for x in ("5d", "10D", "3", "2w", "d", "", "7dd", "-4d")]), (F.col("o_orderkey") % 8 + 1).cast("int"))
    return t.table(spark, sf_dir, "orders").select("o_orderkey", text.horizon_days(raw).alias("horizon"))


def missing_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = t.table(spark, sf_dir, "part").select(F.col("p_type").alias("model")).withColumn("pool_name", text.pool_name(F.col("model")))
    pool = t.table(spark, sf_dir, "part").where("p_type < 'M'").select(text.pool_name(F.col("p_type")).alias("pool_name"))
    return graph.missing_models(wanted, pool)


def allow_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    part, customer = t.table(spark, sf_dir, "part"), t.table(spark, sf_dir, "customer")
    return graph.allow_list(part.select(F.col("p_brand").alias("name")), customer.select(F.col("c_mktsegment").alias("name")))


def slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.concat(F.lit(" ^"), F.col("p_type"), F.lit("/"), F.col("p_brand"), F.lit("! "))
    return t.table(spark, sf_dir, "part").select("p_partkey", text.safe_ticker(raw).alias("safe"), text.model_slug(raw).alias("slug"), text.pool_name(raw).alias("pool"), text.ontology_slug(raw).alias("onto"), text.last_segment(raw).alias("last"), text.proposal_slug(raw).alias("proposal"), text.file_name(raw).alias("file"))


def inventory_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = t.table(spark, sf_dir, "part")
    now = part.select(F.concat(F.lit("f"), F.col("p_partkey").cast("string")).alias("path"), F.when(F.col("p_size") % 10 == 0, 0).otherwise(F.col("p_size")).cast("long").alias("size"), (F.col("p_size") * 100 + F.col("p_partkey") % 5).cast("long").alias("rows"))
    before = part.where("p_partkey % 7 <> 0").select(F.concat(F.lit("f"), F.col("p_partkey").cast("string")).alias("path"), (F.col("p_size") * 100).cast("long").alias("rows"))
    return inventory.compare(now, before).select("path", "prev_rows", F.round("drift", 6).alias("drift"), "anomaly")


def inventory_anomalies(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = t.table(spark, sf_dir, "part")
    now = part.select(F.col("p_partkey").alias("path"), F.when(F.col("p_size") % 10 == 0, 0).otherwise(F.col("p_size")).cast("long").alias("size"), (F.col("p_size") * 100 + F.col("p_partkey") % 5).cast("long").alias("rows"))
    before = part.select(F.col("p_partkey").alias("path"), (F.col("p_size") * 100).cast("long").alias("rows"))
    return inventory.anomalies(inventory.compare(now, before))


def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    query = [((k * 37) % 11 - 5) / 5 for k in range(64)]
    return vectors.recall(t.table(spark, sf_dir, "embeddings"), query, 10).select("vec_id", F.round("score", 6).alias("score"))


def message_previews(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.messages(spark, sf_dir).select("conv_id", F.left("text", F.lit(300)).alias("preview"), text.token_estimate(F.col("text")).alias("tokens"))


def log_tails(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short tails of all documents' whole texts."""
    raw = F.concat(F.lit("\x1b[31mred\x1b[0m line\n2024-01-01T00:00:00 noise\n\n"), F.coalesce("text", F.lit("")))
    return t.table(spark, sf_dir, "documents").select("doc_id", text.log_tail(raw, 80).alias("tail"))


def log_tails_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tails of all documents' whole texts, with the operator's own length."""
    raw = F.concat(F.lit("\x1b[31mred\x1b[0m line\n2024-01-01T00:00:00 noise\n\n"), F.coalesce("text", F.lit("")))
    return t.table(spark, sf_dir, "documents").select("doc_id", text.log_tail(raw).alias("tail"))


def role_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    roles = F.create_map(F.lit("Brand#1"), F.lit("vendor/One"), F.lit("Brand#2"), F.lit(""))
    model = text.resolve_role(F.col("p_brand"), roles, {"Brand#2": "vendor/Two.1"})
    return t.table(spark, sf_dir, "part").select("p_brand").distinct().select("p_brand", model.alias("model"), text.pool_name(model).alias("gateway"))


def ontology_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    entities = t.table(spark, sf_dir, "nation").select(F.concat("n_name", F.lit(" x")).alias("name"))
    relations = t.table(spark, sf_dir, "region").select(F.concat(F.lit("in "), "r_name").alias("name"), F.when(F.col("r_regionkey") != 1, F.lit("Nation")).alias("source"), F.col("r_name").alias("target"))
    return graph.ontology_triples(entities, relations)


def ids_and_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = t.table(spark, sf_dir, "orders")
    pairs = lambda *kv: F.create_map(*[F.lit(x) for x in kv])
    roles = text.merged(pairs("reader", "small", "writer", "big"), F.when(F.col("o_orderkey") % 3 == 0, pairs("writer", "huge", "judge", "mid")))
    shown = F.concat_ws(",", F.transform(F.array_sort(F.map_entries(roles)), lambda e: F.concat(e["key"], F.lit("="), e["value"])))
    return orders.select("o_orderkey", text.proposal_id(F.col("o_orderpriority"), F.col("o_orderdate")).alias("id"), text.iso_utc(F.col("o_orderdate")).alias("at"), shown.alias("roles"))


def fuzzy_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = t.table(spark, sf_dir, "part").select("p_type").distinct()
    types = ["Economical", "Standard", "PROMOS", "smal", "medium", "largest"]
    return part.select("p_type", text.nearest_name(F.col("p_type"), types).alias("name"), text.nearest_name(F.col("p_type"), types, 9).alias("any_name"))


def calls_of_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.totals(ledger.calls_of(t.calls(spark, sf_dir), "key-2"))


def json_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = t.table(spark, sf_dir, "events")
    return events.select("event_id", proposals.first_json(F.concat(F.lit("so { we have "), F.col("props"), F.lit(" and } {}"))).alias("found"))


def synthetic_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A walk for each brand that has parts."""
    brands = t.table(spark, sf_dir, "part").select(F.col("p_brand").alias("ticker")).distinct()
    bars = Synthetic(periods=60).load_history(spark, brands)
    return bars.select("ticker", _day("ts").alias("day"), *[F.round(c, 6).alias(c) for c in ("open", "high", "low", "close")], "adjusted")


NAMES = (
    "backtest_stats event_rows stats_by_ticker_short skipped_no_data information_coefficient equity_curve bars_daily bar_coverage read_bars_filtered upsert_latest_wins "
    "store_round_trip returns raw_return_mode price_features label_from_value registry_compute asof_close events_two_hop trigger_filter sweep_rank sweep_top chunk_lookup benchmark_map "
    "link_tickers normalized_dates provenance_tags route_documents bucket_tokens gates_and_labels feature_step pipeline_fold tier_router spend_by_model ledger_recent "
    "ledger_totals daily_tokens budget_gate overview overview_totals recent_20_per_key graph_counts graph_labels graph_preview graph_preview_nodes signal_upsert signal_edges "
    "validate_proposals horizons missing_models allow_list slugs inventory_drift inventory_anomalies vector_topk message_previews log_tails log_tails_whole role_models ontology_triples ids_and_maps fuzzy_names calls_of_key json_extract synthetic_bars"
).split()


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: globals()[name] for name in NAMES}
