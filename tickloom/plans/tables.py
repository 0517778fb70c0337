"""The engine's inputs derived from the star-schema tables: bars from trades, events from orders, tags, ledgers, messages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.schema import BARS

SECTORS = 5
#: The ticker that the symbol map leaves out, so that the default benchmark is used.
UNMAPPED = "Brand#25"
DEFAULT = "SECTOR#0"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ticker, ts, px, qty, k): a trade for each order line, priced by the piece; k orders trades of a day.

    k is one number for (order, line, part, supplier), so that bars are hash aggregates: a struct would be sorted.
    """
    lines, part = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    joined = lines.join(part, lines["l_partkey"] == part["p_partkey"])
    px = F.try_divide("l_extendedprice", "l_quantity")
    high, low = F.col("l_orderkey") * 1000 + F.col("l_linenumber"), F.shiftleft(F.col("l_partkey").cast("long"), 31) + F.col("l_suppkey")
    k = high.cast("decimal(18,0)") * F.lit("1" + "0" * 19).cast("decimal(20,0)") + low.cast("decimal(19,0)")
    return joined.select(F.col("p_brand").alias("ticker"), F.col("l_shipdate").alias("ts"), px.alias("px"), F.col("l_quantity").alias("qty"), k.alias("k"))


def sector(ticker):
    return F.concat(F.lit("SECTOR#"), (F.regexp_extract(ticker, "([0-9]+)$", 1).cast("int") % SECTORS).cast("string"))


def to_bars(t: DataFrame, freq: str = "1d") -> DataFrame:
    """Daily bars of trades; open and close are the first and last trade by k."""
    bars = t.groupBy("ticker", "ts").agg(F.min_by("px", "k").alias("open"), F.max("px").alias("high"), F.min("px").alias("low"), F.max_by("px", "k").alias("close"), F.sum("qty").alias("volume"))
    return bars.select(*[f for f in BARS.names if f not in ("adjusted", "freq")], F.lit(False).alias("adjusted"), F.lit(freq).alias("freq"))


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return to_bars(trades(spark, sf_dir))


def symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ticker, benchmark): a sector for each brand but UNMAPPED."""
    brands = table(spark, sf_dir, "part").select(F.col("p_brand").alias("ticker")).distinct()
    return brands.where(F.col("ticker") != UNMAPPED).withColumn("benchmark", sector(F.col("ticker")))


def market_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ticker, ts, close, bench): brands with their sector as benchmark, and the sectors themselves (without one).

    One pass over the trades, which gives each brand's last trade of a day; a sector's is the last of its brands.
    """
    brands = trades(spark, sf_dir).groupBy("ticker", "ts").agg(F.max_by("px", "k").alias("close"), F.max("k").alias("k"))
    sectors = brands.groupBy(sector(F.col("ticker")).alias("ticker"), "ts").agg(F.max_by("close", "k").alias("close"))
    closes = brands.drop("k").unionByName(sectors)
    bench = F.when(F.col("ticker").startswith("Brand#") & (F.col("ticker") != UNMAPPED), sector(F.col("ticker"))).when(F.col("ticker") == UNMAPPED, F.lit(DEFAULT))
    return closes.withColumn("bench", bench)


def order_events(spark: SparkSession, sf_dir: str, priority: str | None = "1-URGENT") -> DataFrame:
    """Distinct (ticker, as_of) of orders, dealt to brands by order key."""
    orders = table(spark, sf_dir, "orders")
    if priority:
        orders = orders.where(F.col("o_orderpriority") == priority)
    return orders.select(F.concat(F.lit("Brand#"), (F.col("o_orderkey") % 25 + 1).cast("string")).alias("ticker"), F.col("o_orderdate").alias("as_of")).distinct()


def order_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(node_id, tag): each order has the brands of its lines and its date."""
    orders, lines, part = (table(spark, sf_dir, n) for n in ("orders", "lineitem", "part"))
    brands = lines.join(part, lines["l_partkey"] == part["p_partkey"]).select(F.col("l_orderkey").alias("node_id"), F.concat(F.lit("ticker:"), "p_brand").alias("tag"))
    kept = brands.join(orders.select(F.col("o_orderkey").alias("node_id")), "node_id", "left_semi")
    dates = orders.select(F.col("o_orderkey").alias("node_id"), F.concat(F.lit("asof:"), F.date_format("o_orderdate", "yyyy-MM-dd")).alias("tag"))
    return kept.unionByName(dates)


def vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, labels, name, text): regions, nations and customers as a graph."""
    region, nation, customer = (table(spark, sf_dir, n) for n in ("region", "nation", "customer"))
    kind = lambda label, key, name: (F.concat(F.lit(f"{label}:"), F.col(key).cast("string")).alias("id"), F.array(F.lit(label)).alias("labels"), F.col(name).alias("name"), F.lit(None).cast("string").alias("text"))
    return region.select(*kind("Region", "r_regionkey", "r_name")).unionByName(nation.select(*kind("Nation", "n_nationkey", "n_name"))).unionByName(customer.select(*kind("Customer", "c_custkey", "c_name")))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation, customer = table(spark, sf_dir, "nation"), table(spark, sf_dir, "customer")
    end = lambda label, key: F.concat(F.lit(f"{label}:"), F.col(key).cast("string"))
    return nation.select(end("Nation", "n_nationkey").alias("src"), end("Region", "n_regionkey").alias("dst"), F.lit("IN_REGION").alias("type")).unionByName(customer.select(end("Customer", "c_custkey").alias("src"), end("Nation", "c_nationkey").alias("dst"), F.lit("IN_NATION").alias("type")))


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A spend ledger from events: some calls have a group, some only a model path."""
    e = table(spark, sf_dir, "events")
    group = F.when(F.col("event_id") % 3 == 0, F.lit("")).when(F.col("event_id") % 3 == 1, F.col("event_type"))
    return e.select(F.col("event_id").alias("request_id"), F.col("ts").alias("end_time"), group.alias("model_group"), F.concat(F.lit("vendor/"), "event_type").alias("model"), F.col("value").alias("spend"), F.get_json_object("props", "$.k").try_cast("long").alias("total_tokens"), F.concat(F.lit("key-"), (F.col("user_id") % 7).cast("string")).alias("alias"))


def token_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select("event_id", "ts", F.date_format("ts", "yyyy-MM-dd").alias("date"), F.get_json_object("props", "$.k").try_cast("long").alias("input_tokens"), F.floor("value").cast("long").alias("output_tokens"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, text, doc_type, tags, as_of, tickers, meta): documents with what their labels say."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    marks = labels.groupBy(F.col("doc_id").alias("l_id")).agg(F.max("quality").alias("quality"))
    joined = docs.join(marks, docs["doc_id"] == marks["l_id"], "left")
    relevance = F.when(F.col("quality") == 1, "high").when(F.col("quality") == 0, "low")
    meta = F.map_filter(F.map_from_arrays(F.array(F.lit("docType"), F.lit("relevance"), F.lit("_raw")), F.array(F.col("source"), relevance, F.lit("x"))), lambda k, v: v.isNotNull())
    as_of = F.date_format(F.date_add(F.lit("1996-01-01").cast("date"), (F.col("doc_id") % 1500).cast("int")), "yyyy-MM-dd")
    ticker = lambda n: F.concat(F.lit("Brand#"), ((F.col("doc_id") * n) % 25 + 1).cast("string"))
    return joined.select("doc_id", "text", F.col("source").alias("doc_type"), F.array("lang").alias("tags"), as_of.alias("as_of"), F.array_distinct(F.array(ticker(1), ticker(7))).alias("tickers"), meta.alias("meta"))


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(conv_id, text, tools): all turns of a conversation in order; every third conversation brings tools."""
    c = table(spark, sf_dir, "conversations")
    turns = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    text = F.concat_ws("\n", F.transform(turns, lambda t: F.coalesce(t["text"], F.lit(""))))
    return c.groupBy("conv_id").agg(text.alias("text")).withColumn("tools", F.col("conv_id") % 3 == 0)
