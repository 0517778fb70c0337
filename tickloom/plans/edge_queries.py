"""Registered queries for what stands at the edges: named files, refused inputs, empty results, missing graphs; each beside its SQL."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom import schema
from tickloom.operators import evidence, graph, inventory, steps
from tickloom.plans import tables as t
from tickloom.plans.backtest import AHEAD, UNKNOWN, guard_problem
from tickloom.plans.oracle import BARS, GRAPH
from tickloom.plans.queries import evaluated
from tickloom.shared import new_path
from tickloom.sources.bars import make_adapter


def _write_files(files: DataFrame, path: str) -> None:
    """A file ``path``/name with the given text for each row (name, text); written by tasks."""

    def write(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, root = inventory._opened(path)
        at.create_dir(root, recursive=True)
        for frame in frames:
            for name, text in frame.itertuples(index=False):
                with at.open_output_stream(f"{root}/{name}") as f:
                    f.write(text.encode())
            yield frame[["name"]]

    files.select("name", "text").mapInPandas(write, "name string").write.format("noop").mode("overwrite").save()


def _lines(df: DataFrame, by: str, line, order: list[str]) -> DataFrame:
    """(by, text): the lines of each group in order, each ended. A group is one file."""
    rows = F.transform(F.array_sort(F.collect_list(F.struct(*order, line.alias("line")))), lambda x: F.concat(x["line"], F.lit("\n")))
    return df.groupBy(by).agg(F.array_join(rows, "").alias("text"))


def filename_tickers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All bars as a CSV file for each brand, whose name alone tells the ticker."""
    path = new_path(spark, "named")
    line = F.concat_ws(",", F.date_format("ts", "yyyy-MM-dd"), F.col("close").cast("string"))
    texts = _lines(t.bars(spark, sf_dir), "ticker", line, ["ts"])
    _write_files(texts.select(F.concat("ticker", F.lit(".csv")).alias("name"), F.concat(F.lit("date,close\n"), "text").alias("text")), path)
    bars = make_adapter({"kind": "csvdir", "path": path, "ticker_from_filename": True}).load_history(spark, start="1996-01-01")
    return bars.select("ticker", F.date_format("ts", "yyyy-MM-dd").alias("day"), F.round("close", 6).alias("close"))


def line_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a JSON-lines file for each nation's customers, by a split scan and by the streamed snapshot."""
    path = new_path(spark, "lines")
    customers = t.table(spark, sf_dir, "customer")
    texts = _lines(customers, "c_nationkey", F.to_json(F.struct("c_custkey", "c_name")), ["c_custkey"])
    _write_files(texts.select(F.concat(F.lit("n"), F.col("c_nationkey").cast("string"), F.lit(".jsonl")).alias("name"), "text"), path)
    scanned = inventory.line_counts(spark, path).select(F.substring_index("path", "/", -1).alias("path"), F.col("rows").alias("scanned"))
    return inventory.snapshot(spark, path).join(scanned, "path").select("path", "rows", "scanned")


def freq_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is wrong with the freq that each part's size stands for."""
    freq = F.when(F.col("p_size") % 4 == 0, "1d").when(F.col("p_size") % 4 == 1, "1m").when(F.col("p_size") % 4 == 2, F.concat(F.col("p_size").cast("string"), F.lit("w")))
    return t.table(spark, sf_dir, "part").select("p_partkey", schema.freq_problem(freq).alias("problem"))


def guard_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the look-ahead guard says to the predictor that each customer asks for."""
    names = F.array(*[F.lit(x) for x in ("forward_return", "cum_abnormal_return", "car_zscore", "realized_vol", "nope", "")])
    return t.table(spark, sf_dir, "customer").select("c_custkey", guard_problem(F.get(names, (F.col("c_custkey") % 7).cast("int"))).alias("problem"))


def empty_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of events without an outcome, and of none."""
    rows = evaluated(spark, sf_dir)
    parts = {"no outcome": rows.where("fwd IS NULL"), "no events": rows.where("ticker = 'none'")}
    made = [evidence.stats_record(df).select(F.lit(k).alias("which"), "n", "hit_rate", "avg_fwd", "median_fwd", "t_stat", "ic") for k, df in parts.items()]
    return made[0].unionByName(made[1])


def output_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mode of steps that say it in their own word, or in the older one, or not at all."""
    output = F.get(F.array(F.lit(" Rewrite"), F.lit("SIGNAL"), F.lit("other"), F.lit("")), (F.col("c_custkey") % 5).cast("int"))
    kind = F.get(F.array(F.lit("classify "), F.lit("transform")), (F.col("c_custkey") % 3).cast("int"))
    return t.table(spark, sf_dir, "customer").select("c_custkey", steps.output_mode_of(output, kind).alias("mode"))


def graph_existence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of a stored graph, of one without edges, and of one that isn't there."""
    paths = {k: new_path(spark, "graph") for k in ("stored", "bare", "missing")}
    v, e = t.vertices(spark, sf_dir), t.edges(spark, sf_dir)
    graph.save_graph(v, e, paths["stored"])
    v.write.parquet(f"{paths['bare']}/vertices")
    made = [graph.graph_stats(spark, path).select(F.lit(k).alias("which"), "exists", "nodes", "edges", F.concat_ws(",", "labels").alias("labels")) for k, path in paths.items()]
    return made[0].unionByName(made[1]).unionByName(made[2])


def _said(message: str, value: str) -> str:
    return " || ".join(x for k, part in enumerate(message.replace("'", "''").split("{}")) for x in ([value] if k else []) + [f"'{part}'"])


_ASKED = "(['forward_return', 'cum_abnormal_return', 'car_zscore', 'realized_vol', 'nope', ''])[c_custkey % 7 + 1]"
_NO_STATS = "0::BIGINT AS n, NULL::DOUBLE AS hit_rate, NULL::DOUBLE AS avg_fwd, NULL::DOUBLE AS median_fwd, NULL::DOUBLE AS t_stat, NULL::DOUBLE AS ic"

SQL = {
    "filename_tickers": f"WITH {BARS} SELECT ticker, strftime(ts, '%Y-%m-%d') AS day, round(close, 6) AS close FROM bars WHERE ts >= '1996-01-01'",
    "line_counts": "SELECT 'n' || c_nationkey || '.jsonl' AS path, count(*) AS rows, count(*) AS scanned FROM customer GROUP BY c_nationkey",
    "freq_problems": "SELECT p_partkey, CASE p_size % 4 WHEN 2 THEN 'invalid freq: ' || p_size || 'w; expected one of 1d, 1m' WHEN 3 THEN 'invalid freq: null; expected one of 1d, 1m' END AS problem FROM part",
    "guard_verdicts": f"SELECT c_custkey, CASE WHEN {_ASKED} = 'nope' THEN {_said(UNKNOWN, _ASKED)} WHEN {_ASKED} IN ('forward_return', 'cum_abnormal_return', 'car_zscore') THEN {_said(AHEAD, _ASKED)} END AS problem FROM customer",
    "empty_stats": f"SELECT 'no outcome' AS which, {_NO_STATS} UNION ALL SELECT 'no events', {_NO_STATS}",
    "output_modes": "SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN 'rewrite' WHEN c_custkey % 5 = 1 THEN 'signal' WHEN c_custkey % 3 = 0 THEN 'signal' ELSE 'rewrite' END AS mode FROM customer",
    "graph_existence": f"WITH {GRAPH}, n AS (SELECT (SELECT count(*) FROM v) AS nodes, (SELECT count(*) FROM e) AS edges, (SELECT string_agg(DISTINCT label, ',' ORDER BY label) FROM v) AS labels) SELECT 'stored' AS which, true AS exists, nodes, edges, labels FROM n UNION ALL SELECT 'bare', true, nodes, 0, labels FROM n UNION ALL SELECT 'missing', false, 0, 0, ''",
}

NAMES = "filename_tickers line_counts freq_problems guard_verdicts empty_stats output_modes graph_existence".split()


def queries() -> dict:
    return {name: globals()[name] for name in NAMES}
