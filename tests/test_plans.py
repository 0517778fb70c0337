"""What the plans must look like: filters at the scan, few columns read, no Python in the hot paths, bounded top-k."""

import pytest
from conftest import SF
from pyspark.sql.classic.dataframe import DataFrame

from tickloom.plans import edge_queries, io_queries, scale_queries
from tickloom.plans import queries as q


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(q.NAMES) - {"json_extract", "synthetic_bars", "store_round_trip"}))
def test_no_python_in_the_plan(spark, name):
    text = plan(q.queries()[name](spark, SF))
    assert not any(word in text for word in ("Python", "ArrowEval", "MapInPandas", "FlatMapGroups", "CartesianProduct")), text


@pytest.mark.parametrize("name", "backtest_stats price_features sweep_rank equity_curve information_coefficient registry_compute feature_step budget_gate".split())
def test_no_python_before_a_checkpoint(spark, monkeypatch, name):
    """The same where plans aren't cut, so that what would be written is seen too."""
    monkeypatch.setattr(DataFrame, "checkpoint", lambda self, eager=True: self)
    text = plan(q.queries()[name](spark, SF))
    assert "ExistingRDD" not in text and "FileScan" in text
    assert not any(word in text for word in ("Python", "ArrowEval", "MapInPandas", "FlatMapGroups", "CartesianProduct")), text


@pytest.mark.parametrize("name", sorted({**io_queries.queries(), **scale_queries.queries(), **edge_queries.queries()}.keys() & set("backtest_record feature_marks message_texts model_names output_caps integrity_exit price_features_hot trade_quantiles nearest_customers features_kept freq_problems guard_verdicts output_modes empty_stats".split())))
def test_no_python_in_other_queries(spark, name):
    text = plan({**io_queries.queries(), **scale_queries.queries(), **edge_queries.queries()}[name](spark, SF))
    assert not any(word in text for word in ("Python", "ArrowEval", "MapInPandas", "FlatMapGroups", "CartesianProduct")), text


def test_filters_and_columns_reach_the_scan(spark):
    text = plan(q.evaluated(spark, SF))
    assert "EqualTo(o_orderpriority,1-URGENT)" in text
    orders = next(part for part in text.split("FileScan")[1:] if "orders.parquet" in part)
    assert "o_totalprice" not in orders.split("ReadSchema")[1].split("\n")[0]


def test_features_share_one_sort_of_each_ticker(spark):
    exchanges = [plan(query(spark, SF)).count("hashpartitioning(ticker#") for query in (q.price_features, q.returns)]
    assert exchanges[0] <= exchanges[1] + 1


def test_top_k_is_bounded(spark):
    assert "TakeOrderedAndProject" in plan(q.ledger_recent(spark, SF)) and "TakeOrderedAndProject" in plan(q.vector_topk(spark, SF))
    assert "WindowGroupLimit" in plan(q.recent_20_per_key(spark, SF))
