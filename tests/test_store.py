"""Sources, the bar store and its plans, files and streams."""

import datetime as dt
import json

import pytest
from conftest import days
from pyspark.sql import functions as F

from tickloom.schema import BARS, normalise
from tickloom.sources import files, store
from tickloom.sources.bars import make_adapter
from tickloom.streaming import bars as stream


def bars(spark, rows):
    return spark.createDataFrame(rows, "ticker string, ts timestamp_ntz, close double, freq string")


def test_normalise(spark):
    out = normalise(spark.createDataFrame([("A", "2024-01-02", "12.5", "x", "1d")], "ticker string, ts string, close string, volume string, freq string"))
    assert out.schema.names == BARS.names
    r = out.first()
    assert (r["ts"], r["close"], r["volume"], r["adjusted"]) == (dt.datetime(2024, 1, 2), 12.5, None, False)
    with pytest.raises(ValueError, match="freq"):
        normalise(spark.createDataFrame([("A", "x", 1.0)], "ticker string, ts string, close double"))


def test_upsert_keeps_the_latest(spark, tmp_path):
    path, at = str(tmp_path / "bars"), days(3)
    assert store.read_bars(spark, path).count() == 0
    store.upsert_bars(bars(spark, [("^A", at[0], 1.0, "1d"), ("^A", at[1], 2.0, "1d"), ("B", at[0], 5.0, "1m")]), path)
    detail = store.upsert_bars(bars(spark, [("^A", at[1], 20.0, "1d"), ("^A", at[2], 30.0, "1d")]), path)
    assert [tuple(r) for r in detail.collect()] == [("^A", "1d", 3)]
    assert tuple(store.summary(detail).first()) == (1, 3)
    assert [r["close"] for r in store.close_series(spark, path, ["^A"]).orderBy("ts").collect()] == [1.0, 20.0, 30.0]
    assert store.read_bars(spark, path, freq="1m").count() == 1  # untouched by the second batch
    assert store.read_bars(spark, path, ["^A"], start=at[1], end=at[1]).count() == 1
    assert [tuple(r)[:2] for r in store.coverage(store.read_bars(spark, path)).collect()] == [("^A", 3)]


def test_order_within_a_batch(spark):
    at = days(1)[0]
    new = spark.createDataFrame([("A", at, 2.0, "1d", 1), ("A", at, 1.0, "1d", 2)], "ticker string, ts timestamp_ntz, close double, freq string, seq int")
    out = store.latest_wins(store.empty_bars(spark), normalise(new).withColumn("seq", F.when(F.col("close") == 1.0, 2).otherwise(1)), "seq")
    assert [r["close"] for r in out.collect()] == [1.0]


def test_invalid_freq_writes_nothing(spark, tmp_path):
    path = str(tmp_path / "bars")
    with pytest.raises(Exception, match="invalid freq"):
        store.upsert_bars(bars(spark, [("A", days(1)[0], 1.0, "1d"), ("B", days(1)[0], 1.0, "2h")]), path)
    assert store.read_bars(spark, path).count() == 0


def test_partitions_are_pruned_and_filters_pushed(spark, tmp_path):
    path = str(tmp_path / "bars")
    store.upsert_bars(bars(spark, [(t, d, 1.0, "1d") for t in "ABC" for d in days(3)]), path)
    plan = store.close_series(spark, path, ["A"], start="2024-01-02")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(freq" in plan and "ticker" in plan.split("PartitionFilters")[1].split("]")[0]
    assert "GreaterThanOrEqual(ts" in plan and "open" not in plan.split("ReadSchema")[1]


def test_csv_folder(spark, tmp_path):
    (tmp_path / "INFY.NS.csv").write_text("day,close,open\n2024-01-02,10,9\nbad,11,9\n2024-01-03,,9\n2024-01-04,12,x\n")
    spec = {"kind": "csvdir", "path": str(tmp_path), "column_map": {"ts": "day"}, "ticker_from_filename": True, "adjusted": True}
    got = make_adapter(spec).load_history(spark, ["INFY.NS"]).orderBy("ts").collect()
    assert [(r["ticker"], r["close"], r["open"], r["volume"], r["adjusted"]) for r in got] == [("INFY.NS", 10.0, 9.0, None, True), ("INFY.NS", 12.0, None, None, True)]
    assert make_adapter(spec).load_history(spark, end="2024-01-03").count() == 1
    with pytest.raises(ValueError, match="lack the column"):
        make_adapter({"kind": "csvdir", "path": str(tmp_path)}).load_history(spark)


def test_parquet_folder_and_ingest(spark, tmp_path):
    spark.createDataFrame([("A", days(1)[0], 3.0)], "ticker string, date timestamp_ntz, close double").write.parquet(str(tmp_path / "in"))
    detail = store.ingest(spark, {"kind": "parquetdir", "path": str(tmp_path / "in")}, str(tmp_path / "store"))
    assert [tuple(r) for r in detail.collect()] == [("A", "1d", 1)]


def test_adapters(spark):
    with pytest.raises(ValueError, match="csvdir.*parquetdir.*synthetic.*web"):
        make_adapter({"kind": "nope"})
    import pandas as pd

    at = days(1)

    def download(ticker, start, end, freq):
        return None if ticker == "none" else pd.DataFrame({"ts": at, "open": 1.0, "high": 1.0, "low": 1.0, "close": 2.0, "volume": 3.0})

    assert [r["ticker"] for r in make_adapter({"kind": "web", "download": download}).load_history(spark, ["A", "none"]).collect()] == ["A"]


def test_json_lines_and_texts(spark, tmp_path):
    (tmp_path / "log").mkdir()
    (tmp_path / "log/a.jsonl").write_text('{"date": "2024-01-01", "input_tokens": 3}\nnot json\n{"date": "2024-01-01", "output_tokens": 4}\n')
    log = files.read_jsonl(spark, str(tmp_path / "log"), files.TOKEN_LOG)
    from tickloom.operators.ledger import spent_on

    assert spent_on(log, "2024-01-01").first()[0] == 7 and spent_on(log, "2024-01-02").first()[0] == 0
    files.append_jsonl(log, str(tmp_path / "out"))
    files.append_jsonl(log, str(tmp_path / "out"))
    assert files.read_jsonl(spark, str(tmp_path / "out"), files.TOKEN_LOG).count() == 4
    (tmp_path / "texts").mkdir()
    (tmp_path / "texts/a.TXT").write_bytes(b"caf\xe9")
    (tmp_path / "texts/b.png").write_bytes(b"x")
    assert [tuple(r) for r in files.read_texts(spark, str(tmp_path / "texts")).collect()] == [("a.TXT", "caf�")]


def test_configs(spark, tmp_path):
    (tmp_path / "seed.json").write_text(json.dumps({"a": {"x": 1}}))
    (tmp_path / "bad.json").write_text("{")
    paths = [str(tmp_path / n) for n in ("missing.json", "bad.json", "seed.json")]
    assert files.load_config(spark, paths, {"a": {"x": 0, "y": 2}}) == {"a": {"x": 1, "y": 2}}
    assert files.load_symbols(spark, [str(tmp_path / "missing.json")])["tickers"] == {}


def test_proposals_queue(spark, tmp_path):
    from tickloom.operators.proposals import queue

    for name, body in (("a.json", {"id": "1", "created_at": "2024-01-01"}), ("b.json", {"id": "2", "created_at": "2024-01-02"}), (".bt_c.json", {"id": "3"})):
        (tmp_path / name).write_text(json.dumps(body, indent=1))
    (tmp_path / "broken.json").write_text("{")
    assert [r["id"] for r in queue(files.read_proposals(spark, str(tmp_path))).collect()] == ["2", "1"]


def test_capture_stream(spark, tmp_path):
    incoming, path, mark = (str(tmp_path / n) for n in ("incoming", "store", "mark"))
    at = days(2)
    for close in (1.0, 9.0):  # the second file restates the first bar
        normalise(bars(spark, [("A", at[0], close, "1m")])).write.mode("append").parquet(incoming)
        stream.capture(spark, incoming, path, mark).awaitTermination(120)
    assert [r["close"] for r in store.read_bars(spark, path, freq="1m").collect()] == [9.0]


def test_token_stream(spark, tmp_path):
    (tmp_path / "log").mkdir()
    (tmp_path / "log/a.json").write_text("\n".join(json.dumps({"ts": f"2024-01-{d:02d}T10:00:00", "input_tokens": d, "output_tokens": 1}) for d in (1, 1, 2, 9)))
    query = stream.daily_tokens(spark, str(tmp_path / "log")).writeStream.format("memory").queryName("tokens_by_day").outputMode("append").option("checkpointLocation", str(tmp_path / "mark")).start()
    query.processAllAvailable()
    query.stop()
    got = {r["day"]: r["tokens"] for r in spark.sql("SELECT * FROM tokens_by_day").collect()}
    assert got == {"2024-01-01": 4, "2024-01-02": 3}
