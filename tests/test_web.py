"""The price service as a data source, in one go and followed."""

import pandas as pd

from tickloom.sources.bars import Web
from tickloom.sources.store import read_bars
from tickloom.sources.web import follow_prices, price_source, read_prices


def service(folder):
    """A service whose prices and present stand in a folder; each call is noted there."""

    def fetch(ticker, start, end, freq):
        import os
        import uuid

        with open(os.path.join(folder, f"call-{uuid.uuid4().hex}"), "w") as f:
            f.write(f"{ticker} {start} {end} {freq}")
        bars = pd.read_json(os.path.join(folder, "bars.json"), dtype={"ticker": str})
        mine = bars[bars["ticker"] == ticker]
        return mine.drop(columns="ticker") if len(mine) else None

    def clock():
        with open(f"{folder}/now") as f:
            return f.read()

    return fetch, clock


def publish(folder, rows, now):
    pd.DataFrame(rows, columns=["ticker", "ts", "close"]).to_json(folder / "bars.json", date_format="iso")
    (folder / "now").write_text(now)


def calls(folder):
    return sorted(f.read_text() for f in folder.glob("call-*"))


def closes(df):
    return {(r["ticker"], f"{r['ts']:%m-%d}"): r["close"] for r in df.collect()}


def test_in_one_go(spark, tmp_path):
    publish(tmp_path, [("A", "2024-01-01", 1.0), ("A", "2024-01-02", 2.0), ("A", "2024-01-03", 3.0), ("B", "2024-01-02", 9.0)], "2024-01-03")
    spark.dataSource.register(price_source(*service(str(tmp_path)), name="one_go"))
    df = read_prices(spark, ["A", "B", "C"], "2024-01-02", "2024-01-02", "1m", name="one_go")
    assert df.rdd.getNumPartitions() == 3
    got = df.collect()
    assert {(r["ticker"], r["close"], r["open"], r["adjusted"], r["freq"]) for r in got} == {("A", 2.0, None, True, "1m"), ("B", 9.0, None, True, "1m")}
    assert calls(tmp_path) == [f"{t} 2024-01-02 2024-01-02 1m" for t in "ABC"]
    assert read_prices(spark, [], name="one_go").count() == 0
    assert read_prices(spark, ["A", "B", "C"], each=2, name="one_go").rdd.getNumPartitions() == 2


def test_followed_with_restated_bars(spark, tmp_path):
    """Each run asks only for what is new and the days before it; restated bars there replace what was held, older ones don't."""
    fetch, clock = service(str(tmp_path))
    spark.dataSource.register(price_source(fetch, clock, "followed"))
    store, at = str(tmp_path / "store"), str(tmp_path / "check")
    go = lambda: follow_prices(spark, ["A"], store, at, "2024-01-01", lookback=2, name="followed").awaitTermination()
    publish(tmp_path, [("A", f"2024-01-{d:02d}", d) for d in range(1, 11)], "2024-01-10")
    go()
    go()  # nothing new
    assert len(calls(tmp_path)) == 1 and len(closes(read_bars(spark, store))) == 10
    publish(tmp_path, [("A", f"2024-01-{d:02d}", d * 100) for d in range(1, 16)], "2024-01-12")
    go()
    got = closes(read_bars(spark, store))
    assert got == {("A", f"01-{d:02d}"): d * 100 if d >= 8 else d for d in range(1, 13)}
    assert calls(tmp_path) == ["A 2024-01-01T00:00:00 2024-01-10 1d", "A 2024-01-08T00:00:00 2024-01-12 1d"]


def test_adapter_takes_the_source(spark, tmp_path):
    publish(tmp_path, [("A", "2024-01-01", 1.0), ("B", "2024-01-02", 2.0)], "2024-01-03")
    bars = Web(service(str(tmp_path))[0]).load_history(spark, ["A", "B", "C"], start="2024-01-02")
    assert closes(bars) == {("B", "01-02"): 2.0}
