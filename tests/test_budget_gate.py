"""The streamed budget gate against a fold over the ordered log."""

import datetime as dt
import random

from tickloom.operators.ledger import BUDGET_REPLY
from tickloom.streaming.budget import run_gate

SCHEMA = "call_id long, ts string, input_tokens long, output_tokens long"


def fold(calls, soft, hard):
    spent, out = {}, {}
    for call_id, ts, a, b in sorted(calls, key=lambda c: (c[1], c[0])):
        before, used = spent.get(ts[:10], 0), (a or 0) + (b or 0)
        refused = before >= hard
        spent[ts[:10]] = before if refused else before + used
        out[call_id] = (ts[:10], used, before, refused, BUDGET_REPLY if refused else None, spent[ts[:10]] >= soft)
    return out


def arrive(spark, folder, calls):
    spark.createDataFrame(calls, SCHEMA).coalesce(1).write.mode("append").json(str(folder))


def decisions(spark, out):
    return {r["call_id"]: tuple(r)[1:] for r in spark.read.parquet(str(out)).collect()}


def go(spark, tmp_path, soft=300, hard=500):
    stream = spark.readStream.schema(SCHEMA).json(str(tmp_path / "in"))
    run_gate(spark, stream, str(tmp_path / "out"), str(tmp_path / "check"), soft, hard).awaitTermination()


def test_equals_a_fold_over_several_runs(spark, tmp_path):
    draw, calls, at = random.Random(2), [], dt.datetime(2024, 2, 27)
    for n in range(400):
        at += dt.timedelta(minutes=draw.choice([0, 5, 20, 30]))
        calls.append((n, at.isoformat(), draw.choice([None, 3, 40]), draw.choice([None, 0, 10])))
    provider = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    for part in (calls[:150], calls[150:151], calls[151:]):
        arrive(spark, tmp_path / "in", part)
        go(spark, tmp_path)
    assert decisions(spark, tmp_path / "out") == fold(calls, 300, 500)
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") == provider
    assert any(d[3] for d in decisions(spark, tmp_path / "out").values())


def test_over_the_cap_gets_the_reply_and_next_day_is_free(spark, tmp_path):
    """One call may exceed the cap, as its cost is known afterwards; all later ones of the day are refused and cost nothing."""
    arrive(spark, tmp_path / "in", [(1, "2024-05-01T10:00:00", 400, 0), (2, "2024-05-01T10:00:01", 5000, 0), (3, "2024-05-01T10:00:02", 1, 1), (4, None, 1, 1), (5, "no time", 1, 1)])
    go(spark, tmp_path)
    arrive(spark, tmp_path / "in", [(6, "2024-05-01T23:59:59", 9, 9), (7, "2024-05-02T00:00:00", 5, 3)])
    go(spark, tmp_path)
    got = decisions(spark, tmp_path / "out")
    assert {k: v[2:4] for k, v in got.items()} == {1: (0, False), 2: (400, False), 3: (5400, True), 6: (5400, True), 7: (0, False)}
    assert got[3][4] == BUDGET_REPLY and got[7][4] is None and got[1][5] and not got[7][5]


def test_a_closed_day_is_forgotten(spark, tmp_path):
    arrive(spark, tmp_path / "in", [(1, "2024-05-01T10:00:00", 600, 0)])
    go(spark, tmp_path)
    arrive(spark, tmp_path / "in", [(2, "2024-05-03T10:00:00", 1, 0)])
    go(spark, tmp_path)
    arrive(spark, tmp_path / "in", [(3, "2024-05-01T11:00:00", 1, 0), (4, "2024-05-03T11:00:00", 1, 0)])
    go(spark, tmp_path)
    assert decisions(spark, tmp_path / "out").keys() == {1, 2, 4}  # the first day's late call finds it closed
