"""Linking, routing, steps, gates, ledgers, graphs and inventories on small hand-made inputs."""


import pytest
from pyspark.sql import functions as F

from tickloom.functions import text
from tickloom.functions.dates import normalize_asof, recency
from tickloom.operators import graph, inventory, ledger, linker, proposals, routing, steps, vectors


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x"))).first()[0]


@pytest.mark.parametrize(
    ("raw", "want"),
    [("2024-01-05", "2024-01-05"), (" 2024-1-5 ", "2024-01-05"), ("2024/01/05", "2024-01-05"), ("05-01-2024", "2024-01-05"), ("5/1/2024", "2024-01-05"), ("3 June 2024", "2024-06-03"), ("3 jun 2024", "2024-06-03"),
     ("2024-01-05T10:11:12", "2024-01-05"), ("2024-01-05 10:11:12", "2024-01-05"), ("2024-13-01", "2024-13-01"), ("2024-01-05Z", "2024-01-05"), ("31/02/2024", None), ("June 2024", None), ("", None), (None, None)],
)
def test_normalize_asof(spark, raw, want):
    assert one(spark, normalize_asof, raw) == want


def test_recency(spark):
    today = F.lit("2024-12-31")
    assert one(spark, lambda c: recency(c, today), "2024-01-01") == pytest.approx(2.718281828 ** (-365 / 365), rel=1e-6)
    assert one(spark, lambda c: recency(c, today), "2025-06-01") == 1.0 and one(spark, lambda c: recency(c, today), "soon") == 0.0


@pytest.mark.parametrize(("out", "want"), [("DROP", True), ("drop.\nbecause", True), ("DROP it all now", True), ("dropping this whole thing", False), ("keep", False), ("", False), (None, False), (' "DROP" ', True)])
def test_drop_gate(spark, out, want):
    assert one(spark, text.is_drop, out) is want


def test_scalars(spark):
    assert one(spark, text.safe_ticker, "^NSEI") == "NSEI" and one(spark, text.safe_ticker, "^^") == "ticker"
    assert one(spark, text.pool_name, "Vendor/Model 4.6") == "or--vendor-model-4-6" and one(spark, text.model_slug, "") == "model"
    assert one(spark, text.ontology_slug, "") == "x" and one(spark, text.proposal_slug, "!") == "signal"
    assert one(spark, lambda c: text.match_label(c, ["high", "low"]), "it is below") == "low"
    assert one(spark, text.token_estimate, "abc") == 1 and one(spark, text.token_estimate, "a" * 9) == 2
    assert [one(spark, text.horizon_days, x) for x in ("5d", "10D", "2w", "", None)] == [5, 10, 5, 5, 5]
    assert one(spark, text.log_tail, "\x1b[1;31mA\x1b[0m\n2024-01-01T00:00:00 x\n\nB") == "A\nB"
    assert one(spark, text.message_text, [("a",), (None,), ("b",)], "array<struct<text:string>>") == "a\nb"


SYMBOLS = {"defaultBenchmark": "IDX", "tickers": {"AB.NS": {"aliases": ["Alpha Beta", "C++"], "benchmark": "BM"}, "^IX": {"aliases": [""]}}}


@pytest.mark.parametrize(("blob", "want"), [("we like alpha beta.", ["AB.NS"]), ("alphabeta", []), ("AB.NS rose", ["AB.NS"]), ("ABXNS", []), ("x^IX", ["^IX"]), (" ^IX", []), (None, []), ("éAlpha Beta", [])])
def test_resolve_tickers(spark, blob, want):
    assert one(spark, lambda c: linker.resolve_tickers(c, SYMBOLS), blob) == want


def test_links(spark):
    got = spark.range(1).select(linker.resolve_tickers(F.lit("Alpha Beta"), SYMBOLS, F.array(F.lit(" Q "), F.lit("AB.NS"), F.lit("")))).first()[0]
    assert got == ["Q", "AB.NS"]
    assert one(spark, lambda c: linker.benchmark_for(c, SYMBOLS), "AB.NS") == "BM" and one(spark, lambda c: linker.benchmark_for(c, SYMBOLS), "zz") == "IDX"
    assert spark.range(1).select(linker.provenance_tags(F.array(F.lit("A")), F.lit("2024-01-01"))).first()[0] == ["ticker:A", "asof:2024-01-01"]
    assert linker.symbol_table(spark, SYMBOLS).count() == 5


def route(spark, rules, content="text", meta=None, tags=None, **more):
    docs = spark.createDataFrame([(content, tags, meta or {})], "text string, tags array<string>, meta map<string,string>")
    return routing.route(docs, {"routing": {"rules": rules, **more}}).first()["model"]


def test_rules(spark):
    hit = lambda cond, **kw: route(spark, [{"if": cond, "model": "m"}], **kw) == "m"
    assert not hit({}) and hit({"unknown": 1}) and hit({"signal": {}}) and hit({"pattern": ""})
    assert not hit({"docType": "a"}) and hit({"docType": ["a", "b"]}, meta={"docType": "b"})
    assert hit({"tag": "Q3"}, tags=["q3"]) and not hit({"tag": "Q3"}, tags=None) and not hit({"tag": []}, tags=["x"])
    assert hit({"signal": {"move": ["high"]}}, meta={"move": "high"}) and not hit({"signal": {"_raw": "x"}}, meta={"_raw": "x"}) and hit({"signal": {"move": None, "gone": [None]}}, meta={}) is False
    assert hit({"pattern": "TEX."}) and not hit({"pattern": "("}) and hit({"minLength": 4, "maxLength": 4}) and not hit({"minLength": 5})
    assert route(spark, [{"if": {"minLength": 0}}]) == "extractor" and route(spark, [{"if": {"minLength": 0}, "model": "m"}], enabled=False) == "extractor"
    assert route(spark, [{"if": {"minLength": 0}, "model": "first"}, {"if": {"minLength": 0}, "model": "second"}]) == "first"


@pytest.mark.parametrize(
    ("content", "tools", "want"),
    [("why did it fail", False, ("high", "reasoning_pattern")), ("anomalies in feed", False, ("high", "reasoning_pattern")), ("x" * 1501, True, ("mid", "tools_with_long_context")), ("please confirm " + "x" * 900, False, ("low", "routine_pattern")),
     ("hello", False, ("low", "short_request")), ("hello", True, ("mid", "default")), ("x" * 800, False, ("mid", "default")), (None, False, ("low", "short_request"))],
)
def test_tiers(spark, content, tools, want):
    assert tuple(one(spark, lambda c: routing.tier(c, F.lit(tools)), content)) == want


def test_named_tier_and_cap(spark):
    assert tuple(one(spark, lambda c: routing.tier(F.lit("why"), F.lit(False), c), "low")) == ("low", "explicit:low")
    assert [one(spark, routing.output_cap, x, "int") for x in (None, 0, 100, 9000)] == [2000, 2000, 100, 2000]


def model(content, step):
    return F.when(content.contains(step["prompt"]), F.lit(step["says"])).otherwise(F.lit("no")), F.when(content.contains("boom"), F.lit("timeout"))


def test_steps(spark):
    plan = [
        {"id": "type", "output": "signal", "metaKey": "docType", "labels": ["call"], "prompt": "earnings", "says": "a CALL"},
        {"id": "gate", "output": "rewrite", "prompt": "junk", "says": "DROP", "appliesTo": {"docTypes": ["call"]}},
        {"id": "secret", "output": "signal", "metaKey": "_x", "prompt": "earnings", "says": "s"},
        {"id": "off", "output": "rewrite", "prompt": "earnings", "says": "changed", "enabled": False},
    ]
    docs = spark.createDataFrame([(1, "earnings junk"), (2, "earnings boom"), (3, "junk"), (4, None)], "doc_id int, text string")
    out = {r["doc_id"]: r for r in steps.run_steps(docs, plan, model).collect()}
    assert out[1]["dropped"] and out[1]["text"] is None and out[1]["meta"] == {"docType": "call"} and [t["step"] for t in out[1]["trace"]] == ["type", "gate"]
    assert not out[2]["dropped"] and out[2]["meta"] == {} and out[2]["trace"][0]["error"] == "timeout"
    assert out[3]["text"] == "junk" and out[3]["cur_type"] is None and [t["step"] for t in out[3]["trace"]] == ["type", "secret"]
    assert out[4]["text"] is None and not out[4]["dropped"]


def test_feature_step(spark):
    from conftest import days

    at = days(40)
    bars = spark.createDataFrame([(t, d, 100.0 + (n % 7) * (1 if t == "A" else 5), None) for t in "AB" for n, d in enumerate(at)], "ticker string, ts timestamp_ntz, close double, bench string")
    day = f"{at[30]:%Y-%m-%d}"
    docs = spark.createDataFrame([(1, "x", ["A", "B"], day), (2, "x", ["Z"], day), (3, "x", ["A"], None)], "doc_id int, text string, tickers array<string>, as_of string")
    step = {"id": "move", "engine": "feature", "feature": "realized_vol", "metaKey": "move", "thresholds": {"high": 0.05}}
    out = {r["doc_id"]: r["meta"] for r in steps.run_steps(docs, [step], model, bars=bars).collect()}
    assert out == {1: {"move": "high"}, 2: {}, 3: {}}
    assert [tuple(r)[:2] for r in steps.feature_values(docs, bars, "realized_vol").collect()] == [(1, "B")]


def test_proposals(spark):
    check = lambda *a: spark.range(1).select(proposals.problems(*[F.lit(x).cast("string" if n < 2 else "boolean") for n, x in enumerate(a)])).first()[0]
    assert check("a", "long", True, True) == [] and check(None, "flat", True, False) == ["missing 'id'", "direction must be long|short", "trigger.match required"]
    assert one(spark, proposals.first_json, 'x { y {"a": {"b": 1}} {') == '{"a": {"b": 1}}' and one(spark, proposals.first_json, "none {") is None
    assert spark.range(1).select(proposals.trigger_tickers(F.array().cast("array<string>"), F.array(F.lit("U")))).first()[0] == ["U"]


def test_budget(spark):
    assert [one(spark, ledger.budget_state, x, "long") for x in (0, 50_100, 100_000)] == ["ok", "warn", "exhausted"]
    log = spark.createDataFrame([("d", n, 40_000, 10_000) for n in range(4)], "date string, at int, input_tokens long, output_tokens long")
    got = [tuple(r)[4:] for r in ledger.budget_gate(log, "at", ()).orderBy("at").collect()]
    assert [g[:2] for g in got] == [(0, False), (50_000, False), (100_000, True), (150_000, True)] and got[2][2] == ledger.BUDGET_REPLY and [g[3] for g in got] == [True] * 4


def test_ledger_keys_and_overview(spark):
    calls = spark.createDataFrame([("g", "v/m", 1.0, 2), ("", "v/m", 2.0, None), (None, None, None, 1)], "model_group string, model string, spend double, total_tokens long")
    assert [tuple(r) for r in ledger.spend_by_model(calls).collect()] == [("m", 1, 2.0, 0), ("g", 1, 1.0, 2), ("—", 1, 0.0, 1)]
    assert tuple(ledger.totals(calls).first()) == (3, 3.0, 3)
    keys = spark.createDataFrame([("p", None, 3.0)], "alias string, max_budget double, spend double")
    view = ledger.overview(spark.createDataFrame([("p",), ("q",)], "alias string"), keys)
    assert sorted(map(tuple, view.collect())) == [("p", None, 3.0, None), ("q", None, 0.0, None)]
    assert tuple(ledger.overview_totals(view).first()) == (0.0, 3.0)
    shown = ledger.with_display(spark.createDataFrame([("a",), ("embed",), ("b",)], "id string"), spark.createDataFrame([("a", "A")], "id string, name string"))
    assert sorted(map(tuple, shown.collect())) == [("a", "A"), ("b", "")]


def test_graph(spark):
    none_v, none_e = spark.createDataFrame([], "id string, labels array<string>, name string, text string"), spark.createDataFrame([], "src string, dst string, type string")
    assert tuple(graph.counts(none_v, none_e).first()) == (0, 0) and graph.preview(none_v, none_e).count() == 0
    proposals_ = spark.createDataFrame([("s", ["A", "Z"], ["B"]), ("u", [], ["B"])], "id string, match_tickers array<string>, universe array<string>")
    tags = spark.createDataFrame([("ticker:A",), ("ticker:B",), ("ticker:A",)], "tag string")
    assert sorted(map(tuple, graph.signal_edges(proposals_, tags).collect())) == [("s", "ticker:A"), ("u", "ticker:B")]


def test_vectors(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 1.0]), (3, [0.0, 0.0]), (4, None), (5, [2.0, 0.0])], "vec_id long, embedding array<float>")
    assert [(r["vec_id"], round(r["score"], 6)) for r in vectors.recall(v, [1.0, 0.0], 3).collect()] == [(1, 1.0), (5, 1.0), (2, 0.707107)]
    each = vectors.recall_each(v, spark.createDataFrame([(9, [0.0, 1.0])], "query_id long, query array<double>"), 1)
    assert [tuple(r)[:2] for r in each.collect()] == [(9, 2)]


def test_files_of_any_size_and_kind(spark, tmp_path):
    """More than 2 GB, folders in folders, line ends at the border of a chunk, hidden and empty files; what is as old isn't read again."""
    import hashlib

    with open(tmp_path / "large.bin", "wb") as f:
        f.truncate((2 << 30) + 17)
    deep = tmp_path / "a" / "b=c d" / "e"
    deep.mkdir(parents=True)
    ends = b"x" * (inventory.CHUNK - 1) + b"\r\n" + b"y\rz\n\nlast"
    (deep / "ends.jsonl").write_bytes(ends)
    (deep / "none.jsonl").write_bytes(b"")
    (deep / ".hidden").write_bytes(b"x")
    (tmp_path / "_made").write_bytes(b"made")
    (tmp_path / "empty").mkdir()
    before = inventory.snapshot(spark, str(tmp_path)).persist()
    got = {r["path"]: (r["size"], r["sha256"], r["rows"]) for r in before.collect()}
    zeros = hashlib.sha256()
    for _ in range(2048):
        zeros.update(bytes(1 << 20))
    zeros.update(bytes(17))
    assert got == {
        "_made": (4, hashlib.sha256(b"made").hexdigest(), None),
        "a/b=c d/e/ends.jsonl": (len(ends), hashlib.sha256(ends).hexdigest(), 5),
        "a/b=c d/e/none.jsonl": (0, "", 0),
        "large.bin": ((2 << 30) + 17, zeros.hexdigest(), None),
    }
    told = before.withColumn("sha256", F.concat("sha256", F.lit("!")))
    again = {r["path"]: r["sha256"] for r in inventory.snapshot(spark, str(tmp_path), told).collect()}
    assert all(again[p].endswith("!") for p in ("_made", "large.bin"))


def test_inventory(spark, tmp_path):
    (tmp_path / "data.jsonl").write_text('{"a": 1}\n' * 10)
    (tmp_path / "data.parquet").write_bytes(b"x" * 2000)
    (tmp_path / "empty.txt").write_text("")
    first = inventory.snapshot(spark, str(tmp_path)).toPandas().set_index("path")
    assert first.loc["data.jsonl", "rows"] == 10 and first.loc["empty.txt", "sha256"] == "" and len(first.loc["data.parquet", "sha256"]) == 64
    before = inventory.snapshot(spark, str(tmp_path)).persist()
    before.count()
    (tmp_path / "data.jsonl").write_text('{"a": 1}\n' * 20)
    now = inventory.snapshot(spark, str(tmp_path), before)
    found = {r["path"]: (r["anomaly"], r["drift"]) for r in inventory.compare(now, before).collect()}
    assert found == {"data.jsonl": ("ROW-DRIFT", 100.0), "data.parquet": (None, None), "empty.txt": ("ZERO-BYTE", None)}
    counted = inventory.anomalies(inventory.compare(now, before))
    assert tuple(counted.first()) == (3, 1, 1) and inventory.exit_code(counted).first()[0] == 1
    assert inventory.exit_code(inventory.anomalies(inventory.compare(now.limit(0), before))).first()[0] == 2




def test_a_delivery_is_many_files(spark, tmp_path, monkeypatch):
    """Arrived documents aren't one file a delivery, which one task would write and read."""
    from tickloom.plans import scale_queries

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60)
    docs.repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(scale_queries, "new_path", lambda _, name: f"{tmp_path}/{name}")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        assert scale_queries.incremental_fold(spark, str(tmp_path)).count() == 60
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(list((tmp_path / "incoming").glob("*.parquet"))) > 2
