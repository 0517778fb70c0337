"""Text-model steps by a service, and documents that arrive over time."""

import random
import time
from pathlib import Path

import pytest
from conftest import SF
from pyspark.sql import functions as F

from tickloom.operators import model_calls
from tickloom.operators import steps
from tickloom.operators.model_calls import TextService, answers
from tickloom.plans import queries as q
from tickloom.plans import scale_queries
from tickloom.streaming.documents import Intake, changed_scope

UP = [{"id": "up", "output": "rewrite", "prompt": "up"}]


def shaky():
    """Fails on texts with an x, hangs on texts with a z, answers one too few for a single q. Made here, so that it travels to the workers."""

    class Shaky:
        def ask(self, texts, step):
            if any("z" in t for t in texts):
                time.sleep(1.5)
            if any("x" in t for t in texts):
                raise ValueError("bad text")
            return [] if texts == ["q"] else [t.upper() for t in texts]

    return Shaky


@pytest.fixture
def service(tmp_path):
    return TextService(shaky(), str(tmp_path / "answers"), batch=4, timeout=0.5, retries=1, pause=0.0, tasks=2)


def stored(spark, service):
    return spark.read.parquet(service.store)


def test_bad_and_slow_texts_fail_alone(spark, service):
    texts = ["a", "b", "x1", "c", "z", "q", "d", "a", "a", None, ""]
    got = {r["key"]: (r["output"], r["error"]) for r in answers(spark.createDataFrame([(t,) for t in texts], "text string"), UP[0], service).collect()}
    by = spark.createDataFrame([(t,) for t in set(texts) - {None}], "text string").select("text", service.key(F.col("text"), UP[0]).alias("key")).collect()
    found = {r["text"]: got[r["key"]] for r in by}
    assert {t: o for t, (o, _) in found.items()} == {"a": "A", "b": "B", "c": "C", "d": "D", "": "", "x1": None, "z": None, "q": None}
    assert "ValueError" in found["x1"][1] and "TimeoutError" in found["z"][1] and "0 answers" in found["q"][1]
    assert stored(spark, service).count() == len(found)  # equal texts once


def test_known_answers_are_not_asked_again(spark, service):
    docs = spark.createDataFrame([(1, "a"), (2, "a"), (3, "x"), (4, None), (5, " ")], "doc_id long, text string")
    for turn in (1, 2):
        out = {r["doc_id"]: (r["text"], [e["error"] for e in r["trace"]]) for r in steps.run_steps(docs, UP, service).collect()}
        assert out[1] == out[2] == ("A", [None]) and out[3][0] == "x" and "bad text" in out[3][1][0] and out[4][0] is None and out[5][0] == " "
        # only what failed is asked again
        assert stored(spark, service).groupBy("key").count().agg(F.sum("count")).first()[0] == 1 + turn
    other = TextService(shaky(), service.store, version="2", batch=4, retries=0)
    steps.run_steps(docs.limit(1), UP, other).collect()
    assert stored(spark, service).count() == 4


def test_fold_with_a_service_equals_the_fold_in_the_plan(spark):
    got, want = (sorted(map(tuple, f(spark, SF).collect())) for f in (scale_queries.service_fold, q.pipeline_fold))
    assert got == want and any(r[5] for r in got)


SCOPED = [
    {"id": "type", "kind": "classify", "metaKey": "docType", "prompt": "type"},
    {"id": "gate", "output": "rewrite", "prompt": "gate", "appliesTo": {"docTypes": ["note"]}},
    {"id": "lower", "output": "rewrite", "prompt": "lower", "appliesTo": {"docTypes": ["essay"]}},
]


def test_scope_of_changes():
    assert changed_scope(SCOPED, SCOPED) == []
    assert changed_scope(SCOPED, [SCOPED[0], {**SCOPED[1], "prompt": "lower"}, SCOPED[2]]) == ["note"]
    assert changed_scope(SCOPED, SCOPED[:2]) == ["essay"] and changed_scope(SCOPED, [SCOPED[0], SCOPED[2], SCOPED[1]]) == ["essay", "note"]
    assert changed_scope(SCOPED, SCOPED[1:]) is None and changed_scope(SCOPED, [{**SCOPED[0], "labels": ["a"]}, *SCOPED[1:]]) is None
    off = [*SCOPED, {"id": "more", "enabled": False}]
    assert changed_scope(SCOPED, off) == [] and changed_scope(off, [*SCOPED, {"id": "more", "enabled": False, "prompt": "x"}]) == []


def state(intake):
    return {r["doc_id"]: (r["cur_type"], r["dropped"], r["text"], len(r["trace"])) for r in intake.results().collect()}


def test_only_new_and_changed_documents_and_steps(spark, tmp_path):
    """Unchanged documents are left alone, changed ones redone; a changed step redoes the types it touches; a replay changes nothing."""
    schema = "doc_id long, text string, source string"
    docs = [(1, "Short text that is long enough to be kept, I should think so. " * 2, "s"), (2, "Long. " * 300, "s"), (3, "tiny", "s"), (4, None, "s")]
    intake = Intake(spark, str(tmp_path / "r"), SCOPED, q.toy_model)
    intake.process(spark.createDataFrame(docs, schema), 0)
    once = state(intake)
    assert once[2] == ("essay", False, "long. " * 300, 2) and once[3][1] and once[1][2].startswith("> ")
    sizes = lambda: {r["batch"]: r["count"] for r in intake._rows().groupBy("batch").count().collect()}
    changed = [*docs[:2], (3, "tiny no more, but of a length that the gate lets pass through it", "s"), (5, "Long. " * 400, "s")]
    for _ in range(2):  # the second is a replay
        intake.process(spark.createDataFrame(changed, schema), 1)
        assert sizes() == {0: 4, 1: 2}
    assert not state(intake)[3][1] and state(intake)[1] == once[1]
    intake.steps = [*SCOPED[:2], {**SCOPED[2], "prompt": "gate"}]
    intake.process(spark.createDataFrame(changed, schema), 2)
    assert sizes() == {0: 4, 1: 2, 2: 2} and state(intake)[2][2].startswith("> Long.")  # both essays, no note
    whole = Intake(spark, str(tmp_path / "w"), intake.steps, q.toy_model)
    whole.process(spark.createDataFrame([*changed, docs[3]], schema), 0)
    assert state(intake) == state(whole)


def test_repeated_and_missing_ids_and_nothing(spark, tmp_path):
    schema = "doc_id long, text string, source string"
    intake = Intake(spark, str(tmp_path / "r"), SCOPED, q.toy_model)
    intake.process(spark.createDataFrame([(1, "b", None), (1, "a", "s"), (None, "c", "s")], schema), 0)
    intake.process(spark.createDataFrame([], schema), 1)
    assert [(r["doc_id"], r["source"]) for r in intake.results().collect()] == [(1, None)]


def test_texts_are_shuffled_once_a_step(spark, tmp_path):
    """They are dealt by key, by which they are also made different and compared with the known ones."""
    service = model_calls.TextService(None, str(tmp_path))
    texts = spark.createDataFrame([("a",), ("b",), ("a",), (None,)], "text string")
    wanted = model_calls._wanted(texts, {"prompt": "p"}, service)
    assert sorted(r["text"] for r in wanted.collect()) == ["a", "b"]
    known = spark.createDataFrame([("x",)], "key string")
    plan = wanted.join(known.hint("merge"), "key", "left_anti")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(key") == 2 and plan.count("Exchange") == 2  # the texts, and the known keys


def shouting():
    """Answers by prompt: half of a text, all of it in capitals, DROP for texts of one letter; no answer to a text with an x."""

    class Shouting:
        def ask(self, texts, step):
            if any("x" in t for t in texts):
                raise ValueError("bad text")
            return [{"half": t[: len(t) // 2] or "DROP", "up": t.upper(), "size": "long" if len(t) > 3 else "short", "void": None}[step["prompt"]] for t in texts]

    return Shouting


@pytest.mark.parametrize("most", [model_calls.BROADCAST_BYTES, 0])
def test_copies_known_and_rewritten_texts(spark, tmp_path, monkeypatch, most):
    """Texts that are rewritten twice, fail, vanish, become equal or were known, in documents whose columns have any names; few rows or many."""
    monkeypatch.setattr(model_calls, "BROADCAST_BYTES", most)
    texts = ["abcdef", "abcdef", "abcDEF", "ABCzzz", "abczzz", "x long one", "x long one", "a", "a", "bc", "", " ", None, None]
    docs = spark.createDataFrame([(i, t, i * 2, f"k{i}", None) for i, t in enumerate(texts)], "row long, text string, run long, key string, first string")
    fold = [{"id": "half", "output": "rewrite", "prompt": "half"}, {"id": "size", "output": "signal", "prompt": "size", "labels": ["short", "long"]}, {"id": "none", "output": "rewrite"}, {"id": "up", "output": "rewrite", "prompt": "up"}]
    service = TextService(shouting(), str(tmp_path / "answers"), batch=3, retries=0)
    want = {}
    for i, t in enumerate(texts):
        blank, bad = not (t or "").strip(), "x" in (t or "")
        half = t if blank or bad else (t[: len(t) // 2] or None)
        want[i] = (half if half is None or blank or bad else half.upper(), not blank and not bad and half is None, None if blank or half is None or bad else "short", i * 2, f"k{i}")
    for turn in (1, 2):  # the second knows all answers but those that failed
        out = steps.run_steps(docs, fold, service)
        assert out.columns == [*docs.columns, "cur_type", "meta", "dropped", "trace"]
        rows = out.collect()
        assert {r["row"]: (r["text"], r["dropped"], r["meta"].get("size"), r["run"], r["key"]) for r in rows} == want and len(rows) == len(texts)
        errors = {r["row"]: [e["error"] is not None for e in r["trace"]] for r in rows}
        assert errors[5] == [True, True, False, True] and errors[0] == [False] * 4 and errors[7] == [False] and errors[12] == [False] * 4
        asked = stored(spark, service).where("error IS NULL").count()
        assert asked == 6 + 3 + 3  # halves of six texts; sizes, then capitals, of abc, ABC and b, once each
    void = steps.run_steps(docs, [{"id": "void", "output": "rewrite", "prompt": "void"}], service).collect()
    assert {r["row"]: r["text"] for r in void} == {i: t if "x" in (t or "") or not (t or "").strip() else None for i, t in enumerate(texts)}


def test_steps_that_mark_write_no_texts(spark, tmp_path):
    """Texts stand once in the shared folder, however many steps ask for them."""
    draw = random.Random(5)
    docs = spark.createDataFrame([(i, draw.randbytes(40_000).hex()) for i in range(40)], "doc_id long, text string")
    shared = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file:"))
    size = lambda: sum(f.stat().st_size for f in shared.rglob("*") if f.is_file())
    before, service = size(), TextService(shouting(), str(tmp_path / "answers"))
    fold = [{"id": f"s{k}", "output": "signal", "prompt": "size", "labels": ["long"], "model": k} for k in range(4)]
    rows = steps.run_steps(docs, fold, service).collect()
    assert all(r["meta"] == {f"s{k}": "long" for k in range(4)} and len(r["text"]) == 80_000 for r in rows) and len(rows) == 40
    assert stored(spark, service).count() == 160 and size() - before < 40 * 80_000


@pytest.mark.parametrize("most", [model_calls.BROADCAST_BYTES, 0])
def test_texts_of_many_rows_are_split_where_they_are(spark, monkeypatch, most):
    """By a bit for each, as a join of numbers would."""
    monkeypatch.setattr(model_calls, "BROADCAST_BYTES", most)
    texts = spark.range(100_000).select(((F.col("id") % 3) * (1 << 33) + F.col("id")).alias("row"), F.col("id").cast("string").alias("text"))
    rows = texts.where("text % 7 = 0 AND row < 15000000000").select("row")
    among = model_calls.split(texts, rows, True)
    assert sorted(map(tuple, among.collect())) == sorted(map(tuple, texts.join(rows, "row").collect()))
    assert model_calls.split(texts, rows, False).count() == 100_000 - among.count() and model_calls.split(texts, rows.limit(0), True).count() == 0
    plan = among._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan or not most
