"""The document pipeline: ordered steps that rewrite, drop or mark documents, folded into a DataFrame."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.functions.text import is_drop, label_from_value, match_label
from tickloom.operators import model_calls
from tickloom.operators.model_calls import TextService
from tickloom.operators.returns import compute
from tickloom.shared import written

#: A step's model: given the documents in scope (with text) and the step, the column ``output`` of texts, and ``error``.
Model = Callable[[Column, Mapping], tuple[Column, Column | None]]
_META = "map<string,string>"
_TRACE = "array<struct<step:string,output:string,dropped:boolean,error:string,meta:map<string,string>>>"


def output_mode(step: Mapping) -> str:
    """``rewrite`` or ``signal``: the step's own word, else by its older ``kind``."""
    mode = str(step.get("output") or "").strip().lower()
    if mode in ("rewrite", "signal"):
        return mode
    return "signal" if str(step.get("kind") or "").strip().lower() == "classify" else "rewrite"


def output_mode_of(output: Column, kind: Column) -> Column:
    """output_mode() of steps that are rows."""
    mode = F.lower(F.trim(F.coalesce(output, F.lit(""))))
    return F.when(mode.isin("rewrite", "signal"), mode).when(F.lower(F.trim(F.coalesce(kind, F.lit("")))) == "classify", "signal").otherwise("rewrite")


def applies(step: Mapping, doc_type: Column) -> Column:
    """Whether a step is enabled and meant for the document's current type."""
    if not step.get("enabled", True):
        return F.lit(False)
    kinds = (step.get("appliesTo") or {}).get("docTypes") or ["*"]
    return F.lit(True) if "*" in kinds else F.coalesce(doc_type.isin(list(kinds)), F.lit(False))


def started(docs: DataFrame, doc_type: Column | None = None) -> DataFrame:
    """``docs`` (text) with the state that steps carry: cur_type, meta, dropped, trace."""
    kind = F.lit(None).cast("string") if doc_type is None else doc_type.cast("string")
    empty = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    return docs.withColumns({"cur_type": kind, "meta": F.when(kind.isNotNull(), F.create_map(F.lit("docType"), kind)).otherwise(empty).cast(_META), "dropped": F.lit(False), "trace": F.array().cast(_TRACE)})


def _put(meta: Column, key: str, value: Column) -> Column:
    """``meta`` with ``key`` set to ``value``, whatever it was before."""
    return F.map_concat(F.map_filter(meta, lambda k, _: k != key), F.create_map(F.lit(key), value))


def _advance(docs: DataFrame, step: Mapping, mode: str, ran: Column, dropped: Column, text: Column, value: Column, error: Column) -> DataFrame:
    """The state after one step: ``ran`` says where it applied, ``value`` what it marks (null: nothing)."""
    key = step.get("metaKey") or step.get("id") or ("feature" if step.get("engine") == "feature" else "label")
    failed = error.isNotNull()
    marks = ran & ~failed & value.isNotNull()
    empty = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    entry = F.struct(
        F.lit(step.get("name") or step.get("id") or "step").alias("step"), F.lit(mode).alias("output"), (dropped & ~failed).alias("dropped"), error.cast("string").alias("error"),
        F.when(value.isNotNull() & F.lit(not key.startswith("_")), F.create_map(F.lit(key), value)).otherwise(empty).alias("meta"),
    )
    new = {"trace": F.when(ran, F.concat("trace", F.array(entry).cast(_TRACE))).otherwise(F.col("trace")), "dropped": F.col("dropped") | (ran & ~failed & dropped)}
    if not key.startswith("_"):
        new["meta"] = F.when(marks, _put(F.col("meta"), key, value)).otherwise(F.col("meta"))
    if key == "docType":
        new["cur_type"] = F.when(marks, value).otherwise(F.col("cur_type"))
    if mode == "rewrite" and "text" in docs.columns:
        new["text"] = F.when(ran & ~failed, F.when(dropped, F.lit(None)).otherwise(text)).otherwise(F.col("text"))
    return docs.withColumns(new)


def text_step(docs: DataFrame, step: Mapping, model: Model | TextService) -> DataFrame:
    """A step of a text model. Without a prompt or with a blank text it does nothing; an error keeps the document as it is.

    A model is a function of Columns, which stays in the plan, or a service, before which the documents are written.
    """
    if isinstance(model, TextService):
        return _served(docs, [step], model)
    mode = output_mode(step)
    ran = ~F.col("dropped") & applies(step, F.col("cur_type"))
    active = ran & F.lit(_prompted(step)) & (F.trim(F.coalesce("text", F.lit(""))) != "")
    output, error = model(F.col("text"), step)
    return _after_text(docs, step, mode, ran, active, output, is_drop(output), error)


def _prompted(step: Mapping) -> bool:
    return bool(str(step.get("prompt") or "").strip())


def _after_text(docs: DataFrame, step: Mapping, mode: str, ran: Column, active: Column, output: Column, drops: Column, error: Column | None) -> DataFrame:
    error = F.when(active, error) if error is not None else F.lit(None).cast("string")
    none = F.lit(None).cast("string")
    if mode == "signal":
        labels = step.get("labels") or []
        value = F.when(active, match_label(output, labels) if labels else F.nullif(F.trim(output), F.lit("")))
        return _advance(docs, step, mode, ran, F.lit(False), F.col("text"), value, error)
    return _advance(docs, step, mode, ran, active & drops, F.when(active, output).otherwise(F.col("text")), none, error)


def _served(docs: DataFrame, steps: Sequence[Mapping], service: TextService, bars: DataFrame | None = None, doc_id: str = "doc_id", use_benchmark: bool = True) -> DataFrame:
    """``docs`` after all steps with a service. They are written once, with numbers; from then on steps carry the state without texts."""
    whole = written(docs.withColumn("__row", F.monotonically_increasing_id()), "documents")
    state, texts = whole.drop("text"), whole.select(F.col("__row").alias("row"), "text").where("text IS NOT NULL")
    for step in steps:
        if _is_feature(step):
            state = feature_step(state, step, bars, doc_id, use_benchmark) if step.get("feature") and bars is not None else state
        else:
            state, texts = _service_step(state, texts, step, service)
    return state.join(texts.withColumnRenamed("row", "__at"), F.col("__row") == F.col("__at"), "left").select(*docs.columns)


def _service_step(state: DataFrame, texts: DataFrame, step: Mapping, service: TextService) -> tuple[DataFrame, DataFrame]:
    """State and texts (row, text) after a step; texts neither move nor are written for it, only answers are."""
    mode, none = output_mode(step), F.lit(None).cast("string")
    ran = ~F.col("dropped") & applies(step, F.col("cur_type"))
    if not _prompted(step) or not step.get("enabled", True):
        return _after_text(state, step, mode, ran, F.lit(False), none, F.lit(False), None), texts
    asked = texts.where(F.trim("text") != "").select(F.col("row").alias("__at"), service.key(F.col("text"), step).alias("__asked"))
    joined = state.join(asked, F.col("__row") == F.col("__at"), "left").withColumn("__active", ran & F.col("__asked").isNotNull())
    # documents that aren't asked have a key of their own, so that they don't meet in one task
    key = F.when(F.col("__active"), F.col("__asked")).otherwise(F.concat(F.lit("none:"), F.col("__row").cast("string")))
    state = written(joined.withColumn("__key", key).drop("__at", "__asked"), "state")
    run = model_calls.ask_rows(state.where("__active").select(F.col("__key").alias("key"), F.col("__row").alias("row")), texts, step, service)
    shown = F.col("output").alias("__output") if mode == "signal" else is_drop(F.col("output")).alias("__drops")
    best = model_calls._best(state.sparkSession, service, run, shown).withColumnsRenamed({"key": "__of", "run": "__run", "row": "__first", "error": "__error"})
    state = state.join(best, F.col("__key") == F.col("__of"), "left")
    if mode != "signal":
        changed = state.where(F.col("__active") & F.col("__error").isNull()).select(F.col("__row").alias("row"), F.col("__key").alias("key"), F.col("__run").alias("run"), F.col("__first").alias("first"))
        texts = model_calls.rewritten(changed, texts, service, run, ~is_drop(F.col("output")))
    output, drops = (F.col("__output"), F.lit(False)) if mode == "signal" else (none, F.col("__drops"))
    out = _after_text(state, step, mode, ran, F.col("__active"), output, drops, F.col("__error"))
    return out.drop("__active", "__key", "__of", "__run", "__first", "__error", "__output", "__drops"), texts


def _is_feature(step: Mapping) -> bool:
    return str(step.get("engine") or "llm").strip().lower() == "feature"


def feature_values(docs: DataFrame, bars: DataFrame, name: str, doc_id: str = "doc_id", params: Mapping | None = None, use_benchmark: bool = True) -> DataFrame:
    """(doc_id, ticker, value): of a document's tickers the one with the most extreme value, the first on a tie.

    ``docs`` have doc_id, tickers and as_of (text). A document without tickers, date or data has no row.
    """
    wanted = docs.select(F.col(doc_id).alias("doc_id"), F.posexplode("tickers").alias("ord", "ticker"), F.col("as_of").try_cast("timestamp_ntz").alias("as_of")).where("as_of IS NOT NULL AND ticker IS NOT NULL")
    values = compute(name, bars, wanted, params, use_benchmark).where("value IS NOT NULL")
    best = values.groupBy("doc_id").agg(F.max_by(F.struct("ticker", "value"), F.struct(F.abs("value"), -F.col("ord"))).alias("b"))
    return best.select("doc_id", "b.*")


def feature_step(docs: DataFrame, step: Mapping, bars: DataFrame, doc_id: str = "doc_id", use_benchmark: bool = True) -> DataFrame:
    """A step that marks documents with a price feature's label, or its value to 4 decimals; without data nothing."""
    values = feature_values(docs, bars, step["feature"], doc_id, step.get("params"), use_benchmark).select(F.col("doc_id").alias("__id"), F.col("value").alias("__v"))
    joined = docs.join(values, docs[doc_id] == values["__id"], "left")
    label = F.coalesce(label_from_value(F.col("__v"), step.get("thresholds") or {}), F.round("__v", 4).cast("string"))
    ran = ~F.col("dropped") & applies(step, F.col("cur_type"))
    value = F.when(ran, label)
    return _advance(joined, step, "signal", ran, F.lit(False), F.col("text"), value, F.lit(None).cast("string")).drop("__id", "__v")


def run_steps(docs: DataFrame, steps: Sequence[Mapping], model: Model | TextService, doc_type: Column | None = None, bars: DataFrame | None = None, doc_id: str = "doc_id", use_benchmark: bool = True) -> DataFrame:
    """``docs`` after all steps, with text (null if dropped), cur_type, meta, dropped and trace.

    A step out of scope leaves no trace; one that fails leaves the document as it was; after a drop none runs; a step
    that marks ``docType`` changes the scope of those after it.
    """
    out = started(docs, doc_type)
    if isinstance(model, TextService):
        return _served(out, steps or [], model, bars, doc_id, use_benchmark)
    for step in steps or []:
        if _is_feature(step):
            out = feature_step(out, step, bars, doc_id, use_benchmark) if step.get("feature") and bars is not None else out
        else:
            out = text_step(out, step, model)
    return out
