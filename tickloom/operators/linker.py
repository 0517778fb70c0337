"""Documents to tickers and dates: aliases found in text, benchmarks, provenance tags."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.operators.returns import DEFAULT_BENCHMARK

#: Characters that mean something in a Java pattern.
_SPECIAL = re.compile(r"([\\^$.|?*+()\[\]{}\-&#~])")


def quoted(text: str) -> str:
    return _SPECIAL.sub(r"\\\1", text)


def pattern_of(names: Sequence[str]) -> str:
    """One pattern that finds any of the names between word borders, whatever their case."""
    return "(?iU)" + "|".join(rf"\b{quoted(n.strip())}\b" for n in names if n and n.strip())


def resolve_tickers(text: Column, symbols: Mapping, explicit: Column | None = None) -> Column:
    """Tickers of a document: the explicit ones as given, then those whose name or alias is in the text, each once.

    ``symbols`` is the symbol map ({tickers: {ticker: {aliases}}}); it is part of the plan as one pattern for each ticker,
    so documents are neither joined nor shuffled.
    """
    blob = F.coalesce(text, F.lit(""))
    found = []
    for ticker, meta in (symbols.get("tickers") or {}).items():
        names = [n for n in [ticker, *((meta or {}).get("aliases") or [])] if n and n.strip()]
        if names:
            found.append(F.when(blob.rlike(pattern_of(names)), F.lit(ticker)))
    matched = F.array_compact(F.array(*found)) if found else F.array().cast("array<string>")
    known = list(symbols.get("tickers") or {})
    given = F.coalesce(explicit, F.array().cast("array<string>")) if explicit is not None else F.array().cast("array<string>")
    given = F.filter(F.transform(given, lambda t: F.when(t.isin(known), t).otherwise(F.trim(t))), lambda t: F.coalesce(t != "", F.lit(False)))
    return F.array_distinct(F.concat(given, matched))


def symbol_table(spark, symbols: Mapping) -> DataFrame:
    """The symbol map as rows (ord, ticker, alias, benchmark, sector), a row for each alias and for the ticker itself."""
    rows = [
        (n, ticker, alias, (meta or {}).get("benchmark"), (meta or {}).get("sector"))
        for n, (ticker, meta) in enumerate((symbols.get("tickers") or {}).items())
        for alias in dict.fromkeys([ticker, *((meta or {}).get("aliases") or [])])
    ]
    return spark.createDataFrame(rows, "ord int, ticker string, alias string, benchmark string, sector string")


def benchmark_for(ticker: Column, symbols: Mapping) -> Column:
    """The ticker's benchmark, else the map's default, else the built-in one."""
    default = symbols.get("defaultBenchmark") or DEFAULT_BENCHMARK
    own = {t: m["benchmark"] for t, m in (symbols.get("tickers") or {}).items() if (m or {}).get("benchmark")}
    if not own:
        return F.lit(default)
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in own.items() for x in pair]), ticker), F.lit(default))


def provenance_tags(tickers: Column, as_of: Column) -> Column:
    """``ticker:`` tags of all tickers, then an ``asof:`` tag if there is a date."""
    dated = F.when(F.coalesce(as_of != "", F.lit(False)), F.array(F.concat(F.lit("asof:"), as_of))).otherwise(F.array().cast("array<string>"))
    return F.concat(F.transform(F.coalesce(tickers, F.array().cast("array<string>")), lambda t: F.concat(F.lit("ticker:"), t)), dated)
