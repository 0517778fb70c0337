"""A property graph as two tables: vertices (id, labels, name, text) and edges (src, dst, type)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def save_graph(vertices: DataFrame, edges: DataFrame, path: str) -> None:
    """Both tables of a graph in the folder ``path``, in place of what was there."""
    for name, df in (("vertices", vertices), ("edges", edges)):
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def _part(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except Exception as e:  # the reader has no narrower class for a missing path
        if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
            return None
        raise


def graph_stats(spark: SparkSession, path: str) -> DataFrame:
    """One row (exists, nodes, edges, labels): labels sorted. A graph without vertices has none, a missing table counts 0."""
    vertices, edges = (_part(spark, f"{path}/{name}") for name in ("vertices", "edges"))
    if vertices is None:
        return spark.range(1).select(F.lit(False).alias("exists"), F.lit(0).cast("long").alias("nodes"), F.lit(0).cast("long").alias("edges"), F.array().cast("array<string>").alias("labels"))
    names = labels(vertices).agg(F.array_sort(F.collect_list("label")).alias("labels"))  # a graph has few labels
    number = counts(vertices, edges if edges is not None else vertices.limit(0))
    return number.crossJoin(names).select(F.lit(True).alias("exists"), "nodes", "edges", "labels")


def counts(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """One row (nodes, edges); tables without rows count 0."""
    return vertices.agg(F.count("*").alias("nodes")).crossJoin(edges.agg(F.count("*").alias("edges")))  # one row each


def labels(vertices: DataFrame) -> DataFrame:
    return vertices.select(F.explode("labels").alias("label")).where("label <> ''").distinct().orderBy("label")


def relation_types(edges: DataFrame) -> DataFrame:
    return edges.select("type").distinct().orderBy("type")


def preview(vertices: DataFrame, edges: DataFrame, n: int = 40) -> DataFrame:
    """The first ``n`` edges by (src, type, dst) with both ends' display names: name, else first label, cut to 28."""
    chosen = edges.orderBy("src", "type", "dst").limit(n)

    def end(which: str) -> DataFrame:
        group = F.coalesce(F.get("labels", F.lit(0)), F.lit("Node"))
        return vertices.select(F.col("id").alias(which), F.left(F.coalesce(F.nullif("name", F.lit("")), group), F.lit(28)).alias(f"{which}_label"), group.alias(f"{which}_group"))

    # n rows meet the vertices twice; both joins broadcast the n rows
    chosen = end("src").join(F.broadcast(chosen), "src")
    return end("dst").join(F.broadcast(chosen), "dst").select("src", "src_label", "src_group", "type", "dst", "dst_label", "dst_group")


def preview_nodes(edges: DataFrame) -> DataFrame:
    """The distinct nodes of a preview."""
    sides = [edges.select(F.col(s).alias("id"), F.col(f"{s}_label").alias("label"), F.col(f"{s}_group").alias("group")) for s in ("src", "dst")]
    return sides[0].unionByName(sides[1]).distinct()


def upsert_signals(existing: DataFrame, proposals: DataFrame) -> DataFrame:
    """Signals by id: a proposal replaces the signal of its id, the last by (created_at, approved_at) if there are several."""
    columns = existing.columns
    both = existing.withColumn("__new", F.lit(0)).unionByName(proposals.withColumn("__new", F.lit(1)), allowMissingColumns=True)
    latest = both.groupBy("id").agg(F.max_by(F.struct(*columns), F.struct("__new", F.coalesce("created_at", F.lit("")), F.coalesce("approved_at", F.lit("")))).alias("s"))
    return latest.select("s.*")


def signal_edges(proposals: DataFrame, tags: DataFrame) -> DataFrame:
    """(id, tag) links of proposals (id, match_tickers, universe) to ticker tags that exist; match_tickers go first."""
    wanted = F.when(F.size(F.coalesce("match_tickers", F.array().cast("array<string>"))) > 0, F.col("match_tickers")).otherwise(F.col("universe"))
    links = proposals.select("id", F.explode(wanted).alias("ticker")).select("id", F.concat(F.lit("ticker:"), "ticker").alias("tag")).distinct()
    return links.join(tags.select("tag").distinct(), "tag", "left_semi").select("id", "tag")


def ontology_triples(entities: DataFrame, relations: DataFrame) -> DataFrame:
    """(s, p, o): entities (name) become classes, relations (name, source, target) properties with domain and range."""
    from tickloom.functions.text import ontology_slug

    def triples(df: DataFrame, kind: str, more: list) -> DataFrame:
        df = df.where("name <> ''")
        s = ontology_slug(F.col("name"))
        made = [F.struct(F.lit("rdf:type").alias("p"), F.lit(kind).alias("o")), F.struct(F.lit("rdfs:label").alias("p"), F.col("name").alias("o")), *more]
        return df.select(s.alias("s"), F.explode(F.array(*made)).alias("t")).select("s", "t.p", "t.o").where("o IS NOT NULL")

    ends = [F.struct(F.lit(p).alias("p"), F.when(F.coalesce(F.col(c) != "", F.lit(False)), ontology_slug(F.col(c))).alias("o")) for p, c in (("rdfs:domain", "source"), ("rdfs:range", "target"))]
    return triples(entities, "owl:Class", []).unionByName(triples(relations, "owl:ObjectProperty", ends)).distinct()


def missing_models(wanted: DataFrame, pool: DataFrame) -> DataFrame:
    """(pool_name, model) of models to create: one of each pool name that the pool (pool_name) lacks."""
    return wanted.groupBy("pool_name").agg(F.min("model").alias("model")).join(pool.select("pool_name"), "pool_name", "left_anti")


def allow_list(*lists: DataFrame) -> DataFrame:
    """The names in any of the lists (name), each once, in order."""
    out = lists[0].select("name")
    for other in lists[1:]:
        out = out.unionByName(other.select("name"))
    return out.distinct().orderBy("name")
