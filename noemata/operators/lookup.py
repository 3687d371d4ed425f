"""Point lookups, edge and constraint filters, and what a lookup answers with."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def by_id(rows: DataFrame, column: str, *ids, with_pruned: bool = True) -> DataFrame:
    """Rows of these ids: a filter that reaches the scan. Without pruned ones if asked."""
    found = rows.where(F.col(column).isin(*ids))
    return found if with_pruned else found.where(~F.coalesce(F.col("pruned"), F.lit(False)))


def edges(rows: DataFrame, source: str | None = None, target: str | None = None, edge_type: str | None = None, limit: int | None = None) -> DataFrame:
    """Edges out of a source, into a target, or of a type; any of these together. A limit keeps the first by source, target and type."""
    for name, value in (("source", source), ("target", target), ("edge_type", edge_type)):
        if value is not None:
            rows = rows.where(F.col(name) == value)
    return rows if limit is None else rows.orderBy("source", "target", "edge_type").limit(limit)


def constraints(rows: DataFrame, subject: str | None = None, predicate: str | None = None, object: str | None = None, min_score: float = 0.0, limit: int = 100) -> DataFrame:
    """The best constraints of these values, best first."""
    for name, value in (("subject", subject), ("predicate", predicate), ("object", object)):
        if value is not None:
            rows = rows.where(F.col(name) == value)
    return rows.where(F.col("score") >= min_score).orderBy(F.desc("score"), "subject", "predicate", "object").limit(limit)


def chained(hits: DataFrame, chains: DataFrame, facts: DataFrame, key: str = "seq") -> DataFrame:
    """Facts that chains (node) lead to and that aren't among the hits: a semi join for the nodes and an anti join for the hits."""
    nodes = chains.select(F.col("node").alias(key)).distinct().join(hits.select(key), key, "left_anti")
    return facts.join(nodes, key, "left_semi")


def with_parent(rows: DataFrame, parent: Column) -> DataFrame:
    """rows with one more parent, none twice."""
    return rows.withColumn("parent_fact_ids", F.array_union(F.coalesce("parent_fact_ids", F.array().cast("array<string>")), F.array(parent)))


def grounding_answer(g: Column) -> Column:
    """A grounding as JSON: only the members of its kind."""
    ast = F.to_json(F.struct(F.lit("ast").alias("type"), *[g[n].alias(n) for n in ("file_path", "line_number", "node_type")]), {"ignoreNullFields": "false"})
    text = F.to_json(F.struct(F.lit("text").alias("type"), *[g[n].alias(n) for n in ("doc_id", "sent_id", "char_start", "char_end", "sentence_text")]), {"ignoreNullFields": "false"})
    return F.when(g["grounding_type"] == "ast", ast).otherwise(text)


def answers(hits: DataFrame, around: DataFrame | None = None, key: str = "fact_id") -> DataFrame:
    """subject, predicate, object, polarity, confidence, score (null without one), grounding (JSON), context: the hits as a search answers.

    around: hit and the columns of a fact beside it.
    """
    shown = ["subject", "predicate", "object", "polarity"]
    score = F.col("score") if "score" in hits.columns else F.lit(None).cast("double")
    out = hits.select(F.col(key).alias("hit"), *shown, "confidence", score.alias("score"), grounding_answer(F.col("grounding")).alias("grounding"))
    kind = "array<struct<subject: string, predicate: string, object: string, polarity: boolean, grounding: string>>"
    if around is None:
        return out.withColumn("context", F.array().cast(kind)).drop("hit")
    beside = around.groupBy("hit").agg(F.sort_array(F.collect_list(F.struct(*shown, grounding_answer(F.col("grounding")).alias("grounding")))).alias("context"))
    return out.join(beside, "hit", "left").withColumn("context", F.coalesce(F.col("context").cast(kind), F.array().cast(kind))).drop("hit")
