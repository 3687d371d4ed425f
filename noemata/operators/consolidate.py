"""Temporal chains, constraints and decay."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..fixed import DECAY_DAYS, DECAY_FACTOR
from ..functions import scores


def next_edges(facts: DataFrame, key: str = "seq", buckets: int = 1) -> DataFrame:
    """source, target, days, weight: each fact leads to the next one that shares its subject or object.

    buckets over 1 split each anchor's facts by time (hot anchors), with what precedes each bucket stitched on.
    """
    anchored = facts.select(F.col(key).alias("source"), "timestamp", F.explode(F.array_distinct(F.array("subject", "object"))).alias("anchor"))
    linked = _followed(anchored, ["anchor"], buckets)
    days = scores.days_between(F.col("timestamp"), F.col("next_time"))
    return linked.select("source", F.col("next_source").alias("target"), days.alias("days"), scores.edge_weight(days).alias("weight")).dropDuplicates(["source", "target"])


def _followed(rows: DataFrame, keys: list[str], buckets: int, carry: tuple[str, ...] = ()) -> DataFrame:
    """Rows with the next row of their keys by (timestamp, source): next_source, next_time."""
    if buckets <= 1:
        by = Window.partitionBy(*keys).orderBy("timestamp", "source")
        out = rows.withColumn("next_source", F.lead("source").over(by)).withColumn("next_time", F.lead("timestamp").over(by))
        return out.where("next_source IS NOT NULL")
    low, high = rows.agg(F.min(F.unix_micros("timestamp")), F.max(F.unix_micros("timestamp"))).first()
    width = max(1, -(-((high or 0) - (low or 0) + 1) // buckets))
    cut = rows.withColumn("_b", F.floor((F.unix_micros("timestamp") - F.lit(low or 0)) / F.lit(width)))
    by = Window.partitionBy(*keys, "_b").orderBy("timestamp", "source")
    inner = cut.withColumn("next_source", F.lead("source").over(by)).withColumn("next_time", F.lead("timestamp").over(by))
    firsts = cut.groupBy(*keys, "_b").agg(F.min(F.struct("timestamp", "source")).alias("_first"))
    over = Window.partitionBy(*keys).orderBy("_b")
    heads = firsts.withColumn("_next", F.lead("_first").over(over)).select(*keys, "_b", "_next")
    joined = inner.join(heads, [*keys, "_b"])
    ended = F.col("next_source").isNull()
    joined = joined.withColumn("next_time", F.when(ended, F.col("_next.timestamp")).otherwise(F.col("next_time"))).withColumn("next_source", F.when(ended, F.col("_next.source")).otherwise(F.col("next_source")))
    return joined.where("next_source IS NOT NULL").drop("_b", "_next")


def next_edges_by_role(facts: DataFrame, key: str = "seq", buckets: int = 1, of: tuple[str, ...] = ("subject", "predicate", "object")) -> DataFrame:
    """source, target, anchor, anchor_role (the source's), gap_days: chains over subject, predicate and object, or over some of them. A pair that shares several anchors has an edge for each."""
    roles = F.array(*[F.struct(F.lit(r).alias("anchor_role"), F.col(r).alias("anchor")) for r in of])
    anchored = facts.where("timestamp IS NOT NULL").select(F.col(key).alias("source"), "timestamp", F.inline(roles))
    linked = _followed(anchored, ["anchor"], buckets, ("anchor_role",)).where("source <> next_source")
    return linked.select("source", F.col("next_source").alias("target"), "anchor", "anchor_role", F.abs(F.datediff("next_time", "timestamp")).alias("gap_days"), F.lit(1.0).alias("weight"))


def only_new(edges: DataFrame, existing: DataFrame) -> DataFrame:
    """Edges whose (source, target) isn't there yet: additive maintenance."""
    return edges.join(existing.select("source", "target"), ["source", "target"], "left_anti")


def constraints_by_evidence(facts: DataFrame) -> DataFrame:
    """Per triple, whatever the polarity: greatest count, mean confidence, and persistence as a chance."""
    grouped = facts.groupBy("subject", "predicate", "object").agg(F.max("reinforcement_count").alias("evidence"), F.avg("confidence").alias("strength"))
    return grouped.withColumn("persistence", scores.persistence(F.col("evidence")))


def constraints_by_documents(facts: DataFrame, document: str = "doc_id") -> DataFrame:
    """Per triple: facts, documents, mean confidence, months, and the score over them."""
    grouped = facts.groupBy("subject", "predicate", "object").agg(
        F.count(F.lit(1)).alias("evidence"), F.countDistinct(document).alias("doc_count"), F.avg("confidence").alias("strength"), F.countDistinct(F.date_format("timestamp", "yyyy-MM")).alias("persistence")
    )
    return grouped.withColumn("score", scores.constraint_score(F.col("evidence"), F.col("doc_count"), F.col("strength"), F.col("persistence")))


def reinforced(new: DataFrame, existing: DataFrame) -> DataFrame:
    """existing (with reinforcement_count and the parts of importance) after new facts of the same triple: count, mean confidence and importance."""
    added = new.groupBy("subject", "predicate", "object").agg(F.count(F.lit(1)).alias("_n"), F.sum("confidence").alias("_c"), F.max("timestamp").alias("_t"))
    joined = existing.join(added, ["subject", "predicate", "object"], "left")
    n = F.coalesce(F.col("_n"), F.lit(0))
    joined = joined.withColumn("confidence", (F.col("confidence") * F.col("reinforcement_count") + F.coalesce(F.col("_c"), F.lit(0.0))) / (F.col("reinforcement_count") + n))
    joined = joined.withColumn("reinforcement_count", F.col("reinforcement_count") + n).withColumn("last_reinforced", F.coalesce("_t", "timestamp"))
    return joined.drop("_n", "_c", "_t")


def decay(facts: DataFrame, value: str, now: Column, factor: float = DECAY_FACTOR, after: int = DECAY_DAYS) -> DataFrame:
    return facts.withColumn(f"{value}_now", scores.decayed(F.col(value), F.col("timestamp"), now, factor, after))
