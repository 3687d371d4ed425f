"""Upserts, filters, counts and maintenance of facts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY = ["subject", "predicate", "object", "polarity"]


def upsert_fold(new: DataFrame, existing: DataFrame | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row for each (subject, predicate, object, polarity): the first row's columns to keep, the last one's timestamp, how often it was seen, and the mean confidence.

    new: KEY, confidence, timestamp, seq (order of arrival). existing: the same with reinforcement_count; it comes before
    new and weighs its count. The fold is associative, so batches may be folded in turn or at once.
    """
    rows = new.select(*KEY, "confidence", "timestamp", "seq", *keep, F.lit(1).cast("long").alias("n"), F.lit(1).alias("age"))
    if existing is not None:
        rows = rows.unionByName(existing.select(*KEY, "confidence", "timestamp", "seq", *keep, F.col("reinforcement_count").alias("n"), F.lit(0).alias("age")))
    order = F.struct("age", "seq")
    return rows.groupBy(*KEY).agg(
        F.sum("n").alias("reinforcement_count"),
        (F.sum(F.col("confidence") * F.col("n")) / F.sum("n")).alias("confidence"),
        F.max_by("timestamp", order).alias("timestamp"),
        F.max_by("seq", order).alias("seq"),
        *[F.min_by(c, order).alias(c) for c in keep],
    )


def latest(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Replacing upsert: the last row of each key."""
    last = Window.partitionBy(*keys).orderBy(F.desc(order))
    return rows.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n")


def matching(facts: DataFrame, subject: str | None = None, predicate: str | None = None, object: str | None = None, min_confidence: float = 0.0, **more) -> DataFrame:
    """Facts of these values; what is None or empty doesn't filter."""
    wanted = {"subject": subject, "predicate": predicate, "object": object} | more
    conditions = [F.col(k) == v for k, v in wanted.items() if v] + [F.col("confidence") >= min_confidence]
    return facts.where(reduce(Column.__and__, conditions))


def live(facts: DataFrame, kind: str | None = "observed", include_imagined: bool = False) -> DataFrame:
    """Facts that aren't pruned, of the kind asked for."""
    found = facts.where(~F.coalesce(F.col("pruned"), F.lit(False)))
    return found if include_imagined or kind is None else found.where(F.col("kind") == kind)


def by_anchor(facts: DataFrame, key: str, roles: tuple[str, ...] = ("subject", "predicate", "object")) -> DataFrame:
    """A row for each fact and role: anchor, role, and the fact's columns. Joins on anchor are then equi-joins, where a disjunction would be a nested loop."""
    pairs = F.array(*[F.struct(F.lit(r).alias("role"), F.col(r).alias("anchor")) for r in roles])
    return facts.select("*", F.inline(pairs))


def for_symbol(facts: DataFrame, symbol: str, relation: str | None = None, limit: int = 50) -> DataFrame:
    found = facts.where((F.col("subject") == symbol) | (F.col("object") == symbol))
    found = found.where(F.col("predicate") == relation) if relation else found
    return found.orderBy(F.desc("reinforcement_count"), *KEY).limit(limit)


def first_tier(facts: DataFrame, text: str) -> DataFrame:
    """Facts with the text as subject; without any, as predicate; without any, as object."""
    tier = F.when(F.col("subject") == text, 1).when(F.col("predicate") == text, 2).when(F.col("object") == text, 3)
    found = facts.withColumn("tier", tier).where("tier IS NOT NULL")
    return found.join(F.broadcast(found.agg(F.min("tier").alias("tier"))), "tier")


def top_anchors(facts: DataFrame, k: int = 10) -> DataFrame:
    anchors = facts.select(F.explode(F.array("subject", "object")).alias("anchor"))
    return anchors.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "anchor").limit(k)


def anchors_of(facts: DataFrame) -> DataFrame:
    return facts.select(F.explode(F.array("subject", "object")).alias("anchor")).distinct()


def pruned(facts: DataFrame, importance: str, below: float) -> DataFrame:
    """Facts with the soft deletion of those under the threshold."""
    return facts.withColumn("pruned", F.coalesce(F.col("pruned"), F.lit(False)) | (F.col(importance) < below))


def probe(new: DataFrame, existing: DataFrame) -> DataFrame:
    """new with found: added where no fact of its triple exists, reinforced where one of its polarity does, else contradicted."""
    known = existing.groupBy("subject", "predicate", "object").agg(F.collect_set("polarity").alias("_known"))
    found = F.when(F.col("_known").isNull(), "added").when(F.array_contains("_known", F.col("polarity")), "reinforced").otherwise("contradicted")
    return new.join(known, ["subject", "predicate", "object"], "left").withColumn("found", found).drop("_known")
