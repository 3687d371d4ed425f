"""Ranking facts for a query, with personas, hierarchy, context and chains."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..fixed import CONTRARY_GAIN, DESCENDANT_ACTIVATION, RANK_WEIGHTS
from ..functions import scores
from .facts import by_anchor


def expanded(query: DataFrame, closure: DataFrame) -> DataFrame:
    """query (anchor, activation) with the descendants of its anchors, which have a fixed activation unless they are in the query."""
    below = query.join(closure, query["anchor"] == closure["ancestor"]).select(F.col("descendant").alias("anchor"), F.when(F.col("depth") == 0, F.col("activation")).otherwise(F.lit(DESCENDANT_ACTIVATION)).alias("activation"), F.col("depth"))
    own = query.select("anchor", "activation", F.lit(0).alias("depth"))
    return own.unionByName(below).groupBy("anchor").agg(F.min_by("activation", "depth").alias("activation"))


def relevance(facts: DataFrame, query: DataFrame, valences: DataFrame | None = None, persona: str | None = None) -> DataFrame:
    """facts whose subject or object the query activates, with valence and score. Two left joins with the small query rather than a disjunctive one."""
    s, o = (F.broadcast(query.select(F.col("anchor").alias(c), F.col("activation").alias(f"_{c}"))) for c in ("subject", "object"))
    found = facts.join(s, "subject", "left").join(o, "object", "left").where("_subject IS NOT NULL OR _object IS NOT NULL")
    if valences is not None and persona:
        found = found.join(F.broadcast(valences.where(F.col("persona") == persona).select("predicate", "valence")), "predicate", "left")
    else:
        found = found.withColumn("valence", F.lit(0.0))
    found = found.withColumn("valence", F.coalesce("valence", F.lit(0.0)))
    overlap = F.coalesce("_subject", F.lit(0.0)) + F.coalesce("_object", F.lit(0.0))
    score = overlap / 2 * F.col("confidence") * F.col("reinforcement") * (1 + F.col("valence"))
    return found.withColumn("score", score).drop("_subject", "_object")


def ranked(scored: DataFrame, limit: int, key: str = "seq") -> DataFrame:
    """The best row of each triple, best first."""
    by = Window.partitionBy("subject", "predicate", "object").orderBy(F.desc("score"), key)
    return scored.withColumn("_n", F.row_number().over(by)).where("_n = 1").drop("_n").orderBy(F.desc("score"), key).limit(limit)


def context(hits: DataFrame, edges: DataFrame, key: str = "seq", both: bool = False) -> DataFrame:
    """hit, other, weight: what the edges of a hit lead to; with both, also what leads to it."""
    found = hits.select(F.col(key).alias("hit")).join(edges, F.col("hit") == F.col("source")).select("hit", F.col("target").alias("other"), "weight")
    if both:
        back = hits.select(F.col(key).alias("hit")).join(edges, F.col("hit") == F.col("target")).select("hit", F.col("source").alias("other"), "weight")
        found = found.unionByName(back)
    return found


def valence_of(predicate: Column, confidence: Column, polarity: Column, positive: Column, negative: Column) -> Column:
    """Valence of a fact for a persona's predicates, from -1 to 1; negation turns it."""
    strong = 0.5 + 0.5 * confidence
    value = F.when(F.array_contains(positive, predicate), strong).when(F.array_contains(negative, predicate), -strong).otherwise(0.1 * confidence)
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.when(polarity, value).otherwise(-value)))


def salience_of(types: list[Column], focus: Column) -> Column:
    return F.least(F.lit(1.0), sum((F.when(F.array_contains(focus, t), 0.33).otherwise(0.0) for t in types), F.lit(0.0)))


def urgency_of(tense: Column, confidence: Column) -> Column:
    return F.least(F.lit(1.0), F.when(tense.isin("future", "conditional"), 0.5 + 0.5 * confidence).when(tense == "present_continuous", 0.3 + 0.3 * confidence).otherwise(0.0))


def rank_score(importance: Column, salience: Column, recency: Column, valence: Column, contrary: bool = False, polarity: Column | None = None) -> Column:
    a, b, c, d = RANK_WEIGHTS
    out = a * importance + b * salience + c * recency + d * F.abs(valence)
    return out + F.when(~polarity, CONTRARY_GAIN).otherwise(0.0) if contrary else out


def persona_scores(query: DataFrame, types: DataFrame, focus: DataFrame) -> DataFrame:
    """persona, score: activation of the anchors whose type is in the persona's focus."""
    typed = query.join(F.broadcast(types.select(F.col("key").alias("anchor"), "type")), "anchor")
    spread = focus.select("persona", F.explode("types").alias("type"))
    return typed.join(F.broadcast(spread), "type").groupBy("persona").agg(F.sum("activation").alias("score"))


def fetched(facts: DataFrame, wanted: DataFrame, k: int, order: list) -> DataFrame:
    """For each (role, anchor) wanted the first k facts with that anchor in that role."""
    pairs = by_anchor(facts, "seq").join(F.broadcast(wanted), ["role", "anchor"])
    by = Window.partitionBy("role", "anchor").orderBy(*order)
    return pairs.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)


def constraint_lookup(constraints: DataFrame, wanted: DataFrame, k: int = 10) -> DataFrame:
    pairs = by_anchor(constraints, "subject").join(F.broadcast(wanted), ["role", "anchor"])
    by = Window.partitionBy("role", "anchor").orderBy(F.desc("score"), "subject", "predicate", "object")
    found = pairs.withColumn("_n", F.row_number().over(by)).where(F.col("_n") <= k)
    return found.select(*constraints.columns).dropDuplicates(["subject", "predicate", "object"])


def chains(starts: DataFrame, edges: DataFrame, depth: int = 10) -> DataFrame:
    """start, anchor, step, node: along the edges of one anchor from each start (source, anchor). Edges of an anchor form a path, so each step is one row; a node that comes again ends it.

    A step is a join of the walks, which hold their path, with the edges of their last node. The edges are dealt out once for all
    steps and merged: broadcasts of all steps would meet in the memory of one task. Where a node has several, each goes on by a walk of its own, and all but the first leave out what they share (since).
    """
    links = edges.groupBy(F.col("source").alias("_source"), F.col("anchor").alias("_anchor")).agg(F.collect_list("target").alias("_targets")).hint("merge")
    walks = starts.select(F.col("source").alias("start"), "anchor", F.lit(0).alias("since"), F.array("source").alias("path"))
    for step in range(1, depth + 1):
        last = F.when(F.size("path") == step, F.get("path", F.lit(step - 1)))
        met = walks.withColumn("_last", last).join(links, (F.col("_last") == F.col("_source")) & (F.col("anchor") == F.col("_anchor")), "left")
        further = F.filter(F.coalesce("_targets", F.array()), lambda t: ~F.array_contains("path", t))
        met = met.select("start", "anchor", "since", "path", F.posexplode_outer(further).alias("_place", "_next"))
        onward = F.when(F.col("_next").isNotNull(), F.concat("path", F.array("_next"))).otherwise(F.col("path"))
        walks = met.select("start", "anchor", F.when(F.col("_place") > 0, step).otherwise(F.col("since")).alias("since"), onward.alias("path"))
    return walks.select("start", "anchor", "since", F.posexplode("path").alias("step", "node")).where("step >= since").select("start", "anchor", "step", "node")


def timeline(hits: DataFrame, key: str = "seq") -> DataFrame:
    return hits.withColumn("place", F.row_number().over(Window.orderBy("timestamp", key)))  # hits are few: a cut list


def search(facts: DataFrame, query: DataFrame, types: DataFrame, focus: DataFrame, persona: str, now: Column, top_k: int = 50, contrary: bool = False) -> DataFrame:
    """facts (with importance_score, tense) that the query activates in the role of each anchor's type, with valence, salience, urgency, recency and rank_score."""
    role = F.when(F.col("type") == "actor", "subject").when(F.col("type") == "relation", "predicate").otherwise("object")
    wanted = query.join(F.broadcast(types.select(F.col("key").alias("anchor"), "type")), "anchor").select("anchor", role.alias("role"))
    found = fetched(facts, wanted, top_k, [F.desc("importance_score"), "seq"]).drop("role", "anchor", "rank").dropDuplicates(["seq"])
    return rescored(found, types, focus, persona, now, contrary).orderBy(F.desc("rank_score"), "seq").limit(top_k)


def rescored(found: DataFrame, types: DataFrame, focus: DataFrame, persona: str, now: Column, contrary: bool = False) -> DataFrame:
    """found with valence, salience, urgency, recency and rank_score."""
    kinds = [F.broadcast(types.select(F.col("key").alias(c), F.col("type").alias(f"_{c}"))) for c in ("subject", "predicate", "object")]
    for k, c in zip(kinds, ("subject", "predicate", "object"), strict=True):
        found = found.join(k, c, "left")
    found = found.join(F.broadcast(focus.where(F.col("persona") == persona).select("positive", "negative", F.col("types").alias("_focus"))))
    valence = valence_of(F.col("predicate"), F.col("confidence"), F.col("polarity"), F.col("positive"), F.col("negative"))
    found = found.withColumn("valence", -valence if contrary else valence).withColumn("salience", salience_of([F.col("_subject"), F.col("_predicate"), F.col("_object")], F.col("_focus")))
    found = found.withColumn("urgency", urgency_of(F.col("tense"), F.col("confidence"))).withColumn("recency", scores.recency(F.col("timestamp"), now))
    ranked_ = found.withColumn("rank_score", rank_score(F.col("importance_score"), F.col("salience"), F.col("recency"), F.col("valence"), contrary, F.col("polarity")))
    return ranked_.drop("positive", "negative", "_focus", "_subject", "_predicate", "_object")
