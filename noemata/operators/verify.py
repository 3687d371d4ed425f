"""Verification of many claims at once: masses for each fact and claim, fused per fact, then over the decisive facts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..fixed import DECISIVE, EVIDENCE, REFUTES_AT, RELEVANCE, SUPPORTS_AT
from ..functions import belief


def evidence(claims: DataFrame, facts: DataFrame, key: str = "seq", most: int = EVIDENCE) -> DataFrame:
    """claim_id with the facts (at most so many, by importance) that share its subject or predicate anchors, and how far each role is activated.

    claims: claim_id, anchor, activation.
    """
    whole = F.struct(*[F.col(c) for c in facts.columns])
    roles = F.array(*[F.struct(F.lit(r).alias("role"), F.col(r).alias("anchor")) for r in ("subject", "predicate")])
    # The best facts of a claim are among the best of its anchors, so an anchor's other facts needn't meet a claim.
    by = Window.partitionBy("role", "anchor").orderBy(F.desc("importance_score"), key)
    best = facts.select(whole.alias("_f"), key, "importance_score", F.inline(roles)).withColumn("_n", F.row_number().over(by)).where(F.col("_n") <= most)
    touched = best.select("anchor", "_f", key).dropDuplicates(["anchor", key]).drop(key).join(claims.select("claim_id", "anchor"), "anchor").select("claim_id", F.col(f"_f.{key}").alias(key), "_f").dropDuplicates(["claim_id", key])
    by = Window.partitionBy("claim_id").orderBy(F.desc("_f.importance_score"), key)
    rows = touched.withColumn("place", F.row_number().over(by)).where(F.col("place") <= most).select("claim_id", "place", "_f.*")
    for role, name in (("subject", "s"), ("predicate", "p"), ("object", "o")):
        told = claims.select("claim_id", F.col("anchor").alias(role), F.col("activation").alias(name))
        rows = rows.join(told, ["claim_id", role], "left").withColumn(name, F.coalesce(F.col(name), F.lit(0.0)))
    return rows


def competing(rows: DataFrame, claims: DataFrame, types: DataFrame) -> DataFrame:
    """rows with competing: the most that the claim activates another anchor of the object's type."""
    kind = lambda c: F.coalesce(F.col(c), F.lit("feature"))
    typed = claims.join(F.broadcast(types.select(F.col("key").alias("anchor"), "type")), "anchor", "left").where("activation > 0.1")
    best = Window.partitionBy("claim_id", "type").orderBy(F.desc("activation"), "anchor")
    two = typed.withColumn("type", kind("type")).withColumn("_n", F.row_number().over(best)).where("_n <= 2")
    tops = two.groupBy("claim_id", "type").agg(F.max(F.when(F.col("_n") == 1, F.struct("anchor", "activation"))).alias("_first"), F.max(F.when(F.col("_n") == 2, F.col("activation"))).alias("_second"))
    named = rows.join(F.broadcast(types.select(F.col("key").alias("object"), "type")), "object", "left").withColumn("type", kind("type"))
    joined = named.join(F.broadcast(tops), ["claim_id", "type"], "left")
    return joined.withColumn("competing", F.when(F.col("_first.anchor") != F.col("object"), F.col("_first.activation")).otherwise(F.col("_second"))).drop("_first", "_second", "type")


def fused(rows: DataFrame, contrary: bool = False) -> DataFrame:
    """rows with m: the four sources combined; ignorance where the claim is about something else."""
    s, p, o = F.col("s"), F.col("p"), F.col("o")
    m = belief.combine(
        belief.from_polarity(F.col("polarity"), F.col("confidence")),
        belief.from_alignment(s, p, o, F.col("polarity")),
        belief.from_distance(s, p, o, F.col("competing")),
        belief.from_confidence(F.col("confidence")),
    )
    return rows.withColumn("m", F.when(F.greatest(s, p) < RELEVANCE, belief.mass(theta=1.0)).otherwise(belief.inverted(m) if contrary else m))


def verdicts(rows: DataFrame, key: str = "seq") -> DataFrame:
    """claim_id, belief in each outcome, label, n_evidence: the facts that leave the least open are fused."""
    by = Window.partitionBy("claim_id").orderBy("m.theta", "place")
    ranked = rows.withColumn("_d", F.row_number().over(by))
    out = ranked.groupBy("claim_id").agg(F.count(F.lit(1)).alias("n_evidence"), F.max("_d").alias("_"), *[F.product(F.when(F.col("_d") <= DECISIVE, f).otherwise(F.lit(1.0))).alias(n) for n, f in (("_s", F.col("m.s") + F.col("m.theta")), ("_r", F.col("m.r") + F.col("m.theta")), ("_u", F.col("m.u") + F.col("m.theta")), ("_t", F.col("m.theta")))])
    out = out.withColumn("m", belief.combined(F.col("_s"), F.col("_r"), F.col("_u"), F.col("_t")))
    out = out.withColumn("pig", belief.pignistic(F.col("m")))
    s, r = F.col("pig.s"), F.col("pig.r")
    label = F.when((r > REFUTES_AT) & (r > s), "REFUTES").when((s > SUPPORTS_AT) & (s > r), "SUPPORTS").otherwise("NOT ENOUGH INFO")
    return out.select("claim_id", s.alias("belief_supports"), r.alias("belief_refutes"), F.col("pig.u").alias("belief_uncertain"), belief.plausibility(F.col("m"), "s").alias("plausibility_supports"), belief.plausibility(F.col("m"), "r").alias("plausibility_refutes"), "n_evidence", label.alias("label"))


def verify(claims: DataFrame, facts: DataFrame, types: DataFrame, key: str = "seq", contrary: bool = False) -> DataFrame:
    """Verdicts of the claims (claim_id, anchor, activation). Of a claim that no fact touches nothing is known: it lacks information."""
    told = verdicts(fused(competing(evidence(claims, facts, key), claims, types), contrary), key)
    nothing = belief.pignistic(belief.mass(theta=1.0))
    filled = {"belief_supports": nothing["s"], "belief_refutes": nothing["r"], "belief_uncertain": nothing["u"], "plausibility_supports": F.lit(1.0), "plausibility_refutes": F.lit(1.0), "n_evidence": F.lit(0), "label": F.lit("NOT ENOUGH INFO")}
    rows = claims.select("claim_id").distinct().join(told, "claim_id", "left")
    return rows.select("claim_id", *[F.coalesce(F.col(c), filled[c]).alias(c) for c in told.columns if c != "claim_id"])
