"""Scores and dates as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..fixed import IMPORTANCE_WEIGHTS, PERSISTENCE_DECAY, REINFORCEMENT_WEIGHT, SCORE_NORMS, SCORE_WEIGHT


def clamp(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def confidence_of_least(activation: Column) -> Column:
    return clamp(F.tanh(activation / 2))


def geometric(*xs: Column) -> Column:
    return F.pow(reduce(Column.__mul__, xs), F.lit(1.0) / len(xs))


def composite(importance: Column) -> Column:
    names = ("activation", "coherence", "specificity", "novelty", "reinforcement")
    return reduce(Column.__add__, [importance[n] for n in names]) / len(names)


def importance(activation: Column, coherence: Column, specificity: Column, novelty: Column, reinforced: Column | None = None) -> Column:
    terms = [F.lit(w) * x for w, x in zip(IMPORTANCE_WEIGHTS, (activation, coherence, specificity, novelty), strict=True)]
    return reduce(Column.__add__, terms) + (F.lit(REINFORCEMENT_WEIGHT) * F.log1p(reinforced) if reinforced is not None else F.lit(0.0))


def persistence(evidence: Column, decay: float = PERSISTENCE_DECAY) -> Column:
    return 1 - F.pow(F.lit(decay), evidence)


def constraint_score(evidence: Column, documents: Column, strength: Column, periods: Column) -> Column:
    a, b, c = (float(n) for n in SCORE_NORMS)
    return SCORE_WEIGHT * (F.log1p(evidence) / F.log1p(F.lit(a)) + F.log1p(documents) / F.log1p(F.lit(b)) + strength + F.log1p(periods) / F.log1p(F.lit(c)))


def days_between(a: Column, b: Column) -> Column:
    """Days from a to b, with fractions."""
    return (F.unix_micros(b.cast("timestamp")) - F.unix_micros(a.cast("timestamp"))) / F.lit(8.64e10)


def edge_weight(days: Column) -> Column:
    return 1 / (1 + days)


def decayed(value: Column, ts: Column, now: Column, factor: float, after: int) -> Column:
    """Exponential decay of what is older than so many days. Derived from the stored base, so it may be asked again and again."""
    days = days_between(ts, now)
    return F.when(days > after, value * F.pow(F.lit(factor), days)).otherwise(value)


def decayed_linear(value: Column, ts: Column, now: Column, rate: Column) -> Column:
    return F.greatest(F.lit(0.0), value - rate * F.greatest(F.lit(0), F.datediff(now, ts)))


def recency(ts: Column, now: Column) -> Column:
    """1 for today, down to 0.1; 0.5 where the date is unknown."""
    days = F.greatest(F.lit(0), F.datediff(now, ts))
    return F.coalesce(F.greatest(F.lit(0.1), F.exp(-days / F.lit(365.0))), F.lit(0.5))
