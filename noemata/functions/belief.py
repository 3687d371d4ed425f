"""Belief masses over supports, refutes, uncertain and the whole frame (theta), as struct columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..fixed import IGNORANCE

NAMES = ("s", "r", "u", "theta")


def mass(s=0.0, r=0.0, u=0.0, theta=0.0) -> Column:
    """A mass function; divided by its total where that isn't 1."""
    parts = [x if isinstance(x, Column) else F.lit(float(x)) for x in (s, r, u, theta)]
    whole = parts[0] + parts[1] + parts[2] + parts[3]
    by = F.when(F.abs(whole - 1) > 1e-6, whole).otherwise(F.lit(1.0))
    return F.struct(*[(x / by).alias(n) for x, n in zip(parts, NAMES, strict=True)])


def from_polarity(polarity: Column, confidence: Column) -> Column:
    strength = F.least(confidence, F.lit(0.8))
    return F.when(polarity, mass(s=strength * 0.5, theta=1 - strength * 0.5)).otherwise(mass(r=strength * 0.7, u=strength * 0.1, theta=1 - strength * 0.8))


def from_alignment(s: Column, p: Column, o: Column, polarity: Column) -> Column:
    """s, p, o: how far the claim activates the fact's subject, predicate and object."""
    both, full = F.least(s, p), F.pow(s * p * o, F.lit(1.0) / 3)
    strong, rest = F.least(full * 0.8, F.lit(0.7)), F.greatest(1 - full * 0.8, F.lit(0.3))
    other = both * (1 - o)
    return (
        F.when((both > 0.1) & (o > 0.1) & polarity, mass(s=strong, theta=rest))
        .when((both > 0.1) & (o > 0.1), mass(r=strong, theta=rest))
        .when(both > 0.1, mass(s=other * 0.05, r=F.least(other * 0.6, F.lit(0.5)), theta=F.greatest(1 - other * 0.65, F.lit(0.3))))
        .when((s > 0.1) & polarity, mass(s=s * 0.15, theta=1 - s * 0.15))
        .when(s > 0.1, mass(r=s * 0.15, theta=1 - s * 0.15))
        .otherwise(mass(theta=1.0))
    )


def from_distance(s: Column, p: Column, o: Column, competing: Column) -> Column:
    """competing: the most that the claim activates another anchor of the object's type (over 0.1); null without any."""
    delta = competing - o
    return (
        F.when((s < 0.1) | (p < 0.1) | competing.isNull(), mass(theta=1.0))
        .when(competing > o + 0.1, mass(r=F.least(delta * 0.4, F.lit(0.35)), theta=F.greatest(1 - delta * 0.4, F.lit(0.65))))
        .when(o > competing, mass(s=F.least(o * 0.2, F.lit(0.2)), theta=F.greatest(1 - o * 0.2, F.lit(0.8))))
        .otherwise(mass(theta=1.0))
    )


def from_confidence(confidence: Column) -> Column:
    u = F.when(confidence < 0.05, F.lit(0.3)).otherwise(F.greatest(F.lit(0.05), 0.3 * (1 - confidence)))
    return mass(u=u, theta=1 - u)


def from_logits(supports: Column, uncertain: Column, refutes: Column) -> Column:
    """Masses of a classifier's three logits: their softmax, less the ignorance that an undecided one leaves."""
    most = F.greatest(supports, uncertain, refutes)
    powers = [F.exp(x - most) for x in (supports, refutes, uncertain)]
    whole = powers[0] + powers[1] + powers[2]
    theta = F.greatest(F.lit(0.0), IGNORANCE * (1 - F.greatest(*powers) / whole))
    return F.struct(*[(p / whole * (1 - theta)).alias(n) for p, n in zip(powers, NAMES[:3], strict=True)], theta.alias("theta"))


def combined(qs: Column, qr: Column, qu: Column, t: Column) -> Column:
    """Dempster's rule in closed form: q the products of (mass + theta), t that of theta. Total conflict leaves ignorance."""
    whole = qs + qr + qu - 2 * t
    return F.when(whole > 0, F.struct(((qs - t) / whole).alias("s"), ((qr - t) / whole).alias("r"), ((qu - t) / whole).alias("u"), (t / whole).alias("theta"))).otherwise(mass(theta=1.0))


def combine(*masses: Column) -> Column:
    """Combination of the masses of one row. A fold, so that each mass is an expression once and not once for each of its uses."""
    one = F.struct(*[F.lit(1.0).alias(n) for n in ("qs", "qr", "qu", "t")])

    def times(acc: Column, m: Column) -> Column:
        products = [acc[q] * (m[n] + m["theta"]) for q, n in (("qs", "s"), ("qr", "r"), ("qu", "u"))]
        return F.struct(*[p.alias(q) for p, q in zip([*products, acc["t"] * m["theta"]], ("qs", "qr", "qu", "t"), strict=True)])

    return F.aggregate(F.array(*masses), one, times, lambda acc: combined(acc["qs"], acc["qr"], acc["qu"], acc["t"]))


def combine_rows(m: Column) -> Column:
    """Aggregate: combination of the masses of a group's rows, in any order."""
    return combined(F.product(m["s"] + m["theta"]), F.product(m["r"] + m["theta"]), F.product(m["u"] + m["theta"]), F.product(m["theta"]))


def inverted(m: Column) -> Column:
    return F.struct(m["r"].alias("s"), m["s"].alias("r"), m["u"].alias("u"), m["theta"].alias("theta"))


def pignistic(m: Column) -> Column:
    """Theta dealt to the others in proportion; in thirds where they are 0."""
    focal = m["s"] + m["r"] + m["u"]
    return F.struct(*[F.when(focal > 0, m[n] + m["theta"] * m[n] / F.when(focal > 0, focal)).otherwise(m["theta"] / 3).alias(n) for n in ("s", "r", "u")])


def plausibility(m: Column, name: str) -> Column:
    return 1 - sum((m[n] for n in ("s", "r", "u") if n != name), F.lit(0.0))


def entropy(m: Column) -> Column:
    return sum((F.when(m[n] > 0, -m[n] * F.log2(m[n])).otherwise(0.0) for n in NAMES), F.lit(0.0))


def ucb(mean: Column, parent_visits: Column, visits: Column, exploration: float) -> Column:
    return F.when(visits > 0, mean + exploration * F.sqrt(2 * F.log(parent_visits) / visits)).otherwise(F.lit(float("inf")))
