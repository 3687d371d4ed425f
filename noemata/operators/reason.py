"""Bounded tree search for evidence around a claim.

The tree is small (iterations times branching) and lives on the driver; facts and edges stay in DataFrames. The claim's
neighbourhood (facts of its anchors, and what their edges lead to, depth times) is cut out once with joins; the search then
walks over these few rows, rather than starting a job for each node.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..fixed import DECISIVE, REFUTES_AT, SEARCH, SUPPORTS_AT
from .facts import by_anchor


def neighbourhood(facts: DataFrame, claim: DataFrame, per_anchor: int) -> DataFrame:
    """The first facts (by importance) of each anchor of the claim, in any role: anchor, seq, place and the fact."""
    by = Window.partitionBy("anchor").orderBy(F.desc("importance_score"), "seq")
    pairs = by_anchor(facts, "seq").drop("role").join(F.broadcast(claim), "anchor").dropDuplicates(["anchor", "seq"])
    return pairs.withColumn("place", F.row_number().over(by)).where(F.col("place") <= per_anchor)


def _fold(masses: list[tuple[float, ...]]) -> tuple[float, ...]:
    """Dempster's rule in closed form."""
    s, r, u, t = (math.prod(m[k] + (m[3] if k < 3 else 0) for m in masses) for k in range(4))
    whole = s + r + u - 2 * t
    return ((s - t) / whole, (r - t) / whole, (u - t) / whole, t / whole) if masses and whole > 0 else (0.0, 0.0, 0.0, 1.0)


def _mass(polarity: bool, confidence: float) -> tuple[float, ...]:
    c = min(confidence, 0.8)
    own = (0.5 * c, 0.0, 0.0, 1 - 0.5 * c) if polarity else (0.0, 0.7 * c, 0.1 * c, 1 - 0.8 * c)
    u = 0.3 if confidence < 0.05 else max(0.05, 0.3 * (1 - confidence))
    return _fold([own, (0.0, 0.0, u, 1 - u)])


@dataclass
class Node:
    path: tuple[str, ...]
    seqs: list[int]
    depth: int
    parent: Node | None = None
    mass: tuple[float, ...] = (0.0, 0.0, 0.0, 1.0)
    visits: int = 0
    children: list[Node] = field(default_factory=list)
    expanded: bool = False


def _entropy(m: tuple[float, ...]) -> float:
    return -sum(x * math.log2(x) for x in m if x > 0)


def search(claim: DataFrame, facts: DataFrame, edges: DataFrame, **options) -> tuple[dict, list[Node]]:
    """Verdict and the nodes of the tree. claim: anchor, activation; facts with seq, importance_score; edges: source, target, anchor."""
    o = SEARCH | options
    roots = claim.where("activation > 0.1").orderBy(F.desc("activation"), "anchor").limit(o["roots"])
    asked = [(r["anchor"], r["activation"]) for r in roots.collect()]
    spark = facts.sparkSession
    kind = facts.schema["seq"].dataType.simpleString()
    frontier = [r["seq"] for r in neighbourhood(facts, spark.createDataFrame(asked, "anchor string, activation double"), o["facts"]).select("seq").distinct().collect()] if asked else []
    reached, links = set(frontier), []
    for _ in range(o["depth"] - 1):  # each step's rows are bounded: the step before times next_edges
        if not frontier:
            break
        by = Window.partitionBy("source").orderBy("target", "anchor")
        here = F.broadcast(spark.createDataFrame([(s,) for s in frontier], f"source {kind}"))
        step = edges.select("source", "target", "anchor").join(here, "source").withColumn("_n", F.row_number().over(by)).where(F.col("_n") <= o["next_edges"]).collect()
        links += step
        frontier = sorted({e["target"] for e in step} - reached)
        reached |= set(frontier)
    rows = facts.join(F.broadcast(spark.createDataFrame([(s,) for s in sorted(reached)], f"seq {kind}")), "seq", "left_semi")
    # Bounded: roots * facts * next_edges ** depth rows at most.
    known = {r["seq"]: r for r in rows.select("seq", "subject", "predicate", "object", "polarity", "confidence", "importance_score").collect()}
    leads: dict = {}
    for e in sorted(links, key=lambda e: (e["source"], e["anchor"], e["target"])):
        if e["target"] in known:
            leads.setdefault(e["source"], []).append((e["anchor"], e["target"]))
    first = sorted(known, key=lambda s: (-known[s]["importance_score"], s))
    names = {a for a, _ in asked}
    root = Node(tuple(sorted(names)), [s for s in first if names & {known[s]["subject"], known[s]["predicate"], known[s]["object"]}][: o["roots"] * o["facts"]], 0)
    nodes, log = [root], []

    def evaluate(node: Node) -> list[tuple[float, ...]]:
        return [_mass(known[s]["polarity"], known[s]["confidence"]) for s in node.seqs[:5]]

    def update(node: Node) -> None:
        while node is not None:
            telling = sorted((c.mass for c in node.children if max(c.mass[0], c.mass[1]) > 0.3 * c.mass[2]), key=lambda m: m[3])[:3]
            own = sorted(evaluate(node), key=lambda m: -max(m[0], m[1]))[:DECISIVE]
            node.mass, node.visits = _fold(own + telling), node.visits + 1
            node = node.parent

    def ucb(node: Node) -> float:
        if not node.visits:
            return math.inf
        above = node.parent.visits if node.parent else node.visits
        return node.mass[0] + o["exploration"] * math.sqrt(2 * math.log(max(above, 1)) / node.visits)

    update(root)
    for _ in range(o["iterations"]):
        leaves = [n for n in nodes if not n.expanded and n.depth < o["depth"]]
        if not leaves:
            break
        node = max(leaves, key=ucb)
        node.expanded = True
        grown: dict[str, list[int]] = {}
        for s in node.seqs[:10]:
            for anchor, target in leads.get(s, [])[: o["next_edges"]]:
                if target not in grown.setdefault(anchor, []):
                    grown[anchor].append(target)
        met = sorted({known[s][k] for s in node.seqs for k in ("subject", "object")} - set(node.path))[: o["new_anchors"]]
        for anchor in met:
            other = [s for s in first if anchor in (known[s]["subject"], known[s]["predicate"], known[s]["object"]) and s not in node.seqs][:8]
            grown.setdefault(anchor, []).extend(x for x in other if x not in grown.get(anchor, []))
        for anchor in sorted(grown):
            if grown[anchor]:
                child = Node((*node.path, anchor) if anchor not in node.path else node.path, grown[anchor], node.depth + 1, node)
                node.children.append(child)
                nodes.append(child)
                update(child)
        log.append(_entropy(root.mass))
        if len(log) >= 5 and max(log[-3:]) - min(log[-3:]) < o["settled"]:
            break
    s, r, u, t = root.mass
    focal = s + r + u
    s, r, u = (x + t * x / focal for x in (s, r, u)) if focal > 0 else (t / 3,) * 3
    label = "REFUTES" if r > REFUTES_AT and r > s else "SUPPORTS" if s > SUPPORTS_AT and s > r else "NOT ENOUGH INFO"
    return {"label": label, "belief_supports": s, "belief_refutes": r, "belief_uncertain": u, "n_nodes": len(nodes), "n_facts": sum(len(n.seqs) for n in nodes), "iterations": len(log)}, nodes
