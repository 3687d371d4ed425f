"""Pairs are counted as numbers and named afterwards; clusters work the edges out once."""

from collections import Counter
from itertools import combinations_with_replacement

from noemata.operators import discover


def units(spark):
    said = ["b a c", "a b", "", "c", "z9 a _x", "b a", "q r s a"]
    return spark.createDataFrame(list(enumerate(said)), "id int, text string"), said


def test_pairs_are_counted_as_numbers(spark):
    rows, said = units(spark)
    tokens = discover.unit_tokens(rows, ["id"], "text")
    found = discover.cooccurrence(tokens, ["id"], discover.frequent(tokens, 7))
    assert "hashpartitioning(t1" not in found._jdf.queryExecution().executedPlan().toString()
    kept = {t for t, _ in sorted(Counter(t for line in said for t in line.split()).items(), key=lambda x: (-x[1], x[0]))[:7]}
    told = Counter(pair for line in said for pair in combinations_with_replacement(sorted(kept.intersection(line.split())), 2))
    assert {(r.t1, r.t2): r.n for r in found.collect()} == told and found.columns == ["t1", "t2", "n"]


def test_clusters_work_the_edges_out_once(spark, monkeypatch):
    rows, said = units(spark)
    tokens = discover.unit_tokens(rows, ["id"], "text")
    vocabulary = discover.frequent(tokens)
    edges = discover.npmi(discover.cooccurrence(tokens, ["id"], vocabulary), vocabulary, len(said))
    monkeypatch.setattr(discover, "laplacian", None)  # it reads the edges three times
    found = {r.token: r.cluster for r in discover.clusters(edges, vocabulary, 3).collect()}
    assert set(found) == {t for line in said for t in line.split()} and set(found.values()) == {0, 1, 2}
    assert len({found[t] for t in ("q", "r", "s")}) == 1 and len({found[t] for t in ("z9", "_x")}) == 1
