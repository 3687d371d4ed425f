"""Sentences are worked out within their rows: no shuffle by sentence, and the same as when they are grouped."""

from collections import Counter, defaultdict
from math import log1p

import pytest
from pyspark.sql import functions as F

from noemata.functions import text
from noemata.operators import extract
from noemata.plans import inputs
from noemata.plans.catalogue import QUERIES
from noemata.schema import Vocabulary

from .conftest import SMALL

UNIT = ["doc_id", "sent_idx"]


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["anchor_activation", "row_max_norm", "topk_per_type", "triples_min", "triples_geomean", "observed_facts"])
def test_sentences_are_not_shuffled(spark, name):
    assert "hashpartitioning" not in plan(QUERIES[name](spark, SMALL))


@pytest.mark.parametrize("name", ["idf_specificity", "text_facts"])
def test_only_anchors_are_shuffled(spark, name):
    assert "hashpartitioning(doc_id" not in plan(QUERIES[name](spark, SMALL))


ROWS = [
    (1, "The cat saw of the dog. Of the of the Cat."), (2, "a"), (2, "Then the the cat. And the."), (2, "the x. The of the"), (3, ""), (3, None), (4, None),
    (None, "The of. Dog dog"), (None, "the dog"), (5, "  Theé the'  THE .  "),
]


@pytest.mark.parametrize("rows", [ROWS, [(1, ROWS[0][1]), (None, "The of the dog. The cat.")]])
def test_active_as_counted(spark, rows):
    """Brute force over documents that share an id or have none, tokens given twice and phrases."""
    v = Vocabulary({"c": {"type": "actor", "tokens": ["cat", "Cat", "the"]}, "d": {"type": "relation", "tokens": ["dog", "of the"]}, "e": {"type": "feature", "tokens": ["of", "the"]}, "f": {"type": "market", "tokens": ["none"]}})
    anchors, documents = v.frame(spark), spark.createDataFrame(rows, "doc_id int, text string")
    active = extract.encoded(documents, anchors)
    found = sorted(map(repr, extract.listed(active, UNIT).withColumn("activation", F.round("activation", 9)).collect()))
    single, phrase = Counter(), defaultdict(int)
    for r in text.sentences(documents).select(*UNIT, F.regexp_extract_all(F.lower("sentence"), F.lit("[a-z0-9_']+"), F.lit(0)).alias("words")).collect():
        line = " " + " ".join(r.words) + " "
        for key, info in v.anchors.items():
            for token in map(str.lower, info["tokens"]):
                at = (r.doc_id, r.sent_idx, key, info["type"], token)
                if " " in token:
                    phrase[at] = max(phrase[at], (len(line) - len(line.replace(f" {token} ", ""))) // (len(token) + 2))
                else:
                    single[at] += r.words.count(token)
    most = defaultdict(int)
    for counts in (single, phrase):
        for at, n in counts.items():
            most[at[:4]] = max(most[at[:4]], n)
    told = spark.createDataFrame([(*at, round(log1p(n), 9)) for at, n in most.items() if n], "doc_id int, sent_idx int, key string, type string, activation double")
    assert found == sorted(map(repr, told.collect()))
    grouped = extract.activations(text.sentences(documents), anchors, UNIT).withColumn("activation", F.round("activation", 9))
    assert found == sorted(map(repr, grouped.collect()))


def test_best_by_role(spark):
    active = spark.sql("SELECT 1 AS doc_id, 0 AS sent_idx, from_json(x, 'array<struct<key: string, type: string, activation: double>>') AS active FROM (SELECT '[{\"key\": \"b\", \"type\": \"market\", \"activation\": 1}, {\"key\": \"a\", \"type\": \"feature\", \"activation\": 1}, {\"key\": \"c\", \"type\": \"location\", \"activation\": 2}, {\"key\": \"d\", \"type\": \"actor\", \"activation\": 0.2}]' AS x)")
    assert [(r.key, r.role, r["rank"], r.share) for r in extract.best_by_role(active, UNIT, k=2).collect()] == [("c", "object", 1, 1.0), ("a", "object", 2, 0.5)]


def test_facts_of_documents_that_share_an_id(spark):
    """A fact for each sentence of the place, as when sentences were joined; none without id."""
    said = "Toyota will invest in a battery."
    v = Vocabulary({"toyota": {"type": "actor", "tokens": ["toyota"]}, "invest": {"type": "relation", "tokens": ["invest"]}, "battery": {"type": "feature", "tokens": ["battery"]}})
    documents = spark.createDataFrame([(1, said), (2, said), (2, "Toyota did not invest."), (None, said)], "doc_id int, text string")
    for facts, tense in ((extract.text_facts, {"future", "past", "present"}), (extract.observed_facts, {"present"})):
        rows = facts(documents, v.frame(spark)).collect()
        assert sorted((r.doc_id, r.sentence, r.polarity) for r in rows) == [("1", said, True), ("2", "Toyota did not invest.", False), ("2", said, True)]
        assert {r.tense for r in rows} <= tense
