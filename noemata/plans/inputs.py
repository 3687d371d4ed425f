"""Small fixed inputs of the queries: a vocabulary, a query, sentences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import Vocabulary

#: key, type, tokens, parent
ANCHORS = (
    ("power", "actor", ("th", "er"), None), ("river", "actor", ("on", "an"), "power"), ("stone", "actor", ("ing", "le"), None), ("flame", "actor", ("der", "die"), "stone"),
    ("ember", "actor", ("und",), "flame"), ("moves", "relation", ("the", "and"), None), ("holds", "relation", ("of", "to"), "moves"), ("breaks", "relation", ("la", "un"), None),
    ("height", "feature", ("in", "be"), None), ("depth", "feature", ("que", "es"), "height"), ("width", "feature", ("is", "that"), "height"), ("north", "location", ("en",), None),
    ("south", "location", ("de", "of the"), "north"), ("trade", "market", ("was", "with"), None),
)

#: anchor, activation
QUERY = (("user_1", 1.2), ("user_17", 0.8), ("k_3", 0.6), ("k_7", 0.25))

#: key, parent: the hierarchy of event anchors that retrieval expands
PARENTS = tuple((f"user_{i}", f"user_{i // 10}" if i >= 10 else None) for i in range(1, 151))

#: event type, predicate that personas value
PREDICATES = (("signup", "implements"), ("error", "bypasses"), ("click", "tests"), ("view", "tracks"), ("purchase", "validates"))

SENTENCES = (
    "The service does not call the database.", "It doesn't call the pool.", "The piano calls the stage.", "UserService no longer calls DatabasePool directly.",
    "Toyota will invest in Q1 2026.", "Honda might launch in H2 2025.", "Ford is recalling cars since March 2024.", "BMW launched last week.", "They partner.", "NOBODY KNOWS; never mind.",
    "The plant is near the river because of the water.", "It was seldom used in 1999 and 2001.",
)

NOW = "2024-02-01 00:00:00"


def vocabulary() -> Vocabulary:
    return Vocabulary({k: {"type": t, "tokens": list(w), "parent": p, **({"country_code": "NN", "macro_region": "polar"} if t == "location" else {})} for k, t, w, p in ANCHORS})


def anchors(spark: SparkSession) -> DataFrame:
    return vocabulary().frame(spark)


def query(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(QUERY), "anchor string, activation double")


def parents(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(PARENTS), "key string, parent string")


def sentences(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(enumerate(SENTENCES)), "id int, sentence string")


def now() -> F.Column:
    return F.lit(NOW).cast("timestamp")
