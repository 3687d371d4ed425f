"""Schemas of the tables, the vocabulary of anchors and its hierarchy."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .fixed import CODE_RELATIONS, PERSONA_FOCUS, PERSONA_VALENCE

GROUNDING = "struct<grounding_type: string, doc_id: string, sent_id: int, char_start: int, char_end: int, sentence_text: string, file_path: string, line_number: int, node_type: string>"
IMPORTANCE = "struct<activation: double, coherence: double, specificity: double, novelty: double, reinforcement: double>"
SPAN = "struct<text: string, start: int, end: int>"
LOCATION = "struct<name: string, level: string, country_code: string, macro_region: string, confidence: double, source: string>"
TEMPORAL_REF = "struct<text: string, precision: string, confidence: double>"
MASS = "struct<s: double, r: double, u: double, theta: double>"

FACT_DDL = (
    f"fact_id string, subject string, predicate string, object string, polarity boolean, grounding {GROUNDING}, confidence double, timestamp timestamp, importance {IMPORTANCE}, "
    "kind string, reinforcement_count bigint, doc_id string, created_at timestamp, direction string, "
    f"spans map<string, {SPAN}>, support map<string, string>, subject_meta map<string, string>, predicate_meta map<string, string>, object_meta map<string, string>, "
    f"locations array<{LOCATION}>, precision string, temporal_refs array<{TEMPORAL_REF}>, tense string, aspect string, importance_score double, last_reinforced string, decay_rate double, "
    "pruned boolean, parent_fact_ids array<string>, fitness double"
)
EDGE_DDL = "source string, target string, edge_type string, weight double, metadata struct<anchor: string, anchor_role: string, gap_days: int, level: string>, created_at timestamp"
CONSTRAINT_DDL = "subject string, predicate string, object string, evidence bigint, doc_count bigint, strength double, persistence double, score double, fact_ids array<string>, updated_at timestamp"
DOCUMENT_DDL = "doc_id string, path string, kind string, text string, timestamp timestamp, n_facts bigint, token_count bigint, ingested_at timestamp"
ANCHOR_DDL = "key string, type string, tokens array<string>, description string, parent string, attrs map<string, string>"
TABLES = {"facts": FACT_DDL, "edges": EDGE_DDL, "constraints": CONSTRAINT_DDL, "documents": DOCUMENT_DDL}

TYPES = ("actor", "relation", "feature", "market", "location")
HIERARCHY_FIELDS = ("parent", "country", "country_code", "macro_region", "level", "category", "industry", "period", "variant_of")


class SchemaError(ValueError):
    """A vocabulary that can't be read or isn't valid."""


@dataclass(frozen=True)
class Vocabulary:
    """Anchors by key: {"type", "tokens", "description", "parent", and attributes}. Small data that stays on the driver."""

    anchors: dict[str, dict] = field(default_factory=dict)
    language: str = "text"
    version: str = "1.0"

    def __post_init__(self):
        for key, info in self.anchors.items():
            if info.get("type") not in TYPES:
                raise SchemaError(f"{key}: type {info.get('type')!r} isn't one of {', '.join(TYPES)}")

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        try:
            read = json.loads(Path(path).read_text())
            if "anchors" not in read:  # the flat form: {key: {...}}
                read = {"anchors": read}
            anchors = read["anchors"]
            if isinstance(anchors, list):
                anchors = {a["key"]: {k: v for k, v in a.items() if k != "key"} for a in anchors}
            return cls(anchors, read.get("language", "text"), read.get("version", "1.0")).completed()
        except (OSError, ValueError, KeyError, TypeError, AttributeError) as e:
            raise SchemaError(f"{path}: {e}") from e

    def save(self, path: str) -> None:
        anchors = [{"key": k, **v} for k, v in self.anchors.items()]
        Path(path).write_text(json.dumps({"version": self.version, "language": self.language, "anchors": anchors}, indent=2))

    def completed(self) -> Vocabulary:
        """For code, with the built-in relations that are missing."""
        if self.language != "code":
            return self
        built_in = {k: {"type": "relation", "tokens": list(t), "description": k} for k, t in CODE_RELATIONS}
        return Vocabulary(self.anchors | {k: v for k, v in built_in.items() if k not in self.anchors}, self.language, self.version)

    def of_type(self, kind: str) -> dict[str, dict]:
        return {k: v for k, v in self.anchors.items() if v["type"] == kind}

    def by_field(self, name: str, value: str) -> list[str]:
        return [k for k, v in self.anchors.items() if v.get(name) == value]

    def hierarchy(self, key: str) -> dict:
        return {f: v for f in HIERARCHY_FIELDS if (v := self.anchors.get(key, {}).get(f)) is not None}

    def role_of(self, key: str) -> str:
        return {"actor": "subject", "relation": "predicate"}.get(self.anchors.get(key, {}).get("type", ""), "object")

    def frame(self, spark: SparkSession) -> DataFrame:
        known = {"type", "tokens", "description", "parent"}
        rows = [(k, v["type"], list(v.get("tokens", [])), v.get("description"), v.get("parent"), {a: str(b) for a, b in v.items() if a not in known and b is not None}) for k, v in self.anchors.items()]
        return spark.createDataFrame(rows, ANCHOR_DDL)


def closure(anchors: DataFrame, most: int = 32) -> DataFrame:
    """ancestor, descendant, depth (0 for itself): the transitive closure of parent. Cycles end where a key comes again; most is the greatest depth."""
    spark = anchors.sparkSession
    anchors.select("key", "parent").createOrReplaceTempView("_anchor_parents")
    return spark.sql(f"""
        WITH RECURSIVE walk(ancestor, descendant, depth, path) AS (
            SELECT key, key, 0, array(key) FROM _anchor_parents
            UNION ALL
            SELECT w.ancestor, a.key, w.depth + 1, array_append(w.path, a.key)
            FROM walk w JOIN _anchor_parents a ON a.parent = w.descendant
            WHERE NOT array_contains(w.path, a.key) AND w.depth < {most}
        )
        SELECT ancestor, descendant, min(depth) AS depth FROM walk GROUP BY ancestor, descendant
    """)


def valences(spark: SparkSession) -> DataFrame:
    """persona, predicate, valence."""
    rows = [(p, w, v) for p, (good, bad) in PERSONA_VALENCE.items() for words, v in ((good, 1.0), (bad, -1.0)) for w in words]
    return spark.createDataFrame(rows, "persona string, predicate string, valence double")


def focus(spark: SparkSession) -> DataFrame:
    """persona, positive, negative, types."""
    return spark.createDataFrame([(p, list(a), list(b), list(t)) for p, (a, b, t) in PERSONA_FOCUS.items()], "persona string, positive array<string>, negative array<string>, types array<string>")


def role_of_type(kind: F.Column) -> F.Column:
    return F.when(kind == "actor", "subject").when(kind == "relation", "predicate").otherwise("object")


def grounding(kind: str, **parts: F.Column) -> F.Column:
    """Where a fact comes from: kind text or ast; what isn't given is null."""
    names = {"doc_id": "string", "sent_id": "int", "char_start": "int", "char_end": "int", "sentence_text": "string", "file_path": "string", "line_number": "int", "node_type": "string"}
    return F.struct(F.lit(kind).alias("grounding_type"), *[parts.get(n, F.lit(None)).cast(t).alias(n) for n, t in names.items()])
