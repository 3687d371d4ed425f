"""A knowledge base: Parquet tables of facts, edges, constraints and documents in one folder, with one writer at a time."""

from __future__ import annotations

import json
import uuid
from datetime import UTC, datetime

from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from .fixed import CHAIN_STARTS, CHAINED_ANCHORS, FETCHED_ANCHORS, PRUNE_BELOW
from .functions import scores
from .operators import consolidate, extract, facts, imagine, lookup, reason, retrieve, verify
from .schema import TABLES, Vocabulary, closure, focus, role_of_type, valences

#: Parts by time into which a hot anchor's facts are dealt for its chain.
CHAIN_BUCKETS = 16


class ConcurrentWriteError(RuntimeError):
    """Another writer holds the folder."""


class KnowledgeBase:
    """Tables below `path`. Reading needs no lock; use as a context manager to write.

    A table is a folder of versions and a pointer to the current one. New rows are written as a new version, and only then
    is the pointer switched, by one rename; so a job that fails, or a driver or executor that is lost, leaves the old rows.
    The version before is kept for its readers until the next replacement or vacuum.
    """

    def __init__(self, spark: SparkSession, path: str, vocabulary: Vocabulary | None = None, consolidate_every: int = 100):
        self.spark, self.path, self.vocabulary, self.every = spark, path.rstrip("/"), vocabulary or Vocabulary(), consolidate_every
        self.since, self._locked = 0, False

    # files

    def _fs(self, path: str):
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def __enter__(self) -> KnowledgeBase:
        fs, lock = self._fs(f"{self.path}/.lock")
        if not fs.createNewFile(lock):
            raise ConcurrentWriteError(f"{self.path} is being written; remove {lock} if no writer is left")
        self._locked = True
        return self

    def __exit__(self, *_) -> None:
        self.close()

    def close(self) -> None:
        if self._locked:
            fs, lock = self._fs(f"{self.path}/.lock")
            fs.delete(lock, False)
            self._locked = False

    def _pointer(self, name: str) -> str:
        return f"{self.path}/{name}/CURRENT"

    def version(self, name: str) -> str | None:
        """The folder that holds the table's rows now; None for a table never written."""
        fs, p = self._fs(self._pointer(name))
        if fs.exists(p):
            stream = fs.open(p)
            try:
                return bytes(stream.readAllBytes()).decode().strip()
            finally:
                stream.close()
        _, folder = self._fs(f"{self.path}/{name}")
        if fs.exists(folder) and len(fs.listStatus(folder)):
            raise FileNotFoundError(f"{folder} has rows but no pointer to its current version ({p}); write the name of a version folder there")
        return None

    def table(self, name: str) -> DataFrame:
        current = self.version(name)
        if current is None:
            return self.spark.createDataFrame([], TABLES[name])
        return self._shaped(name, self.spark.read.parquet(f"{self.path}/{name}/{current}"))

    def _shaped(self, name: str, rows: DataFrame, *more: str) -> DataFrame:
        """rows with the table's columns and types, and more of their own; what is missing is null."""
        want = self.spark.createDataFrame([], TABLES[name]).schema
        return rows.select(*[F.col(f.name).cast(f.dataType) if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in want], *more)

    def replace(self, name: str, rows: DataFrame) -> None:
        if not self._locked:
            raise ConcurrentWriteError("writing needs the lock: use `with kb:`")
        before, new = self.version(name), f"v-{uuid.uuid4().hex}"
        self._shaped(name, rows).write.parquet(f"{self.path}/{name}/{new}")
        self._point(name, new)
        for version in self._versions(name) - {before, new}:  # readers may still be in the one before
            self._drop(name, version)

    def _point(self, name: str, version: str) -> None:
        """Switch the pointer by one rename over the old one, so that there is always a whole pointer."""
        jvm = self.spark._jvm
        fs, staged = self._fs(f"{self.path}/{name}/.CURRENT-{uuid.uuid4().hex}")
        out = fs.create(staged)
        out.write(version.encode())
        out.close()
        _, target = self._fs(self._pointer(name))
        kind = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
        how = self.spark.sparkContext._gateway.new_array(kind, 1)
        how[0] = kind.OVERWRITE
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.makeQualified(target).toUri(), self.spark._jsc.hadoopConfiguration()).rename(fs.makeQualified(staged), fs.makeQualified(target), how)

    def _versions(self, name: str) -> set[str]:
        fs, folder = self._fs(f"{self.path}/{name}")
        return {s.getPath().getName() for s in fs.listStatus(folder) if s.isDirectory()} if fs.exists(folder) else set()

    def _drop(self, name: str, version: str) -> None:
        fs, folder = self._fs(f"{self.path}/{name}/{version}")
        fs.delete(folder, True)

    def vacuum(self) -> int:
        """Delete every version but the current ones; how many there were."""
        if not self._locked:
            raise ConcurrentWriteError("vacuum needs the lock: use `with kb:`")
        old = [(n, v) for n in TABLES for v in self._versions(n) - {self.version(n)}]
        for name, version in old:
            self._drop(name, version)
        return len(old)

    # facts

    def upsert(self, new: DataFrame) -> None:
        """new: subject, predicate, object, polarity, confidence, timestamp, seq, and what else a fact has. What is known is reinforced and keeps its first columns; of several facts known by one key (from different documents) the oldest is."""
        old = self.table("facts")
        folds = {*facts.KEY, "confidence", "timestamp", "seq", "reinforcement_count"}
        kept = tuple(c for c in old.columns if c not in folds)
        place = F.row_number().over(Window.partitionBy(*facts.KEY).orderBy("created_at", "fact_id"))
        placed = old.withColumn("_place", place)
        before = placed.where("_place = 1").withColumn("reinforcement_count", F.coalesce("reinforcement_count", F.lit(1))).withColumn("seq", F.lit(None).cast(new.schema["seq"].dataType))
        joined = facts.upsert_fold(self._shaped("facts", new, "seq"), before, kept)
        own = F.concat(F.lit("fact_"), F.substring(F.sha2(F.concat_ws(":", *[F.col(k).cast("string") for k in facts.KEY]), 256), 1, 12))
        for name, default in (("kind", F.lit("observed")), ("fact_id", own), ("pruned", F.lit(False)), ("created_at", F.col("timestamp"))):
            joined = joined.withColumn(name, F.coalesce(name, default))
        self.replace("facts", self._shaped("facts", joined).unionByName(placed.where("_place > 1").drop("_place")))

    def observe(self, text: str, source: str = "agent", at: datetime | None = None) -> dict[str, int]:
        """Store what an observation says, under the document source:time; how many facts came and how many were known (or said twice)."""
        at = at or datetime.now(UTC)
        said = self.spark.createDataFrame([(f"{source}:{at.isoformat()}", text)], "doc_id string, text string")
        found = extract.observed_facts(said, self.vocabulary.frame(self.spark))
        found = found.withColumn("timestamp", F.lit(at.isoformat()).cast("timestamp")).withColumn("kind", F.lit("extracted")).withColumn("importance_score", scores.composite(F.col("importance")))
        found = found.withColumn("seq", F.struct("sent_idx", "fact_id"))
        counted = facts.probe(found.dropDuplicates(facts.KEY), self.table("facts")).agg(F.count_if(F.col("found") != "reinforced").alias("added")).first()
        total = found.count()  # an observation is one text
        self.upsert(found)
        self.consolidate()
        return {"facts_added": counted["added"], "facts_reinforced": total - counted["added"]}

    def put(self, name: str, rows: DataFrame, keys: list[str]) -> None:
        """Replacing upsert: rows win over what has their keys; of rows with the same keys one is kept."""
        old = self.table(name)
        self.replace(name, self._shaped(name, rows).dropDuplicates(keys).unionByName(old.join(rows.select(*keys).distinct(), keys, "left_anti")))

    def ingest(self, documents: DataFrame, consolidate_now: bool | None = None) -> DataFrame:
        """documents: doc_id, text, timestamp. Extracts facts, stores them and the texts, and consolidates when enough have come. Ingesting the same again changes nothing."""
        found = extract.text_facts(documents, self.vocabulary.frame(self.spark)).join(documents.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("timestamp").cast("timestamp").alias("timestamp")), "doc_id")
        found = found.withColumn("kind", F.lit("observed")).withColumn("reinforcement_count", F.lit(1)).withColumn("pruned", F.lit(False))
        found = found.withColumn("created_at", F.col("timestamp"))
        self.put("facts", found, ["fact_id"])
        counts = found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_facts"))
        kept = documents.where("doc_id IS NOT NULL AND text <> ''").select(F.col("doc_id").cast("string").alias("doc_id"), "text", F.col("timestamp").cast("timestamp").alias("timestamp"))
        tokens = F.size(F.regexp_extract_all(F.lower("text"), F.lit(r"[a-z0-9_']+"), F.lit(0)))
        kept = kept.join(counts, "doc_id", "left").withColumn("n_facts", F.coalesce("n_facts", F.lit(0))).withColumn("token_count", tokens).withColumn("kind", F.lit("text"))
        self.put("documents", kept.withColumn("ingested_at", F.current_timestamp()), ["doc_id"])
        self.put("edges", extract.spokes(found), ["source", "target", "edge_type"])
        self.since += 1
        if consolidate_now or (consolidate_now is None and self.since >= self.every):
            self.consolidate()
            self.since = 0
        return self.table("facts")

    def consolidate(self) -> None:
        """Recompute constraints and chains from the observed facts."""
        seen = facts.live(self.table("facts"))
        self.replace("constraints", consolidate.constraints_by_documents(seen))
        edges = consolidate.next_edges_by_role(seen.withColumn("seq", F.col("fact_id")), buckets=CHAIN_BUCKETS)
        spokes = self.table("edges").where("edge_type <> 'NEXT'")
        self.replace("edges", spokes.unionByName(self._shaped("edges", edges.select("source", "target", F.lit("NEXT").alias("edge_type"), "weight", F.struct("anchor", "anchor_role", "gap_days", F.lit(None).cast("string").alias("level")).alias("metadata")))))

    def decay(self, now: F.Column) -> None:
        rows = self.table("facts")
        since = F.coalesce(F.try_to_timestamp("last_reinforced"), "timestamp")
        self.replace("facts", rows.withColumn("importance_score", scores.decayed_linear(F.col("importance_score"), since, now, F.coalesce("decay_rate", F.lit(0.01)))))

    def prune(self, below: float = PRUNE_BELOW) -> int:
        rows = facts.pruned(self.table("facts"), "importance_score", below)
        n = rows.where("pruned").count() - self.table("facts").where("pruned").count()
        self.replace("facts", rows)
        return n

    def clear_imagined(self) -> None:
        self.replace("facts", self.table("facts").where("kind <> 'imagined'"))

    def add_edge(self, source: str, target: str, edge_type: str, weight: float = 1.0) -> None:
        """Append an edge, whether or not there is one like it."""
        new = self.spark.createDataFrame([(source, target, edge_type, float(weight))], "source string, target string, edge_type string, weight double").withColumn("created_at", F.current_timestamp())
        self.replace("edges", self.table("edges").unionByName(self._shaped("edges", new)))

    # questions

    def get(self, fact_id: str, with_pruned: bool = True) -> Row | None:
        return lookup.by_id(self.table("facts"), "fact_id", fact_id, with_pruned=with_pruned).first()

    def document(self, doc_id: str) -> Row | None:
        return lookup.by_id(self.table("documents"), "doc_id", doc_id).first()

    def edges(self, source: str | None = None, target: str | None = None, edge_type: str | None = None, limit: int | None = None) -> DataFrame:
        return lookup.edges(self.table("edges"), source, target, edge_type, limit)

    def constraints(self, subject: str | None = None, predicate: str | None = None, object: str | None = None, min_score: float = 0.0, limit: int = 100) -> DataFrame:
        return lookup.constraints(self.table("constraints"), subject, predicate, object, min_score, limit)

    def answer(self, text: str, limit: int = 10) -> list[dict]:
        """Search as a service gives it: the hits with score, grounding and context; an error as a row."""
        try:
            hits = self.retrieve(text, limit)
            beside = self.table("edges").where("edge_type = 'NEXT'").join(hits.select(F.col("seq").alias("hit")), F.col("hit") == F.col("source")).select("hit", F.col("target").alias("fact_id"))
            around = beside.join(self.table("facts"), "fact_id")
            found = lookup.answers(hits, around, "seq").orderBy(F.desc("score"), "subject", "predicate", "object").collect()  # at most limit
        except Exception as e:  # the service answers with the error
            return [{"error": str(e), "query": text}]
        load = lambda r: {**r, "grounding": json.loads(r["grounding"])}
        return [{**load(r.asDict(True)), "context": [load(c.asDict(True)) for c in r["context"]]} for r in found]

    def full_search(self, text: str, persona: str | None = None, top_k: int = 50, min_importance: float = 0.0, chain_depth: int = 10, contrary: bool = False, now: F.Column | None = None) -> dict:
        """Ranked facts with those that their chains lead to, the chains, the constraints of the query's best anchors, and the timeline.

        The 15 most active anchors, with all below them, are looked up; chains and constraints are those of the best 5.
        """
        v = self.vocabulary.frame(self.spark)
        asked = self.query_anchors(text).orderBy(F.desc("activation"), "anchor").limit(FETCHED_ANCHORS)
        best = asked.orderBy(F.desc("activation"), "anchor").limit(CHAINED_ANCHORS)
        types, tree = v.select("key", "type"), closure(v)
        if persona is None:
            row = retrieve.persona_scores(asked, types, focus(self.spark)).orderBy(F.desc("score"), "persona").first()
            persona = row["persona"] if row else "analyst"
        rows = facts.live(self.table("facts")).where(F.coalesce("importance_score", F.lit(0.0)) >= min_importance).withColumn("seq", F.col("fact_id"))
        moment = now if now is not None else F.current_timestamp()
        wide, all_facts = retrieve.expanded(asked, tree), rows
        found = retrieve.search(all_facts, wide, types, focus(self.spark), persona, moment, top_k, contrary)
        links = self.table("edges").where("edge_type = 'NEXT'").select("source", "target", "metadata.anchor").join(F.broadcast(best.select("anchor")), "anchor")
        starts = found.orderBy(F.desc("rank_score"), "seq").limit(CHAIN_STARTS).select(F.col("seq").alias("source")).crossJoin(F.broadcast(best.select("anchor")))  # 10 x 5
        walked = retrieve.chains(starts, links, chain_depth).where("step > 0")
        more = lookup.chained(found, walked, all_facts)
        ranked = retrieve.rescored(found.select(*all_facts.columns).unionByName(more.select(*all_facts.columns)), types, focus(self.spark), persona, moment, contrary).orderBy(F.desc("rank_score"), "seq").limit(top_k)
        below = retrieve.expanded(best, tree).select("anchor").join(types, F.col("anchor") == F.col("key")).select("anchor", role_of_type(F.col("type")).alias("role"))
        kept = retrieve.constraint_lookup(self.table("constraints"), below).orderBy(F.desc("score"), "subject", "predicate", "object")
        return {"persona": persona, "anchors": asked, "facts": ranked, "chains": walked, "constraints": kept, "timeline": ranked.where("timestamp IS NOT NULL").orderBy("timestamp", "seq")}

    def query_anchors(self, text: str) -> DataFrame:
        units = self.spark.createDataFrame([(0, text)], "q int, sentence string")
        return extract.activations(units, self.vocabulary.frame(self.spark), ["q"]).select(F.col("key").alias("anchor"), "activation")

    def retrieve(self, text: str, limit: int = 10, persona: str | None = None) -> DataFrame:
        """Best facts for a text, with the facts that their chains lead to."""
        asked = retrieve.expanded(self.query_anchors(text), closure(self.vocabulary.frame(self.spark)))
        rows = facts.live(self.table("facts")).withColumn("seq", F.col("fact_id")).withColumn("reinforcement", F.coalesce("importance.reinforcement", F.lit(0.5)))
        hits = retrieve.ranked(retrieve.relevance(rows, asked, valences(self.spark), persona), limit)
        around = retrieve.context(hits, self.table("edges").where("edge_type = 'NEXT'")).groupBy("hit").agg(F.sort_array(F.collect_list("other")).alias("context"))
        return hits.join(around, hits["seq"] == around["hit"], "left").drop("hit").orderBy(F.desc("score"), "seq")

    def search(self, text: str, persona: str = "analyst", top_k: int = 50, contrary: bool = False, now: F.Column | None = None) -> DataFrame:
        rows = facts.live(self.table("facts")).withColumn("seq", F.col("fact_id"))
        types = self.vocabulary.frame(self.spark).select("key", "type")
        return retrieve.search(rows, self.query_anchors(text), types, focus(self.spark), persona, now if now is not None else F.current_timestamp(), top_k, contrary)

    def verify_claim(self, text: str, contrary: bool = False) -> DataFrame:
        rows = facts.live(self.table("facts")).withColumn("seq", F.col("fact_id"))
        return verify.verify(self.query_anchors(text).withColumn("claim_id", F.lit(0)), rows, self.vocabulary.frame(self.spark).select("key", "type"), contrary=contrary)

    def reason(self, text: str, **options) -> dict:
        rows = facts.live(self.table("facts")).withColumn("seq", F.col("fact_id"))
        return reason.search(self.query_anchors(text), rows, self.table("edges").where("edge_type = 'NEXT'").select("source", "target", "metadata.anchor"), **options)[0]

    def imagine(self, text: str, persona: str | None = None, **options) -> DataFrame:
        """Imagined facts from the observed ones that the text touches; they are stored as imagined."""
        rows = facts.live(self.table("facts")).withColumn("seq", F.col("fact_id"))
        seeds = retrieve.relevance(rows.withColumn("reinforcement", F.lit(0.5)), self.query_anchors(text)).orderBy(F.desc("score"), "seq").limit(50)
        anchors = self.vocabulary.frame(self.spark)
        if not self.spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
            self.spark.sparkContext.setCheckpointDir(f"{self.path}/.checkpoints")
        best, _ = imagine.imagine(seeds, rows, anchors.select("key", "type"), imagine.relatives(anchors), self.table("constraints"), lambda d: d.checkpoint(), persona, **options)
        best = best.checkpoint()
        stored = best.select(F.col("imagined_id").alias("fact_id"), "subject", "predicate", "object", "polarity", "confidence", "timestamp", F.lit("imagined").alias("kind"), F.array("seq").alias("parent_fact_ids"), "fitness")
        self.put("facts", stored.withColumn("pruned", F.lit(False)), ["fact_id"])
        return best

    def stats(self) -> DataFrame:
        """One row: facts, edges, constraints, documents, observed, imagined."""
        counted = self.table("facts").agg(F.count(F.lit(1)).alias("facts"), F.count_if(F.col("kind") == "observed").alias("observed"), F.count_if(F.col("kind") == "imagined").alias("imagined"))
        for name in ("edges", "constraints", "documents"):
            counted = counted.crossJoin(self.table(name).agg(F.count(F.lit(1)).alias(name)))  # one row each
        return counted

    def top_anchors(self, k: int = 10) -> DataFrame:
        return facts.top_anchors(self.table("facts"), k)

    def recent(self, k: int = 20) -> DataFrame:
        return self.table("facts").orderBy(F.desc("created_at"), "fact_id").limit(k)
