"""The queries: each takes (spark, folder of the tables) and returns flat columns, doubles rounded to six digits."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..fixed import DECAY_RATE, SEARCH
from ..functions import belief, scores, text
from ..operators import consolidate, discover, extract, facts, imagine, lookup, reason, retrieve, verify
from ..schema import closure, focus, grounding, role_of_type, valences
from ..sources import code
from ..sources.tables import event_facts, geography, order_facts, supply_facts, table
from . import inputs

QUERIES: dict = {}


def query(function):
    QUERIES[function.__name__] = function
    return function


def r(x: Column | str, name: str | None = None) -> Column:
    column = F.col(x) if isinstance(x, str) else x
    return F.round(column, 6).alias(name or x)


def events(spark: SparkSession, folder: str) -> DataFrame:
    return event_facts(table(spark, folder, "events"))


def folded(spark: SparkSession, folder: str) -> DataFrame:
    return facts.upsert_fold(events(spark, folder))


def minutes(ts: str = "timestamp") -> Column:
    return F.unix_micros(F.col(ts))


# store


@query
def obs_upsert_fold(spark, folder):
    return folded(spark, folder).select(*facts.KEY, "reinforcement_count", r("confidence"), minutes().alias("ts_us"), "seq")


@query
def obs_upsert_two_batches(spark, folder):
    """The same fold, in two batches."""
    rows = events(spark, folder)
    first = facts.upsert_fold(rows.where("seq % 2 = 0"))
    return facts.upsert_fold(rows.where("seq % 2 = 1").withColumn("seq", F.col("seq") + 10**9), first).select(*facts.KEY, "reinforcement_count", r("confidence"))


@query
def orders_upsert_fold(spark, folder):
    return facts.upsert_fold(order_facts(table(spark, folder, "orders"))).select(*facts.KEY, "reinforcement_count", r("confidence"), "seq")


@query
def supply_constraints(spark, folder):
    rows = facts.upsert_fold(supply_facts(table(spark, folder, "lineitem")))
    return consolidate.constraints_by_evidence(rows).select("subject", "predicate", "object", "evidence", r("strength"), r("persistence"))


@query
def obs_latest_wins(spark, folder):
    return facts.latest(events(spark, folder), ["subject", "predicate"], "seq").select("subject", "predicate", "object", "polarity", "seq", r("confidence"))


@query
def filter_triple(spark, folder):
    return facts.matching(events(spark, folder), predicate="purchase", object="k_3", min_confidence=0.9).select("seq", "subject", r("confidence"))


@query
def role_lookup(spark, folder):
    """Facts of an anchor, by the role that it has."""
    return facts.by_anchor(events(spark, folder), "user_1").where("anchor IN ('user_1', 'k_3')").groupBy("anchor", "role").agg(F.count(F.lit(1)).alias("n"), r(F.avg("confidence"), "confidence"))


@query
def query_symbol(spark, folder):
    return facts.for_symbol(folded(spark, folder), "user_7", limit=50).select(*facts.KEY, "reinforcement_count")


@query
def search_fallthrough(spark, folder):
    return facts.first_tier(folded(spark, folder), "purchase").groupBy("tier", "predicate").agg(F.count(F.lit(1)).alias("n"), F.sum("reinforcement_count").alias("seen"))


@query
def stats_counts(spark, folder):
    rows = folded(spark, folder)
    edges = consolidate.next_edges(events(spark, folder)).agg(F.count(F.lit(1)).alias("n_edges"))
    constraints = rows.select("subject", "predicate", "object").distinct().agg(F.count(F.lit(1)).alias("n_constraints"))
    documents = table(spark, folder, "documents").agg(F.count(F.lit(1)).alias("n_documents"))
    return rows.agg(F.count(F.lit(1)).alias("n_facts")).crossJoin(edges).crossJoin(constraints).crossJoin(documents)  # one row each


@query
def top_anchors(spark, folder):
    return facts.top_anchors(folded(spark, folder))


@query
def distinct_anchors(spark, folder):
    return facts.anchors_of(events(spark, folder)).groupBy(F.substring("anchor", 1, 2).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query
def recent20(spark, folder):
    return events(spark, folder).orderBy(F.desc("timestamp"), F.desc("seq")).limit(20).select("seq", *facts.KEY)


@query
def kind_counts(spark, folder):
    rows = events(spark, folder).withColumn("kind", F.when(F.col("seq") % 10 == 0, "imagined").otherwise("observed")).withColumn("pruned", F.col("confidence") < 0.2)
    return rows.groupBy("kind", "pruned").agg(F.count(F.lit(1)).alias("n"))


@query
def prune_soft_delete(spark, folder):
    rows = facts.pruned(events(spark, folder).withColumn("pruned", F.lit(False)).withColumn("kind", F.lit("observed")), "confidence", 0.5)
    return facts.live(rows).groupBy("predicate").agg(F.count(F.lit(1)).alias("n"), r(F.min("confidence"), "least"))


@query
def doc_stats(spark, folder):
    docs = table(spark, folder, "documents")
    return docs.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum(F.size(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9_']+"), F.lit(0)))).cast("long").alias("tokens"))


@query
def duplicate_probe(spark, folder):
    rows = events(spark, folder)
    return facts.probe(rows.where("seq % 5 = 0"), rows.where("seq % 5 <> 0")).groupBy("predicate", "found").agg(F.count(F.lit(1)).alias("n"))


@query
def shortened_names(spark, folder):
    return table(spark, folder, "part").select("p_partkey", text.shortened(F.col("p_name"), 12).alias("name"))


# lookups


@query
def fact_by_id(spark, folder):
    rows = events(spark, folder).withColumn("pruned", F.col("confidence") < 0.2)
    found = lookup.by_id(rows, "seq", 17, 42, 99, 10**12).withColumn("asked", F.lit("all"))
    return found.unionByName(lookup.by_id(rows, "seq", 17, 42, 99, 10**12, with_pruned=False).withColumn("asked", F.lit("live"))).select("asked", "seq", *facts.KEY)


@query
def document_by_id(spark, folder):
    return lookup.by_id(table(spark, folder, "documents"), "doc_id", 7).select("doc_id", "lang", F.length("text").alias("n"))


def typed_edges(spark, folder):
    return consolidate.next_edges(events(spark, folder)).withColumn("edge_type", F.lit("NEXT"))


@query
def edges_outgoing(spark, folder):
    return lookup.edges(typed_edges(spark, folder), source=100, edge_type="NEXT").select("source", "target", r("weight"))


@query
def edges_incoming(spark, folder):
    return lookup.edges(typed_edges(spark, folder), target=500).select("source", "target", r("weight"))


@query
def constraints_filtered(spark, folder):
    rows = consolidate.constraints_by_documents(events(spark, folder).withColumn("doc_id", F.to_date("timestamp"))).withColumn("score", F.round("score", 6))
    return lookup.constraints(rows, predicate="purchase", object="k_3", min_score=0.2, limit=25).select("subject", "predicate", "object", "score")


@query
def observation_documents(spark, folder):
    """The document of an observation: source and time."""
    return events(spark, folder).select("seq", F.concat(F.lit("agent:"), F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss")).alias("doc_id"))


@query
def answers_json(spark, folder):
    """Facts as a search answers with them; each one's context is what follows it."""
    where = grounding("ast", file_path=F.concat(F.lit("f"), (F.col("seq") % 10).cast("string")), line_number=F.col("seq"))
    rows = events(spark, folder).withColumn("grounding", where)
    beside = consolidate.next_edges(events(spark, folder)).select(F.col("source").alias("hit"), F.col("target").alias("seq")).join(rows, "seq")
    found = lookup.answers(rows.withColumn("score", F.col("confidence")), beside, "seq")
    return found.groupBy("subject", "predicate").agg(F.min("grounding").alias("first_grounding"), F.count(F.lit(1)).alias("n"), F.sum(F.size("context")).cast("long").alias("n_context"), F.min(F.get("context", F.lit(0))["grounding"]).alias("first_context"))


@query
def chained_facts(spark, folder):
    """What the subject's chain leads to within three steps of its first fact."""
    rows = events(spark, folder)
    starts = rows.groupBy("subject").agg(F.min_by("seq", F.struct("timestamp", "seq")).alias("seq"))
    edges = consolidate.next_edges_by_role(rows, of=("subject",))
    walked = retrieve.chains(starts.select(F.col("seq").alias("source"), F.col("subject").alias("anchor")), edges, 3)
    return lookup.chained(starts, walked, rows).select("seq", *facts.KEY)


# consolidation


@query
def constraints_p1(spark, folder):
    return consolidate.constraints_by_evidence(folded(spark, folder)).select("subject", "predicate", "object", "evidence", r("strength"), r("persistence"))


@query
def constraints_p2(spark, folder):
    rows = events(spark, folder).withColumn("doc_id", F.to_date("timestamp"))
    return consolidate.constraints_by_documents(rows).select("subject", "predicate", "object", "evidence", "doc_count", r("strength"), "persistence", r("score"))


@query
def constraints_ranked(spark, folder):
    """The strongest constraints of the folded facts."""
    rows = consolidate.constraints_by_evidence(folded(spark, folder)).withColumn("weight", F.col("strength") * F.col("persistence"))
    return rows.orderBy(F.desc("weight"), "subject", "predicate", "object").limit(20).select("subject", "predicate", "object", "evidence", r("weight"))


@query
def next_edges_weighted(spark, folder):
    return consolidate.next_edges(events(spark, folder)).select("source", "target", r("weight"))


@query
def next_edges_bucketed(spark, folder):
    """The same chains, each anchor's facts split by time."""
    return consolidate.next_edges(events(spark, folder), buckets=8).select("source", "target", r("weight"))


@query
def next_edges_roles(spark, folder):
    """Chains over predicates too, which are hot: split by time."""
    return consolidate.next_edges_by_role(events(spark, folder), buckets=16).select("source", "target", "anchor", "anchor_role", "gap_days")


@query
def next_edges_incremental(spark, folder):
    rows = events(spark, folder)
    return consolidate.only_new(consolidate.next_edges(rows), consolidate.next_edges(rows.where("seq % 3 <> 0"))).select("source", "target", r("weight"))


@query
def decay_exponential(spark, folder):
    return consolidate.decay(events(spark, folder), "confidence", inputs.now()).select("seq", r("confidence_now"))


@query
def decay_linear(spark, folder):
    return events(spark, folder).select("seq", r(scores.decayed_linear(F.col("confidence"), F.col("timestamp"), inputs.now(), F.lit(DECAY_RATE)), "importance"))


@query
def reinforce_importance(spark, folder):
    rows = events(spark, folder)
    old = facts.upsert_fold(rows.where("seq % 2 = 0")).where("polarity")
    out = consolidate.reinforced(rows.where("seq % 2 = 1"), old)
    value = scores.importance(F.col("confidence"), F.lit(0.0), F.lit(0.5), F.lit(0.8), F.col("reinforcement_count"))
    return out.select("subject", "predicate", "object", "reinforcement_count", r("confidence"), r(value, "importance"))


# hierarchy


@query
def anchor_closure(spark, folder):
    return closure(inputs.anchors(spark))


@query
def geography_closure(spark, folder):
    return closure(geography(table(spark, folder, "region"), table(spark, folder, "nation")))


@query
def ancestors(spark, folder):
    return closure(inputs.parents(spark)).where("depth > 0").groupBy(F.col("descendant").alias("anchor")).agg(F.max("depth").alias("depth"), F.min_by("ancestor", "depth").alias("parent"))


@query
def descendant_expansion(spark, folder):
    return retrieve.expanded(inputs.query(spark), closure(inputs.parents(spark))).select("anchor", r("activation"))


@query
def typed_vocabulary(spark, folder):
    return inputs.anchors(spark).select("key", "type", role_of_type(F.col("type")).alias("role"), F.size("tokens").alias("n_tokens"))


@query
def field_lookup(spark, folder):
    return inputs.anchors(spark).where("attrs['country_code'] = 'NN'").select("key", F.col("attrs").getItem("macro_region").alias("macro_region"))


# text


def doc_sentences(spark, folder):
    return text.sentences(table(spark, folder, "documents").select("doc_id", "text"))


@query
def sentence_split(spark, folder):
    return doc_sentences(spark, folder).select("doc_id", "sent_idx", "sentence")


@query
def sentence_ids(spark, folder):
    return doc_sentences(spark, folder).select(text.sentence_id(F.col("doc_id"), F.col("sent_idx")).alias("sent_id"), F.length("sentence").alias("n"))


def said(spark, folder):
    return doc_sentences(spark, folder).select(F.concat_ws("_", F.col("doc_id").cast("string"), F.col("sent_idx").cast("string")).alias("id"), "sentence").unionByName(inputs.sentences(spark).select(F.concat(F.lit("s_"), F.col("id").cast("string")).alias("id"), "sentence"))


@query
def polarity_regex(spark, folder):
    return said(spark, folder).select("id", text.affirmed(F.col("sentence")).alias("affirmed"), text.label_negated(F.col("sentence")).alias("label"))


@query
def tense(spark, folder):
    return said(spark, folder).select("id", text.tense(F.col("sentence")).alias("tense"))


@query
def relation_types(spark, folder):
    return said(spark, folder).select("id", text.relation_type(F.col("sentence")).alias("relation"))


@query
def negation_window(spark, folder):
    rows = inputs.sentences(spark).withColumn("at", F.instr(F.lower("sentence"), "call"))
    return rows.where("at > 0").select("id", text.negated_before(F.col("sentence"), F.col("at") - 1, F.col("at") + 3).alias("negated"))


@query
def temporal_refs(spark, folder):
    rows = said(spark, folder).select("id", text.temporal_refs(F.col("sentence")).alias("refs"))
    count = lambda p: F.size(F.filter("refs", lambda x: x["precision"] == F.lit(p))).alias(p)
    return rows.select("id", count("quarter"), count("half"), count("month"), count("year"), count("relative"), text.precision(F.col("refs")).alias("first"))


@query
def span_first_token(spark, folder):
    rows = doc_sentences(spark, folder).withColumn("span", text.first_token_span(F.col("sentence"), F.array(F.lit("the"), F.lit("of"))))
    return rows.select("doc_id", "sent_idx", F.col("span.start").alias("start"), F.col("span.end").alias("end"))


@query
def span_longest(spark, folder):
    rows = doc_sentences(spark, folder).withColumn("span", text.longest_token_span(F.col("sentence"), F.array(F.lit("of"), F.lit("of the"), F.lit("that"))))
    return rows.where("span IS NOT NULL").select("doc_id", "sent_idx", F.lower("span.text").alias("text"), F.col("span.start").alias("start"))


@query
def support_class(spark, folder):
    rows = doc_sentences(spark, folder)
    found = text.support(F.col("sentence"), F.array(F.lit("thereof"), F.lit("ationed")), F.array(F.lit("heit"), F.lit("eaux")))
    return rows.select("doc_id", "sent_idx", found.alias("support"))


@query
def deterministic_ids(spark, folder):
    return events(spark, folder).select("seq", text.fact_id(F.col("seq"), F.lit(0), F.col("subject"), F.col("predicate"), F.col("object")).alias("id"), text.imagined_id(F.col("subject"), F.col("predicate"), F.col("object"), F.col("polarity")).alias("imagined"), text.imagined_sentence(F.col("subject"), F.col("predicate"), F.col("object"), F.col("polarity")).alias("sentence"))


# extraction


def active(spark, folder):
    return extract.encoded(table(spark, folder, "documents"), inputs.anchors(spark))


@query
def anchor_activation(spark, folder):
    return extract.listed(active(spark, folder), ["doc_id", "sent_idx"]).select("doc_id", "sent_idx", "key", r("activation"))


@query
def row_max_norm(spark, folder):
    return extract.normalised(active(spark, folder), ["doc_id", "sent_idx"]).select("doc_id", "sent_idx", "key", r("share"))


@query
def topk_per_type(spark, folder):
    return extract.best_by_type(active(spark, folder), ["doc_id", "sent_idx"], k=2).select("doc_id", "sent_idx", "type", "rank", "key")


@query
def triples_min(spark, folder):
    return extract.triples_by_least(active(spark, folder), ["doc_id", "sent_idx"]).select("doc_id", "sent_idx", "subject", "predicate", "object", r("confidence"))


@query
def triples_geomean(spark, folder):
    return extract.triples_by_mean(active(spark, folder), ["doc_id", "sent_idx"]).select("doc_id", "sent_idx", "subject", "predicate", "object", r("confidence"))


@query
def idf_specificity(spark, folder):
    return extract.specificity(extract.listed(active(spark, folder), []), table(spark, folder, "documents").count()).select("key", "df", r("specificity"))


@query
def text_facts(spark, folder):
    """Facts of the documents with all their columns."""
    found = extract.text_facts(table(spark, folder, "documents"), inputs.anchors(spark))
    return found.select(
        "doc_id", "sent_idx", "fact_id", "subject", "predicate", "object", "polarity", "tense", "precision", F.map_keys("spans").alias("spans"), F.map_values("support").alias("support"),
        F.size("locations").alias("n_locations"), F.col("object_meta")["parent"].alias("object_parent"), r("importance_score"),
    )


@query
def observed_facts(spark, folder):
    """Facts of the documents, read as observations."""
    found = extract.observed_facts(table(spark, folder, "documents"), inputs.anchors(spark))
    return found.select("doc_id", "sent_idx", "subject", "predicate", "object", r("confidence"), r(scores.composite(F.col("importance")), "importance"))


@query
def spoke_edges(spark, folder):
    rows = events(spark, folder).withColumn("fact_id", F.concat(F.lit("e"), F.col("seq").cast("string")))
    return extract.spokes(rows).groupBy("edge_type", F.col("source").substr(1, 1).alias("kind")).agg(F.count(F.lit(1)).alias("n"), r(F.sum("weight"), "weight"))


# retrieval


def scored(spark, folder, persona):
    rows = folded(spark, folder).join(F.broadcast(spark.createDataFrame(list(inputs.PREDICATES), "predicate string, named string")), "predicate")
    rows = rows.withColumn("predicate", F.col("named")).drop("named").withColumn("reinforcement", F.least(F.lit(1.0), F.col("reinforcement_count") / 10))
    return retrieve.relevance(rows, retrieve.expanded(inputs.query(spark), closure(inputs.parents(spark))), valences(spark), persona)


@query
def retrieve_ranked(spark, folder):
    return retrieve.ranked(scored(spark, folder, None), 50).select("subject", "predicate", "object", "polarity", r("score"))


@query
def retrieve_persona(spark, folder):
    return retrieve.ranked(scored(spark, folder, "regulator"), 50).select("subject", "predicate", "object", "polarity", r("valence"), r("score"))


@query
def retrieve_context(spark, folder):
    hits = retrieve.ranked(scored(spark, folder, "engineer"), 20)
    return retrieve.context(hits, consolidate.next_edges(events(spark, folder))).select("hit", "other", r("weight"))


def rich(spark, folder):
    """Event facts with what ranked search reads."""
    tense_ = F.when(F.col("seq") % 3 == 0, "future").when(F.col("seq") % 3 == 1, "present_continuous").otherwise("past")
    names = F.create_map(*[F.lit(x) for pair in (("signup", "launch"), ("error", "recall"), ("click", "grow"), ("view", "trend"), ("purchase", "invest")) for x in pair])
    return events(spark, folder).withColumn("predicate", names[F.col("predicate")]).withColumn("importance_score", F.col("confidence") * 0.3 + 0.2).withColumn("tense", tense_)


def kinds(spark, folder):
    rows = events(spark, folder)
    user, k = (rows.select(F.col(c).alias("key"), F.lit(t).alias("type")).distinct() for c, t in (("subject", "actor"), ("object", "feature")))
    return user.unionByName(k).unionByName(spark.createDataFrame([(p, "relation") for p in ("launch", "recall", "grow", "trend", "invest")], "key string, type string"))


@query
def search_ranked(spark, folder):
    found = retrieve.search(rich(spark, folder), inputs.query(spark), kinds(spark, folder), focus(spark), "investor", inputs.now(), 40)
    return found.select("seq", r("valence"), r("salience"), r("urgency"), r("recency"), r("rank_score"))


@query
def search_contrary(spark, folder):
    found = retrieve.search(rich(spark, folder), inputs.query(spark), kinds(spark, folder), focus(spark), "engineer", inputs.now(), 40, contrary=True)
    return found.select("seq", "polarity", r("valence"), r("rank_score"))


@query
def persona_detect(spark, folder):
    return retrieve.persona_scores(inputs.query(spark), kinds(spark, folder), focus(spark)).select("persona", r("score"))


@query
def persona_cues(spark, folder):
    rows = spark.createDataFrame([(0, "What are the RISKS?"), (1, "new patents"), (2, "Market share of toyota"), (3, "which policy"), (4, "weather")], "id int, q string")
    return rows.select("id", text.persona_of_text(F.col("q")).alias("persona"))


@query
def chain_walk(spark, folder):
    edges = consolidate.next_edges_by_role(events(spark, folder), of=("subject",))
    starts = events(spark, folder).groupBy(F.col("subject").alias("anchor")).agg(F.min_by("seq", F.struct("timestamp", "seq")).alias("source")).select("source", "anchor")
    return retrieve.chains(starts, edges, 10).select("start", "anchor", "step", "node")


@query
def timeline(spark, folder):
    return retrieve.timeline(retrieve.ranked(scored(spark, folder, None), 30)).select("place", "seq")


@query
def constraint_lookup(spark, folder):
    wanted = spark.createDataFrame([("subject", "user_1"), ("object", "k_3"), ("predicate", "purchase")], "role string, anchor string")
    rows = consolidate.constraints_by_documents(events(spark, folder).withColumn("doc_id", F.to_date("timestamp")))
    rows = rows.withColumn("score", F.round("score", 9))
    return retrieve.constraint_lookup(rows, wanted).select("subject", "predicate", "object", r("score"))


# belief


def simple_masses(spark, folder):
    return events(spark, folder).select("seq", "predicate", "polarity", "confidence", (F.col("seq") % 7 / 6).alias("s"), (F.col("seq") % 5 / 4).alias("p"), (F.col("seq") % 3 / 2).alias("o"), F.when(F.col("seq") % 4 > 0, F.col("seq") % 4 / 3).alias("competing"))


def mass_columns(m: Column) -> list[Column]:
    return [r(m[n], n) for n in belief.NAMES]


@query
def mass_polarity(spark, folder):
    return simple_masses(spark, folder).select("seq", *mass_columns(belief.from_polarity(F.col("polarity"), F.col("confidence"))))


@query
def mass_alignment(spark, folder):
    return simple_masses(spark, folder).select("seq", *mass_columns(belief.from_alignment(F.col("s"), F.col("p"), F.col("o"), F.col("polarity"))))


@query
def mass_distance(spark, folder):
    return simple_masses(spark, folder).select("seq", *mass_columns(belief.from_distance(F.col("s"), F.col("p"), F.col("o"), F.col("competing"))))


@query
def mass_confidence(spark, folder):
    return simple_masses(spark, folder).select("seq", *mass_columns(belief.from_confidence(F.col("confidence"))))


@query
def mass_logits(spark, folder):
    """A classifier's logits as masses."""
    rows = events(spark, folder).select("seq", belief.from_logits(F.col("seq") % 7 / 2, F.col("seq") % 5 / 2, F.col("seq") % 3 / 2).alias("m"))
    return rows.select("seq", *mass_columns(F.col("m")))


@query
def pignistic(spark, folder):
    """Chances, plausibility and entropy of masses."""
    rows = simple_masses(spark, folder).select("seq", belief.from_polarity(F.col("polarity"), F.col("confidence")).alias("m"))
    chances = belief.pignistic(F.col("m"))
    return rows.select("seq", *[r(chances[n], n) for n in ("s", "r", "u")], r(belief.plausibility(F.col("m"), "s"), "plausible"), r(belief.entropy(F.col("m")), "entropy"))


@query
def ucb_scores(spark, folder):
    rows = simple_masses(spark, folder).withColumn("visits", F.col("seq") % 9)
    return rows.select("seq", r(F.when(F.col("visits") > 0, belief.ucb(F.col("confidence"), F.lit(50.0), F.col("visits"), SEARCH["exploration"])), "ucb"), (belief.ucb(F.col("confidence"), F.lit(50.0), F.col("visits"), 1.4) == float("inf")).alias("unvisited"))


@query
def valence(spark, folder):
    """Valence of every fact for each persona."""
    rows = rich(spark, folder).join(F.broadcast(focus(spark)))
    value = retrieve.valence_of(F.col("predicate"), F.col("confidence"), F.col("polarity"), F.col("positive"), F.col("negative"))
    return rows.groupBy("persona", "predicate").agg(F.count(F.lit(1)).alias("n"), r(F.min(value), "least"), r(F.max(value), "most"))


@query
def dempster_combine(spark, folder):
    """All facts of a day and event type, fused, with pignistic chances."""
    rows = events(spark, folder).withColumn("m", belief.combine(belief.from_polarity(F.col("polarity"), F.col("confidence")), belief.from_confidence(F.col("confidence"))))
    few = rows.groupBy(F.to_date("timestamp").alias("day"), "subject").agg(belief.combine_rows(F.col("m")).alias("m"))
    return few.select("day", "subject", *mass_columns(F.col("m")), *[r(belief.pignistic(F.col("m"))[n], f"pig_{n}") for n in ("s", "r", "u")])


@query
def verify_claims(spark, folder):
    """Each benchmark text as a claim, over the facts of the documents."""
    anchors = inputs.anchors(spark)
    claims = extract.activations(table(spark, folder, "benchmark").select(F.col("item_id").alias("claim_id"), F.col("text").alias("sentence")), anchors, ["claim_id"]).select("claim_id", F.col("key").alias("anchor"), (F.col("activation") / 4).alias("activation"))
    found = extract.triples_by_mean(active(spark, folder), ["doc_id", "sent_idx"])
    rows = found.select((F.col("doc_id") * 1000000 + F.col("sent_idx") * 100).alias("_d"), "subject", "predicate", "object", "confidence", (F.col("sent_idx") % 4 != 0).alias("polarity"))
    rows = rows.withColumn("seq", F.concat_ws(":", F.col("_d").cast("string"), "subject", "predicate", "object")).withColumn("importance_score", F.round("confidence", 9)).drop("_d")
    return verify.verify(claims, rows, anchors.select("key", "type")).select("claim_id", r("belief_supports"), r("belief_refutes"), r("belief_uncertain"), "n_evidence", "label")


# imagination and search


def few_facts(spark, folder):
    return rich(spark, folder).select("seq", "subject", "predicate", "object", "polarity", "timestamp", "confidence")


def triple_constraints(spark, folder):
    rows = rich(spark, folder).withColumn("doc_id", F.to_date("timestamp"))
    return consolidate.constraints_by_documents(rows).select("subject", "predicate", "object", "strength", "persistence")


@query
def mutants_polarity(spark, folder):
    return imagine.named(imagine.polarity_flips(few_facts(spark, folder))).select("seq", "polarity", "imagined_id")


@query
def mutants_predicate(spark, folder):
    return imagine.predicate_changes(few_facts(spark, folder), kinds(spark, folder)).select("seq", "predicate")


@query
def mutants_hierarchy(spark, folder):
    related = imagine.relatives(inputs.parents(spark).withColumn("type", F.lit("actor")))
    return imagine.hierarchy_moves(few_facts(spark, folder), related).groupBy("seq").agg(F.count(F.lit(1)).alias("n"), F.min("subject").alias("first"))


@query
def mutants_temporal(spark, folder):
    return imagine.projections(few_facts(spark, folder)).select("seq", minutes().alias("ts_us"))


@query
def mutants_recombine(spark, folder):
    return imagine.recombinations(few_facts(spark, folder)).select("seq", "subject", "predicate", "object")


@query
def fitness(spark, folder):
    mutants = imagine.polarity_flips(few_facts(spark, folder))
    found = imagine.scored(mutants, few_facts(spark, folder), kinds(spark, folder), triple_constraints(spark, folder), "investor")
    return found.select("seq", r("logic_penalty"), r("whisper"), r("bridge"), r("persona_align"), r("fitness"))


@query
def imagine_verdict(spark, folder):
    """The verdict over the fittest flips."""
    mutants = imagine.polarity_flips(few_facts(spark, folder))
    found = imagine.scored(mutants, few_facts(spark, folder), kinds(spark, folder), triple_constraints(spark, folder), "investor")
    found = found.withColumn("fitness", F.round("fitness", 6)).withColumn("logic_penalty", F.round("logic_penalty", 6))
    best = found.orderBy(F.desc("fitness"), "seq").limit(20)
    return imagine.verdict(best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("fitness"), "seq")))).select("n", "fit", r("penalty"), "verdict")  # 20 rows


def _shared(spark: SparkSession, prefix: str) -> str:
    """The shared folder of the session; a temporary one where all runs on one machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return tempfile.mkdtemp(prefix=prefix)


def _cut(spark: SparkSession):
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(_shared(spark, "checkpoint-"))
    return lambda df: df.checkpoint()


@query
def imagine_topk(spark, folder):
    related = imagine.relatives(inputs.parents(spark).withColumn("type", F.lit("actor")))
    seeds = few_facts(spark, folder).orderBy(F.desc("confidence"), "seq").limit(20)
    best, _ = imagine.imagine(seeds, few_facts(spark, folder), kinds(spark, folder), related, triple_constraints(spark, folder), _cut(spark), "investor")
    return best.select("imagined_id", "subject", "predicate", "object", "polarity", r("fitness"))


@query
def mcts_root(spark, folder):
    rows = rich(spark, folder)
    near = reason.neighbourhood(rows, inputs.query(spark).where("activation > 0.1").limit(8), 20)
    return near.select("anchor", "seq", "place")


@query
def reason_verdict(spark, folder):
    edges = consolidate.next_edges_by_role(events(spark, folder)).where("anchor_role <> 'predicate'").select("source", "target", "anchor")
    found, _ = reason.search(inputs.query(spark), rich(spark, folder), edges)
    return spark.createDataFrame([found]).select("label", r("belief_supports"), r("belief_refutes"), r("belief_uncertain"), "n_nodes", "n_facts", "iterations")


# discovery


def talk_tokens(spark, folder):
    rows = table(spark, folder, "conversations").select("conv_id", "turn", "text")
    return discover.unit_tokens(rows, ["conv_id", "turn"], "text")


@query
def token_freq(spark, folder):
    return talk_tokens(spark, folder).groupBy("token").agg(F.count(F.lit(1)).alias("n"))


@query
def top_f_tokens(spark, folder):
    return discover.frequent(talk_tokens(spark, folder))


@query
def cooccurrence(spark, folder):
    tokens = talk_tokens(spark, folder)
    return discover.cooccurrence(tokens, ["conv_id", "turn"], discover.frequent(tokens))


def related_tokens(spark, folder):
    tokens = talk_tokens(spark, folder)
    vocabulary = discover.frequent(tokens)
    n = tokens.select("conv_id", "turn").distinct().count()
    return discover.npmi(discover.cooccurrence(tokens, ["conv_id", "turn"], vocabulary), vocabulary, n), vocabulary


@query
def npmi(spark, folder):
    return related_tokens(spark, folder)[0].select("t1", "t2", r("npmi"))


@query
def laplacian_entries(spark, folder):
    return discover.laplacian(related_tokens(spark, folder)[0]).select("t1", "t2", r("value"))


@query
def discover_clusters(spark, folder):
    edges, vocabulary = related_tokens(spark, folder)
    return discover.labels(discover.clusters(edges, vocabulary, 50), vocabulary)


# code

PYTHON_SOURCE = b'import os\nfrom db import connect\n\n\nclass QueryError(Exception):\n    pass\n\n\n@audit\ndef save(self, row):\n    self.rows = connect(row)\n    if not row:\n        raise QueryError("empty")\n    return True\n'
SCRIPT_SOURCE = b'import { find } from "./db";\nclass AuthError extends Error {\n  constructor(m) { super(m); this.name = m; }\n  login(user) { const row = find(user); if (!row) { throw new AuthError(user); } return row; }\n}\n'


def _files(spark, *rows):
    return spark.createDataFrame([(p, bytearray(c)) for p, c in rows], "path string, content binary")


@query
def ast_python(spark, folder):
    return code.code_facts(_files(spark, ("src/store.py", PYTHON_SOURCE), ("src/notes.md", b"# none"))).select("subject", "predicate", "object", "line_number")


@query
def ast_js(spark, folder):
    return code.code_facts(_files(spark, ("src/auth.ts", SCRIPT_SOURCE))).select("subject", "predicate", "object", "line_number")


# streams


def _streamed(spark, folder, make, mode="append"):
    from ..streaming import streams

    base = f"{_shared(spark, 'stream-')}/{uuid.uuid4().hex}"
    rows = spark.read.parquet(f"{folder}/events.parquet")
    rows.repartitionByRange(4, "ts").sortWithinPartitions("ts").write.parquet(f"{base}/in")
    streams.run(make(streams, streams.event_stream(spark, f"{base}/in", files_per_batch=4)), f"{base}/out", f"{base}/state", mode)
    return spark.read.parquet(f"{base}/out")


@query
def stream_tumbling_counts(spark, folder):
    return _streamed(spark, folder, lambda m, s: m.daily_counts(s)).select(F.unix_micros("day").alias("day_us"), "predicate", "n")


@query
def stream_dedup_watermark(spark, folder):
    return _streamed(spark, folder, lambda m, s: m.first_sightings(s)).groupBy("predicate").agg(F.count(F.lit(1)).alias("n"))


@query
def stream_session_chains(spark, folder):
    return _streamed(spark, folder, lambda m, s: m.sessions(s)).select("subject", F.unix_micros("start").alias("start_us"), "n")


@query
def stream_upsert(spark, folder):
    from ..streaming import streams

    base = f"{_shared(spark, 'stream-')}/{uuid.uuid4().hex}"
    spark.read.parquet(f"{folder}/events.parquet").repartitionByRange(3, "event_id").write.parquet(f"{base}/in")
    kept: list[str] = []

    def save(rows: DataFrame) -> None:
        target = f"{base}/state-{uuid.uuid4().hex}"  # a batch that is run again writes beside what it left
        rows.write.parquet(target)
        kept.append(target)

    streams.upserts(streams.event_stream(spark, f"{base}/in", 1), lambda: spark.read.parquet(kept[-1]) if kept else None, save, f"{base}/check")
    return spark.read.parquet(kept[-1]).select(*facts.KEY, "reinforcement_count", r("confidence"))
