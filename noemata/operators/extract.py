"""From sentences to facts: lexical activation of anchors, ranking by type or role, triples."""

from __future__ import annotations

from collections import Counter, defaultdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..fixed import ACTIVATION, LEAST_CONFIDENCE, OBSERVED_IMPORTANCE, ROLE_ACTIVATION, TOP_BY_ROLE, TOP_BY_TYPE
from ..functions import scores, text
from ..schema import HIERARCHY_FIELDS, closure, grounding, role_of_type

ROLES = ("subject", "predicate", "object")


def tokens_of(anchors: DataFrame) -> DataFrame:
    """key, type, token: anchors are small and are broadcast."""
    return anchors.select("key", "type", F.explode("tokens").alias("token")).withColumn("token", F.lower("token"))


def activations(units: DataFrame, anchors: DataFrame, unit: list[str], column: str = "sentence") -> DataFrame:
    """unit columns, key, type, activation: the most that an anchor's tokens occur, as ln(1 + count). Tokens of several words match as phrases.

    This is the lexical encoder: it has the shape of a sparse neural one (log-saturated, max-pooled over tokens) without the
    expansion. Units are tokenised once and joined with the broadcast vocabulary, so nothing is compared pairwise.
    """
    vocabulary = tokens_of(anchors)
    words = units.select(*unit, F.explode(F.regexp_extract_all(F.lower(F.col(column)), F.lit(r"[a-z0-9_']+"), F.lit(0))).alias("token"))
    counted = words.join(F.broadcast(vocabulary.where(~F.col("token").contains(" "))), "token").groupBy(*unit, "key", "type", "token").count()
    phrases = vocabulary.where(F.col("token").contains(" "))
    if phrases.take(1):
        padded = F.concat(F.lit(" "), F.array_join(F.regexp_extract_all(F.lower(F.col(column)), F.lit(r"[a-z0-9_']+"), F.lit(0)), " "), F.lit(" "))
        gathered = F.collect_list(F.struct("key", "type", "token"))
        with_phrases = units.select(*unit, padded.alias("_p")).join(F.broadcast(phrases.agg(gathered.alias("_all"))))
        hit = F.filter("_all", lambda x: F.contains(F.col("_p"), F.concat(F.lit(" "), x["token"], F.lit(" "))))
        found = with_phrases.select(*unit, "_p", F.inline(hit)).withColumn("count", ((F.length("_p") - F.length(F.replace(F.col("_p"), F.concat(F.lit(" "), F.col("token"), F.lit(" "))))) / (F.length("token") + 2)).cast("long"))
        counted = counted.unionByName(found.select(*unit, "key", "type", "token", "count"))
    return counted.groupBy(*unit, "key", "type").agg(F.max(F.log1p(F.col("count"))).alias("activation"))


def _made(fields: dict) -> Column:
    return F.struct(*[v.alias(k) for k, v in fields.items()])


def active_in(sentence: Column, anchors: DataFrame) -> Column:
    """Array of (key, type, activation): what activations() has for a unit, from its own row. The vocabulary is small and goes into the expression."""
    words_of, phrases = defaultdict(Counter), []
    for key, kind, token in sorted(tokens_of(anchors).where("token IS NOT NULL").collect()):
        if " " in token:
            phrases.append((key, kind, token))
        else:
            words_of[token][key, kind] += 1
    hit = lambda key, kind, n: _made({"key": key, "type": kind, "less": -n.cast("long")})
    none = F.array().cast("array<struct<key: string, type: string, less: bigint>>")

    def of(words: Column) -> Column:
        found = none
        if words_of:
            entries = [x for t, named in words_of.items() for x in (F.lit(t), F.array(*[_made({"key": F.lit(k), "type": F.lit(t_), "times": F.lit(n)}) for (k, t_), n in named.items()]))]
            of_token = F.create_map(*entries)
            count = lambda kept, t: F.size(F.filter(kept, lambda w: w == t))
            hits = lambda kept: F.flatten(F.transform(F.array_distinct(kept), lambda t: text.bound(count(kept, t), lambda n: F.transform(of_token[t], lambda a: hit(a["key"], a["type"], a["times"] * n)))))
            found = text.bound(F.filter(words, lambda w: w.isin(*words_of)), lambda kept: F.when(F.size(kept) > 0, hits(kept)).otherwise(none))
        if phrases:
            listed = F.array(*[_made({"key": F.lit(k), "type": F.lit(t_), "token": F.lit(f" {t} "), "n": F.lit(len(t) + 2)}) for k, t_, t in phrases])
            times = lambda line, x: (F.length(line) - F.length(F.replace(line, x["token"], F.lit("")))) / x["n"]
            said = lambda line: F.transform(F.filter(listed, lambda x: F.contains(line, x["token"])), lambda x: hit(x["key"], x["type"], times(line, x)))
            found = F.concat(found, text.bound(F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" ")), said))
        return found

    same = lambda x, y: (x["key"] == y["key"]) & (x["type"] == y["type"])
    most = lambda hits: F.filter(hits, lambda x, i: (i == 0) | ~same(F.get(hits, i - 1), x))
    words = F.regexp_extract_all(F.lower(sentence), F.lit(r"[a-z0-9_']+"), F.lit(0))
    counted = text.bound(F.sort_array(text.bound(words, of)), most)
    return F.transform(counted, lambda x: _made({"key": x["key"], "type": x["type"], "activation": F.log1p(-x["less"])}))


def encoded(documents: DataFrame, anchors: DataFrame, doc: str = "doc_id") -> DataFrame:
    """doc, sent_idx, sentence, active (key, type, activation) of each sentence of documents (doc, text).

    A sentence is worked out within its row, so nothing is shuffled. Only documents that share an id, whose sentences of one
    place count together, are grouped.
    """
    rows = documents.select(doc, "text")
    shared = rows.groupBy(doc).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(F.col(doc).alias("_doc"))
    alone = lambda df: text.sentences(df).withColumn("active", active_in(F.col("sentence"), anchors))
    if not shared.take(1):
        return alone(rows)
    is_shared = rows[doc].eqNullSafe(shared["_doc"])
    together, unit = text.sentences(rows.join(shared, is_shared, "left_semi")), [doc, "sent_idx"]
    active = activations(together, anchors, unit).groupBy(*unit).agg(F.collect_list(F.struct("key", "type", "activation")).alias("active"))
    active = active.select(F.col(doc).alias("_doc"), F.col("sent_idx").alias("_at"), "active")
    met = together.groupBy(*unit).agg(F.collect_list("sentence").alias("sentences")).join(active, F.col(doc).eqNullSafe(F.col("_doc")) & (F.col("sent_idx") == F.col("_at")))
    first = met.select(*unit, F.get("sentences", F.lit(0)).alias("sentence"), "active", F.slice("sentences", 2, F.size("sentences")).alias("others"))
    return alone(rows.join(shared, is_shared, "left_anti")).withColumn("others", F.array().cast("array<string>")).unionByName(first)


def listed(active: DataFrame, unit: list[str]) -> DataFrame:
    """unit columns, key, type, activation of what encoded() gives."""
    return active.select(*unit, F.inline(F.concat("active")))


def _best(active: Column, by: Column, value: str, k: int) -> Column:
    """The k of the largest value of each by, ties by key, in turn: the entries with by and rank. Within the row."""
    sorted_ = F.sort_array(F.transform(active, lambda x: _made({"by": by(x), "less": -x[value], "key": x["key"], "x": x})))
    ranks = lambda rows: text.bound(F.transform(rows, lambda x: x["by"]), lambda bys: F.transform(rows, lambda x, i: _made({"by": x["by"], "rank": (i + 2 - F.array_position(bys, x["by"])).cast("int"), "x": x["x"]})))
    return F.filter(text.bound(sorted_, ranks), lambda x: x["rank"] <= k)


def _best_by_type(k: int, least: float) -> Column:
    return _best(F.filter("active", lambda x: x["activation"] >= least), lambda x: x["type"], "activation", k)


def _shares(active: Column) -> Column:
    """activation over the unit's largest (1 where that is 0) beside it."""
    most = lambda a: F.array_max(F.transform(a, lambda x: x["activation"]))
    share = lambda a: text.bound(most(a), lambda m: F.transform(a, lambda x: _made({"key": x["key"], "type": x["type"], "activation": x["activation"], "share": x["activation"] / F.when(m > 0, m).otherwise(F.lit(1.0))})))
    return text.bound(active, share)


def _best_by_role(k: int = TOP_BY_ROLE, least: float = ROLE_ACTIVATION) -> Column:
    return _best(F.filter(_shares(F.col("active")), lambda x: x["activation"] >= least), lambda x: role_of_type(x["type"]), "share", k)


def best_by_type(active: DataFrame, unit: list[str], k: int = TOP_BY_TYPE, least: float = ACTIVATION) -> DataFrame:
    found = F.transform(_best_by_type(k, least), lambda x: _made({"key": x["x"]["key"], "type": x["by"], "activation": x["x"]["activation"], "rank": x["rank"]}))
    return active.select(*unit, F.inline(found))


def normalised(active: DataFrame, unit: list[str]) -> DataFrame:
    """key, type, activation and share: activation over the unit's largest."""
    return active.select(*unit, F.inline(_shares(F.col("active"))))


def best_by_role(active: DataFrame, unit: list[str], k: int = TOP_BY_ROLE, least: float = ROLE_ACTIVATION) -> DataFrame:
    found = F.transform(_best_by_role(k, least), lambda x: _made({"key": x["x"]["key"], "type": x["x"]["type"], "activation": x["x"]["activation"], "share": x["x"]["share"], "role": x["by"], "rank": x["rank"]}))
    return active.select(*unit, F.inline(found))


def _three(ranked: Column, tests: tuple, value: str, confidence, kept) -> Column:
    """Subjects, predicates and objects of a unit met within its row, at most k ** 3 entries: the three, their values and the confidence."""

    def met(rows: Column) -> Column:
        subjects, predicates, objects = (F.filter(rows, t) for t in tests)
        entry = lambda s, p, o: _made({"subject": s["x"]["key"], "predicate": p["x"]["key"], "object": o["x"]["key"], **{f"{r}_activation": x["x"][value] for r, x in zip(ROLES, (s, p, o), strict=True)}, "confidence": confidence(*(x["x"][value] for x in (s, p, o)))})
        every = F.flatten(F.transform(subjects, lambda s: F.flatten(F.transform(predicates, lambda p: F.transform(objects, lambda o: entry(s, p, o))))))
        return F.filter(every, kept)

    return text.bound(ranked, met)


def _triples_by_least() -> Column:
    tests = (lambda x: x["by"] == "actor", lambda x: x["by"] == "relation", lambda x: x["by"].isin("actor", "feature"))
    return _three(_best_by_type(TOP_BY_TYPE, ACTIVATION), tests, "activation", lambda *v: scores.confidence_of_least(F.least(*v)), lambda x: x["subject"] != x["object"])


def _triples_by_mean() -> Column:
    tests = (lambda x: x["by"] == "subject", lambda x: x["by"] == "predicate", lambda x: x["by"] == "object")
    return _three(_best_by_role(), tests, "share", scores.geometric, lambda x: x["confidence"] >= LEAST_CONFIDENCE)


def triples_by_least(active: DataFrame, unit: list[str]) -> DataFrame:
    """actor x relation x (actor or feature), subject unlike object; confidence from the least activation."""
    return active.select(*unit, F.inline(_triples_by_least()))


def triples_by_mean(active: DataFrame, unit: list[str]) -> DataFrame:
    """Best of each role; confidence the geometric mean of the shares."""
    return active.select(*unit, F.inline(_triples_by_mean()))


def _with_triples(active: DataFrame, doc: str, triples: Column) -> DataFrame:
    """doc, sent_idx, sentence and triples of the sentences that have any; documents without id have none. A generator, so triples are worked out once and before what reads them."""
    rows = active.where(F.col(doc).isNotNull())
    sentences = F.concat(F.array("sentence"), "others") if "others" in active.columns else F.array("sentence")
    found = lambda t: F.transform(F.when(F.size(t) > 0, sentences).otherwise(F.array().cast("array<string>")), lambda s: _made({"sentence": s, "triples": t}))
    return rows.select(doc, "sent_idx", F.inline(text.bound(triples, found)))


def specificity(active: DataFrame, n_documents: int, least: float = ROLE_ACTIVATION) -> DataFrame:
    """key, df, specificity: log1p(documents / (1 + units where active)), over the largest of all. active: key, activation."""
    counted = active.groupBy("key").agg(F.sum((F.col("activation") > least).cast("long")).alias("df"))
    idf = F.log1p(F.lit(float(n_documents)) / (1 + F.col("df")))
    rows = counted.withColumn("idf", idf)
    return rows.crossJoin(F.broadcast(rows.agg(F.max("idf").alias("_most")))).select("key", "df", (F.col("idf") / (F.col("_most") + 1e-8)).alias("specificity"))  # one row


def spokes(facts: DataFrame) -> DataFrame:
    """source, target, edge_type: what initiates, is asserted, is targeted, and where it is located."""
    ends = F.array(
        F.struct(F.col("subject").alias("source"), F.col("fact_id").alias("target"), F.lit("INITIATES").alias("edge_type")),
        F.struct(F.col("fact_id").alias("source"), F.col("predicate").alias("target"), F.lit("ASSERTS").alias("edge_type")),
        F.struct(F.col("fact_id").alias("source"), F.col("object").alias("target"), F.lit("TARGETS").alias("edge_type")),
    )
    out = facts.select(F.inline(ends), F.col("confidence").alias("weight"))
    if "locations" in facts.columns:
        out = out.unionByName(facts.select(F.col("fact_id").alias("source"), F.explode("locations.name").alias("target"), F.lit("LOCATED_AT").alias("edge_type"), F.col("confidence").alias("weight")))
    return out


def locations(*metas: F.Column) -> F.Column:
    """Distinct countries of the roles' attributes, as inferred locations."""
    found = F.filter(F.array(*[F.struct(m["country_code"].alias("cc"), F.coalesce(m["macro_region"], F.lit("")).alias("mr")) for m in metas]), lambda x: x["cc"].isNotNull())
    codes = F.array_distinct(F.transform(found, lambda x: x["cc"]))
    first = lambda c: F.get(F.filter(found, lambda x: x["cc"] == c), F.lit(0))["mr"]
    return F.transform(codes, lambda c: F.struct(c.alias("name"), F.lit("country").alias("level"), c.alias("country_code"), first(c).alias("macro_region"), F.lit(0.5).alias("confidence"), F.lit("inferred").alias("source")))


def details(anchors: DataFrame) -> DataFrame:
    """key, tokens, pattern (of its tokens' span), below (tokens of its descendants), meta (type and place in the hierarchy): what a fact says about each of its anchors. As small as the vocabulary."""
    up = F.when(F.col("parent").isNotNull(), F.create_map(F.lit("parent"), F.col("parent"))).otherwise(F.create_map().cast("map<string, string>"))
    own = F.map_filter(F.coalesce("attrs", F.create_map().cast("map<string, string>")), lambda k, v: k.isin(*[f for f in HIERARCHY_FIELDS if f != "parent"]))
    rows = anchors.select("key", "tokens", text.longest_token_pattern(F.col("tokens")).alias("pattern"), F.map_concat(up, own, F.create_map(F.lit("type"), F.col("type"))).alias("meta"))
    lower = closure(anchors).where("depth > 0").join(anchors.select(F.col("key").alias("descendant"), "tokens"), "descendant")
    gathered = lower.groupBy(F.col("ancestor").alias("key")).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("tokens")))).alias("below"))
    return rows.join(gathered, "key", "left").withColumn("below", F.coalesce("below", F.array().cast("array<string>")))


def _described(found: DataFrame, about: DataFrame) -> DataFrame:
    """found with _subject, _predicate and _object: details of each role's anchor."""
    for r in ROLES:
        found = found.join(F.broadcast(about.select(F.col("key").alias(r), F.struct(*[c for c in about.columns if c != "key"]).alias(f"_{r}"))), r)
    return found


def text_facts(documents: DataFrame, anchors: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Facts of documents (doc, text): triples by geometric mean with all that a fact holds: ids, polarity, tense, temporal references, spans,
    support, attributes of its anchors, locations and importance. Specificity counts over all documents given."""
    active = encoded(documents, anchors, doc)
    rarity = specificity(listed(active, []), documents.count()).select("key", "specificity")
    sentence, refs = F.col("sentence"), F.col("temporal_refs")
    said = _with_triples(active, doc, _triples_by_mean()).select("*", text.affirmed(sentence).alias("polarity"), text.tense(sentence).alias("tense"), text.temporal_refs(sentence).alias("temporal_refs"))
    found = said.select(*[c for c in said.columns if c != "triples"], F.inline("triples"))
    found = _described(found, details(anchors).join(rarity, "key", "left"))
    specific = sum((F.coalesce(F.col(f"_{r}.specificity"), F.lit(0.0)) for r in ROLES), F.lit(0.0)) / 3
    spans = F.map_filter(F.create_map(*[x for r in ROLES for x in (F.lit(r), text.span_of(sentence, F.col(f"_{r}.pattern")))]), lambda k, v: v.isNotNull())
    support = F.create_map(*[x for r in ROLES for x in (F.lit(r), text.support(sentence, F.col(f"_{r}.tokens"), F.col(f"_{r}.below")))])
    metas = [F.col(f"_{r}.meta") for r in ROLES]
    parts = [F.col("confidence").alias("activation"), F.lit(0.0).alias("coherence"), specific.alias("specificity"), F.lit(1.0).alias("novelty"), F.lit(0.5).alias("reinforcement")]
    return found.select(
        text.fact_id(F.col(doc), F.col("sent_idx"), F.col("subject"), F.col("predicate"), F.col("object")).alias("fact_id"),
        "subject", "predicate", "object", "polarity", "confidence", F.col(doc).cast("string").alias("doc_id"), "sent_idx", "sentence",
        "tense", F.lit("simple").alias("aspect"), "temporal_refs", text.precision(refs).alias("precision"),
        spans.alias("spans"), support.alias("support"), *[m.alias(f"{r}_meta") for m, r in zip(metas, ROLES, strict=True)], locations(*metas).alias("locations"),
        F.struct(*parts).alias("importance"), scores.importance(F.col("confidence"), F.lit(0.0), specific, F.lit(1.0)).alias("importance_score"),
        grounding("text", doc_id=F.col(doc), sent_id=F.col("sent_idx"), char_start=F.lit(0), char_end=F.length("sentence"), sentence_text=sentence).alias("grounding"),
    )


def observed_facts(documents: DataFrame, anchors: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Facts of observations (doc, text): triples by the least activation, polarity by the window before the predicate's span."""
    said = _with_triples(encoded(documents, anchors, doc), doc, _triples_by_least())
    found = said.select(*[c for c in said.columns if c != "triples"], F.inline("triples"))
    found = found.join(F.broadcast(anchors.select(F.col("key").alias("predicate"), F.col("tokens").alias("_tokens"))), "predicate")
    span = text.first_token_span(F.col("sentence"), F.col("_tokens"))
    parts = [F.col("confidence").alias("activation"), *[F.lit(v).alias(n) for n, v in OBSERVED_IMPORTANCE]]
    return found.withColumn("_span", span).select(
        text.fact_id(F.col(doc), F.col("sent_idx"), F.col("subject"), F.col("predicate"), F.col("object")).alias("fact_id"),
        "subject", "predicate", "object", (~text.negated_before(F.col("sentence"), F.col("_span.start"), F.col("_span.end"))).alias("polarity"), "confidence",
        F.col(doc).cast("string").alias("doc_id"), "sent_idx", "sentence", F.lit("present").alias("tense"), F.lit("simple").alias("aspect"), F.struct(*parts).alias("importance"),
        grounding("text", doc_id=F.col(doc), sent_id=F.col("sent_idx"), char_start=F.lit(0), char_end=F.length("sentence"), sentence_text=F.col("sentence")).alias("grounding"),
    )
