"""Numeric goldens and behaviour of the engine on small fixtures."""

import math
from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from noemata.functions import belief, scores, text
from noemata.operators import consolidate, extract, facts, imagine, retrieve, verify
from noemata.schema import SchemaError, Vocabulary, closure, valences
from noemata.sources import files
from noemata.sources.code import Registry, code_facts, javascript_rows, python_rows
from noemata.store import ConcurrentWriteError, KnowledgeBase

T0 = datetime(2024, 1, 1, 12)
FACTS = "seq int, subject string, predicate string, object string, polarity boolean, confidence double, timestamp timestamp"


def rows(spark, *facts_):
    return spark.createDataFrame([(i, *f[:3], f[3] if len(f) > 3 else True, f[4] if len(f) > 4 else 0.9, f[5] if len(f) > 5 else T0 + timedelta(hours=i)) for i, f in enumerate(facts_)], FACTS)


def test_upsert_counts_and_averages(spark):
    one = facts.upsert_fold(rows(spark, ("a", "p", "b", True, 0.8), ("a", "p", "b", True, 0.9), ("a", "p", "b", False, 0.5))).orderBy("polarity").collect()
    assert [(r.reinforcement_count, round(r.confidence, 6)) for r in one] == [(1, 0.5), (2, 0.85)]


def test_upsert_in_batches_is_the_same(spark):
    whole = rows(spark, *[("a", "p", f"b{i % 3}", i % 2 == 0, i / 20) for i in range(20)])
    at_once = facts.upsert_fold(whole)
    in_turn = facts.upsert_fold(whole.where("seq >= 7"), facts.upsert_fold(whole.where("seq < 7")))
    key = [*facts.KEY, "reinforcement_count", "seq"]
    assert sorted(at_once.select(*key).collect()) == sorted(in_turn.select(*key).collect())


def test_next_edges_form_a_path(spark):
    f = rows(spark, ("a", "p", "x", True, 0.9, T0 - timedelta(hours=2)), ("a", "p", "y", True, 0.9, T0 - timedelta(hours=1)), ("a", "p", "z", True, 0.9, T0))
    found = consolidate.next_edges(f).orderBy("source").collect()
    assert [(r.source, r.target, round(r.weight, 2)) for r in found] == [(0, 1, 0.96), (1, 2, 0.96)]


@pytest.mark.parametrize("buckets", [2, 5, 16])
def test_bucketed_chains_equal_whole_ones(spark, buckets):
    f = rows(spark, *[(f"a{i % 3}", "p", f"b{i % 4}", True, 0.9, T0 + timedelta(hours=(i * 7) % 50)) for i in range(40)])
    key = ["source", "target", "anchor", "anchor_role", "gap_days"]
    assert sorted(consolidate.next_edges_by_role(f).select(*key).collect()) == sorted(consolidate.next_edges_by_role(f, buckets=buckets).select(*key).collect())


def test_fact_about_itself_and_equal_times(spark):
    f = rows(spark, ("a", "p", "a", True, 0.9, T0), ("a", "p", "b", True, 0.9, T0))
    assert [(r.source, r.target, r.weight) for r in consolidate.next_edges(f).collect()] == [(0, 1, 1.0)]


def test_constraints(spark):
    r = consolidate.constraints_by_evidence(facts.upsert_fold(rows(spark, ("a", "p", "b", True, 0.9), ("a", "p", "b", True, 0.95)))).first()
    assert (r.evidence, round(r.strength, 6), round(r.persistence, 6)) == (2, 0.925, 0.0975)
    want = 0.25 * (math.log(4) / math.log(101) + math.log(3) / math.log(51) + 0.8 + math.log(2) / math.log(25))
    got = spark.range(1).select(scores.constraint_score(F.lit(3), F.lit(2), F.lit(0.8), F.lit(1))).first()[0]
    assert abs(got - want) < 1e-12


def test_decay_is_of_the_base(spark):
    now = T0
    f = spark.createDataFrame([(0.8, now - timedelta(days=10)), (0.7, now - timedelta(days=3))], "v double, timestamp timestamp")
    got = [r.v_now for r in consolidate.decay(f, "v", F.lit(now)).collect()]
    assert abs(got[0] - 0.8 * 0.95**10) < 1e-9 and got[1] == 0.7


def test_filters(spark):
    f = rows(spark, ("a", "p", "x", True, 0.9), ("a", "p", "y", True, 0.7), ("b", "p", "x", True, 0.85))
    assert facts.matching(f, subject="a").count() == 2 and facts.matching(f, predicate="p").count() == 3
    assert facts.matching(f, object="x").count() == 2 and facts.matching(f, min_confidence=0.85).count() == 2


def test_closure_ends_on_cycles(spark):
    a = spark.createDataFrame([("x", "y"), ("y", "x"), ("us", "na"), ("ca", "na"), ("na", None)], "key string, parent string")
    found = {(r.ancestor, r.descendant) for r in closure(a).collect()}
    assert {d for x, d in found if x == "na"} == {"na", "us", "ca"} and ("x", "y") in found and ("y", "x") in found


def test_sentences_and_negation(spark):
    df = spark.createDataFrame([(0, "  Toyota invests. Honda launches. Ford recalls. "), (1, ""), (2, "Fin.\n É suit. Ab!  Next? one")], "id int, text string")
    found = [(r.id, r.sentence) for r in text.sentences(df).orderBy("id", "sent_idx").collect()]
    assert found == [(0, "Toyota invests."), (0, "Honda launches."), (0, "Ford recalls."), (2, "Fin.\n É suit."), (2, "Ab!"), (2, "Next? one")]
    s = spark.createDataFrame([("It doesn't call it",), ("It no longer calls it",), ("The piano calls it",)], "s string")
    at = F.instr("s", "call")
    got = [r[0] for r in s.select(text.negated_before(F.col("s"), at - 1, at + 3)).collect()]
    assert got == [False, True, False]
    assert [r[0] for r in s.select(text.affirmed(F.col("s"))).collect()] == [False, False, True]


def test_masses_combine_in_closed_form(spark):
    df = spark.createDataFrame([(0.4, 0.0, 0.0, 0.6), (0.0, 0.35, 0.05, 0.6), (0.1, 0.2, 0.3, 0.4)], "s double, r double, u double, theta double")
    m = F.struct("s", "r", "u", "theta")
    got = df.agg(belief.combine_rows(m).alias("m")).first().m

    def dempster(a, b):
        k = a[0] * (b[1] + b[2]) + a[1] * (b[0] + b[2]) + a[2] * (b[0] + b[1])
        one = [a[i] * b[i] + a[i] * b[3] + a[3] * b[i] for i in range(3)]
        return [x / (1 - k) for x in [*one, a[3] * b[3]]]

    ms = [tuple(r) for r in df.collect()]
    want = dempster(dempster(ms[0], ms[1]), ms[2])
    assert all(abs(x - y) < 1e-12 for x, y in zip(got, want, strict=True))
    row = df.limit(1).select(belief.combine(*[F.struct(*[F.lit(v).alias(n) for v, n in zip(x, belief.NAMES, strict=True)]) for x in ms]).alias("m")).first().m
    assert all(abs(x - y) < 1e-12 for x, y in zip(row, want, strict=True))


def test_verdicts(spark):
    types = spark.createDataFrame([("toyota", "actor"), ("invest", "relation"), ("battery", "feature"), ("ev", "feature")], "key string, type string")
    claims = spark.createDataFrame([(c, a, 0.9) for c, anchors in ((0, ("toyota", "invest", "battery")), (1, ("toyota", "invest", "ev")), (2, ("honda",))) for a in anchors], "claim_id int, anchor string, activation double")
    f = spark.createDataFrame([(0, "toyota", "invest", "battery", True, 0.9, 0.5)], "seq int, subject string, predicate string, object string, polarity boolean, confidence double, importance_score double")
    assert {r.claim_id: r.label for r in verify.verify(claims, f, types).collect()} == {0: "SUPPORTS", 1: "REFUTES", 2: "NOT ENOUGH INFO"}
    turned = f.withColumn("polarity", F.lit(False))
    assert verify.verify(claims, turned, types).where("claim_id = 0").first().label == "REFUTES"


def test_persona_and_dedupe(spark):
    f = facts.upsert_fold(rows(spark, ("token", "bypasses", "pool"), ("auth", "validates", "token"), ("auth", "validates", "token", False))).withColumn("reinforcement", F.lit(0.8))
    q = spark.createDataFrame([("token", 1.0)], "anchor string, activation double")
    found = retrieve.ranked(retrieve.relevance(f, q, valences(spark), "regulator"), 10).collect()
    assert [r.predicate for r in found] == ["validates", "bypasses"] and found[1].score == 0.0


def test_imagination(spark):
    f = rows(spark, ("toyota", "invest", "battery"), ("ford", "recall", "us"))
    types = spark.createDataFrame([("toyota", "actor"), ("ford", "actor"), ("invest", "relation"), ("recall", "relation"), ("battery", "feature"), ("us", "location")], "key string, type string")
    assert {r.predicate for r in imagine.predicate_changes(f.where("seq = 0"), types).collect()} == {"recall"}
    assert not imagine.polarity_flips(f).first().polarity
    c = consolidate.constraints_by_documents(f.withColumn("doc_id", F.lit("d")))
    flipped = imagine.scored(imagine.polarity_flips(f), f, types, c).first()
    assert flipped.grammar == 1.0 and flipped.logic_penalty < 0 and flipped.bridge == 0.3
    bad = imagine.scored(f.withColumn("object", F.lit("ford")), f, types, c).first()
    assert bad.grammar == 0.0 and bad.fitness == 0.0
    best, log = imagine.imagine(f, f, types, imagine.relatives(spark.createDataFrame([("us", "location", None)], "key string, type string, parent string")), c, lambda d: d.checkpoint(), generations=3)
    assert best.count() > 0 and best.groupBy("imagined_id").count().where("count > 1").count() == 0 and log


def test_code_extractors(spark):
    py = {r[:3] for r in python_rows("m/models.py", b"class DatabaseError(Exception): pass\nclass Q(DatabaseError, pkg.X): pass\ndef f(self):\n    y = self.x\n    self.z = 1\n    try: pass\n    except E: raise\n    return self.x\n")}
    assert ("models", "defines", "DatabaseError") in py and ("Q", "inherits", "DatabaseError") in py and ("f", "mutates", "z") in py
    assert ("f", "mutates", "x") not in py and not any(r[1] == "raises" for r in py) and ("f", "returns", "value") in py
    js = {r[:3] for r in javascript_rows("auth.ts", b"import x from '../lib/db';\n// class No {}\nclass A extends B { go() { this.n = 1; return null; } }\nfunction f() { throw new A('}'); }\n")}
    assert {("auth", "imports", "db"), ("A", "inherits", "B"), ("go", "mutates", "n"), ("f", "raises", "A"), ("auth", "defines", "f")} <= js and ("auth", "defines", "No") not in js
    assert list(python_rows("x.py", b"def (")) == []
    reg = Registry()
    reg.register("SQL", lambda path, source: iter([("s", "defines", "t", 1, "x")]))
    found = code_facts(spark.createDataFrame([("a.sql", bytearray(b"")), ("b.txt", bytearray(b""))], "path string, content binary"), reg).collect()
    assert [(r.path, r.object) for r in found] == [("a.sql", "t")] and reg.has(".sql") and not reg.has("txt")


def test_source_files(spark, tmp_path):
    for name in ("a.py", "sub/b.ts", "node_modules/c.py", ".hidden/d.py", "e.txt", "notes.md"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("import os\n")
    assert {r.path.rsplit("/", 1)[1] for r in files.source_files(spark, str(tmp_path)).collect()} == {"a.py", "b.ts"}
    assert files.text_files(spark, str(tmp_path)).count() == 2


def test_vocabulary(tmp_path):
    v = Vocabulary({"a": {"type": "actor", "tokens": ["x"]}, "b": {"type": "actor", "tokens": [], "parent": "a"}}, "code")
    v.save(str(tmp_path / "v.json"))
    read = Vocabulary.load(str(tmp_path / "v.json"))
    assert len(read.anchors) == 10 and read.hierarchy("b") == {"parent": "a"} and read.role_of("calls") == "predicate"
    (tmp_path / "bad.json").write_text("{")
    with pytest.raises(SchemaError):
        Vocabulary.load(str(tmp_path / "bad.json"))
    with pytest.raises(SchemaError):
        Vocabulary({"x": {"type": "planet"}})


def test_knowledge_base(spark, tmp_path):
    v = Vocabulary({"toyota": {"type": "actor", "tokens": ["toyota"]}, "ford": {"type": "actor", "tokens": ["ford"]}, "invest": {"type": "relation", "tokens": ["invests", "invest"]}, "battery": {"type": "feature", "tokens": ["battery", "batteries"]}})
    docs = spark.createDataFrame([("d1", "Toyota invests in battery cells. Ford does not invest in batteries.", "2026-03-01"), ("d2", "Toyota will invest in a battery.", "2026-03-05")], "doc_id string, text string, timestamp string")
    with KnowledgeBase(spark, str(tmp_path / "kb"), v) as kb:
        with pytest.raises(ConcurrentWriteError), KnowledgeBase(spark, str(tmp_path / "kb"), v):
            pass
        first = kb.ingest(docs, consolidate_now=True).count()
        assert kb.ingest(docs).count() == first == 3
        found = {(r.subject, r.polarity, r.tense) for r in kb.table("facts").collect()}
        assert found == {("toyota", True, "present"), ("ford", False, "present"), ("toyota", True, "future")}
        assert kb.retrieve("toyota battery").first().subject == "toyota"
        assert kb.verify_claim("Ford invests in a battery").first().label == "REFUTES"
        assert kb.search("toyota", now=F.lit("2026-03-06").cast("timestamp")).count() == 2
        assert kb.imagine("toyota", generations=1).count() > 0
        assert kb.stats().first().imagined > 0
        kb.clear_imagined()
        stats = kb.stats().first()
        assert (stats.facts, stats.imagined, stats.documents, stats.constraints) == (3, 0, 2, 2) and stats.edges > 0
        kb.upsert(rows(spark, ("x", "p", "y"), ("x", "p", "y")))
        assert kb.table("facts").where("subject = 'x'").first().reinforcement_count == 2
        assert kb.prune(0.0) == 0
        assert kb.get(known := kb.table("facts").where("subject = 'x'").first().fact_id).predicate == "p" and kb.get("none") is None
        assert kb.document("d1").n_facts == 2 and kb.document("d1").token_count == 11 and kb.document("d9") is None
        spoke = kb.edges(edge_type="ASSERTS", target="invest")
        assert spoke.count() == 3 and kb.edges(source=spoke.first().source, edge_type="TARGETS").first().target == "battery"
        for _ in range(2):
            kb.add_edge(known, "y", "SEEN")
        assert kb.edges(source=known, edge_type="SEEN").count() == 2 and kb.edges(edge_type="SEEN", limit=1).count() == 1
        assert kb.constraints(subject="toyota").first().doc_count == 2 and kb.constraints(min_score=5.0).count() == 0
        hit = kb.answer("toyota battery", 1)[0]
        assert (hit["subject"], hit["grounding"]["type"]) == ("toyota", "text") and hit["score"] > 0
        told = kb.full_search("toyota invest", now=F.lit("2026-03-06").cast("timestamp"))
        assert {r.subject for r in told["facts"].collect()} == {"toyota", "ford"} and told["constraints"].count() == 2
        assert [r.timestamp for r in told["timeline"].collect()] == sorted(r.timestamp for r in told["timeline"].collect())
        assert kb.observe("Ford invests in a battery.", at=datetime(2026, 3, 7, tzinfo=UTC)) == {"facts_added": 1, "facts_reinforced": 0}
        assert kb.observe("Ford invests in a battery. Ford never invests in a battery.", at=datetime(2026, 3, 8, tzinfo=UTC)) == {"facts_added": 0, "facts_reinforced": 2}
        assert kb.vacuum() > 0 and kb.vacuum() == 0
        assert kb.reason("Toyota invests in battery")["label"] in ("SUPPORTS", "NOT ENOUGH INFO", "REFUTES")
        (tmp_path / "kb" / "facts" / "CURRENT").unlink()
        with pytest.raises(FileNotFoundError):
            kb.table("facts")
    full = {r.subject: r for r in extract.text_facts(docs.where("doc_id = 'd1'"), v.frame(spark)).collect()}
    assert full["ford"].spans["object"].text == "batteries" and full["ford"].support["subject"] == "direct" and full["toyota"].object_meta == {"type": "feature"}
    assert full["toyota"].importance_score == pytest.approx(0.3 * full["toyota"].confidence + 0.2 * full["toyota"].importance.specificity + 0.15)
    assert extract.text_facts(docs, v.frame(spark)).count() == 3


def test_masses_of_logits(spark):
    m = spark.range(1).select(belief.from_logits(F.lit(2.0), F.lit(1.0), F.lit(0.0)).alias("m")).first().m
    powers = [math.exp(x) for x in (2, 1, 0)]
    share = [p / sum(powers) for p in powers]
    theta = 0.5 * (1 - share[0])
    assert (m.s, m.u, m.r, m.theta) == pytest.approx((*[x * (1 - theta) for x in share], theta))


def test_chains_of_branches_and_circles(spark):
    """As the edges say one by one: branches go on apart, repeated edges count, a node that comes again ends the walk, other anchors are not followed."""
    edges = [(1, 2, "a"), (2, 3, "a"), (2, 4, "a"), (4, 5, "a"), (3, 1, "a"), (3, 6, "b"), (5, 7, "a"), (5, 7, "a"), (7, 8, "a"), (9, 9, "a"), (2, None, "a")]
    starts = [(1, "a"), (3, "b"), (9, "a"), (None, "a"), (1, "a")]
    told = []

    def walk(start, anchor, path):
        told.append((start, anchor, len(path) - 1, path[-1]))
        for s, t, a in edges:
            if len(path) <= 5 and None not in (s, t) and s == path[-1] and a == anchor and t not in path:
                walk(start, anchor, [*path, t])

    for start, anchor in starts:
        walk(start, anchor, [start])
    made = retrieve.chains(spark.createDataFrame(starts, "source int, anchor string"), spark.createDataFrame(edges, "source int, target int, anchor string"), 5)
    assert made.columns == ["start", "anchor", "step", "node"]
    assert sorted(map(repr, map(tuple, made.collect()))) == sorted(map(repr, told))


def test_chains_are_no_recursive_query(spark):
    """A recursive query stops over 1,000,000 rows; here over 50."""
    limit = "spark.sql.cteRecursionRowLimit"
    spark.conf.set(limit, "50")
    try:
        found = retrieve.chains(spark.range(40).selectExpr("id * 10 AS source", "'a' AS anchor"), spark.range(400).selectExpr("id AS source", "id + 1 AS target", "'a' AS anchor"), 3)
        assert found.count() == 160 and found.agg(F.max(F.col("node") - F.col("start"))).first()[0] == 3
    finally:
        spark.conf.unset(limit)
