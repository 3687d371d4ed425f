"""SQL (DuckDB) for the queries, written on its own: same rows, same columns."""

from __future__ import annotations

from ..fixed import LABEL_CUES, NEGATION_CUES, NEGATION_WORDS, PERSONA_CUES, PERSONA_FOCUS, PERSONA_VALENCE, PROJECTION_DAYS, RELATION_CUES
from . import inputs

SQL: dict[str, str] = {}


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def values(rows, columns: str) -> str:
    def one(x):
        return "NULL" if x is None else q(x) if isinstance(x, str) else "[" + ", ".join(map(one, x)) + "]" if isinstance(x, (list, tuple)) else str(x)

    return f"(SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(one, r)) + ')' for r in rows)}) AS t({columns}))"


OBS = """obs AS (SELECT event_id AS seq, 'user_' || user_id AS subject, event_type AS predicate, 'k_' || (CAST(json_extract_string(props, '$.k') AS INT) % 10) AS object,
 event_type <> 'error' AS polarity, value / (value + 10) AS confidence, ts FROM events)"""


def fold(source: str = "obs") -> str:
    return f"""SELECT subject, predicate, object, polarity, count(*) AS reinforcement_count, avg(confidence) AS confidence, arg_max(ts, seq) AS ts, max(seq) AS seq FROM {source} GROUP BY ALL"""


def fold_of(source: str) -> str:
    return f"SELECT subject, predicate, object, polarity, count(*) AS reinforcement_count, avg(confidence) AS confidence, arg_max(ts, seq) AS ts, max(seq) AS seq FROM {source} GROUP BY subject, predicate, object, polarity"


FOLD = f"{OBS}, folded AS ({fold_of('obs')})"
KEY = "subject, predicate, object, polarity"

SQL["obs_upsert_fold"] = f"WITH {FOLD} SELECT {KEY}, reinforcement_count, round(confidence, 6) AS confidence, epoch_us(ts) AS ts_us, seq FROM folded"
SQL["obs_upsert_two_batches"] = f"WITH {FOLD} SELECT {KEY}, reinforcement_count, round(confidence, 6) AS confidence FROM folded"
SQL["orders_upsert_fold"] = """SELECT 'cust_' || o_custkey AS subject, 'ordered_' || lower(o_orderpriority) AS predicate, 'status_' || o_orderstatus AS object, true AS polarity,
 count(*) AS reinforcement_count, round(avg(o_totalprice / (o_totalprice + 100000)), 6) AS confidence, max(o_orderkey) AS seq FROM orders GROUP BY 1, 2, 3"""
SQL["supply_constraints"] = """WITH f AS (SELECT 'supp_' || l_suppkey AS subject, 'supplies' AS predicate, 'part_' || l_partkey AS object, l_returnflag <> 'R' AS polarity, count(*) AS n, avg(l_quantity / 50) AS c FROM lineitem GROUP BY 1, 2, 3, 4)
 SELECT subject, predicate, object, max(n) AS evidence, round(avg(c), 6) AS strength, round(1 - pow(0.95, max(n)), 6) AS persistence FROM f GROUP BY 1, 2, 3"""
SQL["obs_latest_wins"] = f"WITH {OBS} SELECT {KEY}, seq, round(confidence, 6) AS confidence FROM obs QUALIFY row_number() OVER (PARTITION BY subject, predicate ORDER BY seq DESC) = 1"
SQL["filter_triple"] = f"WITH {OBS} SELECT seq, subject, round(confidence, 6) AS confidence FROM obs WHERE predicate = 'purchase' AND object = 'k_3' AND confidence >= 0.9"
SQL["role_lookup"] = f"""WITH {OBS} SELECT 'user_1' AS anchor, 'subject' AS role, count(*) AS n, round(avg(confidence), 6) AS confidence FROM obs WHERE subject = 'user_1'
 UNION ALL SELECT 'k_3', 'object', count(*), round(avg(confidence), 6) FROM obs WHERE object = 'k_3'"""
SQL["query_symbol"] = f"WITH {FOLD} SELECT {KEY}, reinforcement_count FROM folded WHERE subject = 'user_7' OR object = 'user_7' ORDER BY reinforcement_count DESC, subject, predicate, object, polarity LIMIT 50"
SQL["search_fallthrough"] = f"WITH {FOLD} SELECT 2 AS tier, predicate, count(*) AS n, CAST(sum(reinforcement_count) AS BIGINT) AS seen FROM folded WHERE predicate = 'purchase' GROUP BY predicate"
NEXT = """pairs AS (SELECT seq, ts, unnest(list_distinct([subject, object])) AS anchor FROM {src}),
 linked AS (SELECT seq AS source, lead(seq) OVER w AS target, ts, lead(ts) OVER w AS nts FROM pairs WINDOW w AS (PARTITION BY anchor ORDER BY ts, seq)),
 nexts AS (SELECT DISTINCT source, target, round(1 / (1 + (epoch_us(nts) - epoch_us(ts)) / 8.64e10), 6) AS weight FROM linked WHERE target IS NOT NULL)"""
EDGES = f"{OBS}, {NEXT.format(src='obs')}"
SQL["stats_counts"] = f"WITH {FOLD}, {NEXT.format(src='obs')} SELECT (SELECT count(*) FROM folded) AS n_facts, (SELECT count(*) FROM nexts) AS n_edges, (SELECT count(*) FROM (SELECT DISTINCT subject, predicate, object FROM folded)) AS n_constraints, (SELECT count(*) FROM documents) AS n_documents"
SQL["top_anchors"] = f"WITH {FOLD} SELECT anchor, count(*) AS n FROM (SELECT subject AS anchor FROM folded UNION ALL SELECT object FROM folded) GROUP BY anchor ORDER BY n DESC, anchor LIMIT 10"
SQL["distinct_anchors"] = f"WITH {OBS} SELECT substr(anchor, 1, 2) AS kind, count(*) AS n FROM (SELECT subject AS anchor FROM obs UNION SELECT object FROM obs) GROUP BY 1"
SQL["recent20"] = f"WITH {OBS} SELECT seq, {KEY} FROM obs ORDER BY ts DESC, seq DESC LIMIT 20"
SQL["kind_counts"] = f"WITH {OBS} SELECT CASE WHEN seq % 10 = 0 THEN 'imagined' ELSE 'observed' END AS kind, confidence < 0.2 AS pruned, count(*) AS n FROM obs GROUP BY 1, 2"
SQL["prune_soft_delete"] = f"WITH {OBS} SELECT predicate, count(*) AS n, round(min(confidence), 6) AS least FROM obs WHERE confidence >= 0.5 GROUP BY 1"
SQL["doc_stats"] = "SELECT lang, count(*) AS n, CAST(sum(len(regexp_extract_all(lower(text), '[a-z0-9_'']+'))) AS BIGINT) AS tokens FROM documents GROUP BY lang"
SQL["duplicate_probe"] = f"""WITH {OBS}, old AS (SELECT subject, predicate, object, list(DISTINCT polarity) AS known FROM obs WHERE seq % 5 <> 0 GROUP BY 1, 2, 3)
 SELECT n.predicate, CASE WHEN o.known IS NULL THEN 'added' WHEN list_contains(o.known, n.polarity) THEN 'reinforced' ELSE 'contradicted' END AS found, count(*) AS n
 FROM (SELECT * FROM obs WHERE seq % 5 = 0) n LEFT JOIN old o USING (subject, predicate, object) GROUP BY 1, 2"""
SQL["shortened_names"] = "SELECT p_partkey, CASE WHEN length(p_name) > 12 THEN substr(p_name, 1, 10) || '..' ELSE p_name END AS name FROM part"

P1 = f"{FOLD}, c AS (SELECT subject, predicate, object, max(reinforcement_count) AS evidence, avg(confidence) AS strength, 1 - pow(0.95, max(reinforcement_count)) AS persistence FROM folded GROUP BY 1, 2, 3)"
SQL["constraints_p1"] = f"WITH {P1} SELECT subject, predicate, object, evidence, round(strength, 6) AS strength, round(persistence, 6) AS persistence FROM c"
SQL["constraints_ranked"] = f"WITH {P1} SELECT subject, predicate, object, evidence, round(strength * persistence, 6) AS weight FROM c ORDER BY strength * persistence DESC, subject, predicate, object LIMIT 20"
P2 = """c2 AS (SELECT subject, predicate, object, count(*) AS evidence, count(DISTINCT CAST(ts AS DATE)) AS doc_count, avg(confidence) AS strength, count(DISTINCT strftime(ts, '%Y-%m')) AS persistence FROM {src} GROUP BY 1, 2, 3),
 c3 AS (SELECT *, 0.25 * (ln(1 + evidence) / ln(101) + ln(1 + doc_count) / ln(51) + strength + ln(1 + persistence) / ln(25)) AS score FROM c2)"""
SQL["constraints_p2"] = f"WITH {OBS}, {P2.format(src='obs')} SELECT subject, predicate, object, evidence, doc_count, round(strength, 6) AS strength, persistence, round(score, 6) AS score FROM c3"
SQL["next_edges_weighted"] = SQL["next_edges_bucketed"] = f"WITH {EDGES} SELECT * FROM nexts"
ROLES = """anchored AS (SELECT seq, ts, subject AS anchor, 'subject' AS role FROM {src} UNION ALL SELECT seq, ts, predicate, 'predicate' FROM {src} UNION ALL SELECT seq, ts, object, 'object' FROM {src}),
 rl AS (SELECT seq AS source, lead(seq) OVER w AS target, anchor, role AS anchor_role, ts, lead(ts) OVER w AS nts FROM anchored WINDOW w AS (PARTITION BY anchor ORDER BY ts, seq)),
 roles AS (SELECT source, target, anchor, anchor_role, CAST(abs(date_diff('day', CAST(ts AS DATE), CAST(nts AS DATE))) AS INT) AS gap_days FROM rl WHERE target IS NOT NULL AND target <> source)"""
SQL["next_edges_roles"] = f"WITH {OBS}, {ROLES.format(src='obs')} SELECT * FROM roles"
SQL["next_edges_incremental"] = f"""WITH {EDGES}, most AS (SELECT * FROM obs WHERE seq % 3 <> 0), p2 AS (SELECT seq, ts, unnest(list_distinct([subject, object])) AS anchor FROM most),
 l2 AS (SELECT DISTINCT seq AS source, lead(seq) OVER (PARTITION BY anchor ORDER BY ts, seq) AS target FROM p2) SELECT n.* FROM nexts n ANTI JOIN l2 USING (source, target)"""
SQL["decay_exponential"] = f"""WITH {OBS}, d AS (SELECT *, (epoch_us(TIMESTAMP '{inputs.NOW}') - epoch_us(ts)) / 8.64e10 AS days FROM obs)
 SELECT seq, round(CASE WHEN days > 7 THEN confidence * pow(0.95, days) ELSE confidence END, 6) AS confidence_now FROM d"""
SQL["decay_linear"] = f"WITH {OBS} SELECT seq, round(greatest(0, confidence - 0.01 * greatest(0, date_diff('day', CAST(ts AS DATE), DATE '{inputs.NOW[:10]}'))), 6) AS importance FROM obs"
SQL["reinforce_importance"] = f"""WITH {OBS}, old AS (SELECT subject, predicate, object, count(*) AS n, avg(confidence) AS c FROM obs WHERE seq % 2 = 0 AND polarity GROUP BY 1, 2, 3),
 new AS (SELECT subject, predicate, object, count(*) AS m, sum(confidence) AS s FROM obs WHERE seq % 2 = 1 GROUP BY 1, 2, 3),
 j AS (SELECT subject, predicate, object, n + coalesce(m, 0) AS reinforcement_count, (c * n + coalesce(s, 0)) / (n + coalesce(m, 0)) AS c FROM old LEFT JOIN new USING (subject, predicate, object))
 SELECT subject, predicate, object, reinforcement_count, round(c, 6) AS confidence, round(0.3 * c + 0.2 * 0.5 + 0.15 * 0.8 + 0.1 * ln(1 + reinforcement_count), 6) AS importance FROM j"""


def closure(source: str, name: str = "clo") -> str:
    return f"""walk AS (SELECT key AS ancestor, key AS descendant, 0 AS depth FROM {source} UNION ALL SELECT w.ancestor, a.key, w.depth + 1 FROM walk w JOIN {source} a ON a.parent = w.descendant WHERE w.depth < 32),
 {name} AS (SELECT ancestor, descendant, min(depth) AS depth FROM walk GROUP BY 1, 2)"""


ANCHORS = f"anchors AS {values(inputs.ANCHORS, 'key, type, tokens, parent')}"
PARENTS = f"parents AS {values(inputs.PARENTS, 'key, parent')}"
QUERY = f"query AS {values(inputs.QUERY, 'anchor, activation')}"
EXPANDED = f"""{PARENTS}, {QUERY}, {closure('parents')},
 wide AS (SELECT anchor, CAST(activation AS DOUBLE) AS activation, 0 AS depth FROM query UNION ALL SELECT descendant, CASE WHEN depth = 0 THEN CAST(activation AS DOUBLE) ELSE 0.5 END, depth FROM query JOIN clo ON ancestor = anchor),
 expanded AS (SELECT anchor, arg_min(activation, depth) AS activation FROM wide GROUP BY anchor)"""
SQL["anchor_closure"] = f"WITH RECURSIVE {ANCHORS}, {closure('anchors')} SELECT * FROM clo"
SQL["geography_closure"] = f"WITH RECURSIVE geo AS (SELECT r_name AS key, CAST(NULL AS VARCHAR) AS parent FROM region UNION ALL SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey), {closure('geo')} SELECT * FROM clo"
SQL["ancestors"] = f"WITH RECURSIVE {PARENTS}, {closure('parents')} SELECT descendant AS anchor, max(depth) AS depth, arg_min(ancestor, depth) AS parent FROM clo WHERE depth > 0 GROUP BY 1"
SQL["descendant_expansion"] = f"WITH RECURSIVE {EXPANDED} SELECT anchor, round(activation, 6) AS activation FROM expanded"
SQL["typed_vocabulary"] = f"WITH {ANCHORS} SELECT key, type, CASE type WHEN 'actor' THEN 'subject' WHEN 'relation' THEN 'predicate' ELSE 'object' END AS role, CAST(len(tokens) AS INT) AS n_tokens FROM anchors"
SQL["field_lookup"] = f"WITH {ANCHORS} SELECT key, 'polar' AS macro_region FROM anchors WHERE type = 'location'"

SPLIT = r"""cut AS (SELECT doc_id, string_split(regexp_replace(regexp_replace(text, '^\s+|\s+$', '', 'g'), '([.!?])\s+([A-Z])', concat('\1', chr(1), '\2'), 'g'), chr(1)) AS parts FROM documents),
 trimmed AS (SELECT doc_id, list_filter(list_transform(parts, lambda s: regexp_replace(s, '^\s+|\s+$', '', 'g')), lambda s: s <> '') AS parts FROM cut),
 sents AS (SELECT doc_id, CAST(i - 1 AS INT) AS sent_idx, parts[i] AS sentence FROM (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS i FROM trimmed))"""
SQL["sentence_split"] = f"WITH {SPLIT} SELECT doc_id, sent_idx, sentence FROM sents"
SQL["sentence_ids"] = f"WITH {SPLIT} SELECT doc_id || '_' || lpad(CAST(sent_idx AS VARCHAR), CAST(greatest(4, length(CAST(sent_idx AS VARCHAR))) AS INT), '0') AS sent_id, CAST(length(sentence) AS INT) AS n FROM sents"
SAID = f"{SPLIT}, said AS (SELECT doc_id || '_' || sent_idx AS id, sentence FROM sents UNION ALL SELECT 's_' || id, sentence FROM {values(list(enumerate(inputs.SENTENCES)), 'id, sentence')})"


def word(pattern: str) -> str:
    return q(rf"(?i)(^|[^\p{{L}}\p{{M}}\p{{N}}_]){pattern}([^\p{{L}}\p{{M}}\p{{N}}_]|$)")


def cue(words) -> str:
    return f"regexp_matches(sentence, {word('(' + '|'.join(words) + ')')})"


SQL["polarity_regex"] = f"WITH {SAID} SELECT id, NOT {cue(NEGATION_CUES)} AS affirmed, {cue(NEGATION_CUES + LABEL_CUES)} AS label FROM said"
W = r"[\p{L}\p{M}\p{N}_]+"
SQL["tense"] = f"""WITH {SAID} SELECT id, CASE WHEN {cue(('will', 'shall', 'going to'))} THEN 'future' WHEN {cue(('would', 'could', 'might', 'may'))} THEN 'conditional'
 WHEN regexp_matches(sentence, {word(rf'(is|are|am)\s+{W}ing')}) THEN 'present_continuous' WHEN regexp_matches(sentence, {word(rf'(was|were|did|had|{W}ed)')}) THEN 'past' ELSE 'present' END AS tense FROM said"""
SQL["relation_types"] = f"WITH {SAID} SELECT id, CASE " + " ".join(f"WHEN {' OR '.join(f'contains(lower(sentence), {q(c)})' for c in cues)} THEN {q(name)}" for name, cues in RELATION_CUES) + " ELSE 'none' END AS relation FROM said"
SQL["negation_window"] = f"""WITH s AS (SELECT id, sentence, instr(lower(sentence), 'call') AS pos FROM {values(list(enumerate(inputs.SENTENCES)), 'id, sentence')}),
 w AS (SELECT id, lower(substr(sentence, greatest(0, pos - 21) + 1, pos + 3 - greatest(0, pos - 21))) AS window_ FROM s WHERE pos > 0)
 SELECT id, len(list_intersect(regexp_extract_all(window_, '[a-z0-9_]+(''[tn])?'), [{', '.join(map(q, NEGATION_WORDS))}])) > 0 AS negated FROM w"""
SQL["deterministic_ids"] = f"""WITH {OBS} SELECT seq, 'inf_' || substr(sha256(concat_ws(':', seq, 0, subject, predicate, object)), 1, 12) AS id, 'img_' || substr(sha256(concat_ws(':', 'imagined', subject, predicate, object, CAST(polarity AS INT))), 1, 12) AS imagined,
 'imagined: <<' || predicate || ', ' || subject || ', ' || object || '; ' || CAST(polarity AS INT) || '>>' AS sentence FROM obs"""
B0, B1 = r"(^|[^\p{L}\p{M}\p{N}_])", r"([^\p{L}\p{M}\p{N}_]|$)"
SQL["span_longest"] = rf"""WITH {SPLIT}, m AS (SELECT doc_id, sent_idx, sentence, regexp_extract(sentence, '(?i){B0}(of the|that|of){B1}', 0) AS hit, regexp_extract(sentence, '(?i){B0}(of the|that|of){B1}', 2) AS t FROM sents)
 SELECT doc_id, sent_idx, lower(t) AS text, CAST(instr(sentence, hit) - 1 + CASE WHEN starts_with(lower(hit), lower(t)) THEN 0 ELSE 1 END AS INT) AS start FROM m WHERE t <> ''"""
SQL["span_first_token"] = rf"""WITH {SPLIT}, m AS (SELECT doc_id, sent_idx, sentence, lower(sentence) AS s, regexp_extract(lower(sentence), '{B0}the{B1}', 0) AS a, regexp_extract(lower(sentence), '{B0}of{B1}', 0) AS b FROM sents)
 SELECT doc_id, sent_idx, CAST(CASE WHEN a <> '' THEN instr(s, a) - 1 + instr(a, 'the') - 1 WHEN b <> '' THEN instr(s, b) - 1 + instr(b, 'of') - 1 ELSE 0 END AS INT) AS start,
 CAST(CASE WHEN a <> '' THEN instr(s, a) + instr(a, 'the') + 1 WHEN b <> '' THEN instr(s, b) + instr(b, 'of') ELSE length(sentence) END AS INT) AS "end" FROM m"""
SQL["support_class"] = f"""WITH {SPLIT} SELECT doc_id, sent_idx, CASE WHEN contains(lower(sentence), 'thereof') OR contains(lower(sentence), 'ationed') THEN 'direct'
 WHEN contains(lower(sentence), 'heit') OR contains(lower(sentence), 'eaux') THEN 'hierarchical' ELSE 'semantic' END AS support FROM sents"""
YEARS = rf"len(list_filter(regexp_extract_all(sentence, '{W}'), lambda x: regexp_full_match(x, '\p{{Nd}}{{4}}')))"

MONTHS = "January|February|March|April|May|June|July|August|September|October|November|December"
RELATIVE = "today|yesterday|last week|this week|next week|last month|this month|next month|last year|this year|next year"


def spaced(pattern: str) -> str:
    """Matches between word borders: with doubled spaces, borders aren't shared."""
    return rf"CAST(len(regexp_extract_all(regexp_replace(sentence, '\s', '  ', 'g'), '{B0}({pattern}){B1}')) AS INT)"


QUARTER, HALF, MONTH = (spaced(p) for p in (r"Q[1-4]\s+\p{Nd}{4}", r"H[12]\s+\p{Nd}{4}", rf"(?i:{MONTHS})\s+\p{{Nd}}{{4}}"))
RELATIVES = spaced("(?i:" + RELATIVE.replace(" ", "  ") + ")")
SQL["temporal_refs"] = f"""WITH {SAID}, n AS (SELECT id, {QUARTER} AS quarter, {HALF} AS half, {MONTH} AS month, CAST({YEARS} AS INT) AS year, {RELATIVES} AS relative FROM said)
 SELECT *, CASE WHEN quarter > 0 THEN 'quarter' WHEN half > 0 THEN 'half' WHEN month > 0 THEN 'month' WHEN year > 0 THEN 'year' WHEN relative > 0 THEN 'relative' ELSE 'unknown' END AS first FROM n"""

ACTIVE = f"""{SPLIT}, {ANCHORS}, vocab AS (SELECT key, type, unnest(tokens) AS token FROM anchors),
 words AS (SELECT doc_id, sent_idx, unnest(regexp_extract_all(lower(sentence), '[a-z0-9_'']+')) AS token FROM sents),
 single AS (SELECT doc_id, sent_idx, key, type, token, count(*) AS n FROM words JOIN vocab USING (token) GROUP BY ALL),
 padded AS (SELECT doc_id, sent_idx, ' ' || array_to_string(regexp_extract_all(lower(sentence), '[a-z0-9_'']+'), ' ') || ' ' AS p FROM sents),
 phrase AS (SELECT doc_id, sent_idx, key, type, token, CAST((length(p) - length(replace(p, ' ' || token || ' ', ''))) // (length(token) + 2) AS BIGINT) AS n FROM padded JOIN vocab ON contains(token, ' ') AND contains(p, ' ' || token || ' ')),
 active AS (SELECT doc_id, sent_idx, key, type, max(ln(1 + n)) AS activation FROM (SELECT * FROM single UNION ALL SELECT * FROM phrase) GROUP BY 1, 2, 3, 4)"""
SQL["anchor_activation"] = f"WITH {ACTIVE} SELECT doc_id, sent_idx, key, round(activation, 6) AS activation FROM active"
SQL["row_max_norm"] = f"WITH {ACTIVE} SELECT doc_id, sent_idx, key, round(activation / max(activation) OVER (PARTITION BY doc_id, sent_idx), 6) AS share FROM active"
SQL["topk_per_type"] = f"WITH {ACTIVE} SELECT doc_id, sent_idx, type, CAST(row_number() OVER w AS INT) AS rank, key FROM active WINDOW w AS (PARTITION BY doc_id, sent_idx, type ORDER BY activation DESC, key) QUALIFY row_number() OVER w <= 2"
SQL["triples_min"] = f"""WITH {ACTIVE}, best AS (SELECT * FROM active WHERE activation >= 0.1 QUALIFY row_number() OVER (PARTITION BY doc_id, sent_idx, type ORDER BY activation DESC, key) <= 5)
 SELECT s.doc_id, s.sent_idx, s.key AS subject, p.key AS predicate, o.key AS object, round(tanh(least(s.activation, p.activation, o.activation) / 2), 6) AS confidence
 FROM best s JOIN best p ON s.doc_id = p.doc_id AND s.sent_idx = p.sent_idx AND p.type = 'relation' JOIN best o ON s.doc_id = o.doc_id AND s.sent_idx = o.sent_idx AND o.type IN ('actor', 'feature') WHERE s.type = 'actor' AND s.key <> o.key"""
MEAN = f"""{ACTIVE}, shared AS (SELECT *, activation / max(activation) OVER (PARTITION BY doc_id, sent_idx) AS share, CASE type WHEN 'actor' THEN 'subject' WHEN 'relation' THEN 'predicate' ELSE 'object' END AS role FROM active),
 best AS (SELECT * FROM shared WHERE activation >= 0.3 QUALIFY row_number() OVER (PARTITION BY doc_id, sent_idx, role ORDER BY share DESC, key) <= 3),
 triples AS (SELECT s.doc_id, s.sent_idx, s.key AS subject, p.key AS predicate, o.key AS object, pow(s.share * p.share * o.share, 1.0 / 3) AS confidence
 FROM best s JOIN best p ON s.doc_id = p.doc_id AND s.sent_idx = p.sent_idx AND p.role = 'predicate' JOIN best o ON s.doc_id = o.doc_id AND s.sent_idx = o.sent_idx AND o.role = 'object' WHERE s.role = 'subject' AND pow(s.share * p.share * o.share, 1.0 / 3) >= 0.05)"""
SQL["triples_geomean"] = f"WITH {MEAN} SELECT doc_id, sent_idx, subject, predicate, object, round(confidence, 6) AS confidence FROM triples"
SQL["idf_specificity"] = f"""WITH {ACTIVE}, d AS (SELECT key, CAST(sum(CASE WHEN activation > 0.3 THEN 1 ELSE 0 END) AS BIGINT) AS df FROM active GROUP BY key), i AS (SELECT key, df, ln(1 + (SELECT count(*) FROM documents) / (1.0 + df)) AS idf FROM d)
 SELECT key, df, round(idf / ((SELECT max(idf) FROM i) + 1e-8), 6) AS specificity FROM i"""
SQL["spoke_edges"] = f"""WITH {OBS}, s AS (SELECT 'INITIATES' AS edge_type, subject AS source, confidence AS w FROM obs UNION ALL SELECT 'ASSERTS', 'e' || seq, confidence FROM obs UNION ALL SELECT 'TARGETS', 'e' || seq, confidence FROM obs)
 SELECT edge_type, substr(source, 1, 1) AS kind, count(*) AS n, round(sum(w), 6) AS weight FROM s GROUP BY 1, 2"""

VALENCES = f"valences AS {values([(p, w, v) for p, (g, b) in PERSONA_VALENCE.items() for ws, v in ((g, 1.0), (b, -1.0)) for w in ws], 'persona, predicate, valence')}"


def relevance(persona: str | None) -> str:
    return f"""{FOLD}, names AS {values(inputs.PREDICATES, 'predicate, named')}, {EXPANDED}, {VALENCES},
 rel AS (SELECT f.seq, f.subject, n.named AS predicate, f.object, f.polarity, f.ts, coalesce(v.valence, 0) AS valence,
 (coalesce(a.activation, 0) + coalesce(b.activation, 0)) / 2 * f.confidence * least(1, f.reinforcement_count / 10.0) * (1 + coalesce(v.valence, 0)) AS score
 FROM folded f JOIN names n USING (predicate) LEFT JOIN expanded a ON a.anchor = f.subject LEFT JOIN expanded b ON b.anchor = f.object
 LEFT JOIN valences v ON v.persona = {q(persona or '-')} AND v.predicate = n.named WHERE a.anchor IS NOT NULL OR b.anchor IS NOT NULL),
 hits AS (SELECT * FROM rel QUALIFY row_number() OVER (PARTITION BY subject, predicate, object ORDER BY score DESC, seq) = 1)"""


SQL["retrieve_ranked"] = f"WITH RECURSIVE {relevance(None)} SELECT {KEY}, round(score, 6) AS score FROM hits ORDER BY hits.score DESC, seq LIMIT 50"
SQL["retrieve_persona"] = f"WITH RECURSIVE {relevance('regulator')} SELECT {KEY}, round(valence, 6) AS valence, round(score, 6) AS score FROM hits ORDER BY hits.score DESC, seq LIMIT 50"
SQL["retrieve_context"] = f"WITH RECURSIVE {relevance('engineer')}, {NEXT.format(src='obs')}, top AS (SELECT * FROM hits ORDER BY score DESC, seq LIMIT 20) SELECT seq AS hit, target AS other, weight FROM top JOIN nexts ON source = seq"
SQL["timeline"] = f"WITH RECURSIVE {relevance(None)}, top AS (SELECT * FROM hits ORDER BY score DESC, seq LIMIT 30) SELECT CAST(row_number() OVER (ORDER BY ts, seq) AS INT) AS place, seq FROM top"

NAMED = {"signup": "launch", "error": "recall", "click": "grow", "view": "trend", "purchase": "invest"}
RICH = f"""{OBS}, rich AS (SELECT seq, subject, CASE predicate {' '.join(f"WHEN '{a}' THEN '{b}'" for a, b in NAMED.items())} END AS predicate, object, polarity, confidence, ts, confidence * 0.3 + 0.2 AS importance_score,
 CASE seq % 3 WHEN 0 THEN 'future' WHEN 1 THEN 'present_continuous' ELSE 'past' END AS tense FROM obs)"""


def search(persona: str, sign: str, gain: str) -> str:
    good, bad, kinds = PERSONA_FOCUS[persona]
    has = lambda ws: f"predicate IN ({', '.join(map(q, ws))})"
    salience = " + ".join(f"{0.33 if k in kinds else 0}" for k in ("actor", "relation", "feature"))
    return f"""{RICH}, {QUERY}, wanted AS (SELECT r.*, row_number() OVER (PARTITION BY q.anchor ORDER BY importance_score DESC, seq) AS n FROM rich r JOIN query q ON (r.subject = q.anchor AND q.anchor LIKE 'user%') OR (r.object = q.anchor AND q.anchor LIKE 'k%')),
 found AS (SELECT DISTINCT ON (seq) * FROM wanted WHERE n <= 40),
 v AS (SELECT *, {sign} * (CASE WHEN polarity THEN 1 ELSE -1 END) * (CASE WHEN {has(good)} THEN 0.5 + 0.5 * confidence WHEN {has(bad)} THEN -(0.5 + 0.5 * confidence) ELSE 0.1 * confidence END) AS valence,
 least(1, {salience}) AS salience, CASE tense WHEN 'future' THEN 0.5 + 0.5 * confidence WHEN 'present_continuous' THEN 0.3 + 0.3 * confidence ELSE 0 END AS urgency,
 greatest(0.1, exp(-greatest(0, date_diff('day', CAST(ts AS DATE), DATE '{inputs.NOW[:10]}')) / 365.0)) AS recency FROM found),
 s AS (SELECT *, 0.4 * importance_score + 0.3 * salience + 0.2 * recency + 0.1 * abs(valence) + {gain} AS rank_score FROM v)"""


SQL["search_ranked"] = f"WITH {search('investor', '1', '0')} SELECT seq, round(valence, 6) AS valence, round(salience, 6) AS salience, round(urgency, 6) AS urgency, round(recency, 6) AS recency, round(rank_score, 6) AS rank_score FROM s ORDER BY s.rank_score DESC, seq LIMIT 40"
SQL["search_contrary"] = f"WITH {search('engineer', '-1', 'CASE WHEN polarity THEN 0 ELSE 0.25 END')} SELECT seq, polarity, round(valence, 6) AS valence, round(rank_score, 6) AS rank_score FROM s ORDER BY s.rank_score DESC, seq LIMIT 40"
SQL["persona_detect"] = f"""WITH {OBS}, {QUERY}, t AS (SELECT CAST(activation AS DOUBLE) AS activation, CASE WHEN anchor LIKE 'user%' THEN 'actor' ELSE 'feature' END AS type FROM query WHERE anchor IN (SELECT subject FROM obs UNION SELECT object FROM obs)), f AS {values([(p, t) for p, x in PERSONA_FOCUS.items() for t in x[2]], 'persona, type')}
 SELECT persona, round(sum(activation), 6) AS score FROM t JOIN f USING (type) GROUP BY persona"""
SQL["persona_cues"] = f"WITH t AS {values([(0, 'What are the RISKS?'), (1, 'new patents'), (2, 'Market share of toyota'), (3, 'which policy'), (4, 'weather')], 'id, q')} SELECT id, CASE " + " ".join(f"WHEN {' OR '.join(f'contains(lower(q), {q(c)})' for c in cues)} THEN {q(name)}" for name, cues in PERSONA_CUES) + " END AS persona FROM t"
SQL["chain_walk"] = f"""WITH {OBS}, {ROLES.format(src='obs')}, ordered AS (SELECT seq, subject, row_number() OVER (PARTITION BY subject ORDER BY ts, seq) - 1 AS i FROM obs)
 SELECT first_value(seq) OVER (PARTITION BY subject ORDER BY i) AS start, subject AS anchor, CAST(i AS INT) AS step, seq AS node FROM ordered WHERE i <= 10"""
SQL["constraint_lookup"] = f"""WITH {OBS}, {P2.format(src='obs')}, sc AS (SELECT subject, predicate, object, round(score, 9) AS score FROM c3),
 a AS (SELECT * FROM sc WHERE subject = 'user_1' ORDER BY score DESC, subject, predicate, object LIMIT 10), b AS (SELECT * FROM sc WHERE object = 'k_3' ORDER BY score DESC, subject, predicate, object LIMIT 10), c AS (SELECT * FROM sc WHERE predicate = 'purchase' ORDER BY score DESC, subject, predicate, object LIMIT 10)
 SELECT subject, predicate, object, round(score, 6) AS score FROM (SELECT * FROM a UNION SELECT * FROM b UNION SELECT * FROM c)"""

MASSES = f"{OBS}, x AS (SELECT seq, polarity, confidence, (seq % 7) / 6.0 AS s, (seq % 5) / 4.0 AS p, (seq % 3) / 2.0 AS o, CASE WHEN seq % 4 > 0 THEN (seq % 4) / 3.0 END AS comp FROM obs)"


def four(s: str, r: str, u: str, t: str) -> str:
    return f"{{'s': CAST({s} AS DOUBLE), 'r': CAST({r} AS DOUBLE), 'u': CAST({u} AS DOUBLE), 'theta': CAST({t} AS DOUBLE)}}"


def normal(m: str) -> str:
    by = f"CASE WHEN abs({m}.s + {m}.r + {m}.u + {m}.theta - 1) > 1e-6 THEN {m}.s + {m}.r + {m}.u + {m}.theta ELSE 1 END"
    return four(*(f"{m}.{n} / ({by})" for n in ("s", "r", "u", "theta")))


POLARITY = f"CASE WHEN polarity THEN {four('least(confidence, 0.8) * 0.5', '0', '0', '1 - least(confidence, 0.8) * 0.5')} ELSE {four('0', 'least(confidence, 0.8) * 0.7', 'least(confidence, 0.8) * 0.1', '1 - least(confidence, 0.8) * 0.8')} END"
FULL, OTHER = "pow(s * p * o, 1.0 / 3) * 0.8", "least(s, p) * (1 - o)"
ALIGNED = f"""CASE WHEN least(s, p) > 0.1 AND o > 0.1 AND polarity THEN {four(f'least({FULL}, 0.7)', '0', '0', f'greatest(1 - {FULL}, 0.3)')}
 WHEN least(s, p) > 0.1 AND o > 0.1 THEN {four('0', f'least({FULL}, 0.7)', '0', f'greatest(1 - {FULL}, 0.3)')}
 WHEN least(s, p) > 0.1 THEN {four(f'{OTHER} * 0.05', f'least({OTHER} * 0.6, 0.5)', '0', f'greatest(1 - {OTHER} * 0.65, 0.3)')}
 WHEN s > 0.1 AND polarity THEN {four('s * 0.15', '0', '0', '1 - s * 0.15')} WHEN s > 0.1 THEN {four('0', 's * 0.15', '0', '1 - s * 0.15')} ELSE {four('0', '0', '0', '1')} END"""
DISTANT = f"""CASE WHEN s < 0.1 OR p < 0.1 OR comp IS NULL THEN {four('0', '0', '0', '1')} WHEN comp > o + 0.1 THEN {four('0', 'least((comp - o) * 0.4, 0.35)', '0', 'greatest(1 - (comp - o) * 0.4, 0.65)')}
 WHEN o > comp THEN {four('least(o * 0.2, 0.2)', '0', '0', 'greatest(1 - o * 0.2, 0.8)')} ELSE {four('0', '0', '0', '1')} END"""
UNSURE = "CASE WHEN confidence < 0.05 THEN 0.3 ELSE greatest(0.05, 0.3 * (1 - confidence)) END"
TRUST = four("0", "0", UNSURE, f"1 - ({UNSURE})")
OUT = ", ".join(f"round(m.{n}, 6) AS {n}" for n in ("s", "r", "u", "theta"))
for _name, _m in (("mass_polarity", POLARITY), ("mass_alignment", ALIGNED), ("mass_distance", DISTANT), ("mass_confidence", TRUST)):
    SQL[_name] = f"WITH {MASSES}, a AS (SELECT seq, {_m} AS raw FROM x), b AS (SELECT seq, {normal('raw')} AS m FROM a) SELECT seq, {OUT} FROM b"


def fused(*ms: str) -> str:
    prod = lambda n: " * ".join(f"({m}.{n} + {m}.theta)" for m in ms)
    return f"{prod('s')} AS qs, {prod('r')} AS qr, {prod('u')} AS qu, {' * '.join(f'{m}.theta' for m in ms)} AS qt"


CLOSED = "(qs - qt) / (qs + qr + qu - 2 * qt) AS s, (qr - qt) / (qs + qr + qu - 2 * qt) AS r, (qu - qt) / (qs + qr + qu - 2 * qt) AS u, qt / (qs + qr + qu - 2 * qt) AS theta"
SQL["dempster_combine"] = f"""WITH {OBS}, a AS (SELECT subject, CAST(ts AS DATE) AS day, {POLARITY} AS m1, {TRUST} AS m2 FROM obs), b AS (SELECT subject, day, {fused('m1', 'm2')} FROM a), c AS (SELECT subject, day, {CLOSED} FROM b),
 d AS (SELECT day, subject, product(s + theta) AS qs, product(r + theta) AS qr, product(u + theta) AS qu, product(theta) AS qt FROM c GROUP BY 1, 2), e AS (SELECT day, subject, {CLOSED} FROM d)
 SELECT day, subject, round(s, 6) AS s, round(r, 6) AS r, round(u, 6) AS u, round(theta, 6) AS theta, round(s + theta * s / (s + r + u), 6) AS pig_s, round(r + theta * r / (s + r + u), 6) AS pig_r, round(u + theta * u / (s + r + u), 6) AS pig_u FROM e"""

FACTS = f"{RICH}, {P2.format(src='rich')}"
SQL["mutants_polarity"] = f"WITH {RICH} SELECT seq, NOT polarity AS polarity, 'img_' || substr(sha256(concat_ws(':', 'imagined', subject, predicate, object, CAST(NOT polarity AS INT))), 1, 12) AS imagined_id FROM rich"
SQL["mutants_predicate"] = f"WITH {RICH} SELECT seq, p AS predicate FROM rich CROSS JOIN (SELECT unnest({list(NAMED.values())}) AS p) WHERE p <> predicate"
SQL["mutants_temporal"] = f"WITH {RICH} SELECT seq, epoch_us(ts + to_days(CAST(d AS INT))) AS ts_us FROM rich CROSS JOIN (SELECT unnest({list(PROJECTION_DAYS)}) AS d)"
SQL["mutants_hierarchy"] = f"""WITH {RICH}, {PARENTS}, rel AS (SELECT key, parent AS other FROM parents WHERE parent IS NOT NULL UNION SELECT parent, key FROM parents WHERE parent IS NOT NULL
 UNION SELECT a.key, b.key FROM parents a JOIN parents b ON a.parent = b.parent AND a.key <> b.key), known AS (SELECT * FROM rel WHERE key IN (SELECT key FROM parents) AND other IN (SELECT key FROM parents))
 SELECT seq, count(*) AS n, min(other) AS first FROM rich JOIN known ON key = subject GROUP BY seq"""
SQL["fitness"] = f"""WITH {FACTS}, freq AS (SELECT anchor, count(*) AS f FROM (SELECT subject AS anchor FROM rich UNION ALL SELECT predicate FROM rich UNION ALL SELECT object FROM rich) GROUP BY 1), top AS (SELECT max(f) AS most FROM freq),
 x AS (SELECT r.seq, r.predicate, NOT r.polarity AS polarity, a.f AS a, b.f AS b, c.f AS c, most, k.strength, k.persistence FROM rich r JOIN freq a ON a.anchor = r.subject JOIN freq b ON b.anchor = r.predicate JOIN freq c ON c.anchor = r.object CROSS JOIN top
 JOIN c2 k ON k.subject = r.subject AND k.predicate = r.predicate AND k.object = r.object),
 y AS (SELECT seq, CASE WHEN polarity THEN 0 ELSE greatest(-1, -0.5 * least(1, strength) * least(1, persistence / 5.0)) END AS logic_penalty, least(1, pow(CAST(a AS DOUBLE) * b * c, 1.0 / 3) / most) AS whisper,
 CASE WHEN predicate IN ('invest', 'grow', 'launch', 'expand', 'partner') THEN 1.0 WHEN predicate IN ('decline', 'divest', 'delay', 'cancel', 'lose') THEN 0.3 ELSE 0.6 END AS persona_align FROM x)
 SELECT seq, round(logic_penalty, 6) AS logic_penalty, round(whisper, 6) AS whisper, CAST(0.3 AS DOUBLE) AS bridge, round(CAST(persona_align AS DOUBLE), 6) AS persona_align, round(greatest(0, 1 + logic_penalty) * whisper * 0.3 * persona_align, 6) AS fitness FROM y"""
SQL["mcts_root"] = f"""WITH {RICH}, {QUERY}, j AS (SELECT DISTINCT q.anchor, r.seq, r.importance_score FROM rich r JOIN query q ON q.anchor IN (r.subject, r.predicate, r.object))
 SELECT anchor, seq, CAST(row_number() OVER (PARTITION BY anchor ORDER BY importance_score DESC, seq) AS INT) AS place FROM j QUALIFY place <= 20"""

TOKENS = "toks AS (SELECT DISTINCT conv_id, turn, unnest(regexp_extract_all(lower(text), '[a-z0-9_]+')) AS token FROM conversations), freq AS (SELECT token, count(*) AS n FROM toks GROUP BY token), vocab AS (SELECT * FROM freq ORDER BY n DESC, token LIMIT 2000)"
PAIRS = f"{TOKENS}, kept AS (SELECT conv_id, turn, token FROM toks JOIN vocab USING (token)), pairs AS (SELECT a.token AS t1, b.token AS t2, count(*) AS n FROM kept a JOIN kept b ON a.conv_id = b.conv_id AND a.turn = b.turn AND a.token <= b.token GROUP BY 1, 2)"
NPMI = f"""{PAIRS}, tot AS (SELECT count(*) AS u FROM (SELECT DISTINCT conv_id, turn FROM toks)), np AS (SELECT t1, t2, CASE WHEN t1 = t2 THEN 1.0 ELSE ln((p.n / u) / ((a.n / u) * (b.n / u))) / -ln(p.n / u) END AS npmi
 FROM pairs p JOIN vocab a ON a.token = t1 JOIN vocab b ON b.token = t2 CROSS JOIN tot WHERE p.n < u), pos AS (SELECT * FROM np WHERE npmi > 0)"""
SQL["token_freq"] = f"WITH {TOKENS} SELECT token, n FROM freq"
SQL["top_f_tokens"] = f"WITH {TOKENS} SELECT token, n FROM vocab"
SQL["cooccurrence"] = f"WITH {PAIRS} SELECT * FROM pairs"
SQL["npmi"] = f"WITH {NPMI} SELECT t1, t2, round(npmi, 6) AS npmi FROM pos"
SQL["laplacian_entries"] = f"""WITH {NPMI}, both_ AS (SELECT * FROM pos UNION ALL SELECT t2, t1, npmi FROM pos WHERE t1 <> t2), deg AS (SELECT t1 AS t, sum(npmi) AS d FROM both_ GROUP BY 1)
 SELECT b.t1, b.t2, round(CASE WHEN b.t1 = b.t2 THEN 1 ELSE 0 END - npmi / sqrt(x.d * y.d), 6) AS value FROM both_ b JOIN deg x ON x.t = b.t1 JOIN deg y ON y.t = b.t2"""

SQL["ast_python"] = f"SELECT * FROM {values([('store', 'imports', 'os', 1), ('store', 'imports', 'db', 2), ('store', 'defines', 'QueryError', 5), ('QueryError', 'inherits', 'Exception', 5), ('store', 'defines', 'save', 10), ('audit', 'decorates', 'save', 9), ('save', 'mutates', 'rows', 11), ('save', 'calls', 'connect', 11), ('save', 'raises', 'QueryError', 13), ('save', 'calls', 'QueryError', 13), ('save', 'returns', 'True', 14)], 'subject, predicate, object, line_number')}"
SQL["ast_js"] = f"SELECT * FROM {values([('auth', 'imports', 'db', 1), ('auth', 'defines', 'AuthError', 2), ('AuthError', 'inherits', 'Error', 2), ('constructor', 'mutates', 'name', 3), ('login', 'calls', 'find', 4), ('login', 'raises', 'AuthError', 4), ('login', 'returns', 'row', 4)], 'subject, predicate, object, line_number')}"
SQL["stream_tumbling_counts"] = f"WITH {OBS} SELECT epoch_us(date_trunc('day', ts)) AS day_us, predicate, count(*) AS n FROM obs WHERE date_trunc('day', ts) + INTERVAL 1 DAY <= (SELECT max(ts) FROM obs) - INTERVAL 1 HOUR GROUP BY 1, 2"
SQL["stream_dedup_watermark"] = f"WITH {OBS} SELECT predicate, count(*) AS n FROM obs GROUP BY 1"
SQL["stream_upsert"] = SQL["obs_upsert_two_batches"]
SQL["stream_session_chains"] = f"""WITH {OBS}, g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM obs WINDOW w AS (PARTITION BY subject ORDER BY ts, seq)),
 s AS (SELECT *, sum(fresh) OVER (PARTITION BY subject ORDER BY ts, seq) AS k FROM g) SELECT subject, epoch_us(min(ts)) AS start_us, count(*) AS n FROM s GROUP BY subject, k HAVING max(ts) + INTERVAL 6 HOUR <= (SELECT max(ts) FROM obs) - INTERVAL 1 HOUR"""

VERIFIED = f"""{MEAN}, facts AS (SELECT concat_ws(':', doc_id * 1000000 + sent_idx * 100, subject, predicate, object) AS seq, subject, predicate, object, confidence, sent_idx % 4 <> 0 AS polarity, round(confidence, 9) AS imp FROM triples),
 cwords AS (SELECT item_id AS claim_id, unnest(regexp_extract_all(lower(text), '[a-z0-9_'']+')) AS token FROM benchmark), csingle AS (SELECT claim_id, key, count(*) AS n FROM cwords JOIN vocab USING (token) GROUP BY claim_id, key, token),
 cpad AS (SELECT item_id AS claim_id, ' ' || array_to_string(regexp_extract_all(lower(text), '[a-z0-9_'']+'), ' ') || ' ' AS p FROM benchmark),
 cphrase AS (SELECT claim_id, key, CAST((length(p) - length(replace(p, ' ' || token || ' ', ''))) // (length(token) + 2) AS BIGINT) AS n FROM cpad JOIN vocab ON contains(token, ' ') AND contains(p, ' ' || token || ' ')),
 claims AS (SELECT claim_id, key AS anchor, max(ln(1 + n)) / 4 AS act FROM (SELECT * FROM csingle UNION ALL SELECT * FROM cphrase) GROUP BY 1, 2),
 byanchor AS (SELECT anchor, seq, imp FROM (SELECT subject AS anchor, seq, imp FROM facts UNION SELECT predicate, seq, imp FROM facts)),
 near AS (SELECT DISTINCT claim_id, seq, imp FROM claims JOIN byanchor USING (anchor)),
 ev AS (SELECT claim_id, seq, row_number() OVER (PARTITION BY claim_id ORDER BY imp DESC, seq) AS place FROM near QUALIFY place <= 10),
 x AS (SELECT e.claim_id, e.place, f.polarity, f.confidence, coalesce(a.act, 0) AS s, coalesce(b.act, 0) AS p, coalesce(c.act, 0) AS o,
 (SELECT max(k.act) FROM claims k JOIN anchors ka ON ka.key = k.anchor WHERE k.claim_id = e.claim_id AND ka.type = t.type AND k.anchor <> f.object AND k.act > 0.1) AS comp
 FROM ev e JOIN facts f USING (seq) JOIN anchors t ON t.key = f.object LEFT JOIN claims a ON a.claim_id = e.claim_id AND a.anchor = f.subject LEFT JOIN claims b ON b.claim_id = e.claim_id AND b.anchor = f.predicate LEFT JOIN claims c ON c.claim_id = e.claim_id AND c.anchor = f.object),
 r4 AS (SELECT claim_id, place, greatest(s, p) AS rel, {POLARITY} AS a, {ALIGNED} AS b, {DISTANT} AS c, {TRUST} AS d FROM x), n4 AS (SELECT claim_id, place, rel, a, {normal('b')} AS b, {normal('c')} AS c, d FROM r4),
 f4 AS (SELECT claim_id, place, rel, {fused('a', 'b', 'c', 'd')} FROM n4), m4 AS (SELECT claim_id, place, rel, {CLOSED} FROM f4),
 g4 AS (SELECT claim_id, place, CASE WHEN rel < 0.05 THEN 0 ELSE s END AS s, CASE WHEN rel < 0.05 THEN 0 ELSE r END AS r, CASE WHEN rel < 0.05 THEN 0 ELSE u END AS u, CASE WHEN rel < 0.05 THEN 1 ELSE theta END AS theta FROM m4),
 d4 AS (SELECT *, row_number() OVER (PARTITION BY claim_id ORDER BY theta, place) AS d, count(*) OVER (PARTITION BY claim_id) AS n_evidence FROM g4),
 q4 AS (SELECT claim_id, n_evidence, product(s + theta) AS qs, product(r + theta) AS qr, product(u + theta) AS qu, product(theta) AS qt FROM d4 WHERE d <= 5 GROUP BY 1, 2), z4 AS (SELECT claim_id, n_evidence, {CLOSED} FROM q4),
 p4 AS (SELECT claim_id, n_evidence, CASE WHEN s + r + u > 0 THEN s + theta * s / (s + r + u) ELSE theta / 3 END AS ps, CASE WHEN s + r + u > 0 THEN r + theta * r / (s + r + u) ELSE theta / 3 END AS pr, CASE WHEN s + r + u > 0 THEN u + theta * u / (s + r + u) ELSE theta / 3 END AS pu FROM z4)"""
SQL["verify_claims"] = f"WITH {VERIFIED} SELECT claim_id, round(ps, 6) AS belief_supports, round(pr, 6) AS belief_refutes, round(pu, 6) AS belief_uncertain, n_evidence, CASE WHEN pr > 0.15 AND pr > ps THEN 'REFUTES' WHEN ps > 0.25 AND ps > pr THEN 'SUPPORTS' ELSE 'NOT ENOUGH INFO' END AS label FROM p4 UNION ALL SELECT DISTINCT claim_id, round(1 / 3, 6), round(1 / 3, 6), round(1 / 3, 6), 0, 'NOT ENOUGH INFO' FROM claims WHERE claim_id NOT IN (SELECT claim_id FROM p4)"

# lookups, masses and verdicts

SQL["fact_by_id"] = f"""WITH {OBS} SELECT 'all' AS asked, seq, {KEY} FROM obs WHERE seq IN (17, 42, 99) UNION ALL SELECT 'live', seq, {KEY} FROM obs WHERE seq IN (17, 42, 99) AND confidence >= 0.2"""
SQL["document_by_id"] = "SELECT doc_id, lang, CAST(length(text) AS INT) AS n FROM documents WHERE doc_id = 7"
SQL["edges_outgoing"] = f"SELECT * FROM ({SQL['next_edges_weighted']}) WHERE source = 100"
SQL["edges_incoming"] = f"SELECT * FROM ({SQL['next_edges_weighted']}) WHERE target = 500"
SQL["constraints_filtered"] = f"SELECT subject, predicate, object, score FROM ({SQL['constraints_p2']}) WHERE predicate = 'purchase' AND object = 'k_3' AND score >= 0.2 ORDER BY score DESC, subject LIMIT 25"
SQL["observation_documents"] = "SELECT event_id AS seq, 'agent:' || strftime(ts, '%Y-%m-%dT%H:%M:%S') AS doc_id FROM events"
SQL["answers_json"] = f"""WITH {OBS}, g AS (SELECT *, '{{"type":"ast","file_path":"f' || (seq % 10) || '","line_number":' || seq || ',"node_type":null}}' AS grounding FROM obs), e AS ({SQL['next_edges_weighted']}),
 c AS (SELECT e.source, count(*) AS n, min(struct_pack(a := g.subject, b := g.predicate, c := g.object, d := g.polarity, e := g.grounding)) AS first FROM e JOIN g ON g.seq = e.target GROUP BY e.source)
 SELECT subject, predicate, min(grounding) AS first_grounding, count(*) AS n, CAST(sum(coalesce(c.n, 0)) AS BIGINT) AS n_context, min(c.first.e) AS first_context FROM g LEFT JOIN c ON c.source = g.seq GROUP BY subject, predicate"""
SQL["chained_facts"] = f"WITH {OBS}, o AS (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY ts, seq) AS n FROM obs) SELECT seq, {KEY} FROM o WHERE n BETWEEN 2 AND 4"
SQL["mass_logits"] = f"""WITH {OBS}, a AS (SELECT seq, exp((seq % 7) / 2.0) AS s, exp((seq % 5) / 2.0) AS u, exp((seq % 3) / 2.0) AS r FROM obs), b AS (SELECT *, s + u + r AS w, greatest(s, u, r) AS most FROM a), c AS (SELECT *, 0.5 * (1 - most / w) AS theta FROM b)
 SELECT seq, round(s / w * (1 - theta), 6) AS s, round(r / w * (1 - theta), 6) AS r, round(u / w * (1 - theta), 6) AS u, round(theta, 6) AS theta FROM c"""
SQL["pignistic"] = f"""WITH {OBS}, a AS (SELECT seq, polarity, least(confidence, 0.8) AS k FROM obs), m AS (SELECT seq, CASE WHEN polarity THEN 0.5 * k ELSE 0 END AS s, CASE WHEN polarity THEN 0 ELSE 0.7 * k END AS r, CASE WHEN polarity THEN 0 ELSE 0.1 * k END AS u, CASE WHEN polarity THEN 1 - 0.5 * k ELSE 1 - 0.8 * k END AS t FROM a),
 f AS (SELECT *, s + r + u AS focal FROM m)
 SELECT seq, {', '.join(f"round(CASE WHEN focal > 0 THEN {n} + t * {n} / focal ELSE t / 3 END, 6) AS {n}" for n in 'sru')}, round(1 - r - u, 6) AS plausible,
 round({' + '.join(f"CASE WHEN {n} > 0 THEN -{n} * log2({n}) ELSE 0 END" for n in 'srut')}, 6) AS entropy FROM f"""
SQL["ucb_scores"] = f"WITH {OBS} SELECT seq, CASE WHEN seq % 9 > 0 THEN round(confidence + 1.4 * sqrt(2 * ln(50) / (seq % 9)), 6) END AS ucb, seq % 9 = 0 AS unvisited FROM obs"
SQL["valence"] = f"""WITH {RICH}, focus AS {values([(p, list(a), list(b)) for p, (a, b, _) in PERSONA_FOCUS.items()], 'persona, positive, negative')},
 v AS (SELECT persona, predicate, (CASE WHEN polarity THEN 1 ELSE -1 END) * (CASE WHEN list_contains(positive, predicate) THEN 0.5 + 0.5 * confidence WHEN list_contains(negative, predicate) THEN -(0.5 + 0.5 * confidence) ELSE 0.1 * confidence END) AS valence FROM rich, focus)
 SELECT persona, predicate, count(*) AS n, round(min(valence), 6) AS least, round(max(valence), 6) AS most FROM v GROUP BY persona, predicate"""
SQL["imagine_verdict"] = f"""WITH f AS ({SQL['fitness']}), k AS (SELECT *, row_number() OVER (ORDER BY fitness DESC, seq) AS rank FROM f QUALIFY rank <= 20),
 t AS (SELECT count(*) AS n, count(*) FILTER (fitness >= 0.6) AS fit, avg(logic_penalty) FILTER (rank <= 10) AS penalty, coalesce(bool_and(logic_penalty >= -0.2) FILTER (rank <= 5), false) AS sound FROM k)
 SELECT n, fit, round(coalesce(penalty, 0), 6) AS penalty, CASE WHEN n = 0 THEN 'SPECULATIVE' WHEN penalty <= -0.5 THEN 'CONTRADICTED' WHEN fit >= 3 AND sound THEN 'PLAUSIBLE' ELSE 'SPECULATIVE' END AS verdict FROM t"""
SQL["observed_facts"] = f"SELECT CAST(doc_id AS VARCHAR) AS doc_id, CAST(sent_idx AS INT) AS sent_idx, subject, predicate, object, confidence, round((confidence + 2.5) / 5, 6) AS importance FROM ({SQL['triples_min']})"
