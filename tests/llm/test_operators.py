"""The operators against brute force, held-out accuracy and hard cases."""

import hashlib
import math
import random
import re
import tracemalloc
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from noemata.llm import brown, components, language, mixing, packing, quality, simhash, suffixes, toxicity, urls, vectors
from noemata.llm.common import fold

from .fixtures import documents, frame

SMALL = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def text_of(row) -> str:
    return row[1] or ""


# quality rules


def test_quality_figures(spark):
    found = {(r.doc_id, r.n_words): r for r in quality.judge(frame(spark, extra=True)).collect()}
    for row in documents():
        text, words = text_of(row), WORD.findall(text_of(row))
        windows = Counter(tuple(words[k : k + 5]) for k in range(len(words) - 4))
        covered = {k + j for k in range(len(words) - 4) if windows[tuple(words[k : k + 5])] > 1 for j in range(5)}
        seen, dup = set(), 0
        for line in text.split("\n"):
            if WORD.search(line):
                dup += line in seen
                seen.add(line)
        r = found[row[0], len(words)]
        assert (r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered))
        assert r.base_failed == (len(words) < 10 or 100 * len(covered) > 20 * len(words)) and not (r.base_failed and r.kept)
    assert quality.judge(frame(spark, [])).count() == 0
    kept = quality.kept_documents(frame(spark, extra=True))
    assert kept.columns[:5] == ["doc_id", "text", "lang", "source", "n_chars"] and "votes" in kept.columns and kept.count() > 0


def test_quality_counts_long_words_of_every_text(spark):
    text = " ".join(w for k in range(30) for w in (f"{k:060d}", f"w{k:05d}"))
    found = quality.judge(frame(spark, [(1, text, "en", "a", len(text)), *documents()])).where("doc_id = 1 AND n_words = 60").first()
    assert found.n_long == 30 and found.votes[-1] == "b"


def test_quality_weighs_rules():
    patterns = {"ggggggggg" + "g-": 900, "ggbggggggg-": 60, "ggggbbbbggg"[:11]: 40}
    posterior, rules, share = quality.fit(patterns)
    assert posterior["gggggggggg-"] > 0.9 and posterior["ggbggggggg-"] < 0.5 and posterior["ggggbbbbggg"] < 0.5
    assert rules["symbols"][1] > rules["symbols"][0] and 0.8 < share < 1


# simhash


def brute_print(text: str) -> int:
    words = text.encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[k : k + 3]) for k in range(len(words) - 2)] or [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints: dict) -> dict:
    ids = sorted(prints)
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if (prints[a] ^ prints[b]).bit_count() <= 3:
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {i: root(i) for i in ids}


def test_simhash_matches_brute_force(spark):
    rows, base = documents(), documents()[3][1]
    rows += [(200 + k, base + " tail" * k, "en", "a", 1) for k in range(1, 5)]
    rows += [(None, base, "en", "a", 1), (None, base, None, None, 1), (None, "text that no other row has", "en", "a", 1), (None, None, "en", "a", 1)]
    found = simhash.near_duplicates(frame(spark, rows, extra=True)).collect()
    prints = {r[0]: brute_print(text_of(r)) for r in rows if r[0] is not None}
    told = brute_components(prints)
    want = [(r[0], brute_print(text_of(r)), None if r[0] is None else told[r[0]]) for r in rows]
    assert sorted(map(repr, want)) == sorted(repr((r.doc_id, r.print % 2**64, r.component_id)) for r in found)
    assert simhash.near_duplicates(frame(spark, [])).count() == 0


def test_similar_texts(spark):
    rng, rows = random.Random(9), []
    for i in range(6):
        words = [f"w{rng.randrange(5000)}" for _ in range(260)]
        rows.append((10 * i, " ".join(words), "en", "a", 1))
        for k in range(1, 5):
            other = list(words)
            for at in rng.sample(range(260), 4):
                other[at] = f"x{rng.randrange(5000)}"
            rows.append((10 * i + k, " ".join(other), "en", "a", 1))
        rows.append((10 * i + 5, " ".join(words[:130] + [f"y{rng.randrange(5000)}" for _ in range(130)]), "en", "a", 1))
    found = {r.doc_id: r.component_id for r in simhash.similar(frame(spark, rows, extra=True)).collect()}
    want = {i: i if i % 10 == 5 else i - i % 10 for i in (r[0] for r in rows)}
    assert sum(found[i] == want[i] for i in want) >= 0.9 * len(want) and all(found[i] == i for i in want if i % 10 == 5)
    kept = simhash.representatives(frame(spark, [*rows, *documents()], extra=True))
    groups = simhash.similar(frame(spark, [*rows, *documents()]))
    ids = sorted(r.doc_id for r in kept.where("doc_id IS NOT NULL").collect())
    assert ids == sorted({r.component_id for r in groups.collect()}) and kept.where("doc_id IS NULL").count() == 1
    assert simhash.representatives(frame(spark, [])).count() == 0


def edited(n: int = 150, seed: int = 11) -> list[tuple]:
    """Texts, and copies of each with one to twelve scattered words changed: Jaccard 0.6 to 1 in five-word shingles."""
    rng, rows = random.Random(seed), []
    for i in range(n):
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.randint(60, 260))]
        rows.append((20 * i, " ".join(words), "en", "a", 1))
        for k in range(1, 4):
            other = list(words)
            for at in rng.sample(range(len(words)), rng.randint(1, max(2, len(words) // 20))):
                other[at] = f"x{rng.randrange(5000)}"
            rows.append((20 * i + k, " ".join(other), "en", "a", 1))
    return rows


def true_links(rows: list[tuple], least: float = 0.8) -> dict[tuple[int, int], float]:
    """Pairs at least so similar, by the exact Jaccard of sets of five-word shingles."""
    sets, having = {}, defaultdict(set)
    for r in rows:
        words = (r[1] or "").encode().lower().split()
        sets[r[0]] = {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))}
        for x in sets[r[0]]:
            having[x].add(r[0])
    pairs = {(a, b) for ids in having.values() for a in ids for b in ids if a < b}
    return {p: j for p in pairs if (j := len(sets[p[0]] & sets[p[1]]) / len(sets[p[0]] | sets[p[1]])) >= least}


def test_candidates_are_complete(spark):
    rows = edited()
    shared = " ".join(f"c{k}" for k in range(80))
    rows += [(9000 + k, f"{shared} {' '.join(f'd{k}_{j}' for j in range(15 + k))}", "en", "a", 1) for k in range(8)]
    want = set(true_links(rows))
    distinct = simhash.profiles(frame(spark, rows), 0.8, 5).withColumnRenamed("doc_id", "node").cache()
    found = {(r.u, r.v) for r in simhash.candidates(distinct, 0.8).collect()}
    assert len(want) > 100 and want <= found
    told = {(r.u, r.v) for r in simhash.filtered(simhash.candidates(distinct, 0.8), distinct, 0.8).collect()}
    assert want <= told < found
    alone = simhash.entries_of(distinct).withColumn("component", F.col("node")).join(distinct.select("node", "bits"), "node")
    assert {(r.u, r.v) for r in simhash.meeting_apart(alone, 0.8, None).collect()} == told
    assert {(r.u, r.v) for r in simhash.meeting_apart(alone, 0.8, 1).collect()} < told


def test_similar_matches_exact_jaccard(spark):
    rows = edited()
    parent = {r[0]: r[0] for r in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in true_links(rows):
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    assert {r.doc_id: r.component_id for r in simhash.similar(frame(spark, rows)).collect()} == {i: root(i) for i in parent}


def test_similar_takes_the_candidates_of_the_fingerprint_search(spark, monkeypatch):
    rows, asked = edited(40), []
    monkeypatch.setattr(simhash, "links", lambda distinct, *a, f=simhash.links, **b: asked.append(distinct.count()) or f(distinct, *a, **b))
    monkeypatch.setattr(simhash, "meeting", lambda entries, *a, f=simhash.meeting, **b: f(entries.limit(0), *a, **b))
    found = {r.doc_id: r.component_id for r in simhash.similar(frame(spark, rows)).collect()}
    prints, want = {r[0]: brute_print(r[1]) for r in rows}, true_links(rows)
    near = [p for p in want if (prints[p[0]] ^ prints[p[1]]).bit_count() <= 3]
    assert asked == [len(set(prints.values()))] and len(near) > 10
    assert sum(found[a] == found[b] for a, b in near) >= 0.9 * len(near)  # alone, without the prefixes
    told = {i: i for i in found}
    for a, b in sorted(want):  # and nothing that isn't alike
        told = {i: told[a] if x == told[b] else x for i, x in told.items()}
    assert all(told[i] == told[c] for i, c in found.items())


def test_bit_maps_lose_no_similar_pair():
    rng = np.random.default_rng(3)
    pruned = 0
    for n in (1, 3, 50, 63, 64, 65, 120, 128, 129, 260, 1000, 1025):
        for share in (1.0, 0.95, 0.9, 0.85, 0.7, 0.3):
            a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
            b = np.unique(np.concatenate([a[: int(len(a) * share)], rng.integers(0, 2**63, int(n * (1.1 - share))).astype(np.uint64)]))
            maps = [np.frombuffer(simhash.parities(x), np.uint64)[None] for x in (a, b)]
            width = min(m.shape[1] for m in maps)
            told = simhash.possible(np.array([len(a)]), simhash.folded(maps[0], width), np.array([len(b)]), simhash.folded(maps[1], width), 0.8)[0]
            exact = simhash.jaccard(a, b) >= 0.8
            assert told or not exact
            pruned += not told
    assert pruned >= 20


@pytest.mark.parametrize("most", [4000, 6])
def test_links_lose_none_where_values_are_full(spark, most):
    rng = np.random.default_rng(5)
    centres = rng.integers(0, 2**63, 6)
    prints = {0}
    for c in centres.tolist():
        for _ in range(40):
            x = c
            for b in rng.integers(0, 64, rng.integers(0, 4)).tolist():
                x ^= 1 << b
            prints.add(x)
    rows = [(p - 2**64 if p >= 2**63 else p, i) for i, p in enumerate(sorted(prints))]
    df = spark.createDataFrame(rows, "print long, node long")
    found = components.components(simhash.links(df, most=most))
    told = {i: i for _, i in rows} | {r.node: r.component for r in found.collect()}
    assert told == brute_components({i: p % 2**64 for p, i in rows})


def test_radii_cover_the_distance():
    assert sum(t + 1 for t in simhash.allocate([[0, 5, 50], [0, 1, 100], [0, 7, 9], [0, 1e9, 1e9]], 4)) == 4
    assert simhash.allocate([[0, 5, 50], [0, 1, 100], [0, 7, 9], [0, 1e9, 1e9]], 4) == [0, 0, 1, -1]


@pytest.mark.parametrize("hub", [5, 10**6])
def test_components_with_hubs(spark, monkeypatch, hub):
    monkeypatch.setattr(components, "HUB", hub)
    links = [(7, k) for k in range(100, 140)] + [(k, k + 50) for k in range(100, 120)] + [(300, k) for k in range(301, 330)] + [(329, 150), (400, 401)]
    found = {r.node: r.component for r in components.components(spark.createDataFrame(links, "u long, v long")).collect()}
    nodes = {x for pair in links for x in pair}
    assert found == {x: 7 if x < 200 else 7 if x in range(300, 330) else 400 for x in nodes if x not in (7, 400)}


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(200) if i != 120] + [(5, 5)], "u long, v long")
    found = {r.node: r.component for r in components.components(links).collect()}
    assert all(found[i] == (0 if i <= 120 else 121) for i in found) and len(found) in (199, 200, 201)


@pytest.mark.parametrize("share", [3, 30])
def test_components_of_more_links_than_a_task_takes(spark, monkeypatch, share):
    monkeypatch.setattr(components, "SHARE", share)
    links = [(i, i + 1) for i in range(60) if i != 40] + [(90, k) for k in range(50, 58)] + [(5, 5)]
    found = {r.node: r.component for r in components.components(spark.createDataFrame(links, "u long, v long").repartition(4)).collect()}
    assert {i: c for i, c in found.items() if i != c} == {i: 0 if i <= 40 else 41 for i in [*range(61), 90] if i not in (0, 41)}


def test_components_of_few_links_take_few_jobs(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(100)], "u long, v long")
    spark.sparkContext.setJobGroup("few", "few")
    found = {r.node: r.component for r in components.components(links).collect()}
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("few")
    spark.sparkContext.setJobGroup("others", "others")
    assert found == {i: 0 for i in range(1, 101)} and 0 < len(jobs) <= 6


# suffix arrays


def brute_removed(rows: list[tuple], length: int = 100) -> list:
    """For each row, which bytes lie in a string that also starts earlier: in a smaller id, or further up in the row."""
    least, out = {}, []
    key = lambda i: (i is None, i or 0)
    for r in rows:
        b = text_of(r).encode()
        for p in range(len(b) - length + 1):
            s = b[p : p + length]
            if s not in least or key(r[0]) < least[s]:
                least[s] = key(r[0])
    for r in rows:
        b, seen = text_of(r).encode(), set()
        cover = np.zeros(len(b) + 1, int)
        for p in range(len(b) - length + 1):
            s = b[p : p + length]
            if s in seen or least[s] < key(r[0]):
                cover[p] += 1
                cover[p + length] -= 1
            seen.add(s)
        out.append(np.cumsum(cover[:-1]) > 0)
    return out


def awkward() -> list[tuple]:
    """The hard table, with several texts without id and of one id, some of which share passages with others."""
    rows, rng = documents(), random.Random(8)
    words = lambda n: " ".join(f"w{rng.randrange(900)}" for _ in range(n))
    shared, own = rows[0][1], words(60)
    line = "the one line that very many documents hold, whatever else is in them"
    rows += [(None, f"{words(20)} {shared} {words(9)}", "en", "a", 1), (None, words(50), "en", "a", 1), (None, own, "en", "a", 1), (None, f"x {own}", "en", "a", 1), (None, f"x {own}", "en", "a", 1)]
    rows += [(2, words(40), "en", "a", 1), (2, f"{words(7)} {own}", "en", "a", 1), (2, f"{own} {own}", "en", "a", 1)]
    return rows + [(400 + k, f"{words(30)} {line} {words(30)}", "en", "a", 1) for k in range(60)]


def removed_runs(mask: np.ndarray) -> list[tuple[int, int]]:
    at = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(int), [0]])))
    return list(zip(at[::2].tolist(), at[1::2].tolist(), strict=True))


@pytest.mark.parametrize("crowd", [16, 2])
def test_suffix_dedup_matches_brute_force(spark, monkeypatch, crowd):
    monkeypatch.setattr(suffixes, "CROWD", crowd)
    rows, want = awkward(), []
    for r, mask in zip(rows, brute_removed(rows), strict=True):
        b = text_of(r).encode()
        want.append((r[0], len(b), int(mask.sum()), len(removed_runs(mask)), hashlib.sha256(np.frombuffer(b, np.uint8)[~mask].tobytes()).hexdigest()))
    found = suffixes.deduplicate(frame(spark, rows, extra=True)).collect()
    assert sorted(map(repr, want)) == sorted(repr((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256)) for r in found)
    assert suffixes.deduplicate(frame(spark, [])).count() == 0
    shorter = suffixes.deduplicated(frame(spark, rows, extra=True))
    kept = [(r[0], None if r[1] is None else suffixes._keep(r[1].encode(), suffixes._whole(r[1].encode(), removed_runs(m))).decode()) for r, m in zip(rows, brute_removed(rows), strict=True)]
    assert sorted(map(repr, kept)) == sorted(repr((r.doc_id, r.text)) for r in shorter.collect())
    assert all(len(r.text or "") == (r.n_chars or 0) for r in shorter.collect())


@pytest.mark.parametrize("paired,chunk,local,crowd", [(2, 700, 50, 16), (128, 300, 1_000, 3), (1024, 1 << 20, 400, 1)])
def test_suffix_dedup_in_small_pieces(monkeypatch, paired, chunk, local, crowd):
    """Windows string by string, long documents in stretches, crowded anchors, and many flushes give the same."""
    for name, value in (("PAIRED", paired), ("CHUNK", chunk), ("LOCAL", local), ("BATCH", 64), ("CROWD", crowd)):
        monkeypatch.setattr(suffixes, name, value)
    import pyarrow as pa

    rows = list({(r[0], text_of(r)): r for r in awkward() if len(text_of(r)) < 10_000}.values())
    ids = [r[0] if r[0] is not None else suffixes.LAST_ID for r in rows]
    subs, texts = [xxhash.xxh64_intdigest(text_of(r)) % 2**62 for r in rows], [text_of(r) for r in rows]
    batch = pa.RecordBatch.from_pydict({"doc": pa.array(ids), "sub": pa.array(subs), "text": pa.array(texts)})

    def dealt(batches, n=3):
        """By route, as the shuffle does it."""
        whole = pa.Table.from_batches(list(batches))
        route = np.asarray(whole.column("route").combine_chunks()) % n
        return [iter(whole.filter(pa.array(route == k)).to_batches()) for k in range(n)]

    first = [x for part in dealt(suffixes._contexts(100, 32)(iter([batch]))) for b in suffixes._settle(100, 32, False)(part) for x in b.to_pylist()]
    opened = defaultdict(list)
    for x in first:
        if x["kind"] != suffixes.STRETCH:
            opened[x["doc"], x["sub"]].append({k: x[k] for k in ("kind", "k1", "lo", "hi")})
    of = dict(zip(zip(ids, subs, strict=True), texts, strict=True))
    again = pa.RecordBatch.from_pydict({"doc": pa.array([k[0] for k in opened]), "sub": pa.array([k[1] for k in opened]), "text": pa.array([of[k] for k in opened]), "open": pa.array(list(opened.values()))})
    second = [x for part in dealt(suffixes._reopened(100)(iter([again]))) for b in suffixes._settle(100, 32, True)(part) for x in b.to_pylist()]
    got = {k: np.zeros(len(t.encode()), bool) for k, t in of.items()}
    for x in [*first, *second]:
        if x["kind"] == suffixes.STRETCH:
            got[x["doc"], x["sub"]][x["lo"] : x["hi"]] = True
    assert all((got[k] == m).all() for k, m in zip(zip(ids, subs, strict=True), brute_removed(rows), strict=True))


def test_family_tells_what_came_before():
    rng = np.random.default_rng(1)
    family, least, seen = suffixes.Family(), {}, set()
    for batch in range(40):
        n = 50
        k1, k2 = (rng.integers(0, 30, n).astype(np.uint64) for _ in range(2))
        doc, sub = np.sort(rng.integers(0, 4, n) + batch), np.zeros(n, np.int64)
        sub = np.where(rng.random(n) < 0.4, rng.integers(0, 3, n), 0)
        order = np.lexsort((sub, doc))
        doc, sub = doc[order] if batch == 0 else np.maximum(doc[order], last), sub[order]
        order = np.lexsort((sub, doc))
        doc, sub = doc[order], np.where(doc[order] == (last if batch else -1), np.maximum(sub[order], top if batch else 0), sub[order])
        order = np.lexsort((sub, doc))
        doc, sub = doc[order], sub[order]
        last, top = int(doc[-1]), int(sub[-1])
        again = family.add(k1, k2, doc, sub)
        for a, b, d, u, x in zip(k1.tolist(), k2.tolist(), doc.tolist(), sub.tolist(), again.tolist(), strict=True):
            assert x == (least.get((a, b), d) < d or (a, b, d, u) in seen)
            least.setdefault((a, b), d)
            seen.add((a, b, d, u))
    sizes = [len(x[0]) for x in family.levels]
    assert sum(sizes) == len(least) and all(a > 2 * b for a, b in zip(sizes, sizes[1:], strict=False))


def test_suffix_array_is_in_order_with_its_common_prefixes():
    rng, side, length = random.Random(3), 8, 20
    own, reach, key = [], [], []
    for _ in range(60):
        left, right = rng.randint(0, side), rng.randint(6, length)
        own.append("".join(rng.choice("ab") for _ in range(left + right)).encode())
        reach.append((left << 32) | right)
        key.append(rng.randrange(3))
    array = suffixes.SuffixArray(np.array(key), np.array(reach), own, side, length)
    suffix = [(key[k], own[k][reach[k] >> 32 :].ljust(24, b"\0")) for k in array.order.tolist()]
    assert suffix == sorted(suffix)
    got = {}
    for i, j, left, right in array.pairs():
        for a, b, x, y in zip(i.tolist(), j.tolist(), left.tolist(), right.tolist(), strict=True):
            got[tuple(sorted((int(array.order[a]), int(array.order[b]))))] = (x, y)

    def common(x, y):
        return next((k for k, (p, q) in enumerate(zip(x, y, strict=False)) if p != q), min(len(x), len(y)))

    for a in range(60):
        for b in range(a + 1, 60):
            la, lb = reach[a] >> 32, reach[b] >> 32
            want = (common(own[a][:la][::-1], own[b][:lb][::-1]), common(own[a][la:], own[b][lb:]))
            if key[a] == key[b] and want[1]:
                assert got[a, b] == want
            else:
                assert (a, b) not in got


# mixing


def brute_targets(sizes: dict, weights=(5, 2, 1)) -> dict:
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % 3] for i, s in enumerate(order)}
    budget, full = 1.5 * sum(sizes.values()), {}
    while True:
        left = [s for s in order if s not in full]
        level = (budget - sum(full.values())) / sum(w[s] for s in left) if left else 0
        over = [s for s in left if level * w[s] > 2 * sizes[s]]
        if not over:
            return full | {s: level * w[s] for s in left}
        full |= {s: 2.0 * sizes[s] for s in over}


def test_mixing(spark):
    rows = documents()
    found = mixing.mix(frame(spark, extra=True)).collect()
    assert len(found) == len(rows)
    sizes = Counter()
    for r in rows:
        sizes[r[3]] += len(WORD.findall(text_of(r)))
    want = brute_targets(sizes)
    own = {r[0]: (len(WORD.findall(text_of(r))), r[3]) for r in rows}
    taken, largest = Counter(), Counter()
    for r in found:
        size, source = own[r.doc_id]
        assert r["size"] == size and abs(r.target - want[source]) < 1e-6 and r.source_size == sizes[source] and r.taken <= 2 * size
        taken[source] += r.taken
        largest[source] = max(largest[source], size)
    assert all(abs(taken[s] - want[s]) <= 2 * max(largest.values()) for s in want) and sum(taken.values()) <= sum(want.values()) + 1e-6
    again = mixing.mix(frame(spark).repartition(5)).select("doc_id", "size", "copies")
    assert sorted(map(str, again.collect())) == sorted(str(r) for r in mixing.mix(frame(spark)).select("doc_id", "size", "copies").collect())
    copied = mixing.mixed_documents(frame(spark, extra=True))
    assert Counter(r.doc_id for r in copied.collect()) == Counter({k: n for k, n in _copies(found).items() if n})
    assert mixing.mix(frame(spark, [])).count() == 0 and mixing.mixed_documents(frame(spark, [])).count() == 0


def _copies(found) -> Counter:
    out = Counter()
    for r in found:
        out[r.doc_id] += r.copies
    return out


def test_mixing_runs_without_python(spark):
    plan = mixing.mix(frame(spark))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# packing


def test_packing(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rows = [*documents(), (300, "It's 3.5 <|endoftext|> don't, STOP... a.b Ünïcode x y é ½ 'll", "en", "a", 1)]
    found = packing.pack(frame(spark, rows, extra=True), length=512, with_ids=True).collect()
    ids = {r[0]: [*tokenizer.encode(text_of(r), add_special_tokens=False).ids, 2] for r in rows}
    per_doc = defaultdict(list)
    for r in found:
        assert r.ids == ids[r.doc_id][r.start : r.start + r.length] and r.doc_tokens == len(ids[r.doc_id])
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        per_doc[r.doc_id] += list(range(r.start, r.start + r.length))
    copies = Counter(r[0] for r in rows)
    assert all(sorted(per_doc[i]) == sorted(list(range(len(x))) * copies[i]) for i, x in ids.items())
    filled = defaultdict(list)
    for r in found:
        filled[r.sequence_id].append((r.offset, r.length))
    for parts in filled.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 512
    assert packing.pack(frame(spark, [])).count() == 0


def test_packing_learns_each_word_once(monkeypatch):
    """Marks after a word are no reason to encode it again, and small batches go through the encoder together; the ids are the tokenizer's, also where few words are remembered."""
    import public_tokenizers
    from tokenizers import Tokenizer

    vocabulary, learned, learn = public_tokenizers.path("word_bpe_49k.json"), [], packing.Ids._learn
    monkeypatch.setattr(packing.Ids, "_learn", lambda self, words: learned.extend(words) or learn(self, words))
    tokenizer = Tokenizer.from_file(vocabulary)
    packing.remembered("packing").clear()
    packing.Ids(vocabulary, 100).of(pa.array(["River.!! river,%%% river river. (RIVER)", None, "", " river.!! river,%%%\n"]))
    assert sorted(learned) == [b"(river", b")", b",%%%", b".", b".!!", b"river"]
    rows = ["it's. x'. 'll! don't.' a.b, É. é.!! ½.", None, "", " \t\u00a0x.\u0085 ", "Foo.<|endoftext|>. STOP.|> <|ENDOFTEXT|>", "x.\u0301 a<\u0338 İ. ß.", "no " * 40 + "#" * 300]
    want = [np.array(tokenizer.encode(x or "", add_special_tokens=False).ids, "<u4").tobytes() for x in rows]
    for most in (1, 3, 1000):
        packing.remembered("packing").clear()
        encoder = packing.Ids(vocabulary, most)
        assert [encoder.of(pa.array(rows * 2)) for _ in range(3)] == [want * 2] * 3
    packing.remembered("packing").clear()
    batches = [pa.RecordBatch.from_pydict({"doc_id": [i], "text": [x]}, schema=pa.schema({"doc_id": pa.int64(), "text": pa.string()})) for i, x in enumerate(rows)]
    assert [b.to_pydict() for b in packing._gathered(iter(batches))] == [{"doc_id": list(range(len(rows))), "text": rows}]
    monkeypatch.setattr(packing, "AT_ONCE", 50)
    assert [x for b in packing._gathered(iter(batches)) for x in b["text"].to_pylist()] == rows


def test_shortest_pack_first():
    got = packing.place({6: 2, 4: 1, 3: 3, 1: 1}, 10)
    assert got == [(6, 0, 2, 0, 0), (4, 0, 1, 0, 6), (3, 0, 1, 1, 6), (3, 1, 2, 2, 0), (1, 0, 1, 2, 3)]


# language-model scores


def test_class_bigrams(spark):
    df = frame(spark, extra=True)
    held = fold("doc_id", 7) == 2
    train = [r for r in documents() if r[0] is None or zlib.crc32(str(r[0]).encode()) % 7 != 2]
    found = brown.score(df, ~F.coalesce(held, F.lit(False)), n_seed=20, n_endings=8, n_classes=5, n_near=12).collect()
    counts = Counter(t for r in train for t in brown.tokens(text_of(r).encode()))
    n, v = sum(counts.values()), len(counts)
    for r, row in zip(sorted(found, key=lambda r: (r.doc_id is None, r.doc_id or 0, r.n_tokens)), sorted(documents(), key=lambda r: (r[0] is None, r[0] or 0)), strict=True):
        words = brown.tokens(text_of(row).encode())
        assert (r.n_tokens, r.train_tokens, r.n_known) == (len(words), n, sum(w in counts for w in words))
        assert math.isclose(r.base_score, sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in words), rel_tol=1e-9)
        assert r.score <= 1e-9
    none = brown.score(df, F.lit(False)).collect()
    assert all(r.n_known == 0 and r.train_tokens == 0 and r.score < 0 for r in none) and len(none) == len(documents()) and brown.score(df.limit(0), F.lit(True)).count() == 0


@pytest.mark.parametrize("options", [dict(n_seed=6, n_endings=4, n_classes=3, n_near=14, min_count=2), dict(n_seed=40, n_endings=4, n_classes=5, n_near=40), dict(n_seed=3, n_endings=2, n_classes=4)])
def test_class_bigram_scores_match_brute_force(spark, options):
    """Counts, class bigrams and scores in plain Python, with the classes that exchange clustering gave."""
    rows = [r for r in documents() if r[0] is not None and r[0] < 103] + [(900, "the unseen other river", "en", "a", 1)]
    model, counted, encoded = brown.fit(frame(spark, rows), F.col("doc_id") < 40, **options)
    texts = [brown.tokens(text_of(r).encode()) for r in documents() if r[0] is not None and r[0] < 40]
    counts = Counter(t for x in texts for t in x)
    assert {bytes(r.word): r.c for r in counted.collect()} == counts
    of = {w: model.class_of(w) for w in [*counts, b"unseen", b"other"]}
    follows = Counter((of[a], of[b]) for x in texts for a, b in zip([brown.END, *x], x, strict=False))
    k = options["n_classes"]
    assert {(a, b): model.table[a, b] for a in range(k) for b in range(k) if model.table[a, b]} == follows
    held, types = Counter(), Counter()
    for w, c in counts.items():
        held[of[w]] += c
        types[of[w]] += 1
    total = sum(follows.values())
    into, out = Counter(), Counter()
    for (a, b), c in follows.items():
        into[b] += c
        out[a] += c

    def chance(before, word):
        share = (into[of[word]] + 1) / (total + k)
        step = (follows[of[before], of[word]] + 20 * share) / (out[of[before]] + 20)
        own = counts[word] - 0.75 if word in counts else 0.75 * types[of[word]] + 1
        return step * own / (held[of[word]] + 1)

    for before in (brown.END, b"the", b"unseen"):  # over all seen words and one unseen word of each class
        unseen = sum((follows[of[before], c] + 20 * (into[c] + 1) / (total + k)) / (out[of[before]] + 20) * (0.75 * types[c] + 1) / (held[c] + 1) for c in range(k))
        assert math.isclose(sum(chance(before, w) for w in counts) + unseen, 1, rel_tol=1e-9)
    got = {r.doc_id: r.score for r in brown.scored(model, counted, encoded).collect()}
    for r in rows:
        x = brown.tokens(text_of(r).encode())
        for w in x:
            of.setdefault(w, model.class_of(w))
        assert math.isclose(got[r[0]], sum(math.log10(chance(a, b)) for a, b in zip([brown.END, *x], x, strict=False)), rel_tol=1e-9)


def test_items_hold_few_words_and_tell_all():
    tracemalloc.start()
    items = brown.Items([b"a", b"b"], 7)
    told = all(items[b"w%d" % k] == 2 + brown.ending(b"w%d" % k, 7) for k in range(400_000))
    held = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert told and held < 30e6


def test_later_words_move_to_the_best_class():
    """Moving each word alone by the gains is what the likelihood of the class bigrams says."""
    rng = np.random.default_rng(8)
    table = rng.integers(20, 60, (4, 4)).astype(float)
    right, left, was = rng.integers(0, 9, (30, 4)).astype(float), rng.integers(0, 9, (30, 4)).astype(float), rng.integers(0, 4, 30)

    def likelihood(t):
        phi = lambda x: float((x * np.log(np.maximum(x, 1))).sum())
        return phi(t) - phi(t.sum(0)) - phi(t.sum(1))

    got = brown.moved_to(table, right, left, was, block=7)
    for w in range(30):
        without = table.copy()
        without[was[w]] -= right[w]
        without[:, was[w]] -= left[w]
        found = []
        for c in range(4):
            t = without.copy()
            t[c] += right[w]
            t[:, c] += left[w]
            found.append(likelihood(t))
        assert math.isclose(found[got[w]], max(found), abs_tol=1e-6)


def test_clustered_vocabulary_grows(spark):
    rows = [(i, " ".join(f"{'ab'[(i + j) % 2]}{(i * 7 + j) % 60}x{j % 3}" for j in range(40)), "en", "s", 9) for i in range(60)]
    model, counted, _ = brown.fit(frame(spark, rows), F.lit(True), n_seed=10, n_endings=3, n_classes=4)
    alone = sum(int(model.classes[i]) != int(model.classes[len(model.near) + brown.ending(w, 3)]) for i, w in enumerate(model.near[10:], 10))
    assert counted.count() > 60 and alone > 10


def test_exchange_finds_two_classes():
    rng = np.random.default_rng(2)
    follows = np.zeros((8, 8))
    for i in range(8):
        for j in range(8):
            follows[i, j] = rng.integers(90, 110) if (i < 4) != (j < 4) else rng.integers(0, 3)
    of = brown.exchange(follows, 2)
    assert len(set(of[:4])) == 1 and len(set(of[4:])) == 1 and of[0] != of[4]


# toxicity, language


def brute_windows(text: bytes) -> list[bytes]:
    words, out, start = text.lower().split(), [], 0
    while start < len(words):
        out.append(b" " + b" ".join(words[start : start + toxicity.WINDOW]) + b" ")
        if start + toxicity.WINDOW >= len(words):
            break
        start += toxicity.WINDOW // 2
    return out


@pytest.mark.parametrize("stretch", [7, 300, 1 << 20])
def test_toxicity_windows(monkeypatch, stretch):
    monkeypatch.setattr(toxicity, "STRETCH", stretch)
    for n in (0, 1, 15, 16, 17, 31, 32, 33, 47, 48, 49, 64, 65, 500):
        text = " \n".join(f"Word{k}" for k in range(n)).encode()
        assert list(toxicity.windows(text)) == brute_windows(text), n
    assert list(toxicity.windows(b" \t ")) == []


def insulting(n: int = 120) -> tuple[list[tuple], list[tuple]]:
    """Texts of random words; those of odd id hold one of four words that no other text has."""
    rng, rows = random.Random(5), []
    for i in range(n):
        words = ["".join(rng.choice(["ta", "ro", "min", "ke", "sul", "po"]) for _ in range(3)) for _ in range(rng.randint(80, 160))]
        if i % 2:
            for at in rng.sample(range(len(words)), 5):
                words[at] = rng.choice(["grumblefoot", "snivelwort", "blatherskite", "mugwumpish"])
        rows.append((i, " ".join(words), "en", "a", 1))
    return rows, [(i, i % 2) for i in range(n)]


def test_toxicity_dictionaries_are_of_their_own_class(spark):
    """What the toxic dictionary is trained on occurs in toxic texts, in windows that the ordinary ones lack; and the other way round."""
    rows, labels = insulting()
    df, truth = frame(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int")
    sample, classes = toxicity.sampled(df, truth, 100)
    assert classes == {0: 60, 1: 60} and sample.count() == 120
    counts = {0: 60, 1: 60}
    own = toxicity.samples(sample, toxicity.telling_grams(sample, counts, 0.01, 8.0, 12.0), 1000)
    of = {k: [" " + r[1] + " " for r in rows if r[0] % 2 == k] for k in (0, 1)}
    assert own[1] and all(any(s.decode() in t for t in of[1]) and not any(s.decode() in t for t in of[0]) for s in own[1])
    assert all(any(s.decode() in t for t in of[0]) for s in own[0])
    trained = toxicity.train({s: 200 * n for s, n in own[1].items()}, size=256)[-100:]  # zstandard's tables come first
    assert sum(any(trained[k : k + 4] in s for s in own[1]) for k in range(97)) >= 60
    model = toxicity.fit(df, truth)
    assert b"grumblefoot" in model["toxic"] and b"grumblefoot" not in model["ordinary"]
    found = toxicity.score(df, model).collect()
    assert all((r.score >= 0.5) == bool(r.doc_id % 2) for r in found)


def test_toxicity_sample_has_one_of_texts_alike(spark):
    rows, labels = insulting(40)
    copies = [(100 + k, rows[1][1] + f" tail{k}", "en", "a", 1) for k in range(30)]
    sample, _ = toxicity.sampled(frame(spark, rows + copies), spark.createDataFrame(labels + [(100 + k, 1) for k in range(30)], "doc_id long, toxic int"), 100)
    kept = [r.text for r in sample.collect()]
    assert sum(t.startswith(rows[1][1]) for t in kept) <= 3 and len({t for t in kept if not t.startswith(rows[1][1])}) == 39


def test_toxicity_advantage_is_of_compressed_lengths():
    import zstandard

    ordinary, toxic = b"plain words here ", b" grumblefoot snivelwort "
    a = toxicity.Advantage(ordinary, toxic)
    text = b"some Grumblefoot came by with other grumblefoot folk"
    told = a.of(text)
    assert told.tolist() == [len(a.ordinary(toxicity.FRAME + w + toxicity.TAIL)) - len(a.toxic(toxicity.FRAME + w + toxicity.TAIL)) for w in brute_windows(text)] and told[0] > 4
    assert a.of(b"nothing to see").tolist() == [0] and isinstance(zstandard.__version__, str)


def test_toxicity_calibration():
    rng = np.random.default_rng(3)
    rows = [(0, rng.integers(-3, 2, 20)) for _ in range(200)] + [(1, np.append(rng.integers(-3, 2, 20), [9] * 3)) for _ in range(200)]
    threshold, coefficients = toxicity.calibrate(rows, (900, 100))
    p = [toxicity.chance(toxicity.features(a, threshold), coefficients) for _, a in rows]
    assert 2 <= threshold <= 9 and max(p[:200]) < 0.3 < min(p[200:])
    assert toxicity.features(np.zeros(0, np.int64), 3) == [0.0, 0.0, 0.0]


def test_toxicity_on_held_out(spark):
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    found = toxicity.op1_toxicity(spark, "/root/testdata/sf0.1").cache()
    told = found.join(labels, "doc_id").where("held_out").collect()
    clean = [r for r in told if not r.toxic]
    bad = [r for r in told if r.toxic]
    assert sum(r.predicted for r in bad) / len(bad) >= 0.8 and sum(r.predicted for r in clean) / len(clean) <= 0.03
    assert found.where("score < 0 OR score > 1 OR score IS NULL").count() == 0 and found.count() == spark.read.parquet("/root/testdata/sf0.1/documents.parquet").count()


def test_toxicity_cases(spark):
    df = frame(spark, extra=True)
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r.score for r in toxicity.score(df, toxicity.fit(df, none)).collect()} == {0.0}
    labels = spark.createDataFrame([(i, int(i % 2 == 0)) for i in range(30)] + [(3, None)], "doc_id long, toxic int")
    found = toxicity.score(df, toxicity.fit(df, labels))
    assert found.count() == len(documents()) and found.where("score IS NULL OR score < 0 OR score > 1").count() == 0
    assert toxicity.score(df.limit(0), toxicity.fit(df.limit(0), labels)).count() == 0


def test_lattice_sums_all_segmentations():
    pieces = {"a": 1, "b": 2, "ab": 3, "ba": 4, language.MARK: 5, language.MARK + "a": 6}
    chance = np.array([[0.0], [0.2], [0.1], [0.3], [0.05], [0.15], [0.2], [1e-9]])

    def brute(word):
        return 1.0 if not word else sum(chance[i, 0] * brute(word[len(p) :]) for p, i in pieces.items() if word.startswith(p))

    for word in ("a", "ab", "abab", "bbaab"):
        whole = language.MARK + word
        lattice = language.Lattice([whole], pieces, 2)
        assert math.isclose(lattice.forward(chance, 1)[1][-1][0, 0], math.log(brute(whole)), rel_tol=1e-9)
        assert math.isclose(language.Scorer(pieces, chance)._long(whole)[0], math.log(brute(whole)), rel_tol=1e-9)
        counts = np.zeros((8, 1))
        lattice.expected(chance, np.ones((1, 1)), counts)
        lengths = {i: len(p) for p, i in pieces.items()}
        assert math.isclose(sum(counts[i, 0] * n for i, n in lengths.items()), len(whole), rel_tol=1e-9)


def test_language_picks_are_the_first_of_each_language(spark):
    rng = random.Random(1)
    rows = sorted({(rng.choice(["en", "en", "en", "fr"]), rng.randrange(10**6)) for _ in range(3000)})
    df = spark.createDataFrame(rows, "lang string, doc_id long").repartition(7)
    got = sorted((r.lang, r.doc_id) for r in language.first_of(df, [F.col("doc_id")], 40).collect())
    assert got == sorted([x for x in rows if x[0] == "en"][:40] + [x for x in rows if x[0] == "fr"][:40])


def test_language_query_matches_brute_force(spark):
    """The query's answers from plain sums over segmentations, with the chances that it learned."""
    pieces = language.vocabulary("piece_bpe_32k.model")
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    languages, chance = language.fit(docs.select("doc_id", "text", "lang").where(fold("doc_id", 5) != 0), pieces)
    longest, last = max(map(len, pieces)), len(pieces) + 1

    def log_chances(word):
        sums = [np.ones(len(languages))] + [np.zeros(len(languages)) for _ in word]
        for stop in range(1, len(word) + 1):
            for start in range(max(0, stop - longest), stop):
                if i := pieces.get(word[start:stop], last if stop == start + 1 else 0):
                    sums[stop] = sums[stop] + sums[start] * chance[i]
        return np.log(sums[-1])

    told = {r.doc_id: (r.lang_pred, r.score) for r in language.op9_language_id(spark, SMALL).collect()}
    for r in docs.orderBy("doc_id").limit(40).collect():
        words = (r.text or "").encode().lower().decode().split()
        words = [language.MARK + w.lower() for w in words if len(w) <= 60]
        if not words or len(words) != len((r.text or "").split()):
            continue
        total = sum(log_chances(w) for w in words)
        best = int(np.argmax(total))
        assert told[r.doc_id][0] == languages[best] and math.isclose(told[r.doc_id][1], 1 / np.exp(total - total[best]).sum(), rel_tol=1e-6)


def test_language_on_held_out(spark):
    found = language.op9_language_id(spark, SMALL).join(spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "lang"), "doc_id")
    assert found.where("held_out AND lang = lang_pred").count() >= 0.95 * found.where("held_out").count()
    df = frame(spark, [*documents(30), (500, "1234 !!", "en", "a", 7), (501, "x" * 3000, "en", "a", 7)], extra=True)
    told = {r.doc_id: (r.lang_pred, r.score) for r in language.identify(df, df.select("doc_id", "text", "lang")).collect()}
    assert told[100] == told[101] == told[500] == ("und", 0.0) and told[501][0] in ("en", "fr")
    assert {r.lang_pred for r in language.identify(df, df.select("doc_id", "text", "lang").limit(0)).collect()} == {"und"}


# vectors


def test_neighbours_match_brute_force(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.standard_normal(24).astype(float).tolist()) for i in range(300)]
    rows += [(20, rows[20][1]), (301, rows[7][1]), (302, None), (303, [0.0] * 24), (304, [float("nan")] * 24), (306, [None, *[1.0] * 23]), (320, [1.0, 2.0]), (321, [2.0, 1.0]), (340, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("length", F.lit(1)).withColumn("code", F.lit("x"))
    found = defaultdict(list)
    for r in vectors.search(df, block=6).orderBy("query_id", "rank").collect():
        found[r.query_id].append((r.vec_id, r.score))
    good = {i: np.array(v) for i, v in rows if v and None not in v and np.isfinite(v).all() and np.any(v)}
    hit = total = 0
    for q in [i for i in good if i % 20 == 0]:
        scores = sorted(((-float(good[q] @ v), i) for i, v in good.items() if i != q and len(v) == len(good[q])))[:20]
        assert len(found[q]) == len(scores)
        hit += len({i for _, i in scores} & {i for i, _ in found[q]})
        total += len(scores)
        assert all(math.isclose(s, float(good[q] @ good[i]), rel_tol=1e-12, abs_tol=1e-12) for i, s in found[q])
        assert found[q] == sorted(found[q], key=lambda x: (-x[1], x[0]))
    assert hit >= 0.95 * total and set(found) == {i for i in good if i % 20 == 0}
    assert vectors.search(df.limit(0)).count() == 0


# urls


def test_urls(spark):
    rows = [(1, "https://www.example.com/en/a"), (2, "http://M.EXAMPLE.com/en/x?y=/z"), (3, "https://x.net/fr/1#a"), (4, "http://x.net"), (5, None), (6, "no host"), (7, "https://a.example.com/de/"), (8, "http://net/es/"), (9, "ftp://notnet/es/"), (1, "https://www.example.com/en/a"), (10, "https://a.com?x=1"), (11, "https://")]
    found = {r.page_id: r for r in urls.judge(spark.createDataFrame(rows, "page_id long, url string").withColumn("host", F.lit(1)).withColumn("items", F.lit(2))).collect()}
    want = {1: ("www.example.com", "/en/a", "www.example.com/en/", "allow"), 2: ("m.example.com", "/en/x", "example.com/en/", "block"), 3: ("x.net", "/fr/1", "net/fr/", "block"), 7: ("a.example.com", "/de/", "com/", "allow"), 8: ("net", "/es/", "net/es/", "block")}
    for i, w in want.items():
        assert tuple(found[i][k] for k in ("host", "path", "rule", "verdict")) == w
    for i, (host, path) in {4: ("x.net", ""), 5: ("", ""), 6: ("", ""), 9: ("notnet", "/es/"), 10: ("a.com", ""), 11: ("", "")}.items():
        assert (found[i].host, found[i].path, found[i].rule) == (host, path, None) and found[i].verdict in ("allow", "block")
    assert urls.judge(spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_mined_rules_hold_on_the_labelled_urls(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    found = urls.mine(pages)
    assert found and all(c >= 0.9 and s >= 0.005 for _, _, c, s in found)
    fixed = urls.Fixed()
    told = [(set(urls.tokens(r.url)), fixed.of(*urls.host_and_path(r.url))[1]) for r in pages.select("url").collect()]
    for own, verdict, confidence, support in found[:50]:
        both = [v for t, v in told if v and set(own) <= t]
        assert math.isclose(sum(v == verdict for v in both) / len(both), confidence, rel_tol=1e-9)
        assert math.isclose(sum(v == verdict for v in both) / sum(v is not None for _, v in told), support, rel_tol=1e-9)


@pytest.mark.parametrize("name", ["op4_suffix_dedup", "op5_mixing", "op6_nearest_neighbours"])
def test_query_matches_its_sql(spark, name):
    from noemata.llm.queries import QUERIES, SQL

    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('/root/testdata/sf0.01/{t}.parquet')")
    told = con.execute(SQL[name])
    names = [d[0] for d in told.description]
    found = QUERIES[name](spark, "/root/testdata/sf0.01")
    assert sorted(found.columns) == sorted(names)
    assert sorted(tuple(r[n] for n in names) for r in found.collect()) == sorted(told.fetchall())


# pipeline


def test_pipeline_matches_its_stages(spark):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "near-dedup", "passage dedup", "mixing", "packing"]
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    kept = quality.kept_documents(docs).toPandas()
    failed = {r.doc_id for r in quality.judge(docs).where("NOT kept").collect()}
    assert set(kept.doc_id) == set(r.doc_id for r in docs.select("doc_id").collect()) - failed
    groups = {r.doc_id: r.component_id for r in simhash.similar(spark.createDataFrame(kept)).collect()}
    one = kept[[groups[int(i)] == int(i) for i in kept.doc_id]]
    rows = [(int(r.doc_id), r.text, r.lang, r.source, 0) for r in one.itertuples()]
    cut = {r[0]: suffixes._keep(b := r[1].encode(), suffixes._whole(b, removed_runs(mask))).decode() for r, mask in zip(rows, brute_removed(rows), strict=True)}
    shortened = spark.createDataFrame([(r[0], cut[r[0]], r[2], r[3], len(cut[r[0]])) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    want = Counter((r.doc_id, r.start, r.length, r.ids_crc32) for r in packing.pack(mixing.mixed_documents(shortened)).collect())
    got = Counter((r.doc_id, r.start, r.length, r.ids_crc32) for r in corpus_pipeline.run(spark, SMALL).collect())
    assert got == want and got


def test_url_rules_below_full_confidence_are_kept(spark):
    long = [f"http://a.net/es/{'/'.join(f'p{k}' for k in range(12))}"] * 40  # over 5000 rules of confidence 1
    mixed = ["http://b.net/fr/?q=1"] * 19 + ["http://c.com/?q=1"]
    found = urls.mine(spark.createDataFrame(list(enumerate(long + mixed)), "page_id long, url string"))
    assert any(own == ["key=q"] and verdict == "block" and abs(c - 0.95) < 1e-9 for own, verdict, c, _ in found)
    assert not any(c == 1 and len(own) > 1 and any(set(o) < set(own) and v == verdict for o, v, *_ in found) for own, verdict, c, _ in found)
    assert {f"path={'a' * 50}", f"key={'k' * 50}"} <= set(urls.tokens(f"http://x.net/{'a' * 50}?{'k' * 50}=1"))
