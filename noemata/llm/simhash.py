"""SimHash near-duplicates, found by the generalised pigeonhole principle.

A fingerprint has a bit for each of the 64 bits of its shingles' hashes: 1 where more than half have it. Fingerprints link
where at most `distance` bits differ. Equal fingerprints are taken together first, so groups of exact copies cost one row.

Search: correlated bits are put into the same partition (bits in different ones then tell more), and each partition i gets
a radius t_i >= -1 with sum(t_i + 1) = distance + 1: two linked fingerprints then differ by at most t_i in some partition i.
The radii are allocated by dynamic programming on the candidate counts that the histograms of the partitions' values give,
so a partition where many values coincide may be left out and a better one searched further. Each fingerprint goes to its
own value in each partition and, by the radius, to the values near it; those that meet are verified on all 64 bits.

A value where more than `most` fingerprints meet is not left to one task: its fingerprints are dealt again by four blocks
of the bits not yet used, of which linked ones share at least one (three differing bits can't touch all four), and so on
down; this loses no link. Each task reports a spanning forest of the links it finds, not the links.

similar() and representatives(), which the pipeline uses, take this search's links between fingerprints as candidates and
decide each by the similarity of the shingle sets. As fingerprints don't find all pairs that are so similar, the prefixes of
the sets then find the rest, between the groups that the search leaves.

Cases: null and empty texts and those of white space only have fingerprint 0, which links like any other; with fewer words
than a shingle has, the whole sequence is the only shingle; repeated rows and ids are reported each (equal ids count as one
document in components); rows without id are reported
with their fingerprint and a null component, and link nothing; a very long text is hashed like any other; of equal ids and fingerprints
the order doesn't matter, and a component has its smallest id; an empty table gives an empty result. Columns of other names are ignored by near_duplicates().
"""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, flat, gathered, release, slices, table, texts, written
from .components import components

WIDTH = 64
#: Ids of candidates up to which they are sent to all tasks (8 MB).
ASKED = 1_000_000
_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)
_LANES = np.arange(8, dtype=np.int64) * 256


def shingle_hashes(text: bytes, shingle: int = 3, seed: int = 42) -> np.ndarray:
    """XXH64 of each shingle, repeats included; of the whole sequence where it is shorter than a shingle."""
    words = text.lower().split()
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    joined = b" ".join(words)
    if n <= shingle:
        return np.array([digest(joined, seed)], np.uint64)
    stops = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = np.concatenate([[0], stops[: n - shingle] + 1])
    return np.array([digest(joined[a:b], seed) for a, b in zip(starts.tolist(), stops[shingle - 1 :].tolist(), strict=True)], np.uint64)


def majority(h: np.ndarray) -> int:
    """The bits that more than half of the hashes have."""
    lanes = np.bincount((h.view(np.uint8).reshape(-1, 8) + _LANES).ravel(), minlength=2048).reshape(8, 256)
    ones = (lanes @ _BITS).ravel()
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.uint64)[0])


def fingerprint(text: bytes, shingle: int = 3, seed: int = 42) -> int:
    """Unsigned 64-bit fingerprint."""
    return majority(shingle_hashes(text, shingle, seed))


def parities(h: np.ndarray) -> bytes:
    """A bit map of a set of hashes, with a bit or more for each: how often a bit is hit, modulo 2."""
    bits = max(64, 1 << (len(h) - 1).bit_length()) if len(h) else 64
    hit = np.bincount((h & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(hit.astype(np.uint8), bitorder="little").tobytes()


def folded(maps: np.ndarray, width: int) -> np.ndarray:
    """Bit maps (a row of 64-bit words each) as they would be with fewer words."""
    while maps.shape[1] > width:
        half = maps.shape[1] // 2
        maps = maps[:, :half] ^ maps[:, half:]
    return maps


def possible(size_a: np.ndarray, map_a: np.ndarray, size_b: np.ndarray, map_b: np.ndarray, least: float) -> np.ndarray:
    """Which pairs of sets can be so similar. Every bit in which two maps of one width differ stands for an element that only one set has, so no similar pair is lost."""
    shared = (size_a + size_b - np.bitwise_count(map_a ^ map_b).sum(1)) / 2
    return shared * (1 + least) >= least * (size_a + size_b) - 1e-9


def filtered(pairs: DataFrame, sketches: DataFrame, least: float) -> DataFrame:
    """The pairs u, v that can be so similar by their bit maps. sketches: node, size, bits (with component, only pairs of different ones)."""
    named = "component" in sketches.columns
    one, two = (sketches.select(F.col("node").alias(c), F.col("size").alias(f"_s{c}"), F.col("bits").alias(f"_b{c}"), *[F.col("component").alias(f"_c{c}")] * named) for c in "uv")

    def kept(batches):
        for batch in batches:
            keep = np.zeros(len(batch), bool)
            maps = [batch.column(f"_b{c}").to_pylist() for c in "uv"]
            sizes = [np.asarray(batch.column(f"_s{c}")).astype(np.int64) for c in "uv"]
            widths = np.array([min(len(a), len(b)) for a, b in zip(*maps, strict=True)], np.int64)
            for width in np.unique(widths).tolist():
                at = np.flatnonzero(widths == width)
                both = [np.concatenate([folded(np.frombuffer(m[i], np.uint64)[None], width // 8) for i in at.tolist()]) for m in maps]
                keep[at] = possible(sizes[0][at], both[0], sizes[1][at], both[1], least)
            yield batch.select(["u", "v"]).filter(pa.array(keep))

    both = pairs.join(one, "u").join(two, "v")
    return (both.where("_cu <> _cv") if named else both).select("u", "v", "_su", "_bu", "_sv", "_bv").mapInArrow(kept, "u long, v long")


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """doc_id, print (signed) of every row."""

    def printed(batches):
        release()
        for batch in (part for whole in batches for part in slices(whole)):
            found = np.array([fingerprint(t, shingle) for t in texts(batch)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found)], names=["doc_id", "print"])
        release()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(printed, "doc_id long, print long")


def prefix_size(n: int, least: float) -> int:
    """How many shingles of a set of n, the first in an order that all sets share, any set at least so similar has one of among its own first ones."""
    return n - math.ceil(least * n - 1e-9) + 1 if n else 0


def common_shingles(docs: DataFrame, shingle: int, sampled: int = 10_000, often: int = 4) -> np.ndarray:
    """Hashes of the shingles that several of about so many documents have, in ascending order of how many do. They only order the shingles, so what a sample misses costs time but no pair."""
    one_in = max(1, docs.count() // sampled)

    def hashed(batches):
        for batch in (part for whole in batches for part in slices(whole)):
            for text in texts(batch):
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(shingle_hashes(text, shingle)).view(np.int64))], names=["h"])
        release()

    rows = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(one_in)) == 0).select("text").mapInArrow(hashed, "h long")
    found = rows.groupBy("h").count().where(F.col("count") >= often).toArrow()  # at most a quarter of the shingles of the sample
    h, n = (np.asarray(found.column(c).combine_chunks()) for c in ("h", "count"))
    return h[np.lexsort((h, n))].view(np.uint64)


def profiles(docs: DataFrame, least: float, shingle: int) -> DataFrame:
    """doc_id; a digest of the set of shingles (two longs); size of the set; its prefix, rare shingles first; its bit map; the fingerprint of op7_simhash; of every row."""
    common = common_shingles(docs, shingle)
    by_hash = np.argsort(common)
    held = common[by_hash]

    def profiled(batches):
        release()
        for batch in (part for whole in batches for part in slices(whole)):
            firsts, seconds, sizes, prefixes, maps, prints = [], [], [], [], [], []
            for text in texts(batch):
                h = np.unique(shingle_hashes(text, shingle))
                digest = xxhash.xxh3_128_digest(h.tobytes())
                at = np.searchsorted(held, h)
                known = np.zeros(len(h), bool)
                known[at < len(held)] = held[at[at < len(held)]] == h[at < len(held)]
                ordered = np.concatenate([h[~known], common[np.sort(by_hash[at[known]])]])
                firsts.append(int.from_bytes(digest[:8], "little", signed=True))
                seconds.append(int.from_bytes(digest[8:], "little", signed=True))
                sizes.append(len(h))
                prefixes.append(ordered[: prefix_size(len(h), least)].view(np.int64))
                maps.append(parities(h))
                prints.append(_signed(fingerprint(text)))
            arrays = [batch.column("doc_id"), pa.array(firsts, pa.int64()), pa.array(seconds, pa.int64()), pa.array(sizes, pa.int32()), pa.array(prefixes, pa.list_(pa.int64())), pa.array(maps, pa.binary()), pa.array(prints, pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "d1", "d2", "size", "prefix", "bits", "print"])
        release()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(profiled, "doc_id long, d1 long, d2 long, size int, prefix array<long>, bits binary, print long")


def _near_in_size(batches, least: float, steps: int | None):
    """Partitions of entries in the order of key and size, and for each step, from 1 on, the places of rows that can be alike to the row so many places on in the same key."""
    rows = gathered(batches)
    if rows is None:
        return
    key, node, held = (np.asarray(rows.column(c).combine_chunks()) for c in ("key", "node", "held"))
    size, place = held >> 32, held & 0xFFFFFFFF
    order = np.lexsort((node, size, key))
    key, node, size, place = key[order], node[order], size[order], place[order]
    at, step, n = np.arange(len(key)), 1, len(key)
    yield rows, order, key, node, size, held[order]
    while len(at) and (steps is None or step <= steps):
        at = at[at + step < n]
        # Sizes ascend within a key, so what is too large for a row stays so at further steps.
        at = at[(key[at] == key[at + step]) & (size[at] >= least * size[at + step] - 1e-9)]
        to = at + step
        shared = np.minimum(size[at] - place[at], size[to] - place[to])  # at most, if this is the first that both have
        yield step, at[(shared * (1 + least) >= least * (size[at] + size[to]) - 1e-9) & (node[at] != node[to])]
        step += 1


def meeting(entries: DataFrame, least: float, steps: int | None) -> DataFrame:
    """Pairs of entries (key, node, held) of one key whose sizes and places allow the similarity, with rows so near in the order of a key's rows by size: u < v. Of keys that have more rows than these steps reach, also the entries themselves: key, node, held."""

    def met(batches):
        found = _near_in_size(batches, least, steps)
        for _, _, key, node, _, held in found:
            turn = np.flatnonzero(np.diff(key, prepend=key[0] - 1)) if len(key) else np.zeros(0, np.int64)
            long = np.repeat(np.diff(turn, append=len(key)), np.diff(turn, append=len(key))) > (steps or len(key)) + 1
            none = pa.nulls(int(long.sum()), pa.int64())
            yield pa.RecordBatch.from_arrays([none, none, *(pa.array(x[long]) for x in (key, node, held))], names=["u", "v", "key", "node", "held"])
            for step, at in found:
                if len(at):
                    a, b = node[at], node[at + step]
                    pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1)
                    none = pa.nulls(pairs.shape[1], pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1]), none, none, none], names=["u", "v", "key", "node", "held"])
        release()

    return entries.repartition("key").mapInArrow(met, "u long, v long, key long, node long, held long")


def meeting_apart(entries: DataFrame, least: float, partners: int | None) -> DataFrame:
    """u < v: pairs of entries (key, node, held, component, bits) of one key and of different components whose sizes, places and bit maps allow the similarity: for each row the first so many of those after it in the order of size, or all."""

    def met(batches):
        found = _near_in_size(batches, least, None)
        for rows, order, _, node, size, _ in found:
            component = np.asarray(rows.column("component").combine_chunks())[order]
            data, stops = flat(rows.select(["bits"]).combine_chunks().to_batches()[0], "bits")
            words, lengths, starts = data.view(np.uint64), np.diff(stops)[order] // 8, stops[:-1][order] // 8
            given = np.zeros(len(node), np.int64)
            for step, at in found:
                hit = at[component[at] != component[at + step]]
                hit = hit[given[hit] < partners] if partners else hit
                keep = np.zeros(len(hit), bool)
                for width in np.unique(lengths[hit]).tolist():  # the first of a pair is the smaller set
                    for wide in (width, 2 * width):  # and the other of at most 1.25 times its size
                        some = np.flatnonzero((lengths[hit] == width) & (lengths[hit + step] == wide))
                        for k in range(0, len(some), 50_000):
                            part = some[k : k + 50_000]
                            a, b = hit[part], hit[part] + step
                            one, two = (words[starts[x][:, None] + np.arange(w)] for x, w in ((a, width), (b, wide)))
                            keep[part] = possible(size[a], one, size[b], folded(two, width), least)
                given[hit[keep]] += 1
                a, b = node[hit[keep]], node[hit[keep] + step]
                if len(a):
                    yield pa.RecordBatch.from_pydict({"u": np.minimum(a, b), "v": np.maximum(a, b)})
        release()

    return entries.repartition("key").mapInArrow(met, "u long, v long").distinct()


def entries_of(distinct: DataFrame) -> DataFrame:
    """key, node, held: an entry for each shingle of a prefix; size and place of it in one number."""
    return distinct.select("node", "size", F.posexplode("prefix").alias("at", "key")).select("key", "node", F.shiftleft(F.col("size").cast("long"), 32).bitwiseOR(F.col("at").cast("long")).alias("held"))


def candidates(distinct: DataFrame, least: float) -> DataFrame:
    """u, v: all pairs of sets (node, size, prefix) that can be at least so similar: they share a shingle of their prefixes, and sizes and places allow it."""
    return meeting(entries_of(distinct), least, 1 << 40).where("u IS NOT NULL").select("u", "v").distinct()


def together(prints: DataFrame) -> np.ndarray:
    """How often each pair of bits is 1 together (on the diagonal: each bit), and in the last row the number of fingerprints; 65 x 64."""

    def counted(batches):
        out = np.zeros((65, WIDTH))
        for batch in batches:
            p = np.asarray(batch.column("print")).view(np.uint64)
            bits = np.unpackbits(p.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            out[:64] += bits.T @ bits
            out[64] += len(p)
        yield pa.RecordBatch.from_pydict({"at": np.arange(65 * WIDTH, dtype=np.int64), "n": out.ravel()})

    rows = prints.select("print").mapInArrow(counted, "at long, n double").groupBy("at").agg(F.sum("n").alias("n")).collect()  # 4160 rows
    out = np.zeros(65 * WIDTH)
    for r in rows:
        out[r["at"]] = r["n"]
    return out.reshape(65, WIDTH)


def partition_bits(counts: np.ndarray, parts: int) -> list[list[int]]:
    """Bits in equal parts: each part starts with the free bit most correlated to others, and takes those most correlated to it."""
    n = max(1.0, counts[64, 0])
    p = np.diag(counts[:64]) / n
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    related = np.abs((counts[:64] / n - np.outer(p, p)) / np.outer(spread, spread))
    np.fill_diagonal(related, 0)
    free, out = set(range(WIDTH)), []
    for k in range(parts):
        size = len(free) // (parts - k)
        left = sorted(free)
        first = max(left, key=lambda b: (related[b, left].sum(), -b))
        own = [first]
        free.discard(first)
        while len(own) < size:
            b = max(sorted(free), key=lambda b: (related[b, own].sum(), -b))
            own.append(b)
            free.discard(b)
        out.append(sorted(own))
    return out


def mask_of(bits: list[int]) -> int:
    return sum(1 << b for b in bits)


def flips(bits: list[int], radius: int) -> list[int]:
    """What to xor to reach all values of these bits within the radius."""
    return [mask_of(list(c)) for r in range(radius + 1) for c in combinations(bits, r)]


def allocate(costs: list[list[float]], total: int) -> list[int]:
    """Radii t_i of least cost with sum(t_i + 1) = total. costs[i][t + 1]; dynamic programming over the partitions."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for cost in costs:
        new: dict[int, tuple[float, list[int]]] = {}
        for used, (c, radii) in best.items():
            for step, extra in enumerate(cost):
                if used + step <= total and ((found := new.get(used + step)) is None or c + extra < found[0]):
                    new[used + step] = (c + extra, [*radii, step - 1])
        best = new
    return best[total][1]


def radii_for(prints: DataFrame, parts: list[list[int]], distance: int, furthest: int = 1) -> list[int]:
    """Radii by estimated cost: the entries to write, and the pairs to verify that the histogram of the partition's values gives. A histogram has at most 2 to the number of a partition's bits values (65,536 for four partitions)."""
    masks = [mask_of(p) for p in parts]
    values = F.array(*[F.struct(F.lit(i).alias("part"), F.col("print").bitwiseAND(F.lit(_signed(m))).alias("value")) for i, m in enumerate(masks)])
    counted = prints.select(F.explode(values).alias("x")).groupBy("x.part", "x.value").count().toArrow()
    part, value, count = (np.asarray(counted.column(k).combine_chunks()) for k in range(3))
    costs = []
    for i, bits in enumerate(parts):
        of = part == i
        v = value[of].astype(np.int64).view(np.uint64)
        packed = np.zeros(len(v), np.int64)
        for k, b in enumerate(bits):
            packed |= ((v >> np.uint64(b)) & np.uint64(1)).astype(np.int64) << k
        n = np.zeros(1 << len(bits))
        n[packed] = count[of]
        cost = [0.0]
        near = n.copy()
        for radius in range(min(furthest, distance) + 1):
            if radius:
                at = np.arange(len(n))
                near = near + sum(n[at ^ (1 << k)] for k in range(len(bits)))
            entries = n.sum() * len(flips(bits, radius))
            cost.append(float((n * near).sum()) + 20.0 * entries)
        costs.append(cost)
    return allocate(costs, distance + 1)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def blocks_below(path: str, parts: list[list[int]], blocks: int) -> list[list[int]]:
    """The bits that the path leaves, in so many blocks. A path is the partition, then the block at each level: '2.0.3'."""
    first, *rest = map(int, path.rpartition(":")[2].split("."))
    left = [b for i, p in enumerate(parts) if i != first for b in p]
    out = [left[k::blocks] for k in range(blocks)]
    for step in rest:
        left = [b for b in left if b not in set(out[step])]
        out = [left[k::blocks] for k in range(blocks)]
    return out


def link_sorted(key: np.ndarray, prints: np.ndarray, nodes: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning forest of the links within runs of equal keys; each of its edges is a link.

    Rows are compared at growing steps, all runs at once. Pairs that earlier links join already are passed over, and a run
    drops out when it is joined as a whole, so a run of near copies takes few steps.
    """
    n = len(key)
    tree = np.arange(n)  # the root of each row; kept flat
    turns = np.ones(n, bool)
    turns[1:] = key[1:] != key[:-1]
    starts, run = np.flatnonzero(turns), np.cumsum(turns) - 1
    u, v = [], []
    at, step = np.arange(n), 1
    while True:
        at = at[at + step < n]
        at = at[key[at] == key[at + step]]
        if not len(at):
            break
        hit = at[(np.bitwise_count(prints[at] ^ prints[at + step]) <= distance) & (tree[at] != tree[at + step])]
        if len(hit):
            parent: dict[int, int] = {}

            def root(x, parent=parent):
                while (up := parent.get(x, x)) != x:
                    x = up
                return x

            for a, x, y in zip(hit.tolist(), tree[hit].tolist(), tree[hit + step].tolist(), strict=True):
                x, y = root(x), root(y)
                if x != y:
                    parent[max(x, y)] = min(x, y)
                    u.append(a)
                    v.append(a + step)
            moved = np.arange(n)
            changed = np.array(list(parent), np.int64)
            moved[changed] = [root(x) for x in parent]
            tree = moved[tree]
            whole = np.minimum.reduceat(tree, starts) == np.maximum.reduceat(tree, starts)
            at = at[~whole[run[at]]]
        step += 1
    return nodes[np.array(u, np.int64)], nodes[np.array(v, np.int64)]


def links(distinct: DataFrame, distance: int = 3, parts: int = 4, most: int = 4000) -> DataFrame:
    """u, v: links that join whatever fingerprints link, from distinct fingerprints (print, node; with look, only those of the same look are compared)."""
    named = "look" in distinct.columns
    blocks = distance + 1
    sample = distinct.where("look = 0") if named else distinct  # looks are alike in distribution
    bits = partition_bits(together(sample), parts)
    radii = radii_for(sample, bits, distance)
    entries = []
    for i, radius in enumerate(radii):
        if radius >= 0:
            near = F.explode(F.array(*[F.lit(_signed(x)) for x in flips(bits[i], radius)])) if radius else F.lit(0).cast("long")
            value = F.col("print").bitwiseXOR(near if not radius else F.col("_flip")).bitwiseAND(F.lit(_signed(mask_of(bits[i]))))
            of = distinct.withColumn("_flip", near) if radius else distinct
            entries.append(of.select("node", "print", (F.concat(F.col("look").cast("string"), F.lit(f":{i}")) if named else F.lit(str(i))).alias("path"), value.alias("value")))
    level = entries[0]
    for e in entries[1:]:
        level = level.unionAll(e)
    found = None
    for _ in range(8):
        last = all(sum(map(len, blocks_below(p, bits, blocks))) <= 14 for p in _paths(level)) if found is not None else False
        sizes = level.groupBy("path", "value").count().where(F.col("count") > most).select("path", "value", F.lit(True).alias("large"))
        large = None if last else cut(sizes)
        if large is None or not large.take(1):
            now, below = level, None
        else:
            now = level.join(large, ["path", "value"], "left_anti")
            deeper = level.join(large.select("path", "value"), ["path", "value"])

            def deal(batches):
                for batch in batches:
                    prints, paths = np.asarray(batch.column("print")), np.array(batch.column("path").to_pylist(), object)
                    nodes, held = np.asarray(batch.column("node")), np.asarray(batch.column("value"))
                    for path in set(paths.tolist()):
                        of = paths == path
                        for step, own in enumerate(blocks_below(path, bits, blocks)):
                            value = held[of] | (prints[of] & np.int64(_signed(mask_of(own))))
                            yield pa.RecordBatch.from_pydict({"node": nodes[of], "print": prints[of], "path": pa.array([f"{path}.{step}"] * len(value), pa.string()), "value": value})

            below = cut(deeper.select("node", "print", "path", "value").mapInArrow(deal, "node long, print long, path string, value long"))

        def joined(batches):
            rows = gathered(batches)
            if rows is None:
                return
            rows = rows.combine_chunks()
            path = rows.column("path").combine_chunks().dictionary_encode() if rows.num_rows else None
            codes = np.asarray(path.indices if not isinstance(path, pa.ChunkedArray) else path.chunk(0).indices).astype(np.int64)
            value, prints, nodes = (np.asarray(rows.column(c).combine_chunks()) for c in ("value", "print", "node"))
            order = np.lexsort((nodes, value, codes))
            codes, value, prints, nodes = codes[order], value[order], prints[order], nodes[order]
            key = np.cumsum(np.concatenate([[0], (codes[1:] != codes[:-1]) | (value[1:] != value[:-1])]))
            u, v = link_sorted(key, prints.view(np.uint64), nodes, distance)
            yield pa.RecordBatch.from_pydict({"u": u, "v": v})

        dealt = now.repartition("path", "value").select("path", "value", "print", "node").mapInArrow(joined, "u long, v long")
        found = dealt if found is None else found.unionAll(dealt)
        if below is None:
            return found
        level = below
    return found


def _paths(level: DataFrame) -> list[str]:
    return [r.path for r in level.select("path").distinct().collect()]


def near_duplicates(docs: DataFrame, distance: int = 3, shingle: int = 3, parts: int = 4) -> DataFrame:
    """doc_id, print (signed), component_id of every row."""
    prints = written(fingerprints(docs, shingle), "prints")
    distinct = cut(prints.where("doc_id IS NOT NULL").groupBy("print").agg(F.min("doc_id").alias("node"), F.max("doc_id").alias("_last")))
    # Repeated ids with other texts tie their fingerprints together: rare, and only where there are any.
    tied = prints.groupBy("doc_id").agg(F.min("print").alias("a"), F.max("print").alias("b")).where("a <> b")
    edges = links(distinct.select("print", "node"), distance, parts)
    if tied.take(1):
        several = prints.join(tied.select("doc_id"), "doc_id").join(distinct, "print")
        edges = edges.unionAll(several.select(F.col("doc_id").alias("u"), F.col("node").alias("v")))
        edges = edges.unionAll(several.select(F.col("node").alias("u"), F.col("doc_id").alias("v")))
    found = components(edges)
    labelled = distinct.join(found, distinct["node"] == found["node"], "left").select("print", F.coalesce("component", distinct["node"]).alias("component_id"))
    return prints.join(labelled, "print", "left").select("doc_id", "print", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def hexadecimal(column: str) -> F.Column:
    return F.lower(F.lpad(F.hex(column), 16, "0"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", hexadecimal("print").alias("fingerprint"), "component_id")


def jaccard(x: np.ndarray, y: np.ndarray) -> float:
    """Of two sets as ascending numbers."""
    both = np.sort(np.concatenate([x, y]))
    shared = int((both[1:] == both[:-1]).sum())
    return shared / (len(both) - shared) if len(both) else 1.0


def alike(pairs: DataFrame, docs: DataFrame, least: float, shingle: int) -> DataFrame:
    """u, v: the pairs whose sets of shingles have that Jaccard similarity, computed exactly from the texts."""
    rows = docs.select(F.col("doc_id").cast("long").alias("node"), "text")
    asked = written(pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct(), "asked")
    if asked.count() <= ASKED:  # so few that all tasks can know them; only their texts are dealt then
        rows = rows.join(F.broadcast(asked), "node", "left_semi")
    one, two = (rows.select(F.col("node").alias(c), F.col("text").alias(f"_{c}")) for c in "uv")

    def kept(batches):
        for batch in batches:
            for part in slices(batch, 8 << 20, "_u"):
                held: dict[bytes, np.ndarray] = {}
                for text in {*texts(part, "_u"), *texts(part, "_v")}:
                    held[text] = np.unique(shingle_hashes(text, shingle))
                alike_ = [jaccard(held[a], held[b]) >= least - 1e-9 for a, b in zip(texts(part, "_u"), texts(part, "_v"), strict=True)]
                yield part.select(["u", "v"]).filter(pa.array(alike_, pa.bool_()))
        release()

    return pairs.join(one, "u").join(two, "v").select("u", "v", "_u", "_v").mapInArrow(kept, "u long, v long").distinct()


def searched(marks: DataFrame, distance: int = 3, parts: int = 4) -> DataFrame:
    """u < v: candidates of the search over fingerprints, from nodes with theirs (node, print): links that join whatever fingerprints link, and each node with the first of its own fingerprint."""
    distinct = written(marks.groupBy("print").agg(F.min("node").alias("node")), "prints")
    own = marks.select("print", F.col("node").alias("v")).join(distinct.withColumnRenamed("node", "u"), "print").select("u", "v")
    found = links(distinct, distance, parts).select("u", "v").unionAll(own)
    return found.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()


def similar(docs: DataFrame, least: float = 0.8, shingle: int = 5, near: int = 2) -> DataFrame:
    """doc_id, component_id of every row with an id: groups of texts whose sets of shingles are at least so similar.

    Equal sets (by 128 bits of their hashes) are taken together, and each other pair is decided by the exact Jaccard.
    First come the links that the search of op7_simhash finds between the fingerprints. They miss some of the pairs that are
    so similar; what is still apart is found by prefixes, with complete candidates: in an order of shingles that all sets
    share, the first fifth of either of two sets that are
    similar to 0.8 has a shingle that the other's has too. Every row is compared with the next rows in size of each
    of its keys; then, as this joins most of what is alike, with the first row of the key that is in another group still and
    that the bit maps allow, and at last, as hardly any are left, with all such rows. Keys of up to `near` + 1 rows are done after the first step. Rows of one id with different
    texts are one node: it has the sets of all of them.
    """
    seen = written(profiles(docs.where("doc_id IS NOT NULL"), least, shingle), "profiles")
    nodes = written(seen.groupBy("d1", "d2").agg(F.min("doc_id").alias("node")), "nodes")
    distinct = seen.withColumnRenamed("doc_id", "node").join(nodes, ["d1", "d2", "node"]).dropDuplicates(["d1", "d2", "node"])
    sketches = written(distinct.select("node", "size", "bits", "print"), "sketches")

    def decided(pairs: DataFrame) -> DataFrame:
        return written(alike(written(pairs, "told"), docs, least, shingle), "alike")

    links = decided(filtered(searched(sketches.select("node", "print")), sketches, least))
    marked = sketches.select("node", "size", "bits").join(components(links), "node", "left").withColumn("component", F.coalesce("component", "node"))
    met = written(meeting(entries_of(distinct), least, near), "met")
    links = links.unionAll(decided(filtered(met.where("u IS NOT NULL").select("u", "v").distinct(), written(marked, "marked"), least)))
    for partners in (1, None):
        several = met.where("key IS NOT NULL").select("key", "node", "held").join(components(links), "node", "left").withColumn("component", F.coalesce("component", "node"))
        # A key whose rows are of one group by now has nothing to tell.
        split = several.groupBy("key").agg(F.min("component").alias("a"), F.max("component").alias("b")).where("a <> b").select("key")
        named = written(several.join(split, "key", "left_semi"), "several").join(sketches.select("node", "bits"), "node").select("key", "node", "held", "component", "bits")
        links = links.unionAll(decided(meeting_apart(named, least, partners)))
    grouped = components(links)
    labelled = nodes.join(grouped, "node", "left").select("d1", "d2", F.coalesce("component", "node").alias("component_id"))
    return seen.select("doc_id", "d1", "d2").join(labelled, ["d1", "d2"]).select("doc_id", "component_id")


def representatives(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs, one for each group of similar texts: the one of smallest id (of rows of that id, one). Rows without id stay."""
    kept = similar(docs, **options).where("component_id = doc_id").select("doc_id").distinct()
    rows = docs.join(kept, "doc_id", "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])
    repeated = docs.groupBy("doc_id").count().where("count > 1").select("doc_id")
    if repeated.take(1):
        rows = rows.dropDuplicates(["doc_id"])
    return rows.unionAll(docs.where("doc_id IS NULL")) if docs.where("doc_id IS NULL").take(1) else rows
