"""Toxicity by compression distance: one zstandard dictionary for toxic and one for ordinary text.

A text is cut into windows of `WINDOW` words, half overlapping (words are runs of non-white-space, ASCII letters
lower-cased). Each window is set between fixed frame bytes and compressed with either dictionary; what the toxic one
saves in bytes is the window's advantage, which may be negative. Of the advantages of a text the mean, the largest and
the share of windows above a threshold are what a calibration by logistic regression on labelled rows turns into the
probability; the threshold is the one that parts windows of toxic texts from those of ordinary ones best.

zstandard trains either dictionary, on text of its own class alone: on the stretches of the class's windows that are
telling, that is made of strings of six or eight bytes within a word that at least `share` of its texts have, and `ratio` times as many in
proportion as of the other class's (by a log-likelihood ratio of `least` or more, so that chance doesn't tell). Trained on all words alike, both dictionaries are mostly of what the classes have
in common, and their chance matches hide what tells them apart (README has figures).

The model is fitted on a bounded sample of the labelled rows (`max_documents` of each class, those of smallest hash;
of texts alike one counts) and, for each dictionary, on the `max_stretches` most frequent telling stretches of the sample;
whole texts of the sample are used, and every row is scored on its whole text.

Cases: null or empty text, and text of white space only, has no window and gets the score of advantages of 0; a very long
text is read a stretch at a time, with the same windows; ties in the sample's order go to the smaller doc_id, then to the
smaller hash of the text. Rows repeated in `docs` are scored each, and all texts of a repeated id have its label. Labels
that are null are ignored, contradicting repeated labels count as toxic. Without any labelled toxic row (empty tables
too) all scores are 0, without any ordinary one the model is the share of toxic rows. Columns of other names in either
table are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, fold, release, slices, table, texts

WINDOW, GRAMS = 32, (6, 8)
FRAME, TAIL = b"<<one window follows this frame>>", b"<<the frame ends>>"
#: Bytes of a long text that are read at once; gram counts that a task holds before it passes them on.
STRETCH, HELD = 1 << 20, 2_000_000
LOOKS = 3


def windows(text: bytes, step: int = WINDOW // 2) -> Iterator[bytes]:
    """Windows of WINDOW words, one for each `step` words; the last may have fewer. A text of few words has one."""
    held: list[bytes] = []
    at, any_yet = 0, False
    while at < len(text):
        stop = at + STRETCH
        while stop < len(text) and text[stop : stop + 1] not in b" \t\n\x0b\x0c\r":
            stop += 1
        held += text[at:stop].lower().split()
        at, start = stop, 0
        while len(held) - start > WINDOW:  # more follows, so this window is whole and not the last
            yield b" " + b" ".join(held[start : start + WINDOW]) + b" "
            start, any_yet = start + step, True
        del held[:start]
    if held and (not any_yet or len(held) > WINDOW - step):
        yield b" " + b" ".join(held) + b" "


def grams(window: bytes, size: int, within: bool = True) -> np.ndarray:
    """The strings of so many bytes (8 at most) at each place, as numbers; -1 for those of two words, unless they are asked for."""
    a = np.frombuffer(window, np.uint8).astype(np.int64)
    n = len(a) - size + 1
    out = np.zeros(max(0, n), np.int64)
    for k in range(size if n > 0 else 0):
        out = (out << 8) | a[k : n + k]
    for k in range(1, size - 1 if within and n > 0 else 0):
        out[a[k : n + k] == 32] = -1
    return out


def stretches(window: bytes, telling: np.ndarray) -> list[bytes]:
    """The parts of a window that telling grams (ascending) cover."""
    if not len(telling):
        return []
    covered = np.zeros(len(window) + 1, np.int64)
    for size in GRAMS:
        g = grams(window, size)
        on = np.flatnonzero(telling[np.minimum(np.searchsorted(telling, g), len(telling) - 1)] == g)
        covered[on] += 1
        covered[on + size] -= 1
    turns = np.flatnonzero(np.diff(np.cumsum(covered) > 0, prepend=False))
    return [window[a:b] for a, b in zip(turns[::2].tolist(), turns[1::2].tolist(), strict=True)]


def train(samples: dict[bytes, int], size: int = 2048, k: int = 16, together: int = 8) -> bytes:
    """Dictionary content that zstandard trains on stretches of one class and how often each occurs; where they are too few to train on, the stretches themselves.

    The trainer takes the best segment of each part of the samples, so they are dealt evenly: by hash, several to a sample.
    """
    dealt = sorted((zlib.crc32(x + i.to_bytes(8, "big")), x) for x, n in samples.items() for i in range(min(n, 1000)))
    joined = [b"".join(x for _, x in dealt[i : i + together]) for i in range(0, len(dealt), together)]
    if sum(map(len, joined)) >= 8 * size:
        try:
            return zstandard.train_dictionary(size, joined, k=k, d=6, level=3).as_bytes()
        except zstandard.ZstdError:
            pass
    return b"".join(sorted(samples, key=lambda x: (samples[x], x)))[-size:]  # the most frequent ones last, nearest to the window


class Advantage:
    """Bytes that the toxic dictionary saves on a window against the ordinary one."""

    def __init__(self, ordinary: bytes, toxic: bytes, least: int = 7):
        # Literals as they are and matches of seven bytes: then a telling string counts and a chance match doesn't.
        made = zstandard.ZstdCompressionParameters(
            format=zstandard.FORMAT_ZSTD1_MAGICLESS, write_content_size=0, write_checksum=0, write_dict_id=0,
            strategy=zstandard.STRATEGY_FAST, target_length=1, min_match=least, window_log=17, hash_log=15, chain_log=15, search_log=1,
        )
        self.ordinary, self.toxic = (zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(x + FRAME + TAIL, dict_type=zstandard.DICT_TYPE_RAWCONTENT), compression_params=made).compress for x in (ordinary, toxic))

    def of(self, text: bytes) -> np.ndarray:
        """The advantages of the windows of a text."""
        ordinary, toxic, out = self.ordinary, self.toxic, []
        for window in windows(text):
            framed = FRAME + window + TAIL
            out.append(len(ordinary(framed)) - len(toxic(framed)))
        return np.array(out, np.int64)


def features(advantages: np.ndarray, threshold: int) -> list[float]:
    if not len(advantages):
        return [0.0, 0.0, 0.0]
    return [float(advantages.mean()), float(max(0, advantages.max())), float((advantages >= threshold).mean())]


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 0.1, rounds: int = 60) -> np.ndarray:
    """Coefficients (the last is the constant) by Newton's method, with a small penalty."""
    x = np.hstack([x, np.ones((len(x), 1))])
    penalty = np.diag([ridge] * (x.shape[1] - 1) + [1e-6])
    b = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        slope = x.T @ (weight * (p - y)) + penalty @ b
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + penalty, slope)
        b -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return b


def calibrate(rows: list[tuple[int, np.ndarray]], classes: tuple[int, int]) -> tuple[int, list[float]]:
    """rows: (label, advantages of the windows); classes: how many rows of label 0 and 1 the sample stands for. The threshold, and the coefficients."""
    y = np.array([r[0] for r in rows], float)
    prior = classes[1] / max(1, sum(classes))
    if not 0 < y.sum() < len(y):
        return 1, [0.0, 0.0, 0.0, float(np.log(max(prior, 1e-9) / max(1 - prior, 1e-9)))]
    best = (-1.0, 1)
    for t in range(1, 33):  # an advantage over 32 bytes is over this threshold too
        hit = np.array([bool((a >= t).any()) for _, a in rows])
        best = max(best, (hit[y == 1].mean() - hit[y == 0].mean(), t))
    weight = np.where(y == 1, prior / y.mean(), (1 - prior) / (1 - y.mean()))
    return best[1], logistic(np.array([features(a, best[1]) for _, a in rows]), y, weight).tolist()


def chance(found: list[float], coefficients: list[float]) -> float:
    return float(1 / (1 + np.exp(-np.clip(np.dot(coefficients[:-1], found) + coefficients[-1], -30, 30))))


def _looked(batches):
    """Rows of _id, toxic, text with the least hashes of the text's strings of 24 bytes, by LOOKS hashes; of shorter texts the hash of the whole."""
    for batch in (part for whole in batches for part in slices(whole)):
        out = []
        for text in texts(batch):
            g = grams(text, 8, False)
            whole = g[:-16] * 0x632BE59BD9B4E019 + g[8:-8] * 0x2545F4914F6CDD1D + g[16:] if len(g) > 16 else np.array([zlib.crc32(text)])
            out.append([int((whole * (2 * i + 0x1E3779B97F4A7C15) ^ (whole >> (20 + i))).min()) for i in range(LOOKS)])
        columns = list(zip(*out, strict=True)) or [()] * LOOKS
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("_id", "toxic", "text")), *[pa.array(c, pa.int64()) for c in columns]], names=["_id", "toxic", "text", *[f"_m{i}" for i in range(LOOKS)]])


def sampled(docs: DataFrame, labels: DataFrame, max_documents: int) -> tuple[DataFrame, dict[int, int]]:
    """toxic, text of the sample, equal texts once; and the rows of each class."""
    truth = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max((F.col("toxic") != 0).cast("int")).alias("toxic"))
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("_h", F.xxhash64("text"))
    known = cut(rows.select("doc_id", "_h").join(truth, "doc_id"))
    classes = {r.toxic: r["count"] for r in known.groupBy("toxic").count().collect()}
    order = [F.xxhash64("doc_id"), F.col("doc_id"), F.col("_h")]
    picked = [r for k in (1, 0) for r in known.where(f"toxic = {k}").distinct().orderBy(*order).limit(max_documents).collect()]
    chosen = docs.sparkSession.createDataFrame([tuple(r) for r in picked], "doc_id long, _h long, toxic int")
    alike = rows.join(F.broadcast(chosen), ["doc_id", "_h"]).groupBy("text").agg(F.max("toxic").alias("toxic"), F.min("doc_id").alias("_id")).select("_id", "toxic", "text")
    keys = [f"_m{i}" for i in range(LOOKS)]
    seen = cut(alike.mapInArrow(_looked, "_id long, toxic int, text string, " + ", ".join(f"{k} long" for k in keys)))
    for k in keys:  # a near copy has one of its least hashes in common with its original, nearly always
        firsts = seen.groupBy("toxic", k).agg(F.min("_id").alias("_id")).select("toxic", k, "_id")
        alike = firsts if k == keys[0] else alike.join(firsts, ["toxic", "_id"], "left_semi")
    return cut(seen.join(F.broadcast(alike.select("toxic", "_id").distinct()), ["toxic", "_id"], "left_semi").select("toxic", "text")), classes


def telling_grams(sample: DataFrame, counts: dict[int, int], share: float, ratio: float, least: float) -> dict[int, np.ndarray]:
    """By class, the grams that at least `share` of its texts have, and `ratio` times as many in proportion as of the other's, by a log-likelihood ratio of `least` or more. Of a share there are at most 1 / share times a text's grams, whatever the sample."""

    def counted(batches):
        held: dict[int, list[np.ndarray]] = {0: [], 1: []}

        def flush():
            for label, parts in held.items():
                if parts:
                    g, n = np.unique(np.concatenate(parts), return_counts=True)
                    yield pa.RecordBatch.from_pydict({"gram": g, "toxic": np.full(len(g), label, np.int32), "n": n})
                parts.clear()

        for batch in (part for whole in batches for part in slices(whole)):
            for label, text in zip(batch.column("toxic").to_pylist(), texts(batch), strict=True):
                own = [np.unique(grams(w, size)) for w in windows(text, WINDOW) for size in GRAMS]
                if own:
                    found = np.unique(np.concatenate(own))
                    held[label].append(found[found >= 0])
            if sum(map(len, held[0])) + sum(map(len, held[1])) > HELD:
                yield from flush()
        yield from flush()

    sums = sample.mapInArrow(counted, "gram long, toxic int, n long").groupBy("gram").agg(*[F.sum(F.when(F.col("toxic") == k, F.col("n")).otherwise(0)).alias(f"n{k}") for k in (0, 1)])
    size = [float(max(1, counts.get(k, 0))) for k in (0, 1)]
    rate = [F.col(f"n{k}") / size[k] for k in (0, 1)]
    both = (F.col("n0") + F.col("n1")) / (size[0] + size[1])
    surprise = sum((F.when(rate[k] > 0, F.col(f"n{k}") * F.log(rate[k] / both)).otherwise(0.0) for k in (0, 1)), F.lit(0.0))
    sides = [(rate[k] >= share) & (rate[k] >= ratio * rate[1 - k]) & (surprise >= least) for k in (0, 1)]
    found = sums.where(sides[0] | sides[1]).select("gram", sides[1].alias("toxic")).toArrow()
    gram, toxic = (np.asarray(found.column(c).combine_chunks()) if found.num_rows else np.zeros(0, np.int64) for c in ("gram", "toxic"))
    return {k: np.sort(gram[toxic.astype(bool) == bool(k)]) for k in (0, 1)}


def samples(sample: DataFrame, telling: dict[int, np.ndarray], max_stretches: int) -> dict[int, dict[bytes, int]]:
    """By class, the telling stretches of its own texts, and how many windows have each."""

    def found(batches):
        for batch in (part for whole in batches for part in slices(whole)):
            rows = [(label, s) for label, text in zip(batch.column("toxic").to_pylist(), texts(batch), strict=True) for w in windows(text, WINDOW) for s in stretches(w, telling[label])]
            columns = list(zip(*rows, strict=True)) or [()] * 2
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.binary())], names=["toxic", "stretch"])

    counted = sample.mapInArrow(found, "toxic int, stretch binary").groupBy("toxic", "stretch").count()
    return {k: {bytes(r.stretch): r["count"] for r in counted.where(f"toxic = {k}").orderBy(F.desc("count"), "stretch").limit(max_stretches).collect()} for k in (0, 1)}


def fit(docs: DataFrame, labels: DataFrame, max_documents: int = 3000, max_stretches: int = 30_000, share: float = 0.01, ratio: float = 8.0, least: float = 12.0) -> dict:
    """The model, from the rows of docs that labels has."""
    sample, classes = sampled(docs, labels, max_documents)
    counts = {r.toxic: r["count"] for r in sample.groupBy("toxic").count().collect()}
    if not counts.get(1):
        return {"none": True}
    own = samples(sample, telling_grams(sample, counts, share, ratio, least), max_stretches)
    ordinary, toxic = train(own[0]), train(own[1])

    def profiles(batches):
        advantage = Advantage(ordinary, toxic)
        for batch in (part for whole in batches for part in slices(whole)):
            rows = [np.unique(advantage.of(t), return_counts=True) for t in texts(batch)]
            yield pa.RecordBatch.from_pydict({"toxic": batch.column("toxic"), "values": pa.array([v.tolist() for v, _ in rows], pa.list_(pa.int64())), "times": pa.array([n.tolist() for _, n in rows], pa.list_(pa.int64()))})

    profiled = sample.mapInArrow(profiles, "toxic int, values array<long>, times array<long>").collect()
    threshold, coefficients = calibrate([(r.toxic, np.repeat(np.array(r["values"], np.int64), np.array(r["times"], np.int64))) for r in profiled], (classes.get(0, 0), classes.get(1, 0)))
    return {"ordinary": ordinary, "toxic": toxic, "threshold": threshold, "coefficients": coefficients}


def score(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, score, windows, hits (windows above the threshold), advantage (bytes saved over all windows) of every row."""

    def scored(batches):
        release()
        if "none" not in model:
            advantage, t, coefficients = Advantage(model["ordinary"], model["toxic"]), model["threshold"], model["coefficients"]
        for batch in (part for whole in batches for part in slices(whole)):
            out = []
            for text in texts(batch):
                if "none" in model:
                    out.append((0.0, 0, 0, 0))
                else:
                    a = advantage.of(text)
                    out.append((chance(features(a, t), coefficients), len(a), int((a >= t).sum()), int(a.sum())))
            columns = list(zip(*out, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(columns[0], pa.float64()), *[pa.array(c, pa.int64()) for c in columns[1:]]], names=["doc_id", "score", "windows", "hits", "advantage"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(scored, "doc_id long, score double, windows long, hits long, advantage long")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").select("doc_id", "toxic")
    model = fit(docs.where(fold("doc_id", 4) != 2), labels)
    return score(docs, model).select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), "windows", "hits", "advantage")
