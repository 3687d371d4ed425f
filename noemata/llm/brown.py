"""Language-model scores from class-based bigrams; exchange clustering assigns words to classes.

Tokens: runs of non-white-space, ASCII letters lower-cased, and one end for each text (which also stands before its first
word). Counts are taken over all training texts. Exchange clustering goes in two steps.

The `n_seed` most frequent words, and `n_endings` groups of all other words by the hash of their last two bytes, are
clustered on the driver: from classes dealt out by frequency, one item at a time moves to the class where the likelihood of
the class bigrams is largest, until nothing moves. Then every other word that occurs `min_count` times or more, up to the
`n_near` most frequent words in all, leaves its group and moves to the class that is best for it among these, by the counts
of the classes before and after it: the words are dealt out to tasks, the table of class bigrams stays as it is meanwhile.
Rarer words, seen or not, have the class of their group. So the vocabulary that is clustered word by word grows with the
corpus. In the end the class bigrams are counted anew.

P(word | before) = P(class | class before) P(word | class). Transitions are smoothed towards the share of the class. Words
get their count less a discount; what that leaves, with one count more, is the chance of the unseen words of the class as
one event, as the base's V + 1 counts them as one: over all seen words and one unseen word of each class the chances sum to 1.

Texts are tokenised twice: for the counts, and to be written as numbers of items, which the later passes read.

Counts of words: the `n_near` most frequent go to all tasks, the others are joined by word. Only these, the table of item
pairs (n_seed + n_endings squared, at most), a class for each near word and a row for each class reach the driver, whatever
the input.

Cases: null or empty texts, and those of white space only, are an end alone; a very long text is scored whole; repeated
rows and ids are scored each; of equally frequent words those that sort first count as more frequent, of equally good
classes the first is taken; without training rows every token is unseen, N and V are 0 and each token's probability is 1
under the base and the class model's for unseen words; an empty table gives an empty result. Columns of other names are
ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import flat, fold, release, slices, table, texts, written

END = b""
#: Words counted, words remembered, and cells of words by class held by a task before it passes them on or forgets them.
FLUSH, MEMORY, CELLS = 200_000, 250_000, 2_000_000
#: Bytes of text that are made into words at once.
TEXTS = 1 << 20


def tokens(text: bytes) -> list[bytes]:
    return [*text.lower().split(), END]


def ending(word: bytes, n_endings: int) -> int:
    return zlib.crc32(word[-2:]) % n_endings


def counts(docs: DataFrame) -> DataFrame:
    """word, c over all texts. Tasks send sums for the words they have seen, a bounded number at a time."""

    def counted(batches):
        release()
        held: Counter = Counter()

        def flush():
            out = pa.RecordBatch.from_arrays([pa.array(list(held.keys()), pa.binary()), pa.array(list(held.values()), pa.int64())], names=["word", "c"])
            held.clear()
            return out

        for batch in (part for whole in batches for part in slices(whole, TEXTS)):
            for text in texts(batch):
                held.update(tokens(text))
            if len(held) > FLUSH:
                yield flush()
        yield flush()
        release()

    return docs.select("text").mapInArrow(counted, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


class Items(dict):
    """Item of a word: its place among the listed words, or its ending's group behind them."""

    def __init__(self, words: list[bytes], n_endings: int):
        super().__init__({w: i for i, w in enumerate(words)})
        self.groups = list(range(len(words), len(words) + n_endings))  # one number for all words of a group
        self.n_endings = n_endings

    def __missing__(self, word: bytes) -> int:
        item = self.groups[ending(word, self.n_endings)]
        if len(self) < MEMORY:
            self[word] = item
        return item


def encoded(docs: DataFrame, trained: F.Column, near: list[bytes], n_endings: int) -> DataFrame:
    """row, doc_id, trained, codes (the items of a text's tokens, the end last, as 32-bit numbers), rare (words that aren't near, with their items and how often each occurs) of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(near)

    def coded(batches):
        release()
        items, n_near, part, row = Items(sent.value, n_endings), len(sent.value), TaskContext.get().partitionId(), 0
        for batch in (some for whole in batches for some in slices(whole, TEXTS)):
            codes, words, kinds, times, stops = [], [], [], [], [0]
            for text in texts(batch):
                found = tokens(text)
                at = np.array(list(map(items.__getitem__, found)), "<i4")
                codes.append(at.tobytes())
                rare = Counter(found[k] for k in np.flatnonzero(at >= n_near).tolist())
                words += rare
                times += rare.values()
                kinds += [items[w] for w in rare]
                stops.append(len(words))
            rares = pa.ListArray.from_arrays(pa.array(stops, pa.int32()), pa.StructArray.from_arrays([pa.array(words, pa.binary()), pa.array(kinds, pa.int32()), pa.array(times, pa.int32())], names=["word", "item", "times"]))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(row, row + len(batch)) + (part << 36)), batch.column("doc_id"), batch.column("trained"), pa.array(codes, pa.binary()), rares], names=["row", "doc_id", "trained", "codes", "rare"])
            row += len(batch)
        release()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(trained, F.lit(False)).alias("trained"))
    return written(rows.mapInArrow(coded, "row long, doc_id long, trained boolean, codes binary, rare array<struct<word: binary, item: int, times: int>>"), "encoded")


def _entropy(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def _walk(batch: pa.RecordBatch, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The items of all texts of a batch behind an end, and where each text starts; as a text ends with an end, that stands before the next one too."""
    data, stops = flat(batch, "codes")
    return np.concatenate([np.array([end], "<i4"), data.view("<i4")]), stops // 4


def pairs(training: DataFrame, of: np.ndarray, n: int, end: int) -> np.ndarray:
    """How often one class follows another, over all texts (codes). of: the class of each item, n: how many there are."""
    sent = training.sparkSession.sparkContext.broadcast(of)

    def paired(batches):
        held = np.zeros(n * n, np.int64)
        for batch in (some for whole in batches for some in slices(whole, column="codes")):
            at = sent.value[_walk(batch, end)[0]]
            cells, times = np.unique(at[:-1] * n + at[1:], return_counts=True)
            held[cells] += times
        some = np.flatnonzero(held)
        for start in range(0, len(some), 100_000):
            part = some[start : start + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(held[part])], names=["pair", "n"])
        release()

    found = training.mapInArrow(paired, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(n * n)
    out[np.asarray(found.column("pair").combine_chunks())] = np.asarray(found.column("n").combine_chunks())
    return out.reshape(n, n)


def gains(table_: np.ndarray, right: np.ndarray, left: np.ndarray, own: np.ndarray) -> np.ndarray:
    """What each class of each table (words by class by class, without the word) gains by its word; right, left: how often each class follows and precedes it; own: how often it follows itself."""
    whole = _entropy(table_)
    after, before = _entropy(table_ + right[:, None, :]) - whole, _entropy(table_ + left[:, :, None]) - whole
    k = np.arange(table_.shape[1])
    both = _entropy(table_[:, k, k] + right + left + own[:, None]) - whole[:, k, k]
    out = after.sum(2) + before.sum(1) + both - after[:, k, k] - before[:, k, k]
    # What precedes the word stays a predecessor, what follows it a follower, whatever class it is in.
    for of, more in ((table_.sum(2) + left, right.sum(1) + own), (table_.sum(1) + right, left.sum(1) + own)):
        out -= _entropy(of + more[:, None]) - _entropy(of)
    return out


def exchange(follows: np.ndarray, n_classes: int, rounds: int = 8) -> np.ndarray:
    """Class of each item. Moves each item in turn to its best class; ends when a round moves none."""
    n = len(follows)
    order = np.argsort(-follows.sum(1), kind="stable")
    of = np.empty(n, np.int64)
    of[order] = np.arange(n) % n_classes
    hot = np.zeros((n, n_classes))
    hot[np.arange(n), of] = 1
    after, before = follows @ hot, follows.T @ hot  # item by class
    table_ = hot.T @ after
    for _ in range(rounds):
        moved = 0
        for w in order.tolist():
            right, left, own, was = after[w].copy(), before[w].copy(), follows[w, w], of[w]
            if not right.sum() + left.sum():
                continue
            right[was] -= own
            left[was] -= own
            table_[was] -= right
            table_[:, was] -= left
            table_[was, was] -= own
            gain = gains(table_[None], right[None], left[None], np.array([own]))[0]
            new = int(np.argmax(gain))
            if gain[new] <= gain[was] + 1e-9:
                new = was
            table_[new] += right
            table_[:, new] += left
            table_[new, new] += own
            if new != was:
                moved += 1
                of[w] = new
                after[:, was] -= follows[:, w]
                after[:, new] += follows[:, w]
                before[:, was] -= follows[w]
                before[:, new] += follows[w]
        if not moved:
            break
    return of


def moved_to(table_: np.ndarray, right: np.ndarray, left: np.ndarray, was: np.ndarray, block: int = 128) -> np.ndarray:
    """The best class of each word, each on its own against the same table of class bigrams, of which it is part in class `was`."""
    out = was.copy()
    for start in range(0, len(was), block):
        of = slice(start, start + block)
        r, b, at = right[of], left[of], np.arange(len(was[of]))
        without = np.repeat(table_[None], len(at), 0)
        without[at, was[of]] -= r
        without[at, :, was[of]] -= b
        gain = gains(np.maximum(without, 0), r, b, np.zeros(len(at)))
        best = gain.argmax(1)
        better = gain[at, best] > gain[at, was[of]] + 1e-9
        out[of] = np.where(better, best, was[of])
    return out


def exchanged(training: DataFrame, first: int, last: int, end: int, classes: np.ndarray, table_: np.ndarray) -> np.ndarray:
    """The classes of the near words from `first` up to `last`, each exchanged against the table; classes: those of all near words and then of the groups."""
    k = table_.shape[0]
    assert k <= 128, "a class and a side are packed in a byte"
    sent = training.sparkSession.sparkContext.broadcast(classes)

    def around(batches):
        of, held, size = sent.value, [], 0

        def flush():
            cell, n = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            word = cell // (2 * k)
            starts = np.flatnonzero(np.diff(word, prepend=-1))
            packed = (n.astype(np.int32) << 8 | (cell % (2 * k)).astype(np.int32)).astype("<i4")  # at most CELLS of a cell, so 24 bits hold n
            offsets = (4 * np.append(starts, len(cell))).astype(np.int32)
            cells_ = pa.BinaryArray.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(packed)])
            yield from pa.Table.from_arrays([pa.array(word[starts].astype(np.int32)), cells_], names=["word", "cells"]).to_batches(20_000)

        for batch in (some for whole in batches for some in slices(whole, column="codes")):
            at = _walk(batch, end)[0].astype(np.int64)
            own = of[at]
            mine = np.flatnonzero((at >= first) & (at < last))
            mine = mine[(mine > 0) & (mine < len(at) - 1)]
            held += [at[mine] * 2 * k + own[mine + 1], at[mine] * 2 * k + k + own[mine - 1]]
            size += 2 * len(mine)
            if size > CELLS:
                yield from flush()
                size = 0
        if held:
            yield from flush()
        release()

    def best(batches):
        of = sent.value
        seen, sums = np.zeros(last, bool), np.zeros((last, 2 * k), np.float32)  # a row for each near word, whatever the input
        for batch in batches:
            data, stops = flat(batch, "cells")
            word, packed = np.asarray(batch.column("word")).astype(np.int64), data.view("<i4")
            np.add.at(sums.reshape(-1), np.repeat(word, np.diff(stops) // 4) * 2 * k + (packed & 255), (packed >> 8).astype(np.float32))
            seen[word] = True
        at = np.flatnonzero(seen)
        new = moved_to(table_, sums[at, :k].astype(float), sums[at, k:].astype(float), of[at])
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(new)], names=["word", "class"])
        release()

    cells = training.mapInArrow(around, "word int, cells binary").repartition("word")
    found = cells.mapInArrow(best, "word long, class long").toArrow()  # a row for each near word at most
    out = classes.copy()
    if found.num_rows:
        out[np.asarray(found.column("word").combine_chunks())] = np.asarray(found.column("class").combine_chunks())
    return out


@dataclass
class Model:
    """near: the most frequent words, near_c: their counts; classes: the class of each of them and then of each group of endings; table: class bigrams; held, types: tokens and words of each class."""

    near: list[bytes]
    near_c: np.ndarray
    n_endings: int
    classes: np.ndarray
    table: np.ndarray
    held: np.ndarray
    types: np.ndarray
    size: int
    distinct: int
    discount: float
    pull: float

    def steps(self) -> np.ndarray:
        """Logarithms of P(class | class before)."""
        t = self.table
        share = (t.sum(0) + 1) / (t.sum() + len(t))
        return np.log10((t + self.pull * share[None, :]) / (t.sum(1) + self.pull)[:, None])

    def unseen(self) -> np.ndarray:
        """Logarithms of P(an unseen word | class)."""
        return np.log10((self.discount * self.types + 1) / (self.held + 1))

    def class_of(self, word: bytes) -> int:
        return int(self.classes[self.near.index(word) if word in self.near else len(self.near) + ending(word, self.n_endings)])


def fit(docs: DataFrame, trained: F.Column, n_seed: int = 1500, n_endings: int = 200, n_classes: int = 48, n_near: int = 131_072, min_count: int = 3, discount: float = 0.75, pull: float = 20.0) -> tuple[Model, DataFrame, DataFrame]:
    """The model of the rows of docs that are to be trained on, all their words with their counts (word, c), and all rows of docs encoded."""
    counted = written(counts(docs.where(trained)), "counts")
    size, distinct = (int(x or 0) for x in counted.agg(F.sum("c"), F.count(F.lit(1))).first())
    top = counted.orderBy(F.desc("c"), "word").limit(n_near).toArrow()
    near = list(top.column("word").to_pylist())
    near_c = np.asarray(top.column("c").combine_chunks() if top.num_rows else np.zeros(0), np.float64)
    if END not in near:  # so rare, or no training rows
        ends = counted.where(F.col("word") == F.lit(END)).first()
        near, near_c = [*near, END], np.append(near_c, float(ends.c) if ends else 0.0)
    rows = encoded(docs, trained, near, n_endings)
    training, end = rows.where("trained").select("codes"), near.index(END)
    n_first = min(n_seed, len(near))
    alone = np.arange(len(near) + n_endings)
    alone[n_first : len(near)] = [n_first + 1 + ending(w, n_endings) for w in near[n_first:]]
    alone[len(near) :] = n_first + 1 + np.arange(n_endings)
    alone[end] = end if end < n_first else n_first  # a place is kept for an end that isn't among the seed
    follows = pairs(training, alone, n_first + 1 + n_endings, end)
    items = exchange(follows, n_classes)
    classes, table_ = items[alone], _table(follows, items, n_classes)
    last = int((near_c >= min_count).sum())
    if last > n_first:
        classes = exchanged(training, n_first, last, end, classes, table_)
        table_ = pairs(training, classes, n_classes, end)
    sent = docs.sparkSession.sparkContext.broadcast((near, classes))

    def classed(batches):
        words, of = sent.value
        known = Items(words, n_endings)
        for batch in batches:
            own = of[np.array([known[w] for w in batch.column("word").to_pylist()], np.int64)] if len(batch) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(own), batch.column("c")], names=["class", "c"])

    held, types = np.zeros(n_classes), np.zeros(n_classes)
    for r in counted.mapInArrow(classed, "class long, c long").groupBy("class").agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("t")).collect():
        held[r["class"]], types[r["class"]] = r["c"], r["t"]
    return Model(near, near_c, n_endings, classes, table_, held, types, size, distinct, discount, pull), counted, rows


def _table(follows: np.ndarray, items: np.ndarray, n_classes: int) -> np.ndarray:
    hot = np.zeros((len(items), n_classes))
    hot[np.arange(len(items)), items] = 1
    return hot.T @ follows @ hot


def score(docs: DataFrame, trained: F.Column, **options) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score of every row of docs, by the model of the rows of docs that are to be trained on."""
    return scored(*fit(docs, trained, **options))


def scored(model: Model, counted: DataFrame, rows: DataFrame) -> DataFrame:
    """rows: encoded."""
    spark, whole = rows.sparkSession, float(model.size + model.distinct + 1)
    step, unseen, log_held = model.steps(), model.unseen(), np.log10(model.held + 1)
    known, n_near, end = model.near_c > 0, len(model.near), model.near.index(END)
    classes, groups = model.classes, np.zeros(model.n_endings)
    # Of words that aren't near, what counts and the word's own chance add comes by a join.
    base = np.append(np.log10((model.near_c + 1) / whole), groups)
    own = np.append(np.where(known, np.log10(np.maximum(model.near_c - model.discount, 1e-9)) - log_held[classes[:n_near]], unseen[classes[:n_near]]), groups)
    seen = np.append(known.astype(np.int64), groups.astype(np.int64))
    sent = spark.sparkContext.broadcast((base, own, seen))

    def walked(batches):
        base, own, seen = sent.value
        for batch in (some for whole_ in batches for some in slices(whole_, column="codes")):
            if not len(batch):
                continue
            at, stops = _walk(batch, end)
            of, now, starts = classes[at], at[1:], stops[:-1]  # every text has a token, its end
            sums = [np.add.reduceat(x, starts) for x in (seen[now], base[now], step[of[:-1], of[1:]] + own[now])]
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("doc_id"), pa.array(np.diff(stops)), *map(pa.array, sums)], names=["row", "doc_id", "n_tokens", "n_near", "base_near", "own_near"])
        release()

    first = rows.select("row", "doc_id", "codes").mapInArrow(walked, "row long, doc_id long, n_tokens long, n_near long, base_near double, own_near double")
    rare = rows.select("row", F.inline("rare"))
    least = float(model.near_c[-2 if model.near[-1] == END and n_near > 1 else -1]) if known.sum() < model.distinct else 0.0
    far = counted.where(F.col("c") <= least)  # the near ones and those as frequent as the last of them; the others aren't asked for
    joined = rare.join(far, "word", "left")
    by_item = lambda x: F.element_at(F.array(*[F.lit(float(x[k])) for k in classes[n_near:]]), F.col("item") - n_near + 1)
    found = F.col("c").isNotNull()
    of_own = F.when(found, F.log10(F.col("c") - model.discount) - by_item(log_held)).otherwise(by_item(unseen))
    of_base = F.when(found, F.log10((F.col("c") + 1) / F.lit(whole))).otherwise(F.lit(float(np.log10(1 / whole))))
    sums = joined.groupBy("row").agg(F.sum(of_own * F.col("times")).alias("own_far"), F.sum(of_base * F.col("times")).alias("base_far"), F.sum(F.when(found, F.col("times")).otherwise(0)).alias("n_far"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return first.join(sums, "row", "left").select(
        "doc_id", "n_tokens", (F.col("n_near") + zero("n_far")).alias("n_known"), F.lit(model.size).cast("long").alias("train_tokens"), (F.col("base_near") + zero("base_far")).alias("base_score"), (F.col("own_near") + zero("own_far")).alias("score")
    )


def op3_class_bigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = score(docs, fold("doc_id", 7) != 2)
    return found.select("doc_id", (fold("doc_id", 7) == 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
