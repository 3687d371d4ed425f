"""Language identification by unigrams over the pieces of a public vocabulary, summed over all segmentations.

A text is lower-cased and cut at white space; each word stands behind the vocabulary's word mark. A word's probability in a
language is the sum, over all ways to cut it into pieces, of the product of the pieces' probabilities there: a forward pass
over its characters. Words are independent, so a text's is the product over its words, and what the text says of the
languages is the posterior under equal priors. Words are scored once and remembered (a bounded number of them).

Piece probabilities are fitted by expectation-maximisation (forward and backward passes) on the `max_words` most frequent
words (of at most `max_letters` letters) of each language in a bounded sample of the labelled documents (`max_documents`
of each language, those of smallest hash). Characters that the vocabulary lacks are pieces of a small fixed probability.

Cases: null texts and those without a letter get `und` and score 0; repeated rows and ids are judged each; null languages
aren't learned; without training rows (empty tables too) all texts get `und`; ties between languages go to the first by
name; a very long text, or word, is scored whole. Columns of other names are ignored.
"""

from __future__ import annotations

import os
from collections import Counter

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, fold, release, slices, table, texts

MARK = "▁"
CACHE = 1_000_000
LETTER = regex.compile(r"\p{L}")
UNKNOWN = 1e-9


def vocabulary(name: str) -> dict[str, int]:
    """Pieces of a sentencepiece model in lower case, numbered from 1. name: a path, or the name of a public vocabulary."""
    import public_tokenizers
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=name if os.path.isabs(name) else public_tokenizers.path(name))
    pieces = (model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)))
    return {p: i + 1 for i, p in enumerate(sorted({p.lower() for p in pieces}))}


class Lattice:
    """Words of one length: the piece number at each (start, stop), 0 where there is none."""

    def __init__(self, words: list[str], pieces: dict[str, int], longest: int):
        self.n, self.longest = len(words[0]), longest
        get, last = pieces.get, len(pieces) + 1
        self.at: dict[tuple[int, int], np.ndarray] = {}
        for start in range(self.n):
            for stop in range(start + 1, min(self.n, start + longest) + 1):
                none = last if stop == start + 1 else 0
                found = [get(w[start:stop], none) for w in words]
                if any(found):
                    self.at[start, stop] = np.array(found)

    def forward(self, chance: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """chance: piece by language. Sums over segmentations of each beginning, scaled at each place; and the logarithms of the scales, summed up to each place."""
        languages = chance.shape[1]
        alpha = np.zeros((self.n + 1, size, languages))
        logs = np.zeros((self.n + 1, size, languages))
        alpha[0] = 1
        for stop in range(1, self.n + 1):
            total = alpha[stop]
            for start in range(max(0, stop - self.longest), stop):
                if (ids := self.at.get((start, stop))) is not None:
                    total += alpha[start] * np.exp(logs[start] - logs[stop - 1]) * chance[ids]
            # Divide by the value itself: each place then holds 1, and the logarithm what it was.
            scale = np.where(total > 0, total, 1)
            logs[stop] = logs[stop - 1] + np.log(scale)
            alpha[stop] = total / scale
        return alpha, logs

    def expected(self, chance: np.ndarray, weights: np.ndarray, counts: np.ndarray) -> None:
        """Add the expected number of uses of each piece, words weighted (word by language)."""
        size, languages = weights.shape
        alpha, logs = self.forward(chance, size)
        whole = logs[self.n]
        beta = np.full((self.n + 1, size, languages), -np.inf)
        beta[self.n] = 0
        for start in range(self.n - 1, -1, -1):
            for stop in range(start + 1, min(self.n, start + self.longest) + 1):
                if (ids := self.at.get((start, stop))) is not None:
                    with np.errstate(divide="ignore"):
                        step = np.log(chance[ids]) + beta[stop]
                    beta[start] = np.logaddexp(beta[start], step)
                    share = np.exp(np.where(np.isfinite(step), logs[start] + step - whole, -np.inf)) * (alpha[start] > 0)
                    for k in range(languages):
                        counts[:, k] += np.bincount(ids, share[:, k] * weights[:, k], minlength=len(counts))


def by_length(words: list[str]) -> dict[int, list[int]]:
    out: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        out.setdefault(len(w), []).append(i)
    return out


def train(words: dict[str, Counter], pieces: dict[str, int], rounds: int = 4, prior: float = 0.01, max_letters: int = 40) -> tuple[list[str], np.ndarray]:
    """Languages in order, and the chance of each piece in each; row 0 is for no piece, the last for an unknown character."""
    languages, longest = sorted(words), max(map(len, pieces), default=1)
    every = sorted(set().union(*words.values()))
    weights = np.array([[words[k][w] for k in languages] for w in every], float)
    size = len(pieces) + 2
    chance = np.full((size, len(languages)), 1.0 / size)
    groups = [(Lattice([MARK + every[i] for i in at], pieces, longest), at) for n, at in by_length(every).items() if n <= max_letters]
    for _ in range(rounds):
        counts = np.zeros((size, len(languages)))
        for lattice, at in groups:
            lattice.expected(chance, weights[at], counts)
        counts[1:-1] += prior
        chance = counts / counts[1:-1].sum(0)
        chance[0], chance[-1] = 0, UNKNOWN
    return languages, chance


class Scorer:
    """Log probabilities of words by language; remembers a bounded number of words."""

    def __init__(self, pieces: dict[str, int], chance: np.ndarray):
        self.pieces, self.chance, self.longest = pieces, chance, max(map(len, pieces), default=1)
        self.kept: dict[bytes, int] = {}
        self.logs = np.zeros((1024, chance.shape[1]))

    def learn(self, words: list[bytes]) -> None:
        if len(self.kept) + len(words) > CACHE:
            self.kept.clear()
        first = len(self.kept)
        while len(self.logs) < first + len(words):
            self.logs = np.concatenate([self.logs, np.zeros_like(self.logs)])
        self.kept.update(zip(words, range(first, first + len(words)), strict=True))
        read = [MARK + w.decode("utf-8", "replace").lower() for w in words]
        for n, at in by_length(read).items():
            step = max(1, 40_000 // (n + 1))
            for start in range(0, len(at), step):
                some = at[start : start + step]
                if n <= 400:
                    self.logs[[first + i for i in some]] = Lattice([read[i] for i in some], self.pieces, self.longest).forward(self.chance, len(some))[1][-1]
                else:  # a long run without space: one pass, a window of places at a time
                    for i in some:
                        self.logs[first + i] = self._long(read[i])

    def _long(self, word: str) -> np.ndarray:
        logs, last = [np.zeros(self.chance.shape[1])], len(self.pieces) + 1
        table_ = np.log(np.maximum(self.chance, 1e-300))
        for stop in range(1, len(word) + 1):
            total = None
            for start in range(max(0, stop - self.longest), stop):
                if i := self.pieces.get(word[start:stop], last if stop == start + 1 else 0):
                    step = logs[start - stop] + table_[i]
                    total = step if total is None else np.logaddexp(total, step)
            logs = [*logs[-self.longest + 1 :], total] if self.longest > 1 else [total]
        return logs[-1]

    def of(self, some: list[list[bytes]]) -> np.ndarray:
        """Log probability of each text, given as words, in each language."""
        new = [w for w in set().union(*some) if w not in self.kept] if some else []
        if new:
            if len(self.kept) + len(new) > CACHE:
                new = list(set().union(*some))
            self.learn(new)
        out = np.zeros((len(some), self.chance.shape[1]))
        for i, words in enumerate(some):
            out[i] = self.logs[list(map(self.kept.__getitem__, words))].sum(0) if words else 0
        return out


def first_of(rows: DataFrame, order: list, most: int, level: Column | None = None) -> DataFrame:
    """The first rows of each language in this order. Rows are counted by level (by default the first of order; it must rise with the order) first, and only levels up to that of the last row wanted are
    ranked; so a language of most rows sends its counts to one task and not its rows."""
    levels = rows.withColumn("_l", order[0] if level is None else level)
    counts = levels.groupBy("lang", "_l").agg(F.count(F.lit(1)).alias("_c"))
    before = F.sum("_c").over(Window.partitionBy("lang").orderBy("_l")) - F.col("_c")
    last = counts.withColumn("_b", before).where(F.col("_b") < most).groupBy("lang").agg(F.max("_l").alias("_last"))
    near = levels.join(F.broadcast(last), "lang").where("_l <= _last")  # a row for each language
    place = F.row_number().over(Window.partitionBy("lang").orderBy("_l", *order))
    return near.withColumn("_n", place).where(F.col("_n") <= most).drop("_n", "_l", "_last")


def fit(training: DataFrame, pieces: dict[str, int], max_documents: int = 1000, max_words: int = 8000, max_letters: int = 40) -> tuple[list[str], np.ndarray]:
    """training: doc_id, text, lang."""
    spark = training.sparkSession
    known = training.where("lang IS NOT NULL")
    h = F.xxhash64("doc_id")
    picked = cut(first_of(known.select("doc_id", "lang").distinct(), [h, F.col("doc_id")], max_documents, F.shiftright(h, 52)))  # 4096 levels
    sample = known.join(F.broadcast(picked), ["doc_id", "lang"])  # at most max_documents for each language

    def counted(batches):
        for batch in batches:
            held: dict[str, Counter] = {}
            for lang, text in zip(batch.column("lang").to_pylist(), texts(batch), strict=True):
                held.setdefault(lang, Counter()).update(text.lower().split())
            rows = [(k, w, n) for k, c in held.items() for w, n in c.items()]
            columns = list(zip(*rows, strict=True)) or [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.binary(), pa.int64()), strict=True)], names=["lang", "word", "n"])

    counts = sample.select("lang", "text").mapInArrow(counted, "lang string, word binary, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    top = first_of(counts, [F.desc("n"), F.col("word")], max_words, -F.col("n"))
    words: dict[str, Counter] = {}
    for lang, word, n in zip(*(c.to_pylist() for c in top.toArrow().columns), strict=True):
        words.setdefault(lang, Counter())[word.decode("utf-8", "replace").lower()] += n
    return train(words, pieces, max_letters=max_letters) if words else ([], np.zeros((len(pieces) + 2, 0)))


def identify(docs: DataFrame, training: DataFrame, name: str = "piece_bpe_32k.model", **options) -> DataFrame:
    """doc_id, lang_pred, score of every row of docs."""
    pieces = vocabulary(name)
    languages, chance = fit(training, pieces, **options)
    sent = docs.sparkSession.sparkContext.broadcast((pieces, chance))  # a row for each piece of the vocabulary

    def judged(batches):
        release()
        scorer = Scorer(*sent.value)
        for batch in (part for whole in batches for part in slices(whole, 4 << 20)):
            found = texts(batch)
            logs = scorer.of([t.lower().split() for t in found])
            out = []
            for text, own in zip(found, logs, strict=True):
                if not languages or not LETTER.search(text.decode("utf-8", "replace")):
                    out.append(("und", 0.0))
                else:
                    best = int(np.argmax(own))
                    out.append((languages[best], float(1 / np.exp(own - own[best]).sum())))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.float64())], names=["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(judged, "doc_id long, lang_pred string, score double")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = identify(docs, docs.select("doc_id", "text", "lang").where(fold("doc_id", 5) != 0))
    return found.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "lang_pred", "score")
