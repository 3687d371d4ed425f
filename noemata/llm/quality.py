"""Quality rules with weak supervision: rules vote or abstain, expectation-maximisation weighs them.

Each rule looks at one figure of the text and votes for good (1) or bad (0), or abstains (-1). Texts with the same votes
are alike to the model, so it is fitted on the table of vote patterns and their counts over all texts (at most 3 to the
number of rules rows, whatever the input). The hidden classes are good and one bad class for each kind of defect; what a
rule's votes are worth in each class and the classes' shares are estimated by expectation-maximisation. A text is kept where the posterior probability of good
is at least 1/2 and the base check passes.

Cases: a null or empty text has no words, fails the base check and isn't kept; repeated rows and ids are judged each; a very
long text is measured whole; a posterior of exactly 1/2 keeps; an empty table gives an empty result. Columns of other names are ignored by judge() and kept by kept_documents().
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import release, slices, table, texts, written

SYMBOLS = b"#*$%&|<>"
SPACE = b" \t\n\x0b\x0c\r"
UPPER, LOWER = bytes(range(65, 91)), bytes(range(97, 123))
CONTINUED = bytes(range(0x80, 0xC0))
MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD], np.uint64)

FIGURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct", "longest_run", "n_upper", "n_lower", "n_digits", "n_shouts", "n_long")


def without(text: bytes, these: bytes) -> int:
    """How many bytes of the text are among these."""
    return len(text) - len(text.translate(None, these))


def repeats(words: list[bytes]) -> tuple[int, int, int]:
    """Words in 5-word windows that occur twice or more, distinct words, longest run of one word."""
    n = len(words)
    if n == 0:
        return 0, 0, 0
    h = np.fromiter(map(hash, words), np.int64, n).view(np.uint64)
    turns = np.flatnonzero(h[1:] != h[:-1]) + 1
    longest = int(np.diff(turns, prepend=0, append=n).max())
    distinct = np.unique(h).size
    if n < 6:
        return 0, distinct, longest
    key = h[4:] * MULTIPLIERS[4]
    for k in range(4):
        key = key + h[k : n - 4 + k] * MULTIPLIERS[k]
    order = np.argsort(key)
    same = key[order][1:] == key[order][:-1]
    if not same.any():
        return 0, distinct, longest
    edges = np.zeros(n + 1, np.int64)
    twice = np.zeros(n - 4, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    at = np.flatnonzero(twice)
    np.add.at(edges, at, 1)
    np.add.at(edges, at + 5, -1)
    return int((np.cumsum(edges[:-1]) > 0).sum()), distinct, longest


def figures(text: bytes) -> tuple[int, ...]:
    words = text.split()
    repeat, distinct, longest = repeats(words)
    lines = [x for x in text.split(b"\n") if x.strip()]
    return (
        len(words), len(text) - without(text, SPACE + CONTINUED), without(text, SYMBOLS), len(lines) - len(set(lines)), repeat, len(lines), distinct, longest,
        without(text, UPPER), without(text, LOWER), without(text, b"0123456789"), text.count(b"!!") + text.count(b"??"), sum(map((40).__lt__, map(len, words))),
    )


#: Name, SQL condition for a vote for bad, SQL condition for a vote for good (else the rule abstains), kind of defect.
RULES = (
    ("length", "n_words < 8", "n_words >= 50", "form"),
    ("word_length", "word_chars < 2.2 * n_words OR word_chars > 15 * n_words", "word_chars BETWEEN 3 * n_words AND 10 * n_words", "form"),
    ("symbols", "n_symbols > 0.1 * n_words", "n_symbols <= 0.01 * n_words", "symbols"),
    ("duplicate_lines", "n_dup_lines > 0.25 * n_lines", "n_dup_lines = 0", "repetition"),
    ("repeated_passages", "n_repeat_words > 0.2 * n_words", "n_repeat_words <= 0.01 * n_words", "repetition"),
    ("distinct_words", "n_distinct < 0.1 * n_words", "n_distinct > 0.3 * n_words", "repetition"),
    ("longest_run", "longest_run >= 8", "longest_run <= 3", "repetition"),
    ("capitals", "n_upper > 0.4 * (n_upper + n_lower)", "n_upper < 0.12 * (n_upper + n_lower)", "shouting"),
    ("digits", "n_digits > 0.2 * word_chars", "n_digits < 0.05 * word_chars", "form"),
    ("shouting", "n_shouts > 0.05 * n_words", "n_shouts <= 0.005 * n_words", "shouting"),
    ("long_words", "n_long > 0.02 * n_words", None, "form"),
)


def features(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """The figures of each text, beside the columns to keep."""
    picked = docs.select(*[F.col(f"`{c}`") for c in keep], *[F.col(f"`{text}`")] * (text not in keep))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in picked.schema[: len(keep)]) + "".join(f", {x} long" for x in FIGURES)

    def measured(batches):
        release()
        for batch in (part for whole in batches for part in slices(whole, column=text)):
            found = [figures(t) for t in texts(batch, text)]
            columns = list(zip(*found, strict=True)) or [()] * len(FIGURES)
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(len(keep))] + [pa.array(c, pa.int64()) for c in columns], names=[*keep, *FIGURES])
        release()

    return picked.mapInArrow(measured, schema)


def votes() -> F.Column:
    """The votes of all rules as text: g, b or - for each."""
    return F.concat(*[F.when(F.expr(bad), "b").when(F.expr(good or "false"), "g").otherwise("-") for _, bad, good, _ in RULES])


def fit(patterns: dict[str, int], rounds: int = 300, slip: float = 0.003, accuracy: float = 0.8) -> tuple[dict[str, float], dict[str, tuple[float, float]], float]:
    """Posterior probability of good for each pattern; by rule, its false alarms and its accuracy; share of good texts.

    Hidden classes: good, and a bad one for each kind of defect, as a defect shows in few of the rules. A rule's accuracy
    is the chance that it votes bad on a text of its own kind of defect, given that it votes; its false alarms are that
    chance on all other texts. Abstentions say nothing. The prior of the accuracies is 5 votes, that of the false alarms
    has the share `slip` and weighs as much as the data, so that single false alarms don't make a class. The start is the
    any-rule vote: a text belongs to the kinds whose rules vote bad, else to the good ones.
    """
    keys = sorted(patterns)
    if not keys:
        return {}, {}, 1.0
    kinds = sorted({r[3] for r in RULES})
    own = np.array([[r[3] == kind for r in RULES] for kind in kinds]).astype(float)
    weight = np.array([patterns[k] for k in keys], float)
    n = weight.sum()
    bad, good = (np.array([[c == x for c in k] for k in keys]).astype(float) for x in "bg")
    alarms = own @ bad.T
    p = np.vstack([alarms.sum(0) == 0, alarms]).astype(float)
    p /= p.sum(0)
    for _ in range(rounds):
        held = p * weight
        told = held[1:] @ bad, held[1:] @ good
        right = (told[0] + 5 * accuracy) / (told[0] + told[1] + 5)  # [kind, rule]; only a kind's own rules count
        other = weight @ bad - (own * told[0]).sum(0), weight @ good - (own * told[1]).sum(0)
        false = (other[0] + slip * n) / (other[0] + other[1] + n)
        share = (held.sum(1) + np.array([4.5] + [0.1] * len(kinds))) / (n + 4.5 + 0.1 * len(kinds))
        ratio = bad @ (own * np.log(right / false)).T + good @ (own * np.log((1 - right) / (1 - false))).T
        odds = np.exp(np.vstack([np.zeros(len(keys)), np.clip(ratio.T, -300, 300)]) + np.log(share)[:, None])
        before, p = p, odds / odds.sum(0)
        if np.abs(p - before).max() < 1e-9:
            break
    rules = {r[0]: (float(false[k]), float((own * right)[:, k].sum())) for k, r in enumerate(RULES)}
    return dict(zip(keys, p[0].tolist(), strict=True)), rules, float(share[0])


def _told(measured: DataFrame, patterns: DataFrame) -> DataFrame:
    """measured with posterior, base_failed and kept, by the model of the patterns' votes."""
    found, _, _ = fit({r.votes: r["count"] for r in patterns.groupBy("votes").count().collect()})
    table_ = measured.sparkSession.createDataFrame(list(found.items()) or [("", 0.0)], "votes string, posterior double")
    judged = measured.join(F.broadcast(table_), "votes")  # at most 3 ** len(RULES) rows, far fewer in practice
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return judged.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("posterior") >= 0.5))


def judge(docs: DataFrame) -> DataFrame:
    """doc_id, the figures, votes, posterior, base_failed and kept of each row."""
    measured = written(features(docs, ["doc_id"]).withColumn("votes", votes()), "quality")
    return _told(measured, measured)


def kept_documents(docs: DataFrame) -> DataFrame:
    """The rows of docs that are kept, with their columns; whole rows go through, so nothing is joined back. Texts are measured twice, as a table of the rows would cost more than that."""
    names = docs.columns
    inner = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)])
    text = f"c{names.index('text')}"
    measured, patterns = (features(inner, keep, text).withColumn("votes", votes()) for keep in (inner.columns, [f"c{i}" for i, c in enumerate(names) if c != "text"][:1] or [text]))
    return _told(measured, patterns).where("kept").select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)])


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = judge(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", *FIGURES[:5], "base_failed", "kept", "posterior", "votes")
