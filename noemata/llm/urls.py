"""URL filters: a fixed list of host and path rules, and association rules that Spark's FP-growth mines for the rest.

The URLs that the fixed list decides are the labelled ones: their tokens (scheme, host labels and their parts, top-level
domain, path segments, query keys, endings) and the verdict are transactions. FP-growth finds the frequent token
combinations; the rules that conclude a verdict are pruned by support and confidence, and where a rule with fewer tokens
is as confident. The others are judged by the mined rules: an inverted index leads from a rule's rarest token to it, the
most confident rule whose tokens all are in the URL wins (then more support, then its text), and without any the verdict
is the default.

Cases: a null URL or one without :// has empty host and path, fits no fixed rule and gets the mined rules' or the default
verdict; repeated rows and ids are judged each; an empty table, or one where the fixed list decides nothing, mines no
rule. Columns of other names are ignored.
"""

from __future__ import annotations

import re
from collections import defaultdict

import pyarrow as pa
from pyspark.ml.fpm import FPGrowth
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, table

#: (host, path, verdict)
RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))
_LOWER = {c: c + 32 for c in range(65, 91)}
_AFTER = re.compile(r"[/?#]")


def host_and_path(url: str | None) -> tuple[str, str]:
    head, found, rest = (url or "").partition("://")
    if not found:
        return "", ""
    stop = _AFTER.search(rest)
    host, tail = (rest[: stop.start()], rest[stop.start() :]) if stop else (rest, "")
    return host.translate(_LOWER), re.split(r"[?#]", tail, maxsplit=1)[0]


class Fixed:
    """The fixed list, by host; looks up the host and each domain above it."""

    def __init__(self, rules=RULES):
        self.by_host = defaultdict(list)
        for host, path, verdict in rules:
            self.by_host[host].append((len(host) + len(path), host + path, path, verdict))

    def of(self, host: str, path: str) -> tuple[str | None, str | None]:
        best, rest = None, host
        while rest:
            for rule in self.by_host.get(rest, ()):
                if path.startswith(rule[2]) and (best is None or rule > best):
                    best = rule
            rest = rest.partition(".")[2]
        return (best[1], best[3]) if best else (None, None)


def tokens(url: str | None) -> list[str]:
    """Distinct tokens of a URL. Numbers in the path are one token."""
    host, path = host_and_path(url)
    head, _, rest = (url or "").partition("://")
    out = {f"scheme={head.translate(_LOWER)}"} if rest else set()
    labels = [x for x in host.split(".") if x]
    if labels:
        out |= {f"top={labels[-1]}", f"domain={'.'.join(labels[-2:])}"} | {f"label={x}" for x in labels[:-2]} | {f"part={y}" for x in labels[:-2] for y in x.split("-")}
    for segment in path.split("/"):
        name, dot, ending = segment.rpartition(".")
        if dot and len(ending) <= 5:
            out.add(f"ending={ending}")
        for word in re.split(r"[-_]", name if dot else segment):
            if word:
                out.add("path=0" if word.isdigit() else f"path={word}")
    query = rest.partition("?")[2].partition("#")[0]
    out |= {f"key={pair.partition('=')[0]}" for pair in query.split("&") if pair}
    if "#" in rest:
        out.add("fragment")
    return sorted(out)


def mine(pages: DataFrame, rules=RULES, support: float = 0.005, confidence: float = 0.9) -> list[tuple[list[str], str, float, float]]:
    """Association rules (tokens, verdict, confidence, support) from the URLs that the fixed list decides. What support and confidence leave reaches the driver, but for rules that one token less makes as confident."""

    def labelled(batches):
        fixed = Fixed(rules)
        for batch in batches:
            out = []
            for url in batch.column("url").to_pylist():
                verdict = fixed.of(*host_and_path(url))[1]
                if verdict:
                    out.append([*tokens(url), f"verdict={verdict}"])
            yield pa.RecordBatch.from_pydict({"items": pa.array(out, pa.list_(pa.string()))})

    model = FPGrowth(itemsCol="items", minSupport=support, minConfidence=confidence).fit(pages.select("url").mapInArrow(labelled, "items array<string>"))
    if not model.freqItemsets.take(1):
        return []
    found = model.associationRules.where("consequent[0] LIKE 'verdict=%'").select(F.array_sort("antecedent").alias("antecedent"), F.substr(F.col("consequent")[0], F.lit(9)).alias("verdict"), "confidence", "support")
    concluded = cut(found)
    # A rule that any subset makes redundant is so by a minimal one, which stays; so the driver's pruning of the rest is exact.
    less = concluded.select("antecedent", "verdict", "confidence", F.explode("antecedent").alias("_token")).withColumn("_less", F.array_remove("antecedent", F.col("_token")))
    shorter = concluded.select(F.col("antecedent").alias("_less"), "verdict", F.col("confidence").alias("_confidence"))
    redundant = less.join(shorter, ["_less", "verdict"]).where("_confidence >= confidence").select("antecedent", "verdict").distinct()
    best = concluded.join(redundant, ["antecedent", "verdict"], "left_anti")
    out, kept = [], defaultdict(list)
    for r in sorted(best.collect(), key=lambda r: (len(r.antecedent), -r.confidence)):
        own = frozenset(r.antecedent)
        if not any(c >= r.confidence and held <= own for token in own for held, c in kept[token, r.verdict]):
            out.append((sorted(own), r.verdict, r.confidence, r.support))
            for token in own:
                kept[token, r.verdict].append((own, r.confidence))
    return out


def judge(pages: DataFrame, rules=RULES, default: str = "allow", **options) -> DataFrame:
    """page_id, host, path, rule, verdict, and mined (the mined rule that decided) of every row."""
    mined = mine(pages, rules, **options)
    often = defaultdict(int)
    for own, *_ in mined:
        for token in own:
            often[token] += 1

    def judged(batches):
        fixed, index = Fixed(rules), defaultdict(list)
        for own, verdict, confidence, support in mined:
            index[min(own, key=lambda t: (often[t], t))].append((confidence, support, " ".join(own), frozenset(own), verdict))
        for batch in batches:
            out = []
            for url in batch.column("url").to_pylist():
                host, path = host_and_path(url)
                rule, verdict = fixed.of(host, path)
                found = None
                if verdict is None:
                    own = set(tokens(url))
                    found = max((r for t in own for r in index.get(t, ()) if r[3] <= own), default=None, key=lambda r: r[:3])
                    verdict = found[4] if found else default
                out.append((host, path, rule, verdict, found[2] if found else None))
            columns = list(zip(*out, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), *[pa.array(c, pa.string()) for c in columns]], names=["page_id", "host", "path", "rule", "verdict", "mined"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url").mapInArrow(judged, "page_id long, host string, path string, rule string, verdict string, mined string")


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"))
