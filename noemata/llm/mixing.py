"""Mixing sources to target weights by weighted fair queueing, with DataFrame operations only.

Each source is a flow whose rate is its target. Its documents are shuffled (by a hash), once for each time that they may
be taken; a copy's virtual finish time is the source's running sum of sizes up to and with it, over the target. All copies
are put in order of finish time and taken while the budget, the sum of the targets, lasts. At time 1 every flow has sent
its target, so each source gets its target to within a document.

Targets: the budget is `share` of all sizes, dealt by weight; none may exceed `most` times its source's size, the excess
goes to the others by weight until none is above. Both sums over ordered rows (a source's copies, and all copies by
finish time) are taken in slices: totals of slices first, a small table, then within each slice. A source that holds most
rows is so spread over many tasks.

Cases: null or empty text has size 0 and is taken as 0 words; a null source is a source, put last in the order of
weights; repeated rows and ids count each, and of copies that finish at one time those of the first source, then of the smaller doc_id go first; a very long text is a size like any other; where all sizes are 0 (empty tables too) targets and taken words are 0. Other
columns that the table has are ignored by mix() and kept by mixed_documents().
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, table

WEIGHTS = (5.0, 2.0, 1.0)
#: Copies in one slice of a running sum, about.
SLICE = 4_000


def words(column: str) -> F.Column:
    """Number of runs of characters other than space and \\x09-\\x0D: where one begins, the character before is a space."""
    spaced = F.translate(F.coalesce(F.col(column), F.lit("")), "\t\n\x0b\x0c\r", "     ")
    return (F.size(F.split(F.concat(F.lit(" "), spaced, F.lit(" ")), " +")) - 2).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """source, source_size, target. sizes: source, size (a row for each document)."""
    each = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights) + 1).cast("int"))
    ceiling = F.col("source_size") * F.lit(float(most))
    each = each.withColumn("weight", weight).withColumn("_ceiling", ceiling).withColumn("_full_at", F.col("_ceiling") / F.col("weight"))
    # Sources fill up in the order of ceiling over weight. With those before a source full, the rest share what is left at the
    # level below; the first source that this level doesn't fill sets it for all.
    every = Window.orderBy("_full_at", F.col("source").asc_nulls_last())
    before, whole = every.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    each = each.withColumn("_spent", F.coalesce(F.sum("_ceiling").over(before), F.lit(0.0)))
    each = each.withColumn("_open", F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    each = each.withColumn("_budget", F.sum("source_size").over(whole) * F.lit(float(share)))
    each = each.withColumn("_level", (F.col("_budget") - F.col("_spent")) / F.col("_open"))
    each = each.withColumn("_n", F.row_number().over(every))
    level = F.min(F.when(F.col("_level") <= F.col("_full_at"), F.struct("_n", "_level"))).over(whole)["_level"]
    return each.select("source", "source_size", F.when(level.isNull(), F.col("_ceiling")).otherwise(F.least(F.col("_ceiling"), level * F.col("weight"))).alias("target"))


def _running(df: DataFrame, keys: list[str], slice_: str, order: list, value: str, name: str) -> DataFrame:
    """Sum of value over the rows of the same keys up to each row, in the order of (slice_, order)."""
    totals = df.groupBy(*keys, slice_).agg(F.sum(value).alias("_total"))
    before = Window.partitionBy(*keys).orderBy(slice_).rowsBetween(Window.unboundedPreceding, -1)
    firsts = totals.select(*keys, slice_, F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_first"))
    inside = Window.partitionBy(*keys, slice_).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    same = [df[k].eqNullSafe(firsts[k]) for k in [*keys, slice_]]
    on = same[0]
    for x in same[1:]:
        on = on & x
    summed = df.withColumn("_inside", F.sum(value).over(inside))
    on = [*keys, slice_]
    return summed.join(firsts, on).withColumn(name, F.col("_first") + F.col("_inside")).drop("_first", "_inside")


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, most: int = 2, seed: int = 7) -> DataFrame:
    """doc_id, size, source_size, target, taken, copies of every row of docs."""
    sized = cut(docs.select("doc_id", "source", words("text").alias("size")))
    goals = cut(targets(sized, weights, share, most))
    count, whole_size = sized.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    budget = float(whole_size) * min(share, float(most))  # what the targets add up to
    n = max(1, -(-count * most // SLICE))
    # Rows alike (repeated rows) are counted, not told apart; sizes are summed with that count.
    alike = sized.groupBy("doc_id", "source", "size").agg(F.count(F.lit(1)).alias("alike"))
    flows = alike.withColumn("source_key", F.coalesce(F.concat(F.lit("="), "source"), F.lit("")))
    copies = flows.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(most - 1)))).withColumn("sent", F.col("size") * F.col("alike"))
    copies = copies.withColumn("_hash", F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(c).cast("string") for c in ("epoch", "doc_id", "size")]).cast("binary")))
    part = F.floor(F.conv(F.substring("_hash", 1, 8), 16, 10).cast("long") * F.lit(n) / F.lit(2**32)).cast("long")  # rises with the hash
    copies = copies.withColumn("_slice", F.col("epoch") * n + part)
    summed = _running(copies, ["source_key"], "_slice", ["_hash", "doc_id"], "sent", "_upto")
    goal = goals.select(F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("source_key"), "source_size", "target")
    timed = summed.join(goal, "source_key").withColumn("_finish", F.when(F.col("target") > 0, F.col("_upto") / F.col("target")).otherwise(F.when(F.col("sent") > 0, F.lit(float("inf"))).otherwise(F.lit(0.0))))
    timed = timed.withColumn("_time", F.floor(F.least(F.col("_finish"), F.lit(1e9)) * n).cast("long"))  # as many slices as the slowest source needs
    order = ["_finish", "source_key", "epoch", "doc_id", "size"]
    queue = _running(timed.withColumn("_all", F.lit(0)), ["_all"], "_time", order, "sent", "_total")
    near = F.floor(F.lit(budget) - (F.col("_total") - F.col("sent"))) / F.greatest(F.col("size"), F.lit(1))
    whole = F.greatest(F.lit(0), F.least(F.col("alike"), F.floor(near))).cast("long")
    taken = queue.groupBy("doc_id", "source_key", "size", "alike", "source_size", "target").agg(F.sum(whole).alias("whole"))
    # Of rows alike the first ones get one copy more where the copies taken don't divide.
    each = taken.withColumn("_k", F.explode(F.sequence(F.lit(1), F.col("alike"))))
    share_of = (F.floor(F.col("whole") / F.col("alike")) + (F.col("_k") <= F.col("whole") % F.col("alike")).cast("long")).cast("long")
    return each.select("doc_id", "source_key", "size", "source_size", "target", share_of.alias("copies")).withColumn("taken", F.col("copies") * F.col("size"))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs, each as often as the mix takes it."""
    names, own = docs.columns, ["_mix_id", "_mix_source", "_mix_size"]
    taken = mix(docs, **options).groupBy("doc_id", "source_key", "size").agg(F.sum("copies").alias("_copies"), F.count(F.lit(1)).alias("_rows"))
    taken = taken.where("_copies > 0").toDF(*own, "_copies", "_rows")
    inner = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)], F.col("doc_id").alias(own[0]), F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias(own[1]), words("text").alias(own[2]))
    # A null id equals another here; rows alike take their share of the copies by their place among them.
    same = inner["_mix_id"].eqNullSafe(taken["_mix_id"]) & (inner["_mix_source"] == taken["_mix_source"]) & (inner["_mix_size"] == taken["_mix_size"])
    joined = inner.join(taken, same)
    alike = Window.partitionBy(inner["_mix_id"], inner["_mix_source"], inner["_mix_size"]).orderBy(F.xxhash64(*[F.col(f"c{i}") for i in range(len(names))]))
    once = joined.where("_rows = 1").select(*[f"c{i}" for i in range(len(names))], F.col("_copies").alias("_n"))
    several = joined.where("_rows > 1").withColumn("_place", F.row_number().over(alike))
    share = F.floor(F.col("_copies") / F.col("_rows")) + (F.col("_place") <= F.col("_copies") % F.col("_rows")).cast("long")
    several = several.select(*[f"c{i}" for i in range(len(names))], share.cast("long").alias("_n")).where("_n > 0")
    rows = once.unionAll(several) if taken.where("_rows > 1").take(1) else once
    return rows.withColumn("_", F.explode(F.sequence(F.lit(1), F.col("_n").cast("int")))).select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)])


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies")


#: The same mix in SQL: cumulative sums over whole sources, and over all copies, in one piece.
SQL = r"""
WITH RECURSIVE sized AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
each AS (SELECT source, CAST(sum(size) AS DOUBLE) AS source_size, CAST(([5, 2, 1])[1 + CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS INT)] AS DOUBLE) AS weight FROM sized GROUP BY source),
total AS (SELECT CAST(sum(source_size) AS DOUBLE) AS whole, CAST(sum(weight) AS DOUBLE) AS weights FROM each),
levels AS (SELECT *, 2 * source_size AS ceiling, 2 * source_size / weight AS full_at FROM each),
filled AS (SELECT *, row_number() OVER w AS n, coalesce(sum(ceiling) OVER b, 0) AS spent, coalesce(sum(weight) OVER b, 0) AS gone FROM levels
  WINDOW w AS (ORDER BY full_at, source NULLS LAST), b AS (ORDER BY full_at, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
level AS (SELECT arg_min((whole * 1.5 - spent) / (weights - gone), n) AS lev FROM filled, total WHERE (whole * 1.5 - spent) / (weights - gone) <= full_at),
goals AS (SELECT source, source_size, CASE WHEN lev IS NULL THEN ceiling ELSE least(ceiling, lev * weight) END AS target FROM filled, level),
copies AS (SELECT s.*, e.epoch, md5(concat_ws(':', '7', e.epoch, s.doc_id, s.size)) AS h, coalesce('=' || s.source, '') AS k FROM sized s, (VALUES (0), (1)) e(epoch)),
timed AS (SELECT c.*, g.source_size, g.target, sum(c.size) OVER (PARTITION BY c.k ORDER BY c.epoch, c.h, c.doc_id ROWS UNBOUNDED PRECEDING) AS upto FROM copies c JOIN goals g ON c.source IS NOT DISTINCT FROM g.source),
queued AS (SELECT *, sum(size) OVER (ORDER BY CASE WHEN target > 0 THEN upto / target WHEN size > 0 THEN CAST('inf' AS DOUBLE) ELSE 0 END, k, epoch, doc_id, size ROWS UNBOUNDED PRECEDING) AS so_far FROM timed)
SELECT doc_id, size, CAST(source_size AS BIGINT) AS source_size, target, CAST(sum(CASE WHEN so_far <= whole * 1.5 THEN size ELSE 0 END) AS BIGINT) AS taken, CAST(sum(CASE WHEN so_far <= whole * 1.5 THEN 1 ELSE 0 END) AS BIGINT) AS copies
FROM queued, total GROUP BY doc_id, size, source_size, target
"""
