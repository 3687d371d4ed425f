"""Discovery of a vocabulary from what occurs together: NPMI, graph Laplacian, spectral clusters."""

from __future__ import annotations

import warnings

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..fixed import CODE_RELATIONS

PLACES = 2**31


def unit_tokens(units: DataFrame, unit: list[str], column: str) -> DataFrame:
    """Distinct tokens of each unit."""
    return units.select(*unit, F.explode(F.array_distinct(F.regexp_extract_all(F.lower(F.col(column)), F.lit("[a-z0-9_]+"), F.lit(0)))).alias("token"))


def frequent(tokens: DataFrame, most: int = 2000) -> DataFrame:
    """token, n: the units that have it; the most frequent ones."""
    return tokens.groupBy("token").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "token").limit(most)


def cooccurrence(tokens: DataFrame, unit: list[str], vocabulary: DataFrame) -> DataFrame:
    """t1 <= t2, n: units that have both, tokens with themselves too. A unit is a line or sentence, so its pairs are few; they are made within the row.

    Tokens go as their place in the sorted vocabulary, and a pair as one number, which is counted and only then named.
    """
    places = vocabulary.select("token", F.row_number().over(Window.orderBy("token")).cast("int").alias("_at"))  # as few as the vocabulary
    n = int(tokens.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # given, so that small partitions, which grow by their pairs, are not put together
    kept = tokens.join(F.broadcast(places), "token").select(*unit, "_at").repartition(n, *unit).groupBy(*unit).agg(F.sort_array(F.collect_list("_at")).alias("ts"))
    first = kept.select(F.posexplode("ts").alias("i", "_1"), "ts")
    pairs = first.select("_1", F.explode(F.slice("ts", F.col("i") + 1, F.size("ts"))).alias("_2"))
    counted = pairs.groupBy((F.col("_1").cast("long") * PLACES + F.col("_2")).alias("_pair")).agg(F.count(F.lit(1)).alias("n")).select(F.expr(f"CAST(_pair DIV {PLACES} AS INT)").alias("_1"), (F.col("_pair") % PLACES).cast("int").alias("_2"), "n")
    for i in (1, 2):
        counted = counted.join(F.broadcast(places.select(F.col("_at").alias(f"_{i}"), F.col("token").alias(f"t{i}"))), f"_{i}")
    return counted.select("t1", "t2", "n")


def npmi(pairs: DataFrame, vocabulary: DataFrame, n_units: int) -> DataFrame:
    """t1, t2, npmi of the pairs over 0. A pair that is in every unit has none (0/0)."""
    a, b = (F.broadcast(vocabulary.select(F.col("token").alias(t), F.col("n").alias(f"n_{t}"))) for t in ("t1", "t2"))
    p = F.col("n") / F.lit(float(n_units))
    value = F.log(p / (F.col("n_t1") / F.lit(float(n_units)) * F.col("n_t2") / F.lit(float(n_units)))) / -F.log(p)
    return pairs.join(a, "t1").join(b, "t2").where(F.col("n") < n_units).withColumn("npmi", F.when(F.col("t1") == F.col("t2"), 1.0).otherwise(value)).where("npmi > 0").select("t1", "t2", "npmi")


def laplacian(edges: DataFrame) -> DataFrame:
    """t1, t2, value: entries of I - D^-1/2 A D^-1/2, both ways."""
    both = edges.unionByName(edges.where("t1 <> t2").select(F.col("t2").alias("t1"), F.col("t1").alias("t2"), "npmi"))
    degree = both.groupBy("t1").agg(F.sum("npmi").alias("d"))
    joined = both.join(degree, "t1").join(degree.select(F.col("t1").alias("t2"), F.col("d").alias("d2")), "t2")
    return joined.select("t1", "t2", (F.when(F.col("t1") == F.col("t2"), 1.0).otherwise(0.0) - F.col("npmi") / F.sqrt(F.col("d") * F.col("d2"))).alias("value"))


def clusters(edges: DataFrame, vocabulary: DataFrame, n_clusters: int, seed: int = 7) -> DataFrame:
    """token, cluster: k-means over the eigenvectors of least eigenvalue. The Laplacian is of the vocabulary's size (a stated bound, 2000 tokens) and is made and solved on the driver, from the edges worked out once."""
    import pyarrow as pa
    import pyarrow.compute as pc
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.linalg import Vectors

    spark = edges.sparkSession
    tokens = [r.token for r in vocabulary.orderBy(F.desc("n"), "token").collect()]
    at = {t: i for i, t in enumerate(tokens)}
    if len(tokens) <= n_clusters:
        return spark.createDataFrame([(t, i) for i, t in enumerate(tokens)], "token string, cluster int")
    near, found = np.zeros((len(tokens), len(tokens))), edges.toArrow()
    one, two = (pc.index_in(found.column(c), value_set=pa.array(tokens, found.schema.field(c).type)).to_numpy() for c in ("t1", "t2"))
    near[one, two] = near[two, one] = found.column("npmi").to_numpy()
    degree = near.sum(axis=1)
    degree[degree == 0] = 1
    matrix = np.eye(len(tokens)) - near / np.sqrt(np.outer(degree, degree))
    _, vectors = np.linalg.eigh((matrix + matrix.T) / 2)
    rows = spark.createDataFrame([(t, Vectors.dense(vectors[i, :n_clusters].tolist())) for t, i in at.items()], ["token", "features"])
    model = KMeans(k=n_clusters, seed=seed).fit(rows)
    return model.transform(rows).select("token", F.col("prediction").alias("cluster"))


def labels(clustered: DataFrame, vocabulary: DataFrame, mode: str = "text", k: int = 3) -> DataFrame:
    """key, type, tokens: the most frequent tokens of each cluster name it."""
    if mode not in ("text", "code"):
        raise ValueError(f"mode {mode!r} isn't text or code")
    rows = clustered.join(vocabulary, "token").groupBy("cluster").agg(F.slice(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "token"))), lambda x: x["token"]), 1, k).alias("tokens"))
    key = F.substring(F.concat(F.lit("cluster_"), F.col("cluster").cast("string"), F.lit("_"), F.array_join("tokens", "_")), 1, 50)
    return rows.select(key.alias("key"), F.lit("actor" if mode == "code" else "feature").alias("type"), "tokens")


def discover(units: DataFrame, unit: list[str], column: str, mode: str = "text", n_clusters: int = 50, most: int = 2000) -> dict[str, dict]:
    """Anchors of a vocabulary; for code with the built-in relations."""
    if mode not in ("text", "code"):
        raise ValueError(f"mode {mode!r} isn't text or code")
    tokens = unit_tokens(units, unit, column)
    n = tokens.select(*unit).distinct().count()
    if n < 50:
        warnings.warn(f"only {n} units: clusters may say little", stacklevel=2)
    vocabulary = frequent(tokens, most)
    edges = npmi(cooccurrence(tokens, unit, vocabulary), vocabulary, n)
    found = labels(clusters(edges, vocabulary, n_clusters), vocabulary, mode)
    out = {r.key: {"type": r.type, "tokens": list(r.tokens)} for r in found.collect()}
    built_in = {k: {"type": "relation", "tokens": list(t), "description": k} for k, t in CODE_RELATIONS} if mode == "code" else {}
    return out | built_in
