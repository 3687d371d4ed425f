"""Streams over event facts. Each source is a folder of Parquet files; runs end when what is there has been read, or go on."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import facts
from ..sources.tables import event_facts


def event_stream(spark: SparkSession, path: str, files_per_batch: int = 1) -> DataFrame:
    """Event facts from a folder. Times without zone can't carry a watermark and are read as UTC."""
    schema = spark.read.parquet(path).schema
    return event_facts(spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path))


def run(stream: DataFrame, out: str, checkpoint: str, mode: str = "append") -> None:
    """Write all that is there to a folder."""
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start().awaitTermination()


def daily_counts(stream: DataFrame, delay: str = "1 hour") -> DataFrame:
    """day, predicate, n: tumbling windows; a day is given once the watermark has passed it."""
    windowed = stream.withWatermark("timestamp", delay).groupBy(F.window("timestamp", "1 day"), "predicate").count()
    return windowed.select(F.col("window.start").alias("day"), "predicate", F.col("count").alias("n"))


def sessions(stream: DataFrame, gap: str = "6 hours", delay: str = "1 hour") -> DataFrame:
    """subject, start, n: facts of a subject no further apart than the gap."""
    windowed = stream.withWatermark("timestamp", delay).groupBy(F.session_window("timestamp", gap), "subject").count()
    return windowed.select("subject", F.col("session_window.start").alias("start"), F.col("count").alias("n"))


def first_sightings(stream: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Facts without repeats of their arrival number within the watermark."""
    return stream.withWatermark("timestamp", delay).dropDuplicatesWithinWatermark(["seq"])


def upserts(stream: DataFrame, load: Callable[[], DataFrame | None], save: Callable[[DataFrame], None], checkpoint: str) -> None:
    """Fold each micro-batch into what is stored, as upsert_fold does at once."""

    def fold(batch: DataFrame, _: int) -> None:
        save(facts.upsert_fold(batch, load()))

    stream.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def last_seen_chains(stream: DataFrame, delay: str = "1 hour") -> DataFrame:
    """source, target, anchor: as facts of an anchor arrive, each is linked to the one seen last. State is one row for an anchor."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    anchored = stream.withWatermark("timestamp", delay).select("seq", "timestamp", F.explode(F.array_distinct(F.array("subject", "object"))).alias("anchor"))

    def link(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values(["timestamp", "seq"])
        seqs = ([state.get[0]] if state.exists else []) + rows["seq"].tolist()
        state.update((seqs[-1],))
        yield pd.DataFrame({"source": seqs[:-1], "target": seqs[1:], "anchor": [key[0]] * (len(seqs) - 1)})

    return anchored.groupBy("anchor").applyInPandasWithState(link, "source long, target long, anchor string", "last long", "append", GroupStateTimeout.NoTimeout)
