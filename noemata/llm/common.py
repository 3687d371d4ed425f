"""Helpers that the operators share: tables, checkpoints, Arrow text and column names."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The five columns of the documents table.
DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def bounded(spark: SparkSession, rows: int = 500) -> None:
    """Send fewer rows to Python at once than by default (10,000), as texts are long; unless the session has it otherwise already."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, rows)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir; where that is unset and all runs on one machine (as in tests), one of our own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    jsc = spark.sparkContext._jsc.sc()
    if not found and jsc.getCheckpointDir().isDefined():
        found = jsc.getCheckpointDir().get()
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="checkpoint-")
    if not jsc.getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(found)
    return found


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage by a reliable checkpoint: for small tables that several later steps read."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage by a Parquet table in the shared folder: for tables of which later steps read some columns."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/tables/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fold(column: str, n: int) -> F.Column:
    """crc32 of the number written as text, modulo n."""
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(n))


def texts(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """UTF-8 bytes of each text; null counts as empty."""
    return [x or b"" for x in batch.column(column).cast(pa.binary()).to_pylist()]


def flat(batch: pa.RecordBatch, column: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """All texts of a batch end to end as bytes, and where each begins (one more than the rows). Null counts as empty."""
    values = batch.column(column).cast(pa.large_binary()).fill_null(b"")
    if len(values) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(values.buffers()[1], np.int64)[values.offset : values.offset + len(values) + 1]
    data = values.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batch: pa.RecordBatch, most: int = 4 << 20, column: str = "text"):
    """The batch in row slices of at most so many text bytes each (or one row), so that work arrays stay bounded."""
    if len(batch) == 0:
        return
    sizes = np.diff(flat(batch, column)[1])
    start, held = 0, 0
    for i, n in enumerate(sizes):
        if i > start and held + n > most:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += int(n)
    yield batch.slice(start)


#: What operators remember from task to task, as Python workers are kept for later tasks and stages: by operator, a dictionary.
REMEMBERED: dict[str, dict] = {}


def remembered(operator: str) -> dict:
    return REMEMBERED.setdefault(operator, {})


def release(operator: str | None = None) -> None:
    """Give memory that a task no longer needs back to the system, also what other operators remember. Called when a task of an operator starts and when it ends."""
    for name, held in REMEMBERED.items():
        if name != operator:
            held.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def gathered(batches) -> pa.Table | None:
    """All rows of a task's partition; None without any."""
    held = [b for b in batches if len(b)]
    return pa.Table.from_batches(held) if held else None
