"""Helpers shared by the corpus operators."""

from __future__ import annotations

import ctypes
import sys
import types
import uuid
from collections.abc import Callable
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxlake.session import ensure_checkpoint_dir

# rows per Arrow batch: texts may be long, so batches are kept short
BATCH_ROWS = 512
BATCH_BYTES = 6 << 20
#: narrow rows that a task gets at least, if there are as many
TASK_ROWS = 1 << 15


def short_batches(spark: SparkSession) -> None:
    """Bound what one Arrow batch of texts holds, by rows and by bytes."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key, "10000")) > BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    short_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, tag: str) -> str:
    """A new folder name under the shared folder of ``spark.checkpoint.dir``."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{tag}-{uuid.uuid4().hex}"


def kept(df: DataFrame, tag: str, rows_per_file: int | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: later steps do not recompute it."""
    path = scratch(df.sparkSession, tag)
    writer = df.write.option("compression", "zstd")
    if rows_per_file:
        writer = writer.option("maxRecordsPerFile", rows_per_file)
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def in_few(df: DataFrame, rows: int, task_rows: int = TASK_ROWS) -> DataFrame:
    """``df``, of at most ``rows`` rows, in no more tasks than these need.

    Rounds over small tables would otherwise leave files and shuffle blocks of a few bytes for each
    shuffle partition, and these take whole disk blocks. Tasks grow with the rows; a table that has
    fewer partitions keeps them.
    """
    return df.coalesce(max(1, -(-rows // task_rows)))


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, each with underscores in front until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        out.append(name)
    return out


def whole(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def worker_state(kind: str, version: Any, build: Callable[[], Any]) -> Any:
    """What ``build`` gives, once per Python worker process and version, not once per task.

    Task functions travel by value, so module globals do not outlive a task; a module
    object registered with the interpreter does. Only the last one is held: the stages of a
    job follow one another in the same workers, and what an earlier stage needed is released.
    """
    holder = sys.modules.setdefault("_voxlake_worker", types.ModuleType("_voxlake_worker"))
    store = holder.__dict__.setdefault("store", {})
    if kind not in store or store[kind][0] != version:
        store.clear()
        give_back()
        store[kind] = (version, build())
    return store[kind][1]


def drop_state() -> None:
    """Release what earlier stages hold in this worker, for functions that hold nothing themselves."""
    store = getattr(sys.modules.get("_voxlake_worker"), "store", None)
    if store:
        store.clear()
        give_back()


def give_back() -> None:
    """Return what this process has freed to the system, where its allocators can.

    Python workers outlive a stage; blocks that one stage freed would otherwise stand beside those
    of the next.
    """
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # not every C library has one
    if trim:
        trim(0)


def lower_ascii(text: Column) -> Column:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(text, upper, upper.lower())
