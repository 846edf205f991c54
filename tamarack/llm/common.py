"""Helpers shared by the training-data operators: shared tables, words, connected components."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import time
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word of every contract: code points other than the six ASCII spaces.
WORD = r"[^\x20\x09-\x0D]+"


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share; a local one only where the session names none (tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = "file://" + tempfile.mkdtemp(prefix="tamarack-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def table(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.table_path = path
    return out


def drop_table(df: DataFrame) -> None:
    """Remove a table of table() that no later plan reads."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df.table_path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Let Spark remove shuffle files of finished jobs now, not when the driver next collects garbage.

    Twice, with a pause: what the first pass frees holds on to more, and the removal runs beside this thread.
    """
    for _ in range(2):
        gc.collect()
        spark._jvm.System.gc()
        time.sleep(0.3)


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of edges (u long, v long): rows (node, component), component the least node.

    Alternating large-star and small-star steps; every round is written to the shared folder. A hub's
    minimum is partially aggregated, and the join back to its links is one that AQE can split.
    Nodes without an edge are not returned. Nulls never link.
    """
    spent: list[DataFrame] = []

    def star(e: DataFrame, large: bool) -> DataFrame:
        both = e.unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else e
        # Written, so that both sides of the join are plain exchanges and a hub's links can be split.
        least = table(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "cc")
        spent.append(least)
        j = both.join(least, "u")
        if large:
            out = j.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        else:
            out = j.select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x")).select("x.*")
        return out.where("u <> v").distinct()

    cur = table(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "cc")
    seen = None
    for _ in range(max_rounds):
        sign = cur.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v") % F.lit(1 << 40)).alias("s")).first()
        if not sign["n"] or (sign["n"], sign["s"]) == seen:
            break
        seen = (sign["n"], sign["s"])
        nxt = table(star(star(cur, True), False), "cc")
        for old in (cur, *spent):
            drop_table(old)
        spent.clear()
        cur = nxt
    else:
        raise RuntimeError("components did not settle")
    roots = cur.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return cur.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(roots)


def trim_memory() -> None:
    """Give freed memory of this Python process back: Arrow's pool, then the C library's heap."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def tidy(run, rows: int | None = None):
    """A mapInArrow function whose worker, kept for later tasks, gives its memory back at the end of a task.

    rows: batches are cut into slices of so many rows, so that few texts are Python objects at a time.
    """

    def wrapped(batches):
        try:
            yield from run(slices(batches, rows) if rows else batches)
        finally:
            trim_memory()

    return wrapped


def slices(batches, rows: int):
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)
