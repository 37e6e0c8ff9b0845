"""Helpers shared by the training-data operators: shared storage, worker memory, row decisions, components."""

from __future__ import annotations

import gc
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterable, Iterator
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of the contracts, as a Java or Python character class.
WS = r"\x20\x09-\x0D"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir, which a cluster has to name.

    Only a session whose executors live in the driver's process may go without it, as in tests.
    """
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder is None:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="tessella-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder. Hadoop deletes what stands there when the driver ends."""
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder of the shared storage through Spark's own file system layer."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


class Scratch:
    """Tables of one run in the shared folder: dropped as soon as they were used, the last ones when the driver ends."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self.n = spark, fresh_path(spark, name), 0

    def keep(self, df: DataFrame) -> DataFrame:
        """The rows as a written table: computed once, read again after any executor's loss."""
        self.n += 1
        path = f"{self.root}/{self.n}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *frames: DataFrame) -> None:
        for df in frames:
            remove(self.spark, df._scratch_path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def is_empty(df: DataFrame) -> bool:
    return not df.take(1)


_HELD: dict[Any, Any] = {}
#: Seconds that an idle worker keeps its tables: longer than from one task to the next of a stage, shorter than a stage.
IDLE_S = 2.0
_LOCK = threading.Lock()
_TASKS = {"open": 0, "begun": 0}


def worker_table(key: Any, build: Callable[[], Any]) -> Any:
    """What a Python worker keeps for its next task: the tables of one operator, so those of another one make room."""
    if key not in _HELD:
        _HELD.clear()
        _HELD[key] = build()
    return _HELD[key]


def _give_back() -> None:
    """Hands freed memory to the system, as the worker lives on beside the next tasks and stages."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


def _expire(begun: int) -> None:
    """Drops the tables unless a task has begun since."""
    with _LOCK:
        if _TASKS["open"] or _TASKS["begun"] != begun:
            return
        _HELD.clear()
    gc.collect()
    _give_back()


def lean(parts: Iterable[Any]) -> Iterator[Any]:
    """The items; behind the last one the worker gives freed memory back, and its tables too if no task follows within IDLE_S."""
    with _LOCK:
        _TASKS["open"] += 1
        _TASKS["begun"] += 1
    try:
        yield from parts
    finally:
        with _LOCK:
            _TASKS["open"] -= 1
            later = threading.Timer(IDLE_S, _expire, [_TASKS["begun"]])
        later.daemon = True
        later.start()
        _give_back()


def slices(batch, rows: int = 256, most_bytes: int = 4 << 20) -> Iterator[Any]:
    """A batch in parts of a few rows and, beyond single long rows, few bytes."""
    if not batch.num_rows:
        return
    rows = max(1, min(rows, int(batch.num_rows * most_bytes / max(1, batch.nbytes))))
    for i in range(0, batch.num_rows, rows):
        yield batch.slice(i, rows)


def row_key(doc_id: Column, text: Column) -> Column:
    """128 bits that tell the rows of a table apart by doc_id and text, nulls included; equal rows share theirs."""
    return F.struct(F.xxhash64(doc_id, text).alias("x"), F.xxhash64(F.lit(11), doc_id, text).alias("y"))


def staying_rows(docs: DataFrame, verdicts: DataFrame) -> DataFrame:
    """The rows of docs whose verdict is kept, with all their columns.

    verdicts: (row_key, kept), a row for each of docs' rows. Of rows with equal doc_id and text either all stay or, as they are
    copies, one. Nearly all rows are only filtered; the others are few and are dealt out by their key.
    """
    scratch = Scratch(docs.sparkSession, "staying")
    names = [f"_{i}" for i in range(len(docs.columns))]
    at = dict(zip(docs.columns, names, strict=True))
    less = scratch.keep(verdicts.groupBy("row_key").agg(F.sum(F.col("kept").cast("int")).alias("stay"), F.count("*").alias("n")).where("stay < n"))
    plain = docs.toDF(*names).withColumn("row_key", row_key(F.col(at["doc_id"]).cast("long"), F.col(at["text"])))
    left = plain.join(less, "row_key", "left_anti")
    doubled = less.where("stay > 0")
    if not is_empty(doubled):
        left = left.unionByName(plain.join(doubled, "row_key", "left_semi").dropDuplicates(["row_key"]))
    return left.select(*names).toDF(*docs.columns)


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, component) for every node of edges(a, b): component is the smallest node reachable.

    Large-star and small-star in turn until every component is one star: rounds grow at most with the squared
    logarithm of the number of nodes, whatever the order of ids (Kiveris et al., 2014). Edges never grow in
    number, and every step is written to the shared folder. Smallest neighbours are combined before the shuffle and written,
    so that the joins with them shuffle both sides: a hub's rows then are a skewed partition that Spark splits.
    Nulls and self-links are ignored.
    """
    both = edges.where("a is not null and b is not null and a <> b")
    star = scratch.keep(both.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct())
    lowest = lambda e: scratch.keep(e.groupBy("hi").agg(F.min("lo").alias("m")))
    while not _are_stars(star):
        # Large-star: the larger neighbours of a node go to its smallest one.
        low = lowest(star)
        large = scratch.keep(star.join(low.withColumnRenamed("hi", "lo"), "lo", "left").select("hi", F.coalesce("m", "lo").alias("lo")).distinct())
        scratch.drop(star, low)
        # Small-star: the smaller ones and the node itself do.
        low = lowest(large)
        small = large.join(low, "hi").where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        star = scratch.keep(small.union(low.select("hi", "m")).distinct())
        scratch.drop(large, low)
    out = scratch.keep(star.select(F.col("hi").alias("node"), F.col("lo").alias("component")).union(star.select("lo", "lo").distinct()))
    scratch.drop(star)
    return out


def _are_stars(edges: DataFrame) -> bool:
    """Whether every hi has one lo, and no lo is a hi."""
    return is_empty(edges.groupBy("hi").count().where("count > 1")) and is_empty(edges.select("lo").distinct().intersect(edges.select("hi").distinct()))
