"""The shared folder, tables written there, and connected components."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Folders written by this process, deleted when it ends.
_written: list[tuple[SparkSession, str]] = []
#: With it, the shuffle files of a query go when it ends, and not when the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
REPO = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def prepare(spark: SparkSession) -> None:
    """Lets Python workers import this package wherever the driver found it; bounds Arrow batches and threads."""
    env = spark.sparkContext.environment
    if REPO not in env.get("PYTHONPATH", ""):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (REPO, env.get("PYTHONPATH", "")) if x)
    # the tasks are parallel already: a worker's matrix products take one core
    env.setdefault("OPENBLAS_NUM_THREADS", "1")
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) > 1000:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; one of our own is set only where it is unset and the master is local, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local"):
            raise RuntimeError(f"spark.checkpoint.dir must name a folder that all executors share (master {master})")
        found = "file://" + tempfile.mkdtemp(prefix="notewright-checkpoint-")
        spark.conf.set("spark.checkpoint.dir", found)
        spark.sparkContext.setCheckpointDir(found)
    return found


def fresh_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Writes a table to the shared folder and reads it again: it cuts the lineage, and outlives any executor.  The write's own shuffle files are deleted after it."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.select("*").write.parquet(path)  # a frame has the setting from when it is made
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def drop_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def written() -> int:
    """A mark for ``drop_since``."""
    return len(_written)


def drop_since(mark: int, keep: DataFrame | None = None) -> None:
    """Deletes the tables written since the mark, but for the one that ``keep`` reads."""
    kept = set(keep.inputFiles()) if keep is not None else set()
    for item in _written[mark:]:
        tail = "/" + item[1].rsplit("/", 1)[-1] + "/"
        if not any(tail in f for f in kept):
            drop_path(*item)
            _written.remove(item)


@atexit.register
def _clean() -> None:
    for spark, path in _written:
        try:
            if spark.sparkContext._jsc is not None and not spark.sparkContext._jsc.sc().isStopped():
                drop_path(spark, path)
        except Exception:  # noqa: BLE001 - the JVM may have gone first
            return


def components(edges: DataFrame, name: str) -> DataFrame:
    """Connected components of (a, b) with a != b: rows (node, component), component the smallest node.

    Large-star and small-star rounds: each round is two aggregations by key; no group is ever gathered
    in a list, and the edges are written to the shared folder after each round.
    """
    spark = edges.sparkSession
    now = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    now = materialise(now, name)
    before = None
    while True:
        both = now.unionAll(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        # large star: larger neighbours go to the least of the neighbourhood
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        # small star: a node and its smaller neighbours go to the least of these
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        nxt = small.unionAll(low.select("a", F.col("m").alias("b"))).distinct()
        nxt = materialise(nxt, name)
        mark = nxt.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        now = nxt
        if before is not None and tuple(mark) == before:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component"))
        before = tuple(mark)
