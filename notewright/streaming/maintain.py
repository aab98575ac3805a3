"""Notes that arrive as a stream are merged into a stored table, the newest of each rel winning.

A batch that runs again reads what was there before it and writes the same folder, so that a
restart after a failure loses nothing and counts nothing twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text

BUCKETS = 32
#: Characters of texts, stored and new, that a task of a merge takes.
SHARE = 64 << 20
SCHEMA = T.StructType([T.StructField("rel", T.StringType()), T.StructField("stem", T.StringType()), T.StructField("content", T.StringType()), T.StructField("version", T.LongType()), T.StructField("deleted", T.BooleanType())])


def newest(rows: DataFrame) -> DataFrame:
    order = Window.partitionBy("rel").orderBy(F.desc("version"), F.desc("content"))
    return rows.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def merge(stored: DataFrame, batch: DataFrame, parts: int | None = None) -> DataFrame:
    """Stored and new rows, the newest of each rel; tombstones stay, so that late older versions don't return.  parts: tasks, where the session's number is not to hold."""
    rows = stored.unionByName(batch)
    return newest(rows.repartition(parts, "rel") if parts else rows)


class Maintainer:
    """A table in BUCKETS buckets by a hash of rel.

    A batch writes new versions of the buckets that it touches, with their links and term counts, in a folder named by the batch; the others
    stay as they are.  The version before the last of each bucket is kept, for a batch that runs again, and older ones go.
    """

    def __init__(self, spark: SparkSession, table: str):
        self.spark, self.table = spark, table.rstrip("/")

    def _path(self, *parts: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path("/".join([self.table, *parts]))

    def _listed(self, *parts: str) -> list[str]:
        path = self._path(*parts)
        fs = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        return [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []

    def _versions(self, before: int | None = None) -> dict[int, list[int]]:
        """The batches that wrote each bucket, oldest first; a batch counts once its terms, written last, are whole."""
        out: dict[int, list[int]] = {}
        for v in sorted(int(n[1:]) for n in self._listed() if n.startswith("v")):
            if (before is None or v < before) and "_SUCCESS" in self._listed(f"v{v}", "terms"):
                for name in self._listed(f"v{v}", "rows"):
                    if name.startswith("bucket="):
                        out.setdefault(int(name[7:]), []).append(v)
        return out

    def _read(self, kind: str, schema, before: int | None = None, buckets=None) -> DataFrame:
        paths = [f"{self.table}/v{vs[-1]}/{kind}/bucket={k}" for k, vs in self._versions(before).items() if buckets is None or k in buckets]
        if kind != "rows":  # a bucket without a link or a term has no folder of them
            paths = [p for p in paths if p.rsplit("/", 1)[-1] in self._listed(p[len(self.table) + 1 :].rsplit("/", 1)[0])]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def rows(self, before: int | None = None, buckets=None) -> DataFrame:
        return self._read("rows", SCHEMA, before, buckets)

    def notes(self) -> DataFrame:
        return self.rows().where("not coalesce(deleted, false)").select("rel", "stem", "content")

    def links(self) -> DataFrame:
        return self._read("links", "src string, dst string, pos int")

    def document_frequency(self) -> DataFrame:
        """(term, df): the sum of the buckets' counts; no text is read."""
        return self._read("terms", "term string, df long").groupBy("term").agg(F.sum("df").alias("df"))

    def apply(self, batch: DataFrame, batch_id: int) -> None:
        placed = F.pmod(F.hash("rel"), F.lit(BUCKETS)).alias("bucket")
        batch = batch.select([f.name for f in SCHEMA])
        sizes = lambda rows: rows.groupBy(placed).agg(F.coalesce(F.sum(F.length("content")), F.lit(0))).collect()  # noqa: E731 - at most BUCKETS rows
        new = sizes(batch)
        touched = [r[0] for r in new]
        before = self.rows(batch_id, touched)
        parts = 1 + sum(r[1] for r in [*new, *sizes(before)]) // SHARE
        # a small merge is left to the session's partitions
        fixed = parts if parts > int(self.spark.conf.get("spark.sql.shuffle.partitions", "200")) else None
        base = f"{self.table}/v{batch_id}"
        merge(before, batch, fixed).select("*", placed).write.mode("overwrite").partitionBy("bucket").parquet(f"{base}/rows")
        stored = self.spark.read.schema(T.StructType([*SCHEMA, T.StructField("bucket", T.IntegerType())])).parquet(f"{base}/rows")
        living = stored.where("not coalesce(deleted, false)")
        found = living.select("bucket", F.col("stem").alias("src"), F.posexplode(text.wikilinks("content")).alias("pos", "dst"))
        found.select("src", "dst", "pos", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{base}/links")
        terms = living.select("bucket", F.explode(F.array_distinct(text.tokens(F.lower("content")))).alias("term"))
        terms.groupBy("bucket", "term").agg(F.count("*").alias("df")).write.mode("overwrite").partitionBy("bucket").parquet(f"{base}/terms")
        self._drop_old()

    def _drop_old(self) -> None:
        for bucket, versions in self._versions().items():
            for v in versions[:-2]:
                for kind in ("rows", "links", "terms"):
                    path = self._path(f"v{v}", kind, f"bucket={bucket}")
                    path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

    def start(self, stream: DataFrame, checkpoint: str):
        """stream: rows of SCHEMA."""
        return stream.writeStream.foreachBatch(self.apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
