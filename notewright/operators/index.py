"""A stored inverted index that answers searches with one pruned read.

An index is a folder of segments.  A segment holds ``notes`` (numbered, with their lengths), ``postings`` (term, doc, tf, dl) in
folders by a hash of the term and sorted by term, ``terms`` (term, bucket, df), and ``totals``, written last: a segment without it
doesn't count, so that one broken off is made again.  New or changed notes are a further segment; ``dead`` names the numbers in older segments that
it replaces.  Frequencies come from the postings read, so they are those of the living notes.

A query's bare terms hold no white space, so a note contains one exactly if one of its tokens does: the vocabulary is
searched for tokens that contain a term, and only their postings are read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from . import search

BUCKETS, FEW = 64, 2000
#: Words of a task that sorts postings, so that a bucket of a large corpus is sorted by several.
SLICE = 1_000_000


class Index:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _exists(self, path: str) -> bool:
        found = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return found.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(found)

    def segments(self) -> int:
        n = 0
        while self._exists(f"{self.path}/{n}/totals/_SUCCESS"):
            n += 1
        return n

    def _read(self, kind: str, n: int | None = None) -> DataFrame:
        """A table of all segments, or of the first n, with their number as ``seg``."""
        out = None
        for i in range(self.segments() if n is None else n):
            rows = self.spark.read.parquet(f"{self.path}/{i}/{kind}").withColumn("seg", F.lit(i))
            out = rows if out is None else out.unionByName(rows)
        return out

    def add(self, notes: DataFrame) -> Index:
        """Adds notes (root_ord, rel, content), or replaces those of the same root and path; a null content takes a note away."""
        n = self.segments()
        base = f"{self.path}/{n}"
        rows = notes.select(F.monotonically_increasing_id().alias("doc"), "root_ord", "rel", "content", F.size(text.tokens("content")).cast("long").alias("dl"))
        rows.write.mode("overwrite").parquet(f"{base}/notes")
        rows = self.spark.read.parquet(f"{base}/notes")
        if n:
            older = self._read("notes", n).select("seg", "doc", "root_ord", "rel", "dl")
            dead = older.join(rows.select("root_ord", "rel").distinct(), ["root_ord", "rel"], "left_semi").select(F.col("seg").alias("old"), "doc", "dl")
        else:
            dead = self.spark.createDataFrame([], "old int, doc long, dl long")
        dead.write.mode("overwrite").parquet(f"{base}/dead")
        slices = 1 + (rows.agg(F.sum("dl")).first()[0] or 0) // (BUCKETS * SLICE)
        counted = rows.select("doc", "dl", F.explode(text.counted(text.tokens(F.lower("content")))).alias("x")).select("x.term", "doc", "x.tf", "dl")
        counted = counted.withColumn("bucket", F.pmod(F.hash("term"), F.lit(BUCKETS)))
        task = (F.col("bucket") * slices + F.pmod(F.hash("doc"), F.lit(slices))).cast("int")
        placed = counted.repartitionById(BUCKETS * slices, task).sortWithinPartitions("bucket", "term")
        placed.write.mode("overwrite").partitionBy("bucket").parquet(f"{base}/postings")
        stored = self.spark.read.schema("term string, doc long, tf long, dl long, bucket int").parquet(f"{base}/postings")
        stored.groupBy("term", "bucket").agg(F.count("*").alias("df")).write.mode("overwrite").parquet(f"{base}/terms")
        rows.where("content is not null").agg(F.count("*").alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("words")).write.mode("overwrite").parquet(f"{base}/totals")
        return self

    def _dead(self) -> DataFrame:
        """(seg, doc, dl), each once though several segments may replace it."""
        return self._read("dead").select(F.col("old").alias("seg"), "doc", "dl").distinct()

    def _living(self, rows: DataFrame) -> DataFrame:
        return rows.join(self._dead().select("seg", "doc"), ["seg", "doc"], "left_anti") if self.segments() > 1 else rows

    def notes(self) -> DataFrame:
        return self._living(self._read("notes")).where("content is not null").drop("seg", "doc", "dl")

    def totals(self) -> tuple[int, float]:
        """The number of living notes and their average length."""
        n, words = self._read("totals").agg(F.sum("n"), F.sum("words")).first()
        if self.segments() > 1:
            gone = self._dead().where("dl >= 0").join(self._read("notes").where("content is not null").select("seg", "doc"), ["seg", "doc"], "left_semi").agg(F.count("*"), F.coalesce(F.sum("dl"), F.lit(0))).first()
            n, words = n - gone[0], words - gone[1]
        return n, words / n if n else 0.0

    def postings(self, terms: list[str], asked: list[str]) -> DataFrame:
        """(seg, doc, term, tf, dl) of the tokens that contain one of ``terms`` or are one of ``asked``."""
        hit = F.col("term").isin(*asked)
        for t in terms:
            hit = hit | F.contains("term", F.lit(t))
        found = self._read("terms").where(hit).select("term", "bucket").distinct().limit(FEW + 1).collect()
        rows = self._read("postings")
        if len(found) <= FEW:
            rows = rows.where(F.col("bucket").isin(sorted({r.bucket for r in found})) & F.col("term").isin([r.term for r in found]))
        else:
            rows = rows.where(hit)  # a scan that no posting is shuffled for
        return self._living(rows)

    def document_frequency(self) -> DataFrame:
        """(term, df) of the living notes' tokens: of one segment as stored, of several from the postings."""
        if self.segments() == 1:
            return self._read("terms").select("term", "df")
        return self._living(self._read("postings")).groupBy("term").agg(F.count("*").alias("df"))

    def search(self, query: str, limit: int | None = search.LIMIT) -> DataFrame:
        """(root_ord, rel, score), as ``search.search`` over the living notes gives them."""
        asked, whole = query.lower().split(), query.lower()
        terms = text.bare_terms(query) or ([whole] if asked == [whole] else [])
        if not terms:  # nothing but white space and signs: a phrase that no token holds
            return search.search(self.notes(), query, limit)
        each = list(dict.fromkeys(asked))
        rows = self.postings(terms, each)
        df = {r[0]: r[1] for r in rows.where(F.col("term").isin(*each)).groupBy("term").count().collect()}
        n, average = self.totals()
        hit = F.lit(False)
        for t in terms:
            hit = hit | F.contains("term", F.lit(t))
        sums = [F.sum(F.when(F.col("term") == t, F.col("tf")).otherwise(0)).alias(f"tf{i}") for i, t in enumerate(each)]
        docs = rows.groupBy("seg", "doc").agg(F.first("dl").alias("dl"), F.max(hit).alias("hit"), *sums).where("hit")
        score = search.bm25(asked, {t: F.col(f"tf{i}") for i, t in enumerate(each)}, {t: df.get(t, 0) for t in each}, n, average or 1.0)
        names = self._read("notes").select("seg", "doc", "root_ord", "rel")
        return search.best(docs.select("seg", "doc", score.alias("score")).join(names, ["seg", "doc"]).select("root_ord", "rel", "score"), limit)
