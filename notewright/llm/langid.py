"""Language identification, words first.

A word that the training texts have is scored by its log frequency in each language; an unseen word by the
character n-grams of its letters, four at a time, or three, two, one where none of the longer ones is known.
The model is fitted on at most SAMPLE labelled documents (those of the least hashes of doc_id, which isn't null), whole texts; it doesn't grow beyond that sample.

A null text, or one without a letter, is ``und`` with score 0.  With no labelled row every text is ``und``.  The score is
the softmax over languages of the mean log probability a word, times the square root of the number of words.  Equal
scores go to the first language in order.  Rows: one for each input row, repeated ones and null ids included.
"""

from __future__ import annotations

import pickle
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

SAMPLE, LONGEST, CACHE = 4000, 4, 50_000
LETTERS = re.compile(r"[^\W\d_]+")


def words_of(text: str) -> list[str]:
    """Runs of letters (Unicode categories L); number signs such as the Roman twelve or a half, which the pattern takes too, part them."""
    found = LETTERS.findall(text.lower())
    if all(map(str.isalpha, found)):
        return found
    return [w for x in found for w in (x if x.isalpha() else "".join(c if c.isalpha() else " " for c in x)).split()]


def grams(word: str, n: int) -> list[str]:
    padded = f" {word} " if n > 1 else word
    return [padded[i : i + n] for i in range(len(padded) - n + 1)]


def _counting(batches):
    """(lang, size, key, n): words have size 0, n-grams their length."""
    held: dict[str, Counter] = {}
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            held.setdefault(lang, Counter()).update(words_of(text))
    for lang, words in held.items():
        tables = [words, *(Counter() for _ in range(LONGEST))]
        for w, n in words.items():
            for size in range(1, LONGEST + 1):
                table = tables[size]
                for g in grams(w, size):
                    table[g] += n
        for size, table in enumerate(tables):
            if table:
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(table)), pa.array([size] * len(table), pa.int32()), pa.array(list(table)), pa.array(list(table.values()), pa.int64())], ["lang", "size", "key", "n"])


def sample_of(rows: DataFrame, most: int, id_col: str = "doc_id") -> DataFrame:
    """At most ``most`` rows, those of the least hashes of their id; rows without an id aren't taken.  Of equal hashes at the edge, any."""
    mark = F.xxhash64(F.col(id_col), F.lit(11))
    rows = rows.where(F.col(id_col).isNotNull())
    least = [r[0] for r in rows.select(mark.alias("h")).orderBy("h").limit(most).collect()]
    if len(least) < most:
        return rows
    return rows.where(mark < least[-1]).unionAll(rows.where(mark == least[-1]).limit(least.count(least[-1])))


class Model:
    """Log frequencies a language of words (size 0) and of n-grams of one to LONGEST letters.

    counts: an Arrow table (lang, size, key, n) with one row for each lang, size and key.
    """

    def __init__(self, counts: pa.Table):
        self.langs = sorted(set(counts.column("lang").to_pylist()))
        tables = [self._logs(counts.filter(pc.equal(counts.column("size"), size)), self.langs) for size in range(LONGEST + 1)]
        self.words, self.grams = tables[0], tables
        self.cache: dict[str, np.ndarray] = {}

    @staticmethod
    def _logs(rows: pa.Table, langs: list[str]):
        keys = rows.column("key").combine_chunks().dictionary_encode()
        if isinstance(keys, pa.ChunkedArray):
            keys = keys.chunk(0) if keys.num_chunks else pa.array([], pa.string()).dictionary_encode()
        names = keys.dictionary.to_pylist()
        table = np.zeros((len(names), len(langs)))
        at = pc.index_in(rows.column("lang"), pa.array(langs, pa.string())).to_numpy()
        table[keys.indices.to_numpy(), at] = rows.column("n").to_numpy()
        logs = np.log((table + 0.1) / (table.sum(0) + 0.1 * (len(names) + 1))).astype(np.float32)
        return {x: i for i, x in enumerate(names)}, logs

    def unseen(self, word: str) -> np.ndarray:
        for n in range(min(LONGEST, len(word) + 2), 0, -1):
            index, logs = self.grams[n]
            found = [i for g in grams(word, n) if (i := index.get(g)) is not None]
            if found:
                return logs[found].mean(0)
        return np.zeros(len(self.langs), np.float32)

    def predict(self, text: str | None) -> tuple[str, float]:
        found = Counter(words_of(text)) if text else None
        if not found or not self.langs:
            return "und", 0.0
        get, cache = self.words[0].get, self.cache
        total = np.zeros(len(self.langs))
        known, times, n_words = [], [], 0
        for w, n in found.items():
            n_words += n
            i = get(w)
            if i is not None:
                known.append(i)
                times.append(n)
            else:
                v = cache.get(w)
                if v is None:
                    if len(cache) > CACHE:
                        cache.clear()
                    v = cache[w] = self.unseen(w)
                total += n * v
        if known:
            total += np.array(times) @ self.words[1][known]
        x = total / n_words * n_words**0.5
        p = np.exp(x - x.max())
        best = int(x.argmax())
        return self.langs[best], float(p[best] / p.sum())


def _predicting(model, kept: int, names: tuple[str, str]):
    def run(batches):
        own = common.worker_held(("langid", model.id), lambda: pickle.loads(model.value))
        for batch in batches:
            got = [own.predict(x.as_py()) for x in batch.column(kept)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:kept], pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], [*batch.schema.names[:kept], *names])

    return run


class Handle:
    """A broadcast with a name that workers keep their copy of the model by."""

    def __init__(self, spark, value: bytes):
        import hashlib

        self.id, self.held = hashlib.sha1(value).hexdigest(), spark.sparkContext.broadcast(value)

    @property
    def value(self):
        return self.held.value


def fit(docs: DataFrame, most: int = SAMPLE) -> Model:
    """docs: training rows (doc_id, text, lang)."""
    common.prepare(docs.sparkSession)
    rows = sample_of(docs.where("lang is not null and text is not null"), most).select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    counts = rows.mapInArrow(_counting, "lang string, size int, key string, n long").groupBy("lang", "size", "key").agg(F.sum("n").alias("n")).toArrow()
    return Model(counts)


def annotate(docs: DataFrame, train: DataFrame | None = None, fold: int = 5, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """The rows with their language and score in columns of these names, which the table doesn't have."""
    spark = docs.sparkSession
    common.prepare(spark)
    common.must_be_free(docs, names)
    held_out = F.coalesce(common.remainder("doc_id", fold) == 0, F.lit(False))
    model = Handle(spark, pickle.dumps(fit((docs if train is None else train).where(~held_out))))
    rows = docs.withColumn(common.free_name(docs, "scored_text"), F.col("text").cast("string"))
    schema = docs.withColumn(names[0], F.lit("")).withColumn(names[1], F.lit(0.0)).schema
    return rows.mapInArrow(_predicting(model, len(docs.columns), names), schema)


def identify(docs: DataFrame, train: DataFrame | None = None, fold: int = 5) -> DataFrame:
    """(doc_id, held_out, lang_pred, score).  It learns from ``train`` (default: docs) where crc32(doc_id) mod ``fold`` isn't 0."""
    held_out = F.coalesce(common.remainder("doc_id", fold) == 0, F.lit(False))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out.alias("held_out"), F.col("text").cast("string").alias("text"))
    return annotate(own, docs if train is None else train, fold).select("doc_id", "held_out", "lang_pred", "score")
