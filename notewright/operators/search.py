"""Ranked full-text search: substring candidates, whole-token BM25."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text

K1, B, LIMIT = 1.2, 0.75, 20


def candidates(lower_content: Column, query: str) -> Column:
    """Texts that contain one of the terms without the signs at their ends, or the query itself if no term is left."""
    terms = text.bare_terms(query)
    if not terms:
        return F.contains(lower_content, F.lit(query.lower()))
    hit = F.lit(False)
    for t in dict.fromkeys(terms):
        hit = hit | F.contains(lower_content, F.lit(t))
    return hit


def document_stats(notes: DataFrame) -> DataFrame:
    """(docs, words, average_length)."""
    return notes.select(F.size(text.tokens("content")).alias("dl")).agg(F.count("*").alias("docs"), F.sum("dl").alias("words"), F.coalesce(F.avg("dl"), F.lit(0.0)).alias("average_length"))


def document_frequency(notes: DataFrame) -> DataFrame:
    """(term, df) of lower-case tokens."""
    return notes.select(F.explode(F.array_distinct(text.tokens(F.lower("content")))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))


def search(notes: DataFrame, query: str, limit: int | None = LIMIT) -> DataFrame:
    """(rel, score), and root_ord where the notes have it: best first, ties by rel.  Hits without a whole-token match have score 0.

    This way is for notes without an index (``operators.index``): one aggregation over the corpus gives its size, average length
    and the query tokens' document frequencies; one pass then scores candidates and keeps the best.
    """
    asked = query.lower().split()
    tokens = text.tokens(F.lower("content"))
    keys = note_keys(notes)
    rows = notes.select(*keys, F.lower("content").alias("lc"), tokens.alias("toks"), F.size(text.tokens("content")).alias("dl"))
    each = list(dict.fromkeys(asked))
    held = [F.sum(F.array_contains("toks", t).cast("int")).alias(f"df{i}") for i, t in enumerate(each)]
    total = rows.agg(F.count("*").alias("n"), F.avg("dl").alias("avg"), *held).first()
    tf = {t: F.size(F.filter("toks", lambda x: x == t)) for t in each}  # noqa: B023 - used at once
    score = bm25(asked, tf, {t: total[f"df{i}"] or 0 for i, t in enumerate(each)}, total["n"], total["avg"] or 1.0)
    return best(rows.where(candidates(F.col("lc"), query)).select(*keys, score.alias("score")), limit)


def note_keys(rows: DataFrame) -> list[str]:
    return [c for c in ("root_ord", "rel") if c in rows.columns]


def best(found: DataFrame, limit: int | None) -> DataFrame:
    """Scores that differ by less than 1e-9 are ties: they may be sums in another order."""
    return found.orderBy(F.desc(F.round("score", 9)), "rel", *note_keys(found)[:-1]).limit(limit) if limit is not None else found


def bm25(asked: list[str], tf: dict[str, Column], df: dict[str, int], n: int, average: float, length: str = "dl") -> Column:
    """The score of a note by the query's tokens, a repeated token counted each time."""
    score = F.lit(0.0)
    for t in asked:
        times = tf[t].cast("double")
        idf = F.log((F.lit(float(n - df[t])) + 0.5) / (F.lit(float(df[t])) + 0.5) + 1.0)
        score = score + idf * times * (K1 + 1) / (times + K1 * (1 - B + B * F.col(length) / F.lit(float(average))))
    return score


def with_snippets(hits: DataFrame, notes: DataFrame, query: str) -> DataFrame:
    """Contents are joined again only for the hits, by root and path."""
    keys = note_keys(hits)
    return hits.join(notes.select(*keys, "content"), keys).select(*keys, text.snippet("content", query).alias("snippet"), "score")


def trigrams(notes: DataFrame) -> DataFrame:
    """(tri, rel): an index of lower-case character trigrams, to be stored by tri."""
    found = F.regexp_extract_all(F.lower("content"), F.lit("(?s)(?=(.{3}))"), F.lit(1))
    return notes.select("rel", F.explode(F.array_distinct(found)).alias("tri")).select("tri", "rel")


def indexed_candidates(index: DataFrame, notes: DataFrame, term: str) -> DataFrame:
    """Notes that hold all trigrams of a term, verified: the same rows as a scan for the term."""
    term = term.lower()
    if len(term) < 3:
        return notes.where(F.contains(F.lower("content"), F.lit(term))).select("rel")
    asked = sorted({term[i : i + 3] for i in range(len(term) - 2)})
    near = index.where(F.col("tri").isin(asked)).groupBy("rel").agg(F.count("*").alias("n")).where(F.col("n") == len(asked))
    return notes.join(near, "rel", "left_semi").where(F.contains(F.lower("content"), F.lit(term))).select("rel")
