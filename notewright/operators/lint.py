"""Structural checks as anti-joins: rows (rule, page, target)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from .edges import links as links_of
from .edges import orphans

#: Characters of a catalogue or log that go to the tasks at once.
PIECE = 8_000_000


def _rows(rows: DataFrame, rule: str, target: Column | None = None) -> DataFrame:
    return rows.select(F.lit(rule).alias("rule"), F.col("rel").alias("page"), (F.lit(None).cast("string") if target is None else target).alias("target"))


def orphan_pages(notes: DataFrame, links: DataFrame | None = None) -> DataFrame:
    return _rows(orphans(notes, links_of(notes) if links is None else links, "lint"), "orphans")


def broken_links(notes: DataFrame) -> DataFrame:
    """A row for each occurrence; note names are compared without regard to ASCII case."""
    pages = notes.where(~text.is_raw("rel") & ~text.is_schema("rel")).select("rel", F.explode(text.wikilinks("content")).alias("target"))
    stems = notes.select(text.ascii_lower("stem").alias("key")).distinct()
    return _rows(pages.withColumn("key", text.ascii_lower(text.target_key("target"))).join(stems, "key", "left_anti"), "broken_wikilinks", F.col("target"))


def _body(notes: DataFrame, rel: str) -> str:
    """One file's text; a vault has one catalogue and one log."""
    row = notes.where(F.col("rel") == rel).orderBy("root_ord").select("content").first()
    return (row[0] or "") if row else ""


def unmentioned(pages: DataFrame, body: str, names: list[Column], longest: int | None = None) -> DataFrame:
    """The pages (rel, ...) none of whose names stands in a text.

    The text is read once for many pages: a task takes its pages' names together and finds them all in one pass
    (Aho-Corasick).  The text goes out in pieces of PIECE characters that overlap by the longest name, so what is sent at once is bounded.
    """
    spark = pages.sparkSession
    rows = pages.select(F.col("rel"), F.filter(F.array(*names), lambda x: x.isNotNull() & (x != "")).alias("names"))
    if len(body) > PIECE and longest is None:
        longest = rows.agg(F.max(F.array_max(F.transform("names", F.length)))).first()[0] or 0
    found = None
    for start in range(0, max(len(body), 1), PIECE):
        piece = spark.sparkContext.broadcast(body[start : start + PIECE + (longest or 0)])

        def run(batches, piece=piece):
            import ahocorasick

            for pdf in batches:
                machine, owners = ahocorasick.Automaton(), {}
                for i, ns in enumerate(pdf["names"]):
                    for n in ns:
                        owners.setdefault(n, []).append(i)
                for n in owners:
                    machine.add_word(n, n)
                met: set[int] = set()
                if owners:
                    machine.make_automaton()
                    seen = {n for _, n in machine.iter(piece.value)}
                    met.update(i for n in seen for i in owners[n])
                yield pdf.loc[sorted(met), ["rel"]]

        part = rows.mapInPandas(run, "rel string")
        found = part if found is None else found.unionAll(part)
    return pages.join(found, "rel", "left_anti")


def _wiki(notes: DataFrame) -> DataFrame:
    return notes.where(F.startswith("rel", F.lit("wiki/"))).select("rel", "stem")


def missing_from_index(notes: DataFrame) -> DataFrame:
    names = [F.col("rel"), F.concat(F.lit("[["), "stem", F.lit("]]")), F.concat(F.lit("[["), "stem", F.lit("|"))]
    return _rows(unmentioned(_wiki(notes), _body(notes, "index.md"), names), "wiki_pages_missing_from_index")


def never_logged(notes: DataFrame) -> DataFrame:
    return _rows(unmentioned(_wiki(notes), _body(notes, "log.md"), [F.col("rel"), F.col("stem")]), "pages_never_logged")


def raw_without_summary(notes: DataFrame) -> DataFrame:
    summaries = notes.where(F.startswith("rel", F.lit("wiki/sources/"))).select(F.lower("stem").alias("key")).distinct()
    raw = notes.where(text.is_raw("rel") & F.endswith("rel", F.lit(".md"))).withColumn("key", F.lower("stem"))
    return _rows(raw.join(summaries, "key", "left_anti"), "raw_without_source_summary")


RULES = (("orphans", orphan_pages), ("broken_wikilinks", broken_links), ("wiki_pages_missing_from_index", missing_from_index), ("raw_without_source_summary", raw_without_summary), ("pages_never_logged", never_logged))


def lint(notes: DataFrame) -> DataFrame:
    """All rules' rows, by rule in the order of RULES, then by page and target."""
    out = None
    for i, (_, rule) in enumerate(RULES):
        rows = rule(notes).withColumn("_rule", F.lit(i))
        out = rows if out is None else out.unionAll(rows)
    return out.orderBy("_rule", "page", "target").drop("_rule")
