"""Links, titles, degrees and totals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text


def links(notes: DataFrame) -> DataFrame:
    """(src, dst, pos): one row for each occurrence of a link."""
    return notes.select(F.col("stem").alias("src"), F.posexplode(text.wikilinks("content")).alias("pos", "dst")).select("src", "dst", "pos")


def titles(notes: DataFrame) -> DataFrame:
    """(term, canonical, rel): a note's name and its aliases."""
    own = notes.select(F.col("stem").alias("term"), F.col("stem").alias("canonical"), "rel")
    return own.unionAll(notes.select(F.explode(text.aliases("content")).alias("term"), F.col("stem").alias("canonical"), "rel"))


def undirected(links: DataFrame) -> DataFrame:
    """(u, v): the simple graph in both directions, loops kept."""
    return links.select(F.explode(F.array(F.struct(F.col("src").alias("u"), F.col("dst").alias("v")), F.struct(F.col("dst").alias("u"), F.col("src").alias("v")))).alias("e")).select("e.u", "e.v").distinct()


def edge_list(adjacency: DataFrame) -> DataFrame:
    """(a, b) with a < b."""
    return adjacency.where("u < v").select(F.col("u").alias("a"), F.col("v").alias("b"))


def simple_degree(adjacency: DataFrame) -> DataFrame:
    return adjacency.groupBy(F.col("u").alias("name")).agg(F.count("*").alias("degree"))


def multi_degree(links: DataFrame) -> DataFrame:
    """(name, out_links, in_links, degree), each occurrence counted."""
    both = links.select(F.explode(F.array(F.struct(F.col("src").alias("name"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("dst").alias("name"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("x")).select("x.*")
    return both.groupBy("name").agg(F.sum("o").alias("out_links"), F.sum("i").alias("in_links")).withColumn("degree", F.col("out_links") + F.col("in_links"))


def backlinks(links: DataFrame, name: str) -> DataFrame:
    """(direction, name, pos) of one note, duplicates kept."""
    out = links.where(F.col("src") == name).select(F.lit("outgoing").alias("direction"), F.col("dst").alias("name"), "pos")
    return out.unionAll(links.where(F.col("dst") == name).select(F.lit("incoming").alias("direction"), F.col("src").alias("name"), "pos"))


def nodes(notes: DataFrame, links: DataFrame) -> DataFrame:
    return notes.select(F.col("stem").alias("name")).unionAll(links.select("src")).unionAll(links.select("dst")).distinct()


def orphans(notes: DataFrame, links: DataFrame, scope: str = "lint") -> DataFrame:
    """Notes that no link touches.  scope: 'stats' leaves out raw, 'lint' raw and schema files, 'report' none."""
    rows = notes if scope == "report" else notes.where(~text.is_raw("rel"))
    if scope == "lint":
        rows = rows.where(~text.is_schema("rel"))
    linked = links.select(F.explode(F.array("src", "dst")).alias("stem")).distinct()
    return rows.join(linked, "stem", "left_anti").select("rel", "stem")


def stats(notes: DataFrame, links: DataFrame) -> DataFrame:
    """(files, words, links, orphan_count): one row, from one pass and one anti-join."""
    counted = notes.agg(F.count("*").alias("files"), F.coalesce(F.sum(F.size(text.tokens("content"))), F.lit(0)).alias("words"), F.coalesce(F.sum(F.size(text.wikilinks("content"))), F.lit(0)).alias("links"))
    alone = orphans(notes, links, "stats").agg(F.count("*").alias("orphan_count"))
    return counted.withColumn("k", F.lit(1)).join(alone.withColumn("k", F.lit(1)), "k").drop("k")


def report_totals(notes: DataFrame, links: DataFrame) -> DataFrame:
    """(nodes, edges, orphans): every node that a link names counts, and raw and schema notes too."""
    k = F.lit(1).alias("k")
    n = nodes(notes.where("false"), links).agg(F.count("*").alias("linked_nodes"), F.first(F.lit(1)).alias("k0")).select(k, "linked_nodes")
    e = links.agg(F.count("*").alias("edges")).select(k, "edges")
    o = orphans(notes, links, "report").agg(F.count("*").alias("orphans")).select(k, "orphans")
    a = nodes(notes, links).agg(F.count("*").alias("nodes")).select(k, "nodes")
    return a.join(n, "k").join(e, "k").join(o, "k").drop("k")
