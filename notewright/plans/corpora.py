"""Notes made of the driver's tables by SQL that Spark and DuckDB both read."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = "region nation customer supplier part lineitem documents labels pages conversations benchmark".split()

#: Documents as raw notes.
DOCUMENTS = "SELECT 'raw/' || source || '/doc_' || doc_id || '.md' AS rel, 'doc_' || doc_id AS stem, text AS content FROM documents"

#: Regions, nations, customers and suppliers as linked pages with a catalogue and a log.
ENTITIES = """
SELECT 'wiki/concepts/' || r_name || '.md' AS rel, r_name AS stem,
  '---' || chr(10) || 'aliases: [Region ' || r_regionkey || ', "' || lower(r_name) || '"]' || chr(10) || '---' || chr(10) || 'A region.' AS content FROM region
UNION ALL SELECT 'wiki/concepts/' || n_name || '.md', n_name,
  '---' || chr(10) || 'title: x' || chr(10) || 'aliases: Nation ' || n_nationkey || chr(10) || '---' || chr(10) || 'In [[' || r_name || ']]; see [[ ' || n_name || ' |itself]] and [[' || r_name || '|the region]].'
  FROM nation JOIN region ON n_regionkey = r_regionkey
UNION ALL SELECT 'wiki/entities/' || c_name || '.md', c_name, 'Customer of [[' || n_name || ']], segment ' || c_mktsegment || '.' || CASE WHEN c_custkey % 10 = 0 THEN ' Not [[Missing ' || c_custkey % 7 || ']].' ELSE '' END
  FROM customer JOIN nation ON c_nationkey = n_nationkey
UNION ALL SELECT 'wiki/sources/' || s_name || '.md', s_name, 'Supplier from [[wiki/concepts/' || lower(n_name) || '.md|home]].' || CASE WHEN s_suppkey % 5 = 0 THEN ' Trades with [[' || n_name || ']].' ELSE '' END
  FROM supplier JOIN nation ON s_nationkey = n_nationkey
UNION ALL SELECT 'wiki/comparisons/lone ' || r_regionkey || '.md', 'lone ' || r_regionkey, 'no link here' FROM region
"""
INDEX = "SELECT 'index.md' AS rel, 'index' AS stem, 'Catalogue: ' || {join} AS content FROM nation WHERE n_nationkey < 15"
LOG = "SELECT 'log.md' AS rel, 'log' AS stem, 'Log: ' || {join} AS content FROM nation WHERE n_nationkey % 2 = 0"
SUMMARIES = "SELECT 'wiki/sources/DOC_' || doc_id || '.md' AS rel, 'DOC_' || doc_id AS stem, 'A summary.' AS content FROM (SELECT DISTINCT doc_id FROM labels) AS l"
_SPARK = {"index": "array_join(sort_array(collect_list('[[' || n_name || ']]')), ' ')", "log": "array_join(sort_array(collect_list(n_name)), ' ')"}
_DUCK = {"index": "string_agg('[[' || n_name || ']]', ' ' ORDER BY n_name)", "log": "string_agg(n_name, ' ' ORDER BY n_name)"}


def vault_sql(spark: bool) -> str:
    join = _SPARK if spark else _DUCK
    return f"{ENTITIES} UNION ALL {INDEX.format(join=join['index'])} UNION ALL {LOG.format(join=join['log'])} UNION ALL {SUMMARIES} UNION ALL {DOCUMENTS}"


#: The link graph of web pages: page to linked topic, each occurrence.
PAGE_LINKS_DUCK = "SELECT 'page ' || page_id AS src, unnest(regexp_extract_all(html, 'href=\"([^\"]+)\"', 1)) AS dst FROM pages"
PART_LINKS = "SELECT 'supplier ' || l_suppkey AS src, 'part ' || l_partkey AS dst FROM lineitem"


def run_sql(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    return spark.sql(re.sub(rf"\b(FROM|JOIN) ({'|'.join(TABLES)})\b", lambda m: f"{m[1]} parquet.`{sf_dir}/{m[2]}.parquet`", sql))


def vault_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_sql(spark, sf_dir, vault_sql(True)).withColumn("root_ord", F.lit(0))


def document_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_sql(spark, sf_dir, DOCUMENTS).withColumn("root_ord", F.lit(0))


def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    found = F.regexp_extract_all("html", F.lit('href="([^"]+)"'), F.lit(1))
    return pages.select(F.concat(F.lit("page "), F.col("page_id")).alias("src"), F.posexplode(found).alias("pos", "dst"))


def page_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return pages.select(F.lit(0).alias("root_ord"), F.concat(F.lit("wiki/sources/page "), F.col("page_id"), F.lit(".md")).alias("rel"), F.concat(F.lit("page "), F.col("page_id")).alias("stem"), F.lit("").alias("content"))
