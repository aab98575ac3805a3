"""The library's own operators as queries over whole tables, each with its DuckDB equivalent where SQL has one."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import autolink, edges, graph, lint, search
from ..operators.index import Index
from ..sources import vault
from . import corpora
from .shared import fresh_path, prepare

#: Characters of a file of the stream of documents.
BATCH_FILE = 64 << 20
QUERIES: dict = {}
ORACLE: dict[str, str] = {}
VAULT = f"WITH notes AS ({corpora.vault_sql(False)}), found AS (SELECT stem, rel, regexp_extract_all(content, '\\[\\[([^\\]|]+)(?:\\|[^\\]]+)?\\]\\]', 1) AS ls FROM notes), links AS (SELECT stem AS src, trim(x) AS dst FROM (SELECT stem, unnest(ls) AS x FROM found) WHERE trim(x) <> '')"
PAGES = f"WITH RECURSIVE links AS ({corpora.PAGE_LINKS_DUCK}), adj AS (SELECT src AS u, dst AS v FROM links UNION SELECT dst, src FROM links)"
RAW, SCHEMA = "lower(split_part(rel, '/', 1)) = 'raw'", "(rel IN ('index.md', 'log.md', 'AGENTS.md', 'CLAUDE.md', 'GRAPH_REPORT.md') OR lower(rel) = 'readme.md')"


def query(name: str, sql: str | None = None):
    def keep(f):
        def run(spark, sf_dir):
            prepare(spark)
            return f(spark, sf_dir)

        QUERIES[name] = run
        if sql:
            ORACLE[name] = sql
        return f

    return keep


def _rounded(df, *columns):
    return df.withColumns({c: F.round(c, 6) for c in columns})


def _search_sql(q: str, limit: int = 20) -> str:
    asked, terms = q.lower().split(), text.bare_terms(q)
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    hit = " OR ".join(f"contains(lc, {quote(t)})" for t in terms) or f"contains(lc, {quote(q.lower())})"
    tf = lambda t: f"len(list_filter(toks, lambda x: x = {quote(t)}))"
    score = " + ".join(f"ln((n - df{i} + 0.5) / (df{i} + 0.5) + 1.0) * {tf(t)} * 2.2 / ({tf(t)} + 1.2 * (0.25 + 0.75 * dl / avgdl))" for i, t in enumerate(asked)) or "0.0"
    dfs = "".join(f", sum(CASE WHEN list_contains(toks, {quote(t)}) THEN 1 ELSE 0 END) AS df{i}" for i, t in enumerate(asked))
    return f"""WITH notes AS ({corpora.DOCUMENTS}), t AS (SELECT rel, lower(content) AS lc, list_filter(regexp_split_to_array(lower(content), '\\s+'), lambda x: x <> '') AS toks FROM notes),
      d AS (SELECT *, len(toks) AS dl FROM t), s AS (SELECT CAST(count(*) AS DOUBLE) AS n, avg(dl) AS avgdl{dfs} FROM d)
      SELECT rel, round(score, 6) AS score FROM (SELECT rel, CAST({score} AS DOUBLE) AS score FROM d, s WHERE {hit}) ORDER BY round(score, 9) DESC, rel LIMIT {limit}"""


_indexes: dict[tuple, Index] = {}


def document_index(spark, sf_dir) -> Index:
    """The documents' index, made once for a session and folder, as an engine keeps it."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _indexes:
        _indexes[key] = Index(spark, fresh_path(spark, "document-index")).add(corpora.document_notes(spark, sf_dir))
    return _indexes[key]


def _search(q):
    return lambda spark, sf_dir: _rounded(document_index(spark, sf_dir).search(q).select("rel", "score"), "score")


@query("index_document_frequency", f"""WITH notes AS ({corpora.DOCUMENTS}), t AS (SELECT unnest(list_distinct(list_filter(regexp_split_to_array(lower(content), '\\s+'), lambda x: x <> ''))) AS term FROM notes)
  SELECT term, count(*) AS df FROM t GROUP BY term""")
def _index_terms(spark, d):
    """Builds the stored index, where the session hasn't, and counts its postings."""
    return document_index(spark, d).document_frequency()


@query("search_without_index", _search_sql("the idiot tionre"))
def _search_scan(spark, d):
    return _rounded(search.search(corpora.document_notes(spark, d), "the idiot tionre").select("rel", "score"), "score")


for _name, _q in {"search_bm25_top20": "the idiot tionre", "search_rare_term": "License, Apache", "search_punct_quirk": "the, (of)", "search_short_term": "zu", "search_empty_terms": "...", "search_repeated_term": "loser loser trash"}.items():
    query(_name, _search_sql(_q))(_search(_q))


@query("snippet", f"""WITH notes AS ({corpora.DOCUMENTS}), p AS (SELECT rel, content, strpos(lower(content), 'license') AS p0 FROM notes)
  SELECT rel, translate(CASE WHEN p0 > 0 THEN substring(content, greatest(p0 - 80, 1), p0 + 87 - greatest(p0 - 80, 1)) ELSE substring(content, 1, 160) END, chr(10), ' ') AS snippet FROM p""")
def _snippet(spark, d):
    return corpora.document_notes(spark, d).select("rel", text.snippet("content", "License").alias("snippet"))


@query("doc_stats", f"""WITH notes AS ({corpora.DOCUMENTS}), t AS (SELECT len(list_filter(regexp_split_to_array(content, '\\s+'), lambda x: x <> '')) AS dl FROM notes)
  SELECT count(*) AS docs, CAST(sum(dl) AS BIGINT) AS words, round(avg(dl), 6) AS average_length FROM t""")
def _doc_stats(spark, d):
    return _rounded(search.document_stats(corpora.document_notes(spark, d)), "average_length")


@query("doc_freq", f"""WITH notes AS ({corpora.DOCUMENTS}), t AS (SELECT unnest(list_distinct(list_filter(regexp_split_to_array(lower(content), '\\s+'), lambda x: x <> ''))) AS term FROM notes)
  SELECT term, count(*) AS df FROM t GROUP BY term""")
def _doc_freq(spark, d):
    return search.document_frequency(corpora.document_notes(spark, d))


@query("trigram_candidates", f"WITH notes AS ({corpora.DOCUMENTS}) SELECT rel FROM notes WHERE contains(lower(content), 'idiot')")
def _trigram(spark, d):
    notes = corpora.document_notes(spark, d)
    return search.indexed_candidates(search.trigrams(notes), notes, "idiot")


@query("wikilinks_extract", f"{VAULT} SELECT src, dst, count(*) AS n FROM links GROUP BY src, dst")
def _wikilinks(spark, d):
    return edges.links(corpora.vault_notes(spark, d)).groupBy("src", "dst").agg(F.count("*").alias("n"))


@query("titles_aliases", """WITH t AS (SELECT 'wiki/concepts/' || r_name || '.md' AS rel, r_name AS canonical, unnest(['Region ' || r_regionkey, lower(r_name)]) AS term FROM region
  UNION ALL SELECT 'wiki/concepts/' || n_name || '.md', n_name, 'Nation ' || n_nationkey FROM nation) SELECT term, canonical, rel FROM t""")
def _titles(spark, d):
    return edges.titles(corpora.vault_notes(spark, d)).where("term <> canonical")


@query("frontmatter", f"WITH notes AS ({corpora.vault_sql(False)}) SELECT rel, CASE WHEN starts_with(content, '---' || chr(10)) THEN regexp_extract(content, '^---\\n((?s:.*?))\\n---', 1) ELSE '(no frontmatter)' END AS frontmatter FROM notes")
def _frontmatter(spark, d):
    return corpora.vault_notes(spark, d).select("rel", F.coalesce(text.frontmatter("content"), F.lit("(no frontmatter)")).alias("frontmatter"))


@query("links_backlinks", f"{VAULT} SELECT 'outgoing' AS direction, dst AS name, count(*) AS n FROM links WHERE src = 'NATION_1' GROUP BY dst UNION ALL SELECT 'incoming', src, count(*) FROM links WHERE dst = 'NATION_1' GROUP BY src")
def _backlinks(spark, d):
    return edges.backlinks(edges.links(corpora.vault_notes(spark, d)), "NATION_1").groupBy("direction", "name").agg(F.count("*").alias("n"))


@query("undirected_edges", f"{VAULT} SELECT src AS u, dst AS v FROM links UNION SELECT dst, src FROM links")
def _undirected(spark, d):
    return edges.undirected(edges.links(corpora.vault_notes(spark, d)))


@query("simple_degree", f"WITH links AS ({corpora.PART_LINKS}), adj AS (SELECT src AS u, dst AS v FROM links UNION SELECT dst, src FROM links) SELECT u AS name, count(*) AS degree FROM adj GROUP BY u")
def _simple(spark, d):
    return edges.simple_degree(edges.undirected(corpora.run_sql(spark, d, corpora.PART_LINKS)))


@query("multi_degree", f"WITH links AS ({corpora.PART_LINKS}), b AS (SELECT src AS name, 1 AS o, 0 AS i FROM links UNION ALL SELECT dst, 0, 1 FROM links) SELECT name, CAST(sum(o) AS BIGINT) AS out_links, CAST(sum(i) AS BIGINT) AS in_links, CAST(sum(o) + sum(i) AS BIGINT) AS degree FROM b GROUP BY name")
def _multi(spark, d):
    return edges.multi_degree(corpora.run_sql(spark, d, corpora.PART_LINKS))


_ALONE = "stem NOT IN (SELECT src FROM links) AND stem NOT IN (SELECT dst FROM links)"
for _scope, _where in {"stats": f"NOT {RAW}", "lint": f"NOT {RAW} AND NOT {SCHEMA}", "report": "true"}.items():
    query(f"orphans_{_scope}", f"{VAULT} SELECT rel, stem FROM notes WHERE {_where} AND {_ALONE}")(lambda spark, d, scope=_scope: edges.orphans(n := corpora.vault_notes(spark, d), edges.links(n), scope))


@query("stats_overview", f"""{VAULT}, c AS (SELECT count(*) AS files, CAST(sum(len(list_filter(regexp_split_to_array(content, '\\s+'), lambda x: x <> ''))) AS BIGINT) AS words FROM notes)
  SELECT files, words, (SELECT count(*) FROM links) AS links, (SELECT count(*) FROM notes WHERE NOT {RAW} AND {_ALONE}) AS orphan_count FROM c""")
def _stats(spark, d):
    notes = corpora.vault_notes(spark, d)
    return edges.stats(notes, edges.links(notes))


@query("report_totals", f"""{VAULT} SELECT (SELECT count(*) FROM (SELECT stem FROM notes UNION SELECT src FROM links UNION SELECT dst FROM links)) AS nodes,
  (SELECT count(*) FROM (SELECT src FROM links UNION SELECT dst FROM links)) AS linked_nodes, (SELECT count(*) FROM links) AS edges, (SELECT count(*) FROM notes WHERE {_ALONE}) AS orphans""")
def _totals(spark, d):
    notes = corpora.vault_notes(spark, d)
    return edges.report_totals(notes, edges.links(notes))


_KEY = "regexp_replace(list_extract(string_split(target, '/'), -1), '(\\.md)+$', '')"
_RULES = {
    "orphans": f"SELECT 'orphans' AS rule, rel AS page, CAST(NULL AS VARCHAR) AS target FROM notes WHERE NOT {RAW} AND NOT {SCHEMA} AND {_ALONE}",
    "broken": f"SELECT 'broken_wikilinks' AS rule, rel AS page, target FROM (SELECT rel, trim(unnest(ls)) AS target FROM found WHERE NOT {RAW} AND NOT {SCHEMA}) WHERE target <> '' AND lower({_KEY}) NOT IN (SELECT lower(stem) FROM notes)",
    "index": "SELECT 'wiki_pages_missing_from_index' AS rule, rel AS page, CAST(NULL AS VARCHAR) AS target FROM notes, (SELECT content AS ix FROM notes WHERE rel = 'index.md') WHERE starts_with(rel, 'wiki/') AND NOT (contains(ix, rel) OR contains(ix, '[[' || stem || ']]') OR contains(ix, '[[' || stem || '|'))",
    "log": "SELECT 'pages_never_logged' AS rule, rel AS page, CAST(NULL AS VARCHAR) AS target FROM notes, (SELECT content AS lg FROM notes WHERE rel = 'log.md') WHERE starts_with(rel, 'wiki/') AND NOT (contains(lg, rel) OR contains(lg, stem))",
    "raw": f"SELECT 'raw_without_source_summary' AS rule, rel AS page, CAST(NULL AS VARCHAR) AS target FROM notes WHERE {RAW} AND lower(stem) NOT IN (SELECT lower(stem) FROM notes WHERE starts_with(rel, 'wiki/sources/'))",
}
for _rule, _f in {"orphans": lint.orphan_pages, "broken": lint.broken_links, "index": lint.missing_from_index, "log": lint.never_logged, "raw": lint.raw_without_summary}.items():
    query(f"lint_{_rule}", f"{VAULT} {_RULES[_rule]}")(lambda spark, d, f=_f: f(corpora.vault_notes(spark, d)))
query("lint_all", f"{VAULT} " + " UNION ALL ".join(_RULES.values()))(lambda spark, d: lint.lint(corpora.vault_notes(spark, d)))


@query("list_dir", f"WITH notes AS ({corpora.vault_sql(False)}) SELECT DISTINCT 'wiki/' || split_part(rel, '/', 2) || CASE WHEN len(string_split(rel, '/')) > 2 THEN '/' ELSE '' END AS entry FROM notes WHERE starts_with(rel, 'wiki/')")
def _list_dir(spark, d):
    return vault.list_directory(corpora.vault_notes(spark, d), "wiki")


@query("traverse_depth2", f"""{PAGES}, d AS (SELECT 'page 1' AS node, 0 AS distance UNION SELECT v, distance + 1 FROM d JOIN adj ON node = u WHERE distance < 2), m AS (SELECT node, min(distance) AS distance FROM d GROUP BY node)
  SELECT node AS note, CAST(distance AS INTEGER) AS distance, list_sort(list(v)) AS neighbors FROM m JOIN adj ON node = u GROUP BY node, distance""")
def _traverse(spark, d):
    return graph.traverse(corpora.page_notes(spark, d), edges.undirected(corpora.page_links(spark, d)), "page 1", 2)


@query("shortest_path", f"""{PAGES}, d AS (SELECT 'page 0' AS node, ['page 0'] AS path UNION ALL SELECT v, list_append(path, v) FROM d JOIN adj ON node = u WHERE len(path) < 5 AND NOT list_contains(path, v)),
  f AS (SELECT path FROM d WHERE node = 'page 48') SELECT min(path) AS path FROM f WHERE len(path) = (SELECT min(len(path)) FROM f)""")
def _shortest(spark, d):
    """One row, as the SQL's aggregate gives it: null without a path."""
    return graph.shortest_path(edges.undirected(corpora.page_links(spark, d)), "page 0", "page 48").agg(F.min("path").alias("path"))


_VADJ = VAULT.replace("WITH notes", "WITH RECURSIVE notes", 1) + ", adj AS (SELECT src AS u, dst AS v FROM links UNION SELECT dst, src FROM links)"


@query("components", f"{_VADJ}, r AS (SELECT u AS name, u AS reach FROM adj UNION SELECT name, v FROM r JOIN adj ON reach = u) SELECT name, min(reach) AS component FROM r GROUP BY name")
def _components(spark, d):
    return graph.components(edges.undirected(edges.links(corpora.vault_notes(spark, d))))


_BETWEEN = """b_names AS (SELECT name, row_number() OVER (ORDER BY name) - 1 AS k FROM (SELECT DISTINCT u AS name FROM adj)), b_step AS (SELECT count(*) AS n, greatest(count(*) // 100, 1) AS step FROM b_names),
  b_src AS (SELECT name AS s FROM b_names, b_step WHERE n <= 500 OR (k % step = 0 AND k < 100 * step)),
  b_walk AS (SELECT s, s AS node, 0 AS k FROM b_src UNION SELECT s, v, k + 1 FROM b_walk JOIN adj ON node = u WHERE k < 12), b_dist AS (SELECT s, node, min(k) AS k FROM b_walk GROUP BY s, node),
  b_paths AS (SELECT s, s AS node, 0 AS k, CAST(1 AS DOUBLE) AS p FROM b_src
    UNION ALL SELECT w.s, a.v, w.k + 1, sum(w.p) FROM b_paths w JOIN adj a ON w.node = a.u JOIN b_dist d ON d.s = w.s AND d.node = a.v AND d.k = w.k + 1 GROUP BY w.s, a.v, w.k),
  b_share AS (SELECT s, node, k, p, CAST(0 AS DOUBLE) AS x FROM b_paths WHERE k = (SELECT max(k) FROM b_paths)
    UNION ALL SELECT g.s, g.node, g.k, g.p, coalesce(sum(g.p / t.p * (1 + t.x)), 0) FROM (SELECT max(k) - 1 AS k FROM b_share) l JOIN b_paths g ON g.k = l.k
      LEFT JOIN adj a ON a.u = g.node LEFT JOIN b_share t ON t.s = g.s AND t.node = a.v AND t.k = g.k + 1 GROUP BY g.s, g.node, g.k, g.p),
  b_sums AS (SELECT node AS name, sum(x) AS x FROM b_share WHERE node <> s GROUP BY node),
  between_of AS (SELECT b_names.name, coalesce(x, 0) / max(coalesce(x, 0)) OVER () AS betweenness FROM b_names LEFT JOIN b_sums USING (name))"""
_RANK = """nodes AS (SELECT DISTINCT u AS name FROM adj UNION SELECT 'page ' || page_id FROM pages), w AS (SELECT src, dst, count(*) AS w FROM links GROUP BY src, dst),
  s AS (SELECT src, dst, w / sum(w) OVER (PARTITION BY src) AS share FROM w), n AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM nodes),
  r AS (SELECT name, 1.0 / n AS r, 0 AS i FROM nodes, n UNION ALL
    SELECT nodes.name, 0.15 / n.n + 0.85 * coalesce(g.g, 0), g0.i + 1 FROM nodes, n, (SELECT max(i) AS i FROM r) g0 LEFT JOIN (SELECT dst, sum(r.r * share) AS g FROM r JOIN s ON r.name = s.src GROUP BY dst) g ON g.dst = nodes.name WHERE g0.i < 50),
  rank_of AS (SELECT name, r / max(r) OVER () AS pagerank FROM r WHERE i = 50)"""


@query("pagerank_50", f"{PAGES}, {_RANK} SELECT name, round(pagerank, 6) AS pagerank FROM rank_of")
def _pagerank(spark, d):
    return _rounded(graph.pagerank(corpora.page_notes(spark, d), corpora.page_links(spark, d)), "pagerank")


def _adjacency(spark, d):
    return edges.undirected(corpora.page_links(spark, d)).persist()


@query("betweenness", f"{PAGES}, {_BETWEEN} SELECT name, round(betweenness, 6) AS betweenness FROM between_of")
def _between(spark, d):
    return _rounded(graph.betweenness(_adjacency(spark, d)), "betweenness")


@query("hub_nodes", f"""{PAGES}, {_BETWEEN}, {_RANK}, deg AS (SELECT u AS name, count(*) AS degree FROM adj GROUP BY u),
  h AS (SELECT name, 0.4 * degree / max(degree) OVER () + 0.3 * betweenness + 0.3 * pagerank AS score, degree, betweenness, pagerank FROM deg JOIN between_of USING (name) JOIN rank_of USING (name))
  SELECT name, round(score, 6) AS score, degree, round(betweenness, 6) AS betweenness, round(pagerank, 6) AS pagerank FROM h ORDER BY round(h.score, 9) DESC, name LIMIT 15""")
def _hubs(spark, d):
    adj = _adjacency(spark, d)
    return _rounded(graph.hubs(adj, graph.betweenness(adj), graph.pagerank(corpora.page_notes(spark, d), corpora.page_links(spark, d))), "score", "betweenness", "pagerank")


@query("communities")
def _communities(spark, d):
    return graph.communities(_adjacency(spark, d))


@query("cluster_sizes")
def _cluster(spark, d):
    return graph.cluster(graph.communities(_adjacency(spark, d)))


@query("bridges")
def _bridges(spark, d):
    adj = _adjacency(spark, d)
    return _rounded(graph.bridges(corpora.page_links(spark, d), graph.communities(adj), graph.betweenness(adj)), "score")


@query("autolink_suggest")
def _autolink(spark, d):
    talks = spark.read.parquet(f"{d}/conversations.parquet")
    notes = talks.select(F.concat(F.lit("wiki/sources/talk "), "conv_id", F.lit("-"), "turn", F.lit(".md")).alias("rel"), F.col("text").alias("content"))
    words = search.document_frequency(notes).where("df >= 5 and length(term) >= 5")
    titles = words.select("term", F.initcap("term").alias("canonical"), F.concat(F.lit("wiki/concepts/"), "term", F.lit(".md")).alias("rel"))
    return autolink.suggest(notes, titles, vault.STOPWORDS).select("rel", F.md5("new_text").alias("text_md5"), "added")


@query("stream_document_frequency", f"""WITH notes AS ({corpora.DOCUMENTS}), t AS (SELECT unnest(list_distinct(list_filter(regexp_split_to_array(lower(content), '\\s+'), lambda x: x <> ''))) AS term FROM notes)
  SELECT term, count(*) AS df FROM t GROUP BY term""")
def _stream(spark, d):
    """The documents arrive as a stream of files; the maintained table then gives the same frequencies."""
    from ..streaming import maintain

    base = fresh_path(spark, "stream")
    rows = corpora.document_notes(spark, d).select("rel", "stem", "content", F.lit(1).cast("long").alias("version"), F.lit(False).alias("deleted"))
    # three batches of as many files each as keep a task's share of the texts below BATCH_FILE characters
    each = 1 + (rows.agg(F.sum(F.length("content"))).first()[0] or 0) // (3 * BATCH_FILE)
    rows.repartition(3 * each).write.parquet(f"{base}/in")
    keeper = maintain.Maintainer(spark, f"{base}/table")
    stream = spark.readStream.schema(maintain.SCHEMA).option("maxFilesPerTrigger", each).parquet(f"{base}/in")
    keeper.start(stream, f"{base}/checkpoint").awaitTermination()
    return keeper.document_frequency()
