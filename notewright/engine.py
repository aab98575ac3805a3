"""The fourteen operations over a vault, as one object."""

from __future__ import annotations

import datetime
import json
import os
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import sinks
from .functions import text
from .operators import autolink, edges, graph, lint, search
from .operators.index import Index
from .plans.shared import fresh_path
from .sources import vault

#: Writes after which the folders are read again, so that the plan of the notes stays short.
REREAD = 16
_DERIVED = ("links_table", "adjacency", "_betweenness", "_pagerank", "_communities")


class Engine:
    """Analyses of a vault's notes; each is made once and kept until the notes change.  The search index is stored, and a write adds to it."""

    def __init__(self, spark: SparkSession, roots: list[str] | None = None, notes: DataFrame | None = None):
        self.spark, self.roots = spark, list(roots or [])
        self._given, self._writes = notes, 0
        text.register(spark)

    @cached_property
    def notes(self) -> DataFrame:
        return (self._given if self._given is not None else vault.load_vault(self.spark, self.roots)).persist()

    @cached_property
    def index(self) -> Index:
        return Index(self.spark, fresh_path(self.spark, "index")).add(self._indexed(self.notes))

    @staticmethod
    def _indexed(notes: DataFrame) -> DataFrame:
        return vault.first_root_wins(notes).select("root_ord", "rel", "content")

    @cached_property
    def links_table(self) -> DataFrame:
        return edges.links(self.notes).persist()

    @cached_property
    def adjacency(self) -> DataFrame:
        return edges.undirected(self.links_table).persist()

    @cached_property
    def _betweenness(self) -> DataFrame:
        return graph.betweenness(self.adjacency).persist()

    @cached_property
    def _pagerank(self) -> DataFrame:
        return graph.pagerank(self.notes, self.links_table).persist()

    @cached_property
    def _communities(self) -> DataFrame:
        return graph.communities(self.adjacency).persist()

    def _forget(self, *names: str) -> None:
        for name in names:
            held = self.__dict__.pop(name, None)
            if isinstance(held, DataFrame):
                held.unpersist()

    def refresh(self) -> None:
        """Reads the folders anew when next asked."""
        self._forget("notes", "index", *_DERIVED)

    @property
    def name(self) -> str:
        """The first root's folder."""
        return self.roots[0].rstrip("/").rsplit("/", 1)[-1] if self.roots else "wiki"

    def _stem(self, path: str) -> str:
        return os.path.splitext(vault.normalise_path(path).rsplit("/", 1)[-1])[0]

    def _row(self, path: str, *columns):
        """A note's row in the first root that has it."""
        row = vault.first_root_wins(self.notes.where(F.col("rel") == vault.normalise_path(path))).select(*columns).first()
        if row is None:
            raise FileNotFoundError(path)
        return row

    # the operations

    def search(self, query: str, limit: int = search.LIMIT) -> DataFrame:
        hits = self.index.search(query, limit)
        return search.with_snippets(hits, self.notes, query).select("rel", "snippet", "score").orderBy(F.desc("score"), "rel")

    def read(self, path: str) -> str:
        return self._row(path, "content")[0]

    def _linked(self, rel: str, content: str) -> tuple[str, list[str]]:
        """One text linked with the titles that it may mention, found by a join."""
        one = self.spark.createDataFrame([(rel, content)], "rel string, content string")
        row = autolink.suggest(one, edges.titles(self.notes), vault.stoplist(self.spark, self.roots)).first()
        return row["new_text"], list(row["added"])

    def write(self, path: str, content: str) -> list[str]:
        """Links titles, writes the file in the first root that has it, and returns the linked names; raw is refused."""
        rel = vault.normalise_path(path)
        if vault.is_immutable(rel):
            raise PermissionError(f"the raw layer is immutable: {rel}")
        new, added = self._linked(rel, content)
        place = next((i for i, r in enumerate(self.roots) if self._exists(f"{r}/{rel}")), 0)
        sinks.write_text(self.spark, f"{self.roots[place]}/{rel}", [new])
        self._writes += 1
        if not rel.endswith(".md"):
            return added
        changed = self.spark.createDataFrame([(place, rel, self._stem(rel), new, datetime.datetime.now())], vault.NOTES)
        if "index" in self.__dict__:
            self.index.add(changed.select("root_ord", "rel", "content"))
        if self._writes % REREAD:
            notes = sinks.upsert(self.notes, changed).persist()
            notes.count()
            self._forget("notes", *_DERIVED)
            self.__dict__["notes"] = notes
        else:
            self._forget("notes", *_DERIVED)
        return added

    def _exists(self, path: str) -> bool:
        found = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return found.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(found)

    def list(self, directory: str = "") -> list[str]:
        if not directory and len(self.roots) > 1:
            return list(self.roots)
        return [r[0] for r in vault.list_directory(self.notes, directory).collect()]

    def links(self, path: str) -> DataFrame:
        return edges.backlinks(self.links_table, self._stem(path))

    def metadata(self, path: str) -> str:
        return self._row(path, F.coalesce(text.frontmatter("content"), F.lit("(no frontmatter)")))[0]

    def suggest_links(self, path: str) -> list[str]:
        return self._linked(vault.normalise_path(path), self.read(path))[1]

    def stats(self) -> DataFrame:
        return edges.stats(self.notes, self.links_table)

    def lint(self) -> DataFrame:
        return lint.lint(self.notes)

    def traverse(self, start: str, depth: int = 2) -> DataFrame:
        return graph.traverse(self.notes, self.adjacency, start, depth)

    def shortest_path(self, start: str, end: str) -> list[str] | None:
        row = graph.shortest_path(self.adjacency, start, end).first()
        return row[0] if row else None

    def cluster(self) -> DataFrame:
        return graph.cluster(self._communities)

    def report(self, output: str | None = None, today: str | None = None) -> str:
        totals = edges.report_totals(self.notes, self.links_table).select("nodes", "edges", "orphans").first()
        hubs = graph.hubs(self.adjacency, self._betweenness, self._pagerank, 15).collect()
        bridges = graph.bridges(self.links_table, self._communities, self._betweenness, 10).collect()
        found = graph.cluster_heads(self._communities).collect()
        body = sinks.render_report(self.name, totals, hubs, found, bridges, today=today)
        self._out(output or "GRAPH_REPORT.md", [body])
        return body

    def visualize(self, output: str | None = None) -> str:
        """Writes the page, its nodes and links streamed a partition at a time, and returns its path."""
        hubs = graph.hubs(self.adjacency, self._betweenness, self._pagerank, 25)
        nodes = sinks.graph_nodes(edges.multi_degree(self.links_table), self._communities, hubs).persist()
        labels = {r[0]: r[1] for r in sinks.group_labels(nodes).collect()}
        rows = sinks.render_graph(nodes.orderBy("name").toLocalIterator(), self.links_table.select("src", "dst").toLocalIterator(), labels, self.name)
        return self._out(output or "GRAPH_VIZ.html", rows)

    def _out(self, rel: str, parts) -> str:
        rel = vault.normalise_path(rel)
        if vault.is_immutable(rel):
            raise PermissionError(f"the raw layer is immutable: {rel}")
        if self.roots:
            sinks.write_text(self.spark, f"{self.roots[0]}/{rel}", parts)
        return rel

    def json(self, operation: str, **given) -> str:
        """An operation's result as indented JSON, for clients that exchange text; what can't be done is a message."""
        try:
            return _as_json(self, operation, given)
        except (FileNotFoundError, PermissionError, ValueError) as wrong:
            return f"Error: {wrong}"


def _as_json(engine: Engine, operation: str, given: dict) -> str:
    shape = lambda x: json.dumps(x, ensure_ascii=False, indent=2)
    if operation in ("read", "metadata"):
        return getattr(engine, operation)(**given)
    if operation == "list":
        return "\n".join(engine.list(**given))
    if operation == "write":
        added = engine.write(**given)
        size = len(engine.read(given["path"]).encode()) if given["path"].endswith(".md") else len(given["content"].encode())
        return f"Written: {given['path']} ({size} bytes{', auto-linked: ' + ', '.join(added) if added else ''})"
    if operation == "search":
        return shape([{"path": r.rel, "snippet": r.snippet, "score": f"{r.score:.2f}"} for r in engine.search(**given).collect()])
    if operation == "links":
        rows = engine.links(**given).orderBy("direction", "name", "pos").collect()
        return shape({"path": given["path"], "outgoing": [r.name for r in rows if r.direction == "outgoing"], "backlinks": [r.name for r in rows if r.direction == "incoming"]})
    if operation == "suggest_links":
        return shape({"path": given["path"], "suggestions": engine.suggest_links(**given)})
    if operation == "stats":
        row = engine.stats().first().asDict()
        alone = [r.rel for r in edges.orphans(engine.notes, engine.links_table, "stats").select("rel").orderBy("rel").collect()]
        return shape({**row, "orphans": alone, "vaults": engine.roots})
    if operation == "traverse":
        rows = [r.asDict() for r in engine.traverse(**given).collect()]
        return shape(rows) if rows else f"No note named '{given['start']}' in the graph."
    if operation == "shortest_path":
        path = engine.shortest_path(**given)
        return shape({"path": path}) if path else f"No path between '{given['start']}' and '{given['end']}'."
    if operation == "cluster":
        rows = engine.cluster().collect()
        return shape({"communities": [r.asDict() for r in rows], "assignments": {m: r.id for r in rows for m in r.members}})
    if operation == "lint":
        out: dict[str, list] = {name: [] for name, _ in lint.RULES}
        for r in engine.lint().collect():
            out[r.rule].append({"page": r.page, "target": r.target} if r.rule == "broken_wikilinks" else r.page)
        return shape(out)
    if operation == "report":
        engine.report(**given)
        return f"Wrote graph report: {given.get('output') or 'GRAPH_REPORT.md'}"
    if operation == "visualize":
        return f"Wrote graph visualization: {engine.visualize(**given)}"
    raise ValueError(f"no operation named {operation!r}")
