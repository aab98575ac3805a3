"""What a note's text and path say, as column expressions: all JVM-side, usable on any string column."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: The link pattern, files that hold a vault's own rules, and names that are skipped (fixed values).
WIKILINK = r"\[\[([^\]|]+)(?:\|[^\]]+)?\]\]"
SCHEMA_FILES = ("index.md", "log.md", "AGENTS.md", "CLAUDE.md", "GRAPH_REPORT.md")
SKIPPED_NAMES = (".obsidian", ".trash", ".git", "node_modules")


def _col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def trimmed(x) -> Column:
    """Without Unicode white space at both ends."""
    return F.regexp_replace(_col(x), r"(?U)^\s+|\s+$", "")


def frontmatter(content) -> Column:
    """The text between a leading '---' line and the next line that starts with it; null if there is none."""
    c = _col(content)
    end = F.locate("\n---", c, 5)
    return F.when(F.startswith(c, F.lit("---\n")) & (end > 0), F.substring(c, F.lit(5), end - 5))


def aliases(content) -> Column:
    """The aliases line of the frontmatter: a bracketed list or one scalar."""
    lines = F.transform(F.split(F.coalesce(frontmatter(content), F.lit("")), "\n"), trimmed)
    rest = trimmed(F.substring(F.try_element_at(F.filter(lines, lambda x: F.startswith(x, F.lit("aliases:")) & (trimmed(F.substring(x, 9, 1 << 30)) != "")), F.lit(1)), 9, 1 << 30))
    inner = F.when(F.startswith(rest, F.lit("[")), F.split(F.regexp_replace(rest, r"^\[+|\]+$", ""), ",")).otherwise(F.array(rest))
    clean = F.transform(inner, lambda x: F.regexp_replace(F.regexp_replace(trimmed(x), '^"+|"+$', ""), "^'+|'+$", ""))
    return F.coalesce(F.filter(clean, lambda x: x != ""), F.array().cast("array<string>"))


def wikilinks(content) -> Column:
    """Link targets in order, duplicates kept."""
    found = F.regexp_extract_all(F.coalesce(_col(content), F.lit("")), F.lit(WIKILINK), F.lit(1))
    return F.filter(F.transform(found, trimmed), lambda x: x != "")


def tokens(content) -> Column:
    """Tokens between white space."""
    return F.filter(F.split(F.coalesce(_col(content), F.lit("")), r"(?U)\s+"), lambda x: x != "")


def counted(words: Column) -> Column:
    """Structs (term, tf) of an array's distinct words, counted within the row: equal ones are neighbours once sorted."""
    ordered = F.sort_array(words)
    begins = lambda s: F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)))
    one = lambda s, at: F.transform(at, lambda i, k: F.struct(F.get(s, i).alias("term"), (F.coalesce(F.get(at, k + 1), F.size(s)) - i).cast("long").alias("tf")))
    # a lambda's argument holds what is used several times, so that it is made once
    held = F.transform(F.array(ordered), lambda s: F.struct(s.alias("s"), F.when(F.size(s) > 0, begins(s)).otherwise(F.array().cast("array<int>")).alias("at")))
    return F.flatten(F.transform(held, lambda h: one(h["s"], h["at"])))


def bare_terms(query: str) -> list[str]:
    """Lower-case query terms without the signs at their ends; Python's notion of alphanumeric."""
    out = []
    for term in query.lower().split():
        a, b = 0, len(term)
        while a < b and not term[a].isalnum():
            a += 1
        while b > a and not term[b - 1].isalnum():
            b -= 1
        if a < b:
            out.append(term[a:b])
    return out


def stem(rel) -> Column:
    return F.regexp_extract(_col(rel), r"([^/]+?)(\.[^./]*)?$", 1)


def top_folder(rel) -> Column:
    return F.element_at(F.split(F.regexp_replace(F.replace(_col(rel), F.lit("\\"), F.lit("/")), "^/+", ""), "/"), 1)


def is_raw(rel) -> Column:
    """Within the immutable layer."""
    return F.lower(top_folder(rel)) == "raw"


def is_schema(rel) -> Column:
    return _col(rel).isin(*SCHEMA_FILES) | (F.lower(_col(rel)) == "readme.md")


def target_key(target) -> Column:
    """A link target as a note name: the last path segment without '.md'."""
    return F.regexp_replace(F.element_at(F.split(_col(target), "/"), -1), r"(\.md)+$", "")


def ascii_lower(x) -> Column:
    return F.translate(_col(x), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def snippet(content, query: str) -> Column:
    """80 characters around the query's first place, else the first 160."""
    c = _col(content)
    at = F.instr(F.lower(c), F.lit(query.lower())) if query else F.lit(1)
    begin = F.greatest(at - 80, F.lit(1))
    cut = F.when(at > 0, F.substring(c, begin, at + len(query) + 80 - begin)).otherwise(F.substring(c, 1, 160))
    return F.translate(cut, "\n", " ")


def register(spark: SparkSession) -> None:
    """wikilinks(text), aliases(text) and frontmatter(text) as SQL functions, without Python workers."""
    for name, make in (("wikilinks", wikilinks), ("aliases", aliases), ("frontmatter", frontmatter)):
        kind = "STRING" if name == "frontmatter" else "ARRAY<STRING>"
        body = _sql(make)
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(t STRING) RETURNS {kind} RETURN {body}")


def _sql(make) -> str:
    trim = "regexp_replace({}, '(?U)^\\\\s+|\\\\s+$', '')"
    front = "CASE WHEN startswith(t, '---\\n') AND locate('\\n---', t, 5) > 0 THEN substring(t, 5, locate('\\n---', t, 5) - 5) END"
    if make is frontmatter:
        return front
    if make is wikilinks:
        return f"filter(transform(regexp_extract_all(coalesce(t, ''), '\\\\[\\\\[([^\\\\]|]+)(?:\\\\|[^\\\\]]+)?\\\\]\\\\]', 1), x -> {trim.format('x')}), x -> x <> '')"
    line = f"try_element_at(filter(transform(split(coalesce({front}, ''), '\\n'), x -> {trim.format('x')}), x -> startswith(x, 'aliases:') AND {trim.format('substring(x, 9)')} <> ''), 1)"
    rest = trim.format(f"substring({line}, 9)")
    inner = f"CASE WHEN startswith({rest}, '[') THEN split(regexp_replace({rest}, '^\\\\[+|\\\\]+$', ''), ',') ELSE array({rest}) END"
    quotes = "regexp_replace(regexp_replace({}, '^\"+|\"+$', ''), '^\\'+|\\'+$', '')"
    return f"coalesce(filter(transform({inner}, x -> {quotes.format(trim.format('x'))}), x -> x <> ''), array())"
