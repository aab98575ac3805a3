"""Notes from folders of markdown: whole files as rows, earlier roots before later ones."""

from __future__ import annotations

import os
import re
from urllib.parse import urlparse

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text

NOTES = T.StructType([T.StructField("root_ord", T.IntegerType()), T.StructField("rel", T.StringType()), T.StructField("stem", T.StringType()), T.StructField("content", T.StringType()), T.StructField("mtime", T.TimestampType())])
#: Words that aren't linked by default (fixed values).
STOPWORDS = ("index", "readme", "agents", "claude", "log", "skill", "changelog")
IGNORE_FILE, STOPLIST_FILE = ".notewrightignore", ".notewrightstoplist"


def resolve_roots(args: list[str] | None = None, env=os.environ) -> list[str]:
    """Arguments, else NOTEWRIGHT_VAULTS (colons between), else NOTEWRIGHT_VAULT."""
    if args:
        return list(args)
    many = [x for x in env.get("NOTEWRIGHT_VAULTS", "").split(":") if x]
    return many or [x for x in (env.get("NOTEWRIGHT_VAULT"),) if x]


def normalise_path(path: str) -> str:
    """A relative path within a vault; '.' segments go, absolute paths and '..' are refused."""
    path = path.strip().replace("\\", "/")
    if not path or path.startswith("/"):
        raise ValueError(f"not a path within the vault: {path!r}")
    parts = [p for p in path.split("/") if p not in ("", ".")]
    if ".." in parts or not parts:
        raise ValueError(f"not a path within the vault: {path!r}")
    return "/".join(parts)


def is_immutable(path: str) -> bool:
    """Whether a path, normalised before, is in the raw layer."""
    return normalise_path(path.lstrip("/ ")).split("/")[0].lower() == "raw"


def glob_regex(pattern: str) -> str:
    """A gitignore glob, without its marks at the ends, as a regular expression that Java reads."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        if pattern.startswith("**/", i) and (i == 0 or pattern[i - 1] == "/"):
            out, i = out + "(?:[^/]+/)*", i + 3
        elif pattern[i:] == "**" and (i == 0 or pattern[i - 1] == "/"):
            out, i = out + ".+", i + 2
        elif c == "*":
            out, i = out + "[^/]*", i + 1
        elif c == "?":
            out, i = out + "[^/]", i + 1
        elif c == "[" and "]" in pattern[i + 2 :]:
            end = pattern.index("]", i + 2)
            body = pattern[i + 1 : end].replace("\\", "\\\\").replace("[", "\\[").replace("&", "\\&")
            out, i = out + f"(?!/)[{'^' + body[1:] if body[0] in '!^' else body}]", end + 1
        else:
            if c == "\\" and i + 1 < len(pattern):
                i += 1
            out, i = out + re.escape(pattern[i]), i + 1
    return out


def ignore_rules(lines: list[str]) -> list[tuple[str, bool, bool]]:
    """(regular expression of a whole path, whether it keeps, whether it means folders alone) of the lines of an ignore file."""
    rules = []
    for line in lines:
        while line.endswith(" ") and not line.endswith("\\ "):
            line = line[:-1]
        if not line or line.startswith("#"):
            continue
        keep = line.startswith("!")
        line = line[1:] if keep else line
        folder = line.endswith("/")
        line = line[:-1] if folder else line
        anchored = "/" in line
        line = line.removeprefix("/")
        if line:
            rules.append(("^" + ("" if anchored else "(?:.*/)?") + glob_regex(line) + "$", keep, folder))
    return rules


def ignore_condition(lines: list[str] | None, rel: Column) -> Column:
    """Rows to keep.  The lines of an ignore file replace the default names to skip; of the rules that fit a path the last
    decides, and nothing below an ignored folder is kept."""
    segments = F.split(rel, "/")
    hidden = F.exists(segments, lambda p: F.startswith(p, F.lit(".")))
    if lines is None:
        return ~(hidden | F.exists(segments, lambda p: p.isin(*text.SKIPPED_NAMES)))
    rules = ignore_rules(lines)

    def ignored(n: Column) -> Column:
        path, is_folder, drop = F.array_join(F.slice(segments, F.lit(1), n), "/"), n < F.size(segments), F.lit(False)
        for regex, keep, folder in rules:
            hit = path.rlike(regex) & is_folder if folder else path.rlike(regex)
            drop = F.when(hit, F.lit(not keep)).otherwise(drop)
        return drop

    return ~(hidden | F.exists(F.sequence(F.lit(1), F.size(segments)), ignored))


def _lines(spark: SparkSession, root: str, name: str) -> list[str] | None:
    """The lines of a small file of settings, or None.  Spark's readers pass over names that begin with a dot."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(root, name)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return None
    stream = fs.open(path)
    try:
        return jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8").splitlines()
    finally:
        stream.close()


def stoplist(spark: SparkSession, roots: list[str]) -> list[str]:
    """The default words and each root's own, in lower case."""
    return sorted({*STOPWORDS, *(x.strip().lower() for root in roots for x in _lines(spark, root, STOPLIST_FILE) or () if x.strip() and not x.strip().startswith("#"))})


def load_vault(spark: SparkSession, roots: list[str]) -> DataFrame:
    """All notes of all roots: (root_ord, rel, stem, content, mtime).  Files that aren't UTF-8 are skipped."""
    found = None
    for i, root in enumerate(roots):
        base = urlparse(root).path.rstrip("/") if "://" in root else os.path.abspath(root)
        rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").load(root)
        rel = F.expr(f"substring(path, instr(path, {_quoted(base + '/')}) + {len(base) + 1})")
        rows = rows.select(F.lit(i).alias("root_ord"), rel.alias("rel"), "content", F.col("modificationTime").alias("mtime"))
        rows = rows.where(ignore_condition(_lines(spark, root, IGNORE_FILE), F.col("rel"))).where(F.is_valid_utf8(F.col("content").cast("string")))
        found = rows if found is None else found.unionAll(rows)
    if found is None:
        return spark.createDataFrame([], NOTES)
    return found.select("root_ord", "rel", text.stem("rel").alias("stem"), F.col("content").cast("string").alias("content"), "mtime")


def _quoted(x: str) -> str:
    return "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"


def first_root_wins(notes: DataFrame) -> DataFrame:
    """One row for each rel: that of the earliest root."""
    order = Window.partitionBy("rel").orderBy("root_ord")
    return notes.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def list_directory(notes: DataFrame, directory: str = "") -> DataFrame:
    """(entry) one level below a directory, folders with a slash, hidden and skipped names left out."""
    prefix = f"{normalise_path(directory)}/" if directory else ""
    rest = F.split(F.substring("rel", len(prefix) + 1, 1 << 30), "/")
    name = F.element_at(rest, 1)
    rows = notes.where(F.startswith("rel", F.lit(prefix))).where(~F.startswith(name, F.lit(".")) & ~name.isin(*text.SKIPPED_NAMES))
    return rows.select(F.concat(F.lit(prefix), name, F.when(F.size(rest) > 1, "/").otherwise("")).alias("entry")).distinct().orderBy("entry")
