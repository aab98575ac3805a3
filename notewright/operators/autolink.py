"""Automatic links: the first whole-word mention of each title becomes a link.

The rewriting of one text is a fold over titles, longest first, each seeing the links before it, and so a Python
kernel; which titles a text may mention is found before by a join on the titles' first words.
"""

from __future__ import annotations

import _sre
import re
from re._casefix import _EXTRA_CASES

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text

_LINK = re.compile(text.WIKILINK)
#: What is never linked within, each looked for by itself: fences, inline code, addresses, links (fixed values).
_ZONES = (re.compile(r"^```[^\n]*\n.*?^```", re.M | re.S), re.compile(r"`[^`]+`"), re.compile(r"https?://\S+"), re.compile(r"\[\[[^\]]+\]\]"))
#: Bodies and names that may make a zone, or change one when a link is put in.
_ZONED, _BRACKETS, _UNSAFE = re.compile(r"[\[\]`]|://"), re.compile(r"[\[\]]"), re.compile(r"[\[\]`|:/\n]")


class _Cases(dict):
    """One letter for all that a pattern without regard to case takes for equal, each in its place."""

    def __missing__(self, c: int) -> int:
        low = _sre.unicode_tolower(c)
        self[c] = got = min(low, *_EXTRA_CASES.get(low, (low,)))
        return got


_CASES = _Cases()
_ASCII = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}
_FRONT = re.compile(r"---\n.*?\n---\n", re.S)


def auto_link(content: str, rel: str, titles: list[tuple[str, str, str]], stoplist=()) -> tuple[str, list[str]]:
    """(text, linked canonical names).  titles: (term, canonical, rel)."""
    if rel.split("/")[0] == "raw":
        return content, []
    linked = {m.group(1).strip() for m in _LINK.finditer(content)}
    stop = {s.lower() for s in stoplist}
    fit = [
        (i, term, name)
        for i, (term, name, path) in enumerate(titles)
        if len(term) >= 3 and path != rel and term.lower() not in stop and path.split("/")[0] != "raw" and name not in linked and term not in linked
    ]
    fit.sort(key=lambda x: (-len(x[1].encode()), x[0]))
    front = _FRONT.match(content)
    head, body = (front.group(), content[front.end() :]) if front else ("", content)
    added: list[str] = []
    if not _ZONED.search(body) and not any(_BRACKETS.search(term) or _UNSAFE.search(name) for _, term, name in fit):
        return head + _linked(body, fit, added), added
    folded = body.translate(_CASES)
    for _, term, name in fit:
        if term.translate(_CASES) not in folded or name in added or f"[[{name}]]" in body or f"[[{name}|" in body:
            continue
        zones = [m.span() for zone in _ZONES for m in zone.finditer(body)]
        for m in re.finditer(r"\b" + re.escape(term) + r"\b", body, re.I):
            if all(m.end() <= a or m.start() >= b for a, b in zones):
                body = body[: m.start()] + _link(term, name, m.group()) + body[m.end() :]
                folded = body.translate(_CASES)
                added.append(name)
                break
    return head + body, added


def _link(term: str, name: str, met: str) -> str:
    return f"[[{name}]]" if text_equal(term, name) else f"[[{name}|{met}]]"


def _linked(body: str, fit: list[tuple[int, str, str]], added: list[str]) -> str:
    """The fold over a body without zones of its own: places are those of the body as it was, and what is linked is blotted out by signs that no term holds."""
    folded = body.translate(_CASES)
    done: list[tuple[int, int, str]] = []
    names: set[str] = set()
    for _, term, name in fit:
        if name in names:
            continue
        key = term.translate(_CASES)
        first, last = _is_word(term[0]), _is_word(term[-1])
        at = folded.find(key)
        while at >= 0:
            end = at + len(key)
            if (at > 0 and _is_word(folded[at - 1])) != first and (end < len(folded) and _is_word(folded[end])) != last:
                folded = folded[:at] + "[" * len(key) + folded[end:]
                done.append((at, end, _link(term, name, body[at:end])))
                names.add(name)
                added.append(name)
                break
            at = folded.find(key, at + 1)
    out, last_end = [], 0
    for at, end, link in sorted(done):
        out += [body[last_end:at], link]
        last_end = end
    return "".join(out) + body[last_end:]


def _is_word(c: str) -> bool:
    return c.isalnum() or c == "_"


def text_equal(a: str, b: str) -> bool:
    return a.translate(_ASCII) == b.translate(_ASCII)


def suggest(notes: DataFrame, titles: DataFrame, stoplist=()) -> DataFrame:
    """(rel, new_text, added) of every note.

    A title reaches a note's kernel only if the note holds the title's first word, or for a title without a word all of it
    between two words: an equi-join, so neither side is broadcast, and a note's list is bounded by the titles that it may mention.
    """
    # letters that match each other without regard to case become equal; upper case leaves the signs among them as they are
    fold = lambda c: F.translate(F.replace(F.upper(c), F.lit("\u1e9e"), F.lit("SS")), "\u212a\u212b\u2126\u03f4\u0130", "K\u00c5\u03a9\u0398I")
    split = lambda c, at: F.filter(F.split(c, at), lambda x: x != "")
    words, gaps = (lambda c: split(fold(c), r"[^\p{L}\p{N}_]+")), (lambda c: split(c, r"[\p{L}\p{N}_]+"))
    keyed = titles.withColumn("word", F.coalesce(F.try_element_at(words(F.col("term")), F.lit(1)), F.col("term"))).where("length(term) >= 3").distinct()
    held = notes.where(~text.is_raw("rel")).select("rel", F.explode(F.array_distinct(F.concat(words(F.col("content")), gaps(F.col("content"))))).alias("word"))
    pairs = held.join(keyed.select("word", "term", "canonical", F.col("rel").alias("title_rel")), "word").where(F.col("rel") != F.col("title_rel"))
    lists = pairs.groupBy("rel").agg(F.sort_array(F.collect_set(F.struct("term", "canonical", F.col("title_rel").alias("path")))).alias("titles"))
    rows = notes.select("rel", F.coalesce("content", F.lit("")).alias("content")).join(lists, "rel", "left")
    stop = tuple(stoplist)

    def run(batches):
        for pdf in batches:
            out = [auto_link(c, r, [(t["term"], t["canonical"], t["path"]) for t in (ts if ts is not None else [])], stop) for r, c, ts in zip(pdf["rel"], pdf["content"], pdf["titles"], strict=True)]
            yield pd.DataFrame({"rel": pdf["rel"], "new_text": [o[0] for o in out], "added": [o[1] for o in out]})

    return rows.mapInPandas(run, "rel string, new_text string, added array<string>")
