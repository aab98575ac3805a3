"""Writers: notes, the markdown report, the HTML graph, and a vault's scaffold."""

from __future__ import annotations

import datetime
import html
import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A vault's folders (fixed values).
FOLDERS = ("raw", "wiki/entities", "wiki/concepts", "wiki/sources", "wiki/comparisons")
COLOURS = ("#4c78a8", "#f58518", "#54a24b", "#e45756", "#72b7b2", "#eeca3b", "#b279a2", "#ff9da6", "#9d755d", "#bab0ac", "#1f77b4", "#2ca02c")


def upsert(notes: DataFrame, changed: DataFrame) -> DataFrame:
    """The notes with changed rows in place of those of the same root and rel."""
    return notes.join(changed.select("root_ord", "rel"), ["root_ord", "rel"], "left_anti").select(notes.columns).unionByName(changed.select(notes.columns))


def write_text(spark: SparkSession, path: str, parts) -> None:
    """Writes pieces of text as one file, wherever the path's file system is; folders are made."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.setWriteChecksum(False)
    out = fs.create(target, True)
    try:
        for part in parts:
            out.write(bytearray(part.encode("utf-8")))
    finally:
        out.close()


def render_report(name: str, totals, hubs, communities, bridges, n_communities: int | None = None, today: str | None = None) -> str:
    """totals: (nodes, edges, orphans); hubs, communities (id, size, label, members) and bridges (source, target, score, communities): small row lists.

    The headings, the columns and the order of a report's parts are its format.
    """
    today = today or datetime.date.today().isoformat()
    n_communities = len(communities) if n_communities is None else n_communities
    lines = ["---", f'title: "Graph Report: {name}"', f"date: {today}", "type: report", "---", "", f"# Graph Report: {name}", ""]
    lines += [f"**Generated:** {today} | **Notes:** {totals[0]} | **Links:** {totals[1]} | **Communities:** {n_communities} | **Orphans:** {totals[2]}", ""]
    lines += ["## God nodes", "", "Notes that matter by their links, betweenness and PageRank.", "", "| Rank | Note | Score | Connections | Betweenness | PageRank |", "|-|-|-|-|-|-|"]
    for place, hub in enumerate(hubs, 1):
        lines.append(f"| {place} | [[{hub[0]}]] | {hub[1]:.2f} | {hub[2]} | {hub[3]:.2f} | {hub[4]:.2f} |")
    lines += ["", "## Communities", ""]
    for ident, size, label, members in communities:
        rest = f" ... and {size - 15} more" if size > 15 else ""
        lines += [f"### Community {ident + 1} — [[{label}]] ({size} notes)", "", ", ".join(f"[[{m}]]" for m in members[:15]) + rest, ""]
    if bridges:
        lines += ["## Surprising connections", ""]
        for source, target, score, a, b in bridges:
            lines.append(f"- [[{source}]] (community {(a or 0) + 1}) → [[{target}]] (community {(b or 0) + 1}) — bridge score: {score:.2f}")
        lines.append("")
    lines += ["## Suggested questions", ""]
    if len(hubs) > 1:
        lines.append(f"1. What ties [[{hubs[0][0]}]] to [[{hubs[1][0]}]]?")
    if totals[2]:
        lines.append(f"2. Where do the {totals[2]} orphan notes belong in the wiki?")
    lines.append("3. Which claims would a lint pass show as stale or at odds?")
    return "\n".join(lines) + "\n"


_PAGE = """<!DOCTYPE html><html><head><meta charset="utf-8"><title>%(title)s</title>
<style>body{font:14px sans-serif;margin:0}#tip{position:fixed;background:#fff;border:1px solid #999;padding:3px;display:none}</style></head>
<body><input id="filter" placeholder="filter"> <span id="legend">%(legend)s</span><div id="tip"></div><canvas id="c" width="1200" height="800"></canvas>
<script>
const nodes=%(nodes)s, edges=%(edges)s, colours=%(colours)s, ctx=c.getContext('2d'), at=new Map();
nodes.forEach((n,i)=>{n.x=600+300*Math.cos(i*2.4);n.y=400+300*Math.sin(i*2.4);n.dx=n.dy=0;at.set(n.id,n)});
let left=300, wanted='';
function step(){
  for(const a of nodes)for(const b of nodes)if(a!==b){const x=a.x-b.x,y=a.y-b.y,d=Math.max(25,x*x+y*y);a.dx+=900*x/d/20;a.dy+=900*y/d/20}
  for(const e of edges){const a=at.get(e.from),b=at.get(e.to);if(!a||!b)continue;const x=(b.x-a.x)/120,y=(b.y-a.y)/120;a.dx+=x;a.dy+=y;b.dx-=x;b.dy-=y}
  for(const n of nodes){n.dx+=(600-n.x)/900;n.dy+=(400-n.y)/900;n.x+=n.dx*=.8;n.y+=n.dy*=.8}
  draw(); if(--left>0)requestAnimationFrame(step)}
function draw(){ctx.clearRect(0,0,1200,800);ctx.strokeStyle='#ccc';for(const e of edges){const a=at.get(e.from),b=at.get(e.to);if(a&&b){ctx.beginPath();ctx.moveTo(a.x,a.y);ctx.lineTo(b.x,b.y);ctx.stroke()}}
  for(const n of nodes){ctx.globalAlpha=!wanted||n.label.toLowerCase().includes(wanted)?1:.15;ctx.fillStyle=colours[n.group%%colours.length];ctx.beginPath();ctx.arc(n.x,n.y,n.size,0,7);ctx.fill()}ctx.globalAlpha=1}
filter.oninput=()=>{wanted=filter.value.toLowerCase();draw()};
c.onmousemove=e=>{const n=nodes.find(n=>Math.hypot(n.x-e.offsetX,n.y-e.offsetY)<=n.size+2);tip.style.display=n?'block':'none';if(n){tip.textContent=n.label+' ('+n.degree+' links)';tip.style.left=e.clientX+9+'px';tip.style.top=e.clientY+9+'px'}};
step();
</script></body></html>
"""


def _json(x) -> str:
    return json.dumps(x, ensure_ascii=False).replace("<", "\\u003c")


def render_graph(nodes, edges, labels, title: str = "Note graph"):
    """The page in pieces.  nodes: (id, group, importance, degree); edges: (from, to), one for each occurrence; labels: {group: name}.
    Nodes and edges are taken one after another, so that they needn't be in memory together."""
    legend = " ".join(f'<b style="color:{COLOURS[g % len(COLOURS)]}">{html.escape(str(name))}</b>' for g, name in sorted(labels.items()))
    page = _PAGE % {"title": html.escape(title), "legend": legend, "nodes": "\0", "edges": "\0", "colours": _json(COLOURS)}
    head, middle, end = page.split("\0")
    yield head
    yield from _listed({"id": n[0], "label": n[0], "group": n[1], "size": round(4 + 16 * n[2], 3), "degree": n[3]} for n in nodes)
    yield middle
    yield from _listed({"from": a, "to": b} for a, b in edges)
    yield end


def _listed(items):
    yield "["
    for i, x in enumerate(items):
        yield ("," if i else "") + _json(x)
    yield "]"


def graph_nodes(degrees: DataFrame, found: DataFrame, hubs: DataFrame) -> DataFrame:
    """(name, group, importance, degree) of every link end: community 0 and importance 0 where there is none."""
    rows = degrees.select("name", "degree").join(found.select("name", F.col("community_id").alias("group")), "name", "left").join(hubs.select("name", F.col("score").alias("importance")), "name", "left")
    return rows.select("name", F.coalesce("group", F.lit(0)).alias("group"), F.coalesce("importance", F.lit(0.0)).alias("importance"), "degree")


def group_labels(nodes: DataFrame) -> DataFrame:
    """Each group's member of most links, the greatest name at a tie."""
    return nodes.groupBy("group").agg(F.max_by("name", F.struct("degree", "name")).alias("label"))


def scaffold(root: str) -> list[str]:
    """Makes a vault's folders and start files; what exists is left alone."""
    made = []
    for folder in FOLDERS:
        os.makedirs(os.path.join(root, folder), exist_ok=True)
        keep = os.path.join(root, folder, ".gitkeep")
        if not os.path.exists(keep):
            open(keep, "w").close()
            made.append(f"{folder}/.gitkeep")
    today = datetime.date.today().isoformat()
    files = {
        "index.md": "# Index\n\nA catalogue of all wiki pages.\n\n## Entities\n\n## Concepts\n\n## Sources\n\n## Comparisons\n",
        "log.md": f"# Log\n\n## [{today}] created | vault\n",
        "AGENTS.md": "# Rules\n\n- raw/ holds sources and is immutable: nothing in it is ever changed.\n- wiki/ holds pages on entities, concepts, sources and comparisons.\n- Every page is named in index.md and every change in log.md.\n",
    }
    for name, body in files.items():
        path = os.path.join(root, name)
        if not os.path.exists(path):
            with open(path, "w", encoding="utf-8") as f:
                f.write(body)
            made.append(name)
    return made
