"""Graph analytics over links: neighbourhoods, paths, PageRank, betweenness, communities, hubs and bridges.

Iterations are joins and aggregations whose lineage is cut in the shared folder.  Graphs of at most SMALL edges (for betweenness CODED),
counted first, go through the same arithmetic in numpy instead.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.shared import components as _components
from ..plans.shared import materialise
from .edges import nodes as nodes_of

DAMPING, ROUNDS, PASSES, LEAST_COMMUNITY, EXACT_UP_TO, SAMPLES, SMALL = 0.85, 50, 20, 3, 500, 100, 200_000
#: Directed edges of a component that one task takes; larger ones go through joins.
KERNEL = 2_000_000
#: Directed edges that betweenness takes as arrays of numbers, 4 bytes each in every task; more go through joins.
CODED = 20_000_000


def small(edges: DataFrame, most: int = SMALL) -> bool:
    return edges.count() <= most


def traverse(notes: DataFrame, adjacency: DataFrame, start: str, depth: int = 2) -> DataFrame:
    """(note, distance, neighbors): breadth-first from a note, which is known if it is a note or an edge's end."""
    known = notes.where(F.col("stem") == start).select(F.col("stem").alias("node")).unionAll(adjacency.where(F.col("u") == start).select(F.col("u").alias("node"))).distinct()
    seen = known.withColumn("distance", F.lit(0))
    frontier = known
    for step in range(1, depth + 1):
        met = adjacency.join(frontier, F.col("u") == F.col("node")).select(F.col("v").alias("node")).distinct()
        frontier = met.join(seen.select("node"), "node", "left_anti")
        if step % 3 == 0:
            frontier = materialise(frontier, "traverse")
        seen = seen.unionAll(frontier.withColumn("distance", F.lit(step)))
    around = adjacency.join(seen.select(F.col("node").alias("u")), "u").groupBy("u").agg(F.sort_array(F.collect_list("v")).alias("neighbors"))
    out = seen.join(around, F.col("node") == F.col("u"), "left")
    return out.select(F.col("node").alias("note"), "distance", F.coalesce("neighbors", F.array().cast("array<string>")).alias("neighbors")).orderBy("distance", "note")


def shortest_path(adjacency: DataFrame, start: str, end: str) -> DataFrame:
    """(path): the lexicographically least of the shortest paths, or no row.

    A level keeps the least path of each newly met node; two level tables are held, not the paths of all.
    """
    spark = adjacency.sparkSession
    if start == end:
        return spark.createDataFrame([([start],)], "path array<string>")
    level = spark.createDataFrame([(start, [start])], "node string, path array<string>")
    seen = level.select("node")
    while True:
        met = adjacency.join(level, F.col("u") == F.col("node")).select(F.col("v").alias("node"), F.concat("path", F.array("v")).alias("path"))
        level = materialise(met.join(seen, "node", "left_anti").groupBy("node").agg(F.min("path").alias("path")), "path-level")
        found = level.where(F.col("node") == end).select("path")
        if not found.isEmpty() or level.isEmpty():
            return found
        seen = materialise(seen.unionAll(level.select("node")), "path-seen")


def components(adjacency: DataFrame) -> DataFrame:
    """(name, component): component is its least name; only names with an edge."""
    joined = _components(adjacency.select(F.col("u").alias("a"), F.col("v").alias("b")), "components")
    own = adjacency.select(F.col("u").alias("node")).distinct().join(joined, "node", "left")
    return own.select(F.col("node").alias("name"), F.coalesce("component", "node").alias("component"))


def pagerank(notes: DataFrame, links: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(name, pagerank) over all notes and link ends: fixed rounds, dangling mass dropped, divided by the maximum."""
    weighted = links.groupBy("src", "dst").agg(F.count("*").alias("w"))
    names = nodes_of(notes, links)
    if small(weighted) and small(names):
        return _pagerank_small(names, weighted, rounds)
    out = weighted.groupBy("src").agg(F.sum("w").alias("total"))
    shares = materialise(weighted.join(out, "src").select("src", "dst", (F.col("w") / F.col("total")).alias("share")), "rank-shares")
    names = materialise(names, "rank-nodes")
    n = names.count()
    rank = names.withColumn("r", F.lit(1.0 / max(n, 1)))
    for i in range(rounds):
        # merged, as what is broadcast in each round passes through the driver
        got = rank.join(shares.hint("merge"), F.col("name") == F.col("src")).groupBy("dst").agg(F.sum(F.col("r") * F.col("share")).alias("g"))
        rank = names.join(got.hint("merge"), F.col("name") == F.col("dst"), "left").select("name", (F.lit((1 - DAMPING) / max(n, 1)) + DAMPING * F.coalesce("g", F.lit(0.0))).alias("r"))
        if i % 10 == 9:
            rank = materialise(rank, "rank")
    return _normalised(rank, "r", "pagerank")


def _pagerank_small(names: DataFrame, weighted: DataFrame, rounds: int) -> DataFrame:
    spark = names.sparkSession
    keys = sorted(r[0] for r in names.collect())
    at = {k: i for i, k in enumerate(keys)}
    rows = weighted.collect()
    n = len(keys)
    src, dst = np.array([at[r[0]] for r in rows], int), np.array([at[r[1]] for r in rows], int)
    w = np.array([r[2] for r in rows], float)
    share = w / np.bincount(src, w, n)[src] if len(w) else w
    r = np.full(n, 1.0 / max(n, 1))
    for _ in range(rounds):
        r = (1 - DAMPING) / max(n, 1) + DAMPING * np.bincount(dst, r[src] * share, n)
    top = r.max(initial=0)
    return spark.createDataFrame(pd.DataFrame({"name": pd.Series(keys, dtype=object), "pagerank": r / top if top else r}), "name string, pagerank double")


def _normalised(rows: DataFrame, column: str, name: str) -> DataFrame:
    top = rows.agg(F.max(column)).first()[0] or 0.0
    return rows.select("name", (F.col(column) / top if top > 0 else F.col(column)).alias(name))


def placed(rows: DataFrame, *order) -> DataFrame:
    """The rows with their ``place`` (from 0) in an order of no ties, from the sizes of the ranges before theirs, not from one task."""
    parted = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()).withColumn("_k", F.monotonically_increasing_id())
    parted = materialise(parted, "places")
    sizes = {r[0]: (r[1], r[2]) for r in parted.groupBy("_part").agg(F.count("*"), F.min("_k")).collect()}  # a row for each range
    shift, total = [], 0
    for part in sorted(sizes):
        shift += [F.lit(part), F.lit(total - sizes[part][1])]
        total += sizes[part][0]
    if not shift:
        return parted.withColumn("place", F.lit(0).cast("long")).drop("_part", "_k")
    return parted.withColumn("place", F.col("_k") + F.element_at(F.create_map(*shift), F.col("_part"))).drop("_part", "_k")


def sources_of(adjacency: DataFrame) -> DataFrame:
    """(name): all nodes of a small graph, else the first SAMPLES of the sorted names at a stride of n / SAMPLES."""
    names = adjacency.select(F.col("u").alias("name")).distinct()
    n = names.count()
    if n <= EXACT_UP_TO:
        return names
    step = max(n // SAMPLES, 1)
    return placed(names, "name").where((F.col("place") % step == 0) & (F.col("place") < step * SAMPLES)).select("name")


def betweenness(adjacency: DataFrame) -> DataFrame:
    """(name, betweenness), divided by the maximum."""
    if small(adjacency, CODED):
        part = _betweenness_coded(adjacency)
    else:
        part = _betweenness_joins(adjacency, sources_of(adjacency))
    names = adjacency.select(F.col("u").alias("name")).distinct()
    summed = part.groupBy("name").agg(F.sum("x").alias("x"))
    return _normalised(names.join(summed, "name", "left").select("name", F.coalesce("x", F.lit(0.0)).alias("x")), "x", "betweenness")


def _betweenness_coded(adjacency: DataFrame) -> DataFrame:
    """(name, x): names become numbers, and each task has all edges as two broadcast arrays; at most CODED edges."""
    spark = adjacency.sparkSession
    names = materialise(placed(adjacency.select(F.col("u").alias("name")).distinct(), "name").select("name", F.col("place").cast("int").alias("k")), "bc-names")
    coded = adjacency.join(names.toDF("u", "a"), "u").join(names.toDF("v", "b"), "v").select("a", "b").toArrow()
    n = names.count()
    a, b = (coded[c].to_numpy() for c in ("a", "b"))
    ends = b[np.argsort(a, kind="stable")].astype(np.int32)
    starts = np.concatenate([[0], np.cumsum(np.bincount(a, minlength=n))])
    step = 1 if n <= EXACT_UP_TO else max(n // SAMPLES, 1)
    chosen = range(0, n if n <= EXACT_UP_TO else min(n, step * SAMPLES), step)
    shared = spark.sparkContext.broadcast((starts, ends))

    def run(batches):
        total = np.zeros(n)
        for pdf in batches:
            for s in pdf["id"]:
                total += dependencies(*shared.value, int(s))
        at = np.flatnonzero(total)
        for i in range(0, len(at), 100_000):
            yield pd.DataFrame({"k": at[i : i + 100_000].astype(np.int32), "x": total[at[i : i + 100_000]]})

    sums = spark.range(len(chosen)).select((F.col("id") * step).alias("id")).repartition(8).mapInPandas(run, "k int, x double")
    return sums.join(names, "k").select("name", "x")


def dependencies(starts: np.ndarray, ends: np.ndarray, source: int) -> np.ndarray:
    """Each node's dependency on one source, unweighted, level by level; node i's neighbours are ends[starts[i]:starts[i + 1]]."""
    n = len(starts) - 1
    dist, paths, levels = np.full(n, -1, np.int32), np.zeros(n), []
    dist[source], paths[source] = 0, 1.0
    front = np.array([source])
    while len(front):
        size = starts[front + 1] - starts[front]
        at = np.arange(size.sum()) + np.repeat(starts[front] - np.cumsum(size) + size, size)
        u, v = np.repeat(front, size).astype(np.int32), ends[at]
        dist[v[dist[v] < 0]] = len(levels) + 1
        on = dist[v] == len(levels) + 1
        u, v = u[on], v[on]
        paths += np.bincount(v, paths[u], n)
        levels.append((u, v))
        front = np.unique(v)
    share = np.zeros(n)
    for u, v in reversed(levels):
        share += np.bincount(u, paths[u] / paths[v] * (1 + share[v]), n)
    share[source] = 0
    return share


def _betweenness_joins(adjacency: DataFrame, sources: DataFrame) -> DataFrame:
    """The same by levels of joins, for all sources at once: forward for path counts, back for dependencies."""
    level = materialise(sources.select(F.col("name").alias("s"), F.col("name").alias("node"), F.lit(1.0).alias("paths")), "bc-level")
    seen, levels = level.select("s", "node"), [level]
    while True:
        met = levels[-1].join(adjacency, F.col("node") == F.col("u")).groupBy("s", F.col("v").alias("next")).agg(F.sum("paths").alias("paths")).withColumnRenamed("next", "node")
        level = materialise(met.join(seen, ["s", "node"], "left_anti"), "bc-level")
        if level.isEmpty():
            break
        levels.append(level)
        seen = materialise(seen.unionAll(level.select("s", "node")), "bc-seen")
    share = levels[-1].select("s", "node", "paths", F.lit(0.0).alias("d"))
    out = share.where("s <> node").select(F.col("node").alias("name"), F.col("d").alias("x"))
    for above in reversed(levels[:-1]):
        down = share.select("s", F.col("node").alias("w"), F.col("paths").alias("pw"), "d")
        got = down.join(adjacency, F.col("w") == F.col("v")).select("s", F.col("u").alias("node"), ((1 + F.col("d")) / F.col("pw")).alias("g")).groupBy("s", "node").agg(F.sum("g").alias("g"))
        share = materialise(above.join(got, ["s", "node"], "left").select("s", "node", "paths", (F.col("paths") * F.coalesce("g", F.lit(0.0))).alias("d")), "bc-share")
        out = out.unionAll(share.where("s <> node").select(F.col("node").alias("name"), F.col("d").alias("x")))
    return out


def local_moving(around: dict[str, list[str]], m: int) -> dict[str, int]:
    """Community of each node of a component after at most PASSES passes of greedy moves in name order.

    m: edges of the whole graph without loops.  A node moves to the neighbouring community of the highest gain above 0,
    the lowest id at a tie; moves are seen at once.
    """
    names = sorted(around)
    own = {x: i for i, x in enumerate(names)}
    degree = {x: len(around[x]) for x in names}
    weight = {i: degree[x] for i, x in enumerate(names)}
    for _ in range(PASSES):
        moved = False
        for x in names:
            near: dict[int, int] = defaultdict(int)
            for y in around[x]:
                near[own[y]] += 1
            best, gain = own[x], 0.0
            for c in sorted(near):
                if c != own[x]:
                    g = near[c] / m - weight[c] * degree[x] / (2.0 * m * m)
                    if g > gain:
                        best, gain = c, g
            if best != own[x]:
                weight[own[x]] -= degree[x]
                weight[best] += degree[x]
                own[x] = best
                moved = True
        if not moved:
            break
    return own


def dissolve_small(around: dict[str, list[str]], own: dict[str, int]) -> dict[str, int]:
    """Members of communities below LEAST_COMMUNITY go to the community of most of their neighbours outside.

    Small communities by their least name; at a tie the community with the least name.
    """
    members: dict[int, set[str]] = defaultdict(set)
    for x, c in own.items():
        members[c].add(x)
    for c in sorted((c for c, ms in members.items() if len(ms) < LEAST_COMMUNITY), key=lambda c: min(members[c])):
        for x in sorted(members[c]):
            near: dict[int, int] = defaultdict(int)
            for y in around[x]:
                if own[y] != c:
                    near[own[y]] += 1
            if near:
                to = min(near, key=lambda k: (-near[k], min(members[k])))
                members[c].discard(x)
                members[to].add(x)
                own[x] = to
    return own


def communities(adjacency: DataFrame) -> DataFrame:
    """(name, community_id, size, label): ids by size, then least member, which is the label.

    The passes are sequential within a component and independent between components: a component of at most KERNEL edges is one
    task of the kernel, whose memory that bounds; a larger one moves by joins, all its nodes at once.
    """
    m = adjacency.where("u < v").count()
    rows = adjacency.join(components(adjacency), F.col("u") == F.col("name")).select("component", "u", "v")
    large = materialise(rows.groupBy("component").count().where(F.col("count") > KERNEL).select("component"), "communities-large")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        around = {u: sorted(g) for u, g in pdf.groupby("u")["v"]}
        own = dissolve_small(around, local_moving(around, m)) if m else {u: i for i, u in enumerate(sorted(around))}
        least: dict[int, str] = {}
        for x in sorted(own):
            least.setdefault(own[x], x)
        return pd.DataFrame({"name": list(own), "label": [least[c] for c in own.values()]})

    found = rows.join(large, "component", "left_anti").groupBy("component").applyInPandas(run, "name string, label string")
    if not large.isEmpty():
        found = found.unionAll(_moving_joins(materialise(rows.join(large, "component", "left_semi").select("u", "v"), "communities-edges"), m))
    found = materialise(found, "communities")
    sizes = placed(found.groupBy("label").agg(F.count("*").alias("size")), F.desc("size"), F.asc("label"))
    return found.join(sizes, "label").select("name", F.col("place").alias("community_id"), "size", "label")


def _moving_joins(edges: DataFrame, m: int) -> DataFrame:
    """(name, label): all nodes of a pass move at once, where the gain is above that of staying; passes that only lower the community's
    name alternate with passes that only raise it, so that two nodes can't change places for ever.  Small communities go to larger ones first."""
    own = materialise(edges.groupBy(F.col("u").alias("name")).agg(F.count("*").alias("degree")).withColumn("c", F.col("name")), "moving")
    still = 0
    for turn in range(PASSES):
        near = edges.join(own.select(F.col("name").alias("v"), "c"), "v").groupBy("u", "c").agg(F.count("*").alias("e"))
        total = own.groupBy("c").agg(F.sum("degree").alias("w"))
        mine = own.select(F.col("name").alias("u"), F.col("c").alias("now"), "degree")
        home = F.col("c") == F.col("now")
        gain = F.col("e") / m - (F.col("w") - F.when(home, F.col("degree")).otherwise(0)) * F.col("degree") / (2.0 * m * m)
        side = F.col("c") < F.col("now") if turn % 2 == 0 else F.col("c") > F.col("now")
        gains = near.join(total, "c").join(mine, "u").withColumn("g", gain).where(home | side)
        # at a tie a node stays
        best = gains.groupBy("u", "now").agg(F.min(F.struct((-F.col("g")).alias("g"), (~home).alias("away"), "c")).alias("x"))
        moves = materialise(best.where("x.away and x.g < 0").select(F.col("u").alias("name"), F.col("x.c").alias("to")), "moving-moves")
        still = still + 1 if moves.isEmpty() else 0
        if still == 2:
            break
        own = materialise(own.join(moves, "name", "left").select("name", "degree", F.coalesce("to", "c").alias("c")), "moving")
    little = own.groupBy("c").agg(F.count("*").alias("n")).where(F.col("n") < LEAST_COMMUNITY).select("c")
    loose = own.join(little, "c", "left_semi").select(F.col("name").alias("u"), F.col("c").alias("now"))
    around = edges.join(loose, "u").join(own.select(F.col("name").alias("v"), "c"), "v").where("c <> now").groupBy("u", "c").agg(F.count("*").alias("e"))
    around = around.join(little.withColumn("little", F.lit(True)), "c", "left").withColumn("little", F.col("little").isNotNull())
    to = around.groupBy("u").agg(F.min(F.struct("little", (-F.col("e")).alias("e"), "c")).alias("x")).select(F.col("u").alias("name"), F.col("x.c").alias("to"))
    own = materialise(own.join(to, "name", "left").select("name", F.coalesce("to", "c").alias("c")), "moving")
    return own.join(own.groupBy("c").agg(F.min("name").alias("label")), "c").select("name", "label")


def cluster(found: DataFrame) -> DataFrame:
    """(id, size, label, members) of each community."""
    return found.groupBy(F.col("community_id").alias("id")).agg(F.count("*").alias("size"), F.min("name").alias("label"), F.sort_array(F.collect_list("name")).alias("members")).orderBy("id")


def cluster_heads(found: DataFrame, most: int = 15) -> DataFrame:
    """As ``cluster``, with each community's first ``most`` members alone: a report shows no more."""
    rank = F.row_number().over(Window.partitionBy("community_id").orderBy("name"))
    heads = found.withColumn("_n", rank).where(F.col("_n") <= most)
    return heads.groupBy(F.col("community_id").alias("id")).agg(F.first("size").alias("size"), F.min("name").alias("label"), F.sort_array(F.collect_list("name")).alias("members")).orderBy("id")


def hubs(adjacency: DataFrame, between: DataFrame, rank: DataFrame, limit: int = 15) -> DataFrame:
    """(name, score, degree, betweenness, pagerank): 0.4 degree / maximum + 0.3 betweenness + 0.3 pagerank."""
    degree = adjacency.groupBy(F.col("u").alias("name")).agg(F.count("*").alias("degree"))
    top = degree.agg(F.max("degree")).first()[0] or 1
    rows = degree.join(between, "name", "left").join(rank, "name", "left").na.fill(0.0, ["betweenness", "pagerank"])
    score = 0.4 * F.col("degree") / top + 0.3 * F.col("betweenness") + 0.3 * F.col("pagerank")
    return rows.select("name", score.alias("score"), "degree", "betweenness", "pagerank").orderBy(F.desc("score"), "name").limit(limit)


def bridges(links: DataFrame, found: DataFrame, between: DataFrame, limit: int = 10) -> DataFrame:
    """(source, target, score, source_community, target_community): occurrences of links between communities, by the sum of their ends' betweenness."""
    side = found.select("name", "community_id").join(between, "name", "left")
    a = side.toDF("src", "ca", "ba")
    b = side.toDF("dst", "cb", "bb")
    rows = links.join(a, "src", "left").join(b, "dst", "left").where(~F.col("ca").eqNullSafe(F.col("cb")))
    score = F.coalesce("ba", F.lit(0.0)) + F.coalesce("bb", F.lit(0.0))
    return rows.select(F.col("src").alias("source"), F.col("dst").alias("target"), score.alias("score"), F.col("ca").alias("source_community"), F.col("cb").alias("target_community")).orderBy(F.desc("score"), "source", "target").limit(limit)
