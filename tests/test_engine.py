import json
import random
from collections import Counter, defaultdict, deque

import pytest
from pyspark.sql import functions as F

from notewright import sinks
from notewright.engine import Engine
from notewright.functions import text, version
from notewright.operators import autolink, edges, graph, lint, search
from notewright.operators.index import Index
from notewright.plans import shared
from notewright.sources import vault
from notewright.streaming import maintain

HERBS = "sage basil thyme mint dill fennel sorrel lovage borage tansy yarrow rue anise chervil hyssop savory".split()


def notes(spark, files):
    rows = [(0, rel, rel.rsplit("/", 1)[-1].removesuffix(".md"), content) for rel, content in files.items()]
    return spark.createDataFrame(rows, "root_ord int, rel string, stem string, content string")


def garden(n=60, seed=3):
    rng = random.Random(seed)
    return {f"beds/{i:02d}.md": " ".join(rng.choice(HERBS) + rng.choice(["", "", ",", "s", "-tea"]) for _ in range(rng.randint(0, 40))) for i in range(n)}


# texts and paths


def test_parsing(spark):
    cases = {
        "list": "---\naliases: [Salvia, 'common sage', \"\"]\n---\nGoes with [[Thyme|its friend]], [[ Mint ]] and [[Thyme]].\n",
        "odd": "[[Dill|]] [[[Rue]] [[ ]] [[a\nb]]",
        "bare": "---\n---\n",
        "block": "---\naliases:\n- Anethum\n---\n",
        "scalar": "---\nkind: herb\naliases: Anethum\n---\nx",
        "open": "---\naliases: [one, two\n---\nx",
        "none": None,
    }
    text.register(spark)
    df = spark.createDataFrame(list(cases.items()), "k string, t string")
    got = {r[0]: r[1:] for r in df.select("k", text.aliases("t"), text.wikilinks("t"), text.frontmatter("t")).collect()}
    assert got["list"][:2] == (["Salvia", "common sage"], ["Thyme", "Mint", "Thyme"])
    assert got["odd"][1] == ["[Rue", "a\nb"] and got["bare"][2] is None and got["block"][0] == []
    assert got["scalar"] == (["Anethum"], [], "kind: herb\naliases: Anethum") and got["open"][0] == ["one", "two"]
    assert got["none"] == ([], [], None)
    same = {r[0]: r[1:] for r in df.selectExpr("k", "aliases(t)", "wikilinks(t)", "frontmatter(t)").collect()}
    assert same == got


def test_paths():
    assert all(vault.is_immutable(p) for p in ("raw/seeds.md", "RAW/a/b.md", "raw", "./raw/x.md", " raw/x.md"))
    assert not any(vault.is_immutable(p) for p in ("wiki/raw.md", "rawhide/x.md", "log.md"))
    assert vault.normalise_path("beds/./sage.md") == "beds/sage.md"
    for bad in ("../shed.md", "beds/../../shed", "/shed", " ", "."):
        with pytest.raises(ValueError):
            vault.normalise_path(bad)


def test_roots_and_stopwords(spark, tmp_path):
    env = {"NOTEWRIGHT_VAULTS": "/a::/b", "NOTEWRIGHT_VAULT": "/c"}
    assert vault.resolve_roots(["/x"], env) == ["/x"] and vault.resolve_roots(None, env) == ["/a", "/b"]
    assert vault.resolve_roots([], {"NOTEWRIGHT_VAULT": "/c"}) == ["/c"] and vault.resolve_roots(None, {}) == []
    (tmp_path / vault.STOPLIST_FILE).write_text("# mine\n  Weeds \n\nlog\n")
    (tmp_path / vault.IGNORE_FILE).write_text("/shed/\n")
    (tmp_path / "shed").mkdir()
    for name in ("shed/a.md", "b.md"):
        (tmp_path / name).write_text("x")
    assert [r.rel for r in vault.load_vault(spark, [str(tmp_path)]).collect()] == ["b.md"]
    assert vault.stoplist(spark, [str(tmp_path)]) == sorted({"index", "readme", "agents", "claude", "log", "skill", "changelog", "weeds"})


@pytest.mark.parametrize(
    ("lines", "gone"),
    [
        (["**/drafts/"], ["drafts/a.md", "a/b/drafts/c.md", "x/drafts/y/z.md"]),
        (["/drafts"], ["drafts/a.md"]),
        (["*.tmp.md", "!keep.tmp.md"], ["one.tmp.md", "x/two.tmp.md"]),
        (["x/**"], ["x/drafts/y/z.md", "x/two.tmp.md", "x/keep.tmp.md"]),
        (["x/", "!x/keep.tmp.md"], ["x/drafts/y/z.md", "x/two.tmp.md", "x/keep.tmp.md"]),
        (["a/**/c.md"], ["a/b/drafts/c.md", "a/c.md"]),
        (["# no", "", "\\#hash.md", "[o-p]?e.*"], ["#hash.md", "one.tmp.md"]),
        (["a/*/drafts"], ["a/b/drafts/c.md"]),
        (["node_modules.md  "], ["node_modules.md"]),
    ],
)
def test_ignore_files(spark, lines, gone):
    paths = ["drafts/a.md", "a/b/drafts/c.md", "x/drafts/y/z.md", "one.tmp.md", "x/two.tmp.md", "x/keep.tmp.md", "a/c.md", "#hash.md", "plain.md", "node_modules/p.md", "node_modules.md", "drafts.md"]
    df = spark.createDataFrame([(p,) for p in paths], "rel string")
    assert {r.rel for r in df.where(vault.ignore_condition(lines, F.col("rel"))).collect()} == set(paths) - set(gone)
    assert {r.rel for r in df.where(vault.ignore_condition(None, F.col("rel"))).collect()} == set(paths) - {"node_modules/p.md"}


def test_versions():
    assert version.parse("v1.20.3-rc.1+x.5") == (1, 20, 3, "rc.1", "x.5") and str(version.parse("V0.0.1")) == "0.0.1"
    order = ["0.9.9", "1.0.0-alpha", "1.0.0-alpha.1", "1.0.0-alpha.beta", "1.0.0-beta.2", "1.0.0-beta.11", "1.0.0-rc.1", "1.0.0", "1.0.10", "1.2.0"]
    for a, b in zip(order, order[1:], strict=False):
        assert version.is_upgrade(a, b) and not version.is_upgrade(b, a)
    assert not version.is_upgrade("1.0.0+a", "1.0.0+b") and sorted(map(version.parse, reversed(order))) == list(map(version.parse, order))
    for bad in ("", "v", "newest", "2.1", "02.1.0", "vv1.0.0", "1.2.3.4", "1.0.0-", "1.0.0-01", "1.0.0+"):
        with pytest.raises(ValueError):
            version.parse(bad)


# search


def brute_search(files, query):
    docs = {rel: c.lower() for rel, c in files.items()}
    toks = {rel: c.split() for rel, c in docs.items()}
    terms, n = text.bare_terms(query), len(docs)
    average = sum(map(len, toks.values())) / n
    import math

    out = []
    for rel, c in docs.items():
        if any(t in c for t in terms) if terms else query.lower() in c:
            score = 0.0
            for t in query.lower().split():
                tf, df = toks[rel].count(t), sum(t in x for x in toks.values())
                score += math.log((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(toks[rel]) / average))
            out.append((rel, round(score, 9)))
    return sorted(out, key=lambda x: (-x[1], x[0]))


QUERIES = ["sage mint", "Sage, (mint)", "sage sage dill", "orr", "-", ",", "", ". .", "nothing here", "s- TEA", "tea"]


def test_search_ways_agree_with_brute_force(spark, monkeypatch):
    files = {**garden(), "empty.md": "", "sign.md": "- , . ."}
    n = notes(spark, files)
    index = Index(spark, shared.fresh_path(spark, "t")).add(n)
    near = lambda df: [(r.rel, round(r.score, 9)) for r in df.collect()]
    for q in QUERIES:
        want = brute_search(files, q)
        assert near(search.search(n, q, 20)) == near(index.search(q, 20)) == want[:20], q
    from notewright.operators import index as module

    monkeypatch.setattr(module, "FEW", 1)
    assert near(index.search("sage mint", 500)) == brute_search(files, "sage mint")


def test_index_takes_changes(spark):
    files = garden(30)
    index = Index(spark, shared.fresh_path(spark, "t")).add(notes(spark, files))
    changes = {"beds/03.md": "sage sage rue", "beds/04.md": None, "new.md": "mint-tea for two", "beds/05.md": ""}
    index.add(notes(spark, changes))
    index.add(notes(spark, {"beds/03.md": "only hyssop now"}))
    files = {k: v for k, v in {**files, **changes, "beds/03.md": "only hyssop now"}.items() if v is not None}
    for q in ("sage", "hyssop now", "mint-tea", ", .", "rue sage"):
        assert [(r.rel, round(r.score, 9)) for r in index.search(q, 100).collect()] == brute_search(files, q), q


def test_index_reads_few_files(spark):
    index = Index(spark, shared.fresh_path(spark, "t")).add(notes(spark, garden()))
    plan = index.postings(["hyssop"], ["hyssop"])._jdf.queryExecution().toString()
    assert "PartitionFilters: [" in plan and "bucket" in plan.split("PartitionFilters")[1][:80] and "PushedFilters: [In(term" in plan


def test_index_shuffles_no_posting_for_many_tokens(spark, monkeypatch):
    from notewright.operators import index as module

    files = garden()
    index = Index(spark, shared.fresh_path(spark, "t")).add(notes(spark, files))
    monkeypatch.setattr(module, "FEW", 1)
    found = index.postings(["s"], ["sage"])
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString() and found.count() > 1
    assert "Exchange" not in index.document_frequency()._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(module, "SLICE", 1)
    many = Index(spark, shared.fresh_path(spark, "t")).add(notes(spark, files))
    rows = lambda x: sorted((r.term, r.tf, r.dl, r.bucket) for r in x._read("postings").collect())
    assert rows(many) == rows(index) and sorted(many.document_frequency().collect()) == sorted(search.document_frequency(notes(spark, files)).collect())


def test_words_counted_within_a_row(spark):
    df = spark.createDataFrame([(["b", "a", "b", "B"],), ([],), (["x"],)], "w array<string>")
    assert [[tuple(x) for x in r[0]] for r in df.select(text.counted(F.col("w"))).collect()] == [[("B", 1), ("a", 1), ("b", 2)], [], [("x", 1)]]


def test_snippets_and_trigrams(spark):
    n = spark.createDataFrame([(0, "a.md", "a", "mint\nleaf"), (1, "a.md", "a", "other mint text")], "root_ord int, rel string, stem string, content string")
    hits = search.with_snippets(search.search(n, "mint"), n, "mint").collect()
    assert sorted(r.snippet for r in hits) == ["mint leaf", "other mint text"]
    n = notes(spark, garden())
    for term in ("orr", "yssop", "ti", "SAGE", "xyz"):
        want = {r.rel for r in n.where(F.contains(F.lower("content"), F.lit(term.lower()))).collect()}
        assert {r.rel for r in search.indexed_candidates(search.trigrams(n), n, term).collect()} == want


# links


def test_auto_link():
    titles = [("Sweet Basil", "Sweet Basil", "wiki/concepts/Sweet Basil.md"), ("Rue", "Rue", "wiki/concepts/Rue.md"), ("Épée", "Épée", "wiki/x.md"), ("herb of grace", "Rue", "wiki/concepts/Rue.md")]
    link = lambda body, rel="wiki/plan.md", stop=(): autolink.auto_link(body, rel, titles, stop)
    assert link("Plant sweet basil by the rue, rue again.") == ("Plant [[Sweet Basil]] by the [[Rue]], rue again.", ["Sweet Basil", "Rue"])
    assert link("~ herb of Grace") == ("~ [[Rue|herb of Grace]]", ["Rue"])
    assert link("une épée") == ("une [[Épée]]", ["Épée"])
    for kept in ("```sh\nrue\n```", "`two\nrue lines`", "http://x.org/(rue)", "https://x.org/a]rue", "[[the rue bed]]", "[[x|rue]]", "true", "rues", "[[Rue|it]] and rue"):
        assert link(kept) == (kept, []), kept
    assert link("```rue```")[1] == [] and link("``` rue")[1] == ["Rue"]
    assert link("---\ntitle: rue\n---\nthe rue") == ("---\ntitle: rue\n---\nthe [[Rue]]", ["Rue"])
    assert link("the rue", "raw/x.md")[1] == [] and link("the rue", stop=["RUE"])[1] == [] and link("the rue", "wiki/concepts/Rue.md")[1] == []
    assert autolink.auto_link("a ox", "n.md", [("ox", "ox", "wiki/ox.md"), ("ash", "ash", "raw/ash.md")]) == ("a ox", [])


def test_auto_link_of_plain_texts_compiles_no_pattern(monkeypatch):
    titles = [("sage", "Sage", "a.md"), ("ſAGE tea", "Sage tea", "b.md"), ("mint,rue", "Both", "c.md"), ("+rue", "Plus", "d.md"), ("kelvin", "Kelvin", "e.md"), ("rue", "Rue", "f.md")]
    texts = ["Sage tea, sage; sages", "mint,rue rue x+rue", "\u212aelvin \u212aelvin_ RUE", "rue mint,rue mint,ruea", ""]
    want = [autolink.auto_link(x, "n.md", titles) for x in texts]
    with monkeypatch.context() as m:
        m.setattr(autolink, "_ZONED", autolink.re.compile(""))  # every text by patterns
        assert [autolink.auto_link(x, "n.md", titles) for x in texts] == want
    monkeypatch.setattr(autolink.re, "finditer", None)
    assert [autolink.auto_link(x, "n.md", titles) for x in texts] == want and want[0][1] == ["Sage tea", "Sage"]


def test_suggest_is_auto_link_over_all_titles(spark):
    rng = random.Random(11)
    parts = ["sage", "Sage", "basil", "BASIL", "thyme.", "(mint)", "ſage", "Épée", "épée", "İris", "x+++y", "+++", "a_b", "dill-weed", "`rue`", "rue", "[[sage]]", "cafe\u0301", "cafe", "½cup", "ß", "日本", "K", "kelvin", "https://a.b/rue", "\n", "```\n"]
    terms = ["sage", "Basil", "thyme", "mint", "Épée", "iris", "+++", "a_b", "dill-weed", "weed", "rue", "cafe", "cup", "½cup", "日本本", "kelvin", "sage basil", "(mint)", "x+++y"]
    titles = [(t, t.title() if i % 2 else t, f"wiki/t{i}.md") for i, t in enumerate(terms)]
    rows = [(f"wiki/n{i}.md" if i % 9 else f"raw/n{i}.md", " ".join(rng.choice(parts) for _ in range(rng.randint(0, 12)))) for i in range(400)] + [("wiki/t3.md", "mint"), ("wiki/e.md", None)]
    df, ts = spark.createDataFrame(rows, "rel string, content string"), spark.createDataFrame(titles, "term string, canonical string, rel string")
    got = {r.rel: (r.new_text, r.added) for r in autolink.suggest(df, ts, ["weed"]).collect()}
    order = sorted(titles)
    assert got == {rel: autolink.auto_link(c or "", rel, order, ["weed"]) for rel, c in rows}
    assert sum(bool(x[1]) for x in got.values()) > 150


def test_lint(spark, monkeypatch):
    files = {
        "index.md": "all: [[Sage]], [[Mint|cool]], wiki/concepts/Dill weed.md",
        "log.md": "## [2030-01-02] added | Sage and Dill weed, wiki/sources/seed list.md",
        "wiki/concepts/Sage.md": "with [[mint]] and [[concepts/Dill weed.md]] but no [[Tansy]]",
        "wiki/concepts/Mint.md": "[[Tansy]]",
        "wiki/concepts/Dill weed.md": "",
        "wiki/concepts/Rue.md": "alone",
        "wiki/sources/seed list.md": "from [[seeds]]",
        "raw/Seed List.md": "a source",
        "raw/other.md": "[[Nowhere]]",
        "README.md": "[[Nowhere]]",
    }
    n = notes(spark, files)
    want = [
        ("orphans", "wiki/concepts/Dill weed.md", None),
        ("orphans", "wiki/concepts/Rue.md", None),
        ("broken_wikilinks", "wiki/concepts/Mint.md", "Tansy"),
        ("broken_wikilinks", "wiki/concepts/Sage.md", "Tansy"),
        ("broken_wikilinks", "wiki/sources/seed list.md", "seeds"),
        ("wiki_pages_missing_from_index", "wiki/concepts/Rue.md", None),
        ("wiki_pages_missing_from_index", "wiki/sources/seed list.md", None),
        ("raw_without_source_summary", "raw/other.md", None),
        ("pages_never_logged", "wiki/concepts/Mint.md", None),
        ("pages_never_logged", "wiki/concepts/Rue.md", None),
    ]
    assert [tuple(r) for r in lint.lint(n).collect()] == [w for w in want if w[:2] != ("orphans", "wiki/concepts/Mint.md")]
    whole = [sorted(r.page for r in rule(n).collect()) for rule in (lint.missing_from_index, lint.never_logged)]
    monkeypatch.setattr(lint, "PIECE", 7)
    assert [sorted(r.page for r in rule(n).collect()) for rule in (lint.missing_from_index, lint.never_logged)] == whole
    assert lint.missing_from_index(n.where("rel <> 'index.md'")).count() == 5


# graphs


def brute_between(around):
    """Shares of all shortest paths, counted pair by pair."""
    def paths_from(s):
        dist, ways, queue = {s: 0}, defaultdict(int, {s: 1}), deque([s])
        while queue:
            v = queue.popleft()
            for w in around[v]:
                if w not in dist:
                    dist[w] = dist[v] + 1
                    queue.append(w)
                if dist[w] == dist[v] + 1:
                    ways[w] += ways[v]
        return dist, ways

    found = {s: paths_from(s) for s in around}
    sums = {}
    for v in around:
        sums[v] = sum(found[s][1][v] * found[v][1][t] / found[s][1][t] for s in around for t in around if s != v != t and s != t and t in found[s][0] and v in found[s][0] and t in found[v][0] and found[s][0][v] + found[v][0][t] == found[s][0][t])
    top = max(sums.values(), default=0)
    return {v: x / top if top else x for v, x in sums.items()}


def brute_communities(around):
    """Greedy moves with every sum made anew each time."""
    names = sorted(around)
    m = sum(a < b for a in around for b in around[a])
    own = {v: i for i, v in enumerate(names)}
    for _ in range(20):
        before = dict(own)
        for v in names:
            best, gain = own[v], 0.0
            for c in sorted({own[w] for w in around[v]} - {own[v]}):
                here = sum(own[w] == c for w in around[v]) / m - sum(len(around[w]) for w in names if own[w] == c) * len(around[v]) / (2 * m * m)
                if here > gain:
                    best, gain = c, here
            own[v] = best
        if own == before:
            break
    groups = defaultdict(set)
    for v, c in own.items():
        groups[c].add(v)
    for c in sorted((c for c in groups if len(groups[c]) < 3), key=lambda c: min(groups[c])):
        for v in sorted(groups[c]):
            near = Counter(own[w] for w in around[v] if own[w] != c)
            if near:
                to = min(near, key=lambda k: (-near[k], min(groups[k])))
                groups[c].discard(v)
                groups[to].add(v)
                own[v] = to
    sets = sorted((sorted(g) for g in groups.values() if g), key=lambda g: (-len(g), g[0]))
    return {v: (i, len(g), g[0]) for i, g in enumerate(sets) for v in g}


def random_links(seed, n=24, m=40):
    rng = random.Random(seed)
    links = [(f"p{rng.randrange(n):02d}", f"p{rng.randrange(n):02d}") for _ in range(m)] + [("q1", "q2"), ("q3", "q3"), ("p00", "p01"), ("p00", "p01")]
    around = defaultdict(set)
    for a, b in links:
        around[a].add(b)
        around[b].add(a)
    return links, around


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_graph_measures_against_brute_force(spark, seed):
    links, around = random_links(seed)
    rows = spark.createDataFrame(links, "src string, dst string")
    adj = edges.undirected(rows).persist()
    between = {r[0]: r[1] for r in graph.betweenness(adj).collect()}
    want = brute_between(around)
    assert between.keys() == want.keys() and all(abs(between[v] - want[v]) < 1e-9 for v in want)
    found = graph.communities(adj).persist()
    sets = brute_communities(around)
    assert {r.name: (r.community_id, r["size"], r.label) for r in found.collect()} == sets
    clusters = {r.id: (r["size"], r.label, r.members) for r in graph.cluster(found).collect()}
    members = defaultdict(list)
    for v in sorted(sets):
        members[sets[v][0]].append(v)
    assert clusters == {i: (len(ms), ms[0], ms) for i, ms in members.items()}
    heads = {r.id: (r["size"], r.label, r.members) for r in graph.cluster_heads(found, 3).collect()}
    assert heads == {i: (len(ms), ms[0], ms[:3]) for i, ms in members.items()}
    n = notes(spark, {f"{v}.md": "" for v in [*around, "lone"]})
    rank = {v: 1 / (len(around) + 1) for v in [*around, "lone"]}
    for _ in range(50):
        new = dict.fromkeys(rank, 0.15 / len(rank))
        for a, b in links:
            new[b] += 0.85 * rank[a] / sum(x == a for x, _ in links)
        rank = new
    rank = {v: x / max(rank.values()) for v, x in rank.items()}
    got = {r[0]: r[1] for r in graph.pagerank(n, rows).collect()}
    assert got.keys() == rank.keys() and all(abs(got[v] - rank[v]) < 1e-9 for v in rank)
    top = max(len(x) for x in around.values())
    score = {v: 0.4 * len(around[v]) / top + 0.3 * want[v] + 0.3 * rank[v] for v in around}
    order = sorted(score, key=lambda v: (-round(score[v], 9), v))[:15]
    hubs = graph.hubs(adj, graph.betweenness(adj), graph.pagerank(n, rows)).collect()
    assert sorted(h.name for h in hubs) == sorted(order) and all(abs(h.score - score[h.name]) < 1e-9 and h.degree == len(around[h.name]) for h in hubs)
    across = sorted(((want[a] + want[b], a, b) for a, b in links if sets[a][0] != sets[b][0]), reverse=True)
    got = graph.bridges(rows, found, graph.betweenness(adj)).collect()
    assert [round(r.score, 9) for r in got] == [round(x[0], 9) for x in across[:10]]
    assert all((r.source_community, r.target_community) == (sets[r.source][0], sets[r.target][0]) for r in got)
    assert {tuple(r) for r in edges.edge_list(adj).collect()} == {(a, b) for a in around for b in around[a] if a < b}


def test_walks(spark):
    links = spark.createDataFrame([("inn", "ford"), ("inn", "mill"), ("ford", "mill"), ("mill", "wood"), ("wood", "well")], "src string, dst string")
    adj = edges.undirected(links)
    n = notes(spark, {f"{x}.md": "" for x in ("inn", "ford", "mill", "wood", "well", "isle")})
    assert {r.note: r.distance for r in graph.traverse(n, adj, "inn", 2).collect()} == {"inn": 0, "ford": 1, "mill": 1, "wood": 2}
    assert [r[:] for r in graph.traverse(n, adj, "isle", 2).collect()] == [("isle", 0, [])] and graph.traverse(n, adj, "no", 2).count() == 0
    assert graph.shortest_path(adj, "inn", "well").first()[0] == ["inn", "mill", "wood", "well"]
    assert graph.shortest_path(adj, "inn", "isle").count() == 0 and graph.shortest_path(adj, "inn", "inn").first()[0] == ["inn"]
    assert {r.stem for r in edges.orphans(n, links, "lint").collect()} == {"isle"}


def test_shortest_path_query_without_a_path(spark, tmp_path):
    from notewright.plans.queries import QUERIES

    for k, html in enumerate(('<a href="x">', '<a href="page 0">')):
        pages = spark.createDataFrame([(0, "u0", '<a href="x">'), (48, "u48", html.replace("x", "y"))], "page_id long, url string, html string")
        pages.write.parquet(f"{tmp_path}/{k}/pages.parquet")
        got = [r.path for r in QUERIES["shortest_path"](spark, f"{tmp_path}/{k}").collect()]
        assert got == ([None], [["page 0", "page 48"]])[k]


def test_large_graph_ways_agree(spark, monkeypatch):
    rows = [(f"n{i}", f"n{(i * 7 + k) % 41}") for i in range(40) for k in (1, 5)]
    links = spark.createDataFrame(rows, "src string, dst string")
    n, adj = notes(spark, {f"n{i}.md": "" for i in range(41)}), edges.undirected(links)
    near = lambda df: {r[0]: round(r[1], 9) for r in df.collect()}
    want = near(graph.pagerank(n, links, 12)), near(graph.betweenness(adj))
    monkeypatch.setattr(graph, "small", lambda edges, most=0: False)
    assert (near(graph.pagerank(n, links, 12)), near(graph.betweenness(adj))) == want


def test_rounds_broadcast_nothing_and_coded_betweenness_is_used(spark, monkeypatch):
    rows = [(f"n{i}", f"n{(i * 7 + k) % 41}") for i in range(40) for k in (1, 5)]
    links = spark.createDataFrame(rows, "src string, dst string")
    monkeypatch.setattr(graph, "small", lambda edges, most=0: False)
    plan = graph.pagerank(notes(spark, {"n0.md": ""}), links, 2)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
    monkeypatch.setattr(graph, "small", lambda edges, most=200_000: most > 200_000)  # as a graph of more edges than SMALL
    monkeypatch.setattr(graph, "_betweenness_joins", None)
    got = {r[0]: r[1] for r in graph.betweenness(edges.undirected(links)).collect()}
    assert len(got) == 41 and max(got.values()) == 1.0


def test_sampled_sources_and_places(spark, monkeypatch):
    monkeypatch.setattr(graph, "EXACT_UP_TO", 10)
    monkeypatch.setattr(graph, "SAMPLES", 5)
    names = [f"v{i:03d}" for i in range(57)]
    adj = spark.createDataFrame([(a, b) for a, b in zip(names, names[1:] + names[:1], strict=True)], "u string, v string").repartition(7)
    assert sorted(r.name for r in graph.sources_of(adj).collect()) == names[::11][:5]
    assert {r.u: r.place for r in graph.placed(adj.select("u"), "u").collect()} == {x: i for i, x in enumerate(names)}


def test_communities_of_large_components(spark, monkeypatch):
    """Two dense rings and a thin bridge: the way by joins finds both, and leaves no community below three."""
    ring = lambda p: [(f"{p}{i}", f"{p}{j}") for i in range(8) for j in range(i)]
    adj = edges.undirected(spark.createDataFrame([*ring("a"), *ring("b"), ("a0", "b0"), ("b3", "tail"), ("x", "y")], "src string, dst string"))
    monkeypatch.setattr(graph, "KERNEL", 10)
    found = {r.name: r.label for r in graph.communities(adj).collect()}
    assert {found[f"a{i}"] for i in range(8)} == {"a0"} and {found[f"b{i}"] for i in range(8)} | {found["tail"]} == {"b0"} and found["x"] == found["y"] == "x"


def test_components_of_long_chains(spark):
    chain = spark.createDataFrame([(f"{i:04d}", f"{i + 1:04d}") for i in range(0, 300) if i != 150], "u string, v string")
    both = chain.unionAll(chain.select("v", "u"))
    assert {r.name: r.component for r in graph.components(both).collect()} == {f"{i:04d}": "0000" if i <= 150 else "0151" for i in range(301)}


# the engine


def test_engine_over_a_vault(spark, tmp_path):
    root = tmp_path / "garden"
    assert sinks.scaffold(str(root)) and not sinks.scaffold(str(root))
    (root / "wiki/concepts/Sweet Basil.md").write_text("---\naliases: [Ocimum]\n---\nA warm herb. [[Rue]]")
    (root / "wiki/concepts/Rue.md").write_text("Bitter. [[Sweet Basil]]")
    (root / ".git").mkdir()
    (root / ".git/x.md").write_text("hidden")
    e = Engine(spark, [str(root)])
    assert e.stats().first()["files"] == 5 and e.list("wiki/concepts") == ["wiki/concepts/Rue.md", "wiki/concepts/Sweet Basil.md"]
    assert e.search("warm herb").first()["rel"] == "wiki/concepts/Sweet Basil.md"
    assert e.write("wiki/entities/Bed.md", "On ocimum and rue, loamy soil.") == ["Sweet Basil", "Rue"]
    assert (root / "wiki/entities/Bed.md").read_text() == "On [[Sweet Basil|ocimum]] and [[Rue]], loamy soil." == e.read("wiki/entities/Bed.md")
    assert e.shortest_path("Bed", "Sweet Basil") == ["Bed", "Sweet Basil"] and e.stats().first()["files"] == 6
    assert e.search("loamy").first()["rel"] == "wiki/entities/Bed.md"  # the index has the new page
    e.write("wiki/entities/Bed.md", "Cleared.")
    assert [r.rel for r in e.search("cleared").collect()] == ["wiki/entities/Bed.md"] and "wiki/entities/Bed.md" not in {r.rel for r in e.search("[[Rue]]").collect()}
    with pytest.raises(PermissionError):
        e.write("./raw/x.md", "no")
    assert e.metadata("wiki/concepts/Rue.md") == "(no frontmatter)" and e.links("Rue.md").count() == 2
    assert e.suggest_links("log.md") == [] and e.cluster().count() == 1
    report = e.report(today="2030-05-06")
    assert report == (root / "GRAPH_REPORT.md").read_text() and "# Graph Report: garden" in report and "**Notes:** 6 | **Links:** 2 | **Communities:** 1 | **Orphans:** 4" in report
    page = (root / e.visualize()).read_text()
    assert "<canvas" in page and '{"from": "Rue", "to": "Sweet Basil"}' in page and not list(root.glob(".*.crc"))


def test_results_as_json(spark, tmp_path):
    (tmp_path / "wiki").mkdir()
    (tmp_path / "wiki/a.md").write_text("to [[b]] and [[gone]]")
    (tmp_path / "wiki/b.md").write_text("back, a\nline")
    (tmp_path / "wiki/c.md").write_text("x")
    e = Engine(spark, [str(tmp_path)])
    read = lambda op, **kw: json.loads(e.json(op, **kw))
    assert read("search", query="line") == [{"path": "wiki/b.md", "snippet": "back, a line", "score": e.json("search", query="line").split('"score": "')[1][:4]}]
    assert read("links", path="wiki/b.md") == {"path": "wiki/b.md", "outgoing": [], "backlinks": ["a"]}
    assert read("suggest_links", path="wiki/b.md") == {"path": "wiki/b.md", "suggestions": []}
    got = read("stats")
    assert (got["files"], got["links"], got["orphan_count"], got["orphans"], got["vaults"]) == (3, 2, 1, ["wiki/c.md"], [str(tmp_path)])
    assert read("traverse", start="b", depth=1) == [{"note": "b", "distance": 0, "neighbors": ["a"]}, {"note": "a", "distance": 1, "neighbors": ["b", "gone"]}]
    assert read("shortest_path", start="b", end="gone") == {"path": ["b", "a", "gone"]}
    assert read("cluster") == {"communities": [{"id": 0, "size": 3, "label": "a", "members": ["a", "b", "gone"]}], "assignments": {"a": 0, "b": 0, "gone": 0}}
    assert read("lint")["broken_wikilinks"] == [{"page": "wiki/a.md", "target": "gone"}] and read("lint")["orphans"] == ["wiki/c.md"]
    assert e.json("list", directory="wiki") == "wiki/a.md\nwiki/b.md\nwiki/c.md" and e.json("read", path="wiki/c.md") == "x"
    assert e.json("traverse", start="zz").startswith("No note") and e.json("shortest_path", start="c", end="a").startswith("No path")
    assert e.json("read", path="no.md").startswith("Error") and e.json("write", path="raw/x.md", content="").startswith("Error")
    assert e.json("write", path="wiki/d.md", content="é") == "Written: wiki/d.md (2 bytes)"


def test_first_root_wins(spark, tmp_path):
    for i, body in enumerate(("---\nk: first\n---\none", "---\nk: second\n---\ntwo")):
        (tmp_path / f"r{i}").mkdir()
        (tmp_path / f"r{i}/same.md").write_text(body)
    (tmp_path / "r1/only.md").write_text("there")
    e = Engine(spark, [str(tmp_path / "r0"), str(tmp_path / "r1")])
    assert e.metadata("same.md") == "k: first" and e.read("same.md").endswith("one") and e.read("only.md") == "there"
    assert [r.rel for r in e.search("two").collect()] == [] and e.list() == [str(tmp_path / "r0"), str(tmp_path / "r1")]
    e.write("only.md", "changed")
    assert (tmp_path / "r1/only.md").read_text() == "changed" and not (tmp_path / "r0/only.md").exists()


def test_visual_rows(spark):
    links = spark.createDataFrame([("a", "b"), ("a", "b"), ("c", "b"), ("d", "e")], "src string, dst string")
    found = graph.communities(edges.undirected(links))
    hubs = spark.createDataFrame([("b", 0.5)], "name string, score double")
    rows = {r.name: r[1:] for r in sinks.graph_nodes(edges.multi_degree(links), found, hubs).collect()}
    assert rows["b"] == (0, 0.5, 3) and rows["a"] == (0, 0.0, 2) and rows["d"][0] == 1
    labels = {r[0]: r[1] for r in sinks.group_labels(sinks.graph_nodes(edges.multi_degree(links), found, hubs)).collect()}
    assert labels == {0: "b", 1: "e"}
    page = "".join(sinks.render_graph([("</x>", 0, 0.25, 3)], [("a", '"')], {0: "<b>"}, "T & U"))
    assert "T &amp; U" in page and "\\u003c/x>" in page and '"to": "\\""' in page and "&lt;b&gt;" in page


# streams


def test_stream_keeps_the_newest(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(maintain, "BUCKETS", 4)
    keeper = maintain.Maintainer(spark, str(tmp_path / "t"))
    make = lambda rows: spark.createDataFrame(rows, maintain.SCHEMA)
    keeper.apply(make([("a.md", "a", "one [[b]]", 1, False), ("b.md", "b", "x", 1, False)]), 0)
    assert keeper.links().collect()[0][:] == ("a", "b", 0)
    keeper.apply(make([("a.md", "a", "two", 2, False), ("b.md", "b", "", 2, True)]), 1)
    keeper.apply(make([("a.md", "a", "old", 1, False)]), 2)
    keeper.apply(make([("a.md", "a", "old", 1, False)]), 2)
    assert [r[:] for r in keeper.notes().collect()] == [("a.md", "a", "two")] and keeper.links().count() == 0
    assert {r.term: r.df for r in keeper.document_frequency().collect()} == {"two": 1}


def test_stream_tasks_take_a_bounded_share(spark, tmp_path, monkeypatch):
    from notewright.plans import queries

    made = []
    monkeypatch.setattr(queries, "fresh_path", lambda *_: made.append(f"{tmp_path}/s{len(made)}") or made[-1])
    docs = spark.createDataFrame([(i, f"sage mint{i % 7} rue", "a") for i in range(90)], "doc_id long, text string, source string")
    docs.write.parquet(f"{tmp_path}/d/documents.parquet")
    monkeypatch.setattr(queries, "BATCH_FILE", 200, raising=False)
    monkeypatch.setattr(maintain, "SHARE", 100, raising=False)
    got = {r.term: r.df for r in queries.QUERIES["stream_document_frequency"](spark, f"{tmp_path}/d").collect()}
    assert got["sage"] == got["rue"] == 90 and got["mint0"] == 13
    assert len(list((tmp_path / "s0/in").glob("*.parquet"))) > 6 and len(list((tmp_path / "s0/table").glob("v*"))) == 3


def test_stream_equals_the_batch(spark, tmp_path):
    rng, keeper = random.Random(9), maintain.Maintainer(spark, str(tmp_path / "t"))
    state = {}
    for batch in range(6):
        rows = []
        for i in rng.sample(range(40), 8):
            body = None if rng.random() < 0.2 else " ".join(rng.choice([*HERBS, "[[sage]]"]) for _ in range(6))
            rows.append((f"{i}.md", str(i), body or "", batch, body is None))
            state[f"{i}.md"] = body
        df = spark.createDataFrame(rows, maintain.SCHEMA)
        keeper.apply(df, batch)
        if batch % 2:
            keeper.apply(df, batch)  # a batch that runs again
    living = {k: v for k, v in state.items() if v is not None}
    assert {r.rel: r.content for r in keeper.notes().collect()} == living
    assert {r.term: r.df for r in keeper.document_frequency().collect()} == Counter(t for v in living.values() for t in set(v.split()))
    assert keeper.links().count() == sum(v.count("[[") for v in living.values())
    kept = [len(v) for v in keeper._versions().values()]
    assert max(kept) <= 2


def test_shared_folder_is_asked_of_a_cluster(spark):
    class Cluster:
        master = "spark://host:7077"

        def getConf(self):
            return self

        def get(self, *_):
            return None

    class Session:
        sparkContext = Cluster()
        conf = Cluster()

    with pytest.raises(RuntimeError):
        shared.shared_dir(Session())
    mark = shared.written()
    one, two = (shared.materialise(spark.range(3), "t") for _ in range(2))
    shared.drop_since(mark, two)
    assert two.count() == 3 and shared.written() == mark + 1
    with pytest.raises(Exception, match="(?s)."):
        one.count()


def test_entry_has_every_query():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and "search_bm25_top20" in e.queries()
