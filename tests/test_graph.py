import random

import pytest

from skeinwork.operators import backedges, wavefront
from skeinwork.operators import graph as g
from skeinwork.storage import cut


def graph(spark, names, pairs):
    nodes = spark.createDataFrame([(n, i) for i, n in enumerate(names)], "node_id string, node_pos long")
    edges = spark.createDataFrame([(a, b, i) for i, (a, b) in enumerate(pairs)], "src string, dst string, edge_pos long")
    return nodes, edges


APP = "auth user db config cache logger api email".split()
APP_EDGES = [tuple(x.split(">")) for x in "auth>db auth>config auth>logger auth>cache user>db user>config user>auth api>auth api>user api>config api>logger db>config cache>db email>config email>logger email>auth".split()]
RAW = {"auth": 0.034488, "user": 0.022734, "db": 0.054687, "config": 0.088301, "cache": 0.026079, "logger": 0.035376, "api": 0.018750, "email": 0.018750}


@pytest.fixture(params=["one task", "rounds"])
def way(request, monkeypatch):
    """Small graphs in one task, and the same graphs as large ones go."""
    if request.param == "rounds":
        monkeypatch.setattr(g, "TASK_EDGES", -1)


def test_pagerank_of_an_application(spark, way):
    rows = g.pagerank(*graph(spark, APP, APP_EDGES)).collect()
    assert {r.node_id: round(r.raw, 6) for r in rows} == pytest.approx(RAW, abs=1e-6)
    assert max(r.score for r in rows) == 1.0


def test_degrees_of_a_line_and_of_nothing(spark):
    rows = {r.node_id: (r.in_degree, r.out_degree, r.total_degree) for r in g.degree_centrality(*graph(spark, "abc", [("a", "b"), ("b", "c")])).collect()}
    assert rows == {"a": (0, 1, 1), "b": (1, 1, 2), "c": (1, 0, 1)}
    nodes, edges = graph(spark, "a", [])
    assert g.degree_centrality(nodes, edges).first().normalized == 0.0
    none = g.degree_stats(g.degree_centrality(nodes.limit(0), edges)).first()
    assert (none.max_in, none.avg_in, none.median_in) == (0, 0.0, None)


def test_two_triangles(spark, way):
    pairs = [("a1", "a2"), ("a2", "a3"), ("a3", "a1"), ("b1", "b2"), ("b2", "b3"), ("b3", "b1"), ("a3", "b1")]
    nodes, edges = graph(spark, ["a1", "a2", "a3", "b1", "b2", "b3"], pairs)
    groups = {}
    for r in g.communities(nodes, edges).collect():
        groups.setdefault(r.seed, set()).add(r.node_id)
    assert sorted(map(sorted, groups.values())) == [["a1", "a2", "a3"], ["b1", "b2", "b3"]]
    assert sorted(r.members for r in g.cycles(nodes, edges).collect()) == [["a1", "a2", "a3"], ["b1", "b2", "b3"]]


@pytest.mark.parametrize(("pairs", "lengths", "severities"), [
    ([("a", "b"), ("b", "a")], [2], ["CRITICAL"]),
    ([("a", "b"), ("b", "c"), ("c", "a")], [3], ["HIGH"]),
    ([("a", "a")], [1], ["HIGH"]),
    ([("a", "b"), ("b", "c")], [], []),
])
def test_cycles(spark, pairs, lengths, severities):
    rows = g.cycles(*graph(spark, "abc", pairs)).collect()
    assert ([r.length for r in rows], [r.severity for r in rows]) == (lengths, severities)


def test_strong_components_against_reachability(spark, way):
    rng = random.Random(5)
    names = [f"v{i}" for i in range(12)]
    pairs = [(rng.choice(names), rng.choice(names)) for _ in range(22)]
    reach = {(a, b) for a, b in pairs}
    while len(more := reach | {(a, d) for a, b in reach for c, d in reach if b == c}) > len(reach):
        reach = more
    ends = {x for p in pairs for x in p}
    want = {v: min([u for u in ends if (u, v) in reach and (v, u) in reach] + [v]) for v in ends}
    got = {r.node_id: r.scc for r in g.strong_components(graph(spark, names, pairs)[1]).collect()}
    assert got == want


def test_fanout(spark):
    _, edges = graph(spark, ["auth", "api", "ui"], [("api", "auth"), ("ui", "auth"), ("web", "ui")])
    seeds = spark.createDataFrame([("auth", "auth")], "seed string, node_id string")
    assert g.dependent_fanout(edges, seeds).first().dependents == 3


def test_surprise_rules_in_order(spark):
    nodes, edges = graph(spark, ["auth", "db", "legacy/old", "x/a", "b"], [("auth", "db"), ("auth", "legacy/old"), ("auth", "db"), ("db", "legacy/old"), ("x/a", "b")])
    members = spark.createDataFrame([("auth", "c1"), ("db", "c2"), ("legacy/old", "c2")], "node_id string, community string")
    calls = edges.selectExpr("*", "'calls' AS type")
    got = {(r.src, r.dst): r.reason for r in g.surprises(calls, members).collect()}
    assert got == {("auth", "db"): "cross-community", ("auth", "legacy/old"): "cross-community", ("db", "legacy/old"): "legacy", ("x/a", "b"): "unexpected"}


def random_graph(seed, n=14, m=30):
    rng = random.Random(seed)
    names = [f"v{i}" for i in range(n)]
    rng.shuffle(names)
    return names, [(rng.choice(names), rng.choice(names)) for _ in range(m)]


def cycles_by_recursion(names, pairs):
    """Cycles in the order in which a search closes them."""
    found, seen = [], set()

    def visit(v, path):
        seen.add(v)
        for a, b in pairs:
            if a == v and b in path:
                found.append(path[path.index(b) :])
            elif a == v and b not in seen:
                visit(b, [*path, b])

    for v in names:
        if v not in seen:
            visit(v, [v])
    return found


@pytest.mark.parametrize("seed", [1, 2])
def test_back_edges_by_recursion(spark, seed):
    names, pairs = random_graph(seed)
    got = g.cycles(*graph(spark, names, pairs)).orderBy("found").collect()
    assert [r.members for r in got] == cycles_by_recursion(names, pairs)


@pytest.mark.parametrize("seed", [3])
def test_back_edges_by_strong_components(spark, monkeypatch, seed):
    """Many strong components in a row and beside each other, with strangers as endpoints; entered where the whole search enters them."""
    rng = random.Random(seed)
    names, pairs = [f"v{i}" for i in range(30)], []
    rng.shuffle(names)
    for at in range(0, 27, 4):
        pairs += [(rng.choice(names[at : at + 4]), rng.choice(names[at : at + 4])) for _ in range(6)]
        pairs += [(rng.choice(names[: at + 4]), rng.choice(names[at:])) for _ in range(3)]
    pairs += [(names[0], "stranger"), ("stranger", names[9]), ("unseen", names[1]), ("unseen", "unseen"), (names[2], "loop"), ("loop", "loop")]
    rng.shuffle(pairs)
    order = sorted(names)
    monkeypatch.setattr(backedges, "BLOCK_EDGES", 0)
    nodes, edges = (cut(t) for t in graph(spark, order, pairs))
    got = g.cycles(nodes, edges).orderBy("found").collect()
    assert [r.members for r in got] == cycles_by_recursion(order, pairs) and len(got) > 8
    assert all(order[r.root_pos] == r.root for r in got)


def moves_by_definition(names, pairs, passes=10):
    """{node: (home, pass of its last move)}."""
    near = {v: [] for v in names}
    for a, b in pairs:
        for x, y in ((a, b), (b, a)):
            if x in near and y not in near[x]:
                near[x].append(y)
    home, last = {v: v for v in names}, dict.fromkeys(names, 0)
    for done in range(1, passes + 1):
        before = dict(last)
        for v in names:
            options = []
            for u in near[v]:
                if u in home and home[u] != home[v] and home[u] not in [c for c, _ in options]:
                    inside = sum(home.get(w) == home[u] for w in near[v])
                    options.append((home[u], inside - 0.5 * (len(near[v]) - inside)))
            best = max((x for _, x in options), default=0)
            if best > 1e-10:
                home[v], last[v] = next(c for c, x in options if x == best), done
        if last == before:
            break
    return {v: (home[v], last[v]) for v in names}


@pytest.mark.parametrize("seed", [4, 5])
def test_communities_by_definition(spark, seed):
    names, pairs = random_graph(seed, 16, 18)
    got = {r.node_id: (r.seed, r.joined) for r in g.communities(*graph(spark, names, pairs)).collect()}
    assert got == moves_by_definition(names, pairs)


@pytest.mark.parametrize(("seed", "n", "m", "most"), [(1, 24, 30, 14), (4, 12, 20, 0)])
def test_label_moves_over_many_blocks(spark, seed, n, m, most):
    """One component over many blocks and with a hub, and all nodes as hubs."""
    names, pairs = random_graph(seed, n, m)
    pairs += [(names[0], x) for x in names[1:]] + [("stranger", names[1]), (names[2], "stranger"), (names[3], names[3])]
    nodes, edges = (cut(t) for t in graph(spark, names, pairs))
    got = {r.node_id: (r.seed, r.moved) for r in wavefront.label_moves(nodes, edges, passes=3, block_edges=most).collect()}
    assert got == moves_by_definition(names, pairs, passes=3)


def test_blocks_are_bounded(spark):
    names, pairs = random_graph(6, 300, 900)
    near = wavefront.neighbours(*graph(spark, names, [*pairs, *((names[0], x) for x in names)])).cache()
    rows = wavefront.blocks(near, 40).collect()
    sums = {}
    for r in rows:
        sums[r.block] = sums.get(r.block, 0) + r.degree
    assert [r.node for r in rows if r.block == -1] == [names[0]] and len(sums) > 20
    assert max(n for b, n in sums.items() if b >= 0) <= 40
    pos = {v: i for i, v in enumerate(names)}
    spans = sorted((min(pos[r.node] for r in rows if r.block == b), max(pos[r.node] for r in rows if r.block == b)) for b in sums if b >= 0)
    assert all(a[1] < b[0] for a, b in zip(spans, spans[1:], strict=False))


def test_fingerprint_follows_content_only(spark):
    nodes, edges = graph(spark, "abc", [("a", "b"), ("b", "c")])
    mark = lambda n, e: g.fingerprint(n, e).first().fingerprint
    assert mark(nodes, edges) == mark(nodes.orderBy("node_id", ascending=False), edges.orderBy("dst", ascending=False))
    assert len({mark(nodes, edges), mark(nodes.limit(2), edges), mark(nodes, edges.limit(1)), mark(nodes, edges.selectExpr("dst AS src", "src AS dst", "edge_pos"))}) == 4


def test_cache_of_graphs(spark, tmp_path):
    from skeinwork.operators import analysis

    root = f"file://{tmp_path}/graphs"
    nodes, edges = graph(spark, "abc", [("a", "b"), ("b", "c")])
    assert analysis.load_graph(spark, root, nodes, edges) is None
    parts = analysis.assembled(nodes, edges)
    analysis.save_graph(nodes, edges, root, metrics=parts["metrics"], cycles=parts["cycles"])
    held = analysis.load_graph(spark, root, nodes, edges)
    assert held["metrics"].first().total_edges == 2 and held["cycles"].count() == 0
    assert analysis.load_graph(spark, root, nodes, edges.limit(1)) is None
    assert analysis.drop_graphs(spark, root) == 1 and analysis.load_graph(spark, root, nodes, edges) is None


def test_prioritised_map(spark):
    from skeinwork.operators import analysis

    areas = spark.createDataFrame([("Auth", "c1", 3)], "label string, community string, size long")
    hubs = spark.createDataFrame([("login", "CRITICAL", 30, "c1")], "label string, criticality string, in_degree long, community string")
    out = analysis.prioritised_map("src/", areas, hubs)
    assert out.index("Auth") < out.index("login") < out.index("src/")
    assert analysis.prioritised_map("src/", areas.limit(0), hubs.limit(0)) == "src/" and analysis.prioritised_map(" ", areas, hubs) == " "


@pytest.mark.parametrize("seed", [6, 7, 8])
def test_clustering_by_definition(spark, seed):
    names, pairs = random_graph(seed, 10, 24)
    near = {v: {b for a, b in pairs if a == v} | {a for a, b in pairs if b == v} for v in names}
    shares = []
    for v in names:
        k = len(near[v])
        if k >= 2:
            shares.append(sum(b in near[a] for a in near[v] for b in near[v] if a < b) / (k * (k - 1) / 2))
    got = g.average_clustering(*graph(spark, names, pairs)).first().clustering
    assert got == pytest.approx(sum(shares) / len(shares))


def test_places_over_ranges(spark):
    from skeinwork.operators.ranking import first, placed

    rng = random.Random(3)
    rows = [(i, rng.randrange(40)) for i in range(500)]
    df = spark.createDataFrame(rows, "i long, x long").repartition(7)
    order = {i: n for n, (_, i) in enumerate(sorted((-x, i) for i, x in rows), 1)}
    got = {r.i: r.place for r in placed(df, "place", df.x.desc(), "i").collect()}
    assert got == order and placed(df.limit(0), "place", "i").count() == 0
    assert {r.i: r.place for r in first(df, 9, "place", df.x.desc(), df.i).collect()} == {i: n for i, n in order.items() if n <= 9}


def test_gods_and_symbols_by_definition(spark):
    from skeinwork.operators import retrieval

    rng = random.Random(2)
    word = lambda: "".join(rng.choice("aBc") for _ in range(rng.randrange(0, 8)))
    labels, symbols = {word() for _ in range(25)}, {word() for _ in range(40)}
    near = lambda a, b: a == b or len(b) >= 4 and b in a or len(a) >= 4 and a in b
    want = {(x, y) for x in labels for y in symbols if near(x.lower(), y.lower())}
    make = lambda rows, c: spark.createDataFrame([(r,) for r in rows], f"{c} string")
    assert {tuple(r) for r in retrieval.god_matches(make(labels, "label"), make(symbols, "symbol")).collect()} == want


def test_pagerank_both_ways(spark, monkeypatch):
    names, pairs = random_graph(9, 20, 60)
    nodes, edges = graph(spark, names, [*pairs, (names[0], "nowhere"), ("elsewhere", names[1])])
    look = lambda: {r.node_id: (r.raw, r.score) for r in g.pagerank(nodes, edges, iterations=7, tolerance=0).collect()}
    one = look()
    monkeypatch.setattr(g, "TASK_EDGES", -1)
    assert {k: pytest.approx(v) for k, v in look().items()} == one
    assert g.pagerank(nodes.limit(0), edges).count() == 0


def test_weak_components_both_ways(spark, monkeypatch):
    names, pairs = random_graph(10, 40, 28)
    nodes, edges = graph(spark, names, pairs)
    look = lambda: {tuple(r) for r in g.connected_components(nodes, edges).collect()}
    one = look()
    monkeypatch.setattr(g, "TASK_EDGES", -1)
    assert look() == one


def test_cycle_report(spark):
    from skeinwork.operators import reports

    nodes, edges = graph(spark, "abcd", [("a", "b"), ("b", "a"), ("c", "d"), ("d", "c")])
    text = reports.cycle_report(g.cycles(nodes, edges), g.strong_components(edges)).first().report
    assert text == "Cycle Detection Report\n" + "=" * 40 + "\nHas Cycles: YES\nTotal Cycles: 2\nNodes in Cycles: 4\nStrongly Connected Components: 2\n\nTop Cycles:\n  1. [CRITICAL] Length 2: a → b\n  2. [CRITICAL] Length 2: c → d"
    none = edges.limit(0)
    assert "Has Cycles: NO\nTotal Cycles: 0" in reports.cycle_report(g.cycles(nodes, none), g.strong_components(none)).first().report
