"""Graph queries over the trade, hierarchy, flow and web views."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graph as g
from ..sources import tables as v

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

TRADE = """WITH pairs AS (
  SELECT c_nationkey AS s, s_nationkey AS d, count(*) AS n FROM lineitem JOIN supplier ON l_suppkey = s_suppkey
  JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2),
ranked AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY n DESC, d) AS r FROM pairs),
edges AS (SELECT 'n' || s AS src, 'n' || d AS dst, s::BIGINT * 3 + r - 1 AS edge_pos, n::DOUBLE AS weight FROM ranked WHERE r <= 3),
nodes AS (SELECT 'n' || n_nationkey AS node_id, n_nationkey::BIGINT AS node_pos FROM nation),
deg AS (SELECT node_id, node_pos, (SELECT count(*) FROM edges WHERE dst = node_id) AS in_degree, (SELECT count(*) FROM edges WHERE src = node_id) AS out_degree FROM nodes),
degrees AS (SELECT *, in_degree + out_degree AS total_degree FROM deg),
und AS (SELECT src AS a, dst AS b FROM edges UNION SELECT dst, src FROM edges),
member AS (SELECT 'n' || n_nationkey AS node_id, 'r' || n_regionkey AS community FROM nation)
"""


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return add


def rounded(df: DataFrame, *cols: str, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if c in cols else F.col(c) for c in df.columns])


def degrees(spark, d):
    return g.degree_centrality(*v.trade(spark, d))


@query("g_view_trade", TRADE + "SELECT src, dst, edge_pos, weight FROM edges")
def _(spark, d):
    return v.trade(spark, d)[1]


@query("a01_degree_centrality", TRADE + "SELECT node_id, in_degree::BIGINT AS in_degree, out_degree::BIGINT AS out_degree, total_degree::BIGINT AS total_degree, round(total_degree / max(total_degree) OVER (), 6) AS normalized FROM degrees")
def _(spark, d):
    return rounded(degrees(spark, d), "normalized").drop("node_pos")


_stats = ", ".join(f"max({k}_degree)::BIGINT AS max_{k}, round(avg({k}_degree), 6) AS avg_{k}, round(median({k}_degree), 6) AS median_{k}" for k in ("in", "out", "total"))


@query("a02_degree_stats", TRADE + f"SELECT {_stats} FROM degrees")
def _(spark, d):
    out = g.degree_stats(degrees(spark, d))
    return rounded(out, *[c for c in out.columns if c[:3] != "max"])


_metrics = "SELECT n AS total_nodes, m AS total_edges, round(m / (n * (n - 1)), 6) AS density, round(m / (n * (n - 1) / 2), 6) AS undirected_density, round(2 * m / n, 6) AS average_degree FROM (SELECT (SELECT count(*) FROM nodes) AS n, (SELECT count(*) FROM edges) AS m)"


@query("a06_graph_metrics", TRADE + _metrics)
def _(spark, d):
    return rounded(g.graph_metrics(*v.trade(spark, d)), "density", "undirected_density", "average_degree")


@query("a07_undirected_density", TRADE + "SELECT round((SELECT count(*) FROM edges) / (n * (n - 1) / 2), 6) AS undirected_density FROM (SELECT count(*) AS n FROM nodes)")
def _(spark, d):
    return rounded(g.graph_metrics(*v.trade(spark, d)).select("undirected_density"), "undirected_density")


@query("a08_clustering", TRADE + """, k AS (SELECT a, count(*) AS k FROM und GROUP BY 1 HAVING count(*) >= 2),
tri AS (SELECT x.a, count(*) AS t FROM und x JOIN und y ON x.a = y.a AND x.b < y.b JOIN und z ON z.a = x.b AND z.b = y.b GROUP BY 1)
SELECT round(avg(coalesce(t, 0) / (k * (k - 1) / 2)), 6) AS clustering FROM k LEFT JOIN tri USING (a)""")
def _(spark, d):
    return rounded(g.average_clustering(*v.trade(spark, d)), "clustering")


def _rank_sql(k: int) -> str:
    ctes = [", outs AS (SELECT src, count(*) AS o FROM edges GROUP BY 1), r0 AS (SELECT node_id, node_pos, 1.0::DOUBLE / (SELECT count(*) FROM nodes) AS r FROM nodes)"]
    for i in range(1, k + 1):
        ctes.append(f"r{i} AS (SELECT n.node_id, n.node_pos, 0.15::DOUBLE / (SELECT count(*) FROM nodes) + 0.85::DOUBLE * coalesce(s.x, 0) AS r FROM nodes n LEFT JOIN (SELECT e.dst, sum(p.r / o.o) AS x FROM edges e JOIN r{i - 1} p ON p.node_id = e.src JOIN outs o ON o.src = e.src GROUP BY 1) s ON s.dst = n.node_id)")
    return TRADE + ", ".join(ctes) + f", ranks AS (SELECT node_id, node_pos, r AS raw, r / max(r) OVER () AS score FROM r{k})\n"


RANKS = _rank_sql(10)


def ranks(spark, d):
    return g.pagerank(*v.trade(spark, d), iterations=10, tolerance=0)


@query("g01_pagerank_k10", RANKS + "SELECT node_id, round(raw, 6) AS raw, round(score, 6) AS score FROM ranks")
def _(spark, d):
    return rounded(ranks(spark, d), "raw", "score").drop("node_pos")


@query("g01_pagerank_converged")
def _(spark, d):
    return rounded(g.pagerank(*v.trade(spark, d)), "raw", "score")


@query("a03_pagerank_stats", RANKS + "SELECT round(max(score), 6) AS max_score, round(min(score), 6) AS min_score, round(avg(score), 6) AS avg_score, round(median(score), 6) AS median_score, round(stddev_pop(score), 6) AS std_score, round((SELECT score FROM (SELECT score, row_number() OVER (ORDER BY score) AS i, count(*) OVER () AS n FROM ranks) WHERE i = greatest(1, ceil(0.95 * n))), 6) AS p95_score FROM ranks")
def _(spark, d):
    out = g.pagerank_stats(ranks(spark, d))
    return rounded(out, *out.columns)


@query("g02_god_nodes_pagerank", RANKS + "SELECT node_id, round(score, 6) AS score FROM ranks WHERE score >= 0.1")
def _(spark, d):
    return rounded(g.gods_by_pagerank(ranks(spark, d)), "score").select("node_id", "score")


@query("g03_combined_importance", RANKS + "SELECT d.node_id, round(0.4 * d.total_degree / (SELECT max(total_degree) FROM degrees) + 0.6 * r.score, 6) AS importance FROM degrees d JOIN ranks r USING (node_id)")
def _(spark, d):
    return rounded(g.combined_importance(degrees(spark, d), ranks(spark, d)), "importance").drop("node_pos")


@query("g04_god_nodes_indegree", TRADE + "SELECT node_id, in_degree::BIGINT AS in_degree FROM degrees WHERE in_degree >= 3")
def _(spark, d):
    return g.gods_by_degree(degrees(spark, d)).select("node_id", "in_degree")


@query("g04_bottlenecks", TRADE + "SELECT node_id, out_degree::BIGINT AS out_degree FROM degrees WHERE out_degree >= 3")
def _(spark, d):
    return g.bottlenecks_by_degree(degrees(spark, d), 3).select("node_id", "out_degree")


@query("g04_rank_by_in_degree", TRADE + "SELECT node_id, in_degree::BIGINT AS in_degree FROM degrees ORDER BY in_degree DESC, node_pos LIMIT 10")
def _(spark, d):
    return g.rank_by_in_degree(degrees(spark, d)).select("node_id", "in_degree")


@query("g05_connectivity_top10pct", TRADE + """, c AS (SELECT node_id, total_degree AS connectivity, (SELECT count(*) FROM edges WHERE src = dst AND src = node_id) AS loops FROM degrees)
SELECT node_id, connectivity::BIGINT AS connectivity, place::INTEGER AS place, round((connectivity - loops) / 25, 6) AS centrality, 0.5::DOUBLE AS influence FROM (SELECT *, row_number() OVER (ORDER BY connectivity DESC, node_id) AS place FROM c) WHERE place <= ceil(0.1 * 25)""")
def _(spark, d):
    return rounded(g.gods_by_connectivity(*v.trade(spark, d)), "centrality")


@query("g06_criticality", TRADE + "SELECT node_id, CASE WHEN in_degree > 20 THEN 'CRITICAL' WHEN in_degree > 10 THEN 'IMPORTANT' ELSE 'NORMAL' END AS criticality FROM degrees")
def _(spark, d):
    return degrees(spark, d).select("node_id", g.criticality().alias("criticality"))


@query("g07_assembled_bottlenecks", "WITH e AS (SELECT 'n' || n_nationkey AS src, count(*) AS n FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY 1) SELECT src AS node_id, 0.0::DOUBLE AS betweenness, n AS dependent_count FROM e WHERE n > 10")
def _(spark, d):
    edges = v.hierarchy(spark, d).filter("src LIKE 'c%'").select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    nodes = v.trade(spark, d)[0]
    return g.assembled_bottlenecks(g.degree_centrality(nodes, edges))


WEB = """WITH RECURSIVE links AS (SELECT page_id, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS path FROM pages),
edges AS (SELECT 'p' || page_id AS src, path AS dst FROM links),
ids AS (SELECT 'p' || page_id AS v, page_id AS pos FROM pages UNION ALL SELECT DISTINCT dst, NULL FROM edges),
und AS (SELECT src AS a, dst AS b FROM edges UNION SELECT dst, src FROM edges),
reach AS (SELECT v, pos AS r FROM ids WHERE pos IS NOT NULL UNION SELECT und.b, reach.r FROM reach JOIN und ON reach.v = und.a),
comp AS (SELECT ids.v AS node_id, 'p' || min(r) AS component FROM ids LEFT JOIN reach USING (v) GROUP BY 1)
"""


@query("g08_components", WEB + "SELECT node_id, component FROM comp")
def _(spark, d):
    return g.connected_components(*v.web(spark, d))


@query("g08_cohesion", WEB + "SELECT component, count(*) AS size, round((SELECT count(*) FROM edges JOIN comp c2 ON c2.node_id = src WHERE c2.component = comp.component) / (count(*) * (count(*) - 1) / 2), 9) AS cohesion FROM comp GROUP BY component HAVING count(*) > 1")
def _(spark, d):
    nodes, edges = v.web(spark, d)
    return rounded(g.cohesion(g.connected_components(nodes, edges), edges), "cohesion", digits=9)


@query("g09_communities")
def _(spark, d):
    return g.communities(*v.trade(spark, d))


@query("g09_membership_total", "SELECT count(*) AS nodes FROM nation")
def _(spark, d):
    return g.communities(*v.trade(spark, d)).agg(F.count_distinct("node_id").alias("nodes"))


PROFILES = TRADE + """, placed AS (SELECT e.*, a.community AS cs, b.community AS cd FROM edges e LEFT JOIN member a ON a.node_id = src LEFT JOIN member b ON b.node_id = dst),
profiles AS (SELECT community, count(*) AS size, (SELECT count(*) FROM placed WHERE cs = community AND cd = community) AS internal_edges, (SELECT count(*) FROM placed WHERE (cs = community) <> (cd = community)) AS external_edges FROM member GROUP BY 1),
dens AS (SELECT *, CASE WHEN size > 1 THEN internal_edges / (size * (size - 1)) ELSE 0 END AS internal_density, CASE WHEN external_edges > 0 THEN external_edges / (size * (25 - size)) ELSE 0 END AS external_density FROM profiles)
"""


def profiles(spark, d):
    return g.community_profiles(v.regions(spark, d), *v.trade(spark, d))


@query("g10_profiles", PROFILES + "SELECT community, size, internal_edges, external_edges, round(internal_density, 6) AS internal_density, round(external_density, 6) AS external_density FROM dens")
def _(spark, d):
    return rounded(profiles(spark, d), "internal_density", "external_density")


@query("g10_interface_nodes", PROFILES + "SELECT community, node_id, min(edge_pos) AS first_edge FROM (SELECT cs AS community, src AS node_id, edge_pos FROM placed WHERE cs <> cd UNION ALL SELECT cd, dst, edge_pos FROM placed WHERE cs <> cd) GROUP BY 1, 2")
def _(spark, d):
    return g.interface_nodes(v.regions(spark, d), v.trade(spark, d)[1])


@query("g10_community_bottlenecks", TRADE + """, inner_ AS (SELECT m.node_id, m.community, count(n.node_id) AS inner_degree FROM member m LEFT JOIN und ON und.a = m.node_id LEFT JOIN member n ON n.node_id = und.b AND n.community = m.community GROUP BY 1, 2)
SELECT community, node_id, inner_degree FROM (SELECT *, avg(inner_degree) OVER (PARTITION BY community) AS mean FROM inner_) WHERE inner_degree > 1.5 * mean""")
def _(spark, d):
    return g.community_bottlenecks(v.regions(spark, d), v.trade(spark, d)[1])


@query("g11_modularity", PROFILES + "SELECT round(greatest(0, sum(internal_edges / (SELECT count(*) FROM edges) - 0.1 * pow(size / 25, 2))), 6) AS modularity FROM profiles")
def _(spark, d):
    return rounded(g.modularity(profiles(spark, d), *v.trade(spark, d)), "modularity")


@query("a04_community_stats", PROFILES + "SELECT count(*) AS count, " + ", ".join(f"round({f}({c}), 6)::DOUBLE AS {f}_{n}" for n, c in (("size", "size"), ("density", "internal_density")) for f in ("avg", "min", "max")) + " FROM dens")
def _(spark, d):
    out = g.community_stats(profiles(spark, d))
    return rounded(out, *out.columns[1:])


@query("g12_cycles")
def _(spark, d):
    return g.cycles(*v.trade(spark, d)).withColumn("members", F.array_join("members", ","))


REACH = """, reach(a, b) AS (SELECT src, dst FROM edges UNION SELECT reach.a, e.dst FROM reach JOIN edges e ON reach.b = e.src),
ends AS (SELECT src AS v FROM edges UNION SELECT dst FROM edges),
scc AS (SELECT v AS node_id, least(v, coalesce(min(y.a), v)) AS scc FROM ends LEFT JOIN reach x ON x.a = v LEFT JOIN reach y ON y.a = x.b AND y.b = v GROUP BY v)
"""
RTRADE = TRADE.replace("WITH ", "WITH RECURSIVE ", 1)


@query("g12_has_cycle", RTRADE + REACH + "SELECT (SELECT count(*) FROM reach WHERE a = b) > 0 AS has_cycle")
def _(spark, d):
    return g.cycles(*v.trade(spark, d)).agg((F.count(F.lit(1)) > 0).alias("has_cycle"))


@query("g14_scc", RTRADE + REACH + "SELECT node_id, scc FROM scc")
def _(spark, d):
    return g.strong_components(v.trade(spark, d)[1])


@query("g14_scc_density", RTRADE + REACH + "SELECT scc, count(*) AS size, round((SELECT count(*) FROM edges JOIN scc p ON p.node_id = src JOIN scc q ON q.node_id = dst WHERE p.scc = s.scc AND q.scc = s.scc) / (count(*) * (count(*) - 1)), 6) AS density FROM scc s GROUP BY scc HAVING count(*) > 1")
def _(spark, d):
    edges = v.trade(spark, d)[1]
    return rounded(g.scc_density(g.strong_components(edges), edges), "density")


FLOW = """WITH RECURSIVE nexts AS (SELECT event_id, event_type AS src, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS dst FROM events),
edges AS (SELECT src, dst, event_id AS edge_pos FROM nexts WHERE dst IS NOT NULL)
"""


@query("g14_scc_flow", FLOW + REACH + "SELECT node_id, scc FROM scc")
def _(spark, d):
    return g.strong_components(v.flow(spark, d))


@query("a01_flow_degrees", FLOW + "SELECT event_type AS node_id, (SELECT count(*) FROM edges WHERE dst = event_type) AS in_degree, (SELECT count(*) FROM edges WHERE src = event_type) AS out_degree FROM (SELECT DISTINCT event_type FROM events)")
def _(spark, d):
    edges = v.flow(spark, d)
    nodes = v.table(spark, d, "events").select(F.col("event_type").alias("node_id")).distinct().withColumn("node_pos", F.lit(0))
    return g.degree_centrality(nodes, edges).select("node_id", "in_degree", "out_degree")


@query("g15_high_coupling", TRADE + "SELECT node_id, total_degree::BIGINT AS amount FROM degrees WHERE total_degree > 10")
def _(spark, d):
    return g.anomalies(degrees(spark, d)).filter("kind = 'highCoupling'").select("node_id", "amount")


@query("g15_orphans", "SELECT 'p' || page_id AS node_id FROM pages WHERE len(regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1)) = 0 OR html IS NULL")
def _(spark, d):
    return g.anomalies(g.degree_centrality(*v.web(spark, d))).filter("kind = 'orphan'").select("node_id")


@query("g16_anomaly_remap", TRADE + "SELECT 'god_node_violation' AS kind, node_id, 'WARNING' AS severity, total_degree::BIGINT AS amount FROM degrees WHERE total_degree > 10 UNION ALL SELECT 'bottleneck', node_id, 'INFO', 0::BIGINT FROM degrees WHERE total_degree = 0")
def _(spark, d):
    return g.remapped(g.anomalies(degrees(spark, d)))


SURPRISES = TRADE + """, sur AS (SELECT e.src, e.dst, 'cross-community' AS reason, 0.75::DOUBLE AS confidence, min(edge_pos) AS edge_pos FROM edges e JOIN member a ON a.node_id = src JOIN member b ON b.node_id = dst WHERE a.community <> b.community GROUP BY 1, 2)
"""


def found(spark, d):
    return g.surprises(v.trade(spark, d)[1], v.regions(spark, d))


@query("g17_surprises", SURPRISES + "SELECT * FROM sur")
def _(spark, d):
    return found(spark, d)


@query("a05_surprise_stats", SURPRISES + "SELECT count(*) AS total, count(*) FILTER (reason = 'cross-community') AS cross_community, 0::BIGINT AS legacy, 0::BIGINT AS circular, 0::BIGINT AS unexpected, 0::BIGINT AS hidden, avg(confidence) AS avg_confidence, max(confidence) AS max_confidence, min(confidence) AS min_confidence, (SELECT count(*) FROM (SELECT src FROM sur UNION SELECT dst FROM sur)) AS affected_nodes FROM sur")
def _(spark, d):
    return g.surprise_stats(found(spark, d))


@query("a24_categories", SURPRISES + "SELECT r.reason, (SELECT count(*) FROM sur WHERE sur.reason = r.reason) AS n, coalesce((SELECT string_agg(src || '>' || dst, ',' ORDER BY edge_pos) FROM sur WHERE sur.reason = r.reason), '') AS members FROM (VALUES ('cross-community'), ('legacy'), ('circular'), ('unexpected'), ('hidden')) r(reason)")
def _(spark, d):
    return g.categorised(found(spark, d))


@query("g18_high_impact", SURPRISES + "SELECT *, 8::INTEGER AS priority FROM sur WHERE confidence >= 0.7")
def _(spark, d):
    return g.high_impact(found(spark, d))


@query("g19_fanout_all_seeds", RTRADE + REACH + "SELECT node_id AS seed, (SELECT count(*) FROM reach WHERE b = node_id AND a <> node_id) AS dependents FROM nodes")
def _(spark, d):
    nodes, edges = v.trade(spark, d)
    return g.dependent_fanout(edges, nodes.select(F.col("node_id").alias("seed"), "node_id"))


@query("g19_fanout_regions", """WITH RECURSIVE e AS (SELECT 'n' || n_nationkey AS src, 'r' || n_regionkey AS dst FROM nation UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer UNION ALL SELECT 'o' || o_orderkey, 'c' || o_custkey FROM orders),
up AS (SELECT 'r' || r_regionkey AS seed, 'r' || r_regionkey AS v FROM region UNION SELECT seed, src FROM up JOIN e ON e.dst = v)
SELECT seed, count(*) - 1 AS dependents FROM up GROUP BY 1""")
def _(spark, d):
    seeds = v.table(spark, d, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("seed"))
    return g.dependent_fanout(v.hierarchy(spark, d), seeds.select("seed", F.col("seed").alias("node_id")))


@query("g20_bounded_expansion_2", TRADE + ", d0 AS (SELECT node_id AS seed, node_id, 0 AS level FROM nodes), d1 AS (SELECT DISTINCT seed, dst AS node_id, 1 AS level FROM d0 JOIN edges ON src = d0.node_id WHERE dst <> seed), d2 AS (SELECT DISTINCT d1.seed, dst AS node_id, 2 AS level FROM d1 JOIN edges ON src = d1.node_id WHERE (d1.seed, dst) NOT IN (SELECT seed, node_id FROM d0 UNION ALL SELECT seed, node_id FROM d1)) SELECT seed, node_id, level::INTEGER AS level FROM d1 UNION ALL SELECT seed, node_id, level::INTEGER FROM d2")
def _(spark, d):
    nodes, edges = v.trade(spark, d)
    return g.closure(edges, nodes.select(F.col("node_id").alias("seed"), "node_id"), upstream=False, depth=2).filter("level > 0")


@query("g21_broad_overview", TRADE + """, c AS (SELECT node_id, 1 AS priority FROM (SELECT m.*, row_number() OVER (PARTITION BY community ORDER BY node_pos) AS i FROM member m JOIN nodes USING (node_id)) WHERE i = 1
UNION ALL SELECT node_id, 2 FROM (SELECT dst AS node_id, count(DISTINCT src) AS n, any_value(node_pos) AS p FROM edges JOIN nodes ON node_id = dst GROUP BY 1 ORDER BY n DESC, p LIMIT 5) UNION ALL SELECT node_id, 0 FROM nodes WHERE node_id IN ('n3', 'n7'))
SELECT node_id, min(priority)::INTEGER AS priority FROM c GROUP BY 1""")
def _(spark, d):
    nodes, edges = v.trade(spark, d)
    return g.broad_overview(nodes, edges, v.regions(spark, d), ["n3", "n7"])


@query("g22_fingerprint")
def _(spark, d):
    return g.fingerprint(*v.trade(spark, d))


@query("g24_node_roles", RANKS + "SELECT d.node_id, in_degree::BIGINT AS in_degree, out_degree::BIGINT AS out_degree, round(score, 6) AS score, community, CASE WHEN in_degree > 20 THEN 'CRITICAL' WHEN in_degree > 10 THEN 'IMPORTANT' ELSE 'NORMAL' END AS criticality, CASE WHEN out_degree > 5 THEN 'high' WHEN out_degree > 2 THEN 'medium' ELSE 'low' END AS centrality FROM degrees d JOIN ranks USING (node_id) JOIN member USING (node_id)")
def _(spark, d):
    return rounded(g.node_roles(degrees(spark, d), ranks(spark, d), v.regions(spark, d)), "score")


@query("a11_quality_score", PROFILES + "SELECT greatest(0, least(100, 100 - least(2 * loops, 40) - least(gods, 20) + least(greatest(0, comms - 1), 10)))::BIGINT AS score FROM (SELECT (SELECT count(*) FROM edges WHERE src = dst) AS loops, (SELECT count(*) FROM degrees WHERE in_degree >= 3) AS gods, (SELECT count(*) FROM profiles) AS comms)")
def _(spark, d):
    _, edges = v.trade(spark, d)
    loops = edges.filter("src = dst").agg(F.count(F.lit(1)).alias("loops"))
    gods = g.gods_by_degree(degrees(spark, d)).agg(F.count(F.lit(1)).alias("gods"))
    comms = profiles(spark, d).agg(F.count(F.lit(1)).alias("comms"))
    one = loops.join(F.broadcast(gods)).join(F.broadcast(comms))
    return one.select(g.quality_score(F.col("loops"), F.col("gods"), F.col("comms")).cast("long").alias("score"))


@query("j07_edge_communities", TRADE + "SELECT src, dst, a.community AS src_community, b.community AS dst_community FROM edges JOIN member a ON a.node_id = src JOIN member b ON b.node_id = dst")
def _(spark, d):
    m = v.regions(spark, d)
    e = v.trade(spark, d)[1].join(m.select(F.col("node_id").alias("src"), F.col("community").alias("src_community")), "src", "left")
    return e.join(m.select(F.col("node_id").alias("dst"), F.col("community").alias("dst_community")), "dst", "left").select("src", "dst", "src_community", "dst_community")


@query("j16_target_rollup", TRADE + ", p AS (SELECT a.community AS community, b.community AS target, count(*) AS n FROM edges JOIN member a ON a.node_id = src JOIN member b ON b.node_id = dst WHERE a.community <> b.community GROUP BY 1, 2) SELECT community, target, n FROM (SELECT *, row_number() OVER (PARTITION BY community ORDER BY n DESC, target) AS i FROM p) WHERE i <= 3")
def _(spark, d):
    from pyspark.sql.window import Window

    counts = g.across(v.regions(spark, d), v.trade(spark, d)[1]).groupBy(F.col("cs").alias("community"), F.col("cd").alias("target")).agg(F.count(F.lit(1)).alias("n"))
    place = F.row_number().over(Window.partitionBy("community").orderBy(F.desc("n"), "target"))
    return counts.withColumn("i", place).filter("i <= 3").drop("i")
