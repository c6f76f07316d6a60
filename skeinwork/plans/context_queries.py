"""Context, set and ordering queries."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as x
from ..operators import context as c
from ..operators import graph as g
from ..operators import guidance
from ..operators import messages as m
from ..operators.ranking import placed
from ..sources import tables as v
from .graph_queries import PROFILES, RANKS, TRADE, degrees, profiles
from .index_queries import FILES

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return add


@query("u01_union_distinct", "SELECT c_nationkey AS nation FROM customer UNION SELECT s_nationkey FROM supplier")
def _(spark, d):
    return v.table(spark, d, "customer").select(F.col("c_nationkey").alias("nation")).unionByName(v.table(spark, d, "supplier").select(F.col("s_nationkey").alias("nation"))).distinct()


@query("u02_union_all", "SELECT nation, count(*) AS n FROM (SELECT c_nationkey AS nation FROM customer UNION ALL SELECT s_nationkey FROM supplier) GROUP BY 1")
def _(spark, d):
    both = v.table(spark, d, "customer").select(F.col("c_nationkey").alias("nation")).unionByName(v.table(spark, d, "supplier").select(F.col("s_nationkey").alias("nation")))
    return both.groupBy("nation").agg(F.count(F.lit(1)).alias("n"))


@query("u03_exists", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')")
def _(spark, d):
    late = v.table(spark, d, "orders").filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return v.table(spark, d, "customer").join(late, "c_custkey", "left_semi").select("c_custkey")


@query("u04_except", "SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 25)")
def _(spark, d):
    used = v.table(spark, d, "lineitem").filter("l_quantity > 25").select(F.col("l_partkey").alias("p_partkey"))
    return v.table(spark, d, "part").join(used, "p_partkey", "left_anti").select("p_partkey")


@query("u05_first_of_key", "SELECT user_id, event_type, min(event_id) AS event_id FROM events GROUP BY 1, 2")
def _(spark, d):
    e = v.table(spark, d, "events")
    w = Window.partitionBy("user_id", "event_type").orderBy("event_id")
    return e.withColumn("i", F.row_number().over(w)).filter("i = 1").select("user_id", "event_type", "event_id")


@query("t01_stable_order", "SELECT p_partkey, row_number() OVER (ORDER BY p_size DESC, p_partkey)::INTEGER AS place FROM part")
def _(spark, d):
    return placed(v.table(spark, d, "part").select("p_partkey", "p_size"), "place", F.desc("p_size"), "p_partkey").select("p_partkey", F.col("place").cast("int").alias("place"))


@query("t02_last_reversed", "SELECT o_orderkey FROM orders ORDER BY o_orderkey DESC LIMIT 10")
def _(spark, d):
    return v.table(spark, d, "orders").orderBy(F.desc("o_orderkey")).limit(10).select("o_orderkey")


GODS = TRADE + ", gods AS (SELECT node_id, node_pos, in_degree, CASE WHEN in_degree > 20 THEN 'CRITICAL' WHEN in_degree > 10 THEN 'IMPORTANT' ELSE 'NORMAL' END AS criticality FROM degrees WHERE in_degree >= 3)\n"


def gods(spark, d):
    return g.gods_by_degree(degrees(spark, d)).withColumn("criticality", g.criticality()).withColumn("label", F.col("node_id"))


@query("t07_ranked_gods", GODS + "SELECT node_id, place FROM (SELECT node_id, row_number() OVER (ORDER BY CASE criticality WHEN 'CRITICAL' THEN 0 WHEN 'IMPORTANT' THEN 1 ELSE 2 END, in_degree DESC, node_pos)::INTEGER AS place FROM gods) WHERE place <= 5")
def _(spark, d):
    return c.ranked_gods(gods(spark, d), 5).select("node_id", "place")


@query("t08_community_relevance", PROFILES + "SELECT community, round(3.0 * (community IN ('r1', 'r2'))::INT + 2.0 * (community IN ('r2', 'r3'))::INT + internal_density, 6)::DOUBLE AS score FROM dens WHERE community IN ('r1', 'r2', 'r3') OR internal_density > 0 ORDER BY score DESC, community LIMIT 4")
def _(spark, d):
    one = lambda *names: spark.createDataFrame([(n,) for n in names], "community string")
    out = c.community_relevance(one("r1", "r2"), one("r2", "r3"), profiles(spark, d).select("community", F.col("internal_density").alias("density")))
    return out.select("community", F.round("score", 6).alias("score"))


@query("k10_priority_symbols", GODS + "SELECT node_id AS label FROM gods WHERE node_id IN ('n1', 'n2', 'n3', 'n4', 'n5') AND node_id <> 'n2'")
def _(spark, d):
    own = gods(spark, d)
    matched = own.filter(F.col("node_id").isin("n1", "n2", "n3", "n4", "n5"))
    return c.priority_symbols(matched, own, spark.createDataFrame([("n2",)], "label string")) if not matched.isEmpty() else own.select("label").limit(0)


@query("j17_bottlenecks_in_community", TRADE + "SELECT node_id, community FROM degrees JOIN member USING (node_id) WHERE out_degree >= 3 AND community = 'r1'")
def _(spark, d):
    own = v.regions(spark, d).filter("community = 'r1'")
    return g.bottlenecks_by_degree(degrees(spark, d), 3).join(own, "node_id").select("node_id", "community")


@query("j06_god_profile", RANKS + "SELECT d.node_id, in_degree::BIGINT AS in_degree, round(score, 6) AS score, coalesce(community, 'unknown') AS community FROM degrees d JOIN ranks USING (node_id) LEFT JOIN (SELECT * FROM member WHERE community <> 'r0') USING (node_id) WHERE in_degree >= 3")
def _(spark, d):
    ranks = g.pagerank(*v.trade(spark, d), iterations=10, tolerance=0)
    roles = g.node_roles(degrees(spark, d), ranks, v.regions(spark, d).filter("community <> 'r0'"))
    return roles.filter("in_degree >= 3").select("node_id", "in_degree", F.round("score", 6).alias("score"), "community")


@query("j18_lookup", FILES + ", w AS (SELECT path, 'red' AS symbol FROM f WHERE pos % 2 = 0 UNION ALL SELECT path, 'blue' FROM f WHERE pos % 3 = 0) SELECT w.symbol, w.path, CASE WHEN (w.path, w.symbol) IN (SELECT path, symbol FROM s) THEN 'file:' || path || ':' || symbol WHEN symbol = 'blue' THEN 'g1' ELSE 'file:' || path END AS node_id FROM w")
def _(spark, d):
    files, symbols = v.part_files(spark, d), v.part_symbols(spark, d)
    wanted = files.filter("pos % 2 = 0").select("path", F.lit("red").alias("symbol")).unionByName(files.filter("pos % 3 = 0").select("path", F.lit("blue").alias("symbol")))
    return c.lookup(wanted, symbols, spark.createDataFrame([("blue", "g1")], "label string, node_id string"))


@query("r08_in_focus", FILES + "SELECT path FROM f WHERE pos % 50 = 0 OR pos <= 3 OR pos BETWEEN 100 AND 110")
def _(spark, d):
    files = v.part_files(spark, d)
    ranked = files.filter("pos BETWEEN 100 AND 110").select("path", (F.col("pos") - 99).alias("place"))
    absent = spark.createDataFrame([("no/such.ts",)], "path string")
    return c.in_focus(files.filter("pos % 50 = 0").select("path").unionByName(absent), files.filter("pos <= 3"), ranked, files)


@query("j10_community_files", FILES + "SELECT dir AS community, path FROM f")
def _(spark, d):
    files, symbols = v.part_files(spark, d), v.part_symbols(spark, d)
    of_files = files.select(F.concat(F.lit("file:"), "path").alias("node_id"), F.col("dir").alias("community"))
    of_symbols = symbols.select(F.concat(F.lit("file:"), "path", F.lit(":"), "symbol").alias("node_id"), F.lit("x").alias("community"))
    return c.community_files(of_files.unionByName(of_symbols))


@query("f03_node_ids", FILES + "SELECT path, symbol, count(*) AS n FROM s GROUP BY 1, 2")
def _(spark, d):
    ids = v.part_symbols(spark, d).select(F.concat(F.lit("file:"), "path", F.lit(":"), "symbol").alias("id"))
    return ids.groupBy(x.node_path(F.col("id")).alias("path"), x.node_symbol(F.col("id")).alias("symbol")).agg(F.count(F.lit(1)).alias("n"))


@query("f08_glob", "SELECT p_partkey FROM part WHERE regexp_matches(lower(p_brand), '^brand.*3$')")
def _(spark, d):
    return v.table(spark, d, "part").filter(x.glob_match(F.col("p_brand"), "brand*3")).select("p_partkey")


@query("f12_parse_anchor", "SELECT p_partkey, CASE WHEN p_partkey % 5 > 0 THEN p_partkey END AS line FROM part")
def _(spark, d):
    ref = F.concat(F.lit("  > "), F.when(F.col("p_partkey") % 5 == 0, F.lit("0")).otherwise(F.col("p_partkey").cast("string")), F.lit("un|text"))
    return v.table(spark, d, "part").select("p_partkey", x.parse_anchor(ref).getField("line").alias("line"))


@query("m13_broad_query", "SELECT conv_id, turn, regexp_matches(lower(text), '\\b(?:overview|architecture|structure|codebase|code base|repository|repo|project)\\b|how (?:does|is) .*(?:work|organi[sz]ed|structured)|\\bexplain the (?:code|project|system)\\b|\\bwhere (?:do|should) i start\\b|\\bwhat does this (?:project|repo|code ?base)\\b') AND NOT regexp_matches(lower(text), '\\b(?:this|that) (?:function|file|line|class|method)\\b|\\.(?:ts|tsx|js|py|rs)\\b') AS broad FROM conversations")
def _(spark, d):
    return v.chat(spark, d).select("conv_id", F.col("pos").alias("turn"), m.broad_query().alias("broad"))


@query("m15_paths_in_text", "SELECT conv_id, turn, len(list_distinct(regexp_extract_all(text, '((?:[\\w.-]+/)+[\\w.-]+\\.\\w{1,5}|[\\w-]+\\.(?:ts|tsx|js|jsx|py|rs|go|md|json))', 1)))::INTEGER AS n FROM conversations")
def _(spark, d):
    return v.chat(spark, d).select("conv_id", F.col("pos").alias("turn"), F.size(c.mentioned_paths()).alias("n"))


@query("m17_trigger", "SELECT user_id, event_id, CASE WHEN event_type = 'click' THEN 'file pattern' WHEN event_type = 'error' THEN 'tool result' WHEN value > 50 THEN 'symbol score' END AS trigger FROM events")
def _(spark, d):
    e = v.table(spark, d, "events")
    flags = {"file pattern": F.col("event_type") == "click", "tool result": F.col("event_type") == "error", "symbol score": F.col("value") > 50}
    return e.select("user_id", "event_id", c.trigger(flags).alias("trigger"))


CYCLED = """WITH c AS (SELECT p_partkey AS k, p_size % 3 AS kind FROM part)
SELECT k, CASE kind WHEN 0 THEN 'focus' WHEN 1 THEN 'general' ELSE 'none' END AS warning FROM c WHERE k < 6"""


@query("k09_cycle_warning", CYCLED)
def _(spark, d):
    """Of the first parts: a cycle in focus, one elsewhere, or none."""
    out = None
    for r in v.table(spark, d, "part").filter("p_partkey < 6").select("p_partkey", "p_size").collect():
        names = ["a", "b"] if r.p_size % 3 < 2 else []
        nodes = spark.createDataFrame([(n, i) for i, n in enumerate("abx")], "node_id string, node_pos long")
        edges = spark.createDataFrame([("a", "b", 0)] + [("b", "a", 1)] * (len(names) > 0), "src string, dst string, edge_pos long")
        focus = spark.createDataFrame([("b" if r.p_size % 3 == 0 else "x",)], "node_id string")
        one = c.cycle_warning(g.cycles(nodes, edges), focus).select(F.lit(r.p_partkey).cast("long").alias("k"), "warning")
        out = one if out is None else out.unionByName(one)
    return out


@query("a13_token_metrics", TRADE + "SELECT round((SELECT count(*) FROM degrees WHERE in_degree >= 3) / 25, 6) AS coverage, round(2 / 5, 6) AS active_ratio, 3 * 50 * 80 AS savings, round(25 / 4 + 0.0001)::BIGINT AS throughput")
def _(spark, d):
    one = g.gods_by_degree(degrees(spark, d)).agg(F.count(F.lit(1)).alias("gods"))
    t = c.token_metrics(F.col("gods"), F.lit(25), F.lit(2), F.lit(5))
    return one.select(t.alias("t"), c.throughput(F.lit(25), F.lit(4)).alias("throughput")).select(F.round("t.coverage", 6).alias("coverage"), F.round("t.active_ratio", 6).alias("active_ratio"), "t.savings", "throughput")


@query("a21_injection_total", "SELECT o_orderkey, o_custkey % 7 + o_custkey % 5 + o_orderkey % 3 + o_orderkey % 11 + o_custkey % 13 + CASE WHEN o_orderkey % 2 = 0 THEN 4 ELSE 0 END + o_orderkey % 17 AS total FROM orders")
def _(spark, d):
    k, o = F.col("o_custkey"), F.col("o_orderkey")
    values = [k % 7, k % 5, o % 3, o % 11, k % 13, F.when(o % 2 == 0, 4), o % 17]
    log = v.table(spark, d, "orders").select("o_orderkey", *[x.alias(n) for n, x in zip(c.INJECTED, values, strict=True)])
    return log.select("o_orderkey", c.injection_total().alias("total"))


@query("a23_distinct_counts", TRADE + ", sur AS (SELECT DISTINCT src, dst FROM edges JOIN member a ON a.node_id = src JOIN member b ON b.node_id = dst WHERE a.community <> b.community), ends AS (SELECT src AS v FROM sur UNION SELECT dst FROM sur) SELECT (SELECT count(*) FROM ends) AS surprise_nodes, (SELECT count(*) FROM sur) AS surprises, (SELECT count(DISTINCT community) FROM member) AS communities")
def _(spark, d):
    edges = v.trade(spark, d)[1]
    found = g.surprises(edges, v.regions(spark, d)).filter("reason = 'cross-community'")
    return c.distinct_counts(found, v.regions(spark, d))


@query("j19_link_paths", "SELECT count(*) AS n FROM (SELECT DISTINCT unnest(regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1)) AS path FROM pages)")
def _(spark, d):
    return v.web(spark, d)[1].select("dst").distinct().agg(F.count(F.lit(1)).alias("n"))


MODELS, PROVIDERS, DEFAULTS = [("b*-7", ["deep.md"]), ("B*", ["b.md", "AGENTS.md"])], {"BUILDING": ["house.md", "b.md"]}, {"BUILDING": ["never.md"], "MACHINERY": ["b.md"]}


@query("s13_guidance", """WITH asked AS (SELECT c_custkey AS id, '/n' || c_nationkey || '/c' || c_custkey AS cwd, CASE WHEN c_custkey % 4 = 1 AND c_custkey % 10 = 7 THEN ['deep.md'] WHEN c_custkey % 2 = 0 AND c_custkey % 3 = 0 THEN ['b.md', 'AGENTS.md'] WHEN c_mktsegment = 'BUILDING' THEN ['house.md', 'b.md'] WHEN c_mktsegment = 'MACHINERY' THEN ['b.md'] END AS names FROM customer),
files AS (SELECT '/home' AS folder, 'b.md' AS name, 'home' AS content UNION ALL SELECT '/', 'house.md', 'root' UNION ALL SELECT '/', 'b.md', 'stand-in'
UNION ALL SELECT '/n' || n_nationkey, unnest(['AGENTS.md', 'b.md']), unnest(['core', CASE WHEN n_nationkey % 2 = 0 THEN 'core' ELSE n_name END]) FROM nation
UNION ALL SELECT '/n' || c_nationkey || '/c' || c_custkey, 'house.md', c_name FROM customer WHERE c_custkey % 5 = 0),
kept AS (SELECT * FROM files f WHERE NOT (folder = '/' AND name = 'b.md') AND NOT (folder = '/home' AND name = 'b.md') AND name <> 'AGENTS.md' AND content <> 'core'),
tries AS (SELECT id, unnest(['/home', '/', split_part(cwd, '/c', 1), cwd]) AS folder, unnest([1, 2, 3, 4]) AS step, names FROM asked WHERE names IS NOT NULL),
named AS (SELECT id, folder, step, unnest(names) AS name, unnest(range(1, len(names) + 1)) AS nth FROM tries)
SELECT id, row_number() OVER (PARTITION BY id ORDER BY step, nth)::INTEGER AS place, folder, name, content FROM named JOIN kept USING (folder, name)""")
def _(spark, d):
    """What customers' folders hold for their models and providers; b.md is the stand-in of the core file."""
    c_, n_ = v.table(spark, d, "customer"), v.table(spark, d, "nation")
    k = F.col("c_custkey")
    model = F.when((k % 4 == 1) & (k % 10 == 7), "Big-7").when((k % 2 == 0) & (k % 3 == 0), "bright")
    cwd = F.concat(F.lit("/n"), "c_nationkey", F.lit("/c"), "c_custkey")
    asked = c_.select(k.alias("id"), cwd.alias("cwd"), F.col("c_mktsegment").alias("provider"), model.alias("model"))
    fixed = n_.limit(1).select(F.explode(F.array(*[F.struct(F.lit(a).alias("folder"), F.lit(b).alias("name"), F.lit(t).alias("content")) for a, b, t in (("/home", "b.md", "home"), ("/", "house.md", "root"), ("/", "b.md", "stand-in"))])).alias("f")).select("f.*")
    own = n_.select(F.concat(F.lit("/n"), "n_nationkey").alias("folder"), F.explode(F.create_map(F.lit("AGENTS.md"), F.lit("core"), F.lit("b.md"), F.when(F.col("n_nationkey") % 2 == 0, "core").otherwise(F.col("n_name")))).alias("name", "content"))
    deep = c_.filter("c_custkey % 5 = 0").select(cwd.alias("folder"), F.lit("house.md").alias("name"), F.col("c_name").alias("content"))
    return guidance.guidance_files(asked, fixed.unionByName(own).unionByName(deep), "/home", MODELS, PROVIDERS, DEFAULTS, "b.md")
