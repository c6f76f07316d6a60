"""Message, telemetry and budget queries over events, conversations, documents and orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import budget as b
from ..operators import messages as m
from ..operators import telemetry as t
from ..operators.ranking import placed
from ..sources import tables as v

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return add


LOG = """WITH log AS (SELECT user_id AS conv_id, event_id AS pos, event_type = 'error' AS is_error, json_extract_string(props, '$.k') AS path, event_type AS tool_name, value FROM events)
"""
CHAT = "WITH chat AS (SELECT conv_id, turn AS pos, role, text AS content FROM conversations)\n"
DOCS = "WITH docs AS (SELECT source AS conv_id, doc_id AS pos, 'user' AS role, text AS content FROM documents)\n"


@query("m01_dedup", DOCS + "SELECT conv_id, pos FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, role, content ORDER BY pos) AS i FROM docs) WHERE i = 1")
def _(spark, d):
    return m.drop_duplicates(v.document_messages(spark, d)).select("conv_id", "pos")


@query("m02_superseded", LOG + "SELECT conv_id, pos, path FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, path ORDER BY pos DESC) AS i FROM log) WHERE path IS NULL OR i = 1")
def _(spark, d):
    return m.drop_superseded(v.tool_log(spark, d)).select("conv_id", "pos", "path")


@query("m03_error_purge", LOG + "SELECT conv_id, pos FROM (SELECT *, lead(is_error) OVER (PARTITION BY conv_id ORDER BY pos) AS nxt FROM log) WHERE NOT (is_error AND nxt IS NOT NULL AND NOT nxt)")
def _(spark, d):
    return m.drop_resolved_errors(v.tool_log(spark, d)).select("conv_id", "pos")


PIPE = LOG + """, a AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, path ORDER BY pos DESC) AS i FROM log) WHERE path IS NULL OR i = 1),
z AS (SELECT conv_id, pos FROM (SELECT *, lead(is_error) OVER (PARTITION BY conv_id ORDER BY pos) AS nxt FROM a) WHERE NOT (is_error AND nxt IS NOT NULL AND NOT nxt))
"""


def tool_messages(spark, d):
    return v.tool_log(spark, d).withColumn("content", F.col("tool_name"))


@query("m04_pipeline", PIPE + "SELECT conv_id, pos FROM z")
def _(spark, d):
    return m.prune(tool_messages(spark, d)).select("conv_id", "pos")


@query("m05_prune_report", PIPE + "SELECT p AS processed, p - q AS pruned, floor(100 * (p - q) / p + 0.5)::BIGINT AS percent FROM (SELECT (SELECT count(*) FROM log) AS p, (SELECT count(*) FROM z) AS q)")
def _(spark, d):
    before = tool_messages(spark, d)
    return m.prune_report(before, m.prune(before))


MENTIONS = [("the", "c1"), ("and", "c1"), ("der", "c2"), ("que", "c2"), ("les", "c3")]
VOTES = CHAT + """, terms AS (SELECT * FROM (VALUES ('the','c1'),('and','c1'),('der','c2'),('que','c2'),('les','c3')) t(term, community)),
words AS (SELECT conv_id, pos, unnest(regexp_split_to_array(lower(content), '[^a-z0-9_./-]+')) AS term FROM chat),
votes AS (SELECT conv_id, community, count(*) AS votes FROM words JOIN terms USING (term) GROUP BY 1, 2),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY votes DESC, community)::INTEGER AS place FROM votes)
"""


def mentions(spark):
    return spark.createDataFrame(MENTIONS, "term string, community string")


@query("a22_community_votes", VOTES + "SELECT * FROM placed")
def _(spark, d):
    return m.community_votes(v.chat(spark, d), mentions(spark))


@query("m06_community_prune", VOTES + """, active AS (SELECT conv_id, min_by(community, place) AS community FROM placed GROUP BY 1 HAVING count(*) >= 2),
named AS (SELECT DISTINCT w.conv_id, w.pos FROM words w JOIN active a USING (conv_id) JOIN terms t ON t.term = w.term AND t.community = a.community),
sized AS (SELECT chat.*, count(*) OVER (PARTITION BY conv_id) AS n, max(CASE WHEN role = 'assistant' THEN pos END) OVER (PARTITION BY conv_id) AS last_one FROM chat)
SELECT conv_id, pos, role FROM sized WHERE NOT coalesce(role = 'assistant' AND pos < last_one AND trim(content) <> '' AND n >= 3 AND conv_id IN (SELECT conv_id FROM active) AND (conv_id, pos) NOT IN (SELECT conv_id, pos FROM named), false)""")
def _(spark, d):
    return m.community_prune(v.chat(spark, d), mentions(spark), role="assistant").select("conv_id", "pos", "role")


@query("m07_edit_intent", CHAT + """, tail AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY pos DESC) AS i FROM chat) WHERE i <= 10), t AS (SELECT conv_id, string_agg(coalesce(content, ''), chr(10) ORDER BY pos) AS t FROM tail GROUP BY 1)
SELECT conv_id, regexp_matches(lower(t), 'edit|change|modify|update|fix|refactor|rename|replace|add|remove|delete|implement') AS editing, len(list_distinct(regexp_extract_all(t, '([\\w./-]+\\.(?:ts|tsx|js|jsx|py|rs|go|java|json|md))\\b', 1)))::INTEGER AS n_files, regexp_matches(t, '\\b\\d+[a-z]{2}\\|') AS anchored FROM t""")
def _(spark, d):
    return m.edit_intent(v.chat(spark, d)).select("conv_id", "editing", F.size("files").alias("n_files"), "anchored")


@query("m08_navigation", CHAT + """, tail AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY pos DESC) AS i FROM chat) WHERE i <= 5),
k AS (SELECT conv_id, min(CASE WHEN regexp_matches(lower(content), 'definition of|defined|where is \\w+ (?:declared|implemented)') THEN 1 WHEN regexp_matches(lower(content), 'references? (?:to|of)|usages?|who (?:calls|uses)|where is \\w+ used') THEN 2 WHEN regexp_matches(lower(content), 'which file|what file|find the file|located') THEN 3 END) AS k FROM tail GROUP BY 1)
SELECT conv_id, CASE k WHEN 1 THEN 'definition' WHEN 2 THEN 'references' WHEN 3 THEN 'file_location' END AS navigation FROM k""")
def _(spark, d):
    return m.navigation_intent(v.chat(spark, d))


@query("m12_turn_mode", CHAT + """, f AS (SELECT conv_id, pos, regexp_matches(lower(content), '\\b(?:overview|architecture|structure|codebase|code base|repository|repo|project)\\b') AS broad, regexp_matches(lower(content), 'edit|change|add') AS editing, regexp_matches(lower(content), 'where') AS nav FROM chat)
SELECT conv_id, pos, CASE WHEN broad THEN 'overview' WHEN editing THEN 'editing' WHEN nav THEN 'navigation' ELSE 'idle' END AS mode FROM f""")
def _(spark, d):
    c = F.lower("content")
    return v.chat(spark, d).select("conv_id", "pos", m.turn_mode(c.rlike(m.BROAD[0]), c.rlike("edit|change|add"), c.rlike("where")).alias("mode"))


@query("m18_last_n", CHAT + "SELECT conv_id, pos, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY pos DESC) AS i FROM chat) WHERE i <= 3")
def _(spark, d):
    return m.last_messages(v.chat(spark, d), 3).select("conv_id", "pos", "role")


@query("m20_recent_tool", LOG + "SELECT conv_id, pos, max(is_error::INT) OVER (PARTITION BY conv_id ORDER BY pos ROWS 11 PRECEDING) = 1 AS recent_error FROM log")
def _(spark, d):
    return v.tool_log(spark, d).select("conv_id", "pos", m.recent(F.col("is_error"), 12).alias("recent_error"))


@query("m19_intercept", "SELECT user_id AS call_id, bool_or(event_type = 'error') AS denied, min(CASE WHEN event_type = 'error' THEN event_id END) AS first_denial, max_by(event_type, event_id) AS reason FROM events GROUP BY 1")
def _(spark, d):
    e = v.table(spark, d, "events")
    return m.intercept(e.select(F.col("user_id").alias("call_id"), F.col("event_id").alias("order"), (F.col("event_type") == "error").alias("deny"), F.col("event_type").alias("reason")))


@query("a19_milestones", LOG + ", cum AS (SELECT conv_id, pos, sum(floor(value)::BIGINT) OVER (PARTITION BY conv_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS c FROM log) SELECT conv_id, s AS milestone, min(pos) AS pos FROM cum, (VALUES (500::BIGINT), (2000), (5000), (10000), (25000), (50000)) m(s) WHERE c >= s GROUP BY 1, 2")
def _(spark, d):
    return m.milestones(v.tool_log(spark, d).withColumn("saved", F.floor("value")), "saved")


@query("a20_tool_counters", LOG + "SELECT tool_name, count(*) AS calls, count(*) FILTER (is_error) AS errors, max(CASE WHEN is_error THEN pos END) AS last_error_pos FROM log GROUP BY 1")
def _(spark, d):
    return m.tool_counters(v.tool_log(spark, d))


@query("z06_rolling_tools", LOG + "SELECT conv_id, pos, count(*) OVER (PARTITION BY conv_id ORDER BY pos ROWS 23 PRECEDING) AS n FROM log")
def _(spark, d):
    return v.tool_log(spark, d).select("conv_id", "pos", F.count(F.lit(1)).over(m.in_conversation().rowsBetween(-23, 0)).alias("n"))


SESS = """WITH s AS (SELECT o_orderkey AS session_id, o_orderpriority AS index_source, (o_custkey % 7)::BIGINT AS trig, floor(o_totalprice / 100)::BIGINT AS saved, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE floor(o_totalprice / 250)::BIGINT END AS inj FROM orders)
"""


@query("a16_trend", SESS + "SELECT count(*) AS sessions, floor(avg(trig) * 10 + 0.5) / 10 AS avg_triggers, floor(avg(saved) + 0.5)::BIGINT AS avg_saved, floor(avg(CASE WHEN saved + coalesce(inj, 0) > 0 THEN saved / (saved + coalesce(inj, 0)) ELSE 0 END) * 100 + 0.5) / 100 AS avg_ratio, (SELECT session_id FROM s ORDER BY saved DESC, session_id LIMIT 1) AS best_session FROM s")
def _(spark, d):
    return t.session_trend(v.order_sessions(spark, d))


@query("a15_breakdown", SESS + ", p AS (SELECT index_source AS source, sum(saved)::BIGINT AS tokens FROM s GROUP BY 1) SELECT source, tokens, floor(100 * tokens / sum(tokens) OVER () + 0.5)::BIGINT AS percent FROM p WHERE tokens > 0")
def _(spark, d):
    return t.breakdown(v.order_sessions(spark, d).groupBy(F.col("index_source").alias("source")).agg(F.sum("total_tokens_saved").alias("tokens")))


@query("a14_cost", SESS + "SELECT sum(saved)::BIGINT AS skeleton_tokens, sum(coalesce(inj, saved * 8))::BIGINT AS full_tokens, round(1 - sum(saved) / sum(coalesce(inj, saved * 8)), 6) AS ratio FROM s")
def _(spark, d):
    s = v.order_sessions(spark, d).select(F.col("total_tokens_saved").alias("skeleton"), F.col("total_injection_tokens").alias("full"))
    return t.cost(s).withColumn("ratio", F.round("ratio", 6))


@query("a17_top_files", LOG + ", f AS (SELECT *, row_number() OVER (PARTITION BY conv_id, path ORDER BY pos) AS i FROM log WHERE path IS NOT NULL) SELECT path, count(*) AS n FROM f WHERE i = 1 GROUP BY 1 ORDER BY n DESC, min((conv_id, pos)) LIMIT 10")
def _(spark, d):
    return t.top_files(v.tool_log(spark, d).filter("path IS NOT NULL").select(F.col("conv_id").alias("session_id"), "pos", "path"), 10)


@query("a18_running_ratio", LOG + ", x AS (SELECT conv_id AS session_id, pos, floor(value)::BIGINT AS tokens, (pos % 200)::BIGINT AS full_ FROM log), y AS (SELECT session_id, pos, sum(tokens) OVER w AS used, sum(greatest(full_ - tokens, 0)) OVER w AS saved FROM x WINDOW w AS (PARTITION BY session_id ORDER BY pos ROWS UNBOUNDED PRECEDING)) SELECT session_id, pos, CASE WHEN used + saved > 0 THEN 1 - used / (used + saved) ELSE 0 END AS ratio FROM y")
def _(spark, d):
    log = v.tool_log(spark, d).select(F.col("conv_id").alias("session_id"), "pos", F.floor("value").alias("tokens"), (F.col("pos") % 200).alias("full"))
    return t.running_savings(log)


@query("a25_region_hull", LOG + "SELECT path, min(greatest(pos % 50 - 2, 1)) AS start, max(greatest(pos % 70, greatest(pos % 50 - 2, 1))) AS \"end\" FROM log WHERE path IS NOT NULL GROUP BY 1")
def _(spark, d):
    log = v.tool_log(spark, d).filter("path IS NOT NULL")
    return t.region_hull(log.select("path", (F.col("pos") % 50 - 2).alias("start"), (F.col("pos") % 70).alias("end")))


@query("k06_session_records", LOG + ", l AS (SELECT conv_id AS session_id, pos, CASE WHEN tool_name IN ('click', 'view') THEN 'set' ELSE 'add' END AS kind, tool_name AS name, (pos % 5)::BIGINT AS value FROM log) SELECT session_id, name, nullif(CASE WHEN max(kind) = 'set' THEN max_by(value, pos) ELSE sum(value)::BIGINT END, 0) AS value FROM l GROUP BY 1, 2")
def _(spark, d):
    log = v.tool_log(spark, d).select(F.col("conv_id").alias("session_id"), "pos", F.when(F.col("tool_name").isin("click", "view"), "set").otherwise("add").alias("kind"), F.col("tool_name").alias("name"), (F.col("pos") % 5).alias("value"))
    return t.session_records(log)


@query("f19_staleness", "SELECT o_orderkey AS index_id, (epoch(TIMESTAMP '1998-08-02') - epoch(o_orderdate)) / 3600 > 24 OR o_orderkey % 4 <> 0 OR o_custkey % 3 > 0 AS stale, (epoch(TIMESTAMP '1998-08-02') - epoch(o_orderdate)) / 3600 > 48 AS critical FROM orders")
def _(spark, d):
    o = v.table(spark, d, "orders")
    meta = o.select(F.col("o_orderkey").alias("index_id"), F.col("o_orderdate").alias("built_at"), (F.col("o_orderkey") % 4).alias("commit"), F.lit(0).cast("long").alias("head"), (F.col("o_custkey") % 3).alias("changed"))
    return t.staleness(meta, F.to_timestamp(F.lit("1998-08-02")))


FOLD = """WITH RECURSIVE items AS (SELECT source AS grp, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS i, doc_id AS id, ceil(length(text) / 4)::BIGINT AS cost FROM documents),
fold AS (SELECT grp, i, id, cost, {first} AS taken, CASE WHEN {first} THEN cost ELSE 0 END AS used FROM items WHERE i = 1
UNION ALL SELECT n.grp, n.i, n.id, n.cost, {rest}, f.used + CASE WHEN {rest} THEN n.cost ELSE 0 END FROM fold f JOIN items n ON n.grp = f.grp AND n.i = f.i + 1)
SELECT grp, id, cost FROM fold WHERE taken"""


def items(spark, d):
    docs = v.table(spark, d, "documents")
    return docs.select(F.col("source").alias("grp"), F.col("doc_id").alias("pos"), F.col("doc_id").alias("id"), b.estimate_tokens("text").alias("cost"))


@query("t03_greedy_budget", FOLD.format(first="cost <= 2000", rest="f.used + n.cost <= 2000"))
def _(spark, d):
    return b.greedy(items(spark, d), 2000)


@query("t04_priority_pipeline", FOLD.format(first="true", rest="f.used + n.cost <= 2000"))
def _(spark, d):
    return b.greedy(items(spark, d), 2000, first_always=True)


@query("t05_suffix_trim", "WITH x AS (SELECT source AS grp, doc_id AS pos, sum(length(text) + 1) OVER (PARTITION BY source ORDER BY doc_id) AS c FROM documents) SELECT grp, pos FROM x WHERE c - 1 <= 20000")
def _(spark, d):
    docs = v.table(spark, d, "documents")
    return b.suffix_trim(docs.select(F.col("source").alias("grp"), F.col("doc_id").alias("pos"), F.col("text").alias("line"), F.lit(False).alias("header")), 20000).select("grp", "pos")


@query("t06_even_sample", "WITH x AS (SELECT p_partkey AS pos, row_number() OVER (ORDER BY p_partkey) - 1 AS i, count(*) OVER () AS n FROM part) SELECT pos FROM x WHERE i IN (SELECT floor(k * (SELECT count(*) FROM part) / 100) FROM range(100) r(k))")
def _(spark, d):
    return b.even_sample(v.part_files(spark, d).select("pos"), 100)


@query("t09_dir_then_recent", "SELECT p_brand AS dir, p_partkey AS pos, row_number() OVER (ORDER BY p_brand, p_size DESC, p_partkey)::INTEGER AS place FROM part")
def _(spark, d):
    p = placed(v.table(spark, d, "part").select("p_brand", "p_size", "p_partkey"), "place", "p_brand", F.desc("p_size"), "p_partkey")
    return p.select(F.col("p_brand").alias("dir"), F.col("p_partkey").alias("pos"), F.col("place").cast("int").alias("place"))
