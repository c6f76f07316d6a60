"""Index and retrieval queries: parts as files, words of their names as symbols."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import postings
from ..operators import retrieval as r
from ..sources import tables as v

QUERIES: dict = {}
ORACLES: dict = {}

FILES = """WITH f AS (SELECT p_partkey AS pos, p_brand || '/' || replace(p_name, ' ', '_') || '_' || p_partkey || '.ts' AS path, replace(p_name, ' ', '_') || '_' || p_partkey AS stem, p_brand AS dir, p_name FROM part),
s AS (SELECT unnest(string_split(p_name, ' ')) AS symbol, path, pos * 100 + unnest(range(len(string_split(p_name, ' ')))) AS pos FROM f)
"""
QUESTION = "red smallPart steel_box 12"
TOKENS = FILES + ", tok AS (SELECT unnest(['red', 'smallpart', 'steel_box', '12', 'small', 'part', 'steel', 'box']) AS token)\n"


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return add


def tokens(spark):
    return spark.range(1).select(F.explode(r.query_tokens(F.lit(QUESTION))).alias("token"))


@query("r01_tokens", TOKENS + "SELECT token FROM tok")
def _(spark, d):
    return tokens(spark)


@query("r01_document_tokens", "WITH w AS (SELECT doc_id, unnest(string_split_regex(text, '[\\s,.;:!?()\\[\\]{}\"''`<>=+*/\\\\|&^%$#@~-]+')) AS w FROM documents), p AS (SELECT doc_id, lower(w) AS t FROM w WHERE length(w) > 1 UNION SELECT doc_id, lower(x) FROM (SELECT doc_id, unnest(string_split(w, '_')) AS x FROM w WHERE length(w) > 1) WHERE length(x) > 1 UNION SELECT doc_id, lower(x) FROM (SELECT doc_id, unnest(regexp_extract_all(w, '^[^A-Z]+|[A-Z][^A-Z]*')) AS x FROM w WHERE length(w) > 1) WHERE length(x) > 1) SELECT doc_id, count(*) AS n_tokens FROM p GROUP BY 1")
def _(spark, d):
    docs = v.table(spark, d, "documents")
    return docs.select("doc_id", F.size(r.query_tokens(F.col("text"))).cast("long").alias("n_tokens")).filter("n_tokens > 0")


EXACT = TOKENS + ", exact AS (SELECT path, 3 * count(DISTINCT token) AS score, min_by(symbol, s.pos) AS symbol FROM s JOIN tok ON symbol = token GROUP BY 1)\n"
PARTIAL = EXACT + ", partial AS (SELECT path, 2::BIGINT AS score, min_by(symbol, s.pos) AS symbol FROM s JOIN tok ON length(token) > 2 AND contains(lower(symbol), token) WHERE path NOT IN (SELECT path FROM exact) GROUP BY 1)\n"
NAMES = PARTIAL + ", names AS (SELECT path, 2::BIGINT AS score, min(token) AS token FROM f JOIN tok ON contains(lower(stem), token) GROUP BY 1)\n"


@query("r02_exact", EXACT + "SELECT path, score, 'symbol:' || symbol AS signal FROM exact")
def _(spark, d):
    return r.exact_hits(tokens(spark), v.part_symbols(spark, d))


@query("r03_partial", PARTIAL + "SELECT path, score, 'partial-symbol:' || symbol AS signal FROM partial")
def _(spark, d):
    t, s = tokens(spark), v.part_symbols(spark, d)
    return r.partial_hits(t, s, r.exact_hits(t, s))


@query("r04_filename", NAMES + "SELECT path, score, 'filename:' || token AS signal FROM names")
def _(spark, d):
    return r.filename_hits(tokens(spark), v.part_files(spark, d))


@query("r06_topk", NAMES + """, near AS (SELECT path FROM f WHERE pos <= 5), hits AS (SELECT path, score, 'symbol:' || symbol AS signal FROM exact UNION ALL SELECT path, score, 'partial-symbol:' || symbol FROM partial UNION ALL SELECT path, score, 'filename:' || token FROM names UNION ALL SELECT path, 1, 'dep-proximity' FROM near),
g AS (SELECT path, sum(score)::BIGINT AS score, string_agg(signal, ',' ORDER BY signal) AS signals, min(CASE WHEN signal LIKE 'symbol:%' THEN 0 ELSE 1 END) AS phase FROM hits GROUP BY 1)
SELECT * FROM (SELECT path, score, signals, row_number() OVER (ORDER BY score DESC, phase, pos)::INTEGER AS place FROM g JOIN f USING (path)) WHERE place <= 20""")
def _(spark, d):
    files = v.part_files(spark, d)
    return r.top_files(tokens(spark), files, v.part_symbols(spark, d), 20, files.filter("pos <= 5"))


@query("r06_topk_of_each", FILES + """, q AS (SELECT p_partkey AS query_id, unnest(list_distinct([lower(w) FOR w IN string_split(p_name, ' ') || [substr(string_split(p_name, ' ')[1], 1, 3 + p_partkey % 2), (p_partkey % 97)::VARCHAR] IF length(w) > 1])) AS token FROM part),
x AS (SELECT query_id, path, count(DISTINCT token) AS n, arg_min(symbol, s.pos) AS symbol FROM q JOIN s ON symbol = token GROUP BY ALL),
y AS (SELECT query_id, path, arg_min(symbol, s.pos) AS symbol FROM q JOIN s ON length(token) > 2 AND contains(lower(symbol), token) GROUP BY ALL),
z AS (SELECT query_id, path, min(token) AS token FROM q JOIN f ON contains(lower(stem), token) GROUP BY ALL),
a AS (SELECT query_id, path FROM x UNION SELECT query_id, path FROM y UNION SELECT query_id, path FROM z),
g AS (SELECT a.*, 3 * coalesce(n, 0) + CASE WHEN n IS NULL AND y.symbol IS NOT NULL THEN 2 ELSE 0 END + CASE WHEN z.token IS NOT NULL THEN 2 ELSE 0 END AS score, CASE WHEN n IS NULL THEN 1 ELSE 0 END AS phase,
 list_sort(list_filter([CASE WHEN n IS NOT NULL THEN 'symbol:' || x.symbol ELSE 'partial-symbol:' || y.symbol END, 'filename:' || z.token], lambda t: t IS NOT NULL)) AS signals
 FROM a LEFT JOIN x USING (query_id, path) LEFT JOIN y USING (query_id, path) LEFT JOIN z USING (query_id, path))
SELECT query_id, path, score::BIGINT AS score, array_to_string(signals, ',') AS signals, place::INTEGER AS place FROM (SELECT g.*, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, phase, pos) AS place FROM g JOIN f USING (path)) WHERE place <= 5""")
def _(spark, d):
    """Every part asks a question of its own: its name's words, the beginning of one, and a number."""
    part = v.table(spark, d, "part")
    start = F.substring(F.substring_index("p_name", " ", 1), F.lit(1), (F.lit(3) + F.col("p_partkey") % 2).cast("int"))
    asked = part.select(F.col("p_partkey").alias("query_id"), F.concat_ws(" ", "p_name", start, F.col("p_partkey") % 97).alias("text"))
    return postings.top_files_of_each(asked, v.part_files(spark, d), v.part_symbols(spark, d), 5)


@query("r07_boosts", NAMES + """, g AS (SELECT path, sum(score)::BIGINT AS score FROM (SELECT path, score FROM exact UNION ALL SELECT path, score FROM partial UNION ALL SELECT path, score FROM names) GROUP BY 1)
SELECT g.path, score + CASE WHEN pos % 7 = 0 THEN 2 ELSE 0 END + CASE WHEN g.path IN (SELECT path FROM s WHERE lower(symbol) = 'red') THEN 2 ELSE 0 END + CASE WHEN pos % 5 = 0 THEN 1 ELSE 0 END AS score FROM g JOIN f USING (path)""")
def _(spark, d):
    files, symbols, t = v.part_files(spark, d), v.part_symbols(spark, d), tokens(spark)
    exact = r.exact_hits(t, symbols)
    scored = exact.unionByName(r.partial_hits(t, symbols, exact)).unionByName(r.filename_hits(t, files)).groupBy("path").agg(F.sum("score").alias("score"))
    gods = spark.createDataFrame([("RED",)], "label string")
    return r.boosted(scored, files.filter("pos % 7 = 0"), gods, symbols, files.filter("pos % 5 = 0"))


@query("j05_symbol_lookup", FILES + "SELECT symbol, path, pos FROM s WHERE symbol = 'red'")
def _(spark, d):
    return v.part_symbols(spark, d).filter("symbol = 'red'")


@query("j08_god_symbols", FILES + "SELECT DISTINCT label, symbol FROM s, (VALUES ('Red'), ('steelworks'), ('box')) g(label) WHERE lower(label) = lower(symbol) OR (length(symbol) >= 4 AND contains(lower(label), lower(symbol))) OR (length(label) >= 4 AND contains(lower(symbol), lower(label)))")
def _(spark, d):
    gods = spark.createDataFrame([("Red",), ("steelworks",), ("box",)], "label string")
    return r.god_matches(gods, v.part_symbols(spark, d))


@query("j11_mention_files", FILES + ", m AS (SELECT replace(p_name, ' ', '_') || '_' || p_partkey || '.ts' AS mention FROM part) SELECT mention, path FROM m JOIN f ON path = mention OR ends_with(path, '/' || mention)")
def _(spark, d):
    files = v.part_files(spark, d)
    return r.suffix_matches(files.select(F.concat("stem", F.lit(".ts")).alias("mention")), files)


DEPS = FILES + ", c AS (SELECT path AS src, 'x' || pos AS raw, list_value('none/' || pos, (SELECT path FROM f g WHERE g.pos = f.pos * 3), (SELECT path FROM f g WHERE g.pos = f.pos + 1)) AS cands FROM f), deps AS (SELECT DISTINCT src, target FROM (SELECT src, coalesce((SELECT path FROM f g WHERE g.path = cands[1]), cands[2], cands[3]) AS target FROM c) WHERE target IS NOT NULL)\n"


def dependencies(spark, d):
    files = v.part_files(spark, d)
    tasks = r.tasks_for(files.count())
    a, b = files.select(F.col("pos").alias("p3"), F.col("path").alias("a")).repartition(tasks, "p3"), files.select(F.col("pos").alias("p1"), F.col("path").alias("b")).repartition(tasks, "p1")
    own = files.select("path", "pos", (F.col("pos") * 3).alias("third"), (F.col("pos") + 1).alias("next"))
    raw = own.repartition(tasks, "third").join(a, F.col("third") == F.col("p3"), "left").repartition(tasks, "next").join(b, F.col("next") == F.col("p1"), "left")
    cands = raw.select(F.col("path").alias("src"), F.concat(F.lit("x"), "pos").alias("raw"), F.array(F.concat(F.lit("none/"), "pos"), F.col("a"), F.col("b")).alias("candidates"))
    return r.resolve_imports(cands, files, tasks)


@query("j01_import_resolution", DEPS + "SELECT src, target FROM deps")
def _(spark, d):
    return dependencies(spark, d)


@query("j02_reverse_deps", DEPS + "SELECT target AS src, count(*) AS n FROM deps GROUP BY 1")
def _(spark, d):
    return r.reverse(dependencies(spark, d).withColumnRenamed("target", "dst")).groupBy("src").agg(F.count(F.lit(1)).alias("n"))


@query("j03_symbol_graph", DEPS + "SELECT kind, count(*) AS n FROM (SELECT DISTINCT path AS a, symbol AS b, 'depends_on' AS kind FROM s UNION SELECT DISTINCT src, target, 'imports' FROM deps UNION SELECT DISTINCT deps.src, target || symbol, 'uses' FROM deps JOIN s ON s.path = target WHERE deps.src <> target) GROUP BY 1")
def _(spark, d):
    _, edges = r.symbol_graph(v.part_files(spark, d), v.part_symbols(spark, d), dependencies(spark, d).withColumnRenamed("target", "dst"))
    return edges.groupBy(F.col("type").alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query("j04_file_graph", DEPS + "SELECT 'file:' || src AS src, 'file:' || target AS dst FROM deps")
def _(spark, d):
    return dependencies(spark, d).select(F.concat(F.lit("file:"), "src").alias("src"), F.concat(F.lit("file:"), "target").alias("dst"))


@query("a09_index_counts", DEPS + "SELECT (SELECT count(*) FROM f) AS files, (SELECT count(*) FROM s) AS symbols, (SELECT count(*) FROM deps) AS edges")
def _(spark, d):
    count = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    return count(v.part_files(spark, d), "files").join(F.broadcast(count(v.part_symbols(spark, d), "symbols"))).join(F.broadcast(count(dependencies(spark, d), "edges")))


@query("a10_dir_coverage", DEPS + "SELECT dir, count(*) AS files, sum((SELECT count(*) FROM s WHERE s.path = f.path))::BIGINT AS symbols, sum((SELECT count(*) FROM deps WHERE src = f.path))::BIGINT AS edges FROM f GROUP BY 1")
def _(spark, d):
    files = v.part_files(spark, d)
    s = v.part_symbols(spark, d, dealt=True).groupBy("path").agg(F.count(F.lit(1)).alias("ns"))
    e = dependencies(spark, d).groupBy(F.col("src").alias("path")).agg(F.count(F.lit(1)).alias("ne"))
    return files.join(s, "path", "left").join(e, "path", "left").groupBy("dir").agg(F.count(F.lit(1)).alias("files"), F.sum(F.coalesce("ns", F.lit(0))).alias("symbols"), F.sum(F.coalesce("ne", F.lit(0))).alias("edges"))


@query("a26_inverted_index", FILES + "SELECT symbol, count(*) AS n, string_agg(path, ',' ORDER BY pos) AS paths FROM s GROUP BY 1")
def _(spark, d):
    return r.inverted_index(v.part_symbols(spark, d)).withColumn("paths", F.array_join("paths", ","))


@query("a27_dir_listing", FILES + ", n AS (SELECT dir, list_sort(list_distinct(list(string_split(path, '/')[2]))) AS names FROM f GROUP BY 1) SELECT dir, array_to_string(names[1:8], ', ') || CASE WHEN len(names) > 8 THEN ' +' || (len(names) - 8) || ' more' ELSE '' END AS listing FROM n")
def _(spark, d):
    return r.directory_listing(v.part_files(spark, d))


@query("p09_symbol_kind", FILES + "SELECT symbol, any_value(CASE WHEN regexp_matches(symbol, '^[A-Z][a-zA-Z0-9]*$') THEN 'class' WHEN regexp_matches(symbol, '^I[A-Z]') THEN 'interface' WHEN regexp_matches(symbol, '^[a-z][a-zA-Z0-9]*$') THEN 'function' ELSE 'variable' END) AS kind FROM s GROUP BY 1")
def _(spark, d):
    return v.part_symbols(spark, d).select("symbol", r.symbol_kind().alias("kind")).distinct()


@query("l06_workspace_symbols", FILES + "SELECT symbol, path FROM s WHERE symbol ILIKE '%ee%' ORDER BY symbol, pos LIMIT 25")
def _(spark, d):
    return v.part_symbols(spark, d).filter("symbol ILIKE '%ee%'").orderBy("symbol", "pos").limit(25).select("symbol", "path")
