"""Text, line and streaming queries over documents and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import storage
from ..functions import text as x
from ..operators import lines as ln
from ..operators import previews
from ..sources import tables as v
from ..streaming import anchors
from ..streaming import stream as st

QUERIES: dict = {}
ORACLES: dict = {}

LINES = "WITH split AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line_no FROM documents), lines AS (SELECT doc_id, line_no, text, substr(md5(text), 1, 2) AS anchor FROM split)\n"


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return add


def lines(spark, d):
    return v.document_lines(spark, d).withColumn("anchor", F.substring(F.md5(F.col("text").cast("binary")), 1, 2))


@query("f01_tokens", "SELECT doc_id, ceil(length(text) / 4)::BIGINT AS tokens FROM documents")
def _(spark, d):
    return v.table(spark, d, "documents").select("doc_id", x.estimate_tokens("text").alias("tokens"))


@query("f04_match_normal", "SELECT doc_id, md5(regexp_replace(lower(text), '[^a-z0-9_]', '', 'g')) AS h FROM documents")
def _(spark, d):
    return v.table(spark, d, "documents").select("doc_id", F.md5(x.match_normal(F.col("text")).cast("binary")).alias("h"))


@query("f09_rolling_hash", "SELECT p_partkey, list_reduce(list_prepend(0::BIGINT, list_transform(string_split(p_name, ''), lambda c: ascii(c)::BIGINT)), lambda h, c: (h * 31 + c + 2147483648 + 4294967296 * 100) % 4294967296 - 2147483648) AS h FROM part")
def _(spark, d):
    return v.table(spark, d, "part").select("p_partkey", x.rolling_hash(F.col("p_name")).alias("h"))


@query("f10_line_hash")
def _(spark, d):
    return v.document_lines(spark, d).select("doc_id", "line_no", x.line_hash_column(F.col("line_no"), F.col("text")).alias("hash"))


@query("f11_anchored_lines")
def _(spark, d):
    return v.document_lines(spark, d).select("doc_id", "line_no", x.anchored(F.col("line_no"), F.col("text")).alias("line"))


@query("f13_line_endings", "SELECT doc_id, CASE WHEN instr(text, chr(13) || chr(10)) > 0 AND instr(text, chr(13) || chr(10)) < instr(text, chr(10)) THEN 'crlf' ELSE 'lf' END AS ending, md5(regexp_replace(text, '\\r\\n?', chr(10), 'g')) AS h FROM documents")
def _(spark, d):
    c = F.col("text")
    return v.table(spark, d, "documents").select("doc_id", x.line_ending(c).alias("ending"), F.md5(x.to_lf(c).cast("binary")).alias("h"))


@query("f14_min_indent", "WITH s AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM documents) SELECT doc_id, coalesce(min(CASE WHEN trim(l) <> '' THEN length(regexp_extract(l, '^([ \\t]*)', 1)) END), 0)::INTEGER AS indent FROM s GROUP BY 1")
def _(spark, d):
    return v.table(spark, d, "documents").select("doc_id", x.min_indent(F.split("text", "\n")).alias("indent"))


@query("p04_content_hash", "SELECT doc_id, sha256(text) AS content_hash FROM documents")
def _(spark, d):
    return v.table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("content_hash"))


ANCHORS = LINES + ", asked AS (SELECT doc_id, line_no AS line, anchor AS hash FROM lines)\n"


@query("j14_unique_rebase", ANCHORS + "SELECT a.doc_id, a.line, a.hash, CASE WHEN count(l.line_no) = 1 THEN min(l.line_no) END AS rebased FROM (SELECT DISTINCT * FROM asked) a LEFT JOIN lines l ON l.doc_id = a.doc_id AND l.line_no BETWEEN a.line - 5 AND a.line + 5 AND l.line_no <> a.line AND l.anchor = a.hash GROUP BY 1, 2, 3")
def _(spark, d):
    all_ = lines(spark, d)
    return ln.rebase(all_.select("doc_id", F.col("line_no").alias("line"), F.col("anchor").alias("hash")), all_)


@query("j15_reconcile", LINES + ", asked AS (SELECT doc_id, line_no + 2 AS line, anchor AS hash FROM lines) SELECT a.doc_id, a.line, a.hash, CASE WHEN count(l.line_no) = 1 THEN min(l.line_no) END AS rebased FROM (SELECT DISTINCT * FROM asked) a LEFT JOIN lines l ON l.doc_id = a.doc_id AND l.line_no BETWEEN a.line - 10 AND a.line + 10 AND l.anchor = a.hash GROUP BY 1, 2, 3")
def _(spark, d):
    all_ = lines(spark, d)
    return ln.rebase(all_.select("doc_id", (F.col("line_no") + 2).alias("line"), F.col("anchor").alias("hash")), all_, reach=10, own_line=True)


@query("h01_validate", LINES + ", asked AS (SELECT DISTINCT doc_id, line_no + line_no % 2 AS line, anchor AS hash FROM lines), near AS (SELECT a.doc_id, a.line, a.hash, count(*) AS n, min(l.line_no) AS p FROM asked a JOIN lines l ON l.doc_id = a.doc_id AND l.line_no BETWEEN a.line - 5 AND a.line + 5 AND l.line_no <> a.line AND l.anchor = a.hash GROUP BY 1, 2, 3) SELECT a.doc_id, a.line, a.hash, CASE WHEN s.doc_id IS NOT NULL THEN 'ok' WHEN near.n = 1 THEN 'rebased' ELSE 'mismatch' END AS status, CASE WHEN s.doc_id IS NOT NULL THEN a.line WHEN near.n = 1 THEN near.p END AS \"at\" FROM asked a LEFT JOIN lines s ON s.doc_id = a.doc_id AND s.line_no = a.line AND s.anchor = a.hash LEFT JOIN near ON near.doc_id = a.doc_id AND near.line = a.line AND near.hash = a.hash")
def _(spark, d):
    all_ = lines(spark, d)
    asked = all_.select("doc_id", (F.col("line_no") + F.col("line_no") % 2).alias("line"), F.col("anchor").alias("hash"))
    return ln.validated(asked, all_)


@query("h08_line_slice", LINES + ", n AS (SELECT doc_id, max(line_no) AS n FROM lines GROUP BY 1) SELECT doc_id, line_no, md5(text) AS h FROM lines JOIN n USING (doc_id) WHERE line_no BETWEEN least(3, n) AND least(7, n)")
def _(spark, d):
    return ln.read_slice(v.document_lines(spark, d), 3, 7).select("doc_id", "line_no", F.md5(F.col("text").cast("binary")).alias("h"))


@query("h09_window", LINES + ", c AS (SELECT doc_id, 10 AS a, 12 AS b FROM documents WHERE doc_id % 2 = 0) SELECT doc_id, line_no FROM lines LEFT JOIN c USING (doc_id) WHERE line_no BETWEEN coalesce(greatest(a - 15, 1), 1) AND least(coalesce(b + 15, 80), coalesce(greatest(a - 15, 1), 1) + 79)")
def _(spark, d):
    cited = v.table(spark, d, "documents").filter("doc_id % 2 = 0").select("doc_id", F.lit(10).alias("start"), F.lit(12).alias("end"))
    return ln.injection_window(cited, v.document_lines(spark, d)).select("doc_id", "line_no")


@query("h03_edits", LINES + ", e AS (SELECT doc_id, line_no, CASE WHEN line_no = 1 THEN 'new first' ELSE text END AS t FROM lines) SELECT doc_id, md5(string_agg(t, chr(10) ORDER BY line_no) || chr(10) || 'end') AS h FROM e GROUP BY 1")
def _(spark, d):
    docs = v.table(spark, d, "documents").select("doc_id")
    row = lambda i, op, line, new: docs.select("doc_id", F.lit(i).alias("idx"), F.lit(op).alias("op"), F.lit(line).cast("long").alias("line"), F.lit(None).cast("long").alias("end"), F.array(F.lit(new)).alias("lines"))
    edits = row(0, "append", None, "end").unionByName(row(1, "replace", 1, "new first")).unionByName(row(2, "append", None, "end"))
    return ln.edited(v.document_lines(spark, d), edits).select("doc_id", F.md5(F.col("text").cast("binary")).alias("h"))


@query("h07_runs", LINES + ", k AS (SELECT doc_id, line_no AS pos, CASE WHEN length(text) > 300 THEN '+' ELSE '=' END AS kind FROM lines), i AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - row_number() OVER (PARTITION BY doc_id, kind ORDER BY pos) AS g FROM k), r AS (SELECT doc_id, kind, count(*) AS n, min(pos) AS first FROM i GROUP BY doc_id, kind, g) SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY first) AS run, kind, n, first FROM r")
def _(spark, d):
    kinds = v.document_lines(spark, d).select("doc_id", F.col("line_no").alias("pos"), F.when(F.length("text") > 300, "+").otherwise("=").alias("kind"))
    return ln.previews(kinds)


@query("h07_previews", "SELECT event_id AS id, CASE event_id % 3 WHEN 0 THEN '-1  |' || event_type || chr(10) || ' ... 3 more unchanged lines' WHEN 1 THEN '-7  |' || event_type || chr(10) || '-8  |' || props ELSE '' END AS preview, CASE event_id % 3 WHEN 2 THEN user_id % 5 ELSE 0 END::BIGINT AS added, CASE WHEN event_id % 3 < 2 THEN 2 ELSE user_id % 5 END::BIGINT AS removed FROM events")
def _(spark, d):
    """Of a diff for each event: a deletion before a long unchanged run, two deletions, or as many changed pairs as its user has over."""
    e = v.table(spark, d, "events")
    kind, n = F.col("event_id") % 3, (F.col("user_id") % 5).cast("int")
    same = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(7)), lambda i: F.concat(F.lit(" "), i, F.lit("|u"))), "\n")
    signed = lambda sign, text: F.array_join(F.transform(F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>")), lambda i: F.concat(F.lit(sign), i, F.lit("|"), text)), "\n")
    diff = F.when(kind == 0, F.concat(F.lit("-1|"), "event_type", F.lit("\n"), same, F.lit("\n-8|"), "props")).when(kind == 1, F.concat(F.lit("-7|"), "event_type", F.lit("\n-8|"), "props")).otherwise(F.concat_ws("\n", F.nullif(signed("-", F.col("event_type")), F.lit("")), F.nullif(signed("+", F.col("props")), F.lit(""))))
    out = previews.compact(e.select(F.col("event_id").alias("id"), diff.alias("diff")))
    # anchors have letters that SQL cannot make: of the first kind the lines without, of the last one the counts
    lines = F.filter(F.split("preview", "\n"), lambda x: x.startswith("-1 ") | x.startswith(" ... "))
    short = F.when(F.col("id") % 3 == 0, F.array_join(lines, "\n")).when(F.col("id") % 3 == 1, F.col("preview")).otherwise("")
    return out.select("id", short.alias("preview"), "added", "removed")


@query("z03_chunks", LINES + "SELECT doc_id, (line_no - 1) // 5 AS chunk, min(line_no) AS first_line, count(*) AS n_lines FROM lines GROUP BY 1, 2")
def _(spark, d):
    return ln.chunks(v.document_lines(spark, d), 5, 1 << 30).select("doc_id", "chunk", "first_line", "n_lines")


@query("z03_chunks_by_bytes")
def _(spark, d):
    return ln.chunks(v.document_lines(spark, d), 200, 2048)


EVENTS = "WITH g AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w >= INTERVAL 1 DAY THEN 1 ELSE 0 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), b AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS burst FROM g)\n"


def stream_path(spark, name):
    return f"{storage.shared_root(spark)}/{name}-{storage.uuid.uuid4().hex[:12]}"


def streamed(spark, stream, name):
    return st.run_available(stream, stream_path(spark, name), "append")


@query("z01_debounce_sessions", EVENTS + "SELECT user_id, burst::BIGINT AS burst, count(*) AS n FROM b GROUP BY 1, 2")
def _(spark, d):
    from pyspark.sql.window import Window

    e = v.table(spark, d, "events")
    bursts = e.groupBy("user_id", F.session_window("ts", "1 day").alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return bursts.select("user_id", F.row_number().over(Window.partitionBy("user_id").orderBy("w.start")).cast("long").alias("burst"), "n")


@query("z_tumbling", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def _(spark, d):
    e = v.table(spark, d, "events")
    return e.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


@query("z_stream_first_event", "SELECT user_id, count(*) AS n FROM (SELECT DISTINCT user_id, event_type FROM events) GROUP BY 1")
def _(spark, d):
    stream = st.first_of_each(st.events_stream(spark, d), ["user_id", "event_type"], "3650 days").select("user_id", "event_type")
    return streamed(spark, stream, "first-events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))


@query("z_stream_tumbling", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def _(spark, d):
    return st.run_whole(st.tumbling(st.events_stream(spark, d)), stream_path(spark, "tumbling")).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("z04_anchor_state", "SELECT event_type AS path, 2 AS n_lines, CASE WHEN p IS NULL THEN 2 WHEN p = props THEN 0 ELSE 1 END AS n_changed FROM (SELECT *, lag(props) OVER (PARTITION BY event_type ORDER BY event_id) AS p FROM events)")
def _(spark, d):
    reads = st.events_stream(spark, d).select(F.col("event_type").alias("path"), F.col("event_id").alias("pos"), F.concat_ws("\n", F.lit("head"), F.col("props")).alias("content"))
    return st.anchor_states(reads, stream_path(spark, "anchors"))


@query("z04_reconciled", """WITH c AS (SELECT event_type AS path, event_id AS pos, event_id % 3 AS k, event_id % 2 = 0 AS more, event_id % 5 AS t FROM events),
p AS (SELECT *, lag(k) OVER w AS pk, lag(more) OVER w AS pmore, lag(t) OVER w AS pt FROM c WINDOW w AS (PARTITION BY path ORDER BY pos)),
a AS (SELECT path, pos, 1 AS line, 1 AS now FROM p WHERE pk IS NOT NULL UNION ALL
SELECT path, pos, 2, CASE WHEN k = pk THEN 2 END FROM p WHERE pk IS NOT NULL UNION ALL
SELECT path, pos, 3, CASE WHEN more THEN 3 END FROM p WHERE pmore UNION ALL
SELECT path, pos, 3 + pmore::INT, CASE WHEN t = pt THEN 3 + more::INT END FROM p WHERE pk IS NOT NULL)
SELECT path, pos, line::BIGINT AS line, now::BIGINT AS now, CASE WHEN now = line THEN 'kept' WHEN now IS NULL THEN 'lost' ELSE 'moved' END AS fate FROM a""")
def _(spark, d):
    """Files that lose, gain and change lines between reads, one file an event type."""
    tail = F.concat(F.lit("tail"), F.col("event_id") % 5)
    content = F.concat_ws("\n", F.lit("top"), F.concat(F.lit("k"), F.col("event_id") % 3), F.when(F.col("event_id") % 2 == 0, "extra"), tail)
    reads = st.events_stream(spark, d).select(F.col("event_type").alias("path"), F.col("event_id").alias("pos"), content.alias("content"))
    return anchors.reconciled_whole(reads, stream_path(spark, "reconciled")).drop("hash")
