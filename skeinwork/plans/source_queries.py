"""Queries over source files that Spark writes from the tables, scans and follows as they change."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import storage
from ..operators import lifecycle, navigation
from ..sources import changes, parsers, scopes, store
from ..sources import tables as v

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return add


def scratch(spark: SparkSession, name: str) -> str:
    return f"{storage.shared_root(spark)}/{name}-{storage.uuid.uuid4().hex[:12]}"


#: Keys that may share a file, so that files stay small however many parts there are.
FILE_KEYS = 5000
# Each part of the table is a declaration of its brand's file: @ stands for its key, ~ for its name.
TS_KINDS = [
    ("export function f@<\n  T extends { name: '~' },\n>(a: T, s = `~ ${a.name + `}`} {`): { out: T } | undefined {\n  return /[/{'\"]/.test(s) ? { out: a } : undefined\n}\n", "export function f@<\n  T extends { name: '~' },\n>(a: T, s = `~ ${a.name + `}`} {`): { out: T } | undefined { ... }", "f@"),
    ("// class No@ {}\n@Named('~')\nexport class C@ extends mix({ name: '~' }) {\n  run() { function no() {} return '}' }\n}\n", "export class C@ extends mix({ name: '~' }) { ... }", "C@"),
    ("type T@ =\n  | { name: '~' }\n  | (() => void)\nexport default async function g@() { return 4 / 2 / 1 }\n", "type T@ =\n  | { name: '~' }\n  | (() => void)\nexport async function g@() { ... }", "T@,g@"),
    ("export interface I@ { name: '~' }\nconst x@ = { type: 1, class: function no() {} }\n", "export interface I@ { ... }", "I@"),
]
RS_KINDS = [
    ("#[doc = \"~ {\"]\npub fn f@<'a>(s: &'a str, c: fn(char) -> bool) -> &'a str { if c('{') { r#\"fn no() { \"#; } s }\n", "pub fn f@<'a>(s: &'a str, c: fn(char) -> bool) -> &'a str { ... }", "f@"),
    ("/* /* struct No; */ ~ */\npub struct S@(pub [u8; 4]);\nuse crate::m@::{a, b};\n", "pub struct S@(pub [u8; 4]);", "S@"),
    ("macro_rules! m@ { () => { fn no() {} } }\npub(crate) enum E@ { A { name: u8 }, B }\n", "pub(crate) enum E@ { ... }", "E@"),
]


def tree_of(spark: SparkSession, d: str, kinds: list[tuple[str, str, str]], end: str) -> DataFrame:
    """(path, content) of a scanned tree with a file for each brand and range of keys, its parts in the order of their keys."""
    root = scratch(spark, "sources")
    part = v.table(spark, d, "part")
    text = F.element_at(F.array(*[F.lit(k[0]) for k in kinds]), (F.col("p_partkey") % len(kinds) + 1).cast("int"))
    text = F.replace(F.replace(text, F.lit("@"), F.col("p_partkey").cast("string")), F.lit("~"), F.col("p_name"))
    write_files(part, text, root)
    found = store.scan(spark, root, ["txt"])
    return found.select(F.concat(folder("path"), F.lit(end)).alias("path"), "content")


def folder(path: str) -> F.Column:
    return F.regexp_extract(F.url_decode(path), "at=([^/]*)/", 1)


def write_files(part: DataFrame, text: F.Column, root: str) -> None:
    """A file for each brand and range of keys; files that are there for them already go."""
    files = part.groupBy(F.concat_ws("-", "p_brand", F.floor(F.col("p_partkey") / FILE_KEYS)).alias("at")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", text.alias("text")))), lambda r: r["text"]), "").alias("value"))
    files.repartition("at").write.partitionBy("at").mode("overwrite").option("partitionOverwriteMode", "dynamic").text(root)


def tree_sql(kinds: list[tuple[str, str, str]], end: str, imports: str) -> str:
    one = lambda i: "list_extract([" + ", ".join("'" + k[i].replace("'", "''") + "'" for k in kinds) + f"], (p_partkey % {len(kinds)} + 1)::INTEGER)"
    full = lambda i: f"replace(replace({one(i)}, '@', p_partkey::VARCHAR), '~', p_name)"
    joined = lambda i, by: f"string_agg({full(i)}, '{by}' ORDER BY p_partkey)"
    return f"SELECT p_brand || '-' || p_partkey // {FILE_KEYS} || '{end}' AS path, {joined(1, chr(10))} AS skeleton, {joined(2, ',')} AS exports, {imports} AS imports FROM part GROUP BY p_brand, p_partkey // {FILE_KEYS}"


def parsed_tree(spark, d, kinds, end):
    rows = parsers.parse_files(tree_of(spark, d, kinds, end))
    return storage.cut(rows.select("path", "skeleton", F.array_join("exports", ",").alias("exports"), F.array_join("imports", ",").alias("imports")), "parsed")


@query("p01_tree", tree_sql(TS_KINDS, ".ts", "''"))
def _(spark, d):
    """TypeScript files with templates, regular expressions, decorators and generics over lines, scanned and parsed."""
    return parsed_tree(spark, d, TS_KINDS, ".ts")


@query("p03_tree", tree_sql(RS_KINDS, ".rs", "coalesce(string_agg('crate::m' || p_partkey || '::{a, b}', ',' ORDER BY p_partkey) FILTER (p_partkey % 3 = 1), '')"))
def _(spark, d):
    """Rust files with lifetimes, raw strings, nested comments, attributes and macros, scanned and parsed."""
    return parsed_tree(spark, d, RS_KINDS, ".rs")


OLD, NEW = "export class Old@ { name = '~' }\n", "export class New@ { name = '~' }\n"


def changed_tree(spark: SparkSession, d: str):
    """A tree that is written and then partly written anew, with a stream of its changes: yields (root, stream) after each."""
    root, part = scratch(spark, "followed"), v.table(spark, d, "part")
    said = lambda t: F.replace(F.replace(F.lit(t), F.lit("@"), F.col("p_partkey").cast("string")), F.lit("~"), F.col("p_name"))
    for rows, text in ((part, OLD), (part.filter("p_brand LIKE '%1'"), NEW)):
        write_files(rows, said(text), root)
        yield root, changes.watch(spark, root, f"{root}-snapshots", ["txt"])


@query("s15_file_changes", f"""WITH f AS (SELECT DISTINCT p_brand || '-' || p_partkey // {FILE_KEYS} AS folder FROM part)
SELECT folder, 'created' AS kind, 1::BIGINT AS snapshot, 1::BIGINT AS n FROM f UNION ALL
SELECT folder, unnest(['created', 'deleted']), 2, 1 FROM f WHERE folder LIKE '%1-%'""")
def _(spark, d):
    """A tree's files as they come, and as those of some folders are written anew, by a stream that goes on after a restart."""
    out = None
    for root, stream in changed_tree(spark, d):
        stream.writeStream.format("parquet").option("checkpointLocation", f"{root}-log").trigger(availableNow=True).start(f"{root}-told").awaitTermination()
        out = spark.read.schema(stream.schema).parquet(f"{root}-told")
    return out.groupBy(folder("path").alias("folder"), "kind", "snapshot").agg(F.count(F.lit(1)).alias("n"))


@query("z02_followed", f"""SELECT p_brand || '-' || p_partkey // {FILE_KEYS} AS folder, string_agg('export class ' || CASE WHEN p_brand LIKE '%1' THEN 'New' ELSE 'Old' END || p_partkey || ' {{ ... }}', chr(10) ORDER BY p_partkey) AS skeleton
FROM part GROUP BY p_brand, p_partkey // {FILE_KEYS}""")
def _(spark, d):
    """The index of a tree, rebuilt from the stream of its changes and merged with the version before."""
    out = None
    for root, stream in changed_tree(spark, d):
        out = lifecycle.rebuilt(stream, f"{root}-index", *lifecycle.file_index(spark, root, ["txt"], lambda path: F.concat(path, F.lit(".ts"))))
    return out.select(folder("path").alias("folder"), "skeleton")


#: A file for each part: # is its key, & that of the file that it imports from, ! that of one whose function it uses. The file's name, a parameter and a local shadow one another.
SCOPED = "import { top as far } from './f&'\nexport const top = 1\nexport function only#(top) {\n  { const top = 2; use(top) }\n  return top + far + only!\n}\nconst end = top\n"
_scoped = "'" + SCOPED.replace("'", "''") + "'"


@query("l01_scoped", f"""WITH p AS (SELECT p_partkey AS k, greatest(p_partkey - 1, (SELECT min(p_partkey) FROM part)) AS b, (SELECT max(p_partkey) + min(p_partkey) FROM part) - p_partkey AS o FROM part),
t AS (SELECT 'f' || k AS path, k, b, o, replace(replace(replace({_scoped}, '#', k::VARCHAR), '&', b::VARCHAR), '!', o::VARCHAR) AS c FROM p),
a AS (SELECT *, strpos(c, 'const top = 1') + 5 AS outer_at, strpos(c, '(top)') AS param_at, strpos(c, 'const top = 2') + 5 AS inner_at, strpos(c, 'use(top)') + 3 AS u1, strpos(c, 'return top') + 6 AS u2, strpos(c, ' far + ') AS u3, strpos(c, ' + only' || o || chr(10)) + 2 AS u4, strpos(c, 'end = top') + 5 AS u5, strpos(c, 'function only') + 8 AS own FROM t),
r AS (SELECT path, 'top' AS symbol, u1 AS at_, 'scope' AS how, path AS target, inner_at AS target_at FROM a UNION ALL SELECT path, 'top', u2, 'scope', path, param_at FROM a UNION ALL SELECT path, 'top', u5, 'scope', path, outer_at FROM a
UNION ALL SELECT a.path, 'far', a.u3, 'import', b.path, b.outer_at FROM a JOIN a b ON b.k = a.b
UNION ALL SELECT a.path, 'only' || a.o, a.u4, CASE WHEN a.k = a.o THEN 'scope' ELSE 'index' END, b.path, b.own FROM a JOIN a b ON b.k = a.o)
SELECT path, symbol, at_ AS "at", how, target, target_at FROM r""")
def _(spark, d):
    """Where each name of each part's file is declared: locals before parameters before the file's, then imports, then the index."""
    part = v.table(spark, d, "part")
    ends = part.agg(F.min("p_partkey").alias("first"), F.max("p_partkey").alias("last"))
    told = lambda c, mark, x: F.replace(c, F.lit(mark), x.cast("string"))
    text = told(told(told(F.lit(SCOPED), "#", F.col("p_partkey")), "&", F.greatest(F.col("p_partkey") - 1, F.col("first"))), "!", F.col("first") + F.col("last") - F.col("p_partkey"))
    files = part.join(F.broadcast(ends)).select(F.concat(F.lit("f"), "p_partkey").alias("path"), text.alias("content"))
    names = storage.cut(scopes.names_of_files(files), "names")
    targets = names.filter("kind = 'imported'").select("path", "source").distinct().withColumn("target", F.substring("source", 3, 99))
    return navigation.scoped_definitions(names, targets.join(files.select(F.col("path").alias("target")), "target", "left_semi"))
