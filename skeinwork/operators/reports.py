"""Texts for people: what analyses, indexes and turns report, as column expressions over their rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as x
from ..functions import paths as p


def text(value: Column) -> Column:
    return value.cast("string")


def several(n: Column, one: str) -> Column:
    """'3 cycles', '1 cycle', null for none."""
    return F.when(n > 0, F.concat(text(n), F.lit(f" {one}"), F.when(n == 1, "").otherwise("s")))


def quality_line(score: Column, communities: Column, gods: Column, cycles: Column, cached: Column, ms: Column, command: str = "/scope graph") -> Column:
    """One line on a graph's quality, with the command that tells more where it is poor."""
    parts = [
        F.concat(F.lit("Graph quality "), text(score), F.lit("/100")),
        F.when(communities > 1, F.concat(text(communities), F.lit(" communities"))),
        several(gods, "god node"),
        several(cycles, "cycle"),
        F.when(cached, "(from cache)").otherwise(F.concat(F.lit("— "), text(ms), F.lit("ms"))),
        F.when((cycles > 0) | (score < 70), f"— run {command}"),
    ]
    return F.concat_ws(" · ", *parts)


#: What a status line shows, by column, before and after its number, and from which number on.
STATUS = (
    ("files", "", " files", 1),
    ("map_tokens", "map ~", "t", 1),
    ("injections", "", " inj", 1),
    ("context_files", "", " ctx", 1),
    ("guidance", "", " guid", 1),
    ("communities", "", " comm", 2),
    ("quality", "Q", "", 0),
    ("saved", "saved ~", "t", 1),
    ("steered", "🛡 ", "", 1),
)


def status_line() -> Column:
    """Of a row with STATUS's columns; null or too small ones are left out."""
    return F.concat_ws(" | ", *[F.when(F.col(c) >= least, F.concat(F.lit(before), text(F.col(c)), F.lit(after))) for c, before, after, least in STATUS])


#: Marks of how stale an index is.
MARKS = {"none": "✅", "warning": "⚠️", "critical": "🔴"}


def staleness_notice(stale: Column, severity: Column, reasons: Column, built_at: Column) -> Column:
    mark = F.create_map(*[F.lit(v) for kv in MARKS.items() for v in kv]).getItem(severity)
    listed = F.array_join(F.transform(reasons, lambda r: F.concat(F.lit("\n  • "), r)), "")
    return F.when(stale, F.concat(mark, F.lit(" Index may be stale:"), listed)).otherwise(F.concat(F.lit(f"{MARKS['none']} Fresh ("), text(built_at), F.lit(")")))


def build_notice(ms: Column, commit: Column, branch: Column, languages: Column) -> Column:
    """Of a build: time, commit with its branch, and languages (array of structs language, files, symbols, edges)."""
    git = F.when(commit.isNotNull() & (commit != ""), F.concat(F.lit("\nGit: "), F.substring(commit, 1, 7), F.when(F.coalesce(branch, F.lit("")) != "", F.concat(F.lit(" ("), branch, F.lit(")"))).otherwise(""))).otherwise("")
    each = F.transform(languages, lambda v: F.concat(F.lit("\n  "), v.language, F.lit(": "), text(v.files), F.lit(" files, "), text(v.symbols), F.lit(" symbols, "), text(v.edges), F.lit(" edges")))
    return F.concat(F.lit("Build completed in "), text(ms), F.lit("ms"), git, F.when(F.size(languages) > 0, F.concat(F.lit("\nLanguages:"), F.array_join(each, ""))).otherwise(""))


def cycle_report(cycles: DataFrame, components: DataFrame, most: int = 5) -> DataFrame:
    """(report) on a graph's cycles (root_pos, found, members, length, severity) and strong components (scc), one row."""
    top = cycles.orderBy("root_pos", "found").limit(most).agg(F.array_sort(F.collect_list(F.struct("root_pos", "found", "severity", "length", "members"))).alias("l"))
    counts = cycles.agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(cycles.select(F.explode("members").alias("m")).agg(F.count_distinct("m").alias("nodes"))))
    strong = components.groupBy("scc").agg(F.count(F.lit(1)).alias("size")).filter("size > 1").agg(F.count(F.lit(1)).alias("strong"))
    one = counts.join(F.broadcast(strong)).join(F.broadcast(top))
    rows = F.transform("l", lambda v, i: F.concat(F.lit("\n  "), text(i + 1), F.lit(". ["), v.severity, F.lit("] Length "), text(v.length), F.lit(": "), F.array_join(v.members, " → ")))
    head = F.concat(F.lit("Cycle Detection Report\n" + "=" * 40 + "\nHas Cycles: "), F.when(F.col("n") > 0, "YES").otherwise("NO"), F.lit("\nTotal Cycles: "), text(F.col("n")), F.lit("\nNodes in Cycles: "), text(F.col("nodes")), F.lit("\nStrongly Connected Components: "), text(F.col("strong")))
    return one.select(F.concat(head, F.when(F.col("n") > 0, F.concat(F.lit("\n\nTop Cycles:"), F.array_join(rows, ""))).otherwise("")).alias("report"))


def listed(rows: DataFrame, key: str, order: list[str], line: Column, head: str, most: int, more: str) -> DataFrame:
    """(key, text): a heading, the first lines of each key and how many there are beyond. Only `most` lines a key are gathered."""
    from pyspark.sql.window import Window

    w = Window.partitionBy(key).orderBy(*order)
    total = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    first = rows.withColumn("_i", F.row_number().over(w)).filter(F.col("_i") <= most).select(key, "_i", line.alias("_t"))
    lists = first.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("_i", "_t"))).alias("_l")).join(total, key)
    rest = F.when(F.col("_n") > most, F.concat(F.lit("\n"), F.lit(more.split("{}")[0]), text(F.col("_n") - most), F.lit(more.split("{}")[1]))).otherwise("")
    return lists.select(key, F.concat(F.lit(head + "\n"), F.array_join(F.transform("_l", lambda v: v["_t"]), "\n"), rest).alias("text"))


def compiler_guidance(errors: DataFrame) -> DataFrame:
    """(conv_id, text) on compile errors (conv_id, path, line, col)."""
    line = F.concat(F.lit("- `"), "path", F.lit("` → `lsp_hover` with `line: "), text(F.col("line")), F.lit("`, `column: "), text(F.col("col")), F.lit("`"))
    head = "🔧 COMPILER ERRORS → LSP:\nRecent build/test output references these locations. Prefer `lsp_hover` for type context and `lsp_go_to_definition` before patching."
    return listed(errors, "conv_id", ["path", "line", "col"], line, head, 6, "- ... and {} more error site(s)")


def god_section(gods: DataFrame) -> DataFrame:
    """(graph, text) on the hubs (graph, node_pos, label, in_degree, out_degree, criticality) of graphs."""
    line = F.concat(F.lit("  - `"), "label", F.lit("` ("), text(F.col("in_degree")), F.lit(" in, "), text(F.col("out_degree")), F.lit(" out, "), "criticality", F.lit(")"))
    return listed(gods, "graph", ["node_pos"], line, "**God Nodes (most depended-on symbols):**", 5, "  - ... and {} more")


def surprise_section(found: DataFrame, most: int = 5) -> DataFrame:
    """(graph, text) on surprising edges (graph, pos, src, dst, reason)."""
    line = F.concat(F.lit("  - `"), "src", F.lit("` → `"), "dst", F.lit("` ("), "reason", F.lit(")"))
    return listed(found, "graph", ["pos"], line, "**Notable connections:**", most, "  - ... and {} more")


def node_label(node_id: Column) -> Column:
    return F.coalesce(x.node_symbol(node_id), F.substring_index(node_id, ":", -1))


def display_path(path: Column, root: Column) -> Column:
    """Relative to the root where the path is under it."""
    base = F.concat(F.regexp_replace(p.normalized(root), "/$", ""), F.lit("/"))
    own = p.normalized(path)
    return F.when(own.startswith(base), F.substring(own, F.length(base) + 1, F.length(own))).otherwise(path)


def context_section(files: DataFrame, title: str) -> DataFrame:
    """(turn, text) of context files (turn, pos, path, content), whole, under a title."""
    body = F.array_join(F.transform("l", lambda v: F.concat(F.lit("## "), v.path, F.lit("\n\n"), v.content)), "\n\n")
    lists = files.groupBy("turn").agg(F.array_sort(F.collect_list(F.struct("pos", "path", "content"))).alias("l"))
    return lists.select("turn", F.concat(F.lit(f"\n\n# {title}\n\nAdditional project instructions and guidelines:\n\n"), body, F.lit("\n")).alias("text"))


def startup_notice(files: DataFrame, title: str, root: Column) -> DataFrame:
    """(turn, text): which context files (turn, pos, path) were loaded."""
    lists = files.select("turn", F.struct("pos", F.concat(F.lit("  "), display_path(F.col("path"), root)).alias("t")).alias("s")).groupBy("turn").agg(F.array_sort(F.collect_list("s")).alias("l"))
    return lists.select("turn", F.concat(F.lit("[context-files] "), text(F.size("l")), F.lit(f' file(s) loaded for "{title}":\n'), F.array_join(F.transform("l", lambda v: v.t), "\n")).alias("text"))
