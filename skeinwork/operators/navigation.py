"""Definitions, references and outlines that an index can answer, and matches between paths, nodes and mentions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import paths as p
from ..functions import text as x

WORD = r"[\w$]+"


def god_files(gods: DataFrame, files: DataFrame) -> DataFrame:
    """(node_id, path): files that a god node (node_id, label) stands for, by the whole path or its end; a symbol's node
    counts where the file's stem, or the label, is the symbol."""
    # dealt out before they grow: a scan's task is as large as its part of the file, a dealt one is not
    gods, files = gods.repartition("node_id"), files.select("path").repartition("path")
    parsed = gods.select("node_id", F.lower(x.node_path(F.col("node_id"))).alias("end"), F.lower(x.node_symbol(F.col("node_id"))).alias("symbol"), F.lower("label").alias("label"))
    rel = F.lower(F.replace(F.col("path"), F.lit("\\"), F.lit("/")))
    each = files.select("path", F.regexp_replace(p.base_name(rel), r"\.[^.]+$", "").alias("stem"), F.explode(p.suffixes(rel)).alias("end"))
    return each.join(parsed, "end").filter("symbol IS NULL OR stem = symbol OR label = symbol").select("node_id", "path").distinct()


#: Fixed value: file names and paths in messages.
MENTION = r"[\w./\-]+\.(?:ts|tsx|js|jsx|mjs|cjs|py|rs|go)"


def node_votes(messages: DataFrame, membership: DataFrame) -> DataFrame:
    """(conv_id, community, votes): for each message and each node of (node_id, community), the mentioned files that are
    the node's file, its end or its name: all of these share the base name, so that is what is joined."""
    said = messages.select("conv_id", "pos", F.explode(F.array_distinct(F.regexp_extract_all("content", F.lit(MENTION), F.lit(0)))).alias("mention"))
    said = said.withColumn("base", p.base_name(F.col("mention")))
    nodes = membership.filter("contains(node_id, ':')").select("community", F.split_part(F.regexp_replace("node_id", "^[^:]*:", ""), F.lit(":"), F.lit(1)).alias("at"))
    per = nodes.groupBy("community", p.base_name(F.col("at")).alias("base")).agg(F.count(F.lit(1)).alias("nodes"))
    return said.join(per, "base").groupBy("conv_id", "community").agg(F.sum("nodes").alias("votes"))


def active_community(votes: DataFrame) -> DataFrame:
    """(conv_id, community) with most votes; of equals the first by name."""
    top = votes.groupBy("conv_id").agg(F.max("votes").alias("votes"))
    return votes.join(top, ["conv_id", "votes"]).groupBy("conv_id").agg(F.min("community").alias("community"))


def overlapping(anomalies: DataFrame, focus: DataFrame) -> DataFrame:
    """(anomaly): those of (anomaly, node_id) with a file that is, ends in or is the end of a file in focus (path)."""
    path = x.node_path(F.col("node_id"))
    own = anomalies.filter(x.node_symbol(F.col("node_id")).isNull()).select("anomaly", F.replace(path, F.lit("\\"), F.lit("/")).alias("path"))
    seen = focus.select(F.replace(F.col("path"), F.lit("\\"), F.lit("/")).alias("path")).distinct()
    a = own.join(seen.select(F.explode(p.suffixes(F.col("path"))).alias("path")).distinct(), "path", "left_semi")
    b = own.select("anomaly", F.explode(p.suffixes(F.col("path"))).alias("path")).join(seen, "path", "left_semi")
    return a.select("anomaly").unionByName(b.select("anomaly")).distinct()


def word_at(text: Column, character: Column) -> Column:
    """The word that holds a 0-based character of a line, or ends just before it; null between words."""
    left = F.regexp_extract(F.substring(text, F.lit(1), character), rf"({WORD})$", 1)
    right = F.regexp_extract(F.substring(text, character + 1, F.length(text)), rf"^({WORD})", 1)
    return F.nullif(F.concat(left, right), F.lit(""))


def words_under(cursors: DataFrame, lines: DataFrame) -> DataFrame:
    """(path, line, character, symbol): the word under each cursor (0-based)."""
    at = cursors.join(lines.select("path", F.col("line_no").alias("_no"), "text"), "path").filter("_no = line + 1")
    return at.select("path", "line", "character", word_at(F.col("text"), F.col("character")).alias("symbol"))


def definitions(cursors: DataFrame, lines: DataFrame, symbols: DataFrame) -> DataFrame:
    """(path, line, character, symbol, target): where the word under each cursor is exported."""
    return words_under(cursors, lines).join(symbols.select("symbol", F.col("path").alias("target")).distinct(), "symbol").select("path", "line", "character", "symbol", "target")


def definition_counts(cursors: DataFrame, lines: DataFrame, symbols: DataFrame) -> DataFrame:
    """(path, line, character, symbol, n, first): in how many files the word under each cursor is exported, and the first by path.

    Files are counted once a symbol, so a word that many cursors and many files share makes no pairs of them.
    """
    per = symbols.select("symbol", "path").distinct().groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.min("path").alias("first"))
    return words_under(cursors, lines).join(per, "symbol").select("path", "line", "character", "symbol", "n", "first")


def scoped_definitions(names: DataFrame, targets: DataFrame) -> DataFrame:
    """(path, symbol, at, how, target, target_at) of every use in names (path, kind, symbol, at, start, end, source, original).

    A use means the declaration of its name whose scope holds it most closely; else the import of the name, in the file that
    targets (path, source, target) resolve its source to, at that file's own outermost declaration if there is one; else,
    where just one file declares the name at its top, that one. All joins are on a name within a file, or on a name.
    """
    uses = names.filter("kind = 'used'").select("path", "symbol", "at")
    declared = names.filter("kind = 'declared'").select("path", "symbol", F.col("at").alias("target_at"), "start", "end")
    inside = uses.join(declared, ["path", "symbol"]).filter("start <= at AND at < end")
    near = inside.groupBy("path", "symbol", "at").agg(F.max(F.struct("start", (-F.col("end")).alias("end"), F.col("target_at").alias("t"))).alias("d"))
    local = near.select("path", "symbol", "at", F.lit("scope").alias("how"), F.col("path").alias("target"), F.col("d.t").alias("target_at"))
    rest = uses.join(near.select("path", "symbol", "at"), ["path", "symbol", "at"], "left_anti")
    tops = declared.filter("start = 0").groupBy("path", "symbol").agg(F.min("target_at").alias("target_at"))
    imports = names.filter("kind = 'imported'").select("path", "symbol", "source", "original").join(targets, ["path", "source"]).dropDuplicates(["path", "symbol"])
    there = imports.join(tops.select(F.col("path").alias("target"), F.col("symbol").alias("original"), "target_at"), ["target", "original"], "left")
    brought = rest.join(there.select("path", "symbol", "target", "target_at"), ["path", "symbol"]).select("path", "symbol", "at", F.lit("import").alias("how"), "target", "target_at")
    # what is imported from outside the index is nobody's global
    left = rest.join(names.filter("kind = 'imported'").select("path", "symbol").distinct(), ["path", "symbol"], "left_anti")
    only = tops.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.first("path").alias("target"), F.first("target_at").alias("target_at")).filter("n = 1").drop("n")
    elsewhere = left.join(only, "symbol").select("path", "symbol", "at", F.lit("index").alias("how"), "target", "target_at")
    return local.unionByName(brought).unionByName(elsewhere)


def batch_definitions(requests: DataFrame, symbols: DataFrame) -> DataFrame:
    """(request, symbol, path) of requests (request, symbols array): the first file by position that has each, or null."""
    each = requests.select("request", F.explode(F.array_distinct("symbols")).alias("symbol"))
    first = symbols.groupBy("symbol").agg(F.min_by("path", "pos").alias("path"))
    return each.join(first, "symbol", "left").select("request", "symbol", "path")


def references(wanted: DataFrame, lines: DataFrame, most: int = 20) -> DataFrame:
    """(symbol, path, line, place, more): the first `most` lines that hold each wanted symbol, and how many there are beyond."""
    words = lines.select("path", "line_no", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(f"({WORD})"), F.lit(1)))).alias("symbol"))
    hits = words.join(wanted.select("symbol").distinct(), "symbol")
    total = hits.groupBy("symbol").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy("symbol").orderBy("path", "line_no")
    first = hits.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= most)
    return first.join(total, "symbol").select("symbol", "path", (F.col("line_no") - 1).alias("line"), "place", F.greatest(F.col("_n") - most, F.lit(0)).alias("more"))


def first_dependents(deps: DataFrame, most: int = 5) -> DataFrame:
    """(path, place, dependent): the first files by name that import each."""
    w = Window.partitionBy("dst").orderBy("src")
    return deps.select("src", "dst").distinct().withColumn("place", F.row_number().over(w)).filter(F.col("place") <= most).select(F.col("dst").alias("path"), "place", F.col("src").alias("dependent"))


def outline(symbols: DataFrame) -> DataFrame:
    """(path, place, label): a file's symbols (path, pos, symbol, depth) in order, two blanks a level."""
    w = Window.partitionBy("path").orderBy("pos")
    return symbols.select("path", F.row_number().over(w).alias("place"), F.concat(F.expr("repeat('  ', depth)"), "symbol").alias("label"))


def signatures(calls: DataFrame, skeletons: DataFrame) -> DataFrame:
    """(symbol, path, signature): the first line of each file's skeleton that opens a parameter list after the called symbol."""
    lines = skeletons.select("path", F.posexplode(F.split("skeleton", "\n")).alias("i", "line"))
    named = lines.select("path", "i", F.trim("line").alias("signature"), F.regexp_extract("line", rf"({WORD})\s*(?:<[^>]*>)?\(", 1).alias("symbol")).filter("symbol <> ''")
    found = named.join(calls.select("symbol").distinct(), "symbol")
    return found.groupBy("symbol", "path").agg(F.min_by("signature", "i").alias("signature"))


#: Words for the levels of a diagnostic.
SEVERITIES = {1: "error", 2: "warning", 3: "info", 4: "hint"}


def diagnostics_report(diagnostics: DataFrame) -> DataFrame:
    """(path, report) of (path, idx, severity, line, character, code, source, message), places from 0."""
    level = F.coalesce(F.create_map(*[F.lit(v) for kv in SEVERITIES.items() for v in kv]).getItem(F.col("severity")), F.lit("unknown"))
    code = F.when(F.col("code").isNotNull(), F.concat(F.lit(" ("), "code", F.lit(")"))).otherwise("")
    source = F.when(F.coalesce("source", F.lit("")) != "", F.concat(F.lit("["), "source", F.lit("] "))).otherwise("")
    line = F.concat(F.lit("  L"), (F.col("line") + 1).cast("string"), F.lit(":"), (F.col("character") + 1).cast("string"), F.lit(" ["), level, F.lit("]"), code, F.lit(" "), source, "message")
    lists = diagnostics.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("idx", line.alias("text")))).alias("l"))
    return lists.select("path", F.concat(F.lit("LSP diagnostics for "), "path", F.lit(" ("), F.size("l").cast("string"), F.lit("):\n\n"), F.array_join(F.transform("l", lambda v: v.text), "\n")).alias("report"))


def signature_help(label: Column, documentation: Column, parameters: Column, active: Column) -> Column:
    """A signature in bold, its documentation and its parameters, the active one marked."""
    doc = F.when(F.trim(F.coalesce(documentation, F.lit(""))) != "", F.concat(F.lit("\n"), F.trim(documentation))).otherwise("")
    rows = F.transform(parameters, lambda v, i: F.concat(F.when(i == F.coalesce(active, F.lit(0)), "→ ").otherwise("  "), v))
    listed = F.when(F.size(parameters) > 0, F.concat(F.lit("\n\nParameters:\n"), F.array_join(rows, "\n"))).otherwise("")
    return F.when(label.isNull(), "No signature help available at this position.").otherwise(F.concat(F.lit("**"), label, F.lit("**"), doc, listed))
