"""Ranked retrieval over an inverted index: files (path, pos, stem), symbols (symbol, path, pos), tokens (token)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranking import first, placed

DELIMITERS = r"[\s,.;:!?()\[\]{}\"'`<>=+*/\\|&^%$#@~-]+"


def query_tokens(text: Column) -> Column:
    """Distinct lower-case words longer than one letter, with their camel-case and underscore parts."""
    words = F.filter(F.split(text, DELIMITERS), lambda w: F.length(w) > 1)
    # the others are their own only part, and most words come often
    words = F.array_distinct(words)
    made = F.filter(words, lambda w: w.rlike("[A-Z_]"))
    camel = F.flatten(F.transform(made, lambda w: F.split(w, "(?=[A-Z])")))
    snake = F.flatten(F.transform(made, lambda w: F.split(w, "_")))
    parts = F.filter(F.concat(camel, snake), lambda w: F.length(w) > 1)
    return F.array_distinct(F.transform(F.concat(words, parts), lambda w: F.lower(w)))


def exact_hits(tokens: DataFrame, symbols: DataFrame) -> DataFrame:
    """(path, score, signal): 3 for each token that is a symbol of the file, case and all."""
    hits = symbols.join(F.broadcast(tokens), F.col("symbol") == F.col("token")).groupBy("path").agg(F.count_distinct("token").alias("n"), F.min_by("symbol", "pos").alias("symbol"))
    return hits.select("path", (3 * F.col("n")).alias("score"), F.concat(F.lit("symbol:"), "symbol").alias("signal"))


def partial_hits(tokens: DataFrame, symbols: DataFrame, exact: DataFrame) -> DataFrame:
    """2, once, for files without an exact hit whose symbols contain a token of three letters or more; the first such symbol."""
    long = tokens.filter(F.length("token") > 2)
    rest = symbols.join(exact.select("path"), "path", "left_anti")
    hits = rest.join(F.broadcast(long), F.lower("symbol").contains(F.col("token"))).groupBy("path").agg(F.min_by("symbol", "pos").alias("symbol"))
    return hits.select("path", F.lit(2).cast("long").alias("score"), F.concat(F.lit("partial-symbol:"), "symbol").alias("signal"))


def filename_hits(tokens: DataFrame, files: DataFrame) -> DataFrame:
    """2, once, for files whose stem contains a token."""
    hits = files.join(F.broadcast(tokens), F.lower("stem").contains(F.col("token"))).groupBy("path").agg(F.min("token").alias("token"))
    return hits.select("path", F.lit(2).cast("long").alias("score"), F.concat(F.lit("filename:"), "token").alias("signal"))


def top_files(tokens: DataFrame, files: DataFrame, symbols: DataFrame, k: int | None, active: DataFrame | None = None) -> DataFrame:
    """(path, score, signals, place) of the k best files, or of all; files with symbol hits come first among equals, then by position.

    tokens is one query's set, at most a few dozen rows.
    """
    exact = exact_hits(tokens, symbols)
    hits = exact.unionByName(partial_hits(tokens, symbols, exact)).unionByName(filename_hits(tokens, files))
    if active is not None:
        near = active.select("path", F.lit(1).cast("long").alias("score"), F.lit("dep-proximity").alias("signal"))
        hits = hits.unionByName(near)
    scored = hits.groupBy("path").agg(F.sum("score").alias("score"), F.array_join(F.array_sort(F.collect_list("signal")), ",").alias("signals"), F.min(F.when(F.col("signal").startswith("symbol:"), 0).otherwise(1)).alias("phase"))
    found, order = scored.join(files.select("path", "pos"), "path"), (F.desc("score"), F.col("phase"), F.col("pos"))
    ranked = placed(found, "place", *order) if k is None else first(found, k, "place", *order)
    return ranked.select("path", "score", "signals", F.col("place").cast("int").alias("place"))


def boosted(scored: DataFrame, god_files: DataFrame, god_symbols: DataFrame, symbols: DataFrame, active: DataFrame) -> DataFrame:
    """Adds 2 to files of god nodes, 2 to files with a god's symbol and 1 to files of the active community."""
    of_symbol = symbols.join(god_symbols, F.lower("symbol") == F.lower(F.col("label"))).select("path").distinct().withColumn("_s", F.lit(2))
    out = scored.join(god_files.select("path").distinct().withColumn("_g", F.lit(2)), "path", "left").join(of_symbol, "path", "left").join(active.select("path").distinct().withColumn("_a", F.lit(1)), "path", "left")
    total = F.col("score") + F.coalesce("_g", F.lit(0)) + F.coalesce("_s", F.lit(0)) + F.coalesce("_a", F.lit(0))
    return out.select("path", total.alias("score"))


def inverted_index(symbols: DataFrame) -> DataFrame:
    """(symbol, n, paths) in index order."""
    lists = F.array_sort(F.collect_list(F.struct("pos", "path")))
    return symbols.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.transform(lists, lambda x: x.path).alias("paths"))


def directory_listing(files: DataFrame, first: int = 8) -> DataFrame:
    """(dir, listing): the first sorted base names and how many more there are."""
    names = F.array_sort(F.collect_set(F.substring_index("path", "/", -1)))
    more = F.size("names") - first
    return files.groupBy("dir").agg(names.alias("names")).select("dir", F.concat(F.array_join(F.slice("names", 1, first), ", "), F.when(more > 0, F.concat(F.lit(" +"), more.cast("string"), F.lit(" more"))).otherwise("")).alias("listing"))


def suffix_matches(mentions: DataFrame, files: DataFrame) -> DataFrame:
    """(mention, path) where a file's path is the mention or ends with /mention: joined on the base name first."""
    left = mentions.select("mention", F.substring_index("mention", "/", -1).alias("base"))
    right = files.select("path", F.substring_index("path", "/", -1).alias("base"))
    return left.join(right, "base").filter((F.col("path") == F.col("mention")) | F.col("path").endswith(F.concat(F.lit("/"), F.col("mention")))).select("mention", "path")


def god_matches(gods: DataFrame, symbols: DataFrame) -> DataFrame:
    """(label, symbol): equal whatever the case, or one contains the other's text of four letters or more.

    What is contained has its first four letters in the other, so both containments join on those.
    """
    a = gods.select("label", F.lower("label").alias("a")).distinct()
    b = symbols.select("symbol", F.lower("symbol").alias("b")).distinct()
    grams = lambda c: F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(c) - 3), lambda i: F.substring(c, i, F.lit(4))))).alias("g")
    start = lambda c: F.substring(c, F.lit(1), F.lit(4)).alias("g")
    equal = a.join(b, F.col("a") == F.col("b"))
    inside = a.filter("length(a) >= 4").select("label", "a", grams(F.col("a"))).join(b.filter("length(b) >= 4").select("symbol", "b", start(F.col("b"))), "g").filter("contains(a, b)")
    around = b.filter("length(b) >= 4").select("symbol", "b", grams(F.col("b"))).join(a.filter("length(a) >= 4").select("label", "a", start(F.col("a"))), "g").filter("contains(b, a)")
    return equal.select("label", "symbol").unionByName(inside.select("label", "symbol")).unionByName(around.select("label", "symbol")).distinct()


#: Imports that a task resolves, about; beyond so many partitions, where Spark's writers sort in memory what they deal out, up to so many.
TASK_IMPORTS, PLAIN_TASKS, MOST_IMPORTS = 30_000, 200, 150_000


def tasks_for(n: int) -> int:
    return max(1, min(-(-n // TASK_IMPORTS), PLAIN_TASKS), -(-n // MOST_IMPORTS))


def resolve_imports(imports: DataFrame, files: DataFrame, tasks: int | None = None) -> DataFrame:
    """(src, target) of (src, raw, candidates): the first candidate path that is an indexed file.

    tasks: into how many the work is dealt; counted from the imports if not given.
    """
    tasks = tasks or tasks_for(imports.count())
    # dealt out before they grow: a scan's task is as large as its part of the file, a dealt one is not
    dealt = imports.select("src", "raw", "candidates").repartition("src", "raw")
    each = dealt.select("src", "raw", F.posexplode("candidates").alias("i", "path"))
    # numbered tasks: Spark would merge shuffled partitions up to a size at which a task sorts several times as much
    hits = each.repartition(tasks, "path").join(files.select("path").repartition(tasks, "path"), "path")
    found = hits.select("src", "raw", "i", "path").repartition(tasks, "src", "raw").groupBy("src", "raw").agg(F.min_by("path", "i").alias("target"))
    return found.select("src", "target").repartition(tasks, "src", "target").distinct()


def symbol_graph(files: DataFrame, symbols: DataFrame, deps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes of files and their symbols; edges file to symbol, file to file and importer to symbol, once per pair."""
    f = lambda c: F.concat(F.lit("file:"), F.col(c))
    s = F.concat(F.lit("file:"), F.col("path"), F.lit(":"), F.col("symbol"))
    nodes = files.select(f("path").alias("node_id"), F.lit("module").alias("type"), F.col("path").alias("label")).unionByName(symbols.select(s.alias("node_id"), symbol_kind().alias("type"), F.col("symbol").alias("label")))
    has = symbols.select(f("path").alias("src"), s.alias("dst"), F.lit("depends_on").alias("type"), F.lit(1.0).alias("weight"))
    imports = deps.select(f("src").alias("src"), f("dst").alias("dst"), F.lit("imports").alias("type"), F.lit(1.0).alias("weight"))
    uses = deps.select(F.col("src").alias("importer"), F.col("dst").alias("path")).join(symbols, "path").select(f("importer").alias("src"), s.alias("dst"), F.lit("uses").alias("type"), F.lit(0.8).alias("weight"))
    edges = has.unionByName(imports).unionByName(uses)
    return nodes.dropDuplicates(["node_id"]), edges.groupBy("src", "dst").agg(F.min("type").alias("type"), F.max("weight").alias("weight"))


def symbol_kind(name: str = "symbol") -> Column:
    c = F.col(name)
    return F.when(c.rlike(r"^[A-Z][a-zA-Z0-9]*$"), "class").when(c.rlike(r"^I[A-Z]"), "interface").when(c.rlike(r"^[a-z][a-zA-Z0-9]*$"), "function").otherwise("variable")


def reverse(deps: DataFrame) -> DataFrame:
    return deps.select(F.col("dst").alias("src"), F.col("src").alias("dst")).distinct()
