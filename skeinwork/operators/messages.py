"""Message-stream transforms over (conv_id, pos, role, content, ...), all as windows and joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

WRITTEN_PATH = r'"(?:path|filePath)"\s*:\s*"([^"]+)"'


def in_conversation(*order: Column | str) -> Window:
    return Window.partitionBy("conv_id").orderBy(*(order or ("pos",)))


def drop_duplicates(messages: DataFrame, roles: tuple[str, ...] = ("user", "assistant")) -> DataFrame:
    """Drops what the same role has said anywhere before; other roles, and rows without one, stay."""
    first = F.row_number().over(Window.partitionBy("conv_id", "role", F.xxhash64("content"), "content").orderBy("pos"))
    return messages.withColumn("_n", first).filter((F.col("_n") == 1) | ~F.coalesce(F.col("role").isin(*roles), F.lit(False))).drop("_n")


def written_path(content: str = "content") -> Column:
    return F.nullif(F.regexp_extract(content, WRITTEN_PATH, 1), F.lit(""))


def drop_superseded(messages: DataFrame, path: str = "path", roles: tuple[str, ...] = ("tool", "toolResult")) -> DataFrame:
    """Of tool messages that name one path the last stays."""
    last = F.row_number().over(Window.partitionBy("conv_id", path).orderBy(F.desc("pos")))
    subject = F.coalesce(F.col("role").isin(*roles), F.lit(False)) & F.col(path).isNotNull()
    kept = messages.filter(subject).withColumn("_n", last).filter("_n = 1").drop("_n")
    return messages.filter(~subject).unionByName(kept)


def drop_resolved_errors(messages: DataFrame, roles: tuple[str, ...] = ("tool", "toolResult")) -> DataFrame:
    """Drops a tool error if the next tool message is none."""
    tools = F.coalesce(F.col("role").isin(*roles), F.lit(False))
    judged = messages.filter(tools).withColumn("_next", F.lead("is_error").over(in_conversation()))
    return messages.filter(~tools).unionByName(judged.filter("NOT (is_error AND _next IS NOT NULL AND NOT _next)").drop("_next"))


def prune(messages: DataFrame) -> DataFrame:
    return drop_resolved_errors(drop_superseded(drop_duplicates(messages)))


def prune_report(before: DataFrame, after: DataFrame) -> DataFrame:
    """Messages seen, removed, and the share removed in rounded per cent, 0 of none."""
    n, m = before.agg(F.count(F.lit(1)).alias("processed")), after.agg(F.count(F.lit(1)).alias("left"))
    gone = F.col("processed") - F.col("left")
    return n.join(F.broadcast(m)).select("processed", gone.alias("pruned"), F.when(F.col("processed") > 0, F.floor(100 * gone / F.col("processed") + 0.5)).otherwise(0).cast("long").alias("percent"))


def last_messages(messages: DataFrame, n: int) -> DataFrame:
    return messages.withColumn("_n", F.row_number().over(in_conversation(F.desc("pos")))).filter(F.col("_n") <= n).drop("_n")


def community_votes(messages: DataFrame, mentions: DataFrame) -> DataFrame:
    """(conv_id, community, votes, place): how often a conversation's messages name members of each community.

    mentions: (term, community), terms matched as words, so the join is on equality.
    """
    words = messages.select("conv_id", F.explode(F.split(F.lower("content"), r"[^a-z0-9_./-]+")).alias("term")).groupBy("conv_id", "term").agg(F.count(F.lit(1)).alias("n"))
    votes = words.join(mentions, "term").groupBy("conv_id", "community").agg(F.sum("n").alias("votes"))
    return votes.withColumn("place", F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("votes"), "community")))


def community_prune(messages: DataFrame, mentions: DataFrame, role: str = "developer", least: int = 3) -> DataFrame:
    """Drops a conversation's non-blank messages of `role`, the last of them aside, that name nothing of its leading
    community, in conversations with `least` messages and two communities named."""
    votes = community_votes(messages, mentions)
    active = votes.groupBy("conv_id").agg(F.count(F.lit(1)).alias("_k"), F.min_by("community", "place").alias("community")).filter("_k >= 2").drop("_k")
    wanted = active.join(mentions, "community").select("conv_id", "term").distinct()
    words = messages.filter(F.col("role") == role).select("conv_id", "pos", F.explode(F.split(F.lower("content"), r"[^a-z0-9_./-]+")).alias("term")).distinct()
    named = words.join(wanted, ["conv_id", "term"]).select("conv_id", "pos").distinct().withColumn("_named", F.lit(True))
    sizes = messages.groupBy("conv_id").agg(F.count(F.lit(1)).alias("_m"), F.max(F.when(F.col("role") == role, F.col("pos"))).alias("_last"))
    out = messages.join(sizes, "conv_id").join(active, "conv_id", "left").join(named, ["conv_id", "pos"], "left")
    drop = (F.col("role") == role) & (F.col("pos") < F.col("_last")) & (F.trim("content") != "") & F.col("_named").isNull() & F.col("community").isNotNull() & (F.col("_m") >= least)
    return out.filter(~F.coalesce(drop, F.lit(False))).select(*messages.columns)


EDIT_WORDS = ("edit", "change", "modify", "update", "fix", "refactor", "rename", "replace", "add", "remove", "delete", "implement")
FILE_MENTION = r"([\w./-]+\.(?:ts|tsx|js|jsx|py|rs|go|java|json|md))\b"
ANCHOR_MENTION = r"\b\d+[a-z]{2}\|"


def edit_intent(messages: DataFrame, n: int = 10) -> DataFrame:
    """Per conversation over its last n messages: editing words, files and symbols named, line anchors."""
    tail = last_messages(messages, n)
    text = tail.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("content", F.lit("")).alias("c")))), lambda x: x.c), "\n").alias("t"))
    symbols = F.array_distinct(F.flatten(F.array(*[F.regexp_extract_all("t", F.lit(p), F.lit(1)) for p in (r"\b(?:function|class|interface|method|def|fn)\s+(\w{3,})", r"`(\w{3,})`", r"\b(\w{3,})\(\)")])))
    return text.select("conv_id", F.lower("t").rlike("|".join(EDIT_WORDS)).alias("editing"), F.array_distinct(F.regexp_extract_all("t", F.lit(FILE_MENTION), F.lit(1))).alias("files"), symbols.alias("symbols"), F.col("t").rlike(ANCHOR_MENTION).alias("anchored"))


def navigation_intent(messages: DataFrame, n: int = 5) -> DataFrame:
    """Per conversation over its last n messages: definition before references before file_location, or null."""
    c = F.lower(F.col("content"))
    kind = F.when(c.rlike(r"definition of|defined|where is \w+ (?:declared|implemented)"), 1).when(c.rlike(r"references? (?:to|of)|usages?|who (?:calls|uses)|where is \w+ used"), 2).when(c.rlike(r"which file|what file|find the file|located"), 3)
    best = last_messages(messages, n).groupBy("conv_id").agg(F.min(kind).alias("k"))
    return best.select("conv_id", F.when(F.col("k") == 1, "definition").when(F.col("k") == 2, "references").when(F.col("k") == 3, "file_location").alias("navigation"))


#: Files in compilers' messages, and the formats of these, as (path, line, column).
COMPILED = r"((?:[./\w@_-]+/)*[\w@_-]+\.(?:ts|tsx|py|rs|js|jsx|go|java|c|cpp|h|hpp))"
COMPILER_FORMATS = (
    rf"(?i){COMPILED}\((\d+),(\d+)\):\s*(?:error|warning)[^\n]*",
    rf"(?i){COMPILED}:(\d+):(\d+)\s*-\s*(?:error|warning)[^\n]*",
    rf"-->\s+{COMPILED}:(\d+):(\d+)",
    rf"(?i){COMPILED}:(\d+):(\d+):\s*(?:error|warning)",
)


def compiler_errors(messages: DataFrame, n: int = 15, most: int = 8) -> DataFrame:
    """(conv_id, path, line, col), from 0, of distinct places in the last n tool results that speak of errors."""
    tail = last_messages(messages, n).filter((F.col("role") == "toolResult") & (F.col("content").contains("error") | F.col("content").contains("Error")))
    found = None
    for k, pattern in enumerate(COMPILER_FORMATS):
        g = [F.regexp_extract_all("content", F.lit(pattern), F.lit(i)) for i in (1, 2, 3)]
        one = tail.select("conv_id", "pos", F.posexplode(F.arrays_zip(g[0].alias("p"), g[1].alias("l"), g[2].alias("c"))).alias("i", "z"))
        one = one.select("conv_id", F.struct("pos", F.lit(k).alias("k"), "i").alias("at"), F.col("z.p").alias("path"), (F.col("z.l").cast("long") - 1).alias("line"), F.greatest(F.col("z.c").cast("long") - 1, F.lit(0)).alias("col")).filter("line >= 0")
        found = one if found is None else found.unionByName(one)
    first = found.groupBy("conv_id", "path", "line", "col").agg(F.min("at").alias("at"))
    return first.withColumn("_n", F.row_number().over(Window.partitionBy("conv_id").orderBy("at"))).filter(F.col("_n") <= most).drop("_n", "at")


#: Patterns of questions about the whole code base, and of those that are not.
BROAD_NOT = (r"\b(?:this|that) (?:function|file|line|class|method)\b", r"\.(?:ts|tsx|js|py|rs)\b")
BROAD = (r"\b(?:overview|architecture|structure|codebase|code base|repository|repo|project)\b", r"how (?:does|is) .*(?:work|organi[sz]ed|structured)", r"\bexplain the (?:code|project|system)\b", r"\bwhere (?:do|should) i start\b", r"\bwhat does this (?:project|repo|code ?base)\b")


def broad_query(text: str = "content") -> Column:
    t = F.lower(F.coalesce(F.col(text), F.lit("")))
    broad, narrow = F.lit(False), F.lit(False)
    for p in BROAD:
        broad = broad | t.rlike(p)
    for p in BROAD_NOT:
        narrow = narrow | t.rlike(p)
    return broad & ~narrow


def turn_mode(broad: Column, editing: Column, navigating: Column) -> Column:
    return F.when(broad, "overview").when(editing, "editing").when(navigating, "navigation").otherwise("idle")


def recent(flag: Column, rows: int) -> Column:
    """Whether the flag holds among the last `rows` messages, this one included."""
    return F.max(flag.cast("int")).over(in_conversation().rowsBetween(-(rows - 1), 0)) == 1


def milestones(events: DataFrame, saved: str, steps: tuple[int, ...] = (500, 2000, 5000, 10000, 25000, 50000)) -> DataFrame:
    """(conv_id, milestone, pos): where a conversation's running sum first reaches each step."""
    running = events.select("conv_id", "pos", F.sum(saved).over(in_conversation().rowsBetween(Window.unboundedPreceding, 0)).alias("cum"))
    reached = running.select("conv_id", "pos", F.explode(F.filter(F.array(*[F.lit(s).cast("long") for s in steps]), lambda s: F.col("cum") >= s)).alias("milestone"))
    return reached.groupBy("conv_id", "milestone").agg(F.min("pos").alias("pos"))


def tool_counters(events: DataFrame) -> DataFrame:
    """(tool_name, calls, errors, last_error_pos)"""
    return events.groupBy("tool_name").agg(F.count(F.lit(1)).alias("calls"), F.count_if("is_error").alias("errors"), F.max(F.when(F.col("is_error"), F.col("pos"))).alias("last_error_pos"))


def intercept(decisions: DataFrame) -> DataFrame:
    """Of (call_id, order, deny, reason): the first denial decides, the last reason is told."""
    return decisions.groupBy("call_id").agg(F.coalesce(F.bool_or("deny"), F.lit(False)).alias("denied"), F.min_by("order", F.when(F.col("deny"), F.col("order"))).alias("first_denial"), F.max_by("reason", F.when(F.col("reason").isNotNull(), F.col("order"))).alias("reason"))
