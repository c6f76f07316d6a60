"""What messages and tool calls of a conversation say about the code that they are on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths as p
from . import context, retrieval, telemetry
from .mentions import contained
from .messages import last_messages

#: An edge of a word of ASCII letters, digits and underscores; Java's own \\b counts other letters too.
EDGE = r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))"
#: What makes a prompt one about code.
CODE_PATTERNS = (
    r"\.[a-zA-Z]+/[\w./-]+\.(?:ts|tsx|py|rs|js|jsx|go|md)",
    r"['\"`]\.\.?/[^'\"`]+",
    r"\b[A-Z][a-z]+[A-Z]\w+\b",
    r"\b[a-z]+[A-Z]\w+[a-z]\b",
    r"\b[a-z]+_[a-z]+\w*\b",
    r"\b(?:function|class|import|export|const|let|var|def|fn|struct|impl|trait|interface|type|enum|module|package)\b",
    r"\b\w+\.(?:ts|tsx|js|jsx|py|rs|go|md|json|yaml|yml|toml)\b",
    r"\b(?:src|lib|app|tests?|docs?|config|scripts?|components?|pages?|routes?|services?|utils?|helpers?|hooks?|stores?|models?|views?|controllers?|middleware)\b",
    r"\b(?:refactor|rewrite|edit|update|fix|debug|test|build|deploy|implement|add|remove|change|migrate|optimize)\b",
)
#: Words that make a conversation one about code, and areas that it may name.
CODE_WORDS = ("function", "class", "file", "code", "edit", "implement", "refactor", "bug", "fix", "test", "import", "export", "variable", "method")
AREAS = ("auth", "authentication", "security", "transport", "client", "api", "database", "storage", "ui", "frontend", "backend", "service")
#: Signs of plain edits, anchors, questions for files, compiler errors, hubs and their impact, in lower case.
PLAIN_EDIT = r"strreplace|\b(?:str|string)\s+replace\b|edit\s+the\s+file\b"
ANCHOR_WORD = r"\b\d+[a-z]{2}\b"
FILE_QUESTIONS = ("which file", "where is", "what file contains", "file location")
ERROR_SIGNS = (r"\berror\s+ts\d+", r":\s*error\s+ts", r"\(\d+,\d+\):\s*error", r"-->.*\.(?:ts|tsx|rs|py):\d+:\d+")
HUB_WORDS = ("god node", "high-impact symbol", "critical symbol")
IMPACT_SIGNS = (r"\bimpact\s+(analysis|assessment|radius|of\s+changing)\b", r"\bounce\b.*\bimpact\b|\bimpact\b.*\b(risk|radius|scope|blast)\b", "affects", "dependencies")
#: Tools that take files, the arguments that name them, and the order in which a call's path is looked for.
FILE_TOOLS = ("read", "write", "edit", "bash", "grep", "search", "ripgrep", "fd", "fzf")
PATH_KEYS = ("path", "filePath", "file", "target", "destination", "source", "src", "dst")
TOOL_PATH_KEYS = ("path", "filePath", "file", "target", "file_path", "relativePath")
ANCHORED_LINE = r"\b\d+[a-z]{2}\|"


def any_of(text: Column, patterns: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for x in patterns:
        out = out | signs(text, x)
    return out


def signs(text: Column, pattern: str) -> Column:
    return text.rlike(pattern.replace(r"\b", EDGE))


def names_any(text: Column, words: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for x in words:
        out = out | text.contains(x)
    return out


def about_code(prompt: Column) -> Column:
    return F.coalesce(any_of(prompt, CODE_PATTERNS), F.lit(False))


def tool_suggestions(messages: DataFrame, n: int = 15) -> DataFrame:
    """(conv_id, pattern, confidence, tool) of the rules that a conversation's last n messages call for."""
    c = F.lower(F.coalesce("content", F.lit("")))
    flags = {
        "edits": signs(c, PLAIN_EDIT),
        "anchors": c.contains("hashline") | signs(c, ANCHOR_WORD),
        "asks": names_any(c, FILE_QUESTIONS),
        "errors": any_of(c, ERROR_SIGNS),
        "hubs": names_any(c, HUB_WORDS),
        "impact": any_of(c, IMPACT_SIGNS),
    }
    seen = last_messages(messages, n).groupBy("conv_id").agg(*[F.bool_or(f).alias(k) for k, f in flags.items()])
    rule = lambda when, name, sure, tool: F.when(when, F.struct(F.lit(name).alias("pattern"), F.lit(sure).cast("double").alias("confidence"), F.lit(tool).cast("string").alias("tool")))
    rules = F.array(
        rule(F.col("edits") & F.col("anchors"), "basic_file_edit", 0.9, "hashline_edit"),
        rule(F.col("edits") & ~F.col("anchors"), "basic_file_edit", 0.75, "hashline_edit"),
        rule(F.col("asks"), "manual_navigation", 0.8, "lsp_go_to_definition"),
        rule(F.col("errors"), "compiler_error_bridge", 0.85, "lsp_hover"),
        rule(F.col("hubs") & ~F.col("impact"), "missing_impact_analysis", 0.7, None),
    )
    return seen.select("conv_id", F.explode(F.filter(rules, lambda r: r.isNotNull())).alias("r")).select("conv_id", "r.*")


def conversation_meta(messages: DataFrame) -> DataFrame:
    """(conv_id, messages, about_code, areas): how many messages, whether any names code, and the areas named, in fixed order."""
    c = F.lower(F.coalesce("content", F.lit("")))
    out = messages.groupBy("conv_id").agg(F.count(F.lit(1)).alias("messages"), F.bool_or(names_any(c, CODE_WORDS)).alias("about_code"), *[F.bool_or(c.contains(a)).alias(f"_{a}") for a in AREAS])
    areas = F.filter(F.array(*[F.when(F.col(f"_{a}"), F.lit(a)) for a in AREAS]), lambda x: x.isNotNull())
    return out.select("conv_id", "messages", "about_code", F.array_join(areas, ",").alias("areas"))


def mentioned_files(messages: DataFrame) -> DataFrame:
    """(conv_id, path): dotted or rooted paths, quoted or not, each once a conversation."""
    found = F.regexp_extract_all(F.lower("content"), F.lit(r"(['\"`]?)([./][\w./-]+\.(?:ts|tsx|py|rs|js|jsx))\1"), F.lit(2))
    return messages.select("conv_id", F.explode(found).alias("path")).distinct()


def mentioned_communities(messages: DataFrame, nodes: DataFrame) -> DataFrame:
    """(conv_id, community) where a message holds the community's label or id, a member's file stem of over three
    letters or a member's symbol of four at least; nodes has (community, label, node_id)."""
    from ..functions import text as x

    stem = F.regexp_replace(p.base_name(x.node_path(F.col("node_id"))), r"\.[^.]+$", "")
    names = F.array(F.col("label"), F.col("community"), F.when(F.length(stem) > 3, stem), F.when(F.length(x.node_symbol(F.col("node_id"))) >= 4, x.node_symbol(F.col("node_id"))))
    wanted = nodes.select("community", F.explode(names).alias("name")).filter("name IS NOT NULL AND name <> ''").select("community", F.lower("name").alias("name")).distinct()
    said = messages.select(F.col("conv_id").alias("id"), F.lower("content").alias("text"))
    return contained(said, wanted).join(wanted, "name").select(F.col("id").alias("conv_id"), "community").distinct()


def call_paths(calls: DataFrame) -> DataFrame:
    """calls (tool_name, input map, ...) with paths: those that file tools' arguments name, then those in a shell command."""
    named = F.filter(F.transform(F.array(*[F.col("input").getItem(k) for k in PATH_KEYS]), lambda v: p.cleaned(v)), lambda v: v.isNotNull() & (F.length(v) >= 2))
    shell = F.when(F.col("tool_name") == "bash", context.mentioned_paths("_command"))
    both = F.concat(F.transform(F.array_distinct(named), lambda v: p.normalized(v)), F.coalesce(shell, F.array().cast("array<string>")))
    known = F.filter(F.array_distinct(both), lambda v: p.extension(v).isin(*p.NAMED_EXTENSIONS))
    paths = F.when(F.col("tool_name").isin(*FILE_TOOLS), known).otherwise(F.array().cast("array<string>"))
    return calls.withColumn("_command", F.col("input").getItem("command")).withColumn("paths", paths).drop("_command")


def message_paths(messages: DataFrame) -> DataFrame:
    """messages (role, content, tool_name, input) with paths in what users and assistants say, tools are called with and return."""
    called = call_paths(messages).withColumnRenamed("paths", "_called")
    said = F.when(F.col("role").isin("user", "assistant", "toolResult"), context.mentioned_paths()).otherwise(F.array().cast("array<string>"))
    return called.withColumn("paths", F.array_distinct(F.concat(said, F.coalesce("_called", F.array().cast("array<string>"))))).drop("_called")


def tool_path(arguments: Column) -> Column:
    """The first argument of a read or edit call that names a path and is not blank."""
    return F.coalesce(*[F.nullif(F.trim(arguments.getItem(k)), F.lit("")) for k in TOOL_PATH_KEYS])


def has_anchors(text: Column) -> Column:
    return F.coalesce(text.rlike(ANCHORED_LINE), F.lit(False))


def anchors_at_hand(annotated: Column, injected: Column, injected_context: Column) -> Column:
    """Whether a turn has anchors: in its messages, in injected files, or in the context."""
    return F.coalesce(annotated, F.lit(False)) | (F.coalesce(injected, F.lit(0)) > 0) | has_anchors(injected_context)


def region_hints(messages: DataFrame, extra: DataFrame) -> DataFrame:
    """(path, start, end): one region a file around the lines that messages cite and extra references (path, start, end) name."""
    return telemetry.region_hull(context.cited_regions(messages).unionByName(extra.select("path", "start", "end")).filter("start > 0"))


def affected_gods(symbols: DataFrame, gods: DataFrame) -> DataFrame:
    """(label) of gods that one of an edit's target symbols (symbol) matches."""
    return retrieval.god_matches(gods, symbols).select("label").distinct()


def once_a_session(injections: DataFrame) -> DataFrame:
    """Of (session_id, pos, kind) the first of each kind: what is injected once is not injected again."""
    first = injections.groupBy("session_id", "kind").agg(F.min("pos").alias("pos"))
    return first.select("session_id", "kind", "pos")


def previews_consumed(events: DataFrame) -> DataFrame:
    """(conv_id, path, pos, applied_at): each dry run of (conv_id, pos, path, dry_run) and the first edit after it, unless
    a later dry run of the path comes first; an edit consumes one preview."""
    from pyspark.sql.window import Window

    w = Window.partitionBy("conv_id", "path").orderBy("pos")
    then = events.withColumn("_dry", F.lead("dry_run").over(w)).withColumn("_at", F.lead("pos").over(w))
    return then.filter("dry_run").select("conv_id", "path", "pos", F.when(~F.col("_dry"), F.col("_at")).alias("applied_at"))


def insights(messages: DataFrame) -> DataFrame:
    """(conv_id, messages, about_code, suggestions, errors): what a conversation calls for, a row each."""
    from .messages import compiler_errors

    advice = tool_suggestions(messages).groupBy("conv_id").agg(F.array_join(F.array_sort(F.collect_list("pattern")), ",").alias("suggestions"))
    errors = compiler_errors(messages).groupBy("conv_id").agg(F.count(F.lit(1)).alias("errors"))
    meta = conversation_meta(messages).select("conv_id", "messages", "about_code")
    return meta.join(advice, "conv_id", "left").join(errors, "conv_id", "left").select("conv_id", "messages", "about_code", F.coalesce("suggestions", F.lit("")).alias("suggestions"), F.coalesce("errors", F.lit(0)).alias("errors"))
