"""Conversations in reply order, from the quotations that messages hold.

Lines that begin with quote marks are quoted text; their number is the level. The
lines between form passages: runs of one level. Passages are normalised (quote marks,
case and white space) and hashed, and joined with the hashes of what messages of the
same conversation say themselves: their whole text, their paragraphs and their
lines. The original is the first message with the passage; a message replies to the
original of its outermost passage, of several to the one with the most words found.
Passages that are not found as a whole are linked through their paragraphs, which
quoted lines without words part, then through lines of some length, then through
paragraphs of fewer words than that.

Replies are followed up to the message that starts the thread by doubling steps, so
a chain of n replies takes log2(n) joins. Sorting by conversation, thread and turn
gives every message after what it replies to; texts come without quotes and without
the lines that announce them. Index rows are summed to one per conversation and hash
before the join, so a passage that thousands repeat joins one row.

Defined cases: null texts are empty; rows without conversation or turn start a thread
of their own and are never originals; repeated rows give rows of their own, with the
same links; a message never replies to itself or to a later one; texts of any length
are parsed whole; other columns are not read, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

MARKS = re.compile(r"^[ \t]{0,3}((?:>[ \t]?)+)")
#: Lines that announce a quotation, when one follows.
ANNOUNCES = re.compile(r"^\s*(?:On\b.{0,300}\bwrote|Am\b.{0,300}\bschrieb.{0,100}|Le\b.{0,300}\ba écrit|El\b.{0,300}\bescribió|.{0,200}\b(?:wrote|writes|said|schrieb|escribió|a écrit))\s*:\s*$|^\s*-{2,}\s*(?:Original Message|Ursprüngliche Nachricht|Message d'origine|Mensaje original)\s*-{2,}\s*$", re.IGNORECASE)
LEAST_WORDS = 3
WHOLE, PARAGRAPH, LINE, SHORT = 0, 1, 2, 3


def normal(lines: list[str]) -> str:
    return " ".join(" ".join(lines).casefold().split())


def name(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


def parse(text: str) -> tuple[str, list[tuple[int, list[str]]]]:
    """The text without quotes, and its passages (level, lines) in order."""
    if ">" not in text:
        return text, []
    own: list[str] = []
    passages: list[tuple[int, list[str]]] = []
    level_before = 0
    for line in text.split("\n"):
        m = MARKS.match(line)
        level = m[1].count(">") if m else 0
        if not level:
            own.append(line)
        else:
            if not level_before:
                while own and not own[-1].strip():
                    own.pop()
                if own and ANNOUNCES.match(own[-1]):
                    own.pop()
            rest = line[m.end() :]
            if level == level_before:
                passages[-1][1].append(rest)
            else:
                passages.append((level, [rest]))
        level_before = level
    # an announcement inside a quote belongs to the next level's passage
    for level, lines in passages:
        while lines and (not lines[-1].strip() or ANNOUNCES.match(lines[-1])):
            lines.pop()
    return "\n".join(own).strip("\n").strip(), [(n, x) for n, x in passages if any(y.strip() for y in x)]


def paragraphs(lines: list[str]) -> Iterator[str]:
    block: list[str] = []
    for line in [*lines, ""]:
        if line.strip():
            block.append(line)
        elif block:
            yield normal(block)
            block = []


def said(text: str) -> set[int]:
    """Hashes of what a message says: whole, paragraphs, lines."""
    lines = text.split("\n")
    return {name(p) for p in [normal(lines), *paragraphs(lines), *(normal([line]) for line in lines)] if p}


def quoted(passages: list[tuple[int, list[str]]]) -> list[tuple[int, int, int, int]]:
    """(level, kind, hash, words) to look for: whole passages, their paragraphs, and lines of some length."""
    out = set()
    for level, lines in passages:
        whole = normal(lines)
        out.add((level, WHOLE, name(whole), len(whole.split())))
        for part in paragraphs(lines):
            if part != whole:
                n = len(part.split())
                out.add((level, PARAGRAPH if n >= LEAST_WORDS else SHORT, name(part), n))
        for line in lines:
            one = normal([line])
            if one and len(one.split()) >= LEAST_WORDS:
                out.add((level, LINE, name(one), len(one.split())))
    return sorted(out)


PARSED = "conv_id long, turn long, role string, text string, n_quotes int, said array<long>, quotes array<struct<level: int, kind: int, hash: long, words: int>>"
QUOTE = pa.struct([("level", pa.int32()), ("kind", pa.int32()), ("hash", pa.int64()), ("words", pa.int32())])


def parsed(messages: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in common.pieces(batches, "text"):
            own, counts, says, quotes = [], [], [], []
            for x in part.column("text"):
                text, passages = parse(x.as_py() or "")
                own.append(text), counts.append(len(passages)), says.append(sorted(said(text)))
                quotes.append([dict(zip(("level", "kind", "hash", "words"), q, strict=True)) for q in quoted(passages)])
            yield pa.RecordBatch.from_arrays([part.column("conv_id"), part.column("turn"), part.column("role"), pa.array(own, pa.string()), pa.array(counts, pa.int32()), pa.array(says, pa.list_(pa.int64())), pa.array(quotes, pa.list_(QUOTE))], ["conv_id", "turn", "role", "text", "n_quotes", "said", "quotes"])

    return messages.mapInArrow(run, PARSED)


def reply_links(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, parent_turn) of messages whose quotations are found."""
    asks = rows.filter("n_quotes > 0 AND conv_id IS NOT NULL AND turn IS NOT NULL").select("conv_id", "turn", F.explode("quotes").alias("q")).select("conv_id", "turn", "q.*").distinct()
    wanted = asks.select("conv_id", "hash").distinct()
    first = rows.filter("conv_id IS NOT NULL AND turn IS NOT NULL").select("conv_id", "turn", F.explode("said").alias("hash")).groupBy("conv_id", "hash").agg(F.min("turn").alias("parent_turn"))
    found = asks.join(first.join(wanted, ["conv_id", "hash"]), ["conv_id", "hash"]).filter("parent_turn < turn")
    # outermost level, then whole passages before paragraphs before lines, then most words, then the earliest original
    votes = found.groupBy("conv_id", "turn", "level", "kind", "parent_turn").agg(F.sum("words").alias("words"))
    best = votes.groupBy("conv_id", "turn").agg(F.min(F.struct("level", "kind", (-F.col("words")).alias("less"), "parent_turn")).alias("best"))
    return best.select("conv_id", "turn", F.col("best.parent_turn").alias("parent_turn"))


def threads(links: DataFrame) -> DataFrame:
    """(conv_id, turn, thread_turn, depth): where the chain of replies of each message that has one begins."""
    steps = common.cut(links.select("conv_id", "turn", F.col("parent_turn").alias("up"), F.lit(1).cast("long").alias("depth")), "steps")
    while True:
        hop = steps.select("conv_id", F.col("turn").alias("up"), F.col("up").alias("top"), F.col("depth").alias("more"))
        moved = steps.join(hop, ["conv_id", "up"], "left").select("conv_id", "turn", F.coalesce("top", "up").alias("up"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), F.col("top").isNotNull().alias("moved"))
        moved = common.cut(moved, "steps")
        steps = moved.drop("moved")
        if moved.filter("moved").isEmpty():
            return steps.withColumnRenamed("up", "thread_turn")


def reply_order(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per message, in the order of conversations, threads and replies: conv_id, thread_turn, turn, depth,
    parent_turn, role, n_quotes, text, formatted. The order is by ranges, so one conversation may fill many tasks."""
    picked = messages.select(messages[conv_col].cast("long").alias("conv_id"), messages[turn_col].cast("long").alias("turn"), messages[role_col].cast("string").alias("role"), messages[text_col].cast("string").alias("text"))
    rows = common.cut(parsed(picked), "parsed")
    links = common.cut(reply_links(rows), "links")
    out = rows.select("conv_id", "turn", "role", "n_quotes", "text")
    if links.isEmpty():
        out = out.select("*", F.lit(None).cast("long").alias("parent_turn"), F.col("turn").alias("thread_turn"), F.lit(0).cast("long").alias("depth"))
    else:
        found = links.join(threads(links), ["conv_id", "turn"])
        out = out.join(found, ["conv_id", "turn"], "left").select("conv_id", "turn", "role", "n_quotes", "text", "parent_turn", F.coalesce("thread_turn", "turn").alias("thread_turn"), F.coalesce("depth", F.lit(0)).alias("depth"))
    formatted = F.concat(F.lit("<|"), F.coalesce("role", F.lit("")), F.lit("|>\n"), F.col("text"), F.lit("\n"))
    out = out.select("conv_id", "thread_turn", "turn", "depth", "parent_turn", "role", "n_quotes", "text", formatted.alias("formatted"))
    return out.orderBy("conv_id", "thread_turn", "turn", "depth", "role", "text")


def conversations(ordered: DataFrame) -> DataFrame:
    """(conv_id, thread_turn, messages, text): each thread of reply_order() as one formatted text. A thread is one row, so
    this is for threads that fit in one."""
    lists = ordered.groupBy("conv_id", "thread_turn").agg(F.array_sort(F.collect_list(F.struct("turn", "depth", "formatted"))).alias("l"))
    return lists.select("conv_id", "thread_turn", F.size("l").cast("long").alias("messages"), F.array_join(F.transform("l", lambda x: x.formatted), "").alias("text"))


def op9_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reply_order(common.table(spark, sf_dir, "conversations"))
