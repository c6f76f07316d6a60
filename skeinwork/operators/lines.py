"""Hash-anchored line addressing and edits over lines (doc_id, line_no, text, anchor)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import PAIRS


def rebase(anchors: DataFrame, lines: DataFrame, reach: int = 5, own_line: bool = False) -> DataFrame:
    """(doc_id, line, hash, rebased): the only line within `reach` that has the anchor's hash, else null.

    The window is unrolled into at most 2 * reach + 1 line numbers, so the join is on equality.
    """
    wanted = anchors.select("doc_id", "line", "hash").distinct()
    near = wanted.withColumn("line_no", F.explode(F.sequence(F.col("line") - reach, F.col("line") + reach)))
    if not own_line:
        near = near.filter("line_no <> line")
    hits = near.join(lines.select("doc_id", "line_no", F.col("anchor").alias("hash")), ["doc_id", "line_no", "hash"]).groupBy("doc_id", "line", "hash").agg(F.count(F.lit(1)).alias("n"), F.min("line_no").alias("at"))
    return wanted.join(hits, ["doc_id", "line", "hash"], "left").select("doc_id", "line", "hash", F.when(F.col("n") == 1, F.col("at")).alias("rebased"))


def validated(anchors: DataFrame, lines: DataFrame, reach: int = 5) -> DataFrame:
    """(doc_id, line, hash, status, at): 'ok' where the line has the hash, 'rebased' where one near line has, else 'mismatch'."""
    here = lines.select("doc_id", F.col("line_no").alias("line"), F.col("anchor").alias("hash"), F.lit(True).alias("same"))
    out = anchors.select("doc_id", "line", "hash").distinct().join(here, ["doc_id", "line", "hash"], "left")
    moved = rebase(out.filter("same IS NULL"), lines, reach)
    out = out.join(moved, ["doc_id", "line", "hash"], "left")
    status = F.when(F.col("same"), "ok").when(F.col("rebased").isNotNull(), "rebased").otherwise("mismatch")
    return out.select("doc_id", "line", "hash", status.alias("status"), F.when(F.col("same"), F.col("line")).otherwise(F.col("rebased")).alias("at"))


def read_slice(lines: DataFrame, first: int, last: int) -> DataFrame:
    """Lines first..last, bounds clamped into each document."""
    n = lines.groupBy("doc_id").agg(F.max("line_no").alias("_n"))
    clamp = lambda x: F.least(F.greatest(F.lit(x), F.lit(1)), F.col("_n"))
    return lines.join(n, "doc_id").filter(F.col("line_no").between(clamp(first), clamp(last))).drop("_n")


def injection_window(citations: DataFrame, lines: DataFrame, padding: int = 15, most: int = 80) -> DataFrame:
    """Lines around each document's cited (start, end), padded, at most `most`; documents without citation give their head."""
    cited = citations.select("doc_id", F.greatest(F.col("start") - padding, F.lit(1)).alias("_a"), (F.col("end") + padding).alias("_b"))
    bounds = lines.join(cited, "doc_id", "left")
    a = F.coalesce("_a", F.lit(1))
    return bounds.filter(F.col("line_no").between(a, F.least(F.coalesce("_b", F.lit(most)), a + most - 1))).drop("_a", "_b")


def chunks(lines: DataFrame, max_lines: int = 200, max_bytes: int = 64 * 1024) -> DataFrame:
    """(doc_id, chunk, first_line, n_lines, n_bytes) of formatted lines in sequence.

    A chunk ends before a line that would pass the byte limit and after one that reaches a limit; a line over
    the limit stands alone. Sorted partitions are streamed with one chunk's state.
    """

    def cut(batches):
        doc, state = object(), None

        def row():
            return (doc, *state)

        for pdf in batches:
            out = []
            for d, no, size in zip(pdf.doc_id, pdf.line_no, pdf["size"], strict=True):
                if d != doc:
                    if state and state[2]:
                        out.append(row())
                    doc, state = d, [0, no, 0, 0]
                if state[2] and (state[2] >= max_lines or state[3] + 1 + size > max_bytes):
                    out.append(row())
                    state = [state[0] + 1, no, 0, 0]
                state[3] += size + (1 if state[2] else 0)
                state[2] += 1
                if state[2] >= max_lines or state[3] >= max_bytes:
                    out.append(row())
                    state = [state[0] + 1, no + 1, 0, 0]
            yield pd.DataFrame(out, columns=["doc_id", "chunk", "first_line", "n_lines", "n_bytes"])
        if state and state[2]:
            yield pd.DataFrame([row()], columns=["doc_id", "chunk", "first_line", "n_lines", "n_bytes"])

    sized = lines.select("doc_id", "line_no", F.octet_length("text").cast("long").alias("size"))
    return sized.repartition("doc_id").sortWithinPartitions("doc_id", "line_no").mapInPandas(cut, "doc_id long, chunk long, first_line long, n_lines long, n_bytes long")


#: At one line, replacements come before insertions below and above it.
PRECEDENCE = {"replace": 0, "replace_range": 0, "delete": 0, "append": 1, "prepend": 2}


def apply_edits(lines: list[str], edits: list[dict]) -> tuple[list[str], int | None]:
    """The edited lines and the first changed line. Edits name lines of the original, so they run bottom up.

    ops: replace (line), replace_range (line..end), delete (line..end), append (after line, or at the end),
    prepend (before line, or at the start); each once however often it is given.
    """
    seen, todo = set(), []
    for i, e in enumerate(edits):
        key = (e["op"], e.get("line"), e.get("end"), tuple(e.get("lines") or ()))
        if key not in seen:
            seen.add(key)
            todo.append((i, e))
    at_of = lambda e: e["line"] if e.get("line") is not None else (len(lines) + 1 if e["op"] == "append" else 0)
    todo.sort(key=lambda x: (-(x[1].get("end") or at_of(x[1])), PRECEDENCE[x[1]["op"]], x[0]))
    out, first = list(lines), None
    for _, e in todo:
        op, new = e["op"], list(e.get("lines") or ())
        if op in ("replace", "replace_range", "delete"):
            a, b = e["line"] - 1, e.get("end") or e["line"]
            if a + 1 > b:
                raise ValueError(f"line {a + 1} starts after its end {b}")
            new = [] if op == "delete" else new
            if out[a:b] == new:
                continue
            out[a:b], changed = new, a + 1
        elif op == "append":
            a = len(out) if e.get("line") is None else e["line"]
            out[a:a], changed = new, a + 1
        else:
            a = 0 if e.get("line") is None else e["line"] - 1
            out[a:a], changed = new, a + 1
        first = changed if first is None else min(first, changed)
    return out, first


def edited(lines: DataFrame, edits: DataFrame) -> DataFrame:
    """(doc_id, text, first_changed) of documents with edits (doc_id, idx, op, line, end, lines)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        whole = lambda x: None if pd.isna(x) else int(x)
        edit = lambda e: {"op": e["op"], "line": whole(e["line"]), "end": whole(e["end"]), "lines": list(e["lines"]) if e["lines"] is not None else []}
        for pdf in batches:
            out = [apply_edits(list(old), [edit(e) for e in todo]) for old, todo in zip(pdf.old, pdf.todo, strict=True)]
            yield pd.DataFrame({"doc_id": pdf.doc_id, "text": ["\n".join(x) for x, _ in out], "first_changed": pd.array([first for _, first in out], "Int64")})

    whole = lines.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "text"))), lambda x: x.text).alias("old"))
    todo = edits.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("idx", "op", "line", "end", "lines"))).alias("todo"))
    return whole.join(todo, "doc_id").select("doc_id", "old", "todo").mapInPandas(run, "doc_id long, text string, first_changed long")


def line_diff(a: list[str], b: list[str]) -> list[tuple[str, int, str]]:
    """('=', '-' or '+', line number, text): a shortest edit script, greedy by furthest reach, deletions first."""
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    x, y = a[head : len(a) - tail], b[head : len(b) - tail]
    n, m = len(x), len(y)
    reach, trail = {1: 0}, []
    for d in range(n + m + 1):
        trail.append(dict(reach))
        for k in range(-d, d + 1, 2):
            i = reach[k + 1] if k == -d or k != d and reach[k - 1] < reach[k + 1] else reach[k - 1] + 1
            while i < n and i - k < m and x[i] == y[i - k]:
                i += 1
            reach[k] = i
            if i >= n and i - k >= m:
                break
        else:
            continue
        break
    steps, i, j = [], n, m
    for d in range(len(trail) - 1, -1, -1):
        k, before = i - j, trail[d]
        prev = k + 1 if k == -d or k != d and before.get(k - 1, -1) < before.get(k + 1, -1) else k - 1
        pi = before.get(prev, 0)
        pj = pi - prev
        while i > max(pi, 0) and j > max(pj, 0):
            i, j = i - 1, j - 1
            steps.append(("=", head + j + 1, y[j]))
        if d:
            if prev == k + 1:
                j -= 1
                steps.append(("+", head + j + 1, y[j]))
            else:
                i -= 1
                steps.append(("-", head + i + 1, x[i]))
    middle = steps[::-1]
    return [("=", i + 1, t) for i, t in enumerate(a[:head])] + middle + [("=", len(b) - tail + i + 1, t) for i, t in enumerate(b[len(b) - tail :])]


def numbered_diff(before: str, after: str, context: int = 4) -> str:
    """Changed lines with `context` lines around them; left-out stretches are '...'."""
    rows = line_diff(before.split("\n"), after.split("\n"))
    near = [False] * len(rows)
    for i, (kind, *_) in enumerate(rows):
        if kind != "=":
            for j in range(max(0, i - context), min(len(rows), i + context + 1)):
                near[j] = True
    width, out, gap = len(str(max((r[1] for r in rows), default=1))), [], False
    for keep, (kind, no, text) in zip(near, rows, strict=True):
        if keep:
            if gap and any(near):
                out.append(" " * (width + 2) + "...")
            out.append(f"{' ' if kind == '=' else kind}{no:>{width}} {text}")
        gap = not keep if keep else True
    return "\n".join(out)


def boundary_repeats(lines: DataFrame, edits: DataFrame) -> DataFrame:
    """(doc_id, idx) of replacements whose last new line equals, trimmed, the line after the replaced ones."""
    last = edits.filter("op IN ('replace', 'replace_range')").select("doc_id", "idx", (F.coalesce("end", "line") + 1).alias("line_no"), F.trim(F.element_at("lines", -1)).alias("new"))
    return last.join(lines.select("doc_id", "line_no", F.trim("text").alias("old")), ["doc_id", "line_no"]).filter("new = old AND new <> ''").select("doc_id", "idx")


def previews(changes: DataFrame) -> DataFrame:
    """(doc_id, run, kind, n, first) of a diff's (doc_id, pos, kind): runs of one kind, by islands of pos."""
    w = Window.partitionBy("doc_id").orderBy("pos")
    edge = (F.coalesce(F.lag("kind").over(w), F.lit("")) != F.col("kind")).cast("int")
    runs = changes.withColumn("_e", edge).withColumn("run", F.sum("_e").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy("doc_id", "run", "kind").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("first"))


#: An echoed anchor before a line, one after a diff's plus, a diff's plus, and a note that a read was cut.
ANCHOR_PREFIX = rf"^\s*(?:>>>|>>)?\s*(?:[+*]\s*)?\d+(?:{'|'.join(PAIRS)})[:|]"
PLUS_ANCHOR_PREFIX = rf"^\s*(?:>>>|>>)?\s*\+\s*\d+(?:{'|'.join(PAIRS)})[:|]"
PLUS = r"^[+](?![+])"
CUT_NOTE = r"^\[(?:Showing lines \d+-\d+ of \d+|\d+ more lines? in (?:file|\S+))\b.*\bsel=L?\d+"


def stripped(blocks: DataFrame) -> DataFrame:
    """Lines (block, line_no, text) of replacement texts without the anchors or diff signs that were copied with them.

    Anchors go where every line that is not empty has one, however often; a plus goes where no line has an anchor
    after it and half of the lines have a plus; where some lines have plus and anchor, both go from those.
    """
    c = F.col("text")
    note = c.rlike(CUT_NOTE)
    counts = (c != "") & ~note
    n = lambda test: F.coalesce(F.sum((counts & test).cast("int")), F.lit(0))
    votes = blocks.groupBy("block").agg(n(F.lit(True)).alias("_n"), n(c.rlike(ANCHOR_PREFIX)).alias("_a"), n(c.rlike(PLUS_ANCHOR_PREFIX)).alias("_pa"), n(c.rlike(PLUS)).alias("_p"))
    anchors = (F.col("_n") > 0) & (F.col("_a") == F.col("_n"))
    plus = ~anchors & (F.col("_pa") == 0) & (F.col("_p") > 0) & (F.col("_p") >= F.col("_n") * 0.5)
    any_ = (F.col("_n") > 0) & (anchors | plus | (F.col("_pa") > 0))
    # once the first is gone the next stands at the start, so all of them are one pattern
    all_anchors = F.regexp_replace(c, "^(?:" + ANCHOR_PREFIX[1:] + ")+", "")
    text = F.when(anchors, all_anchors).when(plus, F.regexp_replace(c, PLUS, "")).when(any_ & c.rlike(PLUS_ANCHOR_PREFIX), F.regexp_replace(c, ANCHOR_PREFIX, "")).otherwise(c)
    return blocks.join(votes, "block").filter(~(any_ & note)).select("block", "line_no", text.alias("text"))


def ordered_edits(edits: DataFrame) -> DataFrame:
    """(doc_id, place, idx) of (doc_id, idx, op, line, end, lines): each different edit once, bottom up, replacements
    before insertions at one line, and then as given."""
    level = F.create_map(*[F.lit(x) for kv in PRECEDENCE.items() for x in kv]).getItem(F.col("op"))
    once = edits.groupBy("doc_id", "op", "line", "end", "lines").agg(F.min("idx").alias("idx")).withColumn("_level", level)
    last = F.when(F.col("op") == "append", F.lit(2**62)).otherwise(0)
    w = Window.partitionBy("doc_id").orderBy(F.desc(F.coalesce("end", "line", last)), "_level", "idx")
    return once.select("doc_id", F.row_number().over(w).alias("place"), "idx")


def mismatch_frames(mismatches: DataFrame, lines: DataFrame, around: int = 3) -> DataFrame:
    """(doc_id, frame): the lines (doc_id, line_no, text, hash) around mismatched ones (doc_id, line), those marked, gaps as dots."""
    own = mismatches.select("doc_id", "line").distinct()
    near = own.select("doc_id", F.explode(F.sequence(F.col("line") - around, F.col("line") + around)).alias("line_no"), "line")
    near = near.groupBy("doc_id", "line_no").agg(F.max((F.col("line") == F.col("line_no")).cast("int")).alias("hit"))
    shown = near.join(lines.select("doc_id", "line_no", "text", "hash"), ["doc_id", "line_no"])
    gap = F.lag("line_no").over(Window.partitionBy("doc_id").orderBy("line_no"))
    row = F.concat(F.when(F.col("line_no") > gap + 1, "...\n").otherwise(""), F.when(F.col("hit") == 1, "*").otherwise(" "), F.col("line_no").cast("string"), "hash", F.lit("|"), "text")
    rows = shown.select("doc_id", "line_no", row.alias("row"))
    lists = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("line_no", "row"))).alias("l")).join(own.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")), "doc_id")
    head = F.concat(F.lit("Edit rejected: "), F.col("n").cast("string"), F.when(F.col("n") > 1, " lines have").otherwise(" line has"), F.lit(" changed since the last read (marked *).\n"))
    return lists.select("doc_id", F.concat(head, F.array_join(F.transform("l", lambda v: v.row), "\n")).alias("frame"))


def hover_anchors(cursors: DataFrame, lines: DataFrame, around: int = 5) -> DataFrame:
    """(doc_id, line, anchor, first, last): the anchor of a line (from 1) and the lines to read around it."""
    n = lines.groupBy("doc_id").agg(F.max("line_no").alias("_n"))
    here = cursors.select("doc_id", "line").join(lines.select("doc_id", F.col("line_no").alias("line"), "hash"), ["doc_id", "line"]).join(n, "doc_id")
    return here.select("doc_id", "line", F.concat(F.col("line").cast("string"), "hash").alias("anchor"), F.greatest(F.lit(1), F.col("line") - around).alias("first"), F.least(F.col("_n"), F.col("line") + around).alias("last"))


def edit_file(text: str, edits: list[dict], dry_run: bool = False) -> dict:
    """The edited text with its byte order mark and line ends, the numbered diff, and whether anything was written.

    A text of None is a file that does not exist yet: appending and prepending make it.
    """
    if text is None:
        if any(e["op"] not in ("append", "prepend") or e.get("line") for e in edits):
            raise ValueError("only append and prepend make a file")
        text = ""
    mark = "\ufeff" if text.startswith("\ufeff") else ""
    body = text.removeprefix("\ufeff")
    first = body.find("\n")
    end = "\r\n" if first > 0 and body[first - 1] == "\r" else "\n"
    plain = body.replace("\r\n", "\n").replace("\r", "\n")
    new, changed = apply_edits(plain.split("\n") if plain else [], edits)
    after = "\n".join(new)
    return {"text": text if dry_run else mark + after.replace("\n", end), "diff": numbered_diff(plain, after), "first_changed": changed, "written": not dry_run and after != plain}
