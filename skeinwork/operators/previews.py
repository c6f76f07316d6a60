"""Compact previews of numbered diffs: changed pairs as one line, long unchanged runs shortened, changes counted."""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame

from ..functions.text import line_hash

#: A line of a numbered diff, the text of a stretch that it leaves out, and what stands for an anchor's letters.
NUMBERED = re.compile(r"([ +-])(\s*\d+)\|([^\n\r\u2028\u2029]*)")
LEFT_OUT, NO_LETTERS = "...", "  "


class Line(NamedTuple):
    kind: str
    old: int
    new: int
    text: str

    @property
    def shown(self) -> str:
        if not self.kind:
            return self.text
        at = self.old if self.kind == "-" or self.text == LEFT_OUT and self.kind == " " else self.new
        letters = NO_LETTERS if self.kind == "-" or self.text == LEFT_OUT else line_hash(at, self.text)
        return f"{self.kind}{at}{letters}|{self.text}"


def numbered(diff: str) -> Iterator[Line]:
    """The diff's lines with places in both files; other lines have no kind.

    A line has one number, of the file that its sign names. The place in the other file is carried on; one's own moves by
    what the number differs from the last line's place. The step over a line counts besides, so places may run ahead of numbers.
    """
    old = new = 0
    last: Line | None = None
    for raw in diff.split("\n") if diff else ():
        m = NUMBERED.fullmatch(raw)
        if m is None:
            last = Line("", 0, 0, raw)
            yield last
            continue
        kind, at, text = m[1], int(m[2]), m[3]
        if kind in " -":
            old = old + at - (last.old if last else old) if old else at
        if kind in " +":
            new = new + at - (last.new if last else new) if new else at
        last = Line(kind, (old or at) if kind == "+" else at, new or at, text)
        yield last
        if text != LEFT_OUT:
            old += kind in " -"
            new += kind in " +"


def paired(runs: list[list[Line]]) -> Iterator[list[Line]]:
    """Runs of one kind; of a deleted run before an added one, line by line, pairs become changed lines of kind *."""
    at = 0
    while at < len(runs):
        run, after = runs[at], runs[at + 1] if at + 1 < len(runs) else []
        at += 1
        if run[0].kind == "-" and after and after[0].kind == "+":
            gone, come = ([x for x in r if x.text != LEFT_OUT] for r in (run, after))
            if n := min(len(gone), len(come)):
                yield [Line("*", a.old, b.new, b.text) for a, b in zip(gone[:n], come[:n], strict=True)]
                yield from (rest for rest in (gone[n:], come[n:]) if rest)
                at += 1
                continue
        yield run


def preview(diff: str | None, most: int = 2) -> tuple[str, int, int]:
    """(preview, lines added, lines removed); of an unchanged run the `most` lines beside a change are shown."""
    runs = list(paired([list(g) for _, g in itertools.groupby(numbered(diff or ""), key=lambda x: x.kind)]))
    out: list[str] = []
    added = removed = 0
    for i, run in enumerate(runs):
        kind = run[0].kind
        if kind == " ":
            if i == 0:
                run = run[-most:]
            elif i == len(runs) - 1:
                run = run[:most]
            elif len(run) > 2 * most:
                out += [x.shown for x in run[:most]] + [f" ... {len(run) - 2 * most} more unchanged lines"]
                run = run[-most:]
        elif kind:
            n = sum(x.text != LEFT_OUT or kind == "*" for x in run)
            added, removed = added + n * (kind in "+*"), removed + n * (kind in "-*")
        out += [x.shown for x in run]
    return "\n".join(out), added, removed


def compact(diffs: DataFrame, most: int = 2) -> DataFrame:
    """(id, preview, added, removed) of (id, diff); a null diff is an empty one."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            made = [preview(d, most) for d in pdf["diff"]]
            yield pd.DataFrame({"id": pdf["id"], **{c: [m[i] for m in made] for i, c in enumerate(("preview", "added", "removed"))}})

    return diffs.select("id", "diff").mapInPandas(run, "id long, preview string, added long, removed long")
