"""Anchors of files as they are read again: which lines stay, move or die, by diffs against kept state.

The state of a path is a map from line number to line hash, so a read writes only the lines
whose hash changed. A read is compared with it by a shortest edit script over hashes: lines
that the script keeps carry their anchors to their new places, even among equal lines. For
a line that it deletes, a line with the same hash within ten lines of its old place takes
over if there is just one.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.text import line_hash
from ..operators.lines import line_diff
from .stream import run_told

REACH = 10
OUT = "path string, pos long, line long, hash string, now long, fate string"
#: The state store that keeps state by keys; set on the session before such a stream starts.
PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def hashes_of(content: str | None) -> list[str]:
    return [line_hash(i, t) for i, t in enumerate((content or "").split("\n"), 1)]


def kept_lines(old: list[str], new: list[str]) -> dict[int, int]:
    """Old line numbers to new ones of lines that a shortest edit script keeps."""
    out, at = {}, 0
    for kind, number, _ in line_diff(old, new):
        at += kind != "+"
        if kind == "=":
            out[at] = number
    return out


def fates(old: list[str], new: list[str], reach: int = REACH) -> list[tuple[int, str, int | None, str]]:
    """(line, hash, line now, fate) of every old line: kept, moved, found again nearby, or lost."""
    kept, out = kept_lines(old, new), []
    for line, said in enumerate(old, 1):
        now = kept.get(line)
        if now is not None:
            out.append((line, said, now, "kept" if now == line else "moved"))
            continue
        centre = min(line, len(new))
        near = [i for i in range(max(1, centre - reach), min(len(new), centre + reach) + 1) if new[i - 1] == said]
        out.append((line, said, near[0], "found") if len(near) == 1 else (line, said, None, "lost"))
    return out


class Reconciler(StatefulProcessor):
    """Rows of a path in the order of pos; those of one micro-batch are held together, so a trigger bounds their number."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.lines = handle.getMapState("lines", "line long", "hash string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        reads = pd.concat(list(rows)).sort_values("pos", kind="stable")
        held = {k[0]: v[0] for k, v in self.lines.iterator()}
        old = stored = [held[i] for i in sorted(held)]
        for pos, content in zip(reads.pos, reads.content, strict=True):
            new = hashes_of(content)
            if old:
                told = pd.DataFrame(fates(old, new), columns=["line", "hash", "now", "fate"])
                yield pd.DataFrame({"path": key[0], "pos": pos, "line": told.line, "hash": told.hash, "now": told.now.astype("Int64"), "fate": told.fate})
            old = new
        for i, said in enumerate(old, 1):
            if i > len(stored) or stored[i - 1] != said:
                self.lines.updateValue((i,), (said,))
        for i in range(len(old) + 1, len(stored) + 1):
            self.lines.removeKey((i,))

    def close(self) -> None:
        pass


def fates_of_reads(before: str | None, content: str) -> pd.DataFrame:
    """The fates of the lines of the read before, none for a first read."""
    rows = [] if before is None else fates(hashes_of(before), hashes_of(content))
    return pd.DataFrame(rows, columns=["line", "hash", "now", "fate"]).astype({"line": "int64", "now": "Int64"})


def reconciled_whole(reads: DataFrame, path: str) -> DataFrame:
    """Like reconciled() for a stream that runs to its end: reads of one path spread over tasks, and equal pairs of texts
    are compared once a task."""
    return run_told(reads, path, fates_of_reads, OUT)


def reconciled(reads: DataFrame) -> DataFrame:
    """Of a stream of reads (path, pos, content): (path, pos, line, hash, now, fate) of every line that was anchored before."""
    reads.sparkSession.conf.set(*PROVIDER)
    return reads.select("path", "pos", "content").groupBy("path").transformWithStateInPandas(Reconciler(), OUT, "append", "none")
