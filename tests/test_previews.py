"""Compact previews, worked out by hand from the rules; a number that goes on by one counts once more than it should, as the rules have it."""

import pytest

from skeinwork.functions.text import line_hash
from skeinwork.operators import previews


def at(sign, n, text):
    return f"{sign}{n}{line_hash(n, text)}|{text}"


@pytest.mark.parametrize(("diff", "want"), [
    ("", ("", 0, 0)),
    (None, ("", 0, 0)),
    ("-1|old\n+1|new one", (at("*", 1, "new one"), 1, 1)),
    ("-1|a\n-2|b\n+1|c", ("\n".join([at("*", 1, "c"), "-2  |b"]), 1, 2)),
    ("-1|a\n+1|b\n+2|c", ("\n".join([at("*", 1, "b"), at("+", 3, "c")]), 2, 1)),
    ("+1|x\n-1|y", ("\n".join([at("+", 1, "x"), "-1  |y"]), 1, 1)),
    # unchanged lines before the first and after the last change: two beside it
    (" 1|a\n 2|b\n 3|c\n+4|d\n 4|e\n 5|f\n 6|g", ("\n".join([at(" ", 3, "b"), at(" ", 4, "c"), at("+", 5, "d"), at(" ", 5, "e"), at(" ", 6, "f")]), 1, 0)),
    ("@@ note\n+1|x", ("\n".join(["@@ note", at("+", 1, "x")]), 1, 0)),
    ("+1|x\n 2|...\n", ("\n".join([at("+", 1, "x"), " 2  |...", ""]), 1, 0)),
    ("-1|...\n+1|b", ("\n".join(["-1  |...", at("+", 1, "b")]), 1, 0)),
])
def test_previews(diff, want):
    assert previews.preview(diff) == want


def test_long_unchanged_runs_are_shortened():
    diff = "\n".join(["+1|a", *(f" {i}|u{i}" for i in range(2, 9)), "+9|z"])
    text, added, removed = previews.preview(diff)
    shown = text.split("\n")
    assert (added, removed, len(shown)) == (2, 0, 7) and shown[3] == " ... 3 more unchanged lines"
    assert [x.partition("|")[2] for x in shown if "|" in x] == ["a", "u2", "u3", "u7", "u8", "z"]
    short = "\n".join(["+1|a", *(f" {i}|u{i}" for i in range(2, 6)), "+6|z"])
    assert len(previews.preview(short)[0].split("\n")) == 6


def test_rows(spark):
    df = spark.createDataFrame([(1, "-1|old\n+1|new"), (2, None), (None, "")], "id long, diff string")
    assert {tuple(r) for r in previews.compact(df).collect()} == {(1, at("*", 1, "new"), 1, 1), (2, "", 0, 0), (None, "", 0, 0)}
