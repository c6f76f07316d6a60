"""Anchors over reads of a file, against the longest common subsequence by definition."""

import functools
import random

import pytest

from skeinwork.streaming import anchors
from skeinwork.streaming import stream as st


def longest(a, b):
    @functools.cache
    def at(i, j):
        if i == len(a) or j == len(b):
            return 0
        return max(at(i + 1, j), at(i, j + 1), 1 + at(i + 1, j + 1) if a[i] == b[j] else 0)

    return at(0, 0)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_kept_lines_are_a_longest_common_subsequence(seed):
    rng = random.Random(seed)
    for _ in range(300):
        a, b = ([rng.choice("xyz") for _ in range(rng.randrange(9))] for _ in range(2))
        kept = anchors.kept_lines(a, b)
        pairs = sorted(kept.items())
        assert all(a[i - 1] == b[j - 1] for i, j in pairs) and all(p[1] < q[1] for p, q in zip(pairs, pairs[1:], strict=False))
        assert len(pairs) == longest(tuple(a), tuple(b))


def test_fates():
    told = lambda a, b: [(line, now, fate) for line, _, now, fate in anchors.fates(a, b)]
    assert told(list("abc"), list("xabc")) == [(1, 2, "moved"), (2, 3, "moved"), (3, 4, "moved")]
    # of two equal lines one goes: the other keeps its anchor, and the copy that is left stands in for the lost one
    assert sorted(told(list("aab"), list("ab"))) == [(1, 1, "kept"), (2, 1, "found"), (3, 2, "moved")]
    # a line that went elsewhere: the script deletes it, its only copy nearby takes over; of two copies none does
    assert told(list("abcd"), list("bcda"))[0] == (1, 4, "found")
    assert told(list("abcd"), list("bcdaa"))[0] == (1, None, "lost")
    assert told(["a", *"bcdefghijklmnop"], [*"bcdefghijklmnop", "a"])[0] == (1, None, "lost")
    assert told(list("ab"), []) == [(1, None, "lost"), (2, None, "lost")]


def test_state_over_batches_and_a_restart(spark, tmp_path):
    versions = ["a1\nb2\nc3", "a1\nc3", "new\na1\nc3\nd4\ne5", "e5", "", "e5\nf6"]
    out = None
    for stop in (2, 5, 6):
        for pos in range({2: 0, 5: 2, 6: 5}[stop], stop):
            spark.createDataFrame([("f", pos, versions[pos]), (f"other{pos}", pos, "x")], "path string, pos long, content string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        reads = spark.readStream.schema("path string, pos long, content string").parquet(str(tmp_path / "in"))
        out = st.run_available(anchors.reconciled(reads), str(tmp_path / "out"))
    want = {(i, line, now, fate) for i in range(1, len(versions)) for line, _, now, fate in anchors.fates(anchors.hashes_of(versions[i - 1]), anchors.hashes_of(versions[i]))}
    assert {(r.pos, r.line, r.now, r.fate) for r in out.collect()} == want
