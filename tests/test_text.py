import random

import pytest
from pyspark.sql import functions as F

from skeinwork.functions import text as x
from skeinwork.operators import budget, lines, messages, retrieval
from skeinwork.plans import registry

VECTORS = [(1, "const x = 1", "un"), (2, "  return x;", "mr"), (3, "}", "rd"), (42, "function hi() {", "tz"), (1, "", "st"), (5, "  ", "th"), (15, 'import { readFile } from "fs"', "dr"), (20, '    "hello world"', "uc"), (100, "", "th"), (2, "  return;", "tr"), (10, "hello", "tv")]


@pytest.mark.parametrize(("no", "line", "want"), VECTORS)
def test_line_hash(no, line, want):
    assert x.line_hash(no, line) == want


def test_every_line_is_anchored(spark, tmp_path):
    texts = {1: "\n".join(f"  const x{i} = {i};" for i in range(12)) + "\n\n}", 2: "", 3: None}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = {(d, i, f"{i}{x.line_hash(i, t)}|{t}") for d, text in texts.items() if text is not None for i, t in enumerate(text.split("\n"), 1)}
    got = [tuple(r) for r in registry.QUERIES["f11_anchored_lines"](spark, str(tmp_path)).collect()]
    assert len(got) == len(want) == 15 and set(got) == want


def test_every_line_has_its_hash(spark, tmp_path):
    texts = {1: "\n".join(f"  const x{i} = {i};" for i in range(12)) + "\n\n}\n--", 2: "", 3: None, 4: "é 東\r\n  \r"}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = {(d, i, x.line_hash(i, t)) for d, text in texts.items() if text is not None for i, t in enumerate(text.split("\n"), 1)}
    assert set(map(tuple, registry.QUERIES["f10_line_hash"](spark, str(tmp_path)).collect())) == want


@pytest.mark.parametrize(("most_lines", "most_bytes"), [(3, 40), (200, 30), (2, 10_000)])
def test_chunks_line_by_line(spark, most_lines, most_bytes):
    rng = random.Random(most_bytes)
    texts = {d: ["é" * rng.randrange(12) for _ in range(rng.randrange(1, 40))] for d in range(6)}
    want = []
    for d, ls in texts.items():
        chunk, held = 0, []
        for no, t in enumerate(ls, 1):
            if held and (len(held) >= most_lines or len("\n".join([*(x for _, x in held), t]).encode()) > most_bytes):
                want.append((d, chunk, held[0][0], len(held)))
                chunk, held = chunk + 1, []
            held.append((no, t))
            if len(held) >= most_lines or len("\n".join(x for _, x in held).encode()) >= most_bytes:
                want.append((d, chunk, held[0][0], len(held)))
                chunk, held = chunk + 1, []
        if held:
            want.append((d, chunk, held[0][0], len(held)))
    df = spark.createDataFrame([(d, i, t) for d, ls in texts.items() for i, t in enumerate(ls, 1)], "doc_id long, line_no long, text string")
    got = lines.chunks(df, most_lines, most_bytes).select("doc_id", "chunk", "first_line", "n_lines").collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_edited_files_keep_mark_and_line_ends():
    out = lines.edit_file("\ufeffa\r\nb\r\n", [{"op": "replace", "line": 2, "lines": ["c"]}])
    assert out["text"] == "\ufeffa\r\nc\r\n" and out["written"] and out["first_changed"] == 2
    assert lines.edit_file("a", [{"op": "delete", "line": 1}], dry_run=True) | {"diff": ""} == {"text": "a", "diff": "", "first_changed": 1, "written": False}
    assert lines.edit_file(None, [{"op": "append", "lines": ["x"]}])["text"] == "x"
    with pytest.raises(ValueError):
        lines.edit_file(None, [{"op": "replace", "line": 1, "lines": ["x"]}])


def test_prefixes_go_by_vote(spark):
    blocks = {"all": ["12ab|x", " >>> 3un:y", ""], "some": ["12ab|x", "y"], "plus": ["+a", "++b", "+c", "d"], "few": ["+a", "b", "c"], "mixed": ["+ 12ab|x", "y"], "note": ["[Showing lines 1-5 of 9 more sel=L6", "1st|z"]}
    want = {"all": ["x", "y", ""], "some": blocks["some"], "plus": ["a", "++b", "c", "d"], "few": blocks["few"], "mixed": ["x", "y"], "note": ["z"]}
    df = spark.createDataFrame([(b, i, t) for b, ls in blocks.items() for i, t in enumerate(ls)], "block string, line_no long, text string")
    got = {}
    for r in lines.stripped(df).orderBy("line_no").collect():
        got.setdefault(r.block, []).append(r.text)
    assert got == want


def test_functions(spark):
    row = spark.createDataFrame([("a\r\nb\n", "file:src/a.ts:Foo", "file:src/a.ts", "12un|x", "getUserData from authService")], "t string, n string, m string, a string, q string").select(x.line_ending(F.col("t")), x.to_lf(F.col("t")), x.node_path(F.col("n")), x.node_symbol(F.col("n")), x.node_symbol(F.col("m")), x.parse_anchor(F.col("a")), retrieval.query_tokens(F.col("q")), x.glob_match(F.lit("Claims-9"), "claims-*")).first()
    assert row[:5] == ("crlf", "a\nb\n", "src/a.ts", "Foo", None)
    assert tuple(row[5]) == (12, "un")
    assert set(row[6]) == {"getuserdata", "get", "user", "data", "from", "authservice", "auth", "service"}
    assert row[7]


def test_message_rules(spark):
    chat = spark.createDataFrame([(1, 0, "user", "hello"), (1, 1, "assistant", "hi"), (1, 2, "user", "hello"), (1, 3, "toolResult", "same"), (1, 4, "toolResult", "same"), (1, 5, None, "z"), (1, 6, None, "z")], "conv_id long, pos long, role string, content string")
    assert sorted(r.pos for r in messages.drop_duplicates(chat).collect()) == [0, 1, 3, 4, 5, 6]
    tools = spark.createDataFrame([(1, 0, "tool", True), (1, 1, "user", False), (1, 2, "tool", False), (1, 3, "tool", True), (1, 4, "tool", True)], "conv_id long, pos long, role string, is_error boolean")
    assert sorted(r.pos for r in messages.drop_resolved_errors(tools).collect()) == [1, 2, 3, 4]


def test_compiler_errors(spark):
    df = spark.createDataFrame([(1, 0, "toolResult", "src/a.ts(3,5): error TS1 bad\nsrc/b.rs:7:2: error: no\nsrc/a.ts(3,5): error TS1 bad"), (1, 1, "user", "src/c.ts(1,1): error x")], "conv_id long, pos long, role string, content string")
    assert sorted((r.path, r.line, r.col) for r in messages.compiler_errors(df).collect()) == [("src/a.ts", 2, 4), ("src/b.rs", 6, 1)]


def test_greedy_skips_and_goes_on(spark):
    items = spark.createDataFrame([(1, i, i, c) for i, c in enumerate([50, 70, 40, 10])], "grp long, pos long, id long, cost long")
    assert sorted(r.id for r in budget.greedy(items, 100).collect()) == [0, 2, 3]
    assert sorted(r.id for r in budget.greedy(items, 30, first_always=True).collect()) == [0]


def test_edits_run_bottom_up():
    out, first = lines.apply_edits(list("abcde"), [{"op": "replace", "line": 2, "lines": ["B"]}, {"op": "append", "line": 2, "lines": ["x"]}, {"op": "prepend", "line": 2, "lines": ["w"]}, {"op": "delete", "line": 4, "end": 5}, {"op": "append", "lines": ["end"]}])
    assert (out, first) == (["a", "w", "B", "x", "c", "end"], 2)
    assert lines.apply_edits(["a"], [{"op": "replace", "line": 1, "lines": ["a"]}]) == (["a"], None)
    with pytest.raises(ValueError):
        lines.apply_edits(["a", "b"], [{"op": "replace_range", "line": 2, "end": 1, "lines": []}])


def test_diff_is_a_shortest_script():
    rng = random.Random(3)
    for _ in range(60):
        a = [rng.choice("abc") for _ in range(rng.randint(0, 9))]
        b = [rng.choice("abc") for _ in range(rng.randint(0, 9))]
        script = lines.line_diff(a, b)
        assert [t for k, _, t in script if k != "+"] == a
        assert [t for k, _, t in script if k != "-"] == b
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, p in enumerate(a):
            for j, q in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if p == q else max(best[i][j + 1], best[i + 1][j])
        assert sum(k != "=" for k, *_ in script) == len(a) + len(b) - 2 * best[-1][-1]
    assert "-2 b" in lines.numbered_diff("a\nb\nc", "a\nc")


def test_rebase_needs_one_match(spark):
    rows = spark.createDataFrame([(1, i + 1, t, t) for i, t in enumerate("abcab")], "doc_id long, line_no long, text string, anchor string")
    asked = spark.createDataFrame([(1, 5, "c"), (1, 3, "a"), (1, 1, "a")], "doc_id long, line long, hash string")
    assert {(r.line, r.hash): r.rebased for r in lines.rebase(asked, rows).collect()} == {(5, "c"): 3, (3, "a"): None, (1, "a"): 4}


def test_chunks(spark):
    rows = spark.createDataFrame([(1, i + 1, "x" * n) for i, n in enumerate([3, 3, 50, 2, 2])], "doc_id long, line_no long, text string")
    got = [(r.first_line, r.n_lines, r.n_bytes) for r in lines.chunks(rows, 2, 10).orderBy("chunk").collect()]
    assert got == [(1, 2, 7), (3, 1, 50), (4, 2, 5)]


def test_hashes_of_whole_columns(spark):
    """xxHash32 with a seed by row, and the lines that get an ordinal's ending, against one line at a time."""
    import random

    import numpy as np
    import pyarrow as pa
    import xxhash

    rng = random.Random(3)
    line = lambda: "".join(rng.choice("aZ9é日 {}\t\r🙂-_  　²Ⅷ") for _ in range(rng.choice([0, 1, 2, 3, 5, 15, 16, 17, 31, 47, 80, 2500])))
    rows = [line() for _ in range(1500)] + ["", "}", " {\r", " ", "---", "a" * 70_000]
    seeds = np.array([rng.randrange(2**32) for _ in rows])
    assert x.xxh32(pa.array(rows).slice(3), seeds[3:]).tolist() == [xxhash.xxh32_intdigest(r.encode(), int(s)) for r, s in zip(rows[3:], seeds[3:], strict=True)]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows, 1)] + [(None, "x"), (1, None)], "n long, t string")
    got = {(r.n, r.t): r.h for r in df.select("n", "t", x.line_hash_column(df.n, df.t).alias("h")).collect()}
    assert got == {**{(i, r): x.line_hash(i, r) for i, r in enumerate(rows, 1)}, (None, "x"): None, (1, None): None}
