"""Fill-in-middle against lists of units."""

import hashlib
import random
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from skeinwork.llm import common, middle


def plain_version(doc_id, text, seed=1):
    text = text or ""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * i : 8 * i + 8], 16) for i in range(4))
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    n = len(units)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    if h4 % 100 < 20:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def texts(seed, n):
    rng = random.Random(seed)
    pieces = ["a", "Zz", " ", "  ", "\n", "é", "日本", "🙂", "<", "<P", "S>", ">", "1", "́", "\x00", "word", "[", "`", "{", "@"]
    return ["".join(rng.choice(pieces) for _ in range(rng.randrange(30))) for _ in range(n)]


def test_every_place_of_every_text():
    all_texts = ["", *texts(1, 300), "é", "a", "x" * 5000 + "1" * 5000]
    runs = middle.encode(*common.utf8(pa.array(all_texts)))
    for i, text in enumerate(all_texts):
        units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
        assert runs.units[i] == len(units) and runs.chars[i] == len(text)
        assert len(re.findall(r"[A-Za-z]+|[^A-Za-z]+", text)) == runs.first[i + 1] - runs.first[i]
        if len(units) < 100:
            assert [middle.place(runs, i, u) for u in range(len(units) + 1)] == [len("".join(units[:u])) for u in range(len(units) + 1)]


def test_outputs_and_way_back(spark):
    rows = [*enumerate(texts(2, 2000)), (None, "no id here"), (7, None), (8, "has <P> in it"), (9, "ends with <"), (9, "ends with <"), (10, "ab " * 400_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = middle.fill_in_middle(df).withColumn("back", middle.restored(F.col("output"), F.col("form")))
    got = [(r.doc_id, r.text, (r.n, r.form, r.prefix_chars, r.middle_chars, r.output), r.back) for r in out.collect()]
    assert len(got) == len(rows) and {g[2][1] for g in got} == {"plain", "psm", "spm"}
    for doc_id, text, made, back in got:
        assert made == plain_version(doc_id, text)
        assert back == (text or "")


@pytest.mark.parametrize("seed", [2, 3])
def test_parameters(spark, seed):
    df = spark.createDataFrame([(i, "one two three") for i in range(200)], "doc_id long, text string")
    out = middle.fill_in_middle(df, seed=seed, plain_from=100, spm_below=100).collect()
    assert {r.form for r in out} == {"spm"} and len({r.prefix_chars for r in out}) > 3
    assert all(r.prefix + r.middle + r.suffix == r.text for r in out)


def test_rough(rough, nothing):
    out = middle.fill_in_middle(rough)
    rows = out.collect()
    assert len(rows) == rough.count() and middle.fill_in_middle(nothing).count() == 0
    assert sorted(out.columns) == sorted({*rough.columns, *middle.MADE})
    assert {(r.n, r.form) for r in rows if not r.text} == {(0, "plain")}
