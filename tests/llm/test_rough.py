"""Every operator and stage on nulls, empty and long texts, repeats, empty tables and clashing names."""

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from skeinwork.llm import common, decontaminate, html, ngram_join, packing, quality, quotes, suffix, topk, toxicity, warc


def test_jaccard(rough, nothing):
    got = {(r.doc_id, r.n_shingles): r.component_id for r in ngram_join.jaccard_classes(rough).collect()}
    assert got[(1, 17)] == got[(2, 17)] == got[(10, 17)] == 1
    assert got[(None, 17)] is None
    assert got[(3, 0)] == 3 and got[(4, 0)] == 4 and got[(8, 0)] == 8
    assert got[(6, 1)] == got[(7, 1)] == 6
    assert got[(5, 29996)] == got[(9, 29997)] == 5
    assert ngram_join.jaccard_classes(rough).count() == 12
    assert ngram_join.jaccard_classes(nothing).count() == 0


def test_suffix(rough, nothing):
    rows = suffix.dedup(rough, width=60).collect()
    assert len(rows) == 12
    assert {r.n_removed for r in rows if r.text is None or not r.text.strip()} == {0}
    assert all(r.n_removed == len(r.text) for r in rows if r.doc_id in (1, 2))
    assert all(r.n_removed == 0 for r in rows if r.doc_id == 10)
    assert suffix.dedup(nothing).count() == 0


def test_periodic_texts(spark):
    df = common.cut(spark.createDataFrame([(1, "a" * 400_000), (2, "ab" * 100_000), (3, "a" * 399)], "doc_id long, text string"), "texts")
    assert {(r.doc_id, r.n_bytes, r.n_removed, r.n_spans) for r in suffix.dedup(df, digest_only=True).collect()} == {(1, 400_000, 400_000, 1), (2, 200_000, 200_000, 1), (3, 399, 0, 0)}


def test_quality(rough, nothing, labels):
    rows = quality.judge(rough, labels).collect()
    assert len(rows) == 12
    assert not any(r.kept for r in rows if not (r.text or ""))
    assert all(r.kept for r in rows if r.doc_id in (1, 2))
    assert quality.judge(nothing, labels).count() == 0
    assert all(r.kept for r in quality.judge(rough, labels.limit(0)).collect())


def test_decontaminate(spark, rough, nothing):
    items = spark.createDataFrame([(1, "quick brown fox jumps over the lazy dog and runs away from all"), (2, None), (3, ""), (4, "one two"), (None, "hounds that follow")], "item_id long, text string")
    got = sorted((r.doc_id or -1, r.item_id or -1) for r in decontaminate.find_overlaps(rough, items).collect())
    assert got == sorted([(d, i) for d in (1, 2, 2, -1, 10) for i in (1, -1)] + [(6, 4), (7, 4)])
    assert decontaminate.find_overlaps(nothing, items).count() == decontaminate.find_overlaps(rough, items.limit(0)).count() == 0
    assert sorted(r.doc_id or -1 for r in decontaminate.drop_contaminated(rough, items).collect()) == [-1, 3, 4, 5, 8, 9]


def test_pack(rough, nothing):
    rows = packing.pack(rough, packing.default_tokenizer()).collect()
    assert {r.doc_id for r in rows} == {None, *range(1, 11)}
    assert [r.length for r in rows if r.doc_id in (3, 4)] == [1, 1]
    assert packing.pack(nothing, packing.default_tokenizer()).count() == 0


def test_toxicity(rough, nothing, labels):
    rows = toxicity.classify(rough, labels).collect()
    assert len(rows) == 12 and all(0 <= r.score <= 1 for r in rows)
    assert toxicity.classify(nothing, labels).count() == 0
    assert {r.score for r in toxicity.classify(rough, labels.limit(0)).collect()} == {0.0}


def test_html(spark):
    df = spark.createDataFrame([(1, "u", "<p>a &amp; b</p>", 5), (None, None, None, 5), (2, "u", "", 5), (1, "u", "<p>a &amp; b</p>", 5), (3, "u", "x" * 300_000, 5)], "page_id long, url string, html string, text int")
    assert sorted((r.page_id or 0, r.n_chars) for r in html.extract(df).collect()) == [(0, 0), (1, 5), (1, 5), (2, 0), (3, 300_000)]
    assert html.extract(df.limit(0)).count() == 0


def test_warc(spark):
    page = "<p>" + "same text " * 20
    rows = [(3, "u", page, 1), (1, "v", page, 1), (None, None, page, 1), (2, "w", None, 1), (4, "x", "é" * 60, 1), (5, "x\ny", "\u0000<p>", 1), (1, "v", page, 1), (6, "z", "q" * 400_000, 1)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, digest int")
    plan = warc.plan_records(df, "page_id", "url", "html", 100)
    folder = common.new_folder(spark, "warc")
    files = common.cut(warc.write_archives(plan, folder), "files")
    for split in (1 << 20, 100):
        got = sorted((r.record_id or "", r.record_type, r.refers_to or "", r.payload_bytes, None if r.payload is None else bytes(r.payload)) for r in warc.read_archives(files, split).collect())
        b = page.encode()
        assert got == sorted([("1", "response", "", len(b), b), ("1", "response", "", len(b), b), ("3", "revisit", "1", len(b), None), ("", "revisit", "1", len(b), None), ("2", "response", "", 0, b""), ("4", "response", "", 120, ("é" * 60).encode()), ("5", "response", "", 4, b"\x00<p>"), ("6", "response", "", 400_000, b"q" * 400_000)], key=lambda x: x[:4])
    assert sorted(r.bytes for r in warc.list_archives(spark, folder).collect()) == sorted(r.bytes for r in files.collect())
    empty = common.cut(warc.write_archives(plan.limit(0), folder), "files")
    assert warc.read_archives(empty).count() == 0


def test_records_of_other_writers(spark, tmp_path):
    import base64
    import gzip
    import hashlib

    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n"
    b32 = "sha1:" + base64.b32encode(hashlib.sha1(b"page one").digest()).decode()

    def record(kind, rid, block, *fields, length=None):
        head = [f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{rid}>", *fields, f"Content-Length: {len(block) if length is None else length}"]
        return gzip.compress(("WARC/1.0\r\n" + "\r\n".join(head) + "\r\n\r\n").encode() + block + b"\r\n\r\n")

    is_http = "Content-Type: application/http; msgtype=response"
    parts = [
        record("warcinfo", "a", b"software: x\r\n", "Content-Type: application/warc-fields"),
        record("response", "b", http + b"page one", is_http, f"WARC-Payload-Digest: {b32}"),
        b"junk \x1f\x8b\x08 between",
        record("response", "c", http + b"page two", is_http, f"WARC-Payload-Digest: {b32}"),
        record("response", "d", http + b"page", is_http, length="many"),
        record("response", "e", http + b"cut", is_http, length=9999),
        record("resource", "f", b"\r\n\r\nplain", "WARC-Payload-Digest: md5:" + hashlib.md5(b"\r\n\r\nplain").hexdigest().upper()),
    ]
    path = tmp_path / "x.warc.gz"
    path.write_bytes(b"".join(parts))
    files = spark.createDataFrame([(str(path), len(b"".join(parts)))], "path string, bytes long")
    for split in (1 << 20, 64):
        got = {r.record_id[-1]: (r.record_type, None if r.payload is None else bytes(r.payload), r.intact) for r in warc.read_archives(files, split).collect()}
        assert got["a"] == ("warcinfo", b"software: x\r\n", None) and got["b"] == ("response", b"page one", True)
        assert got["c"] == ("response", b"page two", False) and got["f"] == ("resource", b"\r\n\r\nplain", True)
        assert got["d"][2] is False and got["e"][2] is False and got["e"][1].startswith(b"cut") and len(got) == 6


def test_topk(spark):
    rows = [(0, [1.0, 2.0]), (1, [1.0, 2.0]), (2, [1.0, 2.0]), (3, None), (4, [1.0, None]), (5, [float("nan"), 1.0]), (6, [-9.0, 0.5]), (None, [9.0, 9.0]), (20, [0.0, 0.0]), (7, [1.0, 2.0, 3.0]), (40, []), (1, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 AS len", "2 AS dim")
    got = {q: [(r.vec_id, r.score) for r in sorted(topk.search(df, "vec_id % 20 = 0", 2).collect(), key=lambda r: r["rank"]) if r.query_id == q] for q in (0, 20, 40)}
    assert got == {0: [(1, 64 * 64 * 5), (1, 64 * 64 * 5)], 20: [(0, 0), (1, 0)], 40: []}
    twice = spark.createDataFrame([(0, [1.0]), (1, [5.0]), (1, [3.0]), (2, [4.0]), (0, [2.0])], "vec_id long, embedding array<double>")
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score // 4096) for r in topk.search(twice, "vec_id % 20 = 0", 9).collect())
    assert got == sorted([(0, 1, 1, 5), (0, 2, 2, 4), (0, 3, 1, 3), (0, 4, 0, 2), (0, 1, 1, 10), (0, 2, 2, 8), (0, 3, 1, 6), (0, 4, 0, 2)])
    assert topk.search(df.limit(0), "vec_id % 20 = 0", 2).count() == 0


def test_quotes(spark):
    rows = [(1, 0, "user", "Hello there my friend.\nHow are you today?"), (1, 1, "assistant", "On Monday, Bob wrote:\n> Hello there my friend.\n> How are\n> you today?\n\nI am fine thanks"), (1, 2, "user", "> I am fine   THANKS\n>> Hello there my friend.\ngood"), (1, 3, "user", "apart"), (1, 4, "user", "> how are you today?\nI asked"), (None, 1, "x", None), (2, 0, "user", "> I am fine thanks\nno"), (1, None, None, "> good"), (1, 4, "user", "> how are you today?\nI asked")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS depth", "2 AS said")
    got = sorted((r.conv_id or -1, -1 if r.turn is None else r.turn, r.parent_turn, r.depth, r.text) for r in quotes.reply_order(df).collect())
    assert got == [(-1, 1, None, 0, ""), (1, -1, None, 0, ""), (1, 0, None, 0, rows[0][3]), (1, 1, 0, 1, "I am fine thanks"), (1, 2, 1, 2, "good"), (1, 3, None, 0, "apart"), (1, 4, 0, 1, "I asked"), (1, 4, 0, 1, "I asked"), (2, 0, None, 0, "no")]
    assert quotes.reply_order(df.limit(0)).count() == 0
    ordered = quotes.reply_order(df)
    keys = [(r.conv_id is not None, r.conv_id, r.thread_turn is not None, r.thread_turn, r.turn) for r in ordered.collect()]
    assert keys == sorted(keys, key=lambda k: tuple(-1 if x is None else x for x in k))
    whole = {(r.conv_id, r.thread_turn): (r.messages, r.text) for r in quotes.conversations(ordered).collect()}
    assert whole[1, 0] == (5, "<|user|>\n" + rows[0][3] + "\n<|assistant|>\nI am fine thanks\n<|user|>\ngood\n<|user|>\nI asked\n<|user|>\nI asked\n")


def test_quotes_in_a_chain_of_long_and_periodic_texts(spark):
    long = "\n".join(f"line {i} of a very long message" for i in range(30_000))
    rows = [(1, 0, "user", long), (1, 1, "user", "> " + long.replace("\n", "\n> ") + "\nyes"), (1, 2, "user", "> yes\nno"), (1, 3, "user", ">" * 50_000 + " x"), (1, 4, "user", "> a\n" * 20_000)]
    got = {r.turn: (r.parent_turn, r.thread_turn, r.depth) for r in quotes.reply_order(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert got == {0: (None, 0, 0), 1: (0, 0, 1), 2: (1, 0, 2), 3: (None, 3, 0), 4: (None, 4, 0)}


def test_quoted_paragraphs_wrapped_anew(spark):
    import textwrap

    parts = [" ".join(f"{name}{i}" for i in range(40)) for name in ("first", "second", "third")]
    fill = lambda texts, width, mark: "\n\n".join(textwrap.fill(t, width) for t in texts).replace("\n", "\n" + mark)
    rows = [(1, 0, "user", "Hi,\n\nunrelated"), (1, 1, "user", "Hi,\n\n" + fill(parts, 72, "")), (1, 2, "user", "> " + fill(parts[:2], 64, "> ") + "\nI agree"), (1, 3, "user", "> Hi,\n>\n> " + fill(parts[1:], 64, "> ") + "\nI do not"), (1, 4, "user", "> Hi,\n>\n> what nobody said\nbut greets")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert {r.turn: r.parent_turn for r in quotes.reply_order(df).collect()} == {0: None, 1: None, 2: 1, 3: 1, 4: 0}


@pytest.mark.parametrize("k", range(5))
def test_stages(spark, rough, nothing, sf_dir, k):
    name, stage = corpus_pipeline.STAGES[k]
    for docs in (rough, common.cut(nothing, "none")):
        out = stage(spark, docs, sf_dir)
        assert k == 4 or out.columns == docs.columns
        assert (out.count() == 0) == docs.isEmpty()


def test_rows_are_judged_by_their_own_texts(spark, sf_dir):
    item = common.table(spark, sf_dir, "benchmark").first().text
    own = {k: " ".join(f"{k}{i}" for i in range(40)) for k in ("a", "b", "c")}
    held = " ".join(f"d{i}" for i in range(20)) + " " + item
    rows = [(1, own["a"]), (2, own["a"]), (2, own["b"]), (3, held), (3, own["c"]), (None, own["a"]), (None, held + " once more with many other words behind it, so that it is not a near copy " + own["c"][::-1])]
    docs = common.cut(spark.createDataFrame(rows, "doc_id long, text string"), "ids").withColumn("lang", F.lit("en")).withColumn("source", F.lit("s")).withColumn("n_chars", F.length("text").cast("long")).withColumn("row", F.lit(1))
    key = lambda rows: sorted((r[0] or -1, r[1]) for r in rows)
    first = corpus_pipeline.drop_near_copies(spark, docs, sf_dir)
    assert first.columns == docs.columns and key(first.collect()) == key([rows[0], *rows[2:5], rows[6]])
    second = corpus_pipeline.drop_benchmark(spark, common.cut(first, "first"), sf_dir)
    assert second.dtypes == docs.dtypes and key(second.collect()) == key([rows[0], rows[2], rows[4]])
