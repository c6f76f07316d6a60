"""Steps that must not grow faster than their input, and results that hang on no batch or partition."""

import random
import re

from pyspark.sql import functions as F

from oracle import same
from skeinwork import storage
from skeinwork.operators import agent, navigation, postings, retrieval
from skeinwork.plans import registry
from skeinwork.streaming import anchors
from skeinwork.streaming import stream as st


def rows_out(df):
    """The largest number of rows that any operator of a query's plan puts out, its result's included."""
    df.collect()

    def walk(node):
        found = node.metrics().get("numOutputRows")
        kids = node.children()
        inner = [node.executedPlan()] if node.getClass().getSimpleName() == "AdaptiveSparkPlanExec" else [node.plan()] if node.getClass().getSimpleName().endswith("QueryStageExec") else []
        inner += [kids.apply(i) for i in range(kids.size())]
        return max([found.get().value() if found.isDefined() else 0, *map(walk, inner)])

    return walk(df._jdf.queryExecution().executedPlan())


def test_definitions_of_a_shared_word_make_no_pairs(spark):
    n = 600
    files = spark.range(n).select(F.concat(F.lit("f"), "id").alias("path"), "id")
    cursors = files.select("path", F.lit(0).cast("long").alias("line"), F.lit(1).alias("character"))
    lines = files.select("path", F.lit(1).cast("long").alias("line_no"), F.lit("shared x").alias("text"))
    symbols = files.select(F.lit("shared").alias("symbol"), "path", F.col("id").alias("pos"))
    got = navigation.definition_counts(cursors, lines, symbols)
    assert {(r.n, r.first) for r in got.collect()} == {(n, "f0")} and rows_out(got) <= 2 * n


def test_queries_with_equal_tokens_read_few_blocks(spark, monkeypatch):
    n, written = 3000, []
    files = spark.range(n).select(F.concat(F.lit("d/w_"), "id").alias("path"), F.col("id").alias("pos"), F.concat(F.lit("w_"), "id").alias("stem"))
    symbols = files.select(F.when(F.col("pos") % 50 == 0, "rare").otherwise("often").alias("symbol"), "path", "pos")
    asked = spark.range(200).select(F.col("id").alias("query_id"), F.lit("rare often").alias("text"))

    def counted(df, name="cut"):
        out = storage.cut(df, name)
        written.append((name, out.count()))
        return out

    monkeypatch.setattr(postings, "cut", counted)
    got = postings.top_files_of_each(asked, files, symbols, 3, 10, 4).collect()
    assert {(r.query_id, r.place, r.path) for r in got} == {(q, i + 1, f"d/w_{i}") for q in range(200) for i in range(3)}
    # a row for each query is asked and answered; blocks are of the one set of tokens
    assert sum(rows for name, rows in written if name in ("frontier", "bounds")) < 400


def test_trees_of_blocks_give_the_same_files(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abc") for _ in range(rng.randrange(1, 5)))
    files = spark.createDataFrame([(f"d/f{i}", i, word() + "_" + word()) for i in range(300)], "path string, pos long, stem string")
    symbols = spark.createDataFrame([(word(), f"d/f{rng.randrange(300)}", i) for i in range(500)], "symbol string, path string, pos long")
    asked = spark.createDataFrame([(i, " ".join(word() for _ in range(4))) for i in range(30)], "query_id long, text string")
    deep, flat = (set(map(tuple, postings.top_files_of_each(asked, files, symbols, 4, *at).collect())) for at in ((3, 3), (1000, 64)))
    assert deep == flat


def test_reads_of_one_file_spread_over_tasks(spark, tmp_path):
    rng = random.Random(2)
    texts = ["\n".join(rng.choice("abc") for _ in range(rng.randrange(1, 5))) for _ in range(900)] + [None]
    rng.shuffle(order := list(range(len(texts))))
    at, out, places = str(tmp_path / "in"), str(tmp_path / "out"), []
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for stop in (300, 901):
            rows = [("f", i, texts[i]) for i in order if (i < 300) == (stop == 300)] + [(f"g{stop}", 1, "x"), (None, stop, "a")]
            spark.createDataFrame(rows, "path string, pos long, content string").repartition(3).write.mode("append").parquet(at)
            stream = spark.readStream.schema("path string, pos long, content string").parquet(at)
            got = anchors.reconciled_whole(stream, out)
        lines = st.anchor_states(spark.readStream.schema("path string, pos long, content string").parquet(at), str(tmp_path / "lines"))
        n = sorted((r.n_lines, r.n_changed) for r in lines.filter("path = 'f'").collect())
        near, _ = st.with_previous(spark.read.parquet(at).filter("path = 'f'"))
        places = near.filter("pos > 0 AND NOT seen").count()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    texts = [t or "" for t in texts]
    want = [(i, line, now, fate) for i in range(1, len(texts)) for line, _, now, fate in anchors.fates(anchors.hashes_of(texts[i - 1]), anchors.hashes_of(texts[i]))]
    assert sorted(((r.pos, r.line, r.now, r.fate) for r in got.filter("path = 'f'").collect()), key=repr) == sorted(want, key=repr)
    assert got.filter("path IS NULL").select("pos", "fate").collect() == [(901, "kept")] and got.filter("path LIKE 'g%'").isEmpty()
    changed = [st.changed_lines(texts[i - 1] if i else None, texts[i]).iloc[0] for i in range(len(texts))]
    assert n == sorted((r.n_lines, r.n_changed) for r in changed) and places == 0


def test_signs_that_belong_to_the_text_stay(spark, tmp_path):
    texts = ["+a\nb", "+a", "a\n+b\n+c", "x\n+\n", "[Showing lines 1-2 of 9 sel=L3\nx", "3 more lines\n\n+", "plain\nlines", "12th|a\nb"]
    rows = [(3 * i + k, t) for i, t in enumerate(texts) for k in range(3)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    same(spark, str(tmp_path), registry.QUERIES["f16_stripped"], registry.ORACLES["f16_stripped"])


def test_words_end_at_letters_beyond_ascii(spark, tmp_path):
    rows = [(i, i, "user", t) for i, t in enumerate(["é fix", "éfix", "fixé", "x.pyé", "naïve_case", "aéB", "testü 1", "none", "日class本"])]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    same(spark, str(tmp_path), registry.QUERIES["m14_about_code"], registry.ORACLES["m14_about_code"])
    assert spark.sql("SELECT 'é12ab' AS c").filter(agent.signs(F.col("c"), agent.ANCHOR_WORD)).count() == 1


def test_imports_and_god_files_are_dealt_before_they_are_grouped(spark):
    files = spark.range(50).select(F.concat(F.lit("d/f"), "id", F.lit(".ts")).alias("path"))
    imports = files.select(F.col("path").alias("src"), F.lit("x").alias("raw"), F.array(F.lit("no"), "path", F.lit("d/f1.ts")).alias("candidates"))
    gods = files.select(F.concat(F.lit("file:"), "path").alias("node_id"), F.lit("l").alias("label"))
    for df in (retrieval.resolve_imports(imports, files), navigation.god_files(gods, files)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "REPARTITION_BY_COL" in plan and df.count() == 50
    assert {(r.src, r.target) for r in retrieval.resolve_imports(imports, files).collect()} == {(f"d/f{i}.ts",) * 2 for i in range(50)}


def test_symbols_are_dealt_before_they_are_counted_by_file(spark, sf_dir):
    """Else a task of the scan counts all files of a row group, however many those are."""
    a10 = registry.QUERIES["a10_dir_coverage"]
    plan = a10(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"hashpartitioning\(path#\d+, \d+\), REPARTITION_BY_COL", plan)
    same(spark, sf_dir, a10, registry.ORACLES["a10_dir_coverage"])


def test_imports_are_resolved_in_tasks_of_bounded_rows(spark, sf_dir, monkeypatch):
    """Spark merges shuffled partitions by bytes; a task's sorts must not grow with what it merges."""
    monkeypatch.setattr(retrieval, "TASK_IMPORTS", 10)
    files = spark.range(50).select(F.concat(F.lit("d/f"), "id", F.lit(".ts")).alias("path"))
    imports = files.select(F.col("path").alias("src"), F.lit("x").alias("raw"), F.array(F.lit("no"), "path", F.lit("d/f1.ts")).alias("candidates"))
    got = retrieval.resolve_imports(imports, files)
    assert got.rdd.getNumPartitions() == 5 and {(r.src, r.target) for r in got.collect()} == {(f"d/f{i}.ts",) * 2 for i in range(50)}
    same(spark, sf_dir, registry.QUERIES["j01_import_resolution"], registry.ORACLES["j01_import_resolution"])
    monkeypatch.undo()
    assert [retrieval.tasks_for(n) for n in (0, 1_200_000, 7_200_000, 72_000_000)] == [1, 40, 200, 480]
