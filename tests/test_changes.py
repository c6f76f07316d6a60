"""Streams of file changes and indexes that follow them."""

import os

import pytest
from pyspark.sql import functions as F

from skeinwork.operators import lifecycle
from skeinwork.sources import changes
from skeinwork.streaming import stream as st


def put(root, name, text):
    (root / name).parent.mkdir(parents=True, exist_ok=True)
    (root / name).write_text(text)


def test_created_changed_deleted_over_restarts(spark, tmp_path):
    root = tmp_path / "tree"

    def told():
        watched = changes.watch(spark, str(root), str(tmp_path / "snapshots"), ["ts", "py"])
        watched.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "log")).trigger(availableNow=True).start(str(tmp_path / "out")).awaitTermination()
        rows = spark.read.schema(watched.schema).parquet(str(tmp_path / "out")).collect()
        return {(r.snapshot, r.kind, r.path) for r in rows}, rows

    for name in ("a.ts", "b/c.py", "b/d.ts", "node_modules/x.ts", ".git/y.ts", "e.txt", "_f.ts"):
        put(root, name, "x")
    first, rows = told()
    assert first == {(1, "created", p) for p in ("a.ts", "b/c.py", "b/d.ts")} and all(r.length == 1 and r.modified for r in rows)
    assert told()[0] == first
    put(root, "a.ts", "longer")
    os.remove(root / "b/c.py")
    put(root, "new.ts", "")
    assert told()[0] - first == {(2, "changed", "a.ts"), (2, "deleted", "b/c.py"), (2, "created", "new.ts")}
    os.utime(root / "new.ts", (1, 1))
    assert {x for x in told()[0] if x[0] == 3} == {(3, "changed", "new.ts")}
    # what was committed needs no snapshot any more; one that never got its number does no harm
    assert len([x for x in os.listdir(tmp_path / "snapshots") if x.isdigit()]) <= 2


def test_changes_are_debounced(spark, tmp_path):
    """Two bursts of changes, told once a later change shows that they are over."""
    for i, at in enumerate((1000.0, 1000.1, 1000.2, 1060.0, 2000.0)):
        put(tmp_path / "tree", f"{i}.ts", "x")
        os.utime(tmp_path / "tree" / f"{i}.ts", (at, at))
    watched = changes.watch(spark, str(tmp_path / "tree"), str(tmp_path / "snapshots")).withColumn("ts", F.col("modified"))
    bursts = st.debounced(watched, "kind")
    st.run_available(bursts, str(tmp_path / "bursts"))
    put(tmp_path / "tree", "late.ts", "x")
    assert sorted(r.n for r in st.run_available(bursts, str(tmp_path / "bursts")).collect())[:2] == [1, 3]


def events(spark, path, rows):
    spark.createDataFrame(rows, "kind string, id long").coalesce(1).write.mode("append").parquet(str(path))


@pytest.fixture
def latest():
    top = lambda rows, c: rows.groupBy("kind").agg(F.max(c).alias("last"))
    return lambda rows: top(rows, "id"), lambda old, fresh: fresh if old is None else top(old.unionByName(fresh), "last")


def test_rebuild_over_many_batches_a_failure_and_a_restart(spark, tmp_path, latest):
    rebuild, merge = latest
    events(spark, tmp_path / "in", [("t1", 1), ("t2", 5)])
    events(spark, tmp_path / "in", [("t2", 4)])
    events(spark, tmp_path / "in", [("t3", 7)])
    stream = lambda: spark.readStream.schema("kind string, id long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    index = f"file://{tmp_path}/index"
    look = lambda df: {tuple(r) for r in df.collect()}
    assert lifecycle.current(spark, index) is None
    assert look(lifecycle.rebuilt(stream(), index, rebuild, merge)) == {("t1", 1), ("t2", 5), ("t3", 7)}
    assert lifecycle.current_version(spark, index) == 2
    assert look(lifecycle.rebuilt(stream(), index, rebuild, merge)) == {("t1", 1), ("t2", 5), ("t3", 7)}
    events(spark, tmp_path / "in", [("t1", 9)])

    def fails(old, fresh):
        raise ValueError("no")

    with pytest.raises(Exception, match="no"):
        lifecycle.rebuilt(stream(), index, rebuild, fails)
    assert look(lifecycle.current(spark, index)) == {("t1", 1), ("t2", 5), ("t3", 7)}
    assert look(lifecycle.rebuilt(stream(), index, rebuild, merge)) == {("t1", 9), ("t2", 5), ("t3", 7)}
    assert sorted(x for x in os.listdir(tmp_path / "index") if x.startswith("version")) == ["version-2", "version-3"]


def test_index_follows_a_tree(spark, tmp_path):
    root, index = tmp_path / "tree", f"file://{tmp_path}/index"

    def follow():
        watched = changes.watch(spark, str(root), str(tmp_path / "snapshots"), ["ts", "py"])
        out = lifecycle.rebuilt(watched, index, *lifecycle.file_index(spark, str(root), ["ts", "py"]))
        return {r.path: r.exports for r in out.collect()}

    put(root, "a.ts", "class A {}")
    put(root, "b.py", "def b(): pass")
    put(root, "bad.py", "def (")
    assert follow() == {"a.ts": ["A"], "b.py": ["b"]}
    put(root, "a.ts", "class A2 {}")
    put(root, "b.py", "def b(:  # broken now")
    put(root, "c.ts", "enum C {}")
    assert follow() == {"a.ts": ["A2"], "b.py": ["b"], "c.ts": ["C"]}
    os.remove(root / "a.ts")
    assert follow() == {"b.py": ["b"], "c.ts": ["C"]}


def test_upsert(spark):
    make = lambda rows: spark.createDataFrame(rows, "k long, v string")
    merge = lifecycle.upsert("k")
    assert sorted(map(tuple, merge(make([(1, "a"), (2, "b")]), make([(2, "c"), (3, "d")])).collect())) == [(1, "a"), (2, "c"), (3, "d")]
    assert merge(None, make([(2, "c")])).count() == 1
