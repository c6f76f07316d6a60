"""Names in texts and ranked retrieval against loops over everything."""

import random

import pytest

from skeinwork.operators import mentions, postings


@pytest.mark.parametrize(("shard", "size"), [(100_000, 1 << 20), (7, 300)])
def test_contained_names(spark, shard, size):
    rng = random.Random(4)
    word = lambda n: "".join(rng.choice("abé ") for _ in range(rng.randrange(n)))
    names = [word(5) for _ in range(60)] + ["aa", "aaa", None, "日本"]
    texts = [(rng.randrange(20), word(40)) for _ in range(60)] + [(1, None), (2, ""), (None, "aaa"), (3, "x日本"), (3, "x日本")]
    got = mentions.contained(spark.createDataFrame(texts, "id long, text string"), spark.createDataFrame([(n,) for n in names], "name string"), shard, size)
    want = {(i, n) for i, t in texts if t for n in names if n and n in t}
    rows = got.collect()
    assert {tuple(r) for r in rows} == want and len(rows) == len(want)


def test_no_names_and_no_texts(spark):
    none = spark.createDataFrame([], "id long, text string, name string")
    some = spark.createDataFrame([(1, "a", "a")], "id long, text string, name string")
    assert mentions.contained(none, some).count() == mentions.contained(some, none).count() == 0


def best_files(words, files, symbols, k):
    """[(path, score, signals)] by the definition, over all files; symbols in index order."""
    rows = []
    for path, pos, stem in files:
        own = [s for s, p, _ in symbols if p == path]
        exact = {w for w in words if w in own}
        first = lambda ok: next((s for s in own if ok(s)), None)
        partial = first(lambda s: any(len(w) > 2 and w in s.lower() for w in words))
        named = min((w for w in words if w in stem.lower()), default=None)
        score = 3 * len(exact) + (2 if not exact and partial else 0) + (2 if named else 0)
        if score:
            told = [f"filename:{named}"] if named else []
            told += [f"symbol:{first(lambda s: s in exact)}"] if exact else [f"partial-symbol:{partial}"] if partial else []
            rows.append((-score, not exact, pos, path, ",".join(sorted(told))))
    return [(path, -score, told) for score, _, _, path, told in sorted(rows)[:k]]


@pytest.mark.parametrize(("k", "block"), [(3, 4), (50, 8)])
def test_many_queries_at_once(spark, k, block):
    rng = random.Random(k)
    word = lambda: "".join(rng.choice("abc") for _ in range(rng.randrange(1, 6)))
    files = [(f"d/f{i}", i, word() + rng.choice(["", "_X", "Y"]) + word()) for i in range(90)]
    symbols = [(rng.choice([word(), word().upper(), "abc"]), f"d/f{rng.randrange(90)}", i) for i in range(250)]
    asked = {i: {word() for _ in range(rng.randrange(6))} for i in range(40)}
    make = spark.createDataFrame
    got = postings.top_files_of_each(make([(i, " ".join(sorted(w))) for i, w in asked.items()], "query_id long, text string"), make(files, "path string, pos long, stem string"), make(symbols, "symbol string, path string, pos long"), k, block).collect()
    found = {}
    for r in sorted(got, key=lambda r: (r.query_id, r.place)):
        found.setdefault(r.query_id, []).append((r.path, r.score, r.signals))
    want = {i: best_files({x for x in w if len(x) > 1}, files, symbols, k) for i, w in asked.items()}
    assert found == {i: rows for i, rows in want.items() if rows}
