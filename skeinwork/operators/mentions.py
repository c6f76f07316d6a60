"""Names that texts contain, found by automata over shards of names.

Names are dealt into shards by a hash and texts into slices, both of bounded size, and each
shard meets each slice in one group: its automaton reads a text once, whatever the number of
names. Only what was found leaves the group.
"""

from __future__ import annotations

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Names of a shard and bytes of text of a slice; one longer text is a slice's share by itself.
SHARD_NAMES, SLICE_BYTES = 100_000, 4 << 20


def contained(texts: DataFrame, names: DataFrame, shard_names: int | None = None, slice_bytes: int | None = None) -> DataFrame:
    """(id, name), each once, where a text of (id, text) contains a name of (name); neither null nor empty ones take part."""
    names = names.select("name").filter("name <> ''").distinct()
    texts = texts.select("id", "text").filter("text <> ''").distinct()
    n, size = names.count(), texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards, slices = -(-n // (shard_names or SHARD_NAMES)) or 1, -(-size // (slice_bytes or SLICE_BYTES)) or 1
    every = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    left = names.withColumn("shard", F.pmod(F.xxhash64("name"), F.lit(shards)).cast("int")).withColumn("slice", every(slices))
    right = texts.withColumn("slice", F.pmod(F.xxhash64("id", "text"), F.lit(slices)).cast("int")).withColumn("shard", every(shards))

    def run(own: pa.Table, read: pa.Table) -> pa.Table:
        automaton = ahocorasick.Automaton()
        for name in own.column("name").to_pylist():
            automaton.add_word(name, name)
        hits = []
        if len(automaton) and read.num_rows:
            automaton.make_automaton()
            for at, text in zip(read.column("id").to_pylist(), read.column("text").to_pylist(), strict=True):
                hits += [(at, name) for name in {name for _, name in automaton.iter(text)}]
        return pa.table([pa.array([h[0] for h in hits], read.schema.field("id").type), pa.array([h[1] for h in hits], pa.string())], ["id", "name"])

    kind = texts.schema["id"].dataType.simpleString()
    return left.groupBy("shard", "slice").cogroup(right.groupBy("shard", "slice")).applyInArrow(run, f"id {kind}, name string").distinct()
