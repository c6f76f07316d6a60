"""What the operators of this package share: shared-folder tables and vectorised text hashing.

Words are hashed by a random 64-bit value for each byte at each place, so no two
words are alike by structure: two different ones among n are taken for equal with a
chance of about n * n / 2**65. The rolling polynomial modulo 2**64 further down is not
such a hash; it serves to choose places in texts and never decides that texts are equal.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import shared_root

#: Bytes of text that a task holds in numpy form at once; one longer text is taken alone.
SLAB_BYTES = 1 << 20
ROW_BATCH = 2000
#: Bytes and rows of an Arrow batch on its way to Python and back, at most.
BATCH_BYTES, BATCH_ROWS = 4 << 20, 2000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def delete_folder(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def small_batches(spark: SparkSession) -> None:
    """Lets Spark send texts to Python in batches that a task can hold several of."""
    for key, most in (("maxBytesPerBatch", BATCH_BYTES), ("maxRecordsPerBatch", BATCH_ROWS)):
        key = f"spark.sql.execution.arrow.{key}"
        now = spark.conf.get(key).rstrip("b")
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, str(most))


def release() -> None:
    """Gives memory that this Python process has freed back to the system, where the C library can."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def store(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Computes df once, into Parquet in the shared folder; lineage ends there."""
    spark = df.sparkSession
    small_batches(spark)
    path = new_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    return store(df, name)[0]


#: Bits of a row's place in its file, and file names that are sent to tasks; more are joined.
PLACE_BITS, SENT_FILES = 36, 100_000


def with_row_key(df: DataFrame, name: str) -> DataFrame:
    """df with a number for each row that no other row has and that stays the same however often and by whatever splits it
    is read: the number of its file, of all names in order, and the place in it. What does not come from files is stored
    with numbers first. The driver gets a row a file, as it does when it lists them."""
    try:
        files = sorted(r[0] for r in df.select(F.col("_metadata.file_path").alias("file")).distinct().collect())
    except AnalysisException:
        return cut(df.withColumn(name, F.monotonically_increasing_id()), "numbered")
    numbers = df.sparkSession.createDataFrame(list(zip(files, range(len(files)), strict=True)), "`file of row` string, `number of file` long")
    numbers = F.broadcast(numbers) if len(files) <= SENT_FILES else numbers
    placed = df.select("*", F.col("_metadata.file_path").alias("file of row"), F.col("_metadata.row_index").alias("place of row")).join(numbers, "file of row")
    key = F.shiftleft("number of file", PLACE_BITS).bitwiseOR(F.col("place of row"))
    return placed.select(*[F.col(f"`{c}`") for c in df.columns], key.alias(name))


def free_shuffles(spark: SparkSession) -> None:
    """Lets Spark's cleaner drop shuffle files of plans that nothing refers to any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def pieces(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLAB_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with at most `limit` bytes of `column`, one row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(sizes)
        at = 0
        while at < batch.num_rows:
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + limit, side="right")))
            to = min(to, at + ROW_BATCH)
            yield batch.slice(at, to - at)
            at = to
    release()


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string or binary column, and where each row starts (one entry more than rows); null is empty."""
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    n = len(column)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64, count=n + 1 + column.offset)[column.offset :]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], (off - off[0]).astype(np.int64)


_RNG = np.random.default_rng(20240229)
#: A random odd number for each byte value, and the base of the rolling polynomial.
BYTE_CODE = _RNG.integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = np.uint64(0x9E3779B97F4A7C15)
BASE_INVERSE = np.uint64(pow(int(BASE), -1, 2**64))
WORD_CODES = _RNG.integers(0, 2**63, 32, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32
#: Places in a span whose byte values have a code of their own in a table; further ones are computed.
TABLE_PLACES = 64
PLACE_CODE = _RNG.integers(0, 2**64, (2, TABLE_PLACES * 256), dtype=np.uint64)
_powers: dict[str, np.ndarray] = {}


def powers(n: int, inverse: bool = False) -> np.ndarray:
    """BASE (or its inverse modulo 2**64) to the power 0..n-1."""
    key = "inverse" if inverse else "base"
    have = _powers.get(key)
    if have is None or len(have) < n:
        out = np.full(max(n, SLAB_BYTES + 1), BASE_INVERSE if inverse else BASE, np.uint64)
        out[0] = 1
        np.multiply.accumulate(out, out=out)
        if n > 4 * SLAB_BYTES:
            return out
        _powers[key] = have = out
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def prefix_sums(codes: np.ndarray) -> np.ndarray:
    """Running polynomial sums, with a leading 0, of 64-bit symbol codes."""
    out = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(codes * powers(len(codes)), out=out[1:])
    return out


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return mix((sums[end] - sums[start]) * powers(len(sums), inverse=True)[start] + (end - start).astype(np.uint64))


def bytes_hash(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The hash of every span [start, end) of bytes; spans may be empty."""
    return bytes_hashes(raw, start, end, 1)[0]


def bytes_hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray, lanes: int = 2) -> list[np.ndarray]:
    """Independent hashes of every span, one a lane."""
    size = (end - start).astype(np.int64)
    ends = np.cumsum(size)
    total = int(ends[-1]) if len(ends) else 0
    if total > 2 * SLAB_BYTES and len(cuts := np.flatnonzero(np.diff(ends // SLAB_BYTES))):
        edges = [0, *(cuts + 1).tolist(), len(ends)]
        parts = [bytes_hashes(raw, start[i:j], end[i:j], lanes) for i, j in zip(edges[:-1], edges[1:], strict=True)]
        return [np.concatenate(x) for x in zip(*parts, strict=True)]
    place = np.arange(total, dtype=np.int64) - np.repeat(ends - size, size)
    cell = np.repeat(start.astype(np.int64), size)
    cell += place
    cell = raw[cell] + (place << 8)
    far = np.flatnonzero(place >= TABLE_PLACES)
    del place
    beyond = cell[far].astype(np.uint64)
    cell[far] = 0
    out = []
    for lane in range(lanes):
        code = PLACE_CODE[lane][cell]
        code[far] = mix((beyond + np.uint64(lane << 40)) * BASE)
        sums = np.zeros(total + 1, np.uint64)
        np.cumsum(code, out=sums[1:])
        out.append(mix((sums[ends] - sums[ends - size]) + size.astype(np.uint64) * BASE))
    return out


def words_of(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where words `[^\\x20\\x09-\\x0D]+` start and end, and the first word of each text (one entry more)."""
    word = np.zeros(len(raw) + 2, bool)
    np.logical_not(SPACE[raw], out=word[1:-1])
    edge = np.zeros(len(raw) + 1, bool)
    edge[off] = True
    inner, before, after = word[1:-1], word[:-2], word[2:]
    start = np.flatnonzero(inner & (~before | edge[:-1]))
    end = np.flatnonzero(inner & (~after | edge[1:])) + 1
    return start, end, np.searchsorted(start, off)


def word_hashes(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hash of every word with A-Z lower-cased, and the first word of each text (one entry more)."""
    start, end, first = words_of(raw, off)
    return bytes_hash(LOWER[raw], start, end), first


def shingle_hashes(words: np.ndarray, first: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Every shingle of `width` words; of a text with fewer words the whole sequence, of one without none."""
    n = len(words)
    counts = np.diff(first)
    made = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
    out_first = np.concatenate([[0], np.cumsum(made)])
    full = np.zeros(n, np.uint64)
    for k in range(width):
        full[: max(0, n - k)] += words[k:] * WORD_CODES[k]
    owner = np.repeat(np.arange(len(counts)), made)
    at = np.arange(out_first[-1]) - out_first[:-1][owner] + first[:-1][owner]
    out = full[at]
    for i in np.flatnonzero((counts > 0) & (counts < width)):
        w = words[first[i] : first[i + 1]]
        out[out_first[i]] = (np.append(w, np.uint64(len(w))) * np.append(WORD_CODES[: len(w)], WORD_CODES[31])).sum(dtype=np.uint64)
    return mix(out), out_first


def signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


#: Links that one task joins, 16 bytes each; more are joined in rounds over all tasks.
TASK_LINKS = 500_000


def join_links(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of links, and the smallest node reachable from each."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    i, j = ends[: len(a)], ends[len(a) :]
    label = np.arange(len(nodes))
    while len(i):
        x, y = label[i], label[j]
        apart = x != y
        i, j, x, y = i[apart], j[apart], x[apart], y[apart]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(up := label[label], label):
            label = up
    return nodes, nodes[label]


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable over edges (a, b); nodes without edges are left out.

    Up to TASK_LINKS links are joined in one task. Of more, each round hooks every node to its
    smallest neighbour, jumps pointers until every node points at a root, and contracts the
    edges to roots; the labels met so far are folded through the same map. Tables between
    rounds are written to the shared folder, and go when the next is there.
    """
    spark = edges.sparkSession
    folders: list[str] = []

    def keep(df: DataFrame, name: str) -> DataFrame:
        out, path = store(df, name)
        folders.append(path)
        return out

    def finish(labels: DataFrame) -> DataFrame:
        out = cut(labels, "labels")
        for path in folders:
            delete_folder(spark, path)
        return out

    live = keep(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    if live.count() <= TASK_LINKS:

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = [(x.column("a").to_numpy(), x.column("b").to_numpy()) for x in batches]
            if held:
                nodes, roots = join_links(*(np.concatenate(c) for c in zip(*held, strict=True)))
                yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(roots)], ["node", "component"])

        return finish(live.repartition(1).mapInArrow(run, "node long, component long"))
    labels = None
    while True:
        both = live.select(F.col("b").alias("node"), F.col("a").alias("up")).unionByName(live.select(F.col("a").alias("node"), F.col("b").alias("up")))
        parent = both.groupBy("node").agg(F.min("up").alias("up")).select("node", F.least("node", "up").alias("up"))
        parent = keep(parent, "parents")
        while True:
            hop = parent.select(F.col("node").alias("up"), F.col("up").alias("top"))
            jumped = keep(parent.join(hop, "up").select("node", F.col("top").alias("up"), (F.col("top") < F.col("up")).alias("moved")), "parents")
            parent = jumped.select("node", "up")
            if jumped.filter("moved").isEmpty():
                break
        if labels is None:
            labels = parent.select("node", F.col("up").alias("component"))
        else:
            labels = labels.join(parent.select(F.col("node").alias("component"), "up"), "component", "left").select("node", F.coalesce("up", "component").alias("component"))
        labels = keep(labels, "labels")
        a, b = parent.select(F.col("node").alias("a"), F.col("up").alias("ua")), parent.select(F.col("node").alias("b"), F.col("up").alias("ub"))
        live = live.join(a, "a").join(b, "b").filter("ua <> ub").select(F.least("ua", "ub").alias("a"), F.greatest("ua", "ub").alias("b")).distinct()
        live = keep(live, "edges")
        free_shuffles(spark)
        if live.isEmpty():
            return finish(labels)
