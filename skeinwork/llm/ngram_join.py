"""Exact self-join of documents on word shingles by Jaccard similarity, as link classes.

1. Every text becomes its set of distinct shingle hashes; equal sets are one set.
2. Families: sets that share the smallest hash of some of a few hash ranges name the most
   widely shared set among them their hub. A set is sent to its hub once; where the two
   are similar it joins the hub's family and leaves only its differences from the hub.
   Answers inside a family are derived from those: |x & y| is the hub's size less what
   x and y lack, plus what they lack and what they add in common. Members that link
   with the hub are one class without further work; the others are compared in blocks
   of similar size, a pair of blocks a task, and only links that join classes leave a task.
3. Index: sets order their shingles by corpus frequency (frequent ones, counted over
   all documents, last), then hash. Any two sets that link share one of their first
   n - ceil(t * n) + 1 shingles. A family enters a shingle's list once, with the
   range of its members' sizes and its least position. Lists are sorted by size and cut
   into blocks; from sizes and positions two blocks may be known to hold no link, and are
   skipped whole. Long lists are split into pairs of parts that different tasks compare.
4. Families found in one list are compared by their hubs. The overlap of the hubs and
   the members' differences bound what members can share; where the bound leaves that
   open, the smaller family's members become guests of the larger one's hub and are
   compared with its members as in 2.

Defined cases: null and empty texts have an empty set and link with nothing, texts
with fewer words than the shingle width are one shingle; rows without id get no
component and link nothing; repeated rows are documents of their own with the same
component; a text of any length is taken whole, by itself if it is longer than a slab;
other columns are not read, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

WIDTH = 5
NUMERATOR, DENOMINATOR = 4, 5
#: Ranges of hash values whose smallest member a set is known by.
RANGES = 8
#: Shingles that sort last. Which ones they are changes work, never results.
FREQUENT = 200_000
LIST_BLOCK = 2_000
#: Entries of a list that are skipped or compared together.
SKIP_BLOCK = 16
#: Index entries, 28 bytes each, of a bucket, and of a task that deals them out.
INDEX_ROWS, DEAL_ROWS = 200_000, 300_000
#: Ids of documents to look at again that are sent to tasks; more are joined.
SENT_IDS = 200_000
#: Sets that one copy of a hub is compared with.
HUB_SETS = 500
#: Shingles and members of a block of a family.
BLOCK_MASS, BLOCK_SETS = 400_000, 1_000


def sets_of(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of every text, concatenated, and where each starts."""
    raw, off = common.utf8(column)
    shingles, first = common.shingle_hashes(*common.word_hashes(raw, off), width)
    out = [np.unique(shingles[a:b]) for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
    return np.concatenate(out) if out else shingles, np.concatenate([[0], np.cumsum([len(x) for x in out])]).astype(np.int64)


def set_names(tokens: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit names of each set; 0 for the empty one."""
    n, out = np.diff(first), []
    for salt in (0xA5A5A5A55A5A5A5A, 0x3C6EF372FE94F82B):
        sums = np.zeros(len(tokens) + 1, np.uint64)
        np.cumsum(common.mix(tokens ^ np.uint64(salt)), out=sums[1:])
        out.append(np.where(n > 0, common.signed(common.mix((sums[first[1:]] - sums[first[:-1]]) + n.astype(np.uint64))), 0))
    return out[0], out[1]


def prefix_size(n, numerator: int, denominator: int):
    return n - (numerator * n + denominator - 1) // denominator + 1


def describe(docs: DataFrame, width: int) -> DataFrame:
    """Rows of documents (doc_id, n, sid, sid2, k) and, with n null, of in-slab counts (sid: shingle, times)."""
    edges = (np.arange(RANGES, dtype=np.uint64) << np.uint64(64 - int(math.log2(RANGES)))).astype(np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in common.pieces(batches, "text"):
            tokens, first = sets_of(part.column("text"), width)
            n = np.diff(first)
            sid, sid2 = set_names(tokens, first)
            keys = []
            for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
                own = tokens[a:b]
                at = np.searchsorted(own, edges)
                keys.append(common.signed(np.unique(own[at[at < len(own)]])))
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(x) for x in keys])]).astype(np.int32)), pa.array(np.concatenate(keys) if keys else np.zeros(0, np.int64)))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n), pa.array(sid), pa.array(sid2), lists, pa.nulls(len(n), pa.int64())], NAMES)
            seen, times = np.unique(tokens, return_counts=True)
            seen, times = seen[times > 1], times[times > 1]
            if m := len(seen):
                none = pa.nulls(m, pa.int64())
                yield pa.RecordBatch.from_arrays([none, none, pa.array(common.signed(seen)), none, pa.nulls(m, pa.list_(pa.int64())), pa.array(times.astype(np.int64))], NAMES)

    return docs.mapInArrow(run, "doc_id long, n long, sid long, sid2 long, k array<long>, times long")


NAMES = ["doc_id", "n", "sid", "sid2", "k", "times"]
COMPARED = "x long, hub long, n long, n_hub long, inter long, gone binary, new binary"


class Join:
    def __init__(self, docs: DataFrame, width: int, numerator: int, denominator: int):
        self.spark, self.docs = docs.sparkSession, docs
        self.width, self.num, self.den = width, numerator, denominator
        self.folders: list[str] = []

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        out, path = common.store(df, name)
        self.folders.append(path)
        return out

    def linked(self, inter: str, a: str, b: str) -> str:
        """|A & B| * den >= num * |A | B|."""
        return f"{self.num + self.den} * ({inter}) >= {self.num} * ({a} + {b})"

    def similar_sizes(self, a: str, b: str) -> str:
        return f"{self.den} * {a} >= {self.num} * {b} AND {self.den} * {b} >= {self.num} * {a}"

    def run(self) -> DataFrame:
        seen = self.keep(describe(self.docs, self.width), "described")
        rows = seen.filter("n IS NOT NULL")
        least = F.min(F.struct("doc_id", "n", "k")).alias("one")
        distinct = rows.filter("n > 0 AND doc_id IS NOT NULL").groupBy("sid", "sid2").agg(least)
        # a set's number is fixed by the stored table
        self.sets = self.keep(distinct.select(F.monotonically_increasing_id().alias("x"), "sid", "sid2", "one.*"), "sets")
        # FREQUENT bounds what is sent: 16 bytes each
        often = seen.filter("times IS NOT NULL").groupBy("sid").agg(F.sum("times").alias("times")).orderBy(F.desc("times"), "sid").limit(FREQUENT).select("sid").toArrow().column(0)
        often = np.concatenate([c.to_numpy() for c in often.chunks] or [np.zeros(0, np.int64)]).view(np.uint64)
        common.free_shuffles(self.spark)
        members, links = self.families()
        spans = self.keep(members.groupBy(F.col("hub").alias("family")).agg((F.count(F.lit(1)) + 1).alias("m"), F.min("n").alias("least"), F.max("n").alias("most"), F.max(F.col("n") - F.col("inter")).alias("new"), F.max(F.expr(f"NOT ({self.linked('inter', 'n', 'n_hub')})")).alias("open")), "families")
        pairs = self.candidates(members, often)
        if not pairs.isEmpty():
            links += self.across(pairs, members, spans)
        joined = common.components(self.union(links))
        label = self.sets.select("x", "sid", "sid2", "doc_id").join(joined.withColumnRenamed("node", "x"), "x", "left").select("sid", "sid2", "doc_id", F.coalesce("component", "x").alias("component"))
        label = self.keep(label, "labels")
        first = label.groupBy("component").agg(F.min("doc_id").alias("component_id"))
        by_set = label.join(first, "component").select("sid", "sid2", "component_id")
        out = rows.select("doc_id", "n", "sid", "sid2").join(by_set, ["sid", "sid2"], "left").select("doc_id", F.col("n").alias("n_shingles"), F.expr("CASE WHEN doc_id IS NULL THEN NULL ELSE coalesce(component_id, doc_id) END").alias("component_id"))
        return self.keep(out, "classes")

    @staticmethod
    def union(frames: list[DataFrame]) -> DataFrame:
        out = frames[0]
        for f in frames[1:]:
            out = out.unionByName(f)
        return out

    def families(self) -> tuple[DataFrame, list[DataFrame]]:
        """COMPARED rows of sets that are at least half like their hub, and the links (a, b) inside families."""
        base = self.sets.select("x", "n", F.explode("k").alias("key"))
        times = base.groupBy("key").agg(F.count(F.lit(1)).alias("times")).filter("times > 1")
        held = self.keep(base.join(times, "key"), "keys")
        weight = held.groupBy("x").agg(F.sum("times").alias("weight"))
        heavy = held.join(weight, "x")
        lead = heavy.groupBy("key").agg(F.max(F.struct("weight", "x", "n")).alias("lead"))
        votes = heavy.join(lead, "key").filter("x <> lead.x").filter(self.similar_sizes("n", "lead.n")).groupBy("x", F.col("lead.x").alias("hub"), F.col("lead.weight").alias("weight")).agg(F.count(F.lit(1)).alias("votes"))
        choice = self.keep(votes.groupBy("x").agg(F.max(F.struct("votes", "weight", "hub")).alias("to")).select("x", "to.hub", "to.votes"), "choices")
        # one shared smallest hash in eight is chance or a shared passage; small sets have few
        keys = self.sets.select("x", F.size("k").alias("keys"))
        chosen = choice.join(keys, "x").filter("4 * votes >= keys").select("x", "hub")
        hubs = chosen.select(F.col("hub").alias("x")).distinct()
        compared = self.compare(chosen.join(hubs, "x", "left_anti"), False)
        members = self.keep(compared.filter("3 * inter >= n + n_hub"), "members")
        like_hub = self.linked("inter", "n", "n_hub")
        links = [compared.filter(like_hub).select(F.col("x").alias("a"), F.col("hub").alias("b"))]
        kinds = members.withColumn("kind", F.when(F.expr(like_hub), 1).otherwise(0))
        links.append(self.blocks(kinds, [(0, 0), (0, 1)]))
        return members, links

    def compare(self, pairs: DataFrame, differences: bool) -> DataFrame:
        """COMPARED rows of pairs (x, hub) of sets, from whole texts; with their differences where the two are half alike, or always."""
        of = self.sets.select("x", "sid", "sid2", "doc_id")
        pairs = self.keep(pairs.select("x", "hub"), "pairs")
        hubs = pairs.groupBy("hub").agg(F.ceil(F.count(F.lit(1)) / HUB_SETS).cast("int").alias("chunks"))
        guests = pairs.join(hubs, "hub").join(of, "x").select("doc_id", "sid", "sid2", "x", "hub", F.pmod(F.xxhash64("x"), F.col("chunks")).cast("int").alias("chunk"))
        copies = hubs.join(of.withColumnRenamed("x", "hub"), "hub").select("doc_id", "sid", "sid2", F.lit(None).cast("long").alias("x"), "hub", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"))
        need = self.keep(guests.unionByName(copies), "needed")
        need = F.broadcast(need) if need.count() <= SENT_IDS else need
        # the hub's copy comes first, as nulls do
        sent = self.docs.join(need, "doc_id").select("hub", "chunk", "x", "sid", "sid2", "text").repartition("hub", "chunk").sortWithinPartitions("hub", "chunk", "x")
        width = self.width

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            at, hub = None, np.zeros(0, np.uint64)
            for part in common.pieces(batches, "text"):
                tokens, first = sets_of(part.column("text"), width)
                names = np.stack(set_names(tokens, first), 1).tolist()
                cols = [part.column(c).to_pylist() for c in ("hub", "chunk", "x", "sid", "sid2")]
                out: list[tuple] = []
                for i, (h, chunk, x, sid, sid2) in enumerate(zip(*cols, strict=True)):
                    if names[i] != [sid, sid2]:
                        continue  # another text with this id
                    own = tokens[first[i] : first[i + 1]]
                    if x is None:
                        at, hub = (h, chunk), own.copy()
                    elif at == (h, chunk):
                        place = np.minimum(np.searchsorted(hub, own), len(hub) - 1)
                        hit = hub[place] == own
                        inter = int(hit.sum())
                        gone = new = None
                        if differences or 3 * inter >= len(own) + len(hub):
                            lacks = np.ones(len(hub), bool)
                            lacks[place[hit]] = False
                            gone, new = np.flatnonzero(lacks).astype("<u4").tobytes(), own[~hit].tobytes()
                        out.append((x, h, len(own), len(hub), inter, gone, new))
                if out:
                    kinds = [pa.int64()] * 5 + [pa.binary()] * 2
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], [c.split()[0] for c in COMPARED.split(", ")])

        out = self.keep(sent.mapInArrow(run, COMPARED), "compared")
        common.free_shuffles(self.spark)
        return out

    def blocks(self, kinds: DataFrame, meet: list[tuple[int, int]]) -> DataFrame:
        """Links (a, b) between members of one hub whose kinds meet, as many as join what is linked; from COMPARED rows with a kind."""
        num, den = self.num, self.den
        step = math.log(den / num) * 1.0001 if num < den else 1.0
        room = F.greatest(F.lit(4), F.least(F.lit(BLOCK_SETS), (F.lit(float(BLOCK_MASS)) / F.pow(F.lit(math.exp(step)), F.col("size"))).cast("int")))
        sized = kinds.withColumn("size", F.floor(F.log("n") / F.lit(step)).cast("int"))
        parts = sized.groupBy("hub", "kind", "size").agg(F.count(F.lit(1)).alias("m")).select("hub", "kind", "size", F.ceil(F.col("m") / room).cast("int").alias("parts"))
        parts = self.keep(parts, "parts")
        unit = parts.select("hub", "kind", "size", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
        side = lambda s: unit.select("hub", F.struct("kind", "size", "part").alias(s))
        wanted = " OR ".join(f"(u.kind = {a} AND v.kind = {b}" + (" AND (u.size < v.size OR u.size = v.size AND u.part <= v.part))" if a == b else ")") for a, b in meet)
        tasks = side("u").join(side("v"), "hub").filter(f"({wanted}) AND abs(u.size - v.size) <= 1")
        tasks = self.keep(tasks.withColumn("task", F.monotonically_increasing_id()), "tasks")
        if tasks.isEmpty():
            return self.sets.limit(0).select(F.col("x").alias("a"), F.col("x").alias("b"))
        dealt = sized.join(parts, ["hub", "kind", "size"]).withColumn("unit", F.struct("kind", "size", F.pmod(F.xxhash64("x"), F.col("parts")).cast("int").alias("part"))).drop("kind", "size", "parts")
        first = dealt.join(tasks.select("hub", F.col("u").alias("unit"), "task"), ["hub", "unit"]).withColumn("side", F.lit(0))
        second = dealt.join(tasks.filter("u <> v").select("hub", F.col("v").alias("unit"), "task"), ["hub", "unit"]).withColumn("side", F.lit(1))
        both = first.unionByName(second).select("task", "side", "x", "n", "n_hub", "gone", "new")

        def derive(t: pa.Table) -> pa.Table:
            a, b = block_links(t, num, den)
            return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

        return self.keep(both.groupBy("task").applyInArrow(derive, "a long, b long"), "family-links")

    def candidates(self, members: DataFrame, often: np.ndarray) -> DataFrame:
        """(a, b, shared): pairs of families, by their hubs, that share a list and that nothing rules out."""
        info = self.sets.select("x", "sid", "sid2", "doc_id", "n").join(members.select("x", "hub"), "x", "left").select("sid", "sid2", "doc_id", "n", F.coalesce("hub", "x").alias("cluster"))
        entries = self.index(info, often)
        pairs = self.list_pairs(entries)
        common.free_shuffles(self.spark)
        return pairs

    def index(self, info: DataFrame, often: np.ndarray) -> DataFrame:
        """(token, cluster, least, most, place): entries of shingles that several families have."""
        width, num, den = self.width, self.num, self.den
        shared = self.spark.sparkContext.broadcast((np.sort(often), np.argsort(often, kind="stable")))

        def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names, places = shared.value
            for part in common.pieces(batches, "text"):
                t, first = sets_of(part.column("text"), width)
                sid, sid2 = set_names(t, first)
                rank = np.zeros(len(t), np.int64)
                if len(names):
                    at = np.minimum(np.searchsorted(names, t), len(names) - 1)
                    rank = np.where(names[at] == t, len(names) - places[at], 0)
                blobs = []
                for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
                    p, r = t[a:b], rank[a:b]
                    if r.any():
                        p = p[np.argsort(r, kind="stable")]
                    blobs.append(p[: prefix_size(b - a, num, den)].tobytes() if b > a else b"")
                keep = np.flatnonzero(np.diff(first) > 0)
                batch = pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(sid), pa.array(sid2), pa.array(blobs, pa.binary())], ["doc_id", "sid", "sid2", "prefix"])
                yield batch.take(pa.array(keep))

        total = info.agg(F.sum(F.floor(F.col("n") * (den - num) / den) + 1)).first()[0] or 0
        buckets = max(1, -(-int(total) // INDEX_ROWS))
        rows = self.docs.mapInArrow(prefixes, "doc_id long, sid long, sid2 long, prefix binary").join(info, ["sid", "sid2", "doc_id"]).select("prefix", "cluster", "n")

        def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """Entries by bucket of their shingle; a family's entries of one task are one."""
            held, size = [], 0

            def flush() -> Iterator[pa.RecordBatch]:
                e = merged(np.concatenate(held))
                part = (e["token"] >> np.uint64(33)).astype(np.int64) * buckets >> 31
                order = np.argsort(part, kind="stable")
                e, part = e[order], part[order]
                edges = np.flatnonzero(np.diff(np.concatenate([[-1], part, [buckets]])))
                cut = [(part[a], e[a:b].tobytes()) for a, b in zip(edges[:-1], edges[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([int(p) for p, _ in cut], pa.int64()), pa.array([b for _, b in cut], pa.binary())], ["bucket", "entries"])

            for batch in batches:
                raw, off = common.utf8(batch.column("prefix"))
                m = np.diff(off) // 8
                e = np.empty(int(m.sum()), ENTRY)
                e["token"] = np.frombuffer(raw.tobytes(), np.uint64)
                e["cluster"] = np.repeat(batch.column("cluster").to_numpy(), m)
                e["least"] = e["most"] = np.repeat(batch.column("n").to_numpy(), m)
                e["place"] = np.arange(len(e)) - np.repeat(np.cumsum(m) - m, m)
                held.append(e)
                size += len(e)
                if size > DEAL_ROWS:
                    yield from flush()
                    held, size = [], 0
            if size:
                yield from flush()
            held.clear()
            common.release()

        def shared_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """Entries of shingles that more than one family has. One bucket's blobs come together."""
            held: list[np.ndarray] = []
            for batch in batches:
                held += [np.frombuffer(x.as_buffer(), ENTRY) for x in batch.column("entries")]
                if len(held) > 1 and sum(map(len, held)) > 2 * INDEX_ROWS:
                    held = [merged(np.concatenate(held))]
            if not held:
                return
            e = merged(np.concatenate(held))
            held.clear()
            t = e["token"]
            same = np.concatenate([[False], t[1:] == t[:-1], [False]])
            e = e[same[:-1] | same[1:]]
            for at in range(0, len(e), 100_000):
                x = e[at : at + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array(common.signed(x["token"])), pa.array(np.ascontiguousarray(x["cluster"])), *(pa.array(x[c].astype(np.int64)) for c in ("least", "most", "place"))], ["token", "cluster", "least", "most", "place"])
            common.release()

        dealt = rows.mapInArrow(deal, "bucket long, entries binary").repartition(buckets, "bucket")
        return self.keep(dealt.mapInArrow(shared_tokens, "token long, cluster long, least long, most long, place long"), "entries")

    def list_pairs(self, entries: DataFrame) -> DataFrame:
        """(a, b): all pairs of families that share a list and that sizes and positions allow."""
        num, den = self.num, self.den
        lists = entries.groupBy("token").agg(F.ceil(F.count(F.lit(1)) / LIST_BLOCK).cast("int").alias("blocks"))
        long_lists = lists.filter("blocks > 1")
        # short lists, nearly all, go as they are
        split = entries.join(long_lists, "token").withColumn("own", F.pmod(F.xxhash64("cluster"), F.col("blocks")).cast("int"))
        split = split.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("token", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "cluster", "least", "most", "place")
        zero = F.lit(0)
        short = entries.join(long_lists, "token", "left_anti").select("token", zero.alias("i"), zero.alias("j"), zero.alias("own"), "cluster", "least", "most", "place")

        def skip_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            rest: pa.Table | None = None
            for batch in batches:
                t = pa.Table.from_batches([batch])
                if rest is not None:
                    t = pa.concat_tables([rest, t])
                token, i, j = (t.column(c).to_numpy() for c in ("token", "i", "j"))
                new = np.flatnonzero((token[1:] != token[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1
                done = int(new[-1]) if len(new) else 0
                rest = t.slice(done)
                if done:
                    yield pair_up(t.slice(0, done), num, den)
            if rest is not None and rest.num_rows:
                yield pair_up(rest, num, den)

        ordered = split.unionByName(short).repartition("token", "i", "j").sortWithinPartitions("token", "i", "j", "least", "most")
        return self.keep(ordered.mapInArrow(skip_lists, "a long, b long").distinct(), "candidates")

    def across(self, pairs: DataFrame, members: DataFrame, spans: DataFrame) -> list[DataFrame]:
        """Links (a, b) between sets of different families, of candidate pairs of families."""
        # the family in more pairs is the hub, so that fewer texts travel
        degree = pairs.select(F.explode(F.array("a", "b")).alias("x")).groupBy("x").agg(F.count(F.lit(1)).alias("degree"))
        both = pairs.join(degree.select(F.col("x").alias("a"), F.col("degree").alias("d_a")), "a").join(degree.select(F.col("x").alias("b"), F.col("degree").alias("d_b")), "b")
        over = self.compare(both.select(F.expr("if(d_a > d_b, b, a)").alias("x"), F.expr("if(d_a > d_b, a, b)").alias("hub")), False)
        like = self.linked("inter", "n", "n_hub")
        links = [over.filter(like).select(F.col("x").alias("a"), F.col("hub").alias("b"))]
        wide = over.select("x", "hub", "n", "n_hub", "inter")
        for c in ("x", "hub"):
            span = spans.select(F.col("family").alias(c), *[F.col(k).alias(f"{k}_{c}") for k in ("m", "least", "most", "new", "open")])
            own = "n" if c == "x" else "n_hub"
            wide = wide.join(span, c, "left").withColumns({f"m_{c}": F.coalesce(f"m_{c}", F.lit(1)), f"least_{c}": F.least(f"least_{c}", own), f"most_{c}": F.greatest(f"most_{c}", own), f"new_{c}": F.coalesce(f"new_{c}", F.lit(0)), f"open_{c}": F.coalesce(f"open_{c}", F.lit(False))})
        possible = f"{self.linked('inter + new_x + new_hub', 'least_x', 'least_hub')} AND {self.den} * most_x >= {self.num} * least_hub AND {self.den} * most_hub >= {self.num} * least_x"
        left = wide.filter("m_x > 1 OR m_hub > 1").filter(f"NOT ({like} AND NOT open_x AND NOT open_hub)").filter(possible)
        big = F.expr("struct(if(m_x > m_hub, x, hub) AS hub, if(m_x > m_hub, hub, x) AS guest, if(m_x > m_hub, new_x, new_hub) AS new, if(m_x > m_hub, least_x, least_hub) AS least, inter)")
        left = self.keep(left.select(big.alias("p")).select("p.*"), "left-open")
        if left.isEmpty():
            return links
        # members of the smaller family that the bound leaves open visit the larger one's hub
        family = members.select("x", F.col("hub").alias("guest"), "n", (F.col("n") - F.col("inter")).alias("own"))
        alone = self.sets.select("x", F.col("x").alias("guest"), "n", F.lit(0).cast("long").alias("own"))
        visits = left.join(family.unionByName(alone), "guest").filter(self.linked("inter + new + own", "least", "n"))
        visits = self.keep(visits.groupBy("x", "hub").agg(F.max("new").alias("most_new"), F.min("least").alias("least")), "visits")
        met = self.compare(visits, True)
        links.append(met.filter(like).select(F.col("x").alias("a"), F.col("hub").alias("b")))
        guests = met.join(visits, ["x", "hub"]).filter(self.linked("inter + most_new", "n", "least")).drop("most_new", "least").withColumn("kind", F.lit(0))
        hosts = members.join(guests.select("hub").distinct(), "hub", "left_semi").withColumn("kind", F.lit(1))
        links.append(self.blocks(guests.unionByName(hosts), [(0, 1)]))
        return links


#: An index entry: shingle, family, its members' least and most sizes, least position.
ENTRY = np.dtype([("token", "<u8"), ("cluster", "<i8"), ("least", "<u4"), ("most", "<u4"), ("place", "<u4")])


def merged(e: np.ndarray) -> np.ndarray:
    """Sorted by shingle and family; entries of one shingle and family are one."""
    e = e[np.lexsort((e["cluster"], e["token"]))]
    if len(e) < 2:
        return e
    new = np.concatenate([[True], (e["token"][1:] != e["token"][:-1]) | (e["cluster"][1:] != e["cluster"][:-1])])
    if new.all():
        return e
    at = np.flatnonzero(new)
    out = e[at]
    out["least"], out["most"], out["place"] = np.minimum.reduceat(e["least"], at), np.maximum.reduceat(e["most"], at), np.minimum.reduceat(e["place"], at)
    return out


def pair_up(t: pa.Table, num: int, den: int) -> pa.RecordBatch:
    """Candidate pairs of whole lists sorted by size.

    Lists are cut into blocks of SKIP_BLOCK entries. A block is compared with those 0, 1,
    2, ... further on; from where the sizes are too large the rest of its list is skipped,
    and blocks whose positions leave too few shingles for a link are skipped one by one.
    """
    token, i, j, own, cluster, least, most, place = (t.column(c).to_numpy().astype(np.int64) for c in ("token", "i", "j", "own", "cluster", "least", "most", "place"))
    n = len(token)
    room = 1 + most - place
    new = np.concatenate([[True], (token[1:] != token[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])]) if n else np.zeros(0, bool)
    starts = np.flatnonzero(new)
    which = np.cumsum(new) - 1
    within = np.arange(n) - starts[which] if n else which
    block = np.flatnonzero(within % SKIP_BLOCK == 0)
    size = np.diff(np.append(block, n))
    found: list[np.ndarray] = []
    if n:
        low, high, space, line = np.minimum.reduceat(least, block), np.maximum.reduceat(most, block), np.maximum.reduceat(room, block), which[block]
    alive, step = np.arange(len(block)), 0
    cell = np.arange(SKIP_BLOCK)
    while len(alive):
        a, b = alive, alive + step
        on = (line[a] == line[b]) & (den * high[a] >= num * low[b])
        a, b = a[on], b[on]
        open_ = (num + den) * np.minimum(space[a], space[b]) >= num * (low[a] + low[b])
        p, q = a[open_], b[open_]
        for at in range(0, len(p), 2048):
            p1, q1 = p[at : at + 2048], q[at : at + 2048]
            x = np.broadcast_to((block[p1][:, None] + cell)[:, :, None], (len(p1), SKIP_BLOCK, SKIP_BLOCK))
            y = np.broadcast_to((block[q1][:, None] + cell)[:, None, :], x.shape)
            ok = (cell < size[p1][:, None])[:, :, None] & (cell < size[q1][:, None])[:, None, :]
            x, y = x[ok], y[ok]
            # blocks (i, j) with i < j hold pairs across the two only
            meet = (x < y) & ((i[x] == j[x]) | (own[x] != own[y])) & (den * most[x] >= num * least[y]) & (den * most[y] >= num * least[x])
            meet &= (num + den) * np.minimum(room[x], room[y]) >= num * (least[x] + least[y])
            x, y = cluster[x[meet]], cluster[y[meet]]
            if len(x):
                found.append(np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)], 1), axis=0))
        step += 1
        alive = a[a + step < len(block)]
        if len(found) > 1 and sum(map(len, found)) > 1_000_000:
            found = [np.unique(np.concatenate(found), axis=0)]
    pairs = np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 2), np.int64)
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(pairs[:, 0])), pa.array(np.ascontiguousarray(pairs[:, 1]))], ["a", "b"])


def in_common(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """|x & y| for all x of a and y of b, lists of sets."""
    flat = np.concatenate([*a, *b])
    owner = np.repeat(np.arange(len(a) + len(b)), [len(x) for x in (*a, *b)])
    _, code = np.unique(flat, return_inverse=True)
    left = owner < len(a)
    width = int(code.max()) + 1 if len(code) else 0
    useful = (np.bincount(code[left], minlength=width) > 0) & (np.bincount(code[~left], minlength=width) > 0)
    number = np.cumsum(useful) - 1
    held = useful[code] if width else np.zeros(0, bool)
    code, owner, left = number[code[held]], owner[held], left[held]
    order = np.argsort(code, kind="stable")
    code, owner, left = code[order], owner[order], left[order]
    out = np.zeros((len(a), len(b)), np.float32)
    total = int(useful.sum())
    for low in range(0, total, 2048):
        s = slice(*np.searchsorted(code, [low, low + 2048]))
        c, o, w = code[s] - low, owner[s], left[s]
        x, y = np.zeros((len(a), min(2048, total - low)), np.float32), np.zeros((len(b), min(2048, total - low)), np.float32)
        x[o[w], c[w]] = 1
        y[o[~w] - len(a), c[~w]] = 1
        out += x @ y.T
    return out.astype(np.int64)


def block_links(t: pa.Table, num: int, den: int) -> tuple[list[int], list[int]]:
    """Links (a, b), a spanning forest of them, between the two sides of a pair of blocks of one hub, or within the only one."""
    side = t.column("side").to_numpy()
    ids, n, n_hub = (t.column(c).to_numpy() for c in ("x", "n", "n_hub"))
    gone = [np.frombuffer(x.as_buffer(), "<u4") for x in t.column("gone")]
    new = [np.frombuffer(x.as_buffer(), np.uint64) for x in t.column("new")]
    a = np.flatnonzero(side == 0)
    b = np.flatnonzero(side == 1)
    alone = not len(b)
    if alone:
        b = a
    if not len(a):
        return [], []
    pick = lambda lists, rows: [lists[k] for k in rows]
    inter = in_common(pick(gone, a), pick(gone, b)) + in_common(pick(new, a), pick(new, b))
    lost = np.fromiter(map(len, gone), np.int64, len(gone))
    inter += n_hub[a][:, None] - lost[a][:, None] - lost[b][None, :]
    linked = (num + den) * inter >= num * (n[a][:, None] + n[b][None, :])
    linked &= ids[a][:, None] != ids[b][None, :]
    # breadth first: every member reached gives one link
    out_a, out_b = [], []
    fresh_a, fresh_b = np.ones(len(a), bool), np.ones(len(b), bool)
    for root in np.flatnonzero(linked.any(1)):
        if not fresh_a[root]:
            continue
        fresh_a[root] = False
        if alone:
            fresh_b[root] = False
        todo = [(0, int(root))]
        while todo:
            which, k = todo.pop()
            if alone or which == 0:
                hit = np.flatnonzero(linked[k] & fresh_b)
                fresh_b[hit] = False
                out_a += [int(ids[a[k]])] * len(hit)
                out_b += ids[b[hit]].tolist()
                todo += [(0 if alone else 1, int(h)) for h in hit]
                if alone:
                    fresh_a[hit] = False
            else:
                hit = np.flatnonzero(linked[:, k] & fresh_a)
                fresh_a[hit] = False
                out_a += [int(ids[b[k]])] * len(hit)
                out_b += ids[a[hit]].tolist()
                todo += [(0, int(h)) for h in hit]
    return out_a, out_b


def jaccard_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, numerator: int = NUMERATOR, denominator: int = DENOMINATOR) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every document."""
    picked = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    join = Join(picked, width, numerator, denominator)
    out = join.run()
    for path in join.folders[:-1]:
        common.delete_folder(join.spark, path)
    common.free_shuffles(join.spark)
    return out


def op1_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_classes(common.table(spark, sf_dir, "documents"))
