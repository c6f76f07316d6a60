"""Changes of a source tree as a stream: a Python data source whose offsets are snapshots of the tree.

A snapshot lists every file with its time and length, dealt by a hash of its path into
shards, in a folder of its own; the offset is the snapshot's number, so a checkpoint stays
small and a restart goes on from the tree as it was last told. A task reads one shard of
two snapshots and tells what was created, changed or deleted between them. Snapshots go
once a later one is committed. The tree and the snapshots' folder are on a file system that the
driver and executors mount.
"""

from __future__ import annotations

import json
import os
import re
import uuid
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from .store import IGNORED

SHARDS = 16
SCHEMA = "path string, kind string, modified timestamp, length long, snapshot long"


def local(path: str) -> str:
    return re.sub(r"^file:/+", "/", path).rstrip("/")


def listed(root: str, extensions: frozenset[str], ignored: frozenset[str]) -> Iterator[tuple[str, int, int]]:
    """(path under root, time in nanoseconds, length) of files; ignored folders and what cannot be read are left out."""
    todo = [root]
    while todo:
        try:
            entries = list(os.scandir(todo.pop()))
        except OSError:
            continue
        for e in entries:
            try:
                if e.is_dir(follow_symlinks=False):
                    if e.name not in ignored:
                        todo.append(e.path)
                elif (e.name.rpartition(".")[2] in extensions or not extensions) and not e.name.startswith((".", "_")):
                    at = e.stat()
                    yield os.path.relpath(e.path, root), at.st_mtime_ns, at.st_size
            except OSError:
                continue


class Shard(InputPartition):
    def __init__(self, number: int, start: int, end: int):
        self.number, self.start, self.end = number, start, end


class TreeReader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        split = lambda k, default: frozenset(x for x in options.get(k, default).split(",") if x)
        self.root, self.state = local(options["path"]), local(options["snapshots"])
        self.extensions, self.ignored = split("extensions", ""), split("ignored", ",".join(IGNORED))

    def initialOffset(self) -> dict:
        return {"snapshot": 0}

    def latestOffset(self) -> dict:
        """The last snapshot's number where the tree is as it says, that of a new one otherwise."""
        shards: list[dict[str, tuple[int, int]]] = [{} for _ in range(SHARDS)]
        for path, modified, length in listed(self.root, self.extensions, self.ignored):
            shards[zlib.crc32(path.encode()) % SHARDS][path] = modified, length
        last = max((int(x) for x in os.listdir(self.state) if x.isdigit()), default=0) if os.path.isdir(self.state) else 0
        if all(self.load(last, k) == s for k, s in enumerate(shards)):
            return {"snapshot": last}
        # a snapshot counts once it is whole: it gets its number by a rename
        made = f"{self.state}/{uuid.uuid4().hex}.part"
        os.makedirs(made)
        for k, s in enumerate(shards):
            with open(f"{made}/{k}.json", "w") as f:
                json.dump(s, f)
        os.rename(made, f"{self.state}/{last + 1}")
        return {"snapshot": last + 1}

    def load(self, number: int, shard: int) -> dict[str, tuple[int, int]]:
        if not number:
            return {}
        with open(f"{self.state}/{number}/{shard}.json") as f:
            return {k: tuple(v) for k, v in json.load(f).items()}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [Shard(k, start["snapshot"], end["snapshot"]) for k in range(SHARDS)] if start != end else []

    def read(self, partition: Shard) -> Iterator[tuple]:
        from datetime import datetime, timezone

        old, new = self.load(partition.start, partition.number), self.load(partition.end, partition.number)
        for path in sorted(old.keys() | new.keys()):
            if old.get(path) != new.get(path):
                kind = "created" if path not in old else "deleted" if path not in new else "changed"
                modified, length = new.get(path) or old[path]
                yield path, kind, datetime.fromtimestamp(modified / 1e9, timezone.utc), length, partition.end

    def commit(self, end: dict) -> None:
        for name in os.listdir(self.state) if os.path.isdir(self.state) else ():
            if name.isdigit() and int(name) < end["snapshot"]:
                for k in range(SHARDS):
                    if os.path.exists(at := f"{self.state}/{name}/{k}.json"):
                        os.remove(at)
                os.rmdir(f"{self.state}/{name}")


class TreeChanges(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tree_changes"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> TreeReader:
        return TreeReader(dict(self.options))


def watch(spark: SparkSession, root: str, snapshots: str, extensions: list[str] = (), ignored: tuple[str, ...] = IGNORED) -> DataFrame:
    """A stream (path, kind, modified, length, snapshot) of files created, changed and deleted under root."""
    spark.dataSource.register(TreeChanges)
    return spark.readStream.format("tree_changes").option("path", root).option("snapshots", snapshots).option("extensions", ",".join(extensions)).option("ignored", ",".join(ignored)).load()
