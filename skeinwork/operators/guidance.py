"""Guidance files for a table of requests: which names a model or provider asks for, and which of them its folders hold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The file that every turn has anyway, and the one that stands in for it where a folder lacks it; the second is a parameter.
CORE = "AGENTS.md"


def names_of(names: list[str]) -> Column:
    return F.array(*map(F.lit, names)).cast("array<string>")


def candidate_names(model: Column, provider: Column, models: list[tuple[str, list[str]]], providers: dict[str, list[str]], defaults: dict[str, list[str]]) -> Column:
    """The names to look for: of the first pattern that fits the model (* is any text, case aside), else of the provider as
    configured, else as by default; null where nothing is named."""
    out = F.lit(None).cast("array<string>")
    for table in (defaults, providers):
        for name, names in table.items():
            out = F.when(provider == name, names_of(names)).otherwise(out)
    for pattern, names in reversed(models):
        fits = model.rlike(f"(?i)^{pattern.replace('*', '.*')}$") & (model != "")
        out = F.when(F.coalesce(fits, F.lit(False)), names_of(names)).otherwise(out)
    return out


def folders_of(cwd: Column, home: str) -> Column:
    """The home folder, then all folders from the root down to cwd, each once."""
    parts = F.filter(F.split(cwd, "/"), lambda p: p != "")
    down = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.concat(F.lit("/"), F.array_join(F.slice(parts, F.lit(1), n), "/")))
    return F.array_distinct(F.concat(F.array(F.lit(home)), down))


def guidance_files(requests: DataFrame, files: DataFrame, home: str, models: list[tuple[str, list[str]]], providers: dict[str, list[str]], defaults: dict[str, list[str]], stand_in: str | None = None) -> DataFrame:
    """(id, place, folder, name, content) of requests (id, cwd, provider, model) over files (folder, name, content): what each
    request's folders hold of its names, in the order of folders and names.

    A folder's core file, or its stand-in where it has no core file, is there already and left out, and so is a file with
    just the core file's content.
    """
    asked = requests.select("id", F.posexplode(folders_of(F.col("cwd"), home)).alias("at", "folder"), candidate_names(F.col("model"), F.col("provider"), models, providers, defaults).alias("names"))
    asked = asked.select("id", "at", "folder", F.posexplode("names").alias("nth", "name"))
    core = files.filter(F.col("name") == CORE).select("folder", F.col("content").alias("core"))
    here = files.join(core.withColumn("has", F.lit(True)), "folder", "left")
    told = F.when(F.col("has"), (F.col("name") == CORE) | F.col("content").eqNullSafe(F.col("core"))).otherwise(F.col("name").eqNullSafe(F.lit(stand_in)))
    found = asked.join(here.filter(~F.coalesce(told, F.lit(False))).select("folder", "name", "content"), ["folder", "name"])
    order = F.struct("at", "nth", "folder", "name", "content")
    each = found.groupBy("id").agg(F.array_sort(F.collect_list(order)).alias("l"))
    return each.select("id", F.posexplode("l").alias("i", "f")).select("id", (F.col("i") + 1).alias("place"), "f.folder", "f.name", "f.content")
