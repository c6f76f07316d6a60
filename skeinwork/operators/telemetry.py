"""Roll-ups of session records and injection logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def half_up(value: Column, digits: int = 0) -> Column:
    """floor(x * 10^d + 0.5) / 10^d, halves towards plus infinity."""
    k = 10**digits
    return F.floor(value * k + F.lit(0.5)) / k


def session_trend(sessions: DataFrame) -> DataFrame:
    """Means of triggers (1 digit), saved tokens (whole), share saved (2 digits), and the best session if it saved anything."""
    injected = F.coalesce("total_injection_tokens", F.lit(0))
    ratio = F.when(F.col("total_tokens_saved") + injected > 0, F.col("total_tokens_saved") / (F.col("total_tokens_saved") + injected)).otherwise(0.0)
    best = F.max_by("session_id", F.struct("total_tokens_saved", (-F.col("session_id")).alias("first")))
    out = sessions.agg(F.count(F.lit(1)).alias("sessions"), half_up(F.avg("dep_context_triggers"), 1).alias("avg_triggers"), half_up(F.avg("total_tokens_saved")).cast("long").alias("avg_saved"), half_up(F.avg(ratio), 2).alias("avg_ratio"), F.max("total_tokens_saved").alias("_top"), best.alias("_best"))
    return out.select("sessions", "avg_triggers", "avg_saved", "avg_ratio", F.when(F.col("_top") > 0, F.col("_best")).alias("best_session"))


def breakdown(parts: DataFrame) -> DataFrame:
    """Share of each (source, tokens) in rounded per cent; empty slices go unless all are empty."""
    total = parts.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("total"))
    out = parts.join(F.broadcast(total)).filter("tokens > 0 OR total = 0")
    return out.select("source", "tokens", F.when(F.col("total") > 0, half_up(100 * F.col("tokens") / F.col("total")).cast("long")).otherwise(F.lit(0).cast("long")).alias("percent"))


def cost(files: DataFrame) -> DataFrame:
    """Of (skeleton, full) tokens: sums and 1 - skeleton / full; a missing full is eight skeletons."""
    full = F.coalesce(F.col("full"), F.col("skeleton") * 8)
    out = files.agg(F.sum("skeleton").alias("skeleton_tokens"), F.sum(full).alias("full_tokens"))
    return out.select("skeleton_tokens", "full_tokens", F.when(F.col("full_tokens") > 0, 1 - F.col("skeleton_tokens") / F.col("full_tokens")).otherwise(0.0).alias("ratio"))


def running_savings(log: DataFrame) -> DataFrame:
    """(session_id, pos, ratio) after each injection of (session_id, pos, tokens, full): saved counts where full is more."""
    w = Window.partitionBy("session_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    used, saved = F.sum("tokens").over(w), F.sum(F.greatest(F.col("full") - F.col("tokens"), F.lit(0))).over(w)
    return log.select("session_id", "pos", F.when(used + saved > 0, 1 - used / (used + saved)).otherwise(0.0).alias("ratio"))


def top_files(mentions: DataFrame, n: int) -> DataFrame:
    """(path, n): mentions of (session_id, pos, path); a repeated one counts only for absolute paths."""
    first = F.row_number().over(Window.partitionBy("session_id", "path").orderBy("pos")) == 1
    counted = mentions.withColumn("_c", first | F.col("path").startswith("/")).filter("_c")
    return counted.groupBy("path").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("session_id", "pos")).alias("_at")).orderBy(F.desc("n"), "_at").limit(n).drop("_at")


def region_hull(regions: DataFrame) -> DataFrame:
    """Per path the hull of (start, end) line regions, start at least 1 and end at least start."""
    start = F.greatest(F.col("start"), F.lit(1))
    return regions.select("path", start.alias("s"), F.greatest(F.coalesce("end", "start"), start).alias("e")).groupBy("path").agg(F.min("s").alias("start"), F.max("e").alias("end"))


def session_records(log: DataFrame) -> DataFrame:
    """From (session_id, pos, kind, name, value): the last value of 'set' entries, sums of 'add' entries; zeros are null."""
    per = log.groupBy("session_id", "name").agg(F.max_by("value", F.when(F.col("kind") == "set", F.col("pos"))).alias("last"), F.sum(F.when(F.col("kind") == "add", F.col("value"))).alias("total"))
    return per.select("session_id", "name", F.nullif(F.coalesce("last", "total"), F.lit(0)).alias("value"))


def staleness(meta: DataFrame, now: Column, hours: int = 24) -> DataFrame:
    """Of (index_id, built_at, commit, head, changed): stale when old, moved on or changed; critical past twice the age."""
    age = (F.unix_timestamp(now) - F.unix_timestamp("built_at")) / 3600
    return meta.select("index_id", ((age > hours) | (F.col("commit") != F.col("head")) | (F.col("changed") > 0)).alias("stale"), (age > 2 * hours).alias("critical"))
