"""Snapshots over time: version merges, deltas, comparison, retention, forks, change planning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratagraph.operators.relational import visible


def versions(observations: DataFrame, key: str, order: list[Column], content: Column) -> DataFrame:
    """key, valid_from, valid_to, content: history from observations.  Equal successive contents are one
    version; a null content closes without opening."""
    w = Window.partitionBy(key).orderBy(*order)
    rows = observations.withColumn("_c", content).withColumn("_g", F.row_number().over(w).cast("long")).withColumn("_last", F.lag("_c").over(w))
    changed = rows.where((F.col("_g") == 1) | ~F.col("_c").eqNullSafe(F.col("_last")))
    return changed.select(key, F.col("_g").alias("valid_from"), F.lead("_g").over(Window.partitionBy(key).orderBy("_g")).alias("valid_to"), F.col("_c").alias("content")).where("content is not null")


def merge(current: DataFrame, batch: DataFrame, generation: int, *, complete: bool) -> DataFrame:
    """A new history: current(key, content, valid_from, valid_to) merged with batch(key, content) at a generation.

    Equal content is no change; changed content closes and opens; a new key opens.  Only a batch of complete
    coverage closes keys that it lacks."""
    opened, closed = current.where("valid_to is null"), current.where("valid_to is not null")
    both = opened.alias("c").join(batch.select("key", F.col("content").alias("new"), F.lit(True).alias("there")).alias("b"), "key", "full_outer")
    same = F.col("content").eqNullSafe(F.col("new")) & F.col("there").isNotNull()
    gone = F.col("there").isNull() & F.lit(complete)
    end = F.when(same | (F.col("there").isNull() & ~gone), F.lit(None)).otherwise(F.lit(generation)).cast("long")
    kept = both.where("valid_from is not null").select("key", "content", "valid_from", end.alias("valid_to"))
    fresh = both.where(F.col("there").isNotNull() & (F.col("valid_from").isNull() | ~same)).select("key", F.col("new").alias("content"), F.lit(generation).cast("long").alias("valid_from"), F.lit(None).cast("long").alias("valid_to"))
    return closed.select("key", "content", "valid_from", "valid_to").union(kept).union(fresh)


def diff(records: DataFrame, base: int, target: int, key: str = "record_id") -> DataFrame:
    """key, change (added or removed) between two generations: one scan, two interval tests."""
    a, b = visible(base), visible(target)
    return records.where(a != b).select(key, F.when(b, "added").otherwise("removed").alias("change"))


def compare(base: DataFrame, target: DataFrame, *, include_possible: bool = False) -> DataFrame:
    """change, base_path, target_path of two sets (path, content): changed: same path, other content; moved: same content
    at another path, unique on both sides unless include_possible; the rest added, removed or correlated."""
    b, t = base.select("path", F.col("content").alias("bc")), target.select("path", F.col("content").alias("tc"))
    paired = b.join(t, "path", "full_outer")
    same = paired.where("bc is not null and tc is not null").select(F.when(F.col("bc") == F.col("tc"), "correlated").otherwise("changed").alias("change"), F.col("path").alias("base_path"), F.col("path").alias("target_path"))
    lost, new = paired.where("tc is null").select("path", F.col("bc").alias("content")), paired.where("bc is null").select("path", F.col("tc").alias("content"))
    one = (lambda df: df) if include_possible else (lambda df: df.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("content"))).where("_n = 1").drop("_n"))
    moved = one(lost).select("content", F.col("path").alias("base_path")).join(one(new).select("content", F.col("path").alias("target_path")), "content").select(F.lit("moved").alias("change"), "base_path", "target_path")
    removed = lost.join(moved.select(F.col("base_path").alias("path")), "path", "left_anti").select(F.lit("removed").alias("change"), F.col("path").alias("base_path"), F.lit(None).cast("string").alias("target_path"))
    added = new.join(moved.select(F.col("target_path").alias("path")), "path", "left_anti").select(F.lit("added").alias("change"), F.lit(None).cast("string").alias("base_path"), F.col("path").alias("target_path"))
    return same.unionByName(moved).unionByName(removed).unionByName(added)


def delta_window(records: DataFrame, old: int, new: int) -> DataFrame:
    """Rows that opened or closed in (old, new]: what a warm copy must take in."""
    inside = lambda c: (F.col(c) > old) & (F.col(c) <= new)
    return records.where(inside("valid_from") | F.coalesce(inside("valid_to"), F.lit(False)))


def churn(records: DataFrame, old: int, new: int) -> DataFrame:
    opened, closed = ((F.col(c) > old) & (F.col(c) <= new) for c in ("valid_from", "valid_to"))
    return records.agg(F.count_if(closed).alias("removals"), F.count_if(opened).alias("additions"), F.count_if(visible(old)).alias("before"))


def version_chain(history: DataFrame, key: str, order: list[Column], record_id: str) -> DataFrame:
    return history.withColumn("previous_record_id", F.lag(record_id).over(Window.partitionBy(key).orderBy(*order)))


def retained(snapshots: DataFrame, *, keep: int = 32, now: Column, hours: int = 24) -> DataFrame:
    """Snapshots (workspace_id, generation, created_at, pinned) among the last `keep` of a workspace, younger than `hours`, or pinned."""
    n = F.row_number().over(Window.partitionBy("workspace_id").orderBy(F.desc("generation")))
    return snapshots.withColumn("_n", n).where((F.col("_n") <= keep) | F.col("pinned") | (F.col("created_at") > now - F.make_dt_interval(hours=F.lit(hours)))).drop("_n")


def unreachable(objects: DataFrame, roots: DataFrame, key: str) -> DataFrame:
    """Objects that no root names: to be swept after a second look."""
    return objects.join(roots.select(key).distinct(), key, "left_anti")


def fork(records: DataFrame, generation: int, workspace: str) -> DataFrame:
    """The visible rows under a new workspace, with ids remapped and intervals begun anew."""
    rows = records.where(visible(generation))
    return rows.withColumn("record_id", F.concat(F.lit(f"{workspace}/"), "record_id")).withColumn("parent_id", F.concat(F.lit(f"{workspace}/"), "parent_id")).withColumn("valid_from", F.lit(0).cast("long")).withColumn("valid_to", F.lit(None).cast("long"))


def set_digest(df: DataFrame, by: list[str], entry: Column) -> DataFrame:
    """by, digest: SHA-256 over a group's sorted entries.  Entries are digests of fixed size; for groups beyond a
    task's memory, digest by bucket first."""
    return df.groupBy(*by).agg(F.concat(F.lit("sha256:"), F.sha2(F.array_join(F.array_sort(F.collect_list(entry)), ""), 256)).alias("digest"))


STATUS = ("complete", "partial", "unknown", "unsupported", "stale")


def worst_status(df: DataFrame, by: list[str], status: str) -> DataFrame:
    """The worst of a group's states; a state not known here counts as unknown."""
    rank = F.lit(2)
    for i, s in enumerate(STATUS):
        rank = F.when(F.col(status) == s, i).otherwise(rank)
    names = F.array(*map(F.lit, STATUS))
    return df.groupBy(*by).agg(F.element_at(names, F.max(rank) + 1).alias("status"))
