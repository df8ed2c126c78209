"""Manifests and signed cursors: results are ordered once, pages are ordinal ranges of what was written."""

from __future__ import annotations

import base64
import hashlib
import hmac
import json
import time

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stratagraph.operators.relational import QueryError


def manifest(stream: DataFrame, order: list[Column], partition: list[str] = ()) -> DataFrame:
    """stream with `ordinal` (from 0).  With `partition`, each stream is numbered on its own.  Without, rows are
    range-sorted and numbered by partition offsets: no single task sees all rows."""
    if partition:
        return stream.withColumn("ordinal", F.row_number().over(Window.partitionBy(*partition).orderBy(*order)).cast("long") - 1)
    # a partition id and the place in it are fixed once the sorted rows are written or checkpointed
    placed = stream.orderBy(*order).withColumn("_id", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_id", 33)).withColumn("_row", F.col("_id").bitwiseAND((1 << 33) - 1))
    from stratagraph.operators.graph import _cut

    placed = _cut(placed)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    return placed.join(starts, "_part").withColumn("ordinal", F.col("_start") + F.col("_row")).drop("_id", "_part", "_row", "_start")


def write_manifest(stream: DataFrame, order: list[Column], path: str) -> None:
    """The manifest's sink: rows with their ordinals, in order, written once; pages read ranges of it."""
    manifest(stream, order).repartitionByRange("ordinal").sortWithinPartitions("ordinal").write.parquet(path)


def open_manifest(spark: SparkSession, path: str) -> DataFrame:
    """A written manifest: page() filters its ordinals at the scan, so a page touches a file or two."""
    return spark.read.parquet(path)


def page(rows: DataFrame, *, after: int | None = None, before: int | None = None, limit: int) -> DataFrame:
    """Forward: ordinals behind `after`.  Backward: the last `limit` ordinals ahead of `before`, in order."""
    if not 1 <= limit <= 100_000:
        raise QueryError("core:budget_invalid", str(limit))
    if before is not None:
        return rows.where(F.col("ordinal").between(max(0, before - limit), before - 1)).orderBy("ordinal")
    start = 0 if after is None else after + 1
    return rows.where(F.col("ordinal").between(start, start + limit - 1)).orderBy("ordinal")


def sign(claims: dict, secret: bytes) -> str:
    body = base64.urlsafe_b64encode(json.dumps(claims, sort_keys=True, separators=(",", ":")).encode()).rstrip(b"=")
    return (body + b"." + base64.urlsafe_b64encode(hmac.digest(secret, body, hashlib.sha256)).rstrip(b"=")).decode()


def check(token: str, secret: bytes, expected: dict, now: float | None = None) -> dict:
    """The claims of a cursor; each mismatch has its own code."""
    body, _, seal = token.encode().partition(b".")
    if not hmac.compare_digest(base64.urlsafe_b64encode(hmac.digest(secret, body, hashlib.sha256)).rstrip(b"="), seal):
        raise QueryError("core:cursor_invalid")
    claims = json.loads(base64.urlsafe_b64decode(body + b"=" * (-len(body) % 4)))
    if claims.get("expires", 0) <= (time.time() if now is None else now):
        raise QueryError("core:cursor_expired")
    for field in ("stream", "projection", "budget", "snapshot", "scope", "ordering"):
        if field in expected and claims.get(field) != expected[field]:
            raise QueryError(f"core:cursor_{field}_mismatch")
    return claims
