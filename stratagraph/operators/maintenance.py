"""Keeping projections, publications and sources current: what the store does between two snapshots.

Every operator is a lazy set of joins and aggregates; drivers hold single rows only (a marker, a count).
"""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stratagraph.operators.relational import QueryError

# ---------------------------------------------------------------- projections


def projection_delta(owners: DataFrame, projection: DataFrame, *, key: str = "owner_id", digest: str = "content_hash") -> DataFrame:
    """key, action (`close` or `insert`): open rows of a projection whose owner is gone or has other content are
    closed, owners without an equal open row get one; nothing else is touched.  The same for lexical documents,
    trigrams by document, vectors and entity documents."""
    open_ = projection.where("valid_to is null").select(key, F.col(digest).alias("_have"))
    both = owners.select(key, F.col(digest).alias("_want")).join(open_, key, "full_outer")
    same = F.col("_have").eqNullSafe(F.col("_want"))
    actions = F.array_compact(F.array(F.when(F.col("_have").isNotNull() & ~same, "close"), F.when(F.col("_want").isNotNull() & ~same, "insert")))
    return both.select(key, F.explode(actions).alias("action"))


def apply_delta(projection: DataFrame, owners: DataFrame, generation: int, *, key: str = "owner_id", digest: str = "content_hash") -> DataFrame:
    """The projection after its delta: closed rows end at the generation, inserted ones begin there."""
    delta = projection_delta(owners, projection, key=key, digest=digest)
    closing = delta.where("action = 'close'").select(key, F.lit(True).alias("_closing"))
    kept = projection.join(closing, key, "left").withColumn("valid_to", F.when(F.col("valid_to").isNull() & F.col("_closing"), F.lit(generation).cast("long")).otherwise(F.col("valid_to"))).drop("_closing")
    opened = owners.join(delta.where("action = 'insert'").select(key), key, "left_semi").select(key, digest).withColumn("valid_from", F.lit(generation).cast("long")).withColumn("valid_to", F.lit(None).cast("long"))
    return kept.select(key, digest, "valid_from", "valid_to").unionByName(opened)


def marker(expected_generation: int, generation_now: int, failed: int = 0) -> str:
    """What a maintenance run may publish: its marker only if the generation hasn't moved and nothing failed."""
    return "withheld" if failed else "stale" if generation_now != expected_generation else "published"


def next_generation(source: int, published: int, changed: int) -> int:
    """max + 1; a batch that changes nothing opens no generation."""
    return max(source, published) + 1 if changed else max(source, published)


# ---------------------------------------------------------------- change planning


def escalated(affected: DataFrame, artifacts: DataFrame, changed_paths: DataFrame, *, configuration: str = r"(^|/)(package\.json|tsconfig[^/]*\.json|registry\.json)$", unproven: bool = False, owner: str = "namespace") -> DataFrame:
    """artifact_id, scope: the affected artifacts (targeted); with a changed configuration file everything of its
    owner (plugin); with an unproven lookup everything (workspace).  The widest scope of an artifact counts."""
    if unproven:
        return artifacts.select("artifact_id", F.lit("workspace").alias("scope"))
    wide = changed_paths.where(F.col("path").rlike(configuration)).select(owner).distinct()
    rows = affected.select("artifact_id", F.lit(0).alias("_w")).union(artifacts.join(wide, owner, "left_semi").select("artifact_id", F.lit(1)))
    return rows.groupBy("artifact_id").agg(F.when(F.max("_w") == 1, "plugin").otherwise("targeted").alias("scope"))


def execution_levels(nodes: DataFrame, depends: DataFrame) -> DataFrame:
    """id, level: a unit runs one level after the last that it depends on (id, on); units of a level run side by
    side.  core:dependency_cycle if some never become ready.  A round a level, each with the units still waiting."""
    from stratagraph.operators.graph import _cut

    waiting, level, out = _cut(nodes.select("id").distinct()), 0, None
    needs = depends.select("id", "on").distinct().join(nodes.select(F.col("id").alias("on")).distinct(), "on", "left_semi")
    while True:
        needs = _cut(needs.join(waiting.withColumnRenamed("id", "on"), "on", "left_semi"))
        ready = _cut(waiting.join(needs.select("id").distinct(), "id", "left_anti"))
        if ready.isEmpty():
            break
        part = ready.withColumn("level", F.lit(level))
        out = part if out is None else out.union(part)
        waiting, level = _cut(waiting.join(ready, "id", "left_anti")), level + 1
    if not waiting.isEmpty():
        raise QueryError("core:dependency_cycle")
    return out if out is not None else nodes.select("id", F.lit(0).alias("level")).limit(0)


def identity_decision(base: DataFrame, target: DataFrame, barriers: DataFrame, *, key: str = "identity_key", owner: str = "owner") -> DataFrame:
    """key, decision: `continue` an identity that both sides have; `create` one that is new, whose owner changed, or
    that an absence barrier forces to begin anew; `close` one that is gone."""
    both = base.select(key, F.col(owner).alias("_a"), F.lit(1).alias("_b")).join(target.select(key, F.col(owner).alias("_c"), F.lit(1).alias("_t")), key, "full_outer").join(barriers.select(key, F.lit(1).alias("_x")).distinct(), key, "left")
    fresh = F.col("_b").isNull() | F.col("_x").isNotNull() | ~F.col("_a").eqNullSafe(F.col("_c"))
    return both.select(key, F.when(F.col("_t").isNull(), "close").when(fresh, "create").otherwise("continue").alias("decision"))


def validate_delta(records: DataFrame, relations: DataFrame, scopes: DataFrame, *, digest: str = "content_hash") -> DataFrame:
    """check, bad: rows of a delta that break a rule; a delta is valid if every count is 0.

    identity: a record without a key, or a key twice among the open ones; interval: an end that isn't after its
    begin; digest: none or one that isn't 64 hexadecimal digits; scope: an owner outside of the declared scopes;
    endpoints: a relation one of whose ends is no record; classification: neither confirmed nor possible."""
    open_ = records.where("valid_to is null")
    ends = relations.select(F.col("src").alias("record_id")).union(relations.select("dst"))
    checks = {
        "identity": records.where("identity_key is null").select(F.lit(1)).union(open_.groupBy("identity_key").count().where("count > 1").select(F.lit(1))),
        "interval": records.where("valid_to <= valid_from").select(F.lit(1)),
        "digest": records.where(~F.coalesce(F.col(digest).rlike("^[0-9a-f]{64}$"), F.lit(False))).select(F.lit(1)),
        "scope": records.join(scopes.select("owner").distinct(), "owner", "left_anti").select(F.lit(1)),
        "endpoints": ends.join(records.select("record_id"), "record_id", "left_anti").select(F.lit(1)),
        "classification": relations.where(~F.coalesce(F.col("classification").isin("confirmed", "possible"), F.lit(False))).select(F.lit(1)),
    }
    counted = [df.agg(F.count(F.lit(1)).alias("bad")).select(F.lit(name).alias("check"), "bad") for name, df in checks.items()]
    return reduce(DataFrame.union, counted)


def _whole(content: str = "content") -> Column:
    """Whether stored bytes have their hash and the stated length; without a hash or bytes they haven't."""
    return F.coalesce((F.sha2(content, 256) == F.col("content_hash")) & (F.octet_length(content) == F.col("byte_length")), F.lit(False))


def verify_blobs(blobs: DataFrame) -> DataFrame:
    """content_hash of stored blobs whose bytes don't have it, or not the stated length."""
    return blobs.where(~_whole()).select("content_hash")


def repair_blobs(blobs: DataFrame, spare: DataFrame) -> DataFrame:
    """The store with damaged blobs replaced from another copy where that one is whole.  Rows count, not hashes: a whole
    row stays beside a damaged one of its hash, and so does a whole spare."""
    return blobs.where(_whole()).unionByName(spare.where(_whole()).join(verify_blobs(blobs), "content_hash", "left_semi").select(blobs.columns))


def expired(executions: DataFrame, now: Column, minutes: int = 30) -> DataFrame:
    """Executions whose lifetime is over: their leases are released."""
    return executions.where(F.col("started") + F.expr(f"interval {int(minutes)} minutes") <= now)


# ---------------------------------------------------------------- publication


def publish(tables: dict[str, DataFrame], root: str, generation: int) -> str:
    """Writes tables under root/<generation>-<id>/ and then moves the pointer root/CURRENT to it by a rename: readers
    see the old publication or the new one whole.  core:publication_conflict if a later one is current."""
    spark = next(iter(tables.values())).sparkSession
    now = current(spark, root)
    if now is not None and now["generation"] >= generation:
        raise QueryError("core:publication_conflict", f"{now['generation']} is current")
    name = f"{generation:012d}-{uuid.uuid4().hex}"
    for table, df in tables.items():
        df.write.parquet(f"{root}/{name}/{table}")
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path
    fs = path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    draft = path(f"{root}/.{name}")
    out = fs.create(draft, True)
    out.write(bytearray(json.dumps({"generation": generation, "name": name, "tables": sorted(tables)}).encode()))
    out.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(path(root).toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    rename = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    rename[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(draft, path(f"{root}/CURRENT"), rename)
    return name


def current(spark: SparkSession, root: str) -> dict | None:
    """The pointer's content; None where nothing is published."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root}/CURRENT")
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return None
    return json.loads(spark.read.text(f"{root}/CURRENT", wholetext=True).first()[0])


def published(spark: SparkSession, root: str, table: str) -> DataFrame:
    now = current(spark, root)
    if now is None or table not in now["tables"]:
        raise QueryError("core:snapshot_expired", table)
    return spark.read.parquet(f"{root}/{now['name']}/{table}")


# ---------------------------------------------------------------- sources

#: Event classes, fixed values: those that ask for a complete reconciliation, and those that open a barrier.
COMPLETE = ("overflow", "provider_reset")
ADMINISTRATIVE = ("administrative", "git_head", "git_index", "worktree_administration", "provider_root_transition")


def reconcile(observed: DataFrame, known: DataFrame, *, key: str = "uri", digest: str = "content_hash", complete: bool, authority: bool = True) -> DataFrame:
    """key, change (presence, modify, absence) between a scan and what is known.  Absences count only for a complete
    scan of a provider with authority; others are left alone."""
    both = observed.select(key, F.col(digest).alias("_o")).join(known.select(key, F.col(digest).alias("_k")), key, "full_outer")
    change = F.when(F.col("_k").isNull(), "presence").when(F.col("_o").isNull(), "absence" if complete and authority else None).when(F.col("_o") != F.col("_k"), "modify")
    return both.select(key, change.alias("change")).where("change is not null")


def watch_deletes(hints: DataFrame, authorities: DataFrame, *, key: str = "uri") -> DataFrame:
    """Absence hints of providers that advertise authority for them, each observation once (the first)."""
    allowed = authorities.where("deletes").select("provider").distinct()
    return hints.where("event_type = 'absence'").join(allowed, "provider", "left_semi").groupBy("observation_id").agg(F.min(key).alias(key))


def reconciliation_mode(hints: DataFrame, *, scan_minutes: int = 10, last_scan: str | None = None) -> DataFrame:
    """binding, mode: `complete` for a binding with an overflow or reset among its hints, or whose last complete scan
    (column last_scan, if named) is older than the period; `barrier` for one with administrative events; else `hints`."""
    old = (F.max("ts") - F.max(last_scan) >= F.expr(f"interval {int(scan_minutes)} minutes")) if last_scan else F.lit(False)
    kind = F.when(F.bool_or(F.col("event_type").isin(*COMPLETE)) | old, "complete").when(F.bool_or(F.col("event_type").isin(*ADMINISTRATIVE)), "barrier").otherwise("hints")
    return hints.groupBy("binding").agg(kind.alias("mode"))


def source_barrier(attempts: DataFrame, most: int = 3) -> DataFrame:
    """binding, state: a barrier is passed by the first attempt during which the epoch didn't move (`current`, with
    its number); `degraded` after `most` that did; else still `open`.  attempts: binding, attempt, before, after."""
    calm = F.min(F.when(F.col("before") == F.col("after"), F.col("attempt")))
    one = attempts.where(F.col("attempt") <= most).groupBy("binding").agg(calm.alias("attempt"), F.count(F.lit(1)).alias("_n"))
    return one.select("binding", "attempt", F.when(F.col("attempt").isNotNull(), "current").when(F.col("_n") >= most, "degraded").otherwise("open").alias("state"))


def freshness(markers: DataFrame, wanted: DataFrame) -> DataFrame:
    """binding, fresh: whether each wanted watermark is represented by the binding's marker; one answer over several
    workspaces is the conjunction.  Callers poll this table for their wait (5 s, 60 at most)."""
    have = markers.groupBy("binding").agg(F.max("watermark").alias("_have"))
    return wanted.join(have, "binding", "left").select("binding", F.coalesce(F.col("_have") >= F.col("watermark"), F.lit(False)).alias("fresh"))


def covers_edges(references: DataFrame, contains: DataFrame, tests: DataFrame, artifact_of: DataFrame) -> DataFrame:
    """src, dst: what a test container (id) covers: targets, in other artifacts, of references from its members."""
    inside = contains.join(tests.select(F.col("id").alias("src")).distinct(), "src", "left_semi").select(F.col("src").alias("test"), F.col("dst").alias("member"))
    used = inside.join(references.select(F.col("src").alias("member"), F.col("dst").alias("target")), "member")
    of = lambda c, a: artifact_of.select(F.col("id").alias(c), F.col("artifact").alias(a))
    return used.join(of("member", "_m"), "member").join(of("target", "_t"), "target").where("_m <> _t").select(F.col("test").alias("src"), F.col("target").alias("dst")).distinct()


# ---------------------------------------------------------------- order


#: Comparison modes and how a column of each is compared: text by its UTF-8 bytes, digests and bytes as they are.
MODES = {"text_utf8": "string", "uce_bytes": "binary", "bytes": "binary", "digest": "string", "safe_int": "long", "big_int": "decimal(38,0)", "float64": "double", "decimal": "decimal(38,18)", "timestamp": "timestamp"}


def sort_keys(df: DataFrame, keys: list[dict], tie: str) -> list[Column]:
    """Columns to order by: of each key {column, mode, direction, absent}, then the tie's bytes.  absent: first, last,
    or forbidden (core:ordering_value_absent if a row lacks the value)."""
    out = []
    for k in keys:
        mode, direction, absent = k.get("mode", "text_utf8"), k.get("direction", "ascending"), k.get("absent", "last")
        if mode not in MODES or direction not in ("ascending", "descending") or absent not in ("first", "last", "forbidden"):
            raise QueryError("core:ordering_invalid", str(k))
        if absent == "forbidden" and not df.where(F.col(k["column"]).isNull()).isEmpty():
            raise QueryError("core:ordering_value_absent", k["column"])
        c = F.col(k["column"]).cast(MODES[mode])
        out.append({("ascending", True): c.asc_nulls_first, ("ascending", False): c.asc_nulls_last, ("descending", True): c.desc_nulls_first, ("descending", False): c.desc_nulls_last}[direction, absent == "first"]())
    return [*out, F.col(tie).cast("binary").asc()]


def overflow_probe(df: DataFrame, most: int) -> bool:
    """Whether there are more rows than `most`, from a limit of one more."""
    return df.limit(most + 1).count() > most


def shed(rows: DataFrame, budget: int, *, order: list[Column]) -> DataFrame:
    """A page's rows (text, snippet) within a budget of characters: all snippets are dropped if the page is over
    it with them, and then trailing rows that still don't fit.  For a page: rows share one running sum."""
    every = Window.partitionBy()
    upto = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    n = lambda c: F.coalesce(F.length(c), F.lit(0))
    over = F.sum(n("text") + n("snippet")).over(every) > budget
    sized = rows.withColumn("_over", over).withColumn("snippet", F.when(~F.col("_over"), F.col("snippet")))
    return sized.withColumn("_sum", F.sum(n("text") + n("snippet")).over(upto)).where(F.col("_sum") <= budget).drop("_over", "_sum")


def path_classification(paths: DataFrame) -> DataFrame:
    """path_id, classification of chains of relations (path_id, classification): the worst wins, possible, then
    unclassified, then confirmed."""
    rank = F.when(F.col("classification") == "possible", 0).when(F.col("classification").isNull(), 1).otherwise(2)
    worst = paths.groupBy("path_id").agg(F.min(rank).alias("_r"))
    return worst.select("path_id", F.when(F.col("_r") == 0, "possible").when(F.col("_r") == 1, "unclassified").otherwise("confirmed").alias("classification"))


def rational(numerator: Column, denominator: Column) -> Column:
    """An exact fraction in lowest terms with a denominator above 0: struct(n, d) of whole numbers; null for a zero denominator."""
    gcd = F.aggregate(F.sequence(F.lit(1), F.lit(64)), F.struct(F.abs(numerator).cast("long").alias("a"), F.abs(denominator).cast("long").alias("b")), lambda s, _: F.when(s["b"] == 0, s).otherwise(F.struct(s["b"].alias("a"), (s["a"] % F.nullif(s["b"], F.lit(0))).alias("b"))))["a"]
    sign = F.signum(denominator).cast("long")
    return F.when(denominator != 0, F.struct((sign * numerator / gcd).cast("long").alias("n"), (sign * denominator / gcd).cast("long").alias("d")))


def shard_vectors(vectors: DataFrame, shards: DataFrame, dimensions: int) -> DataFrame:
    """vec_id, embedding of rows (vec_id, shard, offset) that point into packed shards (shard, data) of little-endian
    32-bit floats; core data that is too short gives null."""
    cut = F.substring("data", F.col("offset") + 1, F.lit(4 * dimensions))
    joined = vectors.join(shards, "shard").select("vec_id", cut.alias("_b"))
    return joined.select("vec_id", F.when(F.octet_length("_b") == 4 * dimensions, floats(F.col("_b"), dimensions)).alias("embedding"))


def floats(data: Column, dimensions: int) -> Column:
    """Little-endian 32-bit floats of binary data, from their bits (no numbers below 2**-126, infinities or NaN)."""
    def one(i: Column) -> Column:
        byte = lambda k: F.conv(F.hex(F.substring(data, i * 4 + k + 1, F.lit(1))), 16, 10).cast("long")
        bits = byte(0) + byte(1) * 256 + byte(2) * 65536 + byte(3) * 16777216
        exponent, mantissa = F.shiftright(bits, 23).bitwiseAND(255), bits.bitwiseAND(0x7FFFFF)
        value = (1 + mantissa / F.lit(float(1 << 23))) * F.pow(F.lit(2.0), exponent - 127)
        return F.when(exponent == 0, 0.0).otherwise(F.when(bits >= 1 << 31, -value).otherwise(value)).cast("float")

    return F.transform(F.sequence(F.lit(0), F.lit(dimensions - 1)), one)
