"""Sources: file trees, and the binding of the benchmark tables to the engine's model.

Model tables: records(record_id, category, kind, universal_kind, name,
identity_key, parent_id, facets, valid_from, valid_to), edges(edge_id, src, dst,
kind, classification), artifacts(artifact_id, path, namespace, language,
artifact_kind, content_hash, byte_length, text).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def directory(spark: SparkSession, root: str) -> DataFrame:
    """Files under a folder: uri, path, byte_length, content_hash, is_binary, content."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    path = F.regexp_replace("path", r"^[a-z]+:/*", "/")
    content = F.col("content")
    binary = (F.position(F.lit(b"\x00"), content) > 0) | ~F.is_valid_utf8(content.cast("string"))
    return files.select(F.col("path").alias("uri"), path.alias("path"), F.col("length").alias("byte_length"), F.sha2(content, 256).alias("content_hash"), binary.alias("is_binary"), content)


MAX_BYTES = 10 << 20
EXCLUDED = [".git/**", "**/node_modules/**", "**/.git/**"]


def inclusion(path: Column, size: Column, binary: Column, rules: list[tuple[str, str]]) -> Column:
    """The decision for a file: mandatory exclusions, then size, then binary, then the last matching rule (glob, decision)."""
    from stratagraph.functions import matches_any

    decided = F.lit("included")
    for glob, decision in rules:
        decided = F.when(matches_any(path, [glob]), decision).otherwise(decided)
    return F.when(matches_any(path, EXCLUDED), "mandatory_exclusion").when(size > MAX_BYTES, "too_large").when(binary, "binary").otherwise(decided)


def ignored(path: Column, lines: list[str]) -> Column:
    """Whether ignore lines leave a path out: the last matching line decides, `!` takes back.  A pattern without an
    inner `/` matches at any depth, one that ends in `/` what lies below such a folder; blank lines and `#` are notes."""
    from stratagraph.functions import matches_any

    out = F.lit(False)
    for line in lines:
        line = line.strip()
        if not line or line.startswith("#"):
            continue
        keep, pattern = line.startswith("!"), line.removeprefix("!")
        folder, anchored = pattern.endswith("/"), "/" in pattern.rstrip("/")
        glob = ("" if anchored else "**/") + pattern.strip("/")
        globs = [glob + "/**"] if folder else [glob, glob + "/**"]
        out = F.when(matches_any(path, globs), F.lit(not keep)).otherwise(out)
    return out


class SourceChanged(ValueError):
    """core:source_changed: a batch whose bytes aren't those observed."""


def stable_read(observed: DataFrame, read: DataFrame) -> DataFrame:
    """The batch as read, if every observed file is there with the hash of its observation; else the whole batch is refused."""
    seen = observed.select("uri", F.col("content_hash").alias("_seen")).join(read.select("uri", "content_hash"), "uri", "left")
    bad = seen.where(~F.col("_seen").eqNullSafe(F.col("content_hash"))).select("uri").limit(1).collect()
    if bad:
        raise SourceChanged(bad[0]["uri"])
    return read.join(observed.select("uri"), "uri", "left_semi")


def blobs(files: DataFrame) -> DataFrame:
    """Content-addressed store: one row for each content."""
    return files.dropDuplicates(["content_hash", "byte_length"]).select("content_hash", "byte_length", "content")


def write_blobs(files: DataFrame, path: str) -> None:
    """Adds contents that the store at `path` doesn't hold yet."""
    spark, new = files.sparkSession, blobs(files)
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        new = new.join(spark.read.parquet(path).select("content_hash"), "content_hash", "left_anti")
    new.write.mode("append").parquet(path)


def read_blobs(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """content_hash, byte_length, content of the wanted hashes; a blob that doesn't have its hash is an error of the read."""
    held = spark.read.parquet(path).join(wanted.select("content_hash").distinct(), "content_hash", "left_semi")
    whole = (F.sha2("content", 256) == F.col("content_hash")) & (F.octet_length("content") == F.col("byte_length"))
    return held.withColumn("content", F.when(whole, F.col("content")).otherwise(F.raise_error(F.concat(F.lit("core:blob_corrupt "), "content_hash")).cast("binary")))


# ---------------------------------------------------------------- benchmark tables


def artifacts(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("doc_id") % 17 == 0, "generated").when(F.col("doc_id") % 23 == 0, "external").otherwise("source")
    return table(spark, d, "documents").select(
        F.concat(F.lit("doc:"), "doc_id").alias("artifact_id"), F.col("doc_id"), F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))).alias("path"),
        F.col("source").alias("namespace"), F.col("lang").alias("language"), kind.alias("artifact_kind"), F.sha2("text", 256).alias("content_hash"), F.octet_length("text").cast("long").alias("byte_length"), F.col("text"),
    )


def _months(c: str) -> Column:
    return F.year(c).cast("long") * 12 + F.month(c) - 1


def _entity(df: DataFrame, prefix: str, key: str, name: Column, universal: str, parent: Column, facets: list[Column], since: Column, until: Column) -> DataFrame:
    return df.select(
        F.concat(F.lit(f"{prefix}:"), key).alias("record_id"), F.lit("entity").alias("category"), F.lit(f"tpch:{prefix}").alias("kind"), F.lit(universal).alias("universal_kind"), name.alias("name"),
        F.concat_ws(":", F.lit("tpch"), F.lit(prefix), F.coalesce(parent, F.lit("root")), name).alias("identity_key"), parent.alias("parent_id"), F.array(*facets).alias("facets"), since.cast("long").alias("valid_from"), until.cast("long").alias("valid_to"),
    )


def records(spark: SparkSession, d: str) -> DataFrame:
    t = {n: table(spark, d, n) for n in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")}
    last = t["lineitem"].groupBy("l_orderkey").agg((F.max(_months("l_shipdate")) + 1).alias("until"))
    orders = t["orders"].join(last, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    none, zero = F.lit(None).cast("string"), F.lit(0)
    definition = F.lit("core:definition")
    made = [
        _entity(t["region"], "region", "r_regionkey", F.col("r_name"), "core:container", none, [definition, F.lit("core:exported")], zero, F.lit(None)),
        _entity(t["nation"], "nation", "n_nationkey", F.col("n_name"), "core:container", F.concat(F.lit("region:"), "n_regionkey"), [definition], zero, F.lit(None)),
        _entity(t["customer"], "customer", "c_custkey", F.col("c_name"), "core:value", F.concat(F.lit("nation:"), "c_nationkey"), [definition, F.concat(F.lit("segment:"), "c_mktsegment")], zero, F.lit(None)),
        _entity(t["supplier"], "supplier", "s_suppkey", F.col("s_name"), "core:callable", F.concat(F.lit("nation:"), "s_nationkey"), [definition, F.lit("core:test")], zero, F.lit(None)),
        _entity(t["part"], "part", "p_partkey", F.col("p_name"), "core:type", none, [definition, F.concat(F.lit("brand:"), "p_brand")], zero, F.lit(None)),
        _entity(orders, "order", "o_orderkey", F.col("o_orderkey").cast("string"), "core:callable", F.concat(F.lit("customer:"), "o_custkey"), [F.lit("core:execution"), F.concat(F.lit("status:"), "o_orderstatus")], _months("o_orderdate"), F.col("until")),
    ]
    return reduce(DataFrame.unionByName, made)


#: The same tables for DuckDB.
RECORDS_SQL = """
records AS (
 SELECT 'region:' || r_regionkey AS record_id, 'entity' AS category, 'tpch:region' AS kind, 'core:container' AS universal_kind, r_name AS name, 'tpch:region:root:' || r_name AS identity_key, CAST(NULL AS VARCHAR) AS parent_id, ['core:definition', 'core:exported'] AS facets, CAST(0 AS BIGINT) AS valid_from, CAST(NULL AS BIGINT) AS valid_to FROM region
 UNION ALL SELECT 'nation:' || n_nationkey, 'entity', 'tpch:nation', 'core:container', n_name, 'tpch:nation:region:' || n_regionkey || ':' || n_name, 'region:' || n_regionkey, ['core:definition'], 0, NULL FROM nation
 UNION ALL SELECT 'customer:' || c_custkey, 'entity', 'tpch:customer', 'core:value', c_name, 'tpch:customer:nation:' || c_nationkey || ':' || c_name, 'nation:' || c_nationkey, ['core:definition', 'segment:' || c_mktsegment], 0, NULL FROM customer
 UNION ALL SELECT 'supplier:' || s_suppkey, 'entity', 'tpch:supplier', 'core:callable', s_name, 'tpch:supplier:nation:' || s_nationkey || ':' || s_name, 'nation:' || s_nationkey, ['core:definition', 'core:test'], 0, NULL FROM supplier
 UNION ALL SELECT 'part:' || p_partkey, 'entity', 'tpch:part', 'core:type', p_name, 'tpch:part:root:' || p_name, NULL, ['core:definition', 'brand:' || p_brand], 0, NULL FROM part
 UNION ALL SELECT 'order:' || o_orderkey, 'entity', 'tpch:order', 'core:callable', CAST(o_orderkey AS VARCHAR), 'tpch:order:customer:' || o_custkey || ':' || o_orderkey, 'customer:' || o_custkey, ['core:execution', 'status:' || o_orderstatus], year(o_orderdate) * 12 + month(o_orderdate) - 1, until
  FROM orders LEFT JOIN (SELECT l_orderkey, max(year(l_shipdate) * 12 + month(l_shipdate) - 1) + 1 AS until FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey)"""


def edges(spark: SparkSession, d: str) -> DataFrame:
    t = {n: table(spark, d, n) for n in ("nation", "customer", "supplier", "orders", "lineitem")}

    def edge(df: DataFrame, kind: str, src: str, a: str, dst: str, b: str, sure: Column | None = None) -> DataFrame:
        return df.select(F.concat(F.lit(f"{src}:"), a).alias("src"), F.concat(F.lit(f"{dst}:"), b).alias("dst"), F.lit(kind).alias("kind"), (F.lit("confirmed") if sure is None else F.when(sure, "confirmed").otherwise("possible")).alias("classification"))

    sure = F.col("ok")
    def pairs(key: str, where: str = "true") -> DataFrame:  # noqa: E306
        return t["lineitem"].where(where).groupBy("l_orderkey", key).agg(F.bool_or(F.col("l_returnflag") != "R").alias("ok"))

    covers = t["lineitem"].where("l_linenumber = 1").groupBy("l_suppkey", "l_partkey").agg(F.bool_or(F.col("l_returnflag") != "R").alias("ok"))
    made = [
        edge(t["nation"], "core:contains", "region", "n_regionkey", "nation", "n_nationkey"), edge(t["customer"], "core:contains", "nation", "c_nationkey", "customer", "c_custkey"),
        edge(t["supplier"], "core:contains", "nation", "s_nationkey", "supplier", "s_suppkey"), edge(t["orders"], "core:defines", "customer", "o_custkey", "order", "o_orderkey"),
        edge(pairs("l_partkey"), "core:references", "order", "l_orderkey", "part", "l_partkey", sure), edge(pairs("l_suppkey"), "core:call", "order", "l_orderkey", "supplier", "l_suppkey", sure),
        edge(covers, "core:covers", "supplier", "l_suppkey", "part", "l_partkey", sure),
    ]
    return reduce(DataFrame.unionByName, made).select(F.concat_ws(">", "src", "kind", "dst").alias("edge_id"), "src", "dst", "kind", "classification")


EDGES_SQL = """
raw_edges AS (
 SELECT 'region:' || n_regionkey AS src, 'nation:' || n_nationkey AS dst, 'core:contains' AS kind, 'confirmed' AS classification FROM nation
 UNION ALL SELECT 'nation:' || c_nationkey, 'customer:' || c_custkey, 'core:contains', 'confirmed' FROM customer
 UNION ALL SELECT 'nation:' || s_nationkey, 'supplier:' || s_suppkey, 'core:contains', 'confirmed' FROM supplier
 UNION ALL SELECT 'customer:' || o_custkey, 'order:' || o_orderkey, 'core:defines', 'confirmed' FROM orders
 UNION ALL SELECT 'order:' || l_orderkey, 'part:' || l_partkey, 'core:references', CASE WHEN bool_or(l_returnflag <> 'R') THEN 'confirmed' ELSE 'possible' END FROM lineitem GROUP BY l_orderkey, l_partkey
 UNION ALL SELECT 'order:' || l_orderkey, 'supplier:' || l_suppkey, 'core:call', CASE WHEN bool_or(l_returnflag <> 'R') THEN 'confirmed' ELSE 'possible' END FROM lineitem GROUP BY l_orderkey, l_suppkey
 UNION ALL SELECT 'supplier:' || l_suppkey, 'part:' || l_partkey, 'core:covers', CASE WHEN bool_or(l_returnflag <> 'R') THEN 'confirmed' ELSE 'possible' END FROM lineitem WHERE l_linenumber = 1 GROUP BY l_suppkey, l_partkey),
edges AS (SELECT src || '>' || kind || '>' || dst AS edge_id, * FROM raw_edges)"""

ARTIFACTS_SQL = """
artifacts AS (SELECT 'doc:' || doc_id AS artifact_id, doc_id, source || '/' || lang || '/' || doc_id || '.txt' AS path, source AS namespace, lang AS language,
 CASE WHEN doc_id % 17 = 0 THEN 'generated' WHEN doc_id % 23 = 0 THEN 'external' ELSE 'source' END AS artifact_kind, sha256(text) AS content_hash, CAST(strlen(text) AS BIGINT) AS byte_length, text FROM documents)"""
