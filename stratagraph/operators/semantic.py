"""Vector and hybrid retrieval: exact scans, rank fusion, the hashing embedding."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructField, StructType

from stratagraph.operators.relational import QueryError


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def vector_topk(vectors: DataFrame, query: list[float], k: int, *, metric: str = "cosine", id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """id, distance of the exact k nearest, ties by id.  Zero vectors have no cosine and are left out, as are
    vectors of another dimension or with non-finite components."""
    if metric not in ("cosine", "squared_l2") or not query or not all(map(math.isfinite, query)):
        raise QueryError("core:invalid_vector")
    v, q = F.col(vector_col).cast("array<double>"), F.array(*[F.lit(float(x)) for x in query])
    rows = vectors.where((F.size(v) == len(query)) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))).withColumn("_v", v)
    if metric == "cosine":
        norm = math.sqrt(sum(x * x for x in query))
        if not norm:
            raise QueryError("core:invalid_vector", "zero")
        rows = rows.where(_dot(F.col("_v"), F.col("_v")) > 0)
        distance = 1 - _dot(F.col("_v"), q) / (F.sqrt(_dot(F.col("_v"), F.col("_v"))) * norm)
    else:
        distance = F.aggregate(F.zip_with("_v", q, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)
    return rows.select(id_col, F.round(distance, 6).alias("distance")).orderBy("distance", id_col).limit(k)


def filtered_vectors(vectors: DataFrame, owners: DataFrame, owner_col: str = "owner_id") -> DataFrame:
    """Vectors whose owner is among the eligible ones (id): hard filters come before any distance."""
    return vectors.join(owners.select(F.col("id").alias(owner_col)).distinct(), owner_col, "left_semi")


def fuse(lanes: dict[str, tuple[DataFrame, float]]) -> DataFrame:
    """id, score, lanes: lanes hold (id, rank); score is the sum of weight / rank, without a constant;
    order by score, then id.  A rank below 1 or an id twice in a lane is an error, so check_lane() first."""
    rows = reduce(DataFrame.unionByName, [df.select("id", (F.lit(float(w)) / F.col("rank")).alias("_s"), F.lit(n).alias("_lane")) for n, (df, w) in lanes.items()])
    return rows.groupBy("id").agg(F.round(F.sum("_s"), 6).alias("score"), F.array_join(F.array_sort(F.collect_set("_lane")), ",").alias("lanes"))


def check_lane(lane: DataFrame) -> DataFrame:
    bad = lane.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.min("rank").alias("least")).where("n > 1 or least < 1")
    if not bad.isEmpty():
        raise QueryError("core:invalid_lane")
    return lane


def ranked(df: DataFrame, order: list[Column], cap: int = 100) -> DataFrame:
    """id, rank of the first `cap` rows: the limit comes first, so only a lane's head is numbered."""
    head = df.orderBy(*order).limit(cap)
    return head.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def mean_pool(windows: DataFrame, key: str, vector: str) -> DataFrame:
    """key, pooled: the element-wise mean of a key's vectors."""
    each = windows.select(key, F.posexplode(F.col(vector).cast("array<double>")).alias("_i", "_x")).groupBy(key, "_i").agg(F.avg("_x").alias("_m"))
    return each.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", "_m"))), lambda s: s["_m"]).alias("pooled"))


def coverage(expected: DataFrame, embedded: DataFrame, excluded: DataFrame) -> DataFrame:
    """One row: expected, embedded, excluded, pending, status; each input has the column id."""
    marks = expected.select("id").join(embedded.select("id", F.lit(1).alias("e")), "id", "left").join(excluded.select("id", F.lit(1).alias("x")), "id", "left")
    n = marks.agg(F.count(F.lit(1)).alias("expected"), F.count("e").alias("embedded"), F.count_if(F.col("e").isNull() & F.col("x").isNotNull()).alias("excluded"))
    n = n.withColumn("pending", F.col("expected") - F.col("embedded") - F.col("excluded"))
    return n.withColumn("status", F.when(F.col("embedded") == 0, "unavailable").when(F.col("pending") > 0, "updating").when(F.col("excluded") > 0, "degraded").otherwise("complete"))


def canonical_vector(vector: Column, dimensions: int, normalize: bool = False) -> Column:
    """The vector as doubles, -0 as 0, at length 1 if asked for; null for another dimension, a null or non-finite
    component, or a zero vector that is to be normalised."""
    v = F.transform(vector.cast("array<double>"), lambda x: x + F.lit(0.0))
    fine = (F.size(v) == dimensions) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    norm = F.sqrt(_dot(v, v))
    return F.when(fine, v) if not normalize else F.when(fine & (norm > 0), F.transform(v, lambda x: x / norm))


def dedupe_vectors(vectors: DataFrame, by: str, order: str = "vec_id") -> DataFrame:
    """Of each owner (or document reference) the first vector by projection id; those without one stay."""
    first = vectors.where(F.col(by).isNotNull()).groupBy(by).agg(F.min(order).alias(order))
    return vectors.join(first, [by, order], "left_semi").unionByName(vectors.where(F.col(by).isNull()))


def split_grains(vectors: DataFrame, grain: str = "grain") -> dict[str, DataFrame]:
    """The artifact and the entity lane, each for a dedupe and a cap of its own."""
    return {"artifact": vectors.where(F.col(grain) == "artifact"), "entity": vectors.where(F.col(grain) == "entity")}


def rerank(lanes: dict[str, tuple[DataFrame, int]], k: int | None = None) -> DataFrame:
    """id, numerator, denominator, in order of the exact score sum(weight / rank), then id.  Weights are whole
    numbers; of three lanes at most, ranks up to 10**9, products stay within 38 digits."""
    if not 1 <= len(lanes) <= 3:
        raise QueryError("core:invalid_lane", "one to three lanes")
    rows = reduce(DataFrame.unionByName, [df.select("id", F.lit(n).alias("_lane"), F.col("rank").cast("decimal(12,0)").alias("_rank"), F.lit(w).cast("decimal(6,0)").alias("_w")) for n, (df, w) in enumerate(lanes.values())])
    one = rows.groupBy("id").agg(*[F.max(F.when(F.col("_lane") == n, F.col(c))).alias(f"{c}{n}") for n in range(len(lanes)) for c in ("_rank", "_w")])
    ranks = [F.coalesce(F.col(f"_rank{n}"), F.lit(1)).cast("decimal(12,0)") for n in range(len(lanes))]
    product = lambda some: reduce(lambda x, y: (x * y).cast("decimal(38,0)"), some, F.lit(1).cast("decimal(38,0)"))
    top = [(F.coalesce(F.col(f"_w{n}"), F.lit(0)) * product([r for m, r in enumerate(ranks) if m != n])).cast("decimal(38,0)") for n in range(len(lanes))]
    scored = one.select("id", reduce(lambda x, y: (x + y).cast("decimal(38,0)"), top).alias("numerator"), product(ranks).alias("denominator"))
    # a whole part and a remainder part of 18 digits order as the fractions do, for denominators below 10**18
    whole = F.floor(F.col("numerator") / F.col("denominator"))
    rest = ((F.col("numerator") % F.col("denominator")).cast("decimal(20,0)") * F.lit(10**18).cast("decimal(19,0)")) / F.col("denominator")
    ordered = scored.orderBy(whole.desc(), rest.desc(), "id")
    return ordered.limit(k) if k else ordered


# ---------------------------------------------------------------- semantic documents

#: An entity document needs a span of so many characters; kinds that never have one.
LEAST_SPAN, NO_DOCUMENT = 120, ("core:container", "core:parameter")


def eligible_entity(kind: Column, span: Column, start_column: Column) -> Column:
    """Whether an entity gets a document of its own: no container or parameter, a long span, from a line's begin."""
    return F.coalesce(~kind.isin(*NO_DOCUMENT) & (F.length(span) >= LEAST_SPAN) & (start_column == 0), F.lit(False))


def entity_document(kind: Column, label: Column, comment: Column, span: Column) -> Column:
    """`kind label`, the comment if there is one, and the span, on lines of their own."""
    return F.concat_ws("\n", F.concat_ws(" ", kind, label), F.nullif(comment, F.lit("")), span)


def semantic_document(source: Column, sections: Column) -> Column:
    """The source, then the enrichment sections that aren't empty, in order of their digests."""
    some = F.filter(sections, lambda x: x.isNotNull() & (F.trim(x) != ""))
    ordered = F.transform(F.array_sort(F.transform(some, lambda x: F.struct(F.sha2(x, 256).alias("d"), x.alias("t")))), lambda x: x["t"])
    return F.array_join(F.concat(F.array(source), ordered), "\n")


def segments(docs: DataFrame, id_col: str, tokens: Column, size: int, overlap: int = 0) -> DataFrame:
    """id, segment, tokens: fixed windows of a document's tokens; a document without tokens has none."""
    if size < 1 or not 0 <= overlap < size:
        raise QueryError("core:budget_invalid", f"{size} {overlap}")
    step = size - overlap
    known = docs.select(id_col, tokens.alias("_t")).where(F.size("_t") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("_t") - overlap - 1), F.lit(step))
    return known.select(id_col, "_t", F.posexplode(starts).alias("segment", "_at")).select(id_col, "segment", F.slice("_t", F.col("_at") + 1, F.lit(size)).alias("tokens"))


def select_profile(gates: DataFrame) -> DataFrame:
    """profile_id: of the profiles all of whose gates passed the smallest; gates: profile_id, passed."""
    return gates.groupBy("profile_id").agg(F.bool_and(F.coalesce("passed", F.lit(False))).alias("_ok")).where("_ok").agg(F.min("profile_id").alias("profile_id")).where("profile_id is not null")


# ---------------------------------------------------------------- hashing embedding

#: FNV-1a of 32 bits, the offset of the sign (the first one, xor 0x9E3779B9), buckets.
FNV_OFFSET, FNV_PRIME, SIGN_OFFSET, DIMENSIONS = 0x811C9DC5, 0x01000193, 0x811C9DC5 ^ 0x9E3779B9, 256
_FULL, _PARTS = "[A-Za-z0-9_$]+", "[0-9]+|[A-Z]+(?=[A-Z][a-z])|[A-Z]?[a-z]+|[A-Z]+"


def hash_tokens(text: Column) -> Column:
    """Each identifier as a whole and each of its parts by `_`, `$`, digits and humps (a word without parts
    stands twice), lower-cased."""
    every = F.concat(F.regexp_extract_all(text, F.lit(_FULL), F.lit(0)), F.regexp_extract_all(text, F.lit(_PARTS), F.lit(0)))
    return F.transform(every, F.lower)


def fnv(token: Column, offset: int) -> Column:
    """FNV-1a of an ASCII string."""
    step = lambda h, i: (h.bitwiseXOR(F.ascii(F.substr(token, i, F.lit(1))).cast("long")) * FNV_PRIME).bitwiseAND(0xFFFFFFFF)
    return F.aggregate(F.sequence(F.lit(1), F.length(token)), F.lit(offset).cast("long"), step)


#: Words whose hashes a worker remembers; then it begins anew.
REMEMBERED = 200_000


def _bucket_rows(dense: bool):
    """What turns batches (id, list of texts) into rows (id, bucket, value) or, if dense, (id, embedding), made here so that
    workers get it whole.  A word's parts are those of the text, so each distinct word is taken apart and hashed once."""
    most, size = REMEMBERED, DIMENSIONS
    full, parts = re.compile(_FULL), re.compile(_PARTS)
    words: dict[str, list[str]] = {}
    hashes: dict[str, tuple[int, int]] = {}

    def hashed(term: str) -> tuple[int, int]:
        one, two = FNV_OFFSET, SIGN_OFFSET
        for c in term.encode():
            one, two = (one ^ c) * FNV_PRIME & 0xFFFFFFFF, (two ^ c) * FNV_PRIME & 0xFFFFFFFF
        return one % size, 1 if two % 2 == 0 else -1

    def buckets(texts: list[str | None]) -> dict[int, float]:
        tf: dict[str, int] = {}
        for text in texts:
            for word, n in Counter(full.findall(text or "")).items():
                terms = words.get(word)
                if terms is None:
                    terms = words[word] = [x.lower() for x in (word, *parts.findall(word))]
                for x in terms:
                    tf[x] = tf.get(x, 0) + n
        out: dict[int, list[float]] = {}
        for x, n in tf.items():
            known = hashes.get(x)
            if known is None:
                known = hashes[x] = hashed(x)
            out.setdefault(known[0], []).append(known[1] * (1 + math.log(n)))
        if len(words) > most or len(hashes) > most:
            words.clear()
            hashes.clear()
        return {k: v for k, v in ((k, math.fsum(v)) for k, v in out.items()) if v}

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, len(batch), 256):
                ids, texts = batch.column(0).slice(first, 256), batch.column(1).slice(first, 256)
                held = [buckets(x.as_py()) for x in texts]
                if dense:
                    kept = [k for k, b in enumerate(held) if b]
                    matrix = np.zeros((len(kept), size))
                    for row, k in enumerate(kept):
                        matrix[row, list(held[k])] = list(held[k].values())
                    matrix /= np.sqrt((matrix * matrix).sum(1, keepdims=True))
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(0, matrix.size + 1, size, dtype=np.int32)), pa.array(matrix.ravel()))
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(kept, pa.int64())), lists], [batch.schema.names[0], "embedding"])
                else:
                    at = pa.array([k for k, b in enumerate(held) for _ in b], pa.int64())
                    yield pa.RecordBatch.from_arrays([ids.take(at), pa.array([k for b in held for k in b], pa.int32()), pa.array([v for b in held for v in b.values()], pa.float64())], [batch.schema.names[0], "bucket", "value"])

    return find


def _texts_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, list of its texts.  Ids mostly name one row; only if some name several (a count of ids) are texts brought together."""
    if docs.groupBy(id_col).count().where("count > 1").isEmpty():
        return docs.select(id_col, F.array(text_col).alias("_texts"))
    return docs.groupBy(id_col).agg(F.collect_list(text_col).alias("_texts"))


def hash_buckets(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, bucket, value: signed sums of 1 + ln(tf); buckets that cancel out are left out."""
    some = _texts_of(docs, id_col, text_col)
    return some.mapInArrow(_bucket_rows(False), StructType([some.schema[id_col], StructField("bucket", IntegerType()), StructField("value", DoubleType())]))


def hash_embedding(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, embedding: the buckets at length 1; documents without tokens, or whose tokens cancel out, have none."""
    some = _texts_of(docs, id_col, text_col)
    return some.mapInArrow(_bucket_rows(True), StructType([some.schema[id_col], StructField("embedding", ArrayType(DoubleType()))]))
