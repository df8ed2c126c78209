"""Approximate nearest neighbours by randomly rotated one-bit codes.

Each vector's residual from the mean is rotated by a random orthogonal matrix;
its code is the sign of each coordinate, packed into bits.  With o the unit
residual and s the unit vector of its signs, the factor <s, o> corrects the
estimate: <o, q> is about <s, q> / <s, o> for any rotated query q, with a
deviation of sqrt((1 - <s,o>^2) / <s,o>^2 / (d - 1)) times |q|.

Cells: k-means centres of a bounded sample part the vectors, and a query meets
the cells whose centres have the largest inner products with it.  How many, is
read off the sample: so many that the sample's own nearest neighbours lie in them
(REACHED of them).  Vectors in clusters need a few cells; vectors without any
structure need most of them, so the answer stays right and only work grows.

In a cell, vectors whose upper bound (estimate + BOUND deviations) reaches the
k-th largest lower bound are reranked by exact inner products in double
precision; all others are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratagraph.llm import words
from stratagraph.llm.common import partitions, small_side, written

SEED, BOUND = 11, 1.5
#: Vectors (about) that fit the cells, queries among them that set the number of probed cells, and the share
#: of their neighbours that must lie there.
SAMPLE, TRIALS, REACHED = 40_000, 256, 0.97
#: Bytes of the sample at most, in doubles: of long vectors fewer serve.
SAMPLE_BYTES = 64 << 20
#: Vectors a cell (about, until there are as many cells as the sample can fit), sample vectors a cell.
CELL, PER_CELL = 4096, 40
#: Vectors and queries that one task takes of a cell.
BLOCK, QUERIES = 16_384, 4096


def rotation(d: int, seed: int = SEED) -> np.ndarray:
    """A random orthogonal matrix (QR of Gaussian columns, signs fixed)."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, d)))
    return q * np.sign(np.diag(r))


def pack(signs: np.ndarray) -> np.ndarray:
    """Bits of rows of booleans, as bytes."""
    return np.packbits(signs, axis=1, bitorder="little")


@dataclass
class Index:
    """What is fitted on the sample: the mean, the rotation, the cells' centres and how many of them a query probes."""

    mean: np.ndarray
    turn: np.ndarray
    centres: np.ndarray
    probes: int

    def cells(self, vectors: np.ndarray) -> np.ndarray:
        """The cell of each vector: the nearest centre."""
        return (vectors @ self.centres.T - (self.centres**2).sum(1) / 2).argmax(1) if len(vectors) else np.zeros(0, np.int64)

    def probed(self, queries: np.ndarray) -> np.ndarray:
        """The cells that each query meets."""
        return np.argsort(-(queries @ self.centres.T), axis=1, kind="stable")[:, : self.probes]

    def encode(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(packed signs, rows of: residual's norm, correction factor, error's deviation, inner product with the mean)."""
        residual = vectors - self.mean
        norm = np.linalg.norm(residual, axis=1)
        unit = residual / np.where(norm > 0, norm, 1)[:, None] @ self.turn
        d = vectors.shape[1]
        factor = np.abs(unit).sum(1) / np.sqrt(d)
        factor = np.where(factor > 0, factor, 1)
        deviation = np.sqrt(np.maximum(0, 1 - factor**2) / max(1, d - 1)) / factor
        return pack(unit >= 0), np.stack([norm, factor, deviation, vectors @ self.mean], 1)

    def estimates(self, bits: np.ndarray, scalars: np.ndarray, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(estimated inner products, half widths of their bounds): a row a vector, a column a query."""
        d = len(self.mean)
        norm, factor, deviation, base = scalars.T[:, :, None]
        residual = queries - self.mean
        signs = np.unpackbits(bits, axis=1, count=d, bitorder="little").astype(np.float32) * 2 - 1
        against = signs @ (residual @ self.turn).T.astype(np.float32) / np.sqrt(d)
        estimate = against / factor * norm + base + queries @ self.mean - self.mean @ self.mean
        return estimate, norm * deviation * BOUND * np.linalg.norm(residual, axis=1)


def fit(sample: np.ndarray, k: int, cells: int, seed: int = SEED) -> Index:
    """An index fitted on sample vectors: `cells` centres at most, by Lloyd's rounds."""
    d = sample.shape[1]
    rng = np.random.default_rng(seed)
    mean = sample.mean(0) if len(sample) else np.zeros(d)
    index = Index(mean, rotation(d), np.zeros((1, d)), 1)
    cells = max(1, min(cells, len(sample) // PER_CELL))
    if cells == 1:
        return index
    index.centres = sample[rng.choice(len(sample), cells, replace=False)]
    for _ in range(8):
        own = np.concatenate([index.cells(sample[a : a + 8192]) for a in range(0, len(sample), 8192)])
        many = np.bincount(own, minlength=cells)
        sums = np.zeros((cells, d))
        np.add.at(sums, own, sample)
        index.centres = np.where(many[:, None] > 0, sums / np.maximum(many, 1)[:, None], index.centres)
    own = np.concatenate([index.cells(sample[a : a + 8192]) for a in range(0, len(sample), 8192)])
    trial = rng.choice(len(sample), min(TRIALS, len(sample)), replace=False)
    scores = sample[trial] @ sample.T
    scores[np.arange(len(trial)), trial] = -np.inf
    near = np.argpartition(-scores, min(k, len(sample) - 1) - 1, axis=1)[:, :k]
    index.probes = cells
    place = np.argsort(index.probed(sample[trial]), axis=1)  # of each cell among those of a query
    needed = np.take_along_axis(place, own[near], 1) + 1
    index.probes = int(np.quantile(needed, REACHED, method="higher"))
    return index


def block_top(index: Index, bits: np.ndarray, scalars: np.ndarray, vectors: np.ndarray, ids: np.ndarray, queries: np.ndarray, own: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(position of a query, ids, exact inner products) of a block's k best for each query, without its own row
    (of the same id and vector); ties to smaller ids."""
    for a in range(0, len(queries), 64):
        some = queries[a : a + 64]
        estimate, width = index.estimates(bits, scalars, some)
        lower = estimate - width
        least = np.partition(lower, len(ids) - k - 1, axis=0)[len(ids) - k - 1] if len(ids) > k + 1 else np.full(len(some), -np.inf)
        keep = estimate + width >= least  # one more than k, as the query's own row may be among them
        for q in range(len(some)):
            near = np.flatnonzero(keep[:, q])
            near = near[(ids[near] != own[a + q]) | (vectors[near] != some[q]).any(1)]
            exact = vectors[near] @ some[q]
            best = np.lexsort((ids[near], -exact))[:k]
            yield a + q, ids[near][best], exact[best]


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """id, v (doubles) of the rows that take part: an id, and a vector that isn't null or all zero, of finite components."""
    v = F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where("id is not null and v is not null and size(v) > 0")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return rows.where(F.coalesce(finite, F.lit(False)) & F.exists("v", lambda x: x != 0))


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy().reshape(-1, d)


def search(vectors: DataFrame, *, every: int = 20, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: for each query row (id divisible by `every`) its k nearest by
    inner product among all other rows.

    Rows without an id, with a null, empty or all-zero vector, or with a null or
    non-finite component take no part, nor do vectors of another dimension than
    the most frequent one (of equally frequent ones the smallest).  Rows that
    repeat an id with another vector are candidates, and queries, of their own
    (the ranks of such queries start anew with each vector, told apart by
    query_key); a query's exact repeats count as its own row.  Ties go to smaller
    ids.  An empty table gives no rows; with fewer than k candidates in the
    probed cells, these are returned.

    The sample and the cells' sizes (a row a cell) are all that reaches the
    driver.  A task takes a block of a cell's vectors and a block of its queries,
    so a cell with a third of all rows is many tasks.  Each block returns k rows
    a query.
    """
    spark = vectors.sparkSession
    rows = usable(vectors, id_col, vector_col)
    shape = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    d, n = (shape["d"], shape["count"]) if shape else (1, 0)
    rows = rows.where(F.size("v") == d)
    most = min(SAMPLE, SAMPLE_BYTES // (8 * d))
    share = min(1.0, most / max(1, n))
    chosen = rows.where(F.pmod(F.xxhash64("id", F.lit(SEED)), F.lit(1 << 30)) <= int(share * (1 << 30))).limit(2 * most)
    sample = np.concatenate([_matrix(c, d) for c in chosen.select("v").toArrow().column("v").chunks] or [np.zeros((0, d))])
    sample = sample[np.lexsort(sample.T)] if n else sample  # rows come in any order
    index = fit(sample, k, -(-n // CELL))
    fitted = spark.sparkContext.broadcast(index)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 4096):
                b = whole.slice(at, 4096)
                data = _matrix(words.column(b, "v"), d)
                bits, scalars = fitted.value.encode(data)
                yield pa.RecordBatch.from_arrays([words.column(b, "id"), pa.array(fitted.value.cells(data), pa.int32()), pa.array([x.tobytes() for x in bits], pa.binary()), pa.array([x.tobytes() for x in scalars], pa.binary()), words.column(b, "v")], ["id", "cell", "bits", "scalars", "v"])

    coded = written(rows.mapInArrow(assign, "id long, cell int, bits binary, scalars binary, v array<double>"), "codes")

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 4096):
                b = whole.slice(at, 4096)
                cells = fitted.value.probed(_matrix(words.column(b, "v"), d))
                yield pa.RecordBatch.from_arrays([words.column(b, "id"), words.column(b, "v"), pa.array(list(cells.astype(np.int32)), pa.list_(pa.int32()))], ["id", "v", "cells"])

    asking = coded.where(F.col("id") % every == 0).select("id", "v").dropDuplicates(["id", "v"]).mapInArrow(probe, "id long, v array<double>, cells array<int>")
    asking = asking.select("id", "v", F.explode("cells").alias("cell"))
    sizes = coded.groupBy("cell").count().select("cell", F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks"))
    asked = written(asking, "probes")
    many = asked.groupBy("cell").count().select("cell", F.ceil(F.col("count") / QUERIES).cast("int").alias("parts"))
    sizes = small_side(written(sizes.join(many, "cell"), "cells"))
    # a vector goes to each part of its cell's queries, a query to each block of its cell's vectors
    held = coded.join(sizes, "cell").select("cell", F.pmod(F.xxhash64("id", "v"), F.col("blocks")).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "id", "bits", "scalars", "v")
    meeting = asked.join(sizes, "cell").select("cell", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.pmod(F.xxhash64("id", "v"), F.col("parts")).cast("int").alias("part"), "id", "v")

    def top(left: pa.Table, right: pa.Table) -> pa.Table:
        found: list[tuple] = []
        if left.num_rows and right.num_rows:
            ids, own = (t.column("id").to_numpy() for t in (left, right))
            data, queries = (np.concatenate([_matrix(c, d) for c in t.column("v").chunks]) for t in (left, right))
            bits = np.frombuffer(b"".join(left.column("bits").to_pylist()), np.uint8).reshape(len(ids), -1)
            scalars = np.frombuffer(b"".join(left.column("scalars").to_pylist())).reshape(len(ids), -1)
            keys = right.column("key").to_numpy()
            found = [(own[q], keys[q], near, exact) for q, near, exact in block_top(fitted.value, bits, scalars, data, ids, queries, own, k)]
        times = [len(f[2]) for f in found]
        return pa.table({"query_id": pa.array(np.repeat([f[0] for f in found], times).astype(np.int64)), "query_key": pa.array(np.repeat([f[1] for f in found], times).astype(np.int64)), "vec_id": pa.array(np.concatenate([f[2] for f in found] or [np.zeros(0, np.int64)])), "score": pa.array(np.concatenate([f[3] for f in found] or [np.zeros(0)]))})

    key = ["cell", "block", "part"]
    parts = partitions(coded, 8)
    left = held.repartition(parts, *key).groupBy(*key)
    right = meeting.withColumn("key", F.xxhash64("v")).repartition(parts, *key).groupBy(*key)
    near = left.cogroup(right).applyInArrow(top, "query_id long, query_key long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id", "query_key").orderBy(F.desc("score"), "vec_id"))
    return near.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score", "query_key")
