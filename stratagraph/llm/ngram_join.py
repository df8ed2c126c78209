"""N-gram Jaccard self-join by count-vector R-trees.

A document is the set of its distinct word shingles (64-bit hashes).  Two sets
link when their Jaccard similarity reaches t = 3/4; links make components.

1. Rows of one and the same set collapse into a class, numbered by a digest of
   the set, so that rows that repeat an id with other texts are of several.
2. Classes meet in blocks.  An R-tree alone would compare all with all: hashed
   counts of unrelated texts lie so near one another that boxes prune nothing.
   So the top of the tree is cut by elements: if J >= t, the first
   n - ceil(t*n) + 1 elements of either set, in one common order, hold a common
   one.  Each of these is a block's key.  The order puts elements that are
   frequent in a sample of documents last, so that passages which many documents
   share make few and small blocks; any order gives the same links.
3. Pairs of small blocks are bounded by their sizes and count vectors (elements
   hashed into GROUPS groups; the summed minima must reach the overlap that t
   needs).  Blocks of more than SMALL members become R-trees of count vectors: a
   search descends into boxes whose sizes fit and whose bound, the summed minima
   of the query's counts and the box's upper corner, suffices.  What passes only
   has to join candidate components, so a member is not searched for by those
   that are in one group with it.
4. All links lie inside of candidate components.  Each of them becomes an R-tree
   once more, whose surviving pairs are verified on the sets and counted.
   Blocks and components of many members are cut, and each pair of cuts is a
   task: no task holds an unbounded group, and no pair is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from stratagraph.llm import words
from stratagraph.llm.common import arrow_rows, drop, free_shuffles, partitions, small_side, written

WIDTH, NUMERATOR, DENOMINATOR = 5, 3, 4  # 100 * both >= 75 * all
GROUPS, FANOUT = 256, 16
#: Documents (about) whose elements are counted for the common order, times that make an element frequent, and
#: frequent elements that are kept (the most frequent ones).  They shape the blocks, not the results.
SAMPLE, OFTEN, COMMON = 10_000, 3, 500_000
#: Members of a block whose pairs are all taken.
SMALL = 8
#: Members of a larger block that one task takes; blocks beyond are cut and cuts are paired.
SPLIT = 2000
#: Members of a component, and elements of their sets, in one cut.
CUT, CUT_ELEMENTS = 2000, 2_000_000
#: Distinct elements that one product of incidence matrices takes, and surviving pairs a member from which on products verify.
COLUMNS, DENSE = 2048, 4
#: Ids of classes whose texts are read again that are broadcast at most (8 bytes each).
REREAD = 1_000_000


# ---------------------------------------------------------------- sets


def document_sets(texts: pa.Array) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    buf, offsets = words.text_bytes(texts)
    for i, j in words.slices(offsets, 1_000_000):
        at = offsets[i : j + 1] - offsets[i]
        low, starts, ends, first = words.split(buf[offsets[i] : offsets[j]], at, words.SPACED)
        hashes, cut = words.shingles(words.word_hashes(low, starts, ends), first, WIDTH)
        for d in range(j - i):
            yield np.unique(hashes[cut[d] : cut[d + 1]])


def least_common(n):
    """ceil(t*n): elements that a set of n shares with any set that links with it."""
    return -(-NUMERATOR * n // DENOMINATOR)


def prefix(elements: np.ndarray, common: np.ndarray | None = None, often: np.ndarray | None = None) -> np.ndarray:
    """The elements that stand for a (sorted) set in the blocks: the first ones in the order of how `often`
    an element is among `common` (sorted) ones, others before, equals by hash."""
    n = len(elements) - least_common(len(elements)) + 1 if len(elements) else 0
    if n and common is not None and len(common):
        at = np.minimum(np.searchsorted(common, elements), len(common) - 1)
        held = common[at] == elements
        if held.any():
            return elements[np.argsort(np.where(held, often[at], 0), kind="stable")[:n]]
    return elements[:n]


def counts(elements: np.ndarray) -> np.ndarray:
    """Elements in each group, as bytes (255: that many or more).  A set has GROUPS groups, or twice, four
    times ... as many, so that four elements fall into one at most: beyond that the counts of unrelated sets lie
    too near one another to part them."""
    groups = GROUPS
    while 4 * groups < len(elements):
        groups *= 2
    c = np.bincount((elements >> np.uint64(17)).astype(np.int64) % groups, minlength=groups)
    return np.minimum(c, 255).astype(np.uint8)


def folded(points: np.ndarray, groups: int) -> np.ndarray:
    """Rows of counts in fewer groups."""
    return points if points.shape[-1] == groups else points.reshape(*points.shape[:-1], -1, groups).sum(-2, dtype=np.int32)


def overlap_bound(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Summed coordinate minima of rows of counts; without end where a count is cut at 255."""
    least = np.minimum(x, y)
    bound = least.sum(-1, dtype=np.int64)
    return np.where((least >= 255).any(-1), 1 << 40, bound)


class Points:
    """Count vectors of a task's sets, some in more groups than others."""

    def __init__(self, vectors: list[np.ndarray], sizes: np.ndarray):
        self.sizes = sizes
        self.groups = np.array([len(v) for v in vectors], np.int64)
        self.coarse = np.stack([folded(v, GROUPS) for v in vectors]).astype(np.int32) if vectors else np.zeros((0, GROUPS), np.int32)
        self.row, self.fine = {}, {}  # by number of groups: of sets with as many groups or twice as many
        for g in np.unique(self.groups[self.groups > GROUPS]).tolist() + [GROUPS]:
            some = np.flatnonzero((self.groups == g) | (self.groups == 2 * g))
            self.row[g] = np.full(len(vectors), -1)
            self.row[g][some] = np.arange(len(some))
            self.fine[g] = np.stack([folded(vectors[k], g).astype(np.int32) for k in some]) if len(some) else np.zeros((0, g), np.int32)

    def __getitem__(self, some: np.ndarray) -> np.ndarray:
        return self.coarse[some]

    def bounded(self, i: int, near: np.ndarray) -> np.ndarray:
        """Of positions, those whose counts, in as many groups as both have, allow a link with the i-th set."""
        out = []
        common = np.minimum(self.groups[near], self.groups[i])
        for g in np.unique(common).tolist():
            some = near[common == g]
            some = some[(self.row[g][some] >= 0)] if self.row[g][i] >= 0 else some[:0]  # else their sizes are too far apart
            bound = overlap_bound(self.fine[g][self.row[g][some]], self.fine[g][self.row[g][i]])
            out.append(some[may_link(bound, self.sizes[some], self.sizes[i])])
        return np.sort(np.concatenate(out)) if out else near


def may_link(bound, a, b):
    """Whether an overlap of at most `bound` is enough for sets of a and b elements."""
    return (NUMERATOR + DENOMINATOR) * bound >= NUMERATOR * (a + b)


def overlaps(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of each of the left with each of the right sets, by products of
    incidence matrices."""
    both = np.zeros((len(left), len(right)), np.int64)
    parts = []
    for side in (left, right):
        size = np.array([len(sets[k]) for k in side], np.int64)
        parts.append((np.concatenate([sets[k] for k in side]) if size.sum() else np.zeros(0, np.uint64), np.repeat(np.arange(len(side)), size)))
    shared = np.intersect1d(np.unique(parts[0][0]), np.unique(parts[1][0]), assume_unique=True)
    if not len(shared):
        return both
    held = []
    for values, owner in parts:
        at = np.minimum(np.searchsorted(shared, values), len(shared) - 1)
        some = np.flatnonzero(shared[at] == values)
        order = some[np.argsort(at[some], kind="stable")]
        held.append((at[order], owner[order]))
    for begin in range(0, len(shared), COLUMNS):
        made = []
        for (column, owner), n in zip(held, both.shape):
            some = slice(*np.searchsorted(column, (begin, begin + COLUMNS)))
            m = np.zeros((n, min(COLUMNS, len(shared) - begin)), np.float32)
            m[owner[some], column[some] - begin] = 1
            made.append(m)
        both += np.rint(made[0] @ made[1].T).astype(np.int64)
    return both


def linked_pairs(sets: list[np.ndarray], pairs: np.ndarray) -> np.ndarray:
    """Of pairs (rows of two positions) of sorted sets, those with J >= t, exactly."""
    if not len(pairs):
        return pairs
    sizes = np.array([len(s) for s in sets], np.int64)
    left, right = np.unique(pairs[:, 0]), np.unique(pairs[:, 1])
    if len(pairs) > DENSE * (len(left) + len(right)):
        both = overlaps(sets, left, right)[np.searchsorted(left, pairs[:, 0]), np.searchsorted(right, pairs[:, 1])]
    else:
        both = np.array([len(np.intersect1d(sets[i], sets[j], assume_unique=True)) for i, j in pairs], np.int64)
    return pairs[(both > 0) & ((NUMERATOR + DENOMINATOR) * both >= NUMERATOR * (sizes[pairs[:, 0]] + sizes[pairs[:, 1]]))]


# ---------------------------------------------------------------- R-tree


class Tree:
    """A packed R-tree over count vectors: points in order of size, then of heaviest group; each
    level above holds, of FANOUT entries below, the upper corner and the smallest and largest size."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray):
        self.order = np.lexsort((points.argmax(1) if len(points) else sizes, sizes))
        self.levels = [(points[self.order], sizes[self.order], sizes[self.order])]
        while len(self.levels[-1][0]) > FANOUT:
            upper, low, high = self.levels[-1]
            heads = np.arange(0, len(upper), FANOUT)
            self.levels.append((np.maximum.reduceat(upper, heads), np.minimum.reduceat(low, heads), np.maximum.reduceat(high, heads)))

    def search(self, point: np.ndarray, size: int) -> np.ndarray:
        """Positions (in the order given) of the points that may link with the query."""
        now = np.arange(len(self.levels[-1][0]))
        for k in range(len(self.levels) - 1, -1, -1):
            upper, low, high = self.levels[k]
            least = np.maximum(low[now], least_common(size))
            fits = (high[now] >= least) & (NUMERATOR * low[now] <= DENOMINATOR * size)
            now, least = now[fits], least[fits]
            now = now[may_link(overlap_bound(upper[now], point), size, least)]
            if k:
                now = (now[:, None] * FANOUT + np.arange(FANOUT)).ravel()
                now = now[now < len(self.levels[k - 1][0])]
        return self.order[now]


def may_pairs(points: Points, side: np.ndarray | None = None) -> np.ndarray:
    """Pairs of positions that may link, the smaller first; with sides, (one of side 0, one of side 1)."""
    sizes = points.sizes
    left = np.arange(len(sizes)) if side is None else np.flatnonzero(side == 0)
    tree = Tree(points[left], sizes[left])
    found = [np.zeros((0, 2), np.int64)]
    for i in left if side is None else np.flatnonzero(side == 1):
        near = left[tree.search(points[i], int(sizes[i]))]
        near = points.bounded(int(i), near[near < i] if side is None else near)
        found.append(np.stack([near, np.full(len(near), i)], 1))
    return np.concatenate(found)


class Groups:
    """Groups of joined positions."""

    def __init__(self, n: int):
        self.of = np.arange(n)

    def join(self, members: np.ndarray) -> None:
        labels = np.unique(self.of[members])
        if len(labels) > 1:
            self.of[np.isin(self.of, labels)] = labels[0]


def block_edges(ids: np.ndarray, points: Points, side: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Edges that join whatever of a block's members (of the two sides) may link, directly or over others.
    First leaders take all that may link with them; then members outside of the largest group search."""
    n, sizes = len(ids), points.sizes
    groups, tree = Groups(n), Tree(points.coarse, sizes)
    asked = np.zeros(n, bool)

    def search(i: int) -> None:
        near = tree.search(points[i], int(sizes[i]))
        near = points.bounded(i, near[near != i] if side is None else near[side[near] != side[i]])
        asked[i] = True
        if len(near):
            groups.join(np.append(near, i))

    for i in np.argsort(sizes, kind="stable"):
        if groups.of[i] == i and (groups.of == i).sum() == 1:
            search(int(i))
    labels, many = np.unique(groups.of, return_counts=True)
    for i in np.flatnonzero((groups.of != labels[many.argmax()]) & ~asked):
        search(int(i))
    first: dict[int, int] = {}
    out = []
    for k in np.argsort(ids, kind="stable"):
        a = first.setdefault(int(groups.of[k]), int(ids[k]))
        if a != ids[k]:
            out.append((a, int(ids[k])))
    return out


# ---------------------------------------------------------------- blocks of keys


def size_code(n: int) -> int:
    """A set's size in 16 bits, on a scale of logarithms: codes of sizes with a ratio of 4/3 differ by STEP at most."""
    return int(np.log2(n) * 2048)


STEP = int(np.ceil(np.log2(DENOMINATOR / NUMERATOR) * 2048)) + 1


def entries(keys: np.ndarray, number: int, size: int) -> np.ndarray:
    """Rows (48 bits of the key and the size's code, class) of the keys of a class."""
    out = np.empty((len(keys), 2), np.uint64)
    out[:, 0] = keys << np.uint64(16) | np.uint64(size_code(size))
    out[:, 1] = np.int64(number).astype(np.uint64)
    return out


def meet(held: np.ndarray, small: int = SMALL) -> tuple[np.ndarray, list[tuple[int, np.ndarray]]]:
    """Of entries of one part of the keys: distinct pairs (a < b) of classes in small blocks whose sizes
    fit, and (number, classes) of larger blocks.  Blocks of the same members count once."""
    key, code, number = held[:, 0] >> np.uint64(16), (held[:, 0] & np.uint64(0xFFFF)).astype(np.int64), held[:, 1].astype(np.int64)
    order = np.lexsort((number, key))
    key, code, number = key[order], code[order], number[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (number[1:] != number[:-1])
    key, code, number = key[new], code[new], number[new]
    heads = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    many = np.diff(np.append(heads, len(key)))
    heads, many = heads[many > 1], many[many > 1]
    pairs = [np.zeros((0, 2), np.int64)]
    larger = []
    if len(heads):
        marks = words.mix(number.view(np.uint64))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(marks, dtype=np.uint64)])
        mark = words.mix(sums[heads + many] - sums[heads]) ^ many.astype(np.uint64)
        _, one = np.unique(mark, return_index=True)
        heads, many, mark = heads[one], many[one], mark[one]
    for m in np.unique(many[many <= small]):
        at = heads[many == m][:, None] + np.arange(m)
        i, j = np.triu_indices(m, 1)
        fit = np.abs(code[at[:, i]] - code[at[:, j]]) <= STEP
        pairs.append(np.stack([number[at[:, i]][fit], number[at[:, j]][fit]], 1))
    for h, m, x in zip(heads[many > small], many[many > small], mark[many > small] if len(heads) else ()):
        larger.append((int(x.astype(np.int64)), number[h : h + m]))
    return np.unique(np.concatenate(pairs), axis=0), larger


# ---------------------------------------------------------------- stages


def _number(elements: np.ndarray) -> int | None:
    """A class's number; None for an empty set."""
    return xxhash.xxh3_64_intdigest(elements.tobytes()) - (1 << 63) if len(elements) else None


def _each_set(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """Parts of batches and the sets of their texts."""
    for whole in batches:
        for at in range(0, whole.num_rows, 500):
            b = whole.slice(at, 500)
            yield b, list(document_sets(words.column(b, "text")))


def _classes(rows: DataFrame) -> DataFrame:
    """id, n, class, text_key of each document: one pass, no shuffle."""

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, sets in _each_set(batches):
            yield pa.RecordBatch.from_arrays([words.column(b, "id"), pa.array([len(s) for s in sets], pa.int64()), pa.array([_number(s) for s in sets], pa.int64()), words.column(b, "text_key")], ["id", "n", "class", "text_key"])

    return rows.mapInArrow(take, "id long, n long, class long, text_key long")


def _of_classes(rows: DataFrame, chosen: DataFrame, most: int) -> DataFrame:
    """The rows of the ids `rep` of chosen classes: a broadcast of ids, if they are `most` at most, so that
    texts aren't shuffled."""
    return rows.join(small_side(chosen.select(F.col("rep").alias("id")).distinct(), most), "id", "left_semi").select("id", "text")


def _frequent(rows: DataFrame, classes: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(elements, how often) of the elements that OFTEN of SAMPLE classes have, COMMON at most."""
    spark = rows.sparkSession
    share = int(min(1.0, SAMPLE / max(1, classes.count())) * (1 << 30))
    chosen = written(classes.where(F.pmod(F.xxhash64("class"), F.lit(1 << 30)) <= share).limit(2 * SAMPLE).select("class", "rep"), "sample")
    parts = 64

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, sets in _each_set(batches):
            every = np.sort(np.concatenate(sets)) if sets else np.zeros(0, np.uint64)
            cuts = np.searchsorted(every >> np.uint64(58), np.arange(parts + 1, dtype=np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(range(parts), pa.int32()), pa.array([every[cuts[k] : cuts[k + 1]].tobytes() for k in range(parts)], pa.binary())], ["part", "data"])

    def count(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        values, n = np.unique(np.frombuffer(b"".join(table.column("data").to_pylist()), np.uint64), return_counts=True)
        return pa.table({"element": pa.array(values[n >= OFTEN].view(np.int64)), "n": pa.array(n[n >= OFTEN], pa.int64())})

    with arrow_rows(spark, 1000):
        found = _of_classes(rows, chosen, 2 * SAMPLE).mapInArrow(spread, "part int, data binary").groupBy("part").applyInArrow(count, "element long, n long")
        table = found.orderBy(F.desc("n"), "element").limit(COMMON).toArrow()
    elements = table.column("element").to_numpy().view(np.uint64)
    order = np.argsort(elements)
    drop(chosen)
    return elements[order], table.column("n").to_numpy()[order].astype(np.int32)


def _meetings(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """block, a, b: pairs of classes of small blocks (no block), and members a of larger blocks."""
    spark = rows.sparkSession
    common = spark.sparkContext.broadcast(_frequent(rows, classes))
    parts = partitions(rows, 4)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set[int] = set()  # copies in this task's rows
        kept: list[np.ndarray] = []
        tops: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            every, part = np.concatenate(kept), np.concatenate(tops)
            order = np.argsort(part, kind="stable")
            every, part = every[order], part[order]
            names = np.unique(part)
            cuts = np.append(np.searchsorted(part, names), len(part))
            kept.clear(), tops.clear()
            return pa.RecordBatch.from_arrays([pa.array(names, pa.int32()), pa.array([every[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:])], pa.binary())], ["part", "data"])

        for b, sets in _each_set(batches):
            for known, s in zip(words.column(b, "id").is_valid().to_pylist(), sets):
                number = _number(s)
                if number is None or not known or number in sent:
                    continue
                sent.add(number)
                keys = prefix(s, *common.value)
                kept.append(entries(keys, number, len(s)))
                tops.append((words.mix(keys) % np.uint64(parts)).astype(np.int32))
            if sum(map(len, kept)) > 200_000:
                yield flush()
        if kept:
            yield flush()

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[bytes]] = {}
        for b in batches:
            for part, data in zip(words.column(b, "part").to_pylist(), words.column(b, "data").to_pylist()):
                held.setdefault(part, []).append(data)
        while held:
            pairs, larger = meet(np.frombuffer(b"".join(held.popitem()[1]), np.uint64).reshape(-1, 2))
            none = pa.nulls(len(pairs), pa.int64())
            yield pa.RecordBatch.from_arrays([none, pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["block", "a", "b"])
            for block, members in larger:
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(members), block)), pa.array(members), pa.nulls(len(members), pa.int64())], ["block", "a", "b"])

    with arrow_rows(spark, 1000):
        made = rows.select("id", "text").mapInArrow(spread, "part int, data binary").repartition(parts, "part").mapInArrow(gather, "block long, a long, b long")
        out = written(made.distinct(), "meetings")
    common.unpersist()
    free_shuffles(spark)
    return out


def _sets(rows: DataFrame, classes: DataFrame, elements: bool) -> DataFrame:
    """class, n, counts of classes (class, rep), and with `elements` their sets, from texts of the documents
    `rep`; a class is there as often as its text repeats."""
    schema = "class long, n long, counts binary" + ", elements binary" * elements

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, sets in _each_set(batches):
            made = [pa.array([_number(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array([counts(s).tobytes() for s in sets], pa.binary())]
            made += [pa.array([s.tobytes() for s in sets], pa.binary())] * elements
            yield pa.RecordBatch.from_arrays(made, ["class", "n", "counts", "elements"][: len(made)])

    with arrow_rows(rows.sparkSession, 1000):
        made = _of_classes(rows, classes, REREAD).mapInArrow(take, schema)
        return written(made.join(small_side(classes.select("class"), REREAD), "class", "left_semi"), "sets")


@F.arrow_udf(LongType())
def _bound(a: pa.Array, b: pa.Array) -> pa.Array:
    x, y = (v.to_pylist() for v in (a, b))
    out = np.zeros(len(x), np.int64)
    least = np.array([min(len(p), len(q)) for p, q in zip(x, y)], np.int64)
    for g in np.unique(least):
        some = np.flatnonzero(least == g)
        for k in range(0, len(some), max(1, (1 << 22) // int(g))):
            part = some[k : k + max(1, (1 << 22) // int(g))]
            sides = (np.stack([folded(np.frombuffer(v[i], np.uint8), int(g)).astype(np.int32) for i in part]) for v in (x, y))
            out[part] = overlap_bound(*sides)
    return pa.array(out)


def _bounded(pairs: DataFrame, vectors: DataFrame) -> DataFrame:
    """a, b of the pairs whose sizes fit and whose counts allow a link."""
    of = lambda c: vectors.select(F.col("class").alias(c), F.col("n").alias(f"n{c}"), F.col("counts").alias(f"c{c}"))
    near = F.least("na", "nb") * DENOMINATOR >= F.greatest("na", "nb") * NUMERATOR
    counted = pairs.join(of("a"), "a").join(of("b"), "b").where(near).withColumn("bound", _bound("ca", "cb"))
    return counted.where((NUMERATOR + DENOMINATOR) * F.col("bound") >= NUMERATOR * (F.col("na") + F.col("nb"))).select("a", "b")


def _cut(members: DataFrame, group: str, cuts) -> DataFrame:
    """The members once for each pair (i, j) of their group's cuts that holds them, and their side in it."""
    own = F.pmod(F.xxhash64("class"), cuts).cast("int")
    spread = members.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), cuts - 1)))
    ends = F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).cast("int").alias("side")
    return spread.select(group, *ends, *(c for c in members.columns if c != group))


def _table(table: pa.Table) -> tuple[np.ndarray, pa.Table]:
    """(numbers, rows) of a task's classes, each once."""
    number = table.column("class").to_numpy()
    _, one = np.unique(number, return_index=True)
    return number[one], table.take(pa.array(one))


def _points(table: pa.Table) -> Points:
    return Points([np.frombuffer(x, np.uint8) for x in table.column("counts").to_pylist()], table.column("n").to_numpy())


def _searched(members: DataFrame, vectors: DataFrame) -> DataFrame:
    """a, b: edges that join what may link inside of the larger blocks (block, class)."""
    size = written(members.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / SPLIT).cast("int").alias("cuts")), "block-sizes")
    known = members.join(small_side(size), "block").join(vectors, "class")

    def search(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        ids, table = _table(table)
        side = None if key[1].as_py() == key[2].as_py() else table.column("side").to_numpy()
        edges = block_edges(ids, _points(table), side)
        return pa.table({"a": pa.array([e[0] for e in edges], pa.int64()), "b": pa.array([e[1] for e in edges], pa.int64())})

    task = _cut(known, "block", F.col("cuts")).drop("cuts")
    return task.groupBy("block", "i", "j").applyInArrow(search, "a long, b long")


def _verified(candidates: DataFrame, sets: DataFrame) -> DataFrame:
    """class, n_links, other: links that each class has inside of its candidate component (component, class),
    and edges class - other that join all that link."""
    held = candidates.join(sets.select("class", "n").distinct(), "class")
    size = held.groupBy("component").agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("elements"))
    cuts = F.greatest(F.ceil(F.col("k") / CUT), F.ceil(F.col("elements") / CUT_ELEMENTS)).cast("int")
    cuts = written(size.select("component", cuts.alias("cuts")).where("cuts > 1"), "cuts")
    inside = candidates.join(small_side(cuts), "component", "left").withColumn("cuts", F.coalesce("cuts", F.lit(1)))

    def verify(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        ids, table = _table(table)
        side = None if key[1].as_py() == key[2].as_py() else table.column("side").to_numpy()
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("elements")]
        links = linked_pairs(sets, may_pairs(_points(table), side))
        n = np.bincount(links.ravel(), minlength=len(ids))
        groups, edges = Groups(len(ids)), []
        order = np.argsort(links[:, 0], kind="stable")
        for k, some in _runs(links[order, 0]):
            groups.join(np.append(links[order[some], 1], k))
        for label in np.unique(groups.of):
            members = np.sort(ids[groups.of == label])
            edges += [(int(members[0]), int(m)) for m in members[1:]]
        linked = np.flatnonzero(n)
        a, b = ([e[k] for e in edges] for k in (0, 1))
        return pa.table({"class": pa.array(ids[linked].tolist() + a, pa.int64()), "n_links": pa.array(n[linked].tolist() + [None] * len(a), pa.int64()), "other": pa.array([None] * len(linked) + b, pa.int64())})

    with arrow_rows(sets.sparkSession, 1000):
        task = _cut(inside.join(sets, "class"), "component", F.col("cuts")).drop("cuts")
        out = written(task.groupBy("component", "i", "j").applyInArrow(verify, "class long, n_links long, other long"), "verified")
    return out


def _runs(keys: np.ndarray) -> Iterator[tuple[int, slice]]:
    heads = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    for a, b in zip(heads, np.append(heads[1:], len(keys))):
        yield int(keys[a]), slice(a, b)


def components(edges: DataFrame) -> DataFrame:
    """id, component (its smallest id) of every node of the edges (a, b): alternating large-star
    and small-star rounds, each written to the shared folder, until nothing changes."""
    state = None
    while True:
        both = edges.select("a", "b").union(edges.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", "m")).where("a != b").distinct()
        before, edges = edges, written(small, "stars")
        if state is not None:
            drop(before)
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(now) == state:
            nodes = edges.select(F.col("a").alias("id"), F.col("b").alias("component"))
            return written(nodes.union(edges.select("b", "b").distinct().toDF("id", "component")), "components")
        state = tuple(now)


def join_classes(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_shingles, component_id, n_links of every document.

    n_links counts the other classes (different sets) that link with the
    document's own; its exact copies have the same count.  A null or empty text,
    or one without words, has an empty set and is a component of its own.  Rows
    that repeat an id are in one component, the links of each are its own text's.
    Sets are of 64-bit hashes; on these the answer is exact.
    A null id takes no part and has a null component.  Further columns are left
    out; an empty table gives no rows.
    """
    return _joined(docs, id_col, text_col).select("id", F.col("n").alias("n_shingles"), "component_id", "n_links")


def distinct_texts(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, text_key (xxhash64 of the text), class of the rows to keep: of texts joined by links those of the
    smallest id (of several with it, of the smallest class).  Rows of an id are judged each by its text;
    those without an id are left out."""
    return _joined(docs, id_col, text_col).where("kept").select("id", "text_key", "class").distinct()


def _joined(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Each row's id, n, class, text_key, component_id, n_links and whether it is `kept`."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("text_key"))
    with arrow_rows(spark, 1000):
        table = written(_classes(rows), "rows")
    usable = table.where("id is not null and class is not null")
    classes = written(usable.groupBy("class").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("rows")), "classes")
    met = _meetings(rows, classes)
    pairs, members = met.where("block is null").select("a", "b"), met.where("block is not null").select("block", F.col("a").alias("class"))
    needed = pairs.select("a").union(pairs.select("b")).union(members.select("class")).toDF("class").distinct()
    chosen = written(classes.join(needed, "class", "left_semi").select("class", "rep"), "chosen")
    read = _sets(rows, chosen, False)
    vectors = written(read.groupBy("class").agg(F.max("n").alias("n"), F.max("counts").alias("counts")), "vectors")
    edges = written(_bounded(pairs, vectors).union(_searched(members, vectors)).distinct(), "edges")
    candidates = components(edges)
    drop(met, chosen, read, vectors, edges)
    inside = written(candidates.select(F.col("id").alias("class"), "component").join(classes, "class"), "inside")
    sets = _sets(rows, inside.select("class", "rep"), True)
    verified = _verified(inside.select("class", "component"), sets)
    drop(sets, candidates, inside)
    links = verified.where("other is not null").select(F.col("class").alias("a"), F.col("other").alias("b"))
    degrees = verified.where("other is null").groupBy("class").agg(F.sum("n_links").alias("n_links"))
    grouped = components(links)
    # an id's texts are in one component, but a link of one is none of another
    firsts = written(table.where("id is not null").groupBy("id").agg(F.min("class").alias("a"), F.max("class").alias("z"), F.count(F.lit(1)).alias("k")).where("k > 1 and a is not null"), "firsts")
    repeated = firsts.where("a != z").select("id", "a")
    joined = grouped
    if repeated.limit(1).count():
        same = usable.join(repeated, "id").where("class != a").select("a", F.col("class").alias("b")).distinct()
        joined = components(links.union(same))
    of = lambda some, c: some.select(F.col("id").alias("class"), F.col("component").alias(c))
    known = classes.join(of(grouped, "g"), "class", "left").join(of(joined, "j"), "class", "left").where("rows > 1 or g is not null or j is not null").join(degrees, "class", "left")
    known = written(known.withColumn("g", F.coalesce("g", "class")).withColumn("j", F.coalesce("j", "class")), "known")
    best = known.groupBy("g").agg(F.min(F.struct("rep", "class")).alias("best"))
    least = known.groupBy("j").agg(F.min("rep").alias("component_id"))
    # classes of one row without links aren't among them: they are components of their own
    labels = written(known.join(best, "g").join(least, "j").select("class", "rep", "component_id", "n_links", (F.col("best.class") == F.col("class")).alias("best")), "labels")
    drop(verified, known)
    texts = table.where("class is not null").join(labels, "class", "left")
    others = labels.select(F.col("class").alias("a"), "component_id")
    none = F.lit(None)
    blank = table.where("class is null").join(small_side(firsts.select("id", "a")), "id", "left").join(others, "a", "left")
    blank = blank.select("id", "n", "class", "text_key", none.cast("long").alias("rep"), "component_id", none.cast("long").alias("n_links"), none.cast("boolean").alias("best"))
    out = texts.select(blank.columns).union(blank)
    here = F.col("id").isNotNull()
    return out.select(
        "id", "n", "class", "text_key",
        F.when(here, F.coalesce("component_id", "id")).alias("component_id"),
        F.when(here, F.coalesce("n_links", F.lit(0))).otherwise(0).cast("long").alias("n_links"),
        (here & F.coalesce("best", F.lit(True)) & (F.col("id") == F.coalesce("rep", "id"))).alias("kept"),
    )
