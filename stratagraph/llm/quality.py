"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics of a batch are taken from the text's bytes by numpy, many documents
at once.  Trees are grown level by level on histograms of quantile bins with
logistic loss, and flattened into arrays in heap order, so that scoring walks
all documents down a level in one vector step.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratagraph.llm import words
from stratagraph.llm.common import arrow_rows, give_back, written

#: Labelled documents that a fit uses at most (of those, the first in an order hashed from the id).
FIT_ROWS = 40_000
TREES, DEPTH, BINS, RATE, LEAST_WEIGHT, RIDGE = 120, 4, 64, 0.1, 5.0, 1.0
#: Bytes of text measured at once: their running sums and hashes take many times as much.
SLICE = 1_000_000
#: Rows and bytes of an Arrow batch on its way to a Python worker.
BATCH = 1000, 2 << 20
#: score >= this: predicted 1, and kept by keep_good().
THRESHOLD = 0.7

_LINES = np.ones(256, bool)
_LINES[10] = False
_BYTE_CLASSES = [
    np.isin(np.arange(256), list(x))
    for x in (range(65, 91), range(48, 58), b"!", b"?", b".,;:", b"'\"()-", b"#$%&*+=^~<>@", b"|[]{}/\\_`", b"\n", b" \t\r\x0b\x0c", range(128, 256))
]
STATISTICS = (
    *("upper", "digit", "shout", "ask", "stop", "quote", "symbol", "mark", "newline", "space", "wide"),
    *("log_bytes", "log_words", "word_bytes", "long_word", "short_words", "caps_words", "bare_words", "distinct_words", "top_word", "repeats", "longest_run", "distinct_triples", "distinct_lines", "line_bytes", "end_words"),
)


def _keys(hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys (document, 44 bits of hash) and their document."""
    doc = np.repeat(np.arange(len(first) - 1, dtype=np.uint64), np.diff(first))
    keys = np.sort(doc << np.uint64(44) | hashes >> np.uint64(20))
    return keys, (keys >> np.uint64(44)).astype(np.int64)


def _most(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The largest value of each document; 0 of one without."""
    out = np.zeros(len(first) - 1)
    full = np.flatnonzero(np.diff(first))
    if len(full):
        out[full] = np.maximum.reduceat(values, first[:-1][full])
    return out


def _distinct(hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per document: distinct hashes, and rows of the most frequent one."""
    n = len(first) - 1
    if not len(hashes):
        return np.zeros(n), np.zeros(n)
    keys, doc = _keys(hashes, first)
    new = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    runs = np.diff(np.append(new, len(keys)))
    distinct = np.bincount(doc[new], minlength=n)
    return distinct, _most(runs, np.concatenate([[0], np.cumsum(distinct)]))


def statistics(buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of STATISTICS for each text; all zero but finite for an empty one."""
    n = len(offsets) - 1
    size = np.diff(offsets).astype(float)
    out = np.zeros((n, len(STATISTICS)))
    if not len(buf):
        return out

    def over(x: np.ndarray, of: np.ndarray) -> np.ndarray:
        return x / np.maximum(of, 1)

    counts = np.stack([np.bincount(buf[a:b], minlength=256) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())])
    out[:, : len(_BYTE_CLASSES)] = over(counts @ np.stack(_BYTE_CLASSES, 1).astype(np.int64), size[:, None])
    low, starts, ends, first = words.split(buf, offsets, words.SPACED)
    count = np.diff(first).astype(float)
    long = ends - starts
    hashes = words.word_hashes(low, starts, ends)
    doc = np.repeat(np.arange(n), np.diff(first))
    upper = np.concatenate([[0], np.cumsum(_BYTE_CLASSES[0][buf], dtype=np.int64)])
    letter = np.concatenate([[0], np.cumsum(((low >= 97) & (low <= 122)) | (low >= 128), dtype=np.int64)])
    caps = (upper[ends] - upper[starts]) * 2 > long
    bare = letter[ends] == letter[starts]
    last = low[ends - 1] if len(ends) else low[:0]

    def share(flags: np.ndarray) -> np.ndarray:
        return over(np.bincount(doc, flags, minlength=n), count)

    same = np.zeros(len(hashes), bool)
    same[1:] = hashes[1:] == hashes[:-1]
    heads = first[:-1][first[:-1] < len(hashes)]
    same[heads] = False
    run = np.arange(len(same)) - np.maximum.accumulate(np.where(same, 0, np.arange(len(same)))) if len(same) else np.zeros(0)
    longest, widest = _most(run, first), _most(long, first)
    distinct, top = _distinct(hashes, first)
    triples, at = words.shingles(hashes, first, 3)
    _, line_starts, line_ends, line_first = words.split(buf, offsets, _LINES)
    lines = np.diff(line_first)
    columns = (
        np.log1p(size), np.log1p(count), over(np.bincount(doc, long, minlength=n), count), np.log1p(widest), share(long <= 2), share(caps), share(bare),
        over(distinct, count), over(top, count), share(same), np.log1p(longest), over(_distinct(triples, at)[0], np.diff(at)),
        over(_distinct(words.word_hashes(low, line_starts, line_ends), line_first)[0], lines), np.log1p(over(size, lines)), share(np.isin(last, (33, 46, 63))),
    )
    for k, x in enumerate(columns, len(_BYTE_CLASSES)):
        out[:, k] = x
    return out


def column_statistics(texts: pa.Array) -> np.ndarray:
    buf, offsets = words.text_bytes(texts)
    parts = [statistics(buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]) for i, j in words.slices(offsets, SLICE)]
    give_back()
    return np.concatenate(parts) if parts else np.zeros((0, len(STATISTICS)))


# ---------------------------------------------------------------- trees


@dataclass
class Trees:
    """Complete trees in heap order: node k has the children 2k+1 and 2k+2.  feature, threshold:
    (trees, inner nodes); a node that wasn't split has an infinite threshold.  value: (trees, leaves)."""

    prior: float
    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray

    def margin(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.prior)
        rows = np.arange(len(x))
        inner = self.feature.shape[1]
        for f, t, v in zip(self.feature, self.threshold, self.value):
            at = np.zeros(len(x), np.int64)
            while inner and at.size and at[0] < inner:
                at = 2 * at + 1 + (x[rows, f[at]] > t[at])
            total += v[at - inner]
        return total

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -50, 50)))


def grow(x: np.ndarray, y: np.ndarray, *, trees: int = TREES, depth: int = DEPTH, bins: int = BINS, rate: float = RATE) -> Trees:
    """Boosted trees for labels 0/1.  With no rows, or labels of one kind, a constant (0.5, or near the kind)."""
    share = (y.sum() + 0.5) / (len(y) + 1)
    prior = float(np.log(share / (1 - share)))
    inner, leaves = 2**depth - 1, 2**depth
    if not len(y) or y.min() == y.max():
        return Trees(prior, np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, leaves)))
    n, width = x.shape
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(width)]
    binned = np.stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(edges)]).astype(np.int64)
    cut = np.full((width, bins), np.inf)  # bin b or less: x <= cut
    for f, e in enumerate(edges):
        cut[f, : len(e)] = e
    margin = np.full(n, prior)
    made: list[tuple] = []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        feature, threshold = np.zeros(inner, np.int64), np.full(inner, np.inf)
        at = np.zeros(n, np.int64)
        for level in range(depth):
            low, many = 2**level - 1, 2**level
            local = at - low
            gs, hs = (np.stack([np.bincount(local * bins + b, w, many * bins).reshape(many, bins) for b in binned]) for w in (g, h))
            gl, hl = gs.cumsum(2), hs.cumsum(2)
            gt, ht = gl[:, :, -1:], hl[:, :, -1:]
            gain = gl**2 / (hl + RIDGE) + (gt - gl) ** 2 / (ht - hl + RIDGE) - gt**2 / (ht + RIDGE)
            gain[(hl < LEAST_WEIGHT) | (ht - hl < LEAST_WEIGHT)] = 0
            gain[~np.isfinite(cut)[:, None, :].repeat(many, 1)] = 0
            flat = gain.transpose(1, 0, 2).reshape(many, -1)
            best = flat.argmax(1)
            f, b = best // bins, best % bins
            good = flat[np.arange(many), best] > 1e-6
            feature[low : low + many] = np.where(good, f, 0)
            threshold[low : low + many] = np.where(good, cut[f, b], np.inf)
            right = (binned[f[local], np.arange(n)] > b[local]) & good[local]
            at = 2 * at + 1 + right
        leaf = at - inner
        value = -rate * np.bincount(leaf, g, leaves) / (np.bincount(leaf, h, leaves) + RIDGE)
        margin += value[leaf]
        made.append((feature, threshold, value))
    return Trees(prior, *(np.stack(z) for z in zip(*made)))


# ---------------------------------------------------------------- tables


def held_out(id_col: str, parts: int, part: int) -> Column:
    """Whether crc32 of the id as text falls into the part kept from learning; false for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % parts == part, F.lit(False))


def sample_labels(labels: DataFrame, label: str, held: Column, most: int) -> DataFrame:
    """doc_id, _y of at most `most` labelled ids, in an order hashed from the id.  Ids with
    contradicting labels count as the majority says; null ids and labels take no part."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & ~held)
    each = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.avg(label) >= 0.5).cast("int").alias("_y"))
    return each.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)


def fit(docs: DataFrame, labels: DataFrame, *, label: str = "quality", most: int = FIT_ROWS, parts: int = 4, part: int = 2) -> Trees:
    """Trees from documents whose label may be learned from (not those of the held-out part).
    The driver gets statistics of `most` documents at most, never texts."""

    @F.arrow_udf("array<double>")
    def measure(texts: pa.Array) -> pa.Array:
        x = column_statistics(texts)
        return pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64()))

    chosen = sample_labels(labels, label, held_out("doc_id", parts, part), most)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id")
    measured = rows.select("doc_id", "_y", measure("text").alias("x"))
    with arrow_rows(docs.sparkSession, *BATCH):
        table = measured.groupBy("doc_id").agg(F.min("_y").alias("y"), F.min("x").alias("x")).orderBy("doc_id").toArrow()
    if not table.num_rows:
        return grow(np.zeros((0, len(STATISTICS))), np.zeros(0))
    x = table.column("x").combine_chunks()
    x = (x if isinstance(x, pa.Array) else x.chunk(0)).flatten().to_numpy().reshape(-1, len(STATISTICS))
    return grow(x, table.column("y").to_numpy().astype(float))


def score_column(model: Trees, text: str = "text") -> Column:
    """Score of each text, 0 to 1; an empty or null text has the score of empty statistics."""

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        return pa.array(model.score(column_statistics(texts)))

    return score(text)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every document, in one pass and without a shuffle.

    Null texts count as empty; a null id isn't held out; repeated rows stay;
    further columns are left out.  Without usable labels every score is 0.5; an
    empty table gives no rows.
    """
    model = fit(docs, labels)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out("doc_id", 4, 2).alias("held_out"), score_column(model).alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents (all columns) that the classifier doesn't reject; where no label can be learned from, all.
    They are written here, as batches keep their bounds only for what runs here."""
    model = fit(docs, labels)
    if not len(model.feature):
        return docs
    with arrow_rows(docs.sparkSession, *BATCH):
        return written(docs.where(score_column(model) >= THRESHOLD), "good")
