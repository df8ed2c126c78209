"""Toxicity by compression distance: two zstandard dictionaries and calibrated window lengths.

Each text is cut into windows of a few words.  A window is compressed plainly,
with a dictionary of toxic text and with one of ordinary text; what a dictionary
saves says how near the window is to that text.  A document is as toxic as its
most toxic windows: the largest savings are calibrated to a score by logistic
regression on labelled documents that didn't serve for the dictionaries.

The ordinary dictionary is zstandard's own training on ordinary windows.  That
training spends a toxic dictionary on the neutral words around insults (area under
the curve at sf0.1: 0.7; trained on just the words that hold significant spans:
0.81; as built here: 0.97), so the toxic one is raw content instead: byte spans
that are significantly more frequent in toxic documents than in ordinary ones,
the most frequent nearest to the data.  Every window ends with a pad that all
dictionaries hold: zstandard then always has a compressed block to write, and
each further match shows in the length (without it short windows stay raw).
"""

from __future__ import annotations

import random
from collections import Counter
from collections.abc import Iterable
from dataclasses import dataclass
from math import log

import numpy as np
import pyarrow as pa
import xxhash
import zstandard as zs
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratagraph.llm import words
from stratagraph.llm.quality import held_out

#: Documents per class that make dictionaries (toxic, ordinary) and that calibrate at most, and
#: bytes of a text that a fit takes; scoring has no such bounds.
DICTIONARY_ROWS, CALIBRATION_ROWS, FIT_BYTES = (1500, 3000), 12_000, 20_000
WINDOW, GRAM, CONTENT, ORDINARY_CONTENT = 3, 5, 2048, 2048
THRESHOLD = 0.7
PAD = bytes(random.Random(5).randrange(1, 32) for _ in range(48))


# ---------------------------------------------------------------- windows


def _windows(buf: np.ndarray, offsets: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray]:
    """(data, window lengths, first window of each text and the total).  data holds, for each
    run of WINDOW words: a space, the run's bytes, the pad."""
    low, starts, ends, first = words.split(buf, offsets, words.SPACED)
    counts = np.diff(first)
    many = -(-counts // WINDOW)
    at = np.concatenate([[0], np.cumsum(many)])
    head = words.ranges(np.zeros(len(many), np.int64), many) * WINDOW + np.repeat(first[:-1], many)
    tail = np.minimum(head + WINDOW, np.repeat(first[1:], many)) - 1
    begin, size = starts[head], ends[tail] - starts[head]
    lengths = size + 1 + len(PAD)
    spots = np.cumsum(lengths) - lengths
    data = np.empty(int(lengths.sum()), np.uint8)
    data[spots] = 32
    for k, byte in enumerate(PAD):
        data[spots + 1 + size + k] = byte
    data[words.ranges(spots + 1, size)] = low[words.ranges(begin, size)]
    return data.tobytes(), lengths, at


@dataclass
class Model:
    """toxic, ordinary: dictionary contents; weights: of the calibration (a constant first)."""

    toxic: bytes
    ordinary: bytes
    weights: np.ndarray

    def compressors(self) -> list[zs.ZstdCompressor]:
        parameters = zs.ZstdCompressionParameters(
            window_log=17, hash_log=12, chain_log=12, search_log=3, min_match=GRAM, target_length=0, strategy=zs.STRATEGY_LAZY,
            write_content_size=0, write_checksum=0, write_dict_id=0, format=zs.FORMAT_ZSTD1_MAGICLESS,
        )
        content = (PAD, self.toxic + PAD, self.ordinary + PAD)
        return [zs.ZstdCompressor(dict_data=zs.ZstdCompressionDict(c, dict_type=zs.DICT_TYPE_RAWCONTENT), compression_params=parameters) for c in content]


#: Savings whose windows are counted.
LEVELS = (3, 4, 5, 6)
FEATURES = 5 + 2 * len(LEVELS)
#: Occurrences in a document that count, and the bar of the likelihood ratio (a logarithm).
OCCURRENCES, BAR = 4, 25


def features(texts: pa.Array, compressors: list[zs.ZstdCompressor]) -> np.ndarray:
    """Per text: the two largest savings by the toxic dictionary, the two largest leads over the
    ordinary one, the logarithm of the windows, and for each of LEVELS the windows that save as
    much, as a logarithm and in tenths of the windows; zeros without words."""
    buf, offsets = words.text_bytes(texts)
    out = []
    for i, j in words.slices(offsets, 1_000_000):
        data, lengths, at = _windows(buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        x = np.zeros((j - i, FEATURES))
        if len(lengths):
            segments = np.stack([np.cumsum(lengths) - lengths, lengths], 1).astype("<u8").tobytes()
            plain, toxic, ordinary = (np.fromiter(map(len, c.multi_compress_to_buffer(zs.BufferWithSegments(data, segments))), np.int64, len(lengths)) for c in compressors)
            saved, ahead = plain - toxic, ordinary - toxic
            for d in np.flatnonzero(np.diff(at)):
                a, b = at[d], at[d + 1]
                many = [(saved[a:b] >= k).sum() for k in LEVELS]
                x[d] = (*_top_two(saved[a:b]), *_top_two(ahead[a:b]), np.log1p(b - a), *np.log1p(many), *(10 * np.array(many) / (b - a)))
        out.append(x)
    return np.concatenate(out) if out else np.zeros((0, FEATURES))


def _top_two(x: np.ndarray) -> tuple[float, float]:
    if len(x) == 1:
        return float(x[0]), 0.0
    top = np.partition(x, len(x) - 2)[-2:]
    return float(top[1]), float(top[0])


def _design(x: np.ndarray) -> np.ndarray:
    """A constant and steps of the savings (lengths are small integers, so each level has its own weight), and
    the numbers and shares of windows, on scales on which the ridge penalty lets them count."""
    steps = ((x[:, k : k + 1] >= np.arange(2, 11)) for k in range(4))
    return np.column_stack([np.ones(len(x)), *steps, x[:, :5] / 10, x[:, 5 : 5 + len(LEVELS)], np.log1p(10 * x[:, 5 + len(LEVELS) :])]).astype(float)


def score(model: Model, x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(_design(x) @ model.weights, -50, 50)))


# ---------------------------------------------------------------- fit


def _spread(texts: Iterable[str]) -> list[bytes]:
    """Texts that don't share one of their eight smallest shingle hashes with an earlier one:
    a family of near copies counts once, so its chance words don't look significant."""
    seen: set[int] = set()
    out = []
    for text in texts:
        w = text.lower().split()
        smallest = sorted({xxhash.xxh64_intdigest(" ".join(w[i : i + 5])) for i in range(max(1, len(w) - 4))})[:8]
        if seen.isdisjoint(smallest):
            out.append(" ".join(w).encode())
        seen.update(smallest)
    return out


def _word_grams(text: bytes) -> dict[bytes, list[bytes]]:
    out = {}
    for w in set(text.split()):
        v = b" " + w + b" "
        out[v] = [v[i : i + GRAM] for i in range(len(v) - GRAM + 1)]
    return out


def gram_counts(texts: list[bytes]) -> tuple[Counter, Counter]:
    """Of the grams: documents that hold them, and words that do, OCCURRENCES of a document at most."""
    documents, words_of = Counter(), Counter()
    for t in texts:
        own: Counter = Counter()
        many = Counter(b" " + w + b" " for w in t.split())
        for v, grams in _word_grams(t).items():
            for g in set(grams):
                own[g] += many[v]
        documents.update(own.keys())
        words_of.update({g: min(n, OCCURRENCES) for g, n in own.items()})
    return documents, words_of


def toxic_content(toxic: list[bytes], ordinary: list[bytes]) -> bytes:
    """Spans of words whose every GRAM bytes are significantly more frequent in toxic documents."""
    (documents, seen_in), (_, others) = gram_counts(toxic), gram_counts(ordinary)
    n, m = max(1, len(toxic)), max(1, len(ordinary))
    least = max(4, n / 200)

    def significant(g: bytes) -> bool:
        """In enough documents, four times as often as in ordinary text, and beyond what chance makes of some
        100,000 candidates, several of a document (a Poisson likelihood ratio of exp(BAR))."""
        seen, expected = seen_in[g], n * (others[g] + 1) / m
        return documents[g] >= least and seen >= 4 * expected and seen * log(seen / expected) - (seen - expected) >= BAR

    good = {g for g in documents if significant(g)}
    spans: Counter = Counter()
    for t in toxic:
        own = set()
        for word, grams in _word_grams(t).items():
            at = 0
            while at < len(grams):
                end = at
                while end < len(grams) and grams[end] in good:
                    end += 1
                if end > at:
                    own.add(word[at : end - 1 + GRAM])
                at = max(end, at + 1)
        spans.update(own)
    kept: list[bytes] = []
    for span, seen in sorted(spans.items(), key=lambda x: (-x[1], x[0])):
        if seen >= least and not any(span in k for k in kept):
            kept.append(span)
    return b"".join(reversed(kept))[-CONTENT:]


def ordinary_content(ordinary: list[bytes]) -> bytes:
    windows = [b" ".join(w[i : i + 8]) for w in (t.split() for t in ordinary) for i in range(0, len(w), 8)]
    try:
        return zs.train_dictionary(2 * ORDINARY_CONTENT, windows, k=32, d=6).as_bytes()[-ORDINARY_CONTENT:]
    except zs.ZstdError:  # too few windows to train on
        return b" ".join(windows)[-ORDINARY_CONTENT:]


def calibrate(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Ridge logistic regression by Newton steps; a constant for no rows or labels of one kind."""
    a = _design(x)
    share = (y.sum() + 0.5) / (len(y) + 1)
    w = np.zeros(a.shape[1])
    w[0] = np.log(share / (1 - share))
    if not len(y) or y.min() == y.max():
        return w
    penalty = np.full(a.shape[1], 0.3)
    penalty[0] = 1e-3

    def loss(w: np.ndarray) -> float:
        z = a @ w
        return float(np.logaddexp(0, z).sum() - y @ z + (penalty * w * w).sum() / 2)

    now = loss(w)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve(a.T @ (a * (p * (1 - p))[:, None]) + np.diag(penalty), a.T @ (y - p) - penalty * w)
        while loss(w + step) > now and np.abs(step).max() > 1e-9:  # a full step may overshoot
            step = step / 2
        w = w + step
        before, now = now, loss(w)
        if before - now < 1e-9:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, *, label: str = "toxic", parts: int = 3, part: int = 1) -> Model:
    """Dictionaries and calibration from bounded samples of labelled rows outside of the held-out part.

    Of each class, in an order hashed from the id, two of three documents may serve for the
    dictionaries (DICTIONARY_ROWS at most) and the third for the calibration (CALIBRATION_ROWS over
    both classes at most); texts of more than FIT_BYTES don't serve for dictionaries.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & ~held_out("doc_id", parts, part))
    each = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.avg(label) >= 0.5).cast("int").alias("_y"))
    key = F.xxhash64("doc_id")
    most = 4 * max(*DICTIONARY_ROWS, CALIBRATION_ROWS // 2)  # of either class, however rare
    some = [each.where(F.col("_y") == y).orderBy(key, "doc_id").limit(most) for y in (0, 1)]
    chosen = some[0].union(some[1]).withColumn("_role", F.when(F.pmod(key, F.lit(3)) < 2, "dictionary").otherwise("calibration"))
    ranked = chosen.withColumn("_rank", F.row_number().over(Window.partitionBy("_role", "_y").orderBy(key, "doc_id")))
    for_dictionary = F.when(F.col("_y") == 1, F.col("_rank") <= DICTIONARY_ROWS[0]).otherwise(F.col("_rank") <= DICTIONARY_ROWS[1])
    picked = ranked.where(F.when(F.col("_role") == "dictionary", for_dictionary).otherwise(F.col("_rank") <= CALIBRATION_ROWS // 2)).drop("_rank")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(picked), "doc_id")
    made = rows.where((F.col("_role") == "dictionary") & (F.octet_length("text") <= FIT_BYTES)).groupBy("doc_id").agg(F.min("_y").alias("y"), F.min("text").alias("t")).orderBy(key).toArrow().to_pylist()
    toxic, ordinary = (_spread(r["t"] for r in made if r["y"] == y) for y in (1, 0))
    model = Model(toxic_content(toxic, ordinary), ordinary_content(ordinary), np.zeros(0))
    measure = _measure(model)
    table = rows.where(F.col("_role") == "calibration").select("doc_id", "_y", measure("text").alias("x")).groupBy("doc_id").agg(F.min("_y").alias("y"), F.min("x").alias("x")).orderBy("doc_id").toArrow()
    x = np.array(table.column("x").to_pylist(), float).reshape(-1, FEATURES)
    model.weights = calibrate(x, table.column("y").to_numpy().astype(float))
    return model


def _measure(model: Model):
    @F.arrow_udf("array<double>")
    def measure(texts: pa.Array) -> pa.Array:
        x = features(texts, model.compressors())
        return pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), FEATURES).cast(pa.list_(pa.float64()))

    return measure


def score_column(model: Model, text: str = "text") -> Column:
    """Score of each whole text, 0 to 1; an empty or null one has the score of no savings."""

    @F.arrow_udf("double")
    def scored(texts: pa.Array) -> pa.Array:
        return pa.array(score(model, features(texts, model.compressors())))

    return scored(text)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every document, in one pass and without a shuffle.

    Null texts count as empty; a null id isn't held out; repeated rows stay;
    further columns are left out.  Without usable labels every score is 0.5 (of
    one kind only: near that kind); an empty table gives no rows.
    """
    model = fit(docs, labels)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out("doc_id", 3, 1).alias("held_out"), score_column(model).alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
