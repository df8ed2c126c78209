"""Benchmark decontamination with suffix arrays over the training text.

Training text is cut into shards (runs of documents of a few megabytes).  Each
shard's words make a suffix array, by prefix doubling on ranks; suffixes are
ordered by their first 16 words, more than a window has.  Every suffix of every
benchmark item, cut to a window of 13 words (a shorter item: as a whole), is
found in each shard by a binary search over all suffixes at once; the range it
finds is all its places.  Places on one diagonal (text position minus item
position) that follow one another make the longest verbatim matches.

Words compare by 64-bit hashes; documents end with a mark that no word equals.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from stratagraph.llm import words
from stratagraph.llm.common import give_back, written

WINDOW = 13
#: contaminated: some word is hit, and 20 * hits >= words.
SHARE = 20
#: Text of benchmark items that one pass takes to every shard; a larger benchmark goes in several passes.
PASS_BYTES = 16 << 20


@dataclass
class Windows:
    """Test suffixes cut to windows: hashes of all items' words, and of each window the first word, length, item
    number and place in the item."""

    words: np.ndarray
    start: np.ndarray
    lengths: np.ndarray
    item: np.ndarray
    place: np.ndarray
    names: list[str]


def windows(items: list[tuple[str, str | None]]) -> Windows:
    buf, offsets = words.text_bytes(pa.array([t for _, t in items], pa.string()))
    low, starts, ends, first = words.split(buf, offsets, words.ALNUM)
    hashes = np.maximum(words.word_hashes(low, starts, ends), np.uint64(1))
    n = np.diff(first)
    many = np.where(n >= WINDOW, n - WINDOW + 1, np.minimum(n, 1))
    at = words.ranges(first[:-1], many)
    item = np.repeat(np.arange(len(n)), many)
    return Windows(hashes, at, np.minimum(n[item], WINDOW), item, at - first[:-1][item], [name for name, _ in items])


def suffix_array(tokens: np.ndarray) -> np.ndarray:
    """Positions in order of their first 16 tokens (beyond the end: the smallest)."""
    n = len(tokens)
    order = np.argsort(tokens)
    step = 1
    ranks = _ranks(tokens[order], order)
    while step < 16 and n:
        after = np.zeros(n, np.uint64)
        after[: max(0, n - step)] = ranks[step:]
        keys = ranks << np.uint64(32) | after
        order = np.argsort(keys)
        ranks = _ranks(keys[order], order)
        step *= 2
    return order


def _ranks(ordered: np.ndarray, order: np.ndarray) -> np.ndarray:
    ranks = np.empty(len(order), np.uint64)
    ranks[order] = np.concatenate([[1], 1 + np.cumsum(ordered[1:] != ordered[:-1])]) if len(order) else 0
    return ranks


def find(tokens: np.ndarray, order: np.ndarray, tests: Windows) -> tuple[np.ndarray, np.ndarray]:
    """[low, high) in the suffix array for each window, all binary searches in step."""
    padded = np.concatenate([tokens, np.zeros(WINDOW, np.uint64)])

    def search(beyond: bool) -> np.ndarray:
        low, high = np.zeros(len(tests.start), np.int64), np.full(len(tests.start), len(order), np.int64)
        while (todo := np.flatnonzero(low < high)).size:
            mid = (low[todo] + high[todo]) >> 1
            at = order[mid]
            less, same = np.zeros(len(todo), bool), np.ones(len(todo), bool)
            for k in range(WINDOW):
                live = np.flatnonzero(same & (tests.lengths[todo] > k))
                if not live.size:
                    break
                have, want = padded[at[live] + k], tests.words[tests.start[todo[live]] + k]
                less[live] = have < want
                same[live] = have == want
            right = less | same if beyond else less
            low[todo[right]], high[todo[~right]] = mid[right] + 1, mid[~right]
        return low

    return search(False), search(True)


@dataclass
class Hits:
    """A shard's documents: words, hit words, and per document its items and longest match
    (words, item number, word position)."""

    n_words: np.ndarray
    n_hit: np.ndarray
    items: list[np.ndarray]
    longest: np.ndarray
    ranges: list[np.ndarray]


def shard_hits(buf: np.ndarray, offsets: np.ndarray, tests: Windows) -> Hits:
    low, starts, ends, first = words.split(buf, offsets, words.ALNUM)
    n = np.diff(first)
    docs = len(n)
    out = Hits(n, np.zeros(docs, np.int64), [np.zeros(0, np.int64)] * docs, np.zeros((docs, 3), np.int64), [np.zeros((0, 2), np.int64)] * docs)
    if not len(tests.start) or not len(starts):
        return out
    heads = first[:-1] + np.arange(docs)  # a mark follows each document
    tokens = np.zeros(len(starts) + docs, np.uint64)
    tokens[words.ranges(heads, n)] = np.maximum(words.word_hashes(low, starts, ends), np.uint64(1))
    order = suffix_array(tokens)
    a, b = find(tokens, order, tests)
    which = np.repeat(np.arange(len(a)), b - a)
    places = order[words.ranges(a, b - a)]
    if not len(places):
        return out
    cover = np.zeros(len(tokens) + 1, np.int64)
    np.add.at(cover, places, 1)
    np.subtract.at(cover, places + tests.lengths[which], 1)
    hit = np.concatenate([[0], np.cumsum(np.cumsum(cover[:-1]) > 0)])
    out.n_hit = hit[heads + n] - hit[heads]
    doc = np.searchsorted(heads, places, "right") - 1
    item = tests.item[which]
    diagonal = places - tests.place[which]
    by = np.lexsort((places, diagonal, item))
    places, diagonal, item, doc, long = places[by], diagonal[by], item[by], doc[by], tests.lengths[which][by]
    new = np.ones(len(by), bool)
    new[1:] = (item[1:] != item[:-1]) | (diagonal[1:] != diagonal[:-1]) | (places[1:] != places[:-1] + 1)
    runs = np.flatnonzero(new)
    size = np.diff(np.append(runs, len(by))) + long[runs] - 1
    best = np.lexsort((places[runs], -size, doc[runs]))
    for d, group in _groups(doc[runs][best], best):
        top = runs[group[0]]
        out.longest[d] = size[group[0]], item[top], places[top] - heads[d]
        out.items[d] = np.unique(item[runs[group]])
        out.ranges[d] = np.stack([places[runs[group]] - heads[d], places[runs[group]] - heads[d] + size[group]], 1)
    return out


def _groups(keys: np.ndarray, values: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    cuts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else []
    for i, c in enumerate(cuts):
        yield int(keys[c]), values[c : cuts[i + 1] if i + 1 < len(cuts) else len(keys)]


def _slices(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    buf, offsets = words.text_bytes(texts)
    for i, j in words.slices(offsets):
        yield i, j, buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]


RESULT = "id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, longest_match long, longest_item string, longest_at long"
_FOUND = "row long, id long, n_words long, ranges array<array<long>>, items array<string>, longest_match long, longest_item string, longest_at long"
_KINDS = {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_(), "array<array<long>>": pa.list_(pa.list_(pa.int64())), "array<string>": pa.list_(pa.string())}


def _target(schema: str) -> pa.Schema:
    return pa.schema([(x.split(" ", 1)[0], _KINDS[x.split(" ", 1)[1]]) for x in schema.split(", ")])


def _summary(record_id, n_words: int, n_hit: int, items: list[str], longest: tuple) -> dict:
    own = sorted(set(items))
    return {"id": record_id, "n_words": n_words, "n_hit": n_hit, "n_items": len(own), "items_sha256": hashlib.sha256(",".join(own).encode()).hexdigest(), "contaminated": n_hit > 0 and SHARE * n_hit >= n_words} | dict(zip(("longest_match", "longest_item", "longest_at"), longest))


def _passes(benchmark: DataFrame) -> tuple[int, Callable[[int], Windows]]:
    """In how many passes the benchmark goes, and a function that collects the windows of one of them: text of
    PASS_BYTES, about.  Identical rows count once."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("i"), F.col("text").alias("t")).where("t is not null").distinct()
    size = items.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    n = -(-size // PASS_BYTES) or 1
    part = F.pmod(F.xxhash64("i", "t"), F.lit(n))
    return n, lambda k: windows(sorted((r["i"], r["t"]) for r in items.where(part == k).toLocalIterator()))


def scan(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: words, hit words, items (count and digest of their ids), whether it is
    contaminated, and its longest verbatim match of a window or more (words, item, first word from 0; 0 and
    nulls if there is none: runs of fewer words than a window aren't matches).

    A null or empty text has no words and isn't contaminated; a null or empty
    item makes no window; an item without an id counts as "null".  Repeated
    rows and rows without an id stay.  Further columns are left out.
    """
    n, collect = _passes(benchmark)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    if n > 1:
        return _merged(_numbered(rows), n, collect).drop("row")
    return rows.mapInArrow(_matcher(docs.sparkSession.sparkContext.broadcast(collect(0)), False), RESULT)


def _numbered(docs: DataFrame) -> DataFrame:
    """The rows with a number of their own, `row`, written so that every pass reads the same numbers."""
    return written(docs.withColumn("row", F.monotonically_increasing_id()), "numbered")


def _matcher(sent: Broadcast, found: bool):
    """A pass over id and text, or for several passes (`found`) over row, id and text."""
    target = _target(_FOUND if found else RESULT)

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tests = sent.value
        for b in batches:
            ids = words.column(b, "id").to_pylist()
            numbers = words.column(b, "row").to_pylist() if found else None
            for i, j, buf, offsets in _slices(words.column(b, "text")):
                hits = shard_hits(buf, offsets, tests)
                made = []
                for d in range(j - i):
                    items = [tests.names[x] for x in hits.items[d].tolist()]
                    size, item, at = hits.longest[d].tolist()
                    longest = (size, tests.names[item], at) if size else (0, None, None)
                    if found:
                        made.append(dict(zip(target.names, (numbers[i + d], ids[i + d], int(hits.n_words[d]), hits.ranges[d].tolist(), items, *longest))))
                    else:
                        made.append(_summary(ids[i + d], int(hits.n_words[d]), int(hits.n_hit[d]), items, longest))
                yield pa.RecordBatch.from_pylist(made, schema=target)

    return take


def _merged(rows: DataFrame, n: int, collect: Callable[[int], Windows]) -> DataFrame:
    """row and scan()'s columns of each row of row, id, text, hits of all passes counted together.  A pass is a
    job of its own, so only its windows are held at a time."""
    everything = None
    for k in range(n):
        sent = rows.sparkSession.sparkContext.broadcast(collect(k))
        each = written(rows.select("row", "id", "text").mapInArrow(_matcher(sent, True), _FOUND), "pass")
        sent.destroy()
        everything = each if everything is None else everything.union(each)

    def merge(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        found = table.to_pylist()
        spans, n_hit, end = sorted(tuple(r) for x in found for r in x["ranges"]), 0, 0
        for a, b in spans:
            n_hit += max(0, b - max(a, end))
            end = max(end, b)
        top = max(found, key=lambda x: x["longest_match"])
        summary = _summary(found[0]["id"], found[0]["n_words"], n_hit, [i for x in found for i in x["items"]], (top["longest_match"], top["longest_item"], top["longest_at"]))
        return pa.Table.from_pylist([{"row": key[0].as_py()} | summary], schema=_target(f"row long, {RESULT}"))

    return everything.groupBy("row").applyInArrow(merge, f"row long, {RESULT}")


def clean_column(sent: Broadcast, text: str = "text") -> Column:
    """Whether a text isn't contaminated by one pass's windows."""

    @F.arrow_udf(BooleanType())
    def clean(texts: pa.Array) -> pa.Array:
        flags = [np.zeros(0, bool)]
        for _, _, buf, offsets in _slices(texts):
            hits = shard_hits(buf, offsets, sent.value)
            flags.append(~((hits.n_hit > 0) & (SHARE * hits.n_hit >= hits.n_words)))
        give_back()
        return pa.array(np.concatenate(flags))

    return clean(text)


def remove_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents (all columns) that aren't contaminated.  Of a benchmark of several passes, hits of
    all passes count together, row by row."""
    n, collect = _passes(benchmark)
    if n == 1:
        return docs.where(clean_column(docs.sparkSession.sparkContext.broadcast(collect(0))))
    numbered = _numbered(docs.select(F.struct(*docs.columns).alias("doc")))
    rows = numbered.select("row", F.col("doc.doc_id").cast("long").alias("id"), F.col("doc.text").alias("text"))
    bad = _merged(rows, n, collect).where("contaminated").select("row")
    return numbered.join(bad, "row", "left_anti").select("doc.*")
