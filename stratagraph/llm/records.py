"""Token-ID output: length-delimited binary records with an offset index.

A shard file is a sequence of frames.  Fixed values of the format::

    u64  payload length                      (little-endian)
    u32  masked crc32 of those eight bytes
    ...  payload
    u32  masked crc32 of the payload
    0x0A end of frame

    payload: u8 flags (1: no id, 2: 32-bit tokens), i64 record id, token ids (u16 or u32)

The checksum is zlib's crc32, masked as ((c >> 15 | c << 17) + 0xA282EAD8) mod 2**32,
so that checksums of data that holds checksums stay strong.

Frames are made in Python, but Spark's own writer puts them into files (a text
column of raw bytes, whose line separator is the frame's last byte).  So shards
are committed by task, may lie in any store that Spark writes to, and survive
lost executors.  Shard numbers follow the order of the record ids; inside a
shard, records ascend.  The index is a Parquet table beside the shards: one row
a record with shard, position, byte offset, length, id and token count.  A
shuffled read permutes index rows and takes frames by offset.
"""

from __future__ import annotations

import itertools
import json
import os
import struct
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stratagraph.llm import words
from stratagraph.llm.common import arrow_rows, partitions, written

NO_ID, WIDE = 1, 2
_HEAD = struct.Struct("<QI")
_PAYLOAD = struct.Struct("<Bq")
_CHECK = struct.Struct("<I")


def masked(data) -> int:
    c = zlib.crc32(data)
    return ((c >> 15 | c << 17) + 0xA282EAD8) & 0xFFFFFFFF


def frame(record_id: int | None, tokens: np.ndarray) -> bytes:
    """One record without the frame's last byte, which the writer adds."""
    payload = _PAYLOAD.pack((record_id is None) * NO_ID + (tokens.itemsize == 4) * WIDE, record_id or 0) + tokens.tobytes()
    size = struct.pack("<Q", len(payload))
    return size + _CHECK.pack(masked(size)) + payload + _CHECK.pack(masked(payload))


def frames(content, whole: bool = True) -> Iterator[tuple[int, int, int | None, np.ndarray]]:
    """(offset, frame length, record id, tokens as u32) of each record of a shard.  ValueError for a
    damaged frame.  whole: nothing follows, so a frame cut off at the end is damaged too; else it is left."""
    at, view = 0, memoryview(content)
    while at < len(view):
        if at + _HEAD.size > len(view):
            if not whole:
                return
            raise ValueError(f"record at {at}: cut off")
        length, check = _HEAD.unpack_from(view, at)
        if masked(view[at : at + 8]) != check:
            raise ValueError(f"record at {at}: bad length checksum")
        body = view[at + _HEAD.size : at + _HEAD.size + length]
        end = at + _HEAD.size + length
        if end + 5 > len(view) and not whole:
            return
        if end + 5 > len(view) or masked(body) != _CHECK.unpack_from(view, end)[0] or view[end + 4] != 10:
            raise ValueError(f"record at {at}: bad payload checksum")
        flags, record_id = _PAYLOAD.unpack_from(body, 0)
        tokens = np.frombuffer(body[_PAYLOAD.size :], "<u4" if flags & WIDE else "<u2").astype("<u4")
        yield at, end + 5 - at, None if flags & NO_ID else record_id, tokens
        at = end + 5


def frames_of_pieces(pieces: Iterable[tuple[bytes, bool]]) -> Iterator[list[tuple[int, int, int | None, np.ndarray]]]:
    """What frames() gives, from a shard's pieces (bytes, whether it is the last): a list for each piece that
    ends a frame.  Only a frame that a piece cuts is held until its rest has come."""
    base, held, size, need = 0, [], 0, 0
    for piece, last in pieces:
        held.append(piece)
        size += len(piece)
        if size < need and not last:
            continue
        content = b"".join(held)
        found = [(base + at, length, record_id, tokens) for at, length, record_id, tokens in frames(content, last)]
        used = sum(length for _, length, _, _ in found)
        base, held, size = base + used, [content[used:]], size - used
        need = _HEAD.size + _HEAD.unpack_from(held[0])[0] + 5 if size >= _HEAD.size else 0
        if found:
            yield found


#: Distinct pieces whose ids a worker keeps; beyond it the memory starts anew.
KEPT_PIECES = 1_000_000
#: New pieces that are kept apart before they are merged into the large level.
_FRESH = 65_536


class Pieces:
    """Ids of pieces by two 64-bit hashes: arrays in order of the first, in a large and a fresh level."""

    def __init__(self, kind: np.dtype):
        self.kind = kind
        self.clear()

    def clear(self) -> None:
        none = np.zeros(0, np.uint64)
        empty = none, none, np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, self.kind)
        self.levels = [empty, empty]

    def __len__(self) -> int:
        return sum(len(level[0]) for level in self.levels)

    def find(self, keys: np.ndarray, checks: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(positions of keys that a level holds, their counts, heads, the level's ids) of each level."""
        for known, check, counts, heads, table in self.levels:
            if len(known):
                at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
                held = np.flatnonzero((known[at] == keys) & (check[at] == checks))
                yield held, counts[at[held]], heads[at[held]], table

    def add(self, keys: np.ndarray, checks: np.ndarray, counts: np.ndarray, ids: np.ndarray) -> None:
        heads = np.cumsum(counts, dtype=np.int64) - counts
        level = 0 if len(self.levels[1][0]) + len(keys) > _FRESH else 1
        parts = self.levels if level == 0 else self.levels[1:]
        offset, own = 0, []
        for part in (*parts, (keys, checks, counts.astype(np.int32), heads, ids)):
            own.append((*part[:3], part[3] + offset, part[4]))
            offset += len(part[4])
        known, check, many, at, table = (np.concatenate(x) for x in zip(*own))
        order = np.argsort(known, kind="stable")
        self.levels[level] = known[order], check[order], many[order], at[order], table
        if level == 0:
            none = np.zeros(0, np.uint64)
            self.levels[1] = none, none, np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, self.kind)


def _space_before() -> tuple[np.ndarray, np.ndarray]:
    space = np.zeros(256, bool)
    space[[0x20, *range(0x09, 0x0E)]] = True
    tail = np.zeros(256, bool)  # last bytes of wider white space
    tail[[0x85, 0xA0, *range(0x80, 0x8B), 0xA8, 0xA9, 0xAF, 0x9F]] = True
    return space, tail


_SPACE, _TAIL = _space_before()
_LEAD = np.zeros(256, bool)  # bytes before those
_LEAD[[0xC2, 0x9A, 0x80, 0x81]] = True
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_MARK = np.zeros(256, bool)  # ASCII punctuation but for the apostrophe, which may open a contraction
_MARK[[x for x in range(33, 127) if not chr(x).isalnum() and chr(x) != "'"]] = True


def _pieces(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of white space with the word behind it, and of marks behind a letter.  A
    byte-level pre-tokenizer never joins a character with white space that follows it, nor a
    letter with a mark that follows it, so pieces are encoded alike alone."""
    space = _SPACE[buf]
    cut = np.zeros(len(buf), bool)
    cut[1:] = space[1:] & ~space[:-1]
    wide = np.zeros(len(buf), bool)
    wide[2:] = cut[2:] & _TAIL[buf[1:-1]] & _LEAD[buf[:-2]]
    cut &= ~wide
    cut[1:] |= _MARK[buf[1:]] & _LETTER[buf[:-1]]
    cut[offsets[:-1][offsets[:-1] < len(buf)]] = True
    starts = np.flatnonzero(cut)
    return starts, np.append(starts[1:], len(buf)) if len(starts) else starts


class Encoder:
    """A tokenizer and what a worker keeps of it.  special_as_text: strings of special tokens inside
    of texts are ordinary text; else they give the special id, as the library's default is."""

    def __init__(self, path: str, special_as_text: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the task has one core; further threads would hold memory of their own
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = special_as_text
        made = json.loads(self.tokenizer.to_str())
        before = made.get("pre_tokenizer") or {}
        #: Only this kind parts texts where _pieces() does; others take whole texts.
        self.in_pieces = before.get("type") == "ByteLevel" and before.get("use_regex") and not before.get("add_prefix_space") and not made.get("normalizer") and made["model"].get("type") == "BPE"
        added = made.get("added_tokens") or []
        self.in_pieces = self.in_pieces and all(t["special"] and not t["normalized"] for t in added)
        self.special = [] if special_as_text else [t["content"].encode() for t in added]
        size = self.tokenizer.get_vocab_size()
        self.kind = np.dtype("<u4" if size > 1 << 16 else "<u2")
        self.long = np.fromiter((len(self.tokenizer.id_to_token(i) or "") for i in range(size)), np.int64, size)
        self.pieces = Pieces(self.kind)

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, self.kind) for t in texts for e in self.tokenizer.encode_batch_fast([t], add_special_tokens=False)]

    def encode(self, buf: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
        """Ids of each text.  Each distinct piece is encoded once."""
        data = buf.tobytes()
        text = lambda d: data[offsets[d] : offsets[d + 1]].decode()
        docs = len(offsets) - 1
        if not self.in_pieces:
            return self.whole([text(d) for d in range(docs)])
        out = self._in_pieces(buf, offsets)
        if out is None:
            return self.whole([text(d) for d in range(docs)])
        if any(s in data for s in self.special):
            for d in range(docs):
                if any(s in data[offsets[d] : offsets[d + 1]] for s in self.special):
                    out[d] = self.whole([text(d)])[0]
        return out

    def _in_pieces(self, buf: np.ndarray, offsets: np.ndarray) -> list[np.ndarray] | None:
        """None if two pieces of one hash differ."""
        starts, ends = _pieces(buf, offsets)
        if not len(starts):
            return [np.zeros(0, self.kind)] * (len(offsets) - 1)
        keys, checks = words.word_hashes(buf, starts, ends), words.word_hashes(buf, starts, ends, 1)
        distinct, where, which = np.unique(keys, return_index=True, return_inverse=True)
        if not np.array_equal(checks, checks[where[which]]):
            return None
        checks, starts_of, ends_of = checks[where], starts[where], ends[where]
        counts, heads = np.full(len(distinct), -1, np.int64), np.zeros(len(distinct), np.int64)
        if len(self.pieces) > KEPT_PIECES:
            self.pieces.clear()
        tables, offset = [], 0
        for held, n, at, table in self.pieces.find(distinct, checks):
            counts[held], heads[held] = n, at + offset
            tables.append(table)
            offset += len(table)
        new = np.flatnonzero(counts < 0)
        if len(new):
            new, n, ids = self._fresh(buf, new, starts_of, ends_of)
            counts[new], heads[new] = n, np.cumsum(n) - n + offset
            tables.append(ids)
            self.pieces.add(distinct[new], checks[new], n, ids)
        counts = counts[which]
        stream = np.concatenate(tables)[words.ranges(heads[which], counts)]
        at = np.concatenate([[0], np.cumsum(counts)])[np.searchsorted(starts, offsets)]
        return [stream[at[d] : at[d + 1]] for d in range(len(offsets) - 1)]

    def _fresh(self, buf: np.ndarray, new: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(new in another order, number of ids of each, all ids).  Pieces that begin with white space and
        end without stand one after another in a text as they do alone, so these go through the tokenizer
        joined; as each character of a byte-level token is one byte, lengths tell where a piece's ids end."""
        last, before = buf[ends[new] - 1], buf[np.maximum(ends[new] - 2, 0)]
        joined = _SPACE[buf[starts[new]]] & (last > 0x20) & ~((last > 127) & _TAIL[last] & _LEAD[before])
        single, new = new[~joined], new[joined]
        counts, ids = [], []
        for k in range(0, len(new), 20_000):
            part = new[k : k + 20_000]
            sizes = ends[part] - starts[part]
            text = buf[words.ranges(starts[part], sizes)].tobytes().decode()
            made = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.int64)
            stops = np.searchsorted(np.cumsum(self.long[made]), np.cumsum(sizes)) + 1
            counts.append(np.diff(stops, prepend=0))
            ids.append(made.astype(self.kind))
        for k in range(0, len(single), 5000):
            part = [buf[starts[i] : ends[i]].tobytes().decode() for i in single[k : k + 5000]]
            made = [np.array(e.ids, self.kind) for e in self.tokenizer.encode_batch_fast(part, add_special_tokens=False)]
            counts.append(np.array([len(m) for m in made], np.int64))
            ids += made
        return np.concatenate([new, single]), np.concatenate(counts), np.concatenate(ids)


_KEPT: dict[tuple[str, bool], Encoder] = {}


def _encoder(path: str, special_as_text: bool = False) -> Encoder:
    if (path, special_as_text) not in _KEPT:
        _KEPT.clear()
        _KEPT[path, special_as_text] = Encoder(path, special_as_text)
    return _KEPT[path, special_as_text]


def write_records(docs: DataFrame, path: str, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text", end_id: int | None = 0, shard_mb: int = 8, special_as_text: bool = False, keep_order: bool = False) -> None:
    """Encode every text and write shards to path/shards and the index to path/index.

    A null text counts as empty (its record holds the end id alone).  Records
    ascend by id (null ids first), ties by text; repeated rows stay.  With
    keep_order they have the order of docs instead, rows and partitions as they
    come: that of a table sorted or shuffled before.  Further columns are left
    out.  An empty table gives an empty index.

    Special tokens' strings inside of texts give their special ids, as the
    library's default is; special_as_text encodes them as ordinary text.  Texts
    are parted into pieces only for byte-level BPE; other tokenizers take them
    whole.  shard_mb: input of a shard, which is read back in pieces.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(tokenizer, special_as_text)
        tail = np.array([] if end_id is None else [end_id], encoder.kind)
        for b in batches:
            ids = words.column(b, "id")
            buf, offsets = words.text_bytes(words.column(b, "text"))
            for i, j in words.slices(offsets, 2_000_000):
                tokens = encoder.encode(buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                yield pa.RecordBatch.from_arrays([pa.array([frame(k, np.concatenate([t, tail])) for k, t in zip(ids[i:j].to_pylist(), tokens)], pa.binary())], ["value"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    if not keep_order:
        rows = rows.repartitionByRange(partitions(docs, shard_mb), "id", F.xxhash64("text")).sortWithinPartitions("id", "text")
    with arrow_rows(docs.sparkSession, 1000, 2 << 20):
        rows.mapInArrow(encode, "value binary").select(F.col("value").cast("string").alias("value")).write.option("lineSep", "\n").text(f"{path}/shards")

    def index(found: list, records: int, tokens: int) -> list:
        return [range(records, records + len(found)), *zip(*((at, length, record_id, len(ids)) for at, length, record_id, ids in found))]

    with arrow_rows(docs.sparkSession, 1):
        per_shard(docs.sparkSession, path, index, INDEX).write.parquet(f"{path}/index")


INDEX = "shard string, position long, offset long, length long, id long, n_tokens long"


#: Bytes of a shard that go to a Python worker at once: the buffers on the way stay small however large a shard is.
PIECE = 1 << 20


def per_shard(spark: SparkSession, path: str, columns: Callable[[list, int, int], list], schema: str) -> DataFrame:
    """shard and the columns that columns(frames, records before, tokens before) makes of every shard file, which
    Spark reads and hands over in pieces.  A task's memory holds an Arrow batch of pieces: run it within
    arrow_rows(spark, 1) for one at a time."""
    names = [x.split(" ") for x in schema.split(", ")]
    kinds = {"string": pa.string(), "long": pa.int64()}

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, bool, bytes]]:
        for b in batches:
            for shard, last, content in zip(words.column(b, "shard").to_pylist(), words.column(b, "last").to_pylist(), words.column(b, "content")):
                yield shard, last, content.as_buffer().to_pybytes()

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, own in itertools.groupby(pieces(batches), lambda x: x[0]):
            records = tokens = 0
            for found in frames_of_pieces((content, last) for _, last, content in own):
                made = columns(found, records, tokens)
                yield pa.RecordBatch.from_arrays([pa.array([shard] * len(made[0]), pa.string()), *(pa.array(list(x), kinds[kind]) for x, (_, kind) in zip(made, names[1:]))], [name for name, _ in names])
                records += len(found)
                tokens += sum(len(ids) for _, _, _, ids in found)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(f"{path}/shards")
    parts = F.expr(f"transform(sequence(0, greatest(length(content) - 1, 0), {PIECE}), at -> substring(content, at + 1, {PIECE}))")
    cut = files.select(F.regexp_extract("path", r"part-(\d+)", 1).alias("shard"), "length", F.posexplode(parts).alias("piece", "content"))
    return cut.select("shard", ((F.col("piece").cast("long") + 1) * PIECE >= F.col("length")).alias("last"), "content").mapInArrow(take, schema)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/index")


def shard_starts(spark: SparkSession, path: str) -> DataFrame:
    """shard, tokens in earlier shards: one row a shard."""
    totals = read_index(spark, path).groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shard_start"))


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """id, start, n_tokens, ids_crc32 of every record, from the files (each checksum verified)."""

    def digest(found: list, records: int, tokens: int) -> list:
        starts = itertools.accumulate((len(ids) for _, _, _, ids in found), initial=tokens)
        return list(zip(*((record_id, start, len(ids), zlib.crc32(ids)) for (_, _, record_id, ids), start in zip(found, starts))))

    with arrow_rows(spark, 1):
        rows = written(per_shard(spark, path, digest, "shard string, id long, local long, n_tokens long, ids_crc32 long"), "digests")
    return rows.join(shard_starts(spark, path), "shard").select("id", (F.col("shard_start") + F.col("local")).alias("start"), "n_tokens", "ids_crc32")


def shuffled_index(spark: SparkSession, path: str, seed: int) -> DataFrame:
    """The index in a seeded global order: the reading plan of one epoch."""
    key = F.xxhash64(F.lit(seed), "shard", "position")
    index = read_index(spark, path)
    return index.repartition(partitions(index), key).sortWithinPartitions(key, "shard", "position")
