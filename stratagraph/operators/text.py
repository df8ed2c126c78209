"""Lexical retrieval and source snippets over artifacts(artifact_id, text, ...).

Searches are case-sensitive unless asked otherwise and never cut off (the contract's behaviour).
Offsets are given in code points (start_char, from 0) and bytes (start_byte).
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from stratagraph.functions import safe_regex
from stratagraph.operators.relational import QueryError


_HEX = np.frombuffer("".join(f"{x:02x}" for x in range(256)).encode(), np.uint8).reshape(256, 2)


#: Bytes of folded text whose windows are sorted at once.
SLICE = 1 << 20


def _trigram_rows():
    """What turns batches (artifact_id, text) into rows (artifact_id, trigram), made here so that workers get it whole."""
    most = SLICE

    def long(b: np.ndarray) -> np.ndarray:
        """Distinct windows of one long text, marked piece by piece in a table of all there are."""
        seen = np.zeros(1 << 24, bool)
        for at in range(0, len(b) - 2, most):
            p = b[at : at + most + 2].astype(np.uint32)
            seen[p[:-2] << 16 | p[1:-1] << 8 | p[2:]] = True
        return np.flatnonzero(seen).astype(np.uint64)

    def windows(parts: list[bytes]) -> np.ndarray:
        """A text's number and a window of it in each value, sorted."""
        b = np.frombuffer(b"".join(parts), np.uint8)
        if len(parts) == 1 and len(b) > most:
            return long(b)
        b, owner = b.astype(np.uint64), np.repeat(np.arange(len(parts), dtype=np.uint64), [len(p) for p in parts])
        some = np.flatnonzero(owner[2:] == owner[:-2]) if len(b) > 2 else np.zeros(0, np.int64)
        return np.unique(owner[some] << np.uint64(24) | b[some] << np.uint64(16) | b[some + 1] << np.uint64(8) | b[some + 2])

    def rows(ids: pa.Array, first: int, parts: list[bytes]) -> Iterator[pa.RecordBatch]:
        found = windows(parts)
        for at in range(0, len(found), most):
            some = found[at : at + most]
            hexed = _HEX[np.stack([some >> np.uint64(k) & np.uint64(255) for k in (16, 8, 0)], 1).astype(np.int64)].tobytes()
            values = pa.StringArray.from_buffers(len(some), pa.py_buffer(np.arange(0, 6 * len(some) + 1, 6, dtype=np.int32)), pa.py_buffer(hexed))
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(first + (some >> np.uint64(24)).astype(np.int64))), values], ["artifact_id", "trigram"])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            first, parts, size = 0, [], 0
            for k in range(len(texts)):
                part = unicodedata.normalize("NFKC", texts[k].as_py() or "").lower().encode()
                if parts and size + len(part) > most:
                    yield from rows(ids, first, parts)
                    first, parts, size = k, [], 0
                parts.append(part)
                size += len(part)
            if parts:
                yield from rows(ids, first, parts)

    return find


def trigram_index(artifacts: DataFrame) -> DataFrame:
    """trigram, artifact_id: the projection to write and partition by trigram.  The distinct three-byte windows, in hex, of
    the NFKC-folded, lower-cased texts; a worker holds a batch of texts and the windows of SLICE bytes of them."""
    some = artifacts.select("artifact_id", "text")
    return some.mapInArrow(_trigram_rows(), StructType([some.schema["artifact_id"], StructField("trigram", StringType())]))


def trigram_candidates(index: DataFrame, literal: str) -> DataFrame | None:
    """Artifacts that hold all trigrams of a literal; None (every artifact) for shorter literals.  The literal's last
    character isn't taken: a mark behind it may be folded into it."""
    b = b"" if "Σ" in literal else unicodedata.normalize("NFKC", literal[:-1]).lower().encode()
    wanted = sorted({b[i : i + 3].hex() for i in range(len(b) - 2)})
    if not wanted:
        return None
    return index.where(F.col("trigram").isin(wanted)).groupBy("artifact_id").agg(F.count_distinct("trigram").alias("_n")).where(F.col("_n") == len(wanted)).select("artifact_id")


def prefiltered(artifacts: DataFrame, literal: str, index: DataFrame | None) -> DataFrame:
    """The artifacts that may hold a literal, by the trigram projection where there is one."""
    some = trigram_candidates(index, literal) if index is not None else None
    return artifacts if some is None else artifacts.join(some, "artifact_id", "left_semi")


def _quoted(literal: str) -> str:
    return re.sub(r"([\\.^$|?*+()\[\]{}])", r"\\\1", literal)


def literal_spans(artifacts: DataFrame, literal: str, *, case_sensitive: bool = True, index: DataFrame | None = None) -> DataFrame:
    """artifact_id, n, start_char, start_byte, line of non-overlapping occurrences, left to right.  Pieces between
    hits give offsets, bytes and lines by running sums: one pass, in the JVM, and no text is joined again."""
    if not literal:
        raise QueryError("core:invalid_pattern", "empty literal")
    text = F.col("text") if case_sensitive else F.lower("text")
    literal = literal if case_sensitive else literal.lower()
    found = prefiltered(artifacts, literal, index).where(text.contains(literal)).select("artifact_id", F.split(text, _quoted(literal), -1).alias("_p"))
    each = found.select("artifact_id", F.posexplode(F.slice("_p", F.lit(1), F.size("_p") - 1)).alias("n", "_piece"))
    before = Window.partitionBy("artifact_id").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    total = lambda c, own: (F.sum(c).over(before) + F.col("n") * own).cast("long")
    lines = F.length("_piece") - F.length(F.replace(F.col("_piece"), F.lit("\n"), F.lit("")))
    return each.select("artifact_id", "n", total(F.length("_piece"), len(literal)).alias("start_char"), total(F.octet_length("_piece"), len(literal.encode())).alias("start_byte"), (1 + total(lines, literal.count("\n"))).alias("line"))


def literal_hits(artifacts: DataFrame, literal: str, *, case_sensitive: bool = True, index: DataFrame | None = None) -> DataFrame:
    """artifact_id, n, start_char of literal_spans."""
    return literal_spans(artifacts, literal, case_sensitive=case_sensitive, index=index).select("artifact_id", "n", "start_char")


def match_counts(artifacts: DataFrame, pattern: str, *, syntax: str = "literal", word_mode: str = "substring", case_sensitive: bool = True) -> DataFrame:
    """artifact_id, matches of a literal or safe regular expression, as a substring, an identifier or a token."""
    body = safe_regex(pattern) if syntax == "safe_regex" else _quoted(pattern)
    edges = {"substring": ("", ""), "identifier": ("(?<![A-Za-z0-9_$])", "(?![A-Za-z0-9_$])"), "token": ("(?<!\\S)", "(?!\\S)")}
    if word_mode not in edges:
        raise QueryError("core:invalid_arguments", word_mode)
    regex = ("" if case_sensitive else "(?i)") + edges[word_mode][0] + f"(?:{body})" + edges[word_mode][1]
    n = F.regexp_count("text", F.lit(regex))
    return artifacts.where(F.col("text").rlike(regex)).select("artifact_id", n.cast("long").alias("matches"))


def line_of(text: Column, start_char: Column) -> Column:
    """Line, from 1, of a code-point offset."""
    return F.size(F.split(F.substr(text, F.lit(1), start_char), "\n")).cast("long")


SNIPPET, TOTAL = 4000, 16_000


def snippet(text: Column, mode: str) -> Column:
    """none, signature (the first line), relevant and body (the text)."""
    return {"none": F.lit(""), "signature": F.substring_index(text, "\n", 1), "relevant": text, "body": text}[mode]


def snippet_budget(subjects: DataFrame, *, mode: str = "body", order: list[Column], per_snippet: int = SNIPPET, total: int = TOTAL, stream: str | None = None) -> DataFrame:
    """subjects with `snippet`, cut to per_snippet characters and, in order, to a total: in closed form, one
    running sum.  stream: a column whose values have budgets of their own; without it one ordered stream
    (a page) shares the budget."""
    w = Window.partitionBy(*([stream] if stream else [F.lit(1)])).orderBy(*order)
    cut = F.substring(snippet(F.col("text"), mode), 1, per_snippet)
    rows = subjects.withColumn("_cut", cut).withColumn("_sum", F.sum(F.length("_cut")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    take = F.least(F.col("_sum"), F.lit(total)) - F.least(F.col("_sum") - F.length("_cut"), F.lit(total))
    return rows.withColumn("snippet", F.substr("_cut", F.lit(1), take.cast("int"))).drop("_cut", "_sum")


#: A small set of detectors of our own: addresses, keys, telephone numbers.
SECRETS = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}|AKIA[0-9A-Z]{16}|sk-[A-Za-z0-9]{20,}|[0-9]{3}-[0-9]{3}-[0-9]{4}"


def redact(text: Column) -> Column:
    return F.regexp_replace(text, SECRETS, "[REDACTED]")


def term_frequency(artifacts: DataFrame) -> DataFrame:
    """artifact_id, token, tf: lower-cased runs of letters and digits."""
    tokens = artifacts.select("artifact_id", F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9_$]+"), F.lit(0))).alias("token"))
    return tokens.groupBy("artifact_id", "token").agg(F.count(F.lit(1)).alias("tf"))
