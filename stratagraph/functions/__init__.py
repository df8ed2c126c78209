"""Scalar helpers: globs, regular-expression gate, digests, name tails, the hashing tokenizer."""

from __future__ import annotations

import hashlib
import json
import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def glob_regex(pattern: str) -> str:
    """`**/` any folders or none, `**` anything, `*` anything within a folder, `?` one character of it."""
    parts = re.split(r"(\*\*/|\*\*|\*|\?)", pattern)
    made = {"**/": "(?:.*/)?", "**": ".*", "*": "[^/]*", "?": "[^/]"}
    return "^" + "".join(made.get(p, re.escape(p).replace("/", "/")) for p in parts) + "$"


def matches_any(path: Column, globs: list[str]) -> Column:
    return path.rlike("|".join(f"(?:{glob_regex(g)})" for g in globs)) if globs else F.lit(False)


class UnsafePattern(ValueError):
    """core:invalid_pattern"""


def _widest(parsed, inside: bool = False) -> bool:
    """Whether an unbounded repetition stands inside of another."""
    for op, value in parsed:
        name = str(op)
        if name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
            unbounded = value[1] > 1000
            if inside and unbounded or _widest(value[2], inside or unbounded):
                return True
        elif name == "SUBPATTERN" and _widest(value[-1], inside) or name == "ATOMIC_GROUP" and _widest(value, inside):
            return True
        elif name == "BRANCH" and any(_widest(x, inside) for x in value[1]):
            return True
    return False


def safe_regex(pattern: str) -> str:
    """A pattern of at most 1024 characters, without look-around, back-references and repetitions without bound
    inside of one another (these may take exponential time)."""
    if len(pattern) > 1024 or re.search(r"\(\?<?[=!]|\\[1-9]|\(\?P=|\\k<", pattern):
        raise UnsafePattern(pattern[:40])
    re.compile(pattern)
    if _widest(re._parser.parse(pattern)):
        raise UnsafePattern(pattern[:40])
    return pattern


def name_tail(identity_key: Column) -> Column:
    return F.element_at(F.split(identity_key, ":"), -1)


def digest(*parts: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(F.concat_ws("|", *parts), 256))


def canonical_digest(value: object) -> str:
    """Digest of a plan: JSON with sorted keys and no spaces."""
    return "sha256:" + hashlib.sha256(json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()
