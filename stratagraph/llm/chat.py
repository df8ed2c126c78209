"""Chat formatting with a compiled, sandboxed template language.

Source text becomes tokens, tokens a syntax tree, constants are folded, and the
tree becomes nested Python closures.  Rendering walks closures only: a template
reaches mappings, lists, scalars and the filters given here, never attributes,
calls or imports of Python.

Language::

    {{ expression }}            output
    {% for x in list %} ... {% endfor %}      loop.index, loop.index0, loop.first inside
    {% if e %} ... {% elif e %} ... {% else %} ... {% endif %}
    {% set name = e %}
    {% generation %} ... {% endgeneration %}  text under the loss mask
    {# comment #}

Expressions: strings, numbers, true/false/none, names, a.b and a['b'], list
items, `|filter`, `~` (join as text), + - * / %, comparisons, in, not in, and,
or, not, parentheses.  `-` inside a marker's edge strips white space there.

Loops are lazy (`loop.last` doesn't exist), so a conversation is rendered as its
turns arrive: memory stays bounded however long it is.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator
from itertools import count, groupby

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratagraph.llm.common import partitions

# ---------------------------------------------------------------- escaping

#: The control strings of TEMPLATE.  Each opens with < or [ and has no other < or [.
CONTROL = ("<s>", "</s>", "[INST]", "[/INST]")
_ESCAPED = re.compile(r"\\|" + "|".join(map(re.escape, CONTROL)))
_UNESCAPED = re.compile(r"\\(.)", re.S)


def escape(text: str) -> str:
    """Doubles each backslash and puts one behind the first character of each control string.
    As a control string's opener stands only at its start, none can arise across borders."""
    return _ESCAPED.sub(lambda m: "\\\\" if m[0] == "\\" else f"{m[0][0]}\\{m[0][1:]}", text)


def unescape(text: str) -> str:
    return _UNESCAPED.sub(r"\1", text)


# ---------------------------------------------------------------- syntax tree


class TemplateError(ValueError):
    """A template that doesn't parse, or asks for something the sandbox lacks."""


_PIECE = re.compile(r"(\{\{-?|\{%-?|\{#)")
_TOKEN = re.compile(r"""\s*(?:(?P<num>\d+(?:\.\d+)?)|(?P<str>'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")|(?P<name>[A-Za-z_]\w*)|(?P<op>==|!=|<=|>=|[-+*/%~|.()\[\]<>=,]))""", re.S)
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}

FILTERS: dict[str, Callable] = {
    "escape": lambda x: escape(_text(x)),
    "trim": lambda x: _text(x).strip(),
    "upper": lambda x: _text(x).upper(),
    "lower": lambda x: _text(x).lower(),
    "length": lambda x: len(x),
    "capitalize": lambda x: _text(x).capitalize(),
}


def _text(x) -> str:
    return "" if x is None else x if isinstance(x, str) else str(x)


def _same(a, b):
    return a == b


_BINARY: dict[str, Callable] = {
    "==": _same,
    "!=": lambda a, b: a != b,
    "<": lambda a, b: a < b,
    ">": lambda a, b: a > b,
    "<=": lambda a, b: a <= b,
    ">=": lambda a, b: a >= b,
    "+": lambda a, b: a + b,
    "-": lambda a, b: a - b,
    "*": lambda a, b: _product(a, b),
    "/": lambda a, b: a / b,
    "%": lambda a, b: _remainder(a, b),
    "~": lambda a, b: _text(a) + _text(b),
    "in": lambda a, b: a in b,
    "not in": lambda a, b: a not in b,
}


def _numbers(a, b) -> None:
    if not all(isinstance(x, (int, float)) for x in (a, b)):
        raise TemplateError("* and % take numbers")


def _product(a, b):
    _numbers(a, b)
    return a * b


def _remainder(a, b):
    _numbers(a, b)
    return a % b


#: From loosest to tightest.
_LEVELS = (("or",), ("and",), ("==", "!=", "<", ">", "<=", ">=", "in", "not in"), ("~",), ("+", "-"), ("*", "/", "%"))


class _Expression:
    """Recursive descent over one marker's tokens; nodes are tuples (kind, ...)."""

    def __init__(self, source: str):
        self.tokens, at = [], 0
        source = source.rstrip()
        while at < len(source):
            if not (m := _TOKEN.match(source, at)):
                raise TemplateError(f"unexpected {source[at:].strip()[:20]!r}")
            self.tokens.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.at = 0

    def peek(self, ahead: int = 0) -> tuple[str | None, str]:
        return self.tokens[self.at + ahead] if self.at + ahead < len(self.tokens) else (None, "")

    def take(self, value: str | None = None) -> tuple[str | None, str]:
        got = self.peek()
        if got[0] is None or value is not None and (got[0] == "str" or got[1] != value):
            raise TemplateError(f"expected {value or 'a token'}, found {got[1]!r}")
        self.at += 1
        return got

    def is_(self, value: str) -> bool:
        return self.peek()[1] == value and self.peek()[0] in ("op", "name")

    def end(self) -> None:
        if self.peek()[0] is not None:
            raise TemplateError(f"unexpected {self.peek()[1]!r}")

    def whole(self):
        node = self.level(0)
        self.end()
        return node

    def operator(self, level: int) -> str | None:
        for op in _LEVELS[level]:
            first, _, second = op.partition(" ")
            if self.is_(first) and (not second or self.peek(1)[1] == second):
                return op
        return None

    def level(self, n: int):
        if n == len(_LEVELS):
            return self.unary()
        if n == 2 and self.is_("not"):
            self.take()
            return ("not", self.level(2))
        node = self.level(n + 1)
        while op := self.operator(n):
            for _ in op.split():
                self.take()
            node = (op if op in ("or", "and") else "binary", *([] if op in ("or", "and") else [op]), node, self.level(n + 1))
        return node

    def unary(self):
        if self.is_("-"):
            self.take()
            return ("binary", "-", ("const", 0), self.unary())
        return self.suffixes(self.atom())

    def suffixes(self, node):
        while True:
            if self.is_("."):
                self.take()
                kind, name = self.take()
                if kind != "name":
                    raise TemplateError("a name must follow the dot")
                node = ("item", node, ("const", name))
            elif self.is_("["):
                self.take()
                node = ("item", node, self.level(0))
                self.take("]")
            elif self.is_("|"):
                self.take()
                _, name = self.take()
                if name not in FILTERS:
                    raise TemplateError(f"no filter {name!r}")
                node = ("filter", name, node)
            else:
                return node

    def atom(self):
        kind, value = self.take()
        if kind == "num":
            return ("const", float(value) if "." in value else int(value))
        if kind == "str":
            return ("const", re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[1]), value[1:-1], flags=re.S))
        if kind == "name":
            words = {"true": True, "false": False, "none": None}
            return ("const", words[value.lower()]) if value.lower() in words else ("name", value)
        if value == "(":
            node = self.level(0)
            self.take(")")
            return node
        raise TemplateError(f"unexpected {value!r}")


def parse(source: str) -> list[tuple]:
    """The template's syntax tree: a list of statements."""
    parts: list[tuple[str, str]] = []
    at, strip = 0, False
    while at <= len(source):
        m = _PIECE.search(source, at)
        text = source[at : m.start() if m else len(source)]
        text = text.lstrip() if strip else text
        if not m:
            parts.append(("text", text))
            break
        opener = m[1]
        closer = {"{{": "}}", "{%": "%}", "{#": "#}"}[opener[:2]]
        body, end = _inside(source, m.end(), closer)
        parts.append(("text", text.rstrip() if opener.endswith("-") else text))
        strip = body.endswith("-")
        if closer != "#}":
            parts.append(("out" if closer == "}}" else "tag", body[:-1] if strip else body))
        at = end
    return _block(iter(parts), ())[0]


def _inside(source: str, at: int, closer: str) -> tuple[str, int]:
    quoted = re.compile(r"""'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*"|""" + re.escape(closer), re.S) if closer != "#}" else re.compile(r"#\}")
    for m in quoted.finditer(source, at):
        if m[0] == closer:
            return source[at : m.start()], m.end()
    raise TemplateError(f"{closer} is missing")


def _block(parts: Iterator[tuple[str, str]], until: tuple[str, ...]) -> tuple[list[tuple], str, _Expression | None]:
    out: list[tuple] = []
    for kind, body in parts:
        if kind == "text":
            out += [("text", body)] if body else []
        elif kind == "out":
            out.append(("out", _Expression(body).whole()))
        else:
            e = _Expression(body)
            _, tag = e.take()
            if tag in until:
                return out, tag, e
            out.append(_statement(tag, e, parts))
    if until:
        raise TemplateError(f"{until[-1]} is missing")
    return out, "", None


def _statement(tag: str, e: _Expression, parts: Iterator[tuple[str, str]]) -> tuple:
    if tag == "for":
        _, name = e.take()
        e.take("in")
        over = e.whole()
        return ("for", name, over, _block(parts, ("endfor",))[0])
    if tag == "set":
        _, name = e.take()
        e.take("=")
        return ("set", name, e.whole())
    if tag == "generation":
        e.end()
        return ("generation", _block(parts, ("endgeneration",))[0])
    if tag == "if":
        branches, otherwise, test = [], [], e.whole()
        while True:
            body, ended, more = _block(parts, ("elif", "else", "endif"))
            branches.append((test, body))
            if ended == "elif":
                test = more.whole()
                continue
            if ended == "else":
                otherwise = _block(parts, ("endif",))[0]
            return ("if", branches, otherwise)
    raise TemplateError(f"no statement {tag!r}")


# ---------------------------------------------------------------- folding


def fold(node):
    """The tree with constant expressions computed, dead branches dropped and texts joined."""
    if isinstance(node, list):
        out: list[tuple] = []
        for x in map(fold, node):
            x = ("text", _text(x[1][1])) if x[0] == "out" and x[1][0] == "const" else x
            for y in x[2] if x[0] == "if" and not x[1] else [x]:
                if y[0] == "text" and out and out[-1][0] == "text":
                    out[-1] = ("text", out[-1][1] + y[1])
                elif y != ("text", ""):
                    out.append(y)
        return out
    kind = node[0]
    if kind in ("const", "name", "text"):
        return node
    if kind == "for":
        return ("for", node[1], fold(node[2]), fold(node[3]))
    if kind == "generation":
        return ("generation", fold(node[1]))
    if kind == "if":
        branches, otherwise = [], fold(node[2])
        for test, body in node[1]:
            test = fold(test)
            if test[0] != "const":
                branches.append((test, fold(body)))
            elif test[1]:
                otherwise = fold(body)
                break
        return ("if", branches, otherwise)
    kids = tuple(fold(x) if isinstance(x, tuple) else x for x in node[1:])
    node = (kind, *kids)
    if kind in ("binary", "not", "filter", "item", "and", "or") and all(x[0] == "const" for x in kids if isinstance(x, tuple)):
        try:
            return ("const", _expression(node)({}))
        except TemplateError:
            raise
        except Exception:  # left to fail where it is rendered
            return node
    return node


# ---------------------------------------------------------------- closures


def _expression(node) -> Callable[[dict], object]:
    kind = node[0]
    if kind == "const":
        value = node[1]
        return lambda scope: value
    if kind == "name":
        name = node[1]
        return lambda scope: scope.get(name)
    if kind == "binary":
        f, a, b = _BINARY[node[1]], _expression(node[2]), _expression(node[3])
        return lambda scope: f(a(scope), b(scope))
    if kind == "not":
        a = _expression(node[1])
        return lambda scope: not a(scope)
    if kind == "and":
        a, b = _expression(node[1]), _expression(node[2])
        return lambda scope: a(scope) and b(scope)
    if kind == "or":
        a, b = _expression(node[1]), _expression(node[2])
        return lambda scope: a(scope) or b(scope)
    if kind == "filter":
        f, a = FILTERS[node[1]], _expression(node[2])
        return lambda scope: f(a(scope))
    if kind == "item":
        a, key = _expression(node[1]), _expression(node[2])

        def item(scope):
            of, k = a(scope), key(scope)
            if isinstance(of, dict):
                return of.get(k)
            if isinstance(of, (list, tuple, str)) and isinstance(k, int):
                return of[k] if -len(of) <= k < len(of) else None
            return None

        return item
    raise TemplateError(f"no expression {kind!r}")


#: A piece of output: its text and whether it is under the loss mask.
Piece = tuple[str, bool]


def _statements(nodes: list[tuple], masked: bool) -> Callable[[dict], Iterator[Piece]]:
    made = [_closure(x, masked) for x in nodes]

    def run(scope: dict) -> Iterator[Piece]:
        for f in made:
            yield from f(scope)

    return run


def _closure(node: tuple, masked: bool) -> Callable[[dict], Iterator[Piece]]:
    kind = node[0]
    if kind == "text":
        piece = (node[1], masked)
        return lambda scope: iter((piece,))
    if kind == "out":
        value = _expression(node[1])
        return lambda scope: iter(((_text(value(scope)), masked),))
    if kind == "generation":
        return _statements(node[1], True)
    if kind == "set":
        name, value = node[1], _expression(node[2])

        def assign(scope: dict) -> Iterator[Piece]:
            scope[name] = value(scope)
            return iter(())

        return assign
    if kind == "if":
        branches = [(_expression(t), _statements(b, masked)) for t, b in node[1]]
        otherwise = _statements(node[2], masked)

        def choose(scope: dict) -> Iterator[Piece]:
            for test, body in branches:
                if test(scope):
                    return body(scope)
            return otherwise(scope)

        return choose
    name, over, body = node[1], _expression(node[2]), _statements(node[3], masked)

    def loop(scope: dict) -> Iterator[Piece]:
        outer = {k: scope.get(k) for k in (name, "loop")}
        for n, x in enumerate(over(scope) or ()):
            scope[name], scope["loop"] = x, {"index0": n, "index": n + 1, "first": n == 0}
            yield from body(scope)
        scope.update(outer)

    return loop


class Template:
    """A compiled template: render(**names) yields pieces (text, under the loss mask)."""

    def __init__(self, source: str):
        self.source, self.tree = source, fold(parse(source))
        self._run = _statements(self.tree, False)

    def render(self, **names) -> Iterator[Piece]:
        return self._run(dict(names))


#: Marks every turn as <s>[INST] role [/INST]text</s>; the assistant's text is under the mask.
TEMPLATE = """
{%- for m in messages -%}
{{ '<s>' ~ '[INST] ' ~ m.role|escape ~ ' [/INST]' }}
{%- if m.role == 'assistant' %}{% generation %}{{ m.text|escape }}{% endgeneration %}{% else %}{{ m.text|escape }}{% endif -%}
{{ '</s>' }}
{%- endfor -%}
"""

# ---------------------------------------------------------------- tables

#: Characters of a part of formatted text, about: longer conversations have many parts.
PART = 1 << 20
PARTS = "conv_id long, own string, part long, last boolean, text string, spans array<array<long>>"


def format_conversations(turns: DataFrame, template: str = TEMPLATE, *, part: int = PART) -> DataFrame:
    """conv_id, own, part, last, text, spans: formatted conversations in parts of about `part` characters.

    spans holds [start, end) code points of the part's text under the loss mask;
    last marks a conversation's last part; own tells those without a conv_id apart.  turns: conv_id, turn, role, text; rows
    are ordered by turn (null first), ties by role and text, repeated rows stay.
    A null role or text is empty; a row without a conv_id is a conversation of its
    own, so these meet in no one task.  Further columns are left out.  An empty
    table gives no rows.
    """

    def render(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = Template(template)
        rows = (r for b in batches for r in zip(*(b.column(i).to_pylist() for i in range(3))))
        made: list[tuple] = []
        size = 0
        task = TaskContext.get()
        for (conv, serial), own in groupby(rows, key=_own()):
            name = f"{task.partitionId() if task else 0}-{serial}" if conv is None else None
            n, at, text, spans = 0, 0, [], []
            for piece, masked in compiled.render(messages=({"role": r[1] or "", "text": r[2] or ""} for r in own)):
                if masked:
                    spans.append([at, at + len(piece)])
                text.append(piece)
                at += len(piece)
                if at >= part:
                    yield _batch([(conv, name, n, False, "".join(text), spans)])
                    n, at, text, spans = n + 1, 0, [], []
            made.append((conv, name, n, True, "".join(text), spans))
            size += at
            if size >= part or n:
                yield _batch(made)
                made, size = [], 0
        yield _batch(made)

    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").alias("_turn"), F.col("role").alias("_role"), F.col("text").alias("_text"))
    salt = F.when(F.col("conv_id").isNull(), F.xxhash64("_turn", "_role", "_text"))
    ordered = rows.repartition(partitions(turns), "conv_id", salt).sortWithinPartitions("conv_id", "_turn", "_role", "_text")
    return ordered.select("conv_id", "_role", "_text").mapInArrow(render, PARTS)


def _own() -> Callable[[tuple], tuple]:
    """A key of rows by their first field; a null is equal to no other."""
    serial = count()
    return lambda r: (r[0], next(serial) if r[0] is None else 0)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [[]] * 6
    kinds = (pa.int64(), pa.string(), pa.int64(), pa.bool_(), pa.string(), pa.list_(pa.list_(pa.int64())))
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], [x.split()[0] for x in PARTS.split(", ")])


_TURN = re.compile(r"<s>\[INST\] (.*?) \[/INST\](.*?)</s>", re.S)


def read_turns(text: str) -> Iterator[tuple[str, str, int]]:
    """(role, text, end in `text`) of each whole turn that TEMPLATE made."""
    for m in _TURN.finditer(text):
        yield unescape(m[1]), unescape(m[2]), m.end()


DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def read_digests(formatted: DataFrame) -> DataFrame:
    """What a reader of the formatted text gets back, one row a conversation, of format_conversations' rows in
    any order: written, read and shuffled ones serve as well.  Conversations of one part are read as they
    come; only those of several are brought together, in order of their parts, of which one is in memory."""

    def digest(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for r in zip(*(b.column(i).to_pylist() for i in range(4))))
        out: list[tuple] = []
        for (conv, _), parts in groupby(rows, key=_first(lambda r: r[1] == 0)):
            turns, loss, n, chars, under, rest = hashlib.sha256(), hashlib.sha256(), 0, 0, 0, ""
            for _, _, text, spans in parts:
                chars += len(text)
                for a, b in spans:
                    plain = unescape(text[a:b])
                    under += len(plain)
                    loss.update(plain.encode())
                rest, end = rest + text, 0
                for role, said, end in read_turns(rest):
                    n += 1
                    turns.update(f"{role}\n{said}\n".encode())
                rest = rest[end:]
            out.append((conv, n, turns.hexdigest(), under, loss.hexdigest(), chars))
            if len(out) == 10_000:
                yield _digests(out)
                out = []
        yield _digests(out)

    one = F.col("last") & (F.col("part") == 0)
    columns = ["conv_id", "part", "text", "spans"]
    several = formatted.where(~one).repartition(partitions(formatted), "conv_id", "own").sortWithinPartitions("conv_id", "own", "part")
    return formatted.where(one).select(columns).mapInArrow(digest, DIGESTS).union(several.select(columns).mapInArrow(digest, DIGESTS))


def _first(begins: Callable[[tuple], bool]) -> Callable[[tuple], tuple]:
    """A key of rows by their first field and the number of beginnings so far."""
    seen = [0]

    def key(r: tuple) -> tuple:
        seen[0] += begins(r)
        return r[0], seen[0]

    return key


def _digests(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
    columns = list(zip(*rows)) or [[]] * 6
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], [x.split()[0] for x in DIGESTS.split(", ")])
