"""Chat formatting with a compiled, sandboxed template language.

A template is parsed into a syntax tree, constants in it are folded, and the rest becomes nested Python
closures that yield the text piece by piece with markers where generated text begins and ends.

The language: text; ``{{ expression }}``; ``{% for x in e %} {% endfor %}``; ``{% if e %} {% elif e %}
{% else %} {% endif %}``; ``{% set x = e %}``; ``{% generation %} {% endgeneration %}``; ``{# comment #}``;
a dash inside a tag (``{%-``, ``-%}``) removes white space beside it. Expressions have strings, whole
numbers, true, false, none, names, ``a.b``, ``a[e]``, ``+ - * // %``, ``~`` (joins texts), comparisons,
``in``, ``is [not] defined``, ``is [not] none``, ``not and or``, ``x if c else y`` and the filters escape, trim, upper, lower, length. In a loop
there is ``loop.index``, ``loop.index0``, ``loop.first`` and ``loop.last``.

The sandbox: names are looked up in the given values only, attributes and items in mappings and lists
only, names with a leading underscore don't compile, nothing can be called, and texts can't be multiplied.
Data are never parsed.

``escape`` puts a backslash behind the first character of every control string in a text and doubles
backslashes, so an escaped text holds no control string and ``Controls.unescape`` gives it back exactly.

Spark deals conversations by id and sorts their rows within the partitions; a task renders row after row
and holds one part of a conversation (``PART`` characters, or one text where that is longer), whatever
the length of the conversation, provided the template reads ``messages`` once, in a loop; other templates
get the list. Formatted conversations are written as parts; the reader takes them from there, those of a
single part without a shuffle. A digest over a whole conversation is sequential by its nature, so
the parts of a long conversation pass through one task, one after another.

Defined cases: rows of a conversation go by turn, then role, then text, nulls first; a null role or text
is empty; rows with a null conv_id are one conversation; repeated rows are turns of their own; only
the role ``assistant`` is under the loss mask; an empty table has the added conversation only, in
the query, and no rows otherwise; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import itertools
import operator
import re
from collections.abc import Callable, Iterable, Iterator, Mapping
from dataclasses import dataclass, field, replace
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesmill.llm.text import bounded_batches, table
from seriesmill.session import written

PART = 1 << 20


class TemplateError(ValueError):
    """A template that doesn't compile, or an expression that the sandbox refuses."""


@dataclass(frozen=True)
class Controls:
    """Strings that mean something to the reader of formatted text, and how texts avoid them."""

    strings: tuple[str, ...]

    def __post_init__(self) -> None:
        if any(len(s) < 2 or "\\" in s for s in self.strings):
            raise TemplateError("control strings need two characters and no backslash")

    @property
    def pattern(self) -> str:
        return "|".join(re.escape(s) for s in sorted(self.strings, key=len, reverse=True))

    def escape(self, text: str) -> str:
        text = text.replace("\\", "\\\\")
        return re.sub(f"(?=(?:{self.pattern}))(.)", r"\1\\", text, flags=re.S) if self.strings else text

    @staticmethod
    def unescape(text: str) -> str:
        return re.sub(r"\\(\\?)", r"\1", text)


# The syntax tree


@dataclass(frozen=True)
class Const:
    value: Any


@dataclass(frozen=True)
class Name:
    name: str


@dataclass(frozen=True)
class Item:
    of: Any
    key: Any


@dataclass(frozen=True)
class Apply:
    """An operator, test or filter on its operands."""

    op: str
    args: tuple


@dataclass(frozen=True)
class Choice:
    test: Any
    then: Any
    other: Any


@dataclass(frozen=True)
class Text:
    text: str


@dataclass(frozen=True)
class Out:
    value: Any


@dataclass(frozen=True)
class Loop:
    name: str
    over: Any
    body: tuple


@dataclass(frozen=True)
class Branch:
    test: Any
    then: tuple
    other: tuple


@dataclass(frozen=True)
class Assign:
    name: str
    value: Any


@dataclass(frozen=True)
class Generation:
    body: tuple


class _Undefined:
    def __bool__(self) -> bool:
        return False

    def __str__(self) -> str:
        return ""


UNDEFINED = _Undefined()
TOKEN = re.compile(r"""\s*(?:(?P<text>"(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*')|(?P<number>\d+)|(?P<name>[A-Za-z_]\w*)|(?P<sign>==|!=|<=|>=|//|[-+*%~<>=.,|()\[\]]))""", re.S)
TAG = re.compile(r"(\{%-?.*?-?%\}|\{\{-?.*?-?\}\}|\{#-?.*?-?#\})", re.S)
WORDS = {"and", "or", "not", "in", "is", "if", "else"}
CONSTANTS = {"true": True, "false": False, "none": None, "True": True, "False": False, "None": None}
FILTERS = ("escape", "trim", "upper", "lower", "length")
#: Two-sided operators from the loosest to the tightest.
LEVELS = (("==", "!=", "<", "<=", ">", ">=", "in", "not in"), ("~",), ("+", "-"), ("*", "//", "%"))
ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "\\": "\\", "'": "'", '"': '"'}


class _Expression:
    """Recursive descent over the tokens of one tag."""

    def __init__(self, source: str):
        self.tokens: list[tuple[str, str]] = []
        at, source = 0, source.strip()
        while at < len(source):
            found = TOKEN.match(source, at)
            if not found:
                raise TemplateError(f"can't read {source[at:]!r}")
            self.tokens.append((found.lastgroup, found.group(found.lastgroup)))
            at = found.end()
        self.tokens.append(("end", ""))
        self.at = 0

    def peek(self) -> str:
        kind, text = self.tokens[self.at]
        return text if kind in ("sign", "name") else ""

    def take(self, *texts: str) -> str:
        if self.peek() in texts and self.peek():
            self.at += 1
            return self.tokens[self.at - 1][1]
        return ""

    def need(self, text: str) -> None:
        if not self.take(text):
            raise TemplateError(f"{text!r} is missing")

    def name(self) -> str:
        kind, text = self.tokens[self.at]
        if kind != "name" or text in WORDS or text.startswith("_"):
            raise TemplateError(f"{text!r} is not a name that templates may use")
        self.at += 1
        return text

    def ended(self) -> None:
        if self.tokens[self.at][0] != "end":
            raise TemplateError(f"{self.tokens[self.at][1]!r} is not expected here")

    def whole(self) -> Any:
        value = self.choice()
        self.ended()
        return value

    def choice(self) -> Any:
        value = self.either()
        if self.take("if"):
            test = self.either()
            return Choice(test, value, self.choice() if self.take("else") else Const(""))
        return value

    def either(self) -> Any:
        value = self.both()
        while self.take("or"):
            value = Apply("or", (value, self.both()))
        return value

    def both(self) -> Any:
        value = self.negated()
        while self.take("and"):
            value = Apply("and", (value, self.negated()))
        return value

    def negated(self) -> Any:
        return Apply("not", (self.negated(),)) if self.take("not") else self.sided(0)

    def sided(self, level: int) -> Any:
        if level == len(LEVELS):
            return self.signed()
        value = self.sided(level + 1)
        while True:
            if level == 0 and self.take("is"):
                turned = bool(self.take("not"))
                test = self.name()
                if test not in ("defined", "none"):
                    raise TemplateError(f"no test {test!r}")
                value = Apply(f"is {test}", (value,))
                value = Apply("not", (value,)) if turned else value
                continue
            op = self.take(*LEVELS[level])
            if not op and level == 0 and self.peek() == "not" and self.tokens[self.at + 1][1] == "in":
                self.at += 2
                op = "not in"
            if not op:
                return value
            value = Apply(op, (value, self.sided(level + 1)))

    def signed(self) -> Any:
        return Apply("-", (Const(0), self.signed())) if self.take("-") else self.filtered()

    def filtered(self) -> Any:
        value = self.reached()
        while self.take("|"):
            name = self.name()
            if name not in FILTERS:
                raise TemplateError(f"no filter {name!r}")
            value = Apply(name, (value,))
        return value

    def reached(self) -> Any:
        value = self.single()
        while True:
            if self.take("."):
                value = Item(value, Const(self.name()))
            elif self.take("["):
                value = Item(value, self.choice())
                self.need("]")
            else:
                return value

    def single(self) -> Any:
        kind, text = self.tokens[self.at]
        if kind == "text":
            self.at += 1
            return Const(re.sub(r"\\(.)", lambda m: ESCAPES.get(m[1], m[0]), text[1:-1], flags=re.S))
        if kind == "number":
            self.at += 1
            return Const(int(text))
        if self.take("("):
            value = self.choice()
            self.need(")")
            return value
        name = self.name()
        return Const(CONSTANTS[name]) if name in CONSTANTS else Name(name)


def parse(source: str) -> tuple:
    """The syntax tree of a template."""
    pieces = TAG.split(source)
    items: list[tuple[str, str]] = []
    for k, piece in enumerate(pieces):
        if k % 2 == 0:
            if k and pieces[k - 1][-3] == "-":
                piece = piece.lstrip()
            if k + 1 < len(pieces) and pieces[k + 1][2] == "-":
                piece = piece.rstrip()
            items.append(("text", piece))
        elif not piece.startswith("{#"):
            inner = piece[2:-2].removeprefix("-").removesuffix("-").strip()
            items.append(("out" if piece.startswith("{{") else "tag", inner))
    body, at = _block(items, 0, (), False)
    return body


def _block(items: list[tuple[str, str]], at: int, ends: tuple[str, ...], generating: bool) -> tuple[tuple, int]:
    """Nodes up to a tag named in ``ends``, which is left to the caller."""
    nodes: list[Any] = []
    while at < len(items):
        kind, text = items[at]
        word, _, rest = text.partition(" ") if kind == "tag" else ("", "", "")
        if kind == "text":
            nodes.append(Text(text))
        elif kind == "out":
            nodes.append(Out(_Expression(text).whole()))
        elif word in ends:
            return tuple(nodes), at
        elif word == "for":
            head = _Expression(rest)
            name = head.name()
            head.need("in")
            over = head.whole()
            body, at = _block(items, at + 1, ("endfor",), generating)
            nodes.append(Loop(name, over, body))
        elif word == "if":
            node, at = _branch(items, at, rest, generating)
            nodes.append(node)
        elif word == "set":
            head = _Expression(rest)
            name = head.name()
            head.need("=")
            nodes.append(Assign(name, head.whole()))
        elif word == "generation":
            if generating:
                raise TemplateError("generation inside generation")
            body, at = _block(items, at + 1, ("endgeneration",), True)
            nodes.append(Generation(body))
        else:
            raise TemplateError(f"no tag {text!r} here")
        at += 1
    if ends:
        raise TemplateError(f"{ends[-1]!r} is missing")
    return tuple(nodes), at


def _branch(items: list[tuple[str, str]], at: int, test: str, generating: bool) -> tuple[Branch, int]:
    condition = _Expression(test).whole()
    then, at = _block(items, at + 1, ("elif", "else", "endif"), generating)
    word, _, rest = items[at][1].partition(" ")
    other: tuple = ()
    if word == "elif":
        node, at = _branch(items, at, rest, generating)
        other = (node,)
    elif word == "else":
        other, at = _block(items, at + 1, ("endif",), generating)
    return Branch(condition, then, other), at


# Folding


def _text(value: Any) -> str:
    if value is None or value is UNDEFINED:
        return ""
    if isinstance(value, (str, int)):
        return str(value)
    raise TemplateError(f"a {type(value).__name__} is not text")


def _numbers(f: Callable[[int, int], int]) -> Callable[[Any, Any], int]:
    def run(a: Any, b: Any) -> int:
        if not isinstance(a, int) or not isinstance(b, int):
            raise TemplateError("only numbers can be reckoned with")
        return f(a, b)

    return run


def _plus(a: Any, b: Any) -> Any:
    return a + b if isinstance(a, str) and isinstance(b, str) else _numbers(operator.add)(a, b)


def _among(a: Any, b: Any) -> bool:
    if not isinstance(b, (str, list, tuple, Mapping)):
        raise TemplateError("'in' needs a text, list or mapping")
    return a in b


def _functions(controls: Controls) -> dict[str, Callable]:
    return {
        "==": operator.eq, "!=": operator.ne, "<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge,
        "in": _among, "not in": lambda a, b: not _among(a, b), "~": lambda a, b: _text(a) + _text(b), "+": _plus,
        "-": _numbers(operator.sub), "*": _numbers(operator.mul), "//": _numbers(operator.floordiv), "%": _numbers(operator.mod),
        "not": operator.not_, "is none": lambda a: a is None, "is defined": lambda a: a is not UNDEFINED,
        "escape": lambda a: controls.escape(_text(a)), "trim": lambda a: _text(a).strip(), "upper": lambda a: _text(a).upper(),
        "lower": lambda a: _text(a).lower(), "length": len,
    }


def folded(node: Any, functions: Mapping[str, Callable]) -> Any:
    """An expression with its constant parts worked out; errors are left for the time of rendering."""
    if isinstance(node, Name):
        return functions.get(f"name {node.name}", node)
    if isinstance(node, Item):
        return replace(node, of=folded(node.of, functions), key=folded(node.key, functions))
    if isinstance(node, Choice):
        test = folded(node.test, functions)
        if isinstance(test, Const):
            return folded(node.then if test.value else node.other, functions)
        return Choice(test, folded(node.then, functions), folded(node.other, functions))
    if isinstance(node, Apply):
        args = tuple(folded(a, functions) for a in node.args)
        if node.op in ("and", "or") and isinstance(args[0], Const):
            return args[1] if bool(args[0].value) == (node.op == "and") else args[0]
        if node.op in functions and all(isinstance(a, Const) for a in args):
            try:
                return Const(functions[node.op](*(a.value for a in args)))
            except (TypeError, ArithmeticError, TemplateError):
                pass
        return Apply(node.op, args)
    return node


def _given(nodes: Any, name: str) -> int:
    """How often a name gets a value in some statements."""
    if isinstance(nodes, tuple):
        return sum(_given(n, name) for n in nodes)
    own = int(isinstance(nodes, (Assign, Loop)) and nodes.name == name)
    return own + sum(_given(getattr(nodes, f), name) for f in ("body", "then", "other") if hasattr(nodes, f))


def folded_tree(nodes: tuple, functions: Mapping[str, Callable]) -> tuple:
    """A whole template folded; names that it sets once, to a constant, are constants from there on."""
    known = dict(functions)
    done: list[Any] = []
    for k, node in enumerate(nodes):
        value = folded(node.value, known) if isinstance(node, Assign) else None
        if isinstance(value, Const) and _given(nodes, node.name) == 1 and not _uses(nodes[:k], node.name):
            known[f"name {node.name}"] = value
        else:
            done += folded_body((node,), known)
    return folded_body(done, functions)


def folded_body(nodes: Iterable[Any], functions: Mapping[str, Callable]) -> tuple:
    """Statements with constants worked out, branches decided and neighbouring texts joined."""
    done: list[Any] = []
    for node in nodes:
        if isinstance(node, Out):
            value = folded(node.value, functions)
            node = Text(_text(value.value)) if isinstance(value, Const) else Out(value)
        elif isinstance(node, Assign):
            node = Assign(node.name, folded(node.value, functions))
        elif isinstance(node, Loop):
            node = Loop(node.name, folded(node.over, functions), folded_body(node.body, functions))
        elif isinstance(node, Generation):
            node = Generation(folded_body(node.body, functions))
        elif isinstance(node, Branch):
            test = folded(node.test, functions)
            node = Branch(test, folded_body(node.then, functions), folded_body(node.other, functions))
        parts = (node.then if node.test.value else node.other) if isinstance(node, Branch) and isinstance(node.test, Const) else (node,)
        for part in parts:
            if isinstance(part, Text) and done and isinstance(done[-1], Text):
                done[-1] = Text(done[-1].text + part.text)
            elif part != Text(""):
                done.append(part)
    return tuple(done)


# Closures


class Mark:
    """Begin or end of generated text."""

    def __init__(self, name: str):
        self.name = name

    def __repr__(self) -> str:
        return self.name


BEGIN, END = Mark("BEGIN"), Mark("END")
Piece = str | Mark


def _value(node: Any, functions: Mapping[str, Callable]) -> Callable[[dict], Any]:
    if isinstance(node, Const):
        return lambda names, v=node.value: v
    if isinstance(node, Name):
        return lambda names, n=node.name: names.get(n, UNDEFINED)
    if isinstance(node, Item):
        of, key = _value(node.of, functions), _value(node.key, functions)

        def item(names: dict) -> Any:
            holder, k = of(names), key(names)
            if isinstance(holder, Mapping):
                return holder.get(k, UNDEFINED)
            if isinstance(holder, (list, tuple)) and isinstance(k, int):
                return holder[k] if -len(holder) <= k < len(holder) else UNDEFINED
            raise TemplateError(f"a {type(holder).__name__} has no items for templates")

        return item
    if isinstance(node, Choice):
        test, then, other = (_value(n, functions) for n in (node.test, node.then, node.other))
        return lambda names: then(names) if test(names) else other(names)
    args = [_value(a, functions) for a in node.args]
    if node.op == "and":
        return lambda names: args[0](names) and args[1](names)
    if node.op == "or":
        return lambda names: args[0](names) or args[1](names)
    f = functions[node.op]
    if len(args) == 1:
        one = args[0]
        return lambda names: f(one(names))
    a, b = args
    return lambda names: f(a(names), b(names))


def _looped(node: Loop, functions: Mapping[str, Callable]) -> Callable[[dict], Iterator[Piece]]:
    over, body = _value(node.over, functions), _body(node.body, functions)

    def run(names: dict) -> Iterator[Piece]:
        items = over(names)
        if isinstance(items, (str, Mapping)) or not isinstance(items, Iterable):
            raise TemplateError("a loop needs a list")
        rest = iter(items)
        ahead = next(rest, END)
        index = 0
        while ahead is not END:
            item, ahead = ahead, next(rest, END)
            about = {"index": index + 1, "index0": index, "first": index == 0, "last": ahead is END}
            yield from body({**names, node.name: item, "loop": about})
            index += 1

    return run


def _statement(node: Any, functions: Mapping[str, Callable]) -> Callable[[dict], Iterator[Piece]]:
    if isinstance(node, Text):
        return lambda names, t=(node.text,): iter(t)
    if isinstance(node, Loop):
        return _looped(node, functions)
    if isinstance(node, Out):
        value = _value(node.value, functions)
        return lambda names: iter((_text(value(names)),))
    if isinstance(node, Assign):
        value = _value(node.value, functions)

        def assign(names: dict) -> Iterator[Piece]:
            names[node.name] = value(names)
            return iter(())

        return assign
    if isinstance(node, Generation):
        body = _body(node.body, functions)
        return lambda names: itertools.chain((BEGIN,), body(names), (END,))
    test, then, other = _value(node.test, functions), _body(node.then, functions), _body(node.other, functions)
    return lambda names: then(names) if test(names) else other(names)


def _body(nodes: tuple, functions: Mapping[str, Callable]) -> Callable[[dict], Iterator[Piece]]:
    steps = [_statement(n, functions) for n in nodes]

    def run(names: dict) -> Iterator[Piece]:
        for step in steps:
            yield from step(names)

    return run


def _uses(node: Any, name: str) -> int:
    if isinstance(node, Name):
        return int(node.name == name)
    if isinstance(node, tuple):
        return sum(_uses(n, name) for n in node)
    return sum(_uses(getattr(node, f), name) for f in getattr(node, "__dataclass_fields__", ()))


@dataclass(frozen=True)
class Template:
    """A compiled template; a task compiles it once from its source."""

    source: str
    controls: Controls = Controls(())
    tree: tuple = field(init=False, compare=False, repr=False)
    streams: bool = field(init=False, compare=False, repr=False)

    def __post_init__(self) -> None:
        functions = _functions(self.controls)
        tree = folded_tree(parse(self.source), functions)
        loops = [n for n in tree if isinstance(n, Loop) and n.over == Name("messages")]
        object.__setattr__(self, "tree", tree)
        object.__setattr__(self, "streams", _uses(tree, "messages") == 1 == len(loops))
        object.__setattr__(self, "_run", _body(tree, functions))

    def __reduce__(self) -> tuple:
        return Template, (self.source, self.controls)

    def pieces(self, messages: Iterable[Mapping], **names: Any) -> Iterator[Piece]:
        """Texts and markers, in order. Messages are taken as they are needed where the template allows."""
        return self._run({**names, "messages": messages if self.streams else list(messages)})

    def render(self, messages: Iterable[Mapping], **names: Any) -> tuple[str, list[tuple[int, int]]]:
        """The whole text and the spans of generated text in it, in code points."""
        found = list(parts(self.pieces(messages, **names), None))
        return (found[0][0], found[0][1]) if found else ("", [])


def parts(pieces: Iterable[Piece], size: int | None) -> Iterator[tuple[str, list[tuple[int, int]]]]:
    """Texts of at least ``size`` characters, cut between pieces only, with their own generated spans."""
    texts: list[str] = []
    spans: list[tuple[int, int]] = []
    length, begin, given = 0, None, False
    for piece in pieces:
        if piece is BEGIN:
            begin = length
        elif piece is END:
            spans.append((begin, length))
            begin = None
        else:
            texts.append(piece)
            length += len(piece)
        if size is not None and length >= size:
            if begin is not None:
                spans.append((begin, length))
                begin = 0
            yield "".join(texts), spans
            texts, spans, length, given = [], [], 0, True
    if length or spans or not given:
        yield "".join(texts), spans


# Conversations

CONTROLS = Controls(("<s>", "</s>", "[INST]", "[/INST]", "[ROLE]", "[/ROLE]"))
CHAT = Template(
    """
{#- A turn: its role, then its text, generated or instructed. -#}
{%- set open = '<s>' ~ '[ROLE]' -%}
{%- for turn in messages -%}
  {{- open }}{{ turn.role | escape }}[/ROLE]
  {%- if turn.role == 'assistant' -%}
    {%- generation %}{{ turn.text | escape }}{% endgeneration -%}
  {%- else -%}
    {{- '[INST]' }}{{ turn.text | escape }}[/INST]
  {%- endif -%}
  </s>
{%- endfor -%}
""",
    CONTROLS,
)
FORMATTED = "conv_id long, part long, last boolean, text string, spans array<struct<start: long, end: long>>"
DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
PARTS = pa.schema([("conv_id", pa.int64()), ("part", pa.int64()), ("last", pa.bool_()), ("text", pa.string()), ("spans", SPANS)])


def _rows(batches: Iterable[pa.RecordBatch]) -> Iterator[dict]:
    return itertools.chain.from_iterable(b.to_pylist() for b in batches)


def _batches(rows: Iterable[dict], schema: pa.Schema, chars: Callable[[dict], int]) -> Iterator[pa.RecordBatch]:
    """Rows packed until they hold ``PART`` characters."""
    held: list[dict] = []
    size = 0
    for row in rows:
        held.append(row)
        size += 64 + chars(row)
        if size >= PART:
            yield pa.RecordBatch.from_pylist(held, schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def formatted(conversations: DataFrame, template: Template = CHAT, size: int = PART) -> DataFrame:
    """Conversations as the template renders them: one row per part, with its generated spans.

    Conversations below ``size`` characters have one part. Spans count from the start of their part.
    """

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for key, rows in itertools.groupby(_rows(batches), key=lambda r: r["conv_id"]):
            messages = ({"role": r["role"] or "", "text": r["text"] or ""} for r in rows)
            ahead = None
            for k, (text, spans) in enumerate(parts(template.pieces(messages), size)):
                if ahead:
                    yield {**ahead, "last": False}
                ahead = {"conv_id": key, "part": k, "text": text, "spans": [{"start": a, "end": b} for a, b in spans]}
            yield {**ahead, "last": True}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _batches(whole(batches), PARTS, lambda r: len(r["text"]))

    bounded_batches(conversations.sparkSession, 2000)
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.col("role").cast("string").alias("role"),
        F.col("text").cast("string").alias("text"),
    )
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(run, FORMATTED)


class Reader:
    """Reads the parts of one conversation in ``CHAT``'s format, one after another."""

    def __init__(self, controls: Controls = CONTROLS):
        self.marks = re.compile(f"({controls.pattern})")
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.n_turns = self.loss_chars = self.chars = 0
        self.place = ""

    def take(self, text: str, spans: Iterable[Mapping]) -> None:
        self.chars += len(text)
        for k, piece in enumerate(self.marks.split(text)):
            if k % 2:
                if piece == "<s>":
                    self.n_turns += 1
                elif piece == "[/ROLE]" or piece == "</s>":
                    self.turns.update(b"\n")
                self.place = piece
            elif piece:
                if self.place in ("", "<s>", "</s>", "[/INST]"):
                    raise ValueError("text outside a turn")
                self.turns.update(_encoded(Controls.unescape(piece)))
        for span in spans:
            own = Controls.unescape(text[span["start"] : span["end"]])
            self.loss.update(_encoded(own))
            self.loss_chars += len(own)

    def row(self, conv_id: int | None) -> dict:
        digests = {"turns_sha256": self.turns.hexdigest(), "loss_sha256": self.loss.hexdigest()}
        return {"conv_id": conv_id, "n_turns": self.n_turns, "loss_chars": self.loss_chars, "formatted_chars": self.chars, **digests}


def _encoded(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass")


ANSWERS = pa.schema(
    [("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())]
)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def whole() -> Iterator[dict]:
        reader = Reader()
        for row in _rows(batches):
            reader.take(row["text"], row["spans"])
            if row["last"]:
                yield reader.row(row["conv_id"])
                reader = Reader()

    return _batches(whole(), ANSWERS, lambda r: 256)


def read_back(output: DataFrame) -> DataFrame:
    """Turns and generated text of formatted conversations, as digests; ``output`` is read twice."""
    single = (F.col("part") == 0) & F.col("last")
    long = output.where(~single).repartition("conv_id").sortWithinPartitions("conv_id", "part")
    return output.where(single).mapInArrow(_read, DIGESTS).unionAll(long.mapInArrow(_read, DIGESTS))


ADDED = "</s>[INST] ok [/INST]"


def op13_chat_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ("conv_id", "turn", "role", "text")
    added = spark.range(1).selectExpr("explode(array(named_struct('turn', 0, 'role', 'user'), named_struct('turn', 1, 'role', 'assistant'))) AS r")
    added = added.select(F.lit(-7).alias("conv_id"), F.col("r.turn"), F.col("r.role"), F.lit(ADDED).alias("text"))
    rows = table(spark, sf_dir, "conversations").select(*names).unionAll(added.select(*names))
    return read_back(written(formatted(rows), "formatted"))
