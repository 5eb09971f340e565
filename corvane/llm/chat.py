"""Chat formatting: a compiler for a small sandboxed template language.

A template is parsed into a syntax tree, constants are folded, and every node becomes a Python closure that writes into
a renderer. There is no attribute access on Python objects, no call other than registered filters, and no
name that the caller has not passed, so a template cannot reach the interpreter.

    {{ expression }}   {% for x in xs %}..{% endfor %}   {% if e %}..{% elif e %}..{% else %}..{% endif %}
    {% set x = e %}    {% generation %}..{% endgeneration %}      {# comment #}

Expressions: strings, integers, true, false, none, names, x.key, x['key'], == != < > + ~ and or not in, parentheses,
``| filter``; in a loop, loop.index, loop.first and loop.last. Text written inside generation markers is recorded as
character spans of the output, the loss mask.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as tk


class TemplateError(ValueError):
    pass


# --- syntax tree -------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Const:
    value: object


@dataclass(frozen=True)
class Name:
    name: str


@dataclass(frozen=True)
class Item:
    of: object
    key: object


@dataclass(frozen=True)
class Apply:
    op: str
    args: tuple


@dataclass(frozen=True)
class Filter:
    name: str
    of: object


@dataclass(frozen=True)
class Output:
    value: object


@dataclass(frozen=True)
class Block:
    body: tuple


@dataclass(frozen=True)
class For:
    name: str
    of: object
    body: object


@dataclass(frozen=True)
class If:
    test: object
    then: object
    other: object


@dataclass(frozen=True)
class Set:
    name: str
    value: object


@dataclass(frozen=True)
class Generation:
    body: object


_TAG = re.compile(r"(\{\{.*?\}\}|\{%.*?%\}|\{#.*?#\})", re.DOTALL)
_TOKEN = re.compile(r"""\s*(?:(?P<str>'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")|(?P<int>\d+)|(?P<name>[A-Za-z_]\w*)|(?P<op>==|!=|[<>+~|.\[\]()=]))""", re.DOTALL)
_ESCAPES = {"n": "\n", "t": "\t"}


class _Expression:
    """A recursive-descent parser of one expression."""

    def __init__(self, source: str):
        self.tokens, at = [], 0
        source = source.strip()
        while at < len(source):
            m = _TOKEN.match(source, at)
            if not m:
                raise TemplateError(f"unexpected {source[at:at + 10]!r}")
            self.tokens.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.at = 0

    def peek(self, *values: str) -> bool:
        return self.at < len(self.tokens) and self.tokens[self.at][0] in ("op", "name") and self.tokens[self.at][1] in values

    def take(self, *values: str) -> str | None:
        if self.peek(*values):
            self.at += 1
            return self.tokens[self.at - 1][1]
        return None

    def need(self, kind: str, *values: str) -> str:
        if self.at >= len(self.tokens) or self.tokens[self.at][0] != kind or values and self.tokens[self.at][1] not in values:
            raise TemplateError(f"expected {' or '.join(values) or kind}")
        self.at += 1
        return self.tokens[self.at - 1][1]

    def whole(self):
        tree = self.either()
        if self.at < len(self.tokens):
            raise TemplateError(f"unexpected {self.tokens[self.at][1]!r}")
        return tree

    def either(self):
        tree = self.both()
        while self.take("or"):
            tree = Apply("or", (tree, self.both()))
        return tree

    def both(self):
        tree = self.inverse()
        while self.take("and"):
            tree = Apply("and", (tree, self.inverse()))
        return tree

    def inverse(self):
        return Apply("not", (self.inverse(),)) if self.take("not") else self.compare()

    def compare(self):
        tree = self.sum()
        while op := self.take("==", "!=", "<", ">", "in"):
            tree = Apply(op, (tree, self.sum()))
        return tree

    def sum(self):
        tree = self.filtered()
        while op := self.take("+", "~"):
            tree = Apply(op, (tree, self.filtered()))
        return tree

    def filtered(self):
        tree = self.primary()
        while self.take("|"):
            tree = Filter(self.need("name"), tree)
        return tree

    def primary(self):
        kind, value = self.tokens[self.at] if self.at < len(self.tokens) else (None, "the end")
        self.at += 1
        if kind == "str":
            tree = Const(re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[1]), value[1:-1], flags=re.DOTALL))
        elif kind == "int":
            tree = Const(int(value))
        elif kind == "name" and value in ("true", "false", "none"):
            tree = Const({"true": True, "false": False, "none": None}[value])
        elif kind == "name":
            tree = Name(value)
        elif value == "(":
            tree = self.either()
            self.need("op", ")")
        else:
            raise TemplateError(f"unexpected {value!r}")
        while op := self.take(".", "["):
            if op == ".":
                tree = Item(tree, Const(self.need("name")))
            else:
                tree = Item(tree, self.either())
                self.need("op", "]")
        return tree


def parse(source: str) -> Block:
    """The syntax tree of a template."""
    parts = [p for p in _TAG.split(source) if p and not p.startswith("{#")]
    at = 0

    def block(*ends: str) -> tuple[Block, str, str]:
        nonlocal at
        body = []
        while at < len(parts):
            part = parts[at]
            at += 1
            if part.startswith("{{"):
                body.append(Output(_Expression(part[2:-2]).whole()))
            elif part.startswith("{%"):
                word, _, rest = part[2:-2].strip().partition(" ")
                if word in ends:
                    return Block(tuple(body)), word, rest
                body.append(statement(word, rest))
            else:
                body.append(Output(Const(part)))
        if ends:
            raise TemplateError(f"missing {ends[-1]}")
        return Block(tuple(body)), "", ""

    def choice(test: str) -> If:
        then, end, rest = block("elif", "else", "endif")
        other = choice(rest) if end == "elif" else block("endif")[0] if end == "else" else Block(())
        return If(_Expression(test).whole(), then, other)

    def statement(word: str, rest: str):
        if word == "for":
            e = _Expression(rest)
            name = e.need("name")
            e.need("name", "in")
            of = e.whole()
            return For(name, of, block("endfor")[0])
        if word == "if":
            return choice(rest)
        if word == "set":
            e = _Expression(rest)
            name = e.need("name")
            e.need("op", "=")
            return Set(name, e.whole())
        if word == "generation":
            return Generation(block("endgeneration")[0])
        raise TemplateError(f"unknown statement {word!r}")

    return block()[0]


# --- constant folding --------------------------------------------------------------------------------------------

_BINARY: dict[str, Callable] = {
    "==": lambda a, b: a == b,
    "!=": lambda a, b: a != b,
    "<": lambda a, b: a < b,
    ">": lambda a, b: a > b,
    "in": lambda a, b: a in b,
    "+": lambda a, b: a + b,
    "~": lambda a, b: _text(a) + _text(b),
}


def _text(value: object) -> str:
    return "" if value is None else str(value)


def fold(tree, filters: dict[str, Callable]):
    """The tree with constant expressions evaluated, decided branches taken and neighbouring constant text joined."""
    again = lambda t: fold(t, filters)
    match tree:
        case Item(of, key):
            return Item(again(of), again(key))
        case Filter(name, of):
            if name not in filters:
                raise TemplateError(f"unknown filter {name!r}")
            of = again(of)
            return Const(filters[name](_text(of.value))) if isinstance(of, Const) else Filter(name, of)
        case Apply(op, args):
            args = tuple(map(again, args))
            if op in ("and", "or") and isinstance(args[0], Const):
                return args[1] if bool(args[0].value) == (op == "and") else args[0]
            if all(isinstance(a, Const) for a in args):
                return Const(not args[0].value if op == "not" else _BINARY[op](args[0].value, args[1].value))
            return Apply(op, args)
        case Output(value):
            value = again(value)
            return Output(Const(_text(value.value))) if isinstance(value, Const) else Output(value)
        case For(name, of, body):
            return For(name, again(of), again(body))
        case Set(name, value):
            return Set(name, again(value))
        case Generation(body):
            return Generation(again(body))
        case If(test, then, other):
            test = again(test)
            if isinstance(test, Const):
                return again(then if test.value else other)
            return If(test, again(then), again(other))
        case Block(body):
            out = []
            for node in map(again, body):
                for n in node.body if isinstance(node, Block) else (node,):
                    if out and isinstance(n, Output) and isinstance(n.value, Const) and isinstance(out[-1], Output) and isinstance(out[-1].value, Const):
                        out[-1] = Output(Const(out[-1].value.value + n.value.value))
                    else:
                        out.append(n)
            return Block(tuple(out))
    return tree


# --- closures ----------------------------------------------------------------------------------------------------


@dataclass
class Rendered:
    """What a template wrote, and the character spans written inside generation markers."""

    parts: list[str] = field(default_factory=list)
    size: int = 0
    spans: list[tuple[int, int]] = field(default_factory=list)

    def write(self, text: str) -> None:
        self.parts.append(text)
        self.size += len(text)

    @property
    def text(self) -> str:
        return "".join(self.parts)


def _value(tree, filters) -> Callable[[dict], object]:
    match tree:
        case Const(value):
            return lambda names: value
        case Name(name):
            return lambda names: names.get(name)
        case Item(of, key):
            of, key = _value(of, filters), _value(key, filters)

            def item(names):
                where, k = of(names), key(names)
                if isinstance(where, dict):
                    return where.get(k)
                return where[k] if isinstance(where, (list, tuple)) and isinstance(k, int) and k < len(where) else None

            return item
        case Filter(name, of):
            call, of = filters[name], _value(of, filters)
            return lambda names: call(_text(of(names)))
        case Apply("and", (a, b)):
            a, b = _value(a, filters), _value(b, filters)
            return lambda names: a(names) and b(names)
        case Apply("or", (a, b)):
            a, b = _value(a, filters), _value(b, filters)
            return lambda names: a(names) or b(names)
        case Apply("not", (a,)):
            a = _value(a, filters)
            return lambda names: not a(names)
        case Apply(op, (a, b)):
            call, a, b = _BINARY[op], _value(a, filters), _value(b, filters)
            return lambda names: call(a(names), b(names))
    raise TemplateError(f"not an expression: {tree!r}")


def _writer(tree, filters) -> Callable[[dict, Rendered], None]:
    match tree:
        case Output(Const(text)):
            return lambda names, out: out.write(text)
        case Output(value):
            value = _value(value, filters)
            return lambda names, out: out.write(_text(value(names)))
        case Set(name, value):
            value = _value(value, filters)

            def assign(names, out):
                names[name] = value(names)

            return assign
        case If(test, then, other):
            test, then, other = _value(test, filters), _writer(then, filters), _writer(other, filters)
            return lambda names, out: then(names, out) if test(names) else other(names, out)
        case Generation(body):
            body = _writer(body, filters)

            def mark(names, out):
                start = out.size
                body(names, out)
                out.spans.append((start, out.size))

            return mark
        case For(name, of, body):
            of, body = _value(of, filters), _writer(body, filters)

            def loop(names, out):
                items = list(of(names) or ())
                for i, x in enumerate(items):
                    body({**names, name: x, "loop": {"index": i + 1, "first": i == 0, "last": i == len(items) - 1}}, out)

            return loop
        case Block(nodes):
            nodes = [_writer(n, filters) for n in nodes]

            def run(names, out):
                for node in nodes:
                    node(names, out)

            return run
    raise TemplateError(f"not a statement: {tree!r}")


class Template:
    """A compiled template. ``controls`` are strings that the ``escape`` filter keeps out of texts, reversibly."""

    def __init__(self, source: str, controls: tuple[str, ...] = ()):
        starts = "|".join(re.escape(c[0]) + (f"(?={re.escape(c[1:])})" if c[1:] else "") for c in controls)
        special = re.compile(rf"\\|{starts}" if starts else r"\\")
        # a backslash goes after the first character of every control string, also of overlapping ones, and backslashes double
        filters = {"escape": lambda s: special.sub(r"\g<0>\\", s), "trim": str.strip, "upper": str.upper, "lower": str.lower, "capitalize": str.capitalize}
        self.tree = fold(parse(source), filters)
        self._write = _writer(self.tree, filters)

    def render(self, **names: object) -> Rendered:
        out = Rendered()
        self._write(dict(names), out)
        return out


def unescape(text: str) -> str:
    """What the escape filter was given: of two backslashes one stays, and one after another character goes."""
    return re.sub(r"\\(\\)?", r"\1", text)


# --- the default layout ------------------------------------------------------------------------------------------

#: Every turn opens with its role in a heading line and ends with a closing tag.
TURNS = """{% for m in messages %}### {{ m.role | escape }}:
{% if m.role == 'assistant' %}{% generation %}{{ m.text | escape }}{% endgeneration %}{% else %}{{ m.text | escape }}{% endif %}</turn>
{% endfor %}"""
CONTROLS = ("###", "</turn>", ":\n")
_TURN = re.compile(r"### (.*?):\n(.*?)</turn>\n", re.DOTALL)


def chat_template() -> Template:
    return Template(TURNS, CONTROLS)


def read_turns(output: str) -> list[tuple[str, str]]:
    """The (role, text) turns of an output of the default layout. Control strings cannot stand inside either."""
    turns, at = [], 0
    while at < len(output):
        m = _TURN.match(output, at)
        if not m:
            raise ValueError(f"no turn at {at}")
        turns.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    return turns


def _digest(messages: list[dict], template: Template) -> tuple:
    out = template.render(messages=messages)
    text = out.text
    turns, loss = hashlib.sha256(), hashlib.sha256()
    n = chars = 0
    for role, said in read_turns(text):
        turns.update(f"{role}\n{said}\n".encode("utf-8", "surrogatepass"))
        n += 1
    for a, b in out.spans:
        said = unescape(text[a:b])
        chars += len(said)
        loss.update(said.encode("utf-8", "surrogatepass"))
    return text, [list(s) for s in out.spans], n, turns.hexdigest(), chars, loss.hexdigest(), len(text)


def format_conversations(conversations: DataFrame, texts: bool = True) -> DataFrame:
    """(conv_id, formatted, loss_spans, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars), a row for each conv_id.

    conversations: conv_id, turn, role, text; other columns are ignored. Turns go in order of (turn, role, text), nulls
    first, so repeated rows and ties have a fixed order; a null role or text is empty, a null conv_id is one
    conversation of its own. The digests are of what reading the output back gives. texts: without it the first two
    columns are left out. Each conversation is rendered by one task as its sorted rows stream by; only that conversation is held.
    """
    tk.ship(conversations.sparkSession)
    fields = [("conv_id", pa.int64()), ("formatted", pa.string()), ("loss_spans", pa.list_(pa.list_(pa.int64()))), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())]
    ddl = ["conv_id long", "formatted string", "loss_spans array<array<bigint>>", "n_turns long", "turns_sha256 string", "loss_chars long", "loss_sha256 string", "formatted_chars long"]
    if not texts:
        fields, ddl = fields[:1] + fields[3:], ddl[:1] + ddl[3:]
    schema = pa.schema(fields)

    def rows(batches: Iterable[pa.RecordBatch]):
        template = chat_template()
        now, messages = None, []
        for batch in batches:
            for conv, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text"))):
                if messages and conv != now:
                    yield (now, *_digest(messages, template))
                    messages = []
                now = conv
                messages.append({"role": role or "", "text": text or ""})
        if messages:
            yield (now, *_digest(messages, template))

    def run(batches):
        out, size = [], 0
        for row in rows(batches):
            out.append(row if texts else row[:1] + row[3:])
            size += len(row[1])
            if size > 4 << 20:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
                out, size = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    chosen = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    return chosen.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text").mapInArrow(run, ", ".join(ddl))
