"""Chat formatting: a compiler for a small sandboxed template language.

Language: literal text, ``{{ expression }}`` and the tags ``{% for x in e %}``,
``{% if e %} {% elif e %} {% else %}``, ``{% set x = e %}``, ``{% generation %}`` with their
``{% end... %}``.  Expressions: names, strings, whole numbers, ``a.b`` (a key of a mapping),
``==``, ``!=``, ``and``, ``or``, ``not``, ``~`` (joins strings), ``e if c else d``, filters (``e | name``) and
brackets; ``loop.first``, ``loop.last`` and ``loop.index0`` inside a loop.  There are no calls, no
attributes of Python objects and no other names than the variables given, so a
template can reach nothing but its input.

A template is parsed into a syntax tree, constant parts are folded, and every node
becomes a Python closure.  Rendering gives the text and the spans written inside
``{% generation %}``: the loss mask.

Control strings inside texts are escaped: ``\\`` is put before each of them and before
each ``\\``; reading back drops every first ``\\``.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clusterscope.session import ship_package

OPEN, ROLE_END, CLOSE = "### ", ": ", "</turn>"
TEMPLATE = ("{% for m in messages %}### {{ m.role | escape }}: "
            "{% if m.role == 'assistant' %}{% generation %}{{ m.text | escape }}{% endgeneration %}{% else %}{{ m.text | escape }}{% endif %}"
            "</turn>{% if not loop.last %}\n{% endif %}{% endfor %}")
_TO_ESCAPE = re.compile(r"\\|(?=" + "|".join(map(re.escape, (OPEN.strip(), ROLE_END.strip(), CLOSE))) + ")")


def escape(text: str) -> str:
    return _TO_ESCAPE.sub(lambda m: "\\" + m.group(), text)


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


FILTERS: dict[str, Callable[[str], str]] = {"escape": escape, "trim": str.strip, "upper": str.upper, "lower": str.lower}


class TemplateError(ValueError):
    pass


# --- syntax tree ------------------------------------------------------------------

@dataclass
class Const:
    value: object


@dataclass
class Name:
    name: str


@dataclass
class Key:
    of: object
    key: str


@dataclass
class Op:
    op: str
    args: list


@dataclass
class Filter:
    name: str
    of: object


@dataclass
class Block:
    parts: list = field(default_factory=list)


@dataclass
class Put:
    value: object


@dataclass
class Set:
    name: str
    value: object


@dataclass
class If:
    test: object
    then: Block
    other: Block


@dataclass
class For:
    name: str
    of: object
    body: Block


@dataclass
class Generation:
    body: Block


# --- parser --------------------------------------------------------------------------

_PIECE = re.compile(r"\{\{(.*?)\}\}|\{%(.*?)%\}", re.S)
_TOKEN = re.compile(r"\s*(?:(\d+)|'((?:[^'\\]|\\.)*)'|\"((?:[^\"\\]|\\.)*)\"|([A-Za-z_]\w*)|(==|!=|[.|~()=]))", re.S)
_WORDS = {"and", "or", "not", "if", "else", "in"}


def _tokens(source: str) -> list[tuple[str, object]]:
    out, at = [], 0
    source = source.rstrip()
    while at < len(source):
        m = _TOKEN.match(source, at)
        if not m:
            raise TemplateError(f"can't read {source[at:]!r}")
        number, one, two, name, sign = m.groups()
        if number is not None:
            out.append(("const", int(number)))
        elif one is not None or two is not None:
            text = one if one is not None else two
            out.append(("const", re.sub(r"\\(.)", lambda x: {"n": "\n", "t": "\t"}.get(x.group(1), x.group(1)), text, flags=re.S)))
        elif name is not None:
            out.append(("word" if name in _WORDS else "name", name))
        else:
            out.append(("sign", sign))
        at = m.end()
    return out


class _Expression:
    """Recursive descent, loosest binding first."""

    def __init__(self, tokens: list):
        self.tokens, self.at = tokens, 0

    def accept(self, *token) -> bool:
        if self.at < len(self.tokens) and self.tokens[self.at] == token:
            self.at += 1
            return True
        return False

    def whole(self):
        tree = self.choice()
        if self.at < len(self.tokens):
            raise TemplateError(f"unexpected {self.tokens[self.at][1]!r}")
        return tree

    def choice(self):
        tree = self.some()
        if self.accept("word", "if"):
            test = self.some()
            if not self.accept("word", "else"):
                raise TemplateError("'if' without 'else' in an expression")
            return Op("choice", [test, tree, self.choice()])
        return tree

    def some(self):
        tree = self.every()
        while self.accept("word", "or"):
            tree = Op("or", [tree, self.every()])
        return tree

    def every(self):
        tree = self.negation()
        while self.accept("word", "and"):
            tree = Op("and", [tree, self.negation()])
        return tree

    def negation(self):
        return Op("not", [self.negation()]) if self.accept("word", "not") else self.equality()

    def equality(self):
        tree = self.joined()
        for sign in ("==", "!="):
            if self.accept("sign", sign):
                return Op(sign, [tree, self.joined()])
        return tree

    def joined(self):
        tree = self.filtered()
        while self.accept("sign", "~"):
            tree = Op("~", [tree, self.filtered()])
        return tree

    def filtered(self):
        tree = self.atom()
        while self.accept("sign", "|"):
            name = self.name()
            if name not in FILTERS:
                raise TemplateError(f"no filter {name!r}")
            tree = Filter(name, tree)
        return tree

    def name(self) -> str:
        if self.at >= len(self.tokens) or self.tokens[self.at][0] != "name":
            raise TemplateError("a name is missing")
        self.at += 1
        return self.tokens[self.at - 1][1]

    def atom(self):
        if self.accept("sign", "("):
            tree = self.choice()
            if not self.accept("sign", ")"):
                raise TemplateError("')' is missing")
        elif self.at < len(self.tokens) and self.tokens[self.at][0] == "const":
            tree = Const(self.tokens[self.at][1])
            self.at += 1
        else:
            tree = Name(self.name())
        while self.accept("sign", "."):
            tree = Key(tree, self.name())
        return tree


def _expression(tokens: list):
    return _Expression(tokens).whole()


def parse(source: str) -> Block:
    """Syntax tree of a template."""
    pieces, at = [], 0
    for m in _PIECE.finditer(source):
        if m.start() > at:
            pieces.append(("text", source[at:m.start()]))
        pieces.append(("put", _tokens(m.group(1))) if m.group(1) is not None else ("tag", _tokens(m.group(2))))
        at = m.end()
    if at < len(source):
        pieces.append(("text", source[at:]))
    pieces.reverse()

    def block(*ends: str) -> tuple[Block, list]:
        out = Block()
        while pieces:
            kind, what = pieces.pop()
            if kind == "text":
                out.parts.append(Put(Const(what)))
            elif kind == "put":
                out.parts.append(Put(_expression(what)))
            else:
                head = what[0][1] if what else None
                if head in ends:
                    return out, what
                out.parts.append(tag(head, what[1:]))
        if ends:
            raise TemplateError(f"{' or '.join(ends)} is missing")
        return out, []

    def tag(head, rest):
        if head == "generation" and not rest:
            return Generation(block("endgeneration")[0])
        if head == "for" and len(rest) > 2 and rest[0][0] == "name" and rest[1] == ("word", "in"):
            return For(rest[0][1], _expression(rest[2:]), block("endfor")[0])
        if head == "set" and len(rest) > 2 and rest[0][0] == "name" and rest[1] == ("sign", "="):
            return Set(rest[0][1], _expression(rest[2:]))
        if head == "if" and rest:
            then, end = block("elif", "else", "endif")
            if end[0][1] == "elif":
                return If(_expression(rest), then, Block([tag("if", end[1:])]))
            return If(_expression(rest), then, block("endif")[0] if end[0][1] == "else" else Block())
        raise TemplateError(f"unknown tag {head!r}")

    return block()[0]


# --- constant folding --------------------------------------------------------------------

def _string(value) -> str:
    return "" if value is None else value if isinstance(value, str) else str(value) if isinstance(value, int) else _bad(value)


def _bad(value):
    raise TemplateError("only strings and numbers can be written")


_OPS: dict[str, Callable] = {"==": lambda a, b: a == b, "!=": lambda a, b: a != b, "not": lambda a: not a, "~": lambda a, b: _string(a) + _string(b),
                             "and": lambda a, b: a and b, "or": lambda a, b: a or b, "choice": lambda c, a, b: a if c else b}


def fold(node):
    """The same tree with constant expressions, branches and neighbouring texts put together."""
    if isinstance(node, Op):
        args = [fold(a) for a in node.args]
        return Const(_OPS[node.op](*(a.value for a in args))) if all(isinstance(a, Const) for a in args) else Op(node.op, args)
    if isinstance(node, Filter):
        of = fold(node.of)
        return Const(FILTERS[node.name](_string(of.value))) if isinstance(of, Const) else Filter(node.name, of)
    if isinstance(node, Key):
        return Key(fold(node.of), node.key)
    if isinstance(node, Put):
        value = fold(node.value)
        return Put(Const(_string(value.value)) if isinstance(value, Const) else value)
    if isinstance(node, Set):
        return Set(node.name, fold(node.value))
    if isinstance(node, For):
        return For(node.name, fold(node.of), fold(node.body))
    if isinstance(node, Generation):
        return Generation(fold(node.body))
    if isinstance(node, If):
        test = fold(node.test)
        if isinstance(test, Const):
            return fold(node.then if test.value else node.other)
        return If(test, fold(node.then), fold(node.other))
    if isinstance(node, Block):
        parts: list = []
        for p in map(fold, node.parts):
            for q in p.parts if isinstance(p, Block) else [p]:
                if isinstance(q, Put) and isinstance(q.value, Const) and parts and isinstance(parts[-1], Put) and isinstance(parts[-1].value, Const):
                    parts[-1] = Put(Const(parts[-1].value.value + q.value.value))
                else:
                    parts.append(q)
        return Block(parts)
    return node


# --- closures -----------------------------------------------------------------------------

def _value(node) -> Callable[[dict], object]:
    if isinstance(node, Const):
        return lambda env, v=node.value: v
    if isinstance(node, Name):
        def name(env, n=node.name):
            if n not in env:
                raise TemplateError(f"no variable {n!r}")
            return env[n]
        return name
    if isinstance(node, Key):
        def key(env, of=_value(node.of), k=node.key):
            held = of(env)
            if type(held) is not dict or k not in held:
                raise TemplateError(f"no key {k!r}")
            return held[k]
        return key
    if isinstance(node, Filter):
        return lambda env, f=FILTERS[node.name], of=_value(node.of): f(_string(of(env)))
    args = [_value(a) for a in node.args]
    if node.op == "and":
        return lambda env: args[0](env) and args[1](env)
    if node.op == "or":
        return lambda env: args[0](env) or args[1](env)
    if node.op == "choice":
        return lambda env: args[1](env) if args[0](env) else args[2](env)
    return lambda env, f=_OPS[node.op]: f(*(a(env) for a in args))


class _Out:
    def __init__(self):
        self.parts, self.size, self.spans = [], 0, []

    def write(self, text: str) -> None:
        self.parts.append(text)
        self.size += len(text)


def _writer(node) -> Callable[[dict, _Out], None]:
    if isinstance(node, Block):
        writers = [_writer(p) for p in node.parts]

        def block(env, out):
            for w in writers:
                w(env, out)
        return block
    if isinstance(node, Put):
        return lambda env, out, v=_value(node.value): out.write(_string(v(env)))
    if isinstance(node, Set):
        def put(env, out, v=_value(node.value), n=node.name):
            env[n] = v(env)
        return put
    if isinstance(node, If):
        return lambda env, out, t=_value(node.test), a=_writer(node.then), b=_writer(node.other): (a if t(env) else b)(env, out)
    if isinstance(node, Generation):
        def generation(env, out, body=_writer(node.body)):
            start = out.size
            body(env, out)
            out.spans.append((start, out.size))
        return generation

    def loop(env, out, of=_value(node.of), body=_writer(node.body), n=node.name):
        items = of(env)
        if not isinstance(items, list):
            raise TemplateError("only lists can be looped over")
        inner = dict(env)
        for i, item in enumerate(items):
            inner[n] = item
            inner["loop"] = {"first": i == 0, "last": i == len(items) - 1, "index0": i}
            body(inner, out)
    return loop


def compile_template(source: str) -> Callable[[dict], tuple[str, list[tuple[int, int]]]]:
    """A function from variables to (text, generation spans in code points)."""
    write = _writer(fold(parse(source)))

    def render(variables: dict) -> tuple[str, list[tuple[int, int]]]:
        out = _Out()
        write(dict(variables), out)
        return "".join(out.parts), out.spans
    return render


# --- Spark ------------------------------------------------------------------------------------

def _rendered(template: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        render = compile_template(template)
        for batch in batches:
            texts, spans = [], []
            for turns in batch.column("turns").to_pylist():
                messages = [{"role": t["role"] or "", "text": t["text"] or ""} for t in turns]
                text, marked = render({"messages": messages})
                texts.append(text)
                spans.append([{"start": a, "end": b} for a, b in marked])
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), pa.array(texts, pa.string()),
                                              pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))],
                                             names=["conv_id", "formatted", "loss_spans"])
    return run


def format_conversations(conversations: DataFrame, template: str = TEMPLATE) -> DataFrame:
    """One row per conv_id: conv_id, formatted (text) and loss_spans (start, end in code points).

    ``conversations`` has conv_id, turn, role and text; other columns are ignored.  Turns
    come by turn (null first), then role, then text; repeated rows are turns of their own.
    A null role or text is empty.  Rows without a conv_id are one conversation
    whose conv_id is null.
    """
    ship_package(conversations.sparkSession)
    turns = F.sort_array(F.collect_list(F.struct(F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"),
                                                 F.col("text").cast("string").alias("text"))))
    return (conversations.groupBy(F.col("conv_id").cast("long").alias("conv_id")).agg(turns.alias("turns"))
            .mapInArrow(_rendered(template), "conv_id long, formatted string, loss_spans array<struct<start:long,end:long>>"))


_CONTROL = re.compile(r"\\.|### |: |</turn>\n?", re.S)


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of all turns of a conversation written with ``TEMPLATE``."""
    out, role, start, where = [], "", 0, CLOSE
    for m in _CONTROL.finditer(formatted):
        mark = m.group()
        if mark == OPEN and where == CLOSE:
            where, start = OPEN, m.end()
        elif mark == ROLE_END and where == OPEN:
            role, where, start = unescape(formatted[start:m.start()]), ROLE_END, m.end()
        elif mark.startswith(CLOSE) and where == ROLE_END:
            out.append((role, unescape(formatted[start:m.start()])))
            where = CLOSE
    return out


def _read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    digest = lambda text: hashlib.sha256(text.encode()).hexdigest()
    for batch in batches:
        rows = []
        for formatted, spans in zip(batch.column("formatted").to_pylist(), batch.column("loss_spans").to_pylist()):
            turns = read_turns(formatted)
            loss = "".join(unescape(formatted[s["start"]:s["end"]]) for s in spans)
            rows.append((len(turns), digest("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), digest(loss), len(formatted)))
        cols = list(zip(*rows)) if rows else [()] * 5
        yield pa.RecordBatch.from_arrays(
            [batch.column("conv_id"), *(pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())))],
            names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])


def read_back(formatted: DataFrame) -> DataFrame:
    """What the formatted conversations hold: turns and the text under the loss mask, as counts and digests."""
    return formatted.mapInArrow(_read_back, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
