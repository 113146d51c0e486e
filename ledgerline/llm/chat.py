"""Chat formatting by compiled templates.

A small, sandboxed template language is parsed into a syntax tree, constant parts are folded, and the tree becomes
nested Python closures. Rendering streams: a conversation is an iterator of messages, and chunks of text come out with
a mark that says whether they lie in a `generation` block. No template code is ever evaluated by Python, attributes are
keys of mappings only, there are no calls but the listed filters, and loops run over the given iterables alone.

    {{ expression }}   {% for x in items %}..{% endfor %}   {% if a %}..{% elif b %}..{% else %}..{% endif %}
    {% set x = e %}    {% generation %}..{% endgeneration %}   {# comment #}

Expressions: strings, integers, true, false, none, names, a.b, a['b'], + ~ == != < > <= >= in, not, and, or, x | filter,
and, in a loop, loop.index, loop.index0, loop.first, loop.last.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ship

#: Strings that mark turns; in texts they never appear unescaped.
CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]")
TEMPLATE = (
    "{# one turn: <s> role [INST] text [/INST] </s> #}"
    "{% for m in messages %}{{ '<s>' }}{{ m.role | guard }}{{ '[INST]' }}"
    "{% if m.role == 'assistant' %}{% generation %}{{ m.text | guard }}{% endgeneration %}{% else %}{{ m.text | guard }}{% endif %}"
    "{{ '[/INST]' + '</s>' }}{% endfor %}"
)
_CONTROL = re.compile("|".join(map(re.escape, CONTROLS)))


def escape(text: str) -> str:
    r"""Each backslash doubled, and one backslash put after the first character of each control string.

    A run of backslashes in the outcome is even, except for the single ones put in, so unescape() can tell them apart.
    """
    return _CONTROL.sub(lambda m: m[0][0] + "\\" + m[0][1:], text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return re.sub(r"\\(\\?)", r"\1", text)


FILTERS: dict[str, Callable] = {"guard": lambda v: escape(_text(v)), "upper": lambda v: _text(v).upper(), "lower": lambda v: _text(v).lower(), "trim": lambda v: _text(v).strip(), "length": lambda v: len(v or "")}
LEX = re.compile(r"\s*(?:(?P<str>'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(?P<int>\d+)|(?P<name>[A-Za-z_]\w*)|(?P<op>==|!=|<=|>=|[-+~<>()\[\].|=]))")
WORDS = {"and", "or", "not", "in", "true", "false", "none", "if", "else"}


class TemplateError(ValueError):
    pass


def _text(value) -> str:
    return "" if value is None else str(value)


def _lex(source: str) -> list[tuple[str, str]]:
    out, at = [], 0
    while source[at:].strip():
        m = LEX.match(source, at)
        if not m:
            raise TemplateError(f"cannot read {source[at:]!r}")
        kind = m.lastgroup
        out.append(("word" if kind == "name" and m[kind] in WORDS else kind, m[kind]))
        at = m.end()
    return [*out, ("end", "")]


class ExpressionParser:
    """Recursive descent to tuples: ('const', v), ('name', n), ('item', e, key), ('bin', op, a, b), ('not', e), ('filter', name, e)."""

    def __init__(self, source: str):
        self.tokens, self.at = _lex(source), 0

    def peek(self, *values: str) -> bool:
        return self.tokens[self.at][0] in ("op", "word") and self.tokens[self.at][1] in values

    def next(self) -> tuple[str, str]:
        self.at += 1
        return self.tokens[self.at - 1]

    def need(self, value: str) -> None:
        if self.next()[1] != value:
            raise TemplateError(f"{value!r} is missing")

    def whole(self):
        e = self.either()
        if self.tokens[self.at][0] != "end":
            raise TemplateError(f"unexpected {self.tokens[self.at][1]!r}")
        return e

    def _chain(self, ops: tuple[str, ...], below: Callable):
        e = below()
        while self.peek(*ops):
            op = self.next()[1]
            e = ("bin", op, e, below())
        return e

    def either(self):
        return self._chain(("or",), self.both)

    def both(self):
        return self._chain(("and",), self.negated)

    def negated(self):
        if self.peek("not"):
            self.next()
            return ("not", self.negated())
        return self._chain(("==", "!=", "<", ">", "<=", ">=", "in"), self.sum)

    def sum(self):
        return self._chain(("+", "~"), self.filtered)

    def filtered(self):
        e = self.atom()
        while self.peek("|"):
            self.next()
            name = self.next()[1]
            if name not in FILTERS:
                raise TemplateError(f"no filter {name!r}")
            e = ("filter", name, e)
        return e

    def atom(self):
        kind, value = self.next()
        if kind == "str":
            e = ("const", re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t"}.get(m[1], m[1]), value[1:-1]))
        elif kind == "int":
            e = ("const", int(value))
        elif value in ("true", "false", "none"):
            e = ("const", {"true": True, "false": False, "none": None}[value])
        elif kind == "name":
            e = ("name", value)
        elif value == "(":
            e = self.either()
            self.need(")")
        else:
            raise TemplateError(f"unexpected {value!r}")
        while self.peek(".", "["):
            if self.next()[1] == ".":
                kind, name = self.next()
                if kind != "name" or name.startswith("_"):
                    raise TemplateError(f"attribute {name!r} is not allowed")
                e = ("item", e, ("const", name))
            else:
                e = ("item", e, self.either())
                self.need("]")
        return e


def fold(e):
    """Constant subexpressions to their values."""
    kind = e[0]
    if kind in ("const", "name"):
        return e
    e = tuple(fold(x) if isinstance(x, tuple) else x for x in e)
    parts = [x for x in e[1:] if isinstance(x, tuple)]
    return ("const", close(e)({})) if all(x[0] == "const" for x in parts) else e


BINARY: dict[str, Callable] = {
    "+": lambda a, b: a + b if isinstance(a, int) and isinstance(b, int) else _text(a) + _text(b), "~": lambda a, b: _text(a) + _text(b), "==": lambda a, b: a == b, "!=": lambda a, b: a != b,
    "<": lambda a, b: a < b, ">": lambda a, b: a > b, "<=": lambda a, b: a <= b, ">=": lambda a, b: a >= b, "in": lambda a, b: a in b,
}


def close(e) -> Callable[[dict], object]:
    """An expression as a closure over the variables."""
    kind = e[0]
    if kind == "const":
        return lambda env, v=e[1]: v
    if kind == "name":
        return lambda env, n=e[1]: env.get(n)
    if kind == "not":
        return lambda env, f=close(e[1]): not f(env)
    if kind == "filter":
        return lambda env, f=FILTERS[e[1]], g=close(e[2]): f(g(env))
    if kind == "item":
        of, key = close(e[1]), close(e[2])

        def item(env):
            v = of(env)
            return v.get(key(env)) if isinstance(v, dict) else None

        return item
    a, b = close(e[2]), close(e[3])
    if e[1] == "and":
        return lambda env: a(env) and b(env)
    if e[1] == "or":
        return lambda env: a(env) or b(env)
    return lambda env, f=BINARY[e[1]]: f(a(env), b(env))


def parse(source: str) -> list[tuple]:
    """A template to a tree: ('text', s), ('out', e), ('for', name, e, body), ('if', [(e, body)..], else), ('set', name, e), ('generation', body)."""
    pieces = re.split(r"(\{\{.*?\}\}|\{%.*?%\}|\{#.*?#\})", source, flags=re.S)
    at = 0

    def block(ends: tuple[str, ...]) -> tuple[list[tuple], str]:
        nonlocal at
        body: list[tuple] = []
        while at < len(pieces):
            piece = pieces[at]
            at += 1
            if piece.startswith("{#"):
                continue
            if piece.startswith("{{"):
                body.append(("out", fold(ExpressionParser(piece[2:-2]).whole())))
            elif piece.startswith("{%"):
                said = piece[2:-2].strip().strip("-").strip()
                word, _, rest = said.partition(" ")
                if word in ends:
                    return body, said
                if word == "for":
                    m = re.fullmatch(r"\s*([A-Za-z]\w*)\s+in\s+(.+)", rest, re.S)
                    if not m:
                        raise TemplateError(f"cannot read {said!r}")
                    inner, _ = block(("endfor",))
                    body.append(("for", m[1], fold(ExpressionParser(m[2]).whole()), inner))
                elif word == "if":
                    arms, other, said = [], [], f"elif {rest}"
                    while said.startswith("elif"):
                        inner, after = block(("elif", "else", "endif"))
                        arms.append((fold(ExpressionParser(said[4:]).whole()), inner))
                        said = after
                    if said == "else":
                        other, _ = block(("endif",))
                    body.append(("if", arms, other))
                elif word == "set":
                    name, _, value = rest.partition("=")
                    body.append(("set", name.strip(), fold(ExpressionParser(value).whole())))
                elif word == "generation":
                    inner, _ = block(("endgeneration",))
                    body.append(("generation", inner))
                else:
                    raise TemplateError(f"unexpected {said!r}")
            elif piece:
                body.append(("text", piece))
        if ends:
            raise TemplateError(f"{' or '.join(ends)} is missing")
        return body, ""

    return simplify(block(())[0])


def simplify(body: list[tuple]) -> list[tuple]:
    """Constant output to text, branches that constants decide to their bodies, neighbouring texts to one."""
    out: list[tuple] = []
    for node in body:
        kind = node[0]
        if kind == "out" and node[1][0] == "const":
            node = ("text", _text(node[1][1]))
        elif kind == "for":
            node = ("for", node[1], node[2], simplify(node[3]))
        elif kind == "generation":
            node = ("generation", simplify(node[1]))
        elif kind == "if":
            arms, other = [], simplify(node[2])
            for e, inner in node[1]:
                if e[0] == "const" and not e[1]:
                    continue
                if e[0] == "const":
                    other = simplify(inner)
                    break
                arms.append((e, simplify(inner)))
            if not arms:
                for x in other:
                    _append(out, x)
                continue
            node = ("if", arms, other)
        _append(out, node)
    return out


def _append(out: list[tuple], node: tuple) -> None:
    if node[0] == "text" and out and out[-1][0] == "text":
        out[-1] = ("text", out[-1][1] + node[1])
    elif node != ("text", ""):
        out.append(node)


Chunks = Iterator[tuple[str, bool]]


def generate(body: list[tuple], inside: bool = False) -> Callable[[dict], Chunks]:
    """The tree as one closure: variables to chunks of (text, whether under the generation mark)."""
    made = [_node(n, inside) for n in body]

    def run(env: dict) -> Chunks:
        for f in made:
            yield from f(env)

    return run


def _node(node: tuple, inside: bool) -> Callable[[dict], Chunks]:
    kind = node[0]
    if kind == "text":
        chunk = ((node[1], inside),)
        return lambda env: iter(chunk)
    if kind == "out":
        f = close(node[1])
        return lambda env: iter(((_text(f(env)), inside),))
    if kind == "generation":
        return generate(node[1], True)
    if kind == "set":
        f, name = close(node[2]), node[1]

        def put(env: dict) -> Chunks:
            env[name] = f(env)
            return iter(())

        return put
    if kind == "if":
        arms, other = [(close(e), generate(b, inside)) for e, b in node[1]], generate(node[2], inside)
        return lambda env: next((b for e, b in arms if e(env)), other)(env)
    items, name, inner = close(node[2]), node[1], generate(node[3], inside)

    def loop(env: dict) -> Chunks:
        rest, i = iter(items(env) or ()), 0
        ahead = next(rest, rest)
        while ahead is not rest:
            now, ahead = ahead, next(rest, rest)
            own = env | {name: now, "loop": {"index": i + 1, "index0": i, "first": i == 0, "last": ahead is rest}}
            yield from inner(own)
            i += 1

    return loop


def compile_template(source: str) -> Callable[[Iterable[dict]], Chunks]:
    """A function from messages to chunks of (text, whether the loss covers it)."""
    run = generate(parse(source))
    return lambda messages: run({"messages": messages})


FORMATTED = "conv_id long, part long, formatted string, loss array<struct<start:long,end:long>>"


def format_partition(batches, template: str, size: int = 1 << 16):
    """Rows (conv_id, role, text), conversations together and in order, to rows of FORMATTED of about `size` characters.

    Parts of one conversation follow each other; loss spans are places in the whole formatted conversation.
    """
    render = compile_template(template)

    def rows():
        for b in batches:
            yield from zip(*(c.to_pylist() for c in b.columns), strict=True)

    struct = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    out: list[tuple] = []

    def flush():
        cols = zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.string(), struct), strict=True)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in cols], names=["conv_id", "part", "formatted", "loss"])

    held = 0
    for conv, turns in groupby(rows(), lambda r: r[0]):
        part, at, text, loss = 0, 0, [], []
        begun = 0
        for chunk, inside in render({"role": r, "text": t} for _, r, t in turns):
            text.append(chunk)
            if inside:
                loss.append({"start": at, "end": at + len(chunk)})
            at += len(chunk)
            if at - begun >= size:
                out.append((conv, part, "".join(text), loss))
                held += at - begun
                part, begun, text, loss = part + 1, at, [], []
                if held >= 1 << 22:
                    yield flush()
                    out.clear()
                    held = 0
        if text or not part:
            out.append((conv, part, "".join(text), loss))
            held += at - begun
        if held >= 1 << 22 or len(out) >= 1024:
            yield flush()
            out.clear()
            held = 0
    if out:
        yield flush()


def format_conversations(spark: SparkSession, conversations: DataFrame, template: str = TEMPLATE) -> DataFrame:
    """FORMATTED rows: each conversation's text in parts, in order, with the spans that the loss covers.

    A conversation is the rows of a conv_id (null is one too) by turn, null turns first; rows that repeat a turn are
    ordered by role and text. A null role or text counts as empty. An empty table gives no rows; further columns are
    ignored whatever their names. Partitions are sorted by Spark and rendered as a stream, so a conversation of any
    length needs the memory of a few parts.
    """
    ship(spark)
    empty = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    held = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), empty("role"), empty("text"))
    held = held.repartition("conv_id").sortWithinPartitions(F.col("conv_id"), F.col("turn").asc_nulls_first(), "role", "text")
    return held.select("conv_id", "role", "text").mapInArrow(lambda it: format_partition(it, template), FORMATTED)


class Reader:
    """Reads turns and loss text back from the parts of a conversation formatted by TEMPLATE."""

    def __init__(self):
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.n_turns = self.loss_chars = self.chars = 0
        self.rest = ""

    def feed(self, formatted: str, loss: list[dict]) -> None:
        for span in loss:  # a span lies within a part, and is one escaped text
            text = unescape(formatted[span["start"] - self.chars : span["end"] - self.chars])
            self.loss.update(text.encode("utf-8", "surrogatepass"))
            self.loss_chars += len(text)
        self.chars += len(formatted)
        *whole, self.rest = (self.rest + formatted).split("</s>")
        for turn in whole:
            role, _, text = turn.removeprefix("<s>").partition("[INST]")
            text = text.removesuffix("[/INST]")
            self.turns.update(f"{unescape(role)}\n{unescape(text)}\n".encode("utf-8", "surrogatepass"))
            self.n_turns += 1


DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def read_back(batches):
    """FORMATTED rows, parts of a conversation together, to one row of DIGEST for each."""
    names = [c.split()[0] for c in DIGEST.split(", ")]
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

    def rows():
        for b in batches:
            yield from zip(*(c.to_pylist() for c in b.columns), strict=True)

    out: list[tuple] = []
    for conv, parts in groupby(rows(), lambda r: r[0]):
        reader = Reader()
        for _, _, formatted, loss in parts:
            reader.feed(formatted, loss)
        out.append((conv, reader.n_turns, reader.turns.hexdigest(), reader.loss_chars, reader.loss.hexdigest(), reader.chars))
        if len(out) >= 4096:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)
            out.clear()
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)
