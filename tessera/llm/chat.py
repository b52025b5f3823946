"""Chat formatting by a small template compiler.

Templates are text with ``{{ expression }}`` and ``{% statement %}``.  The language is a sandbox: names,
string and integer literals, ``.field``, ``+``, ``==``, ``!=``, ``not``, ``and``, ``or`` and the filters below;
statements ``for NAME in NAME``, ``if/elif/else``, ``set NAME = expression`` and ``generation`` (marks text that carries loss).
There are no calls, no indexing and no attributes of Python objects.  A template is parsed into a syntax
tree, constants are folded, and the tree becomes nested Python closures that yield (text, marked) pieces.

One call renders a whole conversation, headers, footers and names that are set from turn to turn included.
The messages are read and the pieces are yielded one by one, so a conversation of any length streams.
What ``escape`` has to protect and the grammar by which formatted text is read back follow from the
template's tree.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator
from itertools import chain, groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Emitter, arrow_schema, rows

OPEN, CLOSE = "### ", "</turn>\n"
TEMPLATE = (
    "{% for m in messages %}"
    "{{ '### ' + m.role|escape + ': ' }}"
    "{% if m.role == 'assistant' %}{% generation %}{{ m.text|escape }}{% endgeneration %}{% else %}{{ m.text|escape }}{% endif %}"
    "{{ '</turn>' + '\\n' }}"
    "{% endfor %}"
)
#: Characters of formatted text in a row of the output, at least; a row ends between two pieces.
CHUNK_CHARS = 1 << 15
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)

Escape = Callable[[str], str]


def escaper(signs: set[str]) -> Escape:
    """Puts a backslash before every one of ``signs`` and every backslash; ``unescape`` undoes it."""
    control = re.compile("[" + "".join(map(re.escape, sorted(signs | {"\\"}))) + "]")
    return lambda text: control.sub(r"\\\g<0>", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


#: Filters besides ``escape``, which depends on the template.
FILTERS: dict[str, Callable[[str], str]] = {"trim": str.strip, "upper": str.upper, "lower": str.lower, "title": str.title}


class TemplateError(ValueError):
    """The template isn't in the language."""


# --- parser: source -> syntax tree of tuples ----------------------------------------------------------

_PARTS = re.compile(r"\{\{(.*?)\}\}|\{%(.*?)%\}|\{#.*?#\}", re.DOTALL)
_TOKEN = re.compile(r"\s*(?:('(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(\d+)|([A-Za-z_]\w*)|(==|!=|[().|+=]))", re.DOTALL)
_SIGNS = {"n": "\n", "t": "\t", "r": "\r"}


def lex(source: str) -> list[tuple[str, object]]:
    out, at, source = [], 0, source.rstrip()
    while at < len(source):
        m = _TOKEN.match(source, at)
        if not m:
            raise TemplateError(f"unexpected text: {source[at : at + 20]!r}")
        if m[1] is not None:
            out.append(("const", re.sub(r"\\(.)", lambda x: _SIGNS.get(x[1], x[1]), m[1][1:-1], flags=re.DOTALL)))
        elif m[2] is not None:
            out.append(("const", int(m[2])))
        else:
            out.append(("name", m[3]) if m[3] is not None else ("sign", m[4]))
        at = m.end()
    return out


class Parser:
    def __init__(self, source: str):
        self.items: list[tuple[str, str]] = []
        at = 0
        for m in _PARTS.finditer(source):
            if m.start() > at:
                self.items.append(("text", source[at : m.start()]))
            if m[1] is not None:
                self.items.append(("expr", m[1]))
            elif m[2] is not None:
                self.items.append(("stmt", m[2].strip()))
            at = m.end()
        if at < len(source):
            self.items.append(("text", source[at:]))
        self.at = 0

    def parse(self) -> tuple:
        tree, end = self.block(())
        return tree

    def block(self, ends: tuple[str, ...]) -> tuple[tuple, str]:
        """Statements up to one whose first word is in ``ends``; that statement's text."""
        nodes = []
        while self.at < len(self.items):
            kind, body = self.items[self.at]
            self.at += 1
            if kind == "text":
                nodes.append(("out", ("const", body)))
            elif kind == "expr":
                nodes.append(("out", self.expression(body)))
            else:
                word = body.split()[0] if body else ""
                if word in ends:
                    return ("seq", nodes), body
                nodes.append(self.statement(word, body))
        if ends:
            raise TemplateError(f"{ends[-1]} is missing")
        return ("seq", nodes), ""

    def statement(self, word: str, body: str) -> tuple:
        if word == "for":
            m = re.fullmatch(r"for\s+([A-Za-z_]\w*)\s+in\s+([A-Za-z_]\w*)", body)
            if not m:
                raise TemplateError(f"not a loop: {body!r}")
            return ("for", m[1], m[2], self.block(("endfor",))[0])
        if word == "set":
            m = re.fullmatch(r"set\s+([A-Za-z_]\w*)\s*=(?!=)(.*)", body, re.DOTALL)
            if not m:
                raise TemplateError(f"not an assignment: {body!r}")
            return ("set", m[1], self.expression(m[2]))
        if word == "generation":
            return ("mark", self.block(("endgeneration",))[0])
        if word == "if":
            arms, test = [], self.expression(body[2:])
            while True:
                then, end = self.block(("elif", "else", "endif"))
                arms.append((test, then))
                if end.startswith("elif"):
                    test = self.expression(end[4:])
                else:
                    return ("if", arms, self.block(("endif",))[0] if end.startswith("else") else ("seq", []))
        raise TemplateError(f"unknown statement: {body!r}")

    def expression(self, source: str) -> tuple:
        tokens = lex(source)
        tree, at = self.binary(tokens, 0, 0)
        if at != len(tokens):
            raise TemplateError(f"unexpected text in {source!r}")
        return tree

    LEVELS = (("or",), ("and",), ("==", "!="), ("+",))

    def binary(self, tokens, at: int, level: int) -> tuple[tuple, int]:
        if level == len(self.LEVELS):
            return self.unary(tokens, at)
        left, at = self.binary(tokens, at, level + 1)
        while at < len(tokens) and tokens[at][0] != "const" and tokens[at][1] in self.LEVELS[level]:
            sign = tokens[at][1]
            right, at = self.binary(tokens, at + 1, level + 1)
            left = ("op", sign, left, right)
        return left, at

    def unary(self, tokens, at: int) -> tuple[tuple, int]:
        if at >= len(tokens):
            raise TemplateError("an expression ends too soon")
        kind, value = tokens[at]
        if (kind, value) == ("name", "not"):
            tree, at = self.unary(tokens, at + 1)
            return ("not", tree), at
        if (kind, value) == ("sign", "("):
            tree, at = self.binary(tokens, at + 1, 0)
            if at >= len(tokens) or tokens[at] != ("sign", ")"):
                raise TemplateError("a bracket isn't closed")
        elif kind == "sign":
            raise TemplateError(f"unexpected {value!r}")
        else:
            tree = (kind, value)
        at += 1
        while at + 1 < len(tokens) and tokens[at][0] == "sign" and tokens[at][1] in ".|" and tokens[at + 1][0] == "name":
            sign, name = tokens[at][1], tokens[at + 1][1]
            if sign == "|" and name != "escape" and name not in FILTERS:
                raise TemplateError(f"no such filter: {name}")
            if sign == "." and name.startswith("_"):
                raise TemplateError(f"no such field: {name}")
            tree = ("filter" if sign == "|" else "field", name, tree)
            at += 2
        return tree, at


# --- constant folding ---------------------------------------------------------------------------------


def text_of(value: object) -> str:
    return "" if value is None else value if isinstance(value, str) else str(value)


def operate(sign: str, a: object, b: object) -> object:
    if sign == "==":
        return a == b
    if sign == "!=":
        return a != b
    return a + b if isinstance(a, int) and isinstance(b, int) else text_of(a) + text_of(b)


def fold(node: tuple) -> tuple:
    """The tree with constant expressions computed, decided branches taken and neighbouring texts joined."""
    kind = node[0]
    if kind == "op":
        a, b = fold(node[2]), fold(node[3])
        if node[1] in ("and", "or"):
            if a[0] == "const":
                return b if bool(a[1]) == (node[1] == "and") else a
        elif a[0] == b[0] == "const":
            return ("const", operate(node[1], a[1], b[1]))
        elif node[1] == "+" and b[0] == "const" and isinstance(b[1], str) and a[0] == "op" and a[1] == "+" and a[3][0] == "const" and isinstance(a[3][1], str):
            return ("op", "+", a[2], ("const", a[3][1] + b[1]))
        return ("op", node[1], a, b)
    if kind == "not":
        a = fold(node[1])
        return ("const", not a[1]) if a[0] == "const" else ("not", a)
    if kind == "filter":
        a = fold(node[2])
        return ("const", FILTERS[node[1]](text_of(a[1]))) if a[0] == "const" and node[1] != "escape" else ("filter", node[1], a)
    if kind == "field":
        return ("field", node[1], fold(node[2]))
    if kind == "out":
        return ("out", fold(node[1]))
    if kind == "set":
        return ("set", node[1], fold(node[2]))
    if kind == "mark":
        return ("mark", fold(node[1]))
    if kind == "for":
        return ("for", node[1], node[2], fold(node[3]))
    if kind == "if":
        arms, other = [], fold(node[2])
        for test, then in node[1]:
            test = fold(test)
            if test[0] != "const":
                arms.append((test, fold(then)))
            elif test[1]:
                other = fold(then)
                break
        return ("if", arms, other) if arms else other
    if kind == "seq":
        nodes: list[tuple] = []
        for child in map(fold, node[1]):
            for n in child[1] if child[0] == "seq" else [child]:
                if n[0] == "out" and n[1][0] == "const" and nodes and nodes[-1][0] == "out" and nodes[-1][1][0] == "const":
                    nodes[-1] = ("out", ("const", text_of(nodes[-1][1][1]) + text_of(n[1][1])))
                else:
                    nodes.append(n)
        return ("seq", nodes)
    return node


# --- closures -----------------------------------------------------------------------------------------


def value_closure(node: tuple, escape: Escape) -> Callable[[dict], object]:
    kind = node[0]
    if kind == "const":
        value = node[1]
        return lambda scope: value
    if kind == "name":
        name = node[1]
        return lambda scope: scope.get(name)
    if kind == "field":
        name, of = node[1], value_closure(node[2], escape)
        return lambda scope: v.get(name) if isinstance(v := of(scope), dict) else None
    if kind == "filter":
        function, of = escape if node[1] == "escape" else FILTERS[node[1]], value_closure(node[2], escape)
        return lambda scope: function(text_of(of(scope)))
    if kind == "not":
        of = value_closure(node[1], escape)
        return lambda scope: not of(scope)
    sign, a, b = node[1], value_closure(node[2], escape), value_closure(node[3], escape)
    if sign == "and":
        return lambda scope: a(scope) and b(scope)
    if sign == "or":
        return lambda scope: a(scope) or b(scope)
    return lambda scope: operate(sign, a(scope), b(scope))


Pieces = Iterator[tuple[str, bool]]


def closure(node: tuple, escape: Escape, marked: bool = False) -> Callable[[dict], Pieces]:
    """The generator function of a statement; ``marked`` holds inside a generation block."""
    kind = node[0]
    if kind == "out":
        of = value_closure(node[1], escape)

        def out(scope: dict) -> Pieces:
            yield text_of(of(scope)), marked

        return out
    if kind == "seq":
        parts = [closure(n, escape, marked) for n in node[1]]
        return lambda scope: chain.from_iterable(p(scope) for p in parts)
    if kind == "mark":
        return closure(node[1], escape, True)
    if kind == "set":
        name, of = node[1], value_closure(node[2], escape)

        def put(scope: dict) -> Pieces:
            scope[name] = of(scope)
            return iter(())

        return put
    if kind == "if":
        arms, other = [(value_closure(t, escape), closure(n, escape, marked)) for t, n in node[1]], closure(node[2], escape, marked)

        def branch(scope: dict) -> Pieces:
            return next((then for test, then in arms if test(scope)), other)(scope)

        return branch
    name, source, body = node[1], node[2], closure(node[3], escape, marked)

    def loop(scope: dict) -> Pieces:
        """Names that the body sets last from turn to turn and beyond the loop; the loop's own name doesn't."""
        items, before = scope.get(source), scope.get(name)
        for item in items if isinstance(items, Iterable) and not isinstance(items, (str, dict)) else ():
            scope[name] = item
            yield from body(scope)
        scope[name] = before

    return loop


def nodes(tree: tuple) -> Iterator[tuple]:
    """The tree and all that is in it."""
    yield tree
    for child in tree[1:]:
        for part in child if isinstance(child, list) else [child]:
            for node in part if isinstance(part, tuple) and part and isinstance(part[0], tuple) else [part]:
                if isinstance(node, tuple) and node:
                    yield from nodes(node)


def literals(value: tuple) -> Iterator[str]:
    """The texts that an expression can put out beside its fields."""
    if value[0] == "const":
        yield text_of(value[1])
    elif value[0] == "op" and value[1] not in ("==", "!="):
        yield from literals(value[2])
        yield from literals(value[3])


class Template:
    """A compiled template: ``render`` gives the pieces of a whole conversation, ``read`` its turns back from them."""

    def __init__(self, source: str = TEMPLATE):
        self.tree = fold(Parser(source).parse())
        # whatever can follow an escaped text begins with one of these
        signs = {text[0] for n in nodes(self.tree) if n[0] == "out" for text in literals(n[1]) if text}
        self.signs = signs | {"\\"}
        self.pieces = closure(self.tree, escaper(signs))
        self.loops = sum(n[0] == "for" and n[2] == "messages" for n in nodes(self.tree))

    def render(self, messages: Iterable[dict], **names) -> Pieces:
        """The (text, marked) pieces; a template that goes through the messages once takes them one by one."""
        return self.pieces({**names, "messages": messages if self.loops <= 1 else list(messages)})

    def read(self, texts: Iterable[str]) -> Iterator[dict[str, str]]:
        """The escaped fields of each turn of a conversation that is given in any number of texts.  ValueError if it isn't one."""
        top = self.tree[1]
        at = [k for k, n in enumerate(top) if n[0] == "for" and n[2] == "messages"]
        if len(at) != 1 or self.loops != 1:
            raise TemplateError("only a template with one loop over the messages can be read back")
        groups: dict[str, str] = {}
        head, turn, foot = (re.compile(self.grammar(("seq", part), top[at[0]][1], groups), re.DOTALL) for part in (top[: at[0]], [top[at[0]][3]], top[at[0] + 1 :]))
        more = iter(texts)
        held, tried = "", 0

        def need(size: int) -> bool:
            """Reads on until more than ``size`` characters are held."""
            nonlocal held
            parts, have = [held], len(held)
            while have <= size and (piece := next(more, None)) is not None:
                parts.append(piece)
                have += len(piece)
            held = "".join(parts)
            return have > size

        need(1 << 12)
        start = head.match(held)
        if not start:
            raise ValueError("the formatted text doesn't begin like the template")
        held = held[start.end() :]
        while need(tried) or held:
            at, ended = 0, not need(len(held))
            while (m := turn.match(held, at)) and m.end() > at and (m.end() < len(held) or ended):
                at = m.end()
                yield {groups[g]: v for g, v in m.groupdict().items() if v is not None}
            held = held[at:]
            if ended:
                if not foot.fullmatch(held):
                    raise ValueError("the formatted text ends inside a turn")
                return
            tried = 0 if at else 2 * len(held)  # a long turn is tried again when twice as much is there
        if not foot.fullmatch(held):
            raise ValueError("the formatted text doesn't end like the template")

    def grammar(self, node: tuple, item: str, groups: dict[str, str]) -> str:
        """A pattern for what a statement puts out; escaped fields of ``item`` are groups, named in ``groups``."""
        kind = node[0]
        if kind == "seq":
            return "".join(self.grammar(n, item, groups) for n in node[1])
        if kind == "mark":
            return self.grammar(node[1], item, groups)
        if kind == "set":
            return ""
        if kind == "if":
            arms = [self.grammar(n, item, groups) for n in (*[then for _, then in node[1]], node[2])]
            return "(?:" + "|".join(arms) + ")"
        if kind == "out":
            return self.grammar(node[1], item, groups)
        if kind == "const":
            return re.escape(text_of(node[1]))
        if kind == "op" and node[1] == "+":
            return self.grammar(node[2], item, groups) + self.grammar(node[3], item, groups)
        if kind == "filter" and node[1] == "escape" and node[2] == ("field", node[2][1], ("name", item)):
            group = f"g{len(groups)}"
            groups[group] = node[2][1]
            plain = "[^" + "".join(map(re.escape, sorted(self.signs))) + "]"
            return rf"(?P<{group}>(?:{plain}++|\\.)*+)"
        raise TemplateError("only constants and escaped fields of the message can be read back")


# --- plans --------------------------------------------------------------------------------------------


def format_conversations(df: DataFrame, template: str = TEMPLATE) -> DataFrame:
    """(conv_id, chunk_no, formatted, marks) of ``df`` (conv_id, turn, role, text): each conversation rendered by one call.

    The chunks of a conversation, joined in order, are what the template yields for it; ``marks`` are the
    code point ranges [start, end) of a chunk that carry loss.  Null roles and texts are empty; null
    conv_ids form one conversation; turns order null first, equal turns by role and text; repeated rows
    are repeated turns.  Other columns are ignored; an empty table gives an empty result.  Rows are
    sorted, not grouped: a conversation of any length streams through one task, a chunk at a time.
    """
    Template(template)
    out = arrow_schema(conv_id=pa.int64(), chunk_no=pa.int64(), formatted=pa.string(), marks=pa.list_(pa.int32()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = Template(template)
        turns = (row for batch in batches for row in zip(*rows(batch, "conv_id", "role", "text"), strict=True))
        e = Emitter(out, 64)
        for conv, own in groupby(turns, key=lambda row: row[0]):
            number, texts, marks, at = 0, [], [], 0
            for piece, marked in compiled.render({"role": role or "", "text": text or ""} for _, role, text in own):
                if at >= CHUNK_CHARS:
                    e.add(conv, number, "".join(texts), marks)
                    number, texts, marks, at = number + 1, [], [], 0
                    if e.full():
                        yield e.take()
                texts.append(piece)
                if marked:
                    marks += [at, at + len(piece)]
                at += len(piece)
            e.add(conv, number, "".join(texts), marks)
            if e.full():
                yield e.take()
        yield e.take()

    turns = df.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").alias("turn"), F.col("role").alias("role"), F.col("text").alias("text"))
    placed = turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return placed.mapInArrow(run, "conv_id long, chunk_no long, formatted string, marks array<int>")


def conversation_digests(formatted: DataFrame, template: str = TEMPLATE) -> DataFrame:
    """The contract row of each conversation, read back from the chunks by the template's grammar.

    ``formatted`` comes straight from ``format_conversations``, so the chunks of a conversation follow each other in
    one partition (ValueError if they don't).  Digests are updated turn by turn.
    """
    out = arrow_schema(
        conv_id=pa.int64(), n_turns=pa.int64(), turns_sha256=pa.string(), loss_chars=pa.int64(), loss_sha256=pa.string(), formatted_chars=pa.int64()
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled, e = Template(template), Emitter(out)
        chunks = (row for batch in batches for row in zip(*rows(batch, "conv_id", "chunk_no", "formatted", "marks"), strict=True))
        for conv, own in groupby(chunks, key=lambda row: row[0]):
            turns, loss, sizes = hashlib.sha256(), hashlib.sha256(), [0, 0, 0]

            def texts(own=own, loss=loss, sizes=sizes) -> Iterator[str]:
                for k, (_, number, text, marks) in enumerate(own):
                    if number != k:
                        raise ValueError("the chunks of a conversation are apart")
                    for a, b in zip(marks[::2], marks[1::2], strict=True):
                        said = unescape(text[a:b])
                        sizes[1] += len(said)
                        loss.update(said.encode("utf-8", "surrogatepass"))
                    sizes[2] += len(text)
                    yield text

            for fields in compiled.read(texts()):
                sizes[0] += 1
                turns.update(f"{unescape(fields.get('role', ''))}\n{unescape(fields.get('text', ''))}\n".encode("utf-8", "surrogatepass"))
            e.add(conv, sizes[0], turns.hexdigest(), sizes[1], loss.hexdigest(), sizes[2])
            if e.full():
                yield e.take()
        yield e.take()

    return formatted.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
