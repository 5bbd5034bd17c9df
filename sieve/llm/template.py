"""A small sandboxed template language, compiled to Python closures.

Syntax: ``{{ expression }}``, ``{% if %}/{% elif %}/{% else %}/{% endif %}``, ``{% for x in messages %}/{% endfor %}``,
``{% set name = expression %}``, ``{% generation %}/{% endgeneration %}`` and ``{# comment #}``; a ``-`` beside a delimiter
trims white space there. Expressions: strings, integers, true, false, none, names, ``a.b``, ``a['b']``, ``+ ~``,
``== != < <= > >= in``, ``and or not``, parentheses and filters (``| escape``). Items are looked up in mappings only:
no Python attribute or function can be reached. Loops run over what the caller passed, so rendering always ends.

``compile_template`` parses to a syntax tree, folds constant expressions and branches and joins constant text, then
makes closures. A closure yields pieces (text, generated); loops read their input lazily with one item of look-ahead, so a conversation of any length is rendered without being held.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator, Mapping
from dataclasses import dataclass
from typing import Any


class TemplateError(ValueError):
    pass


@dataclass(frozen=True)
class Node:
    kind: str
    value: Any = None
    parts: tuple = ()


TOKEN = re.compile(r"\s*(?:(\d+)|('(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|([A-Za-z_]\w*)|(==|!=|<=|>=|[-+~<>().\[\]|,=]))")
BLOCK = re.compile(r"\{\{(-?)(.*?)(-?)\}\}|\{%(-?)(.*?)(-?)%\}|\{#(-?).*?(-?)#\}", re.S)
COMPARE: dict[str, Callable[[Any, Any], Any]] = {
    "==": lambda a, b: a == b,
    "!=": lambda a, b: a != b,
    "<": lambda a, b: a < b,
    "<=": lambda a, b: a <= b,
    ">": lambda a, b: a > b,
    ">=": lambda a, b: a >= b,
    "in": lambda a, b: a in b,
}
CONSTANTS = {"true": True, "false": False, "none": None, "True": True, "False": False, "None": None}
FILTERS: dict[str, Callable[..., Any]] = {
    "trim": lambda v: str(v).strip(),
    "upper": lambda v: str(v).upper(),
    "lower": lambda v: str(v).lower(),
    "length": len,
    "default": lambda v, other="": other if v is None else v,
}


class _Expressions:
    def __init__(self, source: str):
        self.tokens: list[tuple[str, Any]] = []
        at, source = 0, source.strip()
        while at < len(source):
            m = TOKEN.match(source, at)
            if not m or m.end() == at:
                raise TemplateError(f"cannot read {source[at:]!r}")
            number, text, name, sign = m.groups()
            if number:
                self.tokens.append(("value", int(number)))
            elif text:
                self.tokens.append(("value", re.sub(r"\\(.)", lambda e: {"n": "\n", "t": "\t"}.get(e[1], e[1]), text[1:-1], flags=re.S)))
            elif name:
                self.tokens.append(("name", name))
            else:
                self.tokens.append(("sign", sign))
            at = m.end()
        self.at = 0

    def peek(self) -> tuple[str, Any]:
        return self.tokens[self.at] if self.at < len(self.tokens) else ("end", None)

    def take(self, *values: str) -> Any:
        kind, value = self.peek()
        if kind in ("name", "sign") and value in values:
            self.at += 1
            return value
        return None

    def need(self, value: str) -> None:
        if not self.take(value):
            raise TemplateError(f"expected {value!r}, found {self.peek()[1]!r}")

    def name(self) -> str:
        kind, value = self.peek()
        if kind != "name":
            raise TemplateError(f"expected a name, found {value!r}")
        self.at += 1
        return value

    def whole(self) -> Node:
        node = self.either()
        if self.peek()[0] != "end":
            raise TemplateError(f"unexpected {self.peek()[1]!r}")
        return node

    def either(self) -> Node:
        node = self.both()
        while self.take("or"):
            node = Node("or", parts=(node, self.both()))
        return node

    def both(self) -> Node:
        node = self.negated()
        while self.take("and"):
            node = Node("and", parts=(node, self.negated()))
        return node

    def negated(self) -> Node:
        return Node("not", parts=(self.negated(),)) if self.take("not") else self.compared()

    def compared(self) -> Node:
        node = self.summed()
        while sign := self.take(*COMPARE):
            node = Node("compare", sign, (node, self.summed()))
        return node

    def summed(self) -> Node:
        node = self.filtered()
        while sign := self.take("+", "~"):
            node = Node("add" if sign == "+" else "join", parts=(node, self.filtered()))
        return node

    def filtered(self) -> Node:
        node = self.item()
        while self.take("|"):
            name, given = self.name(), []
            if self.take("("):
                while not self.take(")"):
                    given.append(self.either())
                    self.take(",")
            node = Node("filter", name, (node, *given))
        return node

    def item(self) -> Node:
        kind, value = self.peek()
        if self.take("("):
            node = self.either()
            self.need(")")
        elif kind == "value":
            self.at += 1
            node = Node("const", value)
        else:
            name = self.name()
            node = Node("const", CONSTANTS[name]) if name in CONSTANTS else Node("name", name)
        while sign := self.take(".", "["):
            if sign == ".":
                node = Node("get", parts=(node, Node("const", self.name())))
            else:
                node = Node("get", parts=(node, self.either()))
                self.need("]")
        return node


def parse(source: str) -> Node:
    """The syntax tree of a template."""
    pieces: list[tuple[str, str]] = []
    at, trim = 0, False
    for m in BLOCK.finditer(source):
        text = source[at : m.start()]
        text = text.lstrip() if trim else text
        if "-" in (m[1], m[4], m[7]):
            text = text.rstrip()
        pieces.append(("text", text))
        if m[2] is not None:
            pieces.append(("expression", m[2]))
        elif m[5] is not None:
            pieces.append(("statement", m[5].strip()))
        at, trim = m.end(), "-" in (m[3], m[6], m[8])
    text = source[at:]
    pieces.append(("text", text.lstrip() if trim else text))
    place = 0

    def body(*ends: str) -> tuple[Node, str]:
        nonlocal place
        nodes: list[Node] = []
        while place < len(pieces):
            kind, value = pieces[place]
            place += 1
            if kind == "text":
                nodes.append(Node("text", value))
            elif kind == "expression":
                nodes.append(Node("print", parts=(_Expressions(value).whole(),)))
            else:
                word, _, rest = value.partition(" ")
                if word in ends:
                    return Node("body", parts=tuple(nodes)), value
                nodes.append(statement(word, rest))
        if ends:
            raise TemplateError(f"{ends[-1]} is missing")
        return Node("body", parts=tuple(nodes)), ""

    def statement(word: str, rest: str) -> Node:
        if word == "if":
            test = _Expressions(rest).whole()
            yes, end = body("elif", "else", "endif")
            if end.startswith("elif"):
                return Node("if", parts=(test, yes, statement("if", end[4:])))
            no = body("endif")[0] if end == "else" else Node("body")
            return Node("if", parts=(test, yes, no))
        if word == "for":
            e = _Expressions(rest)
            name = e.name()
            e.need("in")
            over = e.whole()
            return Node("for", name, (over, body("endfor")[0]))
        if word == "set":
            e = _Expressions(rest)
            name = e.name()
            e.need("=")
            return Node("set", name, (e.whole(),))
        if word == "generation":
            return Node("generation", parts=(body("endgeneration")[0],))
        raise TemplateError(f"unknown statement {word!r}")

    return body()[0]


def fold(node: Node) -> Node:
    """The tree with constant expressions computed, constant branches chosen and constant text joined."""
    parts = tuple(map(fold, node.parts))
    node = Node(node.kind, node.value, parts)
    constant = bool(parts) and all(p.kind == "const" for p in parts)
    if constant and node.kind in ("or", "and", "not", "compare", "add", "join") or constant and node.kind == "filter" and node.value in FILTERS:
        try:
            return Node("const", _expression(node, FILTERS)({}))
        except (TypeError, ValueError):
            return node  # fails when it is rendered, if it is
    if node.kind == "print" and constant:
        return Node("text", _shown(parts[0].value))
    if node.kind == "if" and parts[0].kind == "const":
        return parts[1] if parts[0].value else parts[2]
    if node.kind == "body":
        flat: list[Node] = []
        for p in parts:
            for q in p.parts if p.kind == "body" else (p,):
                if q.kind == "text" and flat and flat[-1].kind == "text":
                    flat[-1] = Node("text", flat[-1].value + q.value)
                elif q.kind != "text" or q.value:
                    flat.append(q)
        return Node("body", parts=tuple(flat))
    return node


def _shown(value: Any) -> str:
    return "" if value is None else str(value)


def _get(of: Any, key: Any) -> Any:
    if isinstance(of, Mapping):
        return of.get(key)
    raise TemplateError(f"no item {key!r} in {type(of).__name__}")


def _expression(node: Node, filters: Mapping[str, Callable]) -> Callable[[dict], Any]:
    kind, value = node.kind, node.value
    if kind == "const":
        return lambda scope: value
    if kind == "name":
        return lambda scope: scope.get(value)
    p = [_expression(x, filters) for x in node.parts]
    if kind == "get":
        return lambda scope: _get(p[0](scope), p[1](scope))
    if kind == "or":
        return lambda scope: p[0](scope) or p[1](scope)
    if kind == "and":
        return lambda scope: p[0](scope) and p[1](scope)
    if kind == "not":
        return lambda scope: not p[0](scope)
    if kind == "compare":
        test = COMPARE[value]
        return lambda scope: test(p[0](scope), p[1](scope))
    if kind == "add":
        return lambda scope: p[0](scope) + p[1](scope)
    if kind == "join":
        return lambda scope: _shown(p[0](scope)) + _shown(p[1](scope))
    if kind == "filter":
        if value not in filters:
            raise TemplateError(f"unknown filter {value!r}")
        f = filters[value]
        return lambda scope: f(*(x(scope) for x in p))
    raise TemplateError(f"not an expression: {kind}")


def _ahead(items: Iterable[Any]) -> Iterable[tuple[Any, bool]]:
    it = iter(items)
    try:
        item = next(it)
    except StopIteration:
        return
    for following in it:
        yield item, False
        item = following
    yield item, True


Piece = tuple[str, bool]


def _closure(node: Node, filters: Mapping[str, Callable]) -> Callable[[dict, bool], Iterator[Piece]]:
    kind, value = node.kind, node.value
    if kind == "text":

        def text(scope, generated):
            yield value, generated

        return text
    if kind == "print":
        shown = _expression(node.parts[0], filters)

        def show(scope, generated):
            yield _shown(shown(scope)), generated

        return show
    if kind == "body":
        steps = [_closure(p, filters) for p in node.parts]

        def body(scope, generated):
            for step in steps:
                yield from step(scope, generated)

        return body
    if kind == "if":
        test, yes, no = _expression(node.parts[0], filters), _closure(node.parts[1], filters), _closure(node.parts[2], filters)
        return lambda scope, generated: (yes if test(scope) else no)(scope, generated)
    if kind == "set":
        new = _expression(node.parts[0], filters)

        def assign(scope, generated):
            scope[value] = new(scope)
            yield from ()

        return assign
    if kind == "generation":
        inner = _closure(node.parts[0], filters)
        return lambda scope, generated: inner(scope, True)
    if kind == "for":
        over, inner = _expression(node.parts[0], filters), _closure(node.parts[1], filters)

        def loop(scope, generated):
            for k, (item, last) in enumerate(_ahead(over(scope) or ())):
                scope[value], scope["loop"] = item, {"index0": k, "index": k + 1, "first": k == 0, "last": last}
                yield from inner(scope, generated)

        return loop
    raise TemplateError(f"not a statement: {kind}")


def compile_template(source: str, filters: Mapping[str, Callable] | None = None) -> Callable[[dict], Iterator[Piece]]:
    """render(variables): the pieces (text, generated) of the output, in order; empty ones are left out."""
    run = _closure(fold(parse(source)), FILTERS | dict(filters or {}))
    return lambda variables: (piece for piece in run(dict(variables), False) if piece[0])
