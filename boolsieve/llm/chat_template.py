"""A small sandboxed template language, compiled to Python closures.

``{{ expression }}`` prints, ``{% for x in xs %} {% endfor %}`` repeats, ``{% if e %} {% elif e %} {% else %} {% endif %}``
chooses, ``{% generation %} {% endgeneration %}`` marks what a model is to learn. Expressions have strings, whole numbers,
true, false, none, names, ``a.b`` and ``a['b']`` (keys of mappings only), ``+`` (joins), ``== !=``, ``and or not``,
brackets, filters (``| name``) of a fixed set, and ``loop.first`` and ``loop.index``. There are no calls, attributes or imports.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from typing import Any

Scope = dict[str, Any]
#: What a statement prints: pieces of text, and whether a generation block holds them.
Pieces = Iterator[tuple[str, bool]]


class TemplateError(ValueError):
    """The template breaks the language's rules, or a name in it has no value."""


@dataclass(frozen=True)
class Const:
    value: Any


@dataclass(frozen=True)
class Name:
    name: str


@dataclass(frozen=True)
class Key:
    of: Any
    key: str


@dataclass(frozen=True)
class Filter:
    of: Any
    name: str


@dataclass(frozen=True)
class Op:
    name: str
    args: tuple


@dataclass(frozen=True)
class Print:
    what: Any


@dataclass(frozen=True)
class For:
    name: str
    over: Any
    body: tuple


@dataclass(frozen=True)
class If:
    branches: tuple


@dataclass(frozen=True)
class Generation:
    body: tuple


_TAG = re.compile(r"\{\{(.*?)\}\}|\{%(.*?)%\}", re.S)
_TOKEN = re.compile(r"\s*(?:(?P<str>'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(?P<num>\d+)|(?P<name>[A-Za-z_]\w*)|(?P<op>==|!=|[-+~|.()\[\]]))", re.S)
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}


class _Expression:
    """Recursive descent: or, and, not, comparison, plus, filters, keys."""

    def __init__(self, source: str) -> None:
        self.tokens: list[tuple[str, str]] = []
        at = 0
        while source[at:].strip():
            m = _TOKEN.match(source, at)
            if not m:
                raise TemplateError(f"can't read {source[at:]!r}")
            self.tokens.append((m.lastgroup or "", m[m.lastgroup or 0]))
            at = m.end()
        self.at = 0

    def peek(self) -> tuple[str, str]:
        return self.tokens[self.at] if self.at < len(self.tokens) else ("end", "")

    def take(self, *values: str) -> str | None:
        kind, value = self.peek()
        if kind in ("op", "name") and value in values:
            self.at += 1
            return value
        return None

    def need(self, value: str) -> None:
        if not self.take(value):
            raise TemplateError(f"{value!r} is missing")

    def whole(self) -> Any:
        node = self.either()
        if self.peek()[0] != "end":
            raise TemplateError(f"{self.peek()[1]!r} is not expected")
        return node

    def either(self) -> Any:
        node = self.both()
        while self.take("or"):
            node = Op("or", (node, self.both()))
        return node

    def both(self) -> Any:
        node = self.negated()
        while self.take("and"):
            node = Op("and", (node, self.negated()))
        return node

    def negated(self) -> Any:
        return Op("not", (self.negated(),)) if self.take("not") else self.compared()

    def compared(self) -> Any:
        node = self.joined()
        while op := self.take("==", "!="):
            node = Op(op, (node, self.joined()))
        return node

    def joined(self) -> Any:
        node = self.filtered()
        while self.take("+", "~"):
            node = Op("+", (node, self.filtered()))
        return node

    def filtered(self) -> Any:
        node = self.atom()
        while True:
            if self.take("|"):
                node = Filter(node, self.word())
            elif self.take("."):
                node = Key(node, self.word())
            elif self.take("["):
                kind, value = self.peek()
                if kind != "str":
                    raise TemplateError("only a string can stand in [ ]")
                self.at += 1
                node = Key(node, _string(value))
                self.need("]")
            else:
                return node

    def word(self) -> str:
        kind, value = self.peek()
        if kind != "name":
            raise TemplateError("a name is missing")
        self.at += 1
        return value

    def atom(self) -> Any:
        kind, value = self.peek()
        self.at += 1
        if kind == "str":
            return Const(_string(value))
        if kind == "num":
            return Const(int(value))
        if kind == "name":
            return Const({"true": True, "false": False, "none": None}[value]) if value in ("true", "false", "none") else Name(value)
        if value == "(":
            node = self.either()
            self.need(")")
            return node
        raise TemplateError(f"{value or 'the end'!r} is not expected")


def _string(literal: str) -> str:
    return re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[1]), literal[1:-1], flags=re.S)


def parse(source: str) -> tuple:
    """The syntax tree of a template."""
    parts: list[Any] = []
    at = 0
    for m in _TAG.finditer(source):
        if m.start() > at:
            parts.append(Print(Const(source[at : m.start()])))
        parts.append(Print(_Expression(m[1]).whole()) if m[1] is not None else m[2].strip())
        at = m.end()
    if source[at:]:
        parts.append(Print(Const(source[at:])))
    tree, rest, end = _block(parts, 0, ())
    if end is not None:
        raise TemplateError(f"{end!r} is not expected")
    assert rest == len(parts)
    return tree


def _block(parts: list, at: int, ends: tuple[str, ...]) -> tuple[tuple, int, str | None]:
    """The nodes up to a tag of which the first word is in ``ends``, the place after it, and the tag."""
    out: list[Any] = []
    while at < len(parts):
        part = parts[at]
        at += 1
        if isinstance(part, Print):
            out.append(part)
            continue
        word, _, rest = part.partition(" ")
        if word in ends:
            return tuple(out), at, part
        if word == "for":
            m = re.fullmatch(r"([A-Za-z_]\w*)\s+in\s+(.+)", rest.strip(), re.S)
            if not m:
                raise TemplateError(f"can't read {part!r}")
            body, at, _ = _block(parts, at, ("endfor",))
            out.append(For(m[1], _Expression(m[2]).whole(), body))
        elif word == "generation":
            body, at, _ = _block(parts, at, ("endgeneration",))
            out.append(Generation(body))
        elif word == "if":
            branches, end = [], part
            while end != "endif":
                test = Const(True) if end == "else" else _Expression(end.partition(" ")[2]).whole()
                body, at, end = _block(parts, at, ("endif",) if end == "else" else ("elif", "else", "endif"))
                branches.append((test, body))
            out.append(If(tuple(branches)))
        else:
            raise TemplateError(f"there is no tag {word!r} here")
    if ends:
        raise TemplateError(f"{ends[-1]!r} is missing")
    return tuple(out), at, None


def _truth(value: Any) -> bool:
    return bool(value)


def _show(value: Any) -> str:
    return "" if value is None else {True: "true", False: "false"}[value] if isinstance(value, bool) else str(value)


_APPLY: dict[str, Callable[..., Any]] = {
    "+": lambda a, b: _show(a) + _show(b), "==": lambda a, b: a == b, "!=": lambda a, b: a != b, "not": lambda a: not a,
}


def fold(node: Any, filters: dict[str, Callable[[str], str]]) -> Any:
    """The tree with operations on constants done, tests that can't vary decided and texts that touch joined."""
    if isinstance(node, Filter):
        if node.name not in filters:
            raise TemplateError(f"there is no filter {node.name!r}")
        of = fold(node.of, filters)
        return Const(filters[node.name](_show(of.value))) if isinstance(of, Const) else Filter(of, node.name)
    if isinstance(node, Key):
        return Key(fold(node.of, filters), node.key)
    if isinstance(node, Op):
        args = tuple(fold(a, filters) for a in node.args)
        if node.name in ("and", "or"):
            if isinstance(args[0], Const):
                return args[1] if _truth(args[0].value) == (node.name == "and") else args[0]
        elif all(isinstance(a, Const) for a in args):
            return Const(_APPLY[node.name](*[a.value for a in args]))
        return Op(node.name, args)
    return node


def fold_block(block: tuple, filters: dict[str, Callable[[str], str]]) -> tuple:
    out: list[Any] = []

    def add(node: Any) -> None:
        if isinstance(node, Print) and isinstance(node.what, Const):
            text = _show(node.what.value)
            if out and isinstance(out[-1], Print) and isinstance(out[-1].what, Const):
                out[-1] = Print(Const(out[-1].what.value + text))
            elif text:
                out.append(Print(Const(text)))
        else:
            out.append(node)

    for node in block:
        if isinstance(node, Print):
            add(Print(fold(node.what, filters)))
        elif isinstance(node, For):
            add(For(node.name, fold(node.over, filters), fold_block(node.body, filters)))
        elif isinstance(node, Generation):
            add(Generation(fold_block(node.body, filters)))
        else:
            branches: list[tuple[Any, tuple]] = []
            for test, body in node.branches:
                test = fold(test, filters)
                if isinstance(test, Const) and not _truth(test.value):
                    continue
                branches.append((test, fold_block(body, filters)))
                if isinstance(test, Const):
                    break
            if branches and isinstance(branches[0][0], Const):
                for inner in branches[0][1]:
                    add(inner)
            elif branches:
                add(If(tuple(branches)))
    return tuple(out)


def _value(node: Any, filters: dict[str, Callable[[str], str]]) -> Callable[[Scope], Any]:
    if isinstance(node, Const):
        value = node.value
        return lambda scope: value
    if isinstance(node, Name):
        name = node.name

        def read(scope: Scope) -> Any:
            try:
                return scope[name]
            except KeyError:
                raise TemplateError(f"{name!r} has no value") from None

        return read
    if isinstance(node, Key):
        of, key = _value(node.of, filters), node.key

        def look(scope: Scope) -> Any:
            value = of(scope)
            if type(value) is not dict or key not in value:
                raise TemplateError(f"there is no key {key!r}")
            return value[key]

        return look
    if isinstance(node, Filter):
        of, change = _value(node.of, filters), filters[node.name]
        return lambda scope: change(_show(of(scope)))
    args = [_value(a, filters) for a in node.args]
    if node.name == "and":
        return lambda scope: args[0](scope) and args[1](scope)
    if node.name == "or":
        return lambda scope: args[0](scope) or args[1](scope)
    apply = _APPLY[node.name]
    return lambda scope: apply(*[a(scope) for a in args])


def _statements(block: tuple, marked: bool, filters: dict[str, Callable[[str], str]]) -> Callable[[Scope], Pieces]:
    steps: list[Callable[[Scope], Iterable[tuple[str, bool]]]] = []
    for node in block:
        if isinstance(node, Print) and isinstance(node.what, Const):
            steps.append(lambda scope, out=((node.what.value, marked),): out)
        elif isinstance(node, Print):
            steps.append(lambda scope, of=_value(node.what, filters): ((_show(of(scope)), marked),))
        elif isinstance(node, Generation):
            steps.append(_statements(node.body, True, filters))
        elif isinstance(node, For):
            steps.append(_loop(node, marked, filters))
        else:
            steps.append(_choice([(_value(t, filters), _statements(b, marked, filters)) for t, b in node.branches]))

    def run(scope: Scope) -> Pieces:
        for step in steps:
            yield from step(scope)

    return run


def _loop(node: For, marked: bool, filters: dict[str, Callable[[str], str]]) -> Callable[[Scope], Pieces]:
    over, body, name = _value(node.over, filters), _statements(node.body, marked, filters), node.name

    def run(scope: Scope) -> Pieces:
        for i, item in enumerate(over(scope)):
            yield from body({**scope, name: item, "loop": {"first": i == 0, "index": i + 1}})

    return run


def _choice(branches: list[tuple[Callable, Callable]]) -> Callable[[Scope], Iterable[tuple[str, bool]]]:
    def run(scope: Scope) -> Iterable[tuple[str, bool]]:
        for test, body in branches:
            if _truth(test(scope)):
                return body(scope)
        return ()

    return run


class Escaper:
    """Escapes control strings inside texts so that none is left, and takes the escapes back.

    A backslash goes after a control string's first character; strings that look escaped already get one more. Every
    control string must start with a character that no control string has elsewhere, so that they can't overlap.
    """

    def __init__(self, controls: tuple[str, ...]) -> None:
        if any(len(c) < 2 or c[1] == "\\" or any(c[0] in d[1:] for d in controls) for c in controls):
            raise TemplateError("control strings could overlap")
        tails = "|".join(f"{re.escape(c[0])}(?=\\\\*{re.escape(c[1:])})" for c in controls)
        self._plain = re.compile(f"({tails})")
        self._escaped = re.compile(f"({tails})\\\\")

    def escape(self, text: str) -> str:
        return self._plain.sub(lambda m: m[1] + "\\", text)

    def unescape(self, text: str) -> str:
        return self._escaped.sub(lambda m: m[1], text)


def compile_template(source: str, controls: tuple[str, ...]) -> Callable[[Scope], Pieces]:
    """A function from names and values to the pieces that the template prints; it can stream an iterator of messages."""
    filters: dict[str, Callable[[str], str]] = {"escape": Escaper(controls).escape, "trim": str.strip}
    return _statements(fold_block(parse(source), filters), False, filters)
