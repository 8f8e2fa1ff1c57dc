"""The Boolean retrieval language: syntax tree, parser, checks, evaluation and compilation to columns.

``a AND (b OR c) NOT d``; NOT binds tightest, then AND, then OR; a NOT that follows an operand means AND NOT. Terms are
words, quoted phrases, or words in a row (a phrase), and may carry a field tag: ``[tiab]``, ``[mh]`` or ``[mh:noexp]``.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boolsieve.functions.text import TOKEN


class QueryError(ValueError):
    """The string is no query."""


@dataclass(frozen=True)
class Term:
    text: str
    tag: str = ""

    def __str__(self) -> str:
        text = f'"{self.text}"' if " " in self.text or self.tag.startswith("mh") else self.text
        return f"{text}[{self.tag}]" if self.tag else text


@dataclass(frozen=True)
class And:
    parts: tuple

    def __str__(self) -> str:
        plus = [p for p in self.parts if not isinstance(p, Not)]
        minus = [p for p in self.parts if isinstance(p, Not)]
        return " AND ".join(_inner(p) for p in plus) + "".join(f" NOT {_inner(p.part)}" for p in minus) if plus else " AND ".join(map(str, minus))


@dataclass(frozen=True)
class Or:
    parts: tuple

    def __str__(self) -> str:
        return " OR ".join(_inner(p) if not isinstance(p, Or) else f"({p})" for p in self.parts)


@dataclass(frozen=True)
class Not:
    part: object

    def __str__(self) -> str:
        return f"NOT {_inner(self.part)}"


Node = Term | And | Or | Not


def _inner(node: Node) -> str:
    return str(node) if isinstance(node, Term) else f"({node})"


_LEX = re.compile(r'\s*(?:(?P<open>\()|(?P<close>\))|"(?P<phrase>[^"]*)"(?:\[(?P<ptag>[^\]]*)\])?|(?P<word>[^\s()"\[\]]+)(?:\[(?P<wtag>[^\]]*)\])?)')


def _lex(query: str) -> Iterator[tuple[str, str, str]]:
    at, end = 0, len(query.rstrip())
    run: list[str] = []
    while at < end:
        m = _LEX.match(query, at)
        if not m:
            raise QueryError(f"can't read {query[at : at + 20]!r}")
        at = m.end()
        word = m["word"]
        if word is not None and word not in ("AND", "OR", "NOT"):
            run.append(word)
            if m["wtag"] is not None:
                yield "term", " ".join(run), m["wtag"]
                run = []
            continue
        if run:
            yield "term", " ".join(run), ""
            run = []
        if m["open"] or m["close"]:
            yield m["open"] or m["close"], "", ""
        elif word is not None:
            yield word, "", ""
        else:
            yield "term", m["phrase"], m["ptag"] or ""
    if run:
        yield "term", " ".join(run), ""
    yield "end", "", ""


class _Parser:
    def __init__(self, query: str) -> None:
        self.tokens = list(_lex(query))
        self.at = 0

    def next(self) -> str:
        return self.tokens[self.at][0]

    def take(self, kind: str) -> bool:
        hit = self.next() == kind
        self.at += hit
        return hit

    def either(self) -> Node:
        parts = [self.both()]
        while self.take("OR"):
            parts.append(self.both())
        return parts[0] if len(parts) == 1 else Or(tuple(parts))

    def both(self) -> Node:
        parts = [self.unary()]
        while True:
            if self.take("AND"):
                parts.append(self.unary())
            elif self.next() == "NOT":
                parts.append(self.unary())
            else:
                return parts[0] if len(parts) == 1 else And(tuple(parts))

    def unary(self) -> Node:
        if self.take("NOT"):
            return Not(self.unary())
        kind, text, tag = self.tokens[self.at]
        self.at += 1
        if kind == "(":
            node = self.either()
            if not self.take(")"):
                raise QueryError("a bracket is not closed")
            return node
        if kind != "term" or not text.strip():
            raise QueryError(f"a term is missing before {kind!r}")
        return Term(text, tag)


def parse(query: str) -> Node:
    """The syntax tree of a query, or QueryError."""
    parser = _Parser(query)
    node = parser.either()
    if parser.next() != "end":
        raise QueryError(f"{parser.next()!r} is not expected")
    return node


def is_valid(query: str) -> bool:
    """Whether brackets balance, none is empty, and operators and operands take turns."""
    try:
        parse(query)
    except QueryError:
        return False
    return True


def terms_of(node: Node) -> list[Term]:
    """The terms in order, repeats included."""
    if isinstance(node, Term):
        return [node]
    if isinstance(node, Not):
        return terms_of(node.part)
    return [t for p in node.parts for t in terms_of(p)]


def fold(node: Node, term: Callable, both: Callable, either: Callable, negate: Callable):
    """The tree's value from those of its leaves."""
    if isinstance(node, Term):
        return term(node)
    if isinstance(node, Not):
        return negate(fold(node.part, term, both, either, negate))
    values = [fold(p, term, both, either, negate) for p in node.parts]
    return reduce(both if isinstance(node, And) else either, values)


def evaluate(node: Node, has: Callable[[Term], bool]) -> bool:
    """The query's value for one document."""
    return fold(node, has, lambda a, b: a and b, lambda a, b: a or b, lambda a: not a)


def _words(text: str) -> list[str]:
    return re.findall(TOKEN, text.lower())


def to_column(node: Node, tokens: Column, headings: Column | None = None) -> Column:
    """The query as a condition on a document's tokens (in order) and headings.

    A phrase must stand as tokens in a row. Headings match whole, ``[mh]`` also by those that ``headings`` lists as more
    general. A term without a tag matches tokens or, where there are headings, a heading.
    """

    def in_text(text: str) -> Column:
        w = _words(text)
        if len(w) == 1:
            return F.array_contains(tokens, w[0])
        return F.contains(F.concat(F.lit(" "), F.array_join(tokens, " "), F.lit(" ")), F.lit(f" {' '.join(w)} ")) if w else F.lit(False)

    def one(t: Term) -> Column:
        if t.tag.startswith("mh"):
            return F.array_contains(headings, t.text.lower()) if headings is not None else F.lit(False)
        if t.tag == "" and headings is not None:
            return in_text(t.text) | F.array_contains(headings, t.text.lower())
        return in_text(t.text)

    return fold(node, one, lambda a, b: a & b, lambda a, b: a | b, lambda a: ~a)


def matches(node: Node, postings: DataFrame, docs: DataFrame, doc: str = "doc_id", term: str = "term") -> DataFrame:
    """(doc) of the documents that fit, from postings (doc, term) of which the terms are as the query has them.

    Only the query's terms are read; each document's are gathered and the query is decided on them. Documents without
    any of them matter just if the query fits an empty document; then ``docs`` is joined for those.
    """
    names = sorted({str(t) if t.tag.startswith("mh") else t.text for t in terms_of(node)})
    has = lambda t: F.array_contains("have", str(t) if t.tag.startswith("mh") else t.text)
    rule = fold(node, has, lambda a, b: a & b, lambda a, b: a | b, lambda a: ~a)
    have = postings.filter(F.col(term).isin(names)).groupBy(doc).agg(F.collect_set(term).alias("have"))
    fits = have.filter(rule).select(doc)
    if evaluate(node, lambda t: False):
        fits = fits.unionByName(docs.select(doc).join(have.select(doc), doc, "left_anti"))
    return fits


def variants_without(node: Node) -> list[tuple[Term, int, Node | None]]:
    """The tree once without each occurrence of a term: (term, its place among all, tree). None: nothing is left."""
    return [(t, k, rewrite(node, k, None)) for k, t in enumerate(terms_of(node))]


def rewrite(node: Node, place: int, new: Term | None) -> Node | None:
    """The tree with the term at a place exchanged or, with None, taken out with operators that lose their sense."""

    def go(n: Node, at: int) -> tuple[Node | None, int]:
        if isinstance(n, Term):
            return (new if at == place else n), at + 1
        if isinstance(n, Not):
            part, at = go(n.part, at)
            return (Not(part) if part is not None else None), at
        kept = []
        for p in n.parts:
            part, at = go(p, at)
            if part is not None:
                kept.append(part)
        return (None if not kept else kept[0] if len(kept) == 1 else replace(n, parts=tuple(kept))), at

    return go(node, 0)[0]


def replace_term(node: Node, old: str, new: str | None) -> Node | None:
    """The tree with every term of that text exchanged, or taken out."""
    at = 0
    while node is not None:
        here = terms_of(node)
        found = next((k for k in range(at, len(here)) if here[k].text == old), None)
        if found is None:
            return node
        node = rewrite(node, found, None if new is None else replace(here[found], text=new))
        at = found if new is None else found + 1
    return node


def nested(node: Node) -> list[list[list[str]]]:
    """The query as OR of ANDs of ORs of term texts; NOT counts as its operand, deeper trees are flattened."""
    clauses = node.parts if isinstance(node, Or) and any(isinstance(p, And) for p in node.parts) else (node,)
    out = []
    for clause in clauses:
        groups = clause.parts if isinstance(clause, And) else (clause,)
        out.append([[t.text for t in terms_of(g)] for g in groups])
    return out


def counts(node: Node) -> dict[str, int]:
    """How many AND, OR and NOT the tree has."""
    if isinstance(node, Term):
        return {"AND": 0, "OR": 0, "NOT": 0}
    if isinstance(node, Not):
        own = counts(node.part)
        return own | {"NOT": own["NOT"] + 1}
    total = {"AND": 0, "OR": 0, "NOT": 0}
    for p in node.parts:
        for k, v in counts(p).items():
            total[k] += v
    joins = len(node.parts) - 1
    if isinstance(node, Or):
        total["OR"] += joins
    else:  # a NOT inside stands for its own AND
        total["AND"] += max(0, sum(not isinstance(p, Not) for p in node.parts) - 1)
    return total
