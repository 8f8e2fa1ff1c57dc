import itertools
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from boolsieve.functions import boolean as b
from boolsieve.functions import rules as r

FORMULAS = [
    "apple", "apple NOT pear", "NOT plum AND fig", "lamp AND desk AND (ink OR pen)", "(red OR blue OR green) AND (cup OR jar) AND (oak OR elm)",
    "rain OR (wind AND (hail OR snow)) OR (NOT wind AND snow)", "NOT (red OR blue OR green) AND (cup OR jar) AND (oak OR elm)", "sun OR (moon NOT (star OR comet OR dust))",
    "(ant AND bee) OR (cow AND dog)", "((tin OR zinc) AND lead) OR ((iron OR gold) NOT lead)", "(nail AND saw) OR (rope AND hook) OR (bolt AND nut)",
    "((north OR south) AND day NOT fog) OR (night AND (east OR west))", "(tea AND milk AND cake) OR (coffee AND rum NOT cake)",
]

TERMS = st.sampled_from(["ab", "cd", "ef", "gh"]).map(b.Term)
NODES = st.recursive(TERMS, lambda x: st.one_of(x.map(b.Not), st.lists(x, min_size=2, max_size=3).map(lambda p: b.And(tuple(p))), st.lists(x, min_size=2, max_size=3).map(lambda p: b.Or(tuple(p)))), max_leaves=8)


def value(node, present):
    return b.evaluate(node, lambda t: t.text in present)


def assignments(*nodes):
    names = sorted({t.text for n in nodes for t in b.terms_of(n)})
    for k in range(len(names) + 1):
        yield from map(set, itertools.combinations(names, k))


@pytest.mark.parametrize("formula", FORMULAS)
def test_formulas_round_trip(formula):
    node = b.parse(formula)
    again = b.parse(str(node))
    assert all(value(node, a) == value(again, a) for a in assignments(node))


@given(NODES)
@settings(max_examples=150, deadline=None)
def test_any_tree_round_trips(node):
    again = b.parse(str(node))
    assert all(value(node, a) == value(again, a) for a in assignments(node))


def test_precedence_and_tags():
    assert b.parse("a OR b AND NOT c") == b.Or((b.Term("a"), b.And((b.Term("b"), b.Not(b.Term("c"))))))
    assert b.parse('"heart attack"[tiab] NOT x[mh:noexp]') == b.And((b.Term("heart attack", "tiab"), b.Not(b.Term("x", "mh:noexp"))))


@pytest.mark.parametrize("bad", ["", "()", "a AND", "(a", "a)", "a OR OR b", "NOT", "a AND (", "AND a"])
def test_bad_queries(bad):
    assert not b.is_valid(bad)
    with pytest.raises(b.QueryError):
        b.parse(bad)


def test_rewrites():
    node = b.parse("(a OR b) AND c NOT (d OR a)")
    assert str(b.replace_term(node, "a", "z")) == "(z OR b) AND c NOT (d OR z)"
    assert str(b.replace_term(node, "a", None)) == "b AND c NOT d"
    assert b.replace_term(b.parse("a"), "a", None) is None
    assert [str(v) for _, _, v in b.variants_without(node)][:2] == ["b AND c NOT (d OR a)", "a AND c NOT (d OR a)"]
    assert b.nested(node) == [[["a", "b"], ["c"], ["d", "a"]]]
    assert b.counts(node) == {"AND": 1, "OR": 2, "NOT": 1}


def test_columns_agree_with_evaluation(spark):
    docs = [(1, ["a", "b"], ["x"]), (2, ["b", "c", "d"], []), (3, [], ["heart disease"]), (4, ["heart", "attack"], None)]
    df = spark.createDataFrame(docs, "doc_id long, tokens array<string>, headings array<string>")
    got = {q: {r.doc_id for r in df.filter(b.to_column(b.parse(q), F.col("tokens"))).collect()} for q in ("a OR d", "b NOT c", '"heart attack"', "NOT a AND NOT b")}
    assert got == {"a OR d": {1, 2}, "b NOT c": {1}, '"heart attack"': {4}, "NOT a AND NOT b": {3, 4}}
    assert {r.doc_id for r in df.filter(b.to_column(b.parse('"heart disease"[mh]'), F.col("tokens"), F.coalesce("headings", F.array()))).collect()} == {3}


def test_postings_agree_with_columns(spark):
    random.seed(3)
    rows = [(i, sorted(random.sample("abcdef", random.randint(0, 5)))) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, tokens array<string>")
    post = docs.select("doc_id", F.explode("tokens").alias("term"))
    for q in ("a AND b NOT c", "NOT a", "(a OR b) AND NOT (c AND d)", "e"):
        node = b.parse(q)
        want = {i for i, t in rows if value(node, set(t))}
        assert {x.doc_id for x in b.matches(node, post, docs).collect()} == want


def test_rendering_and_size():
    rules = [r.rule([(("b", "a"), True), (('"x"[mh]',), True), (("c",), False)]), r.rule([(("d",), True)]), r.rule([(("e",), False)])]
    text, size = r.render(rules, None, {"a": ["a", "a one"]}, tiab=False, mh_noexp=True)
    assert text == '("x"[mh:noexp] AND (a OR "a one" OR b) NOT c[tiab]) OR d'
    assert size == {"paths": 2, "avg_path_len": 2.0, "ANDs": 1, "NOTs": 1, "added_ORs": 1, "ORs": 1, "synonym_ORs": 1}
    ops = b.counts(b.parse(text))
    assert ops == {"AND": size["ANDs"], "NOT": size["NOTs"], "OR": size["ORs"] + size["added_ORs"] + size["synonym_ORs"]}
    assert r.cost(size) == 2 * 2 + 1 + 1.5 + 0.5
