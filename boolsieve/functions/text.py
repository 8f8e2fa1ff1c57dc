"""Tokens, bags of words and heading notation."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Runs of ASCII letters and digits, joined by single hyphens.
TOKEN = "[a-z0-9]+(?:-[a-z0-9]+)*"
#: Stands for an empty abstract in some corpora; never a term.
FORBIDDEN = ("nan",)
# fixed values: common English words that carry no topic
STOP_WORDS = ("a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "has", "in", "is", "it", "of", "on", "or", "that", "the", "this", "to", "was", "were", "with")


def tokens(text: Column) -> Column:
    """All tokens of a text, lower-cased, in order; a null text has none."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), 0)


def has_token(text: Column, *words: str) -> Column:
    """Whether a text has one of some words among its ``tokens``, without making them."""
    one = "|".join(re.escape(w) for w in words)
    return F.lower(F.coalesce(text, F.lit(""))).rlike(f"(?<![a-z0-9])(?<![a-z0-9]-)(?:{one})(?![a-z0-9])(?!-[a-z0-9])")


def terms(text: Column, stop_words: tuple[str, ...] = STOP_WORDS, min_length: int = 2, numbers: bool = False) -> Column:
    """The different terms of a text, sorted: no stop words, no forbidden ones, none shorter, no bare numbers unless asked."""
    return F.array_sort(F.filter(F.array_distinct(tokens(text)), lambda t: is_term(t, stop_words, min_length, numbers)))


def is_term(t: Column, stop_words: tuple[str, ...] = STOP_WORDS, min_length: int = 2, numbers: bool = False) -> Column:
    """Whether a token counts as a term."""
    found = (F.length(t) >= min_length) & ~t.isin(*stop_words, *FORBIDDEN)
    return found if numbers else found & ~t.rlike(r"^[0-9-]+$")


# fixed values: English plurals that no ending gives away
IRREGULAR = {"children": "child", "criteria": "criterion", "feet": "foot", "geese": "goose", "men": "man", "mice": "mouse", "phenomena": "phenomenon", "teeth": "tooth", "women": "woman"}


def lemma(word: Column, irregular: dict[str, str] | None = None) -> Column:
    """The dictionary form of a lower-case word, as far as endings tell: irregular forms, then the plural rules of the S stemmer.

    The rules are those of Harman, "How effective is suffixing?" (1991): -ies becomes -y but after a or e, -es becomes -e but
    after a, e or o, -s goes but after s or u; the first ending that is there decides. Words of up to three letters stay.
    """
    known = IRREGULAR if irregular is None else irregular
    plural = F.when(word.rlike("ies$"), F.regexp_replace(word, "(?<![ae])ies$", "y")).when(word.rlike("es$"), F.regexp_replace(word, "(?<![aeo])es$", "e")).otherwise(F.regexp_replace(word, "(?<![su])s$", ""))
    regular = F.when(F.length(word) > 3, plural).otherwise(word)
    if not known:
        return regular
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in sorted(known.items()) for x in pair]), word), regular)


def lemmas(text: Column) -> Column:
    """The different lemmas of a text's terms, sorted."""
    return F.array_sort(F.array_distinct(F.transform(terms(text), lambda t: lemma(t))))


def surface_form(word: Column) -> Column:
    """A word as it is searched for: lower case, marks other than hyphens as spaces, no hyphens or spaces at its ends or in a row."""
    plain = F.regexp_replace(F.lower(word), "[^a-z0-9\\s-]", " ")
    return F.regexp_replace(F.regexp_replace(plain, "[-\\s]{2,}", " "), "^[ -]+|[ -]+$", "")


def heading_term(heading: Column) -> Column:
    """The bag-of-words form of a controlled heading: quoted, with its tag."""
    return F.concat(F.lit('"'), heading, F.lit('"[mh]'))


def bag_of_words(text: Column, headings: Column) -> Column:
    """A text's sorted terms, then its sorted headings."""
    tagged = F.array_sort(F.array_distinct(F.transform(F.coalesce(headings, F.array().cast("array<string>")), heading_term)))
    return F.concat(terms(text), tagged)


def without_headings(bow: Column) -> Column:
    return F.filter(bow, lambda t: ~F.contains(t, F.lit("[mh]")))


def strip_heading(heading: Column) -> Column:
    """Trimmed, without one pair of outer brackets, lower case."""
    return F.lower(F.regexp_replace(F.trim(heading), r"^\((.*)\)$", "$1"))


def expand_heading(heading: Column) -> Column:
    """The head of a heading and the head with each qualifier: ``a/b/*c & d`` gives a, a/b and a/c and d.

    One head was renamed in the vocabulary and is mapped to its present name.
    """
    plain = F.replace(F.replace(F.lower(F.trim(heading)), F.lit("*"), F.lit("")), F.lit("&"), F.lit("and"))
    plain = F.regexp_replace(plain, r"^purpura, schoenlein-henoch", "iga vasculitis")  # fixed value: the renamed heading
    parts = F.transform(F.split(plain, "/"), lambda p: F.trim(p))
    head = F.element_at(parts, 1)
    rest = F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0)))
    return F.array_distinct(F.concat(F.array(head), F.transform(rest, lambda q: F.concat(head, F.lit("/"), q))))


def prefixes(tree_number: Column) -> Column:
    """Every proper dotted prefix of a tree number: a.b.c gives a and a.b."""
    parts = F.split(tree_number, r"\.")
    return F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "."))).otherwise(
        F.array().cast("array<string>")
    )


def strip_tags(query: Column) -> Column:
    """A query without field tags and quotes."""
    return F.regexp_replace(query, r'\[(?:mh|mh:noexp|tiab|tx)\]|"', "")


def query_words(query: Column) -> Column:
    """The terms of a query string, in order, split at operators and brackets."""
    return F.filter(F.transform(F.split(query, r"\s+(?:AND|OR|NOT)\s+|[()]|^NOT\s+"), lambda t: F.trim(t)), lambda t: (t != "") & ~t.isin("AND", "OR", "NOT"))


def format_count(n: Column) -> Column:
    """999, 1.9k, 12k, 1.23m, 12.3m."""
    n = n.cast("double")
    return (
        F.when(n < 1000, n.cast("long").cast("string"))
        .when(n < 10_000, F.format_string("%.1fk", n / 1000))
        .when(n < 1_000_000, F.format_string("%.0fk", n / 1000))
        .when(n < 10_000_000, F.format_string("%.2fm", n / 1_000_000))
        .otherwise(F.format_string("%.1fm", n / 1_000_000))
    )


def strip_outer_brackets(query: str) -> str:
    """A query without the brackets around the whole of it."""
    while query.startswith("(") and query.endswith(")"):
        depth = 0
        for at, c in enumerate(query):
            depth += (c == "(") - (c == ")")
            if not depth and at < len(query) - 1:
                return query
        query = query[1:-1].strip()
    return query


def number_of_operators(query: Column) -> Column:
    """AND, OR and NOT as words of a query; letters inside a term don't count."""
    return F.size(F.regexp_extract_all(query, F.lit(r"(?<![A-Za-z])(AND|OR|NOT)(?![A-Za-z])"), 1)).cast("long")


def is_heading(term: str) -> bool:
    return bool(re.search(r"\[mh(:noexp)?\]$", term))


def heading_share(query: Column) -> Column:
    """The share of a query's terms that are headings; 0 if it has none."""
    n = F.size(query_words(query))
    headings = F.size(F.regexp_extract_all(query, F.lit(r"\[mh(?::noexp)?\]"), 0))
    return F.when(n > 0, headings / n).otherwise(0.0)
