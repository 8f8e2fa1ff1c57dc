"""Finds licence notices through a positional index of rare words. DataFrame functions only."""

from __future__ import annotations

from dataclasses import dataclass
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boolsieve.llm.common import GAP, WORD

#: Share of a template's words that must stand at their places.
THRESHOLD = 0.8


@dataclass(frozen=True)
class Template:
    """A notice: its words, and the key phrase among them that must stand there whole."""

    label: str
    text: str
    key: str
    base: bool = False

    @property
    def words(self) -> list[str]:
        return self.text.split()

    @property
    def key_at(self) -> int:
        w, k = self.words, self.key.split()
        return next(i for i in range(len(w)) if w[i : i + len(k)] == k)


#: The phrases of the contract; each is a template that must match whole.
BASE = (
    Template("mit", "mit license", "mit license", True),
    Template("apache", "apache license", "apache license", True),
    Template("gpl", "general public license", "general public license", True),
)
#: Notices of public licences as they stand in files, in lower case, without punctuation: label, words, key phrase.
NOTICES = tuple(Template(*x) for x in (
    ("mit", "released under the mit license", "mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", "permission is hereby granted"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy", "permission is hereby granted"),
    ("apache", "licensed under the apache license version 2 0", "apache license"),
    ("apache", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", "apache license"),
    ("apache", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis", "on an as is basis"),
    ("gpl", "licensed under the gnu general public license version 3", "general public license"),
    ("gpl", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "gnu general public license"),
    ("lgpl", "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation", "lesser general public license"),
    ("agpl", "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation", "affero general public license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "source and binary forms"),
    ("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", "redistributions of source code"),
    ("bsd", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer", "redistributions in binary form"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "with or without fee"),
    ("mpl", "subject to the terms of the mozilla public license", "mozilla public license"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    ("epl", "made available under the terms of the eclipse public license", "eclipse public license"),
    ("cddl", "subject to the terms of the common development and distribution license", "common development and distribution"),
    ("boost", "distributed under the boost software license version 1 0", "boost software license"),
    ("zlib", "permission is granted to anyone to use this software for any purpose including commercial applications", "granted to anyone to use"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "free and unencumbered software"),
    ("artistic", "under the terms of the artistic license", "artistic license"),
    ("wtfpl", "do what the fuck you want to public license", "want to public license"),
    ("postgresql", "without a written agreement is hereby granted provided that the above copyright notice", "without a written agreement"),
    ("psf", "licensed under the python software foundation license", "python software foundation"),
    ("ofl", "licensed under the sil open font license", "open font license"),
    ("cc0", "the person who associated a work with this deed has dedicated the work to the public domain", "dedicated the work"),
    ("cc0", "licensed under cc0 1 0", "cc0 1 0"),
    ("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    ("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    ("cc-by-nd", "licensed under cc by nd 4 0", "cc by nd"),
    ("cc-by", "licensed under cc by 4 0", "cc by 4"),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license", "creative commons attribution 4"),
    ("cc-by-sa", "licensed under a creative commons attribution sharealike 4 0 international license", "attribution sharealike 4"),
    ("cc-by-nc", "licensed under a creative commons attribution noncommercial 4 0 international license", "attribution noncommercial 4"),
    ("reserved", "all rights reserved no part of this publication may be reproduced", "no part of this publication"),
))


def key_words(templates: tuple[Template, ...]) -> list[str]:
    """The words of all key phrases."""
    return sorted({w for t in templates for w in t.key.split()})


def document_counts(texts: DataFrame, words: list[str]) -> dict[str, int]:
    """How many rows of ``texts`` (a column ``text``) have each word. The driver gets one number for each word of the templates."""
    lowered = F.translate("text", ascii_uppercase, ascii_lowercase)
    found = F.regexp_extract_all(lowered, F.lit(f"(?<!{WORD[:-1]}){_alternatives(words)}(?!{WORD[:-1]})"), 0)
    counted = texts.select(F.explode(F.array_distinct(found)).alias("word")).groupBy("word").count()
    return {r["word"]: r["count"] for r in counted.collect()}


def anchors(templates: tuple[Template, ...], counts: dict[str, int]) -> list[tuple[Template, str, int]]:
    """Each template with the word of its key phrase that has the highest IDF, the fewest documents, and that word's place; ties go to the first."""
    out = []
    for t in templates:
        at = min(range(t.key_at, t.key_at + len(t.key.split())), key=lambda i: (counts.get(t.words[i], 0), i))
        out.append((t, t.words[at], at))
    return out


def _alternatives(words: list[str]) -> str:
    """An expression of all the words, shared beginnings once."""
    by: dict[str, list[str]] = {}
    for w in words:
        by.setdefault(w[:1], []).append(w[1:])
    if list(by) == [""]:
        return ""
    parts = [k + _alternatives(sorted(set(v))) for k, v in sorted(by.items()) if k]
    return f"(?:{'|'.join(parts)}){'?' if '' in by else ''}"


def _constant(indexed: list[tuple[Template, str, int]], threshold: float) -> tuple[str, str]:
    """The templates and their postings as SQL constants: an array of templates, and a map from a word to (template, place)."""
    quoted = lambda words: "array(" + ", ".join(f"'{w}'" for w in words) + ")"
    rows = [f"named_struct('label', '{t.label}', 'words', {quoted(t.words)}, 'at', {t.key_at}, 'key', {quoted(t.key.split())}, 'base', {str(t.base).lower()}, 'least', {1.0 if t.base else threshold}D)" for t, _, _ in indexed]
    postings: dict[str, list[str]] = {}
    for k, (_, word, at) in enumerate(indexed):
        postings.setdefault(word, []).append(f"named_struct('t', {k}, 'at', {at})")
    return f"array({', '.join(rows)})", "map(" + ", ".join(f"'{w}', array({', '.join(p)})" for w, p in sorted(postings.items())) + ")"


def scan(docs: DataFrame, templates: tuple[Template, ...] = BASE + NOTICES, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(id, n_words, n_base, first_word, last_word, base_labels, labels, score, found) for every row of ``docs``.

    Words are runs of letters, digits and characters above ASCII, A-Z lower-cased. A first job counts the documents that
    have each word of the key phrases; a template stands in the index under the word of its key phrase that the fewest
    documents have (which word that is does not change a result). Every such word of a text looks up its postings, which are
    data and not part of the expression; each gives the place where its template would start. There words are intersected
    by position; a template is found if its key phrase stands whole and ``threshold`` of its words are in place. ``found``
    lists label, start, share and base; ``score`` is the largest share (0: none). Null and empty texts have no words. Rows are
    judged alone: repeated ones return alike, ids may be null, other columns are not read. Texts without any word of the
    index are only counted.
    """
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    indexed = anchors(templates, document_counts(rows, key_words(templates)))
    table, postings = _constant(indexed, threshold)
    rare = sorted({w for _, w, _ in indexed})
    low = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    gap = GAP.removesuffix("+")
    maybe = F.col("text").rlike(f"(?i)(?:^|{gap}){_alternatives(rare)}(?:{gap}|$)")
    split = rows.select("id", F.regexp_extract_all("text", F.lit(WORD), 0).alias("w"), maybe.alias("maybe"))
    lowered = split.select("id", F.size("w").cast("long").alias("n_words"), F.expr(f"if(maybe, transform(w, x -> {low.format('x')}), cast(array() as array<string>))").alias("w"))
    listed = ", ".join(f"'{w}'" for w in rare)
    hits = f"filter(transform(w, (x, i) -> struct(x as x, i as i)), h -> h.x in ({listed}))"
    starts = f"flatten(transform({hits}, h -> transform(element_at({postings}, h.x), p -> named_struct('t', element_at({table}, p.t + 1), 's', h.i - p.at))))"
    whole = "(not c.t.base or c.s >= 0) and size(filter(c.t.key, (k, j) -> get(w, c.s + c.t.at + j) <=> k)) = size(c.t.key)"
    rated = f"transform(filter({starts}, c -> {whole}), c -> named_struct('label', c.t.label, 'start', c.s, 'share', size(filter(c.t.words, (k, j) -> get(w, c.s + j) <=> k)) / double(size(c.t.words)), 'base', c.t.base, 'least', c.t.least))"
    kept = F.filter(F.expr(rated), lambda m: m["share"] >= m["least"])
    listed_docs = lowered.select("id", "n_words", F.transform(kept, lambda m: m.dropFields("least")).alias("found"))
    base = F.filter("found", lambda m: m["base"])
    names = lambda a: F.array_join(F.array_sort(F.array_distinct(F.transform(a, lambda m: m["label"]))), ",")
    places = F.transform(base, lambda m: m["start"].cast("long"))
    return listed_docs.select(
        F.col("id").alias(id_col), "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(places).alias("first_word"), F.array_max(places).alias("last_word"),
        names(base).alias("base_labels"), names(F.col("found")).alias("labels"), F.coalesce(F.array_max(F.transform("found", lambda m: m["share"])), F.lit(0.0)).alias("score"), "found",
    )
