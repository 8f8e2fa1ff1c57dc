"""Lexicons, related words and heading hierarchies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boolsieve.functions.text import lemma, lemmas, prefixes
from boolsieve.operators.vocabulary import postings
from boolsieve.session import cut, small


def merge_lexicon(lexicon: dict[str, set[str]]) -> dict[str, set[str]]:
    """A key that is a form of another key is merged into it, in the order of keys.

    Later keys that point to a merged one follow it to where it went; a key never merges into itself.
    """
    into: dict[str, str] = {}

    def root(k: str) -> str:
        while k in into:
            k = into[k]
        return k

    forms = {k: set(v) for k, v in lexicon.items()}
    for key in lexicon:
        for word in sorted(lexicon[key]):
            if word in lexicon and word != key:
                a, b = root(key), root(word)
                if a != b:
                    into[b] = a
                    forms[a] |= {b} | forms.pop(b)
    return forms


def merge_targets(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """(word, root): the smallest word of each component of (key, form), by label propagation with jumps; for large lexicons."""
    both = cut(edges.select(F.col("key").alias("a"), F.col("form").alias("b")).unionAll(edges.select(F.col("form").alias("a"), F.col("key").alias("b"))).distinct())
    labels = cut(both.groupBy(F.col("a").alias("word")).agg(F.least(F.col("a"), F.min("b")).alias("root")))
    for _ in range(rounds):
        near = both.join(labels, both["b"] == labels["word"]).groupBy(F.col("a").alias("word")).agg(F.min("root").alias("near"))
        new = labels.join(near, "word").select("word", F.least("root", "near").alias("root"))
        jump = new.select(F.col("word").alias("_w"), F.col("root").alias("_r"))
        new = cut(new.join(jump, F.col("root") == F.col("_w")).select("word", F.least("root", "_r").alias("root")))
        changed = new.join(labels.withColumnRenamed("root", "old"), "word").filter("root <> old").isEmpty()
        labels = new
        if changed:
            return labels
    raise RuntimeError("the lexicon did not settle")


def closure(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """(word, related): all words that edges (word, related) reach from the starting words, themselves included.

    Each round goes a step further than the last, from what that found new, until nothing is; cycles end there, too.
    """
    reached = cut(starts.select("word", F.col("word").alias("related")).distinct())
    front = reached
    step = edges.select(F.col("word").alias("_from"), F.col("related").alias("_to"))
    while True:
        new = front.join(step, F.col("related") == F.col("_from")).select("word", F.col("_to").alias("related")).distinct()
        front = cut(new.join(reached, ["word", "related"], "left_anti"))
        if front.isEmpty():
            return reached
        reached = cut(reached.unionByName(front))


def dominating_words(words: DataFrame, related: DataFrame) -> DataFrame:
    """(word, target): of a word and its related words in the vocabulary the one with the most related words; ties by word.

    words (word); related (word, related). A word without any is its own target.
    """
    known = related.join(words, "word", "left_semi").join(words.select(F.col("word").alias("related")), "related", "left_semi")
    sizes = words.join(known.groupBy("word").agg(F.count_distinct("related").alias("n")), "word", "left").fillna(0, ["n"])
    choices = known.select("word", F.col("related").alias("choice")).unionByName(words.select("word", F.col("word").alias("choice"))).distinct()
    rated = choices.join(sizes.select(F.col("word").alias("choice"), "n"), "choice")
    return rated.groupBy("word").agg(F.min_by("choice", F.struct(-F.col("n"), F.col("choice"))).alias("target"))


def lemma_forms(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, lemma, forms): each lemma of a document with the sorted different forms that stand for it there. Null texts have none."""
    found = postings(docs, doc, text).withColumn("lemma", lemma(F.col("term")))
    return found.groupBy(doc, "lemma").agg(F.array_sort(F.collect_set("term")).alias("forms"))


def global_lexicon(forms: DataFrame, targets: DataFrame | None = None) -> DataFrame:
    """(lemma, forms): the sorted different forms of each lemma over all documents' (lemma, forms), after a remap (word, target)."""
    rows = forms.select("lemma", F.explode("forms").alias("form"))
    if targets is not None:
        moved = targets.select(F.col("word").alias("lemma"), "target")
        rows = rows.join(small(moved), "lemma", "left").select(F.coalesce("target", "lemma").alias("lemma"), "form")
    return rows.distinct().groupBy("lemma").agg(F.array_sort(F.collect_list("form")).alias("forms"))


def lemma_counts(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(lemma, forms, df): each lemma with the sorted different forms that stand for it and the documents that have it.

    Forms and documents are counted where texts are read, so what is shuffled goes by the vocabulary and nothing is written for a
    document. Rows that share an id are one document; those are told apart first.
    """
    several = cut(docs.groupBy(doc).agg(F.count("*").alias("_n")).filter("_n > 1").select(doc))
    plain = docs if several.isEmpty() else docs.join(several, doc, "left_anti")
    counts = plain.filter(F.col(doc).isNotNull()).select(F.explode(lemmas(F.col(text))).alias("lemma")).groupBy("lemma").agg(F.count("*").alias("df"))
    if not several.isEmpty():
        again = docs.join(several, doc).select(doc, F.explode(lemmas(F.col(text))).alias("lemma")).distinct()
        counts = counts.unionAll(again.groupBy("lemma").agg(F.count("*").alias("df"))).groupBy("lemma").agg(F.sum("df").alias("df"))
    found = postings(docs, doc, text).select("term").distinct().select(lemma(F.col("term")).alias("lemma"), F.col("term").alias("form"))
    forms = found.groupBy("lemma").agg(F.array_sort(F.collect_list("form")).alias("forms"))
    return forms.join(counts, "lemma", "left").select("lemma", "forms", F.coalesce("df", F.lit(0).cast("long")).alias("df"))


def remap_terms(post: DataFrame, targets: DataFrame) -> DataFrame:
    """Postings with terms exchanged for their targets (word, target); headings stay as they are."""
    moved = small(targets.select(F.col("word").alias("term"), "target"))
    new = F.when(F.contains("term", F.lit("[mh]")), F.col("term")).otherwise(F.coalesce("target", "term"))
    return post.join(moved, "term", "left").select("doc_id", new.alias("term")).distinct()


def ancestors(tree: DataFrame) -> DataFrame:
    """(name, ancestor): the names at all proper prefixes of a name's tree numbers, and itself. tree: (name, tree_numbers)."""
    numbers = tree.select("name", F.explode("tree_numbers").alias("number"))
    up = numbers.select("name", F.explode(prefixes(F.col("number"))).alias("number"))
    found = up.join(numbers.select(F.col("name").alias("ancestor"), "number"), "number").select("name", "ancestor")
    return found.unionByName(tree.select("name", F.col("name").alias("ancestor"))).distinct()


def with_ancestors(headings: DataFrame, tree: DataFrame) -> DataFrame:
    """(doc_id, heading) of headings and all their ancestors; a heading that the tree lacks stays alone."""
    up = ancestors(tree).select(F.col("name").alias("heading"), "ancestor")
    return headings.join(small(up), "heading", "left").select("doc_id", F.coalesce("ancestor", "heading").alias("heading")).distinct()


def cluster_words(vectors: DataFrame, threshold: float) -> DataFrame:
    """(group, word, canonical): complete-linkage clusters of each group's words by cosine, cut where similarity falls below.

    Groups are small (the terms of one query); each is clustered in one call.
    """
    import numpy as np
    import pandas as pd

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("word").reset_index(drop=True)
        v = np.array(pdf["vector"].tolist(), float)
        v = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
        distance = 1 - v @ v.T
        head = np.arange(len(v))
        far = np.where(np.arange(len(v))[:, None] < np.arange(len(v)), distance, np.inf)  # of each pair of clusters, by their first members
        while len(v) > 1:
            x, y = np.unravel_index(np.argmin(far), far.shape)
            if not far[x, y] <= 1 - threshold:
                break
            either = np.maximum(np.minimum(far[x], far[:, x]), np.minimum(far[y], far[:, y]))
            far[y], far[:, y] = np.inf, np.inf
            far[x], far[:, x] = np.where(np.arange(len(v)) > x, either, np.inf), np.where(np.arange(len(v)) < x, either, np.inf)
            head[head == y] = x
        return pdf.assign(canonical=pdf["word"].to_numpy()[head])[["group", "word", "canonical"]]

    return vectors.groupBy("group").applyInPandas(run, "group string, word string, canonical string")
