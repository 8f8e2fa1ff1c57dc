"""Token counts under a unigram vocabulary, by dynamic programming that a trie of pre-tokens shares."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boolsieve.llm.common import slices, utf8

#: A public vocabulary of 32,000 pieces; its path is a parameter of whoever calls ``load_pieces``.
VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
#: Stands before every pre-token.
MARK = "▁"
#: Pre-tokens whose counts a task remembers; beyond that it forgets them all and counts anew, with the same results.
REMEMBERED = 600_000


def load_pieces(path: str = VOCABULARY) -> dict[str, float]:
    """Pieces with log probabilities.

    A unigram file's scores are log probabilities and are taken as they are. The scores of a merge file are ranks, whole
    numbers from zero down; its piece of rank r gets the share of Zipf's law, 1 / (r * H).
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    plain = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    return log_shares([(model.id_to_piece(i), model.get_score(i)) for i in plain])


def log_shares(scored: list[tuple[str, float]]) -> dict[str, float]:
    """Log probabilities of pieces in the order of their ranks, from the scores of a vocabulary file; see ``load_pieces``."""
    if any(score != int(score) for _, score in scored):
        return dict(scored)
    norm = math.log(sum(1 / r for r in range(1, len(scored) + 1)))
    return {name: -math.log(r) - norm for r, (name, _) in enumerate(scored, 1)}


class Trie:
    """A trie of pre-tokens, of which each node has the best score of its prefix and that segmentation's number of pieces.

    A node's forward score follows from its ancestors' scores and the pieces that end at it, so a prefix is scored once
    for all pre-tokens that share it. Pre-tokens come in order, which walks the trie depth first: only the nodes on the way
    to the present one are held. A character that is no piece is spelled in bytes, each with ``byte_score``. Ties go to
    fewer pieces.
    """

    def __init__(self, pieces: dict[str, float]) -> None:
        self.pieces = pieces
        self.byte_score = min(pieces.values(), default=0.0) - 1.0
        lengths: dict[str, set[int]] = {}
        for p in pieces:
            if len(p) > 1:
                lengths.setdefault(p[-2:], set()).add(len(p))
        self.lengths = {k: tuple(sorted(v)) for k, v in lengths.items()}
        self.nodes = 0

    def terminals(self, texts: list[str]) -> list[tuple[int, float]]:
        """The number of pieces and the score of the best segmentation of each of some sorted texts."""
        pieces, endings, byte_score = self.pieces.get, self.lengths.get, self.byte_score
        score, count = [0.0], [0]
        before, out = "", []
        for text in texts:
            same = 0
            for a, b in zip(before, text):
                if a != b:
                    break
                same += 1
            del score[same + 1 :], count[same + 1 :]
            for at in range(same + 1, len(text) + 1):
                c = text[at - 1]
                best = pieces(c)
                if best is None:
                    size = len(c.encode("utf-8", "surrogatepass"))
                    best, least = score[-1] + size * byte_score, count[-1] + size
                else:
                    best, least = score[-1] + best, count[-1] + 1
                if at > 1:
                    for n in endings(text[at - 2 : at], ()):
                        if n > at:
                            break
                        value = pieces(text[at - n : at])
                        if value is not None:
                            value += score[at - n]
                            if value > best or value == best and count[at - n] + 1 < least:
                                best, least = value, count[at - n] + 1
                score.append(best)
                count.append(least)
            self.nodes += len(text) - same
            before = text
            out.append((count[-1], score[-1]))
        return out


def count_new(tokens: list[list[bytes]], known: dict[bytes, int], trie: Trie) -> None:
    """Adds the counts of pre-tokens that are not known yet, all in one trie."""
    new = sorted(MARK + t.decode() for t in set().union(*tokens) - known.keys())
    for text, (n, _) in zip(new, trie.terminals(new)):
        known[text[1:].encode()] = n


def token_counts(docs: DataFrame, pieces: dict[str, float], id_col: str = "doc_id", text_col: str = "text", remembered: int = REMEMBERED) -> DataFrame:
    """(id, n_pretokens, n_tokens) for every row of ``docs``.

    Pre-tokens are runs without ASCII white space; each is segmented by itself, the mark before it. Null, empty and blank
    texts have none. Rows are counted alone: repeated rows and null ids each return; an empty table gives an empty
    result; other columns are not read. A task inserts the distinct new pre-tokens of each step of text in a trie and
    remembers a bounded number of counts. The vocabulary is broadcast; it has the size of its file.
    """
    shared = docs.sparkSession.sparkContext.broadcast(pieces)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, known = Trie(shared.value), {}
        for part in slices(batches, "text"):
            tokens = [t.split() for t in utf8(part.column("text"))]
            if len(known) > remembered:
                known.clear()
            count_new(tokens, known, trie)
            found = [sum(map(known.__getitem__, t)) for t in tokens]
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(map(len, tokens), pa.int64()), pa.array(found, pa.int64())], ["id", "n_pretokens", "n_tokens"])

    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return rows.mapInArrow(run, "id long, n_pretokens long, n_tokens long").withColumnRenamed("id", id_col)
