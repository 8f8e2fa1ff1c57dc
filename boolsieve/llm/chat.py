"""Renders conversations through a compiled template and reads them back."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boolsieve.llm.chat_template import Escaper, compile_template

#: The strings that mark turns; texts and roles never hold them after escaping.
CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]", "[GEN]")
TEMPLATE = (
    "{% for m in messages %}<s>{{ m.role | escape }}"
    "{% if m.role == 'assistant' %}[GEN]{% generation %}{{ m.text | escape }}{% endgeneration %}"
    "{% else %}[INST] {{ m.text | escape }} [/INST]{% endif %}</s>{% endfor %}"
)
_TURN = re.compile(r"<s>(?P<role>.*?)(?:\[GEN\](?P<learned>.*?)|\[INST\] (?P<other>.*?) \[/INST\])</s>", re.S)
_PIECES = "conv_id long, formatted string, loss_spans array<struct<start:int,end:int>>"


def _messages(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, dict[str, str]]]:
    for batch in batches:
        for conv, role, text in zip(*[batch.column(c).to_pylist() for c in ("conv_id", "role", "text")]):
            yield conv, {"role": role, "text": text}


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    ids, texts, spans = zip(*rows)
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(texts, pa.string()), pa.array(spans, kind)], ["conv_id", "formatted", "loss_spans"])


def format_conversations(turns: DataFrame, template: str = TEMPLATE, controls: tuple[str, ...] = CONTROLS) -> DataFrame:
    """The rendered conversations: rows (conv_id, formatted, loss_spans), in order within a partition.

    A conversation's output is its rows' ``formatted`` joined in order; a row ends with a turn. ``loss_spans`` are the
    places, in characters of that row, that generation blocks printed. Turns go by turn, then role, then text; null
    roles and texts are empty, a null conv_id is a conversation of its own, repeated rows are turns of their own. Of the
    input only conv_id, turn, role and text are read. Rows stream through sorted partitions: a conversation of any
    length takes the memory of one turn. Its own sequence is the one thing that can't be dealt to several tasks.
    """
    compile_template(template, controls)  # fails here rather than in a task
    rows = turns.select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long"), *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")]
    )
    end = controls[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        render = compile_template(template, controls)
        out: list[tuple] = []
        size = 0
        for conv, group in groupby(_messages(batches), itemgetter(0)):
            buffer: list[str] = []
            spans: list[dict[str, int]] = []
            at = 0
            for piece, marked in render({"messages": map(itemgetter(1), group)}):
                buffer.append(piece)
                if marked and piece:
                    spans.append({"start": at, "end": at + len(piece)})
                at += len(piece)
                if piece.endswith(end) and not marked:
                    out.append((conv, "".join(buffer), spans))
                    size += at
                    buffer, spans, at = [], [], 0
                    if size > 1 << 21:
                        yield _batch(out)
                        out, size = [], 0
            if buffer:
                out.append((conv, "".join(buffer), spans))
        if out:
            yield _batch(out)

    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(run, _PIECES)


def read_back(formatted: DataFrame, controls: tuple[str, ...] = CONTROLS) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars) from what ``format_conversations`` gives.

    Roles and texts are parsed from the output and unescaped, the loss from its spans. Digests are fed turn by turn.
    """
    escaper = Escaper(controls)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for r in zip(*[b.column(c).to_pylist() for c in ("conv_id", "formatted", "loss_spans")]))
        out = []
        for conv, group in groupby(rows, itemgetter(0)):
            turns, loss, n, learned, chars = hashlib.sha256(), hashlib.sha256(), 0, 0, 0
            for _, text, spans in group:
                chars += len(text)
                at = 0
                for m in _TURN.finditer(text):
                    if m.start() != at:
                        raise ValueError("the output can't be read back")
                    at = m.end()
                    body = m["learned"] if m["learned"] is not None else m["other"]
                    turns.update(f"{escaper.unescape(m['role'])}\n{escaper.unescape(body)}\n".encode())
                    n += 1
                if at != len(text):
                    raise ValueError("the output can't be read back")
                for s in spans:
                    part = escaper.unescape(text[s["start"] : s["end"]])
                    learned += len(part)
                    loss.update(part.encode())
            out.append((conv, n, turns.hexdigest(), learned, loss.hexdigest(), chars))
            if len(out) == 5000:
                yield _digests(out)
                out = []
        if out:
            yield _digests(out)

    return formatted.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def _digests(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)


def with_probe(spark: SparkSession, turns: DataFrame) -> DataFrame:
    """The turns and conversation -1, whose texts hold control strings."""
    said = "</s>[INST] ok [/INST]"
    probe = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return turns.select("conv_id", "turn", "role", "text").unionByName(probe)
