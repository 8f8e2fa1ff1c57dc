"""Interleaved text and media sequences, with payloads in a column and digests as references."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from html import escape
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boolsieve.llm.common import free, slices, utf8
from boolsieve.session import cut

#: Samples of a picture's row: 64 pixels of three 8-bit channels.
ROW_BYTES = 192
_WIDTH = ROW_BYTES // 3
_BLOCK = frozenset("p div h1 h2 h3 h4 h5 h6 li td th tr article section figure figcaption blockquote pre table ul ol br".split())
_HIDDEN = frozenset(("script", "style", "template", "head"))
ITEM = "position int, kind string, text string, digest string, caption string"


class _Items(HTMLParser):
    """Text and media references of a page, in order."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.items: list[dict] = []
        self.text: list[str] = []
        self.hidden: list[str] = []
        self.figure: int | None = None
        self.caption: list[str] | None = None

    def flush(self) -> None:
        text = " ".join("".join(self.text).split())
        self.text = []
        if text:
            self.items.append({"kind": "text", "text": text, "digest": None, "caption": None})

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in _HIDDEN:
            self.hidden.append(tag)
        if tag in _BLOCK and self.caption is None:
            self.flush()
        if tag == "figure":
            self.figure = len(self.items)
        elif tag == "figcaption":
            self.caption = []
        elif tag in ("img", "audio", "video", "source") and not self.hidden:
            values = dict(attrs)
            self.flush()
            source = values.get("src") or ""
            self.items.append({"kind": "media", "text": None, "digest": source.removeprefix("sha256:"), "caption": values.get("alt")})

    def handle_endtag(self, tag: str) -> None:
        if tag in self.hidden:
            while self.hidden.pop() != tag:
                pass
        if tag == "figcaption" and self.caption is not None:
            words = " ".join("".join(self.caption).split())
            for item in self.items[self.figure or 0 :]:
                if item["kind"] == "media":
                    item["caption"] = words
            self.caption = None
        elif tag == "figure":
            self.figure = None
        if tag in _BLOCK and self.caption is None:
            self.flush()

    def handle_data(self, data: str) -> None:
        if not self.hidden:
            (self.text if self.caption is None else self.caption).append(data)


def parse_html(html: str) -> list[dict]:
    """The items of a page with their positions: text blocks, and media with digest and caption."""
    parser = _Items()
    parser.feed(html)
    parser.close()
    parser.flush()
    return [{"position": i, **item} for i, item in enumerate(parser.items)]


def sequences(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(id, position, kind, text, digest, caption): the items of every page, one row each. Null and empty pages have none."""
    kind = pa.struct([("position", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("digest", pa.string()), ("caption", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "html"):
            items = [parse_html(t.decode()) for t in utf8(part.column("html"))]
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(items, pa.list_(kind))], ["id", "items"])

    rows = pages.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{html_col}`").cast("string").alias("html"))
    return rows.mapInArrow(run, f"id long, items array<struct<{ITEM.replace(' ', ':').replace(',:', ',')}>>").select(F.col("id").alias(id_col), F.inline("items"))


def encode_picture(payload: bytes) -> bytes:
    """A binary pixel map (P6) of 64 pixels a row whose samples are the payload; the rest of its last row is spaces."""
    padded = payload.ljust(max(1, -(-len(payload) // ROW_BYTES)) * ROW_BYTES)
    return b"P6\n%d %d\n255\n" % (_WIDTH, len(padded) // ROW_BYTES) + padded


def decode_picture(stored: bytes) -> tuple[int, int, bytes]:
    """Width, height and samples of a binary pixel map."""
    magic, size, depth, samples = stored.split(b"\n", 3)
    width, height = map(int, size.split())
    if magic != b"P6" or depth != b"255" or len(samples) != width * height * 3:
        raise ValueError("not a pixel map of this kind")
    return width, height, samples


def picture_feature(width: int, height: int, samples: bytes) -> str:
    """Size and mean of each channel, in hundredths."""
    import numpy as np

    sums = np.frombuffer(samples, np.uint8).reshape(-1, 3).sum(axis=0, dtype=np.int64).tolist()
    return f"{width}x{height}:" + ",".join(str(s * 100 // (width * height)) for s in sums)


def payload_store(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(digest, media): the stored form of every text; null counts as empty, copies are not dropped."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            stored = [encode_picture(t) for t in utf8(part.column("text"))]
            digests = [hashlib.sha256(m).hexdigest() for m in stored]
            yield pa.RecordBatch.from_arrays([pa.array(digests), pa.array(stored, pa.binary())], ["digest", "media"])

    return docs.select(F.col(f"`{text_col}`").cast("string").alias("text")).mapInArrow(run, "digest string, media binary")


def read_payloads(store: DataFrame) -> DataFrame:
    """(digest, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature) of each stored medium.

    All values come from the stored bytes, which are decoded here; a medium that doesn't have its digest is an error.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "media"):
            rows = []
            for digest, media in zip(part.column("digest").to_pylist(), utf8(part.column("media"))):
                own = hashlib.sha256(media).hexdigest()
                if own != digest:
                    raise ValueError("a stored medium doesn't have its digest")
                width, height, samples = decode_picture(media)
                rows.append((digest, len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-16:]), len(media), own, picture_feature(width, height, samples)))
            kinds = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            names = ["digest", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    return store.mapInArrow(run, "digest string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def resolve(items: DataFrame, payloads: DataFrame) -> DataFrame:
    """The items with their payload's columns, joined by digest; text items and unknown digests have nulls there.

    Payloads are reduced to a row for each digest first, so that a medium with many copies is one row in the join; its
    references can be split among tasks. Payloads should carry what is asked of them (features, a path) and not media; of
    several rows of a digest one stays whole, the one of the smallest hash.
    """
    (digest,) = free(items, "_digest")
    row = F.struct(*[F.col(f"`{c}`") for c in payloads.columns if c != "digest"])
    once = cut(payloads.groupBy("digest").agg(F.min_by(row, F.xxhash64(row)).alias("_row")).select(F.col("digest").alias(digest), "_row.*"))
    return items.join(once, F.col("digest") == F.col(digest), "left").drop(digest)


#: Bytes of a text from which on the next line break, or after twice as many the next blank, ends a block of its page.
BLOCK = 2000


def blocks(text: str) -> list[str]:
    """A text in order, cut behind line breaks or blanks; the blocks joined are the text."""
    out, at = [], 0
    while at < len(text):
        end = text.find("\n", at + BLOCK, at + 2 * BLOCK)
        if end < 0:
            end = text.find(" ", at + 2 * BLOCK, at + 4 * BLOCK)
        end = min(len(text), at + 4 * BLOCK) if end < 0 else end + 1
        if len(text) <= at + 2 * BLOCK:
            end = len(text)
        out.append(text[at:end])
        at = end
    return out


def text_items(html: str) -> list[str]:
    """What a reader sees of some HTML, block by block, blanks made one."""
    return [i["text"] for i in parse_html(html) if i["kind"] == "text"]


def page_of(text: bytes) -> str:
    """A page with the text's blocks as paragraphs in order, and behind each a figure that refers to the text's stored form.

    A figure's caption says which block it follows, of how many, and the text's bytes.
    """
    ref = hashlib.sha256(encode_picture(text)).hexdigest()
    parts = blocks(text.decode()) or [""]
    figure = f'<figure><img src="sha256:{ref}"/><figcaption>block {{}} of {len(parts)}, bytes {len(text)}</figcaption></figure>'
    return "<article>" + "".join(f"<p>{escape(b)}</p>{figure.format(k)}" for k, b in enumerate(parts, 1)) + "</article>"


_CAPTION = re.compile(r"block (\d+) of (\d+), bytes (\d+)")
_SEQUENCE = "n_items long, n_media long, digest string, n_bytes long, sequence_sha256 string"


def _sequence(items: list[dict]) -> tuple[int, int, str, int, str]:
    """What a page's items come to: a caption that doesn't follow its block, or names another text, is an error."""
    media = [i for i in items if i["kind"] == "media"]
    told = [tuple(map(int, _CAPTION.fullmatch(m["caption"]).groups())) for m in media]
    if [k for k, _, _ in told] != list(range(1, len(media) + 1)) or len({(m["digest"], *t[1:]) for m, t in zip(media, told)}) != 1 or told[0][1] != len(media):
        raise ValueError("captions and positions of a page don't go together")
    lines = (f"{i['position']}\t{i['kind']}\t{i['text'] if i['kind'] == 'text' else i['digest'] + ' ' + i['caption']}\n" for i in items)
    return len(items), len(media), media[0]["digest"], told[0][2], hashlib.sha256("".join(lines).encode()).hexdigest()


def page_sequences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_items, n_media, digest, n_bytes, sequence_sha256) of each row's page, as parsing it gives."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            rows = [_sequence(parse_html(page_of(t))) for t in utf8(part.column("text"))]
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([part.column("id"), *(pa.array(c, k) for c, k in zip(zip(*rows), kinds))], ["id", *(f.split()[0] for f in _SEQUENCE.split(", "))])

    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, {_SEQUENCE}")


def stored_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: what reading its text's stored form back gives, and its page's sequence.

    Texts become pages of blocks and figures that refer to pictures by digest; the pages are parsed to sequences in which
    every caption must follow its block, and references are resolved by a digest join with the payload store. A payload
    whose size isn't that of the captions is an error. Null texts are empty; an empty text is one row of spaces. Equal texts
    give equal values; repeated rows and null ids each return; other columns are not read.
    """
    joined = resolve(page_sequences(docs, id_col, text_col), read_payloads(payload_store(docs, text_col)))
    padded = F.greatest(F.ceil(F.col("n_bytes") / ROW_BYTES), F.lit(1)) * ROW_BYTES
    checked = F.when(F.col("payload_bytes") == padded, F.col("payload_bytes")).otherwise(F.raise_error(F.lit("a payload isn't what its captions say")).cast("long"))
    return joined.select(
        F.col("id").alias(id_col), "n_bytes", checked.alias("payload_bytes"), "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "n_items", "n_media", "sequence_sha256",
    )
