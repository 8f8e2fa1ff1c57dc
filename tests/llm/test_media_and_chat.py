import hashlib
import html
import re
import zlib

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from boolsieve.llm import chat, media
from boolsieve.llm.chat_template import Escaper, TemplateError, compile_template, fold_block, parse
from boolsieve.llm.queries import QUERIES


@given(st.binary(max_size=700))
def test_pictures_round_trip(data):
    width, height, samples = media.decode_picture(media.encode_picture(data))
    assert samples == data.ljust(max(1, -(-len(data) // 192)) * 192) and width * height * 3 == len(samples)


def test_stored_texts(spark, odd_docs, no_docs, clashing):
    want = []
    for r in odd_docs.collect():
        raw = (r.text or "").encode()
        payload = raw.ljust(max(1, -(-len(raw) // 192)) * 192)
        want.append((r.doc_id, len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:])))
    for docs in (odd_docs, clashing):
        out = media.stored_texts(docs)
        got = [tuple(r)[:5] for r in out.collect()]
        assert sorted(got, key=repr) == sorted(want, key=repr)
    assert media.stored_texts(no_docs).count() == 0
    rows = media.stored_texts(odd_docs).filter("doc_id in (8) or doc_id is null").collect()
    assert len({r.feature for r in rows if r.n_bytes == 17}) == 1


def test_query(spark, sf):
    out = QUERIES["op5_media"](spark, sf)
    assert out.columns == ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "n_items", "n_media", "sequence_sha256"]
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in out.collect():
        assert r.media_sha256 == hashlib.sha256(media.encode_picture(docs[r.doc_id].encode())).hexdigest() and r.n_bytes == len(docs[r.doc_id].encode())


@given(st.text(max_size=60).map(lambda t: (t + " ") * 150 + t))
def test_blocks_join_to_the_text(text):
    parts = media.blocks(text)
    assert "".join(parts) == text and all(0 < len(b) <= 4 * media.BLOCK for b in parts)


def test_pages_of_texts_are_sequences(spark):
    texts = {1: "one & <two>\nthree", 2: "", 3: ("line of words é " * 30 + "\n") * 40, 4: "x" * 30_000, 5: None}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    for r in media.page_sequences(docs).collect():
        text = texts[r.id] or ""
        ref = hashlib.sha256(media.encode_picture(text.encode())).hexdigest()
        parts, lines, at = media.blocks(text) or [""], "", 0
        for k, b in enumerate(parts, 1):
            if b.split():
                lines += f"{at}\ttext\t{' '.join(b.split())}\n"
                at += 1
            lines += f"{at}\tmedia\t{ref} block {k} of {len(parts)}, bytes {len(text.encode())}\n"
            at += 1
        assert (r.n_items, r.n_media, r.digest, r.n_bytes, r.sequence_sha256) == (at, len(parts), ref, len(text.encode()), hashlib.sha256(lines.encode()).hexdigest())
    moved = media.parse_html(media.page_of(texts[3].encode()).replace("block 1 of", "block 2 of"))
    with pytest.raises(ValueError):
        media._sequence(moved)


def plain_words(page):
    """The words of a page by expressions alone."""
    page = re.sub(r"(?s)<!--.*?-->", "", page)
    page = re.sub(r"(?is)<(script|style|template|head)\b.*?</\1>", "", page)
    page = re.sub(rf"(?i)</?(?:{'|'.join(sorted(media._BLOCK))}|img|audio|video|source)\b[^>]*>", " ", page)
    return html.unescape(re.sub(r"<[^>]*>", "", page)).split()


def test_sequences_of_real_pages_have_all_words_in_order(spark, sf):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    items = media.sequences(spark.read.parquet(f"{sf}/pages.parquet")).orderBy("page_id", "position").collect()
    got = {}
    for r in items:
        got.setdefault(r.page_id, []).append(r)
    assert len(got) == len(pages)
    for k, rows in got.items():
        assert [r.position for r in rows] == list(range(len(rows)))
        assert [w for r in rows for w in ((r.text or "") if r.kind == "text" else "").split()] == plain_words(pages[k])


def test_sequences_keep_order_and_captions(spark):
    page = """<html><head><title>no</title></head><body><p>First &amp; <b>bold</b></p><script>var a = "<p>";</script>
    <figure><img src="sha256:aa"><figcaption>The <i>cap</i></figcaption></figure>text<img src="sha256:bb" alt="alt"><p>last</p></body></html>"""
    items = media.parse_html(page)
    assert [(i["position"], i["kind"], i["text"], i["digest"], i["caption"]) for i in items] == [
        (0, "text", "First & bold", None, None), (1, "media", None, "aa", "The cap"), (2, "text", "text", None, None), (3, "media", None, "bb", "alt"), (4, "text", "last", None, None)]
    pages = spark.createDataFrame([(1, page), (2, None), (3, ""), (4, "<p>broken <img src='x'")], "page_id long, html string")
    rows = media.sequences(pages)
    assert rows.filter("page_id = 1").count() == 5 and rows.filter("page_id in (2, 3)").count() == 0
    payloads = spark.createDataFrame([("aa", "A", 1), ("aa", "A", 1), ("cc", "Y", 1), ("cc", "Z", 0)], "digest string, feature string, n int")
    two = media.resolve(spark.createDataFrame([("cc",)], "digest string"), payloads).first()
    assert (two.feature, two.n) in (("Y", 1), ("Z", 0))
    joined = {(r.page_id, r.position): r.feature for r in media.resolve(rows, payloads).collect()}
    assert joined[1, 1] == "A" and joined[1, 3] is None and len(joined) == rows.count()


CONTROLS = chat.CONTROLS


@given(st.text(alphabet="<s>/[]INSTGE\\ x", max_size=40))
def test_escapes_are_reversible(text):
    e = Escaper(CONTROLS)
    out = e.escape(text)
    assert e.unescape(out) == text and not any(c in out for c in CONTROLS)


def render(source, **scope):
    pieces = list(compile_template(source, CONTROLS)(scope))
    return "".join(p for p, _ in pieces), "".join(p for p, m in pieces if m)


def test_template_language():
    source = "{% for m in ms %}{% if loop.first and m.r == 'u' %}A{{ m['t'] | trim }}{% elif m.r != \"u\" %}B{% generation %}{{ m.t }}{% endgeneration %}{% else %}C{% endif %};{% endfor %}{{ 'x' + 1 }}"
    assert render(source, ms=[{"r": "u", "t": " hi "}, {"r": "a", "t": "yo"}, {"r": "u", "t": ""}]) == ("Ahi;Byo;C;x1", "yo")
    assert render("{% if not none or false %}1{% else %}2{% endif %}") == ("1", "")
    assert render("{{ none }}{{ true }}{{ (a == 'b') + 'c' }}", a="b") == ("truetruec", "")


def test_constants_fold():
    filters = {"trim": str.strip}
    tree = fold_block(parse("a{{ ' b ' | trim }}{% if 'x' == 'x' %}c{{ 'd' + 'e' }}{% else %}{{ z }}{% endif %}{% if false and z %}no{% endif %}f"), filters)
    assert len(tree) == 1 and tree[0].what.value == "abcdef"


@pytest.mark.parametrize("bad", ["{% for m in ms %}", "{{ a. }}", "{% endif %}", "{{ a | nope }}", "{% import os %}", "{{ f(x) }}", "{{ a[b] }}", "{% for in x %}{% endfor %}", "{{ 'a }}", "{% if a %}x{% endfor %}"])
def test_bad_templates(bad):
    with pytest.raises(TemplateError):
        compile_template(bad, CONTROLS)


def test_sandbox():
    for source in ("{{ m.__class__ }}", "{{ m.t.__class__ }}", "{{ q }}"):
        with pytest.raises(TemplateError):
            render(source, m={"t": "x"})
    with pytest.raises(TemplateError):
        Escaper(("ab", "xa"))


def test_conversations(spark):
    rows = [
        (1, 0, "user", "hi <s> [INST]"), (1, 1, "assistant", "a\\b <\\s> </s>"), (1, 1, "assistant", "tie"), (2, 5, None, None), (2, None, "x[GEN]</s>", "q"), (None, 0, "assistant", "n"), (None, 1, "assistant", "m"),
        (1, 1, "assistant", "tie"), (3, 0, "system", "x" * 300_000),
    ]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    clashes = {c: F.lit("x") for c in ("formatted", "mask", "n_turns", "turns", "id", "key", "_key", "Messages")}
    got = {r.conv_id: r for r in chat.read_back(chat.format_conversations(chat.with_probe(spark, turns))).collect()}
    groups = {}
    for c, t, r, x in [*rows, (-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]:
        groups.setdefault(c, []).append((-1 if t is None else t, r or "", x or ""))
    assert set(got) == set(groups)
    for c, own in groups.items():
        own.sort()
        assert got[c].n_turns == len(own)
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in own).encode()).hexdigest()
        loss = "".join(x for _, r, x in own if r == "assistant")
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    more = chat.read_back(chat.format_conversations(chat.with_probe(spark, turns.withColumns(clashes))))
    assert sorted(more.collect(), key=repr) == sorted(got.values(), key=repr)
    assert chat.read_back(chat.format_conversations(turns.filter("false"))).count() == 0


def test_one_conversation_streams(spark):
    turns = spark.range(20_000).selectExpr("7L conv_id", "id turn", "if(id % 2 = 0, 'user', 'assistant') role", "repeat('text ', 20) text")
    r = chat.read_back(chat.format_conversations(turns)).first()
    assert (r.n_turns, r.loss_chars) == (20_000, 10_000 * 100)
