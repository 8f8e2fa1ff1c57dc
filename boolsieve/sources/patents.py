"""Patent documents: nested archives, two XML dialects, and their full text."""

from __future__ import annotations

import io
import re
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_TEXT = "array<struct<lang:string,text:string>>"
_PARTY = "array<struct<sequence:string,name:string,address:string,country:string>>"
DOCUMENT = (
    "id string, dialect string, country string, number string, kind string, date string, family_id string, language string, application_id string, priorities array<string>, "
    f"ipc array<struct<symbol:string,version:string,is_primary:boolean>>, cpc array<struct<symbol:string,is_inventive:boolean>>, applicants {_PARTY}, inventors {_PARTY}, "
    f"titles {_TEXT}, abstracts {_TEXT}, claims array<struct<num:string,lang:string,text:string>>, states array<string>"
)
# fixed values: a classification symbol, and an entity of a document type
_SYMBOL = re.compile(r"[A-H]\d{2}[A-Z]\s*\d+/?\d*")
_ENTITY = re.compile(rb"<!ENTITY\s+([\w.-]+)\s+\"([^\"]*)\"")


def archives(spark: SparkSession, path: str) -> DataFrame:
    """``members`` of the archives below a folder."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.zip").load(path)
    return members(found)


def members(rows: DataFrame) -> DataFrame:
    """(path, xml) of every document in archives (path, content): XML files, in archives in archives, tables of contents left out.

    Entities that an archive's DTD files define are resolved before the XML is read. One archive is one row of work.
    """

    def inside(data: bytes, name: str) -> Iterator[tuple[str, bytes]]:
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            for info in sorted(z.infolist(), key=lambda i: i.filename):
                if info.filename.lower().endswith(".zip"):
                    yield from inside(z.read(info), f"{name}/{info.filename}")
                elif not info.is_dir():
                    yield f"{name}/{info.filename}", z.read(info)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"]):
                files = list(inside(content, path))
                entities = {k.decode(): v.decode() for n, d in files if n.lower().endswith((".dtd", ".ent")) for k, v in _ENTITY.findall(d)}
                xml = [(n, resolve_entities(d.decode("utf-8", "replace"), entities)) for n, d in files if n.lower().endswith(".xml") and not n.lower().endswith("toc.xml")]
                yield pd.DataFrame(xml, columns=["path", "xml"])

    return rows.select("path", "content").mapInPandas(run, "path string, xml string")


def resolve_entities(xml: str, entities: dict[str, str]) -> str:
    plain = {"amp", "lt", "gt", "quot", "apos"}
    return re.sub(r"&([A-Za-z][\w.-]*);", lambda m: m[0] if m[1] in plain else entities.get(m[1], ""), xml)


def _all(node: ET.Element | None) -> str | None:
    text = " ".join("".join(node.itertext()).split()) if node is not None else ""
    return text or None


def _first(node: ET.Element | None, path: str) -> str | None:
    return _all(node.find(path)) if node is not None else None


def _joined(*parts: str | None) -> str | None:
    return "-".join(p for p in parts if p) or None


def _reference(node: ET.Element | None) -> tuple[str | None, str | None, str | None, str | None]:
    doc = node.find(".//document-id") if node is not None else None
    return tuple(_first(doc, p) for p in ("country", "doc-number", "kind", "date"))


def _parties(nodes: list[ET.Element], name: str) -> list[dict]:
    out = []
    for n in nodes:
        label = _first(n, f".//{name}") or _first(n, ".//name") or _first(n, ".//last-name")
        if label:
            lines = [_all(x) for x in n.iterfind(".//address/*") if x.tag != "country"]
            out.append({"sequence": n.get("sequence"), "name": label, "address": ", ".join(x for x in lines if x) or None, "country": _first(n, ".//country")})
    return out


def _ipc(text: str | None, sequence: str | None) -> dict | None:
    m = _SYMBOL.search(text or "")
    version = re.search(r"(?<!\d)(\d{8})(?!\d)", text or "")
    return {"symbol": " ".join(m[0].split()), "version": version[1] if version else None, "is_primary": sequence == "1"} if m else None


def parse_exchange(doc: ET.Element) -> dict:
    """A document of the exchange dialect."""
    country, number, kind, date = (doc.get(a) for a in ("country", "doc-number", "kind", "date-publ"))
    own = _reference(doc.find(".//publication-reference"))
    country, number, kind, date = country or own[0], number or own[1], kind or own[2], date or own[3]
    cpc = []
    for c in doc.iterfind(".//patent-classification"):
        parts = [_first(c, p) for p in ("section", "class", "subclass", "main-group", "subgroup")]
        symbol = _first(c, "classification-symbol") or ("".join(p or "" for p in parts[:3]) + (f"{parts[3]}/{parts[4]}" if parts[3] else "")) or None
        if symbol:
            cpc.append({"symbol": symbol, "is_inventive": _first(c, "classification-value") == "I"})
    abstracts = []
    for a in doc.iterfind(".//abstract"):
        text = " ".join(t for t in ([_all(p) for p in a.iterfind("p")] or [_all(a)]) if t)
        if text:
            abstracts.append({"lang": a.get("lang"), "text": text})
    ipc = [_ipc(_first(c, "text") or _all(c), c.get("sequence")) for c in doc.iterfind(".//classification-ipcr")]
    return {
        "id": _joined(country, number, kind), "dialect": "exchange", "country": country, "number": number, "kind": kind, "date": date, "family_id": doc.get("family-id"),
        "language": _first(doc, ".//language-of-publication"), "application_id": _joined(*_reference(doc.find(".//application-reference"))[:3]),
        "priorities": [x for x in (_joined(*_reference(p)[:2]) for p in doc.iterfind(".//priority-claim")) if x], "ipc": [x for x in ipc if x], "cpc": cpc,
        "applicants": _parties(doc.findall(".//applicant"), "applicant-name"), "inventors": _parties(doc.findall(".//inventor"), "inventor-name"),
        "titles": [{"lang": t.get("lang"), "text": _all(t)} for t in doc.iterfind(".//invention-title") if _all(t)], "abstracts": abstracts, "claims": [], "states": [],
    }


def parse_full_text(doc: ET.Element) -> dict:
    """A document of the full-text dialect, whose bibliography has numbered fields."""
    langs = [_all(x) for x in doc.iterfind(".//B540/B541")]
    texts = [_all(x) for x in doc.iterfind(".//B540/B542")]
    ipc = [_ipc(_all(x), str(i)) for i, x in enumerate(doc.iterfind(".//B510EP/classification-ipcr"), 1)]
    country, number, kind = (doc.get(a) for a in ("country", "doc-number", "kind"))
    people = lambda path: [{"sequence": str(i), "name": _first(x, "snm"), "address": ", ".join(t for t in (_first(x, "adr/str"), _first(x, "adr/city")) if t) or None, "country": _first(x, "adr/ctry")} for i, x in enumerate(doc.iterfind(path), 1) if _first(x, "snm")]
    return {
        "id": doc.get("id") or _joined(country, number, kind), "dialect": "full text", "country": country, "number": number, "kind": kind, "date": doc.get("date-publ"), "family_id": None,
        "language": doc.get("lang"), "application_id": _first(doc, ".//B210"), "priorities": [x for x in (_all(p) for p in doc.iterfind(".//B310")) if x], "ipc": [x for x in ipc if x],
        "cpc": [{"symbol": _all(x), "is_inventive": True} for x in doc.iterfind(".//classification-cpc/text") if _all(x)], "applicants": people(".//B711"), "inventors": people(".//B721"),
        "titles": [{"lang": a, "text": b} for a, b in zip(langs, texts) if b], "abstracts": [{"lang": a.get("lang"), "text": _all(a)} for a in doc.iterfind(".//abstract") if _all(a)],
        "claims": [{"num": c.get("num"), "lang": g.get("lang"), "text": _all(c)} for g in doc.iterfind(".//claims") for c in g.iterfind("claim") if _all(c)],
        "states": [x for x in (_all(s) for s in doc.iterfind(".//B840/ctry")) if x],
    }


def _bare(root: ET.Element) -> ET.Element:
    for n in root.iter():
        if isinstance(n.tag, str):
            n.tag = n.tag.rpartition("}")[2]
    return root


def parse(xml: str) -> list[dict]:
    """The documents of a file, by the dialect of its root; none if it can't be read."""
    try:
        root = _bare(ET.fromstring(re.sub(r"<!DOCTYPE[^>\[]*(\[.*?\])?\s*>", "", xml, flags=re.S)))
    except ET.ParseError:
        return []
    if root.tag == "ep-patent-document":
        return [parse_full_text(root)]
    return [parse_exchange(d) for d in root.iter("exchange-document")]


def documents(files: DataFrame) -> DataFrame:
    """The parsed documents of (path, xml) rows; those without an id are left out."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = re.findall(r"(?:^|, )(\w+) (?=string|array)", DOCUMENT)
        for pdf in batches:
            rows = [d for x in pdf["xml"] for d in parse(x or "")]
            yield pd.DataFrame(rows, columns=names)

    return files.select("xml").mapInPandas(run, DOCUMENT).filter("id is not null")


def full_text() -> Column:
    """All texts of a document in a fixed order, blank ones left out."""
    texts = lambda c: F.transform(c, lambda x: x["text"])
    parts = F.flatten(F.array(
        F.array("id", "family_id"), texts("titles"), texts("abstracts"), texts("claims"), F.transform("applicants", lambda x: x["name"]), F.transform("inventors", lambda x: x["name"]),
        F.transform("ipc", lambda x: x["symbol"]), F.transform("cpc", lambda x: x["symbol"]), "priorities", "states",
    ))
    return F.array_join(F.filter(parts, lambda t: F.trim(t) != ""), " ")


def matching_claims(words: list[str], mark: str = "*") -> Column:
    """The claims that have all the words, with these marked; an empty array if none has."""
    every = [rf"(?<![a-z0-9]){re.escape(w.lower())}(?![a-z0-9])" for w in words]
    pattern = "|".join(re.escape(w) for w in words)

    def has_all(claim: Column) -> Column:
        out = F.lit(True)
        for e in every:
            out = out & F.lower(claim["text"]).rlike(e)
        return out

    hits = F.filter("claims", has_all)
    return F.transform(hits, lambda c: F.struct(c["num"].alias("num"), F.regexp_replace(c["text"], rf"(?i)(?<![a-z0-9])({pattern})(?![a-z0-9])", rf"{mark}$1{mark}").alias("text")))
