"""Ratings in XMP sidecars: reading, updating and new documents.

One pass of the platform's XML parser checks the whole document and gives the places of
the rating attributes and elements; names are resolved here, because the parser's own
namespace mode rejects undeclared prefixes, which sidecars may have.
"""

from __future__ import annotations

import re
from xml.parsers import expat

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values of the format.
RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
XMP = "http://ns.adobe.com/xap/1.0/"
RESERVED = {"xml": "http://www.w3.org/XML/1998/namespace", "xmlns": "http://www.w3.org/2000/xmlns/"}

NUMBER = re.compile(r"[+-]?(inf|infinity|nan|([0-9]+\.?[0-9]*|\.[0-9]+)(e[+-]?[0-9]+)?)", re.IGNORECASE | re.ASCII)
TAG = re.compile(rb"""<[^\s/>]+(?:[^>"']|"[^"]*"|'[^']*')*>""")
ATTRIBUTE = re.compile(rb"""([^\s=<>"'/]+)\s*=\s*("[^"]*"|'[^']*')""")
KEPT_MARKUP = re.compile(rb"<!--.*?-->|<\?.*?\?>", re.DOTALL)


class Malformed(ValueError):
    pass


def rating_value(text: str) -> int | None:
    """A number cut to 0..255; no number is no rating."""
    text = text.strip()
    if not NUMBER.fullmatch(text):
        return None
    value = float(text)
    return 0 if value != value or value <= 0 else int(min(value, 255))


class Sidecar:
    """Places and values of a document's ratings, in document order."""

    def __init__(self, xml: str):
        self.data = xml.encode()
        self.values: list[int] = []
        self.attributes: list[tuple[int, int]] = []  # value bytes, without quotes
        self.elements: list[dict] = []
        self.target: tuple[int, dict] | None = None  # the first description's start and its prefixes
        self.stack: list[dict] = []
        parser = self.parser = expat.ParserCreate("utf-8")
        parser.ordered_attributes = True
        parser.buffer_text = False
        parser.StartElementHandler, parser.EndElementHandler = self._start, self._end
        parser.CharacterDataHandler, parser.StartCdataSectionHandler = self._text, self._cdata
        try:
            parser.Parse(self.data, True)
        except expat.ExpatError as e:
            raise Malformed(str(e)) from e

    @staticmethod
    def _resolve(name: str, scope: dict, default: bool) -> tuple[str | None, str]:
        prefix, colon, local = name.rpartition(":")
        return (scope.get(prefix) if colon or default else None), local

    def _start(self, name: str, attributes: list[str]) -> None:
        at = self.parser.CurrentByteIndex
        scope = dict(self.stack[-1]["scope"]) if self.stack else dict(RESERVED)
        pairs = list(zip(attributes[::2], attributes[1::2]))
        for key, value in pairs:
            if key != "xmlns" and not key.startswith("xmlns:"):
                continue
            prefix = key[6:]
            if prefix == "xmlns" or (prefix == "xml") != (value == RESERVED["xml"]) or value == RESERVED["xmlns"]:
                raise Malformed(f"{key} can't be bound to {value}")
            scope[prefix] = value
        inside = bool(self.stack) and self.stack[-1]["description"]
        kind = self._resolve(name, scope, True)
        here = {"scope": scope, "description": kind == (RDF, "Description"), "rating": None, "at": at}
        tag = TAG.match(self.data, at)
        here["open_end"] = tag.end() if tag else at
        if here["description"]:
            if self.target is None:
                self.target = (here["open_end"], scope)
            found = [(k, v) for k, v in pairs if self._resolve(k, scope, False) == (XMP, "Rating")]
            if len(found) > 1:
                raise Malformed("two ratings on one element")
            for key, value in found:
                place = next(m for m in ATTRIBUTE.finditer(self.data, at, here["open_end"]) if m[1] == key.encode())
                self.attributes.append((place.start(2) + 1, place.end(2) - 1))
                if (number := rating_value(value)) is not None:
                    self.values.append(number)
        if inside and kind == (XMP, "Rating"):
            here["rating"] = {"name": name, "text": "", "cdata": False, "inner": []}
        self.stack.append(here)

    def _text(self, text: str) -> None:
        if self.stack and self.stack[-1]["rating"]:
            self.stack[-1]["rating"]["text"] += text

    def _cdata(self) -> None:
        if self.stack and self.stack[-1]["rating"]:
            self.stack[-1]["rating"]["cdata"] = True

    def _end(self, _: str) -> None:
        here, at = self.stack.pop(), self.parser.CurrentByteIndex
        empty = self.data[here["open_end"] - 2 : here["open_end"]] == b"/>"
        close = here["open_end"] if empty else self.data.index(b">", at) + 1
        if self.stack and self.stack[-1]["rating"]:
            self.stack[-1]["rating"]["inner"].append((here["at"], close))
        if rating := here["rating"]:
            rating |= {"empty": empty, "from": here["open_end"], "to": at}
            self.elements.append(rating)
            # An element without content has no value.
            if not empty and (number := rating_value(rating["text"])) is not None:
                self.values.append(number)


def parse_rating(xml: str | None) -> int | None:
    """The first rating in document order of a well-formed document."""
    if xml is None or "Rating" not in xml:
        return None
    try:
        found = Sidecar(xml)
    except Malformed:
        return None
    return found.values[0] if found.values else None


def update_rating(xml: str, rating: int) -> str:
    """The document with every rating replaced, or one put on its first description;
    all other bytes stay. Raises Malformed where there is nothing to write to."""
    found = Sidecar(xml)
    value = str(rating).encode()
    edits = [(a, b, value) for a, b in found.attributes]
    for e in found.elements:
        if e["empty"]:
            edits.append((e["from"] - 2, e["from"], b">" + value + b"</" + e["name"].encode() + b">"))
            continue
        # Elements, comments and instructions within stay, its own text goes.
        kept, at = b"", e["from"]
        for a, b in [*e["inner"], (e["to"], e["to"])]:
            kept += b"".join(KEPT_MARKUP.findall(found.data[at:a])) + found.data[a:b]
            at = b
        edits.append((e["from"], e["to"], kept + (b"<![CDATA[" + value + b"]]>" if e["cdata"] else value)))
    if not edits:
        if found.target is None:
            raise Malformed("no RDF description can hold the rating")
        end, scope = found.target
        prefix, declare = next((p for p, uri in scope.items() if p and uri == XMP), None), b""
        if prefix is None:
            prefix = "xmp" if "xmp" not in scope else "stars"
            while prefix in scope:  # taken for something else
                prefix += "_"
            declare = f' xmlns:{prefix}="{XMP}"'.encode()
        at = end - (2 if found.data[end - 2 : end] == b"/>" else 1)
        edits.append((at, at, f' {prefix}:Rating="'.encode() + value + b'"' + declare))
    out, at = [], 0
    for a, b, new in sorted(edits):
        if a < at:  # a rating inside a rating: the outer one's edit keeps the inner as it was
            continue
        out += [found.data[at:a], new]
        at = b
    return b"".join([*out, found.data[at:]]).decode()


# Types are objects: workers import this module without a session to parse names.
@F.pandas_udf(T.ShortType())
def _parse(xml: pd.Series) -> pd.Series:
    return xml.map(parse_rating, na_action="ignore").astype("Int16")


@F.pandas_udf(T.StructType([T.StructField("xml", T.StringType()), T.StructField("error", T.StringType())]))
def _update(xml: pd.Series, rating: pd.Series) -> pd.DataFrame:
    rows = []
    for x, r in zip(xml, rating):
        try:
            rows.append((update_rating(x, int(r)), None))
        except Malformed as e:
            rows.append((None, str(e)))
    return pd.DataFrame(rows, columns=["xml", "error"])


def xmp_parse_rating(xml: Column) -> Column:
    """Only documents that hold the word leave the JVM with their text."""
    return F.when(xml.contains("Rating"), _parse(F.when(xml.contains("Rating"), xml)))


def xmp_new_sidecar(rating: Column) -> Column:
    head = (
        f'<?xpacket begin="﻿" id="W5M0MpCehiHzreSzNTczkc9d"?>\n<x:xmpmeta xmlns:x="adobe:ns:meta/" x:xmptk="shutterlake">\n'
        f' <rdf:RDF xmlns:rdf="{RDF}">\n  <rdf:Description rdf:about=""\n    xmlns:xmp="{XMP}"\n   xmp:Rating="'
    )
    return F.concat(F.lit(head), rating.cast("string"), F.lit('"/>\n </rdf:RDF>\n</x:xmpmeta>\n<?xpacket end="w"?>'))


def xmp_update_rating(xml: Column, rating: Column) -> Column:
    """STRUCT(xml, error): a new document where there is none, else the updated one."""
    fresh = F.struct(xmp_new_sidecar(rating).alias("xml"), F.lit(None).cast("string").alias("error"))
    return F.when(xml.isNull(), fresh).otherwise(_update(F.coalesce(xml, F.lit("")), rating))
