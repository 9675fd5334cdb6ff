"""HTML to text with a map of offsets, and tables as label and value pairs.

One pass over the markup makes events (text, entity, break); tables at the top level are cut out and read as grids. Every piece of text
knows where it came from, so a stretch of the text can be found in the source and the other way round.
"""

from __future__ import annotations

import html as entities
import re
from bisect import bisect_right
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.batches import map_parts

#: Fixed sets of HTML elements: whose text is no text, which end a paragraph, which stand for a blank.
SKIPPED = frozenset("script style head title".split())
BLOCKS = frozenset("p div tr table li ul ol h1 h2 h3 h4 h5 h6".split())
BLANKS = frozenset("td th br".split())
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<![^>]*>|<\?[^>]*>|<(/?)([A-Za-z][A-Za-z0-9:_-]*)((?:\"[^\"]*\"|'[^']*'|[^<>\"'])*)>|&(?:#\d+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*);|[^<&]+|[<&]", re.S)
RUNS = re.compile(r"[ \t\xa0\r\f\v\n]|[^ \t\xa0\r\f\v\n]+")
SPAN = re.compile(r"\b(colspan|rowspan)\s*=\s*[\"']?(\d+)", re.I)
SPANS = "array<struct<text_start:int,text_end:int,source_start:int,source_end:int,literal:boolean>>"
ARROW_SPANS = pa.list_(pa.struct([*[(n, pa.int32()) for n in ("text_start", "text_end", "source_start", "source_end")], ("literal", pa.bool_())]))
ARROW_PAIRS = pa.list_(pa.struct([("label", pa.string()), ("value", pa.string())]))
SCHEMA = f"text string, spans {SPANS}, pairs array<struct<label:string,value:string>>"


#: Maps that are composed at once in a Python worker.
ROWS = 64


class Piece(NamedTuple):
    text: str
    start: int
    end: int
    literal: bool


def tables(source: str) -> list[tuple[int, int]]:
    """Stretches of the tables that aren't inside another one; an unclosed one runs to the end."""
    out, depth, start = [], 0, 0
    for m in re.finditer(r"<(/?)table\b[^>]*>", source, re.I):
        if not m[1]:
            start = start if depth else m.start()
            depth += 1
        elif depth:
            depth -= 1
            if not depth:
                out.append((start, m.end()))
    return [*out, (start, len(source))] if depth else out


def pieces(source: str, start: int, end: int, depth: list[int] | None = None) -> Iterator[Piece]:
    """Text of a stretch; breaks are pieces of one sign: a blank or two line ends.

    depth, a list of one number, tells how many elements without text are open before the stretch, and then after it.
    """
    depth = [0] if depth is None else depth
    for m in TOKEN.finditer(source, start, end):
        whole = m[0]
        name = (m[2] or "").lower()
        if name:
            closes, single = bool(m[1]), whole.endswith("/>")
            if name in SKIPPED:
                depth[0] = max(0, depth[0] + (-1 if closes else 0 if single else 1))
            elif name in BLANKS:
                yield Piece(" ", m.start(), m.end(), False)
            elif name in BLOCKS and (closes or single):
                yield Piece("\n\n", m.start(), m.end(), False)
        elif whole[0] == "<" and len(whole) > 1 or depth[0]:
            continue
        elif whole[0] == "&" and len(whole) > 1:
            yield Piece(entities.unescape(whole), m.start(), m.end(), False)
        else:
            yield Piece(whole, m.start(), m.end(), True)


def laid(found: Iterator[Piece]) -> tuple[str, list[Piece]]:
    """The text with runs of blanks as one and runs of line ends as at most two, and its pieces in order."""
    letters: list[tuple[str, int, int, bool]] = []  # blanks one by one, other letters by run
    for p in found:
        for m in RUNS.finditer(p.text):
            c = " " if m[0] in "\t\xa0\r\f\v" else m[0]
            at = (p.start + m.start(), p.start + m.end()) if p.literal else (p.start, p.end)
            if c in " \n" and letters and letters[-1][0] in " \n":
                run = len(letters)
                while run and letters[run - 1][0] in " \n":
                    run -= 1
                ends = sum(x[0] == "\n" for x in letters[run:])
                if c == " " or ends >= 2:
                    continue
            letters.append((c, *at, p.literal))
    first = 0
    while first < len(letters) and letters[first][0] in " \n":
        first += 1
    while len(letters) > first and letters[-1][0] in " \n":
        letters.pop()
    letters = letters[first:]
    out: list[Piece] = []
    for c, a, b, literal in letters:
        if out and literal and out[-1].literal and out[-1].end == a:
            out[-1] = Piece(out[-1].text + c, out[-1].start, b, True)
        else:
            out.append(Piece(c, a, b, literal))
    return "".join(x[0] for x in letters), out


def plain(source: str, start: int, end: int) -> str:
    return re.sub(r"\s+", " ", laid(pieces(source, start, end))[0]).strip()


def grid(source: str, start: int, end: int) -> list[list[tuple[int, int, str]]]:
    """Rows of (start, end, text) cells of a table; cells that span rows come again below, nested tables are read inside."""
    rows: list[list[tuple[int, int, str]]] = []
    held: dict[int, tuple[int, tuple[int, int, str]]] = {}
    inner = [(a, b) for a, b in ((x + start + 1, y + start + 1) for x, y in tables(source[start + 1 : end]))]
    inside = lambda at: any(a <= at < b for a, b in inner)
    cell = None
    for m in [*re.finditer(r"<(/?)(tr|td|th)\b([^>]*)>", source[start:end], re.I), None]:
        at = end if m is None else m.start() + start
        if m is not None and inside(at):
            continue
        if cell is not None:
            a, down, wide = cell
            nested = [(x, y) for x, y in inner if a <= x < at]
            text = plain(source, a, at) if not nested else " ".join(filter(None, [plain(source, a, nested[0][0]), *["; ".join(f"{l}: {v}" if l else v for l, v in pairs(source, x, y)) for x, y in nested], plain(source, nested[-1][1], at)]))
            own = (a, at, text)
            column = len(rows[-1]) if rows else 0
            for k in range(wide):
                rows[-1].append(own)
                if down > 1:
                    held[column + k] = (down - 1, own)
            cell = None
        if m is None:
            break
        if m[2].lower() == "tr" and not m[1]:
            rows.append([])
        elif m[2].lower() != "tr" and not m[1]:
            if not rows:
                rows.append([])
            while len(rows[-1]) in held and held[len(rows[-1])][0] > 0:
                left, own = held[len(rows[-1])]
                held[len(rows[-1])] = (left - 1, own)
                rows[-1].append(own)
            size = {k.lower(): max(1, min(100, int(v))) for k, v in SPAN.findall(m[3])}
            cell = (m.end() + start, size.get("rowspan", 1), size.get("colspan", 1))
    return rows


def pairs(source: str, start: int, end: int) -> list[tuple[str, str]]:
    """(label, value) of each row: its first cell and the others; cells at one place count once, one cell alone is a value."""
    out = []
    for row in grid(source, start, end):
        texts = [t for _, _, t in dict.fromkeys(row) if t]
        if len(texts) == 1:
            out.append(("", texts[0]))
        elif texts:
            out.append((texts[0], " ".join(texts[1:])))
    return out


def read(source: str | None) -> tuple[str, list[tuple[int, int, int, int, bool]], list[tuple[str, str]]]:
    """(text, spans, pairs) of a page; a null page is an empty one."""
    source = source or ""
    found: list[Piece] = []
    rows: list[tuple[str, str]] = []
    at = 0
    depth = [0]  # text inside an element that is skipped must not come back after a table
    for a, b in tables(source):
        found += pieces(source, at, a, depth)
        at = b
        if depth[0]:
            found += pieces(source, a, b, depth)
            continue
        own = pairs(source, a, b)
        rows += own
        found.append(Piece("\n".join(f"{l}: {v}" if l else v for l, v in own) + "\n\n", a, b, False))
    text, kept = laid(iter([*found, *pieces(source, at, len(source), depth)]))
    spans, place = [], 0
    for p in kept:
        spans.append((place, place + len(p.text), p.start, p.end, p.literal))
        place += len(p.text)
    return text, spans, rows


def normalised(pages: DataFrame, column: str = "html") -> DataFrame:
    """pages with text, spans and pairs of the column; null pages get an empty text.

    A page is read once, whatever is made of its columns; a Python worker holds a few hundred kilobytes of pages at once, or one page.
    """

    def work(sources: list[str | None]) -> tuple[list[int], dict[str, pa.Array]]:
        text, spans, rows = zip(*map(read, sources), strict=True)
        return list(range(len(sources))), {"text": pa.array(text, pa.string()), "spans": pa.array(spans, ARROW_SPANS), "pairs": pa.array(rows, ARROW_PAIRS)}

    schema = T.StructType([*pages.schema.fields, *T._parse_datatype_string(SCHEMA).fields])
    return map_parts(pages.withColumn("__source", F.col(column)), work, schema)


def resolved(spans: Column, start: Column, end: Column) -> Column:
    """The source stretch of a text stretch: ends are mapped one by one; inside a piece that isn't literal all of it counts."""
    at = lambda x: F.get(F.filter(spans, lambda s: (s["text_start"] <= x) & (x < s["text_end"])), 0)
    def ends(z: Column) -> Column:
        first, last = z["first"], z["last"]
        a = F.when(first["literal"], first["source_start"] + start - first["text_start"]).otherwise(first["source_start"])
        b = F.when(last["literal"], last["source_start"] + end - last["text_start"]).otherwise(last["source_end"])
        return F.struct(a.alias("a"), b.alias("b"))

    # A step of an array of one each, so that what a later step names twice is sought once.
    places = F.array(F.struct(at(start).alias("first"), at(end - 1).alias("last")))
    return F.get(F.transform(F.transform(places, ends), lambda z: F.struct(F.least(z["a"], z["b"]).alias("start"), F.greatest(z["a"], z["b"]).alias("end"))), 0)


def _merged(own: list[dict], below: list[dict]) -> list[dict]:
    """Spans of the upper text in the source of the lower one: literal ones cut at the lower map's bounds, others as the stretch that they cover."""
    starts = [b["text_start"] for b in below]
    out = []
    for s in own:
        a, z = s["source_start"], s["source_end"]
        k = max(0, bisect_right(starts, a) - 1)
        over = []
        while k < len(below) and below[k]["text_start"] < z:
            if below[k]["text_end"] > a:
                over.append(below[k])
            k += 1
        if not over:
            continue
        if not s["literal"]:
            ends = [(b["source_start"] + max(a, b["text_start"]) - b["text_start"], b["source_start"] + min(z, b["text_end"]) - b["text_start"]) if b["literal"] else (b["source_start"], b["source_end"]) for b in (over[0], over[-1])]
            out.append({**s, "source_start": min(ends[0][0], ends[1][0]), "source_end": max(ends[0][1], ends[1][1])})
            continue
        for b in over:
            lo, hi = max(a, b["text_start"]), min(z, b["text_end"])
            source = (b["source_start"] + lo - b["text_start"], b["source_start"] + hi - b["text_start"]) if b["literal"] else (b["source_start"], b["source_end"])
            out.append({"text_start": s["text_start"] + lo - a, "text_end": s["text_start"] + hi - a, "source_start": source[0], "source_end": source[1], "literal": b["literal"]})
    return out


def composed(spans: Column, below: Column) -> Column:
    """The map from the text of `spans` straight to the source of `below`, whose text the sources of `spans` are. Two sorted lists are merged once.

    Stretches that `below` has no span for are left out, as they stand for nothing in the source.
    """

    @F.pandas_udf(SPANS)
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for upper, lower in batches:
            for k in range(0, len(upper), ROWS):
                pairs = zip(upper.iloc[k : k + ROWS], lower.iloc[k : k + ROWS], strict=True)
                yield pd.Series([None if u is None or b is None else _merged(list(u), list(b)) for u, b in pairs], dtype=object)

    return run(spans, below)
