"""Candidates for the fields of a form: every number or date of a text, ranked by the field's own wording, and cues that tell where to look.

All anchors of all fields and all unit phrases are found in one pass of an automaton. A candidate's rank in a field comes from its label, from the
distance to the field's nearest anchor before it, and from its place; what every filing of a group has alike can be left out.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from tidemark.functions.scalars import iso_date, paragraph_hash

# The shapes of numbers, dates and labels.
NUMBER = re.compile(r"(?<![\w,.])\$?\d+(?:,\d{3})*(?:\.\d+)?%?")
DATE = re.compile(r"\b[A-Za-z]{3,9}\.?\s+\d{1,2}(?:st|nd|rd|th)?\s*,?\s*\d{4}\b|\b\d{1,2}(?:st|nd|rd|th)?\s+[A-Za-z]{3,9}\.?\s*,?\s*\d{4}\b|\b\d{4}-\d{1,2}-\d{1,2}\b|\b\d{1,2}/\d{1,2}/\d{4}\b")
LABEL = re.compile(r"([^\n:]+):")
#: Letters after a cue in which a number is sought, around it in its snippet, and around a value in which a label is.
AFTER, BEFORE, WINDOW = 90, 70, 220
#: Hits of one cue in one document.
MOST = 40
FOUND = "values array<struct<kind:string,raw:string,start:int,end:int,label:string,paragraph:string>>, hits array<struct<cue:string,start:int,end:int,hit:string,snippet:string,tail:string>>"


@dataclass(frozen=True)
class Field:
    name: str
    kind: str  # number or date; others have no candidates
    anchors: tuple[str, ...] = ()


def key_of(anchor: str) -> str:
    return anchor.strip().lower().rstrip(": ")


def found(docs: DataFrame, cues: Sequence[str], text: str = "text") -> DataFrame:
    """docs with values (numbers and dates with their labels and paragraphs) and hits (places of the cues, in any case)."""
    wanted = sorted({c.lower() for c in cues if c})

    @F.pandas_udf(FOUND)
    def run(texts: pd.Series) -> pd.DataFrame:
        import ahocorasick

        machine = ahocorasick.Automaton()
        for c in wanted:
            machine.add_word(c, c)
        if wanted:
            machine.make_automaton()

        def values(text: str) -> list[dict]:
            labels = [(m.end(), text.count("\n", 0, m.start()), m[1].strip()) for m in LABEL.finditer(text) if m[1].strip()]
            ends = [x[0] for x in labels]
            out, line, at = [], 0, 0
            cuts = [0, *(m.end() for m in re.finditer("\n\n", text))]
            runs = sorted([(m.start(), "number", m) for m in NUMBER.finditer(text)] + [(m.start(), "date", m) for m in DATE.finditer(text)], key=lambda x: x[0])
            for start, kind, m in runs:
                line, at = line + text.count("\n", at, start), start
                k = bisect_right(ends, start) - 1
                label = labels[k][2] if k >= 0 and line - labels[k][1] in (0, 1) else None
                p = bisect_right(cuts, start) - 1
                paragraph = text[cuts[p] : cuts[p + 1] - 2] if p + 1 < len(cuts) else text[cuts[p] :]
                out.append({"kind": kind, "raw": m[0], "start": start, "end": m.end(), "label": label, "paragraph": paragraph})
            return out

        def hits(text: str) -> list[dict]:
            low, last, out = text.lower(), {}, []
            if not wanted or len(low) != len(text):  # a letter whose lower case has another length would move places
                low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
            for end, c in machine.iter(low) if wanted else ():
                start = end + 1 - len(c)
                if start >= last.get(c, 0):
                    last[c] = end + 1
                    snippet = text[max(0, start - BEFORE) : end + 1 + AFTER].replace("\n", " ")
                    out.append({"cue": c, "start": start, "end": end + 1, "hit": text[start : end + 1], "snippet": snippet, "tail": text[end + 1 : end + 1 + AFTER]})
            return sorted(out, key=lambda h: (h["start"], h["end"]))

        return pd.DataFrame([(values(t or ""), hits(t or "")) for t in texts], columns=["values", "hits"])

    return docs.withColumn("__f", run(F.col(text))).select(*docs.columns, "__f.*")


def candidates(docs: DataFrame, fields: Sequence[Field], common: DataFrame | None = None, group: str | None = None, most: int | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, field, raw, number or day, label, start, end, rank: the values that a field may have in a document.

    Rank: a label that is an anchor of the field, then an anchor before the value at any distance, then the shortest distance to the last
    anchor before it, then place. A run shaped like a date that is none is left out. common (group, h): paragraphs that aren't
    looked at, as text.boilerplate gives them. most: the best so many of a field. A null text has none.
    """
    wanted = [f for f in fields if f.kind in ("number", "date")]
    table = F.array(*[F.struct(F.lit(f.name).alias("field"), F.lit(f.kind).alias("kind"), F.array(*map(F.lit, sorted({key_of(a) for a in f.anchors if len(key_of(a)) >= 3}))).cast("array<string>").alias("anchors")) for f in wanted])
    cues = [key_of(a) for f in wanted for a in f.anchors if len(key_of(a)) >= 3]
    kept = [key, *([group] if group else [])]
    rows = found(docs.select(*kept, F.col(text).alias("__text")), cues, "__text").select(*kept, F.explode("values").alias("v"), "hits")
    if common is not None:
        gone = common.select(group, "h").distinct()
        rows = rows.withColumn("h", paragraph_hash(F.col("v.paragraph"))).join(gone, [group, "h"], "left_anti")
    rows = rows.select(key, "v", "hits", F.explode(F.filter(table, lambda f: f["kind"] == F.col("v.kind"))).alias("f"))
    last = F.array_max(F.transform(F.filter("hits", lambda h: F.array_contains(F.col("f.anchors"), h["cue"]) & (h["end"] <= F.col("v.start"))), lambda h: h["end"]))
    named = F.coalesce(F.array_contains(F.col("f.anchors"), F.lower(F.rtrim(F.regexp_replace("v.label", r"[:\s]+$", "")))), F.lit(False))
    number = F.when(F.col("v.kind") == "number", F.regexp_replace("v.raw", "[$%,]", "").cast("double"))
    day = F.when(F.col("v.kind") == "date", iso_date(F.regexp_replace("v.raw", r"(\d)(?:st|nd|rd|th)\b", "$1")))
    rows = rows.select(key, "f.field", "v.raw", number.alias("number"), day.alias("day"), "v.label", "v.start", "v.end", named.alias("__named"), (F.col("v.start") - last).alias("__after"))
    rows = rows.where(F.coalesce(F.col("number").cast("string"), F.col("day")).isNotNull())
    order = W.Window.partitionBy(key, "field").orderBy(F.desc("__named"), F.asc_nulls_last("__after"), "start")
    rows = rows.withColumn("rank", F.row_number().over(order)).drop("__named", "__after")
    return rows.where(F.col("rank") <= most) if most else rows


def cues(docs: DataFrame, fields: Sequence[Field], units: Mapping[str, str], most: int = MOST, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, start, end, cue, kind (anchor or unit), field, unit, guess, guess_start, guess_end, snippet: where a document says something near a value.

    A phrase that is an anchor of several fields has a row for each. The first number in the AFTER letters that follow is the guess. A cue has its
    first `most` places in a document.
    """
    table = [(a.lower(), "anchor", f.name, None) for f in fields for a in f.anchors if a] + [(u.lower(), "unit", None, kind) for u, kind in units.items()]
    known = docs.sparkSession.createDataFrame(table, "cue string, kind string, field string, unit string").distinct()
    rows = found(docs.select(key, F.col(text).alias("__text")), [t[0] for t in table], "__text").select(key, F.explode("hits").alias("h")).select(key, "h.*")
    rows = rows.withColumn("__n", F.row_number().over(W.Window.partitionBy(key, "cue").orderBy("start"))).where(F.col("__n") <= most).join(F.broadcast(known), "cue")
    number = r"\$?\d[\d,]*(?:\.\d+)?%?"
    guess = F.regexp_substr("tail", F.lit(number))
    at = F.when(guess.isNotNull(), F.col("end") + F.regexp_instr("tail", F.lit(number)) - 1)
    return rows.select(key, "start", "end", F.col("hit").alias("cue"), "kind", "field", "unit", guess.alias("guess"), at.alias("guess_start"), (at + F.length(guess)).alias("guess_end"), "snippet")


def label_near(text: Column, start: Column, end: Column, anchors: Sequence[str] = ()) -> Column:
    """The label of the value from start to end: the last anchor in the WINDOW before, else a label right before, else the first anchor after, else null."""
    pre = text.substr(F.greatest(start - WINDOW, F.lit(0)) + 1, F.least(start, F.lit(WINDOW)))
    post = F.lower(text.substr(end + 1, F.lit(WINDOW)))
    named = [(a.strip().rstrip(": "), key_of(a)) for a in anchors if key_of(a)]
    back = lambda k: F.instr(F.reverse(F.lower(pre)), F.lit(k[::-1]))
    before = F.array_min(F.array(*[F.when(back(k) > 0, F.struct((back(k) + len(k)).alias("at"), F.lit(i).alias("i"), F.lit(a).alias("a"))) for i, (a, k) in enumerate(named)])) if named else None
    after = F.array_min(F.array(*[F.when(F.instr(post, F.lit(k)) > 0, F.struct(F.instr(post, F.lit(k)).alias("at"), F.lit(i).alias("i"), F.lit(a).alias("a"))) for i, (a, k) in enumerate(named)])) if named else None
    own = F.regexp_extract(pre, r"([A-Z][A-Za-z0-9 ()/$&.,'’–-]{2,40}?)\s*:{1,2}\s*$", 1)
    plain = F.when(own != "", F.regexp_replace(own, r"^[ .,]+|[ .,]+$", ""))
    return F.coalesce(before["a"], plain, after["a"]) if named else plain
