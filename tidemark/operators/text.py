"""Documents as paragraphs, sections, labelled values, sentences and candidates."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import window as W

from tidemark.functions.scalars import NUMBER, first_match, paragraph_hash
from tidemark.operators.batches import map_parts


def paragraphs(docs: DataFrame, key: str = "doc_id", text: str = "text", separator: str = "\n{2,}") -> DataFrame:
    """(key, pos, paragraph) of the paragraphs that aren't blank."""
    rows = docs.select(key, F.posexplode(F.split(F.coalesce(text, F.lit("")), separator)).alias("pos", "paragraph"))
    return rows.where(F.trim("paragraph") != "")


def placed_paragraphs(docs: DataFrame, key: str = "doc_id", text: str = "text", separator: str = "\n{2,}") -> DataFrame:
    """(key, pos, paragraph, start): paragraphs that aren't blank, with the place of each in its text."""
    cut = re.compile(separator)

    def work(texts: list[str | None]) -> tuple[list[int], dict[str, pa.Array]]:
        found = []
        for row, text in enumerate(t or "" for t in texts):
            ends = [(m.start(), m.end()) for m in cut.finditer(text)]
            bounds = zip([0, *(b for _, b in ends)], [*(a for a, _ in ends), len(text)], strict=True)
            found += [(row, k, text[a:b], a) for k, (a, b) in enumerate(bounds) if text[a:b].strip(" ")]
        rows, *made = zip(*found, strict=True) if found else ((),) * 4
        kinds = {"pos": pa.int32(), "paragraph": pa.string(), "start": pa.int32()}
        return list(rows), {n: pa.array(x, k) for (n, k), x in zip(kinds.items(), made, strict=True)}

    schema = T.StructType([docs.schema[key], *T._parse_datatype_string("pos int, paragraph string, start int").fields])
    return map_parts(docs.select(key, F.col(text).alias("__source")), work, schema)


def reduced(kept: DataFrame, key: str = "doc_id", joiner: str = "\n\n") -> DataFrame:
    """(key, text, spans): the kept paragraphs, joined in their order, with the map from the text to the one that they were cut from."""
    before = F.sum(F.length("paragraph") + len(joiner)).over(W.Window.partitionBy(key).orderBy("pos", "start", "paragraph").rowsBetween(W.Window.unboundedPreceding, 0)) - F.length("paragraph") - len(joiner)
    placed = kept.select(key, "pos", "start", "paragraph", before.cast("int").alias("before"))
    rows = placed.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", "start", "paragraph", "before"))).alias("p"))
    span = lambda x: F.struct(x["before"].alias("text_start"), (x["before"] + F.length(x["paragraph"])).alias("text_end"), x["start"].alias("source_start"), (x["start"] + F.length(x["paragraph"])).alias("source_end"), F.lit(True).alias("literal"))
    return rows.select(key, F.array_join(F.transform("p", lambda x: x["paragraph"]), joiner).alias("text"), F.transform("p", span).alias("spans"))


def boilerplate(parts: DataFrame, group: str, share: float = 0.8, key: str = "doc_id") -> DataFrame:
    """(group, h, docs, total): hashes of paragraphs that at least this share of a group's documents have; a single document has none."""
    total = parts.groupBy(group).agg(F.countDistinct(key).alias("total"))
    counts = parts.select(group, key, paragraph_hash(F.col("paragraph")).alias("h")).groupBy(group, "h").agg(F.countDistinct(key).alias("docs"))
    return counts.join(total, group).where((F.col("total") > 1) & (F.col("docs") >= F.ceil(F.col("total") * share)))


def without_boilerplate(parts: DataFrame, common: DataFrame, group: str, key: str = "doc_id", joiner: str = "\n\n") -> DataFrame:
    """(key, text, reduction): documents without boilerplate and the per cent of letters that went."""
    marked = parts.withColumn("h", paragraph_hash(F.col("paragraph"))).join(common.select(group, "h", F.lit(True).alias("gone")), [group, "h"], "left")
    kept = F.transform(F.array_sort(F.collect_list(F.when(F.col("gone").isNull(), F.struct("pos", "paragraph")))), lambda x: x["paragraph"])
    out = marked.groupBy(key).agg(F.array_join(kept, joiner).alias("text"), F.sum(F.length("paragraph")).alias("n"), F.sum(F.when(F.col("gone"), F.length("paragraph")).otherwise(0)).alias("less"))
    return out.select(key, "text", F.round(100 * F.col("less") / F.col("n"), 2).alias("reduction"))


def sections(parts: DataFrame, headings: Mapping[str, str], key: str = "doc_id") -> DataFrame:
    """parts with the section each lies in: the last heading at or before it, `cover` before any."""
    own = first_match(F.col("paragraph"), headings)
    return parts.withColumn("section", F.coalesce(F.last(own, ignorenulls=True).over(W.Window.partitionBy(key).orderBy("pos")), F.lit("cover")))


def joined(parts: DataFrame, chosen: Sequence[str], key: str = "doc_id", joiner: str = "\n") -> DataFrame:
    """(key, text) of the chosen sections in the order of the document."""
    own = parts.where(F.col("section").isin(*chosen))
    return own.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "paragraph"))), lambda x: x["paragraph"]), joiner).alias("text"))


def labelled(text: Column, most: int = 700) -> Column:
    """(label, value) pairs of `Label:: value`, or `Label: value` too where single colons outnumber double ones.

    A label stands at the beginning of a line; its value goes on to the next label, over line ends, for `most` letters at most.
    """
    runs = lambda colons: F.regexp_extract_all(text, F.lit(rf"(?ms)(^[A-Z][^:\n]{{0,60}}{colons}(?:.(?!^[A-Z][^:\n]{{0,60}}{colons}))*.?)"), F.lit(1))
    double, either = runs("::"), runs("::?")
    found = F.when(F.size(either) - F.size(double) > F.size(double), either).otherwise(double)
    value = lambda x: F.substring(F.regexp_replace(x, r"(?s)^[^:]*::?", ""), 1, most)
    return F.transform(found, lambda x: F.struct(F.trim(F.substring_index(x, ":", 1)).alias("label"), F.regexp_replace(value(x), r"^\s+|\s+$", "").alias("value")))


def sentences(text: Column) -> Column:
    return F.filter(F.split(text, r"(?<=[.!?])\s+(?=[A-ZÀ-Þ])"), lambda x: F.trim(x) != "")


def forward_looking(docs: DataFrame, cue: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, pos, sentence) of sentences that match the cue and have a number."""
    rows = docs.select(key, F.posexplode(sentences(F.coalesce(text, F.lit("")))).alias("pos", "sentence"))
    return rows.where(F.col("sentence").rlike(cue) & F.col("sentence").rlike(r"\d"))


CANDIDATE = re.compile(r"(?P<date>\b\d{4}-\d{2}-\d{2}\b|\b\d{1,2}/\d{1,2}/\d{4}\b)|(?P<number>" + NUMBER + r"%?)")
#: Letters before a value in which its label is sought, over the end of a line too.
LABEL_WINDOW = 220
LABEL = re.compile(r"([A-Za-z][A-Za-z ]{0,40}?)\s*[:=]\s*$")


def _candidates(text: str | None) -> list[dict]:
    out = []
    for m in CANDIDATE.finditer(text or ""):
        near = LABEL.search(text[max(0, m.start() - LABEL_WINDOW) : m.start()])
        out.append({"kind": m.lastgroup, "value": m[0], "label": near[1].strip() if near else None, "start": m.start(), "end": m.end()})
    return out


def candidates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row per number or date of a text with its place and the label that stands right before it."""

    @F.pandas_udf("array<struct<kind:string,value:string,label:string,start:int,end:int>>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(_candidates)

    return docs.select(key, F.explode(run(text)).alias("c")).select(key, "c.*")


def ranked_candidates(found: DataFrame, anchor: str, most: int = 8, key: str = "doc_id") -> DataFrame:
    """The best `most` candidates of each document: labelled by the anchor first, then any label, then place; in order of place."""
    hit = F.coalesce(F.lower("label").contains(anchor.lower()), F.lit(False))
    w = W.Window.partitionBy(key).orderBy(F.desc(hit.cast("int")), F.desc(F.col("label").isNotNull().cast("int")), "start")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)


def located(text: Column, members: Column) -> Column:
    """Stretch of each member's first place in the text, without case; null where it isn't."""
    at = lambda m: F.instr(F.lower(text), F.lower(m))
    return F.transform(members, lambda m: F.when(at(m) > 0, F.struct((at(m) - 1).alias("start"), (at(m) - 1 + F.length(m)).alias("end"))))


def matches(text: Column, pattern: str) -> Column:
    """The first match of a pattern's group with its place; null if there is none."""
    value = F.regexp_extract(text, pattern, 1)
    start = F.regexp_instr(text, F.lit(pattern)) + F.instr(F.regexp_extract(text, pattern, 0), value) - 2
    return F.when(text.rlike(pattern), F.struct(value.alias("value"), start.alias("start"), (start + F.length(value)).alias("end")))
