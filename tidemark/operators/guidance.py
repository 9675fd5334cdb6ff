"""Sentences in which a company gives guidance: a range or a tolerance, and something that makes it forward-looking.

That is either a phrase of the sentence itself or the heading above it: a heading opens its section for all paragraphs down to the next heading, and a heading
of another kind closes it. Disclaimers are left out whole. Places are those of the document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from tidemark.operators.text import placed_paragraphs

_NUMBER = r"\d[\d,]*(?:\.\d+)?"
_SCALE = r"(?:\s*(?:billion|million|thousand|bn|mm))?"
_DASH = r"\s*(?:to|through|–|—|-)\s*"
# Anchors of headings, of sentences and of ranges, in order of preference.
SECTIONS = {"outlook": r"(?i)\boutlook\b", "guidance_heading": r"(?i)\bguidance\b", "looking_ahead": r"(?i)\blooking\s+(?:ahead|forward)\b", "expectations_heading": r"(?i)\bexpectations\b"}
SENTENCES = {
    "we_expect": r"(?i)\bwe\s+(?:now\s+|currently\s+|continue\s+to\s+)?(?:expect|anticipate|project|forecast|estimate)\w*\b",
    "company_expects": r"(?i)\bthe\s+company\s+(?:now\s+|currently\s+|continues?\s+to\s+)?(?:expects?|anticipates?|projects?|forecasts?|estimates?)\b",
    "expected_to_be": r"(?i)\b(?:is|are)\s+expected\s+to\s+be\b",
    "reaffirm_guidance": r"(?i)\b(?:reaffirms?|reiterates?|raises?|lowers?|maintains?|updates?)\b[^.]*\bguidance\b",
    "for_period": r"(?i)\bfor\s+(?:the\s+)?(?:full[-\s]year|fiscal(?:\s+\d{4})?|(?:the\s+)?(?:first|second|third|fourth)\s+quarter)\b",
}
RANGES = {
    "dollar_range": rf"(?i)\$\s?{_NUMBER}{_SCALE}{_DASH}\$?\s?{_NUMBER}{_SCALE}",
    "percent_range": rf"(?i)\d+(?:\.\d+)?%{_DASH}\d+(?:\.\d+)?%",
    "between_and": rf"(?i)\bbetween\b\s+\$?{_NUMBER}{_SCALE}\s+and\s+\$?\d",
    "range_of": r"(?i)\bin\s+the\s+range\s+of\b",
    "tolerance": rf"(?i)\$?\s?{_NUMBER}\s*(?:billion|million|thousand|bn|mm)?%?\s*,?\s*plus\s+or\s+minus\s+\d+(?:\.\d+)?\s*(?:%|percentage\s+points?|percent|basis\s+points?|bps|bp)(?![A-Za-z])",
}
DISCLAIMED = (r"(?i)forward[-\s]looking\s+statements?", r"(?i)private\s+securities\s+litigation\s+reform\s+act|safe\s+harbou?r|risks?\s+and\s+uncertaint|undue\s+reliance|except\s+as\s+required\s+by\s+law|undertakes?\s+no\s+obligation")
ANCHORS = (*SECTIONS, *SENTENCES, *RANGES)


def _found(text: Column, patterns: dict[str, str]) -> Column:
    return F.array_compact(F.array(*[F.when(text.rlike(p), F.lit(n)) for n, p in patterns.items()]))


def scoped(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, pos, paragraph, start, section): paragraphs without headings, disclaimers and blanks, with the section that is open.

    A heading is a line of up to eight words without an end mark.
    """
    parts = placed_paragraphs(docs, key, text, r"\n[ \t]*\n")
    bare = F.regexp_replace("paragraph", r"^\s+|\s+$", "")
    parts = parts.withColumn("bare", bare).where("bare <> ''")
    heading = ~F.col("bare").contains("\n") & ~F.col("bare").rlike(r"[.!?]$") & (F.size(F.split("bare", r"\s+")) <= 8)
    opened = F.when(heading, F.struct(F.get(_found(F.col("paragraph"), SECTIONS), 0).alias("name")))
    rows = parts.withColumns({"heading": heading, "open": F.last(opened, ignorenulls=True).over(W.Window.partitionBy(key).orderBy("pos"))})
    disclaimed = F.col("paragraph").rlike(DISCLAIMED[0]) & F.col("paragraph").rlike(DISCLAIMED[1])
    return rows.where(~F.col("heading") & ~disclaimed).select(key, "pos", "paragraph", "start", F.col("open.name").alias("section"))


def guidance(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, start, end, sentence, anchor, section, hits) of every sentence that gives guidance.

    anchor is the first of its own phrases, else its section; hits are all anchors that it matches. Documents without any have no rows, as null ones.
    """
    rows = scoped(docs, key, text)
    cut = placed_paragraphs(rows.select(F.struct(key, "section", "start").alias("k"), "paragraph"), "k", "paragraph", r"(?<=[.!?])\s+(?=[A-Z(])")
    lead = F.length("paragraph") - F.length(F.regexp_replace("paragraph", r"^\s+", ""))
    sentence = F.regexp_replace("paragraph", r"^\s+|\s+$", "")
    cut = cut.select(F.col(f"k.{key}").alias(key), "k.section", (F.col("k.start") + F.col("start") + lead).alias("start"), sentence.alias("sentence")).where("sentence <> ''")
    cut = cut.withColumns({"ranges": _found(F.col("sentence"), RANGES), "own": _found(F.col("sentence"), SENTENCES)})
    cut = cut.where((F.size("ranges") > 0) & ((F.size("own") > 0) | F.col("section").isNotNull()))
    hits = F.array_compact(F.concat("ranges", "own", F.array("section")))
    return cut.select(key, "start", (F.col("start") + F.length("sentence")).alias("end"), "sentence", F.coalesce(F.get("own", 0), "section").alias("anchor"), "section", hits.alias("hits"))


def anchor_counts(docs: DataFrame, found: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, anchor, n): for every document and every anchor the sentences that it matches, 0 where there are none. Documents are counted once by key."""
    counts = found.select(key, F.explode("hits").alias("anchor")).groupBy(key, "anchor").agg(F.count(F.lit(1)).alias("n"))
    every = docs.select(key).distinct().select(key, F.explode(F.array(*map(F.lit, ANCHORS))).alias("anchor"))
    return every.join(counts, [key, "anchor"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
