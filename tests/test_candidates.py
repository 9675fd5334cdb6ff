"""Candidates and cues of fields, offset maps through several texts, glued names."""

import random

from pyspark.sql import functions as F

from tidemark.functions.scalars import clean_names
from tidemark.operators import candidates as c
from tidemark.operators import html, text

FOUR = "Strike Date: August 27, 2026\nPricing Date: August 28, 2026\nIssue Date: September 2, 2026\nMaturity Date: August 31, 2028"


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_numbers_as_printed(spark):
    given = "Participation Rate: 70\nCoupon Barrier: 70.00%\nDenomination: 1,000\nEstimated Value: $979.00 per note, Note123"
    rows = c.candidates(docs(spark, given), [c.Field("rate", "number"), c.Field("issuer", "string")]).orderBy("start").collect()
    assert [(r.raw, r.number, r.label) for r in rows] == [("70", 70.0, "Participation Rate"), ("70.00%", 70.0, "Coupon Barrier"), ("1,000", 1000.0, "Denomination"), ("$979.00", 979.0, "Estimated Value")]
    assert all(given[r.start : r.end] == r.raw and r.field == "rate" and r.day is None for r in rows)


def test_dates_and_their_own_labels(spark):
    field = c.Field("maturity", "date", ("Maturity Date:",))
    rows = c.candidates(docs(spark, FOUR, "Maturity Date: August 31, 2028 (or 8/31/2028, 2028-08-31, 31st August 2028)", "Observation Date: September 31, 2028", None, ""), [field]).collect()
    four = sorted((r for r in rows if r.doc_id == 0), key=lambda r: r.rank)
    assert [r.label for r in four] == ["Maturity Date", "Strike Date", "Pricing Date", "Issue Date"] and four[0].day == "2028-08-31"
    assert [r.day for r in rows if r.doc_id == 1] == ["2028-08-31"] * 4 and {r.doc_id for r in rows} == {0, 1}
    assert all(FOUR[r.start : r.end] == r.raw for r in four)


def test_rank_looks_at_anchors_before_a_value_only(spark):
    given = "Other: 5\n\nThe estimated value is 950 and more words here 1240.0 which is not the estimated value"
    rows = c.candidates(docs(spark, given), [c.Field("value", "number", ("estimated value",))]).orderBy("rank").collect()
    assert [r.raw for r in rows] == ["950", "1240.0", "5"]
    assert [r.raw for r in c.candidates(docs(spark, given), [c.Field("value", "number", ("estimated value",))], most=1).collect()] == ["950"]


def test_what_all_filings_have_is_left_out(spark):
    frame = docs(spark, "Rate: 7\n\nalways 100 here", "Rate: 8\n\nalways 100 here", "Rate: 9\n\nalways 100 here").withColumn("form", F.lit("f"))
    parts = text.paragraphs(frame).join(frame.select("doc_id", "form"), "doc_id")
    rows = c.candidates(frame, [c.Field("rate", "number")], common=text.boilerplate(parts, "form"), group="form").collect()
    assert sorted(r.raw for r in rows) == ["7", "8", "9"]


def test_cues_and_guesses(spark):
    given = "Interest Barrier: 70.00% of it.\nPaid 9.5% PER ANNUM, interest barrier again. " + "per annum " * 50
    fields = [c.Field("barrier", "number", ("Interest Barrier",)), c.Field("coupon", "number", ("Interest Barrier", "Coupon Rate:"))]
    rows = c.cues(docs(spark, given, None), fields, {"per annum": "rate"}).orderBy("start", "field").collect()
    anchors = [r for r in rows if r.kind == "anchor"]
    assert [(r.start, r.field, r.cue, r.guess) for r in anchors[:2]] == [(0, "barrier", "Interest Barrier", "70.00%"), (0, "coupon", "Interest Barrier", "70.00%")]
    assert len(anchors) == 4 and len([r for r in rows if r.kind == "unit"]) == c.MOST and {r.unit for r in rows if r.kind == "unit"} == {"rate"}
    assert all(given[r.start : r.end] == r.cue and (r.guess is None or given[r.guess_start : r.guess_end] == r.guess) for r in rows) and "\n" not in anchors[0].snippet


def test_label_near_a_value(spark):
    given = [
        ("... paid on the Maturity Date:: April 9, 2026 CUSIP:: 48136CYQ6", "April 9, 2026", ()), ("70.00% of the price, which we call the Interest Barrier", "70.00%", ("Interest Barrier:",)),
        ("the Coupon Rate: and Interest Barrier are 65%", "65%", ("Coupon Rate", "Interest Barrier")), ("nothing at all 12 more", "12", ("Rate",)),
    ]
    got = []
    for t, value, anchors in given:
        at = t.index(value)
        got.append(spark.createDataFrame([(t,)], "t string").select(c.label_near(F.col("t"), F.lit(at), F.lit(at + len(value)), anchors).alias("l")).first().l)
    assert got == ["Maturity Date", "Interest Barrier", "Interest Barrier", None]


def test_composed_maps_are_brute_force_letter_by_letter(spark):
    rng = random.Random(2)
    words = ["tide", "&amp;", "mark &lt;b&gt;", "<b>bold</b>", "a<br>b", "é", "x &#233; y"]
    pages = [(k, "<html><body>" + "".join(f"<p>{' '.join(rng.choices(words, k=4))} {n}</p>" if n % 4 else f"<table><tr><td>L{n}</td><td>v &amp; {n}</td></tr></table>" for n in range(12)) + "</body></html>") for k in range(6)]
    read = html.normalised(spark.createDataFrame(pages, "doc_id long, html string"))
    parts = text.placed_paragraphs(read, separator="\n+")
    assert all(r.text[r.start : r.start + len(r.paragraph)] == r.paragraph for r in parts.join(read, "doc_id").collect())
    once = text.reduced(parts.where("pos % 3 <> 1"), joiner="\n")
    twice = text.reduced(text.placed_paragraphs(once, separator="\n+").where("pos % 2 = 0"), joiner=" | ")
    both = twice.withColumnRenamed("spans", "s2").withColumnRenamed("text", "t2").join(once.withColumnRenamed("spans", "s1").withColumnRenamed("text", "t1"), "doc_id").join(read, "doc_id")
    rows = both.withColumn("down", html.composed(html.composed(F.col("s2"), F.col("s1")), F.col("spans"))).collect()
    assert len(rows) == 6

    def at(spans, x):
        for s in spans:
            if s.text_start <= x < s.text_end:
                return s
        return None

    checked = 0
    for r in rows:
        assert all(a.text_end <= b.text_start for a, b in zip(r.down, r.down[1:], strict=False))
        for x in range(len(r.t2)):
            s2, got = at(r.s2, x), at(r.down, x)
            if s2 is None:
                assert got is None  # between paragraphs
                continue
            y = s2.source_start + x - s2.text_start
            s1 = at(r.s1, y)
            z = s1.source_start + y - s1.text_start
            s0 = at(r.spans, z)
            assert r.t2[x] == r.t1[y] == r.text[z]
            want = (s0.source_start + z - s0.text_start, True) if s0.literal else (s0.source_start, False)
            assert (got.source_start + (x - got.text_start if got.literal else 0), got.literal) == want
            checked += 1
    assert checked > 200


def test_glued_names(spark):
    names = ["EURO \n\nSTOXX 50‬", "Nasdaq-100 Index® Russell 2000® Index", "One Fund Two", "A ETF B Trust", None, " ", "Pike Corporation"]
    got = spark.createDataFrame([(names,), ([],)], "n array<string>").select(clean_names(F.col("n")).alias("n")).collect()
    assert got[0].n == ["EURO STOXX 50", "Nasdaq-100 Index®", "Russell 2000® Index", "One Fund Two", "A ETF", "B Trust", "Pike Corporation"] and got[1].n == []


def test_types_of_an_index_page(spark):
    from tidemark.sources.filings import index_types

    pages = [
        ('<table><tr><th>Document</th><th>Type</th></tr><tr><td>1</td><td><a href="/ix?doc=/Archives/f/1/a-1.htm">a-1.htm</a> iXBRL</td><td scope="row">8-K</td></tr><tr><td>2</td><td><a\nhref=\'/x/ex991.htm\'>e</a></td><td>\n EX-99.1 </td></tr></table>', {"a-1.htm": "8-K", "ex991.htm": "EX-99.1"}),
        ('<TR><TD><A HREF="b.htm">b</A></TD></TR><tr><td><a href="b.htm">b</a></td><td>EX-99.2</td></tr><tr><td>whole</td><td>none</td></tr>', {"b.htm": "EX-99.2"}), ("no table", {}), (None, {}),
    ]
    got = spark.createDataFrame([(k, p) for k, (p, _) in enumerate(pages)], "k int, p string").select("k", index_types(F.col("p")).alias("m")).orderBy("k").collect()
    assert [r.m for r in got] == [want for _, want in pages]
