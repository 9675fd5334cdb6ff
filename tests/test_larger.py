"""Whole jobs, and steps whose work grows with their rows."""

import math
import random

import numpy as np
import pyarrow as pa
from pyspark.sql import types as T
from pyspark.sql import functions as F

from tidemark.operators import batches, html
from tidemark.operators import joins as j
from tidemark.operators import text as t
from tidemark.operators import trials
from tidemark.operators import windows as w
from tidemark.plans import catalog
from tidemark.plans import stand_ins as s
from tidemark.sources import filings


def test_unpriced_reads_every_order(spark, tmp_path):
    """A customer whose orders are all open or all shipped has orders."""
    spark.createDataFrame([(k, k % 3) for k in range(1, 10)], "c_custkey long, c_nationkey int").write.parquet(str(tmp_path / "customer.parquet"))
    orders = [(10, 1, "O"), (11, 2, "F"), (12, 3, "P"), (13, 4, "F"), (14, 4, "O")]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderstatus string").write.parquet(str(tmp_path / "orders.parquet"))
    found = catalog.queries()["join13_unpriced"](spark, str(tmp_path))
    assert {r.c_nationkey: r.n for r in found.collect()} == {0: 2, 1: 1, 2: 2}


def test_nearest_in_a_crowd(spark):
    """A crowded square isn't paired: 40,000 by 40,000 rows in one, with copies, far rows and a null; brute force on some."""
    rng = np.random.default_rng(3)
    xy = np.round(np.r_[rng.normal(size=(79_000, 2)) * 0.01, rng.uniform(-9, 9, (1000, 2))], 4)
    rows = spark.createDataFrame([(k, float(a), float(b)) for k, (a, b) in enumerate(xy)] + [(80_001, None, None)], "pos long, a double, b double")
    got = {r.t: (r.c, r.dist) for r in j.nearest(rows.where("pos % 2 = 1"), rows.where("pos % 2 = 0"), ["a", "b"]).collect()}
    z = (xy - xy.mean(axis=0)) / xy.std(axis=0, ddof=1)
    assert 80_001 not in got
    for t in [*range(1, 2000, 40), *range(79_001, 80_000, 10)]:
        dist = np.sqrt(((z[::2] - z[t]) ** 2).sum(axis=1))
        assert (t in got) == (dist.min() <= 0.25)
        assert t not in got or (abs(got[t][1] - dist.min()) < 1e-9 and abs(dist[got[t][0] // 2] - dist.min()) < 1e-9)


def test_groups_in_one_pass_are_groups_by_setting(spark):
    from test_trials import SMALL, bars

    held = spark.createDataFrame(bars(0.02), "ticker string, i int, close double, issued int, barrier double, a double, b double")
    for control in ("zero", "low_tercile"):
        want = trials.groups(trials.observations(held, ["a", "b"], ["s"], **SMALL), control)
        got = trials.grouped(held, ["a", "b"], control, ["s"], **SMALL)
        assert got.columns == want.columns and want.count() > 100
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_matches_are_not_sorted_as_pairs(spark):
    """The plan has no rows of pairs and no sort of them: the search is one step of two sides."""
    pool = spark.range(20).selectExpr("'u' AS u", "id % 2 = 0 AS treated", "id AS i", "'t' AS ticker", "id * 1.0D AS a", "id * 2.0D AS b", "0.5D AS v")
    found = trials.matched(pool, ["u"], ["a", "b"], ["v"])
    assert found.count() == 10 and "FlatMapCoGroupsInPandas" in found._jdf.queryExecution().toString()


def _deepest(prices):
    """By plain loops: the deepest fall from the highest of the prices so far; nulls, and falls from 0 or NaN, don't count."""
    own, worst = [p for p in prices if p is not None], 0.0
    for k, p in enumerate(own):
        top = max(own[: k + 1])
        if top != 0 and not any(math.isnan(q) for q in own[: k + 1]):
            worst = min(worst, (p / top - 1) * 100)
    return worst if len(own) >= 2 else None


def test_drawdowns_are_walked(spark):
    """Series longer than an Arrow batch, one of a single row, nulls and prices that aren't above 0; no list of prices is kept for a row."""
    rng = random.Random(7)
    strange = {20: None, 21: None, 300: float("nan"), 900: -4.0, 901: 0.0, 902: -8.0}
    series = {"a": [round(rng.uniform(1, 99), 2) for _ in range(700)], "b": [5.0], "c": [strange.get(k, round(rng.uniform(1, 99), 2)) for k in range(1000)], "d": [0.0, 0.0, 3.0, 1.0]}
    rows = spark.createDataFrame([(t, k, p) for t, ps in series.items() for k, p in enumerate(ps)], "ticker string, date int, close double")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "97")
    for n in (252, 13):
        found = w.max_drawdown(rows, "x", n)
        assert "collect_list" not in found._jdf.queryExecution().toString()
        got = {(r.ticker, r.date): r.x for r in found.collect()}
        assert got == {(t, k): _deepest(ps[max(0, k - n) : k]) for t, ps in series.items() for k in range(len(ps))}
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_windows_are_computed_once(spark):
    """Row numbers and averages that several indicators name are one window each, and a gate's cuts share one order of the bars."""
    bars = spark.range(9).selectExpr("id % 2 AS ticker", "id AS date", "1.0D AS high", "1.0D AS low", "id * 1.0D AS close")
    plan = w.indicators(w.truncated(bars, 2))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("row_number()") == 1 and plan.count("avg(close") == 2 and "DESC" not in plan


def test_texts_come_in_parts_of_bounded_bytes(spark):
    """A worker makes Python objects of a part of the texts at once, not of 10,000 rows; a longer text is alone, nulls and empty parts hold."""
    rows = spark.range(0, 400, 1, 1).selectExpr("id", "CASE WHEN id = 7 THEN repeat('y', 900000) WHEN id % 9 <> 0 THEN repeat('x', 10000) END AS text")

    def work(texts):
        size = sum(len(x or "") for x in texts)
        places = [k for k, x in enumerate(texts) if x is not None]
        return places, {"together": pa.array([size] * len(places), pa.int64()), "longest": pa.array([max(len(x or "") for x in texts)] * len(places), pa.int64())}

    found = batches.map_parts(rows, work, T._parse_datatype_string("id long, together long, longest long")).collect()
    assert sorted(r.id for r in found) == [k for k in range(400) if k % 9]
    assert all(r.together <= max(2 * batches.PART_BYTES, r.longest + batches.PART_BYTES) for r in found)


def test_pages_are_read_once(spark):
    """A filter on a page's text doesn't read the page a second time, and a stretch is sought twice, for its ends."""
    pages = spark.createDataFrame([(1, "<p>a &amp; b</p>"), (2, None), (3, "<table><tr><td>k</td><td>v</td></tr></table>")], "page_id long, html string")
    out = html.normalised(pages)
    found = out.where(F.length("text") > 0).select("page_id", html.resolved(F.col("spans"), F.lit(0), F.length("text")).alias("r"), "pairs")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "ArrowEvalPython" not in plan and plan.count("filter(") == 2
    assert [(r.page_id, tuple(r.r), r.pairs) for r in found.orderBy("page_id").collect()] == [(1, (3, 12), []), (3, (0, 44), [("k", "v")])]


def test_reduced_texts_are_not_copied_by_line(spark):
    """Lines of a document meet in one aggregation; before, each line carried the whole text through a window."""
    docs = spark.createDataFrame([(1, "ab\n\nc"), (2, None), (3, "d\n \nef\ng")], "doc_id long, text string")
    once = t.reduced(t.placed_paragraphs(docs, separator="\n"), joiner=" | ")
    assert "Generate" not in once._jdf.queryExecution().optimizedPlan().toString()
    got = {r.doc_id: (r.text, [tuple(x) for x in r.spans]) for r in once.collect()}
    assert got == {1: ("ab | c", [(0, 2, 0, 2, True), (5, 6, 4, 5, True)]), 3: ("d | ef | g", [(0, 1, 0, 1, True), (4, 6, 4, 6, True), (9, 10, 7, 8, True)])}


def test_forms_without_prefixes_are_not_rewritten(spark):
    """Only a form with a colon goes through the patterns, and a form that is written by an expression is written once."""
    xml = F.concat(F.lit("<a>"), F.upper("x"), F.lit("</a>"))
    rows = spark.createDataFrame([(1, "<b/>"), (2, '<n:b xsi:q="1" xmlns:n="u" r="a:b">t:u</n:b>'), (3, None), (4, "<long-name.x" + "y" * 999 + " z>")], "id long, x string")
    found = rows.select("id", filings.plain_tags(F.col("x")).alias("x"), filings.plain_tags(xml).alias("y"))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Contains" in plan or "contains" in plan
    assert plan.count("upper(") == 1
    assert [r.x for r in found.orderBy("id").collect()] == ["<b/>", '<b q="1" xmlns:n="u" r="a:b">t:u</b>', None, "<long-name.x" + "y" * 999 + " z>"]


def test_extractions_are_dealt_by_their_rows(spark, monkeypatch):
    """Tasks that join lines and orders grow in number with the lines, not in size."""
    at = "/root/testdata/sf0.001"
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    monkeypatch.setattr(s, "TASK_ROWS", 100)
    found = s.extractions(spark, at)
    assert found.rdd.getNumPartitions() == -(-s.table(spark, at, "lineitem").count() // 100) and found.count() == s.table(spark, at, "lineitem").count()
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
