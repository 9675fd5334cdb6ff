"""Operators that SQL doesn't express, against plain Python on small fixtures."""

import datetime as dt
import random

import numpy as np
import pytest
from conftest import DATA
from pyspark.sql import functions as F

from tidemark.operators import html, joins, models, text, windows
from tidemark.sources import filings
from tidemark.streaming import events


def series(spark, n=80, seed=42):
    rng = random.Random(seed)
    rows = []
    for ticker in (1, 2):
        price = 100.0
        for i in range(n):
            price *= 1 + rng.uniform(-0.03, 0.03)
            rows.append((ticker, dt.date(2024, 1, 1) + dt.timedelta(days=i), price, price * 1.01, price * 0.99, price, 10.0))
    return rows, spark.createDataFrame(rows, "ticker int, date date, open double, high double, low double, close double, volume double")


def ema(values, span):
    out, k = [values[0]], 2 / (span + 1)
    for v in values[1:]:
        out.append(out[-1] + (v - out[-1]) * k)
    return out


def test_macd_is_the_recursion_over_rows_before(spark):
    rows, bars = series(spark)
    found = {(r.ticker, r.date): r for r in windows.macd(bars).collect()}
    for ticker in (1, 2):
        own = [r for r in rows if r[0] == ticker]
        for i, row in enumerate(own):
            got = found[ticker, row[1]]
            if i < 26:
                assert got.macd is None or np.isnan(got.macd)
                continue
            closes = [r[5] for r in own[:i]]
            line = [a - b for a, b in zip(ema(closes, 12), ema(closes, 26), strict=True)][25:]
            assert got.macd == pytest.approx(line[-1])
            assert got.macd_signal == pytest.approx(ema(line, 9)[-1])


def test_changing_a_bar_leaves_its_own_indicators(spark):
    rows, bars = series(spark)
    day = rows[60][1]
    changed = bars.withColumns({c: F.when(F.col("date") == F.lit(day), F.col(c) * 3).otherwise(F.col(c)) for c in ("open", "high", "low", "close")})
    cols = ["sma_fast", "sma_slow", "cross", "ret_1m", "rsi", "atr", "vol", "drawdown"]
    bad = windows.differing(windows.indicators(bars), windows.indicators(changed), cols)
    assert bad.where(F.col("date") <= F.lit(day)).count() == 0
    assert bad.count() > 0


def test_nearest_is_the_full_scan(spark):
    rng = random.Random(1)
    t = [(i, rng.random() * 3, rng.random()) for i in range(40)]
    c = [(i, rng.random() * 3, rng.random()) for i in range(60)]
    frame = lambda rows: spark.createDataFrame(rows, "pos int, a double, b double")
    found = {(r.t, r.c) for r in joins.nearest(frame(t), frame(c), ["a", "b"]).collect()}
    pool = np.array([x[1:] for x in t + c])
    mean, sd = pool.mean(axis=0), pool.std(axis=0, ddof=1)
    want = set()
    for i, *x in t:
        near = [(float(np.sqrt((((np.array(x) - mean) / sd - (np.array(y) - mean) / sd) ** 2).sum())), j) for j, *y in c]
        if min(near)[0] <= 0.25:
            want.add((i, min(near)[1]))
    assert found == want and 0 < len(want) < len(t)


def test_barriers_are_the_plain_rule(spark):
    rng = random.Random(3)
    bars = [("a", i, 10 + rng.random() * 5) for i in range(30)]
    notes = [("a", rng.randrange(0, 25), 9 + rng.random() * 7) for _ in range(6)]
    got = {r.date: (r.near, r.pinned) for r in joins.barriers_known(spark.createDataFrame(bars, "ticker string, date int, close double"), spark.createDataFrame(notes, "ticker string, filed int, barrier double"), 4, 0.05).collect()}
    want = {}
    for i in range(1, 30):
        known = [b for _, f, b in notes if f < i]
        if known:
            before = bars[i - 1][2]
            best = min(known, key=lambda b: abs(before - b) / before)
            ahead = bars[i + 4][2] if i + 4 < 30 else None
            want[i] = (abs(before - best) / before <= 0.05, None if ahead is None else abs(ahead - best) / ahead <= 0.05)
    assert got == want


PAGE = """<html><head><title>no</title><script>x("</p>")</script></head><body><p>One &amp; two<br>three</p><!-- no --><table><tr><td>Issuer</td><td>Acme</td></tr><tr><td rowspan=2>Rate</td><td>5%</td></tr><tr><td>6%</td></tr></table><p>End</p></body></html>"""


def test_page_text_pairs_and_places(spark):
    body, spans, pairs = html.read(PAGE)
    assert body == "One & two three\n\nIssuer: Acme\nRate: 5%\nRate: 6%\n\nEnd"
    assert pairs == [("Issuer", "Acme"), ("Rate", "5%"), ("Rate", "6%")]
    assert "".join(body[a:b] for a, b, *_ in spans) == body
    for a, b, s, e, literal in spans:
        if literal:
            assert PAGE[s:e].replace("\n", " ") == body[a:b]
    assert html.read(None) == ("", [], [])
    pages = spark.createDataFrame([(1, PAGE), (2, None)], "page_id int, html string")
    got = html.normalised(pages).select("page_id", "text", html.resolved(F.col("spans"), F.lit(0), F.lit(3)).alias("r")).orderBy("page_id").collect()
    assert got[0].text == body and PAGE[got[0].r.start : got[0].r.end] == "One" and got[1].text == ""


def test_labels_switch_style(spark):
    row = spark.createDataFrame([("A:: 1\nB: 2\nC: 3\nD: 4",), ("A:: 1\nB:: 2\nC: 3",)], "t string")
    got = [[tuple(x) for x in r[0]] for r in row.select(text.labelled(F.col("t"))).collect()]
    assert got == [[("A", "1"), ("B", "2"), ("C", "3"), ("D", "4")], [("A", "1"), ("B", "2\nC: 3")]]
    long = spark.createDataFrame([("Lead:: a\n\nb c\nNext:: " + "x" * 900,)], "t string")
    assert [tuple(x) for x in long.select(text.labelled(F.col("t"))).first()[0]] == [("Lead", "a\n\nb c"), ("Next", "x" * 699)]


def test_skipped_elements_stay_skipped_over_tables():
    page = "<p>a</p><script>var a='<table><tr><td>k</td><td>v</td></tr></table>'; secret()</script><p>b</p><table><tr><td>c</td><td>d</td></tr></table>"
    body, _, pairs = html.read(page)
    assert body == "a\n\nb\n\nc: d" and pairs == [("c", "d")]


def test_bayes_finds_known_functions():
    rng = np.random.default_rng(0)
    x = rng.uniform(-1, 1, (200, 2))
    y = 3 + 2 * x[:, 0] - x[:, 1] + 0.5 * x[:, 0] ** 2 + rng.normal(0, 0.01, 200)
    mean, sd = models.BayesPolynomial(2).fit(x, y).predict(x)
    assert np.abs(mean - y).max() < 0.05 and 0.005 < sd.mean() < 0.02
    assert models.cross_validated(x, y, 2)[1] > 0.999 > models.cross_validated(x, y, 1)[1]


def test_small_groups_have_no_fit(spark):
    rows = spark.createDataFrame([(1, float(i), float(2 * i)) for i in range(40)] + [(2, 1.0, 2.0)], "g int, a double, y double")
    got = {r.g: r for r in models.fit_groups(rows, "g", ["a"], "y").collect()}
    assert got[1].r2 > 0.999 and got[2].degree is None and got[2].n == 1


def test_json_lines_stop_at_the_first_broken_one(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"a": 1}\n{"a": 2}\n{"a": \n{"a": 4}\n')
    assert [r.a for r in filings.ndjson(spark, str(tmp_path / "a.json"), "a int").collect()] == [1, 2]


def test_graduated_fields_are_refused(spark, tmp_path):
    new = spark.createDataFrame([("x", 1)], "field string, v int")
    filings.append_guarded(new, spark.createDataFrame([("y",)], "field string"), str(tmp_path / "t"))
    with pytest.raises(ValueError):
        filings.append_guarded(new, spark.createDataFrame([("x",)], "field string"), str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).count() == 1 and filings.run_id("s", "v1", 3) == "s@v1#0004"


def test_arcs_resolve_labels(spark):
    xml = '<linkbase><calculationLink role="r"><loc label="a" href="x.xsd#us-gaap_Assets"/><loc label="b" href="x.xsd#us-gaap_Cash"/><calculationArc from="a" to="b" weight="1" order="2"/></calculationLink></linkbase>'
    got = filings.arcs(spark.createDataFrame([("d", xml)], "doc string, xml string")).collect()
    assert [(r.parent, r.child, r.weight, r.ord) for r in got] == [("us-gaap:Assets", "us-gaap:Cash", 1.0, 2.0)]


def test_streamed_windows_are_the_batch_ones(spark, tmp_path):
    src = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    src.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = events.read_stream(spark, str(tmp_path / "in"), src.schema)
    events.drain(events.windowed(stream, "1 hour", late="3650 days"), "complete", str(tmp_path / "c"), name="hours")
    want = {tuple(r) for r in events.windowed(src, "1 hour").collect()}
    assert {tuple(r) for r in spark.table("hours").collect()} == want


def test_promotion_takes_any_number_of_days(spark):
    from tidemark.operators.bitemporal import agreements, tracked

    days = [(1, d, True) for d in (0, 5, 20, 40)] + [(2, d, d != 3) for d in (0, 1, 3, 4, 5, 6, 15)]
    rows = [(f, dt.date(2024, 1, 1) + dt.timedelta(days=d), i, ok) for i, (f, d, ok) in enumerate(days)]
    checks = spark.createDataFrame(rows, "field long, day date, seq long, agree boolean")
    assert {tuple(r) for r in agreements(checks).collect()} == {(1, dt.date(2024, 1, 21)), (2, dt.date(2024, 1, 7))}
    got = {r.seq: (r.n, r.status, r.shadow) for r in tracked(checks).collect()}
    assert [got[i] for i in range(4)] == [(1, "pending", False), (2, "pending", False), (3, "promoted", False), (4, "promoted", False)]
    assert [got[i] for i in range(4, 11)] == [(1, "pending", False), (2, "pending", False), (0, "demoted", False), (1, "demoted", False), (2, "demoted", False), (3, "promoted", True), (4, "promoted", False)]
    assert tracked(checks.limit(0)).count() == 0


def test_promotions_of_a_stream_are_the_batch_ones_with_timers(spark, tmp_path):
    from tidemark.operators.bitemporal import tracked

    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rng, start = random.Random(5), dt.datetime(2024, 1, 1)
    rows = sorted((start + dt.timedelta(days=rng.randrange(40), seconds=f), f, rng.random() < 0.8) for f in (1, 2, 3) for _ in range(25))
    rows = [(f, ts, i, ok) for i, (ts, f, ok) in enumerate(rows)]
    rows += [(9, start + dt.timedelta(days=200 + k), 1000 + k, True) for k in range(2)]  # moves the watermark past all timers
    schema = "field long, ts timestamp, seq long, agree boolean"
    for k in range(0, len(rows), 8):
        spark.createDataFrame(rows[k : k + 8], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = events.read_stream(spark, str(tmp_path / "in"), schema).withWatermark("ts", "60 days")
    events.drain(events.promotions(stream), "append", str(tmp_path / "c"), name="changes")
    got = [(r.field, r.at, r.status) for r in spark.table("changes").collect()]
    checks = spark.createDataFrame(rows, schema).withColumn("day", F.to_date("ts"))
    found = sorted(tracked(checks).collect(), key=lambda r: r.seq)
    want, before, over = [], {}, []
    for r in found:
        if r.status != before.get(r.field, "pending"):
            want.append((r.field, r.ts, r.status))
        before[r.field] = r.status
    assert sorted(x for x in got if x[2] != "shadow over") == sorted(want)
    for f in (1, 2, 3):
        first, n = None, 0
        for r in [r for r in found if r.field == f]:
            if not r.agree:
                if n >= 3 and over and over[-1][0] == f and over[-1][3] == first and r.ts <= over[-1][1]:
                    over.pop()
                first, n = None, 0
                continue
            first, n = first or r.ts, n + 1
            if n == 3 and r.ts - first <= dt.timedelta(days=7):
                over.append((f, first + dt.timedelta(days=7), "shadow over", first))
    assert sorted(x for x in got if x[2] == "shadow over") == sorted(x[:3] for x in over)


def test_capped_ranges_split_warn_and_resume(spark, tmp_path):
    from tidemark.streaming import ranges

    path = f"{DATA}/sf0.001/events.parquet"
    spark.dataSource.register(ranges.RangeSource)
    day = lambda k: str(dt.date(2024, 1, k))
    service = ranges.Listing(path, "ts", 120)
    found = ranges.leaves(service, day(1), day(30))
    assert [x.first for x in found] == sorted(x.first for x in found) and found[0].first == day(1) and found[-1].last == day(30) and len(found) > 5
    assert all(service.count(x.first, x.last) < 120 for x in found if not x.full) and all(x.first == x.last for x in found if x.full)
    assert all(str(dt.date.fromisoformat(a.last) + dt.timedelta(days=1)) == b.first for a, b in zip(found, found[1:], strict=False))
    options = {"path": path, "time": "ts", "first": day(1), "last": day(30), "cap": "30"}
    rows = spark.read.format("capped_ranges").schema("event_id long, value double, " + ranges.NOTE).options(**options).load().collect()
    table = spark.read.parquet(path)
    assert sorted(r.event_id for r in rows if r.note is None) == sorted(r.event_id for r in table.collect())
    busy = {str(r.d) for r in table.groupBy(F.to_date("ts").alias("d")).count().where("count >= 30").collect()}
    assert {r.first_day for r in rows if r.note} == busy and busy

    def run(first, last):
        stream = spark.readStream.format("capped_ranges").schema("event_id long, " + ranges.NOTE).options(**options | {"first": first, "last": last, "cap": "200"}).load()
        query = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(once=True).start()
        query.awaitTermination()
        return spark.read.parquet(str(tmp_path / "out")).select("event_id").collect()

    count = lambda a, b: service.__class__(path, "ts", 10**6).count(a, b)
    assert len(run(day(10), day(15))) == count(day(10), day(15))
    assert len(run(day(10), day(15))) == count(day(10), day(15))  # nothing new after a restart
    got = [r.event_id for r in run(day(5), day(30))]  # both edges, and nothing twice
    assert len(got) == len(set(got)) == count(day(5), day(30))


def test_a_range_that_fails_is_named(spark, tmp_path):
    from tidemark.streaming import ranges

    spark.range(3).selectExpr("id", "timestamp'2024-01-01' as ts").coalesce(1).write.parquet(str(tmp_path / "t"))
    spark.dataSource.register(ranges.RangeSource)

    class Broken(ranges.Listing):
        def rows(self, first, last, columns):
            raise OSError("gone")

    reader = ranges.RangeReader(spark.createDataFrame([], "id long, " + ranges.NOTE).schema, {"path": str(tmp_path / "t"), "time": "ts", "first": "2024-01-01", "last": "2024-01-02"})
    reader.service = Broken(str(tmp_path / "t"), "ts", 10)
    assert list(reader.read(ranges.Range("2024-01-01", "2024-01-02"))) == [(None, "failed: OSError", "2024-01-01", "2024-01-02")]


def test_ranges():
    assert events.uncovered(("2024-01-01", "2024-01-10"), ("2024-01-03", "2024-01-05")) == [("2024-01-01", "2024-01-02"), ("2024-01-06", "2024-01-10")]
    assert events.halves("2024-01-01", "2024-01-04") == [("2024-01-01", "2024-01-02"), ("2024-01-03", "2024-01-04")]
    assert events.halves("2024-01-01", "2024-01-01") == [("2024-01-01", "2024-01-01")]


def test_forms_with_prefixes(spark):
    one = lambda xml: spark.createDataFrame([("d", xml)], "doc string, xml string")
    d = '<?xml version="1.0"?><sch:edgarSubmission xmlns:sch="http://x"><sch:formData><sch:coverPageHeader><sch:issuerInfo><sch:issuerCIK>12</sch:issuerCIK></sch:issuerInfo></sch:coverPageHeader><sch:reportingPersons><sch:reportingPersonInfo><sch:reportingPersonName>A B</sch:reportingPersonName><sch:soleVotingPower>10.00</sch:soleVotingPower><sch:percentOfClass>30.7</sch:percentOfClass></sch:reportingPersonInfo><sch:reportingPersonInfo><sch:reportingPersonName>C</sch:reportingPersonName></sch:reportingPersonInfo></sch:reportingPersons></sch:formData></sch:edgarSubmission>'
    got = filings.owners(one(d)).orderBy("pos").collect()
    assert [(r.issuer_cik, r.person, r.sole_voting, r.percent) for r in got] == [("12", "A B", 10.0, 30.7), ("12", "C", None, None)]
    g = "<edgarSubmission><formData><coverPageHeader><issuerInfo><issuerCik>9</issuerCik></issuerInfo></coverPageHeader><coverPageHeaderReportingPersonDetails><reportingPersonName>G</reportingPersonName><classPercent>5.1</classPercent></coverPageHeaderReportingPersonDetails></formData></edgarSubmission>"
    assert [(r.issuer_cik, r.person, r.percent) for r in filings.owners(one(g)).collect()] == [("9", "G", 5.1)]
    s = "<own:edgarSubmission><own:formData><own:issuerInfo><own:issuerCik>7</own:issuerCik></own:issuerInfo><own:securitiesInformation><own:securitiesClassTitle>Common</own:securitiesClassTitle><own:noOfUnitsSold>5</own:noOfUnitsSold></own:securitiesInformation><own:securitiesInformation><own:securitiesClassTitle>Other</own:securitiesClassTitle></own:securitiesInformation><own:securitiesToBeSold><own:securitiesClassTitle>Pref</own:securitiesClassTitle><own:acquiredDate>1</own:acquiredDate></own:securitiesToBeSold><own:securitiesToBeSold><own:securitiesClassTitle>Common</own:securitiesClassTitle><own:acquiredDate>2</own:acquiredDate></own:securitiesToBeSold></own:formData></own:edgarSubmission>"
    assert [(r["class"], r.units, r.acquired) for r in filings.planned_sales(one(s)).orderBy("pos").collect()] == [("Common", 5.0, "2"), ("Other", None, "1")]


def test_inline_facts_nest(spark):
    page = '<p><ix:nonNumeric name="a:Note" contextRef="c">Sales of <ix:nonFraction name="us:Rev" contextRef="c1" scale="6" sign="-">1,234</ix:nonFraction> made</ix:nonNumeric></p>'
    got = filings.inline_facts(spark.createDataFrame([(1, page), (2, None)], "id int, html string")).orderBy("id", "pos").collect()
    assert [(r.name, r.context, r.text, r.value) for r in got] == [("us:Rev", "c1", "1,234", -1234e6), ("a:Note", "c", "Sales of 1,234 made", None)]


def test_no_query_is_cut_by_id(spark):
    """Every line, order, supplier and part of the tables has its rows."""
    from tidemark.plans import catalog

    at = "/root/testdata/sf0.01"
    q, t = catalog.queries(), lambda n: spark.read.parquet(f"{at}/{n}.parquet")
    lines = t("lineitem").count()
    assert q["scan13_schemaless"](spark, at).count() == lines
    assert q["doc16_ownership"](spark, at).count() == lines
    assert q["win36_vol_share"](spark, at).select("ticker").distinct().count() == t("lineitem").select("l_suppkey").distinct().count() > 20
    assert q["join19_nearest"](spark, at).count() == t("part").where("p_partkey % 2 = 1").count()


def test_fits_use_every_row(spark):
    """The sums give what the rows give, fold by fold; a tail of rows far from the rest is in the error."""
    rng = np.random.default_rng(4)
    x = rng.uniform(-1, 50, (6000, 2))
    y = 3 + 2 * x[:, 0] - x[:, 1] + 0.05 * x[:, 0] * x[:, 1] + rng.normal(0, 2, 6000)
    rows = spark.createDataFrame([("g", *map(float, (*a, b))) for a, b in zip(x, y, strict=True)], "g string, a double, b double, y double")
    got = models.fit_groups(rows, "g", ["a", "b"], "y").first()
    folds = np.array([r.f for r in rows.select(F.pmod(F.xxhash64("a", "b", "y"), F.lit(5)).alias("f")).collect()])
    best = []
    for d in (1, 2):
        out = np.empty(6000)
        for f in range(5):
            out[folds == f] = models.BayesPolynomial(d).fit(x[folds != f], y[folds != f]).predict(x[folds == f])[0]
        best.append((float(np.sqrt(np.mean((y - out) ** 2))), d))
    assert got.n == 6000 and got.degree == min(best)[1] == 2
    assert abs(got.rmse / min(best)[0] - 1) < 1e-9
    twice = models.fit_groups(rows.union(rows), "g", ["a", "b"], "y").first()
    assert twice.n == 12000 and abs(twice.rmse / got.rmse - 1) < 0.01


def test_ownership_has_both_tables(spark):
    v = lambda tag, x: f"<{tag}><value>{x}</value></{tag}>"
    moved = lambda name, n: v("securityTitle", name) + v("transactionDate", "2024-01-02") + f"<transactionCoding><transactionCode>M</transactionCode></transactionCoding><transactionAmounts>{v('transactionShares', n)}</transactionAmounts>"
    kept = lambda name, n: v("securityTitle", name) + f"<postTransactionAmounts>{v('sharesOwnedFollowingTransaction', n)}</postTransactionAmounts>"
    xml = (
        f"<ownershipDocument><issuer><issuerCik>5</issuerCik></issuer><nonDerivativeTable><nonDerivativeTransaction>{moved('Common', 10)}</nonDerivativeTransaction><nonDerivativeHolding>{kept('Pref', 7)}</nonDerivativeHolding></nonDerivativeTable>"
        f"<derivativeTable><derivativeTransaction>{moved('Option', 3)}</derivativeTransaction><derivativeTransaction>{moved('Warrant', 4)}</derivativeTransaction><derivativeHolding>{kept('Note', 9)}</derivativeHolding></derivativeTable></ownershipDocument>"
    )
    only = f"<ownershipDocument><derivativeTable><derivativeHolding>{kept('Note', 9)}</derivativeHolding></derivativeTable></ownershipDocument>"
    got = filings.ownership(spark.createDataFrame([("d", xml), ("e", only)], "doc string, xml string")).collect()
    found = {(r.doc, r.table, r.kind, r.pos, r.security, r.code, r.shares, r.owned_after) for r in got}
    assert len(got) == 6 and found == {
        ("d", "non_derivative", "transaction", 0, "Common", "M", 10.0, None), ("d", "non_derivative", "holding", 0, "Pref", None, None, 7.0), ("d", "derivative", "transaction", 0, "Option", "M", 3.0, None),
        ("d", "derivative", "transaction", 1, "Warrant", "M", 4.0, None), ("d", "derivative", "holding", 0, "Note", None, None, 9.0), ("e", "derivative", "holding", 0, "Note", None, None, 9.0),
    }


@pytest.mark.parametrize(("ge", "directions", "weak", "verdict"), [(6, "uuu", 0, "confirmed"), (6, "udu", 0, "inconclusive"), (24, "uuu", 0, "inconclusive"), (29, "uuu", 0, "refuted"), (29, "uuu", 4, "inconclusive"), (9, "uuu", 0, "inconclusive"), (99, "", 0, "refuted")])
def test_verdicts_are_the_reference_rule(spark, ge, directions, weak, verdict):
    """Of 99 null universes `ge` reach the trials that confirm; p is (ge + 1) / 100."""
    trials = [(False, True, d) for d in directions] + [(True, True, "d")] * weak + [(False, False, "d")] * (not directions)
    nulls = [(len(directions) if i < ge else len(directions) - 1,) for i in range(99)]
    found = models.determined(spark.createDataFrame(trials, "underpowered boolean, confirms boolean, direction string"), spark.createDataFrame(nulls, "n int")).first()
    assert found.verdict == verdict
    assert found.n_scored == len(trials) - weak and found.n_confirming == len(directions)
    assert found.empirical_p == (ge + 1) / 100


def test_time_joins_have_every_left_row(spark):
    from tidemark.plans import catalog

    at = "/root/testdata/sf0.001"
    for name, table in (("join7_asof", "events"), ("join7_asof_strict", "events"), ("join18_forward", "events"), ("join8_vol_at", "lineitem")):
        assert catalog.queries()[name](spark, at).count() == spark.read.parquet(f"{at}/{table}.parquet").count()


def test_labels_further_off_are_found():
    far = "Maturity Date:" + " " * 100 + "2024-01-02"
    assert text._candidates(far)[0]["label"] == "Maturity Date"
    assert text._candidates("Coupon Rate:\n5%")[0]["label"] == "Coupon Rate"
    assert text._candidates("Coupon Rate:" + " " * 230 + "5%")[0]["label"] is None


def test_files_of_mixed_forms_go_to_their_readers(spark):
    four = "<ownershipDocument><issuer><issuerCik>7</issuerCik><issuerName>I</issuerName></issuer><nonDerivativeTable><nonDerivativeTransaction><securityTitle><value>Stock</value></securityTitle><transactionAmounts><transactionShares><value>5</value></transactionShares></transactionAmounts></nonDerivativeTransaction></nonDerivativeTable></ownershipDocument>"
    table = '<n1:informationTable xmlns:n1="u"><n1:infoTable><n1:nameOfIssuer>H</n1:nameOfIssuer><n1:value>9</n1:value></n1:infoTable><n1:infoTable><n1:nameOfIssuer>K</n1:nameOfIssuer><n1:value>8</n1:value></n1:infoTable></n1:informationTable>'
    offer = "<edgarSubmission><primaryIssuer><entityName>P</entityName></primaryIssuer><offeringData><offeringSalesAmounts><totalOfferingAmount>100</totalOfferingAmount></offeringSalesAmounts></offeringData></edgarSubmission>"
    files = [(1, " 4", four), (2, "4/a", four), (3, "13F-HR", table), (4, "D", offer), (5, "10-K", four), (6, None, four), (7, "4", table), (8, "144", None), (9, "D/A", "")]
    frame = spark.createDataFrame(files, "doc int, form string, xml string")
    rows, rejects = filings.dispatched(frame)
    got = sorted((r.doc, r.reader, r.issuer, r.shares, r.value) for r in rows.selectExpr("doc", "reader", "variant_get(row, '$.issuer', 'string') issuer", "variant_get(row, '$.shares', 'double') shares", "variant_get(row, '$.value', 'double') value").collect())
    assert got == [(1, "ownership", "I", 5.0, None), (2, "ownership", "I", 5.0, None), (3, "holdings", "H", None, 9.0), (3, "holdings", "K", None, 8.0), (4, "offerings", "P", None, None)]
    single = filings.ownership(frame.where("doc in (1, 2)")).count() + filings.holdings(frame.where("doc = 3")).count() + filings.offerings(frame.where("doc = 4")).count()
    assert rows.count() == single and {r.reader for r in rows.collect()} == {"ownership", "holdings", "offerings"}
    assert {r.doc: r.reason for r in rejects.collect()} == {5: "no reader for form 10-K", 6: "no reader for form ", 7: "no ownershipDocument in it", 8: "no edgarSubmission in it", 9: "no edgarSubmission in it"}
