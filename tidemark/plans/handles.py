"""Queries of single handles of the survey: one function of the library each, over a whole table, with SQL of its own."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import finance as fin
from tidemark.functions import records as rec
from tidemark.functions import scalars as fn
from tidemark.operators import bitemporal as b
from tidemark.operators import insider
from tidemark.operators import joins as j
from tidemark.operators import quality as q
from tidemark.operators import windows as w
from tidemark.plans import stand_ins as s
from tidemark.sources import filings
from tidemark.streaming import events as ev

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def handle(sql: str) -> Callable[[Query], Query]:
    """Registers a query under its name with its SQL."""

    def keep(query: Query) -> Query:
        QUERIES[query.__name__], ORACLE_SQL[query.__name__] = query, sql
        return query

    return keep


def of_orders(name: str, sql: str, /, **columns: Callable[[], Column]) -> None:
    """A query of column expressions over all orders; the SQL gives their columns from orders."""
    QUERIES[name] = lambda spark, sf_dir: s.table(spark, sf_dir, "orders").select("o_orderkey", *[make().alias(c) for c, make in columns.items()])
    ORACLE_SQL[name] = f"SELECT o_orderkey, {sql} FROM orders"


DAY = "o_orderdate"
k = lambda: F.col("o_orderkey")
price = lambda: F.col("o_totalprice")
status = lambda: F.col("o_orderstatus")
day = lambda: F.to_date("o_orderdate")
picked = lambda *texts: F.element_at(F.array(*[F.lit(x) for x in texts]), (F.col("o_orderkey") % len(texts)).cast("int") + 1)
listed = lambda *texts: "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in texts) + f"][o_orderkey % {len(texts)} + 1]"


# Identifiers and names
of_orders("fn2_bare", "CAST(o_orderkey AS VARCHAR) AS bare", bare=lambda: fn.bare_cik(fn.pad_cik(k())))
of_orders("fn3_display", "'Acme ' || o_orderkey AS name, 'AC,B' || o_orderkey AS tickers, lpad(CAST(o_orderkey AS VARCHAR), 10, '0') AS cik",
          name=lambda: _shown()["name"], tickers=lambda: F.array_join(_shown()["tickers"], ","), cik=lambda: _shown()["cik"])
of_orders("fn4_hit", "'000-' || o_orderkey AS accession, CASE WHEN o_orderkey % 2 = 0 THEN 'd:1.htm' END AS document", accession=lambda: _hit()["accession"], document=lambda: _hit()["document"])
of_orders("fn5_clean", "'acme ' || lower(o_orderstatus) || ' inc' AS c", c=lambda: fn.clean_name(F.concat(F.lit("The  Acme® "), status(), F.lit(" Inc., "))))
of_orders("fn8_camel", "'net sales ' || lower(o_orderstatus) || ' goods' AS c", c=lambda: fn.camel_label(F.concat(F.lit("netSales"), F.col("o_orderstatus"), F.lit(" goods(3)"))))
of_orders("fn10_extra", "o_orderkey % 10 = (100 - list_sum(list_transform(range(8), lambda i: list_sum(list_transform(string_split(CAST(CAST(substr(lpad(CAST(o_orderkey // 10 AS VARCHAR), 8, '0'), CAST(i + 1 AS INT), 1) AS INT) * (1 + i % 2) AS VARCHAR), ''), lambda c: CAST(c AS INT))))) % 10) % 10 AS ok",
          ok=lambda: fn.valid_cusip(F.lpad(k().cast("string"), 9, "0"), "*@#"))
of_orders("fn52_hash", "sha1('a ' || lower(o_orderstatus) || ' b') AS h", h=lambda: fn.paragraph_hash(F.concat(F.lit(" A \n"), status(), F.lit("  b "))))
of_orders("fn82_short_hash", "substr(sha1(CAST(o_orderkey AS VARCHAR)), 1, 10) AS h", h=lambda: fn.content_hash(k().cast("string")))


def _shown() -> Column:
    return fn.display_name(F.concat(F.lit("Acme "), k(), F.lit(" (AC, B"), k(), F.lit(") (CIK "), fn.pad_cik(k()), F.lit(")")))


def _hit() -> Column:
    return fn.hit_parts(F.concat(F.lit("000-"), k(), F.when(k() % 2 == 0, ":d:1.htm").otherwise("")))


# Dates, numbers, periods
_MONTHS = "['January','February','March','April','May','June','July','August','September','October','November','December'][month(o_orderdate)]"
of_orders("fn13_same", "CASE o_orderkey % 3 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%Y-%m-%d') ELSE 'soon' END AS d", d=lambda: fn.date_or_same(F.when(k() % 3 == 0, F.date_format(DAY, "yyyyMMdd")).when(k() % 3 == 1, F.date_format(DAY, "MM/dd/yyyy")).otherwise("soon")))
of_orders("fn14_number", f"[{', '.join(['1000.5', 'NULL', '-3', '70'])}][o_orderkey % 4 + 1]::DOUBLE AS n", n=lambda: fn.as_number(picked("$1,000.5", "n/a", "-3", "70%")))
of_orders("fn15_flag", "[true, false, true, false, NULL][o_orderkey % 5 + 1] AS f", f=lambda: fn.as_flag(picked("1", "0", " True", "FALSE", "yes")))
of_orders("fn17_scaled", "round((o_orderkey % 900) * 1000.0::DOUBLE * CASE WHEN o_orderkey % 2 = 0 THEN -1 ELSE 1 END, 3) AS v", v=lambda: F.round(fn.scaled((k() % 900).cast("string"), F.lit(3), k() % 2 == 0), 3))
of_orders("fn18_numbers", "CAST(o_orderkey AS VARCHAR) || '.0;1500.0' AS n", n=lambda: F.array_join(F.transform(fn.numbers_in(F.concat(F.lit("of "), k(), F.lit(" and 1,500 units"))), lambda x: F.format_string("%.1f", x)), ";"))
of_orders("fn20_words", "lower(o_orderpriority)[1:1] || ' ' || lower(o_orderstatus) || ' x' AS w", w=lambda: fn.words_key(F.concat(F.substring("o_orderpriority", 1, 1), F.lit("--"), status(), F.lit(" X!"))))
of_orders("fn21_states", "CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderkey % 3 = 1 END AS ok", ok=lambda: fn.states_number(F.lit("a rate of 7.5% on notes"), F.when(k() % 3 == 1, 0.075).when(k() % 3 == 2, 0.5)))
of_orders("fn22_reason", "CASE WHEN o_totalprice > 100000 THEN 'large' WHEN o_orderstatus = 'F' THEN 'done' END AS r", r=lambda: fn.first_reason((price() > 100000, "large"), (status() == "F", "done")))
of_orders("fn23_confidence", "CASE WHEN o_orderkey % 150 / 100.0 <= 1 THEN o_orderkey % 150 / 100.0::DOUBLE ELSE -1.0 END AS c", c=lambda: fn.confidence(k() % 150 / 100.0))
of_orders("fn24_cost", "round((o_orderkey * 3.0::DOUBLE + o_custkey * 15.0::DOUBLE) / 1000000, 6) AS c", c=lambda: fn.token_cost(k(), F.col("o_custkey"), 3.0, 15.0))
of_orders("fn25_equal", "o_orderkey % 2 = 0 AS number, o_orderstatus = 'F' AS text, o_orderstatus = 'O' AS list",
          number=lambda: fn.same_number(price(), price() + F.when(k() % 2 == 0, 0.0).otherwise(1.0)), text=lambda: fn.same_text(status(), F.lit(" f")), list=lambda: fn.same_list(F.array(F.lit("B"), status()), F.array(F.lit("o "), F.lit("b"))))
of_orders("fn26_overlap", "o_orderkey % 10 < 6 AND 4 < o_orderkey % 10 + 3 AS o", o=lambda: fn.spans_overlap(k() % 10, k() % 10 + 3, F.lit(4), F.lit(6)))
of_orders("fn27_days", "CAST(o_orderkey % 400 AS INT) AS days, CASE WHEN o_orderkey % 400 <= 100 THEN 'quarterly' WHEN o_orderkey % 400 BETWEEN 300 AND 380 THEN 'annual' ELSE 'other' END AS kind",
          days=lambda: _days(), kind=lambda: b.duration_class(_days()))
of_orders("fn29_year", "CAST(year(o_orderdate) AS INT) AS y", y=lambda: F.year(F.to_date(F.date_format(DAY, "yyyy-MM-dd"))))
of_orders("fn30_ordinal", "'Q' || least(greatest(date_diff('day', date_trunc('year', o_orderdate)::DATE, o_orderdate::DATE) // 91 + 1, 1), 3) AS q", q=lambda: fn.quarter_label(day(), F.trunc(DAY, "year")))
of_orders("fn31_null_days", "CASE WHEN o_orderkey % 2 = 0 THEN 30 END AS d", d=lambda: F.datediff(F.date_add(day(), 30), F.when(k() % 2 == 0, day())))
of_orders("fn32_label", "[2024, 2023, 2025, 2022, NULL][o_orderkey % 5 + 1] AS y, ['Q3', 'Q4', 'FY', 'FY', NULL][o_orderkey % 5 + 1] AS kind", y=lambda: _label()["year"], kind=lambda: _label()["kind"])
of_orders("fn33_filed", "CAST(CASE WHEN o_orderkey % 100 >= 90 THEN 1900 ELSE 2000 END + o_orderkey % 100 AS INT) AS y", y=lambda: fn.filing_year(F.format_string("%010d-%02d-%06d", k(), k() % 100, k() % 1000)))
of_orders("fn34_concepts", f"{listed('R1,R2', 'R1,R2', 'E1', '')} AS c", c=lambda: F.coalesce(F.array_join(fn.concepts_for(picked("revenue", "net sales", "eps", "mood"), {"revenue": ["R1", "R2"], "eps": ["E1"]}, {"sales": "revenue"}), ","), F.lit("")))
of_orders("fn35_mid", "CASE o_orderkey % 3 WHEN 0 THEN o_totalprice + 5 WHEN 1 THEN o_totalprice ELSE o_totalprice + 10 END AS m", m=lambda: fn.midpoint(F.when(k() % 3 != 2, price()), F.when(k() % 3 != 1, price() + 10)))
of_orders("fn36_percent", "CASE WHEN o_orderkey % 5 > 0 THEN o_totalprice / (o_orderkey % 5) * 100 END AS p", p=lambda: fn.per_cent_of(price(), k() % 5))
of_orders("fn47_quarter", "year(o_orderdate) || '-Q' || quarter(o_orderdate) AS q", q=lambda: fn.calendar_quarter(day()))
of_orders("fn48_month", "CASE WHEN o_orderkey % 2 = 0 THEN strftime(o_orderdate, '%Y-%m') END AS m", m=lambda: fn.month_of(F.when(k() % 2 == 0, F.date_format(DAY, "yyyy-MM-dd")).otherwise("1999")))
of_orders("fn45_known", f"{listed('a', 'b', '')} AS kinds", kinds=lambda: F.array_join(fn.event_types(F.array(picked("1", "2", "9"), F.lit("8")), {"1": "a", "2": "b"}), ","))
of_orders("fn42_exhibit", "[2, 0, 3, NULL][o_orderkey % 4 + 1] AS n", n=lambda: fn.exhibit_number(picked("x.htm", "a_ex99.htm", "q-ex99-3.htm", "other.htm"), F.when(k() % 4 == 0, "EX-99.2")))
of_orders("fn49_area", f"{listed('income', 'balance', 'none')} AS a", a=lambda: F.coalesce(F.nullif(fn.statement_area(picked("NetIncomeLoss", "TotalAssets", "Mood"), {"income": ["Income"], "balance": ["Assets"]}), F.lit("other")), F.lit("none")))
of_orders("scan25_periods", "o_orderkey % 5 > 0 AS ok", ok=lambda: fn.period_ok(F.concat(F.lit("CY2024Q"), (k() % 5).cast("string"))))


def _days() -> Column:
    return F.datediff(F.date_add(day(), (k() % 400).cast("int")), day())


def _label() -> Column:
    return fn.period_label(picked("Q3 2024", "fourth quarter of 2023", "full year 2025", "FY 2022", "later"))


# Texts and rules
_LONG = "'x' || o_orderkey || repeat('-', 60)"
of_orders("fn55_around", f"substr({_LONG}, CAST(greatest(o_orderkey % 70 - 10, 0) AS INT) + 1, CAST(least(o_orderkey % 70 + 10, length({_LONG})) - greatest(o_orderkey % 70 - 10, 0) AS INT)) AS a", a=lambda: fn.around(F.concat(F.lit("x"), k(), F.repeat(F.lit("-"), F.lit(60))), (k() % 70).cast("int"), 10))
of_orders("fn56_score", "(CASE WHEN o_orderkey % 4 < 2 THEN 2.0 ELSE 0.0 END + CASE WHEN o_orderkey % 4 % 2 = 0 THEN 0.5 ELSE 0.0 END)::DOUBLE AS s", s=lambda: fn.signals(picked("barrier note of a bank", "barrier", "the bank", "none"), {"barrier": 2.0, r"\bbank\b": 0.5}))
of_orders("fn57_best", "CASE WHEN o_orderkey % 7 >= o_orderkey % 5 AND o_orderkey % 7 >= 3 AND o_orderkey % 7 <> o_orderkey % 5 THEN 'a' WHEN o_orderkey % 5 >= 3 AND o_orderkey % 5 > o_orderkey % 7 THEN 'b' END AS kind",
          kind=lambda: F.when(_best()["sure"], _best()["kind"]))
of_orders("fn58_stage", f"{listed('preliminary', 'final', 'preliminary')} AS st, o_orderkey % 3 = 1 AS none", st=lambda: fn.filing_stage(picked("PRELIMINARY terms", "Final terms", "final, once preliminary")), none=lambda: fn.filing_stage(F.when(k() % 3 == 1, "draft").otherwise("final")).isNull())
of_orders("filt15_vocabulary", "o_orderkey % 2 = 0 AS has, CAST(NULL AS BOOLEAN) AS unknown", has=lambda: fn.vocabulary(picked("the Barrier is", "a rate"), ["barrier", "trigger"]), unknown=lambda: fn.vocabulary(status(), []))
of_orders("filt3_window", "CAST(o_orderdate AS DATE) - 30 AS first, CAST(o_orderdate AS DATE) AS last", first=lambda: insider.window_of(day())[0], last=lambda: insider.window_of(day())[1])
of_orders("filt16_withheld", f"{listed('bad_format', 'not_in_document', 'out_of_bounds')} AS r", r=lambda: fn.withheld(price(), F.array(F.lit("out_of_bounds"), picked("bad_format", "not_in_document", "out_of_bounds")), F.lit(1)))
of_orders("fn64_numeric", "[7, 1.5, NULL, NULL][o_orderkey % 4 + 1]::DOUBLE AS n", n=lambda: fn.as_number(picked("7", "1.5", "true", "")))
of_orders("fn65_ungrounded", "CASE WHEN o_orderkey % 2 = 0 THEN '1,000' ELSE '7;1,000' END AS u", u=lambda: F.array_join(fn.ungrounded(F.lit("7 of 1,000"), F.array(picked("has 7", "has 8"))), ";"))
of_orders("set1_concepts", "'a,b,c' AS u", u=lambda: F.array_join(F.array_union(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("b"), F.lit("c"))), ","))
of_orders("set5_names", "o_orderstatus || '|b' AS names", names=lambda: F.array_join(F.array_distinct(F.filter(F.array(status(), F.lit("the"), F.lit("b"), status()), lambda x: ~x.isin("the", "of"))), "|"))
of_orders("set6_kinds", "CASE o_orderstatus WHEN 'F' THEN 'index' ELSE 'index,' || o_orderstatus END AS kinds_then_names", kinds_then_names=lambda: F.array_join(F.concat(F.filter(_members(), lambda x: x.isin("index", "etf")), F.filter(_members(), lambda x: ~x.isin("index", "etf"))), ","))
of_orders("fn60_cross", "o_orderkey % 3 = 0 AS late, o_orderkey % 2 = 0 AS off, false AS missing",
          late=lambda: rec.cross_failed("date_after", day(), F.date_add(day(), F.when(k() % 3 == 0, 1).otherwise(-1))), off=lambda: rec.cross_failed("equals", price() * F.when(k() % 2 == 0, 1.05).otherwise(1.005), price(), 1.0), missing=lambda: rec.cross_failed("lte", F.lit(None).cast("double"), price()))
of_orders("fn61_record", "CASE o_orderkey % 3 WHEN 0 THEN 'missing_required:issuer,unknown_field:zz' WHEN 1 THEN 'wire_key_leak:iss' ELSE 'waived:issuer' END AS flags",
          flags=lambda: F.array_join(rec.record_flags(["issuer", "rate"], ["issuer"], F.when(k() % 3 == 0, F.create_map(F.lit("rate"), F.lit("5"), F.lit("zz"), F.lit("1"))).when(k() % 3 == 1, F.create_map(F.lit("issuer"), F.lit("A"), F.lit("iss"), F.lit("A"))).otherwise(F.create_map(F.lit("rate"), F.lit("5"))), k() % 3 == 2, {"iss": "issuer"}), ","))
of_orders("fn62_schema", "CASE o_orderkey % 5 WHEN 0 THEN 'missing:id' WHEN 1 THEN 'null:id' WHEN 2 THEN 'type:id:number' WHEN 3 THEN 'enum:kind' ELSE '' END AS errors",
          errors=lambda: F.array_join(rec.field_errors({"id": {"required": True, "type": "string"}, "kind": {"nullable": True, "enum": ["gather", "model"]}}, {"id": k() % 5 != 0, "kind": F.lit(True)}, {"id": F.when(k() % 5 != 1, k().cast("string")), "kind": F.when(k() % 5 == 3, "other").when(k() % 2 == 0, "model")}, {"id": F.when(k() % 5 == 2, "number").otherwise("string"), "kind": F.lit("string")}), ","))
of_orders("fn63_by_kind", "CASE WHEN o_orderkey % 3 = 0 THEN 'cadence' WHEN o_orderkey % 3 = 1 THEN 'inputs,posture' ELSE '' END AS missing",
          missing=lambda: F.array_join(rec.required_by_kind(picked("gather", "model", "view"), {"gather": {"source": rec.given(status()), "cadence": rec.given(F.lit(""))}, "model": {"inputs": F.size(F.array()) > 0, "posture": rec.given(F.lit(None).cast("string"))}}), ","))
of_orders("fn50_document", f"{listed('ex107', 'primary', 'graphic', 'xbrl_data', 'xml', 'exhibit', 'other')} AS kind", kind=lambda: rec.document_kind(picked("filingfees.htm", "a.htm", "b.PNG", "c.xml", "d.xsd", "ex5.htm", "readme.txt"), picked("", "424b2 ", "", "XBRL INSTANCE", "", "", "")))
of_orders("set9_slices", "(SELECT string_agg(CAST(o_orderdate AS DATE) + CAST(round_even(i * (1 + o_orderkey % 50) / least(4, 1 + o_orderkey % 50)::DOUBLE, 0) AS INT) || '', ',' ORDER BY i) FROM range(least(4, 1 + o_orderkey % 50)) r(i)) AS starts",
          starts=lambda: F.array_join(F.transform(rec.slices(day(), F.date_add(day(), (k() % 50).cast("int")), 4), lambda x: x["start"].cast("string")), ","))
of_orders("set11_months", "CAST(date_diff('month', o_orderdate::DATE, o_orderdate::DATE + CAST(o_orderkey % 90 AS INT)) + 1 AS INT) AS n, CAST(o_orderdate AS DATE) AS first, CAST(o_orderdate AS DATE) + CAST(o_orderkey % 90 AS INT) AS last", n=lambda: F.size(_months()), first=lambda: F.get(_months(), 0)["start"], last=lambda: F.element_at(_months(), -1)["end"])


def _best() -> Column:
    return fn.best_kind({"a": k() % 7, "b": k() % 5}, 3.0)


def _members() -> Column:
    return F.filter(F.array(F.lit("index"), F.when(status() != "F", status())), lambda x: x.isNotNull())


def _months() -> Column:
    return rec.months(day(), F.date_add(day(), (k() % 90).cast("int")))


# Finance
of_orders("fn70_surface", "round(0.3 * least(greatest(1 - 1.6 * ln((50 + o_orderkey % 100) / 100.0::DOUBLE), 0.60), 1.70) * least(greatest(1 + 0.35 * (o_orderkey % 3 - 8 / 52.0::DOUBLE), 0.80), 1.35), 9) AS v", v=lambda: F.round(fin.surface_vol(F.lit(0.3), F.lit(100.0), 50.0 + k() % 100, (k() % 3).cast("double")), 9))
of_orders("fn71_markup", "round(1 + 0.15 * (least(greatest(o_orderkey % 140 - 20, 0), 100) - 50) / 50.0::DOUBLE, 9) AS m", m=lambda: F.round(fin.vol_markup((k() % 140 - 20).cast("double")), 9))
of_orders("fn72_spread", "greatest(0.02, o_totalprice / 100000 * 0.04) AS h", h=lambda: fin.half_spread(price() / 100000))
of_orders("fn74_intrinsic", "CASE WHEN o_orderkey % 2 = 0 THEN greatest(o_totalprice - 90000, 0) ELSE greatest(90000 - o_totalprice, 0) END AS v", v=lambda: fin.intrinsic(price(), F.lit(90000.0), k() % 2 == 0))
of_orders("fn69_expired", "(CASE WHEN o_orderkey % 2 = 0 THEN CASE WHEN o_totalprice > 90000 THEN 1.0 ELSE 0.0 END ELSE CASE WHEN o_totalprice < 90000 THEN -1.0 ELSE 0.0 END END)::DOUBLE AS delta, 0.0::DOUBLE AS vega", delta=lambda: _greeks()["delta"], vega=lambda: _greeks()["vega"])
of_orders("fn78_shares", "CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE CAST(floor(least(100000 * 0.02 / 4, greatest((o_orderkey % 7 - 2) / 10.0::DOUBLE / 0.04, 0) / 2 * 100000 / 50, 100000 * 0.02 / (0.4 * 50))) AS BIGINT) END AS n",
          n=lambda: fin.suggested_shares(F.lit(100000.0), 0.02, F.lit(50.0), F.lit(2.0), (k() % 7 - 2) / 10.0, F.lit(0.2), F.when(k() % 4 != 0, -0.4)))
of_orders("filt17_liquid", "o_orderkey % 900 >= 500 AND o_orderkey % 300 >= 100 AS ok", ok=lambda: fin.liquid_chain(k() % 900, k() % 300))
of_orders("filt18_unknown", "false AS ok", ok=lambda: fin.liquid_chain(F.lit(None).cast("int"), k()))
of_orders("agg48_smart_money", "round(0.35 * 0.5 + 0.30 * (o_orderkey % 5) / 5.0::DOUBLE, 9) AS v", v=lambda: F.round(fin.smart_money(F.lit(0.5), k() % 5 / 5.0, F.lit(None).cast("double"), F.lit(None).cast("double")), 9))


def _greeks() -> Column:
    return fin.black_76_greeks(price(), F.lit(90000.0), F.lit(0.3), F.lit(0.0), k() % 2 == 0)


@handle(f"WITH {s.BARS}, r AS (SELECT ticker, date_trunc('year', date) AS y, ln(close / lag(close) OVER (PARTITION BY ticker ORDER BY date)) AS x FROM b) SELECT ticker, CAST(year(y) AS INT) AS y, round(CASE WHEN count(x) < 2 THEN 0.0 ELSE stddev_samp(x) * sqrt(52) END, 6) AS v FROM r GROUP BY 1, 2")
def fn75_weekly(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = s.bars(spark, sf_dir).withColumn("x", F.log(F.col("close") / F.lag("close", 1).over(w.series())))
    return rows.groupBy("ticker", F.year("date").alias("y")).agg(F.round(fin.weekly_vol(F.col("x")), 6).alias("v"))


# Stores, versions, sources
@handle("SELECT lpad(CAST(o_custkey AS VARCHAR), 10, '0') AS cik, arg_max('n' || o_orderkey, o_orderkey) FILTER (o_orderkey % 3 > 0) AS name FROM orders GROUP BY 1 HAVING count(*) FILTER (o_orderkey % 3 > 0) > 0")
def scan3_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = s.table(spark, sf_dir, "orders").select(fn.pad_cik(F.col("o_custkey")).alias("cik"), F.when(k() % 3 > 0, F.concat(F.lit("n"), k())).otherwise("").alias("name"), k().alias("seq"))
    return b.upsert_names(rows.where("seq % 2 = 0"), rows.where("seq % 2 = 1")).select("cik", "name")


@handle("SELECT l_partkey AS parent, l_suppkey AS child, arg_max(l_tax, l_orderkey * 10 + l_linenumber) AS weight FROM lineitem GROUP BY 1, 2")
def scan4_arcs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = s.table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("parent"), F.col("l_suppkey").alias("child"), F.col("l_tax").alias("weight"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"))
    return b.upsert(rows.where("seq % 2 = 0"), rows.where("seq % 2 = 1"), ["parent", "child"], "seq").select("parent", "child", "weight")


@handle("SELECT o_custkey, o_orderpriority AS metric, max(o_orderkey) AS seq FROM orders GROUP BY 1, 2")
def scan5_guidance(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = s.table(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderpriority").alias("metric"), k().alias("seq"))
    return b.upsert(rows.where("seq % 2 = 0"), rows.where("seq % 2 = 1"), ["o_custkey", "metric"], "seq").select("o_custkey", "metric", "seq")


@handle("SELECT o_orderkey, 'USD' AS unit, o_totalprice AS value, strftime(o_orderdate, '%Y-%m-%d') AS first FROM orders WHERE o_orderkey % 2 = 0")
def scan22_concept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts of one concept from JSON; instants (odd orders) are left out."""
    first = F.when(k() % 2 == 0, F.date_format(DAY, "yyyy-MM-dd"))
    json = F.to_json(F.struct(F.struct(F.array(F.struct(first.alias("start"), F.date_format(DAY, "yyyy-MM-dd").alias("end"), price().alias("val"))).alias("USD")).alias("units")))
    rows = s.table(spark, sf_dir, "orders").select("o_orderkey", F.explode(filings.facts_of_concept(json)).alias("r"))
    return rows.select("o_orderkey", "r.unit", F.col("r.entry.val").alias("value"), F.col("r.entry.start").alias("first"))


@handle("SELECT 'gaap:' || o_orderstatus AS concept, lpad(CAST(o_custkey AS VARCHAR), 10, '0') AS cik, strftime(o_orderdate, '%Y-%m-%d') AS period_start, o_totalprice AS value FROM orders")
def scan24_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A concept for a period over all filers, from JSON; an instant begins where it ends."""
    entry = F.struct(F.lit("a").alias("accn"), F.col("o_custkey").alias("cik"), F.date_format(DAY, "yyyy-MM-dd").alias("end"), price().alias("val"))
    rows = s.table(spark, sf_dir, "orders").select(F.to_json(F.struct(F.lit("gaap").alias("taxonomy"), status().alias("tag"), F.lit("USD").alias("uom"), F.array(entry).alias("data"))).alias("json"))
    return filings.frames(rows).select("concept", "cik", "period_start", "value")


@handle("SELECT o_custkey AS cik, min(o_orderkey) AS pos FROM orders GROUP BY 1")
def scan21_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filings.first_mentions(s.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("cik"), k().alias("pos")))


@handle("SELECT n_nationkey, n_name FROM nation")
def filt10_projected(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = s.table(spark, sf_dir, "nation")
    return n.select(*rec.kept_columns(n.columns, ["n_nationkey", "absent", "n_name"]))


@handle("SELECT DISTINCT key FROM (SELECT unnest(['a', 'b' || o_orderkey % 3]) AS key FROM orders)")
def filt11_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = s.table(spark, sf_dir, "orders").select(k().alias("row_index"), F.to_json(F.create_map(F.lit("a"), F.lit(1), F.concat(F.lit("b"), (k() % 3).cast("string")), F.lit(2))).alias("data_json"))
    return spark.createDataFrame([(x,) for x in filings.union_columns(rows)], "key string")


@handle("SELECT json_extract_string(v, '$.o') AS o, json_extract_string(v, '$.s') AS st FROM (SELECT json_object('o', o_orderkey, 's', o_orderstatus) AS v FROM orders)")
def scan38_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows as JSON lines and read back."""
    lines = filings.jsonl(s.table(spark, sf_dir, "orders").select(k().alias("o"), status().alias("s")))
    return lines.select(F.get_json_object("value", "$.o").alias("o"), F.get_json_object("value", "$.s").alias("st"))


@handle("SELECT e.field, count(*) AS n FROM (SELECT o_orderpriority AS run_id, o_orderkey AS accession, l_returnflag AS field FROM lineitem JOIN orders ON l_orderkey = o_orderkey) e LEFT JOIN (SELECT DISTINCT o_orderpriority AS run_id FROM orders WHERE o_orderpriority < '3') r USING (run_id) WHERE r.run_id IS NULL GROUP BY 1")
def scan14_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Field rows whose run isn't known, by field, of a left join."""
    e = s.extractions(spark, sf_dir).select("run_id", F.substring("field", 1, 1).alias("field"))
    runs = s.table(spark, sf_dir, "orders").where("o_orderpriority < '3'").select(F.col("o_orderpriority").alias("run_id")).distinct().withColumn("known", F.lit(True))
    return e.join(F.broadcast(runs), "run_id", "left").where("known is null").groupBy("field").agg(F.count(F.lit(1)).alias("n"))


@handle(f"WITH {s.FACTS} SELECT cik, concept, period_end, value FROM f QUALIFY row_number() OVER (PARTITION BY cik, concept, period_start, period_end ORDER BY accession DESC, ingested_seq DESC) = 1")
def agg14_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.latest(s.facts(spark, sf_dir)).select("cik", "concept", "period_end", "value")


@handle(f"WITH {s.FACTS}, v AS (SELECT *, row_number() OVER (PARTITION BY cik, concept, period_start, period_end ORDER BY accession DESC, ingested_seq DESC) AS r FROM f WHERE filed <= '1996-06-30') SELECT cik, concept, period_end, value, filed FROM v WHERE r = 1")
def strm6_restated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What was known on a day: restatements filed later don't show."""
    return b.as_of(s.facts(spark, sf_dir), "1996-06-30").select("cik", "concept", "period_end", "value", "filed")


@handle(f"WITH {s.FACTS} SELECT cik, accession, count(*) AS n, count(DISTINCT concept) AS concepts FROM f GROUP BY 1, 2")
def agg30_filing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s.facts(spark, sf_dir).groupBy("cik", "accession").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("concept").alias("concepts"))


@handle(f"WITH {s.FACTS} SELECT cik, concept, count(DISTINCT accession) AS filings FROM f GROUP BY 1, 2")
def agg31_concepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s.facts(spark, sf_dir).groupBy("cik", "concept").agg(F.countDistinct("accession").alias("filings"))


# Joins, sets, windows
@handle("SELECT n_nationkey, o_orderkey, o_totalprice FROM nation JOIN (SELECT o_custkey % 25 AS n_nationkey, o_orderkey, o_totalprice FROM orders) USING (n_nationkey)")
def join28_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = s.table(spark, sf_dir, "orders").select((F.col("o_custkey") % 25).cast("int").alias("n_nationkey"), "o_orderkey", "o_totalprice")
    return j.lookup(o, s.table(spark, sf_dir, "nation"), "n_nationkey", "n_name")[0].select("n_nationkey", "o_orderkey", "o_totalprice")


@handle("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def join26_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = s.table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"), "o_orderstatus").distinct()
    return j.lookup(s.table(spark, sf_dir, "customer").select("c_custkey"), names, "c_custkey", "o_orderstatus")[1]


@handle("SELECT c_custkey, CASE WHEN c_name LIKE '%1' THEN 'ONE' WHEN c_name LIKE '%2%' THEN 'TWO' END AS ticker FROM customer")
def join27_proxies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names to tickers by ordered patterns; the first that fits."""
    return s.table(spark, sf_dir, "customer").select("c_custkey", fn.first_match(F.col("c_name"), {"ONE": "1$", "TWO": "2"}).alias("ticker"))


@handle(f"WITH {s.BARS}, n AS (SELECT s_suppkey AS ticker, DATE '1995-01-01' + CAST(s_suppkey % 200 AS INT) AS filed, 800.0 + s_suppkey % 7 * 100 AS barrier FROM supplier), h AS (SELECT ticker, date, lag(close) OVER w AS before, lead(close, 5) OVER w AS ahead FROM b WINDOW w AS (PARTITION BY ticker ORDER BY date)) SELECT h.ticker, date, abs(before - barrier) / before <= 0.2 AS near, abs(ahead - barrier) / ahead <= 0.2 AS pinned FROM h JOIN n ON h.ticker = n.ticker AND filed < date WHERE before IS NOT NULL")
def win31_pinned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the close before (FILT13) and the close five bars ahead lie near the nearest barrier known by then."""
    key = F.col("s_suppkey")
    notes = s.table(spark, sf_dir, "supplier").select(key.alias("ticker"), F.date_add(F.lit("1995-01-01").cast("date"), (key % 200).cast("int")).alias("filed"), (800.0 + key % 7 * 100).alias("barrier"))
    return j.barriers_known(s.bars(spark, sf_dir), notes, 5, 0.2)


@handle("SELECT CAST(o_orderdate AS DATE) AS date FROM orders WHERE o_orderstatus IN ('F', 'O') GROUP BY 1 HAVING count(DISTINCT o_orderstatus) = 2")
def set3_common(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = s.table(spark, sf_dir, "orders").where(status().isin("F", "O")).select(status().alias("ticker"), day().alias("date"))
    return j.common_dates(rows)


@handle("SELECT o_orderkey FROM orders WHERE o_orderkey % 5 = 0")
def set4_differing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that differ between a table and a copy with every fifth value changed."""
    a = s.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("ticker"), k().alias("date"), price().alias("v"))
    changed = a.withColumn("v", F.when(F.col("date") % 5 == 0, F.col("v") + 1).otherwise(F.col("v")))
    return w.differing(a, changed, ["v"]).select(F.col("date").alias("o_orderkey"))


@handle("SELECT o_orderkey FROM orders WHERE o_orderkey % 3 <> 0")
def strm8_memoised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose digest wasn't computed before."""
    o = s.table(spark, sf_dir, "orders").select("o_orderkey", fn.cache_key(k(), status()).alias("digest"))
    return ev.only_new(o, o.where(k() % 3 == 0), "digest").select("o_orderkey")


@handle("SELECT event_id FROM events WHERE CAST(ts AS DATE) NOT BETWEEN DATE '2024-01-10' AND DATE '2024-01-15'")
def strm2_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of the days that a wider range adds to one that is covered."""
    e = s.table(spark, sf_dir, "events").withColumn("day", F.to_date("ts"))
    wanted = e.agg(F.min("day").cast("string"), F.max("day").cast("string")).first()
    edges = [F.col("day").between(F.lit(a).cast("date"), F.lit(b).cast("date")) for a, b in ev.uncovered(tuple(wanted), ("2024-01-10", "2024-01-15"))]
    return e.where(reduce(or_, edges, F.lit(False))).select("event_id")


@handle("SELECT l_orderkey, l_linenumber AS n, l_extendedprice AS v FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber DESC, l_extendedprice DESC) = 1")
def sort3_first_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = s.table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("n"), F.col("l_extendedprice").alias("v"))
    return b.last_of(rows, ["l_orderkey"], "n", "v").select("l_orderkey", "n", "v")


@handle("SELECT max(o_orderdate) AS newest, max(o_orderkey) FILTER (o_orderdate = (SELECT max(o_orderdate) FROM orders)) AS id FROM orders")
def sort4_newest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest record, of equal days the greatest id."""
    return s.table(spark, sf_dir, "orders").agg(F.max(DAY).alias("newest"), F.max_by("o_orderkey", F.struct(DAY, "o_orderkey")).alias("id"))


@handle("SELECT o_orderkey, o_totalprice, CAST(row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS INT) AS place FROM orders QUALIFY place <= 200")
def sort7_limited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 200 by price; the limit is the feature."""
    from pyspark.sql import window as W

    top = s.table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(200)
    return top.withColumn("place", F.row_number().over(W.Window.orderBy(F.desc("o_totalprice"), "o_orderkey")))


# Quality
@handle("SELECT o_orderstatus, CASE WHEN sum(o_orderkey % 2) > 0 THEN count(*)::DOUBLE / sum(o_orderkey % 2) END AS r FROM orders GROUP BY 1")
def agg32_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s.table(spark, sf_dir, "orders").groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.sum(k() % 2).alias("m")).select("o_orderstatus", q.ratio(F.col("n"), F.col("m")).alias("r"))


@handle("SELECT o_custkey, CAST(sum(o_orderkey * 18) AS BIGINT) AS micros FROM orders GROUP BY 1")
def agg34_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s.table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.round(F.sum(fn.token_cost(k(), k(), 3.0, 15.0)) * 1e6).cast("long").alias("micros"))


@handle("SELECT o_orderpriority AS run, count(DISTINCT o_custkey) AS docs, count(*) AS n, max(o_orderdate) AS last FROM orders GROUP BY 1")
def agg36_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s.table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("run")).agg(F.countDistinct("o_custkey").alias("docs"), F.count(F.lit(1)).alias("n"), F.max(DAY).alias("last"))


@handle("SELECT count(*) AS n, count(DISTINCT o_custkey) AS issuers, min(o_orderdate) AS first, max(o_orderdate) AS last, count(CASE WHEN o_totalprice > 1000 THEN 1 END) AS priced FROM orders")
def agg37_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s.table(spark, sf_dir, "orders").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("o_custkey").alias("issuers"), F.min(DAY).alias("first"), F.max(DAY).alias("last"), F.count(F.when(price() > 1000, 1)).alias("priced"))


@handle("SELECT event_type, count(value)::DOUBLE / count(*) AS usable FROM events GROUP BY 1")
def agg38_usable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s.table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("value").alias("a"), F.count(F.lit(1)).alias("n")).select("event_type", q.ratio(F.col("a"), F.col("n")).alias("usable"))


@handle("SELECT o_custkey, coalesce(arg_max(o_orderkey || '.htm', o_totalprice) FILTER (o_orderkey % 3 = 0), arg_max('index' || o_orderkey || '.htm', o_totalprice) FILTER (o_orderkey % 3 = 1), arg_max(o_orderkey || '.txt', o_totalprice) FILTER (o_orderkey % 3 = 2)) AS name FROM orders GROUP BY 1")
def fn51_main(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The largest page that is no index, else the largest page, else the largest text."""
    name = F.when(k() % 3 == 0, F.concat(k(), F.lit(".htm"))).when(k() % 3 == 1, F.concat(F.lit("index"), k(), F.lit(".htm"))).otherwise(F.concat(k(), F.lit(".txt")))
    return s.table(spark, sf_dir, "orders").groupBy("o_custkey").agg(rec.main_document(name, price()).alias("name"))


@handle("SELECT l_orderkey, CASE WHEN count(*) FILTER (l_linenumber = 2) > 0 THEN 'r2' ELSE 'r' || min(l_linenumber) FILTER (l_linenumber <> 2) END AS name FROM lineitem GROUP BY 1")
def fn44_release(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exhibit 99.1 (line 2 here), else the lowest-numbered exhibit."""
    n = F.col("l_linenumber")
    number = F.when(n == 2, 1).when(n == 1, 0).otherwise(n)
    return s.table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(rec.press_release(F.concat(F.lit("r"), n), number).alias("name"))
