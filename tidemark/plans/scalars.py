"""Queries that apply the scalar functions to whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import finance as fin
from tidemark.functions import scalars as fn
from tidemark.plans import stand_ins as s


def fn1_identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = s.table(spark, sf_dir, "customer")
    shown = F.concat(F.col("c_name"), F.lit(" (T"), F.col("c_nationkey"), F.lit(", U"), F.col("c_nationkey"), F.lit(") (CIK "), fn.pad_cik(F.col("c_custkey")), F.lit(")"))
    d = fn.display_name(shown)
    h = fn.hit_parts(F.concat(F.lit("a"), F.col("c_custkey"), F.lit(":d:1")))
    return c.select("c_custkey", fn.bare_cik(fn.pad_cik(F.col("c_custkey"))).alias("bare"), d["name"].alias("name"), F.concat_ws("|", d["tickers"]).alias("tickers"), d["cik"].alias("cik"), h["accession"].alias("accession"), h["document"].alias("document"))


def fn9_cusip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight digits of a key and the check digit that its last digit guesses."""
    p = s.table(spark, sf_dir, "orders")
    raw = F.lpad((F.col("o_orderkey") * 7919 % 1_000_000_000).cast("string"), 9, "0")
    return p.select("o_orderkey", fn.valid_cusip(raw).alias("plain"), fn.valid_cusip(F.concat(F.lit("*"), F.substring(raw, 2, 8)), "*@#").alias("extra"), fn.valid_cusip(F.concat(F.lit("*"), F.substring(raw, 2, 8))).alias("refused"))


def fn11_isin(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.concat(F.lit("US"), F.lpad((F.col("o_orderkey") * 104729 % 10_000_000_000).cast("string"), 10, "0"))
    return s.table(spark, sf_dir, "orders").select("o_orderkey", fn.valid_isin(raw).alias("valid"))


def fn6_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = s.table(spark, sf_dir, "part")
    return p.select("p_partkey", fn.alnum_key(F.col("p_brand")).alias("a"), fn.words_key(F.col("p_brand")).alias("w"), fn.camel_label(F.concat(F.lit("netSales"), F.col("p_brand"), F.lit("(2)"))).alias("c"), fn.clean_name(F.concat(F.lit("The  "), F.col("p_name"), F.lit("® , "))).alias("n"), fn.paragraph_hash(F.col("p_name")).alias("h"))


def fn12_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order dates written four ways in prose and found again."""
    o = s.table(spark, sf_dir, "orders")
    d = F.col("o_orderdate")
    text = F.when(F.col("o_orderkey") % 4 == 0, F.concat(F.lit("on "), F.date_format(d, "MMMM d, yyyy"), F.lit(" it"))).when(F.col("o_orderkey") % 4 == 1, F.concat(F.lit("on "), F.date_format(d, "d MMMM yyyy"))).when(F.col("o_orderkey") % 4 == 2, F.date_format(d, "yyyy-MM-dd")).otherwise(F.concat(F.lit("at "), F.date_format(d, "M/d/yyyy")))
    return o.select("o_orderkey", fn.iso_date(text).alias("iso"), fn.date_or_same(F.date_format(d, "MM/dd/yyyy")).alias("same"), fn.calendar_quarter(d).alias("q"), fn.month_of(F.date_format(d, "yyyy-MM-dd")).alias("m"))


def fn16_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = s.table(spark, sf_dir, "orders")
    cents = F.round(F.col("o_totalprice") * 100).cast("long")
    text = F.concat(F.lit("$"), F.floor(cents / 100), F.lit("."), F.lpad((cents % 100).cast("string"), 2, "0"), F.lit(" "))
    return o.select("o_orderkey", fn.as_number(text).alias("n"), fn.as_number(F.lit("n/a")).alias("none"), F.size(fn.numbers_in(F.concat(text, F.lit(" and 1,000 or -3.5%")))).alias("found"), fn.states_number(text, F.col("o_totalprice") / 100).alias("states"), F.array_join(fn.ungrounded(F.lit("7 of 1,000"), F.array(F.col("o_orderkey").cast("string"))), ";").alias("ungrounded"))


def fn28_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = s.table(spark, sf_dir, "orders")
    n = (F.col("o_orderkey") % 5).cast("int")
    label = F.element_at(F.array(*[F.lit(x) for x in ("Q3 2024", "fourth quarter of 2023", "full year 2025", "FY 2022", "later")]), n + 1)
    p = fn.period_label(label)
    return o.select("o_orderkey", p["year"].alias("year"), p["kind"].alias("kind"), fn.filing_year(F.format_string("%010d-%02d-%06d", "o_custkey", F.pmod(F.year("o_orderdate"), F.lit(100)), F.col("o_orderkey") % 1_000_000)).alias("filed"), fn.quarter_label(F.col("o_orderdate").cast("date"), F.trunc("o_orderdate", "year")).alias("q"), fn.period_ok(F.concat(F.lit("CY"), F.year("o_orderdate").cast("string"), F.lit("Q"), n.cast("string"))).alias("ok"))


def fn38_tolerance(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = s.table(spark, sf_dir, "orders")
    k = F.col("o_orderkey") % 90 + 1
    text = F.concat(F.lit("revenue of $"), k, F.when(F.col("o_orderkey") % 2 == 0, " million, plus or minus 2%").otherwise(" ± 50 basis points"))
    t = fn.tolerance_range(text)
    return o.select("o_orderkey", F.round(t["low"], 4).alias("low"), F.round(t["high"], 4).alias("high"), F.round(fn.midpoint(t["low"], t["high"]), 4).alias("mid"), F.array_join(fn.concepts_for(F.when(k % 3 == 0, "Total Revenue").when(k % 3 == 1, "eps").otherwise("net sales"), {"revenue": ["R1", "R2"], "eps": ["E1"]}, {"sales": "revenue"}), ",").alias("concepts"))


def fn59_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = s.table(spark, sf_dir, "lineitem")
    f = fn.flags((F.col("l_tax") > 0.07, "out_of_bounds"), (F.col("l_discount") > 0.08, "bad_format"), (F.col("l_quantity") > 45, "not_in_document"))
    span = F.when(F.col("l_linenumber") > 1, F.col("l_linenumber"))
    return li.select("l_orderkey", "l_linenumber", F.array_join(f, ",").alias("flags"), fn.withheld(F.col("l_quantity"), f, span).alias("withheld"), fn.first_reason((F.col("l_quantity") < 3, "few"), (F.col("l_tax") == 0, "untaxed")).alias("reason"), fn.confidence(F.col("l_tax") * 20).alias("conf"), fn.spans_overlap(F.col("l_linenumber"), F.col("l_linenumber") + 2, F.lit(3), F.lit(4)).alias("overlap"))


def fn41_filings(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = s.table(spark, sf_dir, "orders")
    codes = F.concat(F.lit(" 2.02, "), (F.col("o_orderkey") % 9).cast("string"), F.lit(".01 ,,"))
    return o.select("o_orderkey", F.array_join(fn.items(codes), "|").alias("items"), F.array_join(fn.event_types(fn.items(codes), {"2.02": "results", "5.01": "control", "8.01": "other"}), ",").alias("events"), fn.exhibit_number(F.concat(F.lit("q_ex99-"), (F.col("o_orderkey") % 4).cast("string"), F.lit(".htm")), F.when(F.col("o_orderkey") % 5 == 0, F.lit("EX-99.2"))).alias("exhibit"), fn.statement_area(F.col("o_orderstatus"), {"income": ["F"], "balance": ["O"]}).alias("area"))


def fn67_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = s.table(spark, sf_dir, "part")
    spot, strike, years, vol = F.lit(100.0), 80.0 + F.col("p_size"), (F.col("p_partkey") % 12 + 1) / 12.0, 0.1 + (F.col("p_partkey") % 7) / 20.0
    call = F.col("p_partkey") % 2 == 0
    g = fin.black_scholes(spot, strike, years, vol, call)
    return p.select("p_partkey", g["price"].alias("price"), g["delta"].alias("delta"), F.round(fin.black_76(spot, strike, vol, years, call), 4).alias("b76"), F.round(fin.prob_above(spot, strike, vol, years), 5).alias("above"), fin.intrinsic(spot, strike, call).alias("intrinsic"), F.round(fin.half_spread(g["price"]), 6).alias("half"))


def fn77_regime(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = s.table(spark, sf_dir, "events").where("value is not null")
    v, spread = F.col("value") % 50, F.col("event_id") % 5 - 2.0
    return e.select("event_id", fin.vix_bucket(v).alias("bucket"), F.round(fin.recession_probability(spread), 5).alias("p"), fin.inverted(v, F.lit(20.0)).alias("term"), fin.position_shares(v * 10, F.when(F.col("event_id") % 3 != 0, F.lit(95.0)), F.lit(300.0)).alias("shares"), fin.structure(F.when(F.col("event_id") % 3 == 0, "bullish").when(F.col("event_id") % 3 == 1, "bearish").otherwise("flat"), v * 2, 1 + (F.col("event_id") % 4) / 20.0).alias("structure"))


def fn80_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = s.table(spark, sf_dir, "lineitem")
    oi, vol = F.col("l_quantity") * 20, F.col("l_extendedprice") / 100
    return li.select("l_orderkey", "l_linenumber", fin.unusual(vol, oi).alias("unusual"), fin.put_call(F.col("l_linenumber"), F.col("l_quantity") % 8).alias("put_call"), fin.liquid_chain(oi, vol).alias("liquid"), F.round(fin.smart_money(F.col("l_tax"), F.col("l_discount"), F.when(F.col("l_tax") > 0.02, F.lit(1.0)), F.lit(0.5)), 6).alias("score"))


def fn81_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = s.table(spark, sf_dir, "events")
    return e.select("event_id", fn.cache_key(F.col("event_type"), F.col("user_id"), F.when(F.col("event_id") % 2 == 0, F.lit("x")), F.lit("m"), F.lit(None), F.lit("1")).alias("key"), fn.content_hash(F.col("event_type")).alias("hash"), fn.token_cost(F.col("event_id"), F.col("user_id"), 3.0, 15.0).alias("cost"))


QUERIES = {k: f for k, f in list(globals().items()) if k[:2] == "fn" and k[2:3].isdigit() and callable(f)}

_ERF = "(1 - ((((1.061405429 * (1 / (1 + 0.3275911 * abs({0}))) - 1.453152027) * (1 / (1 + 0.3275911 * abs({0}))) + 1.421413741) * (1 / (1 + 0.3275911 * abs({0}))) - 0.284496736) * (1 / (1 + 0.3275911 * abs({0}))) + 0.254829592) * (1 / (1 + 0.3275911 * abs({0}))) * exp(-({0}) * ({0})))"


def normal_cdf(x: str) -> str:
    z = f"(({x}) / sqrt(2::DOUBLE))"
    return f"(0.5::DOUBLE * (1 + CASE WHEN {z} < 0 THEN -1 ELSE 1 END * {_ERF.format(z)}))".replace("1.061405429", "1.061405429::DOUBLE").replace("0.3275911", "0.3275911::DOUBLE")


_CUSIP = "list_sum(list_transform(range(1, 9), lambda i: CAST({v} AS INT) * (CASE WHEN i % 2 = 0 THEN 2 ELSE 1 END) // 10 + CAST({v} AS INT) * (CASE WHEN i % 2 = 0 THEN 2 ELSE 1 END) % 10))"
_C1 = _CUSIP.format(v="raw[i]")
_C2 = _CUSIP.format(v="(CASE WHEN i = 1 THEN '36' ELSE raw[i] END)")
ORACLE_SQL = {
    "fn1_identifiers": "SELECT c_custkey, CAST(c_custkey AS VARCHAR) AS bare, c_name AS name, 'T' || c_nationkey || '|U' || c_nationkey AS tickers, lpad(CAST(c_custkey AS VARCHAR), 10, '0') AS cik, 'a' || c_custkey AS accession, 'd:1' AS document FROM customer",
    "fn9_cusip": f"WITH r AS (SELECT o_orderkey, lpad(CAST(o_orderkey * 7919 % 1000000000 AS VARCHAR), 9, '0') AS raw FROM orders) SELECT o_orderkey, (10 - {_C1} % 10) % 10 = CAST(raw[9] AS INT) AS plain, (10 - {_C2} % 10) % 10 = CAST(raw[9] AS INT) AS extra, false AS refused FROM r",
    "fn11_isin": "WITH r AS (SELECT o_orderkey, '3028' || substr(lpad(CAST(o_orderkey * 104729 % 10000000000 AS VARCHAR), 10, '0'), 1, 9) AS d, CAST(o_orderkey * 104729 % 10 AS INT) AS c FROM orders) SELECT o_orderkey, (10 - list_sum(list_transform(range(1, 14), lambda i: CAST(d[14 - i] AS INT) * (CASE WHEN i % 2 = 1 THEN 2 ELSE 1 END) // 10 + CAST(d[14 - i] AS INT) * (CASE WHEN i % 2 = 1 THEN 2 ELSE 1 END) % 10)) % 10) % 10 = c AS valid FROM r",
    "fn6_keys": "SELECT p_partkey, regexp_replace(lower(p_brand), '[^a-z0-9]', '', 'g') AS a, trim(regexp_replace(lower(p_brand), '[^a-z0-9]+', ' ', 'g')) AS w, lower(regexp_replace('netSales' || p_brand, '([a-z0-9])([A-Z])', '\\1 \\2', 'g')) AS c, lower(p_name) AS n, sha1(lower(p_name)) AS h FROM part",
    "fn12_dates": "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS iso, strftime(o_orderdate, '%Y-%m-%d') AS same, year(o_orderdate) || '-Q' || quarter(o_orderdate) AS q, strftime(o_orderdate, '%Y-%m') AS m FROM orders",
    "fn16_numbers": "SELECT o_orderkey, round(o_totalprice * 100) / 100 AS n, CAST(NULL AS DOUBLE) AS none, 3 AS found, true AS states, concat_ws(';', CASE WHEN CAST(o_orderkey AS VARCHAR) NOT LIKE '%7%' THEN '7' END, '1,000') AS ungrounded FROM orders",
    "fn28_periods": "SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 2024 WHEN 1 THEN 2023 WHEN 2 THEN 2025 WHEN 3 THEN 2022 END AS year, CASE o_orderkey % 5 WHEN 0 THEN 'Q3' WHEN 1 THEN 'Q4' WHEN 2 THEN 'FY' WHEN 3 THEN 'FY' END AS kind, year(o_orderdate) AS filed, 'Q' || least(3, (dayofyear(o_orderdate) - 1) // 91 + 1) AS q, o_orderkey % 5 > 0 AS ok FROM orders",
    "fn38_tolerance": "WITH k AS (SELECT o_orderkey, o_orderkey % 90 + 1 AS k FROM orders), b AS (SELECT *, CASE WHEN o_orderkey % 2 = 0 THEN k * 1e6 ELSE k * 1.0::DOUBLE END AS b, CASE WHEN o_orderkey % 2 = 0 THEN k * 1e6 * 2 / 100 ELSE 0.5::DOUBLE END AS d FROM k) SELECT o_orderkey, round(b - d, 4) AS low, round(b + d, 4) AS high, round(b, 4) AS mid, CASE WHEN k % 3 = 1 THEN 'E1' ELSE 'R1,R2' END AS concepts FROM b",
    "fn59_rules": "SELECT l_orderkey, l_linenumber, concat_ws(',', CASE WHEN l_tax > 0.07::DOUBLE THEN 'out_of_bounds' END, CASE WHEN l_discount > 0.08::DOUBLE THEN 'bad_format' END, CASE WHEN l_quantity > 45 THEN 'not_in_document' END) AS flags, CASE WHEN l_discount > 0.08::DOUBLE THEN 'bad_format' WHEN l_quantity > 45 THEN 'not_in_document' WHEN l_tax > 0.07::DOUBLE THEN 'out_of_bounds' WHEN l_linenumber <= 1 THEN 'no_span' END AS withheld, CASE WHEN l_quantity < 3 THEN 'few' WHEN l_tax = 0 THEN 'untaxed' END AS reason, CASE WHEN l_tax * 20 <= 1 THEN l_tax * 20 ELSE -1 END AS conf, l_linenumber < 4 AND 3 < l_linenumber + 2 AS overlap FROM lineitem",
    "fn41_filings": "SELECT o_orderkey, '2.02|' || o_orderkey % 9 || '.01' AS items, concat_ws(',', 'results', CASE WHEN o_orderkey % 9 = 5 THEN 'control' WHEN o_orderkey % 9 = 8 THEN 'other' END) AS events, CASE WHEN o_orderkey % 5 = 0 THEN 2 ELSE o_orderkey % 4 END AS exhibit, CASE o_orderstatus WHEN 'F' THEN 'income' WHEN 'O' THEN 'balance' ELSE 'other' END AS area FROM orders",
    "fn67_options": f"""WITH p AS (SELECT p_partkey, 100::DOUBLE AS s, 80::DOUBLE + p_size AS k, (p_partkey % 12 + 1) / 12::DOUBLE AS t, 0.1::DOUBLE + (p_partkey % 7) / 20::DOUBLE AS v, p_partkey % 2 = 0 AS c FROM part), d AS (SELECT *, v * sqrt(t) AS r, (ln(s / k) + (0.04::DOUBLE + v * v / 2) * t) / (v * sqrt(t)) AS d1, (ln(s / k) + v * v / 2 * t) / (v * sqrt(t)) AS e1, k * exp(-0.04::DOUBLE * t) AS pv FROM p),
 g AS (SELECT *, round(CASE WHEN c THEN s * {normal_cdf('d1')} - pv * {normal_cdf('d1 - r')} ELSE pv * {normal_cdf('r - d1')} - s * {normal_cdf('-d1')} END, 4) AS price FROM d)
 SELECT p_partkey, price, round(CASE WHEN c THEN {normal_cdf('d1')} ELSE {normal_cdf('d1')} - 1 END, 4) AS delta, round(greatest(CASE WHEN c THEN s * {normal_cdf('e1')} - k * {normal_cdf('e1 - r')} ELSE k * {normal_cdf('r - e1')} - s * {normal_cdf('-e1')} END, 0.05), 4) AS b76, round({normal_cdf('e1 - r')}, 5) AS above, greatest(CASE WHEN c THEN s - k ELSE k - s END, 0) AS intrinsic, round(greatest(0.02::DOUBLE, price * 0.04::DOUBLE), 6) AS half FROM g""",
    "fn77_regime": f"""WITH e AS (SELECT event_id, value % 50 AS v, event_id % 5 - 2::DOUBLE AS sp FROM events WHERE value IS NOT NULL) SELECT event_id, CASE WHEN v > 40 THEN 'panic' WHEN v > 30 THEN 'stress' WHEN v >= 20 THEN 'elevated' WHEN v >= 15 THEN 'normal' ELSE 'calm' END AS bucket, round({normal_cdf('-0.5333::DOUBLE - 0.6629::DOUBLE * sp')}, 5) AS p,
 CASE WHEN v / 20 > 1.1::DOUBLE THEN 'deep' WHEN v / 20 > 1 THEN 'inverted' ELSE 'normal' END AS term, CASE WHEN event_id % 3 <> 0 THEN floor(least(v * 10, 95, 300)) END AS shares,
 CASE WHEN 1 + (event_id % 4) / 20.0::DOUBLE >= 1.15::DOUBLE THEN 'collar' WHEN event_id % 3 = 0 THEN CASE WHEN v * 2 >= 50 THEN 'bull_put_spread' ELSE 'call_debit_spread' END WHEN event_id % 3 = 1 THEN CASE WHEN v * 2 >= 50 THEN 'bear_call_spread' ELSE 'put_debit_spread' END WHEN v * 2 >= 50 THEN 'iron_condor' ELSE 'calendar' END AS structure FROM e""",
    "fn80_flow": "SELECT l_orderkey, l_linenumber, l_extendedprice / 100 >= 2 * (l_quantity * 20) AS unusual, CASE WHEN l_linenumber / nullif(l_quantity % 8, 0) >= 1.2::DOUBLE THEN 'fear' WHEN l_linenumber / nullif(l_quantity % 8, 0) <= 0.5 THEN 'greed' WHEN l_quantity % 8 <> 0 THEN 'neutral' END AS put_call, l_quantity * 20 >= 500 AND l_extendedprice / 100 >= 100 AS liquid, round(0.35::DOUBLE * l_tax + 0.3::DOUBLE * l_discount + 0.15::DOUBLE * (CASE WHEN l_tax > 0.02::DOUBLE THEN 1 ELSE 0 END) + 0.1::DOUBLE, 6) AS score FROM lineitem",
    "fn81_keys": "SELECT event_id, sha256(event_type || chr(31) || user_id || chr(31) || CASE WHEN event_id % 2 = 0 THEN 'x' ELSE chr(0) END || chr(31) || 'm' || chr(31) || chr(0) || chr(31) || '1') AS key, substr(sha1(event_type), 1, 10) AS hash, round((event_id * 3.0::DOUBLE + user_id * 15.0::DOUBLE) / 1e6, 6) AS cost FROM events",
}
