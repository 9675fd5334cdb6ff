"""Queries on term sheets, written from customers and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import key_terms as k
from tidemark.plans import stand_ins as s

SHEET = """concat('Issuer:: ', initcap(c_mktsegment), ' Holdings Inc.\\nGuarantor:: HTC.\\nMaturity Date:: ', date_format(date_add(DATE'2020-01-01', cast(c_custkey % 3000 as int)), 'MMMM d, yyyy'), ', subject to delay. Contingent Coupon Rate:: The rate ',
 CASE c_custkey % 3 WHEN 0 THEN 'will be at least ' WHEN 1 THEN 'is ' ELSE 'is approximately ' END, c_nationkey + 1, '.5% per annum. Downside Threshold Value:: For A, $10, which is equal to ', c_nationkey + 50, '% of its starting value. For B, $20, which is equal to ',
 c_nationkey + CASE WHEN c_custkey % 2 = 0 THEN 50 ELSE 45 END, '% of its starting value. Contingent Coupon:: Paid if the price is at least the downside threshold value. Hypothetical Threshold Price:: 70% of the starting price. ',
 CASE WHEN c_custkey % 5 < 3 THEN concat(initcap(c_mktsegment), ' Trust Corporation (“HTC” or the “Guarantor”) stands behind it.') ELSE '' END)"""
ASSETS = """CASE c_custkey % 3 WHEN 0 THEN concat('Underlyings:: The common stock of ', initcap(c_mktsegment), ' Corporation, par value $0.01 per share (Bloomberg ticker: AB) and the ', initcap(c_mktsegment), ' Index (Bloomberg ticker: CD) (each an “Underlying”)')
 WHEN 1 THEN concat('Underlyings:: Underlying Initial underlying value* Coupon barrier value** ', initcap(c_mktsegment), ' 500® Index ', c_nationkey + 100, '.5 2,103.4 Small Cap Fund 9.25 *For each underlying, its value')
 ELSE 'Underlyings:: whatever the agent says' END"""
SELLERS = """concat('Issuer:: ', initcap(c_mktsegment), ' Finance LLC. Agent:: ', initcap(c_mktsegment), ' Securities, LLC (“BS”), and West & Co. LLC (“WC”). Others wait. ',
 CASE WHEN c_custkey % 2 = 0 THEN concat('Per Security: $1,000.00 up to $', c_nationkey + 1, '.25 $976.75') ELSE concat('The selling commission is $', c_nationkey + 1, '.75 per security.') END)"""


def _sheets(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    return s.spread(s.table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_nationkey"), "c_custkey").selectExpr("c_custkey", f"{text} AS text")


def doc9_key_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each customer's sheet states: a defined guarantor, dates, a rate with its bound, levels that agree."""
    return k.key_terms(_sheets(spark, sf_dir, SHEET), key="c_custkey").select("c_custkey", "field", "text", "number", "bound", "method")


def doc10_underlyings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members of lines with tickers and of tables with levels; lines that name nothing have no row."""
    found = k.key_terms(_sheets(spark, sf_dir, ASSETS), key="c_custkey", fields=["underlyings"])
    return found.select("c_custkey", "method", F.posexplode("names").alias("pos", "name"))


def doc12_sellers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Selling agents, and the commission in per cent with its bound."""
    found = k.key_terms(_sheets(spark, sf_dir, SELLERS), key="c_custkey", fields=["selling_agents", "agent_commission_pct"])
    return found.select("c_custkey", "field", F.array_join("names", "; ").alias("names"), "number", "bound")


def doc8_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every label run of the sheets with its place, labels amid a line too."""
    return k.terms(_sheets(spark, sf_dir, SELLERS), key="c_custkey").select("c_custkey", "label", F.col("start").cast("long").alias("start"), F.length("value").cast("long").alias("letters"))


QUERIES = {"doc9_key_terms": doc9_key_terms, "doc10_underlyings": doc10_underlyings, "doc12_sellers": doc12_sellers, "doc8_runs": doc8_runs}

_SEGMENT = "upper(c_mktsegment[1]) || lower(c_mktsegment[2:])"
_KEYED = f"WITH c AS (SELECT c_custkey, c_nationkey AS n, {_SEGMENT} AS seg, CAST(DATE '2020-01-01' + CAST(c_custkey % 3000 AS INTEGER) AS DATE) AS d FROM customer)"
ORACLE_SQL = {
    "doc9_key_terms": f"""{_KEYED}
        SELECT c_custkey, 'issuer' AS field, seg || ' Holdings Inc.' AS text, NULL::DOUBLE AS number, NULL::VARCHAR AS bound, 'term' AS method FROM c
        UNION ALL SELECT c_custkey, 'guarantor', seg || ' Trust Corporation', NULL, NULL, 'term+defined' FROM c WHERE c_custkey % 5 < 3
        UNION ALL SELECT c_custkey, 'maturity_date', strftime(d, '%Y-%m-%d'), NULL, NULL, 'term' FROM c
        UNION ALL SELECT c_custkey, 'contingent_coupon_rate', NULL, n + 1.5, CASE WHEN c_custkey % 3 = 0 THEN 'min' END, 'term' FROM c WHERE c_custkey % 3 < 2
        UNION ALL SELECT c_custkey, 'barrier_pct', NULL, n + 50, NULL, 'term' FROM c WHERE c_custkey % 2 = 0
        UNION ALL SELECT c_custkey, 'coupon_barrier_pct', NULL, n + 50, NULL, 'term-shared' FROM c WHERE c_custkey % 2 = 0""",
    "doc10_underlyings": f"""{_KEYED}
        SELECT c_custkey, 'term' AS method, 0 AS pos, seg || ' Corporation' AS name FROM c WHERE c_custkey % 3 = 0 UNION ALL SELECT c_custkey, 'term', 1, seg || ' Index' FROM c WHERE c_custkey % 3 = 0
        UNION ALL SELECT c_custkey, 'term-table', 0, seg || ' 500® Index' FROM c WHERE c_custkey % 3 = 1 UNION ALL SELECT c_custkey, 'term-table', 1, 'Small Cap Fund' FROM c WHERE c_custkey % 3 = 1""",
    "doc12_sellers": f"""{_KEYED}
        SELECT c_custkey, 'selling_agents' AS field, seg || ' Securities, LLC; West & Co. LLC' AS names, NULL::DOUBLE AS number, NULL::VARCHAR AS bound FROM c
        UNION ALL SELECT c_custkey, 'agent_commission_pct', NULL, round((n + CASE WHEN c_custkey % 2 = 0 THEN 1.25 ELSE 1.75 END) / 10, 6), CASE WHEN c_custkey % 2 = 0 THEN 'max' END FROM c""",
    "doc8_runs": f"""{_KEYED},
        t AS (SELECT c_custkey, length(seg) AS l, CASE WHEN c_custkey % 2 = 0 THEN 'Per Security: $1,000.00 up to $' || (n + 1) || '.25 $976.75' ELSE 'The selling commission is $' || (n + 1) || '.75 per security.' END AS last FROM c)
        SELECT c_custkey, 'issuer' AS label, 9 AS start, l + 13 AS letters FROM t
        UNION ALL SELECT c_custkey, 'agent', l + 31, l + length(' Securities, LLC (“BS”), and West & Co. LLC (“WC”). Others wait. ') + length(last) FROM t""",
}
