"""The library's input shapes made from the tables at hand, in Spark and, for the oracles, in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame, key: str) -> DataFrame:
    """rows by key over four tasks a core at least: a small file, from whose rows long texts are written and read, would be one task's work."""
    spark = rows.sparkSession
    return rows.repartition(max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), key)


#: Rows of a task of a join that is dealt by its larger side's rows.
TASK_ROWS = 500_000


def dealt(larger: DataFrame, key: str, other: DataFrame, other_key: str) -> tuple[DataFrame, DataFrame]:
    """Both sides of a join by key, over so many tasks that one has about TASK_ROWS rows of the larger side, however many rows there are."""
    spark = larger.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-larger.count() // TASK_ROWS))
    return larger.repartition(n, key), other.repartition(n, other_key)


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars of each supplier from unit prices of its line items."""
    li = table(spark, sf_dir, "lineitem")
    li = li.select("l_suppkey", F.to_date("l_shipdate").alias("date"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("px"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("at"), "l_quantity")
    return li.groupBy(F.col("l_suppkey").alias("ticker"), "date").agg(
        F.min_by("px", "at").alias("open"), F.max("px").alias("high"), F.min("px").alias("low"), F.max_by("px", "at").alias("close"), F.sum("l_quantity").alias("volume")
    )


BARS = """b AS (SELECT l_suppkey AS ticker, CAST(l_shipdate AS DATE) AS date, arg_min(l_extendedprice / l_quantity, l_orderkey * 10 + l_linenumber) AS open,
 max(l_extendedprice / l_quantity) AS high, min(l_extendedprice / l_quantity) AS low, arg_max(l_extendedprice / l_quantity, l_orderkey * 10 + l_linenumber) AS close,
 sum(l_quantity) AS volume FROM lineitem GROUP BY 1, 2)"""


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions of yearly facts of each customer: status as concept, later orders of a year as restatements."""
    o = table(spark, sf_dir, "orders")
    year = F.year("o_orderdate")
    return o.select(
        F.lpad(F.col("o_custkey").cast("string"), 10, "0").alias("cik"), F.col("o_orderstatus").alias("concept"), F.concat(year.cast("string"), F.lit("-01-01")).alias("period_start"),
        F.concat(year.cast("string"), F.lit("-12-31")).alias("period_end"), year.alias("fiscal_year"),
        F.format_string("%010d-%02d-%08d", F.col("o_custkey"), F.pmod(year, F.lit(100)), F.col("o_orderkey")).alias("accession"),
        F.col("o_totalprice").alias("value"), F.when(F.col("o_orderkey") % 17 != 0, F.date_format(F.date_add(F.to_date("o_orderdate"), (F.col("o_orderkey") % 60).cast("int")), "yyyy-MM-dd")).alias("filed"),
        F.col("o_orderkey").alias("ingested_seq"),
    )


FACTS = """f AS (SELECT lpad(CAST(o_custkey AS VARCHAR), 10, '0') AS cik, o_orderstatus AS concept, year(o_orderdate) || '-01-01' AS period_start, year(o_orderdate) || '-12-31' AS period_end,
 CAST(year(o_orderdate) AS INT) AS fiscal_year, printf('%010d-%02d-%08d', o_custkey, year(o_orderdate) % 100, o_orderkey) AS accession, o_totalprice AS value,
 CASE WHEN o_orderkey % 17 <> 0 THEN strftime(CAST(o_orderdate AS DATE) + CAST(o_orderkey % 60 AS INT), '%Y-%m-%d') END AS filed, o_orderkey AS ingested_seq FROM orders)"""


def quarters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quarterly totals in cents of each nation."""
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    rows = o.join(c, o["o_custkey"] == c["c_custkey"])
    start = F.to_date(F.date_trunc("quarter", "o_orderdate"))
    return rows.groupBy(F.col("c_nationkey").alias("cik"), start.alias("period_start")).agg(F.sum(F.round(F.col("o_totalprice") * 100).cast("long")).alias("value")).withColumn("period_end", F.date_sub(F.add_months("period_start", 3), 1))


QUARTERS = """q AS (SELECT c_nationkey AS cik, CAST(date_trunc('quarter', o_orderdate) AS DATE) AS period_start, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS value,
 CAST(CAST(date_trunc('quarter', o_orderdate) AS DATE) + INTERVAL 3 MONTH - INTERVAL 1 DAY AS DATE) AS period_end FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2, 4)"""


def extractions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Field rows of documents in runs: lines of orders, the order's priority as run."""
    li, o = dealt(table(spark, sf_dir, "lineitem"), "l_orderkey", table(spark, sf_dir, "orders"), "o_orderkey")
    rows = li.join(o, li["l_orderkey"] == o["o_orderkey"])
    value = F.when(F.col("l_tax") > 0.01, F.col("l_quantity"))
    return rows.select(
        F.col("o_orderpriority").alias("run_id"), F.col("o_orderkey").alias("accession"), F.concat("l_returnflag", "l_linestatus").alias("field"), value.alias("value_num"),
        F.to_date("o_orderdate").alias("day"), F.when(F.col("l_discount") > 0.02, F.col("l_linenumber")).alias("span_start"),
        F.when(F.col("l_tax") >= 0.07, "out_of_bounds").when(F.col("l_discount") >= 0.09, "span_unlocatable").alias("flag"), F.col("o_custkey").alias("issuer"), F.col("l_shipmode" if "l_shipmode" in li.columns else "l_linestatus").alias("product_type"),
    )


EXTRACTIONS = """e AS (SELECT o_orderpriority AS run_id, o_orderkey AS accession, l_returnflag || l_linestatus AS field, CASE WHEN l_tax > 0.01 THEN l_quantity END AS value_num,
 CAST(o_orderdate AS DATE) AS day, CASE WHEN l_discount > 0.02 THEN l_linenumber END AS span_start,
 CASE WHEN l_tax >= 0.07 THEN 'out_of_bounds' WHEN l_discount >= 0.09 THEN 'span_unlocatable' END AS flag, o_custkey AS issuer, l_linestatus AS product_type FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Insider trades: orders with their customers."""
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    shares = F.col("o_orderkey") % 1000 + 1
    return o.join(c, o["o_custkey"] == c["c_custkey"]).select(
        F.col("o_orderkey").alias("filing_id"), F.col("c_nationkey").alias("ticker"), F.col("c_name").alias("insider_name"), F.col("c_mktsegment").alias("insider_title"), F.to_date("o_orderdate").alias("transaction_date"),
        F.when(F.col("o_orderstatus") == "O", "BUY").otherwise("SELL").alias("transaction_type"), shares.alias("shares"), (F.col("o_totalprice") / shares).alias("price_per_share"),
        F.when(F.col("o_orderkey") % 23 == 0, F.col("o_totalprice") * 20).otherwise(F.col("o_totalprice")).alias("total_value"), F.concat(F.when(F.col("o_orderkey") % 2 == 0, F.lit("mirror:")).otherwise(F.lit("")), F.lit("https://example.org/"), F.col("o_orderkey")).alias("source_url"),
    )


TRADES = """t AS (SELECT o_orderkey AS filing_id, c_nationkey AS ticker, c_name AS insider_name, c_mktsegment AS insider_title, CAST(o_orderdate AS DATE) AS transaction_date,
 CASE WHEN o_orderstatus = 'O' THEN 'BUY' ELSE 'SELL' END AS transaction_type, o_orderkey % 1000 + 1 AS shares, o_totalprice / (o_orderkey % 1000 + 1) AS price_per_share,
 CASE WHEN o_orderkey % 23 = 0 THEN o_totalprice * 20 ELSE o_totalprice END AS total_value, CASE WHEN o_orderkey % 2 = 0 THEN 'mirror:' ELSE '' END || 'https://example.org/' || o_orderkey AS source_url
 FROM orders JOIN customer ON o_custkey = c_custkey)"""
