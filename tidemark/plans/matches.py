"""Queries that join by time, interval, nearness, names and identifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import joins as j
from tidemark.operators import windows as w
from tidemark.plans import stand_ins as s


def _prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s.table(spark, sf_dir, "events").where("value is not null").select(F.col("user_id").alias("k"), F.col("ts").alias("rt"), F.col("value").alias("px"))


def _notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s.table(spark, sf_dir, "events").select(F.col("event_id").alias("note"), F.col("user_id").alias("k"), F.col("ts").alias("lt"))


def join7_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last value of a user up to each event, taken as a note."""
    return j.asof(_notes(spark, sf_dir), _prices(spark, sf_dir), "k", "lt", "rt", ["px"]).select("note", "px")


def join7_asof_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return j.asof(_notes(spark, sf_dir), _prices(spark, sf_dir), "k", "lt", "rt", ["px"], strict=True).select("note", "px")


def join18_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    return j.asof(_notes(spark, sf_dir), _prices(spark, sf_dir), "k", "lt", "rt", ["px"], forward=True).select("note", "px")


def join8_vol_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Close and trailing deviation of the supplier's bar on or before each order line's receipt less three days, taken as a note's date."""
    bars = s.bars(spark, sf_dir).withColumn("lret", F.log(F.col("close") / F.lag("close", 1).over(w.series())))
    states = bars.select(F.col("ticker").alias("k"), F.col("date").alias("rt"), "close", w.annual_vol(20).alias("v20"))
    notes = s.table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_suppkey").alias("k"), F.date_add(F.to_date("l_shipdate"), -3).alias("lt"))
    out = j.asof(notes, states, "k", "lt", "rt", ["close", "v20"])
    return out.select("l_orderkey", "close", "v20")


def join13_unpriced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers without an order, counted by nation."""
    c, o = s.table(spark, sf_dir, "customer"), s.table(spark, sf_dir, "orders")
    missing = j.lookup(c.withColumnRenamed("c_custkey", "k"), o.select(F.col("o_custkey").alias("k"), "o_orderkey"), "k", "o_orderkey")[1]
    return missing.groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n"))


def join17_contained(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items shipped inside their order's ninety days."""
    li = s.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), "l_linenumber", F.to_date("l_shipdate").alias("s"), F.date_add(F.to_date("l_shipdate"), 10).alias("e"))
    o = s.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.to_date("o_orderdate").alias("os"), F.date_add(F.to_date("o_orderdate"), 90).alias("oe"))
    return j.contained(li, o, "k").select("k", "l_linenumber", "s", "oe")


def join18_calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Months in which every nation has an order."""
    t = s.trades(spark, sf_dir).withColumn("date", F.trunc("transaction_date", "month"))
    return j.common_dates(t)


def join19_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of odd key matched to the nearest ones of even key by size and price, both scaled."""
    p = s.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("pos"), (F.col("p_size") / 10.0).alias("a"), F.round(F.col("p_retailprice") / 500.0, 3).alias("b"))
    out = j.nearest(p.where("pos % 2 = 1"), p.where("pos % 2 = 0"), ["a", "b"])
    # Which of two controls at one distance counts hangs on the last bit of the means, so distances are shown.
    return out.select("t", F.round("dist", 6).alias("dist"))


def join21_carried(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = s.table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("ticker"), F.to_date("ts").alias("date")).agg(F.max(F.when(F.col("event_type") == "purchase", F.col("value"))).alias("v"))
    return j.carried(e, "v")


def join25_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = s.table(spark, sf_dir, "nation")
    tokens = s.table(spark, sf_dir, "customer").select("c_custkey", (F.col("c_nationkey") * 2).alias("n_nationkey"))
    found, missing = j.lookup(tokens, n, "n_nationkey", "n_name")
    return found.select("c_custkey", "n_name").unionByName(missing.select("c_custkey", F.lit(None).cast("string").alias("n_name")))


def join29_reconciled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts against a copy with the words of names turned round and some prices moved."""
    p = s.table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_retailprice")
    other = p.select("p_partkey", F.array_join(F.reverse(F.split("p_name", " ")), " ").alias("p_name"), (F.col("p_retailprice") + F.when(F.col("p_partkey") % 3 == 0, 5.0).otherwise(0.001)).alias("p_retailprice"))
    return j.reconciled(p, other, ["p_partkey"], "p_name", "p_retailprice").select("p_partkey")


def join31_dangling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line suppliers of orders that aren't among the first half of suppliers."""
    li = s.table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_suppkey").alias("tools"))
    sup = s.table(spark, sf_dir, "supplier").where("s_suppkey % 2 = 0")
    return j.dangling(li, "tools", sup, "s_suppkey").select("l_orderkey", "member")


def join3_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest order of each customer by (date, key)."""
    o = s.table(spark, sf_dir, "orders")
    return o.groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("latest"))


def join5_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Priorities of orders, customers of held-out nations left out."""
    c, o = s.table(spark, sf_dir, "customer"), s.table(spark, sf_dir, "orders")
    held = c.where("c_nationkey % 4 = 1").select(F.col("c_custkey").alias("o_custkey"))
    return o.join(held, "o_custkey", "left_anti").groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"))


QUERIES = {f.__name__: f for f in (join7_asof, join7_asof_strict, join18_forward, join8_vol_at, join13_unpriced, join17_contained, join18_calendar, join19_nearest, join21_carried, join25_lookup, join29_reconciled, join31_dangling, join3_runs, join5_anchors)}

_N = "n AS (SELECT event_id AS note, user_id AS k, ts AS lt FROM events), r AS (SELECT user_id AS k, ts AS rt, max(value) AS px FROM events WHERE value IS NOT NULL GROUP BY 1, 2)"
ORACLE_SQL = {
    "join7_asof": f"WITH {_N} SELECT note, px FROM n ASOF LEFT JOIN r ON n.k = r.k AND n.lt >= r.rt",
    "join7_asof_strict": f"WITH {_N} SELECT note, px FROM n ASOF LEFT JOIN r ON n.k = r.k AND n.lt > r.rt",
    "join18_forward": f"WITH {_N} SELECT note, px FROM n ASOF LEFT JOIN r ON n.k = r.k AND n.lt <= r.rt",
    "join8_vol_at": f"""WITH {s.BARS}, l AS (SELECT *, ln(close / lag(close) OVER (PARTITION BY ticker ORDER BY date)) AS lret FROM b), st AS (SELECT ticker, date, close, CASE WHEN count(lret) OVER w = 20 THEN round(stddev_samp(lret) OVER w * sqrt(252) * 100, 4) END AS v20 FROM l WINDOW w AS (PARTITION BY ticker ORDER BY date ROWS 19 PRECEDING)),
 n AS (SELECT l_orderkey, l_suppkey AS k, CAST(l_shipdate AS DATE) - 3 AS lt FROM lineitem) SELECT l_orderkey, close, v20 FROM n ASOF LEFT JOIN st ON n.k = st.ticker AND n.lt >= st.date""",
    "join13_unpriced": "SELECT c_nationkey, count(*) AS n FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders) GROUP BY 1",
    "join17_contained": "SELECT l_orderkey AS k, l_linenumber, CAST(l_shipdate AS DATE) AS s, CAST(o_orderdate AS DATE) + 90 AS oe FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE CAST(l_shipdate AS DATE) >= CAST(o_orderdate AS DATE) AND CAST(l_shipdate AS DATE) + 10 <= CAST(o_orderdate AS DATE) + 90",
    "join18_calendar": f"WITH {s.TRADES} SELECT CAST(date_trunc('month', transaction_date) AS DATE) AS date FROM t GROUP BY 1 HAVING count(DISTINCT ticker) = (SELECT count(DISTINCT ticker) FROM t)",
    "join19_nearest": """WITH r AS (SELECT p_partkey AS pos, p_size / 10.0::DOUBLE AS a, round(p_retailprice / 500.0::DOUBLE, 3) AS b FROM part),
 p AS (SELECT pos, (a - (SELECT avg(a) FROM r)) / (SELECT stddev_samp(a) FROM r) AS a, (b - (SELECT avg(b) FROM r)) / (SELECT stddev_samp(b) FROM r) AS b FROM r),
 d AS (SELECT t.pos AS t, c.pos AS c, sqrt((t.a - c.a) ** 2 + (t.b - c.b) ** 2) AS dist FROM p t JOIN p c ON t.pos % 2 = 1 AND c.pos % 2 = 0 AND abs(t.a - c.a) <= 0.25)
 SELECT t, round(dist, 6) AS dist FROM d WHERE dist <= 0.25 QUALIFY row_number() OVER (PARTITION BY t ORDER BY dist, c) = 1""",
    "join21_carried": """WITH e AS (SELECT user_id AS ticker, CAST(ts AS DATE) AS date, max(CASE WHEN event_type = 'purchase' THEN value END) AS v FROM events GROUP BY 1, 2) SELECT ticker, date, last_value(v IGNORE NULLS) OVER (PARTITION BY ticker ORDER BY date) AS v FROM e""",
    "join25_lookup": "SELECT c_custkey, n_name FROM customer LEFT JOIN nation ON c_nationkey * 2 = n_nationkey",
    "join29_reconciled": "SELECT p_partkey FROM part WHERE p_partkey % 3 <> 0",
    "join31_dangling": "SELECT DISTINCT l_orderkey, l_suppkey AS member FROM lineitem WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_suppkey % 2 = 0)",
    "join3_runs": "SELECT o_custkey, o_orderkey AS latest FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1",
    "join5_anchors": "SELECT o_orderpriority, count(*) AS n FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey % 4 = 1) GROUP BY 1",
}
