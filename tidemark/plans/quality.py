"""Queries on extraction quality, insider trades, samples, sorts and sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import insider, quality as q
from tidemark.plans import stand_ins as s

RUNS = ("1-URGENT", "2-HIGH")


def agg1_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return q.daily(s.extractions(spark, sf_dir))


def agg2_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return q.coverage(s.extractions(spark, sf_dir))


def agg4_field_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return q.field_stats(s.extractions(spark, sf_dir), RUNS[0])


def agg5_dominant(spark: SparkSession, sf_dir: str) -> DataFrame:
    return q.dominant(s.extractions(spark, sf_dir))


def agg7_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = s.extractions(spark, sf_dir)
    return q.comparison(q.field_stats(e, RUNS[0]), q.field_stats(e.where("field <> 'AF'"), RUNS[1]))


def agg8_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return q.values_by_run(s.extractions(spark, sf_dir), "NO", RUNS)


def agg10_issuance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order prices split over the suppliers' nations of their lines."""
    li, o, sup = (s.table(spark, sf_dir, t) for t in ("lineitem", "orders", "supplier"))
    names = li.join(sup, li["l_suppkey"] == sup["s_suppkey"]).groupBy("l_orderkey").agg(F.array_distinct(F.collect_list("s_nationkey")).alias("names"))
    docs = o.join(names, o["o_orderkey"] == names["l_orderkey"]).select("names", F.date_format("o_orderdate", "yyyy-MM").alias("month"), F.col("o_totalprice").alias("amount"))
    out = q.issuance(docs, 3)
    return out.select("month", "name", F.round("amount", 2).alias("amount"))


def agg11_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return q.buckets(s.table(spark, sf_dir, "lineitem").select(F.col("l_quantity").alias("barrier"), (F.col("l_extendedprice") / 1000).alias("coupon"), (F.col("l_linenumber") * -2.5).alias("buffer")), ["barrier", "coupon", "buffer"])


def agg12_league(spark: SparkSession, sf_dir: str) -> DataFrame:
    li, o = s.table(spark, sf_dir, "lineitem"), s.table(spark, sf_dir, "orders")
    rows = li.join(o, li["l_orderkey"] == o["o_orderkey"]).select(F.col("o_custkey").alias("issuer"), F.col("l_returnflag").alias("product_type"), (F.col("l_tax") * 100).alias("markup"), F.round(F.col("l_extendedprice") * 100).cast("long").alias("principal"), F.date_format("o_orderdate", "yyyy-MM").alias("month"))
    return q.league(rows)


def agg13_sellers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return insider.sellers(s.trades(spark, sf_dir))


def agg13_top_buys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return insider.top_buys(s.trades(spark, sf_dir)).select("filing_id", "ticker", "total_value")


def _predicted(spark: SparkSession, sf_dir: str, least: int) -> DataFrame:
    """Quality labels against a rule on length; the gold of unlabelled documents is absent."""
    d, l = s.table(spark, sf_dir, "documents"), s.table(spark, sf_dir, "labels")
    return d.join(l, "doc_id", "left").select(F.col("lang").alias("field"), F.col("quality").alias("gold"), F.when(F.col("n_chars") > 200, F.when(F.col("n_chars") > least, 1).otherwise(0)).alias("pred"))


def agg20_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return q.confusion(_predicted(spark, sf_dir, 1000))


def agg23_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    cand = q.confusion(_predicted(spark, sf_dir, 2500)).where("field <> 'de'")
    return q.gate(q.confusion(_predicted(spark, sf_dir, 1000)), cand, {"precision": 0.01, "recall": 0.02})


def agg24_stratified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many of each stratum a sample of 60 customers has: at least 5, then in turn."""
    return q.stratified(s.table(spark, sf_dir, "customer"), "c_mktsegment", "c_custkey", 5, 60, "s").groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"))


def agg25_tallies(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = s.extractions(spark, sf_dir).where("field <> 'RF'").select("field", F.col("flag").alias("verdict"))
    return q.tallies(v, s.extractions(spark, sf_dir), ["out_of_bounds", "span_unlocatable"])


def agg26_fatigue(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = s.table(spark, sf_dir, "events").select(F.col("user_id").alias("session"), F.col("event_id").alias("seq"), (F.col("event_type") == "click").alias("accept"))
    out = q.fatigue(e)
    return out.select("session", F.round("delta", 6).alias("delta"))


def agg28_timing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return q.timing(s.table(spark, sf_dir, "events").select(F.col("user_id").alias("doc"), "ts"))


def agg33_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return q.shares(s.extractions(spark, sf_dir), "flag", ["out_of_bounds", "span_unlocatable", "model"])


def agg35_roll_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = s.extractions(spark, sf_dir)
    return e.agg(F.countDistinct("accession").alias("docs"), F.countDistinct("issuer").alias("issuers"), F.min("day").alias("first"), F.max("day").alias("last"), F.count("value_num").alias("values"), F.round(F.count("value_num") / F.count(F.lit(1)), 4).alias("usable"))


def agg43_anchor(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = s.extractions(spark, sf_dir).select("issuer", "field", F.col("span_start").alias("anchor")).where("anchor is not null")
    decided = e.where("issuer % 3 = 0").select("issuer", "field").distinct()
    return q.modal_anchor(e, decided, 2, 0.4)


def agg47_magnet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By part type: totals of both flags and the size with most quantity."""
    li, p = s.table(spark, sf_dir, "lineitem"), s.table(spark, sf_dir, "part")
    rows = li.join(p, li["l_partkey"] == p["p_partkey"])
    by_strike = rows.groupBy("p_brand", "p_size").agg(F.sum("l_quantity").alias("oi"), F.sum(F.when(F.col("l_returnflag") == "R", F.col("l_quantity")).otherwise(0.0)).alias("puts"))
    return by_strike.groupBy("p_brand").agg(F.sum("oi").alias("oi"), F.sum("puts").alias("puts"), F.max_by("p_size", F.struct("oi", F.col("p_size") * -1)).alias("magnet"))


def filt1_matching(spark: SparkSession, sf_dir: str) -> DataFrame:
    cond = insider.matching(start="1994-01-01", end="1997-12-31", types=["buy"], name="00", roles=["auto", "BUILD"], least=50_000)
    return insider.rows(s.trades(spark, sf_dir), cond, show_suspects=True).select("filing_id", "sec_url", "suspect")


def filt4_plausible(spark: SparkSession, sf_dir: str) -> DataFrame:
    return insider.rows(s.trades(spark, sf_dir), insider.matching()).groupBy("ticker").agg(F.count(F.lit(1)).alias("n"))


def filt6_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return insider.page(insider.rows(s.trades(spark, sf_dir), insider.matching(types=["SELL"])), by="total_value", limit=50, offset=20).select("filing_id", "total_value")


def filt8_filers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s.facts(spark, sf_dir).groupBy("cik").agg(F.count(F.lit(1)).alias("n"))


def filt19_warm(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = s.bars(spark, sf_dir).groupBy("ticker").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("state", F.when(F.col("n") < 126, "percentile_warming").when(F.col("n") < 252, "rank_warming").otherwise("ready"))


def sort5_exemplars(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = s.table(spark, sf_dir, "events").select(F.col("user_id").alias("field"), F.col("event_id").alias("seq"), (F.col("event_id") % 7).alias("anchor"), (F.col("event_id") % 2).alias("kind"), F.when(F.col("event_id") % 5 == 0, "reject").when(F.col("event_id") % 3 == 0, "correct").otherwise("accept").alias("verdict"))
    return q.exemplars(e, ["field"], 4)


def sort10_per_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = s.table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("day"), F.col("o_orderkey").alias("id"))
    return q.per_day_sample(o, 2, 30).select("day", "id")


def sort11_top_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = s.table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey")
    return q.top_up(o, o.where("o_orderkey % 4 = 0"), ["o_custkey"], "o_orderkey", 3).select("o_custkey", "o_orderkey", "rn")


def sort12_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row of each third of each month's orders."""
    from pyspark.sql import window as W

    o = s.table(spark, sf_dir, "orders").select(F.trunc("o_orderdate", "month").alias("month"), "o_orderkey")
    w = W.Window.partitionBy("month").orderBy("o_orderkey")
    t = o.withColumn("slice", F.ntile(3).over(w))
    return t.groupBy("month", "slice").agg(F.min("o_orderkey").alias("o_orderkey"))


def set2_new_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = s.table(spark, sf_dir, "orders")
    return o.where("year(o_orderdate) = 1997").select("o_custkey").distinct().join(o.where("year(o_orderdate) = 1996").select("o_custkey").distinct(), "o_custkey", "left_anti")


def set7_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = s.table(spark, sf_dir, "orders")
    a, b = o.where("o_orderkey % 2 = 0").select("o_custkey"), o.where("o_orderkey % 3 = 0").select("o_custkey")
    return a.unionByName(b).distinct().join(o.where("o_orderkey % 11 = 0").select("o_custkey").distinct(), "o_custkey", "left_anti")


def set10_weekdays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weekdays from first to last order, with the orders of each."""
    o = s.table(spark, sf_dir, "orders").groupBy(F.to_date("o_orderdate").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    ends = o.agg(F.min("day").alias("a"), F.max("day").alias("b"))
    days = ends.select(F.explode(F.sequence("a", "b")).alias("day")).where(F.weekday("day") < 5)
    return days.join(o, "day", "left").select("day", F.coalesce("n", F.lit(0)).alias("n"))


def set12_weeks(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = s.table(spark, sf_dir, "orders")
    return o.groupBy(F.to_date(F.date_trunc("week", "o_orderdate")).alias("week")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("week")).limit(4)


QUERIES = {k: f for k, f in list(globals().items()) if k.split("_")[0].rstrip("0123456789") in ("agg", "filt", "sort", "set") and callable(f)}

C = "count(*) FILTER (WHERE "
_STATS = "field, count(*) AS n, count(value_num) AS present, count(span_start) AS spanned, count(DISTINCT value_num) AS distinct_values, count(flag) AS flagged FROM e"
_PRED = "p{0} AS (SELECT lang AS field, quality AS gold, CASE WHEN n_chars > 200 THEN CASE WHEN n_chars > {1} THEN 1 ELSE 0 END END AS pred FROM documents LEFT JOIN labels USING (doc_id)), c{0} AS (SELECT field, count(*) FILTER (WHERE pred = gold) AS tp, count(*) FILTER (WHERE pred IS NOT NULL AND (gold IS NULL OR pred <> gold)) AS fp, count(*) FILTER (WHERE gold IS NOT NULL AND (pred IS NULL OR pred <> gold)) AS fn, count(*) FILTER (WHERE pred IS NULL AND gold IS NULL) AS tn, count(*) FILTER (WHERE pred IS NOT NULL AND gold IS NULL) AS absence_fp, count(*) FILTER (WHERE gold IS NULL) AS absent FROM p{0} GROUP BY 1), r{0} AS (SELECT *, round(tp / nullif(tp + fp, 0), 6) AS precision, round(tp / nullif(tp + fn, 0), 6) AS recall, round(absence_fp / nullif(absent, 0), 6) AS absence_fp_rate FROM c{0})"
_SUSPECT = "(price_per_share > 100000 OR total_value > 5e9 OR (total_value > 0 AND price_per_share * shares > 0 AND (total_value / (price_per_share * shares) > 10 OR total_value / (price_per_share * shares) < 0.1)))"
ORACLE_SQL = {
    "agg1_daily": f"WITH {s.EXTRACTIONS} SELECT day, field, count(*) AS n, round(avg(value_num), 4) AS mean, min(value_num) AS least, max(value_num) AS greatest, count(DISTINCT accession) AS docs FROM e WHERE value_num IS NOT NULL GROUP BY 1, 2",
    "agg2_coverage": f"WITH {s.EXTRACTIONS}, c AS (SELECT field, count(*) AS attempts, count(value_num) AS got, count(span_start) AS located, {C}flag ILIKE '%unlocatable%') AS absent, count(DISTINCT accession) AS docs FROM e GROUP BY 1) SELECT *, round(got / nullif(greatest(0, attempts - absent), 0), 4) AS got_rate, round(located / nullif(greatest(0, attempts - absent), 0), 4) AS located_rate FROM c",
    "agg4_field_stats": f"WITH {s.EXTRACTIONS} SELECT {_STATS} WHERE run_id = '1-URGENT' GROUP BY 1",
    "agg5_dominant": f"WITH {s.EXTRACTIONS}, c AS (SELECT field, value_num, count(*) AS c FROM e GROUP BY 1, 2), n AS (SELECT field, sum(c) AS n FROM c GROUP BY 1) SELECT field, value_num, round(c / n, 4) AS share, c / n >= 0.6 AS dominated FROM c JOIN n USING (field) WHERE value_num IS NOT NULL QUALIFY row_number() OVER (PARTITION BY field ORDER BY c DESC, value_num) = 1",
    "agg7_comparison": f"WITH {s.EXTRACTIONS}, a AS (SELECT {_STATS} WHERE run_id = '1-URGENT' GROUP BY 1), b AS (SELECT {_STATS} WHERE run_id = '2-HIGH' AND field <> 'AF' GROUP BY 1) SELECT field, " + ", ".join(f"coalesce({x}.{c}, 0) AS {c}_{x}" for c in ("n", "present", "spanned", "distinct_values", "flagged") for x in "ab") + " FROM a FULL JOIN b USING (field)",
    "agg8_values": f"WITH {s.EXTRACTIONS} SELECT value_num, {C}run_id = '1-URGENT') AS run_0, {C}run_id = '2-HIGH') AS run_1, count(*) AS total FROM e WHERE field = 'NO' GROUP BY 1",
    "agg10_issuance": """WITH n AS (SELECT DISTINCT l_orderkey, s_nationkey FROM lineitem JOIN supplier ON l_suppkey = s_suppkey), p AS (SELECT strftime(o_orderdate, '%Y-%m') AS month, CAST(s_nationkey AS VARCHAR) AS name, o_totalprice / count(*) OVER (PARTITION BY o_orderkey) AS part FROM n JOIN orders ON l_orderkey = o_orderkey),
 t AS (SELECT name FROM p GROUP BY 1 ORDER BY sum(part) DESC, CAST(name AS INT) LIMIT 3) SELECT month, CASE WHEN name IN (SELECT name FROM t) THEN name ELSE 'Other' END AS name, round(sum(part), 2) AS amount FROM p GROUP BY 1, 2""",
    "agg11_buckets": "WITH l AS (SELECT 'barrier' AS kind, l_quantity AS v FROM lineitem UNION ALL SELECT 'coupon', l_extendedprice / 1000 FROM lineitem UNION ALL SELECT 'buffer', l_linenumber * -2.5::DOUBLE FROM lineitem) SELECT kind, round_even(abs(v) / 5, 0) * 5 AS bucket, count(*) AS n FROM l GROUP BY 1, 2",
    "agg12_league": "SELECT o_custkey AS issuer, l_returnflag AS product_type, round(avg(l_tax * 100), 6) AS markup, sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS principal, min(strftime(o_orderdate, '%Y-%m')) AS first, max(strftime(o_orderdate, '%Y-%m')) AS last FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2",
    "agg13_sellers": f"WITH {s.TRADES} SELECT ticker, sum(CAST(round(total_value * 100) AS BIGINT)) AS cents, count(*) AS n, count(DISTINCT insider_name) AS insiders FROM t WHERE transaction_type = 'SELL' GROUP BY 1 ORDER BY cents DESC, ticker LIMIT 25",
    "agg13_top_buys": f"WITH {s.TRADES} SELECT filing_id, ticker, total_value FROM t WHERE transaction_type = 'BUY' ORDER BY total_value DESC, filing_id LIMIT 25",
    "agg20_confusion": f"WITH {_PRED.format('a', 1000)} SELECT * FROM ra",
    "agg23_gate": f"WITH {_PRED.format('a', 1000)}, {_PRED.format('b', 2500)}, j AS (SELECT a.field, a.tp + a.fn AS n, b.field AS bf, a.precision AS ap, b.precision AS bp, a.recall AS ar, b.recall AS br FROM ra a LEFT JOIN rb b ON a.field = b.field AND b.field <> 'de') SELECT field, 'precision' AS metric, round(bp - ap, 6) AS delta, CASE WHEN bf IS NULL THEN true WHEN n < 5 THEN false ELSE coalesce(bp - ap < -0.01, false) END AS blocked FROM j UNION ALL SELECT field, 'recall', round(br - ar, 6), CASE WHEN bf IS NULL THEN true WHEN n < 5 THEN false ELSE coalesce(br - ar < -0.02, false) END FROM j",
    "agg24_stratified": "SELECT c_mktsegment, 12 AS n FROM customer GROUP BY 1",
    "agg25_tallies": f"WITH {s.EXTRACTIONS} SELECT field, {C}field <> 'RF' AND flag = 'out_of_bounds') AS out_of_bounds, {C}field <> 'RF' AND flag = 'span_unlocatable') AS span_unlocatable FROM e GROUP BY 1",
    "agg26_fatigue": "WITH r AS (SELECT user_id AS session, event_type = 'click' AS a, row_number() OVER (PARTITION BY user_id ORDER BY event_id) <= count(*) OVER (PARTITION BY user_id) // 2 AS f FROM events) SELECT session, round(avg(CASE WHEN NOT f THEN a::INT END) - avg(CASE WHEN f THEN a::INT END), 6) AS delta FROM r GROUP BY 1",
    "agg28_timing": "WITH d AS (SELECT user_id, epoch_us(max(ts)) - epoch_us(min(ts)) AS d FROM events GROUP BY 1) SELECT round(quantile_cont(d, 0.5) / 1e6, 3) AS median_s, round(avg(d) / 1e6, 3) AS mean_s, count(*) AS docs FROM d WHERE d > 0",
    "agg33_shares": f"WITH {s.EXTRACTIONS} SELECT k AS kind, round((SELECT {C}flag = k) / count(*) FROM e), 4) AS share FROM (VALUES ('out_of_bounds'), ('span_unlocatable'), ('model')) v(k)",
    "agg35_roll_up": f"WITH {s.EXTRACTIONS} SELECT count(DISTINCT accession) AS docs, count(DISTINCT issuer) AS issuers, min(day) AS first, max(day) AS last, count(value_num) AS \"values\", round(count(value_num) / count(*), 4) AS usable FROM e",
    "agg43_anchor": f"WITH {s.EXTRACTIONS}, c AS (SELECT issuer, field, span_start AS anchor, count(*) AS c, sum(count(*)) OVER (PARTITION BY issuer, field) AS n FROM e WHERE span_start IS NOT NULL AND issuer % 3 <> 0 GROUP BY 1, 2, 3) SELECT issuer, field, anchor, c FROM (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY issuer, field ORDER BY c DESC, anchor DESC) = 1) WHERE c >= 2 AND c / n >= 0.4",
    "agg47_magnet": "WITH k AS (SELECT p_brand, p_size, sum(l_quantity) AS oi, sum(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END) AS puts FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2), m AS (SELECT p_brand, p_size FROM k QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY oi DESC, p_size) = 1) SELECT k.p_brand, sum(oi) AS oi, sum(puts) AS puts, any_value(m.p_size) AS magnet FROM k JOIN m ON k.p_brand = m.p_brand GROUP BY 1",
    "filt1_matching": f"WITH {s.TRADES} SELECT filing_id, replace(source_url, 'mirror:', '') AS sec_url, {_SUSPECT} AS suspect FROM t WHERE transaction_date BETWEEN '1994-01-01' AND '1997-12-31' AND transaction_type = 'BUY' AND insider_name ILIKE '%00%' AND (insider_title ILIKE '%auto%' OR insider_title ILIKE '%build%') AND total_value >= 50000",
    "filt4_plausible": f"WITH {s.TRADES} SELECT ticker, count(*) AS n FROM t WHERE NOT {_SUSPECT} GROUP BY 1",
    "filt6_page": f"WITH {s.TRADES} SELECT filing_id, total_value FROM t WHERE NOT {_SUSPECT} AND transaction_type = 'SELL' ORDER BY total_value DESC, filing_id LIMIT 50 OFFSET 20",
    "filt8_filers": f"WITH {s.FACTS} SELECT cik, count(*) AS n FROM f GROUP BY 1",
    "filt19_warm": f"WITH {s.BARS} SELECT ticker, count(*) AS n, CASE WHEN count(*) < 126 THEN 'percentile_warming' WHEN count(*) < 252 THEN 'rank_warming' ELSE 'ready' END AS state FROM b GROUP BY 1",
    "sort5_exemplars": """WITH e AS (SELECT user_id AS field, event_id AS seq, event_id % 7 AS anchor, event_id % 2 AS kind, CASE WHEN event_id % 5 = 0 THEN 'reject' WHEN event_id % 3 = 0 THEN 'correct' ELSE 'accept' END AS verdict FROM events), b AS (SELECT * FROM e WHERE verdict = 'reject' QUALIFY row_number() OVER (PARTITION BY field ORDER BY seq) = 1),
 g AS (SELECT * FROM e WHERE verdict <> 'reject' QUALIFY row_number() OVER (PARTITION BY field, anchor, kind ORDER BY verdict = 'accept', seq) = 1), p AS (SELECT *, row_number() OVER (PARTITION BY field ORDER BY verdict = 'accept', seq) AS k FROM g)
 SELECT field, seq, anchor, kind, verdict FROM p WHERE k <= 4 - CASE WHEN field IN (SELECT field FROM b) THEN 1 ELSE 0 END UNION ALL SELECT * FROM b""",
    "sort10_per_day": "WITH o AS (SELECT CAST(o_orderdate AS DATE) AS day, o_orderkey AS id FROM orders WHERE isodow(o_orderdate) < 6) SELECT day, id FROM o WHERE day IN (SELECT DISTINCT day FROM o ORDER BY day DESC LIMIT 30) QUALIFY row_number() OVER (PARTITION BY day ORDER BY id) <= 2",
    "sort11_top_up": "WITH i AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS i, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders), r AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY i * 7919 % n, i) AS rn FROM i WHERE o_orderkey % 4 <> 0) SELECT * FROM r WHERE rn <= 3",
    "sort12_spread": "WITH t AS (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS month, o_orderkey, ntile(3) OVER (PARTITION BY date_trunc('month', o_orderdate) ORDER BY o_orderkey) AS slice FROM orders) SELECT month, slice, min(o_orderkey) AS o_orderkey FROM t GROUP BY 1, 2",
    "set2_new_ids": "SELECT DISTINCT o_custkey FROM orders WHERE year(o_orderdate) = 1997 EXCEPT SELECT o_custkey FROM orders WHERE year(o_orderdate) = 1996",
    "set7_union": "(SELECT o_custkey FROM orders WHERE o_orderkey % 2 = 0 UNION SELECT o_custkey FROM orders WHERE o_orderkey % 3 = 0) EXCEPT SELECT o_custkey FROM orders WHERE o_orderkey % 11 = 0",
    "set10_weekdays": "WITH d AS (SELECT CAST(unnest(generate_series(min(CAST(o_orderdate AS DATE))::TIMESTAMP, max(CAST(o_orderdate AS DATE))::TIMESTAMP, INTERVAL 1 DAY)) AS DATE) AS day FROM orders), o AS (SELECT CAST(o_orderdate AS DATE) AS day, count(*) AS n FROM orders GROUP BY 1) SELECT day, coalesce(n, 0) AS n FROM d LEFT JOIN o USING (day) WHERE isodow(day) < 6",
    "set12_weeks": "SELECT CAST(date_trunc('week', o_orderdate) AS DATE) AS week, count(*) AS n FROM orders GROUP BY 1 ORDER BY 1 DESC LIMIT 4",
}
