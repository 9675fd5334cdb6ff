"""Queries on bars: windows that end before the current row, and their counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from tidemark.operators import windows as w
from tidemark.plans import stand_ins as s

P = "PARTITION BY ticker ORDER BY date"
IDX = f"(row_number() OVER ({P}) - 1)"


def _one(add):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return add(w.with_changes(s.bars(spark, sf_dir))).select("ticker", "date", "x")

    return run


def _sql(expr: str, before: str = "") -> str:
    return f"""WITH {s.BARS}, c AS (SELECT *, close - lag(close) OVER ({P}) AS chg, close / lag(close) OVER ({P}) - 1 AS ret,
 CASE WHEN lag(close) OVER ({P}) IS NOT NULL THEN greatest(high - low, abs(high - lag(close) OVER ({P})), abs(low - lag(close) OVER ({P}))) END AS tr, {IDX} AS i FROM b){before}
 SELECT ticker, date, {expr} AS x FROM {'d' if before else 'c'}"""


def frame(n: int) -> str:
    return f"OVER ({P} ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"


def _r(c, digits=6):
    return F.round(c, digits)


def market(bars: DataFrame) -> DataFrame:
    """The mean return of all tickers by date."""
    return w.with_changes(bars).groupBy("date").agg(F.avg("ret").alias("market_ret"))


def win_indicators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every frame indicator of every bar."""
    out = w.indicators(s.bars(spark, sf_dir).select("ticker", "date", "high", "low", "close"))
    return out.select("ticker", "date", *[_r(F.col(c)).alias(c) for c in ("sma_fast", "sma_slow", "ret_1m", "mom_12_1", "rsi", "atr", "vol", "drawdown")], "cross")


def win5_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = s.bars(spark, sf_dir).withColumn("m", _r(w.prior_return(1), 9))
    return rows.select("ticker", "date", _r(w.rank_percent(F.col("m"), F.col("ticker"))).alias("x"))


def win7_ema(spark: SparkSession, sf_dir: str) -> DataFrame:
    closes = F.collect_list("close").over(w.series().rowsBetween(-60, -1))
    return s.bars(spark, sf_dir).select("ticker", "date", _r(w.ema_fold(closes, 12)).alias("x"))


def win8_macd(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = w.macd(s.bars(spark, sf_dir))
    return out.select("ticker", "date", *[_r(F.col(c)).alias(c) for c in ("macd", "macd_signal", "macd_hist")])


def win13_beta(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = s.bars(spark, sf_dir)
    return w.with_changes(bars).join(market(bars), "date", "left").select("ticker", "date", _r(w.beta(20)).alias("x"))


def win14_drawdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return w.max_drawdown(s.bars(spark, sf_dir).select("ticker", "date", "close"), "x").select("ticker", "date", _r(F.col("x")).alias("x"))


def win16_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows where indicators of truncated bars differ from those of all bars, for 10, 50 and 100 rows cut: none."""
    bars = s.bars(spark, sf_dir).select("ticker", "date", "high", "low", "close")
    full = w.indicators(bars)
    out = None
    for n in (10, 50, 100):
        bad = w.differing(full, w.indicators(w.truncated(bars, n)), ["sma_fast", "sma_slow", "cross", "ret_1m", "mom_12_1", "rsi", "atr", "vol", "drawdown"])
        one = bad.agg(F.lit(n).alias("cut"), F.count(F.lit(1)).alias("leaks"))
        out = one if out is None else out.union(one)
    return out


def win17_leaks_caught(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each negative control, whether cutting ten rows changes it: it must, if it sees later rows."""
    bars = s.bars(spark, sf_dir)
    out = None
    for kind in ("centred", "pooled"):
        bad = w.differing(w.leaky(bars, kind), w.leaky(w.truncated(bars, 10), kind), ["x"])
        one = bad.agg(F.lit(kind).alias("kind"), (F.count(F.lit(1)) > 0).alias("caught"))
        out = one if out is None else out.union(one)
    return out


def win12_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.operators.insider import clusters

    return clusters(s.trades(spark, sf_dir).where("transaction_type = 'BUY'"))


def win29_trailing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = s.bars(spark, sf_dir).withColumn("t", w.trailing_sum("volume", 10))
    ranked = w.rank_percent(F.when(F.col("t") > 0, F.col("t")), F.col("ticker"))
    return rows.select("ticker", "date", F.col("t").alias("total"), _r(ranked).alias("x"))


def win33_placebo(spark: SparkSession, sf_dir: str) -> DataFrame:
    return w.shifted(s.bars(spark, sf_dir), F.col("ticker") % 7 + 60, "close").select("ticker", "date", F.col("moved").alias("x"))


def win34_vol(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = s.bars(spark, sf_dir).withColumn("lret", F.log(F.col("close") / F.lag("close", 1).over(w.series())))
    return rows.select("ticker", "date", w.annual_vol(20).alias("v20"), w.annual_vol(60).alias("v60"))


def win36_vol_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    vol = F.when(w.index() >= 13, F.round(F.stddev_samp("ret").over(w.series().rowsBetween(-12, 0)), 9))
    rows = w.with_changes(s.bars(spark, sf_dir)).withColumn("v", vol)
    return w.share_at_most(rows, "v", "x").select("ticker", "date", "x")


def win39_range_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    rank, share = w.range_rank("close", 60)
    return s.bars(spark, sf_dir).select("ticker", "date", _r(rank).alias("iv_rank"), _r(share).alias("iv_percentile"))


def win41_halves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s.bars(spark, sf_dir).withColumn("half", w.half("date", "ticker")).groupBy("ticker", "half").agg(F.count(F.lit(1)).alias("n"), F.min("date").alias("first"))


QUERIES = {
    "win_indicators": win_indicators,
    "win1_sma": _one(lambda d: d.withColumn("x", _r(w.sma(10)))),
    "win2_cross": _one(lambda d: d.withColumn("x", F.signum(_r(w.sma(10), 9) - _r(w.sma(30), 9)).cast("int"))),
    "win3_return": _one(lambda d: d.withColumn("x", _r(w.prior_return(1)))),
    "win4_momentum": _one(lambda d: d.withColumn("x", _r(w.momentum_12_1()))),
    "win5_rank": win5_rank,
    "win6_rsi": _one(lambda d: d.withColumn("x", _r(w.rsi()))),
    "win7_ema": win7_ema,
    "win8_macd": win8_macd,
    "win9_true_range": _one(lambda d: d.withColumn("x", F.col("tr"))),
    "win10_atr": _one(lambda d: d.withColumn("x", _r(w.atr()))),
    "win11_vol": _one(lambda d: d.withColumn("x", _r(w.realized_vol()))),
    "win12_clusters": win12_clusters,
    "win13_beta": win13_beta,
    "win14_drawdown": win14_drawdown,
    "win16_gate": win16_gate,
    "win17_leaks_caught": win17_leaks_caught,
    "win29_trailing": win29_trailing,
    "win30_forward_vol": _one(lambda d: d.withColumn("x", _r(w.forward_vol(5)))),
    "win32_log_floor": _one(lambda d: d.withColumn("x", _r(w.log_floor("volume")))),
    "win33_placebo": win33_placebo,
    "win34_vol": win34_vol,
    "win36_vol_share": win36_vol_share,
    "win38_regime": _one(lambda d: d.withColumn("x", w.regime("close"))),
    "win39_range_rank": win39_range_rank,
    "win40_range_position": _one(lambda d: d.withColumn("x", _r(w.range_rank("close", 252)[0]))),
    "win41_halves": win41_halves,
}

_UP, _DOWN = f"sum(greatest(chg, 0)) {frame(14)} / 14", f"sum(greatest(-chg, 0)) {frame(14)} / 14"
ORACLE_SQL = {
    "win1_sma": _sql(f"round(CASE WHEN i >= 10 THEN avg(close) {frame(10)} END, 6)"),
    "win2_cross": _sql(f"CAST(sign(round(CASE WHEN i >= 10 THEN avg(close) {frame(10)} END, 9) - round(CASE WHEN i >= 30 THEN avg(close) {frame(30)} END, 9)) AS INT)"),
    "win3_return": _sql(f"round((lag(close) OVER ({P}) / nullif(lag(close, 22) OVER ({P}), 0) - 1) * 100, 6)"),
    "win4_momentum": _sql(f"round((lag(close, 22) OVER ({P}) / nullif(lag(close, 274) OVER ({P}), 0) - 1) * 100, 6)"),
    "win5_rank": f"""WITH {s.BARS}, m AS (SELECT ticker, date, round((lag(close) OVER ({P}) / lag(close, 22) OVER ({P}) - 1) * 100, 9) AS m FROM b),
 r AS (SELECT *, row_number() OVER (PARTITION BY date, m IS NULL ORDER BY m, ticker) - 1 AS k, count(m) OVER (PARTITION BY date) AS n FROM m)
 SELECT ticker, date, round(CASE WHEN m IS NULL THEN NULL WHEN n = 1 THEN 50.0 ELSE k / (n - 1) * 100 END, 6) AS x FROM r""",
    "win6_rsi": _sql(f"round(CASE WHEN i >= 15 THEN CASE WHEN {_DOWN} = 0 THEN 100.0 ELSE 100 - 100 / (1 + ({_UP}) / ({_DOWN})) END END, 6)"),
    "win9_true_range": _sql("tr"),
    "win10_atr": _sql(f"round(CASE WHEN i >= 15 THEN avg(tr) {frame(14)} END, 6)"),
    "win11_vol": _sql(f"round(CASE WHEN i >= 21 THEN stddev_samp(ret) {frame(20)} END, 6)"),
    "win13_beta": f"""WITH {s.BARS}, c AS (SELECT *, close / lag(close) OVER ({P}) - 1 AS ret, {IDX} AS i FROM b), m AS (SELECT date, avg(ret) AS mr FROM c GROUP BY date), j AS (SELECT c.*, mr FROM c LEFT JOIN m USING (date))
 SELECT ticker, date, round(CASE WHEN i >= 21 AND var_samp(mr) {frame(20)} <> 0 THEN covar_samp(ret, mr) {frame(20)} / var_samp(mr) {frame(20)} END, 6) AS x FROM j""",
    "win16_gate": "SELECT n AS cut, CAST(0 AS BIGINT) AS leaks FROM (VALUES (10), (50), (100)) v(n)",
    "win17_leaks_caught": "SELECT k AS kind, true AS caught FROM (VALUES ('centred'), ('pooled')) v(k)",
    "win12_clusters": f"""WITH {s.TRADES}, p AS (SELECT ticker, transaction_date AS d, insider_name, total_value FROM t WHERE transaction_type = 'BUY'),
 k AS (SELECT a.ticker, a.d, count(DISTINCT b.insider_name) AS insiders, count(DISTINCT b.insider_name || '|' || b.d) AS dummy FROM (SELECT DISTINCT ticker, d FROM p) a JOIN p b ON a.ticker = b.ticker AND b.d BETWEEN a.d AND a.d + 14 GROUP BY 1, 2)
 SELECT ticker, arg_max(d, insiders * 1000000 - date_diff('day', DATE '1900-01-01', d)) AS start, CAST(max(insiders) AS BIGINT) AS insiders FROM k GROUP BY ticker HAVING max(insiders) >= 3""",
    "win29_trailing": f"""WITH {s.BARS}, t AS (SELECT ticker, date, coalesce(sum(volume) {frame(10)}, 0) AS total FROM b), r AS (SELECT *, row_number() OVER (PARTITION BY date, total <= 0 ORDER BY total, ticker) - 1 AS k, count(CASE WHEN total > 0 THEN 1 END) OVER (PARTITION BY date) AS n FROM t)
 SELECT ticker, date, total, round(CASE WHEN total <= 0 THEN NULL WHEN n = 1 THEN 50.0 ELSE k / (n - 1) * 100 END, 6) AS x FROM r""",
    "win30_forward_vol": _sql(f"round(CASE WHEN count(*) OVER ({P} ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING) = 5 THEN stddev_samp(ret) OVER ({P} ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) END, 6)"),
    "win32_log_floor": _sql(f"CASE WHEN i >= 0 THEN round(ln(greatest(lag(volume) OVER ({P}), 1)), 6) END"),
    "win33_placebo": f"""WITH {s.BARS}, n AS (SELECT *, {IDX} AS i, count(*) OVER (PARTITION BY ticker) AS n FROM b)
 SELECT a.ticker, a.date, m.close AS x FROM n a JOIN n m ON a.ticker = m.ticker AND (m.i + m.ticker % 7 + 60) % m.n = a.i""",
    "win34_vol": f"""WITH {s.BARS}, l AS (SELECT *, ln(close / lag(close) OVER ({P})) AS lret FROM b), w AS (SELECT ticker, date, count(lret) OVER ({P} ROWS 19 PRECEDING) AS n20, count(lret) OVER ({P} ROWS 59 PRECEDING) AS n60, stddev_samp(lret) OVER ({P} ROWS 19 PRECEDING) AS s20, stddev_samp(lret) OVER ({P} ROWS 59 PRECEDING) AS s60 FROM l)
 SELECT ticker, date, CASE WHEN n20 = 20 THEN round(s20 * sqrt(252) * 100, 4) END AS v20, CASE WHEN n60 = 60 THEN round(s60 * sqrt(252) * 100, 4) END AS v60 FROM w""",
    "win38_regime": _sql(f"CAST(CASE WHEN lag(close, 26) OVER ({P}) IS NULL THEN NULL WHEN close / lag(close, 26) OVER ({P}) - 1 > 0.04 THEN 1 WHEN close / lag(close, 26) OVER ({P}) - 1 < -0.04 THEN -1 ELSE 0 END AS INT)"),
    "win39_range_rank": f"""WITH {s.BARS}, l AS (SELECT *, list(close) {frame(60)} AS h, min(close) {frame(60)} AS lo, max(close) {frame(60)} AS hi FROM b)
 SELECT ticker, date, round(CASE WHEN hi > lo THEN (close - lo) / (hi - lo) * 100 END, 6) AS iv_rank, round(CASE WHEN len(h) > 0 THEN len(list_filter(h, lambda x: x < close)) / len(h) * 100 END, 6) AS iv_percentile FROM l""",
    "win40_range_position": _sql(f"round(CASE WHEN max(close) {frame(252)} > min(close) {frame(252)} THEN (close - min(close) {frame(252)}) / (max(close) {frame(252)} - min(close) {frame(252)}) * 100 END, 6)"),
    "win41_halves": f"""WITH {s.BARS}, r AS (SELECT *, row_number() OVER ({P}) AS k, count(*) OVER (PARTITION BY ticker) AS n FROM b), h AS (SELECT *, CASE WHEN k <= n // 2 THEN 1 ELSE 2 END AS half FROM r)
 SELECT ticker, half, count(*) AS n, min(date) AS first FROM h GROUP BY 1, 2""",
    "win7_ema": f"""WITH {s.BARS} SELECT ticker, date, round(list_reduce(h, lambda a, x: a + (x - a) * (2.0::DOUBLE / 13)), 6) AS x FROM (SELECT ticker, date, list(close) {frame(60)} AS h FROM b)""",
    "win36_vol_share": f"""WITH {s.BARS}, c AS (SELECT *, close / lag(close) OVER ({P}) - 1 AS ret, {IDX} AS i FROM b), v AS (SELECT ticker, date, CASE WHEN i >= 13 THEN round(stddev_samp(ret) OVER ({P} ROWS 12 PRECEDING), 9) END AS v FROM c)
 SELECT ticker, date, CASE WHEN v IS NOT NULL THEN round(len(list_filter(h, lambda x: x <= v)) / len(h) * 100) END AS x FROM (SELECT *, list(v) FILTER (WHERE v IS NOT NULL) OVER ({P} ROWS UNBOUNDED PRECEDING) AS h FROM v)""",
    "win14_drawdown": f"""WITH {s.BARS}
 SELECT ticker, date, round((SELECT CASE WHEN len(h) >= 2 THEN list_min(list_transform(range(1, len(h) + 1), lambda k: (h[k] / list_max(h[1:k]) - 1) * 100)) END), 6) AS x FROM (SELECT ticker, date, list(close) {frame(252)} AS h FROM b)""",
}
