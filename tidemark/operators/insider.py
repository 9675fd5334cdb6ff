"""Insider trades: filters, plausibility, roll-ups and clusters of buyers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

PAGE = 2000


def suspect() -> Column:
    """A price over 100,000, a value over 5 billion, or a value ten times more or less than price times shares."""
    product = F.col("price_per_share") * F.col("shares")
    ratio = F.when(product > 0, F.col("total_value") / product)
    return F.coalesce(F.col("price_per_share") > 100_000, F.lit(False)) | F.coalesce(F.col("total_value") > 5e9, F.lit(False)) | F.coalesce((F.col("total_value") > 0) & ((ratio > 10) | (ratio < 0.1)), F.lit(False))


def matching(*, start: str | None = None, end: str | None = None, types: Sequence[str] = (), ticker: object = None, name: str | None = None, roles: Sequence[str] = (), least: float | None = None) -> Column:
    """All the given conditions; text compares without case, a null value counts 0."""
    out = F.lit(True)
    if start:
        out = out & (F.col("transaction_date") >= F.lit(start).cast("date"))
    if end:
        out = out & (F.col("transaction_date") <= F.lit(end).cast("date"))
    if types:
        out = out & F.upper("transaction_type").isin([t.upper() for t in types])
    if ticker is not None:
        out = out & (F.upper(F.col("ticker").cast("string")) == str(ticker).upper())
    if name:
        out = out & F.lower("insider_name").contains(name.lower())
    if roles:
        any_role = F.lit(False)
        for r in roles:
            any_role = any_role | F.lower("insider_title").contains(r.lower())
        out = out & any_role
    if least is not None:
        out = out & (F.coalesce("total_value", F.lit(0.0)) >= least)
    return out


def window_of(end: Column, days: int = 30) -> tuple[Column, Column]:
    """The default period: `days` up to its end."""
    return F.date_sub(end, days), end


def rows(trades: DataFrame, condition: Column, *, show_suspects: bool = False) -> DataFrame:
    """Matching trades with a plain source address and the suspect mark; suspects are left out unless asked for."""
    out = trades.where(condition).withColumns({"sec_url": F.regexp_replace("source_url", "^mirror:", ""), "suspect": suspect()})
    return out if show_suspects else out.where(~F.col("suspect"))


def page(found: DataFrame, *, by: str = "transaction_date", limit: int = 200, offset: int = 0) -> DataFrame:
    """A page of at most PAGE rows, the latest or largest first, ties by filing."""
    return found.orderBy(F.desc(by), "filing_id").offset(max(0, offset)).limit(min(PAGE, max(1, limit)))


def clusters(buys: DataFrame, days: int = 14, least: int = 3) -> DataFrame:
    """(ticker, start, insiders): each ticker's window of `days` after a buy with most distinct buyers, at least `least`.

    The first of equal windows counts. Dates are counted once a ticker and day, so a busy day is one row.
    """
    by_day = buys.groupBy("ticker", F.col("transaction_date").alias("start")).agg(F.collect_set("insider_name").alias("names"))
    w = W.Window.partitionBy("ticker").orderBy(F.datediff("start", F.lit("1970-01-01").cast("date"))).rangeBetween(0, days)
    sized = by_day.select("ticker", "start", F.size(F.array_distinct(F.flatten(F.collect_list("names").over(w)))).cast("long").alias("insiders"))
    best = sized.groupBy("ticker").agg(F.max(F.struct("insiders", (-F.datediff("start", F.lit("1970-01-01").cast("date"))).alias("early"), "start")).alias("b"))
    return best.select("ticker", "b.start", "b.insiders").where(F.col("insiders") >= least)


def top_buys(trades: DataFrame, n: int = 25) -> DataFrame:
    return trades.where("transaction_type = 'BUY'").orderBy(F.desc("total_value"), "filing_id").limit(n)


def sellers(trades: DataFrame, n: int = 25) -> DataFrame:
    """Sums, counts and distinct insiders of sales by ticker, the largest sums first."""
    cents = F.round(F.col("total_value") * 100).cast("long")
    return trades.where("transaction_type = 'SELL'").groupBy("ticker").agg(F.sum(cents).alias("cents"), F.count(F.lit(1)).alias("n"), F.countDistinct("insider_name").alias("insiders")).orderBy(F.desc("cents"), "ticker").limit(n)
