"""Look-ahead-safe indicators over daily bars: every frame ends at the row before the current one.

Bars have ticker, date (any orderable type), open, high, low, close, volume, one row per ticker and date. All functions
add columns; a value is null until enough earlier rows exist. Windows are partitioned by ticker, so one shuffle serves
all indicators of a table.
"""

from __future__ import annotations

from bisect import bisect_right, insort
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import window as W


def series(key: str = "ticker", order: str = "date") -> WindowSpec:
    return W.Window.partitionBy(key).orderBy(order)


def prior(n: int, key: str = "ticker", order: str = "date") -> WindowSpec:
    """The n rows before the current one."""
    return series(key, order).rowsBetween(-n, -1)


def index(key: str = "ticker", order: str = "date") -> Column:
    """Row number of the series, from 0."""
    return F.row_number().over(series(key, order)) - 1


def guarded(value: Column, least: int, at: Column | None = None) -> Column:
    """value once at least `least` rows come before; at is a column with the row's number, if there is one."""
    return F.when((index() if at is None else at) >= least, value)


def _change(now: Column, start: Column) -> Column:
    return F.when(start != 0, (now / start - 1) * 100)


def sma(n: int, price: str = "close") -> Column:
    return guarded(F.avg(price).over(prior(n)), n)


def sma_cross(fast: int = 50, slow: int = 200) -> Column:
    """1, 0 or -1: the sign of fast average less slow one."""
    return F.signum(sma(fast) - sma(slow)).cast("int")


def prior_return(months: int, price: str = "close", month: int = 21) -> Column:
    """Per cent change over whole months up to the row before."""
    return _change(F.lag(price, 1).over(series()), F.lag(price, month * months + 1).over(series()))


def momentum_12_1(price: str = "close", month: int = 21) -> Column:
    """Per cent change over twelve months that end a month ago."""
    return _change(F.lag(price, month + 1).over(series()), F.lag(price, 13 * month + 1).over(series()))


def rank_percent(value: Column, key: Column, by: str = "date") -> Column:
    """Place among the non-null values of a date as 0 to 100; 50 for a single one; equal values keep the order of key."""
    w = W.Window.partitionBy(by, value.isNull())
    n = F.count(value).over(w)
    place = F.row_number().over(w.orderBy(value, key)) - 1
    return F.when(value.isNotNull(), F.when(n == 1, F.lit(50.0)).otherwise(place / (n - 1) * 100))


def with_changes(bars: DataFrame) -> DataFrame:
    """Columns the other indicators share: change, simple return and true range of each row."""
    before = F.col("__before")
    ranges = F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before))
    held = bars.withColumn("__before", F.lag("close", 1).over(series()))
    return held.withColumns({"chg": F.col("close") - before, "ret": F.when(before != 0, F.col("close") / before - 1), "tr": F.when(before.isNotNull(), ranges)}).drop("__before")


def rsi(n: int = 14) -> Column:
    """Relative strength of simple averages over n changes; 100 where nothing fell. Needs with_changes()."""
    return guarded(_strength(*_moves(n)), n + 1)


def _moves(n: int) -> tuple[Column, Column]:
    return tuple(F.sum(F.greatest(c, F.lit(0.0))).over(prior(n)) / n for c in (F.col("chg"), -F.col("chg")))


def _strength(up: Column, down: Column) -> Column:
    return F.when(down == 0, F.lit(100.0)).otherwise(100 - 100 / (1 + up / down))


def atr(n: int = 14) -> Column:
    return guarded(F.avg("tr").over(prior(n)), n + 1)


def realized_vol(n: int = 20) -> Column:
    """Sample deviation of n simple returns, not annualised."""
    return guarded(F.stddev_samp("ret").over(prior(n)), n + 1)


def beta(n: int = 60, market: str = "market_ret") -> Column:
    """Covariance with the market's returns over n rows by its variance; null if that is 0."""
    var = F.var_samp(market).over(prior(n))
    return guarded(F.when(var != 0, F.covar_samp("ret", market).over(prior(n)) / var), n + 1)


def _falls(x: np.ndarray, known: np.ndarray, first: np.ndarray, n: int) -> np.ndarray:
    """The deepest fall over the up to n values before each place, those from the place `first` of its series on; NaN for fewer than two known ones.

    A stretch is its peak, its trough and its worst fall; two neighbours make one, so stretches of 1, 2, 4... values give any n.
    """
    at = np.arange(len(x))
    plain = known & np.isfinite(x) & (x > 0)
    peak, trough, worst = np.where(plain, x, 0.0), np.where(plain, x, np.inf), np.zeros(len(x))

    def before(places: np.ndarray, held: tuple[np.ndarray, ...]) -> tuple[np.ndarray, ...]:
        inside = places >= first
        return tuple(np.where(inside, v[np.maximum(places, 0)], none) for v, none in zip(held, (0.0, np.inf, 0.0), strict=True))

    def merged(a: tuple[np.ndarray, ...], b: tuple[np.ndarray, ...]) -> tuple[np.ndarray, ...]:
        return np.maximum(a[0], b[0]), np.minimum(a[1], b[1]), np.minimum(np.minimum(a[2], b[2]), (b[1] / a[0] - 1) * 100)

    with np.errstate(all="ignore"):
        held, size, end, out = (peak, trough, worst), 1, at - 1, None
        while size <= n:
            if n & size:
                own = before(end, held)
                out = own if out is None else merged(own, out)
                end = end - size
            held = merged(before(at - size, held), held)
            size *= 2
        low = np.maximum(first, at - n)
        found = out[2]
        # Where prices aren't above 0 or aren't finite, a trough and a peak don't tell the fall; these few places are walked.
        strange = np.r_[0, np.cumsum(known & ~plain)]
        for k in np.flatnonzero(strange[at] > strange[low]):
            own = x[low[k] : k][known[low[k] : k]]
            tops = np.maximum.accumulate(own)
            found[k] = np.fmin.reduce(np.where(tops == 0, 0.0, (own / tops - 1) * 100), initial=0.0)
        count = np.r_[0, np.cumsum(known)]
        return np.where(count[at] - count[low] >= 2, found, np.nan)


def max_drawdown(rows: DataFrame, name: str = "drawdown", n: int = 252, price: str = "close", key: str = "ticker", order: str = "date") -> DataFrame:
    """rows with the deepest fall from a peak, in per cent (0 or less), over up to n earlier prices, at least two; nulls don't count, nor do peaks of 0.

    Each series is walked once, in Arrow batches that keep the last n prices of the batch before.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, x, known = None, np.zeros(0), np.zeros(0, bool)
        for batch in batches:
            if not batch.num_rows:
                continue
            keys, prices = batch.column(batch.schema.get_field_index(key)), batch.column(batch.num_columns - 1)
            codes = pc.dictionary_encode(keys, null_encoding="encode").indices.to_numpy(zero_copy_only=False)
            if last is None or keys[0].as_py() != last[0]:
                x, known = x[:0], known[:0]
            kept = len(x)
            x, known = np.r_[x, prices.to_numpy(zero_copy_only=False)], np.r_[known, prices.is_valid().to_numpy(zero_copy_only=False)]
            begins = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]])
            begins[1:] += kept
            first = np.repeat(begins, np.diff(np.r_[begins, len(x)]))
            found = _falls(x, known, first, n)[kept:]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found, mask=np.isnan(found))], [*batch.schema.names[:-1], name])
            last = (keys[-1].as_py(),)
            low = max(first[-1], len(x) - n)
            x, known = x[low:], known[low:]

    schema = T.StructType([*rows.schema.fields, T.StructField(name, T.DoubleType())])
    return rows.withColumn("__price", F.col(price).cast("double")).repartition(key).sortWithinPartitions(key, order).mapInArrow(run, schema)


def ema_fold(values: Column, span: int) -> Column:
    """Recursive average of an array seeded with its first value."""
    k = 2.0 / (span + 1)
    return F.aggregate(values, F.lit(None).cast("double"), lambda a, x: F.coalesce(a + (x - a) * F.lit(k), x))


def macd(bars: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9) -> DataFrame:
    """bars with macd, macd_signal and macd_hist of the rows before; null in the first `slow` rows.

    The recursion runs once along each ticker's series, in Arrow batches of whole series.
    """
    schema = T.StructType([*bars.schema.fields, *[T.StructField(c, T.DoubleType()) for c in ("macd", "macd_signal", "macd_hist")]])

    def along(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("date")
        close = pdf["close"]
        line = close.ewm(span=fast, adjust=False).mean() - close.ewm(span=slow, adjust=False).mean()
        # The line counts from the slow average's first full span on, and the signal starts with its first value.
        line = line.where(pd.Series(range(len(line)), index=line.index) >= slow - 1)
        mark = line.ewm(span=signal, adjust=False, ignore_na=True).mean()
        return pdf.assign(macd=line.shift(1), macd_signal=mark.shift(1), macd_hist=(line - mark).shift(1))

    return bars.groupBy("ticker").applyInPandas(along, schema)


def indicators(bars: DataFrame, market: DataFrame | None = None, *, fast: int = 10, slow: int = 30) -> DataFrame:
    """All frame indicators of every bar; market (date, market_ret), if given, adds beta."""
    rows = with_changes(bars)
    extra = {}
    if market is not None:
        rows = rows.join(market, "date", "left")
        extra = {"beta": beta()}
    up, down = _moves(14)
    lag = lambda n: F.lag("close", n).over(series())
    # Each window once: Spark computes one anew wherever an expression names it.
    once = rows.withColumns({
        "__i": index(), "__fast": F.avg("close").over(prior(fast)), "__slow": F.avg("close").over(prior(slow)), "__up": up, "__down": down,
        "__tr": F.avg("tr").over(prior(14)), "__vol": F.stddev_samp("ret").over(prior(20)), "__1": lag(1), "__22": lag(22), "__274": lag(274), **extra,
    })
    i = F.col("__i")
    held = once.withColumns({
        "sma_fast": guarded(F.col("__fast"), fast, i), "sma_slow": guarded(F.col("__slow"), slow, i), "ret_1m": _change(F.col("__1"), F.col("__22")), "mom_12_1": _change(F.col("__22"), F.col("__274")),
        "rsi": guarded(_strength(F.col("__up"), F.col("__down")), 15, i), "atr": guarded(F.col("__tr"), 15, i), "vol": guarded(F.col("__vol"), 21, i),
    }).withColumn("cross", F.signum(F.col("sma_fast") - F.col("sma_slow")).cast("int"))
    slim = held.select(*bars.columns, "sma_fast", "sma_slow", "cross", "ret_1m", "mom_12_1", "rsi", "atr", "vol", *extra)
    # Last, as the rows lie by ticker and date already.
    return max_drawdown(slim).select(*slim.columns[: -len(extra) or None], "drawdown", *extra)


def leaky(bars: DataFrame, kind: str, n: int = 14) -> DataFrame:
    """Negative controls with a column x that sees the current row or later ones: centred, current or pooled."""
    if kind == "centred":
        return bars.withColumn("x", F.avg("close").over(series().rowsBetween(-(n // 2), n // 2)))
    if kind == "current":
        return bars.withColumn("x", F.avg("close").over(series().rowsBetween(-(n - 1), 0)))
    return bars.withColumn("x", F.cume_dist().over(W.Window.partitionBy("ticker").orderBy("close")))


def differing(full: DataFrame, part: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows of both tables by ticker and date where any column differs, nulls being equal to each other."""
    names = {c: f"__{c}" for c in columns}
    both = full.select("ticker", "date", *columns).join(part.select("ticker", "date", *[F.col(c).alias(n) for c, n in names.items()]), ["ticker", "date"])
    same = F.lit(True)
    for c, n in names.items():
        same = same & F.col(c).eqNullSafe(F.col(n))
    return both.where(~same)


def truncated(bars: DataFrame, last: int) -> DataFrame:
    """bars without the last rows of each ticker."""
    return bars.withColumn("__later", F.lead(F.lit(True), last).over(series())).where(F.col("__later").isNotNull()).drop("__later")


def trailing_sum(value: str, n: int) -> Column:
    """Sum over the n rows before; earlier rows that don't exist count 0."""
    return F.coalesce(F.sum(value).over(prior(n)), F.lit(0.0))


def forward_vol(n: int = 20) -> Column:
    """Sample deviation of the returns of this row and the n - 1 after it, null where they run out. An outcome, not a feature."""
    w = series().rowsBetween(0, n - 1)
    return F.when(F.count(F.lit(1)).over(series().rowsBetween(1, n)) == n, F.stddev_samp("ret").over(w))


def log_floor(value: str) -> Column:
    """Log of the row before's value, at least 1."""
    return F.log(F.greatest(F.lag(value, 1).over(series()), F.lit(1.0)))


def annual_vol(n: int = 20) -> Column:
    """Deviation of n log returns up to this row, a year's per cent, four digits. Needs a column lret."""
    w = series().rowsBetween(-(n - 1), 0)
    return F.when(F.count("lret").over(w) == n, F.round(F.stddev_samp("lret").over(w) * (252**0.5) * 100, 4))


def share_at_most(rows: DataFrame, value: str, name: str, key: str = "ticker", order: str = "date") -> DataFrame:
    """rows with the per cent of the series so far that is not above the current value, rounded; null for a null value.

    Each series is walked once, its values so far kept in order; nulls don't count.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[float] = []
        last = None
        for pdf in batches:
            counts = []
            for k, v in zip(pdf["__key"], pdf["__value"], strict=True):
                if k != last:
                    held, last = [], k
                known = v == v and v is not None
                if known:
                    insort(held, v)
                counts.append((bisect_right(held, v) if known else None, len(held)))
            pdf["__le"], pdf["__of"] = (pd.array(x, "Int64") for x in zip(*counts, strict=True)) if counts else ([], [])
            yield pdf[["__key", "__order", "__value", "__le", "__of"]]

    slim = rows.select(F.col(key).alias("__key"), F.col(order).alias("__order"), F.col(value).cast("double").alias("__value"))
    kinds = {n: t for n, t in slim.dtypes}
    found = slim.repartition("__key").sortWithinPartitions("__key", "__order").mapInPandas(run, f"__key {kinds['__key']}, __order {kinds['__order']}, __value double, __le long, __of long")
    share = F.round(F.col("__le") / F.col("__of") * 100)
    joined = rows.join(found, (F.col(key) == F.col("__key")) & (F.col(order) == F.col("__order")), "left")
    return joined.withColumn(name, F.when(F.col("__le").isNotNull(), share)).drop("__key", "__order", "__value", "__le", "__of")


def regime(value: str, steps: int = 26, band: float = 0.04) -> Column:
    """1, -1 or 0 for a change over the steps above, below or inside the band."""
    start = F.lag(value, steps).over(series())
    change = F.col(value) / start - 1
    return F.when(start.isNotNull(), F.when(change > band, 1).when(change < -band, -1).otherwise(0))


def range_rank(value: str, n: int = 252) -> tuple[Column, Column]:
    """(place between the least and greatest of the n rows before, share of them strictly below), in per cent."""
    low, high = F.min(value).over(prior(n)), F.max(value).over(prior(n))
    below = F.size(F.filter(F.collect_list(value).over(prior(n)), lambda x: x < F.col(value)))
    count = F.count(value).over(prior(n))
    return F.when(high > low, (F.col(value) - low) / (high - low) * 100), F.when(count > 0, below / count * 100)


def shifted(rows: DataFrame, by: Column, value: str) -> DataFrame:
    """A placebo: each series turned round by `by` places (an expression of the ticker)."""
    numbered = rows.withColumn("i", index()).withColumn("n", F.count(F.lit(1)).over(W.Window.partitionBy("ticker")))
    moved = numbered.select("ticker", F.pmod(F.col("i") + by, F.col("n")).alias("i"), F.col(value).alias("moved"))
    return numbered.join(moved, ["ticker", "i"])


def half(order: str, key: str) -> Column:
    """1 for the first floor(n/2) rows of a key, 2 for the rest."""
    n = F.count(F.lit(1)).over(W.Window.partitionBy(key))
    return F.when(F.row_number().over(W.Window.partitionBy(key).orderBy(order)) <= F.floor(n / 2), 1).otherwise(2)
