"""Option prices, Greeks and decision rules as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The rational approximation 7.1.26 of Abramowitz and Stegun, error below 1.5e-7.
ERF = (0.3275911, 0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)

#: Bands of the volatility index, the recession probit (Estrella and Mishkin 1998), weights of the score's legs.
VIX_BANDS = ((40, "panic"), (30, "stress"))
PROBIT = (-0.5333, -0.6629)
LEGS = {"congress": 0.35, "insider": 0.30, "news": 0.15, "options": 0.20}


def erf(x: Column) -> Column:
    p, a1, a2, a3, a4, a5 = ERF
    t = 1 / (1 + p * F.abs(x))
    y = 1 - ((((a5 * t + a4) * t + a3) * t + a2) * t + a1) * t * F.exp(-x * x)
    return F.when(x < 0, -y).otherwise(y)


def norm_cdf(x: Column) -> Column:
    return 0.5 * (1 + erf(x / 2**0.5))


def norm_pdf(x: Column) -> Column:
    return F.exp(-x * x / 2) / (2 * 3.141592653589793) ** 0.5


def intrinsic(spot: Column, strike: Column, is_call: Column) -> Column:
    return F.greatest(F.when(is_call, spot - strike).otherwise(strike - spot), F.lit(0.0))


def black_scholes(spot: Column, strike: Column, years: Column, sigma: Column, is_call: Column, rate: float = 0.04) -> Column:
    """price, delta, gamma, vega (a point of volatility), theta (a day)."""
    root = sigma * F.sqrt(years)
    d1 = (F.log(spot / strike) + (rate + sigma * sigma / 2) * years) / root
    d2 = d1 - root
    paper = strike * F.exp(-rate * years)
    price = F.when(is_call, spot * norm_cdf(d1) - paper * norm_cdf(d2)).otherwise(paper * norm_cdf(-d2) - spot * norm_cdf(-d1))
    theta = -spot * norm_pdf(d1) * sigma / (2 * F.sqrt(years)) - F.when(is_call, rate * paper * norm_cdf(d2)).otherwise(-rate * paper * norm_cdf(-d2))
    return F.struct(F.round(price, 4).alias("price"), F.round(F.when(is_call, norm_cdf(d1)).otherwise(norm_cdf(d1) - 1), 4).alias("delta"), F.round(norm_pdf(d1) / (spot * root), 4).alias("gamma"), F.round(spot * norm_pdf(d1) * F.sqrt(years) / 100, 4).alias("vega"), F.round(theta / 365, 4).alias("theta"))


def black_76(forward: Column, strike: Column, sigma: Column, years: Column, is_call: Column) -> Column:
    """Price at a rate of 0, at least 0.05; intrinsic value where no time or volatility is left."""
    root = sigma * F.sqrt(years)
    d1 = (F.log(forward / strike) + sigma * sigma / 2 * years) / root
    price = F.when(is_call, forward * norm_cdf(d1) - strike * norm_cdf(d1 - root)).otherwise(strike * norm_cdf(root - d1) - forward * norm_cdf(-d1))
    return F.greatest(F.when((years <= 0) | (sigma <= 0), intrinsic(forward, strike, is_call)).otherwise(price), F.lit(0.05))


def prob_above(forward: Column, level: Column, sigma: Column, years: Column) -> Column:
    """Chance of a lognormal price to end above a level."""
    root = sigma * F.sqrt(years)
    return norm_cdf((F.log(forward / level) - sigma * sigma / 2 * years) / root)


def clamp(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def half_spread(mid: Column) -> Column:
    return F.greatest(F.lit(0.02), mid * 0.04)


def vix_bucket(vix: Column) -> Column:
    (panic, a), (stress, b) = VIX_BANDS
    return F.when(vix > panic, a).when(vix > stress, b).when(vix >= 20, "elevated").when(vix >= 15, "normal").when(vix.isNotNull(), "calm")


def recession_probability(spread: Column) -> Column:
    return norm_cdf(PROBIT[0] + PROBIT[1] * spread)


def inverted(vix: Column, vix3m: Column) -> Column:
    ratio = vix / vix3m
    return F.when(ratio > 1.10, "deep").when(ratio > 1.0, "inverted").when(ratio.isNotNull(), "normal")


def position_shares(*caps: Column) -> Column:
    """The least of the caps, none if any is missing."""
    known = F.lit(True)
    for c in caps:
        known = known & c.isNotNull()
    return F.when(known, F.floor(F.greatest(F.least(*caps), F.lit(0.0))))


def structure(thesis: Column, iv_rank: Column, skew: Column) -> Column:
    """An option structure for a thesis and rank; a steep skew asks for a collar first."""
    rich = iv_rank >= 50
    return F.when(skew >= 1.15, "collar").when((thesis == "bullish") & rich, "bull_put_spread").when(thesis == "bullish", "call_debit_spread").when((thesis == "bearish") & rich, "bear_call_spread").when(thesis == "bearish", "put_debit_spread").when(rich, "iron_condor").otherwise("calendar")


def unusual(volume: Column, open_interest: Column) -> Column:
    return F.coalesce(volume >= 2 * open_interest, F.lit(False))


def put_call(puts: Column, calls: Column) -> Column:
    ratio = F.try_divide(puts.cast("double"), calls.cast("double"))
    return F.when(ratio >= 1.2, "fear").when(ratio <= 0.5, "greed").when(ratio.isNotNull(), "neutral")


def liquid_chain(open_interest: Column, volume: Column) -> Column:
    """Enough of both; unknown is not enough."""
    return F.coalesce((open_interest >= 500) & (volume >= 100), F.lit(False))


def smart_money(congress: Column, insider: Column, news: Column, options: Column) -> Column:
    """Weighted legs; a missing one counts 0."""
    leg = lambda c: F.coalesce(c, F.lit(0.0))
    return LEGS["congress"] * leg(congress) + LEGS["insider"] * leg(insider) + LEGS["news"] * leg(news) + LEGS["options"] * leg(options)


def weekly_vol(returns: Column) -> Column:
    """Yearly volatility of an aggregate of weekly log returns; 0 for fewer than two."""
    return F.when(F.count(returns) < 2, 0.0).otherwise(F.stddev_samp(returns) * 52**0.5)


#: Fixed values of the volatility surface: slope, least and greatest of the skew and of the term factor, the term's middle in years.
SKEW, TERM, MIDDLE = (-1.6, 0.60, 1.70), (0.35, 0.80, 1.35), 8 / 52
#: Share by which a volatility is dear at the highest rank.
MARKUP = 0.15


def surface_vol(sigma: Column, forward: Column, strike: Column, years: Column) -> Column:
    """A volatility on the surface: dearer for low strikes and, a little, for long terms."""
    tiny = F.lit(1e-6)
    moneyness = F.ln(F.greatest(strike, tiny) / F.greatest(forward, tiny))
    return sigma * clamp(1 + SKEW[0] * moneyness, *SKEW[1:]) * clamp(1 + TERM[0] * (years - MIDDLE), *TERM[1:])


def vol_markup(rank: Column) -> Column:
    """The factor by which options are dear (rank over 50) or cheap; ranks are held to 0 to 100."""
    return 1 + MARKUP * (clamp(rank, 0.0, 100.0) - 50) / 50


def black_76_greeks(forward: Column, strike: Column, sigma: Column, years: Column, is_call: Column, surface: bool = False) -> Column:
    """delta, vega (a point of volatility) and theta (a day) at a rate of 0; without time or price delta is 1, 0 or -1 and the rest 0."""
    vol = F.greatest(sigma, F.lit(0.05))
    vol = surface_vol(vol, forward, strike, years) if surface else vol
    done = (years <= 1e-9) | (forward <= 0)
    d1 = F.when(~done, (F.ln(forward / strike) + 0.5 * vol * vol * years) / (vol * F.sqrt(years)))
    ended = F.when(is_call, F.when(forward > strike, 1.0).otherwise(0.0)).otherwise(F.when(forward < strike, -1.0).otherwise(0.0))
    delta = F.when(done, ended).otherwise(norm_cdf(d1) - F.when(is_call, 0.0).otherwise(1.0))
    vega = F.when(done, 0.0).otherwise(forward * norm_pdf(d1) * F.sqrt(years) / 100)
    theta = F.when(done, 0.0).otherwise(-forward * norm_pdf(d1) * vol / (2 * F.sqrt(years)) / 365)
    return F.struct(delta.alias("delta"), vega.alias("vega"), theta.alias("theta"))


def suggested_shares(equity: Column, risk: float, price: Column, atr: Column, momentum: Column, vol: Column, drawdown: Column, stop: float = 2.0) -> Column:
    """The least of three caps: equal risk at a stop of so many true ranges, half of Kelly's share, the worst fall seen; null if one is missing."""
    by_stop = equity * risk / (atr * stop)
    kelly = F.greatest(momentum / (vol * vol), F.lit(0.0)) / 2 * equity / price
    by_fall = equity * risk / (F.abs(drawdown) * price)
    return F.floor(position_shares(by_stop, kelly, by_fall))
