"""Market-odds column functions.  NULL or NaN in, NULL out."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def clean(ml: Column) -> Column:
    """NaN counts as missing."""
    return F.when(~F.isnan(ml), ml)


def implied(ml: Column, strict: bool = False) -> Column:
    """Raw implied probability of an American line; strict: none for lines inside (-100, 100)."""
    x = clean(ml)
    ok = F.abs(x) >= 100 if strict else x != 0
    return F.when(ok, F.when(x < 0, -x / (-x + 100.0)).otherwise(100.0 / (x + 100.0)))


def decimal(ml: Column) -> Column:
    """Decimal odds of an American line; NULL for 0."""
    x = clean(ml)
    return F.when(x != 0, F.when(x < 0, 1.0 + 100.0 / -x).otherwise(1.0 + x / 100.0))


def devig(home: Column, away: Column) -> Column:
    """Home share of a two-way market."""
    total = home + away
    return F.when(total > 0, home / total)


def overround(home: Column, away: Column) -> Column:
    return home + away


def line_move(open_p: Column, close_p: Column) -> Column:
    return close_p - open_p


def sharp(open_p: Column, close_p: Column, least: float = 0.03) -> Column:
    return F.abs(close_p - open_p) >= least


def kelly(p: Column, dec: Column) -> Column:
    """Full Kelly fraction p - (1 - p) / b."""
    return F.when(dec > 1, p - (1.0 - p) / (dec - 1.0))


def stake_fraction(p: Column, dec: Column, k: float = 0.5, cap: float = 0.05, warm_up: Column | float = 1.0) -> Column:
    """max(0, min(k * Kelly, cap)), times a warm-up multiplier."""
    w = warm_up if isinstance(warm_up, Column) else F.lit(float(warm_up))
    return F.greatest(F.lit(0.0), F.least(kelly(p, dec) * k, F.lit(float(cap)))) * w


def expected_value(p: Column, dec: Column) -> Column:
    return p * (dec - 1.0) - (1.0 - p)


def home_first_side(p: Column, market: Column, dec_home: Column, dec_away: Column, edge: float) -> Column:
    """Bet rule by expected value on both sides; home has priority."""
    home = (expected_value(p, dec_home) > 0) & (p - market > edge)
    away = (expected_value(1.0 - p, dec_away) > 0) & (market - p > edge)
    return F.when(home, "home").when(away, "away")


def banded_side(p: Column, edge: Column, home_ml: Column, away_ml: Column, dec_home: Column, dec_away: Column, low: float, high: float, longest: float) -> Column:
    """Bet rule by the sign of the edge, within a band of edges and a cap on the line."""
    ok = (F.abs(edge) > low) & (F.abs(edge) <= high)
    home = ok & (edge > 0) & (home_ml <= longest) & (expected_value(p, dec_home) > 0)
    away = ok & (edge < 0) & (away_ml <= longest) & (expected_value(1.0 - p, dec_away) > 0)
    return F.when(home, "home").when(away, "away")


def side_probability(side: Column, p: Column) -> Column:
    return F.when(side == "home", p).when(side == "away", 1.0 - p)


def moneyline_profit(side: Column, home_win: Column, home_ml: Column, away_ml: Column, stake: Column, default_decimal: float = 1.91) -> Column:
    """Profit rounded to cents: NULL without a bet or result, default odds without a line."""
    dec = F.coalesce(F.when(side == "home", decimal(home_ml)).otherwise(decimal(away_ml)), F.lit(default_decimal))
    won = (side == "home") == (home_win == 1)
    return F.when(side.isNotNull() & home_win.isNotNull(), F.when(won, F.round(stake * (dec - 1.0), 2)).otherwise(-stake))


def logit(p: Column, eps: float = 1e-6) -> Column:
    c = F.greatest(F.lit(eps), F.least(F.lit(1.0 - eps), p))
    return F.log(c / (1.0 - c))


def pythagorean(scored: Column, allowed: Column) -> Column:
    s, a = scored * scored, allowed * allowed
    return F.when(s + a > 0, s / (s + a))


def recency_weight(age_days: Column, half_life: float) -> Column:
    return F.pow(F.lit(0.5), F.greatest(F.lit(0.0), age_days.cast("double")) / half_life)
