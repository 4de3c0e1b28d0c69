"""Parses, physics and calendar column functions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

MILES = 3958.8  # Earth's radius


def innings(text: Column) -> Column:
    """"10.2" is 10 innings and 2 outs."""
    whole = F.regexp_extract(text, r"^\s*(\d+)(?:\.([012]))?\s*$", 1)
    outs = F.regexp_extract(text, r"^\s*(\d+)(?:\.([012]))?\s*$", 2)
    return F.when(whole != "", whole.cast("double") + F.when(outs != "", outs.cast("double") / 3.0).otherwise(0.0))


def fip(hr: Column, bb: Column, hbp: Column, so: Column, ip: Column, constant: Column | float) -> Column:
    c = constant if isinstance(constant, Column) else F.lit(float(constant))
    return F.when(ip > 0, (13.0 * hr + 3.0 * (bb + hbp) - 2.0 * so) / ip + c)


def per_nine(x: Column, ip: Column) -> Column:
    return F.when(ip > 0, 9.0 * x / ip)


def percent(text: Column) -> Column:
    """"23.1%" or 23.1 or 0.231 -> 0.231; NULL for anything else."""
    v = F.regexp_replace(F.trim(text), r"[%,\s]", "").try_cast("double")
    return F.when(v > 1, v / 100.0).otherwise(v)


def in_range(text: Column, low: float, high: float) -> Column:
    v = text.try_cast("double")
    return F.when(v.between(low, high), v)


def plain_name(text: Column) -> Column:
    """Lower case, & as and, no punctuation, single spaces."""
    x = F.regexp_replace(F.lower(text), "&", " and ")
    return F.trim(F.regexp_replace(F.regexp_replace(x, r"[^a-z0-9 ]", " "), r" +", " "))


def status(text: Column) -> Column:
    """Free text -> postponed, cancelled, final or a slug."""
    x = F.lower(F.trim(text))
    slug = F.regexp_replace(F.regexp_replace(x, r"[^a-z0-9]+", "_"), r"^_+|_+$", "")
    return F.when(x.contains("postpon"), "postponed").when(x.contains("cancel"), "cancelled").when(x.contains("final") | x.contains("completed"), "final").otherwise(slug)


def date_code(d: Column) -> Column:
    return F.upper(F.date_format(d, "yyMMMdd"))


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * MILES * F.asin(F.sqrt(F.least(F.lit(1.0), a)))


def circle(degrees: Column) -> tuple[Column, Column]:
    return F.sin(F.radians(degrees)), F.cos(F.radians(degrees))


def air_density(temp_c: Column, pressure_hpa: Column, humidity: Column) -> Column:
    """kg per cubic metre of moist air; Magnus vapour pressure."""
    vapour = humidity / 100.0 * 6.1094 * F.exp(17.625 * temp_c / (temp_c + 243.04))
    kelvin = temp_c + 273.15
    return (pressure_hpa - vapour) * 100.0 / (287.05 * kelvin) + vapour * 100.0 / (461.495 * kelvin)


def wind_out(speed: Column, direction: Column, axis: Column | float) -> Column:
    """Wind component along a field axis (degrees, towards)."""
    a = axis if isinstance(axis, Column) else F.lit(float(axis))
    return speed * F.cos(F.radians(direction - a))


def mean_of(*cols: Column) -> Column:
    """Mean of the columns that aren't NULL."""
    n = sum((c.isNotNull().cast("int") for c in cols[1:]), cols[0].isNotNull().cast("int"))
    s = sum((F.coalesce(c, F.lit(0.0)) for c in cols[1:]), F.coalesce(cols[0], F.lit(0.0)))
    return F.when(n > 0, s / n)


def humanise(name: Column, acronyms: tuple[str, ...] = ("era", "whip", "fip", "war", "ops")) -> Column:
    """home_era_diff -> Home ERA difference."""
    x = F.regexp_replace(F.lower(name), r"_diff$", "_difference")
    words = F.transform(F.split(x, "_"), lambda w: F.when(w.isin(*acronyms), F.upper(w)).otherwise(w))
    s = F.array_join(words, " ")
    return F.concat(F.upper(F.substring(s, 1, 1)), s.substr(F.lit(2), F.length(s)))


def folded_name(text: Column) -> Column:
    """Lower case without full stops and apostrophes, hyphens as spaces, & as and."""
    return F.trim(F.replace(F.translate(F.lower(text), "-.'", " "), F.lit("&"), F.lit("and")))


def listed_code(name: Column, codes: dict[str, str]) -> Column:
    """The code of the full name that is equal; else of the first, as listed, that holds the name or is held by it.

    Case counts for equality only.  The list is part of the plan, so it should be short.  NULL for a blank
    name and where nothing fits.
    """
    trimmed = F.trim(name)
    plain = F.lower(trimmed)
    exact = F.coalesce(*[F.when(trimmed == full, F.lit(code)) for full, code in codes.items()])
    near = F.coalesce(*[F.when(F.lit(full.lower()).contains(plain) | plain.contains(full.lower()), F.lit(code)) for full, code in codes.items()])
    return F.when(trimmed != "", F.coalesce(exact, near))


def night(ts: Column, zone: str, hour: int = 17) -> Column:
    """1 from ``hour`` o'clock on by the clock of ``zone``, else 0; a missing time counts as night."""
    return F.coalesce((F.hour(F.from_utc_timestamp(ts, zone)) >= hour).cast("int"), F.lit(1))


def days_since(date: Column, season: Column, dates: dict[int, str]) -> Column:
    """Days since the season's date; 0 before it and where the season has none."""
    of = F.coalesce(*[F.when(season == year, F.lit(day).cast("date")) for year, day in dates.items()])
    return F.greatest(F.coalesce(F.datediff(date, of), F.lit(0)), F.lit(0))


def era_flags(season: Column, eras: dict[str, tuple[int | None, int | None]]) -> dict[str, Column]:
    """1 for seasons from an era's first to its last (None: open), else 0."""
    inside = lambda first, last: F.lit(True) & (season >= first if first is not None else True) & (season <= last if last is not None else True)
    return {name: inside(*span).cast("int") for name, span in eras.items()}
