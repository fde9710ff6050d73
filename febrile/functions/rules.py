"""Row-level rules written as Column expressions.

Each function takes Columns (or column names) and returns a Column, so it
stays inside whole-stage codegen.  Edges are inclusive lower bounds checked
top-down, exactly as the bands are defined in ``febrile.config``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from febrile import config as C

__all__ = [
    "col_of", "nan_to_null", "at_least", "trunc_long", "usable_coords", "severity_index",
    "map_risk_label", "map_risk_color", "map_opacity", "map_fill_opacity",
    "map_radius_m", "public_risk_level", "public_risk_color", "public_risk_bg",
    "public_advice", "card_fill", "card_border", "priority_badge",
    "priority_color", "safe_float", "estimate_population", "extract_state",
    "threshold_predict", "fmt_pct", "fmt_fixed", "fmt_thousands",
]


def col_of(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def nan_to_null(c) -> Column:
    """NaN compares true against thresholds in Spark; treat it as missing."""
    c = col_of(c)
    return F.when(F.isnan(c), F.lit(None).cast("double")).otherwise(c)


def at_least(c, edge: float) -> Column:
    """``c >= edge`` where a missing or NaN value is below every edge."""
    return F.coalesce(nan_to_null(c) >= F.lit(float(edge)), F.lit(False))


def trunc_long(c) -> Column:
    """Truncate toward zero (Python ``int()``): Spark's double->bigint cast."""
    return col_of(c).cast("bigint")


def usable_coords(lat="lat", lon="lon") -> Column:
    """Coordinates count as present only when both are non-null and non-zero."""
    lat, lon = col_of(lat), col_of(lon)
    return (F.coalesce(lat != 0, F.lit(False)) & F.coalesce(lon != 0, F.lit(False)))


def severity_index(p_outbreak, p_type) -> Column:
    return col_of(p_outbreak) * col_of(p_type)


def _banded(sev, bands, pick, low) -> Column:
    sev = nan_to_null(sev)
    expr = None
    for band in bands:
        cond = sev >= F.lit(float(band[0]))
        expr = F.when(cond, F.lit(pick(band))) if expr is None else expr.when(cond, F.lit(pick(band)))
    return expr.otherwise(F.lit(low))


def map_risk_label(sev) -> Column:
    return _banded(sev, C.MAP_BANDS, lambda b: b[1], C.MAP_BAND_LOW[0])


def map_risk_color(sev) -> Column:
    return _banded(sev, C.MAP_BANDS, lambda b: b[2], C.MAP_BAND_LOW[1])


def map_opacity(sev) -> Column:
    return F.lit(C.MAP_OPACITY_BASE) + col_of(sev) * F.lit(C.MAP_OPACITY_SLOPE)


def map_fill_opacity(sev) -> Column:
    return map_opacity(sev) * F.lit(C.MAP_FILL_FACTOR)


def map_radius_m(sev, population) -> Column:
    """Circle radius: from population when positive, else from severity."""
    pop = col_of(population).cast("double")
    from_pop = F.sqrt(pop / F.lit(float(C.MAP_PEOPLE_PER_KM2)) / F.lit(math.pi)) * F.lit(1000.0)
    clamped = F.greatest(F.lit(float(C.MAP_RADIUS_MIN_M)),
                         F.least(F.lit(float(C.MAP_RADIUS_MAX_M)), from_pop))
    from_sev = F.lit(float(C.MAP_RADIUS_DEFAULT_BASE_M)) + col_of(sev) * F.lit(float(C.MAP_RADIUS_DEFAULT_SLOPE_M))
    return F.when(pop > 0, clamped).otherwise(from_sev)


def public_risk_level(sev) -> Column:
    return _banded(sev, C.PUBLIC_BANDS, lambda b: b[1], C.PUBLIC_BAND_LOW[0])


def public_risk_color(sev) -> Column:
    return _banded(sev, C.PUBLIC_BANDS, lambda b: b[2], C.PUBLIC_BAND_LOW[1])


def public_risk_bg(sev) -> Column:
    return _banded(sev, C.PUBLIC_BANDS, lambda b: b[3], C.PUBLIC_BAND_LOW[2])


def public_advice(sev) -> Column:
    return _banded(sev, C.PUBLIC_BANDS, lambda b: b[4], C.PUBLIC_BAND_LOW[3])


def card_fill(sev) -> Column:
    return _banded(sev, C.CARD_BANDS, lambda b: b[1], C.CARD_BAND_LOW[0])


def card_border(sev) -> Column:
    return _banded(sev, C.CARD_BANDS, lambda b: b[2], C.CARD_BAND_LOW[1])


def priority_badge(sev) -> Column:
    return _banded(sev, C.PRIORITY_BADGES, lambda b: b[1], C.PRIORITY_BADGE_LOW[0])


def priority_color(sev) -> Column:
    return _banded(sev, C.PRIORITY_BADGES, lambda b: b[2], C.PRIORITY_BADGE_LOW[1])


def safe_float(c, default: float) -> Column:
    """Parse to double; null, NaN or unparsable text gives ``default``."""
    c = col_of(c)
    parsed = c.try_cast("double")
    return F.when(parsed.isNull() | F.isnan(parsed), F.lit(float(default))).otherwise(parsed)


def estimate_population(place_type, importance) -> Column:
    """Population guess from a place candidate: factor by type, truncated, floored."""
    pt = col_of(place_type)
    imp = F.coalesce(col_of(importance), F.lit(C.DEFAULT_IMPORTANCE))
    factor = (F.when(pt.isin(*C.POP_TYPES_LARGE), F.lit(float(C.POP_FACTOR_LARGE)))
              .when(pt.isin(*C.POP_TYPES_SMALL), F.lit(float(C.POP_FACTOR_SMALL)))
              .otherwise(F.lit(float(C.POP_FACTOR_OTHER))))
    return F.greatest(F.lit(C.POP_MIN_ESTIMATE).cast("bigint"), trunc_long(imp * factor))


def extract_state(address) -> Column:
    """First non-empty of address.state, address.state_district, else the fallback."""
    a = col_of(address)
    return F.coalesce(F.nullif(a.getItem("state"), F.lit("")),
                      F.nullif(a.getItem("state_district"), F.lit("")),
                      F.lit(C.FALLBACK_STATE))


def threshold_predict(score, threshold: float) -> Column:
    return at_least(score, threshold).cast("int")


def fmt_pct(c, decimals: int) -> Column:
    """``{:.Nf%}``-style text (display only)."""
    return F.concat(F.format_number(col_of(c) * F.lit(100.0), decimals), F.lit("%"))


def fmt_fixed(c, decimals: int) -> Column:
    return F.format_string(f"%.{decimals}f", col_of(c))


def fmt_thousands(c) -> Column:
    return F.format_number(col_of(c).cast("bigint"), 0)
