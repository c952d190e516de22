"""Column-expression helpers (all built-in Spark functions; nothing runs in Python per row)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values ---------------------------------------------------------------------------
SEASON_AMPLITUDE = 0.25     # seasonality factor 1 + 0.25 * sin(2*pi*doy / 182.5)
SEASON_PERIOD_DAYS = 182.5
# -------------------------------------------------------------------------------------------


def col_(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def exact_ratio(num, den, scale: int) -> Column:
    """``num / den`` for integral ``num`` and ``den`` (any sign of ``num``, ``den`` > 0), rounded
    to ``scale`` decimals with ties away from zero, computed exactly on decimal(38,0)
    integers -- ``floor((2 * |num| * 10^scale + den) / (2 * den))`` with the sign of ``num`` --
    and returned as the nearest double.  No floating-point sum or division precedes the rounding, so the result
    does not depend on summation order or engine.  NULL when ``den`` is 0 or NULL."""
    n = col_(num).cast("decimal(38,0)")
    d = col_(den).cast("decimal(38,0)")
    a = F.abs(n) * F.lit(2 * 10 ** scale).cast("decimal(38,0)") + d
    b = d * F.lit(2).cast("decimal(38,0)")
    q = ((a - F.pmod(a, b)) / b).cast("decimal(38,0)")          # exact floor division
    q = F.when(n < 0, -q).otherwise(q)
    return F.when(d > 0, (q / F.lit(10 ** scale).cast("decimal(38,0)")).cast("double"))


def scaled_int(c, in_scale: int) -> Column:
    """A value with at most ``in_scale`` decimals as the exact integer ``value * 10^in_scale``."""
    return (col_(c).cast(f"decimal(38,{in_scale})") * F.lit(10 ** in_scale)).cast("decimal(38,0)")


def exact_avg(c, in_scale: int, out_scale: int = 6, window=None) -> Column:
    """Mean of a column whose values have at most ``in_scale`` decimals, rounded exactly to
    ``out_scale`` decimals (see ``exact_ratio``); NULLs ignored like ``avg``.  With ``window``
    it is the windowed mean over that frame."""
    total, n = F.sum(scaled_int(c, in_scale)), F.count(col_(c))
    if window is not None:
        total, n = total.over(window), n.over(window)
    return exact_ratio(total, n * F.lit(10 ** in_scale), out_scale)


def rate_pct(num, den, scale: int = 2) -> Column:
    """``num * 100 / den`` (integral counts) rounded to ``scale`` decimals, exactly; 0 when the
    denominator is 0 or NULL."""
    return F.coalesce(exact_ratio(col_(num) * 100, col_(den), scale), F.lit(0.0))


def seasonality(date_col) -> Column:
    """``1 + 0.25 * sin(2*pi*dayofyear / 182.5)``."""
    return 1 + SEASON_AMPLITUDE * F.sin(2 * math.pi * F.dayofyear(col_(date_col)) / SEASON_PERIOD_DAYS)


def month_fraction(date_col, scale: int = 6) -> Column:
    """Proration of a month: day of month / days in month, ``scale`` decimals HALF_UP."""
    d = col_(date_col)
    return F.round(F.dayofmonth(d).cast("decimal(10,0)") / F.dayofmonth(F.last_day(d)).cast("decimal(10,0)"),
                   scale).cast(f"decimal(10,{scale})")


def pair_label(base="base", quote="cotizada") -> Column:
    """``base || '/' || cotizada``; NULL when either side is NULL (unlike ``concat_ws``)."""
    return F.concat(col_(base), F.lit("/"), col_(quote))


def notif_status(read="leida", converted="convertida") -> Column:
    """convertida > leida > enviada."""
    return (F.when(F.coalesce(col_(converted), F.lit(False)), F.lit("convertida"))
            .when(F.coalesce(col_(read), F.lit(False)), F.lit("leida"))
            .otherwise(F.lit("enviada")))


def yyyymmdd(date_col) -> Column:
    return F.date_format(col_(date_col), "yyyyMMdd").cast("int")


def epoch_seconds(ts_col) -> Column:
    """Seconds since the epoch as double (works for TIMESTAMP and TIMESTAMP_NTZ)."""
    c = col_(ts_col)
    return F.unix_micros(c.cast("timestamp")).cast("double") / 1e6


def clamp(value: int, lo: int, hi: int) -> int:
    """Caller-side clamp of a limit parameter (a plain int, not a column)."""
    return max(lo, min(hi, int(value)))
