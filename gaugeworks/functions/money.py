"""Exact 64-bit money arithmetic (F3-F9) as native Column expressions.

Values are integers of 10^-7 units ("stroops") stored as ``bigint``.
Intermediates are ``decimal(38,0)``: the product of two 64-bit extremes (about
8.5e37) fits, so nothing is rounded. ``on_overflow`` chooses between raising
(``raise_error``, the source's behaviour) and quarantining as NULL so one bad
row does not fail a batch job.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
TARGET_DECIMALS = 7
MAX_I64 = 2 ** 63 - 1
MIN_I64 = -(2 ** 63)
HIGH_WATERMARK_PCT = 80

D38 = "decimal(38,0)"


def _c(x) -> Column:
    if isinstance(x, Column):
        return x
    if isinstance(x, str):
        return F.col(x)
    return F.lit(x)


def dec(x) -> Column:
    return _c(x).cast(D38)


def pow10(n) -> Column:
    """Exact ``10^n`` as decimal(38,0) for ``0 <= n <= 37``."""
    n = _c(n)
    return F.rpad(F.lit("1"), (n + 1).cast("int"), "0").cast(D38)


def int_div(a: Column, b: Column) -> Column:
    """Integer division truncating toward zero on decimal(38,0), exact."""
    a, b = dec(a), dec(b)
    return ((a - a % b) / b).cast(D38)


def is_overflow(v) -> Column:
    """true when ``v`` lies outside the signed 64-bit range."""
    v = dec(v)
    return (v > F.lit(MAX_I64).cast(D38)) | (v < F.lit(MIN_I64).cast(D38))


def _checked(v: Column, what: str, on_overflow: str) -> Column:
    bad = is_overflow(v)
    if on_overflow == "raise":
        return F.when(bad, F.raise_error(F.lit(f"{what} overflows signed 64-bit"))).otherwise(v.cast("bigint"))
    if on_overflow == "null":
        return F.when(bad, F.lit(None).cast("bigint")).otherwise(v.cast("bigint"))
    raise ValueError(on_overflow)


def to_target_precision(raw, source_decimals, on_overflow: str = "null") -> Column:
    """rescale to 7 decimals; down-scaling truncates toward zero."""
    raw, d = dec(raw), _c(source_decimals)
    scaled = (F.when(d == TARGET_DECIMALS, raw)
               .when(d > TARGET_DECIMALS, int_div(raw, pow10(d - TARGET_DECIMALS)))
               .otherwise((raw * pow10(TARGET_DECIMALS - d)).cast(D38)))
    return _checked(scaled, "precision conversion", on_overflow)


def multiply_with_precision(a, b, precision_decimals) -> Column:
    """``(a * b) / 10^p`` truncated toward zero, as decimal(38,0)."""
    return int_div((dec(a) * dec(b)).cast(D38), pow10(precision_decimals))


def checked_add(a, b, on_overflow: str = "null") -> Column:
    """exact sum, overflow raises or gives NULL."""
    return _checked((dec(a) + dec(b)).cast(D38), "addition", on_overflow)


def checked_multiply(a, b, on_overflow: str = "null") -> Column:
    """exact product, overflow raises or gives NULL."""
    return _checked((dec(a) * dec(b)).cast(D38), "multiplication", on_overflow)


def round_up_div(a, b, on_zero: str = "null") -> Column:
    """division rounding away from zero (-7/3 = -3, 1/7 = 1); zero divisor raises or NULL."""
    a, b = dec(a), dec(b)
    aa, ab = F.abs(a), F.abs(b)
    num = (aa + ab - F.lit(1)).cast(D38)
    q = ((num - num % ab) / ab).cast(D38)
    signed = F.when((a < 0) != (b < 0), -q).otherwise(q)
    res = F.when(a == 0, F.lit(0).cast(D38)).otherwise(signed)
    zero = F.raise_error(F.lit("Division by zero")) if on_zero == "raise" else F.lit(None).cast(D38)
    return F.when(b == 0, zero).otherwise(res)


def high_watermark() -> Column:
    """80 % of the signed 64-bit maximum, integer division as in the source."""
    return F.lit(MAX_I64 * HIGH_WATERMARK_PCT // 100).cast(D38)


def price_units_flag(price, units) -> Column:
    """F8: true when the exact product exceeds the high watermark."""
    return (dec(price) * dec(units)).cast(D38) > high_watermark()


def decimal_string_to_units(s, decimals: int = TARGET_DECIMALS) -> Column:
    """decimal string to an integer of 10^-decimals units.

    The fraction is padded or cut to ``decimals`` digits. The sign applies to
    the whole value (``-1.5`` is -15000000); the source adds the fraction of
    a negative number instead, which we record as a deviation.
    """
    s = F.trim(_c(s))
    neg = s.startswith("-")
    body = F.regexp_replace(s, r"^[+-]", "")
    whole = F.split(body, r"\.").getItem(0)
    frac = F.coalesce(F.get(F.split(body, r"\."), 1), F.lit(""))
    whole = F.when(whole == "", F.lit("0")).otherwise(whole)
    frac7 = F.rpad(F.substring(frac, 1, decimals), decimals, "0")
    mag = (dec(whole) * pow10(decimals) + dec(frac7)).cast(D38)
    return _checked(F.when(neg, -mag).otherwise(mag), "balance", "null")


def units_to_decimal_string(v, decimals: int = TARGET_DECIMALS) -> Column:
    """Inverse of F9 for formatting: ``-12345`` -> ``-0.0012345``."""
    v = dec(v)
    a = F.abs(v)
    p = pow10(decimals)
    whole = ((a - a % p) / p).cast(D38)
    frac = (a % p).cast(D38)
    return F.concat(F.when(v < 0, F.lit("-")).otherwise(F.lit("")), whole.cast("string"), F.lit("."),
                    F.lpad(frac.cast("string"), decimals, "0"))
