"""Small numeric expressions shared by every operator."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def finite(col: Column) -> Column:
    """NaN and infinities become NULL, the only missing marker inside the package."""
    value = col.cast("double")
    return F.when(~F.isnan(value) & (F.abs(value) != F.lit(math.inf)), value)


def normalise_missing(df: DataFrame) -> DataFrame:
    floating = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    return df.select(*[finite(F.col(c)).alias(c) if c in floating else F.col(c) for c in df.columns])


def safe_rate(numerator: Column, denominator: Column) -> Column:
    """NULL, never 0, where the denominator is 0: an undefined rate is not a zero rate."""
    return F.try_divide(numerator.cast("double"), denominator.cast("double"))


def rate_of(part: Column, whole: Column) -> Column:
    """Share of the rows satisfying ``whole`` that also satisfy ``part``."""
    return safe_rate(F.count_if(part & whole), F.count_if(whole))


def review_count(total: Column, fraction: float | Column, min_one: bool = False) -> Column:
    """Half-to-even review quota, clipped to the queue; ``min_one`` reviews at least one row."""
    share = fraction if isinstance(fraction, Column) else F.lit(float(fraction))
    count = F.least(total.cast("double"), F.greatest(F.lit(0.0), F.rint(total * share)))
    if min_one:
        count = F.when(total > 0, F.greatest(F.lit(1.0), count)).otherwise(F.lit(0.0))
    return count.cast("long")


def check_fraction(value: float, name: str, inclusive: bool = False) -> float:
    value = float(value)
    if not (0 <= value <= 1 if inclusive else 0 < value < 1):
        raise ValueError(f"{name} must be in {'[0, 1]' if inclusive else '(0, 1)'}.")
    return value


def stable_seed(*parts: Column | str | int) -> Column:
    """32-bit seed from the leading hex digits of sha-256 over the joined parts."""
    text = F.concat_ws("|", *[(p if isinstance(p, Column) else F.lit(str(p))).cast("string") for p in parts])
    return F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("long")


def unit_draw(*parts: Column | str | int) -> Column:
    """Deterministic uniform draw in [0, 1) with 52 bits, so that every row of a large panel can be drawn."""
    text = F.concat_ws("|", *[(p if isinstance(p, Column) else F.lit(str(p))).cast("string") for p in parts])
    return F.conv(F.substring(F.sha2(text, 256), 1, 13), 16, 10).cast("long") / F.lit(float(2 ** 52))


def missing_count(columns: list[str]) -> Column:
    total = F.lit(0)
    for c in columns:
        total = total + F.col(c).isNull().cast("int")
    return total.cast("long")


def snap(value: Column, threshold: Column, tolerance: float = 1e-12) -> Column:
    """Pull values within ``tolerance`` of a threshold onto it before comparing."""
    return F.when(F.abs(value - threshold) <= tolerance, threshold).otherwise(value)


def any_of(flags: list[Column]) -> Column:
    out = F.lit(False)
    for f in flags:
        out = out | f
    return out


def coerce_bool(col: Column) -> Column:
    """Boolean-like text, numbers or booleans to BOOLEAN; anything else fails the job."""
    text = F.lower(F.trim(col.cast("string")))
    text = F.regexp_replace(text, r"^([01])\.0$", "$1")
    return (
        F.when(text.isin("true", "1", "yes"), F.lit(True))
        .when(text.isin("false", "0", "no"), F.lit(False))
        .otherwise(F.raise_error(F.concat(F.lit("not a boolean-like value: "), F.coalesce(text, F.lit("NULL")))).cast("boolean"))
    )
