"""Column -> Column functions.  All built-in
expressions: they stay inside whole-stage code generation, no UDF."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# The timestamp text format of the source files and the id
# prefix length used in reports.
TIMESTAMP_FORMAT = "yyyy-MM-dd HH:mm:ss"
ID_PREFIX_LENGTH = 5
SECONDS_PER_DAY = 86400


def parse_timestamp(text: Column, fmt: str = TIMESTAMP_FORMAT) -> Column:
    """G1: parse with a fixed format into TIMESTAMP_NTZ.  A malformed value
    raises under ANSI mode; NULL stays NULL."""
    return F.to_timestamp_ntz(text, F.lit(fmt))


def seconds_between(start: Column, end: Column) -> Column:
    """``end - start`` in whole seconds."""
    return F.timestamp_diff("SECOND", start, end)


def days_floor(seconds: Column) -> Column:
    """Whole days, rounding toward minus infinity (-12 h -> -1)."""
    return F.floor(seconds / F.lit(float(SECONDS_PER_DAY)))


def l1_distance(lat: Column, lng: Column, lat0: Column, lng0: Column) -> Column:
    """|lat - lat0| + |lng - lng0|; NULL if any part is NULL."""
    return F.abs(lat - lat0) + F.abs(lng - lng0)


def id_prefix(value: Column, length: int = ID_PREFIX_LENGTH) -> Column:
    """First ``length`` characters of the id text."""
    return F.substring(value.cast("string"), 1, length)


def first_part(joined: Column, sep: str = ", ") -> Column:
    """First element of a separated string."""
    return F.element_at(F.split(joined, sep, -1), 1)


def last_part(joined: Column, sep: str = ", ") -> Column:
    """Last element of a separated string."""
    return F.element_at(F.split(joined, sep, -1), -1)


def fixed_width(label: Column, value: Column, left: int = 35, right: int = 15) -> Column:
    """Label left-aligned in ``left`` characters, value right-aligned in
    ``right``; padding never cuts a longer text."""
    return F.format_string(f"%-{left}s%{right}s", label, value)


def two_decimals(x: Column) -> Column:
    """Number as text with two decimals, rounded as Python's format does:
    by the exact binary value, a true tie to the even digit (Java's ``%.2f``
    rounds the shortest decimal text instead, 0.125 -> 0.13).

    The fraction is cut at 2**-26 into two parts whose products with 100 are
    exact, so the distance from a tie has the right sign.  NULL and NaN print
    as ``nan``.  For amounts below 2**53 cents."""
    v = F.abs(x.cast("double"))
    whole = F.floor(v)
    frac = v - whole
    high = F.floor(frac * F.lit(67108864.0)) / F.lit(67108864.0)
    low = frac - high
    guess = F.floor(frac * 100.0)
    # the guess is one too many if the product was rounded up to it
    cents = F.when((high * 100.0 - guess) + low * 100.0 < 0, guess - 1).otherwise(guess)
    over = (high * 100.0 - cents - 0.5) + low * 100.0
    up = (over > 0) | ((over == 0) & (cents % 2 == 1))
    total = (whole * 100 + cents + F.when(up, 1).otherwise(0)).cast("long")
    negative = (x < 0) | x.cast("string").startswith("-")
    text = F.concat(F.when(negative, "-").otherwise(""), F.floor(total / 100).cast("string"),
                    F.lit("."), F.lpad((total % 100).cast("string"), 2, "0"))
    return F.when(x.isNull() | F.isnan(x.cast("double")), "nan").otherwise(text)


def centered(text: Column, width: int = 50, fill: str = "#") -> Column:
    """``text`` centred in ``width`` characters, padded with ``fill``
    (extra fill character goes to the right, as Python's ``^`` does)."""
    n = F.length(text)
    pad = F.greatest(F.lit(width) - n, F.lit(0))
    left = F.floor(pad / 2).cast("int")
    right = (pad - left).cast("int")
    return F.concat(F.repeat(F.lit(fill), left), text, F.repeat(F.lit(fill), right))


def nulls_last_key(columns: Sequence[str]) -> Column:
    """A struct that sorts like ``ORDER BY c1 ASC NULLS LAST, c2 ...``."""
    fields = []
    for i, c in enumerate(columns):
        fields += [F.col(c).isNull().alias(f"_n{i}"), F.col(c).alias(f"_v{i}")]
    return F.struct(*fields)


# Amounts of money are multiples of 10 ** -MONEY_SCALE of their unit (a finer one is
# rounded to it) below 10 ** 14.
MONEY_SCALE = 4


def exact_sum(amount: Column) -> Column:
    """Aggregate: the sum of amounts of money as a decimal, so that it is the same
    whatever the order of the rows or the partitions."""
    return F.sum(amount.cast(f"decimal(18,{MONEY_SCALE})"))


def exact_quotient(total: Column, n: Column) -> Column:
    """A decimal sum by a count: one division of two whole numbers, NULL if n is 0."""
    scale = 10 ** MONEY_SCALE
    return F.try_divide((total * scale).cast("double"), n.cast("double") * float(scale))


def exact_mean(amount: Column) -> Column:
    """Aggregate: the mean of amounts of money, NULLs left out; free of the order of
    summation, with one rounding."""
    return exact_quotient(exact_sum(amount), F.count(amount))


# Fractions are summed in units of 2 ** -FRACTION_BITS.
FRACTION_BITS = 52


def stable_mean(x: Column) -> Column:
    """Aggregate: the mean of doubles below 2 ** 63, free of the order of summation:
    whole parts and fractions (cut at 2 ** -52) are summed as whole numbers."""
    unit = F.lit(float(1 << FRACTION_BITS))
    whole = F.floor(x)
    part = F.floor((x - whole) * unit)
    n = F.count(x)
    return (F.try_divide(F.sum(whole.cast("decimal(20,0)")).cast("double"), n)
            + F.try_divide(F.sum(part.cast("decimal(20,0)")).cast("double"), n) / unit)
