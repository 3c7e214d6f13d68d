"""Text cleaning and guarded number parsing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: what counts as a number (underscores group digits).
NUMBER = r"(?i)^[+-]?((\d+(_\d+)*(\.(\d+(_\d+)*)?)?|\.\d+(_\d+)*)(e[+-]?\d+(_\d+)*)?|inf|infinity)$"


# Fixed value: every character that counts as white space.
WHITE = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def strip(c: Column) -> Column:
    """Remove leading and trailing white space of every kind, not only blanks."""
    return F.btrim(c, F.lit(WHITE))


def number(t: Column) -> Column:
    """Parse stripped text as a double; null unless it is a plain decimal literal.

    A bare cast would also accept Java suffixes and hexadecimal floats.
    """
    return F.translate(F.regexp_extract(t, NUMBER, 0), "_", "").try_cast("double")


def half_even(c: Column, digits: int = 0) -> Column:
    """Round to digits as report fields are: by the exact binary value, true halves to even.

    The built-in rounds the shortest decimal text of a double instead, which
    turns 0.0235 (a little below the half) the other way. Only values next to
    a half take the exact path, which is a function of its own over one value:
    inline, a record of many rounded fields outgrows what Java can compile.
    """
    a = F.abs(c.cast("double"))
    ten = F.lit(float(10 ** digits))
    scaled = a * ten
    clear = (scaled < 2.0 ** 40) & (F.abs(scaled - F.floor(scaled) - 0.5) > 1e-3)
    out = F.when(clear, F.floor(scaled + 0.5) / ten).otherwise(F.get(F.transform(F.array(a), lambda x: _near_half(x, digits)), 0) / ten)
    return F.when(a < 2.0 ** 40, F.when(c < 0, -out).otherwise(out)).otherwise(c)


def _near_half(a: Column, digits: int) -> Column:
    """``a`` times ten to the digits, rounded with 100 binary digits of the fraction."""
    ten = 10 ** digits
    whole = F.floor(a)
    frac = (a - whole) * F.lit(2.0 ** 40)
    tail = F.floor((frac - F.floor(frac)) * F.lit(2.0 ** 60)).cast("decimal(19,0)")
    digits100 = F.floor(frac).cast("decimal(13,0)") * F.lit(2 ** 60).cast("decimal(19,0)") + tail
    bits = digits100 * F.lit(ten).cast("decimal(7,0)")
    unit, half = F.lit(str(2 ** 100)).cast("decimal(31,0)"), F.lit(str(2 ** 99)).cast("decimal(31,0)")
    rest = bits % unit
    low = whole * F.lit(ten) + ((bits - rest) / unit).cast("bigint")
    up = (rest > half) | ((rest == half) & (low % 2 == 1))
    return low + F.when(up, 1).otherwise(0)


def fixed1(c: Column) -> Column:
    """A value of at least zero with one decimal."""
    tenths = F.bround(half_even(c, 1) * 10).cast("bigint")
    return F.concat(F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string"))


def finite(c: Column) -> Column:
    """NaN and infinities become null, so that JSON stays valid."""
    return F.when(F.isnan(c) | (F.abs(c) == float("inf")), None).otherwise(c)
