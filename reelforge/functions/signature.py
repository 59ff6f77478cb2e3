"""A 64-bit signature of a description: exclusive or with each value, then a wrapping multiplication.

All values are whole numbers; a text counts as its length and its UTF-16 units, a null text as an empty one, a flag as 1 or
0, and a null number as the least 32-bit one.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Where it starts, and the multiplier 2**40 + FACTOR.
SEED, FACTOR = -3750763034362895579, 435
LOW = 0xFFFFFFFF


def of_text(text: Column) -> Column:
    """Length and UTF-16 units."""
    units = F.hex(F.encode(F.coalesce(text, F.lit("")), "UTF-16BE"))
    n = F.floor(F.length(units) / 4).cast("int")
    codes = F.transform(F.sequence(F.lit(1), n), lambda i: F.conv(F.substr(units, i * 4 - 3, F.lit(4)), 16, 10).cast("long"))
    none = F.array().cast("array<long>")
    return F.concat(F.array(n.cast("long")), F.when(n > 0, codes).otherwise(none))


def of_flag(flag: Column) -> Column:
    return F.array(F.when(flag, 1).otherwise(0).cast("long"))


def of_number(number: Column) -> Column:
    return F.array(F.coalesce(number, F.lit(-(2**31))).cast("long"))


def multiplied(h: Column) -> Column:
    """h * (2**40 + FACTOR) modulo 2**64, in halves of 32 bits, as nothing may overflow under ANSI rules."""
    low, high = h.bitwiseAND(F.lit(LOW)), F.shiftrightunsigned(h, 32)
    product = low * FACTOR
    top = (high * FACTOR + F.shiftright(product, 32) + F.shiftleft(low, 8).bitwiseAND(F.lit(LOW))).bitwiseAND(F.lit(LOW))
    return F.shiftleft(top, 32).bitwiseOR(product.bitwiseAND(F.lit(LOW)))


def signature(*parts: Column) -> Column:
    """The signature of arrays of values, one after another, as an unsigned number in base 16."""
    whole = F.aggregate(F.concat(*parts), F.lit(SEED).cast("long"), lambda h, x: F.get(F.transform(F.array(h.bitwiseXOR(x)), multiplied), F.lit(0)))
    return F.lower(F.hex(whole))
