"""Draws that a row's key and a seed fix, whatever task the row is in."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def lcg(state: Column) -> Column:
    """The next state of a 31-bit linear congruential generator."""
    return ((state.cast("long") % 2147483648) * 1103515245 + 12345) % 2147483648


def mulberry32(seed: Column) -> Column:
    """The first draw, 0 to 1, of a 32-bit mulberry generator with this seed."""
    low = 0xFFFFFFFF
    word = lambda c: c.bitwiseAND(F.lit(low))
    imul = lambda a, b: word((word(a) * word(b.bitwiseAND(F.lit(0xFFFF)))) + F.shiftleft(word(a) * F.shiftrightunsigned(word(b), 16), 16))
    a = word(seed.cast("long") + 0x6D2B79F5)
    t = imul(a.bitwiseXOR(F.shiftrightunsigned(a, 15)), a.bitwiseOR(F.lit(1)))
    t = word(t.bitwiseXOR(word(t + imul(t.bitwiseXOR(F.shiftrightunsigned(t, 7)), t.bitwiseOR(F.lit(61))))))
    return t.bitwiseXOR(F.shiftrightunsigned(t, 14)) / 4294967296


def bucket(n: int, *parts: Column) -> Column:
    """0 to n - 1 by SHA-256 of the parts."""
    return (F.conv(F.substring(F.sha2(F.concat_ws("\u001f", *parts), 256), 1, 8), 16, 10).cast("long") % n).cast("int")
