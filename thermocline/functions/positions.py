"""Log positions: unsigned 64-bit numbers, written as a decimal number or as ``H/L`` in hex."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

SIGN_BIT = -(2**63)


def position_rank(position: Column) -> Column:
    """Signed long that sorts as the unsigned position does."""
    return position.cast("long").bitwiseXOR(F.lit(SIGN_BIT))


def parse_position_rank(text: Column) -> Column:
    """:func:`position_rank` of a position in either spelling; null when it is neither."""
    text = F.trim(text)
    pair = F.regexp_extract(text, r"^([0-9A-Fa-f]{1,8})/([0-9A-Fa-f]{1,8})$", 0) != ""
    high = F.conv(F.split_part(text, F.lit("/"), F.lit(1)), 16, 10).cast("long")
    low = F.conv(F.split_part(text, F.lit("/"), F.lit(2)), 16, 10).cast("long")
    by_pair = F.shiftleft(high, 32).bitwiseOR(low).bitwiseXOR(F.lit(SIGN_BIT))
    number = F.when(text.rlike(r"^[0-9]{1,20}$"), text.try_cast("decimal(20,0)"))
    by_number = (number - F.expr("CAST('9223372036854775808' AS DECIMAL(20,0))")).try_cast("long")
    return F.when(pair, by_pair).otherwise(by_number)


def parse_position(text: str) -> int:
    high, slash, low = text.strip().partition("/")
    value = (int(high, 16) << 32 | int(low, 16)) if slash else int(high)
    if not 0 <= value < 2**64:
        raise ValueError(f"no log position: {text!r}")
    return value


def format_position(value: int) -> str:
    return f"{value >> 32:X}/{value & 0xFFFFFFFF:X}"
