"""Row keys and tier keys as Column expressions.

A *row key text* names a row: one key value stands as it is; several are joined by
U+001F after every backslash is doubled and every U+001F gets a backslash in front.
A *tier key* is the ageing column mapped onto int64 so that order is kept.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import UTC, date, datetime, timedelta

from pyspark.sql import Column, functions as F

KEY_SEPARATOR = "\x1f"
INT64_MIN = -(2**63)
INT64_MAX = 2**63 - 1
EPOCH = datetime(1970, 1, 1)


def escape_key_part(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit(KEY_SEPARATOR), F.lit("\\" + KEY_SEPARATOR))


def key_text(parts: Sequence[Column]) -> Column:
    """Key text of a fixed list of key columns; null when any part is null."""
    texts = [p.cast("string") for p in parts]
    if len(texts) == 1:
        return texts[0]
    joined = F.concat_ws(KEY_SEPARATOR, *[escape_key_part(t) for t in texts])
    missing = texts[0].isNull()
    for t in texts[1:]:
        missing = missing | t.isNull()
    return F.when(~missing, joined)


def key_text_by_names(names: Column, available: dict[str, Column]) -> Column:
    """Key text where ``names`` (array<string>) differs from row to row.

    ``available`` maps every name that may occur to its column.  Null when the array is
    null or empty, a name is unknown or a value is null.
    """

    def value(name: Column) -> Column:
        out = F.lit(None).cast("string")
        for known, col in available.items():
            out = F.when(name == known, col.cast("string")).otherwise(out)
        return out

    single = value(F.try_element_at(names, F.lit(1)))
    parts = F.transform(names, lambda n: escape_key_part(value(n)))
    complete = ~F.exists(parts, lambda p: p.isNull())
    return F.when(F.size(names) == 1, single).when((F.size(names) > 1) & complete, F.array_join(parts, KEY_SEPARATOR))


def encode_key(values: Sequence[object]) -> str:
    """Key text of plain values, for driver-side use."""
    if any(v is None for v in values):
        raise ValueError("a row key has a null part")
    if len(values) == 1:
        return str(values[0])
    return KEY_SEPARATOR.join(str(v).replace("\\", "\\\\").replace(KEY_SEPARATOR, "\\" + KEY_SEPARATOR) for v in values)


def decode_key(text: str, width: int) -> list[str]:
    """Inverse of :func:`encode_key` for keys of ``width`` parts."""
    if width == 1:
        return [text]
    parts, current, i = [], [], 0
    while i < len(text):
        c = text[i]
        if c == "\\" and i + 1 < len(text):
            current.append(text[i + 1])
            i += 2
            continue
        if c == KEY_SEPARATOR:
            parts.append("".join(current))
            current = []
        else:
            current.append(c)
        i += 1
    parts.append("".join(current))
    if len(parts) != width:
        raise ValueError(f"key text has {len(parts)} parts, not {width}")
    return parts


def micros(col: Column, dtype: str) -> Column:
    """Microseconds since 1970 of a timestamp column of either kind, whatever the session zone."""
    if dtype == "timestamp_ntz":
        return F.timestamp_diff("MICROSECOND", F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'"), col)
    return F.unix_micros(col)


class TierKeyType:
    """Codec between a native tier-key column and its canonical int64."""

    def __init__(self, name: str):
        aliases = {"timestamp with time zone": "timestamptz", "timestamp without time zone": "timestamp", "integer": "bigint", "smallint": "bigint", "int": "bigint", "long": "bigint"}
        self.name = aliases.get(name, name)
        if self.name not in ("bigint", "timestamptz", "timestamp", "date"):
            raise ValueError(f"unsupported tier key type {name!r}")

    def __eq__(self, other: object) -> bool:
        return isinstance(other, TierKeyType) and other.name == self.name

    def __hash__(self) -> int:
        return hash(self.name)

    def encode(self, col: Column, dtype: str | None = None) -> Column:
        if self.name == "bigint":
            return col.cast("long")
        if self.name == "date":
            return F.unix_date(col.cast("date")).cast("long")
        return micros(col, dtype or ("timestamp_ntz" if self.name == "timestamp" else "timestamp"))

    def native(self, key: int, dtype: str | None = None) -> Column:
        """Literal in the column's own type, so that a comparison with it reaches the file scan.

        Keys outside the range of the type are clamped to its ends.
        """
        if self.name == "bigint":
            return F.lit(key).cast("long")
        if self.name == "date":
            return F.lit(date(1970, 1, 1) + timedelta(days=min(max(key, -719162), 2932896)))
        low, high = -62135596800000000, 253402300799999999
        when = EPOCH + timedelta(microseconds=min(max(key, low), high))
        kind = dtype or ("timestamp_ntz" if self.name == "timestamp" else "timestamp")
        text = when.strftime("%Y-%m-%d %H:%M:%S.%f").rjust(26, "0")
        return F.expr(f"TIMESTAMP_NTZ'{text}'" if kind == "timestamp_ntz" else f"TIMESTAMP'{text}+00:00'")

    def canonical(self, value: object) -> int:
        """int64 of a plain Python value or its text."""
        if isinstance(value, bool) or value is None:
            raise ValueError(f"no tier key: {value!r}")
        if self.name == "bigint":
            return int(value)
        if self.name == "date":
            if isinstance(value, datetime):
                value = value.date()
            day = value if isinstance(value, date) else date.fromisoformat(str(value))
            return (day - date(1970, 1, 1)).days
        if isinstance(value, int):
            return value
        when = value if isinstance(value, datetime) else self._parse(str(value))
        if when.tzinfo is not None:
            when = when.astimezone(UTC).replace(tzinfo=None)
        delta = when - EPOCH
        return (delta.days * 86400 + delta.seconds) * 1_000_000 + delta.microseconds

    @staticmethod
    def _parse(text: str) -> datetime:
        head, _, fraction = text.strip().replace("T", " ").partition(".")
        zone = ""
        if fraction:
            digits = len(fraction) - len(fraction.lstrip("0123456789"))
            zone, fraction = fraction[digits:], fraction[:digits][:6]
        extra = 0
        if head[17:19] == "60":
            head, extra = head[:17] + "59" + head[19:], 1
        return datetime.fromisoformat(head + (f".{fraction:0<6}" if fraction else "") + zone) + timedelta(seconds=extra)

    def lag(self, text: str | int) -> int:
        """A lag or width such as ``7d``, ``12h``, ``30m``, ``10s`` in units of this key; plain numbers stand for themselves."""
        text = str(text).strip()
        unit = {"d": 86400, "h": 3600, "m": 60, "s": 1}.get(text[-1:])
        if unit is None:
            return int(text)
        seconds = int(text[:-1]) * unit
        if self.name == "bigint":
            raise ValueError(f"a bigint tier key takes a plain number, not {text!r}")
        if self.name == "date":
            if seconds % 86400:
                raise ValueError(f"a date tier key takes whole days, not {text!r}")
            return seconds // 86400
        return seconds * 1_000_000

    def token(self, key: int) -> str:
        """Name part of a generated partition that begins at ``key``."""
        if self.name == "bigint":
            return str(key) if key >= 0 else f"m{-key}"
        if self.name == "date":
            return (date(1970, 1, 1) + timedelta(days=key)).strftime("%Y%m%d")
        return (EPOCH + timedelta(microseconds=key)).strftime("%Y%m%dT%H%M%S")


def band_floor(key: Column, width: int) -> Column:
    """Start of the band of ``width`` that holds ``key``; exact for negative keys."""
    return key - F.pmod(key, F.lit(width))
