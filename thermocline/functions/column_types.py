"""The nine column types of row batches and how texts are read as them."""

from __future__ import annotations

from pyspark.sql import Column, functions as F, types as T

# Type identifiers of the change stream and the column type each stands for.
TYPE_OF_OID = {
    16: "BOOLEAN",
    17: "BINARY",
    20: "LONG",
    21: "LONG",
    23: "LONG",
    26: "LONG",
    700: "DOUBLE",
    701: "DOUBLE",
    1082: "DATE",
    1114: "TIMESTAMP",
    1184: "TIMESTAMP",
    2950: "UUID",
}
NUMERIC_OID = 1700

SPARK_TYPE = {
    "BOOLEAN": T.BooleanType(),
    "LONG": T.LongType(),
    "DOUBLE": T.DoubleType(),
    "TEXT": T.StringType(),
    "TIMESTAMP": T.TimestampType(),
    "DATE": T.DateType(),
    "UUID": T.StringType(),
    "BINARY": T.BinaryType(),
}


def type_of(oid: int, type_mod: int) -> str:
    if oid == NUMERIC_OID:
        return "DECIMAL" if type_mod >= 4 else "DOUBLE"
    return TYPE_OF_OID.get(oid, "TEXT")


def column_type(given: Column, oid: Column, type_mod: Column) -> Column:
    """``given``, or where it is null what follows from the type identifier and modifier."""
    table = F.create_map(*[F.lit(x) for pair in TYPE_OF_OID.items() for x in pair])
    numeric = F.when(type_mod >= 4, F.lit("DECIMAL")).otherwise(F.lit("DOUBLE"))
    derived = F.when(oid == NUMERIC_OID, numeric).otherwise(F.coalesce(F.try_element_at(table, oid.cast("int")), F.lit("TEXT")))
    return F.coalesce(given, derived)


def precision_scale(type_mod: Column) -> tuple[Column, Column]:
    packed = type_mod - 4
    return F.shiftright(packed, 16).bitwiseAND(F.lit(0xFFFF)), packed.bitwiseAND(F.lit(0xFFFF))


def canonical_value(text: Column, kind: Column, type_mod: Column) -> Column:
    """Canonical text of ``text`` read as ``kind``; null when it can't be read so.

    Decimals are rounded half up to the scale and must fit the precision.  Up to 18 places and 20
    digits before them are read; a value or a type beyond that counts as one that can't be read,
    so that ingestion keeps its text as it is.
    """
    precision, scale = precision_scale(type_mod)
    places = F.when((scale >= 0) & (scale <= 18), scale).otherwise(F.lit(18))
    power = F.try_element_at(F.expr("array(" + ", ".join(f"CAST({10**i} AS DECIMAL(19,0))" for i in range(19)) + ")"), places + 1)
    unscaled = F.round(F.try_multiply(text.try_cast("decimal(38,18)"), power), 0).try_cast("decimal(38,0)")
    digits = F.abs(unscaled).cast("string")
    digits = F.lpad(digits, F.greatest(F.length(digits), places + 1), F.lit("0"))
    whole = F.substr(digits, F.lit(1), F.length(digits) - places)
    fits = (F.length(F.regexp_replace(whole, "^0+", "")) <= precision - scale) & unscaled.isNotNull() & (scale <= 18)
    fraction = F.when(places > 0, F.concat(F.lit("."), F.right(digits, places))).otherwise(F.lit(""))
    rounded = F.concat(F.when(unscaled < 0, F.lit("-")).otherwise(F.lit("")), whole, fraction)
    return (
        F.when(kind == "LONG", F.when(text.rlike(r"^\s*[+-]?[0-9]+\s*$"), text.try_cast("long").cast("string")))
        .when(kind == "DOUBLE", text.try_cast("double").cast("string"))
        .when(kind == "DECIMAL", F.when(fits, rounded))
        .when(kind == "BOOLEAN", F.when(F.lower(text).isin("t", "true"), "true").when(F.lower(text).isin("f", "false"), "false"))
        .when(kind == "TIMESTAMP", F.date_format(text.try_cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"))
        .when(kind == "DATE", F.when(F.length(text) <= 10, text.try_cast("date").cast("string")))
        .when(kind == "UUID", F.when(text.rlike("^[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}$"), F.lower(text)))
        .when(kind == "BINARY", F.when(text.rlike(r"^\\x([0-9A-Fa-f]{2})*$"), F.lower(text)))
        .otherwise(text)
    )
