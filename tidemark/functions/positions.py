"""Column expressions on log positions and resume tokens."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def token_hex(token: Column) -> Column:
    """The hex digits of a resume token, in upper case, from ``{"_data": "82.."}`` or the bare digits; null if none."""
    inner = F.regexp_extract(token, r'"_data"\s*:\s*"([0-9A-Fa-f]+)"', 1)
    bare = F.regexp_extract(token, r"^\s*\"?([0-9A-Fa-f]+)\"?\s*$", 1)
    found = F.when(inner != "", inner).when(bare != "", bare)
    return F.upper(found)


def token_position(hex_digits: Column) -> Column:
    """(t, i) of a token in key-string form: byte 0x82, then the cluster time as two 32-bit numbers; else null."""
    t = F.conv(F.substring(hex_digits, 3, 8), 16, 10).cast("long")
    i = F.conv(F.substring(hex_digits, 11, 8), 16, 10).cast("long")
    ok = hex_digits.startswith("82") & (F.length(hex_digits) >= 18)
    return F.when(ok, F.struct(t.alias("t"), i.alias("i")))


def offset_position(offset: Column) -> Column:
    """(t, i) of ``t:i`` or of ``{"$timestamp": {"t": .., "i": ..}}`` in any key order; else null."""
    short = F.regexp_extract(offset, r"^\s*(\d+)\s*:\s*\d+\s*$", 1)
    tagged = F.from_json(offset, "`$timestamp` struct<t:bigint,i:bigint>").getField("$timestamp")
    return F.when(
        short != "",
        F.struct(
            short.try_cast("long").alias("t"),
            F.regexp_extract(offset, r":\s*(\d+)\s*$", 1).try_cast("long").alias("i"),
        ),
    ).otherwise(F.when(tagged.getField("t").isNotNull() & tagged.getField("i").isNotNull(), tagged))


def micros(at: Column | str) -> Column:
    """Microseconds of a timestamp, with or without a zone (without one, it is read in the session's)."""
    return F.unix_micros((F.col(at) if isinstance(at, str) else at).cast("timestamp"))
