"""NMEA text expressions (framing, checksum, coordinates, clock)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def xor_bytes(text: Column) -> Column:
    """XOR of the ASCII codes of a text."""
    codes = F.transform(F.split(text, ""), lambda c: F.ascii(c))
    return F.aggregate(codes, F.lit(0), lambda a, c: a.bitwiseXOR(c))


def checksum_hex(text: Column) -> Column:
    return F.lpad(F.hex(xor_bytes(text)), 2, "0")


def degrees_minutes(degrees: Column, digits: int) -> Column:
    """Decimal degrees to ``ddmm.mmmmmm`` text."""
    whole = F.floor(degrees)
    minutes = F.floor((degrees - whole) * 60e6 + 0.5)
    return F.concat(
        F.lpad(whole.cast("string"), digits, "0"),
        F.lpad(F.floor(minutes / 1e6).cast("string"), 2, "0"),
        F.lit("."),
        F.lpad((minutes % 1_000_000).cast("bigint").cast("string"), 6, "0"),
    )


def decimal(text: Column) -> Column:
    """Plain unsigned decimal, NULL when malformed."""
    return F.when(text.rlike(r"^[0-9]{1,9}(\.[0-9]{1,12})?$"), text.cast("double"))


def signed_decimal(text: Column) -> Column:
    return F.when(text.rlike(r"^-?[0-9]{1,9}(\.[0-9]{1,12})?$"), text.cast("double"))


def coordinate(text: Column, direction: Column, digits: int) -> Column:
    """``ddmm.m`` and hemisphere to signed degrees, NULL when malformed."""
    limit = 90 if digits == 2 else 180
    positive, negative = ("N", "S") if digits == 2 else ("E", "W")
    shaped = text.rlike(rf"^[0-9]{{{digits + 2}}}(\.[0-9]{{1,12}})?$")
    degree = F.when(shaped, F.substring(text, 1, digits).cast("int"))
    minute = F.when(shaped, F.substring(text, digits + 1, 30).cast("double"))
    ok = (degree <= limit) & (minute < 60) & ~((degree == limit) & (minute != 0))
    value = degree + minute / 60
    return F.when(ok & (direction == positive), value).when(ok & (direction == negative), -value)


def clock_seconds(text: Column) -> Column:
    """``hhmmss[.s]`` to seconds of the day, NULL when malformed."""
    shaped = text.rlike(r"^[0-9]{6}(\.[0-9]{1,12})?$")
    hour = F.when(shaped, F.substring(text, 1, 2).cast("int"))
    minute = F.when(shaped, F.substring(text, 3, 2).cast("int"))
    second = F.when(shaped, F.substring(text, 5, 20).cast("double"))
    return F.when((hour <= 23) & (minute <= 59) & (second < 60), hour * 3600 + minute * 60 + second)


def date_seconds(text: Column) -> Column:
    """``ddmmyy`` to epoch seconds; years from 80 on are 19xx."""
    shaped = text.rlike(r"^[0-9]{6}$")
    year = F.when(shaped, F.substring(text, 5, 2).cast("int"))
    day = F.try_to_timestamp(
        F.concat(
            F.when(year >= 80, year + 1900).otherwise(year + 2000).cast("string"),
            F.lit("-"),
            F.substring(text, 3, 2),
            F.lit("-"),
            F.substring(text, 1, 2),
        ),
        F.lit("yyyy-MM-dd"),
    )
    return F.when(shaped, F.unix_seconds(day))
