"""Typing rules of the normalised layer."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fleetlens.functions.text import as_col, null_if_blank, strip_all

# Smallest magnitude of an epoch number in each unit, and the
# digit counts accepted by the strict form, with the divisor to seconds.
EPOCH_MAGNITUDE = [(10**18, 10**9), (10**15, 10**6), (10**12, 10**3)]
EPOCH_DIGITS = {10: 1, 13: 10**3, 16: 10**6, 19: 10**9}
# Fixed value: seconds from 1970, either way, that a clock of 64-bit nanoseconds reaches.
CLOCK_SECONDS = 9_223_372_036


def _whole_seconds(value: Column, divisor: int) -> Column:
    # Subtract the remainder first: a plain double division loses nanosecond
    # digits above 2**53 and could land in the neighbouring second.
    floored = (value - F.pmod(value, F.lit(divisor))) / F.lit(divisor)
    return F.round(floored).cast("long")


def epoch_to_timestamp(value: Column | str) -> Column:
    """Epoch number to a second-precision timestamp; the unit is read from each value.

    Deciding per row keeps the result independent of how rows are partitioned.
    """
    number = as_col(value).try_cast("long")
    seconds = F.when(number < EPOCH_MAGNITUDE[-1][0], number)
    for threshold, divisor in reversed(EPOCH_MAGNITUDE):
        seconds = F.when(number >= threshold, _whole_seconds(number, divisor)).otherwise(seconds)
    return F.timestamp_seconds(seconds)


def epoch_divisor(number: Column) -> Column:
    """Aggregate: the divisor to seconds of the unit in which the median of ``number`` lies.

    Where a median lies follows from counts, so values need not be kept: it reaches a
    bound if more than half of them do, or if half do and the mean of the two values on
    either side of the bound does. Without any number the unit is milliseconds.
    """
    n = F.count(number)
    divisor = F.lit(1)
    for bound, value in reversed(EPOCH_MAGNITUDE):
        high = number >= bound
        reached = F.count_if(high) * 2
        middle = (F.max(F.when(~high, number)) + F.min(F.when(high, number))) / 2
        divisor = F.when((reached > n) | ((reached == n) & (middle >= bound)), value).otherwise(divisor)
    return F.when(n > 0, divisor).otherwise(10**3).cast("long")


def epoch_in_unit(number: Column, whole: Column, divisor: Column) -> Column:
    """A number of a known unit as a timestamp floored to the second; null where no clock reaches.

    ``whole`` is the same number as a long where it is one, so that no digit is lost.
    """
    exact = ((whole - F.pmod(whole, divisor)) / divisor).cast("double")
    seconds = F.round(F.coalesce(exact, F.floor(number / divisor).cast("double")))
    return F.when(F.abs(number / divisor) <= CLOCK_SECONDS, F.timestamp_seconds(seconds.cast("long")))


def cast_datetime(value: Column | str, dtype: str = "string") -> Column:
    """UTC timestamp floored to the second, from timestamp, number or text."""
    column = as_col(value)
    if dtype in ("timestamp", "timestamp_ntz", "date"):
        return F.date_trunc("second", column.cast("timestamp"))
    if dtype in ("tinyint", "smallint", "int", "bigint", "float", "double") or dtype.startswith("decimal"):
        return epoch_to_timestamp(column)
    text = strip_all(column)
    return F.when(text.rlike(r"^[+-]?\d+$"), epoch_to_timestamp(text)).otherwise(
        F.date_trunc("second", text.try_cast("timestamp"))
    )


def epoch_strict_unsupported(value: Column | str) -> Column:
    """True for an all-digit text whose length is not a known epoch length."""
    text = strip_all(value)
    digits = F.length(F.regexp_replace(text, r"^[+-]", ""))
    return F.coalesce(text.rlike(r"^[+-]?\d+$") & ~digits.isin(list(EPOCH_DIGITS)), F.lit(False))


def cast_epoch_strict(value: Column | str, *, on_error: str = "raise") -> Column:
    """Text to timestamp where digit-only text must have 10, 13, 16 or 19 digits.

    ``on_error='raise'`` fails the job on another length, ``'null'`` leaves null so
    that callers can route those rows with :func:`epoch_strict_unsupported`.
    """
    text = strip_all(value)
    digits = F.length(F.regexp_replace(text, r"^[+-]", ""))
    number = text.try_cast("long")
    bad = F.lit(None).cast("long")
    if on_error == "raise":
        bad = F.raise_error(F.concat(F.lit("unsupported epoch length: "), text)).cast("long")
    seconds = bad
    for length, divisor in EPOCH_DIGITS.items():
        seconds = F.when(digits == length, _whole_seconds(number, divisor)).otherwise(seconds)
    return F.when(text.rlike(r"^[+-]?\d+$"), F.timestamp_seconds(seconds)).otherwise(
        F.date_trunc("second", text.try_cast("timestamp"))
    )


def cast_numeric(value: Column | str) -> Column:
    """A number, or null for text that is not one: type suffixes and NaN are not numbers."""
    column = as_col(value)
    text = strip_all(column.cast("string"))
    is_number = text.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$") | text.rlike(r"(?i)^[+-]?inf(inity)?$")
    return F.when(is_number, text.try_cast("double"))


def cast_boolean(value: Column | str) -> Column:
    text = as_col(value).cast("string")
    return F.when(text.isin("true", "True", "1"), F.lit(True)).when(
        text.isin("false", "False", "0"), F.lit(False)
    )


def cast_string(value: Column | str, *, upper: bool = False) -> Column:
    text = strip_all(value)
    return F.upper(text) if upper else text


def epoch_or_iso_ts(value: Column | str) -> Column:
    """Inventory time text: 13 digits are ms, 10 digits are s, anything else ISO."""
    text = null_if_blank(value)
    number = text.try_cast("long")
    return (
        F.when(text.rlike("^[0-9]{13}$"), F.timestamp_millis(number))
        .when(text.rlike("^[0-9]{10}$"), F.timestamp_seconds(number))
        .otherwise(text.try_cast("timestamp"))
    )
