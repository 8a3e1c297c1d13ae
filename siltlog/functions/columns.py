"""Column expressions of the versioned key-value model."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Type byte and two lengths that an encoded operation has besides its key and value.
OPERATION_OVERHEAD = 9


def key_valid(key: Column) -> Column:
    """Whether key may be written: not empty, and without TAB, NL and NUL. Null keys may not."""
    text = key.cast("string")
    bad = (F.instr(text, "\t") > 0) | (F.instr(text, "\n") > 0) | (F.instr(text, "\x00") > 0)
    return F.coalesce((F.octet_length(key) > 0) & ~bad, F.lit(False))


def operation_bytes(key: Column, value: Column) -> Column:
    """Encoded size of an operation; a delete's null value counts as empty."""
    return F.lit(OPERATION_OVERHEAD) + F.octet_length(key) + F.coalesce(F.octet_length(value), F.lit(0))


def overlaps(low: Column, high: Column, other_low: Column, other_high: Column) -> Column:
    """Whether two key ranges overlap; a missing bound overlaps everything."""
    return F.coalesce((low <= other_high) & (other_low <= high), F.lit(True))


def crc32_of(*columns: Column) -> Column:
    """CRC-32 of the columns' bytes one after another."""
    return F.crc32(F.concat(*[c.cast("binary") for c in columns]))


def run_name(number: Column) -> Column:
    """Name of a sorted run: at least six digits."""
    digits = number.cast("string")
    return F.concat(F.lit("run_"), F.lpad(digits, F.greatest(F.lit(6), F.length(digits)), F.lit("0")))


def file_number(name: Column) -> Column:
    """The number in a run's name; null for other names and for 0."""
    digits = F.regexp_extract(name, r"^run_(\d{6,18})$", 1)
    number = F.when(digits != "", digits.cast("long"))
    return F.when(number > 0, number)


def shared_prefix(a: Column, b: Column) -> Column:
    """How many leading characters two strings share, in one walk over them."""
    same = F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: F.coalesce(x == y, F.lit(False)))
    place = F.array_position(same, False)
    return F.when((F.length(a) == 0) | (F.length(b) == 0), F.lit(0)).otherwise(F.when(place > 0, place - 1).otherwise(F.length(a)).cast("int"))


def status_text(code: Column, message: Column) -> Column:
    """`Code: message`, or the code alone without a message."""
    return F.concat_ws(": ", code, F.when(message != "", message))
