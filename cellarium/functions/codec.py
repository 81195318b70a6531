"""Fixed-width big-endian codecs and byte-string helpers as Spark columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Hex digits of each integer type.
WIDTHS = {"short": 4, "int": 8, "long": 16}


def encode_integer(value: Column, kind: str = "long") -> Column:
    """Two's complement, big-endian: its byte order is numeric order for values of one sign only."""
    width = WIDTHS[kind]
    digits = F.lpad(F.hex(value.cast("long")), 16, "0")
    return F.unhex(F.right(digits, F.lit(width)))


def decode_integer(data: Column, kind: str = "long") -> Column:
    """NULL unless ``data`` has exactly the width of ``kind``."""
    width = WIDTHS[kind]
    unsigned = F.conv(F.hex(data), 16, 10).cast("decimal(20,0)")
    top = F.lit(str(1 << (4 * width - 1))).cast("decimal(20,0)")
    whole = F.lit(str(1 << (4 * width))).cast("decimal(20,0)")
    signed = F.when(unsigned >= top, unsigned - whole).otherwise(unsigned)
    name = {"short": "smallint", "int": "int", "long": "bigint"}[kind]
    return F.when(F.octet_length(data) == width // 2, signed.cast(name))


def encode_boolean(value: Column) -> Column:
    return F.when(value, F.unhex(F.lit("FF"))).otherwise(F.unhex(F.lit("00")))


def decode_boolean(data: Column) -> Column:
    return F.when(F.octet_length(data) == 1, F.hex(data) != "00")


def printable(data: Column) -> Column:
    """Bytes as text: printable ASCII as it is, but for the backslash; every other byte as \\xHH."""
    pairs = F.regexp_extract_all(F.hex(data), F.lit("(..)"), F.lit(1))
    keep = F.array(*[F.lit(f"{b:02X}") for b in range(32, 127) if b != 92])
    return F.array_join(
        F.transform(pairs, lambda h: F.when(F.array_contains(keep, h), F.unhex(h).cast("string")).otherwise(F.concat(F.lit("\\x"), h))), ""
    )


def starts_with(data: Column, prefix: Column) -> Column:
    return F.startswith(data, prefix)


def head(data: Column, n: int) -> Column:
    """The first ``n`` bytes; NULL if there are fewer."""
    return F.when(F.octet_length(data) >= n, F.substring(data, 1, n))


def tail(data: Column, n: int) -> Column:
    """The last ``n`` bytes; NULL if there are fewer."""
    return F.when(F.octet_length(data) >= n, F.substring(data, F.octet_length(data) - n + 1, F.lit(n)))


def pad_head(data: Column, n: int) -> Column:
    """``n`` zero bytes, then ``data``."""
    return F.concat(F.unhex(F.lit("00" * n)), data)


def pad_tail(data: Column, n: int) -> Column:
    return F.concat(data, F.unhex(F.lit("00" * n)))


def integer_key(value: Column, width: int = 15) -> Column:
    """A key whose string order is numeric order for values of 0 and above."""
    return F.lpad(value.cast("string"), width, "0")


def decimal_key(value: Column, width: int = 15) -> Column:
    return F.lpad(F.format_string("%.2f", value), width, "0")


def compact_date(day: Column) -> Column:
    """A date as the number yyyyMMdd."""
    return F.date_format(day, "yyyyMMdd").cast("long")


def increment_bytes(data: bytes, amount: int) -> bytes:
    """``data`` as a big-endian number plus ``amount``, in as many bytes."""
    return ((int.from_bytes(data, "big") + amount) % (1 << (8 * len(data)))).to_bytes(len(data), "big")


def split_points(first: bytes, last: bytes, parts: int) -> list[bytes]:
    """``parts`` - 1 keys that cut [first, last) evenly as big-endian numbers."""
    width = max(len(first), len(last)) + 1
    low, high = (int.from_bytes(k.ljust(width, b"\0"), "big") for k in (first, last))
    if parts < 2 or high - low < parts:
        raise ValueError("too little room between the keys")
    return [(low + (high - low) * i // parts).to_bytes(width, "big") for i in range(1, parts)]


def hex_split_points(parts: int, width: int = 8) -> list[str]:
    """Even cuts of the hex strings of ``width`` digits."""
    return [f"{(16**width) * i // parts:0{width}x}" for i in range(1, parts)]
