"""Comparators: how a filter's operand is compared with data.

Operators read "data op operand": LESS keeps data below the operand.  Strings and
binaries compare by unsigned bytes, as Spark does itself; numbers compare as numbers.
"""

from __future__ import annotations

from dataclasses import dataclass
from enum import Enum
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F


class Op(Enum):
    LESS = "<"
    LESS_OR_EQUAL = "<="
    EQUAL = "="
    NOT_EQUAL = "!="
    GREATER_OR_EQUAL = ">="
    GREATER = ">"
    NO_OP = "no_op"


@dataclass(frozen=True)
class Binary:
    value: Any

    def test(self, op: Op, data: Column) -> Column:
        return _ordered(op, data, F.lit(self.value))


@dataclass(frozen=True)
class BinaryPrefix:
    """Compares the first bytes of the data, as many as the operand has."""

    value: str | bytes

    def test(self, op: Op, data: Column) -> Column:
        if isinstance(self.value, bytes):
            return _ordered(op, F.substring(data.cast("binary"), 1, len(self.value)), F.lit(self.value))
        raw = self.value.encode()
        return _ordered(op, F.substring(data.cast("binary"), 1, len(raw)), F.lit(raw))


@dataclass(frozen=True)
class Null:
    def test(self, op: Op, data: Column) -> Column:
        return _equal_only(op, data.isNull(), "null")


@dataclass(frozen=True)
class Regex:
    """Found anywhere in the data."""

    pattern: str

    def test(self, op: Op, data: Column) -> Column:
        return _equal_only(op, data.cast("string").rlike(self.pattern), "regexstring")


@dataclass(frozen=True)
class Substring:
    """Found anywhere in the data, whatever the case."""

    text: str

    def test(self, op: Op, data: Column) -> Column:
        return _equal_only(op, F.lower(data.cast("string")).contains(self.text.lower()), "substring")


@dataclass(frozen=True)
class Bit:
    """EQUAL where operand and data, combined by AND, OR or XOR, are not all zero.

    Integers combine as numbers, others byte by byte; byte strings of another length never match.
    """

    value: int | str | bytes
    how: str = "AND"

    def test(self, op: Op, data: Column) -> Column:
        if self.how not in ("AND", "OR", "XOR"):
            raise ValueError(f"unknown bit operator {self.how}")
        if isinstance(self.value, int):
            mix = {"AND": data.bitwiseAND, "OR": data.bitwiseOR, "XOR": data.bitwiseXOR}[self.how]
            return _equal_only(op, mix(F.lit(self.value)) != 0, "bit")
        raw = self.value.encode() if isinstance(self.value, str) else self.value
        data = data.cast("binary")
        hits = F.lit(False)
        for i, b in enumerate(raw):
            byte = F.conv(F.hex(F.substring(data, i + 1, 1)), 16, 10).cast("int")
            mix = {"AND": byte.bitwiseAND, "OR": byte.bitwiseOR, "XOR": byte.bitwiseXOR}[self.how]
            hits = hits | (mix(F.lit(b)) != 0)
        return _equal_only(op, (F.octet_length(data) == len(raw)) & hits, "bit")


Comparator = Binary | BinaryPrefix | Null | Regex | Substring | Bit


def _ordered(op: Op, data: Column, operand: Column) -> Column:
    match op:
        case Op.LESS:
            return data < operand
        case Op.LESS_OR_EQUAL:
            return data <= operand
        case Op.EQUAL:
            return data == operand
        case Op.NOT_EQUAL:
            return data != operand
        case Op.GREATER_OR_EQUAL:
            return data >= operand
        case Op.GREATER:
            return data > operand
    return F.lit(False)


def _equal_only(op: Op, holds: Column, name: str) -> Column:
    if op is Op.EQUAL:
        return holds
    if op is Op.NOT_EQUAL:
        return ~holds
    if op is Op.NO_OP:
        return F.lit(False)
    raise ValueError(f"{name} knows only = and !=")
