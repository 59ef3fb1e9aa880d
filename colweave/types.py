"""Logical types and how Spark carries them.

Signed integers and floats map one to one. Spark has no unsigned integers: u8, u16
and u32 ride in the next wider signed type, masked after every operation; u64
rides as the raw bits of a bigint. Timestamps are ticks since the epoch in a
bigint while an expression is computed, and Spark timestamps at its borders.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T


class TypeMismatch(TypeError):
    """Operands or literals whose types do not go together."""


@dataclass(frozen=True)
class DType:
    name: str
    width: int = 0
    kind: str = "int"  # int, uint, float, bool, time
    unit: str = ""
    utc: bool = False

    def __repr__(self) -> str:
        return self.name

    @property
    def integer(self) -> bool:
        return self.kind in ("int", "uint")

    @property
    def numeric(self) -> bool:
        return self.kind in ("int", "uint", "float")

    @property
    def carrier(self) -> str:
        """The Spark type of values while computing."""
        if self.kind == "uint":
            return {8: "smallint", 16: "int", 32: "bigint", 64: "bigint"}[self.width]
        if self.kind == "int":
            return {8: "tinyint", 16: "smallint", 32: "int", 64: "bigint"}[self.width]
        return {"float": "float" if self.width == 32 else "double", "bool": "boolean", "time": "bigint"}[self.kind]

    @property
    def least(self) -> int:
        return 0 if self.kind == "uint" else -(1 << self.width - 1)

    @property
    def most(self) -> int:
        return (1 << self.width) - 1 if self.kind == "uint" else (1 << self.width - 1) - 1

    @property
    def ticks(self) -> int:
        """Ticks in a second."""
        return {"s": 1, "ms": 1_000, "us": 1_000_000, "ns": 1_000_000_000}[self.unit]


I8, I16, I32, I64 = (DType(f"i{w}", w) for w in (8, 16, 32, 64))
U8, U16, U32, U64 = (DType(f"u{w}", w, "uint") for w in (8, 16, 32, 64))
F32, F64 = (DType(f"f{w}", w, "float") for w in (32, 64))
BOOL = DType("bool", 1, "bool")
I128 = DType("i128", 128)
BY_NAME = {t.name: t for t in (I8, I16, I32, I64, U8, U16, U32, U64, F32, F64, BOOL)} | {"i1": BOOL}


def timestamp(unit: str, utc: bool = False) -> DType:
    if unit not in ("s", "ms", "us", "ns"):
        raise TypeMismatch(f"unknown timestamp unit {unit!r}")
    return DType(f"timestamp[{unit}{', UTC' if utc else ''}]", 64, "time", unit, utc)


def signed(width: int) -> DType:
    return BY_NAME[f"i{width}"]


def promote(a: DType, b: DType) -> DType:
    """The common type of two operands: the wider of one kind; kinds do not mix."""
    if a == b:
        return a
    if a.kind != b.kind or not a.numeric:
        raise TypeMismatch(f"{a} and {b} have no common type; cast one of them")
    return a if a.width >= b.width else b


def of_spark(t: T.DataType) -> DType:
    """The logical type of a Spark column."""
    known = {
        T.ByteType: I8, T.ShortType: I16, T.IntegerType: I32, T.LongType: I64, T.FloatType: F32, T.DoubleType: F64,
        T.BooleanType: BOOL, T.TimestampNTZType: timestamp("us"), T.TimestampType: timestamp("us", True),
    }
    if type(t) not in known:
        raise TypeMismatch(f"no logical type for Spark's {t.simpleString()}")
    return known[type(t)]
