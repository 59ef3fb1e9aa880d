"""Bitwise logic, shifts, rotates, counts and permutations, each on the value's own width."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..types import BOOL, signed
from .registry import OPERATORS, Value, any_null, bits_of, fit, need, one, operator, reinterpret, same, shift


def _pair(ctx, args, want) -> list[Value] | None:
    """Two integers of one width; the result has the type of the first."""
    a, b = ctx.value(args[0]), ctx.value(args[1])
    if a is None and b is None:
        if want is None:
            return None
        a = ctx.value(args[0], want)
    a = a or ctx.value(args[0], b.dtype)
    b = b or ctx.value(args[1], a.dtype)
    need(a.dtype.integer and b.dtype.integer, f"bit operations need integers, not {a.dtype} and {b.dtype}")
    need(a.dtype.width == b.dtype.width, f"bit operations need one width, not {a.dtype} and {b.dtype}")
    return [a, b]


def _logic(name: str, apply):
    def run(ctx, args, want, params):
        values = _pair(ctx, args, want)
        if values is None:
            return None
        a, b = values
        return a.but(fit(apply(a.column, reinterpret(b, a.dtype).column), a.dtype), nullable=any_null(values))

    operator("bit_" + name)(run)

    @operator(name)
    def either(ctx, args, want, params):
        """On predicates the predicate operator, on integers the bitwise one."""
        kinds = [v.dtype for v in map(ctx.value, args) if v]
        if BOOL in kinds or not kinds and want == BOOL:
            return ctx.apply("p_" + name, args, want, params)
        return run(ctx, args, want, params)


_logic("and", lambda a, b: a.bitwiseAND(b))
_logic("or", lambda a, b: a.bitwiseOR(b))
_logic("xor", lambda a, b: a.bitwiseXOR(b))
_logic("andnot", lambda a, b: F.bitwise_not(a).bitwiseAND(b))
_logic("xnor", lambda a, b: F.bitwise_not(a.bitwiseXOR(b)))


@operator("not", "not_")
def not_(ctx, args, want, params):
    v = ctx.value(args[0], want)
    if v is None:
        return None
    if v.dtype == BOOL:
        return ctx.apply("p_not", args, want, params)
    need(v.dtype.integer, f"not does not take {v.dtype}")
    return v.but(fit(F.bitwise_not(v.column), v.dtype))


for _name in ("and", "or"):
    operator(_name + "_")(OPERATORS[_name])


def sign_extended(v: Value) -> Column:
    return reinterpret(v, signed(v.dtype.width)).column.cast("bigint")


def shifted(kind: str, a: Value, count: Column) -> Column:
    """One of sll, srl, sra, rotl, rotr; the count is taken modulo the width."""
    w = a.dtype.width
    k = count.cast("bigint").bitwiseAND(F.lit(w - 1))
    if kind == "sra":
        return fit(shift("right", sign_extended(a), k), a.dtype)
    bits = bits_of(a)
    left, right = shift("left", bits, k), shift("unsigned", bits, k)
    if kind == "sll":
        return fit(left, a.dtype)
    if kind == "srl":
        return fit(right, a.dtype)
    back = (F.lit(w) - k).bitwiseAND(F.lit(w - 1))
    other = shift("unsigned", bits, back) if kind == "rotl" else shift("left", bits, back)
    return fit((left if kind == "rotl" else right).bitwiseOR(other), a.dtype)


def _shift(name: str):
    @operator(name)
    def run(ctx, args, want, params):
        values = _pair(ctx, args, want)
        if values is None:
            return None
        return values[0].but(shifted(name, values[0], values[1].column), nullable=any_null(values))


for _name in ("sll", "srl", "sra", "rotl", "rotr"):
    _shift(_name)


def leading_zeros(v: Value) -> Column:
    bits, w = bits_of(v), v.dtype.width
    return F.when(bits == 0, w).when(bits < 0, 0).otherwise(F.lit(w) - F.length(F.bin(bits)))


def trailing_zeros(v: Value) -> Column:
    bits = bits_of(v)
    below = bits.bitwiseAND(-bits) - F.lit(1).cast("bigint")
    return F.bit_count(below if v.dtype.width == 64 else below.bitwiseAND(F.lit((1 << v.dtype.width) - 1)))


def _integer(*names: str):
    def add(apply):
        @operator(*names)
        def run(ctx, args, want, params):
            v = one(ctx, args[0], want)
            if v is None:
                return None
            need(v.dtype.integer, f"{names[0]} needs an integer, not {v.dtype}")
            return v.but(fit(F.when(v.column.isNotNull(), apply(v).cast("bigint")) if v.nullable else apply(v).cast("bigint"), v.dtype))

        return run

    return add


_integer("popcnt")(lambda v: F.bit_count(bits_of(v)))
_integer("lzcnt")(leading_zeros)
_integer("tzcnt")(trailing_zeros)
_integer("log2_no_zero")(lambda v: F.lit(v.dtype.width - 1) - leading_zeros(v))
_integer("log2")(lambda v: F.when(v.column != 0, F.lit(v.dtype.width - 1) - leading_zeros(v)).otherwise(0))
_integer("bit_floor")(lambda v: F.when(v.column != 0, shift("left", F.lit(1).cast("bigint"), F.lit(v.dtype.width - 1) - leading_zeros(v))).otherwise(0))


@_integer("bit_ceil")
def bit_ceil(v: Value) -> Column:
    """Least power of two not below x as unsigned; 1 for 0 and 1; wraps above the largest power."""
    w = v.dtype.width
    less = Value(v.dtype, fit(v.column - F.lit(1).cast(v.dtype.carrier), v.dtype))
    k = (F.lit(w) - leading_zeros(less)).bitwiseAND(F.lit(w - 1))
    return F.when((v.column == 0) | (v.column == 1), 1).otherwise(shift("left", F.lit(1).cast("bigint"), k))


@operator("has_single_bit")
def has_single_bit(ctx, args, want, params):
    """x & (x - 1) == 0: true for 0 as well."""
    v = one(ctx, args[0], want)
    if v is None:
        return None
    need(v.dtype.integer, "has_single_bit needs an integer")
    bits = bits_of(v)
    return Value(BOOL, bits.bitwiseAND(bits - F.lit(1).cast("bigint")) == 0, v.nullable)


def lanes(bits: Column, size: int, source: list[int]) -> Column:
    """Lane k of the result is lane source[k] of bits; lanes have size bits."""
    mask = F.lit((1 << size) - 1 if size < 64 else -1).cast("bigint")
    parts = [shift("left", shift("unsigned", bits, F.lit(s * size)).bitwiseAND(mask), F.lit(k * size)) for k, s in enumerate(source)]
    return reduce(lambda a, b: a.bitwiseOR(b), parts)


def permuted(v: Value, size: int, source: list[int]) -> Column:
    need(not v.nullable, "permute takes no nullable input")
    need(len(source) * size == v.dtype.width, f"{len(source)} lanes of {size} bits do not make {v.dtype}")
    need(all(0 <= s < len(source) for s in source), "permute: no such lane")
    return lanes(bits_of(v), size, source)


@operator("permute")
def permute(ctx, args, want, params):
    """Bytes, or with is_bit bits, in the order of idxs: place k takes lane idxs[k]."""
    v = one(ctx, args[0], want)
    if v is None:
        return None
    need(v.dtype.integer, "permute needs an integer")
    return v.but(fit(permuted(v, 1 if params.get("is_bit") else 8, list(params["idxs"])), v.dtype))


def _lane_permute(width: int, size: int):
    name = f"permute_i{width}_i{size}"

    @operator(name)
    def run(ctx, args, want, params):
        v = one(ctx, args[0], want)
        if v is None:
            return None
        need(v.dtype.integer and v.dtype.width == width, f"{name} needs {width} bits, not {v.dtype}")
        return v.but(fit(permuted(v, size, list(params["idxs"])), v.dtype))


for _width, _size in ((64, 8), (64, 16), (64, 32), (32, 8), (32, 16), (16, 8)):
    _lane_permute(_width, _size)


@operator("permute_i8_bits")
def permute_i8_bits(ctx, args, want, params):
    """The bits within every byte, in the order of idxs; -1 stands for bit 0."""
    v = one(ctx, args[0], want)
    if v is None:
        return None
    order = [max(0, k) for k in params["idxs"]]
    need(len(order) == 8, "permute_i8_bits needs 8 places")
    whole = [byte * 8 + k for byte in range(v.dtype.width // 8) for k in order]
    return v.but(fit(permuted(v, 1, whole), v.dtype))


@operator("reverse_bits_i8")
def reverse_bits_i8(ctx, args, want, params):
    return permute_i8_bits(ctx, args, want, {"idxs": list(range(7, -1, -1))})


@operator("replicate_ith_bit_i8")
def replicate_ith_bit_i8(ctx, args, want, params):
    """Every bit of each byte becomes its bit params['bit']."""
    return permute_i8_bits(ctx, args, want, {"idxs": [params["bit"]] * 8})


def _backwards(name: str, size: int):
    @operator(name)
    def run(ctx, args, want, params):
        v = one(ctx, args[0], want)
        if v is None:
            return None
        need(v.dtype.integer and v.dtype.width > size, f"{name} does not take {v.dtype}")
        n = v.dtype.width // size
        return v.but(fit(lanes(bits_of(v), size, list(range(n - 1, -1, -1))), v.dtype))


_backwards("byteswap", 8)
_backwards("reverse_bits_full", 1)
