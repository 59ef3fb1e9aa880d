"""Named fragments: scalar expressions and struct-returning aggregates over raw Spark columns.

Their sums differ from the aggregates of programs: they are null where no row counts, and 128
bits wide.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..operators.aggregates import sum128

# Fixed values of the fragments.
SCALE = 10_000
SHIP_UNTIL, SHIP_BELOW = 10_592, 24
CODES = 128
Q19_ARMS = ((12, 1, 11, 1, 4, 5), (23, 10, 20, 5, 8, 10), (34, 20, 30, 9, 12, 15))


def quotient(a: Column, by: int) -> Column:
    return F.call_function("div", a, F.lit(by))


def wide_sum(x: Column, where: Column | None = None) -> Column:
    x = x.cast("bigint")
    return sum128(x if where is None else F.when(where, x))


def add(a: Column, b: Column) -> Column:
    return a + b


def net(price: Column, discount_bp: Column) -> Column:
    return quotient(price * (F.lit(SCALE) - discount_bp), SCALE)


def charge(price: Column, discount_bp: Column, tax_bp: Column) -> Column:
    return quotient(price * (F.lit(SCALE) - discount_bp) * (F.lit(SCALE) + tax_bp), SCALE * SCALE)


def ship_filter(shipdate: Column, quantity: Column) -> Column:
    return (shipdate <= SHIP_UNTIL) & (quantity < SHIP_BELOW)


def dict_gather(code: Column) -> Column:
    """An i8 code looked up in the dictionary of the first CODES numbers; other codes are errors."""
    # Literals only, so that Spark folds the dictionary to a constant.
    dictionary = F.array(*map(F.lit, range(CODES))).cast("array<tinyint>")
    return F.when((code < 0) | (code >= CODES), F.raise_error(F.lit("dictionary code out of range"))).otherwise(F.get(dictionary, code.cast("int")))


def dict_spec(code: Column) -> Column:
    """The same lookup, knowing that the dictionary is the identity."""
    return F.when((code < 0) | (code >= CODES), F.raise_error(F.lit("dictionary code out of range"))).otherwise(code)


def sum_add(a: Column, b: Column) -> Column:
    return wide_sum(add(a, b))


def sum_net(price: Column, discount_bp: Column) -> Column:
    return wide_sum(net(price, discount_bp))


def count_ship_filter(shipdate: Column, quantity: Column) -> Column:
    return F.count_if(ship_filter(shipdate, quantity))


def q1_multi(price: Column, discount_bp: Column, tax_bp: Column) -> Column:
    return F.struct(
        wide_sum(net(price, discount_bp)).alias("sum_net"),
        wide_sum(charge(price, discount_bp, tax_bp)).alias("sum_charge"),
        F.count(F.lit(1)).alias("row_count"),
    )


def q19_mask(brand: Column, container: Column, quantity: Column, size: Column) -> Column:
    out = F.lit(False)
    for b, low, high, first, last, most in Q19_ARMS:
        out = out | ((brand == b) & container.between(first, last) & quantity.between(low, high) & size.between(1, most))
    return out


def q19(brand: Column, container: Column, quantity: Column, size: Column, price: Column, discount_bp: Column) -> Column:
    keep = q19_mask(brand, container, quantity, size)
    return F.struct(F.count_if(keep).alias("row_count"), wide_sum(net(price, discount_bp), keep).alias("revenue"))


def nullable_revenue(quantity: Column, price: Column, discount_bp: Column, delay: Column) -> Column:
    quantity, discount_bp = F.coalesce(quantity, F.lit(0)), F.coalesce(discount_bp, F.lit(0))
    price = F.nullif(price, F.lit(0))
    valid = price.isNotNull() & (quantity > 0)
    value = quotient(quantity * price * (F.lit(SCALE) - discount_bp), SCALE)
    return F.struct(
        wide_sum(value, valid).alias("sum_valid_net"),
        wide_sum(value, valid & (delay > 30)).alias("sum_delay_net"),
        F.count_if(valid).alias("count_valid"),
    )


def sales(quantity: Column, price: Column, discount_bp: Column, return_flag: Column, channel: Column) -> Column:
    """Any integer widths: the wide and the mixed narrow layouts are one."""
    value = quotient(quantity.cast("bigint") * price * (F.lit(SCALE) - discount_bp.cast("bigint")), SCALE)
    signed = F.when(return_flag == 1, -value).otherwise(value)
    return F.struct(
        wide_sum(signed).alias("sum_revenue"),
        wide_sum(signed, channel == 2).alias("channel2_revenue"),
        F.count_if(quantity >= 10).alias("bulk_count"),
    )
