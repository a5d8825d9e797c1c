"""Scalar functions. Integers are 64 bits wide; a NaN is never a value and becomes null."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

LONG_MAX, LONG_MIN = 9223372036854775807, -9223372036854775808


def value(x: Column) -> Column:
    """NaN as null."""
    return F.nullif(x, F.lit(float("nan")))


def add(a: Column, b: Column) -> Column:
    return a + b


def sub(a: Column, b: Column) -> Column:
    return a - b


def mul(a: Column, b: Column) -> Column:
    return a * b


def div(a: Column, b: Column, integers: bool = False) -> Column:
    """Integers are divided towards zero."""
    return F.call_function("div", a, b) if integers else a / b


def rem(a: Column, b: Column) -> Column:
    """The remainder has the sign of a."""
    return a % b


def power(a: Column, b: Column, integers: bool = False) -> Column:
    return F.pow(a, b).cast("bigint") if integers else F.pow(a, b)


def neg(a: Column) -> Column:
    return -a


def bit_not(a: Column) -> Column:
    return F.bitwise_not(a)


def shl(a: Column, n: int) -> Column:
    return F.shiftleft(a, n)


def shr(a: Column, n: int, unsigned: bool = False) -> Column:
    return F.shiftrightunsigned(a, n) if unsigned else F.shiftright(a, n)


def sqrt(a: Column) -> Column:
    return value(F.sqrt(a))


def arcsin(a: Column) -> Column:
    return value(F.asin(a))


def arccos(a: Column) -> Column:
    return value(F.acos(a))


def arctan(a: Column) -> Column:
    return F.atan(a)


def minimum(a: Column, b: Column) -> Column:
    return F.least(a, b)


def maximum(a: Column, b: Column) -> Column:
    return F.greatest(a, b)


def round_half_up(a: Column, places: int = 0) -> Column:
    """Halves are rounded away from zero."""
    return F.round(a, places)


def float_to_int(a: Column) -> Column:
    """Towards zero; what does not fit becomes the nearest that does."""
    return F.when(a >= float(LONG_MAX), F.lit(LONG_MAX)).when(a <= float(LONG_MIN), F.lit(LONG_MIN)).otherwise(a.cast("bigint"))


def decimal_to_int(a: Column) -> Column:
    """To the nearest integer."""
    return F.round(a, 0).cast("bigint")


def widen(a: Column, kind: str) -> Column:
    return a.cast(kind)


def byte_at(a: Column, i: int) -> Column:
    """The byte at an index from 0, or null beyond the end."""
    return F.when((F.lit(i) >= 0) & (F.octet_length(a) > i), F.conv(F.hex(F.substring(a, i + 1, 1)), 16, 10).cast("int"))


def matches(a: Column, pattern: str) -> Column:
    return a.rlike(pattern)


def number_text(a: Column, places: int = 3) -> Column:
    """A decimal text that does not depend on the engine."""
    return F.round(a, places).cast(f"decimal(30,{places})").cast("string")


def message(template: str, **values: Column) -> Column:
    """Text with {name} replaced by values; null is None."""
    parts: list[Column] = []
    while template:
        head, brace, rest = template.partition("{")
        if head:
            parts.append(F.lit(head))
        if not brace:
            break
        name, closing, template = rest.partition("}")
        if not closing or name not in values:
            raise ValueError(f"no value for {{{name}")
        parts.append(F.coalesce(values[name].cast("string"), F.lit("None")))
    return F.concat(*parts) if parts else F.lit("")


def value_text(a: Column, kind: str = "string") -> Column:
    """Bytes in upper-case hex, null as None."""
    return F.coalesce(F.hex(a) if kind == "bytes" else a.cast("string"), F.lit("None"))


def tuple_make(*items: Column) -> Column:
    return F.struct(*[x.alias(f"_{i}") for i, x in enumerate(items)])


def tuple_get(a: Column, i: int) -> Column:
    return a.getField(f"_{i}")


def tuple_text(*items: Column) -> Column:
    return F.concat(F.lit("("), F.concat_ws(", ", *[value_text(x) for x in items]), F.lit(")"))


def user_fn(fn: Callable[..., Column]) -> Callable[..., Column]:
    """A function of columns, checked to be one; it is written into the plan where it is called."""

    def call(*args: Column | int | float | str | bool) -> Column:
        out = fn(*[a if isinstance(a, Column) else F.lit(a) for a in args])
        if not isinstance(out, Column):
            raise TypeError(f"{fn.__name__} must give a column")
        return out

    call.__name__ = fn.__name__
    return call
