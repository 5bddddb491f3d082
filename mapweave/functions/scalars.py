"""Null-tolerant scalar functions over Columns.

``""``, empty arrays and empty maps count as null (see ``nullify``); arithmetic takes null as
0, equality is two-valued and division by zero gives infinities or NaN, never an error.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

STRING, ARRAY, MAP, NUMBER, BOOL, ANY = "string", "array", "map", "number", "bool", "any"


def nullify(c: Column, kind: str = ANY) -> Column:
    """Null-ish values as null. Numbers and booleans are never null-ish and stay plain columns, so filters still push down.

    ``ANY`` takes scalars of any type: text "" is null-ish and all others are kept.
    """
    if kind == ANY:
        return F.when(c.cast("string") != F.lit(""), c)
    if kind == STRING:
        return F.nullif(c, F.lit(""))
    if kind in (ARRAY, MAP):
        return F.when(F.size(c) > 0, c)
    return c


def is_nil(c: Column, kind: str = ANY) -> Column:
    return nullify(c, kind).isNull()


def is_not_nil(c: Column, kind: str = ANY) -> Column:
    return nullify(c, kind).isNotNull()


def truthy(c: Column, kind: str = BOOL) -> Column:
    """A boolean is itself, null false; anything else is true unless it is null-ish (0 is true)."""
    return F.coalesce(c, F.lit(False)) if kind == BOOL else is_not_nil(c, kind)


def not_(c: Column, kind: str = BOOL) -> Column:
    return ~truthy(c, kind)


def and_(*cs: Column) -> Column:
    """Short-circuits from the left: later conditions are evaluated only where earlier ones hold."""
    return reduce(lambda acc, c: F.when(truthy(c), acc).otherwise(False), reversed(cs[:-1]), truthy(cs[-1])) if cs else F.lit(False)


def or_(*cs: Column) -> Column:
    return reduce(lambda acc, c: F.when(truthy(c), True).otherwise(acc), reversed(cs[:-1]), truthy(cs[-1])) if cs else F.lit(False)


def ternary(condition: Column, then: Column, otherwise: Column | None = None, kind: str = BOOL) -> Column:
    chosen = F.when(truthy(condition, kind), then)
    return chosen if otherwise is None else chosen.otherwise(otherwise)


def required(body: Column, *args: tuple[Column, str]) -> Column:
    """``body`` where no argument is null-ish, else null."""
    return F.when(reduce(lambda a, b: a & b, [is_not_nil(c, k) for c, k in args]), body)


def num0(c: Column) -> Column:
    return F.coalesce(c.cast("double"), F.lit(0.0))


def add(first: Column, *more: Column) -> Column:
    return reduce(lambda a, b: a + num0(b), more, num0(first))


def sub(first: Column, *more: Column) -> Column:
    return reduce(lambda a, b: a - num0(b), more, num0(first))


def mul(first: Column, *more: Column) -> Column:
    return reduce(lambda a, b: a * num0(b), more, num0(first))


def div(a: Column, b: Column) -> Column:
    a, b = num0(a), num0(b)
    by_zero = F.when(a > 0, float("inf")).when(a < 0, float("-inf")).otherwise(float("nan"))
    return F.when(b == 0, by_zero).otherwise(F.try_divide(a, b))


def mod(a: Column, b: Column) -> Column:
    return F.try_mod(num0(a), num0(b))


def floor(c: Column) -> Column:
    return F.floor(num0(c)).cast("double")


def eq(first: Column, *more: Column, kind: str = ANY) -> Column:
    """All equal to the first; null-ish values are equal to each other."""
    return reduce(lambda a, b: a & b, [nullify(first, kind).eqNullSafe(nullify(c, kind)) for c in more], F.lit(True))


def neq(a: Column, b: Column, kind: str = ANY) -> Column:
    return ~eq(a, b, kind=kind)


def all_distinct(*cs: Column, kind: str = ANY) -> Column:
    """No two of the values are equal."""
    pairs = [neq(a, b, kind) for i, a in enumerate(cs) for b in cs[:i]]
    return reduce(lambda a, b: a & b, pairs, F.lit(True))


def gt(a: Column, b: Column) -> Column:
    return num0(a) > num0(b)


def gte(a: Column, b: Column) -> Column:
    return num0(a) >= num0(b)


def lt(a: Column, b: Column) -> Column:
    return num0(a) < num0(b)


def lte(a: Column, b: Column) -> Column:
    return num0(a) <= num0(b)


def to_text(c: Column, kind: str = ANY) -> Column:
    """Text of a value: null prints as nothing, whole numbers without a fraction, whatever their type."""
    if kind == ANY:
        return F.when(F.typeof(c).isin("double", "float"), to_text(c.try_cast("double"), NUMBER)).otherwise(to_text(c, STRING))
    if kind == NUMBER:
        d = c.cast("double")
        whole = (d == F.rint(d)) & (F.abs(d) < 9e18)
        return F.coalesce(F.when(whole, F.when(whole, d).cast("bigint").cast("string")).otherwise(d.cast("string")), F.lit(""))
    return F.coalesce(c.cast("string"), F.lit(""))


def concat_text(*parts: tuple[Column, str] | Column) -> Column:
    """String sum and interpolation."""
    return F.concat(*[to_text(*p) if isinstance(p, tuple) else to_text(p) for p in parts])


def numbers(start: Column, end: Column | None = None) -> Column:
    """The whole numbers from ``start`` (0 if only an end is given) up to but not ``end``, as doubles; empty if there are none."""
    if end is None:
        start, end = F.lit(0), start
    some = F.sequence(start.cast("bigint"), F.greatest(end.cast("bigint") - 1, start.cast("bigint")))
    return F.when(end > start, some).otherwise(F.array().cast("array<bigint>")).cast("array<double>")


def numbers_either_way(start: Column, end: Column) -> Column:
    """As ``numbers``, but counts down where ``start`` is above ``end``."""
    step = F.when(start <= end, 1).otherwise(-1).cast("bigint")
    some = F.sequence(start.cast("bigint"), end.cast("bigint") - step, step)
    return F.when(start == end, F.array().cast("array<bigint>")).otherwise(some).cast("array<double>")


def parse_num(c: Column, strict: bool = True) -> Column:
    """A number of text; bad text raises unless ``strict`` is off, null-ish text is null."""
    text = F.trim(nullify(c, STRING))
    return text.cast("double") if strict else text.try_cast("double")


def fail(message: str) -> Column:
    return F.raise_error(F.lit(message))


def with_default(attempt: Column, fallback: Column) -> Column:
    """Value of a ``try_*`` column, or a fallback where it came to nothing."""
    return F.coalesce(attempt, fallback)


def digest(*cs: Column) -> Column:
    """Stable hex digest of scalars with their types (1 and "1" differ); null-ish ones hash alike."""
    return F.sha2(F.to_json(F.struct(*[nullify(c).alias(f"f{i}") for i, c in enumerate(cs)])), 256)


def int_digest(*cs: Column) -> Column:
    """The first 32 bits of ``digest``, signed."""
    return (F.conv(F.substring(digest(*cs), 1, 8), 16, 10).cast("bigint") - F.lit(2**31)).cast("int")


def type_of(c: Column) -> Column:
    """Kind of a value: null, string, number, bool, array, container (struct or map) or other, by its static type."""
    t = F.typeof(c)
    number = t.isin("tinyint", "smallint", "int", "bigint", "float", "double") | t.startswith("decimal")
    named = F.when(number, NUMBER).when(t == "string", STRING).when(t == "boolean", BOOL).when(t.startswith("array"), ARRAY).when(t.startswith("struct") | t.startswith("map"), "container").otherwise("other")
    return F.when(c.isNull(), "null").otherwise(named)


def is_type(c: Column, *kinds: str) -> Column:
    return type_of(c).isin(*kinds)


def debug_string(c: Column) -> Column:
    """A value with its kind, for looking at."""
    return F.concat(type_of(c), F.lit(": "), F.coalesce(to_text(c), F.lit("")))
