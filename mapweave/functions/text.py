"""String, pattern and encoding functions over Columns."""

from __future__ import annotations

import re
import string

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scalars import nullify, to_text


def split(c: Column, delimiter: str | None = None) -> Column:
    """By a literal delimiter, empty parts kept; into characters without one."""
    return F.split(c, "" if delimiter is None else re.escape(delimiter), -1)


def split_trimmed(c: Column, delimiter: str) -> Column:
    """By a literal delimiter; parts are trimmed and empty ones dropped."""
    return F.filter(F.transform(split(c, delimiter), lambda x: F.trim(x)), lambda x: x != "")


def str_join(delimiter: str, array: Column) -> Column:
    """Elements joined, nulls as empty text."""
    return F.array_join(F.transform(array, lambda x: to_text(x)), delimiter)


def str_join_present(delimiter: str, array: Column) -> Column:
    """Elements joined, nulls left out."""
    return F.array_join(array, delimiter)


def trimmed(c: Column) -> Column:
    """Written text without white space around it; nothing left is null."""
    return nullify(F.trim(c))


def str_fmt(pattern: str, *args: Column) -> Column:
    return F.format_string(pattern, *[to_text(a) for a in args])


def to_upper(c: Column) -> Column:
    """ASCII letters only."""
    return F.translate(c, string.ascii_lowercase, string.ascii_uppercase)


def to_lower(c: Column) -> Column:
    return F.translate(c, string.ascii_uppercase, string.ascii_lowercase)


def matches_regex(c: Column, pattern: str) -> Column:
    """Whether the whole text matches; null doesn't."""
    return F.coalesce(c.rlike(rf"\A(?:{pattern})\z"), F.lit(False))


def contains_regex(c: Column, pattern: str) -> Column:
    return F.coalesce(c.rlike(pattern), F.lit(False))


def extract_regex(c: Column, pattern: str) -> Column:
    """First match or null."""
    return nullify(F.regexp_extract(c, pattern, 0))


def extract_all(c: Column, pattern: str, groups: int, make) -> Column:
    """``make(list of groups)`` of every match; group 0 is the match."""
    found = [F.regexp_extract_all(c, F.lit(pattern), F.lit(i)) for i in range(groups + 1)]
    zipped = F.arrays_zip(*[f.alias(f"g{i}") for i, f in enumerate(found)])
    names = [f"g{i}" for i in range(groups + 1)]
    return F.transform(zipped.cast("array<struct<" + ",".join(f"{n}:string" for n in names) + ">>"), lambda m: make([m[n] for n in names]))


def base64_encode(c: Column) -> Column:
    """On one line; Spark's own may break it after every 76 characters."""
    return F.replace(F.base64(F.coalesce(c, F.lit("")).cast("binary")), F.lit("\r\n"), F.lit(""))


def base64_decode(c: Column) -> Column:
    return F.unbase64(F.coalesce(c, F.lit(""))).cast("string")


def sub_str(c: Column, start: int, end: int) -> Column:
    """From ``start`` up to ``end``, clamped to the text."""
    return F.substring(c, start + 1, max(end - start, 0))


def sorted_fields(c: Column, kind: T.DataType) -> Column:
    """A value with the fields of its structs in the order of their names."""
    if isinstance(kind, T.StructType):
        return F.when(c.isNotNull(), F.struct(*[sorted_fields(c[f.name], f.dataType).alias(f.name) for f in sorted(kind, key=lambda f: f.name)]))
    if isinstance(kind, T.ArrayType):
        return F.transform(c, lambda x: sorted_fields(x, kind.elementType))
    return c


def serialize_json(struct: Column, kind: T.DataType | None = None) -> Column:
    """Compact JSON; null members are dropped. Fields are sorted by name if the type is given, else as they stand."""
    return F.to_json(struct if kind is None else sorted_fields(struct, kind))


def merge_json(existing: Column, inbound: Column, schema: T.StructType) -> Column:
    """JSON text of two JSON texts of one schema merged deep: arrays concatenate, other values of ``inbound`` win where they are set."""
    from ..operators import merge

    a, b = (F.from_json(c, schema) for c in (existing, inbound))
    return F.coalesce(serialize_json(F.when(a.isNotNull() & b.isNotNull(), merge.merged(a, b, schema, schema)), None), inbound, existing)


def json_path(c: Column, *path: str, to: str = "string") -> Column:
    """A value inside JSON text, null if it isn't there; names may hold dots."""
    if any("'" in p and '"' in p for p in path):
        raise ValueError("a field's name can't hold both kinds of quotes")
    steps = "".join(f'["{p}"]' if "'" in p else f"['{p}']" for p in path)
    return F.try_variant_get(F.try_parse_json(c), "$" + steps, to)
