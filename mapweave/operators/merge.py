"""Merging writes: deep union of structs and maps, concatenation of arrays, else replacement; and writes at a path."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

MERGE, REPLACE, APPEND, EXTEND = "merge", "replace", "append", "extend"


def _present(c: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.StringType):
        return F.nullif(c, F.lit(""))
    if isinstance(kind, (T.ArrayType, T.MapType)):
        return F.when(F.size(c) > 0, c)
    return c


def merged(existing: Column, incoming: Column, old: T.DataType, new: T.DataType) -> Column:
    """``incoming`` written onto ``existing``; the types are those of the two sides.

    Structs unite field by field, maps key by key, both deep; arrays concatenate;
    null-ish incoming values leave what is there; anything else is replaced.
    """
    if isinstance(old, T.NullType):
        return incoming
    if isinstance(new, T.NullType):
        return existing
    if isinstance(old, T.StructType) and isinstance(new, T.StructType):
        olds, news = {f.name: f.dataType for f in old}, {f.name: f.dataType for f in new}
        out = []
        for name in [*olds, *[n for n in news if n not in olds]]:
            if name not in news:
                out.append(existing[name].alias(name))
            elif name not in olds:
                out.append(incoming[name].alias(name))
            else:
                out.append(merged(existing[name], incoming[name], olds[name], news[name]).alias(name))
        return F.struct(*out)
    if isinstance(old, T.MapType) and isinstance(new, T.MapType):
        both = F.map_zip_with(existing, incoming, lambda k, a, b: merged(a, b, old.valueType, new.valueType))
        return F.coalesce(both, _present(incoming, new), existing)
    if isinstance(old, T.ArrayType) and isinstance(new, T.ArrayType):
        return F.when(existing.isNull(), incoming).when(incoming.isNull(), existing).otherwise(F.concat(existing, incoming))
    return F.coalesce(_present(incoming, new), existing)


def merged_type(old: T.DataType, new: T.DataType, mode: str = MERGE) -> T.DataType:
    """The type of ``written`` for the types of both sides."""
    if isinstance(old, T.NullType) or mode == REPLACE:
        return new
    if isinstance(new, T.NullType) or mode == APPEND:
        return old
    if isinstance(old, T.StructType) and isinstance(new, T.StructType):
        news = {f.name: f.dataType for f in new}
        both = [T.StructField(f.name, merged_type(f.dataType, news[f.name]) if f.name in news and mode == MERGE else f.dataType) for f in old]
        return T.StructType(both + [T.StructField(f.name, f.dataType) for f in new if f.name not in old.fieldNames()])
    return old


def merged_at(existing: Column, incoming: Column, index: int, old: T.DataType | None = None, new: T.DataType | None = None) -> Column:
    """A write to the fixed slot ``index``: pads with nulls up to it and keeps the slot's value if the write is null.

    With the types of the element and of the write, it merges into what the slot holds.
    """
    size = F.greatest(F.when(existing.isNull(), 0).otherwise(F.size(existing)), F.lit(index + 1))
    there = lambda i: F.get(F.coalesce(existing, F.array()), i)
    put = (lambda i: F.coalesce(incoming, there(i))) if old is None else (lambda i: merged(there(i), incoming, old, new))
    return F.transform(F.sequence(F.lit(0), size - 1), lambda i: F.when(i == index, put(i)).otherwise(there(i)))


def written(existing: Column, incoming: Column, old: T.DataType, new: T.DataType, mode: str = MERGE) -> Column:
    """A write in one of the modes; ``append`` and ``extend`` need suitable types."""
    if mode == REPLACE:
        return incoming
    if mode == APPEND:
        if not isinstance(old, T.ArrayType):
            raise TypeError("append needs an array to append to")
        return F.array_append(F.coalesce(existing, F.array()), incoming)
    if mode == EXTEND:
        if isinstance(old, T.ArrayType):
            return F.when(existing.isNull(), incoming).when(incoming.isNull(), existing).otherwise(F.concat(existing, incoming))
        if isinstance(old, T.MapType):
            return F.coalesce(F.map_zip_with(existing, incoming, lambda k, a, b: F.coalesce(a, b)), existing, incoming)
        if isinstance(old, T.StructType):
            have = set(old.fieldNames())
            return F.struct(*[existing[n].alias(n) for n in old.fieldNames()], *[incoming[n].alias(n) for n in new.fieldNames() if n not in have])
        raise TypeError("extend needs arrays or containers")
    if mode != MERGE:
        raise ValueError(f"no merge mode {mode!r}")
    return merged(existing, incoming, old, new)


def path_steps(path: str) -> list[str | int | None]:
    """``a.b[0].c[]`` as field names, slots and None for an append."""
    steps: list[str | int | None] = []
    at = 0
    for m in re.finditer(r"\.?([^.\[\]]+)|\[(\d*)\]", path):
        if m.start() != at:
            break
        steps.append(m[1] if m[1] is not None else int(m[2]) if m[2] else None)
        at = m.end()
    if at != len(path) or path.startswith("."):
        raise ValueError(f"{path!r} is no path")
    return steps


def write_at(root: Column, kind: T.DataType, path: str, value: Column, value_kind: T.DataType, mode: str = MERGE) -> tuple[Column, T.DataType]:
    """``root`` with ``value`` written at ``path`` in one of the modes, and the type that it then has.

    Fields that are missing are added (``NullType`` starts from nothing), ``[n]`` fills an array
    up to that slot, ``[]`` appends an element; maps take steps as their keys.
    """
    return _written_at(root, kind, path_steps(path), value, value_kind, mode)


def _written_at(root: Column, kind: T.DataType, steps: list, value: Column, value_kind: T.DataType, mode: str) -> tuple[Column, T.DataType]:
    if not steps:
        made = merged_type(kind, value_kind, mode)
        return (value if isinstance(kind, T.NullType) else written(root, value, kind, value_kind, mode)), made
    step, rest = steps[0], steps[1:]
    void = T.NullType()
    if isinstance(step, str):
        if isinstance(kind, T.MapType):
            put, inner = _written_at(F.try_element_at(root, F.lit(step)), kind.valueType, rest, value, value_kind, mode)
            entry = F.create_map(F.lit(step), put)
            return F.coalesce(F.map_zip_with(root, entry, lambda k, a, b: F.when(k == step, b).otherwise(a)), entry), T.MapType(kind.keyType, inner)
        if not isinstance(kind, (T.StructType, T.NullType)):
            raise TypeError(f"{kind.simpleString()} has no field {step!r}")
        have = {f.name: f.dataType for f in kind} if isinstance(kind, T.StructType) else {}
        there = root[step] if step in have else F.lit(None)
        put, inner = _written_at(there, have.get(step, void), rest, value, value_kind, mode)
        types = have | {step: inner}
        made = F.struct(*[(put if n == step else root[n]).alias(n) for n in types])
        return made, T.StructType([T.StructField(n, t) for n, t in types.items()])
    if not isinstance(kind, (T.ArrayType, T.NullType)):
        raise TypeError(f"{kind.simpleString()} has no elements")
    element = kind.elementType if isinstance(kind, T.ArrayType) else void
    held = F.coalesce(root, F.array()) if isinstance(kind, T.ArrayType) else F.array()
    if step is None:
        put, inner = _written_at(F.lit(None), void, rest, value, value_kind, mode)
        inner = merged_type(element, inner)
        old = held if isinstance(element, T.NullType) else F.transform(held, lambda x: widened(x, element, inner))
        return F.concat(old.cast(T.ArrayType(inner)), F.array(put).cast(T.ArrayType(inner))), T.ArrayType(inner)
    size = F.greatest(F.size(held), F.lit(step + 1))
    put, inner = _written_at(F.get(held, F.lit(step)), element, rest, value, value_kind, mode)
    other = lambda i: F.lit(None).cast(inner) if isinstance(element, T.NullType) else widened(F.get(held, i), element, inner)
    return F.transform(F.sequence(F.lit(0), size - 1), lambda i: F.when(i == step, put.cast(inner)).otherwise(other(i))), T.ArrayType(inner)


def widened(c: Column, old: T.DataType, new: T.DataType) -> Column:
    """A value of a type as one that has more fields."""
    if old == new or not isinstance(old, T.StructType):
        return c.cast(new)
    have = {f.name: f.dataType for f in old}
    made = F.struct(*[(widened(c[f.name], have[f.name], f.dataType) if f.name in have else F.lit(None).cast(f.dataType)).alias(f.name) for f in new])
    return F.when(c.isNotNull(), made)
