"""Array and map functions over Columns: selectors, folds, iteration."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scalars import ANY, ARRAY, STRING, nullify, truthy

Fn = Callable[..., Column]


def where(array: Column, p: Fn) -> Column:
    """Elements for which ``p`` holds."""
    return F.filter(array, lambda x: truthy(p(x)))


def where_fields(m: Column, p: Fn, kind: T.DataType | None = None) -> Column:
    """Entries of a map, or of a struct (whose type is given) as a map of texts, for which ``p(field, value)`` holds."""
    return F.map_filter(struct_as_map(m, kind) if isinstance(kind, T.StructType) else m, lambda k, v: truthy(p(k, v)))


def wildcard(array: Column, f: Fn, kind: str = ANY, flat: bool = False) -> Column:
    """``f`` of every element, null-ish results dropped; ``flat`` joins results that are arrays, as a second wildcard does."""
    made = F.filter(F.transform(array, lambda x: f(x)), lambda x: nullify(x, ARRAY if flat else kind).isNotNull())
    return F.flatten(made) if flat else made


def iterate(f: Fn, *arrays: Column, kind: str = ANY) -> Column:
    """``f`` over one array or several in step; null-ish results are dropped.

    A null or empty array gives nulls beside the others; arrays of unequal lengths, none of them 0, are an error.
    """
    if len(arrays) == 1:
        return wildcard(arrays[0], f, kind)
    sizes = F.array(*[F.when(a.isNull(), 0).otherwise(F.size(a)) for a in arrays])
    some = F.filter(sizes, lambda n: n > 0)
    zipped = F.arrays_zip(*[F.coalesce(a, F.array()).alias(f"a{i}") for i, a in enumerate(arrays)])
    made = F.filter(F.transform(zipped, lambda x: f(*[x[f"a{i}"] for i in range(len(arrays))])), lambda x: nullify(x, kind).isNotNull())
    bad = F.array_max(some) > F.array_min(some)
    return F.when(bad, F.raise_error(F.lit("arrays iterated together differ in length"))).otherwise(made)


def iterate_maps(f: Fn, *maps: Column, kind: str = ANY) -> Column:
    """``f(field, values...)`` over the union of the fields of maps; a null map gives nulls, null-ish results are dropped."""
    fields_ = F.array_sort(F.array_distinct(F.flatten(F.array_compact(F.array(*[F.map_keys(m) for m in maps])))))
    entries = F.transform(fields_, lambda k: F.struct(k.alias("k"), f(k, *[F.try_element_at(m, k) for m in maps]).alias("v")))
    return F.map_from_entries(F.filter(entries, lambda e: nullify(e["v"], kind).isNotNull()))


def reduce(array: Column, f: Fn, seed: Column | None = None) -> Column:
    """Left fold; without a seed the first element starts it, and an empty array gives null."""
    if seed is not None:
        return F.when(F.size(array) > 0, F.aggregate(array, seed, lambda acc, cur: f(acc, cur))).otherwise(seed)
    return F.when(F.size(array) > 0, F.aggregate(F.slice(array, 2, F.greatest(F.size(array) - 1, F.lit(0))), F.get(array, 0), lambda acc, cur: f(acc, cur)))


def list_len(array: Column) -> Column:
    return F.coalesce(F.size(array), F.lit(0))


def last(array: Column) -> Column:
    return F.try_element_at(array, F.lit(-1))


def unique(array: Column, kind: str = ANY) -> Column:
    """First occurrences in order; null-ish elements are equal."""
    return F.array_distinct(F.transform(array, lambda x: nullify(x, kind)))


def unique_by(array: Column, key: Fn) -> Column:
    """The first element of each key, in order."""
    keys = F.transform(array, lambda x: F.struct(key(x).alias("k")))  # in a struct, null keys are found too
    return F.filter(array, lambda x, i: F.array_position(keys, F.struct(key(x).alias("k"))) == i + 1)


def sort_by(array: Column, key: Fn) -> Column:
    """Stable, ascending, nulls first."""
    tagged = F.transform(array, lambda x, i: F.struct(key(x).alias("k"), i.alias("i"), x.alias("x")))
    return F.transform(F.array_sort(tagged), lambda s: s["x"])


def sort_by_desc(array: Column, key: Fn) -> Column:
    """Stable, descending, nulls last."""
    tagged = F.transform(array, lambda x, i: F.struct(key(x).alias("k"), i.alias("i"), x.alias("x")))

    def order(a: Column, b: Column) -> Column:
        by_key = F.when(a["k"].eqNullSafe(b["k"]), 0).when(a["k"].isNull(), 1).when(b["k"].isNull(), -1).when(a["k"] > b["k"], -1).otherwise(1)
        return F.when(by_key != 0, by_key).otherwise((a["i"] - b["i"]).cast("int"))

    return F.transform(F.array_sort(tagged, order), lambda s: s["x"])


def group_by(array: Column, key: Fn) -> Column:
    """[{key, elements}], groups in order of first occurrence."""
    keys = F.array_distinct(F.transform(array, lambda x: key(x)))
    return F.transform(keys, lambda k: F.struct(k.alias("key"), F.filter(array, lambda x: key(x).eqNullSafe(k)).alias("elements")))


def list_cat(*arrays: Column) -> Column:
    return F.concat(*[F.coalesce(a, F.array()) for a in arrays])


def flatten(array: Column, depth: int = 1) -> Column:
    for _ in range(depth):
        array = F.flatten(array)
    return array


def sort_and_take_top(array: Column, key: Fn, descending: bool = False) -> Column:
    """The element with the least (greatest) key as text; of ties the last one."""
    tagged = F.transform(array, lambda x, i: F.struct(key(x).cast("string").alias("k"), (i if descending else -i).alias("i"), x.alias("x")))
    return (F.array_max(tagged) if descending else F.array_min(tagged))["x"]


def union(existing: Column, inbound: Column) -> Column:
    """Ordered set union; a missing side gives the other."""
    return F.when(existing.isNull(), F.array_distinct(inbound)).when(inbound.isNull(), F.array_distinct(existing)).otherwise(F.array_union(existing, inbound))


def diff(existing: Column, inbound: Column) -> Column:
    """Ordered set difference; nothing inbound takes nothing away."""
    return F.when(inbound.isNull(), F.array_distinct(existing)).otherwise(F.array_except(existing, inbound))


def union_by_field(existing: Column, inbound: Column, key: Fn, kind: str = ANY) -> Column:
    """Elements by key, null-ish keys being equal: the last value of each key, at the place of its first. A missing side gives the other."""
    by = lambda x: F.struct(nullify(key(x), kind).alias("k"))
    both = F.concat(existing, inbound)
    order = F.array_distinct(F.transform(both, by))
    merged = F.transform(order, lambda k: F.try_element_at(F.filter(both, lambda x: by(x) == k), F.lit(-1)))
    return F.when(existing.isNull(), inbound).when(inbound.isNull(), existing).otherwise(merged)


def struct_as_map(c: Column, kind: T.StructType) -> Column:
    """The set fields of a struct as a map of texts: strings as they are, others as JSON text."""

    def text(f: T.StructField) -> Column:
        v = c[f.name]
        if isinstance(f.dataType, T.StringType):
            return nullify(v, STRING)
        if isinstance(f.dataType, (T.ArrayType, T.MapType)):
            return F.to_json(nullify(v, ARRAY))
        return F.to_json(v) if isinstance(f.dataType, T.StructType) else v.cast("string")

    entries = F.array(*[F.struct(F.lit(f.name).alias("k"), text(f).alias("v")) for f in kind])
    return F.map_from_entries(F.filter(entries, lambda e: e["v"].isNotNull()))


def fields(m: Column, kind: T.DataType | None = None) -> Column:
    """Sorted names of a map's fields, or of a struct's set fields if its type is given."""
    return F.array_sort(F.map_keys(struct_as_map(m, kind) if isinstance(kind, T.StructType) else m))


def values(m: Column, kind: T.DataType | None = None) -> Column:
    """Values in the order of the sorted fields; of a struct, whose type is given, as texts."""
    if isinstance(kind, T.StructType):
        return values(struct_as_map(m, kind))
    return F.transform(fields(m), lambda k: F.try_element_at(m, k))


def unset(m: Column, field: str, kind: T.DataType | None = None) -> Column:
    """A map, or a struct whose type is given, without one field."""
    if isinstance(kind, T.StructType):
        return F.struct(*[m[f.name].alias(f.name) for f in kind if f.name != field])
    return F.map_filter(m, lambda k, v: k != field)


def unnest_arrays(m: Column) -> Column:
    """[{k, v}] of a map of arrays, fields sorted."""
    return F.flatten(F.transform(fields(m), lambda k: F.transform(F.try_element_at(m, k), lambda v: F.struct(k.alias("k"), v.alias("v")))))


def join_one_to_one(left: Column, right: Column, match: Fn, element: str) -> Column:
    """Greedy one-to-one full outer join of two arrays under any predicate.

    Each left element takes the first right element left that matches it; the right elements
    that nobody took follow. For small arrays: the fold looks at every pair. ``element``: DDL
    type of the elements.
    """
    pair = f"array<struct<l: {element}, r: {element}>>"
    start = F.struct(F.array().cast(pair).alias("out"), right.alias("rest"))

    def step(state: Column, x: Column) -> Column:
        hits = F.transform(state["rest"], lambda y, i: F.when(truthy(match(x, y)), i))
        at = F.array_min(hits)
        taken = F.struct(x.alias("l"), F.get(state["rest"], F.coalesce(at, F.lit(-1))).alias("r"))
        rest = F.filter(state["rest"], lambda y, i: ~i.eqNullSafe(at))
        return F.struct(F.concat(state["out"], F.array(taken)).cast(pair).alias("out"), rest.alias("rest"))

    done = F.aggregate(left, start, step)
    return F.concat(done["out"], F.transform(done["rest"], lambda y: F.struct(F.lit(None).cast(element).alias("l"), y.alias("r"))))
