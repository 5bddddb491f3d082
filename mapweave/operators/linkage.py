"""Record linkage: matching criteria as Columns, links by shared property values, groups of linked records."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import discard, settle
from .skew import join_by_key

AND, OR = "AND", "OR"


@dataclass(frozen=True)
class Criteria:
    """A tree over a record: a field of kind primitive, array or container, with filters and children.

    ``filters``: of an array, (field, value) pairs that its elements must hold, fields with dots
    leading into structs; of a primitive, the values it may have. A name is empty for an array's
    element itself.
    """

    name: str
    kind: str
    paths: tuple["Criteria", ...] = ()
    operator: str = OR
    filters: tuple = field(default=())

    def __post_init__(self):
        if not isinstance(self.name, str):
            raise ValueError(f"field {self.name!r} is no text")
        if self.kind not in ("primitive", "array", "container"):
            raise ValueError(f"{self.name}: kind {self.kind!r} is none of primitive, array, container")
        if self.operator not in (AND, OR):
            raise ValueError(f"{self.name}: operator {self.operator!r} is neither AND nor OR")
        if (self.kind == "primitive") == bool(self.paths):
            raise ValueError(f"{self.name}: a primitive has no paths, anything else has some")
        if self.kind == "array" and not self.name:
            raise ValueError("an array has a field")
        if self.kind == "container" and any(p.kind == "primitive" and not p.name for p in self.paths):
            raise ValueError(f"{self.name}: a primitive in a container has a field")
        if self.kind == "container" and self.filters:
            raise ValueError(f"{self.name}: a container has no filters")


def criteria_from(config: dict) -> Criteria:
    """Criteria of a JSON configuration: field, fieldType, pathOperator, fieldFilter, paths. Malformed ones raise."""
    if not isinstance(config, dict):
        raise ValueError(f"{config!r} is no container of criteria")
    name, kind, operator = (config.get(k, "") for k in ("field", "fieldType", "pathOperator"))
    paths, allowed = config.get("paths", []), config.get("fieldFilter", [])
    if not isinstance(kind, str) or not isinstance(operator, str):
        raise ValueError(f"{name}: fieldType and pathOperator are text")
    if not isinstance(paths, list):
        raise ValueError(f"{name}: paths are no array")
    if not isinstance(allowed, list) or not all(isinstance(v, (str, int, float, bool)) for v in allowed):
        raise ValueError(f"{name}: fieldFilter is no array of primitives")
    if allowed and kind != "primitive":
        raise ValueError(f"{name}: only primitives have a fieldFilter")
    return Criteria(name, kind, tuple(criteria_from(p) for p in paths), operator or OR, tuple(str(v) for v in allowed))


def check_criteria(criteria: Criteria, record: T.DataType) -> None:
    """Raises where the type of the records is not as the criteria have it; missing fields are no error."""
    kind = record
    if criteria.name:
        if not isinstance(record, T.StructType):
            raise TypeError(f"{criteria.name} is looked for in a {record.simpleString()}, which has no fields")
        if criteria.name not in record.fieldNames():
            return
        kind = record[criteria.name].dataType
    wanted = {"array": T.ArrayType, "container": T.StructType}.get(criteria.kind)
    if wanted and not isinstance(kind, wanted) or not wanted and isinstance(kind, (T.ArrayType, T.StructType, T.MapType)):
        raise TypeError(f"{criteria.name or 'an element'} is a {kind.simpleString()}, not a {criteria.kind}")
    for p in criteria.paths:
        check_criteria(p, kind.elementType if criteria.kind == "array" else kind)


def primitive(name: str) -> Criteria:
    return Criteria(name, "primitive")


def filter_value(name: str, value: str) -> tuple[str, str]:
    return (name, value)


def any_of(name: str, *paths: Criteria) -> Criteria:
    return Criteria(name, "container", paths, OR)


def all_of(name: str, *paths: Criteria) -> Criteria:
    return Criteria(name, "container", paths, AND)


def array_any_of(name: str, *paths: Criteria, filters=()) -> Criteria:
    return Criteria(name, "array", paths, OR, tuple(filters))


def array_all_of(name: str, *paths: Criteria, filters=()) -> Criteria:
    return Criteria(name, "array", paths, AND, tuple(filters))


def path_to(name: str, inner: Criteria) -> Criteria:
    return any_of(name, inner)


def any_identifier(*filters) -> Criteria:
    return array_all_of("identifier", primitive("system"), primitive("value"), filters=filters)


def any_coding(*filters) -> Criteria:
    return array_all_of("coding", primitive("system"), primitive("code"), filters=filters)


def reference_for(name: str) -> Criteria:
    return any_of(name, primitive("reference"))


def identifier_reference_for(name: str) -> Criteria:
    return any_of(name, all_of("", primitive("type"), path_to("identifier", all_of("", primitive("system"), primitive("value")))))


def any_meta_tag(*filters) -> Criteria:
    return any_of("meta", array_all_of("tag", primitive("system"), primitive("code"), filters=filters))


def any_meta_extension(*filters) -> Criteria:
    return any_of("meta", array_all_of("extension", primitive("url"), primitive("valueString"), filters=filters))


def build_reference(kind: Column, key: Column, separator: str = "/") -> Column:
    """A reference to a record, ``Type/key``; null if either is null-ish."""
    return F.when((kind != "") & (key.cast("string") != ""), F.concat(kind, F.lit(separator), key.cast("string")))


def property_values(criteria: Criteria, record: Column) -> Column:
    """Distinct strings ``field=...`` of a record (a struct) under the criteria.

    OR gives the children's strings one after another; AND combines one of each child, sorted
    and joined with ``|``, and nothing if any child has none.
    """
    return F.array_distinct(_strings(criteria, record[criteria.name] if criteria.name else record))


def _strings(c: Criteria, value: Column) -> Column:
    none = F.array().cast("array<string>")
    if c.kind == "primitive":
        text = F.nullif(value.cast("string"), F.lit(""))
        held = text.isin(*c.filters) if c.filters else text.isNotNull()
        return F.when(held, F.array(F.concat(F.lit(f"{c.name}=" if c.name else ""), text))).otherwise(none)
    if c.kind == "array":
        kept = value
        for name, wanted in c.filters:
            kept = _holding(kept, name, wanted)
        return F.coalesce(F.flatten(F.transform(kept, lambda x: _children(c, x))), none)
    return F.when(value.isNull(), none).otherwise(_children(c, value))


def _children(c: Criteria, value: Column) -> Column:
    lists = [_strings(p, value[p.name] if p.name else value) for p in c.paths]
    if c.operator == OR:
        combined = F.concat(*lists)
    else:
        combined = F.transform(lists[0], lambda s: F.array(s))
        for more in lists[1:]:
            combined = _crossed(combined, more)
        combined = F.transform(combined, lambda parts: F.array_join(F.array_sort(parts), "|"))
    return F.transform(combined, lambda s: F.concat(F.lit(f"{c.name}="), s)) if c.name else combined


def _holding(array: Column, name: str, wanted: str) -> Column:
    def inner(x: Column) -> Column:
        for step in name.split("."):
            x = x[step]
        return x

    return F.filter(array, lambda x: inner(x).cast("string").eqNullSafe(F.lit(wanted)))


def _crossed(combined: Column, more: Column) -> Column:
    return F.flatten(F.transform(combined, lambda parts: F.transform(more, lambda s: F.array_append(parts, s))))


def link_records(df: DataFrame, key: str, values: str, most_rounds: int = 50) -> DataFrame:
    """(key, group): records that share a property value, directly or through others; group is the smallest key.

    Keys of any ordered type. Each value links its records to their smallest one, so a value
    that many records share makes as many links as it has records. Labels then move to the
    least of their neighbours and jump to their label's label until none moves; each round is a
    written table. Records with a null key link with nothing and are left out.
    """
    named = df.where(F.col(key).isNotNull())
    owned = settle(named.select(F.col(key).alias("id"), F.explode(values).alias("v")).distinct())
    least = settle(owned.groupBy("v").agg(F.min("id").alias("m"), F.count("*").alias("n")))
    edges = settle(join_by_key(owned, least, ["v"], "n").select("id", "m").where("id <> m").distinct())
    both = edges.unionByName(edges.select(F.col("m").alias("id"), F.col("id").alias("m")))
    ends = settle(both.groupBy("m").agg(F.count("*").alias("n")))
    labels = settle(named.select(F.col(key).alias("id"), F.col(key).alias("g")).distinct())
    for _ in range(most_rounds):
        said = settle(ends.join(labels.withColumnsRenamed({"id": "m", "g": "h"}), "m"))
        near = join_by_key(both, said, ["m"], "n").groupBy("id").agg(F.min("h").alias("h"))
        moved = settle(labels.join(near, "id", "left").select("id", F.least("g", "h").alias("g"), F.col("g").alias("was")))
        jump = moved.select(F.col("id").alias("g"), F.col("g").alias("j"))
        found = settle(moved.join(jump, "g", "left").select("id", F.coalesce("j", "g").alias("g"), "was"))
        for done in (labels, said, moved):
            discard(done)
        labels = found.select("id", "g")
        labels._settled_at = found._settled_at
        if found.where("g <> was").isEmpty():
            break
    else:
        raise RuntimeError(f"groups are not settled after {most_rounds} rounds")
    return labels.select(F.col("id").alias(key), F.col("g").alias("group"))
