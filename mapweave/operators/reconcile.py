"""Snapshot merging: folding a record's versions into one by rules for each field."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

FORCE, PREFER, UNION = "force_inbound", "prefer_inbound", "union"


def nullish(kind: T.DataType, c: Column) -> Column:
    if isinstance(kind, T.StringType):
        return F.nullif(c, F.lit(""))
    return F.when(F.size(c) > 0, c) if isinstance(kind, (T.ArrayType, T.MapType)) else c


def force_inbound(existing: Column, inbound: Column) -> Column:
    return inbound


def prefer_inbound(existing: Column, inbound: Column, kind: T.DataType | None = None) -> Column:
    return F.coalesce(nullish(kind, inbound) if kind else inbound, existing)


def choice_written(rule, existing: Column, inbound: Column, kind: T.StructType, *names: str) -> Column:
    """The struct ``existing`` with its alternative fields merged by ``rule``: the one that the result names is set, the others are null."""
    chosen = choice_field(rule, existing, inbound, *names)
    kinds = {f.name: f.dataType for f in kind}
    outs = [F.when(chosen["field"] == n, chosen["value"].cast(kinds[n])).alias(n) if n in names else existing[n].alias(n) for n in kinds]
    return F.struct(*outs)


def choice_field(rule, existing: Column, inbound: Column, *names: str) -> Column:
    """Of alternative fields: the merge by ``rule`` of the first one set on each side, as (field, value)."""

    def first(side: Column) -> Column:
        picked = F.lit(None)
        for n in reversed(names):
            picked = F.when(side[n].isNotNull(), F.struct(F.lit(n).alias("field"), side[n].cast("string").alias("value"))).otherwise(picked)
        return picked

    return rule(first(existing), first(inbound))


def merge_snapshots(df: DataFrame, key: list[str], order: list[str], rules: dict[str, str], mode: str = "merge") -> DataFrame:
    """One record for each key from its snapshots in ``order``.

    ``latest``: the last snapshot. ``merge``: each field by its rule - the last value, the last
    value that is set, or the union of arrays in order of appearance. The rules are
    associative, so each becomes an aggregate that combines partial results. Unions find where
    each element first appears (elements that tie there stand in their own order) and collect
    distinct elements only.
    """
    kinds = {f.name: f.dataType for f in df.schema}
    names = [c for c in df.columns if c not in key and c not in order]
    at = F.struct(*order)
    if mode == "latest":
        last = df.groupBy(*key).agg(F.max_by(F.struct(*names), at).alias("r"))
        return last.select(*key, "r.*")
    outs, unions = [], []
    for n in names:
        rule = rules.get(n, UNION if isinstance(kinds[n], T.ArrayType) else PREFER)
        c = F.col(n)
        if rule == FORCE:
            outs.append(F.max_by(c, at).alias(n))
        elif rule == PREFER:
            outs.append(F.max_by(c, F.when(nullish(kinds[n], c).isNotNull(), at)).alias(n))
        elif rule == UNION:
            unions.append(n)
        else:
            raise ValueError(f"no merge rule {rule!r}")
    done = df.groupBy(*key).agg(*outs) if outs else df.select(*key).distinct()
    for n in unions:
        each = df.select(*key, at.alias("__at"), F.posexplode(n).alias("__pos", "__v"))
        firsts = each.groupBy(*key, "__v").agg(F.min(F.struct("__at", "__pos")).alias("__first"))
        found = firsts.groupBy(*[F.col(k).alias(f"__key_{k}") for k in key]).agg(F.transform(F.sort_array(F.collect_list(F.struct("__first", "__v"))), lambda x: x["__v"]).alias("__found"))
        on = F.lit(True)
        for k in key:
            on = on & F.col(k).eqNullSafe(F.col(f"__key_{k}"))
        done = done.join(found, on, "left").withColumn(n, F.coalesce("__found", F.array().cast(kinds[n]))).select(*done.columns, n)
    return done.select(*key, *names)


def rules_for(kind: str, rules: dict[str, dict[str, str]], default: dict[str, str] | None = None) -> dict[str, str]:
    """The field rules of a record type: those under its name, else ``default``; single fields of ``default`` hold where a type says nothing of them."""
    return (default or {}) | rules.get(kind, {})


def merge_by_type(df: DataFrame, type_column: str, key: list[str], order: list[str], rules: dict[str, dict[str, str]], default: dict[str, str] | None = None, modes: dict[str, str] | None = None) -> DataFrame:
    """``merge_snapshots`` of records of several types, each by the rules (and in the mode) of its type.

    Types without rules of their own, null among them, share the default ones and are merged in one pass.
    """
    modes = modes or {}
    named = sorted(set(rules) | set(modes))
    kind = F.col(type_column)
    keys = [type_column, *key]
    other = ~kind.isin(*named) | kind.isNull() if named else F.lit(True)
    done = merge_snapshots(df.where(other), keys, order, default or {})
    for n in named:
        done = done.unionByName(merge_snapshots(df.where(kind == n), keys, order, rules_for(n, rules, default), modes.get(n, "merge")))
    return done


def without_tags(array: Column, field: str, *values: str) -> Column:
    """An array of structs (meta tags and the like) without those whose ``field`` has one of the values; null if none is left."""
    left = F.filter(array, lambda x: ~F.coalesce(x[field].isin(*values), F.lit(False)))
    return F.when(F.size(left) > 0, left)
