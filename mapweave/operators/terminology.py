"""Terminology and unit lookups as joins with small tables."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Concept maps up to this many rows are broadcast.
BROADCAST_ROWS = 200_000


def concept_table(spark: SparkSession, maps: list[dict]) -> DataFrame:
    """Rows (map_id, source, code, at, target_code, display, target_system, version) of concept maps, ``at`` in their order; of equal ids the first holds."""
    rows, seen = [], set()
    for m in maps:
        if m["id"] in seen:
            continue
        seen.add(m["id"])
        for g in m.get("group", []):
            for e in g.get("element", []):
                for t in e.get("target", []):
                    rows.append((m["id"], g.get("source", ""), e["code"], len(rows), t["code"], t.get("display", ""), g.get("target", ""), m.get("version", "")))
    return spark.createDataFrame(rows, "map_id string, source string, code string, at int, target_code string, display string, target_system string, version string")


def unmapped_table(spark: SparkSession, maps: list[dict]) -> DataFrame:
    """``unmapped_rules`` as a table (map_id, source, mode, fixed_code, fixed_display, target_system, version)."""
    return spark.createDataFrame(unmapped_rules(maps), "map_id string, source string, mode string, fixed_code string, fixed_display string, target_system string, version string")


def unmapped_rules(maps: list[dict]) -> list[tuple]:
    """The groups' rules for codes without a match; of equal map ids the first holds."""
    rows, seen = [], set()
    for m in maps:
        if m["id"] in seen:
            continue
        seen.add(m["id"])
        for g in m.get("group", []):
            u = g.get("unmapped")
            if u:
                rows.append((m["id"], g.get("source", ""), u["mode"], u.get("code", ""), u.get("display", ""), g.get("target", ""), m.get("version", "")))
    return rows


def load_concept_maps(text: str) -> list[dict]:
    got = json.loads(text)
    return got if isinstance(got, list) else [got]


def harmonize(df: DataFrame, maps: list[dict], map_id: str, code: Column, system: Column | None = None, target_system: str | None = None, out: str = "coded") -> DataFrame:
    """``df`` with ``out``: array of {code, display, system, version} for each record's code.

    A null-ish system matches any group. Codes without a match take the groups' unmapped rules
    (``fixed`` or ``provided``), and without one the code itself under ``<map>-unharmonized``.
    """
    if map_id not in {m["id"] for m in maps}:
        raise KeyError(f"no concept map {map_id!r}")
    spark = df.sparkSession
    system = F.coalesce(system, F.lit("")) if system is not None else F.lit("")
    known = concept_table(spark, maps).where(F.col("map_id") == map_id)
    if target_system is not None:
        known = known.where(F.col("target_system") == target_system)
    names = ("source", "mode", "fixed_code", "fixed_display", "target_system", "version")
    rule_rows = [dict(zip(names, r[1:])) for r in unmapped_rules(maps) if r[0] == map_id and target_system in (None, r[5])]
    entry = F.struct("at", F.col("target_code").alias("code"), "display", F.col("target_system").alias("system"), "version")
    in_order = F.transform(F.sort_array(F.collect_list(entry)), lambda x: x.dropFields("at")).alias("found")
    by_source = known.groupBy("source", "code").agg(in_order)
    any_source = known.groupBy("code").agg(in_order).select(F.lit("").alias("source"), "code", "found")
    lookup = by_source.where("source <> ''").unionByName(any_source).withColumnsRenamed({"source": "__source", "code": "__code"})
    small = sum(len(g.get("element", [])) for m in maps for g in m.get("group", [])) <= BROADCAST_ROWS
    keyed = df.withColumns({"__c": code.cast("string"), "__s": system})
    met = keyed.join(F.broadcast(lookup) if small else lookup, (F.col("__c") == F.col("__code")) & (F.col("__s") == F.col("__source")), "left")
    kind = "array<struct<code: string, display: string, system: string, version: string>>"

    def rule_entry(r: dict) -> Column:
        provided = r["mode"] == "provided"
        fixed = F.struct(*[(F.col("__c") if provided and k == "code" else F.lit("" if provided and k == "display" else v)).alias(k) for k, v in (("code", r["fixed_code"]), ("display", r["fixed_display"]), ("system", r["target_system"]), ("version", r["version"]))])
        return F.when((F.col("__s") == "") | (F.col("__s") == r["source"]), fixed)

    unmapped = F.array_compact(F.array(*[rule_entry(r) for r in rule_rows])).cast(kind) if rule_rows else F.array().cast(kind)
    unknown = F.array(F.struct(F.col("__c").alias("code"), F.lit("").alias("display"), F.lit(f"{map_id}-unharmonized").alias("system"), F.lit("").alias("version"))).cast(kind)
    chosen = F.when(F.col("found").isNotNull(), F.col("found")).when(F.size(unmapped) > 0, unmapped).otherwise(unknown)
    return met.withColumn(out, chosen).drop("__c", "__s", "__code", "__source", "found")


def unit_table(spark: SparkSession, conversions: list[dict]) -> DataFrame:
    """(unit, u_code, u_system, dest_unit, scalar, constant, constant_first), the first for each source unit, code and system."""
    rows = [(u, c.get("code", ""), c.get("codesystem", ""), c["dest_unit"], float(c.get("scalar", 1.0)), float(c.get("constant", 0.0)), bool(c.get("constant_first", False))) for c in conversions for u in c["source_unit"]]
    rows = list({r[:3]: r for r in reversed(rows)}.values())
    return spark.createDataFrame(rows, "u_unit string, u_code string, u_system string, dest_unit string, scalar double, constant double, constant_first boolean")


def harmonize_unit(df: DataFrame, conversions: list[dict], quantity: Column, unit: Column, code: Column, system: Column, decimals: int, prefix: str = "si_") -> DataFrame:
    """``df`` with the converted quantity and unit, and whether a conversion was found; else as they were.

    A conversion is looked up by unit, code and system as they are, null being "", so each
    record meets one at most.
    """
    table = unit_table(df.sparkSession, conversions)
    keyed = df.withColumns({"__q": quantity.cast("double"), "__u": unit, "__c": F.coalesce(code, F.lit("")), "__y": F.coalesce(system, F.lit(""))})
    on = (F.col("__u") == F.col("u_unit")) & (F.col("u_code") == F.col("__c")) & (F.col("u_system") == F.col("__y"))
    units = sum(len(c["source_unit"]) for c in conversions)
    met = keyed.join(F.broadcast(table) if units <= BROADCAST_ROWS else table, on, "left")
    value = F.when(F.col("constant_first"), (F.col("constant") + F.col("__q")) * F.col("scalar")).otherwise(F.col("scalar") * F.col("__q") + F.col("constant"))
    done = met.withColumns({f"{prefix}value": F.when(F.col("dest_unit").isNull(), F.col("__q")).otherwise(F.round(value, decimals)), f"{prefix}unit": F.coalesce("dest_unit", "__u"), f"{prefix}converted": F.col("dest_unit").isNotNull()})
    return done.drop("__q", "__u", "__c", "__y", *table.columns)
