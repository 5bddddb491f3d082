"""Queries of further mapping operators, with null and empty values made in the query, and their SQL."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import arrays as A
from ..functions import scalars as S
from ..functions import text as X
from ..functions import times as D
from ..operators import dataset, linkage, merge, reconcile, terminology
from ..session import shared_dir
from ..sources import documents
from ..streaming import mapping as streams
from .queries import big, order_docs, query, t

# Scalars


@query("SELECT s_suppkey AS id, s_acctbal >= 0 AS ge, s_acctbal < s_nationkey AS lt, s_acctbal <= 100 AS le, s_nationkey <> s_nationkey % 3 AS ne, NOT (s_nationkey % 2 = 0) AS neg, (s_nationkey % 2 <> s_nationkey % 3 AND s_nationkey % 3 <> s_nationkey % 5 AND s_nationkey % 2 <> s_nationkey % 5) AS apart, s_nationkey = 3 AS three, false AS nil, s_nationkey % 4 = 0 AS gone FROM supplier")
def comparisons(spark, sf_dir):
    b, k = F.col("s_acctbal"), F.col("s_nationkey")
    return t(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), S.gte(b, F.lit(0)).alias("ge"), S.lt(b, k).alias("lt"), S.lte(b, F.lit(100)).alias("le"), S.neq(k, k % 3).alias("ne"), S.not_(k % 2 == 0).alias("neg"), S.all_distinct(k % 2, k % 3, k % 5).alias("apart"), S.eq(k, F.lit(3)).alias("three"), S.is_nil(k).alias("nil"), S.is_nil(F.when(k % 4 != 0, k)).alias("gone"))


@query("SELECT p_partkey AS id, TRY_CAST(CASE p_size % 4 WHEN 0 THEN p_size || 'e2' WHEN 1 THEN '12345678901' || p_size || '.5' WHEN 2 THEN '-' || p_size ELSE 'x' || p_size END AS DOUBLE) AS loose, p_size::DOUBLE AS strict FROM part")
def parse_numbers(spark, sf_dir):
    n = F.col("p_size")
    text = F.when(n % 4 == 0, F.concat(n, F.lit("e2"))).when(n % 4 == 1, F.concat(F.lit("12345678901"), n, F.lit(".5"))).when(n % 4 == 2, F.concat(F.lit("-"), n)).otherwise(F.concat(F.lit("x"), n))
    return t(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), S.parse_num(text, strict=False).alias("loose"), S.parse_num(n.cast("string")).alias("strict"))


@query("SELECT n_nationkey AS id, array_to_string(CASE WHEN n_nationkey % 7 <= n_nationkey % 5 THEN range(n_nationkey % 7, n_nationkey % 5) ELSE range(n_nationkey % 7, n_nationkey % 5, -1) END, ',') AS both_ways, (n_nationkey % 5)::BIGINT AS n_up, coalesce(len(range(n_nationkey % 7, n_nationkey % 5)), 0)::BIGINT AS n_from FROM nation")
def ranges(spark, sf_dir):
    k = F.col("n_nationkey")
    return t(spark, sf_dir, "nation").select(k.alias("id"), X.str_join(",", S.numbers_either_way(k % 7, k % 5)).alias("both_ways"), big(F.size(S.numbers(k % 5))).alias("n_up"), big(F.size(S.numbers(k % 7, k % 5))).alias("n_from"))


@query("SELECT n_nationkey AS id, CASE WHEN n_regionkey = 0 THEN 'null' ELSE 'number' END AS a, 'string' AS b, 'array' AS c, 'container' AS d, n_regionkey <> 0 AS e, 'string: ' || n_name AS f FROM nation")
def kinds_of_values(spark, sf_dir):
    k, name = F.when(F.col("n_regionkey") != 0, F.col("n_regionkey")), F.col("n_name")
    return t(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), S.type_of(k).alias("a"), S.type_of(name).alias("b"), S.type_of(F.array(name)).alias("c"), S.type_of(F.struct(name)).alias("d"), S.is_type(k, S.NUMBER).alias("e"), S.debug_string(name).alias("f"))


# Arrays and maps


@query("SELECT l_orderkey AS id, sum(2 * l_linenumber + l_partkey + l_quantity::BIGINT)::BIGINT AS three, count(*) AS beside_null, sum((l_linenumber % 2 = 0)::INT)::BIGINT AS kept FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1")
def iterate_several(spark, sf_dir):
    line, part, q = (A.wildcard(F.col("lines"), lambda x, k=k: x[k]) for k in ("l_linenumber", "l_partkey", "l_quantity"))
    three = A.iterate(lambda a, b, c: 2 * a + b + c.cast("bigint"), line, part, q)
    beside = A.iterate(lambda a, b: a, part, F.lit(None).cast("array<int>"))
    kept = A.iterate(lambda a, b: F.when(a % 2 == 0, F.lit("x")).otherwise(""), line, part)
    return order_docs(spark, sf_dir).select(F.col("o_orderkey").alias("id"), big(A.reduce(three, lambda a, b: a + b)).alias("three"), big(F.size(beside)).alias("beside_null"), big(F.size(kept)).alias("kept"))


@query("SELECT user_id, sum(CASE WHEN value > 66 THEN 1 WHEN value > 33 THEN 2 ELSE 3 END)::BIGINT AS s FROM events GROUP BY 1")
def iterate_three_maps(spark, sf_dir):
    v = F.col("value")
    counts = t(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count_if(v > 66).alias("a"), F.count_if((v <= 66) & (v > 33)).alias("b"), F.count_if(v <= 33).alias("c"))
    maps = counts.groupBy("user_id").agg(*[F.map_from_entries(F.collect_list(F.when(F.col(c) > 0, F.struct("event_type", c)))).alias(c) for c in "abc"])
    n = lambda x: F.coalesce(x, F.lit(0))
    sums = A.iterate_maps(lambda k, a, b, c: n(a) + 2 * n(b) + 3 * n(c), *[F.when(F.size(c) > 0, F.col(c)) for c in "abc"])
    return maps.select("user_id", A.reduce(A.values(sums), lambda a, b: a + b).alias("s"))


@query("WITH a AS (SELECT user_id, list(DISTINCT event_type) AS v FROM events WHERE value > 90 GROUP BY 1), b AS (SELECT user_id, list(DISTINCT event_type) AS v FROM events WHERE value < 10 GROUP BY 1) SELECT user_id, len(list_distinct(list_concat(coalesce(a.v, []), coalesce(b.v, []))))::BIGINT AS n_union, CASE WHEN a.v IS NULL THEN NULL ELSE len(list_filter(a.v, lambda x: NOT list_contains(coalesce(b.v, []), x))) END::BIGINT AS n_diff FROM a FULL OUTER JOIN b USING (user_id)")
def union_and_diff_of_null(spark, sf_dir):
    ev = t(spark, sf_dir, "events")
    a, b = (ev.where(p).groupBy("user_id").agg(F.collect_set("event_type").alias(n)) for p, n in (("value > 90", "a"), ("value < 10", "b")))
    met = a.join(b, "user_id", "full_outer")
    return met.select("user_id", big(F.size(A.union(F.col("a"), F.col("b")))).alias("n_union"), big(F.when(F.col("a").isNotNull(), F.size(A.diff(F.col("a"), F.col("b"))))).alias("n_diff"))


@query("SELECT c_custkey AS id, CASE WHEN c_acctbal < 0 THEN 'c_custkey,c_name' ELSE 'c_custkey,c_mktsegment,c_name' END AS names, c_custkey || CASE WHEN c_acctbal < 0 THEN '' ELSE '|' || c_mktsegment END || '|' || c_name AS vals, c_name AS left_name, (1 + (c_acctbal >= 0)::INT)::BIGINT AS n_texts FROM customer")
def struct_forms(spark, sf_dir):
    df = t(spark, sf_dir, "customer").select("c_custkey", F.struct("c_custkey", "c_name", F.when(F.col("c_acctbal") < 0, "").otherwise(F.col("c_mktsegment")).alias("c_mktsegment")).alias("s"))
    s, kind = F.col("s"), df.schema["s"].dataType
    texts = A.where_fields(s, lambda k, v: k != "c_custkey", kind)
    return df.select(F.col("c_custkey").alias("id"), X.str_join(",", A.fields(s, kind)).alias("names"), X.str_join("|", A.values(s, kind)).alias("vals"), A.unset(s, "c_custkey", kind)["c_name"].alias("left_name"), big(F.size(texts)).alias("n_texts"))


@query("SELECT n_regionkey AS id, count(*) AS n, count(DISTINCT c_mktsegment) AS n_segments FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY 1")
def wildcard_of_wildcard(spark, sf_dir):
    c = t(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.collect_list("c_mktsegment").alias("segments"))
    docs = t(spark, sf_dir, "nation").join(c, F.col("c_nationkey") == F.col("n_nationkey"), "left").groupBy("n_regionkey").agg(F.collect_list(F.struct("n_name", "segments")).alias("nations"))
    flat = A.wildcard(F.col("nations"), lambda x: x["segments"], flat=True)
    return docs.select(F.col("n_regionkey").alias("id"), big(F.size(flat)).alias("n"), big(F.size(A.unique(flat))).alias("n_segments"))


@query("SELECT n_regionkey AS id, count(DISTINCT n_nationkey % 3) AS n_unique, count(DISTINCT n_nationkey % 4) AS n_union_by, min(n_nationkey)::BIGINT AS first, 0::BIGINT AS none FROM nation GROUP BY 1")
def unique_numbers(spark, sf_dir):
    docs = dataset.group_by(t(spark, sf_dir, "nation"), F.col("n_regionkey"), F.col("n_nationkey"), F.col("n_nationkey"))
    e = F.col("elements")
    both = A.union_by_field(e, A.wildcard(e, lambda x: x + 4), lambda x: x % 4)
    none = A.where(F.lit(None).cast("array<int>"), lambda x: x > 0)
    return docs.select(F.col("key").alias("id"), big(F.size(A.unique(A.wildcard(e, lambda x: x % 3)))).alias("n_unique"), big(F.size(both)).alias("n_union_by"), big(F.get(A.sort_by(e, lambda x: x), 0)).alias("first"), big(A.list_len(none)).alias("none"))


@query("WITH a AS (SELECT n_regionkey AS r, n_nationkey AS x, row_number() OVER (PARTITION BY n_regionkey, n_nationkey % 3 ORDER BY n_nationkey) AS at FROM nation), b AS (SELECT (n_regionkey + 1) % 5 AS r, n_nationkey AS y, row_number() OVER (PARTITION BY n_regionkey, n_nationkey % 3 ORDER BY n_nationkey) AS at FROM nation) SELECT coalesce(a.r, b.r)::BIGINT AS id, x, y FROM a FULL OUTER JOIN b ON a.r = b.r AND x % 3 = y % 3 AND a.at = b.at")
def join_arrays_by_predicate(spark, sf_dir):
    docs = dataset.group_by(t(spark, sf_dir, "nation"), F.col("n_regionkey"), F.col("n_nationkey"), F.col("n_nationkey"))
    other = docs.select(((F.col("key") + 1) % 5).alias("k2"), F.col("elements").alias("right"))
    pairs = A.join_one_to_one(F.col("elements"), F.col("right"), lambda x, y: x % 3 == y % 3, "int")
    return docs.join(other, F.col("key") == F.col("k2")).select(big("key").alias("id"), F.explode(pairs).alias("p")).select("id", F.col("p.l").alias("x"), F.col("p.r").alias("y"))


# Merging and writes


@query("SELECT c_custkey AS id, c_custkey || ',' || c_nationkey AS k, 2::BIGINT AS n, CASE WHEN c_nationkey % 2 = 0 THEN 'x' ELSE c_name || ',x' END AS appended, CASE WHEN c_nationkey % 2 = 0 THEN 'y' WHEN c_nationkey % 3 = 0 THEN c_name ELSE c_name || ',y' END AS extended, CASE WHEN c_nationkey % 3 = 0 THEN NULL ELSE 'y' END AS replaced FROM customer")
def merge_maps_and_nulls(spark, sf_dir):
    k = F.col("c_nationkey")
    old, new = F.create_map(F.lit("k"), F.array("c_custkey")), F.create_map(F.lit("k"), F.array(k.cast("bigint")), F.lit("n"), F.array(F.lit(1).cast("bigint")))
    df = t(spark, sf_dir, "customer").select("c_custkey", old.alias("old"), new.alias("new"), F.when(k % 2 != 0, F.array("c_name")).alias("arr"), F.when((k % 3 != 0) | (k % 2 == 0), F.array(F.lit("y"))).alias("more"), F.when(k % 3 != 0, "y").alias("one"))
    of = lambda c: df.schema[c].dataType
    m = merge.merged(F.col("old"), F.col("new"), of("old"), of("new"))
    appended = merge.written(F.col("arr"), F.lit("x"), of("arr"), T.StringType(), merge.APPEND)
    extended = merge.written(F.col("arr"), F.col("more"), of("arr"), of("more"), merge.EXTEND)
    replaced = merge.written(F.lit("old"), F.col("one"), T.StringType(), T.StringType(), merge.REPLACE)
    return df.select(F.col("c_custkey").alias("id"), X.str_join(",", m["k"]).alias("k"), big(F.size(m)).alias("n"), X.str_join(",", appended).alias("appended"), X.str_join(",", extended).alias("extended"), replaced.alias("replaced"))


@query("SELECT c_custkey AS id, c_name AS at_1, CASE WHEN c_acctbal < 0 THEN 'debt' END AS at_0, 2::BIGINT AS n, c_mktsegment || ',' || c_nationkey AS tags, CASE WHEN c_acctbal < 0 THEN 'debt' ELSE 'fine' END AS state, 'v' || c_nationkey AS in_map FROM customer")
def write_at_paths(spark, sf_dir):
    df = t(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment", "c_nationkey", F.when(F.col("c_acctbal") < 0, "debt").alias("debt"), F.create_map(F.lit("a"), F.lit("b")).alias("m"))
    text = T.StringType()
    root, kind = F.struct(F.col("c_custkey").alias("id"), F.struct(F.lit("fine").alias("state"), "m").alias("info")), df.select(F.struct(F.col("c_custkey").alias("id"), F.struct(F.lit("fine").alias("state"), "m").alias("info")).alias("r")).schema["r"].dataType
    for path, value in (("info.names[1].value", F.col("c_name")), ("info.names[0].value", F.col("debt")), ("info.tags[]", F.col("c_mktsegment")), ("info.tags[]", F.col("c_nationkey").cast("string")), ("info.state", F.col("debt")), ("info.m.k", F.concat(F.lit("v"), "c_nationkey"))):
        root, kind = merge.write_at(root, kind, path, value, text)
    done = df.select(root.alias("r"))
    return done.select("r.id", F.get("r.info.names", 1)["value"].alias("at_1"), F.get("r.info.names", 0)["value"].alias("at_0"), big(F.size("r.info.names")).alias("n"), X.str_join(",", F.col("r.info.tags")).alias("tags"), "r.info.state", F.try_element_at("r.info.m", F.lit("k")).alias("in_map"))


@query("SELECT event_id AS id, '{\"a\":[' || user_id || ',1],\"k\":' || (props->>'$.k') || CASE WHEN user_id % 2 = 0 THEN ',\"s\":\"x\"' ELSE ',\"s\":\"y\"' END || '}' AS j FROM events")
def merge_json_texts(spark, sf_dir):
    schema = T.StructType.fromDDL("a array<bigint>, k bigint, s string")
    old = F.concat(F.lit('{"a":['), "user_id", F.lit('],"k":0,"s":"y"}'))
    new = F.concat(F.lit('{"a":[1],"s":"'), F.when(F.col("user_id") % 2 == 0, "x").otherwise(""), F.lit('","k":'), X.json_path(F.col("props"), "k"), F.lit("}"))
    return t(spark, sf_dir, "events").select(F.col("event_id").alias("id"), X.merge_json(old, new, schema).alias("j"))


# Text


@query("SELECT p_partkey AS id, length(p_brand)::BIGINT AS n_chars, array_to_string(list_filter(list_transform(string_split(p_type, ' '), lambda x: trim(x)), lambda x: x <> ''), '-') AS parts, regexp_matches(p_name, '[0-9]5') AS has_five, p_size || ',' || p_size || '.5' AS nums, '{\"b\":1,\"c\":' || p_size || '}' AS sorted, p_brand AS dotted, CASE WHEN p_size % 2 = 0 THEN NULL ELSE p_brand END AS trimmed, 'll' AS doubled FROM part")
def text_functions(spark, sf_dir):
    n = F.col("p_size")
    s = F.struct(n.alias("c"), F.lit(1).alias("b"))
    kind = T.StructType.fromDDL("c int, b int")
    doc = F.to_json(F.create_map(F.lit("a.b"), F.col("p_brand")))
    doubled = X.extract_all(F.lit("hello"), r"(.)\1", 1, lambda g: g[0])
    return t(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), big(F.size(X.split(F.col("p_brand")))).alias("n_chars"), X.str_join_present("-", X.split_trimmed(F.col("p_type"), " ")).alias("parts"), X.contains_regex(F.col("p_name"), "[0-9]5").alias("has_five"), X.str_join(",", F.array(n.cast("double"), n + F.lit(0.5).cast("double"))).alias("nums"), X.serialize_json(s, kind).alias("sorted"), X.json_path(doc, "a.b").alias("dotted"), X.trimmed(F.when(n % 2 == 0, "  ").otherwise(F.concat(F.lit(" "), "p_brand"))).alias("trimmed"), X.str_join("", doubled).alias("doubled"))


# Times


@query("SELECT event_id AS id, strftime(ts, '%Y-%m-%dT%H:%M:%S.') || lpad(((epoch_us(ts) // 1000) % 1000)::VARCHAR, 3, '0') || 'Z' AS iso, strftime(ts + INTERVAL 9 HOUR, '%d %H:%M') AS tokyo, strftime(to_timestamp(event_id) AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%S.000Z') AS secs, strftime(to_timestamp(event_id) AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%S.000Z') AS nanos, (hour(ts) * 60 + minute(ts))::BIGINT AS minutes, strftime(ts, '%Y-%m-%dT00:00:00.000Z') AS day, strftime(ts, '%Y-%m-01T00:00:00.000Z') AS month, strftime(ts - INTERVAL 2 HOUR, '%Y-%m-%dT%H:%M:00.000Z') AS zoned, '2024' AS now FROM events")
def times_of_events(spark, sf_dir):
    ts, n = F.col("ts"), F.col("event_id")
    ms = D.to_millis(ts)
    parts = D.split_time(ts)
    zoned = F.concat(D.format_date_time(ts, "yyyy-MM-dd HH:mm"), F.lit(" +0200"))
    month = D.parse_date_time(D.format_date_time(ts, "yyyy/MM"), "yyyy/MM[/dd]")
    return t(spark, sf_dir, "events").select(n.alias("id"), D.from_millis(ms).alias("iso"), D.format_date_time(ts, "dd HH:mm", "Asia/Tokyo").alias("tokyo"), D.parse_unix_time(n, "s").alias("secs"), D.parse_unix_time(n * 1_000_000_000, "ns").alias("nanos"), (F.get(parts, 3) * 60 + F.get(parts, 4)).alias("minutes"), D.parse_date_time(D.format_date_time(ts, "dd.MM.yyyy"), "yyyy-MM-dd", "dd.MM.yyyy").alias("day"), month.alias("month"), D.parse_date_time(zoned, "yyyy-MM-dd HH:mm Z").alias("zoned"), D.current_time("yyyy", at=ts).alias("now"))


# Lookups

_TWO = [{"id": "two", "version": "2", "group": [{"source": "tpc", "target": "t1", "element": [{"code": "1-URGENT", "target": [{"code": "Z"}, {"code": "A"}]}], "unmapped": {"mode": "provided"}}, {"source": "other", "target": "t2", "element": [{"code": "1-URGENT", "target": [{"code": "M"}]}, {"code": "2-HIGH", "target": [{"code": "H"}]}]}]}, {"id": "two", "group": []}]


@query("SELECT o_orderkey AS id, CASE o_orderpriority WHEN '1-URGENT' THEN 'Z@t1,A@t1,M@t2' WHEN '2-HIGH' THEN 'H@t2' ELSE o_orderpriority || '@t1' END AS any_system, CASE o_orderpriority WHEN '1-URGENT' THEN 'Z@t1,A@t1' ELSE o_orderpriority || '@t1' END AS by_system, CASE o_orderpriority WHEN '1-URGENT' THEN 'M@t2' WHEN '2-HIGH' THEN 'H@t2' ELSE o_orderpriority || '@two-unharmonized' END AS by_target FROM orders")
def harmonize_groups(spark, sf_dir):
    maps, code = terminology.load_concept_maps(json.dumps(_TWO)), F.col("o_orderpriority")
    done = terminology.harmonize(t(spark, sf_dir, "orders"), maps, "two", code, None, out="a")
    done = terminology.harmonize(done, maps, "two", code, F.lit("tpc"), out="b")
    done = terminology.harmonize(done, maps, "two", code, F.lit("other"), "t2", out="c")
    shown = lambda c: X.str_join(",", F.transform(c, lambda x: F.concat(x["code"], F.lit("@"), x["system"])))
    return done.select(F.col("o_orderkey").alias("id"), shown("a").alias("any_system"), shown("b").alias("by_system"), shown("c").alias("by_target"))


_SPECIFIC = [{"source_unit": ["A"], "dest_unit": "kg", "scalar": 2.0}, {"source_unit": ["A"], "code": "x", "codesystem": "s", "dest_unit": "g", "scalar": 3.0}, {"source_unit": ["A"], "code": "x", "codesystem": "s", "dest_unit": "never"}]


@query("SELECT l_returnflag AS flag, l_linestatus AS status, count(*) AS n, sum(l_quantity * CASE WHEN l_returnflag = 'A' AND l_linestatus = 'F' THEN 3 WHEN l_returnflag = 'A' THEN 2 ELSE 1 END) AS total, min(CASE WHEN l_returnflag = 'A' AND l_linestatus = 'F' THEN 'g' WHEN l_returnflag = 'A' THEN 'kg' ELSE l_returnflag END) AS unit FROM lineitem GROUP BY 1, 2")
def harmonize_unit_by_code(spark, sf_dir):
    coded = F.col("l_linestatus") == "F"
    done = terminology.harmonize_unit(t(spark, sf_dir, "lineitem"), _SPECIFIC, F.col("l_quantity"), F.col("l_returnflag"), F.when(coded, "x"), F.when(coded, "s"), 2)
    return done.groupBy(F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status")).agg(F.count("*").alias("n"), F.sum("si_value").alias("total"), F.min("si_unit").alias("unit"))


# Linkage and snapshots


def _people(spark, sf_dir):
    """Customers as records with identifiers, codings, references and tags."""
    text = lambda c: F.col(c).cast("string")
    pair = lambda a, x, b, y: F.struct(x.alias(a), y.alias(b))
    ids = F.array(pair("system", F.lit("S"), "value", text("c_custkey")), pair("system", F.lit("N"), "value", F.when(F.col("c_nationkey") % 2 == 0, text("c_nationkey"))))
    coding = F.array(pair("system", F.lit("seg"), "code", F.col("c_mktsegment")))
    meta = F.struct(F.array(pair("system", F.lit("tag"), "code", text("c_nationkey"))).alias("tag"), F.array(pair("url", F.lit("u"), "valueString", F.col("c_name"))).alias("extension"))
    ref = F.struct(linkage.build_reference(F.lit("Nation"), F.col("c_nationkey")).alias("reference"), F.lit("Nation").alias("type"), F.struct(F.lit("S").alias("system"), text("c_nationkey").alias("value")).alias("identifier"))
    record = F.struct(ids.alias("identifier"), coding.alias("coding"), meta.alias("meta"), ref.alias("nation"), F.array("c_name", "c_mktsegment").alias("given"))
    return t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), record.alias("r"))


_NAMED = {
    "any_identifier": linkage.any_identifier(),
    "filtered": linkage.any_identifier(linkage.filter_value("system", "N")),
    "any_coding": linkage.any_coding(),
    "reference": linkage.reference_for("nation"),
    "identifier_reference": linkage.identifier_reference_for("nation"),
    "tag": linkage.any_meta_tag(linkage.filter_value("system", "tag")),
    "extension": linkage.any_meta_extension(),
    "any_of": linkage.any_of("nation", linkage.primitive("type"), linkage.primitive("reference")),
    "array_any_of": linkage.array_any_of("identifier", linkage.primitive("value")),
    "path": linkage.path_to("nation", linkage.path_to("identifier", linkage.primitive("value"))),
    "config": linkage.criteria_from({"field": "identifier", "fieldType": "array", "pathOperator": "OR", "paths": [{"fieldType": "container", "pathOperator": "AND", "paths": [{"field": "system", "fieldType": "primitive", "fieldFilter": ["S"]}, {"field": "value", "fieldType": "primitive"}]}]}),
    "elements": linkage.criteria_from({"field": "given", "fieldType": "array", "paths": [{"fieldType": "primitive"}]}),
}

_SAID = {
    "any_identifier": ["'identifier=system=S|value=' || c_custkey", "CASE WHEN c_nationkey % 2 = 0 THEN 'identifier=system=N|value=' || c_nationkey END"],
    "filtered": ["CASE WHEN c_nationkey % 2 = 0 THEN 'identifier=system=N|value=' || c_nationkey END"],
    "any_coding": ["'coding=code=' || c_mktsegment || '|system=seg'"],
    "reference": ["'nation=reference=Nation/' || c_nationkey"],
    "identifier_reference": ["'nation=identifier=system=S|value=' || c_nationkey || '|type=Nation'"],
    "tag": ["'meta=tag=code=' || c_nationkey || '|system=tag'"],
    "extension": ["'meta=extension=url=u|valueString=' || c_name"],
    "any_of": ["'nation=type=Nation'", "'nation=reference=Nation/' || c_nationkey"],
    "array_any_of": ["'identifier=value=' || c_custkey", "CASE WHEN c_nationkey % 2 = 0 AND c_nationkey <> c_custkey THEN 'identifier=value=' || c_nationkey END"],
    "path": ["'nation=identifier=value=' || c_nationkey"],
    "config": ["'identifier=system=S|value=' || c_custkey"],
    "elements": ["'given=' || c_name", "'given=' || c_mktsegment"],
}


@query("SELECT * FROM (" + " UNION ALL ".join(f"SELECT c_custkey AS id, '{k}' AS criteria, {e} AS v FROM customer" for k, es in _SAID.items() for e in es) + ") WHERE v IS NOT NULL")
def criteria_values(spark, sf_dir):
    people = _people(spark, sf_dir)
    for c in _NAMED.values():
        linkage.check_criteria(c, people.schema["r"].dataType)
    each = F.array(*[F.struct(F.lit(k).alias("criteria"), linkage.property_values(c, F.col("r")).alias("vs")) for k, c in _NAMED.items()])
    return people.select("id", F.explode(each).alias("e")).select("id", "e.criteria", F.explode("e.vs").alias("v"))


@query("WITH m AS (SELECT c_nationkey, c_mktsegment, min(c_name) AS g FROM customer GROUP BY 1, 2) SELECT c_name, g AS \"group\" FROM customer JOIN m USING (c_nationkey, c_mktsegment)")
def link_records_by_name(spark, sf_dir):
    keyed = t(spark, sf_dir, "customer").select("c_name", F.array(F.concat_ws("/", "c_nationkey", "c_mktsegment")).alias("values"))
    return linkage.link_records(keyed, "c_name", "values")


@query("WITH e AS (SELECT *, CASE WHEN value >= 50 THEN value END AS v FROM events), r AS (SELECT event_type, user_id, last(v ORDER BY ts, event_id) AS forced, arg_max(v, (ts, event_id)) FILTER (v IS NOT NULL) AS preferred, arg_max(props, (ts, event_id)) AS props FROM e GROUP BY 1, 2) SELECT event_type, user_id, CASE WHEN event_type IN ('purchase', 'error') THEN forced ELSE preferred END AS v, props FROM r")
def snapshots_by_type(spark, sf_dir):
    ev = t(spark, sf_dir, "events").select("event_type", "user_id", "ts", "event_id", F.when(F.col("value") >= 50, F.col("value")).alias("v"), "props")
    rules = {"purchase": {"v": reconcile.FORCE}}
    return reconcile.merge_by_type(ev, "event_type", ["user_id"], ["ts", "event_id"], rules, {"v": reconcile.PREFER}, {"error": "latest"}).select("event_type", "user_id", "v", "props")


@query("SELECT c_custkey AS id, CASE WHEN c_acctbal < 0 THEN NULL ELSE c_name END AS a, CASE WHEN c_acctbal < 0 THEN c_nationkey END AS b, c_mktsegment AS c, CASE WHEN c_nationkey % 2 = 0 THEN 1 END::BIGINT AS n_tags FROM customer")
def choice_fields(spark, sf_dir):
    k = F.col("c_nationkey")
    old = F.struct(F.col("c_name").alias("a"), F.lit(None).cast("int").alias("b"), F.col("c_mktsegment").alias("c"))
    new = F.struct(F.lit(None).cast("string").alias("a"), F.when(F.col("c_acctbal") < 0, k).alias("b"), F.lit("x").alias("c"))
    df = t(spark, sf_dir, "customer").select("c_custkey", old.alias("old"), new.alias("new"), F.array(F.struct(F.lit("keep").alias("code")), F.struct(F.lit("drop").alias("code"))).alias("tags"), k.alias("k"))
    done = reconcile.choice_written(reconcile.prefer_inbound, F.col("old"), F.col("new"), df.schema["old"].dataType, "a", "b")
    left = reconcile.without_tags(F.col("tags"), "code", "drop")
    left = F.when(F.col("k") % 2 == 0, left).otherwise(reconcile.without_tags(F.col("tags"), "code", "drop", "keep"))
    return df.select(F.col("c_custkey").alias("id"), done.alias("m"), big(F.size(left)).alias("n_tags")).select("id", "m.a", "m.b", "m.c", "n_tags")


# Sources, tables and streams


@query("SELECT n_nationkey, n_name, CASE WHEN n_regionkey > 0 THEN n_regionkey END AS region, true AS there FROM nation")
def json_files(spark, sf_dir):
    path = f"{shared_dir(spark)}/json-{uuid.uuid4().hex}"
    root = F.struct("n_nationkey", "n_name", F.when(F.col("n_regionkey") > 0, F.col("n_regionkey")).alias("region"))
    documents.write_documents(t(spark, sf_dir, "nation").select(root.alias("root")), path)
    there = documents.file_exists(spark, path) and documents.list_files(spark, path, "part-*").count() > 0
    return documents.read_json_lines(spark, path, "n_nationkey int, n_name string, region int").withColumn("there", F.lit(there))


@query("SELECT n_nationkey, CASE n_regionkey WHEN 0 THEN 'south' WHEN 1 THEN 'west' END AS side FROM nation")
def json_literal(spark, sf_dir):
    sides = documents.from_literal(spark, '[{"r": 0, "side": "south"}, {"r": 1, "side": "west"}]', "r int, side string")
    return t(spark, sf_dir, "nation").join(F.broadcast(sides), F.col("n_regionkey") == F.col("r"), "left").select("n_nationkey", "side")


@query("SELECT page_id, string_split(url, '/')[-1] AS name, '/data/maps/x.json' AS joined, '/data/y.json' AS absolute FROM pages")
def path_functions(spark, sf_dir):
    return t(spark, sf_dir, "pages").select("page_id", documents.file_name(F.col("url")).alias("name"), F.lit(documents.join_path("/data", "lists/../maps", "x.json")).alias("joined"), F.lit(documents.abs_path("/data/main.map", "y.json")).alias("absolute"))


@query("SELECT event_id AS id, CASE WHEN value > 50 THEN event_type END AS big, CASE WHEN user_id % 2 = 0 THEN user_id END AS even FROM events WHERE value > 50 OR user_id % 2 = 0")
def iterate_rows(spark, sf_dir):
    ev = t(spark, sf_dir, "events")
    done = dataset.iterate(ev, big=F.when(F.col("value") > 50, F.col("event_type")), even=F.when(F.col("user_id") % 2 == 0, F.col("user_id")), id=F.when((F.col("value") > 50) | (F.col("user_id") % 2 == 0), F.col("event_id")))
    return done.select("id", "big", "even")


@query("SELECT event_id AS id, (props->>'$.k')::BIGINT AS k FROM events WHERE value > 50")
def stream_mapping(spark, sf_dir):
    folder = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    t(spark, sf_dir, "events").write.parquet(f"{folder}/in")
    source = streams.read_stream(spark, f"{folder}/in", t(spark, sf_dir, "events").schema)
    mapped = lambda df: df.where("value > 50").select(F.col("event_id").alias("id"), X.json_path(F.col("props"), "k", to="bigint").alias("k"))
    streams.run_mapping(source, mapped, f"{folder}/out", f"{folder}/state").awaitTermination()
    return spark.read.parquet(f"{folder}/out")


@query("SELECT date_trunc('day', ts)::TIMESTAMP AS day, user_id, arg_max(event_id, (ts, event_id)) AS last_id, count(*) AS n FROM events GROUP BY 1, 2")
def latest_by_day(spark, sf_dir):
    ev = t(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("at"), "user_id", F.struct("ts", "event_id").alias("e"))
    done = streams.latest_by_window(ev, "at", "user_id", "e", order="e")
    return done.select(F.col("window_start").cast("timestamp_ntz").alias("day"), "user_id", F.col("e.event_id").alias("last_id"), "n")
