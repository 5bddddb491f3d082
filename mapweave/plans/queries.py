"""The queries of the mapping operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..functions import scalars as S
from ..functions import text as X
from ..functions import times as D
from ..operators import dataset, linkage, merge, reconcile, terminology

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

big = lambda c: (F.col(c) if isinstance(c, str) else c).cast("bigint")


def query(sql: str | None = None):
    """Registers a query under its function's name."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return put


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def order_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document for each order: its key and its lines, sorted."""
    lines = t(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", "l_discount", "l_returnflag"))).alias("lines"))
    return t(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority").join(lines, F.col("o_orderkey") == F.col("l_orderkey")).drop("l_orderkey")


# Paths, construction and folds in documents


@query("SELECT l_orderkey AS id, count(*) FILTER (l_quantity > 30) AS n_big, round(sum(l_extendedprice), 2) AS revenue FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1")
def order_documents(spark, sf_dir):
    docs = order_docs(spark, sf_dir)
    big_lines = A.where(F.col("lines"), lambda x: x["l_quantity"] > 30)
    revenue = A.reduce(A.wildcard(F.col("lines"), lambda x: x["l_extendedprice"]), lambda acc, cur: acc + cur)
    return docs.select(F.col("o_orderkey").alias("id"), big(A.list_len(big_lines)).alias("n_big"), F.round(revenue, 2).alias("revenue"))


@query("SELECT l_orderkey AS id, count(*) AS n, sum(l_quantity) AS q FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_quantity > 30 GROUP BY 1")
def where_array(spark, sf_dir):
    kept = order_docs(spark, sf_dir).select(F.col("o_orderkey").alias("id"), A.where(F.col("lines"), lambda x: x["l_quantity"] > 30).alias("kept"))
    return kept.where(F.size("kept") > 0).select("id", big(A.list_len(F.col("kept"))).alias("n"), A.reduce(A.wildcard(F.col("kept"), lambda x: x["l_quantity"]), S.add, F.lit(0.0)).alias("q"))


@query("SELECT l_orderkey AS id, string_agg(l_returnflag, ',' ORDER BY l_linenumber, l_partkey, l_quantity, l_extendedprice, l_discount, l_returnflag) AS flags FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1")
def wildcard_path(spark, sf_dir):
    return order_docs(spark, sf_dir).select(F.col("o_orderkey").alias("id"), X.str_join(",", A.wildcard(F.col("lines"), lambda x: x["l_returnflag"])).alias("flags"))


@query("SELECT l_orderkey AS id, min(l_linenumber)::BIGINT AS first_line, max(l_linenumber)::BIGINT AS last_line FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1")
def index_and_last(spark, sf_dir):
    lines = F.col("lines")
    return order_docs(spark, sf_dir).select(F.col("o_orderkey").alias("id"), big(F.get(lines, 0)["l_linenumber"]).alias("first_line"), big(A.last(lines)["l_linenumber"]).alias("last_line"))


@query("SELECT l_orderkey AS id, max(l_extendedprice) AS dearest, min(l_extendedprice) AS cheapest FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1")
def sort_by_array(spark, sf_dir):
    price = lambda x: x["l_extendedprice"]
    return order_docs(spark, sf_dir).select(F.col("o_orderkey").alias("id"), F.get(A.sort_by_desc(F.col("lines"), price), 0)["l_extendedprice"].alias("dearest"), F.get(A.sort_by(F.col("lines"), price), 0)["l_extendedprice"].alias("cheapest"))


@query("SELECT l_orderkey AS id, count(DISTINCT l_returnflag) AS n_flags FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1")
def unique_array(spark, sf_dir):
    return order_docs(spark, sf_dir).select(F.col("o_orderkey").alias("id"), big(F.size(A.unique(A.wildcard(F.col("lines"), lambda x: x["l_returnflag"])))).alias("n_flags"))


@query("SELECT id, string_agg(l_returnflag || ':' || n, ',' ORDER BY l_returnflag) AS g FROM (SELECT l_orderkey AS id, l_returnflag, count(*) AS n FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1, 2) GROUP BY 1")
def group_by_array(spark, sf_dir):
    groups = A.group_by(F.col("lines"), lambda x: x["l_returnflag"])
    shown = F.array_sort(F.transform(groups, lambda g: F.concat(g["key"], F.lit(":"), F.size(g["elements"]).cast("string"))))
    return order_docs(spark, sf_dir).select(F.col("o_orderkey").alias("id"), X.str_join(",", shown).alias("g"))


@query("SELECT l_orderkey AS id, round(sum(l_quantity * l_discount), 4) AS weighed FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1")
def iterate_zip(spark, sf_dir):
    q, d = (A.wildcard(F.col("lines"), lambda x, k=k: x[k]) for k in ("l_quantity", "l_discount"))
    return order_docs(spark, sf_dir).select(F.col("o_orderkey").alias("id"), F.round(A.reduce(A.iterate(S.mul, q, d), S.add, F.lit(0.0)), 4).alias("weighed"))


@query("SELECT o_orderkey AS id, max(CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0 END)::BIGINT AS a, o_orderpriority AS p, (2 + (o_orderpriority = '1-URGENT')::INT)::BIGINT AS n_fields FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey, o_orderpriority")
def merge_modes(spark, sf_dir):
    flags = A.wildcard(F.col("lines"), lambda x: x["l_returnflag"])
    base = F.create_map(F.lit("p"), F.col("o_orderpriority"), F.lit("a"), F.when(F.array_contains(flags, "A"), "1").otherwise("0"))
    docs = order_docs(spark, sf_dir).select("o_orderkey", base.alias("base"), F.when(F.col("o_orderpriority") == "1-URGENT", F.create_map(F.lit("u"), F.lit("1"), F.lit("p"), F.lit(""))).alias("more"))
    kinds = [docs.schema[c].dataType for c in ("base", "more")]
    done = docs.withColumn("m", merge.written(F.col("base"), F.col("more"), *kinds))
    return done.select(F.col("o_orderkey").alias("id"), big(F.col("m")["a"]).alias("a"), F.col("m")["p"].alias("p"), big(F.size("m")).alias("n_fields"))


@query("SELECT c_custkey AS id, c_name AS name, n_name AS nation, CASE WHEN c_acctbal < 0 THEN 'debt' ELSE c_mktsegment END AS segment FROM customer JOIN nation ON n_nationkey = c_nationkey")
def merge_deep(spark, sf_dir):
    df = t(spark, sf_dir, "customer").join(t(spark, sf_dir, "nation"), F.col("n_nationkey") == F.col("c_nationkey"))
    old = F.struct(F.col("c_custkey").alias("id"), F.struct(F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment")).alias("info"))
    new = F.struct(F.struct(F.when(F.col("c_acctbal") < 0, "debt").alias("segment"), F.col("n_name").alias("nation")).alias("info"))
    df = df.select(old.alias("old"), new.alias("new"))
    m = df.select(merge.merged(F.col("old"), F.col("new"), df.schema["old"].dataType, df.schema["new"].dataType).alias("m"))
    return m.select("m.id", "m.info.name", "m.info.nation", "m.info.segment")


@query("SELECT c_custkey AS id, (CASE WHEN c_nationkey % 2 = 0 THEN 'x' END) AS s2, 4::BIGINT AS n FROM customer")
def merge_fixed_slot(spark, sf_dir):
    arr = merge.merged_at(F.array(F.lit("a")), F.when(F.col("c_nationkey") % 2 == 0, "x"), 3)
    return t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.get(arr, 3).alias("s2"), big(F.size(arr)).alias("n"))


@query("SELECT user_id, sum(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END)::BIGINT AS clicks, count(DISTINCT event_type) AS kinds FROM events GROUP BY 1")
def fields_values_unset(spark, sf_dir):
    counts = t(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n")).groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "n"))).alias("m"))
    clicks = F.coalesce(F.try_element_at("m", F.lit("click")), F.lit(0))
    kinds = F.size(A.values(A.unset(F.col("m"), "click"))) + A.where_fields(F.col("m"), lambda k, v: k == "click").isNotNull().cast("int") * F.size(A.fields(A.where_fields(F.col("m"), lambda k, v: k == "click")))
    return counts.select("user_id", big(clicks).alias("clicks"), big(kinds).alias("kinds"))


@query("WITH a AS (SELECT user_id, event_type, count(*) AS n FROM events WHERE value > 50 GROUP BY 1, 2), b AS (SELECT user_id, event_type, count(*) AS n FROM events WHERE value <= 50 GROUP BY 1, 2) SELECT user_id, sum(abs(coalesce(a.n, 0) - coalesce(b.n, 0)))::BIGINT AS gap FROM a FULL OUTER JOIN b USING (user_id, event_type) GROUP BY 1")
def iterate_container(spark, sf_dir):
    ev = t(spark, sf_dir, "events")
    maps = ev.groupBy("user_id", "event_type").agg(F.count_if(F.col("value") > 50).alias("h"), F.count_if(F.col("value") <= 50).alias("l")).groupBy("user_id").agg(*[F.map_from_entries(F.collect_list(F.when(F.col(c) > 0, F.struct("event_type", c)))).alias(c) for c in ("h", "l")])
    gaps = A.iterate_maps(lambda k, a, b: F.abs(F.coalesce(a, F.lit(0)) - F.coalesce(b, F.lit(0))), F.col("h"), F.col("l"))
    return maps.select("user_id", A.reduce(A.values(gaps), lambda a, b: a + b).alias("gap"))


@query("SELECT user_id, event_type AS k, value AS v FROM events")
def unnest_arrays(spark, sf_dir):
    m = t(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.collect_list("value").alias("vs")).groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "vs"))).alias("m"))
    return m.select("user_id", F.explode(A.unnest_arrays(F.col("m"))).alias("e")).select("user_id", "e.k", "e.v")


@query("SELECT user_id, min(event_type) AS low, max(event_type) AS high, count(DISTINCT event_type) AS n FROM events GROUP BY 1")
def v1_arrays(spark, sf_dir):
    kinds = t(spark, sf_dir, "events").groupBy("user_id").agg(F.collect_set("event_type").alias("a"))
    nested = A.flatten(F.array(A.list_cat(F.col("a"), F.col("a"))))
    return kinds.select("user_id", A.sort_and_take_top(F.col("a"), lambda x: x).alias("low"), A.sort_and_take_top(F.col("a"), lambda x: x, True).alias("high"), big(F.size(A.unique_by(nested, lambda x: x))).alias("n"))


# Verbs over tables


@query("SELECT l_orderkey, l_partkey, l_quantity FROM lineitem WHERE l_quantity > 45 AND l_shipdate < TIMESTAMP '1996-01-01'")
def where_rows(spark, sf_dir):
    return dataset.where(t(spark, sf_dir, "lineitem"), (F.col("l_quantity") > 45) & (F.col("l_shipdate") < F.lit("1996-01-01").cast("timestamp_ntz"))).select("l_orderkey", "l_partkey", "l_quantity")


@query("SELECT o_orderpriority AS key, count(*) AS n, count(DISTINCT o_custkey) AS customers FROM orders GROUP BY 1")
def group_by_elements(spark, sf_dir):
    return dataset.fold(t(spark, sf_dir, "orders").withColumnRenamed("o_orderpriority", "key"), ["key"], n=F.count("*"), customers=F.countDistinct("o_custkey"))


@query("SELECT n_regionkey::BIGINT AS r, string_agg(n_name, ';' ORDER BY n_name) AS names FROM nation GROUP BY 1")
def reduce_seed_concat(spark, sf_dir):
    groups = dataset.group_by(t(spark, sf_dir, "nation"), F.col("n_regionkey"), F.col("n_name"), F.col("n_name"))
    joined = A.reduce(F.col("elements"), lambda a, b: X.str_fmt("%s;%s", a, b))
    return groups.select(big("key").alias("r"), joined.alias("names"))


@query("SELECT l_returnflag, l_linestatus, sum(l_quantity) AS q, round(avg(l_discount), 6) AS d, count(*) AS n FROM lineitem GROUP BY 1, 2")
def reduce_sum(spark, sf_dir):
    return dataset.fold(t(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"], q=F.sum("l_quantity"), d=F.round(F.avg("l_discount"), 6), n=F.count("*"))


@query("SELECT DISTINCT user_id, event_type FROM events")
def unique_rows(spark, sf_dir):
    return dataset.unique(t(spark, sf_dir, "events"), "user_id", "event_type")


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) = 1")
def unique_by_rows(spark, sf_dir):
    return dataset.unique_by(t(spark, sf_dir, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey", "o_totalprice")


@query("SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def last_rows(spark, sf_dir):
    return dataset.last_by(t(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "event_type")


@query("SELECT p_partkey, p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice, p_partkey) AS up, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS down FROM part")
def sort_by_ranks(spark, sf_dir):
    part = t(spark, sf_dir, "part")
    both = dataset.ranked(dataset.ranked(part, ["p_brand"], [F.col("p_retailprice").asc_nulls_first(), F.col("p_partkey")], "up"), ["p_brand"], [F.col("p_retailprice").desc_nulls_last(), F.col("p_partkey")], "down")
    return both.select("p_partkey", "p_brand", big("up").alias("up"), big("down").alias("down"))


@query("WITH c AS (SELECT c_nationkey AS k, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS at FROM customer), s AS (SELECT s_nationkey AS k, s_suppkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS at FROM supplier) SELECT coalesce(c.k, s.k)::BIGINT AS key, c_custkey, s_suppkey FROM c FULL OUTER JOIN s ON c.k IS NOT DISTINCT FROM s.k AND c.at = s.at")
def join_one_to_one(spark, sf_dir):
    c = t(spark, sf_dir, "customer").withColumnRenamed("c_nationkey", "k")
    s = t(spark, sf_dir, "supplier").withColumnRenamed("s_nationkey", "k")
    met = dataset.join_one_to_one(c, s, "k", ["c_custkey"], ["s_suppkey"])
    return met.select(big("key").alias("key"), F.col("left.c_custkey").alias("c_custkey"), F.col("right.s_suppkey").alias("s_suppkey"))


# Scalars


@query("SELECT s_suppkey AS id, coalesce(nullif(s_acctbal, round(s_acctbal, 0)), 0) + 1 - coalesce(CASE WHEN s_nationkey % 3 = 0 THEN s_acctbal END, 0) * 2 AS v, floor(s_acctbal / 7) AS f, round(s_acctbal - 7 * trunc(s_acctbal / 7), 6) AS m FROM supplier")
def arith_null_zero(spark, sf_dir):
    b = F.col("s_acctbal")
    v = S.sub(S.add(F.nullif(b, F.round(b, 0)), F.lit(1)), S.mul(F.when(F.col("s_nationkey") % 3 == 0, b), F.lit(2)))
    return t(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), v.alias("v"), S.floor(S.div(b, F.lit(7))).alias("f"), F.round(S.mod(b, F.lit(7)), 6).alias("m"))


@query("SELECT s_suppkey AS id, CASE WHEN s_nationkey % 4 <> 0 THEN cast(s_acctbal / (s_nationkey % 4) > 0 AS VARCHAR) WHEN s_acctbal > 0 THEN 'inf' WHEN s_acctbal < 0 THEN '-inf' ELSE 'nan' END AS v FROM supplier")
def div_zero(spark, sf_dir):
    q = S.div(F.col("s_acctbal"), F.col("s_nationkey") % 4)
    shown = F.when(q == float("inf"), "inf").when(q == float("-inf"), "-inf").when(F.isnan(q), "nan").otherwise((q > 0).cast("string"))
    return t(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), shown.alias("v"))


@query("SELECT s_suppkey AS id, (CASE WHEN s_nationkey % 2 = 0 THEN s_name END) IS NOT DISTINCT FROM (CASE WHEN s_nationkey % 3 = 0 THEN s_name END) AS same, s_nationkey % 2 <> 0 AS nil, (s_nationkey % 2 = 0 AND s_acctbal > 0) OR s_nationkey > 20 AS mix FROM supplier")
def eq_null(spark, sf_dir):
    k = F.col("s_nationkey")
    a, b = F.when(k % 2 == 0, F.col("s_name")).otherwise(""), F.when(k % 3 == 0, F.col("s_name"))
    return t(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), S.eq(a, b).alias("same"), S.is_nil(a).alias("nil"), S.or_(S.and_(k % 2 == 0, S.gt(F.col("s_acctbal"), F.lit(0))), k > 20).alias("mix"))


@query("SELECT s_suppkey AS id, CASE WHEN s_acctbal > 5000 THEN 'high' WHEN s_acctbal > 0 THEN 'low' ELSE 'none' END AS level, CASE WHEN s_nationkey % 2 = 0 THEN 'got ' || s_name END AS req, CASE WHEN s_nationkey > 0 THEN s_nationkey ELSE 0 END::BIGINT AS n FROM supplier")
def ternary_truthy(spark, sf_dir):
    b, k = F.col("s_acctbal"), F.col("s_nationkey")
    level = S.ternary(S.gt(b, F.lit(5000)), F.lit("high"), S.ternary(S.gt(b, F.lit(0)), F.lit("low"), F.lit("none")))
    name = F.when(k % 2 == 0, F.col("s_name")).otherwise("")
    return t(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), level.alias("level"), S.required(S.concat_text(F.lit("got "), name), (name, S.STRING)).alias("req"), big(A.list_len(S.numbers(F.lit(0), k))).alias("n"))


@query("SELECT p_partkey AS id, p_name || '/' || p_size || '/' || CASE WHEN p_size % 2 = 0 THEN cast(p_size // 2 AS VARCHAR) ELSE cast(p_size / 2 AS VARCHAR) END AS v FROM part")
def interpolation(spark, sf_dir):
    return t(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), S.concat_text(F.col("p_name"), F.lit("/"), (F.col("p_size"), S.NUMBER), F.lit("/"), (F.col("p_size") / 2, S.NUMBER)).alias("v"))


# Strings


@query("SELECT p_partkey AS id, upper(p_name) AS up, lower(p_brand) AS low, len(string_split(p_type, ' '))::BIGINT AS n, string_split(p_type, ' ')[1] AS first, substring(p_name, 2, 3) AS sub FROM part")
def str_functions(spark, sf_dir):
    words = X.split(F.col("p_type"), " ")
    return t(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), X.to_upper(F.col("p_name")).alias("up"), X.to_lower(F.col("p_brand")).alias("low"), big(F.size(words)).alias("n"), F.get(words, 0).alias("first"), X.sub_str(F.col("p_name"), 1, 4).alias("sub"))


@query("SELECT p_partkey AS id, regexp_full_match(p_brand, '[A-Za-z]+#[0-9]+') AS whole, nullif(regexp_extract(p_name, '[0-9]+', 0), '') AS num, array_to_string(list_transform(regexp_extract_all(p_type || ' ' || p_name, '([A-Za-z])([a-z0-9]*)', 1), lambda x: x || '.'), '') AS initials FROM part")
def regex_functions(spark, sf_dir):
    both = F.concat("p_type", F.lit(" "), "p_name")
    initials = X.extract_all(both, "([A-Za-z])([a-z0-9]*)", 2, lambda g: F.concat(g[1], F.lit(".")))
    return t(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), X.matches_regex(F.col("p_brand"), "[A-Za-z]+#[0-9]+").alias("whole"), X.extract_regex(F.col("p_name"), "[0-9]+").alias("num"), X.str_join("", initials).alias("initials"))


@query("SELECT doc_id AS id, to_base64(encode(lang || ': ' || text)) AS b, lang || ': ' || text AS back FROM documents")
def base64_functions(spark, sf_dir):
    s = F.concat("lang", F.lit(": "), "text")
    return t(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), X.base64_encode(s).alias("b"), X.base64_decode(X.base64_encode(s)).alias("back"))


@query("SELECT doc_id AS id, to_base64(encode(text)) AS b, text AS back FROM documents")
def base64_texts(spark, sf_dir):
    b = X.base64_encode(F.col("text"))
    return t(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), b.alias("b"), X.base64_decode(b).alias("back"))


@query("SELECT event_id AS id, (props->>'$.k')::BIGINT AS k, '{\"k\":' || (props->>'$.k') || '}' AS again FROM events")
def json_path(spark, sf_dir):
    k = X.json_path(F.col("props"), "k", to="bigint")
    return t(spark, sf_dir, "events").select(F.col("event_id").alias("id"), k.alias("k"), X.serialize_json(F.struct(k.alias("k"), F.lit(None).cast("string").alias("gone"))).alias("again"))


# Times


@query("SELECT event_id AS id, (epoch_us(ts) // 1000) AS ms, floor(abs((epoch_us(ts) // 1000) - epoch_ms(TIMESTAMP '2024-01-10')) / 3600000)::BIGINT AS hours, (epoch_us(ts) // 1000) + 2 * 86400000 AS later, (epoch_us(ts) // 1000) BETWEEN epoch_ms(TIMESTAMP '2024-01-05') AND epoch_ms(TIMESTAMP '2024-01-06') AS inside FROM events")
def time_arithmetic(spark, sf_dir):
    ts = F.col("ts")
    return t(spark, sf_dir, "events").select(F.col("event_id").alias("id"), D.to_millis(ts).alias("ms"), D.elapsed(ts, F.lit("2024-01-10T00:00:00Z"), "HOURS").alias("hours"), D.to_millis(D.new_date_time(ts, F.lit(2), "DAYS")).alias("later"), D.is_between(F.lit("2024-01-05T00:00:00Z"), F.lit("2024-01-06T00:00:00Z"), ts).alias("inside"))


@query("SELECT o_orderkey AS id, strftime(o_orderdate, '%Y/%m/%d') AS day, strftime(o_orderdate, '%Y-%m-%dT00:00:00.000Z') AS iso, year(o_orderdate) * 100 + month(o_orderdate) AS ym FROM orders")
def time_formats(spark, sf_dir):
    day = F.date_format("o_orderdate", "dd.MM.yyyy")
    iso = D.parse_date_time(day, "yyyy-MM-dd", "dd.MM.yyyy")
    parts = D.split_time(F.col("o_orderdate"))
    return t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), D.format_date_time(F.col("o_orderdate"), "yyyy/MM/dd").alias("day"), iso.alias("iso"), (F.get(parts, 0) * 100 + F.get(parts, 1)).alias("ym"))


# Lookups


_PRIORITY = {"id": "priority", "version": "v1", "group": [{"source": "tpc", "target": "hl7", "element": [{"code": "1-URGENT", "target": [{"code": "S", "display": "stat"}]}, {"code": "2-HIGH", "target": [{"code": "A", "display": "asap"}]}, {"code": "3-MEDIUM", "target": [{"code": "R", "display": "routine"}]}], "unmapped": {"mode": "fixed", "code": "U", "display": "unknown"}}]}


@query("SELECT o_orderkey AS id, CASE o_orderpriority WHEN '1-URGENT' THEN 'S' WHEN '2-HIGH' THEN 'A' WHEN '3-MEDIUM' THEN 'R' ELSE 'U' END AS code, CASE o_orderpriority WHEN '1-URGENT' THEN 'stat' WHEN '2-HIGH' THEN 'asap' WHEN '3-MEDIUM' THEN 'routine' ELSE 'unknown' END AS display, 'hl7' AS system FROM orders")
def harmonize_code(spark, sf_dir):
    done = terminology.harmonize(t(spark, sf_dir, "orders"), [_PRIORITY], "priority", F.col("o_orderpriority"), F.lit("tpc"))
    first = F.get("coded", 0)
    return done.select(F.col("o_orderkey").alias("id"), first["code"].alias("code"), first["display"].alias("display"), first["system"].alias("system"))


_UNITS = [{"source_unit": ["A", "R"], "dest_unit": "kg", "scalar": 0.45, "constant": 1.0}, {"source_unit": ["N"], "dest_unit": "K", "scalar": 2.0, "constant": 3.0, "constant_first": True}]


@query("SELECT l_returnflag AS flag, sum(CASE WHEN l_returnflag IN ('A', 'R') THEN round(0.45 * l_quantity + 1, 2) ELSE round((3 + l_quantity) * 2, 2) END)::DECIMAL(18, 2)::DOUBLE AS total, min(CASE WHEN l_returnflag IN ('A', 'R') THEN 'kg' ELSE 'K' END) AS unit FROM lineitem GROUP BY 1")
def harmonize_unit(spark, sf_dir):
    done = terminology.harmonize_unit(t(spark, sf_dir, "lineitem"), _UNITS, F.col("l_quantity"), F.col("l_returnflag"), F.lit(None).cast("string"), F.lit(None).cast("string"), 2)
    return done.groupBy(F.col("l_returnflag").alias("flag")).agg(F.round(F.sum("si_value"), 2).alias("total"), F.min("si_unit").alias("unit"))


# Linkage and snapshots


@query("SELECT c_custkey AS id, 'info=nation=' || c_nationkey || '|segment=' || c_mktsegment AS v FROM customer")
def property_values(spark, sf_dir):
    record = F.struct(F.struct(F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment")).alias("info"))
    criteria = linkage.all_of("info", linkage.primitive("segment"), linkage.primitive("nation"))
    return t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.explode(linkage.property_values(criteria, record)).alias("v"))


@query("WITH RECURSIVE e AS (SELECT DISTINCT a.c_custkey AS x, b.c_custkey AS y FROM (SELECT c_custkey, min(c_custkey) OVER (PARTITION BY c_nationkey, c_mktsegment) AS m FROM customer) a JOIN customer b ON b.c_custkey = a.m) SELECT x AS c_custkey, min(y) AS \"group\" FROM e GROUP BY 1")
def link_records(spark, sf_dir):
    record = F.struct(F.struct(F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment")).alias("info"))
    criteria = linkage.all_of("info", linkage.primitive("segment"), linkage.primitive("nation"))
    keyed = t(spark, sf_dir, "customer").select("c_custkey", linkage.property_values(criteria, record).alias("values"))
    return linkage.link_records(keyed, "c_custkey", "values")


@query("SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type, arg_max(value, (ts, event_id)) FILTER (event_type = 'purchase') AS value, count(DISTINCT event_type) AS n FROM events GROUP BY 1")
def snapshot_merge(spark, sf_dir):
    ev = t(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type", F.when(F.col("event_type") == "purchase", F.col("value")).alias("value"), F.array("event_type").alias("types"))
    done = reconcile.merge_snapshots(ev, ["user_id"], ["ts", "event_id"], {"event_type": reconcile.FORCE, "value": reconcile.PREFER, "types": reconcile.UNION})
    return done.select("user_id", "event_type", "value", big(F.size("types")).alias("n"))


@query("SELECT user_id, arg_max(event_id, (ts, event_id)) AS last_id, arg_max(props, (ts, event_id)) AS props FROM events GROUP BY 1")
def snapshot_latest(spark, sf_dir):
    ev = t(spark, sf_dir, "events").select("user_id", "ts", "event_id", F.col("event_id").alias("last_id"), "props")
    return reconcile.merge_snapshots(ev, ["user_id"], ["ts", "event_id"], {}, "latest")


@query("SELECT a.user_id, len(list_distinct(list_concat(a.v, b.v)))::BIGINT AS n_union, len(list_filter(a.v, lambda x: NOT list_contains(b.v, x)))::BIGINT AS n_diff FROM (SELECT user_id, list(DISTINCT event_type) AS v FROM events WHERE value > 50 GROUP BY 1) a JOIN (SELECT user_id, list(DISTINCT event_type) AS v FROM events WHERE value < 10 GROUP BY 1) b USING (user_id)")
def union_and_diff(spark, sf_dir):
    ev = t(spark, sf_dir, "events")
    a, b = (ev.where(p).groupBy("user_id").agg(F.collect_set("event_type").alias(n)) for p, n in (("value > 50", "a"), ("value < 10", "b")))
    met = a.join(b, "user_id")
    return met.select("user_id", big(F.size(A.union_by_field(F.col("a"), F.col("b"), lambda x: x))).alias("n_union"), big(F.size(A.diff(F.col("a"), F.col("b")))).alias("n_diff"))


@query("SELECT n_nationkey, sha256('{\"f0\":\"' || n_name || '\",\"f1\":' || n_regionkey || '}') AS h, (('0x' || substr(sha256('{\"f0\":\"' || n_name || '\"}'), 1, 8))::BIGINT - 2147483648)::INT AS i FROM nation")
def digests(spark, sf_dir):
    return t(spark, sf_dir, "nation").select("n_nationkey", S.digest(F.col("n_name"), F.col("n_regionkey")).alias("h"), S.int_digest(F.col("n_name")).alias("i"))
