"""Mapping functions and operators on edge values, and every query against its SQL."""

import base64
import os
import random

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from mapweave.functions import arrays as A
from mapweave.functions import scalars as S
from mapweave.functions import text as X
from mapweave.functions import times as D
from mapweave.operators import dataset, linkage, merge, reconcile, terminology
from mapweave.plans import queries as mapping
from mapweave.sources import documents
from mapweave.streaming import mapping as streams

SF = "/root/testdata/sf0.001"


def one(spark, *columns):
    row = spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first()
    return row[0] if len(columns) == 1 else tuple(row)


def null():
    return F.lit(None).cast("string")


def test_null_rules(spark):
    assert one(spark, S.eq(F.lit(""), null()), S.eq(F.lit("a"), null()), S.is_nil(F.array().cast("array<int>"), S.ARRAY), S.truthy(F.lit(0), S.NUMBER), S.truthy(F.lit(False)), S.not_(F.lit(None).cast("boolean"))) == (True, False, True, True, False, True)
    assert one(spark, S.add(F.lit(None).cast("int"), F.lit(2)), S.sub(F.lit(5), F.lit(None).cast("int")), S.gt(F.lit(None).cast("double"), F.lit(-1))) == (2.0, 5.0, True)
    assert one(spark, S.div(F.lit(1), F.lit(0)), S.div(F.lit(-1), F.lit(0))) == (float("inf"), float("-inf")) and one(spark, F.isnan(S.div(F.lit(0), F.lit(0))))
    assert one(spark, S.and_(), S.or_(F.lit(None).cast("boolean"), F.lit(True)), S.and_(F.lit(False), S.fail("no").isNull())) == (False, True, False)
    assert one(spark, S.all_distinct(F.lit("a"), F.lit("b"), F.lit("a")), S.required(F.lit("x"), (F.lit(""), S.STRING))) == (False, None)


@pytest.mark.parametrize("value, text", [(1.0, "1"), (1.5, "1.5"), (1e16, "10000000000000000"), (-0.0, "0"), (None, ""), (1e7, "10000000")])
def test_number_text(spark, value, text):
    assert one(spark, S.to_text(F.lit(value).cast("double"), S.NUMBER)) == text


def test_ranges(spark):
    assert one(spark, S.numbers(F.lit(0), F.lit(3)), S.numbers(F.lit(3), F.lit(0)), S.numbers_either_way(F.lit(3), F.lit(0)), S.numbers_either_way(F.lit(1), F.lit(1))) == ([0, 1, 2], [], [3, 2, 1], [])


def test_text(spark):
    assert one(spark, X.split(F.lit("a.b..c"), "."), X.split_trimmed(F.lit(" a ;; b"), ";"), X.to_upper(F.lit("straße")), X.to_lower(F.lit("ÄB"))) == (["a", "b", "", "c"], ["a", "b"], "STRAßE", "Äb")
    assert one(spark, X.matches_regex(F.lit("ab\n"), "ab"), X.matches_regex(F.lit("ab"), "a|ab"), X.matches_regex(null(), "a"), X.extract_regex(F.lit("x12"), r"\d"), X.extract_regex(F.lit("x"), r"\d")) == (False, True, False, "1", None)
    assert one(spark, X.extract_all(F.lit("a1b2"), r"([a-z])(\d)", 2, lambda g: F.concat(g[2], g[1])), X.str_join("-", F.array(F.lit("a"), null())), X.str_join_present("-", F.array(F.lit("a"), null())), X.sub_str(F.lit("hello"), 1, 99)) == (["1a", "2b"], "a-", "a", "ello")
    assert one(spark, X.base64_decode(X.base64_encode(F.lit("é"))), X.base64_encode(null()), X.json_path(F.lit('{"a":{"b":1}}'), "a", "b", to="int"), X.json_path(F.lit("no json"), "a")) == ("é", "", 1, None)


def test_base64_of_whole_texts(spark):
    texts = ["é" * 57, "two\nlines\r\n" * 40, "x" * 76, "x" * 77, "long ünd \U0001f600 " * 5000, ""]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(texts)], "i int, s string")
    rows = df.orderBy("i").select(X.base64_encode(F.col("s")), X.base64_decode(X.base64_encode(F.col("s")))).collect()
    assert [tuple(r) for r in rows] == [(base64.b64encode(s.encode()).decode(), s) for s in texts]
    whole = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert {r["id"]: r["back"] for r in mapping.QUERIES["base64_texts"](spark, SF).collect()} == whole


def test_arrays(spark):
    nums = F.array(*[F.lit(x) for x in (3, None, 1, 3)])
    key = lambda x: x
    none = F.array().cast("array<int>")
    assert one(spark, A.sort_by(nums, key), A.sort_by_desc(nums, key)) == ([None, 1, 3, 3], [3, 3, 1, None])
    assert one(spark, A.last(none), A.reduce(none, lambda a, b: a + b), A.list_len(none), A.reduce(none, lambda a, b: a + b, F.lit(7))) == (None, None, 0, 7)
    assert one(spark, A.unique_by(F.array(*[F.lit(x) for x in (3, None, 1, 3, None)]), key)) == [3, None, 1]
    assert one(spark, A.iterate(lambda x: F.when(x > 1, x * 2), nums), A.iterate(lambda a, b: a + b, F.array(F.lit(1), F.lit(2)), F.array(F.lit(5), F.lit(6)))) == ([6, 6], [6, 8])
    with pytest.raises(Exception, match="differ in length"):
        one(spark, A.iterate(lambda a, b: a + b, F.array(F.lit(1)), F.array(F.lit(5), F.lit(6))))
    assert one(spark, A.unique(F.array(F.lit(""), null(), F.lit("a"), F.lit("")))) == [None, "a"]
    pair = lambda k, v: F.struct(F.lit(k).alias("k"), F.lit(v).alias("v"))
    merged = one(spark, A.union_by_field(F.array(pair(1, "a"), pair(2, "b")), F.array(pair(3, "c"), pair(1, "z")), lambda x: x["k"]))
    assert [tuple(x) for x in merged] == [(1, "z"), (2, "b"), (3, "c")]


def greedy(left, right):
    rest, out = list(enumerate(right)), []
    for x in left:
        hit = next((p for p in rest if p[1] == x), None)
        out.append((x, hit[1] if hit else None))
        if hit:
            rest.remove(hit)
    return out + [(None, y) for _, y in rest]


def test_one_to_one_joins(spark):
    rng = random.Random(1)
    for _ in range(4):
        left, right = ([rng.choice(["a", "b", "c", "d"]) for _ in range(rng.randrange(1, 9))] for _ in range(2))
        got = one(spark, A.join_one_to_one(F.array(*map(F.lit, left)), F.array(*map(F.lit, right)), lambda x, y: x == y, "string"))
        assert [tuple(x) for x in got] == greedy(left, right)
        a, b = (spark.createDataFrame([(i, k) for i, k in enumerate(v)], "i int, k string") for v in (left, right))
        rows = dataset.join_one_to_one(a, b, "k", ["i"], ["i"]).collect()
        assert sorted((r["left"] and r["left"]["k"], r["right"] and r["right"]["k"]) for r in rows if r["left"] and r["right"]) == sorted(p for p in greedy(left, right) if None not in p)
        assert len(rows) == len(greedy(left, right))


def test_merge(spark):
    df = spark.sql("select struct(1 as a, array(1) as l, 'x' as s, map('k', 1) as m) as old, struct(2 as b, array(2) as l, '' as s, map('k', 2, 'n', 3) as m) as new")
    kinds = df.schema["old"].dataType, df.schema["new"].dataType
    got = df.select(merge.merged(F.col("old"), F.col("new"), *kinds).alias("m")).first()["m"]
    assert got.asDict() == {"a": 1, "l": [1, 2], "s": "x", "m": {"k": 2, "n": 3}, "b": 2}
    extended = df.select(merge.written(F.col("old"), F.col("new"), *kinds, merge.EXTEND).alias("m")).first()["m"]
    assert extended.asDict() == {"a": 1, "l": [1], "s": "x", "m": {"k": 1}, "b": 2}
    with pytest.raises(TypeError):
        merge.written(F.col("old"), F.col("new"), *kinds, merge.APPEND)
    with pytest.raises(ValueError):
        merge.written(F.col("old"), F.col("new"), *kinds, "other")
    assert one(spark, merge.merged_at(F.array(F.lit(1)), F.lit(9), 2)) == [1, None, 9]


def test_times(spark):
    iso = F.lit("2024-03-01T10:20:30.500Z")
    assert one(spark, D.split_time(iso), D.to_millis(F.lit("bad")), D.elapsed(iso, F.lit("2024-02-29T10:20:30.500Z"), "HOURS"), D.new_date_time(iso, F.lit(1), "MONTHS")) == ([2024, 3, 1, 10, 20, 30, 500000000], None, 24, "2024-03-31T20:20:30.500Z")
    assert one(spark, D.parse_unix_time(F.lit(1700000000), "s"), D.parse_date_time(F.lit("x"), "yyyy"), D.format_date_time(iso, "HH", "Asia/Tokyo")) == ("2023-11-14T22:13:20.000Z", None, "19")
    with pytest.raises(ValueError):
        D.elapsed(iso, iso, "FORTNIGHTS")


def test_lookups(spark):
    maps = [{"id": "m", "version": "1", "group": [{"source": "s", "target": "t", "element": [{"code": "a", "target": [{"code": "A"}, {"code": "B"}]}], "unmapped": {"mode": "provided"}}]}, {"id": "m", "group": []}, {"id": "bare", "group": [{"source": "s", "target": "t", "element": []}]}]
    df = spark.createDataFrame([("a", "s"), ("a", ""), ("q", "s"), ("q", "else")], "code string, sys string")
    got = {(r["code"], r["sys"]): [x["code"] + "@" + x["system"] for x in r["coded"]] for r in terminology.harmonize(df, maps, "m", F.col("code"), F.col("sys")).collect()}
    assert got == {("a", "s"): ["A@t", "B@t"], ("a", ""): ["A@t", "B@t"], ("q", "s"): ["q@t"], ("q", "else"): ["q@m-unharmonized"]}
    with pytest.raises(KeyError):
        terminology.harmonize(df, maps, "none", F.col("code"))


def test_linkage(spark):
    df = spark.sql("select 1 as id, struct(array(struct('S' as system, 'V' as value), struct('T' as system, 'W' as value), struct('S' as system, '' as value)) as identifier) as r")
    strings = lambda c: df.select(linkage.property_values(c, F.col("r"))).first()[0]
    assert strings(linkage.any_identifier()) == ["identifier=system=S|value=V", "identifier=system=T|value=W"]
    assert strings(linkage.any_identifier(linkage.filter_value("system", "T"))) == ["identifier=system=T|value=W"]
    for bad in (("x", "odd"), ("x", "array"), ("x", "primitive", (linkage.primitive("y"),))):
        with pytest.raises(ValueError):
            linkage.Criteria(*bad)
    chain = spark.createDataFrame([(i, [f"v{i}", f"v{i + 1}"]) for i in range(12)] + [(50, ["z"]), (60, [])], "id long, vals array<string>")
    assert {r["id"]: r["group"] for r in linkage.link_records(chain, "id", "vals").collect()} == {**{i: 0 for i in range(12)}, 50: 50, 60: 60}


def test_linkage_of_too_few_rounds_fails(spark):
    chain = spark.createDataFrame([(i, [f"v{i}", f"v{i + 1}"]) for i in range(12)], "id long, vals array<string>")
    with pytest.raises(RuntimeError, match="not settled"):
        linkage.link_records(chain, "id", "vals", most_rounds=2)


def test_snapshots(spark):
    df = spark.createDataFrame([(1, 1, "a", "x", ["p"]), (1, 2, "", "y", ["q", "p"]), (1, 3, None, None, None)], "id int, at int, name string, gone string, tags array<string>")
    got = reconcile.merge_snapshots(df, ["id"], ["at"], {"gone": reconcile.FORCE}).first()
    assert (got["name"], got["gone"], got["tags"]) == ("a", None, ["p", "q"])
    with pytest.raises(ValueError):
        reconcile.merge_snapshots(df, ["id"], ["at"], {"name": "odd"})


def test_snapshot_unions_collect_distinct_elements_only(spark):
    rows = [(None, 2, ["b", None, "a"]), (None, 1, ["c", "b"]), (1, 1, []), (2, 1, None), (3, 5, ["x"]), (3, 4, ["y", "x", "y"])]
    df = spark.createDataFrame(rows, "id int, at int, tags array<string>")
    done = reconcile.merge_snapshots(df, ["id"], ["at"], {})
    assert {r["id"]: r["tags"] for r in done.collect()} == {None: ["c", "b", None, "a"], 1: [], 2: [], 3: ["y", "x"]}
    plan = done._jdf.queryExecution().optimizedPlan().toString().split("\n")
    at = next(i for i, line in enumerate(plan) if "Aggregate" in line and "collect_list" in line)
    assert any("Aggregate" in line and "__v" in line.split("]")[0] and "min(" in line for line in plan[at + 1 :]), plan


def test_sources_and_paths(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"x": {"y": 1}}')
    assert documents.read_documents(spark, str(tmp_path), "x struct<y: int>").select("root.x.y").first()[0] == 1
    assert documents.list_files(spark, str(tmp_path), "*.json").count() == 1 and documents.file_exists(spark, str(tmp_path / "a.json"))
    documents.write_documents(spark.sql("select struct(1 as a, cast(null as int) as b) as root"), str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out")).first()[0] == '{"a":1}'
    assert documents.join_path("gs://b/x", "../y") == "gs://b/y" and documents.join_path("./a", "b") == "./a/b" and documents.abs_path("/a/b.txt", "c") == "/a/c"


def test_stream_gives_what_the_table_gives(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet")
    source = str(tmp_path / "in")
    events.repartition(3).write.parquet(source)
    mapped = lambda df: df.where("value > 50").select("event_id", X.json_path(F.col("props"), "k", to="int").alias("k"))
    streams.run_mapping(streams.read_stream(spark, source, events.schema), mapped, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    assert sorted(spark.read.parquet(str(tmp_path / "out")).collect()) == sorted(mapped(events).collect())


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"create view {f.removesuffix('.parquet')} as select * from '{SF}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(mapping.QUERIES))
def test_query_against_sql(spark, duck, name):
    df = mapping.QUERIES[name](spark, SF)
    rows = sorted(tuple(map(str, r)) for r in df.select(*sorted(df.columns)).collect())
    assert rows
    if name in mapping.ORACLE_SQL:
        rel = duck.sql(mapping.ORACLE_SQL[name])
        assert sorted(rel.columns) == sorted(df.columns)
        want = rel.project(",".join(f'"{c}"' for c in sorted(rel.columns))).fetchall()
        assert rows == sorted(tuple(map(str, r)) for r in want)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.fixture
def in_zone(spark):
    yield lambda zone: spark.conf.set("spark.sql.session.timeZone", zone)
    spark.conf.set("spark.sql.session.timeZone", "UTC")


@pytest.mark.parametrize("zone", ["UTC", "America/New_York", "Asia/Kolkata"])
def test_times_under_any_session_zone(spark, in_zone, zone):
    in_zone(zone)
    iso = F.lit("2024-01-01T00:00:00Z")
    assert one(spark, D.from_millis(F.lit(0)), D.from_millis(F.lit(-1)), D.to_millis(F.lit("1970-01-01T00:00:01")), D.to_millis(F.lit("1970-01-02"))) == ("1970-01-01T00:00:00.000Z", "1969-12-31T23:59:59.999Z", 1000, 86_400_000)
    assert one(spark, D.new_date_time(iso, F.lit(1), "DAYS"), D.split_time(iso), D.format_date_time(iso, "yyyy-MM-dd HH:mm"), D.format_date_time(iso, "dd HH", "Asia/Tokyo")) == ("2024-01-02T00:00:00.000Z", [2024, 1, 1, 0, 0, 0, 0], "2024-01-01 00:00", "01 09")
    assert one(spark, D.parse_date_time(F.lit("01.02.2024 03"), "dd.MM.yyyy HH"), D.parse_date_time(F.lit("2024-02-01 03:00 +0100"), "yyyy-MM-dd HH:mm Z"), D.parse_date_time(F.lit("2024/02"), "yyyy/MM[/dd]"), D.parse_unix_time(F.lit(1_500), "ms"), D.parse_unix_time(F.lit(2_000_000), "us")) == ("2024-02-01T03:00:00.000Z", "2024-02-01T02:00:00.000Z", "2024-02-01T00:00:00.000Z", "1970-01-01T00:00:01.500Z", "1970-01-01T00:00:02.000Z")
    at = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    assert one(spark, D.to_millis(at), D.to_millis(F.timestamp_millis(F.lit(77))), D.current_time("yyyy-MM-dd", at=iso)) == (1_704_067_200_000, 77, "2024-01-01")
    with pytest.raises(Exception, match="not a time"):
        one(spark, D.is_between(F.lit("bad"), iso, iso))


def test_defaults_take_numbers_and_null_sides(spark):
    nums, none = F.array(F.lit(1), F.lit(2), F.lit(1)), F.lit(None).cast("array<int>")
    assert one(spark, S.eq(F.lit(1), F.lit(1)), S.is_nil(F.lit(0)), S.neq(F.lit(1.5), F.lit(2.5)), A.unique(nums), S.parse_num(F.lit("1e3"), strict=False), S.parse_num(F.lit("1234567890123.5"), strict=False), S.parse_num(F.lit("x"), strict=False)) == (True, False, True, [1, 2], 1000.0, 1234567890123.5, None)
    assert one(spark, A.union(none, nums), A.union(nums, none), A.diff(nums, none), A.diff(nums, F.array(F.lit(2)))) == ([1, 2], [1, 2], [1, 2], [1])
    assert one(spark, A.iterate(lambda a, b, c: F.coalesce(b, F.lit(0)) + a + c, nums, none, nums), A.iterate(lambda x: F.when(x > 1, F.lit("a")).otherwise(""), nums)) == ([2, 4, 2], ["a"])
    assert one(spark, X.str_join("-", F.array(F.lit(1.0), F.lit(2.5))), X.json_path(F.lit('{"a.b": {"c\'d": 4}}'), "a.b", "c'd", to="int"), X.str_join("", X.extract_all(F.lit("hello"), r"(.)\1", 1, lambda g: g[1]))) == ("1-2.5", 4, "l")
    assert one(spark, S.digest(F.lit(1)) != S.digest(F.lit("1")), S.digest(F.lit("")) == S.digest(null()), S.numbers(F.lit(2))) == (True, True, [0.0, 1.0])


def test_writes_of_nothing_and_at_paths(spark):
    from pyspark.sql import types as T

    ints, text = T.ArrayType(T.IntegerType()), T.StringType()
    none, some = F.lit(None).cast("array<int>"), F.array(F.lit(1))
    assert one(spark, merge.written(none, F.lit(2), ints, T.IntegerType(), merge.APPEND), merge.written(none, some, ints, ints, merge.EXTEND), merge.written(some, none, ints, ints, merge.EXTEND)) == ([2], [1], [1])
    root, kind = F.lit(None), T.NullType()
    for path, mode in (("a.b[1].c", merge.MERGE), ("a.b[].c", merge.MERGE), ("a.b[0].d", merge.MERGE), ("a.b[1].c", merge.REPLACE)):
        root, kind = merge.write_at(root, kind, path, F.lit(f"{path}{mode}"), text, mode)
    got = one(spark, F.to_json(root), F.lit(0))[0]
    assert got == '{"a":{"b":[{"d":"a.b[0].dmerge"},{"c":"a.b[1].creplace"},{"c":"a.b[].cmerge"}]}}'
    root, kind = merge.write_at(F.struct(F.array(F.lit(1)).alias("l")), T.StructType.fromDDL("l array<int>"), "l[3]", F.lit(9), T.IntegerType())
    assert one(spark, root["l"], F.lit(0))[0] == [1, None, None, 9]
    assert merge.path_steps("a.b[0][].c") == ["a", "b", 0, None, "c"]
    for bad in (".a", "a..b", "a[x]", "a]"):
        with pytest.raises(ValueError):
            merge.path_steps(bad)
    with pytest.raises(TypeError):
        merge.write_at(F.lit(1), T.IntegerType(), "a", F.lit(1), T.IntegerType())
    slot = merge.merged_at(F.array(F.struct(F.lit(1).alias("a"))), F.struct(F.lit(2).alias("a")), 0, T.StructType.fromDDL("a int"), T.StructType.fromDDL("a int"))
    assert one(spark, slot, F.lit(0))[0][0]["a"] == 2


PRIMITIVES = [{"field": "system", "fieldType": "primitive"}, {"field": "value", "fieldType": "primitive"}]
PAIR = {"fieldType": "container", "pathOperator": "AND", "paths": PRIMITIVES}


@pytest.mark.parametrize(
    "bad",
    [
        {"fieldType": "array", "paths": [PAIR]},
        {"field": "identifier", "fieldType": "array"},
        {"field": "identifier", "fieldType": "array", "paths": [{"fieldType": "container"}]},
        {"field": "identifier", "fieldType": "array", "fieldFilter": ["x"], "paths": [PAIR]},
        {"field": "identifier", "fieldType": "array", "paths": [PAIR | {"fieldFilter": ["x"]}]},
        {"field": "identifier", "fieldType": "odd", "paths": [PAIR]},
        {"field": "identifier", "fieldType": "array", "paths": [PAIR | {"pathOperator": "NOT"}]},
        {"field": "identifier", "paths": [PAIR]},
        {"field": "identifier", "fieldType": "array", "paths": [PAIR | {"paths": [PRIMITIVES[0] | {"fieldFilter": "ssn"}]}]},
        {"field": "identifier", "fieldType": "array", "paths": PAIR},
        {"field": "identifier", "fieldType": "array", "paths": ["no", "paths"]},
        {"field": "identifier", "fieldType": "array", "paths": [PAIR | {"paths": [PRIMITIVES[0] | {"fieldFilter": [["x"]]}]}]},
        {"field": "identifier", "fieldType": ["container"], "paths": [PAIR]},
        {"field": "identifier", "fieldType": "array", "pathOperator": ["AND"], "paths": [PAIR]},
        {"field": "identifier", "fieldType": "array", "paths": [PAIR | {"paths": [PRIMITIVES[0] | {"paths": PRIMITIVES}]}]},
        {"field": "identifier", "fieldType": "array", "paths": [PAIR | {"paths": [{"fieldType": "primitive"}, PRIMITIVES[1]]}]},
        {"field": 3, "fieldType": "primitive"},
        "text",
    ],
)
def test_malformed_criteria(bad):
    with pytest.raises(ValueError):
        linkage.criteria_from(bad)


def test_criteria_against_the_type_of_records():
    from pyspark.sql import types as T

    texts = T.StructType.fromDDL("arrayField array<string>, containerField array<string>, name struct<given: array<string>>")
    key = [{"field": "key", "fieldType": "primitive"}]
    for bad in ({"field": "arrayField", "fieldType": "array", "paths": [{"fieldType": "container", "paths": key}]}, {"field": "arrayField", "fieldType": "array", "paths": key}, {"field": "containerField", "fieldType": "container", "paths": key}, {"field": "name", "fieldType": "container", "paths": [{"field": "given", "fieldType": "primitive"}]}):
        with pytest.raises(TypeError):
            linkage.check_criteria(linkage.criteria_from(bad), texts)
    linkage.check_criteria(linkage.criteria_from({"field": "gone", "fieldType": "primitive"}), texts)
    linkage.check_criteria(linkage.criteria_from({"field": "arrayField", "fieldType": "array", "paths": [{"fieldType": "primitive"}]}), texts)


def test_linkage_of_text_keys_and_heavy_values(spark, monkeypatch):
    from mapweave.operators import skew

    monkeypatch.setattr(skew, "FEW", 3)
    monkeypatch.setattr(skew, "HEAVY", 20)
    rows = [(f"k{i:03}", ["all"] if i % 2 else [f"v{i}"]) for i in range(60)] + [(None, ["all"]), ("k000", ["v2"])]
    got = {r["id"]: r["group"] for r in linkage.link_records(spark.createDataFrame(rows, "id string, vals array<string>"), "id", "vals").collect()}
    assert got == {f"k{i:03}": "k001" if i % 2 else "k000" if i == 2 else f"k{i:03}" for i in range(60)}


def test_join_by_key_of_heavy_and_light_keys(spark, monkeypatch):
    from mapweave.operators import skew

    monkeypatch.setattr(skew, "FEW", 2)
    monkeypatch.setattr(skew, "HEAVY", 4)
    rows = spark.createDataFrame([(k, i) for i, k in enumerate([1] * 50 + [2] * 2 + [3, None])], "k int, i int")
    keyed = rows.where("k is not null and k < 3").groupBy("k").agg(F.count("*").alias("n"))
    assert sorted(r["i"] for r in skew.join_by_key(rows, keyed, ["k"], "n").collect()) == list(range(52))


def test_unit_look_up_is_exact(spark):
    table = [{"source_unit": ["A"], "dest_unit": "kg", "scalar": 2.0}, {"source_unit": ["A"], "code": "x", "dest_unit": "g", "scalar": 3.0}]
    df = spark.createDataFrame([(1.0, "A", None), (1.0, "A", "x"), (1.0, "A", "y"), (None, "B", "")], "q double, u string, c string")
    got = [(r["u"], r["c"], r["si_value"], r["si_unit"]) for r in terminology.harmonize_unit(df, table, F.col("q"), F.col("u"), F.col("c"), F.lit(""), 2).collect()]
    assert sorted(got, key=str) == sorted([("A", None, 2.0, "kg"), ("A", "x", 3.0, "g"), ("A", "y", 1.0, "A"), ("B", "", None, "B")], key=str)


def test_xml_and_documents_by_name(spark, tmp_path):
    (tmp_path / "x.xml").write_text("<all><row id='1'><name>a</name></row><row id='2'><name>b</name></row></all>")
    assert [tuple(r) for r in documents.read_xml(spark, str(tmp_path / "x.xml"), "row", "_id int, name string").collect()] == [(1, "a"), (2, "b")]
    documents.write_each(spark.sql("select 'p' as file, struct(1 as a) as root union all select 'q', struct(2 as a)"), str(tmp_path / "each"), "file")
    assert spark.read.text(str(tmp_path / "each" / "file=q")).first()[0] == '{"a":2}'
