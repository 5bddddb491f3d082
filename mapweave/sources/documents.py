"""JSON documents in and out, and paths."""

from __future__ import annotations

import posixpath

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_documents(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """A row for each file that holds one JSON document: (path, root). Without a schema root is a variant."""
    texts = spark.read.option("wholetext", True).text(path).select(F.col("_metadata.file_path").alias("path"), "value")
    return texts.select("path", (F.parse_json("value") if schema is None else F.from_json("value", schema)).alias("root"))


def read_json_lines(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.json(path)


def load_text(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("wholetext", True).text(path)


def write_documents(df: DataFrame, path: str, root: str = "root") -> None:
    """A JSON text line for each record; null members are dropped."""
    df.select(F.to_json(root).alias("value")).write.text(path)


def list_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, length) of the files below ``path`` whose names match."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    return found.select("path", "length")


def file_exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at))


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def join_path(first: str, *rest: str) -> str:
    """Joined and normalised; a scheme and one leading ``./`` or ``../`` stay."""
    scheme, mark, tail = first.partition("://")
    head = tail if mark else first
    joined = posixpath.normpath(posixpath.join(head, *[r.lstrip("/") for r in rest]))
    if head.startswith("./") and not joined.startswith("."):
        joined = f"./{joined}"
    return f"{scheme}://{joined}" if mark else joined


def abs_path(base: str, *parts: str) -> str:
    """``parts`` against the folder of ``base``; an absolute first part stands alone."""
    if parts and (parts[0].startswith("/") or "://" in parts[0]):
        return join_path(*parts)
    return join_path(posixpath.dirname(base), *parts)


def from_literal(spark: SparkSession, text: str, schema: T.StructType | str) -> DataFrame:
    """A small table of a JSON text (a document or an array of them) that the program holds."""
    array = text.lstrip().startswith("[")
    kind = f"array<{schema if isinstance(schema, str) and schema.startswith('struct') else 'struct<' + schema + '>' if isinstance(schema, str) else schema.simpleString()}>"
    row = spark.createDataFrame([(text if array else f"[{text}]",)], "text string")
    return row.select(F.inline(F.from_json("text", kind)))


def write_each(df: DataFrame, path: str, name: str, root: str = "root") -> None:
    """One folder with a JSON text file for each value of ``name`` (``path/name=value``), written by as many tasks as hold rows."""
    df.select(name, F.to_json(root).alias("value")).repartition(name).write.partitionBy(name).text(path)


def read_xml(spark: SparkSession, path: str, row_tag: str, schema: T.StructType | str | None = None) -> DataFrame:
    """A row for each element ``row_tag`` of XML files; attributes are columns with ``_`` before their names."""
    reader = spark.read.format("xml").option("rowTag", row_tag)
    return (reader if schema is None else reader.schema(schema)).load(path)
