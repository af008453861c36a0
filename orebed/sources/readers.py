"""Readers: text, CSV, JSON in its odder shapes, XML trees, tables over JDBC. Schemas are given, never inferred."""

from __future__ import annotations

import xml.etree.ElementTree as ET
from collections import deque
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf


def read_lines(spark: SparkSession, *paths: str) -> DataFrame:
    """(value) of one or several text inputs."""
    return spark.read.text(list(paths))


def read_csv(spark: SparkSession, path: str, schema: str, header: bool = True) -> DataFrame:
    """A CSV table; without a header the schema names the columns."""
    return spark.read.csv(path, schema=schema, header=header)


def read_spaced(spark: SparkSession, path: str, names_and_types: list[tuple[str, str]]) -> DataFrame:
    """A table of columns parted by white space; what does not cast is null."""
    parts = F.split(F.trim("value"), r"\s+")
    return spark.read.text(path).select(*(F.get(parts, i).try_cast(t).alias(n) for i, (n, t) in enumerate(names_and_types)))


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.json(path, schema=schema)


def read_json_inferred(spark: SparkSession, path: str, sample: float = 1.0) -> DataFrame:
    """JSON lines with the types that the values show, by a pass over all of them or over a share of the lines."""
    return spark.read.option("samplingRatio", sample).json(path)


def unwrap_json(text: Column) -> Column:
    """The JSON text that a JSON string holds; other JSON text as it is."""
    return F.when(F.trim(text).startswith('"'), F.get_json_object(F.concat(F.lit('{"v":'), text, F.lit("}")), "$.v")).otherwise(text)


def read_json_array(spark: SparkSession, path: str, record: str) -> DataFrame:
    """Records of files that each hold one JSON array, plain or encoded a second time as a string."""
    rows = spark.read.text(path, wholetext=True).select(F.explode(F.from_json(unwrap_json(F.col("value")), f"array<struct<{record}>>")).alias("r"))
    return rows.select("r.*")


def read_json_maps(spark: SparkSession, path: str) -> DataFrame:
    """(outer, inner, fields) of files that hold a map of maps of records; `fields` keeps which keys there were."""
    rows = spark.read.text(path, wholetext=True).select(F.from_json(unwrap_json(F.col("value")), "map<string,map<string,map<string,string>>>").alias("m"))
    return rows.select(F.explode("m").alias("outer", "inner_map")).select("outer", F.explode("inner_map").alias("inner", "fields"))


def field(fields: Column, key: str, default: str) -> Column:
    """A record's field as text: the default if the key is missing, null if it is there and null."""
    return F.when(F.map_contains_key(fields, key), F.try_element_at(fields, F.lit(key))).otherwise(F.lit(default))


def number(text: Column) -> Column:
    """A number with thousands commas; null if it is none."""
    return F.replace(text, F.lit(","), F.lit("")).try_cast("double")


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of whole text files, ASCII only and in lower case."""
    from orebed.functions.text import ascii_lower

    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), ascii_lower(F.col("value")).alias("text"))


def read_jdbc(spark: SparkSession, url: str, table: str, **options: str) -> DataFrame:
    """A table of a database; filters and columns are pushed down. The driver's jar has to be on the class path."""
    return spark.read.jdbc(url, table, properties=options)


@udtf(returnType="path string, tag string, text string")
class XmlElements:
    """(path, tag, text) of an XML document's elements, breadth first, and of their attributes as path.@key.

    Children of elements without text are visited too, unless `strict`. A document that does not parse, or a null
    one, gives no rows.
    """

    def eval(self, document: str | None, strict: bool) -> Iterator[tuple]:
        try:
            root = ET.fromstring(document or "")
        except ET.ParseError:
            return
        todo = deque([(root.tag, root)])
        while todo:
            path, element = todo.popleft()
            text = (element.text or "").strip()
            if not text and element.text is None and strict:
                continue
            if text:
                yield path, element.tag, text
            for key, value in element.attrib.items():
                yield f"{path}.@{key}", f"@{key}", value
            todo.extend((f"{path}.{child.tag}", child) for child in element)


def xml_elements(docs: DataFrame, id_column: str, text_column: str, strict: bool = False) -> DataFrame:
    """(which, path, tag, text) of the elements of all documents."""
    docs.sparkSession.udtf.register("orebed_xml_elements", XmlElements)
    return docs.sparkSession.sql(f"SELECT d.{id_column} AS which, x.path, x.tag, x.text FROM {{docs}} d, LATERAL orebed_xml_elements(d.{text_column}, {str(strict).lower()}) x", docs=docs)


def read_xml_dir(spark: SparkSession, path: str) -> DataFrame:
    """xml_elements of the files in a folder whose names end in `l`."""
    files = spark.read.text(path, wholetext=True, pathGlobFilter="*l").select(F.input_file_name().alias("file"), F.col("value").alias("document"))
    return xml_elements(files, "file", "document")
