"""Writers: JSON records, CSV, tab-separated counts, reports, XML postings, tables over JDBC."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_json_records(df: DataFrame, path: str) -> None:
    """One JSON object a line, nulls written."""
    df.write.option("ignoreNullFields", "false").json(path)


def json_array(df: DataFrame, encoded_twice: bool = False) -> DataFrame:
    """One row: all records as one JSON array text, in the order of the records' values; for small results."""
    text = F.to_json(F.array_sort(F.collect_list(F.struct(*df.columns))))
    return df.agg((F.to_json(F.struct(text.alias("v"))).substr(F.lit(6), F.length(F.to_json(F.struct(text.alias("v")))) - 6) if encoded_twice else text).alias("value"))


def write_json_object(df: DataFrame, path: str) -> None:
    """Each row of df as an indented JSON object, nulls written; a summary of one row makes one object."""
    text = F.to_json(F.struct("*"), {"pretty": "true", "ignoreNullFields": "false"})
    df.select(text.alias("value")).write.text(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.csv(path, header=True)


def write_counts(df: DataFrame, path: str) -> None:
    """Key and value parted by a tab, without a header."""
    df.write.csv(path, sep="\t")


def write_text(df: DataFrame, column: str, path: str) -> None:
    df.select(column).write.text(path)


def write_xml(df: DataFrame, path: str, root: str = "index", row: str = "token") -> None:
    df.write.format("xml").option("rootTag", root).option("rowTag", row).save(path)


def write_jdbc(df: DataFrame, url: str, table: str, mode: str = "append", **options: str) -> None:
    """Rows in bulk, by as many connections as df has partitions."""
    df.write.jdbc(url, table, mode=mode, properties=options)
