"""Small helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space that separates words, as a character class body.
ASCII_SPACE = "\\x20\\x09-\\x0D"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_kept: dict[str, object] = {}


def kept(name: str, make: Callable[[], object]) -> object:
    """What a Python worker keeps from task to task under `name`; whatever it kept for another operator goes."""
    if name not in _kept:
        _kept.clear()
        _kept[name] = make()
    return _kept[name]


def slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The batches in parts of few rows, so that only these become Python objects at a time."""
    for b in batches:
        for lo in range(0, b.num_rows, rows):
            yield b.slice(lo, rows)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body(value)` with `value` evaluated once a row, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), 0)


def char_array(text: Column) -> Column:
    """The characters of a text, in linear time for any length; empty for an empty text."""
    return F.when(F.length(text) > 0, F.split(text, "")).otherwise(F.array().cast("array<string>"))


def positions(n: Column) -> Column:
    """[0, n), empty where n <= 0."""
    return F.when(n > 0, F.sequence(F.lit(0), (n - 1).cast("int"))).otherwise(F.array().cast("array<int>"))


def constant_array(values: list[float]) -> Column:
    """An array of doubles that the optimizer folds into one literal; for models of a bounded size."""
    return F.split(F.lit(" ".join(map(repr, values))), " ").cast("array<double>")
