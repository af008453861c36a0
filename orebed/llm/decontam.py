"""Benchmark decontamination by pigeonhole edit matching.

An item that may carry k errors is cut into k + 1 pieces: wherever it occurs with at most k errors, one piece
occurs exactly. All pieces of a block of items make one Aho-Corasick automaton; every piece hit is verified
by Myers' bit-parallel edit distance of the whole item against the text around the hit.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orebed.llm.common import kept, slices, table

#: Errors allowed, as a share of an item's characters.
ERROR_RATE = 0.08

#: Items of one automaton; more items take more passes over the texts, not more memory.
BLOCK_ITEMS = 20_000

#: What is known of a row after some blocks; its text goes with it to the next block.
FOUND = "doc_id long, item_ids array<long>, least_errors int"

_GAP = re.compile(r"[\W_]+")


def normal(text: str | None) -> str:
    """Lower case; every run of other than letters and digits is one space; none at the ends."""
    return _GAP.sub(" ", (text or "").lower()).strip()


def budget(length: int, rate: float = ERROR_RATE) -> int:
    return int(length * rate)


class Item:
    """A benchmark item made ready: its error budget, its pieces with their offsets, its bit masks."""

    def __init__(self, item_id: int, text: str, rate: float) -> None:
        self.id, self.size, self.errors = item_id, len(text), budget(len(text), rate)
        cuts = [i * len(text) // (self.errors + 1) for i in range(self.errors + 2)]
        self.pieces = [(text[a:b], a) for a, b in zip(cuts, cuts[1:], strict=False)]
        self.masks: dict[str, int] = {}
        for i, c in enumerate(text):
            self.masks[c] = self.masks.get(c, 0) | 1 << i

    def distance(self, text: str) -> int:
        """The least edit distance of the item to any substring of `text` (Myers 1999, one big integer a column)."""
        full, last = (1 << self.size) - 1, 1 << (self.size - 1)
        plus, minus, score = full, 0, self.size
        best = score
        for c in text:
            eq = self.masks.get(c, 0)
            x = eq | minus
            d0 = ((((x & plus) + plus) ^ plus) | x) & full
            up, down = minus | (full & ~(d0 | plus)), plus & d0
            if up & last:
                score += 1
            elif down & last:
                score -= 1
                best = min(best, score)
            up, down = (up << 1) & full, (down << 1) & full
            plus, minus = down | (full & ~(d0 | up)), up & d0
        return best


class Matcher:
    """Finds the items of one block in texts."""

    def __init__(self, items: list[tuple[int, str]], rate: float) -> None:
        self.items = [Item(i, t, rate) for i, t in items if t]
        where: dict[str, list[tuple[int, int]]] = {}
        for k, item in enumerate(self.items):
            for piece, offset in item.pieces:
                where.setdefault(piece, []).append((k, offset))
        self.automaton = ahocorasick.Automaton()
        for piece, places in where.items():
            self.automaton.add_word(piece, (len(piece), places))
        if where:
            self.automaton.make_automaton()

    def find(self, text: str | None) -> dict[int, int]:
        """item id: least errors, of the items that `text` holds within their budgets."""
        found: dict[int, int] = {}
        tried: set[tuple[int, int]] = set()
        if not self.items or not (clean := normal(text)):
            return found
        for end, (size, places) in self.automaton.iter(clean):
            for k, offset in places:
                item, at = self.items[k], end + 1 - size - offset
                if found.get(item.id) == 0 or (k, at) in tried:
                    continue
                tried.add((k, at))
                errors = item.distance(clean[max(0, at - item.errors) : at + item.size + item.errors])
                if errors <= item.errors:
                    found[item.id] = min(errors, found.get(item.id, errors))
        return found


def _matcher(name: str, items: list[tuple[int, str]], rate: float) -> Matcher:
    return kept(f"matcher {name}", lambda: Matcher(items, rate))


def _blocks(benchmark: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """The benchmark's different non-empty items, at most BLOCK_ITEMS at a time."""
    items = benchmark.select(F.col("item_id").cast("long"), "text").where("text IS NOT NULL")
    n = 1 + items.count() // (BLOCK_ITEMS // 2)  # blocks are dealt by hash, half full on average
    for part in range(n):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == part).collect()
        block = sorted({(i if i is not None else -1, c) for i, t in rows if (c := normal(t))})
        if block:
            yield block


def matches(docs: DataFrame, benchmark: DataFrame, rate: float = ERROR_RATE) -> DataFrame:
    """One row a document: doc_id, contaminated, n_items, least_errors (null if none), item_ids in order.

    Null and empty texts hold no item; null and wordless items are left out; an item with a null id counts as
    -1. Items and texts are compared in lower case with punctuation as spaces, texts whole. Repeated rows get
    equal results, other columns are ignored, an empty table gives no rows, an empty benchmark no matches.
    """
    blocks, run_id = list(_blocks(benchmark)), uuid.uuid4().hex
    docs = docs.select(F.col("doc_id").cast("long"), "text")

    found = docs.withColumns({"item_ids": F.array().cast("array<long>"), "least_errors": F.lit(None).cast("int")})
    for k, items in enumerate(blocks):
        last = k == len(blocks) - 1

        def run(batches: Iterator[pa.RecordBatch], items=items, name=f"{run_id}-{k}", last=last) -> Iterator[pa.RecordBatch]:
            m = _matcher(name, items, rate)
            for b in slices(batches):
                got = [m.find(t) for t in b.column("text").to_pylist()]
                ids = [sorted({*known, *g}) for known, g in zip(b.column("item_ids").to_pylist(), got, strict=True)]
                least = [min((x for x in (known, *g.values()) if x is not None), default=None) for known, g in zip(b.column("least_errors").to_pylist(), got, strict=True)]
                out = {"doc_id": b.column("doc_id"), "item_ids": pa.array(ids, pa.list_(pa.int64())), "least_errors": pa.array(least, pa.int32())}
                yield pa.RecordBatch.from_pydict(out if last else out | {"text": b.column("text")})

        found = found.mapInArrow(run, FOUND if last else f"{FOUND}, text string")
    n = F.size("item_ids").cast("long")
    return found.select("doc_id", (n > 0).alias("contaminated"), n.alias("n_items"), "least_errors", "item_ids")


def keep_clean(docs: DataFrame, benchmark: DataFrame, rate: float = ERROR_RATE) -> DataFrame:
    """The rows whose text holds no benchmark item; all columns and repeated rows stay."""
    columns, run_id = docs.columns, uuid.uuid4().hex
    for k, items in enumerate(_blocks(benchmark)):

        def run(batches: Iterator[pa.RecordBatch], items=items, name=f"{run_id}-{k}") -> Iterator[pa.RecordBatch]:
            m = _matcher(name, items, rate)
            for b in slices(batches):
                yield b.filter(pa.array([not m.find(t) for t in b.column(columns.index("text")).to_pylist()], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
