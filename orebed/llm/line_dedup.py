"""Fuzzy line dedup: MinHash over character shingles, exact Jaccard verification, union-find, one line a component.

Equal lines are folded first. The signatures are one-permutation MinHash: each shingle's hash falls into one
bin and the bin keeps the least; an empty bin takes the value of another, picked by a fixed random order of
its own, so that the bins of a band do not borrow from the same shingle. A batch of lines is signed by a few
array operations on all its characters at once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orebed.llm.common import slices, table
from orebed.llm.idfilter import id_bits, may_hold
from orebed.llm.linkage import DEALT, Dealer, link, partitions
from orebed.llm.minhash import mix
from orebed.storage import materialize

#: Characters of a shingle; bands and rows a band over the bins (of pairs of similarity 0.8, 8 in a thousand share no band; at 0.85, 5 in ten thousand).
SHINGLE, BANDS, ROWS = 5, 16, 6
BINS = BANDS * ROWS

#: Percent of similarity that links, and how far (of 1) a long line's estimate by one-bit minima may fall short: four standard errors.
PERCENT, SLACK = 80, 0.38

#: A line's sketch is one word. Up to SHORT shingles: how many they are (from bit MAP on) and a map of MAP bits of
#: them; beyond: the top bit, and ONE_BIT low bits of minima.
SHORT, MAP, ONE_BIT = 64, 56, 63

#: Characters signed together, about, lines of texts held together, and hashes of lines that a task remembers as signed already.
CHARACTERS, REMEMBERED = 1 << 16, 1 << 18

#: Picks that an empty bin tries before it takes the next full bin.
PICKS = 24

_MUL = np.uint64(0x9E3779B97F4A7C15)
_MUL2 = np.uint64(0x9E3779B97F4A7C15**2 & 0xFFFFFFFFFFFFFFFF)
_FILL = np.uint32(0x9E3779B1)
_TOP = np.uint64(1 << 63)
_order = np.argsort(np.random.default_rng(11).random((PICKS, BINS)), axis=1)


def normal(line: str) -> str:
    """A line as it is compared: lower case, white space runs as one space, none at the ends."""
    return " ".join(line.lower().split())


def _windows(lines: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the character shingles of many lines, each one's line, and how many a line has; a short line is one shingle."""
    padded = [x if len(x) >= SHINGLE else x.ljust(SHINGLE, "\0") for x in lines]
    code = np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    sizes = np.fromiter(map(len, padded), np.int64, len(padded))
    two = code[:-1] * _MUL + code[1:]
    four = two[:-2] * _MUL2 + two[2:]
    h = four[:-1] * _MUL + code[4:]
    inside = np.ones(len(code), bool)
    ends = np.cumsum(sizes)
    inside[(ends[:, None] - np.arange(1, SHINGLE)).ravel()] = False
    return mix(h[inside[: len(h)]]), np.repeat(np.arange(len(lines)), sizes - (SHINGLE - 1)), sizes - (SHINGLE - 1)


def shingles(line: str) -> np.ndarray:
    """Sorted distinct shingle hashes of one normal line."""
    return np.unique(_windows([line])[0])


def _signatures(h: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """(n, BINS) uint32 minima; empty bins filled."""
    empty = np.uint32(0xFFFFFFFF)
    bins = ((h >> np.uint64(32)) * np.uint64(BINS) >> np.uint64(32)).astype(np.int64)
    own = np.full(n * BINS, empty, np.uint32)
    np.minimum.at(own, owner * BINS + bins, h.astype(np.uint32))
    own = own.reshape(n, BINS)
    out = own.copy()
    row, at = np.nonzero(own == empty)
    for pick in range(PICKS):
        if not len(row):
            break
        got = own[row, _order[pick, at]]
        full = got != empty
        out[row[full], at[full]] = got[full] + _FILL
        row, at = row[~full], at[~full]
    if len(row):  # lines of very few shingles: the next full bin
        rows, back = np.unique(row, return_inverse=True)
        twice = np.concatenate((own[rows], own[rows]), axis=1)
        next_full = np.minimum.accumulate(np.where(twice != empty, np.arange(2 * BINS), 2 * BINS)[:, ::-1], axis=1)[:, ::-1]
        out[row, at] = own[row, next_full[back, at] % BINS] + _FILL
    return out


def sign(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(lines, BANDS) keys and (lines, 1) sketches, both uint64, of normal, non-empty lines."""
    h, owner, sizes = _windows(lines)
    m = _signatures(h, owner, len(lines))
    short = sizes <= SHORT
    held = np.zeros((len(lines), 64), bool)
    few = short[owner]
    held[owner[few], ((h[few] & np.uint64(0xFFFF)) * np.uint64(MAP) >> np.uint64(16)).astype(np.int64)] = True
    held[~short, :ONE_BIT] = m[~short, :ONE_BIT] & 1
    sketch = np.packbits(held, axis=1, bitorder="little").view("<u8")[:, 0].astype(np.uint64)
    sketch |= np.where(short, sizes.astype(np.uint64) << np.uint64(MAP), _TOP)
    keys = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), (len(lines), BANDS))
    bands = m.reshape(len(lines), BANDS, ROWS).astype(np.uint64)
    for j in range(0, ROWS, 2):
        keys = mix(keys * _MUL + (bands[:, :, j] << np.uint64(32) | bands[:, :, j + 1]))
    return keys, sketch[:, None]


def most_similar(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How similar lines may be at most, from their sketches.

    Short lines: every bit that only one map has is a shingle that only one line has, so of s shingles in both
    lines with d such bits the Jaccard similarity is (s - d) / (s + d) at most; this bound is never too low. Long
    lines: the one-bit estimate and its slack. A short line and a long one: 1, so that they are always tested.
    """
    a, b = a[..., 0], b[..., 0]
    x, low = a ^ b, np.uint64((1 << MAP) - 1)
    d = np.bitwise_count(x & low).astype(np.float64)
    s = ((a >> np.uint64(MAP)).astype(np.int64) & 127) + ((b >> np.uint64(MAP)).astype(np.int64) & 127)
    equal = 1 - np.bitwise_count(x & ~_TOP) / ONE_BIT
    long = (a & b & _TOP) != 0
    return np.where(long, 2 * equal - 1 + SLACK, np.where((x & _TOP) != 0, 1.0, (s - d) / np.maximum(s + d, 1)))


def line_id(line: str) -> int:
    """A signed 64-bit hash of a line as it stands."""
    h = xxhash.xxh3_64_intdigest(line.encode("utf-8", "surrogatepass"))
    return h - (1 << 64) if h >> 63 else h


def _dealt(count: int, percent: int) -> Callable:
    """DEALT rows of the lines of texts, each different line once a task as far as it remembers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        dealer = Dealer(count, 1, percent / 100 - 1e-9, most_similar)
        fresh: dict[int, str] = {}
        size = 0

        def add() -> Iterator[pa.RecordBatch]:
            if fresh:
                yield from dealer.add(*sign_all(fresh))
            fresh.clear()

        def sign_all(found: dict[int, str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            keys, sketch = sign(list(found.values()))
            return keys, np.fromiter(found, np.int64, len(found)), sketch

        for part in slices(batches):
            for text in part.column(0).to_pylist():
                for line in text.split("\n"):
                    if not line or (i := line_id(line)) in seen:
                        continue
                    if len(seen) >= REMEMBERED:
                        seen.clear()
                    seen.add(i)
                    if n := normal(line):
                        fresh[i] = n
                        size += len(n)
                        if size >= CHARACTERS:
                            yield from add()
                            size = 0
        yield from add()
        yield from dealer.flush()

    return run


def _texts(bits: np.ndarray) -> Callable:
    """(id, text) of the lines whose id may be among those that made `bits`; each once a task as far as it remembers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for part in slices(batches):
            lines = [x for t in part.column(0).to_pylist() for x in t.split("\n") if x]
            ids = np.fromiter(map(line_id, lines), np.int64, len(lines))
            out: dict[int, str] = {}
            for k in np.flatnonzero(may_hold(bits, ids)).tolist():
                i = int(ids[k])
                if i not in seen and i not in out:
                    out[i] = normal(lines[k])
            if len(seen) >= REMEMBERED:
                seen.clear()
            seen.update(out)
            if out:
                yield pa.RecordBatch.from_pydict({"id": pa.array(out.keys(), pa.int64()), "text": pa.array(out.values(), pa.string())})

    return run


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches):
        at, nos, ids = [], [], []
        for k, text in enumerate(part.column(1).to_pylist()):
            for no, line in enumerate(text.split("\n")):
                if line and not line.isspace():
                    at.append(k)
                    nos.append(no)
                    ids.append(line_id(line))
        yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(at, pa.int64())), pa.array(nos, pa.int32()), pa.array(ids, pa.int64())], ["doc_id", "line_no", "id"])


def lines_of(docs: DataFrame) -> DataFrame:
    """(doc_id, line_no, id) of the lines with a word (some character that is no white space); id is a 64-bit hash of the line."""
    return docs.where("text IS NOT NULL").select(F.col("doc_id").cast("long"), "text").mapInArrow(_places, "doc_id long, line_no int, id long")


def placed_lines(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(doc_id, line_no, component_doc_id, component_line_no, kept) of every line with a word, a row a line of each row of docs.

    Lines are linked where their character shingle sets have a Jaccard similarity of `percent` or more, in lower
    case with white space runs as one space; a component's first line, by doc_id (null first) and line number, is
    kept. Null, empty and blank texts have no lines; rows that repeat a doc_id are one document, so their lines
    of one number share a fate if they are equal; rows with a null doc_id are told apart by line number alone.
    Whole texts are read, other columns are ignored, an empty table gives no rows.
    """
    texts = docs.where("text IS NOT NULL").select("text")

    def needed(ids: DataFrame) -> DataFrame:
        found = texts.mapInArrow(_texts(id_bits(ids)), "id long, text string")
        return found.join(ids.hint("merge"), "id", "left_semi").groupBy("id").agg(F.min("text").alias("text"))

    def similar(a: np.ndarray, b: np.ndarray) -> bool:
        both = len(np.intersect1d(a, b, assume_unique=True))
        return 100 * both >= percent * (len(a) + len(b) - both)

    found = link(texts.mapInArrow(_dealt(partitions(docs), percent), DEALT), needed, shingles, similar, percent / 100 - 1e-9, 1, most_similar)
    placed = materialize(lines_of(docs), "lines")
    firsts = placed.groupBy("id").agg(F.min(F.struct("doc_id", "line_no")).alias("first"), F.count("*").alias("n")).join(found, "id", "left")
    firsts = materialize(firsts.where("n > 1 OR component IS NOT NULL"), "firsts")
    linked = firsts.where("component IS NOT NULL")
    heads = linked.groupBy("component").agg(F.min("first").alias("head"))
    heads = linked.join(heads, "component").select("id", "head").unionByName(firsts.where("component IS NULL").select("id", F.col("first").alias("head")))
    out = placed.join(heads, "id", "left")
    single = F.col("head").isNull()
    of = lambda name: F.when(single, F.col(name)).otherwise(F.col(f"head.{name}")).alias(f"component_{name}")
    kept = single | (F.col("doc_id").eqNullSafe(F.col("head.doc_id")) & (F.col("line_no") == F.col("head.line_no")))
    return out.select("doc_id", "line_no", of("doc_id"), of("line_no"), kept.alias("kept"))


def dedup_lines(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The documents with later lines of every component taken out of `text`; all columns stay.

    Lines without a word are never duplicates and stay where they are. A document of which no line with a word
    is left goes, unless it had none before: null, empty and blank texts stay. Repeated rows of one doc_id are
    treated as one document: they lose the same lines. Rows with a null doc_id stay as they are, though
    their lines count. A column n_chars of a changed text is set anew. An empty table stays empty.
    """
    lost = placed_lines(docs, percent).where("NOT kept AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.collect_set("line_no").alias("_orebed_drop"))
    lost = lost.withColumnRenamed("doc_id", "_orebed_id")
    out = docs.join(lost, docs["doc_id"] == F.col("_orebed_id"), "left").drop("_orebed_id")
    columns = docs.columns
    at, chars = columns.index("text"), columns.index("n_chars") if "n_chars" in columns else None

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            drops = b.column(len(columns)).to_pylist()
            fields = [b.column(k) for k in range(len(columns))]
            text, keep = fields[at].to_pylist(), []
            for k, drop in enumerate(drops):
                if drop is None or text[k] is None:
                    keep.append(True)
                    continue
                gone = set(drop)
                text[k] = "\n".join(x for no, x in enumerate(text[k].split("\n")) if no not in gone)
                keep.append(bool(text[k].strip()))
            fields[at] = pa.array(text, fields[at].type)
            if chars is not None:
                n = fields[chars].to_pylist()
                fields[chars] = pa.array([x if d is None or t is None else len(t) for x, d, t in zip(n, drops, text, strict=True)], fields[chars].type)
            yield pa.RecordBatch.from_arrays(fields, columns).filter(pa.array(keep, pa.bool_()))

    return out.mapInArrow(cut, docs.schema)


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a line with a word: its component's first line, and whether it is that."""
    return placed_lines(table(spark, sf_dir, "documents"))
