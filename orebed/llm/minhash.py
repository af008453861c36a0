"""MinHash near-duplicates of documents on word shingles, with b-bit signatures.

Exact copies (equal shingle sets) are folded first, so each different set is signed, banded and compared
once. Bands give candidates, two low bits of the minima estimate their similarity by bit counts, corrected for
chance collisions, and every link is confirmed on the whole shingle sets.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orebed.llm.common import kept, slices, table
from orebed.llm.linkage import DEALT, Dealer, estimate, link, pack, partitions, signatures
from orebed.storage import materialize

#: Words of a shingle; bands and rows a band (a pair of similarity 0.8 is missed five times in a million); minima kept as b bits.
SHINGLE, BANDS, ROWS, PACKED = 5, 40, 6, 96

#: Percent of similarity that links by default, and how far (of 1) a b-bit estimate may fall short: five standard errors.
PERCENT, SLACK = 80, 0.22

#: Word hashes that a worker keeps.
CACHED_WORDS = 1 << 17

_rng = np.random.default_rng(5)
_XOR = _rng.integers(0, 1 << 32, (BANDS * ROWS, 1), dtype=np.uint32)
_ODD = _rng.integers(0, 1 << 31, (BANDS * ROWS, 1), dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_MIX = np.uint64(0xFF51AFD7ED558CCD)
_STEP = np.uint64(0x9E3779B97F4A7C15)


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(self) < CACHED_WORDS:
            self[word] = h
        return h


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * _MIX
    return h ^ (h >> np.uint64(29))


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles: words of lower-cased A-Z, the whole sequence if it is short."""
    if not text:
        return np.empty(0, np.uint64)
    words = text.encode("utf-8", "surrogatepass").lower().split()  # both ASCII only
    h = np.fromiter(map(kept("words", _Words).__getitem__, words), np.uint64, len(words))
    if not len(h):
        return h
    n = min(SHINGLE, len(h))
    out = np.full(len(h) - n + 1, n, np.uint64)
    for j in range(n):
        out = mix(out * _STEP + h[j : len(h) - n + 1 + j])
    return np.unique(out)


def minima(h: np.ndarray) -> np.ndarray:
    """The BANDS * ROWS minima of a shingle set."""
    x, best = (h >> np.uint64(32)).astype(np.uint32), np.full(BANDS * ROWS, 0xFFFFFFFF, np.uint32)
    for lo in range(0, len(x), 2048):
        y = (x[None, lo : lo + 2048] ^ _XOR) * _ODD
        best = np.minimum(best, (y ^ (y >> np.uint32(15))).min(axis=1))
    return best


def band_keys(m: np.ndarray) -> np.ndarray:
    h = np.arange(BANDS, dtype=np.uint64)
    for j in range(ROWS):
        h = mix(h * _STEP + m.reshape(BANDS, ROWS)[:, j])
    return h


SIGNED = "doc_id long, n long, p long, q long, bands binary, sig binary"


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches):
        n, one, two, bands, sig = [], [], [], [], []
        for text in b.column(1).to_pylist():
            s = shingles(text)
            m = minima(s) if len(s) else None
            n.append(len(s))
            one.append(int(s.sum(dtype=np.uint64).astype(np.int64)))
            two.append(int(np.bitwise_xor.reduce(mix(s)).astype(np.int64)) if len(s) else 0)
            bands.append(None if m is None else band_keys(m).tobytes())
            sig.append(None if m is None else pack(m[:PACKED]).tobytes())
        yield pa.RecordBatch.from_pydict({"doc_id": b.column(0), "n": pa.array(n, pa.int64()), "p": pa.array(one, pa.int64()), "q": pa.array(two, pa.int64()), "bands": pa.array(bands, pa.binary()), "sig": pa.array(sig, pa.binary())})


def _deal(count: int, least: float) -> Callable:
    """DEALT rows of (doc_id, bands, sig)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dealer = Dealer(count, PACKED // 32, least, estimate)
        for b in batches:
            if b.num_rows:
                yield from dealer.add(signatures(b.column(1)), b.column(0).to_numpy(zero_copy_only=False), signatures(b.column(2)))
        yield from dealer.flush()

    return run


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """One row a row of docs: doc_id, n_shingles, component_id, kept.

    Texts are linked where 100 * |intersection| >= percent * |union| of their shingle sets; component_id is the
    smallest doc_id reachable and kept tells whether it is the row's own. Null, empty and wordless texts have no
    shingles and are linked with nothing; so are rows with a null doc_id, whose component_id is null and which
    are kept. Rows that repeat a doc_id are one document; if their texts differ, the smallest text is the one
    that is compared. Whole texts are read; other columns are ignored; an empty table gives no rows.
    """
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    least = percent / 100 - SLACK
    signed = materialize(docs.mapInArrow(_sign, SIGNED), "signed")
    real = signed.where("n > 0 AND doc_id IS NOT NULL")
    sets = materialize(real.groupBy("n", "p", "q").agg(F.min("doc_id").alias("rep")), "sets")
    # rows of one id and one set have equal bands; texts that differ under one id are settled by `texts`
    first = real.select("doc_id", "n", "p", "q", "bands", "sig").join(sets.withColumnRenamed("rep", "doc_id"), ["n", "p", "q", "doc_id"], "left_semi")

    def texts(ids: DataFrame) -> DataFrame:
        found = docs.join(ids.withColumnRenamed("id", "doc_id").hint("merge"), "doc_id", "left_semi")
        return found.groupBy("doc_id").agg(F.min("text").alias("text")).withColumnRenamed("doc_id", "id")

    def similar(a: np.ndarray, b: np.ndarray) -> bool:
        both = len(np.intersect1d(a, b, assume_unique=True))
        return 100 * both >= percent * (len(a) + len(b) - both)

    found = link(first.select("doc_id", "bands", "sig").mapInArrow(_deal(partitions(docs), least), DEALT), texts, shingles, similar, least, PACKED // 32)
    sets = sets.join(found.withColumnRenamed("id", "rep"), "rep", "left").select("n", "p", "q", F.coalesce("component", "rep").alias("component_id"))
    out = signed.select("doc_id", "n", "p", "q").join(sets, ["n", "p", "q"], "left")
    out = out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.when(F.col("doc_id").isNotNull(), F.col("component_id"))).otherwise(F.col("doc_id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep_one(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The documents but for those that a near duplicate of a smaller doc_id stands for; all columns stay."""
    gone = near_duplicates(docs, percent).where("NOT kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), percent=85)


#: Every pair of documents that share a shingle, their exact similarity, and who is reachable by links.
OP10_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, 1 + greatest(len(w) - 4, least(len(w), 1)))) AS i FROM words)
), sizes AS (
  SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n_shared FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * n_shared >= 85 * (x.n + y.n - n_shared)
), reach AS (
  SELECT doc_id, doc_id AS other FROM documents
  UNION
  SELECT r.doc_id, l.b FROM reach r JOIN (SELECT a, b FROM links UNION SELECT b, a FROM links) l ON l.a = r.other
)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept
FROM (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id) LEFT JOIN sizes USING (doc_id)
"""
