"""Language identification by hyperdimensional profiles.

Each letter has a random bipolar vector. A trigram's vector binds (multiplies) its letters' vectors, each
permuted (rolled) by its place; a text's profile bundles (adds) the vectors of its trigrams; a language's
prototype bundles the profiles of its training documents. A text gets the language of the largest cosine.

Bundles are linear in the n-grams: prototypes are made from n-grams' summed weights, and a text's product with
them is the weighted sum of its n-grams' products, which a worker keeps. So the work a text is its n-grams',
whatever the dimensions. A profile's length is taken as that of independent n-gram vectors.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orebed.llm.common import kept, slices, table

#: Dimensions of the vectors, letters of an n-gram, seed of the letters' vectors.
DIMENSIONS, SIZE, SEED = 4096, 3, 20240229

#: Distinct n-grams whose products a worker keeps, letters whose vectors it keeps (beyond it they start anew), n-grams
#: whose vectors it makes at once, and n-grams of texts that it holds before it adds up their weights.
TABLE_ROWS, LETTERS, SLICE, PENDING = 1 << 15, 1 << 14, 1 << 10, 1 << 20

#: Share of labelled documents whose scores may lie below what counts as a known language; steps of scores;
#: standard deviations of a chance cosine that the least score is above in any case.
LOST, STEP, CHANCE = 0.002, 0.001, 5

UNKNOWN = "und"


def _symbols() -> np.ndarray:
    """For each code point the letter that stands for it (lower case), or a space for what is no letter."""
    out = np.full(0x110000, 32, np.uint32)
    for c in range(0x110000):
        if (ch := chr(c)).isalpha():
            low = ch.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


class Profiler:
    """Counts n-grams of texts and bundles their vectors; one a worker process."""

    def __init__(self) -> None:
        self.symbols = _symbols()
        self.letters: dict[int, np.ndarray] = {}

    def letter(self, c: int) -> np.ndarray:
        if c not in self.letters:
            if len(self.letters) >= LETTERS:
                self.letters.clear()
            self.letters[c] = np.random.default_rng([SEED, c]).integers(0, 2, DIMENSIONS).astype(np.int8) * 2 - 1
        return self.letters[c]

    def gram(self, code: int) -> np.ndarray:
        return self.vectors(np.array([code], np.uint64))[0]

    def vectors(self, codes: np.ndarray) -> np.ndarray:
        """(codes, DIMENSIONS) float32: the n-grams' vectors."""
        out = np.ones((len(codes), DIMENSIONS), np.int8)
        for place in range(SIZE):
            letters, at = np.unique(codes >> np.uint64(21 * (SIZE - 1 - place)) & np.uint64(0x1FFFFF), return_inverse=True)
            out *= np.stack([np.roll(self.letter(int(c)), place) for c in letters])[at]
        return out.astype(np.float32)

    def grams(self, text: str) -> tuple[np.ndarray, np.ndarray] | None:
        """Distinct n-grams and their counts; None for a text without a letter."""
        s = self.symbols[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
        s = np.concatenate(([32], s, [32]))
        s = s[~((s == 32) & (np.concatenate(([0], s[:-1])) == 32))].astype(np.uint64)
        if len(s) < SIZE:
            return None
        code = np.zeros(len(s) - SIZE + 1, np.uint64)
        for place in range(SIZE):
            code = (code << np.uint64(21)) | s[place : len(s) - SIZE + 1 + place]
        return np.unique(code, return_counts=True)

    def bundle(self, codes: np.ndarray, weights: np.ndarray) -> np.ndarray:
        total = np.zeros(DIMENSIONS)
        for lo in range(0, len(codes), SLICE):
            total += weights[lo : lo + SLICE].astype(np.float32) @ self.vectors(codes[lo : lo + SLICE])
        return total

    def profile(self, codes: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """The bundle of n-grams, each weighted by the root of its count so that no single one rules."""
        return self.bundle(codes, np.sqrt(counts))


class Scorer:
    """Cosines of texts' profiles with the prototypes, from the n-grams' products with them."""

    def __init__(self, p: Profiler, protos: np.ndarray) -> None:
        self.p, self.protos = p, protos
        self._reset()

    def _reset(self) -> None:
        self.codes, self.products = np.empty(0, np.uint64), np.empty((0, len(self.protos)), np.float32)

    def _product(self, part: np.ndarray) -> np.ndarray:
        """(part, languages) products of sorted distinct n-grams, no more than half a table."""
        at = np.searchsorted(self.codes, part)
        new = part[self.codes[np.minimum(at, len(self.codes) - 1)] != part] if len(self.codes) else part
        if len(new):
            if len(self.codes) + len(new) > TABLE_ROWS:
                self._reset()
                new = part
            got = [self.p.vectors(new[lo : lo + SLICE]) @ self.protos.T for lo in range(0, len(new), SLICE)]
            known, products = np.concatenate((self.codes, new)), np.concatenate((self.products, *got))
            order = np.argsort(known)
            self.codes, self.products = known[order], products[order]
            at = np.searchsorted(self.codes, part)
        return self.products[at]

    def cosines(self, codes: np.ndarray, counts: np.ndarray) -> np.ndarray:
        total, half = np.zeros(len(self.protos)), TABLE_ROWS // 2
        for lo in range(0, len(codes), half):
            total += np.sqrt(counts[lo : lo + half]) @ self._product(codes[lo : lo + half])
        return total / np.sqrt(float(counts.sum()) * DIMENSIONS)


def profiler() -> Profiler:
    return kept("profiler", Profiler)


def held_out(doc_id: int | None) -> bool:
    """Whether a document is kept from training: crc32 of its id as text, modulo 4, is 2."""
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 4 == 2


def labelled(docs: DataFrame) -> DataFrame:
    return docs.where("lang IS NOT NULL AND text IS NOT NULL")


def taught(docs: DataFrame) -> DataFrame:
    """The rows that train: labelled, with a text, not held out."""
    return labelled(docs).where((F.crc32(F.col("doc_id").cast("string")) % 4 != 2) | F.col("doc_id").isNull())


def train(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages in order and their prototypes (unit vectors) from all labelled documents.

    Each task sends one vector of sums a language; Spark adds these by dimension. Rows with a null lang or
    text, or texts without a letter, teach nothing. Documents of one language weigh alike, however long.
    """

    def bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, sums, held, size = profiler(), {}, {}, 0

        def add() -> None:
            for lang, parts in held.items():
                codes, at = np.unique(np.concatenate([c for c, _ in parts]), return_inverse=True)
                sums[lang] = sums.get(lang, 0) + p.bundle(codes, np.bincount(at, np.concatenate([w for _, w in parts])))
            held.clear()

        for b in slices(batches):
            for text, lang in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if (g := p.grams(text)) is not None:
                    held.setdefault(lang, []).append((g[0], np.sqrt(g[1] / (float(g[1].sum()) * DIMENSIONS))))
                    size += len(g[0])
                    if size > PENDING:
                        add()
                        size = 0
        add()
        for lang, v in sums.items():
            yield pa.RecordBatch.from_pydict({"lang": [lang], "v": [np.round(v * 2**20).astype(np.int64).tolist()]})

    sums = taught(docs).select("text", "lang").mapInArrow(bundle, "lang string, v array<long>")
    sums = sums.select("lang", F.posexplode("v").alias("d", "x")).groupBy("lang", "d").agg(F.sum("x").alias("x"))
    got = sums.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("d", "x"))).alias("v")).select("lang", "v.x").orderBy("lang").collect()
    protos = np.array([r[1] for r in got], np.float64).reshape(len(got), DIMENSIONS)
    return [r[0] for r in got], (protos / np.maximum(np.linalg.norm(protos, axis=1, keepdims=True), 1e-9)).astype(np.float32)


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray]) -> DataFrame:
    """Per row: doc_id, held_out, lang_pred, score.

    lang_pred is `und` with score 0 for a null text, one without a letter, or a model without languages; ties
    go to the first language in order. score is the cosine, at least 0. Texts are read whole. Other columns
    are ignored, repeated rows get equal results, an empty table none; held_out is false for a null doc_id.
    """
    langs, protos = model

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = profiler()
        scorer = Scorer(p, protos)
        for b in slices(batches):
            ids, out, scores = b.column(0).to_pylist(), [], []
            for text in b.column(1).to_pylist():
                g = p.grams(text) if text and langs else None
                if g is None:
                    out.append(UNKNOWN)
                    scores.append(0.0)
                    continue
                cos = scorer.cosines(*g)
                k = int(np.argmax(np.round(cos, 6)))
                out.append(langs[k])
                scores.append(min(1.0, max(0.0, round(float(cos[k]), 6))))
            yield pa.RecordBatch.from_pydict({"doc_id": pa.array(ids, pa.int64()), "held_out": pa.array([held_out(i) for i in ids], pa.bool_()), "lang_pred": pa.array(out, pa.string()), "score": pa.array(scores, pa.float64())})

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def least_score(docs: DataFrame, model: tuple[list[str], np.ndarray], lost: float = LOST) -> float:
    """The score that all but a share of `lost` of the labelled documents reach, to STEP; never one of mere chance.

    Held-out documents count too: those that trained score higher than new ones, the more so the fewer there are.
    """
    scores = predict(labelled(docs), model).where(F.col("lang_pred") != UNKNOWN).select(F.floor(F.col("score") / STEP).alias("bin"))
    left = 0
    bins = scores.groupBy("bin").agg(F.count("*").alias("n")).orderBy("bin").collect()  # 1 / STEP rows at most
    least = CHANCE / DIMENSIONS**0.5
    for at, n in bins:
        left += n
        if left > lost * sum(n for _, n in bins):
            return max(least, at * STEP)
    return least


def keep_known(docs: DataFrame, lost: float = LOST) -> DataFrame:
    """The documents whose language is known: those with a letter and a score that labelled documents reach.

    The least score is that which all but a share of `lost` of them reach. All columns and repeated rows stay;
    rows with a null doc_id are judged by their text as well.
    """
    model = train(docs)
    least = least_score(docs, model, lost)
    columns = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, (langs, protos) = profiler(), model
        scorer = Scorer(p, protos)
        for b in slices(batches):
            keep = []
            for text in b.column(columns.index("text")).to_pylist():
                g = p.grams(text) if text and langs else None
                keep.append(g is not None and float(scorer.cosines(*g).max()) >= least)
            yield b.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return predict(docs, train(docs))
