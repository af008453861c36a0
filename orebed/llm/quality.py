"""Quality rules: counting rules first, then a likelihood ratio of hashed n-grams, as DataFrame expressions.

Two multinomials over hashed n-grams (words, and the character trigrams that end them) are fitted: one on
trusted documents, one on the whole corpus. A document's score is the mean over its n-grams of
log(trusted / corpus); documents below a threshold that nearly all other trusted documents pass are not kept.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orebed.llm.common import ASCII_SPACE, constant_array, let, positions, table
from orebed.storage import materialize

#: Hash buckets of the n-grams; the model is one array of this size.
BUCKETS = 1 << 14

#: At most half this many trusted documents (of every other one, those of the smallest id hashes) fit the trusted multinomial; their ids are broadcast. All the rest set the threshold.
TRUSTED = 20_000

#: Added to every count, so that rare buckets say little.
SMOOTHING = 5

#: The threshold passes this share of the trusted documents that set it; scores are told apart to STEP.
PASS_SHARE, STEP = 0.995, 0.01

#: The threshold lies this much (nats an n-gram) lower still, so that clean documents of rarer kinds stay.
MARGIN = 0.25

#: Fixed values of the rules: least words, and the highest share (percent) of words in repeated windows of WINDOW words.
MIN_WORDS, MAX_REPEATED, WINDOW = 10, 20, 5

SYMBOLS = "#*$%&|<>"


def words(text: Column) -> Column:
    """The words of a text; none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), f"[{ASCII_SPACE}]+"), lambda w: w != "")


def dup_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: x.rlike(f"[^{ASCII_SPACE}]"))
    return let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))


def repeated_words(hashes: Column) -> Column:
    """Words that lie in a window of WINDOW words found twice or more, from the words' 64-bit hashes.

    Windows are compared by a 64-bit hash. Most texts repeat none, which a distinct count tells; in the others
    the windows are sorted, equal neighbours marked, and the marked places' coverage added up: n log n at most.
    """

    def covered(grams: Column) -> Column:
        placed = F.array_sort(F.transform(grams, lambda g, i: F.struct(g.alias("g"), i.alias("i"))))

        def marked(s: Column) -> Column:
            same = lambda x, j: F.coalesce(F.get(s, j).g == x.g, F.lit(False))
            return F.array_sort(F.transform(F.filter(s, lambda x, k: same(x, k - 1) | same(x, k + 1)), lambda x: x.i))

        def total(at: Column) -> Column:
            start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-WINDOW).alias("last"))
            step = lambda a, i: F.struct((a.n + F.least(F.lit(WINDOW), i - a.last)).alias("n"), i.alias("last"))
            return F.aggregate(at, start, step).n

        return let(let(placed, marked), total)

    grams = F.transform(positions(F.size(hashes) - (WINDOW - 1)), lambda i: F.xxhash64(*(F.get(hashes, i + j) for j in range(WINDOW))))
    return let(grams, lambda g: F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0).cast("long")).otherwise(covered(g)))


def buckets(w: Column) -> Column:
    """Hash buckets of the words' n-grams: each word, and the three characters that end it."""
    bucket = lambda *x: F.pmod(F.xxhash64(*x), F.lit(BUCKETS)).cast("int")
    return F.concat(F.transform(w, lambda x: bucket(x)), F.transform(w, lambda x: bucket(F.lit("end"), F.right(x, F.lit(3)))))


def trusted_ids(labels: DataFrame) -> DataFrame:
    """doc_id of every document labelled of good quality, and never of bad."""
    return labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("q")).where("q = 1").select("doc_id")


def fitting_ids(labels: DataFrame) -> DataFrame:
    """doc_id of the trusted documents that fit the model, at most TRUSTED / 2."""
    half = trusted_ids(labels).where(F.pmod(F.xxhash64(F.lit("fit"), "doc_id"), F.lit(2)) == 0)
    return half.orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRUSTED // 2)


def setting_ids(labels: DataFrame) -> DataFrame:
    """doc_id of the trusted documents that set the threshold: all that don't fit the model."""
    return trusted_ids(labels).join(F.broadcast(fitting_ids(labels)), "doc_id", "left_anti")


def fit(docs: DataFrame, labels: DataFrame) -> list[float]:
    """log(trusted / corpus) of every bucket, smoothed; the corpus counts cover all documents."""
    marked = docs.select("doc_id", "text").join(F.broadcast(fitting_ids(labels).withColumn("fits", F.lit(True))), "doc_id", "left")
    grams = marked.select("fits", F.explode(let(words(F.col("text")), buckets)).alias("b"))
    counts = grams.groupBy("b").agg(F.count("*").alias("raw"), F.count_if("fits").alias("good")).collect()
    raw, good = [SMOOTHING] * BUCKETS, [SMOOTHING] * BUCKETS
    for b, r, g in counts:  # BUCKETS rows at most
        raw[b], good[b] = r + SMOOTHING, g + SMOOTHING
    if sum(good) == SMOOTHING * BUCKETS:
        return [0.0] * BUCKETS
    shift = math.log(sum(raw)) - math.log(sum(good))
    return [round(math.log(g) - math.log(r) + shift, 6) for r, g in zip(raw, good, strict=True)]


def measure(docs: DataFrame, model: list[float]) -> DataFrame:
    """doc_id, n_words, the base counts, base_failed and score (null without words); one row a document."""
    llr = constant_array(model)
    d = docs.select("doc_id", "text", words(F.col("text")).alias("w"))

    def row(w: Column) -> Column:
        mean = F.aggregate(buckets(w), F.lit(0.0), lambda s, i: s + F.get(llr, i)) / F.greatest(F.lit(1), 2 * F.size(w))
        repeated = let(F.transform(w, lambda x: F.xxhash64(x)), repeated_words)
        return F.struct(F.size(w).cast("long").alias("n"), F.length(F.array_join(w, "")).cast("long").alias("chars"), repeated.alias("repeated"), F.when(F.size(w) > 0, F.round(mean, 6)).alias("score"))

    text = F.coalesce("text", F.lit(""))
    symbols = F.length(text) - F.length(F.regexp_replace(text, f"[{SYMBOLS}]", ""))
    d = d.select("doc_id", let(F.col("w"), row).alias("r"), symbols.cast("long").alias("n_symbols"), dup_lines(F.col("text")).alias("n_dup_lines"))
    d = d.select("doc_id", F.col("r.n").alias("n_words"), F.col("r.chars").alias("word_chars"), "n_symbols", "n_dup_lines", F.col("r.repeated").alias("n_repeat_words"), F.col("r.score").alias("score"))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))
    return d.withColumn("base_failed", failed)


def threshold(measured: DataFrame) -> float:
    """MARGIN below the highest multiple of STEP that PASS_SHARE of the scores of the measured documents reach; -inf without any."""
    seen = measured.where("NOT base_failed")
    bins = seen.groupBy(F.floor(F.col("score") / STEP).alias("bin")).agg(F.count("*").alias("n")).orderBy("bin").collect()
    left = (1 - PASS_SHARE) * sum(n for _, n in bins)
    for at, n in bins:
        left -= n
        if left < 0:
            return at * STEP - MARGIN
    return float("-inf")


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per document: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, score.

    A null text has no words and fails the rules, as does an empty one; repeated rows are judged alike and all
    returned; a null doc_id is judged but never trusted. Without labels nothing is dropped by the ratio. Other
    columns are ignored. Long texts are read whole; the counts of the corpus cover every document.
    """
    model = fit(docs, labels)
    measured = materialize(measure(docs, model), "measured")  # small rows: the texts themselves meet no join
    least = threshold(measured.join(setting_ids(labels), "doc_id", "left_semi"))
    kept = ~F.col("base_failed") & (F.col("score") >= least)
    return measured.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), "score")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
