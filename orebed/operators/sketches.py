"""Stream sketches as relations: Bloom filter, Flajolet-Martin, reservoir, repeatable samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orebed.functions.text import trailing_zeros, utf8_mod
from orebed.operators.relational import arithmetic_hash, dense_index, numbered

#: Coefficients (a, b) of the affine hash functions, bits of the Bloom filter, and the sketch's prime and range.
AFFINE = [(913, 14), (387, 471), (24, 552), (751, 38), (597, 819), (101, 67), (433, 229), (883, 907), (71, 353), (229, 541), (659, 13), (337, 701), (47, 89), (811, 17), (503, 611), (173, 251)]
BLOOM_HASHES, BLOOM_BITS = 5, 20011
PRIME, RANGE = 24593, 65536

#: Slots of the reservoir and those that are reported.
SLOTS, REPORTED = 100, [0, 20, 40, 60, 80]


def batches(stream: DataFrame, order: str, size: int) -> DataFrame:
    """The stream with `seq` (0-based, in order) and `batch`, a tumbling window of `size` rows."""
    return stream.join(dense_index(stream, order).withColumnRenamed("index", "seq"), order).withColumn("batch", F.floor(F.col("seq") / size))


def affine(text: Column, k: int, modulus: int) -> Column:
    a, b = AFFINE[k]
    return (utf8_mod(text, modulus) * (a % modulus) + b) % modulus


def bloom_fpr(stream: DataFrame, bits: int = BLOOM_BITS) -> DataFrame:
    """(batch, fp, tn, fpr) from (seq, batch, id), state kept over batches.

    A bit counts as set if an earlier hash set it, of an earlier row or of the same one; an id is new at its
    first row. Minima of places replace the running bit array, so no order of execution matters.
    """
    hashed = F.explode(F.array(*(F.struct(F.lit(k).alias("k"), affine(F.col("id"), k, bits).alias("bit")) for k in range(BLOOM_HASHES))))
    h = stream.select("seq", "batch", "id", hashed.alias("h")).select("seq", "batch", "id", "h.bit", (F.col("seq") * BLOOM_HASHES + F.col("h.k")).alias("place"))
    first_set = h.groupBy("bit").agg(F.min("place").alias("first"))
    flags = h.join(first_set, "bit").groupBy("seq", "batch", "id").agg(F.bool_and(F.col("first") < F.col("place")).alias("hit"))
    new = stream.groupBy("id").agg(F.min("seq").alias("debut"))
    f = flags.join(new, "id").where("seq = debut")
    counts = f.groupBy("batch").agg(F.count_if("hit").alias("fp"), F.count_if(~F.col("hit")).alias("tn"))
    every = stream.select("batch").distinct().join(counts, "batch", "left").select("batch", F.coalesce("fp", F.lit(0).cast("long")).alias("fp"), F.coalesce("tn", F.lit(0).cast("long")).alias("tn"))
    return every.withColumn("fpr", F.when(F.col("fp") + F.col("tn") > 0, F.round(F.col("fp") / (F.col("fp") + F.col("tn")), 8)).otherwise(0.0))


def fm_estimate(stream: DataFrame, intended: bool = False) -> DataFrame:
    """(batch, truth, estimate) from (batch, id): Flajolet-Martin with sixteen hashes, in one aggregation pass.

    Twelve groups by default, the first four hashes and the eleven next alone, the last unused; `intended`
    takes four groups of four. The estimate is the median of the groups' means, cut to an integer.
    """
    x = utf8_mod(F.col("id"), PRIME)
    rows = stream.select("batch", "id", x.alias("x"))
    most = [F.max(trailing_zeros((F.col("x") * a + b) % PRIME % RANGE)).alias(f"r{k}") for k, (a, b) in enumerate(AFFINE)]
    g = rows.groupBy("batch").agg(F.count_distinct("id").alias("truth"), *most)
    est = [F.pow(F.lit(2.0), F.col(f"r{k}")) for k in range(len(AFFINE))]
    mean4 = lambda i: (est[i] + est[i + 1] + est[i + 2] + est[i + 3]) / 4
    groups = F.array_sort(F.array(*([mean4(i) for i in range(0, 16, 4)] if intended else [mean4(0), *est[4:15]])))
    half = 2 if intended else 6
    return g.select("batch", "truth", F.floor((F.get(groups, half - 1) + F.get(groups, half)) / 2).cast("long").alias("estimate"))


def reservoir(stream: DataFrame, slots: int = SLOTS, reported: list[int] = REPORTED) -> DataFrame:
    """(batch, slot, id) of the reported slots after each batch, from (seq, batch, id).

    The first `slots` rows fill the reservoir; row number s then replaces slot h(s) mod s if that is a slot, h
    an arithmetic hash in place of a random number, so that every engine and every retry gives the same.
    """
    s = F.col("seq") + 1
    slot = F.when(F.col("seq") < slots, F.col("seq")).otherwise(F.pmod(arithmetic_hash(F.col("seq"), 553), s))
    wrote = stream.withColumn("slot", slot).where(F.col("slot").isin(reported)).groupBy("batch", "slot").agg(F.max_by("id", "seq").alias("id"))
    grid = stream.select("batch").distinct().withColumn("slot", F.explode(F.array(*(F.lit(r).cast("long") for r in reported))))
    w = Window.partitionBy("slot").orderBy("batch").rowsBetween(Window.unboundedPreceding, 0)
    return grid.join(wrote, ["batch", "slot"], "left").withColumn("id", F.last("id", ignorenulls=True).over(w))


def exact_sample(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """n rows of df (fewer if there are fewer), those of the smallest hashes of their integer key, by rank over range partitions."""
    rows = numbered(df.withColumn("_hash", arithmetic_hash(F.col(key), seed)), ["_hash", key], name="_rank")
    return rows.where(F.col("_rank") < n).drop("_hash", "_rank")
