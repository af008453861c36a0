"""MinHash signatures with fixed hash functions, LSH candidates, exact Jaccard."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The signature has HASHES functions ((i * i) * u + 5 * (i + 1) + 13) mod users; BANDS bands of two.
HASHES, BANDS = 80, 40


def signatures(rows: DataFrame, users: int) -> DataFrame:
    """(item, sig) from (item, u), u the user's dense index: HASHES minima in one aggregation pass, nothing exploded."""
    u = F.col("u")
    least = [F.min((F.lit(i * i) * u + (5 * (i + 1) + 13)) % users).alias(f"h{i}") for i in range(HASHES)]
    return rows.groupBy("item").agg(*least).select("item", F.array(*(F.col(f"h{i}") for i in range(HASHES))).alias("sig"))


def lsh_candidates(sigs: DataFrame) -> DataFrame:
    """Distinct pairs (a, b), a < b, of items that agree in a whole band."""
    rows = HASHES // BANDS
    bands = F.array(*(F.struct(F.lit(b).alias("band"), F.slice("sig", b * rows + 1, rows).alias("part")) for b in range(BANDS)))
    keyed = sigs.select("item", F.explode(bands).alias("k")).select("item", "k.band", "k.part")
    return keyed.select(F.col("item").alias("a"), "band", "part").join(keyed.select(F.col("item").alias("b"), "band", "part"), ["band", "part"]).where("a < b").select("a", "b").distinct()


def common_counts(rows: DataFrame) -> DataFrame:
    """(a, b, n): for items a < b of (key, item) rows, how many keys hold both; an equi-join on the key."""
    return rows.select("key", F.col("item").alias("a")).join(rows.select("key", F.col("item").alias("b")), "key").where("a < b").groupBy("a", "b").agg(F.count("*").alias("n"))


def jaccard(rows: DataFrame, least: float, candidates: DataFrame | None = None) -> DataFrame:
    """(a, b, similarity) of item pairs with a Jaccard similarity of `least` or more, among candidates if given.

    Candidates are joined with the keys of a, then with (b, key), so only their own keys are counted.
    """
    sizes = rows.groupBy("item").agg(F.count("*").alias("size"))
    if candidates is None:
        pairs = common_counts(rows)
    else:
        held = candidates.join(rows.select(F.col("item").alias("a"), "key"), "a")
        pairs = held.join(rows.select(F.col("item").alias("b"), "key"), ["b", "key"]).groupBy("a", "b").agg(F.count("*").alias("n"))
    pairs = pairs.join(sizes.select(F.col("item").alias("a"), F.col("size").alias("na")), "a").join(sizes.select(F.col("item").alias("b"), F.col("size").alias("nb")), "b")
    s = F.col("n") / (F.col("na") + F.col("nb") - F.col("n"))
    return pairs.select("a", "b", F.round(s, 8).alias("similarity")).where(F.col("similarity") >= least)
