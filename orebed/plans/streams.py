"""Count-based batches and sketches over the events in order of event_id."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orebed.operators import sketches as K
from orebed.operators.relational import arithmetic_hash
from orebed.plans.base import query, table
from orebed.streaming import jobs

SIZE = 100


def stream(spark: SparkSession, sf: str) -> DataFrame:
    """(seq, batch, id, user_id): an id is a user and a place."""
    e = table(spark, sf, "events").select("event_id", "user_id", F.concat(F.lit("u"), F.col("user_id").cast("string"), F.lit("-"), F.get_json_object("props", "$.k")).alias("id"))
    return K.batches(e, "event_id", SIZE).select("seq", "batch", "id", "user_id")


_STREAM = f"""s0 AS (SELECT row_number() OVER (ORDER BY event_id) - 1 AS seq, 'u' || user_id || '-' || json_extract_string(props, '$.k') AS id, user_id FROM events),
s AS (SELECT seq, seq // {SIZE} AS batch, id, user_id FROM s0)"""


def _mod(m: int) -> str:
    return f"list_reduce(list_transform(string_split(id, ''), lambda c: CAST(ascii(c) AS BIGINT)), lambda h, b: (h * 256 + b) % {m}, CAST(0 AS BIGINT))"


@query("stream_batches", f"WITH {_STREAM} SELECT batch, count(*) AS n, count(DISTINCT user_id) AS users FROM s GROUP BY 1")
def stream_batches(spark: SparkSession, sf: str) -> DataFrame:
    return stream(spark, sf).groupBy("batch").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"))


_HASHES = ", ".join(f"({_mod(K.BLOOM_BITS)} * {a} + {b}) % {K.BLOOM_BITS} AS h{k}" for k, (a, b) in enumerate(K.AFFINE[: K.BLOOM_HASHES]))


@query("string_hash_mod", f"WITH {_STREAM} SELECT DISTINCT id, {_HASHES} FROM s")
def string_hash_mod(spark: SparkSession, sf: str) -> DataFrame:
    ids = table(spark, sf, "events").select(F.concat(F.lit("u"), F.col("user_id").cast("string"), F.lit("-"), F.get_json_object("props", "$.k")).alias("id")).distinct()
    return ids.select("id", *(K.affine(F.col("id"), k, K.BLOOM_BITS).alias(f"h{k}") for k in range(K.BLOOM_HASHES)))


@query("bloom_fpr", f"""WITH {_STREAM}, hs AS (SELECT seq, batch, id, {_HASHES} FROM s),
h AS (SELECT seq, batch, id, unnest([0, 1, 2, 3, 4]) + seq * 5 AS place, unnest([h0, h1, h2, h3, h4]) AS bit FROM hs),
f AS (SELECT seq, batch, id, min(place) OVER (PARTITION BY bit) < place AS was FROM h),
g AS (SELECT seq, batch, id, bool_and(was) AS hit FROM f GROUP BY ALL), d AS (SELECT id, min(seq) AS debut FROM s GROUP BY 1),
c AS (SELECT batch, count(*) FILTER (WHERE hit) AS fp, count(*) FILTER (WHERE NOT hit) AS tn FROM g JOIN d USING (id) WHERE seq = debut GROUP BY 1)
SELECT b.batch, coalesce(fp, 0) AS fp, coalesce(tn, 0) AS tn, CASE WHEN fp + tn > 0 THEN round(fp / (fp + tn), 8) ELSE 0.0 END AS fpr FROM (SELECT DISTINCT batch FROM s) b LEFT JOIN c USING (batch)""")
def bloom_fpr(spark: SparkSession, sf: str) -> DataFrame:
    return K.bloom_fpr(stream(spark, sf).select("seq", "batch", "id"))


def _fm() -> str:
    zeros = lambda v: f"(length(bin({v})) - length(rtrim(bin({v}), '0')))"
    most = ", ".join(f"pow(2.0, max({zeros(f'(x * {a} + {b}) % {K.PRIME} % {K.RANGE}')})) AS e{k}" for k, (a, b) in enumerate(K.AFFINE))
    return f"""WITH {_STREAM}, x AS (SELECT batch, id, {_mod(K.PRIME)} AS x FROM s), g AS (SELECT batch, count(DISTINCT id) AS truth, {most} FROM x GROUP BY 1)
SELECT batch, truth, CAST(floor(list_median([(e0 + e1 + e2 + e3) / 4, {', '.join(f'e{k}' for k in range(4, 15))}])) AS BIGINT) AS estimate FROM g""".replace("list_median(", "list_aggregate(").replace("])) AS BIGINT", "], 'median')) AS BIGINT")


@query("fm_estimate", _fm())
def fm_estimate(spark: SparkSession, sf: str) -> DataFrame:
    return K.fm_estimate(stream(spark, sf).select("batch", "id"))


_HASH = "((({0} % 1000003) * 7919 + {1}) * 104729 % 1000003)"


@query("reservoir_hash", f"""WITH {_STREAM}, w AS (SELECT *, CASE WHEN seq < {K.SLOTS} THEN seq ELSE {_HASH.format('seq', 553)} % (seq + 1) END AS slot FROM s),
m AS (SELECT batch, slot, max_by(id, seq) AS id FROM w WHERE slot IN (0, 20, 40, 60, 80) GROUP BY ALL), grid AS (SELECT DISTINCT batch, unnest([0, 20, 40, 60, 80]) AS slot FROM s)
SELECT batch, CAST(slot AS BIGINT) AS slot, last_value(id IGNORE NULLS) OVER (PARTITION BY slot ORDER BY batch ROWS UNBOUNDED PRECEDING) AS id FROM grid LEFT JOIN m USING (batch, slot)""")
def reservoir_hash(spark: SparkSession, sf: str) -> DataFrame:
    return K.reservoir(stream(spark, sf).select("seq", "batch", "id"))


@query("reservoir_stream")
def reservoir_stream(spark: SparkSession, sf: str) -> DataFrame:
    return jobs.reservoir_stream(stream(spark, sf), parts=4)


@query("hash_split", f"""WITH h AS (SELECT event_id, {_HASH.format('event_id', 7)} AS h FROM events), r AS (SELECT event_id, row_number() OVER (ORDER BY h, event_id) AS k, count(*) OVER () AS n FROM h)
SELECT event_id, CASE WHEN k <= n * 7 // 10 THEN 'train' ELSE 'test' END AS part FROM r""")
def hash_split(spark: SparkSession, sf: str) -> DataFrame:
    """Exactly seven tenths train: ranks come from range partitions, not from one sorted task."""
    e = table(spark, sf, "events").select("event_id", (arithmetic_hash(F.col("event_id"), 7) * F.lit(1 << 32) + F.col("event_id")).alias("h"))
    n = e.count()
    return K.dense_index(e, "h").join(e, "h").select("event_id", F.when(F.col("index") < n * 7 // 10, "train").otherwise("test").alias("part"))
