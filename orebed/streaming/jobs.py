"""Structured Streaming forms of the sketches, and event-time extras that the reference has no counterpart of."""

from __future__ import annotations

import random
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orebed.operators.sketches import AFFINE, BLOOM_BITS, BLOOM_HASHES, SLOTS
from orebed.storage import new_path


def replay(stream: DataFrame, parts: int) -> tuple[DataFrame, int]:
    """(readStream, files): the rows of (seq, id) again, as a file source that yields one file a micro-batch.

    The files are written one after another, as the source takes them in order of their times; each holds an
    equal share of the seq range.
    """
    spark, path = stream.sparkSession, new_path(stream.sparkSession, "stream")
    n = (stream.agg(F.max("seq")).first()[0] or 0) + 1
    for k in range(parts):
        part = stream.select("seq", "id").where((F.col("seq") >= k * n // parts) & (F.col("seq") < (k + 1) * n // parts))
        part.coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema("seq long, id string").option("maxFilesPerTrigger", 1).parquet(path), parts


def run_available(source: DataFrame, on_batch: Callable[[DataFrame, int], None]) -> None:
    """Run all there is through `on_batch`, one micro-batch after another, with a checkpoint in the shared folder."""
    q = source.writeStream.foreachBatch(on_batch).trigger(availableNow=True).option("checkpointLocation", new_path(source.sparkSession, "progress")).start()
    try:
        q.awaitTermination()
    finally:
        q.stop()


def reservoir_stream(stream: DataFrame, parts: int, slots: int = SLOTS, seed: int = 553) -> DataFrame:
    """(batch, slot, id): a seeded reservoir over micro-batches; its state is `slots` ids, whatever the input."""
    rng, held, seen, out = random.Random(seed), [], 0, []
    source, _ = replay(stream, parts)

    def on_batch(df: DataFrame, batch: int) -> None:
        nonlocal seen
        for row in df.orderBy("seq").toLocalIterator():
            seen += 1
            if len(held) < slots:
                held.append(row.id)
            elif rng.random() < slots / seen:
                held[rng.randrange(slots)] = row.id
        out.extend((batch, k, v) for k, v in enumerate(held))

    run_available(source, on_batch)
    return stream.sparkSession.createDataFrame(out, "batch long, slot int, id string")


def bloom_state(source: DataFrame, bits: int = BLOOM_BITS) -> DataFrame:
    """(batch_rows, fp, tn) of each micro-batch of a streaming (seq, id) source, by transformWithStateInPandas.

    State: the set bits and the seen ids, of one key by design, since the filter is one. Needs the RocksDB state
    store provider.
    """
    from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

    class Bloom(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.bits = handle.getMapState("bits", "bit int", "on boolean")
            self.seen = handle.getMapState("seen", "id string", "on boolean")

        def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
            fp = tn = n = 0
            for row in pd.concat(list(rows)).sort_values("seq").itertuples():
                n += 1
                x = int.from_bytes(row.id.encode(), "big")
                hit = True
                for a, b in AFFINE[:BLOOM_HASHES]:
                    bit = (a * x + b) % bits
                    if not self.bits.containsKey((bit,)):
                        hit = False
                        self.bits.updateValue((bit,), (True,))
                if not self.seen.containsKey((row.id,)):
                    fp, tn = fp + hit, tn + (not hit)
                    self.seen.updateValue((row.id,), (True,))
            yield pd.DataFrame({"batch_rows": [n], "fp": [fp], "tn": [tn]})

        def close(self) -> None:
            pass

    return source.withColumn("key", F.lit(0)).groupBy("key").transformWithStateInPandas(Bloom(), "batch_rows long, fp long, tn long", "append", "none")


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Extra: events by window and type, late rows dropped after the watermark; batch and streaming alike."""
    e = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return e.groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"))


def start_memory(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """Run a streaming frame over all there is into a memory table of the session; for tests."""
    q = df.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).option("checkpointLocation", new_path(spark, "progress")).start()
    q.awaitTermination()
    return spark.table(name)
