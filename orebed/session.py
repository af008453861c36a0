"""Session defaults shared by the tests, the bench and interactive use."""

from __future__ import annotations

from pyspark.sql import SparkSession


def get_session(app: str = "orebed", cores: str = "*", shuffle_partitions: int = 8, **extra: str) -> SparkSession:
    """A local session with the settings that the queries rely on (UTC, AQE, Arrow); `extra` overrides."""
    conf = {
        "spark.sql.shuffle.partitions": str(shuffle_partitions),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
        "spark.driver.host": "127.0.0.1",
        "spark.driver.bindAddress": "127.0.0.1",
    } | {k.replace("__", "."): v for k, v in extra.items()}
    spark = SparkSession.builder.master(f"local[{cores}]").appName(app).config(map=conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
