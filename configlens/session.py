"""Session settings that the engine expects of a Spark session."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Settings that results depend on (time zone, map keys) or that content-bearing rows need (Arrow batch size).
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    """Put SETTINGS on a session that somebody else has made; cluster sizes stay as they are."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def local_session(cores: int = 8, shuffle_partitions: int = 8) -> SparkSession:
    """A session for tests and the bench; on a cluster, pass the cluster's own session to configure()."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("configlens")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    )
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
