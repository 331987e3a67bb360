"""Session settings the operators count on. All are runtime settings."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    # bucket keys, windows and time text are UTC
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    # One session may hold a third of all events. A join of raw events with a
    # table too large to broadcast is split where a key is that heavy, also when
    # the step after the join then needs a shuffle of its own.
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark
