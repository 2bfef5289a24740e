"""A session with the settings that suit this library."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Columns are built without a call site each, in less than half the time; times are UTC; streams keep state in RocksDB.
SETTINGS = {
    "spark.python.sql.dataFrameDebugging.enabled": "false",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def builder(name: str = "tidemark") -> SparkSession.Builder:
    """A builder with SETTINGS, to which a master, memory and all else can be added."""
    out = SparkSession.builder.appName(name)
    for key, value in SETTINGS.items():
        out = out.config(key, value)
    return out


def session_like(spark: SparkSession, settings: dict[str, object]) -> SparkSession:
    """A session of its own with what spark has set, and settings: other queries of spark keep theirs."""
    own = spark.newSession()
    for key, value in spark.conf.getAll.items():
        if own.conf.get(key, None) != value:
            own.conf.set(key, value)
    for key, value in settings.items():
        own.conf.set(key, value)
    return own
