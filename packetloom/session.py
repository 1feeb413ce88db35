"""Session settings that the operators rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build_session(app: str = "packetloom", master: str | None = None, **extra: str) -> SparkSession:
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in extra.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


#: Keeps the state of streams outside the heap; typed state needs it.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def prepare(spark: SparkSession) -> SparkSession:
    """Runtime settings every query needs, whoever built the session."""
    # Event times are UTC everywhere; the session zone must agree.
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    # The JVM does not compile methods beyond 8000 bytecodes; wide decodings run faster split up.
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    return spark
