"""The tokens of one task are bounded by its characters, however large the table is."""

from pyspark.sql import functions as F

from packetloom.operators import sparse as SP


def test_tasks_grow_with_the_text(spark):
    docs = spark.range(64).select(F.col("id").alias("doc_id"), F.repeat(F.lit("word "), 1000).alias("text"))
    cores = spark.sparkContext.defaultParallelism
    assert SP.text_partitions(docs, "text", 10_000) == 32 and SP.text_partitions(docs, "text", 5_000) == 64
    assert SP.text_partitions(docs, "text") == SP.text_partitions(docs.limit(0), "text") == cores
    counts = SP.term_counts(docs, "doc_id", "text", [], [])
    plan = counts._jdf.queryExecution().toString()
    assert "REPARTITION_BY_NUM" in plan and counts.rdd.getNumPartitions() == cores
    assert counts.agg(F.sum("tf")).first()[0] == 64 * 1999
