"""From ranked chunks to prompt and source list."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from packetloom.functions.values import fixed, number, text

MAX_CONTEXT_CHARS = 3_000


def choose_results(dense: DataFrame, sparse: DataFrame, query_keys: list[str]) -> DataFrame:
    """Dense hits where a query has any, otherwise its sparse hits."""
    answered = dense.select(*query_keys).distinct()
    return dense.unionByName(sparse.join(answered, query_keys, "left_anti"))


def with_summary(results: DataFrame, queries: DataFrame, chunks: DataFrame, query_id: str) -> DataFrame:
    """Put the capture's summary chunk in front (score 1.0) of results that lack it.

    ``results``: capture_id, query id, chunk_id, score, rank. ``queries``: capture_id, query id.
    """
    keys = ["capture_id", query_id]
    summaries = chunks.where(F.col("category") == "global_summary").select("capture_id", "chunk_id")
    present = results.join(summaries, ["capture_id", "chunk_id"], "left_semi").select(*keys)
    added = (
        queries.select(*keys).distinct().join(present, keys, "left_anti").join(summaries, "capture_id")
        .select(*keys, "chunk_id", F.lit(1.0).alias("score"), F.lit(0).alias("rank"))
    )
    both = results.select(*keys, "chunk_id", "score", F.col("rank").cast("int").alias("rank")).unionByName(added)
    w = Window.partitionBy(*keys).orderBy("rank")
    return both.withColumn("rank", F.row_number().over(w))


def pack_context(ranked: DataFrame, keys: list[str], max_chars: int = MAX_CONTEXT_CHARS) -> DataFrame:
    """Chunks in rank order until the budget is used; the one that crosses it is cut and marked.

    ``ranked``: keys, rank, category, content. A query holds at most k + 1 rows.
    """
    size = F.length("content")
    before = F.coalesce(
        F.sum(size).over(Window.partitionBy(*keys).orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cut = F.col("_before") + size > max_chars
    snippet = F.when(cut, text(F.substring(F.col("content"), F.lit(1), F.lit(max_chars) - F.col("_before").cast("int")), "…")
                     ).otherwise(F.col("content"))
    parts = F.sort_array(F.collect_list(F.struct("rank", "_part")))
    return (
        ranked.withColumn("_before", before)
        .where(F.col("_before") < max_chars)
        .withColumn("_part", text("[", F.upper("category"), "] ", snippet))
        .groupBy(*keys)
        .agg(F.array_join(F.transform(parts, lambda p: p["_part"]), "\n\n").alias("context"),
             F.count(F.lit(1)).alias("sources_used"))
    )


def build_prompts(questions: DataFrame, contexts: DataFrame, captures: DataFrame, query_id: str) -> DataFrame:
    """``captures``: capture_id, filename, total_packets, total_flows, duration_seconds."""
    prompt = text(
        "PCAP file: ", F.col("filename"), " (", number("total_packets"), " packets, ", number("total_flows"), " flows, ",
        fixed(F.col("duration_seconds"), 1), "s duration)\n\n--- CONTEXT ---\n", F.coalesce("context", F.lit("")),
        "\n--- END CONTEXT ---\n\nQuestion: ", F.col("question"))
    return (
        questions.join(contexts, ["capture_id", query_id], "left").join(captures, "capture_id")
        .select("capture_id", query_id, "question", prompt.alias("prompt"))
    )


def source_list(ranked: DataFrame, keys: list[str], shown: int | None = None) -> DataFrame:
    """Per answer: category, first 300 characters, score to 4 places, metadata, in rank order."""
    kept = ranked if shown is None else ranked.where(F.col("rank") <= shown)
    item = F.struct("rank", "category", F.substring("content", 1, 300).alias("content"),
                    F.round("score", 4).alias("score"), "metadata")
    return kept.groupBy(*keys).agg(F.sort_array(F.collect_list(item)).alias("sources"))


def answer(prompts: DataFrame, ranked: DataFrame, keys: list[str], complete: Callable[[list[str]], list[str]]) -> DataFrame:
    """Run a text model over the prompts, batch by batch inside the tasks.

    A failing call gives an apology followed by the three best chunks.
    """
    best = F.sort_array(F.collect_list(F.struct("rank", "content")))
    tops = ranked.where(F.col("rank") <= 3).groupBy(*keys).agg(
        F.array_join(F.transform(best, lambda p: p["content"]), "\n\n").alias("_top"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            frame["_answer"], frame["_error"] = None, None
            try:
                frame["_answer"] = complete(frame["prompt"].tolist())
            except Exception:  # one bad prompt must not take its neighbours along
                for i in frame.index:
                    try:
                        frame.at[i, "_answer"] = complete([frame.at[i, "prompt"]])[0]
                    except Exception as exc:
                        frame.at[i, "_error"] = str(exc)
            yield frame

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in prompts.schema.fields)
    answered = prompts.mapInPandas(run, f"{schema}, _answer string, _error string")
    apology = text(
        "I was unable to generate an answer because the LLM provider returned an error: ", F.col("_error"),
        ". Here is the most relevant context I found:\n\n", F.coalesce("_top", F.lit("")))
    return (
        answered.join(tops, keys, "left")
        .withColumn("answer", F.trim(F.when(F.col("_error").isNull(), F.col("_answer")).otherwise(apology)))
        .select(*prompts.columns, "answer")
    )
