"""Explanation texts, prompts, text-model hook, chat history and suggested questions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from packetloom.functions.packet import endpoint
from packetloom.functions.values import fixed, number, text
from packetloom.operators.flows import TCP_FAMILY

Complete = Callable[[list[str]], list[str]]


def mock_complete(prompts: list[str]) -> list[str]:
    """Deterministic stand-in for a text model."""
    return [f"(no model: {len(p)} characters of prompt were not read)" for p in prompts]


PROVIDERS: dict[str, Complete] = {"mock": mock_complete}


def register_provider(name: str, complete: Complete) -> None:
    PROVIDERS[name] = complete


def provider(name: str = "mock") -> Complete:
    if name not in PROVIDERS:
        raise ValueError(f"no text model is registered as {name!r}; there are {sorted(PROVIDERS)}")
    return PROVIDERS[name]


def healthy(name: str = "mock") -> bool:
    """A provider is healthy when it answers a short prompt."""
    try:
        return len(provider(name)(["ping"])) == 1
    except Exception:
        return False


def template() -> Column:
    """Text used when no model answers; expects flow columns joined with anomaly columns."""
    score = fixed(F.coalesce("ensemble_score", F.lit(0.0)), 2)
    seconds = fixed(F.coalesce("duration_seconds", F.lit(0.0)), 1)
    counts = text(number("packet_count"), " packets, ", number("byte_count"), " bytes ")
    flagged = text("Anomalous ", F.col("protocol"), " flow detected (type: ", F.coalesce("anomaly_type", F.lit("unknown")),
                   ", score: ", score, "). ", counts, "from ", F.col("src_ip"), " to ", F.col("dst_ip"), ".")
    normal = text("Normal ", F.col("protocol"), " traffic from ", F.col("src_ip"), " to ", F.col("dst_ip"), ". ",
                  counts, "over ", seconds, "s.")
    return F.when(F.coalesce("is_anomaly", F.lit(False)), flagged).otherwise(normal)


def _quoted(c: Column | str) -> Column:
    return F.coalesce(text('"', F.col(c) if isinstance(c, str) else c, '"'), F.lit("null"))


def _decimal(c: str, digits: int) -> Column:
    """Rounded, without exponent, with one decimal at least: 10.0, 0.25."""
    plain = F.round(F.coalesce(c, F.lit(0.0)), digits).cast(f"decimal(38,{digits})").cast("string")
    return F.regexp_replace(plain, r"(\.\d+?)0+$", "$1")


def _indented(pairs: dict[str, Column], depth: int = 1) -> Column:
    """An indented JSON object of values that are JSON texts already."""
    pad = "  " * depth
    lines = [text(f'{pad}"{k}": ', v) for k, v in pairs.items()]
    return text("{\n", F.concat_ws(",\n", *lines), "\n" + "  " * (depth - 1) + "}")


def flow_prompts(flows: DataFrame) -> DataFrame:
    """Prompt per flow: rounded statistics and the detector result as indented JSON."""
    port = lambda ip, p: _quoted(endpoint(ip, F.when(F.col(p) != 0, F.col(p)), "*"))
    flags = {f: number(f"tcp_{f.lower()}_count") for f in ("SYN", "FIN", "RST", "ACK", "PSH")}
    summary = {
        "flow_id": _quoted("flow_id"), "src": port("src_ip", "src_port"), "dst": port("dst_ip", "dst_port"), "protocol": _quoted("protocol"),
        "packet_count": number("packet_count"), "byte_count": number("byte_count"),
        **{c: _decimal(c, n) for c, n in (("duration_seconds", 3), ("avg_packet_size", 1), ("packets_per_second", 2), ("bytes_per_second", 2))},
        "tcp_flags": _indented(flags, 2)}
    found = {"is_anomaly": F.col("is_anomaly").cast("string"), "anomaly_type": _quoted("anomaly_type"),
             "ensemble_score": F.when(F.col("ensemble_score").isNull(), "null").otherwise(_decimal("ensemble_score", 6)), "severity": _quoted("severity")}
    result = F.when(F.col("is_anomaly").isNotNull(), _indented(found)).otherwise(_indented({"is_anomaly": F.lit("false")}))
    prompt = text("Network flow statistics:\n", _indented(summary), "\n\nAnomaly detection result:\n", result,
                  "\n\nExplain this network flow in plain English.")
    return flows.withColumn("prompt", prompt)


def explain_flows(flows: DataFrame, complete: Complete | None = None) -> DataFrame:
    """``explanation`` per flow row; without a model, or where it fails, the template is used.

    ``flows`` carries the anomaly columns (null where a flow has none).
    """
    if complete is None:
        return flows.withColumn("explanation", template())

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            prompts = frame["prompt"].tolist()
            try:
                frame["explanation"] = complete(prompts)
            except Exception:  # one bad prompt must not take its neighbours along
                out = []
                for prompt in prompts:
                    try:
                        out.append(complete([prompt])[0])
                    except Exception:
                        out.append(None)
                frame["explanation"] = out
            yield frame

    asked = flow_prompts(flows).withColumn("_template", template())
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in asked.schema.fields)
    return (
        asked.mapInPandas(run, f"{schema}, explanation string")
        .withColumn("explanation", F.coalesce("explanation", "_template")).drop("prompt", "_template")
    )


def fill_explanations(anomalies: DataFrame, explained: DataFrame, keys: list[str]) -> DataFrame:
    """Write new texts only where an anomaly row has none."""
    new = explained.select(*keys, F.col("explanation").alias("_new"))
    kept = F.when(F.coalesce("explanation", F.lit("")) != "", F.col("explanation")).otherwise(F.col("_new"))
    return anomalies.join(new, keys, "left").withColumn("explanation", kept).drop("_new")


def suggested_questions(captures: DataFrame) -> DataFrame:
    """Up to ten questions per capture.

    ``captures``: capture_id, total_anomalies, dns_query_count, http_request_count, protocols
    (array) and anomaly_types (array).
    """
    def when(condition: Column, *questions: str) -> list[Column]:
        return [F.when(condition, F.lit(q)) for q in questions]

    seen = lambda kind: F.array_contains("anomaly_types", kind)
    always = F.lit(True)
    options = [
        *when(always, "Give me a high-level summary of what happened in this capture.",
              "Which hosts transferred the most data?"),
        *when(F.col("total_anomalies") > 0, "Were any anomalies detected? What types and how severe?",
              "Which flows were flagged as suspicious and why?"),
        *when(F.col("dns_query_count") > 0, "What DNS queries were made? Were any domains unusual?"),
        *when(F.arrays_overlap("protocols", F.array(*[F.lit(p) for p in TCP_FAMILY])),
              "Were there any TCP handshake failures or connection issues?",
              "Explain the TCP connection patterns in this capture."),
        *when(seen("port_scan"), "Was there a port scan? Which host performed it and what ports were probed?"),
        *when(seen("dns_spike"), "There seems to be a DNS spike — what caused it?"),
        *when(seen("data_exfiltration"), "Is there evidence of data exfiltration in this capture?"),
        *when(F.col("http_request_count") > 0, "What HTTP hosts and endpoints were accessed?"),
        *when(always, "Which protocols were used and in what proportion?",
              "Were there any signs of retransmissions or packet loss?"),
    ]
    return captures.select("capture_id", F.slice(F.array_compact(F.array(*options)), 1, 10).alias("questions"))


def chat_history(messages: DataFrame) -> DataFrame:
    """Messages of every session in order, with their index."""
    w = Window.partitionBy("session_id").orderBy("turn")
    return messages.withColumn("message_index", F.row_number().over(w) - 1)
