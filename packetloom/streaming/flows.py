"""Live flows: the streaming twin of ``operators.flows.live_flows``.

The order of packets is final only behind the watermark, so packets wait in the state until the watermark has passed the end of
their time slot; then they are sorted and added to the open flow of their key, which FIN/RST or an idle gap closes. Flows are
dealt to ``BUCKETS`` groups by a hash of their key, and a group is folded as arrays, many flows in one step: a call per flow costs more
than its few packets. The state of a group is two packed tables, the packets that wait and the open flows; a group's row stays
when both are empty. One event-time timeout per group drives the folding, so what is closed depends on the watermark alone:
everything before the last whole slot behind it counts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from packetloom.functions.packet import has_flag, is_teardown
from packetloom.operators.flows import COUNTED_FLAGS, FLOW_TIMEOUT_SECONDS, finalise
from packetloom.schemas import FLOW_COLUMNS

WATERMARK = "30 seconds"
SLOT_SECONDS = 5
BUCKETS = 512
#: Packets that are folded at once, unless one slot has more.
FOLDED = 200_000

_CLOSES = 1 << len(COUNTED_FLAGS)
_KEY = ["capture_id", "flow_id"]
_HEAD = ["src_ip", "dst_ip", "src_port", "dst_port", "protocol"]
_PORTS = ["src_port", "dst_port"]
#: Stands for no port inside the step, where a null would turn the column into floating point numbers.
_NO_PORT = -1
_HEAD_DDL = "src_ip string, dst_ip string, src_port int, dst_port int, protocol string"
_ROW = [*_KEY, "us", "packet_id", "length", "marks", *_HEAD]
_FLAGS = [f"tcp_{f.lower()}_count" for f in COUNTED_FLAGS]
_SUMS = ["packet_count", "byte_count", *_FLAGS]
_NUMBERS = ["first_us", "last_us", "first_packet_id", "packet_count", "byte_count", "min_packet_size", "max_packet_size", *_FLAGS]
_FLOW = [*_KEY, *_HEAD, "teardown", *_NUMBERS]
_FLOW_DDL = f"capture_id string, flow_id string, {_HEAD_DDL}, teardown boolean, " + ", ".join(f"{n} bigint" for n in _NUMBERS)


def _opened(packets: pd.DataFrame) -> pd.DataFrame:
    """Every packet as a flow of its own."""
    marks = packets["marks"].to_numpy()
    us, size = packets["us"], packets["length"].astype("int64")
    return packets[[*_KEY, *_HEAD]].assign(
        teardown=marks >= _CLOSES, first_us=us, last_us=us, first_packet_id=packets["packet_id"], packet_count=np.int64(1), byte_count=size,
        min_packet_size=size, max_packet_size=size, **{n: (marks >> i & 1).astype(np.int64) for i, n in enumerate(_FLAGS)})[_FLOW]


def _codes(rows: pd.DataFrame) -> np.ndarray:
    """Numbers for the different keys; nulls are a value."""
    (a, _), (b, known) = (pd.factorize(rows[c], use_na_sentinel=False) for c in _KEY)
    return a.astype(np.int64) * len(known) + b


def fold(flows: pd.DataFrame | None, packets: pd.DataFrame, gap_us: int) -> tuple[pd.DataFrame, pd.DataFrame]:
    """(closed, open) after adding ``packets`` to the open ``flows``, all of which ended before."""
    rows = _opened(packets)
    rows = rows if flows is None or flows.empty else pd.concat([flows, rows], ignore_index=True)
    if rows.empty:
        return rows, rows
    code = _codes(rows)
    order = np.lexsort((rows["first_packet_id"].to_numpy(), rows["last_us"].to_numpy(), code))
    code = code[order]
    number = {c: rows[c].to_numpy()[order] for c in (*_NUMBERS, "teardown")}
    same = code[1:] == code[:-1]
    joined = same & (number["first_us"][1:] - number["last_us"][:-1] <= gap_us) & ~number["teardown"][:-1]
    at = np.flatnonzero(np.concatenate([[True], ~joined]))
    end = np.append(at[1:], len(code)) - 1
    out = rows[[*_KEY, *_HEAD]].take(order[at]).reset_index(drop=True)
    out = out.assign(teardown=number["teardown"][end], first_us=number["first_us"][at], last_us=number["last_us"][end],
                     first_packet_id=number["first_packet_id"][at], **{c: np.add.reduceat(number[c], at) for c in _SUMS},
                     min_packet_size=np.minimum.reduceat(number["min_packet_size"], at),
                     max_packet_size=np.maximum.reduceat(number["max_packet_size"], at))[_FLOW]
    closed = out["teardown"].to_numpy() | np.append(code[at][1:] == code[at][:-1], False)
    return out[closed], out[~closed].reset_index(drop=True)


def _packed(rows: pd.DataFrame) -> bytes | None:
    if rows.empty:
        return None
    table = pa.Table.from_pandas(rows, preserve_index=False)
    words = [c for c in table.column_names if pa.types.is_string(table.schema.field(c).type) or pa.types.is_large_string(table.schema.field(c).type)]
    for c in words:  # a text is held once, not once per row
        table = table.set_column(table.column_names.index(c), c, table[c].combine_chunks().dictionary_encode())
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="lz4")) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def _unpacked(data: bytes) -> pd.DataFrame:
    table = pa.ipc.open_stream(pa.py_buffer(data)).read_all()
    for i, f in enumerate(table.schema):
        if pa.types.is_dictionary(f.type):
            table = table.set_column(i, f.name, table[f.name].cast(f.type.value_type))
    return table.to_pandas()


def _steps(packets: pd.DataFrame, slot_us: int) -> Iterator[pd.DataFrame]:
    """The packets in order of time, in parts of whole slots with about ``FOLDED`` rows."""
    packets = packets.sort_values("us", ignore_index=True)
    slots = packets["us"].to_numpy() // slot_us
    at = 0
    while at < len(packets):
        end = int(np.searchsorted(slots, slots[min(at + FOLDED, len(slots)) - 1], "right"))
        yield packets.iloc[at:end]
        at = end


def live_step(gap_us: int, slot_us: int) -> Callable[[tuple, Iterator[pd.DataFrame], GroupState], Iterator[pd.DataFrame]]:
    """One step of a group: take in what came, fold the slots that are whole by now, close what is idle."""
    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        waiting, opened = state.get if state.exists else (None, None)
        came = [f[_ROW] for f in frames if len(f)]
        if waiting is not None:
            came.insert(0, _unpacked(bytes(waiting)))
        packets = pd.concat(came, ignore_index=True) if came else None
        flows = None if opened is None else _unpacked(bytes(opened))
        passed = max(0, state.getCurrentWatermarkMs()) * 1000 // slot_us  # slots before this one are whole
        now = passed * slot_us
        ends = []
        if packets is not None:
            whole = packets["us"].to_numpy() < now
            for part in _steps(packets[whole], slot_us):
                closed, flows = fold(flows, part, gap_us)
                if len(closed):
                    yield closed
            packets = packets[~whole]
            if len(packets):
                ends.append(int(packets["us"].min()))
        if flows is not None and len(flows):
            idle = now - flows["last_us"].to_numpy() > gap_us
            if idle.any():
                yield flows[idle]
                flows = flows[~idle]
            if len(flows):
                ends.append(int(flows["last_us"].min()) + gap_us)
        state.update((None if packets is None else _packed(packets), None if flows is None else _packed(flows)))
        if ends:  # a timeout comes when the watermark is beyond it, and a slot is whole when the watermark reaches its end
            state.setTimeoutTimestamp((min(ends) // slot_us + 1) * slot_us // 1000 - 1)

    return step


def live_flow_stream(packets: DataFrame, timeout_seconds: int = FLOW_TIMEOUT_SECONDS, watermark: str = WATERMARK,
                     slot_seconds: int = SLOT_SECONDS) -> DataFrame:
    """Closed flows in append mode; flows still open stay in the state."""
    marks = sum((F.when(has_flag(f), F.lit(1 << i)).otherwise(F.lit(0)) for i, f in enumerate(COUNTED_FLAGS)),
                F.when(is_teardown(), F.lit(_CLOSES)).otherwise(F.lit(0)))
    narrow = packets.withWatermark("timestamp", watermark).select(
        F.pmod(F.xxhash64(*_KEY), F.lit(BUCKETS)).cast("int").alias("bucket"), "timestamp", *_KEY, F.unix_micros("timestamp").alias("us"), "packet_id",
        "length", marks.alias("marks"), "src_ip", "dst_ip", *[F.coalesce(c, F.lit(_NO_PORT)).alias(c) for c in _PORTS], "protocol")
    closed = narrow.groupBy("bucket").applyInPandasWithState(
        live_step(timeout_seconds * 1_000_000, slot_seconds * 1_000_000), _FLOW_DDL, "waiting binary, open binary", "append",
        GroupStateTimeout.EventTimeTimeout)
    timed = closed.withColumns({c: F.nullif(F.col(c), F.lit(_NO_PORT)) for c in _PORTS}).select(
        "*", F.timestamp_micros("first_us").alias("start_time"), F.timestamp_micros("last_us").alias("end_time"),
        F.lit(False).alias("is_active"), F.when(F.col("teardown"), "teardown").otherwise("timeout").alias("close_reason"))
    sizes = {c: F.col(c).cast("int") for c in ("min_packet_size", "max_packet_size")}
    return finalise(timed.withColumns(sizes)).select(*FLOW_COLUMNS)


def as_of(closed: DataFrame, now: DataFrame, timeout_seconds: int = FLOW_TIMEOUT_SECONDS) -> DataFrame:
    """Flows of a stream that ran beyond its last packet, as they stood at the one time ``_now`` of ``now``: idle ones within the timeout were open."""
    gap = F.unix_micros("_now") - F.unix_micros("end_time")
    still = (F.col("close_reason") != "teardown") & (gap <= timeout_seconds * 1_000_000)
    return (
        closed.crossJoin(F.broadcast(now)).withColumn("is_active", still)
        .withColumn("close_reason", F.when(still, "open").otherwise(F.col("close_reason"))).select(*closed.columns)
    )
