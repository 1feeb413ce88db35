"""DuckDB SQL for the queries over stored and updated tables."""

from __future__ import annotations

from packetloom.plans.oracle import ANOMALIES, FLOW_OUT, LIVE_FLOWS, PACKETS, _with, oracle_sql

#: Microseconds: the watermark after the last packet, and the last whole slot behind it.
WATERMARK_US = "(SELECT max(us) // 1000 * 1000 - 30000000 FROM packets)"
SLOT_US = 5_000_000
CLOSED_AT = f"({WATERMARK_US} // {SLOT_US} * {SLOT_US})"




def arrived(disorder_seconds: int, steps: int = 5) -> str:
    """CTE ``arrived``: packets with the step they came in."""
    return PACKETS + f""",
timed AS (SELECT *, us + packet_id * 7919033 % {disorder_seconds * 1_000_000} AS arrival FROM packets),
arrived AS (SELECT *, CAST(floor((arrival - (SELECT min(arrival) FROM timed)) * {steps} / ((SELECT max(arrival) - min(arrival) FROM timed) + 1)) AS BIGINT) AS step FROM timed)"""


def stored_sql() -> dict[str, str]:
    q: dict[str, str] = {}
    closed = _with(LIVE_FLOWS, f"""
      SELECT * REPLACE (false AS is_active, CASE WHEN close_reason = 'teardown' THEN 'teardown' ELSE 'timeout' END AS close_reason)
      FROM (SELECT {FLOW_OUT} FROM live WHERE (closed AND end_time < {CLOSED_AT}) OR {CLOSED_AT} - end_time > 120000000)""")
    q["live_flows_stream"] = _with(LIVE_FLOWS, f"SELECT {FLOW_OUT} FROM live")
    q["flow_table_stream"] = closed
    q["session_table_stream"] = "SELECT user_id AS session_id, count(*) AS message_count, epoch_us(max(ts)) AS last_active_at FROM events GROUP BY 1"
    q["session_lookup"] = q["session_table_stream"].replace("GROUP BY", "WHERE user_id = 7 GROUP BY")
    plain = oracle_sql()
    q["explanations_stored"] = plain["explanations_fill"]
    q["latest_n_stream"] = plain["latest_n_packets"]
    q["stored_period_filter"] = plain["period_filter"]
    q["stored_flow_report"] = plain["flow_anomaly_report"]
    q["stored_flow_lookup"] = _with(PACKETS, """
      SELECT capture_id, packet_id, us AS timestamp, src_ip, dst_ip, CAST(length AS BIGINT) AS length, flow_id FROM packets
      WHERE flow_id = md5('10.0.0.9:40008|192.168.0.1:8080|HTTP')""")
    q["stored_latest_anomaly"] = _with(ANOMALIES, """
      SELECT capture_id, flow_id, anomaly_id, is_anomaly, severity, detected_at FROM anomalies
      QUALIFY row_number() OVER (PARTITION BY capture_id, flow_id ORDER BY detected_at DESC, anomaly_id DESC) = 1""")
    q["stored_busy_periods"] = _with(ANOMALIES, """
      SELECT protocol, count(*) AS packets, CAST(sum(length) AS BIGINT) AS bytes FROM packets
      WHERE us // 60000000 IN (SELECT start_time // 60000000 FROM anomalies WHERE severity = 'critical') GROUP BY 1""")
    q["totals_live"] = _with(arrived(20), """
      SELECT s.step, capture_id, protocol, count(*) AS packets, CAST(sum(length) AS BIGINT) AS bytes, min(us) AS first_seen, max(us) AS last_seen,
        round(count(*) / sum(count(*)) OVER (PARTITION BY s.step, capture_id), 6) AS share
      FROM arrived a JOIN (SELECT unnest(range(5)) AS step) s ON a.step <= s.step GROUP BY 1, 2, 3""")
    q["severities_live"] = _with(ANOMALIES, """
      SELECT step, severity, count(*) AS flows, count(*) FILTER (is_anomaly) AS flagged FROM (
        SELECT s.step, a.* FROM (SELECT *, CAST(floor((detected_at - (SELECT min(detected_at) FROM anomalies)) * 3
            / ((SELECT max(detected_at) - min(detected_at) FROM anomalies) + 1)) AS BIGINT) AS came FROM anomalies) a
          JOIN (SELECT unnest(range(3)) AS step) s ON a.came <= s.step
        QUALIFY row_number() OVER (PARTITION BY s.step, capture_id, flow_id ORDER BY detected_at DESC, anomaly_id DESC) = 1) GROUP BY 1, 2""")
    q["talkers_live"] = _with(PACKETS, """
      SELECT * FROM (SELECT capture_id, src_ip AS ip, CAST(sum(length) AS BIGINT) AS bytes,
        row_number() OVER (PARTITION BY capture_id ORDER BY sum(length) DESC, src_ip) AS rank FROM packets GROUP BY 1, 2) WHERE rank <= 3""")
    q["talkers_live_bounds"] = _with(PACKETS, """
      SELECT DISTINCT capture_id, true AS enclosed, true AS complete, true AS bounded FROM packets""")
    q["late_rows_stream"] = _with(arrived(75), """
      SELECT packet_id, protocol, step AS batch, CASE WHEN us <= mark THEN mark - us END AS delay_us FROM (
        SELECT a.*, (SELECT max(us) - 30000000 FROM arrived b WHERE b.step < a.step) AS mark FROM arrived a)""")
    q["distinct_sketches"] = _with(PACKETS, """
      SELECT capture_id, count(DISTINCT dns_query) AS dns_names, count(DISTINCT http_host) AS http_hosts, count(DISTINCT src_ip) AS sources,
        count(DISTINCT flow_id) AS flows, true AS dns_names_within, true AS http_hosts_within, true AS sources_within, true AS flows_within
      FROM packets WHERE us >= 1704067200000000 + 60000000 AND us < 1704067200000000 + 180000000 GROUP BY 1""")
    return q
