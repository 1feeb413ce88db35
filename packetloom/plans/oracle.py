"""DuckDB SQL for the registered queries, written independently of the Spark plans.

Where Spark slices, salts or merges, the SQL uses one plain window or group per key.
"""

from __future__ import annotations

PACKETS = r"""
events_k AS (
  SELECT *, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events
),
packets0 AS (
  SELECT 'cap' || CAST(user_id % 4 AS VARCHAR) AS capture_id, event_id AS packet_id, k,
    1704067200000000 + CAST(floor((epoch_us(ts) - 1704067200000000) / 10000) AS BIGINT) AS us,
    event_id % 2 = 0 AS outb, event_id % 17 AS fl,
    '10.' || CAST((user_id // 62500) % 250 AS VARCHAR) || '.' || CAST((user_id // 250) % 250 AS VARCHAR)
      || '.' || CAST(user_id % 250 + 1 AS VARCHAR) AS client,
    '192.168.0.' || CAST(k % 3 + 1 AS VARCHAR) AS server,
    CAST(40000 + user_id % 1000 AS INT) AS cport,
    CASE event_type WHEN 'click' THEN 22 WHEN 'view' THEN 443 WHEN 'signup' THEN 53 WHEN 'error' THEN 8080 ELSE 123 END AS sport,
    CASE WHEN event_type = 'click' THEN 'TCP' WHEN event_type = 'view' THEN 'HTTPS' WHEN event_type = 'signup' THEN 'DNS'
         WHEN event_type = 'error' AND event_id % 2 = 0 THEN 'HTTP' WHEN event_type = 'error' THEN 'TCP'
         WHEN k % 10 = 0 THEN 'ICMP' WHEN k % 10 = 1 THEN 'ARP' ELSE 'UDP' END AS protocol,
    CAST(round(value * 100) AS BIGINT) % 1441 AS extra
  FROM events_k
),
packets1 AS (
  SELECT capture_id, packet_id, us, protocol,
    CASE WHEN outb THEN client ELSE server END AS src_ip, CASE WHEN outb THEN server ELSE client END AS dst_ip,
    CASE WHEN protocol IN ('ICMP', 'ARP') THEN NULL WHEN outb THEN cport ELSE sport END AS src_port,
    CASE WHEN protocol IN ('ICMP', 'ARP') THEN NULL WHEN outb THEN sport ELSE cport END AS dst_port,
    CASE WHEN protocol IN ('HTTP', 'DNS') THEN 160 ELSE 60 END + extra AS length,
    CASE WHEN protocol <> 'ARP' THEN 32 + packet_id % 97 END AS ttl,
    CASE WHEN protocol NOT IN ('TCP', 'HTTP', 'HTTPS') THEN NULL WHEN fl = 0 THEN 'SYN' WHEN fl = 1 THEN 'SYNACK'
         WHEN fl = 14 THEN 'PSHACK' WHEN fl = 15 THEN 'FINACK' WHEN fl = 16 THEN 'RST' ELSE 'ACK' END AS tcp_flags,
    CASE WHEN protocol = 'DNS' THEN 'd' || CAST(k AS VARCHAR) || '.example.com' END AS dns_query,
    CASE WHEN protocol = 'DNS' AND NOT outb THEN '198.51.100.' || CAST(k + 1 AS VARCHAR) END AS dns_response,
    CASE WHEN protocol = 'HTTP' THEN CASE packet_id % 3 WHEN 0 THEN 'GET' WHEN 1 THEN 'POST' ELSE 'HEAD' END END AS http_method,
    CASE WHEN protocol = 'HTTP' THEN 'h' || CAST(k % 25 AS VARCHAR) || '.example.org' END AS http_host,
    CASE WHEN protocol = 'HTTP' THEN '/p/' || CAST(packet_id % 10 AS VARCHAR) END AS http_path,
    CASE WHEN protocol = 'ARP' THEN CASE WHEN outb THEN 'request' ELSE 'reply' END END AS arp_op,
    CASE WHEN protocol = 'ARP' THEN CASE WHEN outb THEN '02:00:00:00:00:01' ELSE '02:00:00:00:00:02' END END AS arp_hwsrc,
    CASE WHEN protocol = 'ARP' THEN CASE WHEN outb THEN '02:00:00:00:00:02' ELSE '02:00:00:00:00:01' END END AS arp_hwdst
  FROM packets0
),
packets AS (
  SELECT *,
    CASE WHEN protocol = 'HTTP'
         THEN rpad(lower(hex(http_method || ' ' || http_path || ' HTTP/1.1' || chr(13) || chr(10) || 'Host: '
                   || http_host || chr(13) || chr(10) || chr(13) || chr(10))), 128, '0')
         WHEN protocol IN ('TCP', 'HTTPS') AND length > 54 THEN repeat('00', CAST(least(64, length - 54) AS BIGINT))
    END AS payload_preview,
    md5(least(src_ip || ':' || CAST(coalesce(src_port, 0) AS VARCHAR), dst_ip || ':' || CAST(coalesce(dst_port, 0) AS VARCHAR))
        || '|' ||
        greatest(src_ip || ':' || CAST(coalesce(src_port, 0) AS VARCHAR), dst_ip || ':' || CAST(coalesce(dst_port, 0) AS VARCHAR))
        || '|' || protocol) AS flow_id
  FROM packets1
)"""

# All 21 stored packet columns, times as epoch microseconds.
PACKET_OUT = (
    "capture_id, packet_id, us AS timestamp, src_ip, dst_ip, CAST(src_port AS BIGINT) AS src_port, "
    "CAST(dst_port AS BIGINT) AS dst_port, protocol, CAST(length AS BIGINT) AS length, CAST(ttl AS BIGINT) AS ttl, "
    "tcp_flags, payload_preview, flow_id, dns_query, dns_response, http_method, http_host, http_path, "
    "arp_op, arp_hwsrc, arp_hwdst"
)

_COUNTS = """
    count(*) AS packet_count, CAST(sum(length) AS BIGINT) AS byte_count,
    CAST(min(length) AS BIGINT) AS min_packet_size, CAST(max(length) AS BIGINT) AS max_packet_size,
    count(*) FILTER (tcp_flags LIKE '%SYN%') AS tcp_syn_count, count(*) FILTER (tcp_flags LIKE '%FIN%') AS tcp_fin_count,
    count(*) FILTER (tcp_flags LIKE '%RST%') AS tcp_rst_count, count(*) FILTER (tcp_flags LIKE '%ACK%') AS tcp_ack_count,
    count(*) FILTER (tcp_flags LIKE '%PSH%') AS tcp_psh_count"""

CAPTURE_FLOWS = PACKETS + f""",
marked AS (
  SELECT *, max(CASE WHEN tcp_flags LIKE '%FIN%' OR tcp_flags LIKE '%RST%' THEN packet_id END)
            OVER (PARTITION BY capture_id, flow_id) AS td
  FROM packets
),
flows0 AS (
  SELECT capture_id, flow_id, arg_min(src_ip, packet_id) AS src_ip, arg_min(dst_ip, packet_id) AS dst_ip,
    arg_min_null(src_port, packet_id) AS src_port, arg_min_null(dst_port, packet_id) AS dst_port,
    min(protocol) AS protocol, min(packet_id) AS first_packet_id, min(us) AS start_time,
    max(us) FILTER (td IS NULL OR packet_id <= td) AS end_time,{_COUNTS},
    count(*) FILTER (td IS NULL OR packet_id <= td) AS fp,
    CAST(sum(length) FILTER (td IS NULL OR packet_id <= td) AS BIGINT) AS fb, max(td) IS NOT NULL AS torn
  FROM marked GROUP BY capture_id, flow_id
),
flows AS (
  SELECT *, (end_time - start_time) / 1000000.0 AS duration_seconds, CAST(fb AS DOUBLE) / fp AS avg_packet_size,
    CASE WHEN end_time > start_time THEN fp / ((end_time - start_time) / 1000000.0) END AS packets_per_second,
    CASE WHEN end_time > start_time THEN fb / ((end_time - start_time) / 1000000.0) END AS bytes_per_second,
    false AS is_active, CASE WHEN torn THEN 'teardown' ELSE 'capture_end' END AS close_reason
  FROM flows0
)"""

LIVE_FLOWS = PACKETS + f""",
lagged AS (
  SELECT *, lag(us) OVER w AS pus, lag(tcp_flags) OVER w AS pflags, row_number() OVER w AS rn
  FROM packets WINDOW w AS (PARTITION BY capture_id, flow_id ORDER BY us, packet_id)
),
numbered AS (
  SELECT *, sum(CASE WHEN rn = 1 OR pflags LIKE '%FIN%' OR pflags LIKE '%RST%' OR us - pus > 120000000 THEN 1 ELSE 0 END)
            OVER (PARTITION BY capture_id, flow_id ORDER BY us, packet_id) AS seg
  FROM lagged
),
segs0 AS (
  SELECT capture_id, flow_id, seg, arg_min(src_ip, rn) AS src_ip, arg_min(dst_ip, rn) AS dst_ip,
    arg_min_null(src_port, rn) AS src_port, arg_min_null(dst_port, rn) AS dst_port,
    min(protocol) AS protocol, arg_min(packet_id, rn) AS first_packet_id, min(us) AS start_time, max(us) AS end_time,{_COUNTS},
    bool_or(coalesce(tcp_flags LIKE '%FIN%' OR tcp_flags LIKE '%RST%', false)) AS closed
  FROM numbered GROUP BY capture_id, flow_id, seg
),
segs AS (
  SELECT *, (end_time - start_time) / 1000000.0 AS duration_seconds, CAST(byte_count AS DOUBLE) / packet_count AS avg_packet_size,
    CASE WHEN end_time > start_time THEN packet_count / ((end_time - start_time) / 1000000.0) END AS packets_per_second,
    CASE WHEN end_time > start_time THEN byte_count / ((end_time - start_time) / 1000000.0) END AS bytes_per_second
  FROM segs0
),
live AS (
  SELECT *, NOT (closed OR (SELECT max(us) FROM packets) - end_time > 120000000) AS is_active,
    CASE WHEN closed THEN 'teardown' WHEN (SELECT max(us) FROM packets) - end_time > 120000000 THEN 'timeout' ELSE 'open' END AS close_reason
  FROM segs
)"""

FLOW_OUT = (
    "capture_id, flow_id, src_ip, dst_ip, CAST(src_port AS BIGINT) AS src_port, CAST(dst_port AS BIGINT) AS dst_port, protocol, "
    "first_packet_id, start_time, end_time, round(duration_seconds, 6) AS duration_seconds, packet_count, byte_count, "
    "round(avg_packet_size, 6) AS avg_packet_size, min_packet_size, max_packet_size, tcp_syn_count, tcp_fin_count, "
    "tcp_rst_count, tcp_ack_count, tcp_psh_count, round(packets_per_second, 6) AS packets_per_second, "
    "round(bytes_per_second, 6) AS bytes_per_second, is_active, close_reason"
)

SCORED = CAPTURE_FLOWS + """,
scored0 AS (
  SELECT *, CASE WHEN packet_count % 7 <> 6 THEN round((byte_count % 997) / 996.0, 4) END AS if_score,
    CASE WHEN byte_count % 11 <> 0 THEN round((byte_count * 31 % 1009) / 1008.0, 4) END AS ae_score
  FROM flows
),
scored1 AS (
  SELECT *, coalesce((if_score + ae_score) / 2, if_score, ae_score, 0.0) AS ensemble_score,
    coalesce(if_score >= 0.75, false) OR coalesce(ae_score >= 0.8, false) AS is_anomaly
  FROM scored0
),
scored AS (
  SELECT *, CASE WHEN NOT is_anomaly THEN NULL
      WHEN tcp_syn_count > 0 AND tcp_ack_count < 2 AND duration_seconds < 100 THEN 'port_scan'
      WHEN protocol = 'DNS' AND packet_count > 5 THEN 'dns_spike'
      WHEN byte_count > 4000 AND protocol IN ('TCP', 'HTTPS') THEN 'data_exfiltration'
      WHEN tcp_rst_count > 0 THEN 'rst_storm'
      WHEN packet_count > 2 AND avg_packet_size < 900 THEN 'slow_loris' ELSE 'unknown' END AS anomaly_type,
    CASE WHEN NOT is_anomaly THEN 'info' WHEN ensemble_score >= 0.95 THEN 'critical' WHEN ensemble_score >= 0.8 THEN 'high'
      WHEN ensemble_score >= 0.6 THEN 'medium' WHEN ensemble_score >= 0.4 THEN 'low' ELSE 'info' END AS severity
  FROM scored1
)"""

ANOMALIES = SCORED + """,
anomalies0 AS (
  SELECT s.* EXCLUDE (is_anomaly, anomaly_type, severity, ensemble_score), r.round,
    round(CASE WHEN r.round = 0 THEN ensemble_score ELSE ensemble_score / 2 END, 6) AS ensemble_score,
    is_anomaly AND (r.round = 0 OR byte_count % 2 = 0) AS is_anomaly, anomaly_type AS flow_type
  FROM scored s JOIN (VALUES (0), (1)) r(round) ON r.round = 0 OR byte_count % 3 = 0
),
anomalies AS (
  SELECT flow_id || '-' || CAST(round AS VARCHAR) AS anomaly_id, capture_id, flow_id, start_time, 'ensemble' AS detector_name,
    if_score, ae_score, ensemble_score, is_anomaly, CASE WHEN is_anomaly THEN flow_type END AS anomaly_type,
    CASE WHEN NOT is_anomaly THEN 'info' WHEN ensemble_score >= 0.95 THEN 'critical' WHEN ensemble_score >= 0.8 THEN 'high'
      WHEN ensemble_score >= 0.6 THEN 'medium' WHEN ensemble_score >= 0.4 THEN 'low' ELSE 'info' END AS severity,
    CASE WHEN byte_count % 5 <> 0 THEN 'Score pattern of ' || protocol
      || ' traffic looked unlike the rest of this capture and should be reviewed by hand.' END AS explanation,
    end_time + (round + 1) * 60000000 AS detected_at
  FROM anomalies0
)"""

ANOMALY_OUT = (
    "anomaly_id, capture_id, flow_id, start_time, detector_name, if_score, ae_score, ensemble_score, is_anomaly, "
    "anomaly_type, severity, explanation, detected_at"
)


def _with(ctes: str, body: str) -> str:
    return f"WITH {ctes.strip()}\n{body.strip()}"


def oracle_sql() -> dict[str, str]:
    from packetloom.plans import oracle_text

    q: dict[str, str] = {}

    # ---- packets: keys, filters, pages
    q["packets"] = _with(PACKETS, f"SELECT {PACKET_OUT} FROM packets")
    q["dissect"] = q["packets"]
    q["flow_key"] = _with(PACKETS, "SELECT packet_id, flow_id FROM packets")
    q["flag_membership"] = _with(PACKETS, """
      SELECT packet_id, coalesce(tcp_flags LIKE '%SYN%', false) AS syn, coalesce(tcp_flags LIKE '%FIN%', false) AS fin,
        coalesce(tcp_flags LIKE '%RST%', false) AS rst, coalesce(tcp_flags LIKE '%ACK%', false) AS ack,
        coalesce(tcp_flags LIKE '%PSH%', false) AS psh FROM packets""")
    q["protocol_label"] = _with(PACKETS, "SELECT packet_id, protocol FROM packets")
    q["packets_filter"] = _with(PACKETS, f"SELECT {PACKET_OUT} FROM packets WHERE protocol = 'TCP' AND dst_ip = '192.168.0.2'")
    q["packets_page"] = _with(PACKETS, f"SELECT {PACKET_OUT} FROM packets WHERE protocol = 'HTTPS' ORDER BY us DESC, packet_id LIMIT 1000 OFFSET 100")
    q["packets_page_total"] = _with(PACKETS, "SELECT count(*) AS total FROM packets WHERE protocol = 'HTTPS'")
    q["packet_lookup"] = _with(PACKETS, f"SELECT {PACKET_OUT} FROM packets WHERE packet_id = 77")
    q["capture_filter"] = _with(PACKETS, """
      SELECT packet_id, protocol, src_ip, dst_port FROM packets
      WHERE protocol IN ('TCP', 'HTTP', 'HTTPS', 'ICMP') AND src_ip IN ('192.168.0.1', '192.168.0.3', '10.0.0.8')""")
    q["period_filter"] = _with(PACKETS, """
      SELECT packet_id, us AS timestamp, protocol, CAST(length AS BIGINT) AS length FROM packets
      WHERE us BETWEEN 1704067200000000 + 60000000 AND 1704067200000000 + 180000000""")
    q["live_text_filter"] = _with(PACKETS, """
      SELECT packet_id, src_ip, dst_ip, protocol FROM packets
      WHERE src_ip LIKE '%tcp%' OR dst_ip LIKE '%tcp%' OR lower(protocol) LIKE '%tcp%' ORDER BY us DESC, packet_id LIMIT 200""")
    q["latest_n_packets"] = _with(PACKETS, """
      SELECT us AS timestamp, src_ip, dst_ip, CAST(src_port AS BIGINT) AS src_port, CAST(dst_port AS BIGINT) AS dst_port, protocol,
        CAST(length AS BIGINT) AS length, tcp_flags, flow_id, dns_query, http_host
      FROM packets ORDER BY us DESC, packet_id LIMIT 500""")
    q["packet_display"] = _with(PACKETS, """
      SELECT packet_id, us AS timestamp, protocol, src_ip || ':' || coalesce(CAST(src_port AS VARCHAR), '*') AS source,
        dst_ip || ':' || coalesce(CAST(dst_port AS VARCHAR), '*') AS destination, CAST(length AS BIGINT) AS length,
        coalesce(tcp_flags, '—') AS flags, coalesce(dns_query, http_host, '') AS info FROM packets""")
    q["inter_arrival"] = _with(PACKETS, """
      SELECT capture_id, packet_id, round((us - lag(us) OVER (PARTITION BY capture_id ORDER BY packet_id)) / 1000000.0, 6)
        AS inter_arrival_time FROM packets""")

    # ---- statistics
    q["traffic_totals"] = _with(ANOMALIES, """
      SELECT p.total_packets, p.total_bytes, f.total_flows, a.total_anomalies,
        round(CASE WHEN f.total_flows > 0 THEN CAST(a.total_anomalies AS DOUBLE) / f.total_flows ELSE 0 END * 100, 2) AS anomaly_rate,
        round(p.d / 1000000.0, 6) AS capture_duration_seconds
      FROM (SELECT count(*) AS total_packets, CAST(coalesce(sum(length), 0) AS BIGINT) AS total_bytes, max(us) - min(us) AS d FROM packets) p,
        (SELECT count(*) AS total_flows FROM flows) f, (SELECT count(*) AS total_anomalies FROM anomalies WHERE is_anomaly) a""")
    q["protocol_breakdown"] = _with(PACKETS, """
      SELECT protocol, count(*) AS count, CAST(sum(length) AS BIGINT) AS bytes,
        round(CAST(count(*) AS DOUBLE) / (SELECT count(*) FROM packets) * 100, 2) AS pct FROM packets GROUP BY protocol""")
    q["top_talkers_packets"] = _with(PACKETS, """
      SELECT src_ip AS ip, count(*) AS packets, CAST(sum(length) AS BIGINT) AS bytes FROM packets GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10""")
    q["top_talkers_bytes"] = _with(PACKETS, """
      SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY capture_id ORDER BY bytes DESC, ip) AS rank FROM (
        SELECT capture_id, src_ip AS ip, count(*) AS packets, CAST(sum(length) AS BIGINT) AS bytes FROM packets GROUP BY 1, 2)) WHERE rank <= 10""")
    q["talker_share"] = _with(PACKETS, """
      SELECT ip, packets, bytes, round(CAST(packets AS DOUBLE) / max(packets) OVER () * 100, 6) AS bar_percent FROM (
        SELECT src_ip AS ip, count(*) AS packets, CAST(sum(length) AS BIGINT) AS bytes FROM packets GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 8)""")
    q["capture_duration"] = _with(PACKETS, """
      SELECT capture_id, round((max(us) - min(us)) / 1000000.0, 6) AS duration_seconds FROM packets GROUP BY 1""")
    q["protocol_counts"] = _with(PACKETS, """
      SELECT capture_id, string_agg(protocol || '=' || CAST(n AS VARCHAR), ',' ORDER BY protocol) AS protocol_counts FROM (
        SELECT capture_id, protocol, count(*) AS n FROM packets GROUP BY 1, 2) GROUP BY 1""")
    q["dns_distinct"] = _with(PACKETS, """
      SELECT capture_id, dns_query, min(packet_id) AS first_packet_id, count(*) AS queries FROM packets
      WHERE coalesce(dns_query, '') <> '' GROUP BY 1, 2""")
    q["dns_summary"] = _with(PACKETS, """
      SELECT capture_id, max(n) AS query_count, string_agg(dns_query, ',' ORDER BY r) FILTER (r <= 100) AS queries FROM (
        SELECT *, count(*) OVER (PARTITION BY capture_id) AS n, row_number() OVER (PARTITION BY capture_id ORDER BY first, dns_query) AS r FROM (
          SELECT capture_id, dns_query, min(packet_id) AS first FROM packets WHERE dns_query IS NOT NULL GROUP BY 1, 2)) GROUP BY 1""")
    q["http_requests"] = _with(PACKETS, """
      SELECT capture_id, packet_id, src_ip AS src, http_host AS host, http_method AS method, http_path AS path FROM packets WHERE http_host IS NOT NULL""")
    q["http_hosts"] = _with(PACKETS, """
      SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY capture_id ORDER BY requests DESC, host) AS rank FROM (
        SELECT capture_id, http_host AS host, count(*) AS requests FROM packets WHERE http_host IS NOT NULL GROUP BY 1, 2)) WHERE rank <= 20""")
    q["distinct_sizes"] = _with(PACKETS, """
      SELECT capture_id, count(DISTINCT dns_query) AS dns_names, count(DISTINCT http_host) AS http_hosts, count(DISTINCT protocol) AS protocols
      FROM packets GROUP BY 1""")
    q["anomaly_counts"] = _with(ANOMALIES, """
      SELECT capture_id, anomaly_type, severity, count(*) AS n FROM anomalies WHERE is_anomaly GROUP BY 1, 2, 3""")

    # ---- flows
    q["flows_capture"] = _with(CAPTURE_FLOWS, f"SELECT {FLOW_OUT} FROM flows")
    q["flows_live"] = _with(LIVE_FLOWS, f"SELECT {FLOW_OUT} FROM live")
    q["flows_filter"] = _with(LIVE_FLOWS, f"SELECT {FLOW_OUT} FROM live WHERE protocol = 'HTTPS' AND is_active")
    q["flows_page"] = _with(LIVE_FLOWS, f"SELECT {FLOW_OUT} FROM live WHERE protocol = 'DNS' ORDER BY start_time DESC, flow_id, first_packet_id LIMIT 500 OFFSET 20")
    q["flow_lookup"] = _with(LIVE_FLOWS, f"SELECT {FLOW_OUT} FROM live WHERE flow_id = md5('10.0.0.9:40008|192.168.0.1:8080|HTTP')")
    q["flow_display"] = _with(CAPTURE_FLOWS, """
      SELECT flow_id, start_time, protocol, src_ip || ':' || coalesce(CAST(src_port AS VARCHAR), '*') AS source,
        dst_ip || ':' || coalesce(CAST(dst_port AS VARCHAR), '*') AS destination, packet_count, round(byte_count / 1024.0, 6) AS kilobytes,
        round(duration_seconds, 6) AS duration_seconds, round(packets_per_second, 6) AS packets_per_second FROM flows""")
    q["tcp_health"] = _with(CAPTURE_FLOWS, """
      SELECT capture_id, count(*) AS tcp_flow_count, count(*) FILTER (tcp_syn_count > 0 AND tcp_ack_count = 0) AS incomplete_handshakes,
        count(*) FILTER (tcp_rst_count > 5) AS rst_storms,
        count(*) FILTER (packet_count > 10 AND avg_packet_size < 80 AND tcp_ack_count > packet_count * 0.6) AS retransmission_hints
      FROM flows WHERE protocol IN ('TCP', 'HTTP', 'HTTPS') GROUP BY 1""")
    q["port_scan"] = _with(CAPTURE_FLOWS, """
      SELECT capture_id, src_ip, count(DISTINCT dst_port) AS port_count,
        array_to_string(list_sort(list(DISTINCT dst_port)), ',') AS ports
      FROM flows WHERE protocol IN ('TCP', 'HTTP', 'HTTPS') AND tcp_syn_count > 0 GROUP BY 1, 2 HAVING count(DISTINCT dst_port) >= 2""")

    q["chunk_hosts"] = _with(PACKETS, """
      SELECT capture_id, http_host AS host, count(*) AS requests, 'http' AS category FROM packets WHERE http_host IS NOT NULL GROUP BY 1, 2""")
    scanners = """
      SELECT capture_id, src_ip, count(DISTINCT dst_port) AS port_count, list(DISTINCT dst_port) AS ports
      FROM flows WHERE protocol IN ('TCP', 'HTTP', 'HTTPS') AND tcp_syn_count > 0 GROUP BY 1, 2"""
    q["chunk_scanners"] = _with(CAPTURE_FLOWS, f"""
      SELECT capture_id, 'port_scan' AS category, src_ip, port_count, unnest(ports) AS dst_port FROM ({scanners}) WHERE port_count >= 2""")
    q["port_scan_default"] = _with(CAPTURE_FLOWS, f"SELECT capture_id, src_ip, port_count FROM ({scanners}) WHERE port_count >= 10")
    q["session_table"] = """
      WITH r AS (SELECT user_id AS session_id, count(*) AS message_count, epoch_us(max(ts)) AS last_active_at FROM events GROUP BY 1)
      SELECT *, (SELECT max(last_active_at) FROM r) - last_active_at <= 3600000000 AS live FROM r"""

    # ---- features and detectors
    feats = ["packet_count", "byte_count", "avg_packet_size", "duration_seconds", "packets_per_second", "bytes_per_second",
             "tcp_syn_count", "tcp_fin_count", "tcp_rst_count", "tcp_ack_count", "tcp_psh_count", "src_port", "dst_port"]
    vec = CAPTURE_FLOWS + ",\nvec AS (SELECT capture_id, flow_id, " + ", ".join(
        f"coalesce(CAST({f} AS DOUBLE), 0) AS {f}" for f in feats) + " FROM flows)"
    q["feature_vector"] = _with(vec, "SELECT capture_id, flow_id, " + ", ".join(f"round({f}, 6) AS {f}" for f in feats) + " FROM vec")
    q["scaler_params"] = _with(vec, " UNION ALL ".join(
        f"SELECT '{f}' AS feature, round(avg({f}), 4) AS mean, round(CASE WHEN stddev_pop({f}) > 0 THEN stddev_pop({f}) ELSE 1 END, 4) AS scale FROM vec"
        for f in feats))
    q["scaled_features"] = _with(vec, "SELECT capture_id, flow_id, " + ", ".join(
        f"round(({f} - (SELECT avg({f}) FROM vec)) / (SELECT CASE WHEN stddev_pop({f}) > 0 THEN stddev_pop({f}) ELSE 1 END FROM vec), 4) + 0.0 AS {f}"
        for f in feats) + " FROM vec")
    deviation = "greatest(" + ", ".join(
        f"abs(({f} - (SELECT avg({f}) FROM vec)) / (SELECT CASE WHEN stddev_pop({f}) > 0 THEN stddev_pop({f}) ELSE 1 END FROM vec))" for f in feats) + ")"
    q["detector_contract"] = _with(vec, f"""
      SELECT capture_id, flow_id, round(d / (max(d) OVER ()), 4) AS score, d >= 3 AS is_anomaly FROM (SELECT capture_id, flow_id, {deviation} AS d FROM vec)""")
    q["ensemble"] = _with(SCORED, """
      SELECT capture_id, flow_id, if_score, ae_score, round(ensemble_score, 6) AS ensemble_score, is_anomaly, anomaly_type, severity FROM scored""")
    q["rule_anomalies"] = _with(SCORED, """
      SELECT anomaly_type, count(*) AS flows FROM scored WHERE is_anomaly GROUP BY 1""")
    q["severity_bands"] = _with(SCORED, "SELECT severity, is_anomaly, count(*) AS flows FROM scored GROUP BY 1, 2")

    # ---- anomaly tables and reports
    q["anomalies_filter"] = _with(ANOMALIES, f"SELECT {ANOMALY_OUT} FROM anomalies WHERE is_anomaly AND severity = 'high'")
    q["anomalies_page"] = _with(ANOMALIES, f"SELECT {ANOMALY_OUT} FROM anomalies WHERE is_anomaly ORDER BY detected_at DESC, anomaly_id LIMIT 500 OFFSET 10")
    q["anomaly_lookup"] = _with(ANOMALIES, f"SELECT {ANOMALY_OUT} FROM anomalies WHERE anomaly_id = md5('10.0.0.9:40008|192.168.0.1:8080|HTTP') || '-0'")
    q["anomaly_display"] = _with(ANOMALIES, """
      SELECT anomaly_id, severity, anomaly_type, flow_id, CAST(round(ensemble_score * 100) AS BIGINT) AS score_percent, explanation FROM anomalies""")
    latest = ANOMALIES + """,
latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY capture_id, flow_id ORDER BY detected_at DESC, anomaly_id DESC) AS r FROM anomalies) WHERE r = 1)"""
    q["latest_anomaly"] = _with(latest, """
      SELECT f.capture_id, f.flow_id, f.protocol, f.packet_count, a.is_anomaly, a.anomaly_type, a.ensemble_score, a.severity, a.detected_at
      FROM flows f LEFT JOIN latest a USING (capture_id, flow_id)""")
    q["flow_anomaly_report"] = _with(latest, """
      SELECT f.flow_id, f.src_ip, f.dst_ip, CAST(f.src_port AS BIGINT) AS src_port, CAST(f.dst_port AS BIGINT) AS dst_port, f.protocol, f.start_time,
        round(f.duration_seconds, 6) AS duration_seconds, f.packet_count, f.byte_count, round(f.avg_packet_size, 6) AS avg_packet_size,
        round(f.packets_per_second, 6) AS packets_per_second, round(f.bytes_per_second, 6) AS bytes_per_second, f.tcp_syn_count, f.tcp_rst_count,
        coalesce(a.is_anomaly, false) AS is_anomaly, coalesce(a.anomaly_type, '') AS anomaly_type, a.ensemble_score AS anomaly_score,
        coalesce(a.severity, '') AS severity, coalesce(a.explanation, '') AS explanation
      FROM flows f LEFT JOIN latest a USING (capture_id, flow_id)""")
    q["live_union_dedupe"] = _with(ANOMALIES, """
      SELECT anomaly_id, flow_id, severity, CASE WHEN src = 0 THEN 'live' ELSE 'stored' END AS origin FROM (
        SELECT *, row_number() OVER (PARTITION BY anomaly_id ORDER BY src, position) AS r FROM (
          SELECT * FROM (SELECT 0 AS src, anomaly_id, flow_id, severity, row_number() OVER (ORDER BY detected_at DESC, anomaly_id) AS position
             FROM anomalies WHERE is_anomaly AND round_no = 0) WHERE position <= 100
          UNION ALL
          SELECT * FROM (SELECT 1, anomaly_id, flow_id, severity, row_number() OVER (ORDER BY detected_at DESC, anomaly_id) AS position
             FROM anomalies WHERE is_anomaly) WHERE position <= 500)) WHERE r = 1 ORDER BY src, position LIMIT 200""".replace(
        "round_no = 0", "anomaly_id LIKE '%-0'"))
    q["report_summary"] = _with(ANOMALIES, """
      SELECT metric, value FROM (
        SELECT (SELECT count(*) FROM packets WHERE us >= 1704067260000000) AS p,
               (SELECT count(*) FROM flows WHERE start_time >= 1704067260000000) AS f,
               (SELECT count(*) FROM anomalies WHERE is_anomaly AND detected_at >= 1704067260000000) AS a),
      LATERAL (VALUES ('Total Packets', CAST(p AS VARCHAR)), ('Total Flows', CAST(f AS VARCHAR)), ('Anomalies Detected', CAST(a AS VARCHAR)),
        ('Anomaly Rate', CASE WHEN f > 0 THEN printf('%.1f', CAST(a AS DOUBLE) / f * 100) || '%' ELSE 'N/A' END)) v(metric, value)""")
    q["top_anomalies"] = _with(ANOMALIES, """
      SELECT CASE WHEN length(flow_id) > 20 THEN substring(flow_id, 1, 20) || '…' ELSE flow_id END AS flow_id,
        coalesce(anomaly_type, 'unknown') AS type, severity, printf('%.3f', ensemble_score) AS score,
        CASE WHEN length(explanation) > 80 THEN substring(explanation, 1, 80) || '…' ELSE coalesce(explanation, '') END AS explanation
      FROM (SELECT * FROM anomalies WHERE is_anomaly ORDER BY ensemble_score DESC, anomaly_id LIMIT 20)""")
    q["json_report_parts"] = _with(ANOMALIES, """
      SELECT part, key, n FROM (
        SELECT 'protocol_breakdown' AS part, protocol AS key, count(*) AS n FROM packets GROUP BY protocol
        UNION ALL SELECT 'top_talkers', src_ip, n FROM (SELECT src_ip, count(*) AS n FROM packets GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10)
        UNION ALL SELECT 'summary', 'packet_count', count(*) FROM packets UNION ALL SELECT 'summary', 'flow_count', count(*) FROM flows
        UNION ALL SELECT 'summary', 'anomaly_count', count(*) FROM anomalies WHERE is_anomaly)""")
    q["json_report_document"] = q["json_report_parts"]
    q["csv_report"] = q["flow_anomaly_report"]

    # ---- sessions and messages
    q["session_gaps"] = """
      WITH e AS (SELECT user_id, event_id, epoch_us(ts) AS us FROM events),
      l AS (SELECT *, row_number() OVER w AS rn, lag(us) OVER w AS p FROM e WINDOW w AS (PARTITION BY user_id ORDER BY us, event_id)),
      s AS (SELECT *, sum(CASE WHEN rn = 1 OR us - p > 3600000000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY us, event_id) AS seg FROM l)
      SELECT user_id, min(us) AS first_us, max(us) AS last_us, count(*) AS events FROM s GROUP BY user_id, seg"""
    q["chat_history"] = """
      SELECT conv_id AS session_id, turn, role, text AS content, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS BIGINT) AS message_index
      FROM conversations"""
    q["session_rollup"] = """
      SELECT conv_id AS session_id, count(*) AS message_count, max(turn) AS last_active_at FROM conversations GROUP BY 1"""

    # ---- capture files: one file per capture and block of 20,000 ids, numbered from 0 in each file
    files = PACKETS + """,
filed AS (SELECT * REPLACE (capture_id || '-' || CAST(packet_id // 20000 AS VARCHAR) AS capture_id,
    row_number() OVER (PARTITION BY capture_id, packet_id // 20000 ORDER BY packet_id) - 1 AS packet_id) FROM packets)"""
    q["pcap_scan"] = _with(files, f"SELECT {PACKET_OUT} FROM filed")
    q["capture_files"] = _with(files, """
      SELECT capture_id, CAST(24 + sum(length + 16) AS BIGINT) AS length, count(*) AS packets, CAST(NULL AS VARCHAR) AS error FROM filed GROUP BY 1""")

    # ---- streams: everything up to the last row, run to the mark that ends the input
    q["protocol_minutes_stream"] = _with(PACKETS, """
      SELECT us // 60000000 * 60000000 AS minute, protocol, count(*) AS packets, CAST(sum(length) AS BIGINT) AS bytes FROM packets GROUP BY 1, 2""")
    q["packet_feed_stream"] = _with(PACKETS, """
      SELECT CAST(to_json({'type': 'packet', 'data': {'timestamp': strftime(make_timestamp(us), '%Y-%m-%dT%H:%M:%S.%f') || '+00:00',
        'src_ip': src_ip, 'dst_ip': dst_ip, 'src_port': src_port, 'dst_port': dst_port, 'protocol': protocol, 'length': length,
        'tcp_flags': tcp_flags, 'flow_id': flow_id, 'dns_query': dns_query, 'http_host': http_host}}) AS VARCHAR) AS value FROM packets""")
    q["capture_counters_stream"] = _with(PACKETS, """
      SELECT count(*) AS total_captured, CAST(0 AS BIGINT) AS total_dropped, CAST(0 AS BIGINT) AS queue_size FROM packets""")
    q["session_windows_stream"] = """
      WITH e AS (SELECT user_id, epoch_us(ts) AS us FROM events),
      l AS (SELECT *, row_number() OVER w AS rn, lag(us) OVER w AS p FROM e WINDOW w AS (PARTITION BY user_id ORDER BY us)),
      s AS (SELECT *, sum(CASE WHEN rn = 1 OR us - p > 3600000000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY us) AS seg FROM l)
      SELECT user_id AS session_id, min(us) AS started_at, max(us) + 3600000000 AS expires_at, count(*) AS message_count FROM s GROUP BY user_id, seg"""

    q["idle_flows_stream"] = _with(PACKETS + """,
idle_l AS (SELECT *, row_number() OVER w AS rn, lag(us) OVER w AS p FROM packets WINDOW w AS (PARTITION BY capture_id, flow_id ORDER BY us)),
idle_s AS (SELECT *, sum(CASE WHEN rn = 1 OR us - p > 120000000 THEN 1 ELSE 0 END) OVER (PARTITION BY capture_id, flow_id ORDER BY us) AS seg FROM idle_l)""", f"""
      SELECT capture_id, flow_id, min(us) AS start_time, max(us) AS end_time, count(*) AS packet_count, CAST(sum(length) AS BIGINT) AS byte_count
      FROM idle_s GROUP BY capture_id, flow_id, seg""")
    q["fuse_detectors"] = _with(SCORED, """
      SELECT capture_id, flow_id, round(ensemble_score, 6) AS ensemble_score, is_anomaly, anomaly_type, severity FROM scored""")
    q["json_report_anomalies"] = _with(ANOMALIES, """
      SELECT flow_id, anomaly_type AS type, severity, ensemble_score AS score, explanation,
        strftime(make_timestamp(detected_at), '%Y-%m-%dT%H:%M:%S.%f') || '+00:00' AS detected_at FROM anomalies WHERE is_anomaly""")
    q["report_registry"] = _with(ANOMALIES, """
      SELECT 'traffic' AS name, 'pdf' AS format, (SELECT count(*) FROM packets) AS packet_count, (SELECT count(*) FROM flows) AS flow_count,
        (SELECT count(*) FROM anomalies WHERE is_anomaly) AS anomaly_count""")

    q["report_lookup"] = q["report_registry"].replace("'traffic' AS name, 'pdf' AS format", "'other' AS name, 'csv' AS format")

    q.update(oracle_text.text_sql())
    return q
