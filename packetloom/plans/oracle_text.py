"""DuckDB SQL for text chunks, retrieval and explanations."""

from __future__ import annotations

from packetloom.operators.words import english_stop_words
from packetloom.plans.oracle import ANOMALIES, SCORED, _with


def tfidf_ctes(docs: str, doc_id: str, body: str, queries: str, query_id: str, query_text: str, scope: str = "0") -> str:
    """CTEs up to ``ranked`` (scope, query, document, score, rank); scope restricts matches."""
    stops = ", ".join("'" + w.replace("'", "''") + "'" for w in english_stop_words())

    def counted(name: str, table: str, key: str, text: str) -> str:
        return f"""
{name}_w AS (SELECT sc, id, w, row_number() OVER (PARTITION BY sc, id ORDER BY pos) AS pos FROM (
    SELECT {scope} AS sc, {key} AS id, unnest(regexp_extract_all(lower({text}), '[\\p{{L}}\\p{{N}}_]{{2,}}')) AS w,
      generate_subscripts(regexp_extract_all(lower({text}), '[\\p{{L}}\\p{{N}}_]{{2,}}'), 1) AS pos FROM {table})
    WHERE w NOT IN ({stops})),
{name}_t AS (SELECT sc, id, w AS term FROM {name}_w UNION ALL
    SELECT * FROM (SELECT sc, id, w || ' ' || lead(w) OVER (PARTITION BY sc, id ORDER BY pos) AS term FROM {name}_w) WHERE term IS NOT NULL),
{name}_c AS (SELECT sc, id, term, count(*) AS tf FROM {name}_t GROUP BY 1, 2, 3)"""

    return f"""{counted("d", docs, doc_id, body)},{counted("q", queries, query_id, query_text)},
idf AS (SELECT sc, term, df, ln((1.0 + n) / (1.0 + df)) + 1.0 AS idf FROM (SELECT sc, term, count(*) AS df FROM d_c GROUP BY 1, 2)
        JOIN (SELECT {scope} AS sc, count(*) AS n FROM {docs} GROUP BY 1) USING (sc)),
d_r AS (SELECT sc, id, term, tf, (1.0 + ln(tf)) * idf AS r FROM d_c JOIN idf USING (sc, term)),
q_r AS (SELECT sc, id, term, (1.0 + ln(tf)) * idf AS r FROM q_c JOIN idf USING (sc, term)),
d_v AS (SELECT sc, id, term, tf, r / sqrt(sum(r * r) OVER (PARTITION BY sc, id)) AS weight FROM d_r),
q_v AS (SELECT sc, id, term, r / sqrt(sum(r * r) OVER (PARTITION BY sc, id)) AS weight FROM q_r),
scored_pairs AS (SELECT q_v.sc, q_v.id AS query, d_v.id AS document, round(sum(q_v.weight * d_v.weight), 6) AS score
    FROM q_v JOIN d_v USING (sc, term) GROUP BY 1, 2, 3),
ranked AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY sc, query ORDER BY score DESC, document) AS rank
    FROM scored_pairs WHERE score > 0) WHERE rank <= 6)"""


def _listed(inner: str, item: str, order: str, n: int, sep: str) -> str:
    """Per capture, the first n items of ``inner`` joined by ``sep``."""
    return (f"(SELECT capture_id, string_agg(item, '{sep}' ORDER BY r) AS txt, count(*) AS c FROM (SELECT capture_id, {item} AS item, "
            f"row_number() OVER (PARTITION BY capture_id ORDER BY {order}) AS r FROM {inner}) WHERE r <= {n} GROUP BY 1)")


CHUNKS = SCORED + f""",
talker_rows AS (SELECT capture_id, src_ip AS ip, count(*) AS p, sum(length) AS b FROM packets GROUP BY 1, 2),
dns_rows AS (SELECT capture_id, dns_query AS name, min(packet_id) AS first FROM packets WHERE dns_query IS NOT NULL GROUP BY 1, 2),
host_rows AS (SELECT capture_id, http_host AS host, count(*) AS n FROM packets WHERE http_host IS NOT NULL GROUP BY 1, 2),
proto_rows AS (SELECT capture_id, protocol, count(*) AS n, sum(count(*)) OVER (PARTITION BY capture_id) AS total FROM packets GROUP BY 1, 2),
tcp_rows AS (SELECT * FROM scored WHERE protocol IN ('TCP', 'HTTP', 'HTTPS')),
scan_rows AS (SELECT capture_id, src_ip, list_sort(list(DISTINCT dst_port)) AS ports, min(first_packet_id) AS first
    FROM tcp_rows WHERE tcp_syn_count > 0 GROUP BY 1, 2 HAVING count(DISTINCT dst_port) >= 2),
chunks AS (
  SELECT c.capture_id, substring(md5('global_summary'), 1, 12) AS chunk_id, 'global_summary' AS category,
    'Capture file: ' || c.capture_id || '. Total packets: ' || c.n || '. Total data transferred: ' || printf('%.1f', c.b / 1024.0) || ' KB ('
    || printf('%.2f', c.b / 1048576.0) || ' MB). Capture duration: ' || printf('%.2f', c.d / 1000000.0) || ' seconds. Unique network flows: '
    || f.n || '. Anomalies detected: ' || f.a || '. Protocol breakdown: ' || p.txt || '.' AS content,
    CAST(to_json({{'total_packets': c.n, 'total_flows': f.n, 'duration_seconds': c.d / 1000000.0, 'anomaly_count': f.a}}) AS VARCHAR) AS metadata
  FROM (SELECT capture_id, count(*) AS n, CAST(sum(length) AS DOUBLE) AS b, max(us) - min(us) AS d FROM packets GROUP BY 1) c
  JOIN (SELECT capture_id, count(*) AS n, count(*) FILTER (is_anomaly) AS a FROM scored GROUP BY 1) f USING (capture_id)
  JOIN {_listed("proto_rows", "protocol || ' (' || n || ' packets, ' || printf('%.1f', CAST(n AS DOUBLE) / total * 100) || '%)'", "n DESC, protocol", 99, ", ")} p USING (capture_id)
  UNION ALL
  SELECT capture_id, substring(md5('top_talkers'), 1, 12), 'talker', 'Top hosts by data volume: ' || txt || '.', CAST(to_json({{'talkers': l}}) AS VARCHAR)
  FROM {_listed("talker_rows", "ip || ' sent ' || p || ' packets (' || printf('%.1f', b / 1024.0) || ' KB)'", "b DESC, ip", 8, "; ")}
  JOIN (SELECT capture_id, list({{'ip': ip, 'packets': p, 'bytes': CAST(b AS BIGINT)}} ORDER BY b DESC, ip)[1:10] AS l FROM talker_rows GROUP BY 1) USING (capture_id)
  UNION ALL
  SELECT capture_id, substring(md5('dns_events'), 1, 12), 'dns', 'DNS queries observed (' || n || ' unique domains): ' || txt || CASE WHEN n > 60 THEN '...' ELSE '.' END,
    CAST(to_json({{'query_count': n, 'queries': l}}) AS VARCHAR)
  FROM {_listed("dns_rows", "name", "first, name", 60, ", ")}
  JOIN (SELECT capture_id, count(*) AS n, list(name ORDER BY first, name)[1:100] AS l FROM dns_rows GROUP BY 1) USING (capture_id)
  UNION ALL
  SELECT capture_id, substring(md5('http_events'), 1, 12), 'http', 'HTTP traffic observed: ' || s || ' total requests to ' || m || ' distinct hosts. Top HTTP hosts: ' || txt || '.',
    CAST(to_json({{'request_count': s, 'host_count': m, 'hosts': l}}) AS VARCHAR)
  FROM {_listed("host_rows", "host || ' (' || n || ' requests)'", "n DESC, host", 20, "; ")} JOIN (SELECT capture_id, count(*) AS m, CAST(sum(n) AS BIGINT) AS s,
    map_from_entries(list({{'k': host, 'v': n}} ORDER BY n DESC, host)[1:20]) AS l FROM host_rows GROUP BY 1) USING (capture_id)
  UNION ALL
  SELECT capture_id, substring(md5('flow_' || flow_id), 1, 12), 'flow',
    'Flow ' || substring(flow_id, 1, 8) || ': ' || protocol || ' ' || src_ip || ':' || coalesce(CAST(src_port AS VARCHAR), '*') || ' → ' || dst_ip || ':'
    || coalesce(CAST(dst_port AS VARCHAR), '*') || '. Packets: ' || packet_count || ', bytes: ' || byte_count || ', duration: ' || printf('%.3f', duration_seconds)
    || 's, avg packet size: ' || printf('%.0f', avg_packet_size) || 'B, rate: ' || printf('%.1f', coalesce(packets_per_second, 0)) || ' pps / '
    || printf('%.1f', coalesce(bytes_per_second, 0) / 1024.0) || ' KB/s. '
    || CASE WHEN protocol IN ('TCP', 'HTTP', 'HTTPS') THEN 'TCP flags — SYN:' || tcp_syn_count || ' FIN:' || tcp_fin_count || ' RST:' || tcp_rst_count
       || ' ACK:' || tcp_ack_count || ' PSH:' || tcp_psh_count || '. ' ELSE '' END
    || CASE WHEN is_anomaly THEN 'ANOMALY DETECTED — type: ' || anomaly_type || ', severity: ' || severity || ', ensemble score: '
       || printf('%.3f', ensemble_score) || '. ' ELSE '' END,
    CAST(to_json({{'flow_id': flow_id, 'src_ip': src_ip, 'dst_ip': dst_ip, 'protocol': protocol, 'is_anomaly': is_anomaly, 'anomaly_type': anomaly_type}}) AS VARCHAR)
  FROM scored
  UNION ALL
  SELECT capture_id, substring(md5('anomaly_summary'), 1, 12), 'anomaly', 'Anomaly summary: ' || t.a || ' anomalous flows detected out of ' || t.n
    || ' total. Types observed: ' || k.txt || '. Severity breakdown: ' || s.txt || '. Anomalous flow IDs: ' || i.txt || CASE WHEN t.a > 20 THEN '...' ELSE '.' END,
    CAST(to_json({{'anomaly_count': t.a, 'by_type': mk.m, 'severity_counts': ms.m}}) AS VARCHAR)
  FROM (SELECT capture_id, count(*) AS n, count(*) FILTER (is_anomaly) AS a FROM scored GROUP BY 1) t
  JOIN {_listed("(SELECT capture_id, anomaly_type, count(*) AS n FROM scored WHERE is_anomaly GROUP BY 1, 2)", "n || ' ' || anomaly_type || ' event(s)'", "anomaly_type", 99, "; ")} k USING (capture_id)
  JOIN {_listed("(SELECT capture_id, severity, count(*) AS n FROM scored WHERE is_anomaly GROUP BY 1, 2)", "severity || ': ' || n", "severity", 99, ", ")} s USING (capture_id)
  JOIN {_listed("(SELECT * FROM scored WHERE is_anomaly)", "substring(flow_id, 1, 8)", "first_packet_id, flow_id", 20, ", ")} i USING (capture_id)
  JOIN (SELECT capture_id, map_from_entries(list({{'k': anomaly_type, 'v': n}} ORDER BY anomaly_type)) AS m FROM (
    SELECT capture_id, anomaly_type, count(*) AS n FROM scored WHERE is_anomaly GROUP BY 1, 2) GROUP BY 1) mk USING (capture_id)
  JOIN (SELECT capture_id, map_from_entries(list({{'k': severity, 'v': n}} ORDER BY severity)) AS m FROM (
    SELECT capture_id, severity, count(*) AS n FROM scored WHERE is_anomaly GROUP BY 1, 2) GROUP BY 1) ms USING (capture_id)
  UNION ALL
  SELECT capture_id, substring(md5('tcp_analysis'), 1, 12), 'tcp_analysis', 'TCP analysis over ' || h.n || ' TCP/HTTP/HTTPS flows: ' || h.i
    || ' flows with SYN but no ACK (possible incomplete handshakes or filtered ports). ' || h.r || ' flows with high RST count (possible connection rejections or scanning). '
    || h.t || ' flows show possible retransmission patterns (many small ACKs). ' || coalesce('Incomplete handshake flows involve: ' || x.txt || '. ', ''),
    CAST(to_json({{'tcp_flow_count': h.n, 'incomplete_handshakes': h.i, 'rst_storms': h.r, 'retransmission_hint_count': h.t}}) AS VARCHAR)
  FROM (SELECT capture_id, count(*) AS n, count(*) FILTER (tcp_syn_count > 0 AND tcp_ack_count = 0) AS i, count(*) FILTER (tcp_rst_count > 5) AS r,
          count(*) FILTER (packet_count > 10 AND avg_packet_size < 80 AND tcp_ack_count > packet_count * 0.6) AS t FROM tcp_rows GROUP BY 1) h
  LEFT JOIN {_listed("(SELECT * FROM tcp_rows WHERE tcp_syn_count > 0 AND tcp_ack_count = 0)", "src_ip || '→' || dst_ip || ':' || dst_port", "first_packet_id, flow_id", 10, ", ")} x USING (capture_id)
  UNION ALL
  SELECT capture_id, substring(md5('port_scan_heuristic'), 1, 12), 'port_scan', 'Potential port scan activity detected from ' || n || ' source IP(s). ' || txt, CAST(to_json({{'scanner_count': n}}) AS VARCHAR)
  FROM {_listed("scan_rows", "src_ip || ' probed ' || len(ports) || ' distinct ports (e.g. [' || array_to_string(ports[1:8], ', ') || ']).'", "first, src_ip", 5, " ")}
  JOIN (SELECT capture_id, count(*) AS n FROM scan_rows GROUP BY 1) USING (capture_id)
)"""

QUESTIONS = CHUNKS + """,
facts AS (
  SELECT capture_id, (SELECT count(*) FROM scored s WHERE s.capture_id = c.capture_id AND is_anomaly) AS a,
    (SELECT count(*) FROM dns_rows s WHERE s.capture_id = c.capture_id) AS d, (SELECT count(*) FROM host_rows s WHERE s.capture_id = c.capture_id) AS h,
    (SELECT count(*) FROM tcp_rows s WHERE s.capture_id = c.capture_id) AS t,
    (SELECT list(DISTINCT anomaly_type) FROM scored s WHERE s.capture_id = c.capture_id AND is_anomaly) AS kinds
  FROM (SELECT DISTINCT capture_id FROM packets) c
),
options AS (
  SELECT capture_id, pos, q FROM facts, LATERAL (VALUES
    (1, true, 'Give me a high-level summary of what happened in this capture.'), (2, true, 'Which hosts transferred the most data?'),
    (3, a > 0, 'Were any anomalies detected? What types and how severe?'), (4, a > 0, 'Which flows were flagged as suspicious and why?'),
    (5, d > 0, 'What DNS queries were made? Were any domains unusual?'),
    (6, t > 0, 'Were there any TCP handshake failures or connection issues?'), (7, t > 0, 'Explain the TCP connection patterns in this capture.'),
    (8, list_contains(kinds, 'port_scan'), 'Was there a port scan? Which host performed it and what ports were probed?'),
    (9, list_contains(kinds, 'dns_spike'), 'There seems to be a DNS spike — what caused it?'),
    (10, list_contains(kinds, 'data_exfiltration'), 'Is there evidence of data exfiltration in this capture?'),
    (11, h > 0, 'What HTTP hosts and endpoints were accessed?'), (12, true, 'Which protocols were used and in what proportion?'),
    (13, true, 'Were there any signs of retransmissions or packet loss?')) v(pos, ok, q) WHERE ok
),
questions AS (SELECT capture_id, question_id, q AS question FROM (
  SELECT *, row_number() OVER (PARTITION BY capture_id ORDER BY pos) AS question_id FROM options) WHERE question_id <= 10)"""


def _retrieval() -> str:
    body = QUESTIONS + "," + tfidf_ctes("chunks", "chunk_id", "content", "questions", "question_id", "question", "capture_id")
    return body + """,
summary_id AS (SELECT capture_id, chunk_id FROM chunks WHERE category = 'global_summary'),
merged0 AS (
  SELECT sc AS capture_id, query AS question_id, document AS chunk_id, score, rank FROM ranked
  UNION ALL
  SELECT q.capture_id, q.question_id, s.chunk_id, 1.0, 0 FROM questions q JOIN summary_id s USING (capture_id)
  WHERE NOT EXISTS (SELECT 1 FROM ranked r WHERE r.sc = q.capture_id AND r.query = q.question_id AND r.document = s.chunk_id)
),
merged AS (SELECT capture_id, question_id, chunk_id, score, row_number() OVER (PARTITION BY capture_id, question_id ORDER BY rank) AS rank FROM merged0),
full_rows AS (SELECT m.*, c.category, c.content, c.metadata FROM merged m JOIN chunks c USING (capture_id, chunk_id))"""


def text_sql() -> dict[str, str]:
    q: dict[str, str] = {}
    q["chunks_text"] = _with(CHUNKS, "SELECT capture_id, chunk_id, category, content, metadata FROM chunks")
    q["chunk_counts"] = _with(CHUNKS, "SELECT capture_id, category, count(*) AS chunks FROM chunks GROUP BY 1, 2")
    q["suggested_questions"] = _with(QUESTIONS, "SELECT capture_id, question_id AS question_no, question FROM questions")

    q["capture_summary"] = _with(CHUNKS, """
      SELECT capture_id, p.total_packets, p.total_bytes, p.duration_seconds, f.total_flows, f.total_anomalies, d.dns_query_count,
        pc.protocol_counts, t.top_talkers, ch.chunk_count
      FROM (SELECT capture_id, count(*) AS total_packets, CAST(sum(length) AS BIGINT) AS total_bytes,
              round((max(us) - min(us)) / 1000000.0, 6) AS duration_seconds, count(DISTINCT dns_query) AS x FROM packets GROUP BY 1) p
      JOIN (SELECT capture_id, count(*) AS total_flows, count(*) FILTER (is_anomaly) AS total_anomalies FROM scored GROUP BY 1) f USING (capture_id)
      JOIN (SELECT capture_id, count(DISTINCT dns_query) AS dns_query_count FROM packets GROUP BY 1) d USING (capture_id)
      JOIN (SELECT capture_id, string_agg(protocol || '=' || CAST(n AS VARCHAR), ',' ORDER BY protocol) AS protocol_counts FROM (
              SELECT capture_id, protocol, count(*) AS n FROM packets GROUP BY 1, 2) GROUP BY 1) pc USING (capture_id)
      JOIN (SELECT capture_id, string_agg(ip || '/' || CAST(packets AS VARCHAR) || '/' || CAST(bytes AS VARCHAR), ',' ORDER BY r) AS top_talkers FROM (
              SELECT *, row_number() OVER (PARTITION BY capture_id ORDER BY bytes DESC, ip) AS r FROM (
                SELECT capture_id, src_ip AS ip, count(*) AS packets, CAST(sum(length) AS BIGINT) AS bytes FROM packets GROUP BY 1, 2)) WHERE r <= 5 GROUP BY 1) t USING (capture_id)
      JOIN (SELECT capture_id, count(*) AS chunk_count FROM chunks GROUP BY 1) ch USING (capture_id)""")

    docs = tfidf_ctes("documents", "doc_id", "text", "benchmark", "item_id", "text")
    q["tfidf_terms"] = _with(docs, """
      SELECT id AS doc_id, count(*) AS terms, CAST(sum(tf) AS BIGINT) AS tokens, round(sum(weight), 4) AS weight_sum, round(max(weight), 4) AS top_weight
      FROM d_v GROUP BY 1""")
    q["tfidf_topk"] = _with(docs, "SELECT query AS item_id, document AS doc_id, score, rank FROM ranked")

    q["tfidf_postings_read"] = _with(docs, """
      SELECT q.id AS item_id, CAST(sum(df) AS BIGINT) AS postings_read FROM q_c q JOIN idf USING (sc, term) GROUP BY 1""")

    q["chat_retrieval"] = _with(_retrieval(), "SELECT capture_id, question_id, chunk_id, round(score, 6) AS score, rank, category FROM full_rows")
    q["context_budget"] = _with(_retrieval() + """,
      cum AS (SELECT *, coalesce(sum(length(content)) OVER (PARTITION BY capture_id, question_id ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM full_rows)""", """
      SELECT capture_id, question_id, string_agg('[' || upper(category) || '] ' || CASE WHEN before + length(content) > 700
        THEN substring(content, 1, CAST(700 - before AS BIGINT)) || '…' ELSE content END, chr(10) || chr(10) ORDER BY rank) AS context, count(*) AS sources_used
      FROM cum WHERE before < 700 GROUP BY 1, 2""")
    q["source_list"] = _with(_retrieval(), """
      SELECT capture_id, question_id, string_agg(category || '|' || substring(content, 1, 300) || '|' || printf('%.4f', round(score, 4)) || '|' || metadata, chr(10) ORDER BY rank) AS sources
      FROM full_rows WHERE rank <= 4 GROUP BY 1, 2""")

    q["answer_failures"] = _with(_retrieval(), """
      SELECT capture_id, question_id, trim('I was unable to generate an answer because the LLM provider returned an error: model not reachable'
        || '. Here is the most relevant context I found:' || chr(10) || chr(10) || coalesce(string_agg(content, chr(10) || chr(10) ORDER BY rank)
        FILTER (rank <= 3), '')) AS answer FROM full_rows GROUP BY 1, 2""")

    unit = """
unit AS (SELECT vec_id, label, list_transform(e, lambda x: x / CASE WHEN n = 0 THEN 1 ELSE n END) AS u FROM (
  SELECT vec_id, label, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS n FROM (
    SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings)))"""
    q["dense_normalise"] = _with(unit, """
      SELECT vec_id, CAST(len(u) AS BIGINT) AS dims, round(list_sum(list_transform(u, lambda x: x * x)), 6) AS length_sq,
        round(u[1], 6) AS first, round(u[len(u)], 6) AS last FROM unit""")
    nearest = unit + """,
parts AS (SELECT label, unnest(u) AS x, generate_subscripts(u, 1) AS pos FROM unit),
centre0 AS (SELECT label, list(m ORDER BY pos) AS c FROM (SELECT label, pos, avg(x) AS m FROM parts GROUP BY 1, 2) GROUP BY 1),
centre AS (SELECT label, list_transform(c, lambda x: x / n) AS c FROM (SELECT label, c, sqrt(list_sum(list_transform(c, lambda x: x * x))) AS n FROM centre0)),
nearest AS (SELECT CAST(label AS BIGINT) AS label, vec_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY score DESC, vec_id) AS rank FROM (
  SELECT c.label, u.vec_id, round(list_sum(list_transform(list_zip(u.u, c.c), lambda z: z[1] * z[2])), 6) AS score FROM unit u, centre c)) WHERE rank <= 6)"""
    q["dense_topk"] = _with(nearest, "SELECT label, vec_id, score, rank FROM nearest")
    q["dense_lsh"] = _with(nearest, "SELECT label, count(*) AS hits, max(score) AS best, true AS scores_exact, true AS recall_reached FROM nearest GROUP BY 1")
    q["retrieval_choice"] = _with(nearest + "," + docs, """
      SELECT label AS item_id, vec_id AS doc_id, score, rank FROM nearest
      UNION ALL SELECT query, document, score, rank FROM ranked WHERE query NOT IN (SELECT label FROM nearest)""")

    q["explanation_template"] = _with(SCORED, """
      SELECT capture_id, flow_id, CASE WHEN is_anomaly THEN 'Anomalous ' || protocol || ' flow detected (type: ' || anomaly_type || ', score: '
          || printf('%.2f', ensemble_score) || '). ' || packet_count || ' packets, ' || byte_count || ' bytes from ' || src_ip || ' to ' || dst_ip || '.'
        ELSE 'Normal ' || protocol || ' traffic from ' || src_ip || ' to ' || dst_ip || '. ' || packet_count || ' packets, ' || byte_count
          || ' bytes over ' || printf('%.1f', duration_seconds) || 's.' END AS explanation
      FROM scored""")
    def decimal(c: str, n: int) -> str:
        return f"regexp_replace(CAST(CAST(round(coalesce({c}, 0), {n}) AS DECIMAL(38,{n})) AS VARCHAR), '(\\.[0-9]+?)0+$', '\\1')"

    def quoted(c: str) -> str:
        return f"""coalesce('"' || {c} || '"', 'null')"""

    lines = {"flow_id": quoted("flow_id"), "src": quoted("src_ip || ':' || coalesce(CAST(src_port AS VARCHAR), '*')"),
             "dst": quoted("dst_ip || ':' || coalesce(CAST(dst_port AS VARCHAR), '*')"), "protocol": quoted("protocol"), "packet_count": "packet_count",
             "byte_count": "byte_count", "duration_seconds": decimal("duration_seconds", 3), "avg_packet_size": decimal("avg_packet_size", 1),
             "packets_per_second": decimal("packets_per_second", 2), "bytes_per_second": decimal("bytes_per_second", 2)}
    head = " || ',' || chr(10) || ".join(f"""'  "{k}": ' || {v}""" for k, v in lines.items())
    flags = " || ',' || chr(10) || ".join(f"""'    "{f}": ' || tcp_{f.lower()}_count""" for f in ("SYN", "FIN", "RST", "ACK", "PSH"))
    q["flow_prompts"] = _with(SCORED, f"""
      SELECT capture_id, flow_id, 'Network flow statistics:' || chr(10) || '{{' || chr(10) || {head} || ',' || chr(10)
        || '  "tcp_flags": {{' || chr(10) || {flags} || chr(10) || '  }}' || chr(10) || '}}' || chr(10) || chr(10)
        || 'Anomaly detection result:' || chr(10) || '{{' || chr(10) || '  "is_anomaly": ' || is_anomaly || ',' || chr(10)
        || '  "anomaly_type": ' || {quoted("anomaly_type")} || ',' || chr(10) || '  "ensemble_score": ' || {decimal("ensemble_score", 6)} || ',' || chr(10)
        || '  "severity": ' || {quoted("severity")} || chr(10) || '}}' || chr(10) || chr(10) || 'Explain this network flow in plain English.' AS prompt
      FROM scored""")
    q["explanations_fill"] = _with(ANOMALIES, """
      SELECT a.anomaly_id, coalesce(a.explanation, CASE WHEN s.is_anomaly THEN 'Anomalous ' || protocol || ' flow detected (type: ' || s.anomaly_type || ', score: '
          || printf('%.2f', s.ensemble_score) || '). ' || packet_count || ' packets, ' || byte_count || ' bytes from ' || src_ip || ' to ' || dst_ip || '.'
        ELSE 'Normal ' || protocol || ' traffic from ' || src_ip || ' to ' || dst_ip || '. ' || packet_count || ' packets, ' || byte_count
          || ' bytes over ' || printf('%.1f', duration_seconds) || 's.' END) AS explanation
      FROM anomalies a JOIN scored s USING (capture_id, flow_id)""")
    return q
