"""Shared DuckDB fragments: the same payloads, windows, packets and frames in SQL."""

from __future__ import annotations

PAYLOADS = """payloads AS (
  SELECT d.doc_id, d.source, encode(d.text) AS payload,
         CASE WHEN l.toxic = 1 THEN 'bad' WHEN l.quality = 1 THEN 'gold' ELSE 'normal' END AS tier
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""


def windows(n: int, source: str = "payloads", name: str = "wins", keep: str = "doc_id, tier", data: str = "payload") -> str:
    """CTE of all n-byte windows as hex: ``keep``, i, gram_hex."""
    return f"""{name} AS (
  SELECT {keep}, i, lower(hex({data}[i + 1 : i + {n}])) AS gram_hex
  FROM (SELECT *, unnest(range(octet_length({data}) - {n - 1})) AS i
        FROM {source} WHERE octet_length({data}) >= {n}))"""


def gram_counts(by: str = "", source: str = "wins", name: str = "counts", where: str = "true") -> str:
    keys = f"{by}, gram_hex" if by else "gram_hex"
    return f"{name} AS (SELECT {keys}, count(*) AS cnt FROM {source} WHERE {where} GROUP BY {keys})"


def tiers(n: int = 5) -> str:
    """CTEs gold, bad, verdicts and normal of tier training."""
    return f"""WITH {PAYLOADS}, {windows(n)},
gold AS (SELECT gram_hex, count(*) AS cnt FROM wins WHERE tier = 'gold' GROUP BY gram_hex),
bad AS (SELECT gram_hex, count(*) AS cnt FROM wins WHERE tier = 'bad'
        AND gram_hex NOT IN (SELECT gram_hex FROM gold) GROUP BY gram_hex),
verdicts AS (
  SELECT w.doc_id, count(*) AS num_wins, count(b.gram_hex) AS hits, count(b.gram_hex) > count(*) // 20 AS denied
  FROM wins w LEFT JOIN bad b ON w.gram_hex = b.gram_hex WHERE w.tier = 'normal' GROUP BY w.doc_id),
accepted AS (SELECT w.* FROM wins w JOIN verdicts v ON w.doc_id = v.doc_id WHERE NOT v.denied),
normal AS (SELECT gram_hex, count(*) AS cnt FROM accepted
           WHERE gram_hex NOT IN (SELECT gram_hex FROM bad) GROUP BY gram_hex)"""


PACKETS = """base AS (
  SELECT event_id AS e, epoch_us(ts) AS ts_us, event_type AS kind, props, event_id % 2 = 0 AS forth,
         '10.0.' || (user_id // 256 % 256) || '.' || (user_id % 256) AS client,
         '192.168.0.' || (user_id % 8) AS server, 1024 + user_id % 64000 AS client_port,
         CASE event_type WHEN 'view' THEN 80 WHEN 'click' THEN 443 WHEN 'purchase' THEN 8080
                         WHEN 'signup' THEN 22 ELSE 53 END AS server_port
  FROM events),
packets AS (
  SELECT e AS packet_no, ts_us, CASE WHEN kind = 'error' THEN 17 ELSE 6 END AS proto,
         CASE WHEN forth THEN client ELSE server END AS src,
         CASE WHEN forth THEN server ELSE client END AS dst,
         CAST(CASE WHEN forth THEN client_port ELSE server_port END AS INTEGER) AS sport,
         CAST(CASE WHEN forth THEN server_port ELSE client_port END AS INTEGER) AS dport,
         CAST(CASE WHEN kind = 'error' THEN 0 ELSE e % 256 END AS INTEGER) AS flags,
         lower(hex(encode(CASE
           WHEN kind = 'view' AND forth THEN
             'GET /item/' || e || ' HTTP/1.1' || chr(13) || chr(10) || 'Host: h' || chr(13) || chr(10) || chr(13) || chr(10)
           WHEN kind = 'view' THEN
             'HTTP/1.1 200 OK' || chr(13) || chr(10) || 'Content-Length: 0' || chr(13) || chr(10) || chr(13) || chr(10)
           WHEN e % 10 = 7 THEN '' ELSE props END))) AS payload_hex
  FROM base)"""

_ADDRESS = "format('{{:02x}}{{:02x}}{{:02x}}{{:02x}}', {parts})"


def _address(column: str) -> str:
    parts = ", ".join(f"split_part({column}, '.', {i})::INT" for i in range(1, 5))
    return _ADDRESS.format(parts=parts)


FRAMES = f"""frames AS (
  SELECT packet_no, ts_us, proto, sport, dport, rpad(h, greatest(120, length(h))::INT, '0') AS frame_hex FROM (
    SELECT *, '020000000002020000000001' || CASE WHEN packet_no % 50 = 49 THEN '86dd' ELSE '0800' END || '4500'
      || format('{{:04x}}', length(payload_hex) // 2 + CASE proto WHEN 6 THEN 40 ELSE 28 END)
      || format('{{:04x}}', packet_no % 65536) || '400040' || format('{{:02x}}', proto) || '0000'
      || {_address('src')} || {_address('dst')}
      || CASE proto WHEN 6 THEN format('{{:04x}}{{:04x}}{{:08x}}', sport, dport, packet_no % 4294967296)
           || '0000000050' || format('{{:02x}}', flags) || '200000000000'
         ELSE format('{{:04x}}{{:04x}}{{:04x}}', sport, dport, length(payload_hex) // 2 + 8) || '0000' END
      || payload_hex AS h
    FROM packets))"""

# Packets that survive header decoding: every 50th frame is no IPv4.
DECODED = "decoded AS (SELECT * FROM packets WHERE packet_no % 50 <> 49)"
