"""The same questions in SQL, written from the events and not from rendered text."""

from __future__ import annotations

from workload import adapter

_ENTRIES = adapter.ENTRIES_SQL.format(
    events="events", k="json_extract_string(props, '$.k')", time="TIMESTAMP", fields="d"
)

_IS_ERROR = "(coalesce(status, 0) >= 400 OR level IN ('ERROR', 'CRITICAL'))"
_SSH_FAILURE = "(source = 'ssh' AND event = 'failed')"
_SCAN = r"regexp_matches(coalesce(path, ''), '\.env|\.git|wp-login|\.php', 'i')"
_ISO = "strftime(ts, '%Y-%m-%dT%H:%M:%S')"


def _entries(select: str, more: str = "") -> str:
    return f"{_ENTRIES}{more}\n{select}"


def _top(column: str, n: int = 10, where: str = "TRUE") -> str:
    return (
        f"SELECT {column}, count(*) AS count FROM entries "
        f"WHERE {column} IS NOT NULL AND {where} "
        f"GROUP BY {column} ORDER BY count DESC, {column} LIMIT {n}"
    )


_OVERVIEW = (
    "SELECT count(*) AS total, count(*) FILTER (level IN ('ERROR','CRITICAL')) AS errors, "
    "count(*) FILTER (level = 'WARNING') AS warnings, "
    "round(count(*) FILTER (level IN ('ERROR','CRITICAL')) / count(*) * 100, 2) AS error_rate "
    "FROM entries"
)
_BRUTE_FORCE = f"""
SELECT ip, type, count, CASE WHEN count > 50 THEN 'HIGH' ELSE 'MEDIUM' END AS severity FROM (
  SELECT ip, 'ssh_brute_force' AS type, count(*) AS count FROM entries
  WHERE ip IS NOT NULL AND {_SSH_FAILURE} GROUP BY ip
  UNION ALL
  SELECT ip, 'http_brute_force', count(*) FROM entries
  WHERE ip IS NOT NULL AND status IN (401, 403) GROUP BY ip
) WHERE count >= 10"""
_HIGH_VOLUME = """
SELECT 'high_volume_ip' AS type, ip, count, round(pct, 1) AS pct,
       concat(ip, ' accounts for ', CAST(round(pct, 1) AS VARCHAR), '% of all requests') AS description,
       CASE WHEN pct > 40 THEN 'HIGH' ELSE 'MEDIUM' END AS severity
FROM (SELECT ip, count(*) AS count, count(*) / (SELECT count(*) FROM entries) * 100 AS pct
      FROM entries WHERE ip IS NOT NULL GROUP BY ip) WHERE pct > 20"""
_ERROR_RATE = f"""
SELECT 'high_error_rate' AS type, count, round(pct, 1) AS pct,
       concat('Error rate is ', CAST(round(pct, 1) AS VARCHAR), '% (', CAST(count AS VARCHAR), '/',
              CAST(total AS VARCHAR), ')') AS description,
       CASE WHEN pct > 25 THEN 'HIGH' ELSE 'MEDIUM' END AS severity
FROM (SELECT count(*) FILTER ({_IS_ERROR}) AS count, count(*) AS total,
             count(*) FILTER ({_IS_ERROR}) / count(*) * 100 AS pct FROM entries) WHERE pct > 10"""
_SCANNERS = f"""
SELECT 'scanner_detected' AS type, ip, count,
       concat(ip, ' appears to be scanning for vulnerabilities (', CAST(count AS VARCHAR), ' hits)') AS description,
       'HIGH' AS severity
FROM (SELECT ip, count(*) AS count FROM entries WHERE ip IS NOT NULL AND {_SCAN}
      GROUP BY ip ORDER BY count DESC, ip LIMIT 5) WHERE count >= 3"""
_ANOMALIES = f"""
SELECT type, ip, count, pct, description, severity FROM ({_HIGH_VOLUME})
UNION ALL SELECT type, NULL, count, pct, description, severity FROM ({_ERROR_RATE})
UNION ALL SELECT type, ip, count, NULL, description, severity FROM ({_SCANNERS})"""
_HOURLY = f"""
, hourly AS (
  SELECT date_trunc('hour', ts) AS h, count(*) AS total,
         count(*) FILTER (level IN ('ERROR','CRITICAL')) AS level_errors,
         count(*) FILTER (level = 'WARNING') AS warnings,
         count(*) FILTER ({_IS_ERROR}) AS errors
  FROM entries GROUP BY 1
), mean AS (SELECT sum(errors) / count(*) AS m FROM hourly)"""
_SPIKES = """
SELECT strftime(h, '%Y-%m-%d %H:00') AS "window", errors, total,
       round(errors / total * 100, 1) AS error_rate, round(errors / m, 1) AS vs_average
FROM hourly, mean WHERE total >= 5 AND errors > 3 * m AND errors >= 3 AND m > 0"""
_TIMELINE = """
SELECT strftime(h, '%Y-%m-%d %H:00') AS time, total, level_errors AS errors, warnings FROM hourly"""
# Compares all pairs of the two sides of an IP.
_CORRELATION = f"""
SELECT ip, ssh_event_count, http_event_count, minutes AS closest_gap_minutes,
       concat(ip, ': ', CAST(ssh_event_count AS VARCHAR), ' SSH auth failure(s) and ',
              CAST(http_event_count AS VARCHAR), ' HTTP 4xx/error request(s), closest pair ',
              CAST(minutes AS VARCHAR), ' min apart') AS description,
       CASE WHEN ssh_event_count >= 10 THEN 'HIGH' ELSE 'MEDIUM' END AS severity
FROM (
  SELECT s.ip, s.n AS ssh_event_count, h.n AS http_event_count,
         round(g.gap / 1000000 / 60, 1) AS minutes, g.gap
  FROM (SELECT ip, count(*) AS n FROM entries WHERE ip IS NOT NULL AND {_SSH_FAILURE} GROUP BY ip) s
  JOIN (SELECT ip, count(*) AS n FROM entries WHERE ip IS NOT NULL AND status >= 400 GROUP BY ip) h
    ON s.ip = h.ip
  JOIN (SELECT x.ip, min(abs(epoch_us(x.ts) - epoch_us(y.ts))) AS gap FROM entries x
        JOIN entries y ON x.ip = y.ip
        WHERE x.source = 'ssh' AND x.event = 'failed' AND y.status >= 400 GROUP BY x.ip) g
    ON s.ip = g.ip
) WHERE gap <= 600000000 AND (SELECT count(DISTINCT source) FROM entries) > 1"""
_GEO_TABLES = """
WITH asked AS (
  SELECT DISTINCT CASE WHEN event_id % 4 = 0 THEN 10 WHEN event_id % 4 = 1 THEN 5 ELSE 2 END AS o1,
         CAST(event_id % 256 AS INT) AS o2 FROM events
), lk AS (
  SELECT concat(CAST(o1 AS VARCHAR), '.', CAST(o2 AS VARCHAR), '.216.1') AS ip,
         CAST(o1 AS BIGINT) * 16777216 + o2 * 65536 + 55297 AS n FROM asked WHERE o1 <> 10
), net AS (
  SELECT CAST(83886080 AS BIGINT) AS lo, CAST(100663295 AS BIGINT) AS hi, 'Netherlands' AS country,
         'NL' AS country_code, 'Delft' AS city
  UNION ALL
  SELECT 33554432 + o2 * 65536, 33554432 + o2 * 65536 + 65535, 'United Kingdom', 'GB',
         concat('City', CAST(o2 AS VARCHAR))
  FROM (SELECT DISTINCT o2 FROM asked) t WHERE o2 % 3 <> 0
)"""
_ACCESS = (
    "source, ip, ts AS timestamp, method, path, status, size, user_agent, level, message"
)
_WEB_LEVEL = """CASE k % 8 WHEN 0 THEN 'DEBUG' WHEN 3 THEN 'WARNING' WHEN 4 THEN 'ERROR'
  WHEN 5 THEN 'CRITICAL' WHEN 6 THEN 'CRITICAL' WHEN 7 THEN 'CRITICAL' ELSE 'INFO' END"""
_PRIORITY_LEVEL = """CASE WHEN k % 8 <= 2 THEN 'CRITICAL' WHEN k % 8 = 3 THEN 'ERROR'
  WHEN k % 8 = 4 THEN 'WARNING' WHEN k % 8 = 7 THEN 'DEBUG'
  WHEN lower(message) LIKE '%failed%' THEN 'ERROR' ELSE 'INFO' END"""
_WINDOWS = f"""
, known(id, description, known_level) AS (VALUES
  (4625, 'Failed logon attempt', 'WARNING'), (4648, 'Explicit credentials logon', 'WARNING'),
  (4719, 'System audit policy changed', 'ERROR'), (4720, 'User account created', 'INFO'),
  (4722, 'User account enabled', 'INFO'), (4724, 'Password reset attempt', 'WARNING'),
  (4726, 'User account deleted', 'WARNING'), (4740, 'User account locked out', 'WARNING'),
  (4756, 'Member added to security group', 'INFO'),
  (4771, 'Kerberos pre-authentication failed', 'WARNING'),
  (1102, 'Audit log cleared', 'CRITICAL'), (7045, 'New service installed', 'WARNING')
), windows AS (
  SELECT entries.*, list_extract({adapter.EVENT_IDS}, k % {len(adapter.EVENT_IDS)} + 1) AS event_id FROM entries
), w AS (
  SELECT windows.*, known_level, concat('EventID ', CAST(event_id AS VARCHAR), ': ',
         coalesce(description, 'Windows event')) AS text
  FROM windows LEFT JOIN known ON event_id = id
)"""
_WINDOWS_XML = """
SELECT {seq}'windows_event' AS source,
       CASE WHEN k % 10 = 0 THEN concat('HOST', CAST(k AS VARCHAR)) ELSE ip END AS ip,
       ts AS timestamp,
       coalesce(known_level, CASE k % 6 WHEN 1 THEN 'CRITICAL' WHEN 2 THEN 'ERROR'
                WHEN 3 THEN 'WARNING' WHEN 5 THEN 'DEBUG' ELSE 'INFO' END) AS level,
       text AS message, 'Security' AS channel, CAST(event_id AS VARCHAR) AS event_id
FROM w"""


def _syslog(source: str) -> str:
    stamp = (
        "concat(strftime(ts, '%b'), ' ', lpad(CAST(day(ts) AS VARCHAR), 2, ' '), ' ', "
        "strftime(ts, '%H:%M:%S'))"
    )
    return _entries(
        f"SELECT seq, '{source}' AS source, ts AS timestamp, {_PRIORITY_LEVEL} AS level, message, "
        f"concat({stamp}, ' host svc[1]: ', message) AS raw, "
        "'host' AS host, 'svc' AS service, '1' AS pid FROM entries"
    )


_LISTED = {
    "top_ips": _top("ip"),
    "top_error_ips": _top("ip", where="level IN ('ERROR','CRITICAL')"),
    "top_paths": _top("path"),
    "top_status_codes": _top("status"),
    "top_methods": _top("method"),
    "top_user_agents": _top("user_agent"),
    "banned_ips": _top("ip", where="event = 'ban' AND source = 'fail2ban'"),
}
_KEYS = {
    "top_paths": "path", "top_status_codes": "status", "top_methods": "method",
    "top_user_agents": "user_agent",
}
_SECTION_ROWS = {
    **_LISTED,
    "brute_force": _BRUTE_FORCE,
    "anomalies": _ANOMALIES,
    "spike_windows": _SPIKES,
    "correlations": _CORRELATION,
    "timeline": _TIMELINE,
}
_ONLY = ", chosen AS (SELECT * FROM entries WHERE source IN ({sources}))"
_RUN = (
    "SELECT CAST({id} AS BIGINT) AS id, '{target}' AS target, (SELECT min(ts) FROM entries) AS log_start, total, "
    "errors, warnings, error_rate, (SELECT string_agg(source, ',' ORDER BY source) FROM "
    f"(SELECT DISTINCT source FROM entries)) AS sources FROM ({_OVERVIEW})"
)
_PLACED = {
    **{name: (_KEYS.get(name, "ip"), "count", f"count DESC, {_KEYS.get(name, 'ip')}") for name in _LISTED},
    "brute_force": ("ip", "count", "count DESC, ip, type"),
    "anomalies": (
        "coalesce(ip, type)", "count",
        "list_position(['high_volume_ip', 'high_error_rate', 'scanner_detected'], type), count DESC, ip",
    ),
    "spike_windows": ('"window"', "total", 'errors DESC, "window"'),
    "correlations": ("ip", "ssh_event_count", "closest_gap_minutes, ip"),
    "timeline": ("time", "total", "time"),
}


def _placed(*names: str) -> str:
    """Rows of report lists with their positions."""
    parts = []
    for name in names:
        key, count, order = _PLACED[name]
        parts.append(
            f"SELECT '{name}' AS section, row_number() OVER (ORDER BY {order}) - 1 AS position, "
            f"CAST({key} AS VARCHAR) AS key, CAST({count} AS BIGINT) AS count FROM ({_SECTION_ROWS[name]})"
        )
    return " UNION ALL ".join(parts)


_PATH = r"regexp_replace(split_part(url, '?', 1), '^[^/]*//[^/]*', '')"

ORACLES: dict[str, str] = {
    "overview": _entries(_OVERVIEW),
    "span_sources": _entries(
        "SELECT min(ts) AS start_time, max(ts) AS end_time, "
        "(SELECT string_agg(source, ',' ORDER BY source) FROM (SELECT DISTINCT source FROM entries)) "
        "AS sources FROM entries"
    ),
    "sources": _entries("SELECT source, count(*) AS total FROM entries GROUP BY source"),
    "top_ips": _entries(_LISTED["top_ips"]),
    "top_ips_first_seen": _entries(
        "SELECT ip, count FROM (SELECT ip, count(*) AS count, "
        "min(concat(source, ':', lpad(CAST(seq AS VARCHAR), 18, '0'))) AS first_seen "
        "FROM entries WHERE ip IS NOT NULL GROUP BY ip) ORDER BY count DESC, first_seen LIMIT 40"
    ),
    "top_error_ips": _entries(_LISTED["top_error_ips"]),
    "top_paths": _entries(_LISTED["top_paths"]),
    "top_status": _entries(_LISTED["top_status_codes"]),
    "top_methods": _entries(_LISTED["top_methods"]),
    "top_agents": _entries(_LISTED["top_user_agents"]),
    "banned_ips": _entries(_LISTED["banned_ips"]),
    "by_hour": _entries(
        "SELECT CAST(hour(ts) AS INT) AS hour, count(*) AS count FROM entries GROUP BY 1"
    ),
    "by_weekday": _entries("SELECT dayname(ts) AS weekday, count(*) AS count FROM entries GROUP BY 1"),
    "peaks": _entries(
        "SELECT (SELECT CAST(hour(ts) AS INT) FROM entries GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS peak_hour, "
        "(SELECT dayname(ts) FROM entries GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS peak_weekday"
    ),
    "hour_profile": _entries(
        "SELECT CAST(h AS INT) AS hour, count(seq) AS count FROM range(24) r(h) "
        "LEFT JOIN entries ON hour(ts) = h GROUP BY 1"
    ),
    "weekday_profile": _entries(
        "SELECT CAST(d AS INT) AS day, name AS weekday, count(seq) AS count FROM (VALUES "
        "(0, 'Monday'), (1, 'Tuesday'), (2, 'Wednesday'), (3, 'Thursday'), (4, 'Friday'), "
        "(5, 'Saturday'), (6, 'Sunday')) w(d, name) LEFT JOIN entries ON dayname(ts) = name GROUP BY 1, 2"
    ),
    "timeline": _entries(_TIMELINE, _HOURLY),
    "spikes": _entries(_SPIKES, _HOURLY),
    "brute_force": _entries(_BRUTE_FORCE),
    "high_volume": _entries(_HIGH_VOLUME),
    "error_rate_anomaly": _entries(_ERROR_RATE),
    "scanners": _entries(_SCANNERS),
    "anomalies": _entries(_ANOMALIES),
    "correlation": _entries(_CORRELATION),
    "geo": _GEO_TABLES + " SELECT ip, country, country_code, city FROM lk JOIN net ON n BETWEEN lo AND hi",
    "public_ips": _entries(
        "SELECT ip, count(*) AS count, CAST(NOT (ip LIKE '10.%' OR ip LIKE '203.0.113.%') AS INT) AS public FROM ("
        "SELECT concat(CASE WHEN event_id % 4 = 0 THEN '10' WHEN event_id % 4 = 1 THEN '5' ELSE '2' END, "
        "'.', CAST(event_id % 256 AS VARCHAR), '.216.1') AS ip FROM events "
        "UNION ALL SELECT ip FROM entries) WHERE ip IS NOT NULL GROUP BY ip"
    ),
    "entry_flags": _entries(
        f"SELECT seq, CAST({_IS_ERROR} AS INT) AS is_error, "
        "CAST(coalesce(status BETWEEN 400 AND 499, FALSE) AS INT) AS is_client_error, "
        "CAST(coalesce(status >= 500, FALSE) AS INT) AS is_server_error, "
        f"CAST(coalesce({_SSH_FAILURE}, FALSE) AS INT) AS ssh_failure, "
        f"CAST({_SCAN} AS INT) AS scanner_path, CAST(hour(ts) AS INT) AS hour, dayname(ts) AS weekday, "
        "strftime(ts, '%Y-%m-%d %H:00') AS hour_label FROM entries"
    ),
    "ingest_nginx": _entries(
        f"SELECT seq, {_ACCESS}, CASE WHEN k % 2 = 0 THEN concat('http://r.example/', CAST(k AS VARCHAR)) END AS referer "
        "FROM entries WHERE source = 'nginx'"
    ),
    "ingest_apache": _entries(f"SELECT seq, {_ACCESS} FROM entries WHERE source = 'apache'"),
    "ingest_nginx_error": _entries(
        f"SELECT seq, 'nginx' AS source, ts AS timestamp, {_WEB_LEVEL} AS level, message, "
        "CAST(user_id AS VARCHAR) AS pid FROM entries"
    ),
    "ingest_apache_error": _entries(
        f"SELECT seq, 'apache' AS source, ip, {_WEB_LEVEL} AS level, "
        "message, 'core' AS module, CAST(user_id AS VARCHAR) AS pid FROM entries"
    ),
    "ingest_syslog": _syslog("syslog"),
    "ingest_systemd": _syslog("systemd"),
    "ingest_ssh": _entries(
        "SELECT seq, source, ip, ts AS timestamp, level, message, concat('u', CAST(user_id AS VARCHAR)) AS user, "
        "CASE WHEN event = 'accepted' THEN 'publickey' END AS auth_method, event "
        "FROM entries WHERE source = 'ssh'"
    ),
    "ingest_fail2ban": _entries(
        "SELECT seq, source, ip, ts AS timestamp, level, message, 'actions' AS component, event "
        "FROM entries WHERE source = 'fail2ban'"
    ),
    "ingest_browser": _entries(
        "SELECT seq, 'browser' AS source, ts AS timestamp, "
        "level, path, message, CAST(k AS VARCHAR) AS line FROM entries"
    ),
    "ingest_har": _entries(
        "SELECT 'har' AS source, timestamp, level, method, path, status, size, user_agent, "
        "concat(method, ' ', url, ' ', CAST(status AS VARCHAR)) AS message, url, time_ms, mime_type FROM ("
        "SELECT ts AS timestamp, level, method, path, status, size, user_agent, "
        "concat('https://h.example', path, '?seq=', CAST(seq AS VARCHAR)) AS url, "
        "CAST(k AS VARCHAR) AS time_ms, 'text/html' AS mime_type FROM entries WHERE status IS NOT NULL)"
    ),
    "ingest_windows_xml": _entries(_WINDOWS_XML.format(seq=""), _WINDOWS),
    "ingest_windows_lines": _entries(_WINDOWS_XML.format(seq="seq, "), _WINDOWS),
    "ingest_windows_json": _entries(
        "SELECT 'windows_event' AS source, ts AS timestamp, coalesce(known_level, 'INFO') AS level, "
        "text AS message, CAST(event_id AS VARCHAR) AS \"EventID\", CAST(seq AS VARCHAR) AS \"Record\" FROM w",
        _WINDOWS,
    ),
    "ingest_custom": _entries(
        "SELECT seq, 'shopd' AS source, CASE WHEN seq % 5 <> 0 THEN coalesce(ip, '-') END AS ip, "
        "CASE WHEN seq % 5 <> 0 THEN ts END AS timestamp, CASE WHEN seq % 5 = 0 THEN 'INFO' ELSE CASE k % 6 WHEN 0 THEN 'DEBUG' "
        "WHEN 2 THEN 'WARNING' WHEN 3 THEN 'ERROR' WHEN 4 THEN 'CRITICAL' ELSE 'INFO' END END AS level, "
        "CASE WHEN seq % 5 <> 0 THEN coalesce(method, 'NONE') END AS method, "
        "CASE WHEN seq % 5 <> 0 THEN coalesce(path, '/none') END AS path, "
        "CASE WHEN seq % 5 <> 0 THEN coalesce(status, 299) END AS status, "
        "CASE WHEN seq % 5 = 0 THEN message ELSE '' END AS message FROM entries WHERE seq % 7 <> 0"
    ),
    "all_formats": _entries(
        "SELECT source, level, count(*) AS total, min(ts) AS start_time, max(ts) AS end_time "
        "FROM entries GROUP BY source, level"
    ),
    "rejects": _entries("SELECT seq, message AS line FROM entries WHERE source <> 'nginx'"),
    "detect_format": (
        "SELECT file_name, CASE WHEN n LIKE '%.har' THEN 'har' WHEN n LIKE '%.xml' THEN 'windows' "
        "WHEN n LIKE '%.json' THEN 'browser' WHEN n LIKE '%nginx%' THEN 'nginx' "
        "WHEN n LIKE '%apache%' OR n LIKE '%httpd%' THEN 'apache' "
        "WHEN n LIKE '%auth%' OR n LIKE '%secure%' OR n LIKE '%ssh%' THEN 'ssh' "
        "WHEN n LIKE '%fail2ban%' THEN 'fail2ban' WHEN n LIKE '%syslog%' OR n LIKE '%messages%' THEN 'syslog' "
        "WHEN n LIKE '%journal%' OR n LIKE '%systemd%' THEN 'systemd' ELSE 'nginx' END AS format FROM ("
        "SELECT file_name, lower(file_name) AS n FROM (SELECT concat(CAST(event_id AS VARCHAR), '-', "
        f"list_extract({adapter.FILE_NAMES}, CAST(event_id % {len(adapter.FILE_NAMES)} AS INT) + 1)) AS file_name FROM events))"
    ),
    "url_path": (
        f"SELECT page_id, url, CASE WHEN {_PATH} = '' THEN '/' ELSE {_PATH} END AS path FROM pages"
    ),
    "tail": _entries(
        "SELECT source, seq, ts AS timestamp, message FROM (SELECT *, row_number() OVER "
        "(PARTITION BY source ORDER BY seq DESC) AS r FROM entries) WHERE r <= 50"
    ),
    "cap": _entries(
        "SELECT source, count(*) AS count FROM (SELECT source FROM entries ORDER BY source, seq LIMIT 3000) "
        "GROUP BY source"
    ),
    "status_class": _entries(
        "SELECT *, CASE WHEN status >= 500 THEN 'Server Error' WHEN status >= 400 THEN 'Client Error' "
        "WHEN status >= 300 THEN 'Redirect' ELSE 'Success' END AS status_class "
        f"FROM ({_LISTED['top_status_codes']})"
    ),
    "error_band": _entries(
        "SELECT error_rate, CASE WHEN error_rate > 10 THEN 'error' WHEN error_rate > 5 THEN 'warn' "
        f"ELSE 'ok' END AS band FROM ({_OVERVIEW})"
    ),
    "bar_share": _entries(
        "SELECT ip, count, CAST(floor(count / max(count) OVER () * 18) AS INT) AS bar "
        f"FROM ({_LISTED['top_ips']})"
    ),
    "hour_bars": _entries(
        "SELECT hour, count, CAST(floor(count / max(count) OVER () * 28) AS INT) AS bar FROM ("
        "SELECT CAST(h AS INT) AS hour, count(seq) AS count FROM range(24) r(h) "
        "LEFT JOIN entries ON hour(ts) = h GROUP BY 1)"
    ),
    "alerts": _entries(
        f"SELECT level, source, message, ip, {_ISO} AS timestamp FROM entries WHERE {_IS_ERROR}"
    ),
    "watch_lines": _entries(
        "SELECT CASE WHEN source = 'nginx' THEN strftime(ts, '%H:%M:%S') END AS time, "
        "CASE WHEN source = 'nginx' THEN ip END AS ip, CASE WHEN source = 'nginx' THEN status END AS status, "
        "CASE WHEN source = 'nginx' THEN level END AS level, message AS text FROM entries"
    ),
    "run_alert": _entries(
        f"SELECT CAST(1 AS BIGINT) AS run, (SELECT count(*) FROM ({_ANOMALIES})) AS anomalies, "
        f"(SELECT count(*) FROM ({_BRUTE_FORCE})) AS brute_force, errors, total FROM ({_OVERVIEW}) "
        "WHERE anomalies > 0 OR brute_force > 0"
    ),
    "report_lists": _entries(
        " UNION ALL ".join(
            f"SELECT '{name}' AS section, CAST({_KEYS.get(name, 'ip')} AS VARCHAR) AS key, count FROM ({sql})"
            for name, sql in _LISTED.items()
        )
    ),
    "report_record": _entries(
        f"SELECT 'meta' AS section, 0 AS position, key, value FROM (UNPIVOT (SELECT CAST(total AS VARCHAR) AS total, "
        f"CAST(errors AS VARCHAR) AS errors, CAST(warnings AS VARCHAR) AS warnings FROM ({_OVERVIEW})) "
        "ON total, errors, warnings INTO NAME key VALUE value) "
        "UNION ALL SELECT 'meta', 0, 'start_time', strftime(min(ts), '%Y-%m-%dT%H:%M:%S') FROM entries "
        "UNION ALL SELECT 'meta', 0, 'end_time', strftime(max(ts), '%Y-%m-%dT%H:%M:%S') FROM entries "
        "UNION ALL SELECT 'meta', 0, 'sources', string_agg(source, ',' ORDER BY source) FROM (SELECT DISTINCT source FROM entries) "
        "UNION ALL (SELECT 'temporal', 0, 'peak_hour', CAST(hour(ts) AS VARCHAR) FROM entries GROUP BY hour(ts) "
        "ORDER BY count(*) DESC, hour(ts) LIMIT 1) "
        "UNION ALL (SELECT 'temporal', 0, 'peak_weekday', dayname(ts) FROM entries GROUP BY dayname(ts) "
        "ORDER BY count(*) DESC, 4 LIMIT 1) "
        "UNION ALL SELECT 'by_hour', 0, CAST(hour(ts) AS VARCHAR), CAST(count(*) AS VARCHAR) FROM entries GROUP BY hour(ts) "
        "UNION ALL SELECT 'by_weekday', 0, dayname(ts), CAST(count(*) AS VARCHAR) FROM entries GROUP BY dayname(ts) UNION ALL "
        + " UNION ALL ".join(
            f"SELECT '{name}', CAST(row_number() OVER (ORDER BY count DESC, {_KEYS.get(name, 'ip')}) AS INT) - 1, "
            f"CAST({_KEYS.get(name, 'ip')} AS VARCHAR), CAST(count AS VARCHAR) FROM ({sql})"
            for name, sql in _LISTED.items()
        )
    ),
    "report_rows": _entries(_placed(*_SECTION_ROWS), _HOURLY),
    "report_pages": _entries(
        f"SELECT 'spike_windows' AS page, \"window\" AS key FROM (SELECT * FROM ({_SPIKES}) ORDER BY errors DESC, \"window\" LIMIT 5) "
        f"UNION ALL SELECT 'top_paths', path FROM ({_LISTED['top_paths']})", _HOURLY
    ),
    "report_json": _entries(_LISTED["top_paths"]),
    "history_latest": " UNION ALL ".join(
        f"SELECT * FROM ({_entries(_RUN.format(id=i, target=target), _ONLY.format(sources=sources)).replace('FROM entries', 'FROM chosen')})"
        for i, target, sources in (
            (2, "ssh+nginx", "'ssh', 'nginx'"), (3, "ssh+nginx+apache+fail2ban", "'ssh', 'nginx', 'apache', 'fail2ban'"),
        )
    ).replace("SELECT * FROM chosen WHERE", "SELECT * FROM entries WHERE"),
    "run_lookup": _entries(
        f"SELECT CAST(1 AS BIGINT) AS id, 'events' AS target, * FROM ({_TIMELINE})", _HOURLY
    ),
    "run_findings": _entries(_placed("brute_force", "anomalies", "spike_windows", "correlations", "timeline"), _HOURLY),
    "blank_lines": _entries(
        "SELECT seq, ip, CASE WHEN seq % 10 <> 0 THEN ts END AS timestamp, status FROM entries WHERE source = 'nginx'"
    ),
    "timeless": _entries(
        "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:00') AS time, count(*) AS total, "
        "count(*) FILTER (level IN ('ERROR', 'CRITICAL')) AS errors, count(*) FILTER (level = 'WARNING') AS warnings "
        "FROM entries WHERE source = 'nginx' AND seq % 10 <> 0 GROUP BY 1"
    ),
    "ssh_relevance": _entries(
        "SELECT CAST(source = 'ssh' OR contains(message, 'sshd') AS INT) AS parsed, "
        "CASE WHEN source = 'ssh' THEN level ELSE 'INFO' END AS level, count(*) AS total FROM entries GROUP BY 1, 2"
    ),
    "registered_format": _entries(
        "SELECT seq, 'numbered' AS source, k AS status, message FROM entries WHERE seq % 9 <> 0"
    ),
    "ingest_browser_files": _entries(
        "SELECT 'browser' AS source, ts AS timestamp, level, path, "
        "concat(message, CASE WHEN k % 3 = 0 THEN ' }, {\"x\": [' ELSE '' END) AS message, CAST(seq AS VARCHAR) AS line FROM entries"
    ),
    "ingest_windows_any": _entries(
        "SELECT 'windows_event' AS source, ts AS timestamp, coalesce(known_level, CASE WHEN k % 2 = 1 THEN 'INFO' ELSE "
        "CASE k % 6 WHEN 2 THEN 'ERROR' ELSE 'INFO' END END) AS level, text AS message FROM w",
        _WINDOWS,
    ),
    "rejects_documents": _entries("SELECT concat('lost words ', CAST(seq AS VARCHAR)) AS line FROM entries WHERE seq % 4 = 0"),
    "geo_dense": (
        "WITH n AS (SELECT DISTINCT event_id % 50000 AS n FROM events) "
        "SELECT concat('9.9.', CAST(n // 256 AS VARCHAR), '.', CAST(n % 256 AS VARCHAR)) AS ip, "
        "concat('City', CAST(n AS VARCHAR)) AS city FROM n WHERE n % 3 <> 0 "
        "UNION ALL SELECT concat('2a00:1450:', lower(printf('%x', n)), '::', CAST(n % 7 + 1 AS VARCHAR)), "
        "concat('City', CAST(n AS VARCHAR)) FROM n WHERE n % 3 <> 0"
    ),
    "live_hours": _entries(
        "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:00') AS time, count(*) AS total, "
        "count(*) FILTER (level IN ('ERROR', 'CRITICAL')) AS errors, count(*) FILTER (level = 'WARNING') AS warnings, "
        "CAST(seq % 40 = 0 AND day(ts) <= 9 AS INT) AS late FROM entries GROUP BY time, late"
    ),
    "compacted": _entries(
        "SELECT source, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, level, count(*) AS total FROM entries GROUP BY 1, 2, 3"
    ),
    "entries_table": _entries(
        "SELECT source, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, level, count(*) AS total FROM entries GROUP BY 1, 2, 3"
    ),
    "live_ingest": _entries(f"SELECT {_ACCESS} FROM entries"),
    "live_alerts": _entries(
        f"SELECT level, source, message, ip, {_ISO} AS timestamp FROM entries WHERE {_IS_ERROR}"
    ),
    "recurring_run": _entries(
        f"SELECT CAST(2 AS BIGINT) AS run, (SELECT count(*) FROM ({_ANOMALIES})) AS anomalies, "
        f"(SELECT count(*) FROM ({_BRUTE_FORCE})) AS brute_force, errors, total FROM ({_OVERVIEW}) "
        "WHERE anomalies > 0 OR brute_force > 0"
    ),
}
