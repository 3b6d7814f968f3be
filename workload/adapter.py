"""Log entries, and raw log text in every format, derived from the ``events`` table.

The tables hold no logs, so each event is read as one log entry: its type gives
the source, its user the IP, and the number in its properties the rest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: A shop's own log: requests in one form, other messages in another.
CUSTOM_CONFIG = {
    "name": "shopd",
    "pattern": (
        r"\[(?P<sev>\w+)\] (?P<when>\d\d\.\d\d\.\d{4} \d\d:\d\d:\d\d) client=(?P<client>\S+) "
        r"(?P<verb>[A-Z]+) (?P<target>\S+) -> (?P<code>\d+)"
        r"|\[(?P<rank>\w+)\] note: (?P<text>.+)"
    ),
    "time_field": "when",
    "time_format": "%d.%m.%Y %H:%M:%S",
    "level_field": "sev",
    "ip_field": "client",
    "method_field": "verb",
    "path_field": "target",
    "status_field": "code",
    "message_field": "text",
    "level_map": {"trace": "DEBUG", "fyi": "INFO", "odd": "WARNING", "broken": "ERROR", "dead": "CRITICAL"},
}

#: Level names that the rendered web error logs cycle through.
WEB_NAMES = ["debug", "info", "notice", "warn", "error", "crit", "alert", "emerg"]
#: Event numbers that the rendered Windows events cycle through; two are not known ones.
EVENT_IDS = [
    4624, 4625, 4648, 4719, 4720, 4722, 4724, 4726, 4740, 4756, 4771, 1102, 7045, 9999,
]
#: File names that the format detection is tried on.
FILE_NAMES = [
    "trace.har", "Security.XML", "console.json", "nginx-access.log", "apache2.log",
    "HTTPD_error", "auth.log", "secure", "sshd.log", "fail2ban.log", "syslog.1",
    "messages", "journal.txt", "systemd.out", "access.log",
]
#: Documents hold this many events each.
CHUNK = 100


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Entries of the events, as SQL that both engines run. Only the words in braces differ.
ENTRIES_SQL = """
WITH b AS (
  SELECT event_id AS seq, ts, user_id, event_type, CAST({k} AS INT) AS k FROM {events}
), c AS (
  SELECT seq, ts, user_id, k,
    CASE event_type WHEN 'signup' THEN 'ssh' WHEN 'error' THEN 'fail2ban'
                    WHEN 'purchase' THEN 'apache' ELSE 'nginx' END AS source,
    CASE WHEN user_id % 4 = 0 THEN '203.0.113.7'
         ELSE concat('10.0.', CAST(CAST(floor(user_id / 256) AS INT) AS VARCHAR(20)), '.',
                     CAST(user_id % 256 AS VARCHAR(20))) END AS address
  FROM b
), d AS (
  SELECT *,
    CASE WHEN source IN ('nginx','apache') THEN
      CASE WHEN k < 60 THEN 200 WHEN k < 70 THEN 301 WHEN k < 78 THEN 401
           WHEN k < 84 THEN 403 WHEN k < 92 THEN 404 ELSE 500 END END AS status,
    CASE WHEN source = 'ssh' THEN
           CASE WHEN k < 70 THEN 'failed' WHEN k < 90 THEN 'accepted' ELSE 'disconnect' END
         WHEN source = 'fail2ban' THEN
           CASE WHEN k % 2 = 0 THEN 'ban' WHEN k % 3 = 0 THEN 'unban' ELSE 'info' END END AS event,
    CASE WHEN source IN ('nginx','apache') THEN
      CASE k % 20 WHEN 1 THEN '/.env' WHEN 2 THEN '/wp-login.php' WHEN 3 THEN '/a/.git/config'
           ELSE concat('/item/', CAST(k AS VARCHAR(20))) END END AS path,
    CASE WHEN source IN ('nginx','apache') THEN
      CASE WHEN k % 5 = 0 THEN 'POST' WHEN k % 11 = 0 THEN 'PUT' ELSE 'GET' END END AS method,
    CASE WHEN source IN ('nginx','apache') THEN
      CASE k % 3 WHEN 0 THEN 'Mozilla/5.0' WHEN 1 THEN 'curl/8.0' END END AS user_agent,
    CASE WHEN source IN ('nginx','apache') AND k % 7 <> 0 THEN CAST(k * 100 AS BIGINT) END AS size
  FROM c
), e AS (
  SELECT *,
    CASE WHEN source = 'nginx' AND status = 500
         THEN CAST(date_trunc('day', ts) AS {time}) + INTERVAL '3' HOUR
              + (ts - CAST(date_trunc('hour', ts) AS {time}))
         ELSE ts END AS moved,
    CASE WHEN status >= 500 THEN 'ERROR' WHEN status >= 400 THEN 'WARNING'
         WHEN event IN ('failed','ban') THEN 'WARNING' ELSE 'INFO' END AS level
  FROM {fields}
), entries AS (
  SELECT seq, user_id, k, event, source, CAST(date_trunc('second', moved) AS {time}) AS ts, level,
    CASE WHEN source = 'fail2ban' AND event = 'info' THEN NULL ELSE address END AS ip,
    method, path, status, size, user_agent,
    CASE WHEN status IS NOT NULL THEN concat(method, ' ', path, ' ', CAST(status AS VARCHAR(20)))
         WHEN event = 'failed'
           THEN concat('SSH login failed: u', CAST(user_id AS VARCHAR(20)), ' from ', address)
         WHEN event = 'accepted'
           THEN concat('SSH login accepted: u', CAST(user_id AS VARCHAR(20)), ' via publickey')
         WHEN event = 'disconnect' THEN concat('SSH disconnect: u', CAST(user_id AS VARCHAR(20)))
         WHEN event = 'ban' THEN concat('[sshd] Ban ', address)
         WHEN event = 'unban' THEN concat('[sshd] Unban ', address)
         ELSE '[sshd] Found nothing' END AS message
  FROM e
)"""


# Fields computed once per event. Without the generated row, every filter on an
# entry would be rewritten in terms of the events, many times over.
_ONCE = (
    "(SELECT x.* FROM (SELECT struct(*) AS row FROM d) LATERAL VIEW explode(array(row)) t AS x)"
)


def _entries_sql(spark: SparkSession, events: DataFrame, select: str) -> DataFrame:
    sql = ENTRIES_SQL.format(
        events="{events}", k="get_json_object(props, '$.k')", time="TIMESTAMP_NTZ", fields=_ONCE
    )
    return spark.sql(f"{sql} {select}", events=events)


def event_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entry fields of every event, with ``seq``, ``user_id``, ``k`` and ``event``."""
    events = table(spark, sf_dir, "events").select(
        "event_id", "ts", "user_id", "event_type", "props"
    )
    return _entries_sql(spark, events, "SELECT *, ts AS timestamp FROM entries")


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as entries; the source stands for the file, the number for the line."""
    return _entries_sql(
        spark,
        table(spark, sf_dir, "events"),
        """SELECT source, message AS raw, ts AS timestamp, level, ip, method, path, status, size,
        user_agent, message,
        CASE WHEN event IS NOT NULL THEN map('event', event)
             ELSE CAST(map() AS MAP<STRING, STRING>) END AS extra,
        source AS file, CAST(0 AS BIGINT) AS block_start, seq AS mid FROM entries""",
    )


def _text(*parts: Column | str) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


def _pick(values: list, index: Column) -> Column:
    return F.get(F.array(*map(F.lit, values)), index % len(values))


def _lines(df: DataFrame, value: Column) -> DataFrame:
    return df.select(
        value.alias("value"), F.lit("").alias("file"), F.lit(0).cast("bigint").alias("block_start"),
        F.col("seq").alias("mid"),
    )


def _request() -> Column:
    c = F.col
    referer = F.when(c("k") % 2 == 0, _text("http://r.example/", c("k"))).otherwise("-")
    return _text(
        "[", F.date_format("timestamp", "dd/MMM/yyyy:HH:mm:ss"), ' +0000] "', c("method"), " ",
        c("path"), ' HTTP/1.1" ', c("status"), " ", F.coalesce(c("size").cast("string"), F.lit("-")),
        ' "', referer, '" "', F.coalesce("user_agent", F.lit("-")), '"',
    )


def nginx_lines(df: DataFrame) -> DataFrame:
    return _lines(df.where(F.col("source") == "nginx"), _text(F.col("ip"), " - - ", _request()))


def apache_lines(df: DataFrame) -> DataFrame:
    user = F.col("user_id")
    line = _text(F.col("ip"), " ident u", user, " ", _request())
    return _lines(df.where(F.col("source") == "apache"), line)


def nginx_error_lines(df: DataFrame) -> DataFrame:
    line = _text(
        F.date_format("timestamp", "yyyy/MM/dd HH:mm:ss"), " [", _pick(WEB_NAMES, F.col("k")), "] ",
        F.col("user_id"), "#0: *", F.col("seq"), " ", F.col("message"),
    )
    return _lines(df, line)


def apache_error_lines(df: DataFrame) -> DataFrame:
    client = F.when(F.col("ip").isNotNull(), _text(" [client ", F.col("ip"), ":", F.col("k"), "]"))
    line = _text(
        "[", F.date_format("timestamp", "EEE MMM dd HH:mm:ss yyyy"), "] [core:",
        _pick(WEB_NAMES, F.col("k")), "] [pid ", F.col("user_id"), "]",
        F.coalesce(client, F.lit("")), " ", F.col("message"),
    )
    return _lines(df, line)


def _syslog_head() -> Column:
    day = F.lpad(F.date_format("timestamp", "d"), 2, " ")
    return _text(F.date_format("timestamp", "MMM"), " ", day, " ", F.date_format("timestamp", "HH:mm:ss"))


def syslog_lines(df: DataFrame) -> DataFrame:
    line = _text("<", F.col("k") % 8, ">", _syslog_head(), " host svc[1]: ", F.col("message"))
    return _lines(df, line)


def ssh_lines(df: DataFrame) -> DataFrame:
    who, ip, event = _text("u", F.col("user_id")), F.col("ip"), F.col("event")
    text = (
        F.when(event == "failed", _text("Failed password for ", who, " from ", ip, " port 22 ssh2"))
        .when(event == "accepted", _text("Accepted publickey for ", who, " from ", ip, " port 22 ssh2"))
        .otherwise(_text("Disconnected from user ", who, " ", ip, " port 22"))
    )
    line = _text(_syslog_head(), " host sshd[1]: ", text)
    return _lines(df.where(F.col("source") == "ssh"), line)


def fail2ban_lines(df: DataFrame) -> DataFrame:
    line = _text(
        F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss"),
        ",000 fail2ban.actions [1]: NOTICE  ", F.col("message"),
    )
    return _lines(df.where(F.col("source") == "fail2ban"), line)


def browser_lines(df: DataFrame) -> DataFrame:
    stamp = F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss'.000Z'")
    record = F.struct(
        F.lower("level").alias("level"), "message", stamp.alias("timestamp"),
        F.col("path").alias("url"), F.col("k").alias("line"),
    )
    return _lines(df, F.to_json(record))


def _documents(df: DataFrame, item: Column, document) -> DataFrame:
    """Documents of at most ``CHUNK`` items each."""
    chunk = F.floor(F.col("seq") / CHUNK).alias("seq")
    grouped = df.groupBy(chunk).agg(
        F.array_sort(F.collect_list(F.struct("seq", item.alias("item")))).alias("items")
    )
    items = F.transform("items", lambda x: x["item"])
    return _lines(grouped, document(items))


def har_documents(df: DataFrame) -> DataFrame:
    web = df.where(F.col("status").isNotNull())
    headers = F.array(
        F.struct(F.lit("Host").alias("name"), F.lit("h.example").alias("value")),
        F.struct(F.lit("USER-agent").alias("name"), F.col("user_agent").alias("value")),
    )
    request = F.struct(
        "method",
        _text("https://h.example", F.col("path"), "?seq=", F.col("seq")).alias("url"),
        headers.alias("headers"),
    )
    response = F.struct(
        "status",
        F.coalesce("size", F.lit(-1)).alias("bodySize"),
        F.struct(F.lit("text/html").alias("mimeType")).alias("content"),
    )
    pair = F.struct(
        F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss'.123+02:00'").alias("startedDateTime"),
        F.col("k").alias("time"),
        request.alias("request"), response.alias("response"),
    )
    return _documents(
        web, pair, lambda items: F.to_json(F.struct(F.struct(items.alias("entries")).alias("log")))
    )


def event_id() -> Column:
    return _pick(EVENT_IDS, F.col("k"))


def _event_xml() -> Column:
    stamp = F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss'.0000000Z'")
    host = F.when(F.col("k") % 10 == 0, _text("\\\\HOST", F.col("k"))).otherwise("-")
    return _text(
        '<Event xmlns="http://schemas.microsoft.com/win/2004/08/events/event"><System><EventID>',
        event_id(), "</EventID><Level>", F.col("k") % 6, '</Level><TimeCreated SystemTime="', stamp,
        '"/><Channel>Security</Channel></System><EventData><Data Name="IpAddress">',
        F.coalesce("ip", F.lit("-")), '</Data><Data Name="WorkstationName">', host,
        "</Data></EventData></Event>",
    )


def windows_xml_lines(df: DataFrame) -> DataFrame:
    return _lines(df, _event_xml())


def windows_xml_documents(df: DataFrame) -> DataFrame:
    return _documents(
        df, _event_xml(),
        lambda items: _text("<Events>", F.array_join(items, ""), "</Events>"),
    )


def windows_json_documents(df: DataFrame) -> DataFrame:
    record = F.struct(
        event_id().alias("EventID"),
        F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss'.000Z'").alias("TimeCreated"),
        F.col("seq").alias("Record"),
    )
    return _documents(df, record, F.to_json)


def custom_lines(df: DataFrame) -> DataFrame:
    """Requests, every fifth line a note, every seventh one of neither form."""
    name = _pick(["trace", "fyi", "odd", "BROKEN", "dead", "other"], F.col("k"))
    request = _text(
        "[", name, "] ", F.date_format("timestamp", "dd.MM.yyyy HH:mm:ss"), " client=", F.coalesce("ip", F.lit("-")), " ",
        F.coalesce("method", F.lit("NONE")), " ", F.coalesce("path", F.lit("/none")), " -> ",
        F.coalesce(F.col("status"), F.lit(299)).cast("string"), " tail",
    )
    note = _text("[", name, "] note: ", F.col("message"))
    other = _text("x ", request)
    seq = F.col("seq")
    return _lines(df, F.when(seq % 7 == 0, other).when(seq % 5 == 0, note).otherwise(request))


def odd_nginx_lines(df: DataFrame) -> DataFrame:
    """Access lines: blank ones before every sixth, and no time in every tenth."""
    request = _request()
    timeless = F.regexp_replace(request, r"\A\[[^\]]*\]", "[no time]")
    line = _text(F.col("ip"), " - - ", F.when(F.col("seq") % 10 == 0, timeless).otherwise(request))
    shown = F.when(F.col("seq") % 6 == 0, F.array(F.lit("  \t"), F.lit(""), line)).otherwise(F.array(line))
    lines = df.where(F.col("source") == "nginx").select(F.explode(shown).alias("value"), "seq")
    return _lines(lines, F.col("value"))


def all_ssh_lines(df: DataFrame) -> DataFrame:
    """The SSH events, and all others as lines of other daemons in the same file."""
    other = df.where(F.col("source") != "ssh")
    line = _text(_syslog_head(), " host cron[1]: (root) CMD (", F.col("message"), ")")
    return ssh_lines(df).unionByName(_lines(other, line))


def strayed_xml_documents(df: DataFrame) -> DataFrame:
    """Documents of events with words lost before every fourth event."""
    lost = _text("lost words ", F.col("seq"), " ")
    item = F.when(F.col("seq") % 4 == 0, _text(lost, _event_xml())).otherwise(_event_xml())
    return _documents(df, item, lambda items: _text("<Events>", F.array_join(items, ""), "</Events>"))


def browser_documents(df: DataFrame) -> DataFrame:
    """Console messages as arrays, spread over lines; braces and quotes stand in their texts."""
    stamp = F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss'.000Z'")
    message = _text(F.col("message"), F.when(F.col("k") % 3 == 0, ' }, {"x": [').otherwise(""))
    record = F.struct(
        F.lower("level").alias("level"), message.alias("message"), stamp.alias("timestamp"),
        F.col("path").alias("url"), F.col("seq").alias("line"),
    )
    return _documents(df, F.to_json(record), lambda items: _text("[ ", F.array_join(items, ",\n  "), "\n]"))


def landed(spark: SparkSession, folder: str, lines: dict[str, DataFrame]) -> None:
    """Lines written as text and moved into a folder as finished files, named after their format."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path
    files = path(folder).getFileSystem(conf)
    files.mkdirs(path(folder))
    for name, rows in lines.items():
        written = f"{folder}-written-{name}"
        rows.select("value").write.text(written)
        for status in files.globStatus(path(f"{written}/part-*")):
            start, end = name.rsplit(".", 1)
            files.rename(status.getPath(), path(f"{folder}/{start}-{status.getPath().getName()}.{end}"))


def dense_networks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Many small networks in one /16 of IPv4 and one /32 of IPv6: two of three numbers have one."""
    n = (F.col("event_id") % 50_000).alias("n")
    numbers = table(spark, sf_dir, "events").select(n).distinct().where(F.col("n") % 3 != 0)
    v4 = _text("9.9.", F.floor(F.col("n") / 256).cast("int"), ".", (F.col("n") % 256).cast("int"), "/32")
    v6 = _text("2a00:1450:", F.lower(F.hex("n")), "::/48")
    city = _text("City", F.col("n")).alias("city")
    each = numbers.select(F.explode(F.array(v4, v6)).alias("network"), city)
    return each.select("network", F.lit("Country").alias("country"), F.lit("CC").alias("country_code"), "city")


def dense_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = (F.col("event_id") % 50_000).cast("int").alias("n")
    numbers = table(spark, sf_dir, "events").select(n).distinct()
    v4 = _text("9.9.", F.floor(F.col("n") / 256).cast("int"), ".", F.col("n") % 256)
    v6 = _text("2a00:1450:", F.lower(F.hex("n")), "::", F.lower(F.hex(F.col("n") % 7 + 1)))
    return numbers.select(F.explode(F.array(v4, v6)).alias("ip"))


def geo_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries whose IPs are partly public, for geolocation."""
    seq = F.col("event_id")
    first = F.when(seq % 4 == 0, 10).when(seq % 4 == 1, 5).otherwise(2)
    ip = _text(first, ".", seq % 256, ".216.1")
    return table(spark, sf_dir, "events").select(ip.alias("ip"))


def geo_networks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Networks derived from the events: one /8, and a /16 for most second numbers."""
    second = (F.col("event_id") % 256).alias("o2")
    blocks = table(spark, sf_dir, "events").select(second).distinct().where(F.col("o2") % 3 != 0)
    lo = 33554432 + F.col("o2") * 65536
    small = blocks.select(
        lo.alias("lo"), (lo + 65535).alias("hi"), F.lit("United Kingdom").alias("country"),
        F.lit("GB").alias("country_code"), _text("City", F.col("o2")).alias("city"),
    )
    wide = spark.range(1).select(
        F.lit(83886080).cast("bigint").alias("lo"), F.lit(100663295).cast("bigint").alias("hi"),
        F.lit("Netherlands").alias("country"), F.lit("NL").alias("country_code"),
        F.lit("Delft").alias("city"),
    )
    return small.unionByName(wide)
