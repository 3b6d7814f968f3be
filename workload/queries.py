"""The registered queries: one per operator, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logweir.functions import addresses, display, predicates, times
from logweir.functions.text import url_path
from logweir.operators import (
    correlation,
    detections,
    geo,
    limits,
    overview,
    temporal,
    topn,
)
from logweir.plans.history import append_run, findings, latest_runs, run_result
from logweir.plans.report import REPORT_DDL, Report
from logweir.plans.shared import new_path, settled
from logweir.plans.store import compact, read_entries, write_entries, write_tagged
from logweir.schema import PARSED
from logweir.sources import documents, web, xml
from logweir.sources.custom import custom
from logweir.sources.lines import lines_of
from logweir.sources.registry import detect_format, entries_of, formats, line_format, register_format, rejects_of
from logweir.streaming import hours
from logweir.streaming.hours import start_hours
from logweir.streaming.live import alerts, display as display_rows
from logweir.streaming.live import start_alert_files, start_ingest
from logweir.streaming.recurring import recurring_run, run_alert
from workload import adapter

Query = Callable[[SparkSession, str], DataFrame]

# Log times without a year are of the year of the events.
YEAR = 2024


def _on_entries(operator: Callable[..., DataFrame], **options) -> Query:
    return lambda spark, sf_dir: operator(adapter.entries(spark, sf_dir), **options)


def _ingested(render, parse, fields: list[str], extra: tuple[str, ...] = ()) -> Query:
    """Render the events as text of a format, ingest it, and show the fields."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        tagged = parse(render(adapter.event_entries(spark, sf_dir)))
        return _shown(entries_of(tagged), fields, extra)

    return query


def _shown(entries: DataFrame, fields: list[str], extra: tuple[str, ...] = ()) -> DataFrame:
    chosen = [F.col("mid").alias("seq") if f == "seq" else F.col(f) for f in fields]
    return entries.select(*chosen, *(F.element_at("extra", key).alias(key) for key in extra))


_ACCESS = [
    "seq", "source", "ip", "timestamp", "method", "path", "status", "size", "user_agent",
    "level", "message",
]


def _span_sources(spark, sf_dir):
    rows = overview.summary(adapter.entries(spark, sf_dir))
    return rows.select("start_time", "end_time", F.array_join("sources", ",").alias("sources"))


def _hour_profile(spark, sf_dir):
    return temporal.hour_profile(temporal.by_hour(adapter.entries(spark, sf_dir)))


def _weekday_profile(spark, sf_dir):
    return temporal.weekday_profile(temporal.by_weekday(adapter.entries(spark, sf_dir)))


def _correlation(spark, sf_dir):
    return correlation.correlations(adapter.entries(spark, sf_dir)).drop("sources")


def _geo(spark, sf_dir):
    networks = geo.networks_from_ranges(adapter.geo_networks(spark, sf_dir))
    return geo.geo(adapter.geo_addresses(spark, sf_dir), networks, ips="all").drop("isp")


def _public_ips(spark, sf_dir):
    asked = adapter.geo_addresses(spark, sf_dir).unionByName(
        adapter.entries(spark, sf_dir).select("ip")
    )
    counted = asked.where(predicates.has("ip")).groupBy("ip").agg(F.count(F.lit(1)).alias("count"))
    return addresses.with_public(counted, "ip").withColumn("public", F.col("public").cast("int"))


def _entry_flags(spark, sf_dir):
    p = predicates
    return adapter.entries(spark, sf_dir).select(
        F.col("mid").alias("seq"),
        p.is_error().cast("int").alias("is_error"),
        p.is_client_error().cast("int").alias("is_client_error"),
        p.is_server_error().cast("int").alias("is_server_error"),
        p.ssh_failure().cast("int").alias("ssh_failure"),
        p.scanner_path().cast("int").alias("scanner_path"),
        times.hour(F.col("timestamp")).alias("hour"),
        times.weekday(F.col("timestamp")).alias("weekday"),
        times.hour_label(times.hour_bucket(F.col("timestamp"))).alias("hour_label"),
    )


def _windows_files(spark, sf_dir):
    """Event files, written to the shared folder and read back split by event."""
    path = new_path(spark, "windows-xml")
    files = adapter.windows_xml_documents(adapter.event_entries(spark, sf_dir))
    files.select("value").write.text(path)
    fields = ["source", "ip", "timestamp", "level", "message"]
    return _shown(entries_of(xml.read_windows(spark, path)), fields, ("channel", "event_id"))


def _har(docs: DataFrame) -> DataFrame:
    return documents.har(docs)


def _windows_json(docs: DataFrame) -> DataFrame:
    return documents.windows_json(documents.json_elements(docs))


def _detect_format(spark, sf_dir):
    name = F.concat(
        F.col("event_id").cast("string"),
        F.lit("-"),
        F.get(F.array(*map(F.lit, adapter.FILE_NAMES)),
              (F.col("event_id") % len(adapter.FILE_NAMES)).cast("int")),
    )
    files = adapter.table(spark, sf_dir, "events").select(name.alias("file_name"))
    return files.select("file_name", detect_format(F.col("file_name")).alias("format"))


def _url_path(spark, sf_dir):
    pages = adapter.table(spark, sf_dir, "pages")
    return pages.select("page_id", "url", url_path(F.col("url")).alias("path"))


def _tail(spark, sf_dir):
    rows = limits.tail(adapter.entries(spark, sf_dir), 50)
    return rows.select("source", F.col("mid").alias("seq"), "timestamp", "message")


def _cap(spark, sf_dir):
    capped = limits.cap(adapter.entries(spark, sf_dir), 3000)
    return topn.top_values(capped, "source", 10)


def _status_class(spark, sf_dir):
    rows = topn.top_status_codes(adapter.entries(spark, sf_dir))
    return rows.select("*", display.status_class(F.col("status")).alias("status_class"))


def _error_band(spark, sf_dir):
    rows = overview.overview(adapter.entries(spark, sf_dir))
    return rows.select("error_rate", display.error_rate_band(F.col("error_rate")).alias("band"))


def _bar_share(spark, sf_dir):
    rows = topn.top_ips(adapter.entries(spark, sf_dir))
    return rows.select("ip", "count", display.bar_share(rows, 18).alias("bar"))


def _hour_bars(spark, sf_dir):
    rows = _hour_profile(spark, sf_dir)
    return rows.select("hour", "count", display.bar_share(rows, 28).alias("bar"))


def _alerts(spark, sf_dir):
    return alerts(adapter.entries(spark, sf_dir))


def _watch_lines(spark, sf_dir):
    """Access lines, with the messages of all other sources as lines of no format."""
    return display_rows(web.nginx(_mixed_lines(spark, sf_dir)))


def _mixed_lines(spark, sf_dir):
    df = adapter.event_entries(spark, sf_dir)
    other = df.where(F.col("source") != "nginx").select(
        F.col("message").alias("value"), F.lit("").alias("file"),
        F.lit(0).cast("bigint").alias("block_start"), F.col("seq").alias("mid"),
    )
    return adapter.nginx_lines(df).unionByName(other)


def _rejects(spark, sf_dir):
    rows = rejects_of(web.nginx(_mixed_lines(spark, sf_dir)))
    return rows.select(F.col("mid").alias("seq"), F.col("raw").alias("line"))


def _all_formats(spark, sf_dir):
    """Four formats ingested and united, then counted by source and level."""
    df = adapter.event_entries(spark, sf_dir)
    united = None
    for name, render, options in (
        ("nginx", adapter.nginx_lines, {}),
        ("apache", adapter.apache_lines, {}),
        ("ssh", adapter.ssh_lines, {"year": YEAR}),
        ("fail2ban", adapter.fail2ban_lines, {}),
    ):
        part = entries_of(line_format(name, **options)(render(df)))
        united = part if united is None else united.unionByName(part)
    return united.groupBy("source", "level").agg(
        F.count(F.lit(1)).alias("total"),
        F.min("timestamp").alias("start_time"),
        F.max("timestamp").alias("end_time"),
    )


def _run_alert(spark, sf_dir):
    entries = adapter.entries(spark, sf_dir)
    return run_alert(
        1, overview.overview(entries), detections.anomalies(entries),
        detections.brute_force(entries),
    )


def _report(spark, sf_dir) -> Report:
    networks = geo.networks_from_ranges(adapter.geo_networks(spark, sf_dir))
    return Report(adapter.entries(spark, sf_dir), networks=networks)


def _recorded(spark, sf_dir) -> str:
    folder = new_path(spark, "history")
    append_run(_report(spark, sf_dir), folder, "events")
    return folder


_LISTED = {
    "top_ips": "ip", "top_error_ips": "ip", "top_paths": "path", "top_status_codes": "status",
    "top_methods": "method", "top_user_agents": "ua", "banned_ips": "ip",
}


def _report_lists(spark, sf_dir):
    """Every ranking of the one-record report, as rows with their places."""
    document = _report(spark, sf_dir).document()

    def listed(name: str, key: str):
        def row(x):
            return F.struct(
                F.lit(name).alias("section"), x[key].cast("string").alias("key"),
                x["count"].alias("count"),
            )

        return F.transform(F.col(name), row)

    lists = F.flatten(F.array(*(listed(*item) for item in _LISTED.items())))
    return document.select(F.inline(lists))


def _report_record(spark, sf_dir):
    """The record as it is read back from JSON: figures, hours, weekdays, peaks and rankings."""
    written = _report(spark, sf_dir).document().select(F.to_json(F.struct("*")).alias("json"))
    record = written.select(F.from_json("json", REPORT_DDL).alias("r")).select("r.*")

    def item(section: str, position, key, value):
        return F.struct(
            F.lit(section).alias("section"), position.cast("int").alias("position"),
            key.cast("string").alias("key"), value.cast("string").alias("value"),
        )

    first = F.lit(0)
    single = [
        item("meta", first, F.lit(name), F.col(f"meta.{name}"))
        for name in ("total", "errors", "warnings", "start_time", "end_time")
    ]
    single += [
        item("meta", first, F.lit("sources"), F.array_join("meta.sources", ",")),
        item("temporal", first, F.lit("peak_hour"), F.col("temporal.peak_hour")),
        item("temporal", first, F.lit("peak_weekday"), F.col("temporal.peak_weekday")),
    ]
    lists = [F.array(*single)]

    def counted(name: str):
        pairs = F.map_entries(F.col(f"temporal.{name}"))
        return F.transform(pairs, lambda x: item(name, F.lit(0), x["key"], x["value"]))

    def ranked(name: str, key: str):
        return F.transform(F.col(name), lambda x, i: item(name, i, x[key], x["count"]))

    lists += [counted(name) for name in ("by_hour", "by_weekday")]
    lists += [ranked(name, key) for name, key in _LISTED.items()]
    return record.select(F.inline(F.flatten(F.array(*lists))))


def _row_text(name: str):
    return F.get_json_object("item", f"$.{name}")


def _keyed(rows: DataFrame) -> DataFrame:
    """Rows of report lists by what names them and what they count."""
    names = ("window", "time", "path", "status", "method", "ua", "ip", "type")
    counts = ("count", "total", "ssh_event_count")
    return rows.select(
        "section", F.col("position").cast("bigint").alias("position"),
        F.coalesce(*map(_row_text, names)).alias("key"),
        F.coalesce(*map(_row_text, counts)).cast("bigint").alias("count"),
    )


def _report_rows(spark, sf_dir):
    """Every row of every list of the full report with its position."""
    return _keyed(Report(adapter.entries(spark, sf_dir)).rows())


def _report_pages(spark, sf_dir):
    """The cuts of lists that report pages show, in full and in short."""
    report = _report(spark, sf_dir)
    spikes = report.page("spike_windows").select(F.lit("spike_windows").alias("page"), F.col("window").alias("key"))
    paths = report.page("top_paths", short=True).select(F.lit("top_paths").alias("page"), F.col("path").alias("key"))
    return spikes.unionByName(paths)


def _history_latest(spark, sf_dir):
    """Three runs over more and more sources, the newest two listed."""
    entries, folder = adapter.entries(spark, sf_dir), new_path(spark, "history")
    for sources in (["ssh"], ["ssh", "nginx"], ["ssh", "nginx", "apache", "fail2ban"]):
        append_run(Report(entries.where(F.col("source").isin(sources))), folder, "+".join(sources))
    return latest_runs(spark, folder, 2).select(
        "id", "target", "log_start", "total", "errors", "warnings", "error_rate",
        F.array_join("sources", ",").alias("sources"),
    )


def _run_lookup(spark, sf_dir):
    """A run and its hours, which are among its findings."""
    folder = _recorded(spark, sf_dir)
    hours = findings(spark, folder, 1).where(F.col("section") == "timeline")
    item = F.from_json("item", "time string, total bigint, errors bigint, warnings bigint")
    run = run_result(spark, folder, 1).select("id", "target")
    return hours.select(F.lit(1).cast("bigint").alias("id"), item.alias("item")).join(
        run, "id"
    ).select("id", "target", "item.*")


def _run_findings(spark, sf_dir):
    """The lists of a stored run that grow with the data, in their order."""
    rows = findings(spark, _recorded(spark, sf_dir), 1)
    grown = ["brute_force", "anomalies", "spike_windows", "correlations", "timeline"]
    return _keyed(rows.where(F.col("section").isin(grown)))


def _report_json(spark, sf_dir):
    """The record as a JSON file, read back."""
    path = new_path(spark, "report")
    Report(adapter.entries(spark, sf_dir)).write_json(path)
    back = spark.read.schema(REPORT_DDL).json(path)
    return back.select(F.inline("top_paths"))


def _blank_lines(spark, sf_dir):
    """Access lines among blank ones, some without a time."""
    tagged = web.nginx(lines_of(adapter.odd_nginx_lines(adapter.event_entries(spark, sf_dir)), order="mid"))
    return _shown(entries_of(tagged), ["seq", "ip", "timestamp", "status"])


def _timeless(spark, sf_dir):
    """The hours of access lines of which some have no time."""
    tagged = web.nginx(lines_of(adapter.odd_nginx_lines(adapter.event_entries(spark, sf_dir)), order="mid"))
    return temporal.timeline(entries_of(tagged))


def _ssh_relevance(spark, sf_dir):
    """A log of many daemons: SSH lines become entries, all others rejects."""
    tagged = line_format("ssh", year=YEAR)(adapter.all_ssh_lines(adapter.event_entries(spark, sf_dir)))
    return tagged.groupBy(F.col("parsed").cast("int").alias("parsed"), "level").agg(F.count(F.lit(1)).alias("total"))


def _registered_format(spark, sf_dir):
    """A format of one's own from column expressions: the message of every entry with its number."""
    if "numbered" not in formats():
        number = r"^(\d+) (.*)$"
        register_format(
            "numbered",
            lambda line: {"status": F.regexp_extract(line, number, 1).cast("int"), "message": F.regexp_extract(line, number, 2)},
            lambda line: line.rlike(number),
        )
    df = adapter.event_entries(spark, sf_dir)
    text = F.when(F.col("seq") % 9 == 0, F.col("message")).otherwise(F.concat(F.col("k").cast("string"), F.lit(" "), F.col("message")))
    lines = lines_of(df.select(text.alias("value"), "seq"), order="seq")
    return _shown(entries_of(line_format("numbered")(lines)), ["seq", "source", "status", "message"])


def _browser_files(spark, sf_dir):
    """Files of JSON arrays over many lines, read by element."""
    path = new_path(spark, "browser")
    adapter.browser_documents(adapter.event_entries(spark, sf_dir)).select("value").write.text(path)
    tagged = documents.read_browser(spark, path)
    return _shown(entries_of(tagged), ["source", "timestamp", "level", "path", "message"], ("line",))


def _windows_any(spark, sf_dir):
    """A folder of XML files and of JSON arrays, told apart by their content."""
    df, path = adapter.event_entries(spark, sf_dir), new_path(spark, "windows-any")
    adapter.landed(spark, path, {
        "a.xml": adapter.windows_xml_documents(df.where(F.col("k") % 2 == 0)),
        "b.xml": adapter.windows_json_documents(df.where(F.col("k") % 2 == 1)),
    })
    return _shown(entries_of(xml.read_windows(spark, path)), ["source", "timestamp", "level", "message"])


def _rejects_documents(spark, sf_dir):
    """Text between the events of XML files."""
    path = new_path(spark, "strayed")
    adapter.strayed_xml_documents(adapter.event_entries(spark, sf_dir)).select("value").write.text(path)
    return rejects_of(xml.read_windows(spark, path)).select(F.col("raw").alias("line"))


def _geo_dense(spark, sf_dir):
    """Addresses among tens of thousands of networks of one /16 and one /32."""
    networks = geo.networks_from_cidr(adapter.dense_networks(spark, sf_dir))
    return geo.locate(adapter.dense_addresses(spark, sf_dir), networks).select("ip", "city")


def _entries_table(spark, sf_dir):
    """Entries stored by source and day, and read back."""
    path = new_path(spark, "entries")
    write_entries(adapter.entries(spark, sf_dir), path)
    back = read_entries(spark, path)
    day = F.col("day").cast("string").alias("day")
    return back.groupBy("source", day, "level").agg(F.count(F.lit(1)).alias("total"))


def _compacted(spark, sf_dir):
    """Entries stored in five loads, compacted by day and read back."""
    path, entries = new_path(spark, "compacted"), adapter.entries(spark, sf_dir)
    for k in range(5):
        part = entries.where(F.col("mid") % 5 == k).withColumn(PARSED, F.lit(True))
        write_tagged(part, path, load=f"load-{k}")
    compact(spark, path)
    back = read_entries(spark, path)
    day = F.col("day").cast("string").alias("day")
    return back.groupBy("source", day, "level").agg(F.count(F.lit(1)).alias("total"))


_LINES = {
    "nginx.log": adapter.nginx_lines, "apache.log": adapter.apache_lines,
    "auth.log": adapter.ssh_lines, "fail2ban.log": adapter.fail2ban_lines,
}
_MIXED = {"ssh": {"year": YEAR}}


def _land(spark, df: DataFrame, path: str) -> None:
    adapter.landed(spark, path, {name: render(df) for name, render in _LINES.items()})


def _landed(spark, sf_dir) -> str:
    """All four sources as files of one folder."""
    path = new_path(spark, "landing")
    _land(spark, adapter.event_entries(spark, sf_dir), path)
    return path


def _live_ingest(spark, sf_dir):
    """Files of four formats landed in a folder, taken in by one stream into the stored table."""
    table, state = new_path(spark, "live"), new_path(spark, "live-state")
    start_ingest(
        spark, _landed(spark, sf_dir), "auto", table, state, format_options=_MIXED,
        source_options={"maxFilesPerTrigger": "3"}, availableNow=True,
    ).awaitTermination()
    return _shown(read_entries(spark, table), _ACCESS[1:])


def _live_alerts(spark, sf_dir):
    """Alert messages of four formats written by one stream."""
    out = new_path(spark, "alerts")
    start_alert_files(
        spark, _landed(spark, sf_dir), "auto", out, new_path(spark, "alerts-state"), format_options=_MIXED, availableNow=True
    ).awaitTermination()
    alert = F.from_json(
        "value", "level string, source string, message string, ip string, timestamp string"
    )
    return spark.read.text(out).select(alert.alias("alert")).select("alert.*")


def _recurring(spark, sf_dir):
    """Two landings and a run after each; the alert of the second, made from kept aggregates."""
    df, path = settled(adapter.event_entries(spark, sf_dir)), new_path(spark, "landing")
    where = dict(
        table=new_path(spark, "table"), checkpoint=new_path(spark, "state"), history=new_path(spark, "history"),
        format_options=_MIXED,
    )
    for k in range(2):
        landing = f"{path}/{k}"
        _land(spark, df.where(F.col("seq") % 2 == k), landing)
        _, alert = recurring_run(spark, f"{path}/*", "auto", **where)
    return alert


def _live_hours(spark, sf_dir):
    """Two landings in order of time and a late one: hours as a stream keeps them, and what came too late."""
    df = settled(adapter.event_entries(spark, sf_dir))
    path, out, state = new_path(spark, "landing"), new_path(spark, "hours"), new_path(spark, "state")
    day = F.dayofmonth("timestamp")
    held = (F.col("seq") % 40 == 0) & (day <= 9)
    for k, part in enumerate((df.where((day <= 10) & ~held), df.where((day > 10) & ~held), df.where(held))):
        _land(spark, part, f"{path}/{k}")
        start_hours(spark, f"{path}/*", "auto", out, state, format_options=_MIXED, availableNow=True).awaitTermination()
    kept = hours.live_timeline(spark, out).withColumn("late", F.lit(0))
    late = temporal.timeline(hours.late_entries(spark, out)).withColumn("late", F.lit(1))
    return kept.unionByName(late)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw access lines to a ranking of IPs."""
    lines = adapter.nginx_lines(adapter.event_entries(spark, sf_dir))
    return topn.top_ips(entries_of(web.nginx(lines)))


_SYSLOG = ["seq", "source", "timestamp", "level", "message", "raw"]
_WINDOWS = ["seq", "source", "ip", "timestamp", "level", "message"]

QUERIES: dict[str, Query] = {
    "overview": _on_entries(overview.overview),
    "span_sources": _span_sources,
    "sources": _on_entries(overview.sources),
    "top_ips": _on_entries(topn.top_ips),
    "top_ips_first_seen": _on_entries(topn.top_ips, ties="first_seen", n=40),
    "top_error_ips": _on_entries(topn.top_error_ips),
    "top_paths": _on_entries(topn.top_paths),
    "top_status": _on_entries(topn.top_status_codes),
    "top_methods": _on_entries(topn.top_methods),
    "top_agents": _on_entries(topn.top_user_agents),
    "banned_ips": _on_entries(topn.banned_ips),
    "by_hour": _on_entries(temporal.by_hour),
    "by_weekday": _on_entries(temporal.by_weekday),
    "peaks": _on_entries(temporal.peak_times),
    "hour_profile": _hour_profile,
    "weekday_profile": _weekday_profile,
    "timeline": _on_entries(temporal.timeline),
    "spikes": _on_entries(temporal.spikes),
    "brute_force": _on_entries(detections.brute_force),
    "high_volume": _on_entries(detections.high_volume),
    "error_rate_anomaly": _on_entries(detections.error_rate_anomaly),
    "scanners": _on_entries(detections.scanners),
    "anomalies": _on_entries(detections.anomalies),
    "correlation": _correlation,
    "geo": _geo,
    "public_ips": _public_ips,
    "entry_flags": _entry_flags,
    "ingest_nginx": _ingested(adapter.nginx_lines, web.nginx, _ACCESS, ("referer",)),
    "ingest_apache": _ingested(adapter.apache_lines, web.apache, _ACCESS),
    "ingest_nginx_error": _ingested(
        adapter.nginx_error_lines, web.nginx, ["seq", "source", "timestamp", "level", "message"],
        ("pid",),
    ),
    "ingest_apache_error": _ingested(
        adapter.apache_error_lines, web.apache,
        ["seq", "source", "ip", "level", "message"], ("module", "pid"),
    ),
    "ingest_syslog": _ingested(
        adapter.syslog_lines, line_format("syslog", year=YEAR), _SYSLOG, ("host", "service", "pid")
    ),
    "ingest_systemd": _ingested(
        adapter.syslog_lines, line_format("systemd", year=YEAR), _SYSLOG, ("host", "service", "pid")
    ),
    "ingest_ssh": _ingested(
        adapter.ssh_lines, line_format("ssh", year=YEAR),
        ["seq", "source", "ip", "timestamp", "level", "message"], ("user", "auth_method", "event"),
    ),
    "ingest_fail2ban": _ingested(
        adapter.fail2ban_lines, line_format("fail2ban"),
        ["seq", "source", "ip", "timestamp", "level", "message"], ("component", "event"),
    ),
    "ingest_browser": _ingested(
        adapter.browser_lines, documents.browser,
        ["seq", "source", "timestamp", "level", "path", "message"], ("line",),
    ),
    "ingest_har": _ingested(
        adapter.har_documents, _har,
        ["source", "timestamp", "level", "method", "path", "status", "size", "user_agent", "message"],
        ("url", "time_ms", "mime_type"),
    ),
    "ingest_windows_xml": _windows_files,
    "ingest_windows_lines": _ingested(
        adapter.windows_xml_lines, xml.windows_lines, _WINDOWS, ("channel", "event_id")
    ),
    "ingest_windows_json": _ingested(
        adapter.windows_json_documents, _windows_json,
        ["source", "timestamp", "level", "message"], ("EventID", "Record"),
    ),
    "ingest_custom": _ingested(
        adapter.custom_lines, lambda lines: custom(lines, adapter.CUSTOM_CONFIG),
        ["seq", "source", "ip", "timestamp", "level", "method", "path", "status", "message"],
    ),
    "all_formats": _all_formats,
    "rejects": _rejects,
    "detect_format": _detect_format,
    "url_path": _url_path,
    "tail": _tail,
    "cap": _cap,
    "status_class": _status_class,
    "error_band": _error_band,
    "bar_share": _bar_share,
    "hour_bars": _hour_bars,
    "alerts": _alerts,
    "watch_lines": _watch_lines,
    "run_alert": _run_alert,
    "report_lists": _report_lists,
    "report_rows": _report_rows,
    "report_pages": _report_pages,
    "report_record": _report_record,
    "history_latest": _history_latest,
    "run_lookup": _run_lookup,
    "run_findings": _run_findings,
    "report_json": _report_json,
    "blank_lines": _blank_lines,
    "timeless": _timeless,
    "ssh_relevance": _ssh_relevance,
    "registered_format": _registered_format,
    "ingest_browser_files": _browser_files,
    "ingest_windows_any": _windows_any,
    "rejects_documents": _rejects_documents,
    "geo_dense": _geo_dense,
    "compacted": _compacted,
    "live_hours": _live_hours,
    "entries_table": _entries_table,
    "live_ingest": _live_ingest,
    "live_alerts": _live_alerts,
    "recurring_run": _recurring,
}
