"""Streams give what a batch gives."""

import json
from datetime import datetime

import logweir
from logweir.functions.predicates import is_error
from logweir.sources.lines import lines_of
from logweir.sources.registry import entries_of, line_format, read_tagged
from logweir.streaming.live import alert_payload, alerts, display, live_tagged, start_alert_files, start_alerts, start_ingest
from logweir.streaming import hours
from logweir.streaming.recurring import recurring_run
from tests.helpers import rows


def lines(start, n, status=200):
    return "".join(
        f'10.0.0.{i % 3} - - [10/Oct/2024:13:{start:02d}:{i:02d} +0000] "GET /{i} HTTP/1.1" {status} 5\n' for i in range(n)
    )


def land(folder, name, text):
    folder.mkdir(exist_ok=True)
    (folder / f".{name}").write_text(text)
    (folder / f".{name}").rename(folder / name)


def test_ingest_takes_each_file_once(spark, tmp_path):
    landing, table, state = tmp_path / "landing", str(tmp_path / "table"), str(tmp_path / "state")

    def step():
        start_ingest(spark, str(landing), "nginx", table, state, availableNow=True).awaitTermination()

    land(landing, "a.log", lines(1, 20) + "junk\n")
    step()
    land(landing, "b.log", lines(2, 30, 500))
    step()
    step()
    stored = logweir.read_entries(spark, table).drop("day", "mid", "block_start")
    batch = entries_of(read_tagged(spark, str(landing), "nginx")).drop("mid", "block_start")
    assert stored.count() == 50 and sorted(map(str, rows(stored))) == sorted(map(str, rows(batch)))
    assert [r.raw for r in logweir.read_rejects(spark, table).collect()] == ["junk"]
    in_order = logweir.read_entries(spark, table).where("file like '%a.log'").orderBy("block_start", "mid")
    assert [r.path for r in in_order.collect()] == [f"/{i}" for i in range(20)]


def test_alerts(spark, tmp_path):
    landing, out = tmp_path / "landing", str(tmp_path / "out")
    land(landing, "a.log", lines(1, 3) + lines(2, 4, 404))
    tagged = live_tagged(spark, str(landing), "nginx")
    start_alerts(tagged, out, str(tmp_path / "state"), availableNow=True).awaitTermination()
    got = [json.loads(r.value) for r in spark.read.text(out).collect()]
    batch = entries_of(read_tagged(spark, str(landing), "nginx"))
    assert len(got) == 4 == batch.where(is_error()).count()
    assert sorted(map(str, got)) == sorted(map(str, rows(alerts(batch))))
    assert got[0].keys() == {"level", "source", "message", "ip", "timestamp"}


def test_display(spark, tmp_path):
    land(tmp_path / "d", "a.log", lines(1, 1) + "z" * 500 + "\n")
    land(tmp_path / "d", "b.log", '1.1.1.1 - - [bad] "GET / HTTP/1.1" 404 5\n')
    got = rows(display(read_tagged(spark, str(tmp_path / "d"), "nginx")).orderBy("text"))
    assert got == [
        {"time": "--:--:--", "ip": "1.1.1.1", "status": 404, "level": "WARNING", "text": "GET / 404"},
        {"time": "13:01:00", "ip": "10.0.0.0", "status": 200, "level": "INFO", "text": "GET /0 200"},
        {"time": None, "ip": None, "status": None, "level": None, "text": "z" * 160},
    ]


def test_display_of_an_entry_without_a_message(spark):
    from pyspark.sql import functions as F

    from tests.helpers import entries

    df = entries(spark, [{"raw": "r" * 130, "timestamp": datetime(2024, 1, 1, 2, 3, 4)}]).withColumn("parsed", F.lit(True))
    assert rows(display(df))[0]["text"] == "r" * 120


def test_lines_in_a_column_of_a_stream(spark, tmp_path):
    land(tmp_path / "d", "a.json", "".join(json.dumps({"body": x}) + "\n" for x in lines(1, 5).splitlines() + ["junk"]))
    stream = spark.readStream.schema("body string").json(str(tmp_path / "d"))
    parsed = entries_of(line_format("nginx")(lines_of(stream, "body")))
    query = parsed.writeStream.format("memory").queryName("bodies").trigger(availableNow=True).start()
    query.awaitTermination()
    got = spark.table("bodies").collect()
    assert sorted(r.path for r in got) == [f"/{i}" for i in range(5)] and got[0].mid is None


def test_recurring_run(spark, tmp_path):
    landing = tmp_path / "landing"
    where = dict(table=str(tmp_path / "t"), checkpoint=str(tmp_path / "c"), history=str(tmp_path / "h"))
    landing.mkdir()
    run, alert = recurring_run(spark, str(landing), "nginx", **where)
    assert run is None and rows(alert) == [] and rows(logweir.latest_runs(spark, where["history"])) == []
    land(landing, "a.log", lines(1, 9))
    land(landing, "c.log", "10.0.0.8 - - junk")
    run, alert = recurring_run(spark, str(landing), "nginx", **where)
    assert run == 1
    assert rows(alert) == [{"run": 1, "anomalies": 3, "brute_force": 0, "errors": 0, "total": 9}]
    land(landing, "b.log", "".join(
        f'10.1.{i}.1 - - [10/Oct/2024:13:05:00 +0000] "GET / HTTP/1.1" 200 5\n' for i in range(91)))
    run, alert = recurring_run(spark, str(landing), "nginx", **where)
    assert run == 2 and rows(alert) == [], "nothing to alert about"
    assert [r["total"] for r in rows(logweir.latest_runs(spark, where["history"]))] == [100, 9]


MIXED = {
    "nginx.log": lines(1, 12) + "junk\n",
    "auth.log": "Oct 10 13:01:05 web sshd[7]: Failed password for root from 10.0.0.1 port 22 ssh2\n",
    "dump.json": json.dumps([{"level": "error", "message": "m", "timestamp": "2024-10-10T13:00:00"}], indent=1),
    "page.har": json.dumps({"log": {"entries": [{"startedDateTime": "2024-10-10T13:00:00.1Z", "time": 5, "request": {
        "method": "GET", "url": "http://x/a", "headers": []}, "response": {"status": 503, "bodySize": 1, "content": {}}}]}}, indent=1),
    "Security.xml": "<Events>\n<Event><System><EventID>4625</EventID><Level>2</Level></System>\n</Event>\n</Events>",
    "odd [1]{a}*.log": lines(3, 2, 500),
}


def test_a_mixed_folder_is_one_stream(spark, tmp_path):
    """Files of every kind, one at a time or all at once, give the same table as a batch read."""
    landing = tmp_path / "landing"
    for name, text in MIXED.items():
        land(landing, name, text)
    options = {"ssh": {"year": 2024}}
    batch = read_tagged(spark, str(landing), "auto", options=options)
    plain = lambda df: sorted(str({**r, "extra": sorted(r["extra"].items())}) for r in rows(df.drop("day", "mid", "block_start")))
    for bound in ("1", "100"):
        table, state = str(tmp_path / f"t{bound}"), str(tmp_path / f"s{bound}")
        query = start_ingest(spark, str(landing), "auto", table, state, format_options=options,
                             source_options={"maxFilesPerTrigger": bound}, availableNow=True)
        query.awaitTermination()
        assert plain(logweir.read_entries(spark, table)) == plain(entries_of(batch))
        assert [r.raw for r in logweir.read_rejects(spark, table).collect()] == ["junk"]
        loads = spark.read.parquet(table).select("load").distinct().count()
        assert loads == (len(MIXED) if bound == "1" else 1)
    out = str(tmp_path / "alerts")
    start_alert_files(spark, str(landing), "auto", out, str(tmp_path / "sa"), format_options=options).awaitTermination()
    got = sorted(r.value for r in spark.read.text(out).select("value").collect())
    assert got == sorted(r.value for r in alert_payload(alerts(entries_of(batch))).collect()) and len(got) == 4


def test_a_second_run_reads_no_entry_of_the_first(spark, tmp_path):
    """Minutes that two landings share are right too, and entries of the first are gone by then."""
    landing, table, state = tmp_path / "landing", tmp_path / "t", tmp_path / "st"
    where = dict(table=str(table), checkpoint=str(tmp_path / "c"), history=str(tmp_path / "h"), state=str(state),
                 format_options={"ssh": {"year": 2024}}, source_options={"maxFilesPerTrigger": "1"})
    ssh = "Oct 10 13:{m:02d}:{s:02d} web sshd[7]: Failed password for root from 10.0.0.{i} port 22 ssh2\n"
    web = '10.0.0.{i} - - [10/Oct/2024:13:{m:02d}:{s:02d} +0000] "GET /x HTTP/1.1" 404 5\n'
    at = [(1, 0, 5), (1, 2, 40), (2, 0, 0), (2, 0, 59), (3, 5, 1), (3, 9, 9)]
    land(landing, "auth-1.log", "".join(ssh.format(i=i, m=m, s=s) for i, m, s in at) * 3)
    land(landing, "nginx-1.log", "".join(web.format(i=i, m=m, s=s) for i, m, s in [(1, 2, 58), (3, 0, 0)]))
    logweir_run = lambda: recurring_run(spark, str(landing), "auto", **where)
    run, _ = logweir_run()
    assert run == 1
    first = logweir.read_entries(spark, str(table)).collect()
    for file in table.rglob("*.parquet"):
        file.unlink()
    land(landing, "auth-2.log", ssh.format(i=2, m=0, s=30) + ssh.format(i=1, m=2, s=57))
    land(landing, "nginx-2.log", "".join(web.format(i=i, m=m, s=s) for i, m, s in [(2, 0, 31), (3, 5, 3), (9, 1, 1)]) + lines(8, 5))
    run, alert = logweir_run()
    assert run == 2
    second = logweir.read_entries(spark, str(table)).collect()
    assert len(first) == 20 and len(second) == 10
    whole = logweir.Report(spark.createDataFrame(first + second, logweir.read_entries(spark, str(table)).schema))
    kept = {(r.section, r.position): r.item for r in logweir.findings(spark, where["history"], 2).collect()}
    assert kept == {(r.section, r.position): r.item for r in whole.rows().collect()}
    assert rows(logweir.run_result(spark, where["history"], 2).drop("id", "target", "log_start")) == rows(whole.document())
    gaps = {json.loads(v)["ip"]: json.loads(v)["closest_gap_minutes"] for k, v in kept.items() if k[0] == "correlations"}
    assert gaps == {"10.0.0.1": 0.0, "10.0.0.2": 0.0, "10.0.0.3": 0.0}
    assert rows(alert)[0]["total"] == 30


def test_many_loads_of_a_day_are_compacted(spark, tmp_path):
    landing, table = tmp_path / "landing", tmp_path / "t"
    for i in range(12):
        land(landing, f"{i}.log", lines(i, 4) + ("junk\n" if i % 2 else "") + '1.1.1.1 - - [bad] "GET / HTTP/1.1" 404 5\n')
    step = lambda: start_ingest(spark, str(landing), "nginx", str(table), str(tmp_path / "s"),
                                source_options={"maxFilesPerTrigger": "1"}).awaitTermination()
    step()
    plain = lambda: sorted(map(str, rows(logweir.read_entries(spark, str(table)))))
    before, reader = plain(), logweir.read_entries(spark, str(table))
    rejects_before = sorted(r.raw for r in logweir.read_rejects(spark, str(table)).collect())
    reader.count()
    load = logweir.compact(spark, str(table))
    assert plain() == before and reader.count() == len(before) == 60, "nobody sees both"
    assert sorted(r.raw for r in logweir.read_rejects(spark, str(table)).collect()) == rejects_before == ["junk"] * 6
    files = set(f for f in logweir.read_entries(spark, str(table)).inputFiles() if load in f)
    assert len(files) <= 6 and logweir.compact(spark, str(table)) is None
    land(landing, "13.log", lines(40, 3))
    step()
    assert len(plain()) == 63
    assert logweir.compact(spark, str(table), ["2000-01-01"]) is None
    assert logweir.compact(spark, str(table), ["2024-10-10"]) is not None and len(plain()) == 63
    assert logweir.drop_replaced(spark, str(table)) > 12 and len(plain()) == 63
    assert len(list(table.rglob("*.parquet"))) <= 14


def test_an_unfinished_compaction_is_not_seen(spark, tmp_path):
    table = str(tmp_path / "t")
    one = read_tagged(spark, str(tmp_path / "x.log"), "nginx") if land(tmp_path, "x.log", lines(1, 3)) is None else None
    for name in ("a", "b"):
        logweir.write_tagged(one, table, load=name)
    logweir.write_tagged(one, table, load="compacted-cut-off")
    assert logweir.read_entries(spark, table).count() == 6
    assert logweir.compact(spark, table) is not None
    assert logweir.read_entries(spark, table).count() == 6


def test_hours_close_and_late_entries_are_kept_apart(spark, tmp_path):
    landing, out, state = tmp_path / "landing", str(tmp_path / "hours"), str(tmp_path / "s")
    at = '10.0.0.{ip} - - [10/Oct/2024:{h:02d}:{m:02d}:00 +0000] "GET /{h} HTTP/1.1" {status} 5\n'

    def step(name, *rows_of):
        land(landing, name, "".join(at.format(ip=i, h=h, m=m, status=s) * n for i, h, m, s, n in rows_of))
        hours.start_hours(spark, str(landing), "nginx", out, state, delay_minutes=30).awaitTermination()
        return {r.time[11:13]: (r.total, r.errors) for r in hours.live_timeline(spark, out, unfinished=False).collect()}

    assert hours.live_timeline(spark, out).count() == 0 == hours.late_entries(spark, out).count()
    assert step("a.log", (1, 8, 5, 200, 3), (1, 9, 20, 500, 2)) == {}
    assert step("b.log", (2, 9, 40, 401, 11), (2, 8, 59, 200, 1)) == {"08": (4, 0)}, "an hour is open for the delay"
    assert step("c.log", (3, 10, 31, 200, 1), (3, 8, 1, 500, 4), (3, 9, 1, 200, 1)) == {"08": (4, 0), "09": (14, 2)}
    assert step("d.log", (4, 9, 59, 200, 5)) == {"08": (4, 0), "09": (14, 2)}
    assert sorted(r.path for r in hours.late_entries(spark, out).collect()) == ["/8"] * 4 + ["/9"] * 5
    assert [tuple(r)[:4] for r in hours.live_brute_force(spark, out).collect()] == [("2024-10-10 09:00", "10.0.0.2", "http_brute_force", 11)]
    every = {r.time[11:13]: r.total for r in hours.live_timeline(spark, out).collect()}
    assert every == {"08": 4, "09": 14, "10": 1}
    assert hours.live_spikes(spark, out, multiplier=1.0, min_errors=1).count() == 1
    # A batch without its mark was cut off: nobody sees it, and it is written again.
    import shutil
    shutil.rmtree(f"{out}/marks/batch=3")
    assert hours.late_entries(spark, out).count() == 4
