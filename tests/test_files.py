"""Files: order, encodings, detection, whole documents, rejects."""

import json
import random
from datetime import datetime

import pytest

import logweir
from logweir.operators import limits
from logweir.sources import documents, xml
from logweir.sources.lines import scan_lines
from logweir.sources.registry import detect_format, entries_of, read_tagged
from tests.helpers import F, rows

EVENTS = """<Events>
<Event xmlns="http://schemas.microsoft.com/win/2004/08/events/event"><System><Channel>System</Channel>
 <TimeCreated SystemTime="2023-02-03T04:05:06.700000Z"/><Level>4</Level><EventID>4624</EventID></System>
 <EventData><Data Name="Other">x</Data><Data Name="IpAddress">198.51.100.9</Data></EventData></Event>
<Event><System><TimeCreated>2023-02-03T04:09:00</TimeCreated><EventID>1102</EventID><Level>4</Level></System></Event>
</Events>"""


def line(second, ip="10.0.0.1", path="/"):
    return f'{ip} - - [10/Oct/2024:13:55:{second:02d} +0000] "GET {path} HTTP/1.1" 200 5 "-" "x"'


def test_lines(spark, tmp_path):
    text = f"{line(1)}\n\n   \t\n{line(2)}\r\n{line(3)}\r{line(4, path='/a b')}\n".encode()
    (tmp_path / "nginx.log").write_bytes(text + b'1.1.1.1 - - [x] "GET /\xff HTTP/1.1" 200 5 "-" "\xfe"\n\xc2\xa0\n')
    got = logweir.ingest(spark, str(tmp_path), "nginx").orderBy("block_start", "mid").collect()
    assert [e.timestamp and e.timestamp.second for e in got] == [1, 2, 3, None]
    assert got[3].path == "/�" and got[3].user_agent == "�" and "�" in got[3].raw
    # U+2028 does not end a line. It is a blank, so the path is cut and the line is no access line.
    [reject] = logweir.rejects(spark, str(tmp_path), "nginx").collect()
    assert "a b" in reject.raw


def test_order_over_splits(spark, tmp_path):
    for name in "ab":
        (tmp_path / f"{name}.log").write_text("".join(f"{name} {i}\n" for i in range(4000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2048")
    try:
        df = scan_lines(spark, str(tmp_path))
        assert df.rdd.getNumPartitions() > 10
        got = [r.value for r in df.repartition(5).orderBy("file", "block_start", "mid").collect()]
        assert got == [f"{n} {i}" for n in "ab" for i in range(4000)]
        messages = logweir.ingest(spark, str(tmp_path), "syslog")
        last = rows(limits.tail(messages, 700).select("message"))
        assert sorted(r["message"] for r in last) == sorted(f"{n} {i}" for n in "ab" for i in range(3300, 4000))
        first = rows(limits.cap(messages, 4500).orderBy("file", "block_start", "mid").select("message"))
        assert [r["message"] for r in first] == [f"a {i}" for i in range(4000)] + [f"b {i}" for i in range(500)]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_tail_counts_entries_without_a_time(spark, tmp_path):
    (tmp_path / "nginx.log").write_text("\n".join([line(i) for i in range(100)] + ["junk"] * 5))
    got = limits.tail(logweir.ingest(spark, str(tmp_path)), 10).collect()
    assert len(got) == 10 and all(e.timestamp is None for e in got)


def test_detection(spark):
    names = {
        "x.har": "har", "a.XML": "windows", "nginx.json": "browser", "NGINX-access.log": "nginx",
        "apache-auth.log": "apache", "httpd": "apache", "auth.log": "ssh", "secure-1": "ssh",
        "fail2ban.log": "fail2ban", "syslog.1": "syslog", "messages": "syslog", "journal": "systemd",
        "systemd.txt": "systemd", "anything": "nginx", "sshd-fail2ban": "ssh",
    }
    df = spark.createDataFrame([(n,) for n in names], "n string")
    assert [r[0] for r in df.select(detect_format(F.col("n"))).collect()] == list(names.values())


def test_mixed_directory(spark, tmp_path):
    (tmp_path / "nginx.log").write_text(line(1) + "\njunk\n")
    (tmp_path / "access.log").write_text(line(2))
    (tmp_path / "httpd.log").write_text(line(3))
    (tmp_path / "auth.log").write_text("Oct 11 14:05:24 h sshd[1]: Accepted k for u from 1.1.1.1 port 2\n")
    (tmp_path / "syslog").write_text("Oct 11 14:05:24 h app: hello\n")
    (tmp_path / "journal").write_text("anything\n")
    (tmp_path / "fail2ban.log").write_text("2024-10-10 13:55:36,1 fail2ban.x [1]: INFO  Ban 1.1.1.1\n")
    (tmp_path / "console.json").write_text('[{"level":"error","message":"a"},\n {"message":"b"}, 3]')
    (tmp_path / "events.xml").write_text(EVENTS)
    (tmp_path / "trace.har").write_text(json.dumps({"log": {"entries": [{"request": {"url": "http://h/a?b"}}]}}))
    tagged = read_tagged(spark, str(tmp_path), options={"ssh": {"year": 2020}})
    got = {(r.source): r["count"] for r in entries_of(tagged).groupBy("source").count().collect()}
    assert got == {
        "nginx": 2, "apache": 1, "ssh": 1, "syslog": 1, "systemd": 1, "fail2ban": 1, "browser": 2,
        "windows_event": 2, "har": 1,
    }
    assert [e.timestamp.year for e in tagged.where("source = 'ssh'").collect()] == [2020]
    rejects = {r.raw for r in tagged.where("not parsed").collect()}
    assert rejects == {"junk", "3"}


def test_a_file_is_opened_by_one_format_only(spark, tmp_path):
    for name in ("nginx.log", "auth.log", "syslog", "x.har", "y.json", "z.xml"):
        (tmp_path / name).write_text(f"{name}\n" * 1000)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        chosen = detect_format(F.col("_metadata.file_name")) == "ssh"
        only = scan_lines(spark, str(tmp_path), chosen)
        assert only.rdd.getNumPartitions() <= 10 < scan_lines(spark, str(tmp_path)).rdd.getNumPartitions()
        assert {r.value for r in only.collect()} == {"auth.log"}
        size = F.col("_metadata.file_size") > 8000
        assert scan_lines(spark, str(tmp_path), size).rdd.getNumPartitions() <= 40
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


@pytest.mark.parametrize("layout", ["auto", "document"])
def test_browser_files(spark, tmp_path, layout):
    (tmp_path / "array.json").write_text(
        '[\n {"level":"error","message":"a","stack":{"x":[1,2]}},\n "text", 5, null,\n {"message":"b\\n"}\n]'
    )
    (tmp_path / "lines.json").write_text('{"message":"c"}\n\nnot json\n{"message":"d"}\n')
    got = entries_of(documents.read_browser(spark, str(tmp_path), layout)).orderBy("file", "mid").collect()
    assert [e.message for e in got] == ["a", "b\n", "c", "d"]
    assert json.loads(got[0].raw)["stack"] == {"x": [1, 2]}


def test_layout_is_chosen_by_content(spark, tmp_path):
    (tmp_path / "array.json").write_text('\n [{"message":"a"},\n{"message":"b"}]')
    (tmp_path / "lines.json").write_text('{"message":"c"}\n' * 100)
    (tmp_path / "empty.json").write_text("\n")
    (tmp_path / "word.json").write_text("no json\n")
    df = documents.read_browser(spark, str(tmp_path))
    assert {r.message: r["count"] for r in entries_of(df).groupBy("message").count().collect()} == {
        "a": 1, "b": 1, "c": 100,
    }
    assert [r.raw for r in df.where("not parsed").collect()] == ["no json"]
    with pytest.raises(ValueError):
        documents.read_browser(spark, str(tmp_path), "other")


def test_windows_files_of_any_layout(spark, tmp_path):
    (tmp_path / "Security.xml").write_text('[{"EventID": 4625}]')
    (tmp_path / "lines.xml").write_text('{"EventID": 4624}\n{"EventID": 4740}\nnone\n')
    (tmp_path / "events.xml").write_text(EVENTS)
    (tmp_path / "text.xml").write_text("no event\n<Event><System><EventID>1102</EventID></System></Event>\n")
    tagged = read_tagged(spark, str(tmp_path))
    assert entries_of(tagged).count() == 6
    assert sorted(r.raw for r in tagged.where("not parsed").select("raw").collect()) == ["no event", "none"]


def test_arrays_are_split(spark, tmp_path):
    """Whatever braces, quotes and brackets stand in strings, and wherever a split begins."""
    pick = random.Random(4)
    odd = ['}', '{', '[', ']', '"', '\\', '}]', '\\"}', 'é\u2028', '},{"message":"x"}', '[{', "plain words", ""]
    items = [{"message": f"{i}:" + "".join(pick.choices(odd, k=pick.randrange(6))), "stack": pick.choice([None, "a}\"b", {"d": [1, {"e": "}"}]}])}
             for i in range(300)]
    (tmp_path / "pretty.json").write_text(json.dumps(items, indent=2))
    (tmp_path / "tight.json").write_text(json.dumps(items, separators=(",", ":"), ensure_ascii=False))
    (tmp_path / "empty.json").write_text(" [ ]\n")
    (tmp_path / "cut.json").write_text(json.dumps(items[:40])[:-9])
    (tmp_path / "stray.json").write_text('[{"message": "a"}, 5, oops\n {"message": "b"} tail ]')
    (tmp_path / "two.json").write_text('[{"message": "c"}]\n[{"message": "d"},\n{"message": "e"}]\n')
    spark.conf.set("spark.sql.files.maxPartitionBytes", "900")
    try:
        tagged = documents.read_browser(spark, str(tmp_path)).cache()
        assert documents.scan_pieces(spark, str(tmp_path), "}").rdd.getNumPartitions() > 30
        got = {}
        for r in tagged.where("parsed").orderBy("file", "block_start", "mid").collect():
            got.setdefault(r.file.rsplit("/")[-1], []).append((r.message, r.extra["stack"]))
        bad = {}
        for r in tagged.where("not parsed").orderBy("file", "block_start", "mid").collect():
            bad.setdefault(r.file.rsplit("/")[-1], []).append(r.raw)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    shown = [(x["message"], json.dumps(x["stack"], separators=(",", ":")) if isinstance(x["stack"], dict) else x["stack"]) for x in items]
    assert got["pretty.json"] == [(m, k) if not (k or "").startswith("{") else (m, k) for m, k in shown]
    assert got["tight.json"] == shown and got["cut.json"] == shown[:39]
    assert got["stray.json"] == [("a", None), ("b", None)] and got["two.json"] == [("c", None), ("d", None), ("e", None)]
    assert bad.keys() == {"cut.json", "stray.json"} and bad["stray.json"] == ["5, oops", "tail"]
    assert len(bad["cut.json"]) == 1 and bad["cut.json"][0].startswith('{"message": "39:')


def test_no_job_runs_while_a_plan_is_built(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"message": "a"}]')
    (tmp_path / "b.xml").write_text(EVENTS)
    spark.sparkContext.setJobGroup("plan", "plan")
    tagged = read_tagged(spark, str(tmp_path))
    assert not spark.sparkContext.statusTracker().getJobIdsForGroup("plan")
    assert entries_of(tagged).count() == 3
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_text_around_events_is_rejected(spark, tmp_path):
    event = "<Event><System><EventID>{}</EventID></System></Event>"
    (tmp_path / "page.xml").write_text("<html>\n<body>no event here</body>\n</html>\n")
    (tmp_path / "between.xml").write_text(
        '<?xml version="1.0"?><!-- c --><Events a="b">' + event.format(4624) + " lost words " + event.format(4625) + "</Events>\n")
    (tmp_path / "broken.xml").write_text("<Events>" + "<Event><System><EventID>1</System></Event>" + event.format(4740) + "</Events> end")
    tagged = read_tagged(spark, str(tmp_path))
    assert entries_of(tagged).count() == 3
    bad = sorted(r.raw for r in logweir.rejects(spark, str(tmp_path)).collect())
    assert bad == ["<Event><System><EventID>1</System></Event>", "<html>\n<body>no event here</body>\n</html>", "end", "lost words"]


def test_har(spark, tmp_path):
    def pair(url, status, size=10, headers=(), **more):
        return {"request": {"method": "GET", "url": url, "headers": list(headers)},
                "response": {"status": status, "bodySize": size, "content": {"mimeType": "a/b"}}, **more}

    agent = [{"name": "User-AGENT", "value": "first"}, {"name": "user-agent", "value": "second"}]
    document = {"log": {"entries": [
        pair("https://h.example/a/b?q=1", 200, headers=agent, startedDateTime="2024-10-10T13:55:36.123+02:00", time=12.5),
        pair("https://h.example", 404, -1),
        pair("/plain#top", 0, 0, startedDateTime="bad"),
        {"request": {}, "response": {"status": 503}},
    ]}}
    (tmp_path / "x.har").write_text(json.dumps(document, indent=1))
    got = logweir.ingest(spark, str(tmp_path)).orderBy("mid").collect()
    assert [(e.path, e.status, e.size, e.level) for e in got] == [
        ("/a/b", 200, 10, "INFO"), ("/", 404, None, "WARNING"), ("/plain#top", None, 0, "INFO"),
        (None, 503, None, "ERROR"),
    ]
    assert got[0].timestamp == datetime(2024, 10, 10, 13, 55, 36) and got[0].user_agent == "first"
    assert got[0].message == "GET https://h.example/a/b?q=1 200" and got[0].raw == "https://h.example/a/b?q=1"
    assert got[0].extra == {"url": got[0].raw, "time_ms": "12.5", "mime_type": "a/b"}
    assert got[2].timestamp is None and got[3].message == "None  503" and got[3].extra["time_ms"] == "0"
    (tmp_path / "y.har").write_text("{ not json")
    with pytest.raises(Exception, match="MALFORMED|malformed"):
        logweir.ingest(spark, str(tmp_path)).collect()


def test_windows_xml_files(spark, tmp_path):
    (tmp_path / "events.xml").write_text(EVENTS)
    (tmp_path / "lines.xml").write_text("junk\n" + "\n".join(
        f"<Event><System><EventID>{i}</EventID></System></Event>" for i in range(500)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        df = logweir.ingest(spark, str(tmp_path)).cache()
        assert xml.scan_events(spark, str(tmp_path)).rdd.getNumPartitions() > 5
        got = df.where("file like '%events.xml'").orderBy("mid").collect()
        assert [e.level for e in got] == ["INFO", "CRITICAL"] and got[0].ip == "198.51.100.9"
        assert [e.timestamp for e in got] == [datetime(2023, 2, 3, 4, 5, 6, 700000), datetime(2023, 2, 3, 4, 9)]
        ids = [e.extra["event_id"] for e in df.where("file like '%lines.xml'").orderBy("block_start", "mid").collect()]
        assert ids == [str(i) for i in range(500)]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_windows_json_files(spark, tmp_path):
    items = [
        {"EventID": 4625, "TimeCreated": "2024-10-10T13:55:36.5Z", "More": {"a": 1}},
        {"EventID": "x", "timestamp": "2024-10-10T13:55:37"},
    ]
    (tmp_path / "events.json").write_text(json.dumps(items))
    (tmp_path / "events.xml").write_text(EVENTS)
    only = entries_of(xml.read_windows(spark, f"{tmp_path}/events.json", "json")).orderBy("mid").collect()
    assert [(e.level, e.message) for e in only] == [
        ("WARNING", "EventID 4625: Failed logon attempt"), ("INFO", "EventID None: Windows event"),
    ]
    assert [e.timestamp.second for e in only] == [36, 37]
    assert json.loads(only[0].extra["More"]) == {"a": 1} and json.loads(only[0].raw) == items[0]
    assert entries_of(xml.read_windows(spark, str(tmp_path), "any")).count() == 4
    with pytest.raises(ValueError):
        xml.read_windows(spark, str(tmp_path), "other")


def test_store(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "nginx.log").write_text(f"{line(1)}\njunk\n{line(61)}\n")
    table = str(tmp_path / "table")
    tagged = read_tagged(spark, str(tmp_path / "in"))
    logweir.write_tagged(tagged, table, compact=True)
    logweir.write_tagged(tagged, table, load="again")
    logweir.write_tagged(tagged, table, load="again")
    got = logweir.read_entries(spark, table)
    assert got.count() == 4 and got.where("timestamp is null").count() == 2
    assert [r.raw for r in logweir.read_rejects(spark, table).collect()] == ["junk"] * 2
    one_day = got.where(F.col("day") == "2024-10-10")
    assert one_day.count() == 2
    assert sorted(got.drop("day").first().asDict()) == sorted(logweir.ENTRY_SCHEMA.fieldNames())
    assert len(rows(one_day)) == 2


def test_few_files_by_source_and_day(spark, tmp_path):
    (tmp_path / "in").mkdir()
    text = "".join(line(i % 60).replace("10/Oct", f"{10 + i % 3}/Oct") + "\n" for i in range(600))
    (tmp_path / "in" / "nginx.log").write_text(text)
    table = tmp_path / "table"
    for load in ("a", "b", "a"):
        logweir.write_tagged(read_tagged(spark, str(tmp_path / "in")).repartition(16), str(table), load=load)
    files = list(table.glob("kind=entries/source=nginx/day=2024-10-1*/load=*/*.parquet"))
    assert 6 <= len(files) <= 12
    assert logweir.read_entries(spark, str(table)).count() == 1200
