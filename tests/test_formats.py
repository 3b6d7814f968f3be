"""Formats: one line at a time, with the edges of each."""

from datetime import datetime

import pytest

from logweir.sources.custom import load_config, spark_pattern
from logweir.sources.registry import formats, line_format, register_format
from tests.helpers import F, parse

ACCESS = '198.51.100.23 - - [03/Jul/2023:06:07:08 +0200] "PUT /shelf/17?full=1 HTTP/2" 201 88 "-" "fetcher/3 (test)"'


def access(time="10/Oct/2024:13:55:36 +0000", status="200", size="12", rest="", ip="10.0.0.1", ident="-"):
    return f'{ip} {ident} - [{time}] "GET /x HTTP/1.1" {status} {size}{rest}'


def test_nginx(spark):
    lines = [
        ACCESS,
        access(status="404"),
        access(status="500", rest=' "-" "-"'),
        "2023/07/03 06:07:09 [error] 77#5: *9 upstream shelf gave up after 3 tries",
        "this is not a log line",
        access(time="10/Oct/2024:13:55:36"),
        access(time="10/Oct/2024:13:55:60 +0000"),
        access(time="10/Oct/2024:23:55:36 +0500"),
        access(time="29/Feb/2023:13:55:36 +0000"),
        access(time="10/Mar/2024:02:30:00 -0500"),
        access(ident="word"),
        access(size="-", rest=' "http://a/" " spaced "'),
        access(ip="2001:db8::1"),
        "2024/13/10 13:55:36 [crit] 1#0: no such month",
        "2024/10/10 13:55:36 [weird] 1#0: 99 what",
        access(time="10/oct/2024:13:55:36 Z"),
        access(rest=' "ref   x" "agent   y"'),
        access(status="2004"),
    ]
    got = parse(spark, "nginx", lines)
    ok = got[0]
    assert (ok.source, ok.ip, ok.method, ok.path) == ("nginx", "198.51.100.23", "PUT", "/shelf/17?full=1")
    assert (ok.status, ok.size, ok.level, ok.user_agent) == (201, 88, "INFO", "fetcher/3 (test)")
    assert ok.timestamp == datetime(2023, 7, 3, 6, 7, 8) and ok.timestamp.tzinfo is None
    assert ok.message == "PUT /shelf/17?full=1 201" and ok.raw == ACCESS
    assert ok.extra == {"referer": None}
    assert (got[1].level, got[1].size, got[1].user_agent) == ("WARNING", 12, None)
    assert (got[2].level, got[2].user_agent) == ("ERROR", None)
    error = got[3]
    assert (error.level, error.ip, error.status) == ("ERROR", None, None)
    assert error.message == "upstream shelf gave up after 3 tries"
    assert error.timestamp == datetime(2023, 7, 3, 6, 7, 9) and error.extra == {"pid": "77"}
    assert got[4] is None
    assert [got[i].timestamp for i in (5, 6, 8)] == [None] * 3, "kept without a time"
    assert got[7].timestamp == datetime(2024, 10, 10, 23, 55, 36), "the offset is dropped"
    assert got[9].timestamp == datetime(2024, 3, 10, 2, 30), "an hour that the zone skips"
    assert got[10] is None, "the second field is a dash"
    assert (got[11].size, got[11].extra["referer"], got[11].user_agent) == (None, "http://a/", "spaced")
    assert got[12].ip == "2001:db8::1"
    assert (got[13].timestamp, got[13].level) == (None, "CRITICAL")
    assert (got[14].level, got[14].message) == ("INFO", "what"), "a number may lead the message"
    assert got[15].timestamp == datetime(2024, 10, 10, 13, 55, 36)
    assert got[16].user_agent == "agent   y" and got[16].extra["referer"] == "ref   x"
    assert got[17] is None


def test_marks_in_a_line_do_not_shift_fields(spark):
    got = parse(spark, "nginx", [access(rest=' "a﷐b" "c﷐d"'), "﷐access﷐x"])
    assert got[0].user_agent == "c�d" and got[0].status == 200
    assert got[1] is None


def test_apache(spark):
    lines = [
        '127.0.0.1 - frank [10/Oct/2000:13:55:36 -0700] "GET /apache_pb.gif HTTP/1.0" 200 2326 '
        '"http://www.example.com/start.html" "Mozilla/4.08"',
        access(ident="word"),
        "[Thu Oct 11 14:05:24.903989 2018] [core:error] [pid 123] [client 1.2.3.4:56789] File gone",
        "[Thu Oct 11 14:05:24.903989 2018] [mpm:notice] [pid 7] resuming  ",
        "nothing",
    ]
    got = parse(spark, "apache", lines)
    assert (got[0].ip, got[0].status, got[0].size) == ("127.0.0.1", 200, 2326)
    assert got[0].timestamp == datetime(2000, 10, 10, 13, 55, 36) and got[0].extra == {}
    assert got[1].source == "apache"
    assert (got[2].ip, got[2].level, got[2].timestamp) == ("1.2.3.4", "ERROR", None)
    assert got[2].extra == {"module": "core", "pid": "123"} and got[2].message == "File gone"
    assert (got[3].ip, got[3].level, got[3].message) == (None, "INFO", "resuming")
    assert got[4] is None


def test_systemd_and_syslog(spark):
    lines = [
        "Oct 11 14:05:24 host app[7]: [error] something failed",
        "<4>Oct  1 14:05:24 host app: all failed",
        "<5>Oct 11 14:05:24 host app: a warning",
        "Oct 11 14:05:24 host app: CRITICAL state",
        "Feb 29 10:00:00 host app: leap",
        "<3>no syslog shape, failed",
        "free text, failed",
        "<9>Oct 11 14:05:24 host app: odd priority",
        "Oct 11 14:05:61 host app: odd second  ",
    ]
    got = parse(spark, "systemd", lines, year=2023)
    assert [e.level for e in got] == [
        "ERROR", "WARNING", "WARNING", "CRITICAL", "INFO", "ERROR", "INFO", "INFO", "INFO",
    ]
    assert got[0].timestamp == datetime(2023, 10, 11, 14, 5, 24)
    assert got[0].extra == {"host": "host", "service": "app", "pid": "7"} and got[0].ip is None
    assert got[1].timestamp == datetime(2023, 10, 1, 14, 5, 24), "two blanks before the day"
    assert got[1].raw == lines[1][3:] and got[1].extra["pid"] is None
    assert got[4].timestamp is None, "no such day in that year"
    assert (got[5].message, got[5].raw) == ("no syslog shape, failed",) * 2
    assert got[8].timestamp is None and got[8].message == "odd second"
    assert parse(spark, "syslog", [lines[4]], year=2024)[0].timestamp == datetime(2024, 2, 29, 10)
    now = parse(spark, "syslog", [lines[0]])[0]
    assert now.source == "syslog" and abs(now.timestamp.year - datetime.now().year) <= 1


def test_ssh(spark):
    head = "Oct 11 14:05:24 host sshd[1]: "
    lines = [
        head + "Accepted publickey for root from 10.0.0.1 port 22 ssh2",
        head + "Failed password for root from 10.0.0.2 port 22 ssh2",
        head + "Invalid user admin from 10.0.0.3 port 22",
        head + "Failed password for invalid user bob from 10.0.0.4 port 22 ssh2",
        head + "Disconnected from authenticating user root 10.0.0.5 port 22 [preauth]",
        head + "Connection closed by 10.0.0.6",
        "Oct 11 14:05:24 host cron[1]: job done",
        "Oct 11 14:05:24 host cron[1]: job sshd",
        "Failed none from 10.0.0.7 port 1",
        "Oct 11 14:05:24 host app: Disconnected from user a 1.1.1.1 port 2, Accepted x for b from 2.2.2.2 port 3",
    ]
    got = parse(spark, "ssh", lines, year=2024)
    event = [e and e.extra.get("event") for e in got]
    assert event == [
        "accepted", "failed", "failed", None, "disconnect", None, None, None, "failed", "accepted",
    ]
    assert got[0].extra == {"user": "root", "auth_method": "publickey", "event": "accepted"}
    assert got[0].message == "SSH login accepted: root via publickey" and got[0].level == "INFO"
    assert (got[1].ip, got[1].level) == ("10.0.0.2", "WARNING")
    assert got[1].message == "SSH login failed: root from 10.0.0.2"
    assert got[2].extra["user"] == "admin"
    assert (got[3].level, got[3].ip) == ("INFO", None), "as the format defines it"
    wide = parse(spark, "ssh", lines, year=2024, ssh_invalid_user=True)
    assert (wide[3].extra["user"], wide[3].ip, wide[3].level) == ("bob", "10.0.0.4", "WARNING")
    assert wide[1].extra["user"] == "root"
    assert got[4].message == "SSH disconnect: root" and got[4].ip == "10.0.0.5"
    assert got[5].message == "Connection closed by 10.0.0.6"
    assert got[6] is None and got[7] is not None
    assert (got[8].extra["user"], got[8].timestamp) == ("unknown", None)
    assert got[9].ip == "2.2.2.2", "a login counts before a disconnect, wherever it stands"


def test_fail2ban(spark):
    head = "2024-10-10 13:55:36,123 fail2ban.actions        [1]: "
    lines = [
        head + "NOTICE  [sshd] Ban 1.2.3.4",
        head + "NOTICE  [sshd] Unban 1.2.3.4",
        head + "ERROR   broken",
        head + "notice  Ban 5.5.5.5, Unban 6.6.6.6",
        "junk",
    ]
    got = parse(spark, "fail2ban", lines)
    assert [(e.level, e.ip, e.extra["event"]) for e in got[:4]] == [
        ("WARNING", "1.2.3.4", "ban"), ("INFO", "1.2.3.4", "unban"), ("ERROR", None, "info"),
        ("WARNING", "6.6.6.6", "unban"),
    ]
    assert got[0].timestamp == datetime(2024, 10, 10, 13, 55, 36)
    assert got[0].extra["component"] == "actions" and got[4] is None


@pytest.mark.parametrize("key", ["timestamp", "time"])
def test_browser(spark, key):
    times = {
        "2024-10-10T13:55:36.123Z": datetime(2024, 10, 10, 13, 55, 36, 123000),
        "2024-10-10T13:55:36Z": datetime(2024, 10, 10, 13, 55, 36),
        "2024-10-10 13:55:36": datetime(2024, 10, 10, 13, 55, 36),
        "not-a-real-timestamp": None,
        "2024": None,
        "20241010T135536": datetime(2024, 10, 10, 13, 55, 36),
        "2024-10-10T135536+0200": datetime(2024, 10, 10, 13, 55, 36),
        "2024-10-10": datetime(2024, 10, 10),
        "2024-10-10T13": datetime(2024, 10, 10, 13),
        "2024-10-10T13:5536": None,
        "2024-10-10T13:55:36,5": datetime(2024, 10, 10, 13, 55, 36, 500000),
        "2024-10-10T13:55:36.123456789Z": datetime(2024, 10, 10, 13, 55, 36, 123456),
        "2024-10-10T24:00:00": None,
        "2024-10-10T13:55:36.": None,
        "2024-03-10T02:30:00Z": datetime(2024, 3, 10, 2, 30),
    }
    got = parse(spark, "browser", [f'{{"level":"warn","{key}":"{t}","message":"x"}}' for t in times])
    assert [e.timestamp for e in got] == list(times.values())
    for text, value in times.items():
        try:
            want = datetime.fromisoformat(text).replace(tzinfo=None)
        except ValueError:
            want = None
        assert value == want


def test_browser_fields(spark):
    lines = [
        '{"level":"ERROR","message":"Uncaught","url":"/app.js","line":42,"stack":{"a":[1]}}',
        '{"message":"plain","source":"s.js","url":""}',
        "not valid json {{{",
        "42",
        '"text"',
        '{"level":7}',
    ]
    got = parse(spark, "browser", lines)
    assert (got[0].level, got[0].message, got[0].path) == ("ERROR", "Uncaught", "/app.js")
    assert got[0].extra == {"line": "42", "column": None, "stack": '{"a":[1]}'} and got[0].raw == lines[0]
    assert (got[1].level, got[1].path, got[1].timestamp) == ("INFO", "s.js", None)
    assert got[2:5] == [None] * 3
    assert (got[5].level, got[5].message) == ("INFO", "")


def test_custom(spark):
    config = {
        "name": "myapp",
        "pattern": r"(?P<ip>\S+) (?P<t_ime>\S+) (?P<lvl>\w+) \[(?P<code>\d+|-)\](?: <(?P<opt>\w*)>)? (?P<message>.+)\Z",
        "time_field": "t_ime",
        "time_format": "%Y-%m-%dT%H:%M:%S",
        "level_field": "lvl",
        "ip_field": "ip",
        "status_field": "code",
        "level_map": {"bad": "ERROR"},
    }
    lines = [
        "1.1.1.1 2024-10-10T13:55:36 BAD [503] <x> it broke",
        "1.1.1.1 2024-10-10T13:55:60 fine [-] ok",
        "no match",
    ]
    got = parse(spark, "custom", lines, config)
    first = got[0]
    assert (first.source, first.ip, first.status, first.level) == ("myapp", "1.1.1.1", 503, "ERROR")
    assert first.timestamp == datetime(2024, 10, 10, 13, 55, 36) and first.message == "it broke"
    assert first.extra == {"code": "503", "opt": "x"}
    assert (got[1].timestamp, got[1].status, got[1].level) == (None, None, "INFO")
    assert got[1].extra["opt"] is None and got[2] is None
    bare = parse(spark, "custom", ["hello world"], {"pattern": r"(?P<word>\w+)"})[0]
    assert (bare.message, bare.source, bare.extra) == ("hello world", "custom", {"word": "hello"})


@pytest.mark.parametrize(
    "time_format, text, want",
    [
        ("%d/%b/%Y:%H:%M:%S %z", "10/OCT/2024:13:55:36 +0200", datetime(2024, 10, 10, 13, 55, 36)),
        ("%Y%m%d%H%M%S", "20241010135536", datetime(2024, 10, 10, 13, 55, 36)),
        ("%d %B %y, %I:%M %p", "1 march 24, 12:05 AM", datetime(2024, 3, 1, 0, 5)),
        ("%a %b %d %H:%M:%S.%f %Y", "Thu Oct 10 13:55:36.5 2024", datetime(2024, 10, 10, 13, 55, 36, 500000)),
        ("%H:%M", "13:55", datetime(1900, 1, 1, 13, 55)),
        ("%H:%M", "x13:55", None),
        ("%Y-%m-%d", "2024-10-10 ", None),
        ("%y", "70", datetime(1970, 1, 1)),
    ],
)
def test_custom_times(spark, time_format, text, want):
    config = {"pattern": r"<(?P<time>.*)>", "time_field": "time", "time_format": time_format}
    assert parse(spark, "custom", [f"<{text}>"], config)[0].timestamp == want
    try:
        assert datetime.strptime(text, time_format).replace(tzinfo=None) == want
    except ValueError:
        assert want is None


def test_custom_config_errors():
    with pytest.raises(ValueError, match="pattern"):
        load_config("{}")
    with pytest.raises(ValueError, match="Unknown keys"):
        load_config({"pattern": "x", "patern": "y"})
    with pytest.raises(ValueError, match="requires a config"):
        line_format("custom")
    from logweir.functions.times import compile_time_format

    with pytest.raises(ValueError, match="Unsupported"):
        compile_time_format("%Y %U")
    pattern, numbers = spark_pattern(r"[(?P<no>](x)(?P<a>\(?P<b>y)(?P=a)")
    assert pattern == r"[(?P<no>](x)(\(?P<b>y)(?:\2)" and numbers == {"a": 2}


def test_registry(spark):
    assert {"nginx", "apache", "systemd", "syslog", "ssh", "fail2ban", "browser", "har", "windows"} <= set(formats())
    with pytest.raises(ValueError, match="Unknown format 'nope'. Available"):
        line_format("nope")
    register_format(
        "pipes",
        lambda line: {"ip": F.split(line, r"\|")[0], "message": F.split(line, r"\|")[1]},
        lambda line: line.contains("|"),
    )
    got = parse(spark, "pipes", ["1.1.1.1|hi", "no"])
    assert (got[0].ip, got[0].message, got[0].source, got[1]) == ("1.1.1.1", "hi", "pipes", None)
    with pytest.raises(ValueError, match="exists"):
        register_format("pipes", dict, bool)


def test_windows_lines(spark):
    def event(system, data=""):
        return (
            '<Event xmlns="http://schemas.microsoft.com/win/2004/08/events/event">'
            f"<System>{system}</System><EventData>{data}</EventData></Event>"
        )

    lines = [
        event(
            '<EventID Qualifiers="0">4625</EventID><Level>4</Level>'
            '<TimeCreated SystemTime="2024-10-10T13:55:36.1234567Z"/><Channel>Security</Channel>',
            '<Data Name="IpAddress">10.0.0.5</Data><Data Name="TargetUserName">admin</Data>',
        ),
        event("<EventID>1</EventID><Level>2</Level>", '<Data Name="IpAddress">1.1.1.1</Data>'
              '<Data Name="WorkstationName"> \\\\PC1 </Data><Data Name="IpAddress">-</Data>'),
        event("<EventID>x</EventID>", '<Data Name="A">1</Data><Data Name="A">2</Data><Data>z</Data>'
              '<Data Name="channel">mine</Data>'),
        "<Event><System><EventID>7045</EventID></System></Event>",
        "<Event><Other/></Event>",
        "not xml",
    ]
    got = parse(spark, "windows", lines)
    first = got[0]
    assert (first.source, first.level, first.ip) == ("windows_event", "WARNING", "10.0.0.5")
    assert first.timestamp == datetime(2024, 10, 10, 13, 55, 36, 123456)
    assert first.message == "EventID 4625: Failed logon attempt" and first.raw == ""
    assert first.extra == {
        "event_id": "4625", "channel": "Security", "IpAddress": "10.0.0.5", "TargetUserName": "admin",
    }
    assert (got[1].ip, got[1].level, got[1].extra["IpAddress"]) == ("PC1", "ERROR", "-")
    assert got[2].message == "EventID None: Windows event" and got[2].level == "INFO"
    assert got[2].extra == {"event_id": None, "channel": "mine", "A": "2", "": "z"}
    assert got[3].message == "EventID 7045: New service installed" and got[3].extra["channel"] is None
    assert got[4] is None and got[5] is None
