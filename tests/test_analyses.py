"""Analyses of entries given by hand, and the bounds of each finding."""

from datetime import datetime, timedelta

import pytest

from logweir.functions import predicates
from logweir.operators import correlation, detections, limits, overview, temporal, topn
from logweir.operators.facts import all_facts, facts_of, regroup
from tests.helpers import F, entries, rows

T = datetime(2024, 10, 10, 14, 0)
FAILED = {"source": "ssh", "level": "WARNING", "extra": {"event": "failed"}, "message": "SSH login failed"}


@pytest.fixture(scope="module")
def mixed(spark):
    ok = [{"ip": f"10.0.0.{i % 5}", "status": 200, "method": "GET", "path": "/ok", "timestamp": T} for i in range(50)]
    bad = [{"ip": "10.0.0.9", "status": 500, "level": "ERROR", "path": "/bad", "timestamp": T}] * 10
    ssh = [{"ip": "10.0.0.7", "timestamp": T, **FAILED}] * 20
    return entries(spark, ok + bad + ssh).cache()


def test_overview(spark, mixed):
    assert rows(overview.overview(mixed)) == [{"total": 80, "errors": 10, "warnings": 20, "error_rate": 12.5}]
    [span] = rows(overview.time_span(mixed))
    assert (span["start_time"], span["end_time"]) == (T, T)
    assert rows(overview.source_list(mixed)) == [{"sources": ["nginx", "ssh"]}]
    assert rows(overview.sources(mixed)) == [{"source": "nginx", "total": 60}, {"source": "ssh", "total": 20}]
    [summary] = rows(overview.summary(mixed))
    assert summary["total"] == 80 and summary["sources"] == ["nginx", "ssh"]


def test_empty_input(spark):
    none = entries(spark, [])
    assert rows(overview.overview(none)) == [{"total": 0, "errors": 0, "warnings": 0, "error_rate": 0.0}]
    assert rows(overview.summary(none))[0]["total"] == 0
    for operator in (
        topn.top_ips, temporal.timeline, temporal.spikes, detections.brute_force,
        detections.anomalies, detections.error_rate_anomaly, correlation.correlations,
    ):
        assert rows(operator(none)) == []
    assert rows(temporal.peak_times(none)) == [{"peak_hour": None, "peak_weekday": None}]


def test_rankings(spark, mixed):
    assert rows(topn.top_ips(mixed, 2)) == [{"ip": "10.0.0.7", "count": 20}, {"ip": "10.0.0.0", "count": 10}]
    assert rows(topn.top_ips(mixed, 0)) == []
    assert rows(topn.top_error_ips(mixed)) == [{"ip": "10.0.0.9", "count": 10}]
    assert rows(topn.top_status_codes(mixed)) == [{"status": 200, "count": 50}, {"status": 500, "count": 10}]
    assert rows(topn.top_paths(mixed, 1)) == [{"path": "/ok", "count": 50}]
    assert rows(topn.top_methods(mixed)) == [{"method": "GET", "count": 50}]
    assert rows(topn.top_user_agents(mixed)) == []


def test_absent_values_and_ties(spark):
    df = entries(spark, [
        {"ip": "b", "status": 0}, {"ip": ""}, {"ip": None}, {"ip": "a"}, {"ip": "c"}, {"ip": "c"},
        {"ip": "b", "status": 404, "level": "WARNING"}, {"ip": "a"},
    ])
    assert [r["ip"] for r in rows(topn.top_ips(df))] == ["a", "b", "c"]
    assert [r["ip"] for r in rows(topn.top_ips(df, ties="first_seen"))] == ["b", "a", "c"]
    assert rows(topn.top_status_codes(df)) == [{"status": 404, "count": 1}]
    assert rows(topn.top_error_ips(df)) == [], "a 404 is no error by level"
    with pytest.raises(ValueError):
        topn.top_ips(df, ties="random")


def test_predicates(spark):
    df = entries(spark, [
        {"status": 500}, {"level": "CRITICAL"}, {"status": 404, "level": "WARNING"}, {"status": 200}, {},
    ])
    got = df.orderBy("mid").select(
        predicates.is_error().alias("e"), predicates.is_client_error().alias("c"),
        predicates.is_server_error().alias("s"), predicates.level_error().alias("l"),
    ).collect()
    assert [tuple(r) for r in got] == [
        (True, False, True, False), (True, False, False, True), (True, True, False, False),
        (False,) * 4, (False,) * 4,
    ]


def test_ssh_failure_rule(spark):
    cases = [
        ({"source": "ssh", "extra": {"event": "failed"}}, True),
        ({"source": "nginx", "extra": {"event": "failed"}}, False),
        ({"source": "syslog", "level": "ERROR", "message": "Authentication FAILURE"}, True),
        ({"source": "systemd", "level": "WARNING", "message": "Invalid user x"}, True),
        ({"source": "ssh", "level": "CRITICAL", "message": "failed"}, False),
        ({"source": "ssh", "level": "INFO", "message": "failed"}, False),
        ({"source": "ssh", "level": "ERROR", "message": "other"}, False),
    ]
    df = entries(spark, [c for c, _ in cases]).orderBy("mid")
    assert [r[0] for r in df.select(predicates.ssh_failure()).collect()] == [w for _, w in cases]


def test_temporal(spark, mixed):
    assert rows(temporal.by_hour(mixed)) == [{"hour": 14, "count": 80}]
    assert rows(temporal.by_weekday(mixed)) == [{"weekday": "Thursday", "count": 80}]
    assert rows(temporal.peak_times(mixed)) == [{"peak_hour": 14, "peak_weekday": "Thursday"}]
    profile = rows(temporal.hour_profile(temporal.by_hour(mixed)))
    assert [r["hour"] for r in profile] == list(range(24)) and sum(r["count"] for r in profile) == 80
    week = rows(temporal.weekday_profile(temporal.by_weekday(mixed)))
    assert [r["weekday"] for r in week][::6] == ["Monday", "Sunday"] and week[3]["count"] == 80
    assert rows(temporal.timeline(mixed)) == [
        {"time": "2024-10-10 14:00", "total": 80, "errors": 10, "warnings": 20}
    ]


def test_times_that_the_session_zone_skips(spark):
    at = [datetime(2024, 3, 10, 2, 30, 5, 7), datetime(2024, 3, 10, 3, 10), datetime(2024, 11, 3, 1, 30)]
    df = entries(spark, [{"timestamp": t} for t in at] + [{"timestamp": None}])
    assert [r["time"] for r in rows(temporal.timeline(df))] == [
        "2024-03-10 02:00", "2024-03-10 03:00", "2024-11-03 01:00",
    ]
    assert [r["hour"] for r in rows(temporal.by_hour(df))] == [1, 2, 3]
    assert {r["weekday"]: r["count"] for r in rows(temporal.by_weekday(df))} == {"Sunday": 3}
    from logweir.functions.times import iso_text, wall_micros

    got = df.where("timestamp is not null").orderBy("mid").select(
        iso_text(F.col("timestamp")).alias("t"), wall_micros(F.col("timestamp")).alias("us")
    ).collect()
    assert [r.t for r in got] == [t.isoformat() for t in at]
    epoch = datetime(1970, 1, 1)
    assert [r.us for r in got] == [(t - epoch) // timedelta(microseconds=1) for t in at]


def test_spikes(spark):
    quiet = [{"timestamp": T + timedelta(hours=h), "status": 200} for h in range(20) for _ in range(5)]
    loud = [{"timestamp": T + timedelta(hours=30, minutes=i), "status": 404} for i in range(6)]
    few = [{"timestamp": T + timedelta(hours=40), "status": 500}] * 4
    found = rows(temporal.spikes(entries(spark, quiet + loud + few + [{"status": 500}])))
    mean = 10 / 22
    assert found == [{
        "window": "2024-10-11 20:00", "errors": 6, "total": 6, "error_rate": 100.0,
        "vs_average": round(6 / mean, 1),
    }], "an hour of four entries is too small, entries without a time are out"


def test_brute_force_bounds(spark):
    df = entries(spark, [{"ip": "a", **FAILED}] * 51 + [{"ip": "b", **FAILED}] * 50 + [{"ip": "c", **FAILED}] * 9
                 + [{"ip": "b", "status": 401}] * 6 + [{"ip": "b", "status": 403}] * 4
                 + [{"ip": "d", "status": 404}] * 30 + [{"ip": None, **FAILED}] * 30)
    assert [tuple(r.values()) for r in rows(detections.brute_force(df))] == [
        ("a", "ssh_brute_force", 51, "HIGH"), ("b", "ssh_brute_force", 50, "MEDIUM"),
        ("b", "http_brute_force", 10, "MEDIUM"),
    ]


def test_anomalies(spark):
    df = entries(spark, [{"ip": "a"}] * 41 + [{"ip": "b"}] * 21 + [{"ip": "c"}] * 20 + [{}] * 18)
    got = rows(detections.high_volume(df))
    assert [(r["ip"], r["pct"], r["severity"]) for r in got] == [("a", 41.0, "HIGH"), ("b", 21.0, "MEDIUM")]
    assert got[0]["description"] == "a accounts for 41.0% of all requests"

    def rate(errors):
        return rows(detections.error_rate_anomaly(entries(spark, [{"status": 404}] * errors + [{}] * (100 - errors))))

    assert rate(10) == []
    assert rate(11)[0]["severity"] == "MEDIUM" and rate(25)[0]["severity"] == "MEDIUM"
    [high] = rate(26)
    assert (high["severity"], high["description"]) == ("HIGH", "Error rate is 26.0% (26/100)")


def test_scanners(spark):
    paths = [
        "/.env", "/x/.GIT/config", "/wp-admin", "/WP-LOGIN", "/phpMyAdmin", "/a.php", "/../etc/passwd",
        "/?q=eval(1)", "/base64_decode", "/?q=union  SELECT", "/<script>",
    ]
    many = [{"ip": f"10.0.0.{i}", "path": "/.env"} for i in range(6) for _ in range(6 - i)]
    df = entries(spark, [{"ip": "z", "path": p} for p in paths] + many
                 + [{"ip": "y", "path": "/fine"}] * 9 + [{"ip": None, "path": "/.env"}] * 9)
    got = rows(detections.scanners(df))
    assert [(r["ip"], r["count"]) for r in got] == [
        ("z", 11), ("10.0.0.0", 6), ("10.0.0.1", 5), ("10.0.0.2", 4), ("10.0.0.3", 3),
    ]
    assert got[0]["description"] == "z appears to be scanning for vulnerabilities (11 hits)"
    kinds = [r["type"] for r in rows(detections.anomalies(df))]
    assert kinds.count("scanner_detected") == 5


def test_facts_in_one_pass_equal_single_groupings(spark, mixed):
    everything = all_facts(mixed)
    ips = facts_of(everything, "ip")
    assert sorted(map(str, rows(detections.brute_force_of(ips)))) == sorted(map(str, rows(detections.brute_force(mixed))))
    assert sorted(map(str, rows(detections.anomalies_of(ips)))) == sorted(map(str, rows(detections.anomalies(mixed))))
    hours = regroup(facts_of(everything, "hour"), "hour")
    assert rows(temporal.timeline_of(hours)) == rows(temporal.timeline(mixed))
    assert rows(overview.totals_of_hours(facts_of(everything, "hour"))) == rows(overview.summary(mixed))


def test_tail_and_cap(spark):
    df = entries(spark, [
        {"file": f, "block_start": b, "mid": m, "message": f"{f}{b}-{m}"}
        for f in "ab" for b in (0, 1000, 500) for m in range(10)
    ]).repartition(7)
    got = sorted(r["message"] for r in rows(limits.tail(df, 12)))
    want = sorted(f"{f}{b}-{m}" for f in "ab" for b, m in [(1000, m) for m in range(10)] + [(500, 8), (500, 9)])
    assert got == want
    assert sorted(r["message"] for r in rows(limits.cap(df, 3))) == ["a0-0", "a0-1", "a0-2"]
    first = sorted(r["message"] for r in rows(limits.cap(df, 32, ["b", "a"])))
    assert first == sorted(["a0-0", "a0-1", *(f"b{b}-{m}" for b in (0, 500, 1000) for m in range(10))])
    listed = sorted(r["message"] for r in rows(limits.cap(df, 31, ["b"])))
    assert listed == sorted(["a0-0", *(f"b{b}-{m}" for b in (0, 500, 1000) for m in range(10))]), "files not given come last"
    assert len(rows(limits.cap(df, 100))) == 60 and rows(limits.tail(df, 0)) == []
