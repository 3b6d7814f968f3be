"""Correlation: the given cases, and random ones against all pairs."""

import random
from datetime import datetime, timedelta

import pytest

from logweir.operators import correlation
from tests.helpers import entries, rows

T = datetime(2024, 10, 10, 13, 59, 58)
FAILED = {"source": "ssh", "level": "WARNING", "extra": {"event": "failed"}, "message": "x"}


def case(minutes, ssh=12, http=5, timed=True):
    at = T if timed else None
    later = T + timedelta(minutes=minutes) if timed else None
    return [{"ip": "a", "timestamp": at, **FAILED}] * ssh + [
        {"ip": "a", "timestamp": later, "status": 403, "level": "WARNING"}
    ] * http


@pytest.mark.parametrize(
    "events, window, found",
    [
        (case(4), 10, True), (case(45), 10, False), (case(25), 10, False), (case(25), 30, True),
        (case(10), 10, True), (case(4, timed=False), 10, False), (case(4, http=0), 10, False),
    ],
)
def test_window(spark, events, window, found):
    got = rows(correlation.correlations(entries(spark, events), window))
    assert bool(got) == found


def test_fields(spark):
    [got] = rows(correlation.correlations(entries(spark, case(4))))
    assert got == {
        "ip": "a", "sources": ["ssh", "nginx/apache"], "ssh_event_count": 12, "http_event_count": 5,
        "closest_gap_minutes": 4.0, "severity": "HIGH",
        "description": "a: 12 SSH auth failure(s) and 5 HTTP 4xx/error request(s), closest pair 4.0 min apart",
    }
    [low] = rows(correlation.correlations(entries(spark, case(4, ssh=9))))
    assert low["severity"] == "MEDIUM"


def test_one_source_gives_nothing(spark):
    both = [{"ip": "a", "timestamp": T, "status": 403, **FAILED}]
    assert rows(correlation.correlations(entries(spark, both))) == []
    [got] = rows(correlation.correlations(entries(spark, both + [{"source": "apache"}])))
    assert (got["ssh_event_count"], got["http_event_count"], got["closest_gap_minutes"]) == (1, 1, 0.0)


@pytest.mark.parametrize("seed, step", [(1, 1), (2, 1_000_000), (3, 45_000_000), (4, 3_600_000_000)])
def test_closest_gap_against_all_pairs(spark, seed, step):
    pick = random.Random(seed)
    events = []
    for _ in range(600):
        side = FAILED if pick.random() < 0.5 else {"status": pick.choice([404, 500])}
        at = T + timedelta(microseconds=pick.randrange(400) * step)
        events.append({"ip": f"10.0.0.{pick.randrange(40) // 4 ** pick.randrange(3)}", "timestamp": at, **side})
    got = {r["ip"]: (r["ssh_count"], r["http_count"], r["gap"]) for r in rows(correlation.closest_gaps(entries(spark, events)))}
    want = {}
    for ip in {e["ip"] for e in events}:
        ssh = [e["timestamp"] for e in events if e["ip"] == ip and "status" not in e]
        http = [e["timestamp"] for e in events if e["ip"] == ip and "status" in e]
        if ssh and http:
            gap = min(abs(s - h) for s in ssh for h in http)
            want[ip] = (len(ssh), len(http), gap // timedelta(microseconds=1))
    assert got == want
