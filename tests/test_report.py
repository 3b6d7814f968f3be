"""The report and its history."""

import json
from datetime import datetime

import pytest

import logweir
from logweir.plans import history
from logweir.operators import correlation, detections, geo, temporal, topn
from logweir.plans.report import REPORT_DDL
from pyspark.sql.types import StructType
from tests.helpers import F, entries, rows

T = datetime(2024, 10, 10, 14, 0)
FAILED = {"source": "ssh", "level": "WARNING", "extra": {"event": "failed"}, "message": "SSH login failed"}


def sample(spark):
    return entries(spark, [{"ip": "2.0.0.1", "status": 403, "level": "WARNING", "path": "/.env", "method": "GET",
                            "user_agent": "x", "timestamp": T.replace(minute=i)} for i in range(12)]
                   + [{"ip": "2.0.0.1", "timestamp": T.replace(second=30), **FAILED}] * 11
                   + [{"source": "fail2ban", "ip": "9.9.9.9", "extra": {"event": "ban"}}]
                   + [{"level": "ERROR", "ip": "8.8.8.8", "timestamp": T.replace(hour=15)}] * 3)


def networks(spark):
    return geo.networks_from_ranges(spark.createDataFrame(
        [(33554432, 33619967, "United Kingdom", "GB", "Boxford")],
        "lo bigint, hi bigint, country string, country_code string, city string",
    ))


def test_report_equals_the_single_analyses(spark, tmp_path):
    df = sample(spark)
    report = logweir.Report(df, networks=networks(spark))
    [doc] = rows(report.document())
    assert report.document().schema.simpleString() == StructType.fromDDL(REPORT_DDL).simpleString()
    assert doc["meta"] == {
        "total": 27, "errors": 3, "warnings": 23, "error_rate": 11.11, "sources": ["fail2ban", "nginx", "ssh"],
        "start_time": "2024-10-10T14:00:00", "end_time": "2024-10-10T15:00:00",
    }
    for name, want in {
        "top_ips": topn.top_ips(df), "top_error_ips": topn.top_error_ips(df), "top_paths": topn.top_paths(df),
        "top_status_codes": topn.top_status_codes(df), "top_methods": topn.top_methods(df),
        "top_user_agents": topn.top_user_agents(df).withColumnRenamed("user_agent", "ua"),
        "brute_force": detections.brute_force(df), "anomalies": detections.anomalies(df),
        "spike_windows": temporal.spikes(df), "timeline": temporal.timeline(df),
        "correlations": correlation.correlations(df), "banned_ips": topn.banned_ips(df),
        "geo": geo.geo(df, networks(spark)),
    }.items():
        got = doc[name] if name in doc else rows(report.section(name).rows.orderBy(*report.section(name).order))
        assert got == rows(want), name
    assert [a["type"] for a in doc["anomalies"]] == ["high_volume_ip", "high_error_rate", "scanner_detected"]
    assert doc["temporal"] == {
        "by_hour": {"14": 23, "15": 3}, "by_weekday": {"Thursday": 26}, "peak_hour": 14, "peak_weekday": "Thursday",
    }
    report.write_json(str(tmp_path / "json"))
    [text] = [r.value for r in spark.read.text(str(tmp_path / "json")).collect()]
    assert json.loads(text)["top_ips"][0] == {"ip": "2.0.0.1", "count": 23}
    assert "ip" not in json.loads(text)["anomalies"][1], "absent keys stay absent"
    report.write_rows(str(tmp_path / "rows"))
    stored = spark.read.schema("item string, section string").text(str(tmp_path / "rows"))
    assert {n for (n,) in stored.select("section").distinct().collect()} >= {"top_ips", "timeline", "brute_force"}
    assert stored.count() == report.rows().count()
    assert report.page("top_paths").count() == 1


def test_lists_that_grow_are_rows(spark):
    df = entries(spark, [{"ip": f"1.0.0.{i}", "status": 401} for i in range(8) for _ in range(10)])
    report = logweir.Report(df)
    [doc] = rows(report.document())
    assert "brute_force" not in doc and doc["top_paths"] == []
    assert report.rows(["brute_force"]).count() == 8


def test_empty_report(spark):
    [doc] = rows(logweir.Report(entries(spark, [])).document())
    assert doc["meta"]["total"] == 0 and doc["meta"]["error_rate"] == 0.0 and doc["top_ips"] == []
    assert doc["temporal"]["by_hour"] == {} and doc["temporal"]["peak_hour"] is None


def test_history(spark, tmp_path):
    folder = str(tmp_path / "history")
    assert rows(logweir.latest_runs(spark, folder)) == []
    assert rows(logweir.run_result(spark, folder, 1)) == []
    at = datetime(2024, 11, 1, 8)
    assert logweir.append_run(logweir.Report(sample(spark)), folder, "a.log", at) == 1
    assert logweir.append_run(logweir.Report(entries(spark, [{"ip": "x"}] * 2)), folder, "b.log", at) == 2
    newest = rows(logweir.latest_runs(spark, folder))
    assert [(r["id"], r["target"], r["total"]) for r in newest] == [(2, "b.log", 2), (1, "a.log", 27)]
    assert newest[1]["log_start"] == T and newest[0]["log_start"] == at and newest[1]["run_at"] == at
    assert newest[1]["sources"] == ["fail2ban", "nginx", "ssh"] and newest[1]["error_rate"] == 11.11
    assert [r["id"] for r in rows(logweir.latest_runs(spark, folder, 1))] == [2]
    [found] = rows(logweir.run_result(spark, folder, 1))
    assert found["target"] == "a.log" and found["top_ips"][0]["count"] == 23 and found["meta"]["errors"] == 3
    assert rows(logweir.run_result(spark, folder, 999)) == []
    items = logweir.findings(spark, folder, 1).where(F.col("section") == "brute_force").orderBy("position").collect()
    assert [json.loads(r["item"])["type"] for r in items] == ["http_brute_force", "ssh_brute_force"]


def test_a_run_that_was_cut_off_is_replaced(spark, tmp_path, monkeypatch):
    """Its findings are there without its row: nobody sees them, and the next run has the number."""
    folder = str(tmp_path / "history")
    logweir.append_run(logweir.Report(sample(spark)), folder, "a")
    with monkeypatch.context() as m:
        m.setattr(history, "_append_row", lambda *a: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            logweir.append_run(logweir.Report(sample(spark)), folder, "b")
    assert logweir.findings(spark, folder, 2).count() == 0
    assert [r["id"] for r in rows(logweir.latest_runs(spark, folder))] == [1]
    report = logweir.Report(sample(spark))
    assert logweir.append_run(report, folder, "b") == 2
    for run in (1, 2):
        assert logweir.findings(spark, folder, run).count() == report.rows().count()


def test_positions_follow_the_order_of_each_list(spark):
    """Also of a list that is spread over many ranges, with ties in its first key."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        many = [{"ip": f"1.0.{i // 200}.{i % 200}", "status": 401, "timestamp": T.replace(minute=i % 60)} for i in range(400)]
        report = logweir.Report(entries(spark, many * 10 + many[:70]), top_n=30)
        found = report.rows().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    by_section = {}
    for r in sorted(found, key=lambda r: r.position):
        by_section.setdefault(r.section, []).append(json.loads(r.item))
    assert len(by_section["brute_force"]) == 400
    for name, items in by_section.items():
        assert sorted(r.position for r in found if r.section == name) == list(range(len(items)))
        section = report.section(name)
        assert items == [json.loads(x.j) for x in section.rows.orderBy(*section.order).select(F.to_json(F.struct("*")).alias("j")).collect()]


def test_pages_are_cut(spark):
    df = entries(spark, [{"path": f"/{i}", "ip": "1.1.1.1"} for i in range(40)])
    report = logweir.Report(df, top_n=30)
    assert [report.page("top_paths").count(), report.page("top_paths", short=True).count()] == [15, 10]
    assert report.page("top_paths", 3).count() == 3 and report.page("top_ips").count() == 1


def test_runs_written_before_a_column_was_added(spark, tmp_path):
    folder = str(tmp_path / "old")
    spark.sql("select 1L as id, 'x' as target, 5L as total").write.parquet(f"{folder}/runs")
    assert rows(logweir.latest_runs(spark, folder))[0]["errors"] is None
    assert rows(logweir.run_result(spark, folder, 1)) == []
    assert logweir.append_run(logweir.Report(entries(spark, [{}])), folder, "y") == 2
