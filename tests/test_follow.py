"""Following files that grow."""

import pytest

from logweir.sources.registry import entries_of, line_format
from logweir.streaming.follow import follow_lines

LINE = '10.0.0.{i} - - [10/Oct/2024:13:00:{i:02d} +0000] "GET /{name}/{i} HTTP/1.1" 200 5\n'


def text(name, start, n):
    return "".join(LINE.format(name=name, i=i) for i in range(start, start + n))


def test_lines_are_seen_once_through_rotation_and_restarts(spark, tmp_path):
    log, out, state = tmp_path / "app.log", str(tmp_path / "out"), str(tmp_path / "state")

    def step():
        entries = entries_of(line_format("nginx")(follow_lines(spark, str(log), split_bytes=200)))
        query = entries.writeStream.format("parquet").option("checkpointLocation", state).trigger(availableNow=True)
        query.start(out).awaitTermination()
        rows = spark.read.parquet(out).orderBy("file", "mid").collect() if (tmp_path / "out").exists() else []
        return sorted(r.path for r in rows), rows

    log.write_text(text("a", 0, 9) + "10.0.0.9 - - [10/Oct/2024")
    expected = [f"/a/{i}" for i in range(9)]
    assert step()[0] == expected
    # The line that was cut off is completed, and the stream starts anew.
    with log.open("a") as file:
        file.write(':13:00:09 +0000] "GET /a/9 HTTP/1.1" 200 5\n\n' + text("a", 10, 3))
    expected += [f"/a/{i}" for i in range(9, 13)]
    assert step()[0] == sorted(expected)
    # A rotation: the old file gets its last lines under its new name.
    with log.open("a") as file:
        file.write(text("a", 13, 2))
    log.rename(tmp_path / "app.log.1")
    log.write_text(text("b", 0, 4))
    expected += ["/a/13", "/a/14"] + [f"/b/{i}" for i in range(4)]
    assert step()[0] == sorted(expected)
    assert step()[0] == sorted(expected), "nothing new, nothing again"
    # Truncated in place, and the rotated file is compressed away.
    (tmp_path / "app.log.1").rename(tmp_path / "app.log.2.gz")
    log.write_text(text("c", 5, 2))
    expected += ["/c/5", "/c/6"]
    paths, rows = step()
    assert paths == sorted(expected)
    first = [r.path for r in rows if r.file == rows[[x.path for x in rows].index("/a/0")].file]
    assert first == [f"/a/{i}" for i in range(15)], "bytes give the order of a file's lines"


def test_starting_at_the_end(spark, tmp_path):
    log, out, state = tmp_path / "app.log", str(tmp_path / "out"), str(tmp_path / "state")
    log.write_text(text("old", 0, 5))

    def query():
        lines = follow_lines(spark, str(log), starting_at="end")
        return lines.writeStream.format("parquet").option("checkpointLocation", state)

    running = query().trigger(processingTime="200 milliseconds").start(out)
    try:
        running.processAllAvailable()
        with log.open("a") as file:
            file.write(text("new", 0, 2))
        running.processAllAvailable()
    finally:
        running.stop()
    assert sorted(r.value.split(" ")[6] for r in spark.read.parquet(out).collect()) == ["/new/0", "/new/1"]
    with pytest.raises(ValueError):
        follow_lines(spark, str(log), starting_at="middle")
