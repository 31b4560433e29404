from __future__ import annotations

import json

import pytest

from tracemill.streaming import logs


@pytest.mark.parametrize(("state", "to", "want"), [(None, "queued", "queued"), (None, "running", None), ("queued", "running", "running"), ("succeeded", "running", "succeeded"), ("failed", "redrive", "queued"), ("queued", "succeeded", "queued")])
def test_moves(state, to, want):
    assert logs.moved(state, to) == want


def test_job_stream(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()

    def put(name, *events):
        (src / name).write_text("\n".join(json.dumps({"seq": s, "at": at, "kind": "job", "run": r, "state": st}) for s, at, r, st in events))

    put("a.json", (2, "2024-01-01T00:01:00", "j", "running"), (1, "2024-01-01T00:00:00", "j", "queued"), (1, "2024-01-01T00:00:00", "k", "queued"))
    query = logs.jobs(logs.trail(spark, str(src))).writeStream.outputMode("update").format("memory").queryName("jobs_out").option("checkpointLocation", str(tmp_path / "cp")).start()
    query.processAllAvailable()
    put("b.json", (3, "2024-01-01T00:02:00", "j", "succeeded"), (4, "2024-01-01T00:03:00", "j", "running"))
    query.processAllAvailable()
    query.stop()
    rows = spark.sql("select * from jobs_out").collect()
    assert [(r["state"], r["revision"], r["attempts"]) for r in rows if r["run"] == "j"] == [("running", 2, 1), ("succeeded", 4, 1)]
    assert [r["state"] for r in rows if r["run"] == "k"] == ["queued"]


@pytest.mark.parametrize(("span", "ms"), [("10 minutes", 600_000), ("1 hour", 3_600_000), ("1 hour 30 minutes", 5_400_000), ("2 days", 172_800_000), ("45 seconds", 45_000)])
def test_spans(span, ms):
    assert logs.milliseconds(span) == ms


def test_odd_spans():
    with pytest.raises(ValueError, match="span"):
        logs.milliseconds("soon")


def test_windows_and_first_events(spark, tmp_path):
    """Counts by window close with the watermark; of a key's events the first one counts."""
    src = tmp_path / "in"
    src.mkdir()
    rows = [(1, "2024-01-01T00:00:10", "a", "r1"), (2, "2024-01-01T00:01:00", "a", "r1"), (3, "2024-01-01T00:06:00", "b", "r2"), (4, "2024-01-01T02:00:00", "a", "r3")]
    (src / "a.json").write_text("\n".join(json.dumps({"seq": s, "at": at, "kind": k, "run": r}) for s, at, k, r in rows))
    for name, df, mode in (("rates", logs.rates(logs.trail(spark, str(src))), "append"), ("once", logs.once(logs.trail(spark, str(src)), "run"), "append")):
        query = df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).start()
        query.processAllAvailable()
        query.stop()
    assert sorted((r["kind"], r["n"]) for r in spark.sql("select * from rates").collect()) == [("a", 2), ("b", 1)]
    assert sorted(r["seq"] for r in spark.sql("select * from once").collect()) in ([1, 3, 4], [2, 3, 4])


def test_silent_jobs_become_stale(spark, tmp_path):
    """A running job whose run is silent for the span is told as stale and waits again; ended ones aren't."""
    src = tmp_path / "in"
    src.mkdir()

    def put(name, *events):
        (src / name).write_text("\n".join(json.dumps({"seq": s, "at": at, "kind": "job", "run": r, "state": st}) for s, at, r, st in events))

    put("a.json", (1, "2024-01-01T00:00:00", "j", "queued"), (2, "2024-01-01T00:00:10", "j", "running"), (1, "2024-01-01T00:00:00", "k", "queued"), (2, "2024-01-01T00:00:01", "k", "running"), (3, "2024-01-01T00:00:02", "k", "succeeded"))
    query = logs.jobs(logs.trail(spark, str(src)), "1 minute").writeStream.outputMode("update").format("memory").queryName("stale_out").option("checkpointLocation", str(tmp_path / "cp")).start()
    query.processAllAvailable()
    put("b.json", (1, "2024-01-01T03:00:00", "other", "queued"))
    query.processAllAvailable()
    put("c.json", (2, "2024-01-01T03:00:01", "other", "running"))
    query.processAllAvailable()
    query.stop()
    rows = spark.sql("select * from stale_out").collect()
    assert [r["state"] for r in rows if r["run"] == "j"] == ["running", "stale"] and [r["state"] for r in rows if r["run"] == "k"] == ["succeeded"]
