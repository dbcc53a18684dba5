from datetime import datetime, timedelta

from paperloom.streaming.runs import replay_run_report

START = datetime(2024, 1, 1)
EVENT = "run_id long, status string, error string, ts timestamp, event_id long"


def test_unknown_runs_fail_after_the_watermark(spark):
    at = lambda hours: START + timedelta(hours=hours)
    events = [(1, "queued", None, at(0), 1), (1, "running", None, at(1), 2), (1, "failed", "x", at(1), 3), (2, "done", None, at(50), 4)]
    events += [(3, "done", None, at(1), 5), (None, "done", None, at(2), 6), (4, "done", None, None, 7), (1, "failed", "x", at(1), 3)]
    asked = [(1, at(2)), (1, at(2)), (1, at(0)), (2, at(2)), (3, at(60)), (9, at(61)), (4, at(3)), (None, at(3)), (5, None)]
    report = replay_run_report(spark.createDataFrame(events, EVENT), spark.createDataFrame(asked, "run_id long, asked_at timestamp"))
    unknown = ("failed", "Unknown job_id", 0)
    assert {(row[0], row[1]): tuple(row[2:]) for row in report.collect()} == {
        (1, at(2)): ("failed", "x", 3), (1, at(0)): ("queued", None, 1), (2, at(2)): unknown, (3, at(60)): unknown,
        (9, at(61)): unknown, (4, at(3)): unknown,
    }
    assert report.count() == 6
