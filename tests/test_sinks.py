"""Tables that are replaced by period."""

import datetime as dt
from pathlib import Path

from tidemill.sources import sinks
from tidemill.sources.storage import new_path

SCHEMA = "period string, period_start date, topic string, n long"


def day(i):
    return dt.date(2024, 1, i)


def files(path):
    return {str(f.relative_to(path)): f.stat().st_mtime_ns for f in Path(path.removeprefix("file:")).rglob("*.parquet")}


def test_periods_are_replaced_alone(spark):
    path = new_path(spark, "test-sink")
    make = lambda rows: spark.createDataFrame(rows, SCHEMA)
    all_ = make([("day", day(i), t, i) for i in range(1, 6) for t in ("a", "b")] + [("week", day(1), "a", 30)])
    sinks.replace_periods(all_, path, ["period", "period_start"], all_)
    before = files(path)
    new = make([("day", day(2), "c", 7), ("day", day(4), "a", 99)])  # of the three days: one changed, one without rows, one not asked for
    asked = make([("day", day(2), "", 0), ("day", day(3), "", 0)])
    for _ in range(2):
        sinks.replace_periods(new, path, ["period", "period_start"], asked)
        got = sorted(tuple(r) for r in spark.read.schema("topic string, n long, period string, period_start date").parquet(path).select("period", "period_start", "topic", "n").collect())
        assert got == sorted([("day", day(i), t, i) for i in (1, 4, 5) for t in ("a", "b")] + [("week", day(1), "a", 30), ("day", day(2), "c", 7)])
    after = files(path)
    untouched = {f: t for f, t in before.items() if "period_start=2024-01-02" not in f and "period_start=2024-01-03" not in f}
    assert len(untouched) >= 4 and untouched.items() <= after.items()
    sinks.replace_periods(new.limit(0), path, ["period", "period_start"], asked.limit(0))
    assert files(path) == after
