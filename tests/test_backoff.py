"""Due moments against a plain loop, over several runs."""

import datetime as dt
import random

from tidemill.sources.storage import new_path
from tidemill.streaming import backoff
from tidemill.streaming import pipeline as P

BEGIN = dt.datetime(2024, 1, 1)
SCHEMA = "source_id long, at timestamp, seq long, failed boolean, minutes long"


def plain(rows, ended):
    out, held = [], {}
    for source, at, _, failed, minutes in sorted(rows, key=lambda r: (r[1], r[2])):
        failures, due = held.get(source, (0, None))
        if due is not None and due <= at:
            out.append((source, due, failures))
        failures = failures + 1 if failed else 0
        held[source] = failures, at + dt.timedelta(minutes=minutes * min(2**failures, 24))
    return sorted(out + [(s, due, f) for s, (f, due) in held.items() if due <= ended])


def test_due_moments_over_runs(spark):
    rng = random.Random(6)
    path, rows = new_path(spark, "test-backoff"), []
    for run in range(3):
        new = [(rng.randrange(6), BEGIN + dt.timedelta(hours=30 * run, seconds=rng.randrange(30 * 3600)), 1000 * run + i, rng.random() < 0.6, 30) for i in range(60)]
        new += [(9, BEGIN + dt.timedelta(hours=30 * run), 1000 * run + 500 + i, i % 2 == 0, 30) for i in range(3)]  # fetches of one moment
        rows += new
        spark.createDataFrame(new, SCHEMA).write.mode("append").parquet(f"{path}/log")
        with backoff.timers(spark):
            P.run(backoff.due_moments(P.read(spark, f"{path}/log")), path=f"{path}/due")
    got = sorted((r["source_id"], r["due_at"], r["failures"]) for r in spark.read.parquet(f"{path}/due").collect())
    assert got == plain(rows, max(r[1] for r in rows)) and any(f > 2 for *_, f in got)
    assert "RocksDB" not in spark.conf.get("spark.sql.streaming.stateStore.providerClass")


def test_messages_of_a_source():
    """A source that is new, and one whose timer is known, look no timers up."""
    import pandas as pd

    calls = []

    class Told:
        state = None

        def __getattr__(self, name):
            def call(*args):
                calls.append(name)
                self.state = args[0] if name == "update" else self.state
                return {"getValueState": self, "get": self.state, "listTimers": iter([5])}.get(name)

            return call

    b = backoff.BackOff()
    b.init(Told())
    rows = lambda us: iter([pd.DataFrame({"us": [us], "seq": [1], "failed": [False], "minutes": [30]})])
    assert list(b.handleInputRows((1,), rows(0), None)) == [] and calls == ["getValueState", "get", "registerTimer", "update"]
    calls.clear()
    assert list(b.handleInputRows((1,), rows(60), None)) == [] and calls == ["get", "deleteTimer", "registerTimer", "update"]
    b.source.update((0, -1))
    calls.clear()
    assert list(b.handleInputRows((1,), rows(90), None)) == [] and "listTimers" in calls
