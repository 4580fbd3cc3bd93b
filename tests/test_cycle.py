"""The cycle, stopped between its steps, against an undisturbed run."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemill.sources.storage import new_path
from tidemill.streaming import cycle as C
from tidemill.streaming import pipeline as P

NOW = "2024-01-08 00:00:00"


def item(i, **odd):
    at = dt.datetime(2024, 1, 1) + dt.timedelta(hours=i)
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa".split()
    body = " ".join(words[(i // 4) % 5 :] + [f"own{i // 4}"] * 6 + [f"w{i % 2}"])
    return {"source_id": f"s{i % 3}", "external_id": i, "position": i, "url": f"https://e.org/{i}", "title": f"title {i // 4}", "excerpt": None, "content": body, "published": str(at)} | odd


BATCHES = [
    [item(i) for i in range(0, 12)] + [item(100, url=" "), item(101, title=None), item(102, content="  "), item(103, published="never"), item(104, published="2023-01-01 00:00:00"), item(105, published=None), item(106, published="2030-01-01 00:00:00")],
    [item(i) for i in range(8, 20)] + [item(200, url="http://www.e.org/3/?utm_source=a"), item(201, url="https://e.org/x"), item(202, url="https://www.e.org/x#part"), item(203), item(203, url="https://e.org/y")],
    [item(i) for i in range(18, 30)] + [item(300, source_id=None), item(301, external_id=None)],
]


class Stop(Exception):
    pass


def run(spark, stop=None):
    """Tables after all batches. ``stop``: (step, batch) after which the stream breaks off, once; it is started again then."""
    path, left = new_path(spark, "test-cycle"), [stop]

    def after(step, batch):
        if left[0] == (step, batch):
            left[0] = None
            raise Stop

    cycle = C.Cycle(spark, f"{path}/tables", F.lit(NOW).cast("timestamp"), after)
    for rows in BATCHES:
        spark.createDataFrame([tuple(r.values()) for r in rows], C.ITEM).write.mode("append").parquet(f"{path}/feed")
        try:
            P.run(P.read(spark, f"{path}/feed"), cycle.step, path=f"{path}/stream")
        except Exception:
            assert stop and left[0] is None
            P.run(P.read(spark, f"{path}/feed"), cycle.step, path=f"{path}/stream")
    rows = lambda df: sorted(map(repr, df.select(*sorted(df.columns)).collect()))
    names = ("stories", "activity", "hashes", "assigned")
    return {"created": rows(cycle.items("created")), "known": rows(cycle.items("known")), "rejected": rows(cycle.items("rejected")), "counts": rows(cycle.counts()), "enriched": rows(cycle.enriched())} | {n: rows(cycle.store.read(n)) for n in names}, cycle


@pytest.fixture(scope="module")
def undisturbed(spark):
    return run(spark)


def test_counts_and_reasons(undisturbed):
    _, cycle = undisturbed
    counts = {r["batch"]: r for r in cycle.counts().collect()}
    assert all(r["fetched"] == len(BATCHES[b]) == r["created"] + r["known"] + r["rejected"] for b, r in counts.items()) and len(counts) == 3
    assert {r["position"]: r["reason"] for r in cycle.items("rejected").collect()} == {100: "no address", 101: "no title", 102: "no text", 103: "unreadable time", 104: "too old"}
    known = sorted((r["batch"], r["position"]) for r in cycle.items("known").collect())
    assert known == [(1, 8), (1, 9), (1, 10), (1, 11), (1, 200), (1, 202), (1, 203), (2, 18), (2, 19)]
    late = {r["position"]: r["published_at"] for r in cycle.items("created").collect()}
    assert late[105] == late[106] == dt.datetime(2024, 1, 8)
    stories = cycle.enriched().collect()
    assert sum(r["articles"] for r in stories) == sum(r["created"] for r in counts.values()) and any(r["articles"] > 1 for r in stories)


@pytest.mark.parametrize("stop", [("ingest", 1), ("cluster", 2)])
def test_a_cycle_that_is_stopped(spark, undisturbed, stop):
    tables, _ = run(spark, stop)
    assert tables == undisturbed[0]
