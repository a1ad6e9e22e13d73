"""K4 on streams: rows of the batch form, once a session, with state that ends."""

import datetime as dt
import random

import pytest

from twinweave.streaming import events as ev
from twinweave.streaming import sessions

SCHEMA = "event_id long, ts timestamp, session_id long, kind string, path string, value double"
T0 = dt.datetime(2024, 1, 1)
ROOTS = ["/a", "/a/b", "/a/b/c", "/z"]


def scan(session, start, n, number, finished=True, rng=random.Random(4)):
    """Events of one session, the last of them its finish."""
    paths = ["/a/x.jpg", "/a/b/y.jpg", "/a/b/c/d/e.jpg", "/other/f.jpg", "/z", None]
    rows = [(number + k, T0 + dt.timedelta(seconds=start + k), session, rng.choice(["item", "item", "error", "progress"]), rng.choice(paths), 0.0) for k in range(n)]
    rows[0] = (*rows[0][:3], "started", None, 0.0)
    return rows + [(number + n, T0 + dt.timedelta(seconds=start + n), session, "finished", None, float(rng.randrange(2 * n)))] * finished


@pytest.fixture
def files(spark, tmp_path):
    """A folder of event files as a stream, of which one is read at a time."""
    sessions.with_state_store(spark)

    class Files:
        n = 0

        def add(self, rows):
            spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in" / f"b{self.n:03d}"))
            self.n += 1

        def stream(self):
            schema = spark.createDataFrame([], SCHEMA).schema
            return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))

        def run(self, df):
            q = df.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").start()
            try:
                q.processAllAvailable()
                return sum(o["numRowsTotal"] for o in q.lastProgress["stateOperators"])
            finally:
                q.stop()

        def out(self):
            return spark.read.parquet(str(tmp_path / "out"))

    return Files()


def batches():
    first = scan(1, 0, 20, 0) + scan(2, 5, 30, 100) + scan(3, 8, 15, 200, finished=False)
    random.Random(2).shuffle(first)
    return [first[:25], first[25:50], first[50:]], scan(4, 100_000, 10, 300)


def far(event_id, days):
    return [(event_id, T0 + dt.timedelta(days=days), 99, "progress", None, 0.0)]


@pytest.mark.parametrize("folders", [False, True])
def test_sessions_come_once_and_leave_no_state(spark, files, folders):
    roots = spark.createDataFrame([(r,) for r in ROOTS], "root string")
    of = (lambda s: ev.folder_state(s, roots, "1 hour", silence_s=7200)) if folders else (lambda s: sessions.session_stream(s, "1 hour", 7200))
    early, late = batches()
    for rows in early[:2]:
        files.add(rows)
    open_state = files.run(of(files.stream()))
    assert open_state > 0 and files.out().count() == 0
    # a restart continues from the checkpoint
    for rows in [early[2], late, far(900, 3), far(901, 30)]:
        files.add(rows)
    left = files.run(of(files.stream()))
    everything = spark.createDataFrame([r for b in [*early, late] for r in b], SCHEMA)
    want = ev.folder_state(everything, roots, by_session=True) if folders else ev.session_state(everything)
    rows = lambda df: sorted(map(tuple, df.select(*want.columns).collect()))
    got = files.out().filter("session_id <> 99")
    assert rows(got) == rows(want)
    # what is left is of session 99 alone, and no more than it had by itself
    files.add(far(902, 60))
    assert files.run(of(files.stream())) == left <= 4
    assert rows(files.out().filter("session_id <> 99")) == rows(want)


def test_folder_totals_over_sessions_are_those_of_the_batch(spark):
    roots = spark.createDataFrame([(r,) for r in ROOTS], "root string")
    e = spark.createDataFrame(scan(1, 0, 40, 0) + scan(2, 9, 40, 100), SCHEMA)
    each = ev.folder_state(e, roots, by_session=True).groupBy("root").sum("items", "errors")
    all_ = ev.folder_state(e, roots).filter("items > 0 or errors > 0")
    assert sorted(map(tuple, each.collect())) == sorted(map(tuple, all_.collect()))
