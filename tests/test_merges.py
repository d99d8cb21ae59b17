"""Bucketed tables, streams merged into them, and windows over late events."""

import datetime as dt
import glob
import os

import pytest
from conftest import rows_of
from creditpath.sources.bucketed import BucketedTable, newest_rows
from creditpath.sources.raw_log import typed, write_raw
from creditpath.sources.tables import DuplicateKeyError, merged
from creditpath.streaming.ingest import stream_raw
from creditpath.streaming.upsert import stream_upsert
from creditpath.streaming.windows import conversions_per_window, stream_conversions

SCHEMA = "k long, v string, at long"


def files_of(folders):
    return {f: os.stat(f).st_mtime_ns for folder, b in folders for f in glob.glob(f"{folder}/bucket={b}/*.parquet")}


@pytest.fixture
def table(spark, tmp_path):
    made = BucketedTable(spark, str(tmp_path / "table"), ["k"], buckets=8)
    made.create(spark.range(200).selectExpr("id AS k", "'old' AS v", "0L AS at"))
    return made


def test_merge_equals_the_rewritten_whole(spark, table):
    updates = spark.createDataFrame([(3, "new", 1), (500, "new", 1), (None, "new", 1)], SCHEMA)
    want = rows_of(merged(table.read(), updates, ["k"]))
    before = table.folders()
    assert table.merge(updates)
    assert rows_of(table.read()) == want and table.version() == 1
    changed = {b for b, folder in table.folders().items() if before.get(b) != folder}
    assert 0 < len(changed) <= 3


def test_only_touched_buckets_are_written(spark, table):
    folders = table.folders()
    before = files_of((f, b) for b, f in folders.items())
    table.merge(spark.createDataFrame([(3, "new", 1)], SCHEMA))
    after = table.folders()
    (changed,) = [b for b in folders if after[b] != folders[b]]
    kept = {f: t for f, t in before.items() if f"bucket={changed}/" not in f}
    assert files_of((f, b) for b, f in after.items() if b != changed) == kept
    assert {r.k for r in table.read().where("v = 'new'").collect()} == {3}
    assert table.read().count() == 200


def test_a_merge_is_seen_whole_or_not_at_all(spark, table, monkeypatch):
    want = rows_of(table.read())

    def stop(*_):
        raise RuntimeError("lost")

    monkeypatch.setattr(BucketedTable, "_publish", stop)
    with pytest.raises(RuntimeError):
        table.merge(spark.createDataFrame([(3, "new", 1)], SCHEMA))
    assert rows_of(table.read()) == want and table.version() == 0


def test_second_writer_of_a_version_fails(spark, table, monkeypatch):
    other = BucketedTable(spark, table.path, ["k"], buckets=8)
    latest = other._latest()
    table.merge(spark.createDataFrame([(3, "new", 1)], SCHEMA))
    monkeypatch.setattr(other, "_latest", lambda: latest)
    with pytest.raises(Exception, match="version=1"):
        other.merge(spark.createDataFrame([(4, "lost", 1)], SCHEMA))
    assert {r.k for r in table.read().where("at = 1").collect()} == {3}


def test_duplicate_updates_and_existing_table(spark, table):
    with pytest.raises(DuplicateKeyError):
        table.merge(spark.createDataFrame([(1, "x", 1), (1, "y", 1)], SCHEMA))
    with pytest.raises(Exception, match="version=0"):
        table.create(table.read())


def test_the_newest_row_stays_in_any_order(spark, tmp_path):
    rows = spark.range(300).selectExpr("id % 40 AS k", "concat('v', id % 7) AS v", "(id * 37) % 101 AS at")
    want = rows_of(newest_rows(rows, ["k"], ["at"]))
    for name, order in (("up", [0, 1, 2]), ("down", [2, 1, 0])):
        made = BucketedTable(spark, str(tmp_path / name), ["k"], buckets=4)
        made.create(rows.limit(0))
        for part in order:
            made.merge(rows.where(f"at % 3 = {part}"), ["at"])
        assert rows_of(made.read()) == want
    assert not made.merge(rows.limit(0), ["at"]) and rows_of(made.read()) == want


def events(spark, rows):
    schema = "uid string, time timestamp_ntz, interaction string, channel string, conversion int"
    return spark.createDataFrame(rows, schema)


def test_a_replayed_batch_changes_nothing(spark, tmp_path):
    day = dt.datetime(2024, 1, 1)
    rows = [(f"u{i % 9}", day + dt.timedelta(minutes=(i * 53) % 400), "impression", f"c{i % 4}", i % 2) for i in range(120)]
    source, state = str(tmp_path / "raw"), str(tmp_path / "state")
    for part in range(4):
        write_raw(events(spark, rows[part::4]), f"{source}/part={part}")
    stream = typed(stream_raw(spark, f"{source}/part=*", 2))
    newest = ["time", "conversion", "interaction", "channel"]
    lost = []

    class Losing(BucketedTable):
        """Stops once after a merge, before the stream's checkpoint has it."""

        def merge(self, *args, **options):
            done = super().merge(*args, **options)
            if not lost:
                lost.append(done)
                raise RuntimeError("lost")
            return done

    made = Losing(spark, str(tmp_path / "table"), ["uid"], buckets=4)
    made.create(spark.createDataFrame([], stream.schema))
    with pytest.raises(Exception, match="lost"):
        stream_upsert(stream, made, state, newest)
    assert lost == [True] and made.version() == 1
    seen = made.folders()
    batches = []
    monitored = BucketedTable(spark, made.path, ["uid"], buckets=4)
    plain = monitored.merge
    monitored.merge = lambda *a, **o: batches.append((o["batch"], plain(*a, **o)))
    stream_upsert(stream, monitored, state, newest)
    # The first batch came again and was left out.
    assert batches[0] == (0, False) and all(done for _, done in batches[1:]) and len(batches) > 1
    assert seen != made.folders()
    want = newest_rows(events(spark, rows).select(*stream.columns), ["uid"], newest)
    assert rows_of(made.read()) == rows_of(want)


def test_late_events_within_and_beyond_the_watermark(spark, tmp_path):
    day = dt.datetime(2024, 1, 1)
    at = lambda hours: day + dt.timedelta(hours=hours)
    source, sink, state = (str(tmp_path / n) for n in ("raw", "sink", "state"))
    first = [("u", at(h), "impression", "a", 0) for h in (0, 1, 5, 9)] + [("u", at(9.5), "conversion", "a", 1)]
    write_raw(events(spark, first), f"{source}/part=0")
    got = stream_conversions(spark, f"{source}/part=*", sink, state, "3 hours")
    # The watermark is 6:30; hours that end by then are complete.
    assert [r.window_start for r in got.orderBy("window_start").collect()] == [at(0), at(1), at(5)]
    late = [("u", at(7.5), "conversion", "a", 1), ("u", at(2.5), "conversion", "a", 1), ("u", None, "impression", "a", 0)]
    write_raw(events(spark, [*late, ("u", at(20), "impression", "b", 0)]), f"{source}/part=1")
    got = stream_conversions(spark, f"{source}/part=*", sink, state, "3 hours")
    # 7:30 counts; 2:30 is beyond the watermark; the hour of 20:00 is still open.
    kept = [*first, late[0]]
    want = conversions_per_window(events(spark, kept))
    assert rows_of(got) == rows_of(want)
    again = stream_conversions(spark, f"{source}/part=*", sink, state, "3 hours")
    assert rows_of(again) == rows_of(want)
