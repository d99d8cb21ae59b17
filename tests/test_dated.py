"""Bronze by date: pruning, compaction, and batches that come again."""

import glob
import os

import pytest
from conftest import rows_of
from creditpath.sources.dated import DatedTable
from creditpath.sources.raw_log import read_raw, typed
from creditpath.sources.schemas import BRONZE
from creditpath.streaming.dated import ingest_dated

HEADER = "uid,time,interaction,channel,conversion\n"


@pytest.fixture
def source(tmp_path):
    (tmp_path / "raw").mkdir()
    for n in range(4):
        lines = [f"u{i},2024-01-0{1 + i % 3} 10:00:0{n},impression,Email,{i % 2}\n" for i in range(30)]
        (tmp_path / "raw" / f"{n}.csv").write_text(HEADER + "".join(lines) + f"bad{n},no time,impression,Email,0\n")
    return str(tmp_path / "raw")


@pytest.fixture
def table(spark, tmp_path):
    made = DatedTable(spark, str(tmp_path / "table"), BRONZE)
    made.create()
    return made


def files_of(rows):
    return {f: os.stat(f.removeprefix("file://")).st_mtime_ns for f in rows.inputFiles()}


def test_streamed_equals_backfilled_and_compaction_keeps_rows(spark, table, source, tmp_path):
    assert table.read().count() == 0 and table.compact() == []
    whole = DatedTable(spark, str(tmp_path / "whole"), BRONZE)
    whole.create()
    whole.append(typed(read_raw(spark, source)))
    want = rows_of(whole.read())
    streamed = ingest_dated(table, source, str(tmp_path / "seen"), 1)
    assert rows_of(streamed) == want and len(want) == 124
    before = len(streamed.inputFiles())
    assert table.compact() == ["2024-01-01", "2024-01-02", "2024-01-03", "__HIVE_DEFAULT_PARTITION__"]
    assert rows_of(table.read()) == want and len(table.read().inputFiles()) < before
    assert rows_of(streamed) == want, "readers of the version before keep their files"
    assert rows_of(ingest_dated(table, source, str(tmp_path / "seen"))) == want


def test_a_date_reads_its_folder_only(spark, table, source):
    table.append(typed(read_raw(spark, source)))
    one = table.read().where("day = DATE'2024-01-02'")
    assert one.count() == 40
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in plan
    scanned = one.select("_metadata.file_path").distinct().collect()
    assert scanned and all("day=2024-01-02" in r[0] for r in scanned)
    assert table.read().where("day IS NULL").count() == 4


def test_compaction_leaves_other_days_and_cuts_a_hot_one(spark, table, source):
    rows = typed(read_raw(spark, source))
    table.append(rows)
    table.append(rows.where("uid = 'u0'"))
    kept = {f: t for f, t in files_of(table.read()).items() if "day=2024-01-01" not in f}
    want = rows_of(table.read())
    assert table.compact(file_rows=10) == ["2024-01-01"]
    after = files_of(table.read())
    assert {f: t for f, t in after.items() if "day=2024-01-01" not in f} == kept
    assert len([f for f in after if "day=2024-01-01" in f]) > 2
    assert rows_of(table.read()) == want


def test_a_batch_that_comes_again_changes_nothing(spark, table, source, monkeypatch):
    rows = typed(read_raw(spark, source))
    assert table.append(rows, "s", 0)
    want = rows_of(table.read())
    assert not table.append(rows, "s", 0) and rows_of(table.read()) == want

    def stop(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as patch:
        patch.setattr(DatedTable, "_publish", stop)
        with pytest.raises(RuntimeError):
            table.append(rows, "s", 1)
    assert rows_of(table.read()) == want
    assert table.append(rows, "s", 1) and table.read().count() == 2 * len(want)
    assert glob.glob(f"{table.path}/manifest/version=*")
