"""Tables, upsert, layout, ingestion."""

import os

import pytest
from conftest import rows_of
from creditpath.operators import spend
from creditpath.session import scratch_dir
from creditpath.sources import raw_log, tables
from creditpath.sources.schemas import BRONZE
from creditpath.streaming import ingest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

LINES = [
    "a,2020-05-17 13:30:00,impression,Email,0",
    "a,2020-05-18 13:30:00,conversion,Affiliates,1",
    "b,not a time,impression,Email,0",
    "c,2020-05-18 00:00:01,impression,Email,many",
    "d,,impression,,",
]


def _write(path, name, lines):
    os.makedirs(path, exist_ok=True)
    with open(os.path.join(path, name), "w") as file:
        file.write("\n".join(["uid,time,interaction,channel,conversion", *lines]) + "\n")


def test_stream_equals_batch_and_reads_each_file_once(spark, tmp_path):
    source, sink, seen, batch = (str(tmp_path / n) for n in ("in", "out", "seen", "batch"))
    _write(source, "one.csv", LINES)
    assert ingest.ingest(spark, source, sink, seen).count() == 5
    assert ingest.ingest(spark, source, sink, seen).count() == 5
    _write(source, "two.csv", ["e,2020-06-01 00:00:00,impression,Email,0"])
    found = ingest.ingest(spark, source, sink, seen)
    assert found.schema.simpleString() == BRONZE.simpleString()
    assert rows_of(found) == rows_of(ingest.backfill(spark, source, batch))
    assert found.count() == 6
    for used in (sink, batch):
        with pytest.raises(AnalysisException):
            ingest.backfill(spark, source, used)
    assert spark.read.parquet(batch).count() == 6


def test_unreadable_values_are_null_and_counted(spark, tmp_path):
    _write(str(tmp_path), "one.csv", LINES)
    raw = raw_log.read_raw(spark, str(tmp_path))
    assert raw_log.rejected(raw).first().asDict() == {"n_rows": 5, "bad_time": 1, "bad_conversion": 1}
    rows = {r.uid + str(r.interaction): r for r in raw_log.typed(raw).collect()}
    assert rows["bimpression"].time is None and rows["cimpression"].conversion is None


def test_files_per_trigger(spark, tmp_path):
    source = str(tmp_path / "in")
    for i in range(4):
        _write(source, f"{i}.csv", [f"u{i},2020-05-17 13:30:00,impression,Email,0"])
    found = ingest.ingest(spark, source, str(tmp_path / "out"), str(tmp_path / "seen"), max_files_per_trigger=1)
    assert found.count() == 4


KEYED = st.dictionaries(st.integers(0, 12), st.integers(0, 3), max_size=8)


@settings(max_examples=10, deadline=None, suppress_health_check=list(HealthCheck))
@given(KEYED, KEYED)
def test_upsert_is_a_dictionary_update_and_repeats(spark, old, new):
    frame = lambda d: spark.createDataFrame(list(d.items()), "k int, v int")
    once = tables.upsert(frame(old), frame(new), ["k"])
    assert dict(once.collect()) == old | new
    assert dict(tables.upsert(once, frame(new), ["k"]).collect()) == old | new


def test_duplicate_updates_are_refused(spark):
    rows = spark.createDataFrame([(1, 1), (1, 2)], "k int, v int")
    with pytest.raises(tables.DuplicateKeyError):
        tables.upsert(rows.limit(0), rows, ["k"])


def test_upsert_into_a_table(spark, tmp_path):
    location = str(tmp_path / "t")
    spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string").write.parquet(location + "/version-0")
    tables.external_table(spark, "upserted", location + "/version-0")
    updates = spark.createDataFrame([(2, "B"), (3, "C")], "k int, v string")
    for _ in range(2):
        found = tables.upsert_table(spark, "upserted", updates, ["k"], location)
        assert rows_of(found) == [(1, "a"), (2, "B"), (3, "C")]
    tables.drop_table(spark, "upserted")


def test_catalog(spark, tmp_path):
    tables.use_database(spark, "ads_test")
    tables.use_database(spark, "ads_test")
    one, two = spark.range(3).withColumnRenamed("id", "a"), spark.range(5).select(F.col("id").alias("b"))
    assert tables.create_if_missing(one, "t").count() == 3
    assert tables.create_if_missing(two, "t").count() == 3
    assert tables.replace_table(two, "t").columns == ["b"]
    tables.insert(spark.range(5, 7), "t")
    assert spark.table("t").count() == 7
    tables.drop_table(spark, "t")
    tables.drop_table(spark, "t")
    spend_rows = tables.create_ad_spend(spark, "gold_ad_spend")
    assert spend_rows.isEmpty()
    tables.insert(spend.campaign(spark), "gold_ad_spend")
    spark.sql(
        "INSERT INTO gold_ad_spend VALUES ('x', 500, MAP('Email', .25, 'Affiliates', .75), make_timestamp_ntz(2020, 5, 17, 0, 0, 0))"
    )
    found = spend.ad_spend_exploded(spark.table("gold_ad_spend"))
    dollars = {(r.campaign_id[:1], r.channel): r.dollar_spend for r in found.collect()}
    assert dollars["x", "Email"] == 125.0 and dollars["3", "Email"] == 2000.0 and len(dollars) == 7
    tables.drop_table(spark, "gold_ad_spend")
    spark.sql("USE default")


def test_clustered_files_hold_ranges(spark, tmp_path):
    rows = spark.range(1000).select(F.md5(F.col("id").cast("string")).alias("uid"), "id")
    found = tables.write_clustered(rows, str(tmp_path / "c"), ["uid"], 5)
    spans = (
        found.groupBy(F.input_file_name()).agg(F.min("uid").alias("low"), F.max("uid").alias("high")).orderBy("low").collect()
    )
    assert len(spans) == 5
    assert all(a.high < b.low for a, b in zip(spans, spans[1:]))
    assert rows_of(found) == rows_of(rows)


def test_scratch_folder_is_the_one_the_cluster_names(spark):
    assert scratch_dir(spark) == spark.conf.get("spark.checkpoint.dir")


def test_creating_a_table_twice_is_an_error(spark):
    name = "created_once"
    assert tables.create_new(spark.range(3), name).count() == 3
    with pytest.raises(Exception, match="already exists|ALREADY_EXISTS"):
        tables.create_new(spark.range(5), name)
    assert spark.table(name).count() == 3
    spark.sql(f"DROP TABLE {name}")
