"""Tables: create, replace, insert, upsert and clustered layout."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from creditpath.plans.small import pin
from creditpath.session import scratch_path
from creditpath.sources.schemas import AD_SPEND


class DuplicateKeyError(ValueError):
    """The updates of an upsert hold more than one row for a key."""


def use_database(spark: SparkSession, name: str) -> None:
    """Create the database if it is missing and make it current. Nothing is ever dropped."""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS `{name}`")
    spark.sql(f"USE `{name}`")


def external_table(spark: SparkSession, name: str, path: str) -> DataFrame:
    """Register parquet files under ``path`` as a table."""
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} USING parquet LOCATION '{path}'")
    return spark.table(name)


def create_if_missing(df: DataFrame, name: str) -> DataFrame:
    """Create a table from a query unless it already exists."""
    df.write.format("parquet").mode("ignore").saveAsTable(name)
    return df.sparkSession.table(name)


def replace_table(df: DataFrame, name: str) -> DataFrame:
    """Create the table, or replace its content and schema."""
    df.write.format("parquet").mode("overwrite").option("overwriteSchema", True).saveAsTable(name)
    return df.sparkSession.table(name)


def drop_table(spark: SparkSession, name: str) -> None:
    spark.sql(f"DROP TABLE IF EXISTS {name}")


def create_ad_spend(spark: SparkSession, name: str = "gold_ad_spend") -> DataFrame:
    """An empty campaign table: id, total, share of the total by channel, start."""
    columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in AD_SPEND)
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet")
    return spark.table(name)


def insert(df: DataFrame, name: str) -> None:
    """Append rows to a table by column position."""
    df.write.insertInto(name)


def create_new(df: DataFrame, name: str) -> DataFrame:
    """Create a table from a query; an error if there is one of that name."""
    df.write.mode("errorifexists").saveAsTable(name)
    return df.sparkSession.table(name)


def merged(target: DataFrame, updates: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``target`` with the rows of ``updates`` replaced by key or added."""
    kept = target.join(updates.select(*keys), list(keys), "left_anti")
    return kept.unionByName(updates)


def require_unique(rows: DataFrame, keys: Sequence[str]) -> None:
    """Fail when a key occurs twice."""
    twice = rows.groupBy(*keys).count().where(F.col("count") > 1)
    if not twice.isEmpty():
        raise DuplicateKeyError(f"duplicate keys in {list(keys)}")


def upsert(target: DataFrame, updates: DataFrame, keys: Sequence[str], parts: Sequence[str] = ()) -> DataFrame:
    """The upsert as a DataFrame, after checking that the updates have one row per key.

    Where something comes in several rows, ``parts`` tells them apart: all rows of a key
    are replaced together, so none of an older, longer version stays.
    """
    updates = pin(updates)
    require_unique(updates, [*keys, *parts])
    return merged(target, updates, keys)


def upsert_table(spark: SparkSession, name: str, updates: DataFrame, keys: Sequence[str], location: str) -> DataFrame:
    """Upsert into an external parquet table; the updates are computed once.

    The merged rows go to a new folder under ``location``; readers see them once
    the table is pointed there, and the files of the old version stay readable.
    """
    updates = pin(updates)
    require_unique(updates, keys)
    path = f"{location.rstrip('/')}/{scratch_path(spark, 'version').rsplit('/', 1)[1]}"
    merged(spark.table(name), updates, keys).write.parquet(path)
    spark.sql(f"ALTER TABLE {name} SET LOCATION '{path}'")
    spark.catalog.refreshTable(name)
    return spark.table(name)


def write_clustered(df: DataFrame, path: str, by: Sequence[str], partitions: int | None = None) -> DataFrame:
    """Write parquet in ranges of ``by``, so that a filter on it skips files and row groups.

    Rows equal in all of ``by`` stay together; add columns such as the time when one value has very many.
    """
    ranges = df.repartitionByRange(partitions, *by) if partitions else df.repartitionByRange(*by)
    ranges.sortWithinPartitions(*by).write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)
