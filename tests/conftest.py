import datetime as dt
import os
import random
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, os.environ.get("PYTHONPATH", "")])

from creditpath.session import build_session  # noqa: E402

DATA = "/root/testdata"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "local[8]",
        "creditpath-tests",
        spark__sql__shuffle__partitions="8",
        spark__driver__memory="8g",
        spark__sql__warehouse__dir=str(tmp_path_factory.mktemp("warehouse")),
        spark__checkpoint__dir=str(tmp_path_factory.mktemp("checkpoints")),
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def hot_raw(spark):
    """Raw events in which one user's day has half of the rows, many at the same time, and few conversions."""
    rng = random.Random(5)
    day = dt.datetime(2024, 3, 1)
    rows = []
    for i in range(6000):
        if i % 2:
            user, ts = 7, day + dt.timedelta(seconds=rng.choice([5, 5, 5, 60, 61, 3000 + i]))
            kind = "purchase" if rng.random() < 0.001 else rng.choice(["view", "click"])
        else:
            user, ts = rng.randrange(100, 900), day + dt.timedelta(minutes=rng.randrange(4000))
            kind = rng.choice(["view", "click", "purchase", "error"])
        rows.append((i, ts, user, kind, round(rng.random() * 50, 2), '{"k": %d}' % rng.randrange(100)))
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    return spark.createDataFrame(rows, schema).repartition(6).cache()


def rows_of(df, digits=9):
    """The rows as a sorted list, doubles rounded, columns by name."""
    names = sorted(df.columns)

    def plain(value):
        if isinstance(value, float):
            return round(value, digits) + 0.0
        return [plain(v) for v in value] if isinstance(value, list) else value

    return sorted((tuple(plain(row[n]) for n in names) for row in df.collect()), key=repr)
