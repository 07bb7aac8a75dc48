import os
import sys
import tempfile
from datetime import datetime, timezone

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from pyspark.sql import SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from milepost.sources.events import EVENT_SCHEMA  # noqa: E402

SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"
AS_OF = datetime(2024, 1, 30, 12, 0, 0, tzinfo=timezone.utc)


@pytest.fixture(scope="session")
def spark():
    s = (
        SparkSession.builder.master("local[4]")
        .appName("milepost-tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    if not s.conf.get("spark.checkpoint.dir", None):
        d = tempfile.mkdtemp(prefix="milepost-tests-")
        s.conf.set("spark.checkpoint.dir", d)
    yield s


def us(ts: str) -> int:
    """ISO text (UTC) -> epoch microseconds."""
    dt = datetime.fromisoformat(ts.replace("Z", "+00:00"))
    if dt.tzinfo is None:
        dt = dt.replace(tzinfo=timezone.utc)
    return int(dt.timestamp() * 1_000_000)


_next_id = [0]


def ev(user, name, ts, params=None, user_id=None, city=None, event_id=None):
    """One GA-schema event row. ``params`` is a list of (key, value)."""
    if event_id is None:
        _next_id[0] += 1
        event_id = _next_id[0]
    micros = us(ts)
    day = datetime.fromtimestamp(micros / 1e6, tz=timezone.utc).date()
    p = None if params is None else [(k, (v,)) for k, v in params]
    return (user, user_id, name, micros, (city,), p, event_id, day)


DEFAULT_PARAMS = [("engagement_time_msec", None)]


def events_df(spark, rows):
    return spark.createDataFrame(rows, EVENT_SCHEMA)


def rows_of(df, order=None):
    cols = df.columns
    out = [tuple(r) for r in df.collect()]
    return sorted(out, key=lambda r: tuple("" if v is None else str(v) for v in r)), cols


__all__ = ["ev", "events_df", "rows_of", "us", "AS_OF", "SF001", "SF01", "DEFAULT_PARAMS", "F"]
