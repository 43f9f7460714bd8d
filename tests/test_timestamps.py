from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo

import pytest
from pyspark.sql import functions as F

from postquarry.operators import timestamps as T
from postquarry.operators.timestamps import normalise_timestamps, odd_timestamps

SOURCES = [("ny", "America/New_York", "MDY"), ("lux", "Europe/Luxembourg", "DMY"), ("none", None, None)]

CASES = [
    ("2023-02-18", "lux", "2023-02-17T23:00:00Z"), ("Posted May 2, 2024", "ny", "2024-05-02T04:00:00Z"), ("03/04/2024", "ny", "2024-03-04T05:00:00Z"),
    ("03/04/2024", "lux", "2024-04-02T22:00:00Z"), ("2024/04/03", "ny", "2024-04-03T04:00:00Z"), ("31.12.2024 23:59", "lux", "2024-12-31T22:59:00Z"),
    ("13/25/2024", "ny", "invalid"), ("2025-02-30", "lux", "invalid"), ("25:61", "ny", "invalid"), ("sofort", "ny", "invalid"), ("2024-01-01 24:30", "ny", "invalid"),
    ("2024-07-24 10:00:00 PST", "lux", "2024-07-24T18:00:00Z"), ("2024-07-24 10:00:00 CEST", "ny", "2024-07-24T08:00:00Z"), ("2024-07-24T10:00:00.987+05:30", "ny", "2024-07-24T04:30:00Z"),
    ("2024-07-24T10:00:00-08", "ny", "2024-07-24T18:00:00Z"), ("2024-07-24T10:00:00 America/New_York", "lux", "2024-07-24T14:00:00Z"), ("2024-07-24T10:00:00[Asia/Kolkata]", "lux", "2024-07-24T04:30:00Z"),
    ("2024-07-24T10:00:00 Mars/Olympus", "lux", "invalid"), ("20240213T120154Z", "ny", "2024-02-13T12:01:54Z"), ("20240213", "lux", "2024-02-12T23:00:00Z"), ("1676971297", "ny", "2023-02-21T09:21:37Z"),
    ("1763655036425", "ny", "2025-11-20T16:10:36Z"), ("Mon, 06 Mar 2023 05:53:36 +0200", "ny", "2023-03-06T03:53:36Z"), ("Apr 20, 2024 12:05 AM", "ny", "2024-04-20T04:05:00Z"),
    ("Apr 20, 2024 12:05 pm", "ny", "2024-04-20T16:05:00Z"), ("Apr 20, 2024 13:05 pm", "ny", "invalid"), ("3 août 2024", "lux", "2024-08-02T22:00:00Z"), ("17 de enero de 2025", "lux", "2025-01-16T23:00:00Z"),
    ("5. März 2023", "lux", "2023-03-04T23:00:00Z"), ("10-APR-2025", "none", "2025-04-10T00:00:00Z"), ("7 Foo 2024", "ny", "invalid"), ("  2024-02-10 10:42\t", "lux", "2024-02-10T09:42:00Z"),
    # twice: the first; skipped: ahead by the gap
    ("2024-11-03 01:22:26", "ny", "2024-11-03T05:22:26Z"), ("2024-10-27 02:30", "lux", "2024-10-27T00:30:00Z"), ("2024-03-10 02:30", "ny", "2024-03-10T07:30:00Z"), ("2024-03-31 02:30", "lux", "2024-03-31T01:30:00Z"),
]


@pytest.fixture
def sources(spark):
    return spark.createDataFrame(SOURCES, "source string, home_zone string, numeric_order string")


def test_cases(spark, sources):
    df = spark.createDataFrame([(i, t, s) for i, (t, s, _) in enumerate(CASES)], "row_id bigint, posting_date string, source string")
    got = {r[0]: r[1] for r in odd_timestamps(df, sources).collect()}
    assert got == {i: e for i, (_, _, e) in enumerate(CASES)}


def test_every_hour_of_change_days_against_zoneinfo(spark, sources):
    rows = []
    for day, src, zone in (("2024-03-10", "ny", "America/New_York"), ("2024-11-03", "ny", "America/New_York"), ("2023-03-26", "lux", "Europe/Luxembourg"), ("2023-10-29", "lux", "Europe/Luxembourg")):
        start = datetime.fromisoformat(day)
        for k in range(0, 24 * 60, 7):
            t = start + timedelta(minutes=k)
            # fold=0 is the first of two; for a skipped time its offset is the one before the gap, which moves it ahead
            rows.append((str(t), src, t.replace(tzinfo=ZoneInfo(zone), fold=0).astimezone(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")))
    df = spark.createDataFrame([(i, t, s) for i, (t, s, _) in enumerate(rows)], "row_id bigint, posting_date string, source string")
    got = {r[0]: r[1] for r in odd_timestamps(df, sources).collect()}
    assert got == {i: e for i, (_, _, e) in enumerate(rows)}


def test_blanks_canonical_nulls_and_clashing_names(spark, sources):
    df = spark.createDataFrame(
        [(1, None, "ny", "a", "b"), (2, "  ", "ny", "a", "b"), (3, "2024-01-01T00:00:00Z", "ny", "a", "b"), (4, "2024-01-01", None, "a", "b"), (4, "2024-01-01", None, "a", "b"), (5, "x" * 100000, "who", "a", "b")],
        "row_id bigint, posting_date string, source string, __text string, home_zone string",
    )
    assert sorted(tuple(r) for r in odd_timestamps(df, sources).collect()) == [(4, "2024-01-01T00:00:00Z")] * 2 + [(5, "invalid")]
    full = normalise_timestamps(df, "posting_date", sources.union(sources))
    assert full.columns == [*df.columns, "posted_utc", "pattern"] and full.count() == 6
    assert {r.row_id: r.posted_utc for r in full.collect()} == {1: None, 2: None, 3: "2024-01-01T00:00:00Z", 4: "2024-01-01T00:00:00Z", 5: "invalid"}
    assert odd_timestamps(df.limit(0), sources).count() == 0
    assert odd_timestamps(df, sources.limit(0)).count() == 3


def test_policies(spark):
    rows = [("2024-10-27 02:30:00", "Europe/Berlin"), ("2024-03-31 02:30:00", "Europe/Berlin"), ("2024-06-01 12:00:00", "Europe/Berlin"), ("2024-11-03 01:30:00", "America/New_York"), ("2024-04-07 01:45:00", "Australia/Lord_Howe"), ("2024-10-27 01:59:59", "Europe/Berlin")]
    df = spark.createDataFrame(rows, "t string, z string").withColumn("l", F.expr("cast(t as timestamp_ntz)"))
    at = lambda **k: [r[0] for r in df.select(T.local_to_utc(F.col("l"), F.col("z"), **k).cast("string")).collect()]
    usual = ["2024-10-27 00:30:00", "2024-03-31 01:30:00", "2024-06-01 10:00:00", "2024-11-03 05:30:00", "2024-04-06 14:45:00", "2024-10-26 23:59:59"]
    assert at() == usual
    assert at(ambiguous="second") == ["2024-10-27 01:30:00", usual[1], usual[2], "2024-11-03 06:30:00", "2024-04-06 15:15:00", usual[5]]
    assert at(nonexistent="backward")[1] == "2024-03-31 00:30:00" and at(nonexistent="invalid")[1] is None and at(ambiguous="invalid")[0] is None
    try:
        at(ambiguous="any")
        raise AssertionError
    except ValueError:
        pass
