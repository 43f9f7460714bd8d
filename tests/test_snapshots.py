import random

import pytest
from pyspark.sql import functions as F

from postquarry.operators.snapshots import plain_id, snapshot_changes

SCHEMA = "load_seq bigint, snapshot_date date, loaded_at timestamp, id string, title string, active boolean, __key string"


def brute(rows):
    latest = {}
    for r in sorted(rows, key=lambda r: r[0]):
        if r[3] and r[1]:
            latest[(r[1], r[3].strip().lower())] = r
    days = sorted({d for d, _ in latest})
    norm = lambda r: (" ".join((r[4] or "").split()), True if r[5] is None else r[5], r[6] or "")
    out = set()
    for a, b in zip(days, days[1:]):
        old, new = ({k: norm(r) for (d, k), r in latest.items() if d == x} for x in (a, b))
        out |= {(b.isoformat(), k, "added") for k in new.keys() - old.keys()} | {(b.isoformat(), k, "removed") for k in old.keys() - new.keys()}
        out |= {(b.isoformat(), k, "changed") for k in new.keys() & old.keys() if old[k] != new[k]}
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    from datetime import date, datetime

    rnd, rows, seq = random.Random(seed), [], 0
    for day in (date(2025, 1, 1), date(2025, 1, 8), date(2025, 1, 20)):
        for k in range(600):
            if rnd.random() < 0.8:
                for _ in range(rnd.choice([1, 1, 1, 2])):
                    seq += 1
                    title = rnd.choice(["A  b", "A b", " A b ", None, "", "C"]) if rnd.random() < 0.2 else "A b"
                    rows.append((seq, day, datetime(2025, 1, 1), rnd.choice(["{}", " {} "]).format(f"{k:05d}x"), title, rnd.choice([True, None, True, False]), "z"))
    df = spark.createDataFrame(rows, SCHEMA)
    got = [tuple(r) for r in snapshot_changes(df, defaults={"active": True}, chunk_rows=8, shards=5).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows)


def test_ids(spark):
    ids = ["007", " 2000027490 ", "2000027490.0", "{6D861A22-3DCC-9787-DA58-C1A8E5FB3BDE}", "08bccfcf-12c1-23d4-38cf-b10b92973d5f", "", " ", None, "0"]
    got = [r[0] for r in spark.createDataFrame([(i,) for i in ids], "id string").select(plain_id(F.col("id"))).collect()]
    assert got == ["7", "2000027490", "2000027490", "6d861a22-3dcc-9787-da58-c1a8e5fb3bde", "08bccfcf-12c1-23d4-38cf-b10b92973d5f", None, None, None, "0"]


def test_empty_and_single(spark):
    from datetime import date

    df = spark.createDataFrame([(1, date(2025, 1, 1), None, "1", "x", None, None), (2, None, None, "1", "x", None, None), (3, date(2025, 1, 1), None, None, "x", None, None)], SCHEMA)
    assert snapshot_changes(df).count() == 0 and snapshot_changes(df.limit(0)).count() == 0


def test_ties_repeats_and_long_texts(spark):
    from datetime import date

    long = "word " * 40000
    a, b = date(2025, 1, 1), date(2025, 1, 2)
    rows = [
        (1, a, None, "1", "x", True, None), (1, a, None, "1", "x", True, None), (1, b, None, "1", "x", None, None),  # repeated rows are one
        (2, a, None, "2", long, True, None), (3, b, None, "2", long + "end", True, None),  # the whole text counts
        (5, a, None, "3", "p", True, None), (5, a, None, "3", "q", True, None), (6, b, None, "3", "p", True, None), (None, b, None, "3", "zz", True, None),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    first = sorted(tuple(r) for r in snapshot_changes(df, defaults={"active": True}).collect())
    again = sorted(tuple(r) for r in snapshot_changes(df.orderBy(F.desc("title")), defaults={"active": True}, chunk_rows=1).collect())
    assert first == again and ("2025-01-02", "2", "changed") in first and not [r for r in first if r[1] == "1"]
