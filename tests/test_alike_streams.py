"""Pairs of a stream that hold the same: all of them, in the order of cycles."""

import random

import duckdb
import pandas as pd
from test_streams import Handle, Times

from objwatch.streaming.world import AlikeProcessor


def test_each_open_version_is_in_a_pair_with_each_other():
    """Six objects, two batches that carry how many are open, shuffled rows, and a lane of cycles."""
    p, r, alive, n, us = AlikeProcessor(), random.Random(5), set(), 0, 0
    p.init(Handle())
    for _ in range(2):
        rows, want = [], []
        for _ in range(200):
            us, u = us + 1, r.randrange(6)
            if u in alive:
                rows.append((us, 0, 0, -1, u))
                alive.remove(u)
            if r.random() < 0.7:
                rows.append((us, 0, 0, 1, u))
                alive.add(u)
            want.append((us, len(alive) * (len(alive) - 1) // 2))
        r.shuffle(rows)
        made = list(p.handleInputRows(("=1",), iter([pd.DataFrame(rows, columns=["us", "order", "phase", "sign", "uid"])]), Times(0)))
        d = pd.concat(made).groupby("us")["d"].sum()
        for us_, count in want:
            n += int(d.get(us_, 0))
            assert n == count
    marks = pd.DataFrame([(3, 1, 1, 0, 7), (2, 0, 1, 0, 7)], columns=["us", "order", "phase", "sign", "uid"])
    assert [tuple(x) for made in p.handleInputRows(("#1",), iter([marks]), Times(0)) for x in made.itertuples(index=False)] == [(2, 0, 1, 0), (3, 1, 1, 0)]


def test_stream_world_pairs_counts_all_pairs_of_odd_traces(spark, tmp_path):
    """Values of 100 and less, times that do not go with the cycles or are missing, rows without a value or a user, negative users, cycles far apart."""
    from objwatch.plans import catalog

    r, rows = random.Random(9), []
    for i in range(300):
        minute = r.choice([37 * i, 37 * i, r.randrange(9000), None])
        rows.append((7 + i * 10**10, minute, r.choice([None, *range(-5, 6)]), "view", r.choice([None, -0.5, -1.0, 0.0, 5.0, 5.9, 99.99, 100.0, 100.5, 101.7])))
    frame = spark.createDataFrame(rows, "event_id long, minute int, user_id long, event_type string, value double")
    frame = frame.selectExpr("event_id", "timestamp_ntz'2024-01-01' + make_dt_interval(0, 0, minute) AS ts", "user_id", "event_type", "value", "'{}' AS props")
    frame.coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    c = duckdb.connect()
    c.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    want = sorted(c.sql(catalog.ORACLE_SQL["stream_world_pairs"]).fetchall())
    assert sorted(map(tuple, catalog.QUERIES["stream_world_pairs"](spark, str(tmp_path)).collect())) == want
    assert len(want) == 300 and max(n for _, n in want) > 3
