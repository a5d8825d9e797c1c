"""Queries on small tables of their own that hold what the given tables do not."""

import datetime

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq

from objwatch.plans import catalog


def written(folder, values):
    """events of one row each: (user, value)."""
    start = datetime.datetime(2024, 1, 1)
    rows = [{"event_id": i, "ts": start + datetime.timedelta(hours=3 * i), "user_id": u, "event_type": "purchase", "value": v, "props": "{}"} for i, (u, v) in enumerate(values)]
    pq.write_table(pa.Table.from_pylist(rows, pa.schema([("event_id", pa.int64()), ("ts", pa.timestamp("us")), ("user_id", pa.int64()), ("event_type", pa.string()), ("value", pa.float64()), ("props", pa.string())])), f"{folder}/events.parquet")
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW events AS SELECT * FROM '{folder}/events.parquet'")
    return str(folder), duck


def test_quantify_n_at_the_edge_of_a_code(spark, tmp_path):
    folder, duck = written(tmp_path, [(1, 150.5), (2, 148.0), (3, 149.0), (4, 148.0), (5, 147.99), (6, 152.0), (2, 10.0)])
    got = sorted(tuple(r) for r in catalog.QUERIES["quantify_n"](spark, folder).select("cycle", "n").collect())
    assert got == sorted(duck.sql(catalog.ORACLE_SQL["quantify_n"]).select("cycle, n::BIGINT").fetchall())
    assert [n for _, n in got] == [0, 0, 1, 3, 3, 3, 1]


def test_streams_of_several_files(spark, tmp_path, monkeypatch):
    """Parts of a stream have several files, and no task sees all rows."""
    from objwatch.plans import queries_stream

    folder, duck = written(tmp_path, [(i % 3, float(i * 37 % 301)) for i in range(900)])
    made = []
    run = queries_stream._Parts.run
    monkeypatch.setattr(queries_stream._Parts, "run", lambda self, *args, **more: (made.append(self), run(self, *args, **more))[1])
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for name in ("stream_state", "stream_late", "stream_world"):
            columns = "cycle_id" if name == "stream_world" else "cycle, user_id" if name == "stream_late" else "cycle, user_id, last, prev_1, prev_2"
            got = catalog.QUERIES[name](spark, folder).selectExpr(*columns.split(", ")).collect()
            want = duck.sql(f"SELECT {columns} FROM ({catalog.ORACLE_SQL[name]})").fetchall()
            assert sorted(map(str, map(tuple, got))) == sorted(map(str, want)) and want
            rows = spark.read.parquet(made[-1].path).groupBy("_metadata.file_path").count().collect()
            assert len(rows) >= 4 * len(made[-1].parts) and max(r["count"] for r in rows) < 450
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_waiting_rows_are_merged_by_time(monkeypatch):
    """Runs of chunks, out of order, with a mark inside of one: rows come by time, and few are open at once."""
    import pyarrow as pa
    from test_streams import Handle

    from objwatch.streaming import lives

    monkeypatch.setattr(lives, "CHUNK", 256)
    p = lives.LifeProcessor(lives.Objects({"value": "double"}))
    p.init(Handle())
    rows = [(i * 7919 % 5000, i, float(i)) for i in range(5000)]
    for i in range(0, 5000, 1000):
        p._wait(pa.table(list(map(list, zip(*rows[i : i + 1000], strict=True))), schema=p.arrow))
    assert len(p.waiting) == 20
    later = []
    tables = list(p._ready(3333, later))
    assert [tuple(r.values()) for t in tables for r in t.to_pylist()] == sorted(r for r in rows if r[0] < 3333) and min(later) == 3333
    assert max(map(len, tables)) <= 5 * 256
    assert [tuple(r.values()) for t in p._ready(9999, []) for r in t.to_pylist()] == sorted(r for r in rows if r[0] >= 3333) and not p.waiting and not p.chunks


def test_aggregates_and_counts_of_an_empty_trace(spark, tmp_path):
    folder, duck = written(tmp_path, [])
    for name in ("agg_objects", "agg_objects_ended", "agg_objects_median", "stream_late_counts"):
        got = catalog.QUERIES[name](spark, folder)
        assert sorted(map(tuple, got.collect())) == sorted(duck.sql(f"SELECT {', '.join(got.columns)} FROM ({catalog.ORACLE_SQL[name]})").fetchall()), name
