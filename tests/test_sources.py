import pytest
from pyspark.sql import functions as F

from objwatch.functions import scalar
from objwatch.sources import trace as T


def write(tmp_path, text):
    path = tmp_path / "t.csv"
    path.write_text(text)
    return str(path)


def test_csv_trace(spark, tmp_path):
    path = write(tmp_path, "Car::uid, Car::speed ,flag,TIME\n1, 2.5 ,true,0.0\n#,#,#,0.1\n2,3,false,0.25\n")
    got = T.read_trace(spark, path, {"Car::uid": "Int64", "Car::speed": "Float64", "flag": "Bool"}).orderBy("cycle").collect()
    assert [tuple(r[c] for c in ("cycle", "Car::uid", "Car::speed", "flag", "ts_ns")) for r in got] == [(0, 1, 2.5, True, 0), (1, None, None, None, 100_000_000), (2, 2, 3.0, False, 250_000_000)]


def test_csv_needs_all_signals_and_a_time(spark, tmp_path):
    path = write(tmp_path, "a,b\n1,2\n")
    with pytest.raises(ValueError, match="no \\['c'\\]"):
        T.read_trace(spark, path, {"c": "Int64"})
    with pytest.raises(ValueError, match="is a time"):
        T.read_trace(spark, path, {"a": "Int64"})
    assert T.read_trace(spark, path, {"a": "Int64"}, how="fixed_step", step=5).first()["ts_ns"] == 5


@pytest.mark.parametrize(
    ("kind", "cell", "value"),
    [("UInt8", "7.0", 7), ("UInt64", "18446744073709551615", 18446744073709551615), ("Bytes", "CAfe", bytearray(b"\xca\xfe")), ("Float64", "1e3", 1000.0), ("Int8", "-128", -128), ("Bool", "true", True), ("String", " x ", "x"), ("Int64", "#", None)],
)
def test_cells(spark, kind, cell, value):
    df = spark.createDataFrame([(cell,)], "c string")
    got = T.parse_signals(df, {"c": kind}).first()["c"]
    assert got == value


@pytest.mark.parametrize(("kind", "cell"), [("UInt8", "-1"), ("Int8", "128"), ("Int64", "1.5"), ("Float64", "NaN"), ("Bytes", "xyz"), ("Bool", "maybe")])
def test_bad_cells(spark, kind, cell):
    df = spark.createDataFrame([(cell,)], "c string")
    loose = T.parse_signals(df, {"c": kind}, strict=False).first()
    assert loose["c"] is None and loose["errors"] == ["c"]
    with pytest.raises(Exception):  # noqa: B017
        T.parse_signals(df, {"c": kind}).collect()


def test_binding(spark):
    df = spark.createDataFrame([(1, 2)], "x bigint, y bigint")
    assert T.bind_positional(df, {"a": "bigint", "b": "bigint", "c": "double"}).first().asDict() == {"a": 1, "b": 2, "c": None}
    with pytest.raises(ValueError):
        T.bind_positional(df, {"a": "bigint"})
    with pytest.raises(ValueError):
        T.bind_signals(df, {"a": "x"}, {"a": "bigint", "b": "bigint"})


def test_scalars(spark):
    row = spark.range(1).select(
        scalar.float_to_int(F.lit(1e30)).alias("a"), scalar.float_to_int(F.lit(-2.9)).alias("b"), scalar.div(F.lit(-7), F.lit(2), integers=True).alias("c"), scalar.rem(F.lit(-7), F.lit(2)).alias("d"),
        scalar.round_half_up(F.lit(-2.5)).alias("e"), scalar.sqrt(F.lit(-1.0)).alias("f"), scalar.byte_at(F.lit(b"ab"), 1).alias("g"), scalar.byte_at(F.lit(b"ab"), 2).alias("h"), scalar.message("{x}/{y}", x=F.lit(1), y=F.lit(None)).alias("i"),
    ).first()
    assert tuple(row) == (scalar.LONG_MAX, -2, -3, -1, -3.0, None, 98, None, "1/None")
    with pytest.raises(ValueError):
        scalar.message("{z}")


def test_rows_of_many_files_and_splits_keep_their_order(spark, tmp_path):
    """Two files of several splits each, and small ones: cycles, and times that add up, follow files by name and rows by place."""
    uid, sizes = 0, {"a": 3000, "b": 2, "c": 2500, "d": 1}
    for name, n in sizes.items():
        with open(tmp_path / f"{name}.csv", "w") as f:
            f.write("uid,time\n")
            for _ in range(n):
                f.write(f"{uid},0.5\n")
                uid += 1
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8000")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        got = T.read_trace(spark, str(tmp_path), {"uid": "Int64"}, how="offset").select("cycle", "uid", "ts_ns").collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert len(got) == uid and all(r["cycle"] == r["uid"] and r["ts_ns"] == (r["uid"] + 1) * 500_000_000 for r in got)
