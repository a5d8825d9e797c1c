"""Traces: header-bound CSV with absent cells, typed signals, time codecs, binding by name or place, and verdict sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType, LongType

from objwatch.operators.schema import TYPES
from objwatch.plans import ordering

ABSENT = "#"
TIME_NAMES = ("time", "ts", "timestamp")
NANOS = 1_000_000_000
#: Ways to write times; all become whole nanoseconds since the start.
FORMATS = ("relative", "relative_ns", "offset", "offset_ns", "absolute", "rfc3339", "fixed_step", "wall")


def time_column(columns: list[str], wanted: str | int | None = None) -> str:
    """The time column by name, by place from 1, or the first one that is called as times are, in any case."""
    if isinstance(wanted, int):
        if not 1 <= wanted <= len(columns):
            raise ValueError(f"there is no column {wanted}")
        return columns[wanted - 1]
    if wanted is not None:
        if wanted not in columns:
            raise ValueError(f"there is no column {wanted}")
        return wanted
    for c in columns:
        if c.strip().lower() in TIME_NAMES:
            return c
    raise ValueError(f"none of {columns} is a time")


def absent(cell: Column) -> Column:
    """A cell without surrounding white space; # is null."""
    return F.nullif(F.trim(cell), F.lit(ABSENT))


def parsed(cell: Column, kind: str, strict: bool = True) -> Column:
    """Text as a signal of a type. strict: a cell that is not of the type ends the query; else it is null.

    Unsigned integers may be written with a fraction of zeros and must not be negative; bytes are
    hexadecimal; NaN is no value.
    """
    target = TYPES[kind]
    cast = (lambda c: c.cast(target)) if strict else (lambda c: c.try_cast(target))
    bad = lambda c, what: F.raise_error(F.concat(F.lit(f"{what}: "), c)).cast(target) if strict else F.lit(None).cast(target)
    if kind == "Bytes":
        return F.when(cell.isNull(), None).otherwise(F.coalesce(F.unhex(cell), bad(cell, "not hexadecimal")))
    if kind.startswith("UInt"):
        value = cast(F.regexp_replace(cell, r"\.0+$", ""))
        return F.when(value < 0, bad(cell, "negative")).otherwise(value)
    if kind.startswith("UFixed"):
        value = cast(cell)
        return F.when(value < 0, bad(cell, "negative")).otherwise(value)
    if kind.startswith("Float"):
        value = cast(cell)
        return F.when(F.isnan(value), bad(cell, "NaN")).otherwise(value)
    return cast(cell)


def parse_signals(df: DataFrame, schema: dict[str, str], strict: bool = True) -> DataFrame:
    """Text columns as typed signals; other columns stay. Not strict: also errors, the names of the cells that could not be read."""
    cells = {s: absent(F.col(f"`{s}`")) for s in schema}
    typed = {s: parsed(cells[s], k, strict) for s, k in schema.items()}
    out = df
    if not strict:
        wrong = [F.when(cells[s].isNotNull() & typed[s].isNull(), F.lit(s)) for s in schema]
        out = out.withColumn("errors", F.filter(F.array(*wrong), lambda x: x.isNotNull()))
    return out.withColumns(typed)


def decode_time(df: DataFrame, column: str, how: str, order: list[str] | None = None, bucket: Column | None = None, start: int | str | None = None, step: int = 1, name: str = "ts_ns") -> DataFrame:
    """Add times in nanoseconds since the start.

    order and bucket (a non-decreasing function of it) are needed where a time depends on the rows
    before it: offset, offset_ns, fixed_step. start is the zero of absolute (seconds) and
    rfc3339 (text); without it, the first time is zero.
    """
    raw = F.col(f"`{column}`") if how not in ("fixed_step", "wall") else F.lit(None)
    seconds = lambda c: (c.cast(DecimalType(28, 9)) * NANOS).cast(LongType())
    if how == "relative":
        return df.withColumn(name, seconds(raw))
    if how == "relative_ns":
        return df.withColumn(name, raw.cast(LongType()))
    if how in ("offset", "offset_ns"):
        step_ns = seconds(raw) if how == "offset" else raw.cast(LongType())
        return ordering.running_total(df.withColumn("_step", step_ns), bucket, order, "_step", name).drop("_step")
    if how == "fixed_step":
        return ordering.global_rank(df, bucket, order, "_k").withColumn(name, (F.col("_k") + 1) * step).drop("_k")
    if how == "wall":
        return df.withColumn(name, F.unix_micros(F.current_timestamp()) * 1000)
    if how == "absolute":
        value, zero = seconds(raw), None if start is None else F.lit(int(start)) * NANOS
    elif how == "rfc3339":
        value = F.unix_micros(F.to_timestamp(raw)) * 1000
        zero = None if start is None else F.unix_micros(F.to_timestamp(F.lit(start))) * 1000
    else:
        raise ValueError(f"time formats are {FORMATS}")
    timed = df.withColumn(name, value)
    if zero is not None:
        return timed.withColumn(name, F.col(name) - zero)
    first = timed.agg(F.min(name).alias("_zero"))  # one row
    return timed.join(F.broadcast(first)).withColumn(name, F.col(name) - F.col("_zero")).drop("_zero")


def encode_time(column: Column, how: str) -> Column:
    """Nanoseconds as text: relative (seconds with nine digits), relative_ns, unix (seconds), rfc3339 (microseconds, UTC)."""
    whole, rest = F.call_function("div", column, F.lit(NANOS)), F.pmod(column, F.lit(NANOS))
    if how == "relative":
        return F.concat(whole.cast("string"), F.lit("."), F.lpad(rest.cast("string"), 9, "0"))
    if how == "relative_ns":
        return column.cast("string")
    if how == "unix":
        return whole.cast("string")
    if how == "rfc3339":
        return F.date_format(F.timestamp_micros(F.call_function("div", column, F.lit(1000))), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    raise ValueError(how)


def bind_signals(df: DataFrame, mapping: dict[str, str], signals: dict[str, str], strict: bool = True) -> DataFrame:
    """Signals (name: Spark type) from fields by name; a signal without a field is absent in all rows, or an error if strict."""
    missing = [s for s in signals if s not in mapping or mapping[s] not in df.columns]
    if strict and missing:
        raise ValueError(f"no field for {missing}")
    return df.select(*[F.lit(None).cast(k).alias(s) if s in missing else F.col(mapping[s]).cast(k).alias(s) for s, k in signals.items()])


def bind_positional(df: DataFrame, signals: dict[str, str]) -> DataFrame:
    """Signals from columns by place; missing last ones are absent. More columns than signals are an error."""
    if len(df.columns) > len(signals):
        raise ValueError(f"{len(df.columns)} columns for {len(signals)} signals")
    given = dict(zip(signals, df.columns, strict=False))
    return df.select(*[F.col(given[s]).cast(k).alias(s) if s in given else F.lit(None).cast(k).alias(s) for s, k in signals.items()])


def read_trace(spark: SparkSession, path: str, schema: dict[str, str], time: str | int | None = None, how: str = "relative", strict: bool = True, **more) -> DataFrame:
    """A CSV trace: all signals of schema must be in the header; # is absent. A folder is its files in order of their names.

    Adds ts_ns and cycle, the place of a row in its file and in all files before, from 0. Times are read to the nanosecond, but rfc3339 to the microsecond. Signals are typed; other columns are left out.
    """
    raw = spark.read.csv(path, header=True, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    names = {c.strip(): c for c in raw.columns}
    missing = [s for s in schema if s not in names]
    if missing:
        raise ValueError(f"the header has no {missing}")
    at = time_column(list(names), time) if how not in ("fixed_step", "wall") else None
    # a split is a bucket, and splits of one file follow each other: nothing else puts a file's rows in order
    split = F.struct(F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"))
    place = F.struct(split.alias("split"), F.monotonically_increasing_id().alias("i"))
    cells = raw.select(*[F.col(f"`{names[s]}`").alias(s) for s in schema], *([F.col(f"`{names[at]}`").alias("_time")] if at else []), place.alias("_place"))
    typed = parse_signals(cells, schema, strict)
    ranked = ordering.global_rank(typed, more.pop("bucket", F.col("_place.split")), ["_place"], "cycle")
    if at:
        ranked = ranked.withColumn("_time", absent(F.col("_time")))
    timed = decode_time(ranked, "_time", how, order=["cycle"], bucket=F.floor(F.col("cycle") / 100_000), **more)
    return timed.drop("_time", "_place")


def number_cycles(df: DataFrame, order: list[str], bucket: Column, name: str = "cycle") -> DataFrame:
    """Each row is a cycle of its own, numbered from 0 in the order given; rows without any signal count."""
    return ordering.global_rank(df, bucket, order, name)


def live_source(spark: SparkSession, kind: str, schema=None, **options) -> DataFrame:
    """An unbounded trace: any streaming source of Spark."""
    reader = spark.readStream.format(kind).options(**options)
    return (reader.schema(schema) if schema is not None else reader).load()


def write_verdicts(found: DataFrame, sink: str, kind: str = "parquet", checkpoint: str | None = None):
    """Write verdicts to a folder, in batch or as a stream (then its query is returned; it needs a checkpoint folder)."""
    if not found.isStreaming:
        plain = found.withColumn("key", F.array_join(F.transform("key", lambda k: k.cast("string")), ",")) if kind == "csv" else found
        plain.write.mode("append").format(kind).save(sink)
        return None
    return found.writeStream.format(kind).option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
