"""Queries over the scalar functions, on rows of the trace."""

from __future__ import annotations

from pyspark.sql import functions as F

from objwatch.functions import scalar as S
from objwatch.plans.catalog import query
from objwatch.plans.tables import E, read, trace


def _rows(spark, sf):
    """Whole numbers a (both signs) and b (1 to 9), and the value x."""
    return trace(spark, sf).select("cycle", "event_type", "click", F.col("value").alias("x"), (F.col("cycle") % 37 - 18).alias("a"), (F.col("cycle") % 9 + 1).alias("b"))


R = f"{E}, r AS (SELECT cycle, event_type, click, value AS x, cycle % 37 - 18 AS a, cycle % 9 + 1 AS b FROM e)"


def A():
    return F.col("a")


def B():
    return F.col("b")


def X():
    return F.col("x")


@query("add_sub_mul", f"WITH {R} SELECT cycle, a + b AS added, a - b AS less, a * b AS product FROM r")
def add_sub_mul(spark, sf):
    return _rows(spark, sf).select("cycle", S.add(A(), B()).alias("added"), S.sub(A(), B()).alias("less"), S.mul(A(), B()).alias("product"))


@query("div", f"WITH {R} SELECT cycle, cast(trunc(a / b) AS BIGINT) AS whole, round(x / b, 6) AS part FROM r")
def div(spark, sf):
    return _rows(spark, sf).select("cycle", S.div(A(), B(), integers=True).alias("whole"), F.round(S.div(X(), B()), 6).alias("part"))


@query("rem", f"WITH {R} SELECT cycle, a % b AS rest FROM r")
def rem(spark, sf):
    return _rows(spark, sf).select("cycle", S.rem(A(), B()).alias("rest"))


@query("pow", f"WITH {R} SELECT cycle, cast(pow(a, 3) AS BIGINT) AS cube, round(pow(x, 2), 4) AS square FROM r")
def power(spark, sf):
    return _rows(spark, sf).select("cycle", S.power(A(), F.lit(3), integers=True).alias("cube"), F.round(S.power(X(), F.lit(2)), 4).alias("square"))


@query("neg", f"WITH {R} SELECT cycle, -a AS minus FROM r")
def neg(spark, sf):
    return _rows(spark, sf).select("cycle", S.neg(A()).alias("minus"))


@query("not", f"WITH {R} SELECT cycle, NOT (a > b) AS no, ~a AS inverted FROM r")
def logical_not(spark, sf):
    return _rows(spark, sf).select("cycle", (~(A() > B())).alias("no"), S.bit_not(A()).alias("inverted"))


@query("and_or", f"WITH {R} SELECT cycle, a > 0 AND b > 4 AS both, a > 0 OR b > 4 AS either FROM r")
def and_or(spark, sf):
    return _rows(spark, sf).select("cycle", ((A() > 0) & (B() > 4)).alias("both"), ((A() > 0) | (B() > 4)).alias("either"))


@query("bitand_bitor_bitxor", f"WITH {R} SELECT cycle, a & b AS both, a | b AS either, xor(a, b) AS one FROM r")
def bits(spark, sf):
    return _rows(spark, sf).select("cycle", A().bitwiseAND(B()).alias("both"), A().bitwiseOR(B()).alias("either"), A().bitwiseXOR(B()).alias("one"))


@query("shl_shr", f"WITH {R} SELECT cycle, cycle << 3 AS up, a >> 1 AS down, cycle >> 2 AS plain FROM r")
def shifts(spark, sf):
    return _rows(spark, sf).select("cycle", S.shl(F.col("cycle"), 3).alias("up"), S.shr(A(), 1).alias("down"), S.shr(F.col("cycle"), 2, unsigned=True).alias("plain"))


@query("eq_ne_lt_le_gt_ge", f"WITH {R} SELECT cycle, a = b AS eq, a <> b AS ne, a < b AS lt, a <= b AS le, a > b AS gt, a >= b AS ge FROM r")
def comparisons(spark, sf):
    return _rows(spark, sf).select("cycle", (A() == B()).alias("eq"), (A() != B()).alias("ne"), (A() < B()).alias("lt"), (A() <= B()).alias("le"), (A() > B()).alias("gt"), (A() >= B()).alias("ge"))


@query("sqrt_sin_cos_tan", f"WITH {R} SELECT cycle, CASE WHEN a >= 0 THEN round(sqrt(a), 6) END AS root, round(sin(b), 6) AS s, round(cos(b), 6) AS c, round(tan(b), 6) AS t FROM r")
def trigonometry(spark, sf):
    b = B().cast("double")
    return _rows(spark, sf).select("cycle", F.round(S.sqrt(A().cast("double")), 6).alias("root"), F.round(F.sin(b), 6).alias("s"), F.round(F.cos(b), 6).alias("c"), F.round(F.tan(b), 6).alias("t"))


@query("arcsin_arccos_arctan", f"WITH {R} SELECT cycle, CASE WHEN abs(a) <= 10 THEN round(asin(a / 10.0), 6) END AS s, CASE WHEN abs(a) <= 10 THEN round(acos(a / 10.0), 6) END AS c, round(atan(a), 6) AS t FROM r")
def arcs(spark, sf):
    tenth = A() / 10.0
    return _rows(spark, sf).select("cycle", F.round(S.arcsin(tenth), 6).alias("s"), F.round(S.arccos(tenth), 6).alias("c"), F.round(S.arctan(A().cast("double")), 6).alias("t"))


@query("abs", f"WITH {R} SELECT cycle, abs(a) AS size FROM r")
def absolute(spark, sf):
    return _rows(spark, sf).select("cycle", F.abs(A()).alias("size"))


@query("min_max", f"WITH {R} SELECT cycle, least(a, b) AS low, greatest(a, b) AS high FROM r")
def min_max(spark, sf):
    return _rows(spark, sf).select("cycle", S.minimum(A(), B()).alias("low"), S.maximum(A(), B()).alias("high"))


@query("round", f"WITH {R} SELECT cycle, round(a / 2.0)::DOUBLE AS half, round(x, 1) AS tenth FROM r")
def rounding(spark, sf):
    return _rows(spark, sf).select("cycle", S.round_half_up(A() / 2.0).alias("half"), S.round_half_up(X(), 1).alias("tenth"))


@query("cast", f"WITH {R} SELECT cycle, cast(trunc(a / 4.0) AS BIGINT) AS cut, cast(round(cast(a AS DECIMAL(20, 2)) / 4, 0) AS BIGINT) AS nearest, cast(b AS DOUBLE) AS wide FROM r")
def casts(spark, sf):
    return _rows(spark, sf).select("cycle", S.float_to_int(A() / 4.0).alias("cut"), S.decimal_to_int(A().cast("decimal(20,2)") / 4).alias("nearest"), S.widen(B(), "double").alias("wide"))


@query("at", "SELECT doc_id, ascii(substr(source, 1, 1)) AS first_byte, CASE WHEN length(source) > 4 THEN ascii(substr(source, 5, 1)) END AS fifth_byte FROM documents")
def byte_at(spark, sf):
    d = read(spark, sf, "documents").select("doc_id", F.col("source").cast("binary").alias("b"))
    return d.select("doc_id", S.byte_at(F.col("b"), 0).alias("first_byte"), S.byte_at(F.col("b"), 4).alias("fifth_byte"))


@query("matches", "SELECT doc_id, regexp_matches(text, '[0-9]{3}') AS has_number FROM documents")
def matches(spark, sf):
    return read(spark, sf, "documents").select("doc_id", S.matches(F.col("text"), "[0-9]{3}").alias("has_number"))


@query("format", f"WITH {E} SELECT cycle, 'user ' || user_id || ' did ' || event_type || ' for ' || cast(cast(round(value, 2) AS DECIMAL(30, 2)) AS VARCHAR) || ', clicks ' || coalesce(cast(cast(round(click, 2) AS DECIMAL(30, 2)) AS VARCHAR), 'None') AS text FROM e")
def formatted(spark, sf):
    text = S.message("user {u} did {k} for {v}, clicks {c}", u=F.col("user_id"), k=F.col("event_type"), v=S.number_text(F.col("value"), 2), c=S.number_text(F.col("click"), 2))
    return trace(spark, sf).select("cycle", text.alias("text"))


@query("value_text", f"WITH {E} SELECT cycle, hex(event_type) AS bytes, CASE WHEN click IS NULL THEN 'None' ELSE 'some' END AS opt, '(' || cycle || ', ' || user_id || ')' AS pair FROM e")
def value_text(spark, sf):
    some = S.value_text(F.when(F.col("click").isNotNull(), F.lit("some")))
    return trace(spark, sf).select("cycle", S.value_text(F.col("event_type").cast("binary"), "bytes").alias("bytes"), some.alias("opt"), S.tuple_text(F.col("cycle"), F.col("user_id")).alias("pair"))


@S.user_fn
def clamp(x, low, high):
    shifted = x - low
    return F.least(F.greatest(shifted, F.lit(0)), high - low) + low


@query("user_fn", f"WITH {E} SELECT cycle, least(greatest(value - 20, 0), 60) + 20 AS clamped FROM e")
def user_fn(spark, sf):
    return trace(spark, sf).select("cycle", clamp(F.col("value"), 20, 80).alias("clamped"))


@S.user_fn
def larger(a, b):
    return F.when(a > b, a).otherwise(b)


@query("user_fn_generic", f"WITH {E} SELECT cycle, greatest(cycle, user_id) AS number, greatest(event_type, 'error') AS word FROM e")
def user_fn_generic(spark, sf):
    return trace(spark, sf).select("cycle", larger(F.col("cycle"), F.col("user_id")).alias("number"), larger(F.col("event_type"), "error").alias("word"))
