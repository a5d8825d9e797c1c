r"""Personal data spans: patterns propose, checksums confirm, nearby words adjust a score (DataFrame functions only).

The patterns are written so that Java's matcher needs no recursion and no quadratic retries on
long runs: loops over groups are possessive, and a run of characters is entered only at its start
(\G is the end of the match before). The matches are the same as those of the plain patterns:
a start further inside the run ends at the same character and so fails or matches alike.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from objwatch.llm.common import table


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """True if the Luhn sum of a string of ASCII digits is a multiple of ten."""
    at = F.sequence(F.lit(1), F.length(digits))
    rev = F.reverse(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(rev, i, F.lit(1)).cast("int")
        twice = d * 2
        return total + F.when(i % 2 == 1, d).otherwise(twice - F.when(twice > 9, 9).otherwise(0))

    return F.aggregate(at, F.lit(0), add) % 10 == 0


def mod97(code: Column) -> Column:
    """True if an account number (country, two check digits, rest) leaves 1 when divided by 97."""
    moved = F.concat(F.substring(code, F.lit(5), F.length(code)), F.substring(code, 1, 4))

    def step(rest: Column, i: Column) -> Column:
        c = F.ascii(F.substring(moved, i, F.lit(1)))
        value = F.when(c >= 65, c - 55).otherwise(c - 48)
        return F.when(value > 9, rest * 100 + value).otherwise(rest * 10 + value) % 97

    return F.aggregate(F.sequence(F.lit(1), F.length(moved)), F.lit(0), step) == 1


def _ip_parts(m: Column) -> Column:
    def small(p: Column) -> Column:
        bare = F.regexp_replace(p, "^0+", "")
        return (F.length(bare) <= 3) & (F.concat(F.lit("0"), F.substring(bare, 1, 3)).cast("int") <= 255)

    return F.forall(F.split(m, r"\."), small)


def _n_digits(low: int, high: int):
    return lambda m: F.length(_digits(m)).between(low, high)


@dataclass(frozen=True)
class Kind:
    """A kind of span: its pattern, a cheap test that any text with a match passes, and what confirms a match.

    A confirmed match has the score `base`; `boost` is added if a word of `words` stands in the
    `WINDOW` characters before or after it.
    """

    name: str
    pattern: str
    gate: str
    confirm: object
    base: float
    words: str
    boost: float = 0.3


WINDOW = 40
THRESHOLD = 0.5

KINDS = [
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "instr(text, '@') > 0", lambda m: F.lit(True), 0.7, "mail|contact|kontakt|correo|courriel"),
    Kind("ip", r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}+", r"text rlike '[0-9]\\.[0-9]++\\.[0-9]'", _ip_parts, 0.6, "ip|host|server|address|adresse"),
    Kind("card", r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){15,18}+(?![0-9])(?![ -][0-9])", "text rlike '[0-9][ -]?+[0-9][ -]?+[0-9][ -]?+[0-9][ -]?+[0-9]'", lambda m: luhn(_digits(m)), 0.7, "card|visa|karte|carte|tarjeta|credit"),
    Kind("phone", r"\+[0-9][ ().0-9-]+[0-9]", "instr(text, '+') > 0", _n_digits(8, 15), 0.6, "phone|call|fax|mobile|telefon|tel"),
    # beyond the base kinds
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}+(?![A-Za-z0-9])", "text rlike '[A-Z]{2}[0-9]{2} ?[A-Z0-9]'", lambda m: mod97(F.regexp_replace(m, " ", "")), 0.7, "iban|konto|bank|account|compte|cuenta"),
    Kind("national_id", r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])", "text rlike '[0-9]-[0-9]{2}-[0-9]'", lambda m: F.lit(True), 0.3, "ssn|social|security|tax"),
]
BASE = ("email", "ip", "card", "phone")


def _matches(text: Column, pattern: str) -> Column:
    """array<struct<s, e, m>> of all leftmost non-overlapping matches, in code points.

    Splitting by the pattern gives the texts between the matches, and so where each one starts.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    empty = F.expr("cast(array() as array<struct<s:int, e:int, m:string>>)")

    def add(acc: Column, x: Column) -> Column:
        s = acc["at"] + F.length(x["gap"])
        e = s + F.length(x["m"])
        return F.struct(e.alias("at"), F.concat(acc["out"], F.array(F.struct(s.alias("s"), e.alias("e"), x["m"].alias("m")))).alias("out"))

    pairs = F.arrays_zip(found.alias("m"), F.slice(gaps, 1, F.size(found)).alias("gap"))
    return F.aggregate(pairs, F.struct(F.lit(0).alias("at"), empty.alias("out")), add, lambda acc: acc["out"])


def _scored(text: Column, kind: Kind) -> Column:
    def look(x: Column) -> Column:
        begin = F.greatest(x["s"] - WINDOW, F.lit(0))
        near = F.concat(F.substring(text, begin + 1, x["s"] - begin), F.lit(" "), F.substring(text, x["e"] + 1, F.lit(WINDOW)))
        score = F.lit(kind.base) + F.when(near.rlike(rf"(?i)(?<![A-Za-z])(?:{kind.words})"), kind.boost).otherwise(0.0)
        return F.struct(F.lit(kind.name).alias("kind"), x["s"].alias("start"), x["e"].alias("end"), score.alias("score"))

    confirmed = F.filter(_matches(text, kind.pattern), lambda x: kind.confirm(x["m"]))
    return F.transform(confirmed, look)


NO_SPANS = "cast(array() as array<struct<kind:string, start:int, end:int, score:double>>)"


def find_pii(docs: DataFrame, kinds: list[Kind] = KINDS, threshold: float = THRESHOLD) -> DataFrame:
    """docs and a column spans: array<struct<kind, start, end, score>> in the order of kinds, then of start.

    Null and empty texts have no spans; offsets are code points, end exclusive. Base kinds are
    reported whenever their check passes; others need a score of threshold. Kinds are looked for
    independently, so spans of two kinds may overlap. Every row is treated by itself, so repeated
    rows and null identifiers give what any row gives; an existing column spans is replaced.
    """
    source = F.coalesce(F.col("text"), F.lit(""))
    each = []
    for kind in kinds:
        gate = F.expr(kind.gate.replace("text", "coalesce(text, '')", 1))
        spans = _scored(source, kind)
        if kind.name not in BASE:
            spans = F.filter(spans, lambda x: x["score"] >= threshold)
        each.append(F.when(gate, spans).otherwise(F.expr(NO_SPANS)))
    return docs.withColumn("spans", F.concat(*each))


def redact(docs: DataFrame, mask: str = "*") -> DataFrame:
    """docs with each code point of a span of find_pii() replaced by mask; lengths stay.

    A null text stays null, an empty one empty; spans may overlap. Rows are treated each by
    itself, repeated ones and those without an id too. A text of any length is looked at whole. An existing column spans is replaced.
    """

    def cover(text: Column, x: Column) -> Column:
        n = x["end"] - x["start"]
        return F.concat(F.substring(text, F.lit(1), x["start"]), F.repeat(F.lit(mask), n), F.substring(text, x["end"] + 1, F.length(text)))

    return find_pii(docs).withColumn("text", F.when(F.size("spans") == 0, F.col("text")).otherwise(F.aggregate("spans", F.col("text"), cover)))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_pii(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "spans")
    base = F.filter("spans", lambda x: x["kind"].isin(*BASE))

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    counts = [count(kind) for kind in BASE]
    return found.select("doc_id", *counts, F.sha2(_joined(base).cast("binary"), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))
