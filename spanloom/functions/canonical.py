"""Canonical JSON of columns (RFC 8785): keys by UTF-16 units, numbers as ECMAScript writes them, no blanks, nulls kept; and
ids and hashes of it.

The schema says what is written, so the writer is one expression per type, nested like the type. A value that JSON can't
hold (a number that isn't finite, an integer beyond 2 ** 53 - 1) makes the whole text null, and an id of it null as well.
"""

from __future__ import annotations

from collections.abc import Callable
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import domain_hash

SAFE = (1 << 53) - 1
HALF = 1 << 59  # Integers up to 2 ** 122 are two longs to this base.
SHORT = {"\b": "\\b", "\t": "\\t", "\n": "\\n", "\f": "\\f", "\r": "\\r"}


def quoted(text: Column) -> Column:
    """A string in quotes; control characters in their short form or as \\u00xx in small letters."""
    plain = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    full = plain
    for code in range(32):
        full = F.replace(full, F.lit(chr(code)), F.lit(SHORT.get(chr(code), f"\\u{code:04x}")))
    return F.concat(F.lit('"'), F.when(text.rlike(r"[\x00-\x1f]"), full).otherwise(plain), F.lit('"'))


def _once(value: Column, made: Callable[[Column], Column]) -> Column:
    """What is made of a value that is named several times, with the value computed once."""
    return F.get(F.transform(F.array(value), made), F.lit(0))


def _digits(printed: Column) -> Column:
    """The digits of a printed number without point, exponent and zeros at the end."""
    return F.regexp_replace(F.replace(F.substring_index(printed, "e", 1), F.lit("."), F.lit("")), r"(?<=.)0+$", "")


def _shortest(value: Column, made: Callable[[Column, Column, Column], Column]) -> Column:
    """What is made of the fewest digits that read back as the same double, how many, and where the point stands among them.

    Up to 15 digits that read back are the only ones; more are tried from the fewest on. From 2 ** 53 on the JVM's digits aren't
    always the closest, so up to 2 ** 122 the exact integer is rounded, which decimals hold.
    """
    size = F.abs(value)
    reads = lambda tries: F.get(F.filter(F.array(*tries), lambda s: s.cast("double") == size), F.lit(0))
    high = F.floor(size / float(HALF)).cast("decimal(19,0)") * F.lit(Decimal(HALF))
    whole = _once(high + (size % float(HALF)).cast("long").cast("decimal(19,0)"), lambda w: reads([F.round(w, -p).cast("string") for p in range(36, -1, -1)]))
    exact = _once(whole, lambda w: F.concat(_digits(w), F.lit("e"), (F.length(w) - 1).cast("string")))
    all_digits = F.format_string("%.17e", size)
    few = (F.length(_digits(all_digits)) <= 15) & (size >= 2.2250738585072014e-308)
    printed = F.when((size > float(SAFE)) & (size < 2.0**122), exact).when(few, all_digits).otherwise(reads([F.format_string(f"%.{p}e", size) for p in range(17)]))

    def fewer(s: Column) -> Column:
        """Below a power of two doubles lie closer, so that of 16 digits those above may read back where the rounded ones don't."""
        above = (F.substring(_digits(s), 1, 16).cast("long") + 1).cast("string")
        text = F.concat(F.substring(above, 1, 1), F.lit("."), F.substring(above, 2, 15), F.lit("e"), F.substring_index(s, "e", -1))
        return F.when((F.length(_digits(s)) == 17) & (text.cast("double") == size), text).otherwise(s)

    parts = _once(_once(printed, fewer), lambda s: F.struct(_digits(s).alias("digits"), (F.substring_index(s, "e", -1).cast("int") + 1).alias("point")))
    return _once(parts, lambda n: made(n["digits"], F.length(n["digits"]), n["point"]))


def _finite(value: Column, made: Column, zero: Column) -> Column:
    return F.when(~F.isnan(value) & (F.abs(value) != float("inf")), F.when(value == 0, zero).otherwise(F.concat(F.when(value < 0, "-").otherwise(""), made)))


def number_text(value: Column) -> Column:
    """A double as ECMAScript writes it; null if it isn't finite."""

    def made(digits: Column, k: Column, point: Column) -> Column:
        exponent = F.concat(F.when(point > 0, "e+").otherwise("e-"), F.abs(point - 1).cast("string"))
        part = lambda a, n: F.substring(digits, a, n)
        return (
            F.when((point >= k) & (point <= 21), F.concat(digits, F.repeat(F.lit("0"), point - k)))
            .when((point > 0) & (point <= 21), F.concat(part(F.lit(1), point), F.lit("."), part(point + 1, k)))
            .when((point > -6) & (point <= 0), F.concat(F.lit("0."), F.repeat(F.lit("0"), -point), digits))
            .when(k == 1, F.concat(digits, exponent)).otherwise(F.concat(part(F.lit(1), F.lit(1)), F.lit("."), part(F.lit(2), k), exponent))
        )

    return _finite(value, _shortest(value, made), F.lit("0"))


def float_text(value: Column) -> Column:
    """A double as it is mostly printed: with a point or an exponent, so that it can't be taken for an integer; null if it isn't finite."""

    def made(digits: Column, k: Column, point: Column) -> Column:
        exponent = F.concat(F.when(point > 0, "e+").otherwise("e-"), F.lpad(F.abs(point - 1).cast("string"), F.greatest(F.lit(2), F.length(F.abs(point - 1).cast("string"))), F.lit("0")))
        part = lambda a, n: F.substring(digits, a, n)
        return (
            F.when((point >= k) & (point <= 16), F.concat(digits, F.repeat(F.lit("0"), point - k), F.lit(".0")))
            .when((point > 0) & (point <= 16), F.concat(part(F.lit(1), point), F.lit("."), part(point + 1, k)))
            .when((point > -4) & (point <= 0), F.concat(F.lit("0."), F.repeat(F.lit("0"), -point), digits))
            .when(k == 1, F.concat(digits, exponent)).otherwise(F.concat(part(F.lit(1), F.lit(1)), F.lit("."), part(F.lit(2), k), exponent))
        )

    return _finite(value, _shortest(value, made), F.when(value.cast("string").startswith("-"), "-0.0").otherwise("0.0"))


def canonical(value: Column, kind: T.DataType) -> Column:
    """The canonical JSON of a column of this type; null values are the literal null."""
    if isinstance(kind, T.BooleanType):
        made = F.when(value, "true").otherwise("false")
    elif isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        made = F.when(F.abs(value.cast("decimal(20,0)")) <= SAFE, value.cast("string"))
    elif isinstance(kind, (T.FloatType, T.DoubleType, T.DecimalType)):
        made = number_text(value.cast("double"))
    elif isinstance(kind, T.StringType):
        made = quoted(value)
    elif isinstance(kind, T.ArrayType):
        made = _listed(F.transform(value, lambda v: canonical(v, kind.elementType)), "[", "]")
    elif isinstance(kind, T.MapType):
        keyed = F.transform(F.map_entries(value), lambda e: F.struct(F.encode(e["key"], "UTF-16BE").alias("order"), F.concat(quoted(e["key"]), F.lit(":"), canonical(e["value"], kind.valueType)).alias("text")))
        made = _listed(F.transform(F.array_sort(keyed), lambda e: e["text"]), "{", "}")
    elif isinstance(kind, T.StructType):
        fields = sorted(kind.fields, key=lambda f: f.name.encode("utf-16-be"))
        made = _listed(F.array(*[F.concat(quoted(F.lit(f.name)), F.lit(":"), canonical(value[f.name], f.dataType)) for f in fields]), "{", "}")
    else:
        raise TypeError(f"no JSON for {kind.simpleString()}")
    return F.when(value.isNull(), "null").otherwise(made)


def _listed(parts: Column, left: str, right: str) -> Column:
    return F.when(~F.exists(parts, F.isnull), F.concat(F.lit(left), F.array_join(parts, ","), F.lit(right)))


def canonical_hash(domain: str, value: Column, kind: T.DataType) -> Column:
    return domain_hash(domain, canonical(value, kind))


def stable_id(prefix: str, *parts: Column) -> Column:
    """The same number for the same parts, as strings or null: 20 digits of the digest of their canonical list."""
    listed = F.array(*[p.cast("string") for p in parts])
    return F.concat(F.lit(prefix + ":"), F.substring(F.sha2(canonical(listed, T.ArrayType(T.StringType())), 256), 1, 20))
