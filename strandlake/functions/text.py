"""General string functions as column expressions."""

from __future__ import annotations

import textwrap

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from strandlake.registry import query, table

SUFFIXES = "KMGTPE"
BLANK = "[ \\t\\n\\u000b\\f\\r]"


def truncate_spaces(s: Column, where: str = "both") -> Column:
    """Without white space at the ``begin``, the ``end`` or both."""
    if where in ("begin", "both"):
        s = F.regexp_replace(s, f"^{BLANK}+", "")
    return F.regexp_replace(s, f"{BLANK}+$", "") if where in ("end", "both") else s


def split_nonempty(s: Column, sep: str) -> Column:
    return F.filter(F.split(s, f"[{sep}]"), lambda x: x != "")


def split_in_two(s: Column, sep: str) -> Column:
    """What is before the first separator and after it; the second is empty if there is none."""
    at = F.instr(s, sep)
    return F.struct(F.when(at > 0, F.substr(s, F.lit(1), at - 1)).otherwise(s).alias("first"), F.when(at > 0, F.substr(s, at + len(sep))).otherwise("").alias("second"))


def join_numbers(a: Column, sep: str) -> Column:
    return F.array_join(F.transform(a, lambda x: x.cast("string")), sep)


def compare(a: Column, b: Column, case: bool = True) -> Column:
    """-1, 0 or 1, by bytes; without ``case`` letters compare as lower-case ones."""
    a, b = (a, b) if case else (F.lower(a), F.lower(b))
    return F.when(a < b, -1).when(a > b, 1).otherwise(0)


def is_blank(s: Column) -> Column:
    return ~s.rlike("[^ \\t\\n\\u000b\\f\\r]")


def is_lower(s: Column) -> Column:
    return ~s.rlike("[A-Z]")


def is_upper(s: Column) -> Column:
    return ~s.rlike("[a-z]")


def to_number(s: Column, kind: str = "long") -> Column:
    """A number of all of the text, or null."""
    return s.try_cast(kind)


def to_bool(s: Column) -> Column:
    v = F.lower(s)
    return F.when(v.isin("true", "t", "yes", "y"), True).when(v.isin("false", "f", "no", "n"), False)


def size_to_number(s: Column) -> Column:
    """Bytes of a size such as 1.5KB (1000) or 2MiB (1024), rounded; null if it is none."""
    shape = r"^([0-9]+(?:\.[0-9]+)?) ?([KMGTPE]?)(i?)B?$"
    value, power = F.regexp_extract(s, shape, 1).try_cast("double"), F.instr(F.lit(SUFFIXES), F.regexp_extract(s, shape, 2))
    power = F.when(F.regexp_extract(s, shape, 2) == "", 0).otherwise(power)
    base = F.when(F.regexp_extract(s, shape, 3) == "i", 1024.0).otherwise(1000.0)
    return F.when(s.rlike(shape), F.round(value * F.pow(base, power)).cast("long"))


def number_to_size(n: Column, digits: int = 3, suffix: str = "") -> Column:
    """Three significant digits or more and a 1000-based suffix, rounded half up: 1234567 is 1.23M."""
    text = n.cast("string")
    power = F.floor((F.length(text) - 1) / 3)
    before = F.length(text) - 3 * power
    unit = F.pow(F.lit(10).cast("decimal(38,0)").cast("double"), 3 * power - (digits - before))
    kept = F.when(power == 0, n.cast("double")).otherwise(F.floor(n / unit + 0.5))
    over = (power > 0) & (kept >= 10**digits)  # rounding made one digit more
    kept = F.when(over, kept / 10).otherwise(kept)
    before = F.when(over, before + 1).otherwise(before)
    up = before > 3
    power, before = F.when(up, power + 1).otherwise(power), F.when(up, F.lit(1)).otherwise(before)
    number = F.lpad(kept.cast("long").cast("string"), digits, "0")
    shown = F.when(before < digits, F.concat(F.substr(number, F.lit(1), before.cast("int")), F.lit("."), F.substr(number, before.cast("int") + 1))).otherwise(number)
    return F.when(power == 0, text).otherwise(F.concat(shown, F.substr(F.lit(SUFFIXES), power.cast("int"), F.lit(1)), F.lit(suffix)))


def number_to_binary_size(n: Column, digits: int = 3, suffix: str = "") -> Column:
    """Three significant digits or more and a 1024-based suffix, rounded half up: 1536 is 1.50Ki. What would take more digits, or be 1024, takes the next suffix."""
    wide = lambda c: c.cast("decimal(38,0)")
    power = sum((n >= 1024**k).cast("int") for k in range(1, 7))

    def shown(p: Column) -> tuple[Column, Column]:
        """The number with this suffix, and whether it fits."""
        unit = F.element_at(F.array(*[F.lit(1024**k) for k in range(7)]), p + 1)
        whole = F.call_function("div", n, unit)
        before = F.length(whole.cast("string"))
        more = F.greatest(F.lit(0), F.least(digits - before, 3 * p))
        ten = lambda k: F.element_at(F.array(*[F.lit(10**i) for i in range(19)]), k + 1)
        scaled = F.call_function("div", 2 * wide(n) * wide(ten(more)) + wide(unit), 2 * wide(unit))
        longer = (more > 0) & (F.length(F.call_function("div", scaled, ten(more)).cast("string")) > before)
        scaled, more = F.when(longer, F.call_function("div", scaled, F.lit(10))).otherwise(scaled), F.when(longer, more - 1).otherwise(more)
        first = F.call_function("div", scaled, ten(more))
        rest = F.when(more > 0, F.concat(F.lit("."), F.lpad((scaled - first * ten(more)).cast("string"), more, F.lit("0")))).otherwise("")
        fits = (F.length(first.cast("string")) <= digits) & (first != 1024) & (whole < 1000 if digits == 3 else F.lit(True))
        return F.concat(first.cast("string"), rest, F.substr(F.lit(SUFFIXES), p, F.lit(1)), F.lit("i" + suffix)), fits

    text, fits = shown(power)
    return F.when(power == 0, n.cast("string")).otherwise(F.when(fits, text).otherwise(shown(F.least(power + 1, F.lit(6)))[0]))


def is_number(s: Column) -> Column:
    """A sign, digits with a fraction between or before them, and a small e exponent."""
    return s.rlike(r"^[+-]?([0-9]+(\.[0-9]+)?|\.[0-9]+)(e[+-]?[0-9]+)?$")


def with_commas(n: Column) -> Column:
    return F.format_number(n, 0)


def fixed_width(n: Column, width: int) -> Column:
    """Zeros in front; longer numbers stay whole."""
    s = n.cast("string")
    return F.when(F.length(s) < width, F.lpad(s, width, "0")).otherwise(s)


def find(s: Column, what: str) -> Column:
    """0-based place of the first occurrence, -1 for none."""
    return F.instr(s, what) - 1


def rfind(s: Column, what: str) -> Column:
    at = F.instr(F.reverse(s), what[::-1])
    return F.when(at > 0, F.length(s) - at - len(what) + 1).otherwise(-1)


def find_first_of(s: Column, chars: str) -> Column:
    """0-based place of the first of any of ``chars``, -1 for none."""
    rest = F.regexp_replace(s, f"[{chars}][\\s\\S]*$", "")
    return F.when(F.length(rest) < F.length(s), F.length(rest)).otherwise(-1)


def find_last_of(s: Column, chars: str) -> Column:
    at = find_first_of(F.reverse(s), chars)
    return F.when(at >= 0, F.length(s) - 1 - at).otherwise(-1)


_ESCAPES = {"\t": "t", "\v": "v", "\b": "b", "\r": "r", "\f": "f", "\a": "a", "\n": "n", "\\": "\\", "'": "'", '"': '"'}


def _printable(s: pd.Series) -> pd.Series:
    one = lambda c: "\\" + _ESCAPES[c] if c in _ESCAPES else c if not c.isascii() or c.isprintable() else f"\\{ord(c):03o}"
    return s.map(lambda t: None if t is None else "".join(map(one, t)))


def printable(s: Column) -> Column:
    """C escapes for control characters, quotes and backslashes, in Arrow batches."""
    return F.pandas_udf(_printable, "string")(s)


def wrapped(s: Column, width: int) -> Column:
    """Lines of at most ``width`` characters, in Arrow batches."""

    def lines(v: pd.Series) -> pd.Series:
        return v.map(lambda t: None if t is None else textwrap.wrap(t, width))

    lines.__annotations__ = {"v": pd.Series, "return": pd.Series}
    return F.pandas_udf(lines, "array<string>")(s)


@query("str_scalars", r"""SELECT event_id, regexp_replace(regexp_replace(s, '^\s+', ''), '\s+$', '') AS trimmed, len(list_filter(string_split(props, ','), lambda x: x <> ''))::INT AS parts, split_part(props, ':', 1) AS head,
    CASE WHEN event_type < 'm' THEN -1 WHEN event_type > 'm' THEN 1 ELSE 0 END AS cmp, upper(event_type) AS up, (instr(event_type, 'c') - 1)::INT AS at, CASE WHEN regexp_matches(v, '^[+-]?([0-9]+(\.[0-9]+)?|\.[0-9]+)(e[+-]?[0-9]+)?$') THEN 1 ELSE 0 END AS num,
    format('{:,}', event_id * 1001) AS commas, CASE WHEN len(event_id::VARCHAR) < 6 THEN lpad(event_id::VARCHAR, 6, '0') ELSE event_id::VARCHAR END AS fixed, (user_id * 1024)::BIGINT AS bytes
    FROM (SELECT *, '  ' || event_type || ' ' AS s, CASE WHEN event_id % 3 = 0 THEN '1.5e' || event_id WHEN event_id % 3 = 1 THEN '5.' ELSE '-.5' END AS v FROM events)""")
def scalars(spark: SparkSession, sf_dir: str):  # noqa: ANN201
    e = table(spark, sf_dir, "events")
    v = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("1.5e"), F.col("event_id").cast("string"))).when(F.col("event_id") % 3 == 1, "5.").otherwise("-.5")
    return e.select(
        "event_id",
        truncate_spaces(F.concat(F.lit("  "), "event_type", F.lit(" "))).alias("trimmed"),
        F.size(split_nonempty(F.col("props"), ",")).alias("parts"),
        split_in_two(F.col("props"), ":")["first"].alias("head"),
        compare(F.col("event_type"), F.lit("m")).alias("cmp"),
        F.upper("event_type").alias("up"),
        find(F.col("event_type"), "c").alias("at"),
        is_number(v).cast("int").alias("num"),
        with_commas(F.col("event_id") * 1001).alias("commas"),
        fixed_width(F.col("event_id"), 6).alias("fixed"),
        size_to_number(F.concat(F.col("user_id").cast("string"), F.lit("KiB"))).alias("bytes"),
    )
