"""Form values: term lists, weight texts and clamped numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rolecast.functions.text import fold_case, or_empty, strip

# digits may be grouped by single underscores
_DIGITS = r"\d+(?:_\d+)*"
_DECIMAL = rf"(?i)^[+-]?(?:(?:{_DIGITS}\.?(?:{_DIGITS})?|\.{_DIGITS})(?:e[+-]?{_DIGITS})?|inf(?:inity)?|nan)$"

WEIGHT_LINE = "array<struct<line:int,term:string,weight:double,error:string>>"


def term_list(raw: Column) -> Column:
    """Comma or newline separated terms, trimmed, blanks dropped."""
    return F.filter(F.transform(F.split(or_empty(raw), "[,\n]"), strip), lambda t: t != "")


def number(text: Column) -> Column:
    """Text in the decimal grammar as DOUBLE, null when it is no number."""
    bare = strip(text)
    return F.when(bare.rlike(_DECIMAL), F.replace(bare, F.lit("_"), F.lit("")).try_cast("double"))


def weight_entry(entry: Column, fold: bool = True) -> Column:
    """``term = number`` to a struct of ``term``, ``weight`` and ``error``."""
    term = strip(F.substring_index(entry, "=", 1))
    weight = number(F.regexp_replace(entry, "(?s)^[^=]*=", ""))
    error = (
        F.when(~F.contains(entry, F.lit("=")), F.lit("must look like term = weight"))
        .when(term == "", F.lit("has an empty term"))
        .when(weight.isNull(), F.lit("has a non-numeric weight"))
    )
    return F.struct(
        (fold_case(term) if fold else term).alias("term"),
        F.when(error.isNull(), weight).alias("weight"),
        error.alias("error"),
    )


def weight_lines(raw: Column, fold: bool = True) -> Column:
    """``term = number`` lines (or comma parts) to structs; a bad line says so in ``error``."""
    lines = F.split(F.replace(or_empty(raw), F.lit(","), F.lit("\n")), r"\r\n|[\n\r\x0b\f\x1c-\x1e\x85  ]")

    def parse(chunk: Column, index: Column) -> Column:
        entry = weight_entry(chunk, fold)
        return F.struct((index + 1).alias("line"), *[entry[c].alias(c) for c in ("term", "weight", "error")])

    parsed = F.transform(F.transform(lines, strip), lambda c, i: F.when(c != "", parse(c, i)))
    return F.filter(parsed, lambda p: p.isNotNull()).cast(WEIGHT_LINE)


def weight_number(weight: Column) -> Column:
    """Six significant digits without trailing zeros, the usual short float text."""
    rounded = F.format_string("%.5e", weight)
    exponent = F.substring_index(rounded, "e", -1).cast("int")
    mantissa = F.regexp_replace(F.substring_index(rounded, "e", 1), r"\.?0+$", "")
    short = F.concat(mantissa, F.lit("e"), F.format_string("%+03d", exponent))
    plain = F.call_function("format_number", rounded.cast("double"), F.lit("0.##########"))
    return F.when((weight != 0) & ((exponent < -4) | (exponent >= 6)), short).otherwise(plain)


def clamp_int(raw: Column, default: int, low: int = 1, high: int = 500) -> Column:
    """Whole number within bounds; blank and unreadable texts give the default."""

    text = strip(raw)
    # clamped while still wide, so long numbers do not overflow
    value = F.when(text.rlike(r"^[+-]?\d+$"), text.try_cast("decimal(38,0)"))
    bounded = F.when(value.isNotNull(), F.greatest(F.lit(low), F.least(value, F.lit(high))))
    return F.when(or_empty(raw) == "", F.lit(max(low, min(default, high)))).otherwise(
        F.coalesce(bounded.cast("int"), F.lit(default))
    )


def clamp_float(raw: Column, default: float, low: float = 0.0, high: float = 10_000.0) -> Column:
    """Number within bounds; blank and unreadable texts give the default."""
    value = number(raw)
    bounded = F.when(value.isNotNull(), F.greatest(F.lit(low), F.least(value, F.lit(high))))
    return F.when(or_empty(raw) == "", F.lit(max(low, min(default, high)))).otherwise(
        F.coalesce(bounded, F.lit(default))
    )
