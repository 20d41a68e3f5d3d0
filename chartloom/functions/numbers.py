"""Number parsing with the tolerance of a scripting language's float()."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .missing import stripped

DAYS_PER_YEAR = 365.25
DAYS_PER_MONTH = 365.25 / 12.0

_FLOAT = r"^[+-]?(\d+(_\d+)*(\.(\d+(_\d+)*)?)?|\.\d+(_\d+)*)([eE][+-]?\d+(_\d+)*)?$"
# how a number can begin; texts that don't are not matched against it
_STARTS = tuple("+-.0123456789")
_SPECIAL = tuple(sign + word for sign in ("", "+", "-") for word in ("inf", "infinity", "nan"))
_FIRST_NUMBER = r"[-+]?\d+(?:\.\d+)?"


def to_number(text: Column) -> Column:
    """Text to double: blanks, exponents, digit underscores, inf and nan pass; ``5d`` does not."""
    plain = stripped(text)
    low = F.lower(plain)
    special = (
        F.when(low.rlike(r"nan$"), F.lit(float("nan")))
        .when(low.startswith("-"), F.lit(float("-inf")))
        .otherwise(F.lit(float("inf")))
    )
    number = F.substring(plain, 1, 1).isin(*_STARTS) & plain.rlike(_FLOAT)
    return F.when(number, F.regexp_replace(plain, "_", "").try_cast("double")).when(low.isin(*_SPECIAL), special)


def first_number(text: Column) -> Column:
    """The whole text as a number, else the first signed number inside it."""
    return F.coalesce(to_number(text), F.regexp_extract(text, f"({_FIRST_NUMBER})", 1).try_cast("double"))


def embedded_number(text: Column) -> Column:
    """Only the first signed number inside the text."""
    return F.regexp_extract(text, f"({_FIRST_NUMBER})", 1).try_cast("double")


def finite_days(text: Column) -> Column:
    """Day counts: numbers, with nan treated as missing."""
    number = to_number(text)
    return F.when(~F.isnan(number), number)


def double_text(x: Column) -> Column:
    """Shortest decimal text of a double, plain notation up to 1e16."""
    wide = F.abs(x) >= 1e7
    small = (F.abs(x) < 1e-3) & (F.abs(x) >= 1e-4)
    plain = F.rtrim(F.format_string("%s", x.cast("decimal(38,18)")), F.lit("0"))
    plain = F.when(plain.endswith("."), F.concat(plain, F.lit("0"))).otherwise(plain)
    return (
        F.when(F.isnan(x), "nan")
        .when(x == float("inf"), "inf")
        .when(x == float("-inf"), "-inf")
        .when((wide & (F.abs(x) < 1e16)) | small, plain)
        .otherwise(x.cast("string"))
    )


def number_label(x: Column) -> Column:
    """Whole numbers without a fraction, others as double text."""
    return F.when(x == F.floor(x), x.cast("long").cast("string")).otherwise(double_text(x))


def _truncated(x: Column) -> Column:
    return x.cast("long").cast("string")


def _days_to_years(text: Column) -> Column:
    n = first_number(text)
    return F.when(n.isNull(), F.coalesce(F.nullif(stripped(text), F.lit("")), text)).otherwise(
        F.when(n > 365, _truncated(n / DAYS_PER_YEAR)).otherwise(_truncated(n))
    )


def _whole(text: Column) -> Column:
    n = first_number(text)
    return F.when(n.isNull(), F.coalesce(F.nullif(stripped(text), F.lit("")), text)).otherwise(_truncated(n))


def _days_abs(text: Column) -> Column:
    n = first_number(text)
    return F.when(n.isNull(), F.coalesce(F.nullif(stripped(text), F.lit("")), text)).otherwise(
        _truncated(F.abs(n))
    )


CONVERTERS = {"": lambda text: text, "days_to_years": _days_to_years, "int": _whole, "days_abs": _days_abs}


def convert(text: Column, name: str | None) -> Column:
    """Apply a registered converter; unknown names are an error at plan time."""
    key = (name or "").strip().lower()
    if key not in CONVERTERS:
        raise ValueError(f"unknown converter {name!r}; known: {sorted(CONVERTERS)}")
    return CONVERTERS[key](text)


def convert_by(text: Column, name: Column) -> Column:
    """Converter chosen per row; an unknown name fails the job."""
    key = F.lower(F.trim(F.coalesce(name, F.lit(""))))
    out = F.when(key == "", text)
    for known, fn in CONVERTERS.items():
        if known:
            out = out.when(key == known, fn(text))
    return out.otherwise(F.raise_error(F.concat(F.lit("unknown converter "), key)))
