"""Missing-value vocabulary and tests on raw values.

A raw value is carried as two columns: its text and its JSON kind
(``null``, ``string``, ``number``, ``boolean``, ``array``, ``object``).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Placeholder words that count as "sentinel".
SENTINELS = (
    "not reported", "unknown", "not applicable", "not available", "not evaluated",
    "not otherwise specified", "indeterminate", "cannot be assessed", "unspecified",
    "na", "n/a", "none", "null", "missing", "--",
)
# The smaller vocabulary behind placeholder fallback.
FALLBACK_WORDS = ("", "not reported", "unknown", "not applicable", "--")

# what Python's str.strip removes around a value: every character that counts as white space there
_SPACE = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())


def stripped(text: Column) -> Column:
    return F.btrim(text, F.lit(_SPACE))


def trimmed(text: Column) -> Column:
    """``stripped`` for a column that costs little to read more than once.

    Nearly all texts begin and end with a printable ASCII character, which is
    cheap to see; only the others are searched for white space.
    """
    first, last = (text >= "!") & (text < "\x7f"), F.substring(text, -1, 1).between("!", "~")
    return F.when(first & last, text).otherwise(stripped(text))


def value_state(text: Column, kind: Column) -> Column:
    """null / sentinel / valid."""
    plain = F.lower(trimmed(text))
    return (
        F.when(kind == "number", "valid")
        .when(text.isNull() | (kind == "null"), "null")
        .when((kind == "string") & plain.isin("", *SENTINELS), F.when(plain == "", "null").otherwise("sentinel"))
        .when((kind == "array") & (text == "[]"), "null")
        .when((kind == "object") & (text == "{}"), "null")
        .otherwise("valid")
    )


def text_state(text: Column) -> Column:
    """``value_state`` for columns known to hold strings."""
    return value_state(text, F.lit("string"))


def cleaned(text: Column, fallback: str | None = "not reported") -> Column:
    plain = trimmed(text)
    keep = text.isNotNull() & ~F.lower(plain).isin(*FALLBACK_WORDS)
    return F.when(keep, plain).otherwise(F.lit(fallback))


def is_missing_token(text: Column, extra: tuple[str, ...] = ()) -> Column:
    words = ("", *SENTINELS, *extra)
    # the pattern runs only where the letters are those of a missing word
    letters = F.lower(F.translate(text, _SPACE, ""))
    collapsed = F.lower(stripped(F.regexp_replace(text, f"[{_SPACE}]+", " ")))
    return letters.isin(*sorted({"".join(w.split()) for w in words})) & collapsed.isin(*words)


def has_text(text: Column) -> Column:
    return text.isNotNull() & (trimmed(text) != "")
