"""String helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from edspark import schemas as S
from edspark.schemas import CODE_PATTERN

# The ASCII whitespace Python's str.strip() removes.
WHITESPACE = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f"
UNKNOWN = "Unknown"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def clean_num(text, scale: float = 1.0) -> Column:
    """Whitespace-trimmed all-digit text -> double / scale; blank,
    signed or non-digit text -> null.  Guarded by ``rlike`` so ANSI casts
    never raise; the cast itself drops the white space around the digits."""
    t, space = _c(text), f"[{WHITESPACE}]*"
    value = F.when(t.rlike(f"^{space}[0-9]+{space}$"), t.cast("double"))
    return value / F.lit(scale) if scale != 1.0 else value


def extract_codes(text) -> Column:
    """All ``[A-Z]\\d{2,4}`` matches, in order."""
    return F.regexp_extract_all(_c(text), F.lit(CODE_PATTERN), 0)


def join_codes(codes) -> Column:
    """Codes joined by a space; empty -> "Unknown"."""
    return F.coalesce(F.nullif(F.array_join(_c(codes), " "), F.lit("")), F.lit(UNKNOWN))


def dotted_code(code) -> Column:
    """``c[:3] + '.' + c[3:]`` for codes longer than three characters."""
    c = _c(code)
    return F.when(F.length(c) > 3, F.concat(F.substring(c, 1, 3), F.lit("."), F.substring(c, 4, 1 << 30)))


def split_words(text) -> Column:
    """Whitespace split that drops empty pieces (Python ``str.split()``)."""
    return F.filter(F.split(F.trim(_c(text)), r"\s+"), lambda w: w != "")


def clean_complaint(text) -> Column:
    """Null, blank or shorter than three characters after trimming ->
    "General complaint"; otherwise the whole text."""
    t = _c(text)
    short = t.isNull() | (F.length(F.regexp_replace(t, r"^\s+|\s+$", "")) < 3)
    return F.when(short, F.lit(S.GENERAL_COMPLAINT)).otherwise(t)


def cut_complaint(text, limit: int = 5000) -> Column:
    """The first ``limit`` characters, for callers with a length limit."""
    return F.substring(_c(text), 1, limit)


def level_label(level) -> Column:
    """Chart label of a level, ``Level n`` for one that has none."""
    n = _c(level)
    names = F.create_map(*[x for k, v in S.LEVEL_LABELS.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(names[n], F.concat(F.lit("Level "), n.cast("string")))


def full_name(first, last) -> Column:
    """``first last``."""
    return F.concat_ws(" ", _c(first), _c(last))
