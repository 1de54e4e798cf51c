"""Column -> Column scalar functions (F1-F22). All are native Catalyst
expressions, so they stay inside whole-stage codegen."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Regular expressions used by the cleaning functions. `\w` is
# written out as letters/numbers/underscore so Java and RE2 agree (SEM-9).
NON_WORD = r"[^\p{L}\p{N}_\s]"
URL_RE = r"http\S+|www\S+|https\S+"
EMAIL_TOKEN_RE = r"\S+@\S+"
PHONE_TEXT_RE = r"\+?\d{1,3}[-.\s]?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}"
HTML_TAG_RE = r"<.*?>"
EMAIL_VALID_RE = r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


# F1 / F2 -------------------------------------------------------------------
def date_parts(ts) -> dict[str, Column]:
    t = _c(ts)
    return {"year": F.year(t), "month": F.month(t), "day": F.dayofmonth(t),
            "weekday": F.weekday(t), "hour": F.hour(t), "quarter": F.quarter(t)}


def cyclical(ts) -> dict[str, Column]:
    t = _c(ts)
    two_pi = 2 * math.pi
    return {"month_sin": F.sin(two_pi * F.month(t) / 12), "month_cos": F.cos(two_pi * F.month(t) / 12),
            "day_sin": F.sin(two_pi * F.dayofmonth(t) / 31), "day_cos": F.cos(two_pi * F.dayofmonth(t) / 31)}


# F3 / F4 / F22 ------------------------------------------------------------------
def day_diff(end, start) -> Column:
    return F.datediff(_c(end).cast("date"), _c(start).cast("date"))


def seconds_between(end, start) -> Column:
    return (F.unix_micros(_c(end).cast("timestamp")) - F.unix_micros(_c(start).cast("timestamp"))) / 1e6


def add_seconds(ts, seconds: int) -> Column:
    return _c(ts) + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(seconds))


# F5 ------------------------------------------------------------------------
def words(text) -> Column:
    return F.filter(F.split(F.trim(_c(text)), r"\s+"), lambda w: w != "")


def word_count(text) -> Column:
    return F.size(words(text))


def text_lengths(text) -> dict[str, Column]:
    t = _c(text)
    return {"length": F.length(t), "word_count": word_count(t),
            "char_count": F.length(F.replace(t, F.lit(" "), F.lit("")))}


# F6 / F7 -------------------------------------------------------------------------
def squeeze(x) -> Column:
    return F.trim(F.regexp_replace(_c(x), r"\s+", " "))


def clean_text(text, remove_special: bool = True, remove_numbers: bool = False,
               lowercase: bool = True) -> Column:
    t = F.coalesce(_c(text), F.lit(""))
    if lowercase:
        t = F.lower(t)
    if remove_special:
        t = F.regexp_replace(t, NON_WORD, "")
    if remove_numbers:
        t = F.regexp_replace(t, r"\d+", "")
    return squeeze(t)


def basic_cleaning(text, lowercase: bool = True, remove_punctuation: bool = True,
                   remove_numbers: bool = True) -> Column:
    t = _c(text)
    if lowercase:
        t = F.lower(t)
    t = F.regexp_replace(t, URL_RE, "")
    t = F.regexp_replace(t, EMAIL_TOKEN_RE, "")
    t = F.regexp_replace(t, PHONE_TEXT_RE, "")
    t = F.regexp_replace(t, HTML_TAG_RE, "")
    if remove_punctuation:
        t = F.regexp_replace(t, NON_WORD, " ")
    if remove_numbers:
        t = F.regexp_replace(t, r"\d+", "")
    return squeeze(t)


# F8 / F9 / F10 / F11 / F12 / F13 ---------------------------------------------------
def is_valid_email(x) -> Column:
    return _c(x).rlike(EMAIL_VALID_RE)


def truncate(text, max_length: int = 100) -> Column:
    t = _c(text)
    return F.when(F.length(t) > max_length, F.concat(F.substring(t, 1, max_length), F.lit("..."))).otherwise(t)


def format_number(x, precision: int = 2) -> Column:
    """1.23K / 4.56M / 7.89B; rounding half-up on the decimal value."""
    v = _c(x).cast("decimal(38,10)")

    def fmt(div: int, suffix: str) -> Column:
        r = F.round(v / F.lit(div).cast("decimal(38,0)"), precision).cast(f"decimal(38,{precision})")
        return F.concat(r.cast("string"), F.lit(suffix))
    return (F.when(v >= 1_000_000_000, fmt(1_000_000_000, "B"))
            .when(v >= 1_000_000, fmt(1_000_000, "M"))
            .when(v >= 1_000, fmt(1_000, "K"))
            .otherwise(fmt(1, "")))


def safe_divide(num, den, default: float = 0.0) -> Column:
    n, d = _c(num).cast("double"), _c(den).cast("double")
    return F.when(d == 0, F.lit(default)).otherwise(n / d)


def clip(x, lo, hi) -> Column:
    """SEM-10: nulls stay null (least/greatest would skip them)."""
    v = _c(x)
    return F.when(v.isNull(), F.lit(None)).otherwise(F.least(F.greatest(v, F.lit(lo)), F.lit(hi)))


def fill_constant(x, value="Unknown") -> Column:
    return F.coalesce(_c(x), F.lit(value))


# F16 / F17 / F19 / F20 ------------------------------------------------------------------
def fingerprint(*cols) -> Column:
    return F.md5(F.concat_ws("\u001f", *[_c(c).cast("string") for c in cols]))


def syllables(word) -> Column:
    """Vowel groups, minus one for a final 'e', at least 1."""
    w = F.lower(_c(word))
    groups = F.regexp_count(w, F.lit("[aeiouy]+"))
    return F.greatest(F.lit(1), groups - F.when(w.endswith("e"), 1).otherwise(0))
