"""String, date and token expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalar import col

# Texts that stand for a missing value.
NULL_TOKENS = ["", "nan", "none", "null", "nat"]


def zero_pad(x, width: int = 6) -> Column:
    """Left-pad with zeros; longer codes stay whole."""
    x = col(x).cast("string")
    return F.when(F.length(x) >= width, x).otherwise(F.lpad(x, width, "0"))


def clean_text(x) -> Column:
    """Trimmed text, NULL when it stands for nothing."""
    t = F.trim(col(x).cast("string"))
    return F.when(~F.lower(t).isin(NULL_TOKENS), t)


def known_industry(x) -> Column:
    t = clean_text(x)
    return F.when(F.lower(t) != "unknown", t)


def exchange_prefix(x) -> Column:
    """sh / sz / bj prefix by leading digit, kept where present."""
    t = F.lower(F.trim(col(x).cast("string")))
    code = zero_pad(t)
    first = F.substring(code, 1, 1)
    made = (
        F.when(first.isin("6", "9"), F.concat(F.lit("sh"), code))
        .when(first.isin("4", "8"), F.concat(F.lit("bj"), code))
        .otherwise(F.concat(F.lit("sz"), code))
    )
    return F.when(F.substring(t, 1, 2).isin("sh", "sz", "bj"), t).otherwise(made)


def exchange_suffix(x) -> Column:
    """Code with .SH for a leading 6, else .SZ."""
    code = zero_pad(x)
    return F.concat(code, F.when(F.substring(code, 1, 1) == "6", F.lit(".SH")).otherwise(F.lit(".SZ")))


def compact_date(x) -> Column:
    """yyyymmdd or ISO text to a date; anything else NULL."""
    t = F.trim(col(x).cast("string"))
    return F.coalesce(F.try_to_timestamp(t, F.lit("yyyyMMdd")), F.try_to_timestamp(t)).cast("date")


def stale_days(last, today) -> Column:
    return F.greatest(F.lit(0), F.datediff(col(today), col(last)))


def tokens(x) -> Column:
    """Distinct lower-case words of at least two characters."""
    words = F.split(F.lower(col(x)), r"[^\p{L}\p{N}_]+")
    return F.array_distinct(F.filter(words, lambda w: F.length(w) > 1))
