"""Small column expressions used across operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def first_filled(*cols: Column | str) -> Column:
    """First value that is neither null nor the empty string."""
    return F.coalesce(*[F.nullif(_col(c), F.lit("")) for c in cols])


def filled_or(col: Column | str, default: str) -> Column:
    return F.coalesce(F.nullif(_col(col), F.lit("")), F.lit(default))


def captured(text: Column | str, pattern: str, group: int) -> Column:
    """Regex group, or null where the pattern does not match or the group is empty."""
    return F.nullif(F.regexp_extract(_col(text), pattern, group), F.lit(""))


def share(part: Column, whole: Column) -> Column:
    """part / whole in doubles, 0.0 for an empty whole."""
    return F.when(whole > 0, part.cast("double") / whole.cast("double")).otherwise(F.lit(0.0))


def nonzero(col: Column, tiny: float = 1e-9) -> Column:
    """Replace an exact zero by a tiny divisor."""
    return F.when(col == 0, F.lit(tiny)).otherwise(col)


def one_of(col: Column | str, allowed: Sequence[str]) -> Column:
    return F.coalesce(_col(col).isin(*allowed), F.lit(False))


def stable_id(*cols: Column | str) -> Column:
    """Repeatable row id: a retry of a lost task gives the same value again.

    Values are escaped and null has a mark of its own, so different rows give different texts.
    """

    def text(c: Column | str) -> Column:
        plain = F.replace(F.replace(_col(c).cast("string"), F.lit("\\"), F.lit("\\\\")), F.lit("|"), F.lit("\\|"))
        return F.coalesce(plain, F.lit("\\N"))

    return F.sha2(F.concat_ws("|", *[text(c) for c in cols]), 256).substr(1, 32)


def epoch(col: Column | str) -> Column:
    return F.unix_micros(_col(col).cast("timestamp")) / F.lit(1e6)


def seconds_between(start: Column | str, end: Column | str) -> Column:
    micros = F.unix_micros(_col(end).cast("timestamp")) - F.unix_micros(_col(start).cast("timestamp"))
    return micros / F.lit(1e6)


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c
