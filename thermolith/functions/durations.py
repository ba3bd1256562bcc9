"""Durations like ``5s914ms67us586ns`` as milliseconds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalized_micro(text: Column) -> Column:
    """Both micro signs as one, without the letter that a wrong decoding leaves before them."""
    return F.regexp_replace(F.regexp_replace(text, "Â", ""), "[µμ]s", "us")


#: Parts in their order; what follows the first that is missing or out of order doesn't count.
_PARTS = r"^(\d+)s(?:(\d+)ms)?(?:(\d+)us)?(?:(\d+)ns)?"


def duration_ms(text: Column) -> Column:
    """Milliseconds of a duration whose seconds part is required; null otherwise."""
    plain = normalized_micro(text)

    def part(i: int) -> Column:
        return F.coalesce(F.nullif(F.regexp_extract(plain, _PARTS, i), F.lit("")).try_cast("double"), F.lit(0.0))

    total = part(1) * 1000 + part(2) + part(3) / 1000 + part(4) / 1000000
    return F.when(plain.rlike(_PARTS), total)


def seconds(ms: Column) -> Column:
    """Milliseconds, possibly as text, as seconds; null where they are no number."""
    return ms.try_cast("double") / 1000
