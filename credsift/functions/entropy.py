"""Shannon entropy of short tokens."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def shannon_entropy(token: Column) -> Column:
    """Bits per character, from the character counts of the token."""
    chars = F.array_sort(F.split(token, ""))
    size = F.length(token).cast("double")
    runs = F.transform(
        F.array_distinct(chars),
        lambda ch: F.size(F.filter(chars, lambda other: other == ch)).cast("double") / size,
    )
    return F.aggregate(runs, F.lit(0.0), lambda acc, p: acc - p * F.log2(p))
