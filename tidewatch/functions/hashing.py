"""Draws by hash: the same on every cluster and in every engine that has MD5."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: draws are whole numbers below this
TOP = 1 << 60


def draw(seed: int, *key: str) -> Column:
    """A number from 0 to TOP - 1 for each key: the first 15 digits of the MD5 of seed and key columns as text, joined by |."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), *(F.coalesce(F.col(k).cast("string"), F.lit("")) for k in key))), 1, 15), 16, 10).cast("long")
