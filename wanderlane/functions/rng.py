"""Random numbers as a hash of what they are for: reproducible, independent of partitioning, and the same in SQL.

draw(salt, parts...) is uniform over 0..2^32-1. SQL: ('0x' || substr(md5(concat_ws('|', salt, parts...)), 1, 8))::BIGINT.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RANGE = 1 << 32


def draw(salt: str, *parts: Column) -> Column:
    text = F.concat_ws("|", F.lit(salt), *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long")


def below(p: float) -> int:
    """draw() is less than this with probability p."""
    return int(p * RANGE)


def sql_draw(salt: str, *parts: str) -> str:
    return f"('0x' || substr(md5(concat_ws('|', '{salt}', {', '.join(parts)})), 1, 8))::BIGINT"
