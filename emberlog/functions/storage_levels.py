"""Storage levels and block ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def is_stored(level: Column) -> Column:
    """False for the level NONE: no place at all and one replica."""

    def flag(name: str) -> Column:
        return F.coalesce(level[name], F.lit(False))

    return (
        flag("Use Disk")
        | flag("Use Memory")
        | flag("Use Off Heap")
        | flag("Deserialized")
        | (F.coalesce(level["Replication"], F.lit(1)) != 1)
    )


def rdd_of_block(block_id: Column) -> Column:
    """RDD id of a block ``rdd_<rdd>_<partition>``, NULL for any other block."""
    digits = F.regexp_extract(block_id, r"^rdd_(\d+)_\d+$", 1)
    return F.when(digits != "", digits.cast("int"))
