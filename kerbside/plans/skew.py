"""Joins of rows to one row a group, where a few groups may hold most rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows from which a group is broadcast rather than shuffled to; more where the table is larger, so that at most
#: HEAVY_GROUPS groups are.
HEAVY, HEAVY_GROUPS = 1000, 100_000


def join_groups(rows: DataFrame, groups: DataFrame, key: str | list[str], count: str, total: int) -> DataFrame:
    """rows joined to groups by key, each group's rows known by the column count; total: rows altogether.

    Groups above the limit are at most HEAVY_GROUPS, since each holds total / HEAVY_GROUPS rows or more: these are
    broadcast, and their rows stay where they are. The rest meet in a shuffle in which no key has more rows than the
    limit. Rows of keys that groups lacks, or null, are left out. Both sides are read twice: pass written tables.
    """
    limit = max(HEAVY, total // HEAVY_GROUPS)
    heavy = groups.where(F.col(count) > limit).drop(count)
    large = rows.join(F.broadcast(heavy), key)
    small = rows.join(F.broadcast(heavy.select(key)), key, "left_anti").join(groups.where(F.col(count) <= limit).drop(count), key)
    return large.unionByName(small)
