"""Equi-joins in which one key may hold a third of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.storage import staged

#: Rows of one key beyond which it counts as hot, and the most hot keys that are broadcast.
BOUND, MOST = 2048, 100_000


def meet(rows: DataFrame, facts: DataFrame, on: str, weight: str, bound: int = BOUND, most: int = MOST) -> DataFrame:
    """Inner join of ``rows`` with ``facts`` (one row per key, with the number of ``rows`` that have it in ``weight``).

    Keys with more than ``bound`` rows are counted; if there are at most ``most``, they meet their rows by
    broadcast and their rows are not shuffled, so no task gets more than ``bound`` rows of a key. There can be
    no more hot keys than rows / bound; beyond ``most`` the join is a plain one, whose hot keys adaptive
    execution splits. ``rows`` is read twice, so it should be a stored table. A null key matches nothing.
    """
    facts = staged(facts, "facts", few=True)
    hot = facts.where(F.col(weight) > bound)
    n = hot.limit(most + 1).count()
    if n == 0 or n > most:
        return rows.join(facts, on)
    rest = rows.join(F.broadcast(hot.select(on)), on, "left_anti").join(facts.where(F.col(weight) <= bound), on)
    return rows.join(F.broadcast(hot), on).unionByName(rest)
