"""Order-independent money sums.

A plain sum of doubles depends on the order in which partial results meet, so two runs can round to
different cents. Amounts that lie on the 1/10000 grid are summed as decimals; the few that do not (more
than four decimals, out of range, NaN) are summed beside them as doubles, so nothing is lost.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

GRID = "decimal(18,4)"


def money_sums(matches: Column, amount: Column, name: str) -> list[Column]:
    """Two mergeable aggregates for ``amount`` over matching rows.

    A row that does not match adds zero; a matching row without amount adds nothing, so the total is
    null only if no row added anything.
    """
    on_grid = amount.try_cast(GRID)
    exact = on_grid.cast("double") == amount
    return [
        F.sum(F.when(matches, F.when(exact, on_grid)).otherwise(F.lit(0).cast(GRID))).alias(f"{name}_grid"),
        F.sum(F.when(matches & F.coalesce(~exact, amount.isNotNull()), amount)).alias(f"{name}_rest"),
    ]


def money_merge(name: str) -> list[Column]:
    """Sums of partial sums (pane -> window)."""
    return [F.sum(f"{name}_{part}").alias(f"{name}_{part}") for part in ("grid", "rest")]


def money_total(name: str) -> Column:
    grid, rest = F.col(f"{name}_grid").cast("double"), F.col(f"{name}_rest")
    return F.when(rest.isNull(), grid).otherwise(F.coalesce(grid, F.lit(0.0)) + rest)
