"""Binary-search-like lookups in short sorted lists of literals, without a join."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F


def edges_below(value: Column, edges: list[float], reached: bool = False) -> Column:
    """How many of the sorted ``edges`` are less than ``value`` (with ``reached``: at most ``value``), as an integer; null stays null.

    Two steps over about the root of the list's length each: first the blocks, then the edges of one block.
    """
    if not edges:
        return F.when(value.isNotNull(), F.lit(0))
    width = math.isqrt(len(edges) - 1) + 1
    blocks = [edges[i : i + width] for i in range(0, len(edges), width)]

    def passed(e: Column) -> Column:
        return e <= value if reached else e < value

    block = F.size(F.filter(F.lit([b[-1] for b in blocks]), passed))
    listed = F.array(*[F.lit(b) for b in blocks])
    inside = F.when(block < len(blocks), F.size(F.filter(F.get(listed, block), passed))).otherwise(0)
    # The last block may be shorter, and lies behind nothing.
    before = F.least(block * F.lit(width), F.lit(len(edges)))
    return F.when(value.isNotNull(), before + inside)
