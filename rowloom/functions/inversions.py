"""Inversions of large permutations, counted in blocks of bounded size.

A pair of rows is inverted if it stands in one order by ``p`` and in the other
by ``r``, two numberings 0..n-1 of the same rows. The rows are cut into blocks
by ``p`` and into blocks by ``r``, all of equal size whatever the values are.
An inverted pair lies in one block of ``p``, or in one block of ``r``, or in
different ones of both: the first two are counted inside tasks, rank bit by
rank bit with running counts, and the last from the grid of block counts by
two running sums.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rowloom.session import materialize

#: Rows of a block: what one task sorts. The grid has the square of the number of blocks.
BLOCK_ROWS = 1 << 18


def inversions(values: np.ndarray) -> int:
    """Pairs of different values that stand in falling order.

    From the highest bit of the ranks down: among values that agree above a
    bit, each one without the bit is behind as many smaller-to-be ones as have
    it and stand earlier. Then the groups are parted by the bit, keeping order.
    """
    n = len(values)
    order = np.argsort(values, kind="stable")
    rank = np.empty(n, np.int64)
    rank[order] = np.arange(n)  # equal values rise with their place: no inversion
    total = 0
    for bit in range(max(n - 1, 0).bit_length() - 1, -1, -1):
        group = rank >> (bit + 1)
        ones = rank >> bit & 1
        start = np.searchsorted(group, group)  # groups stand one after the other
        before = np.cumsum(ones) - ones
        ahead = before - before[start]
        total += int(ahead[ones == 0].sum())
        first_one = (group * 2 + 1) << bit  # where the upper half of the group begins
        place = np.where(ones == 1, first_one + ahead, start + (np.arange(n) - start - ahead))
        moved = np.empty(n, np.int64)
        moved[place] = rank
        rank = moved
    return total


def _inside(table: pa.Table, block_rows: int) -> pa.Table:
    """Inversions of one block, by the place of its rows in it and their number on the other side; in blocks of ``r`` those of one block of ``p`` are left out, as they count there."""
    near, far = (table[c].to_numpy().astype(np.int64) for c in ("near", "far"))
    if table["by_p"][0].as_py():
        count = inversions(far[np.argsort(near)])
    else:
        order = np.argsort(far)
        r = near[order]
        count = inversions(r)
        # Raised by their block of p, rows of different such blocks never fall.
        _, block = np.unique(far[order] // block_rows, return_inverse=True)
        count -= inversions(block.astype(np.int64) * (int(r.max()) + 1) + r)
    return pa.table({"grp": table["grp"].slice(0, 1), "n": pa.array([count], pa.int64())})


def count_inversions(rows: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(grp, inverted) from rows (grp, p, r): per group, ``p`` and ``r`` number its rows from 0 without gaps."""
    rows = rows.select("grp", "p", "r", F.expr(f"p div {block_rows}").alias("bp"), F.expr(f"r div {block_rows}").alias("br"))

    def side(by_p: bool, own: str, other: str) -> DataFrame:
        place = F.pmod(own, F.lit(block_rows)).cast("int")
        return rows.select("grp", F.lit(by_p).alias("by_p"), F.col(f"b{own}").alias("block"), place.alias("near"), F.col(other).alias("far"))

    kind = rows.schema["grp"].dataType.simpleString()
    both = side(True, "p", "r").unionByName(side(False, "r", "p"))
    inside = both.groupBy("grp", "by_p", "block").applyInArrow(lambda t: _inside(t, block_rows), f"grp {kind}, n bigint")
    cells = materialize(rows.groupBy("grp", "bp", "br").agg(F.count("*").alias("c")))
    sizes = cells.groupBy("grp").agg((F.max("bp") + 1).alias("k"))
    grid = sizes.where("k > 1").select("grp", "k", F.explode(F.expr("sequence(0L, k - 1)")).alias("bp")).select("grp", "bp", F.explode(F.expr("sequence(0L, k - 1)")).alias("br"))
    grid = grid.join(cells, ["grp", "bp", "br"], "left").select("grp", "bp", "br", F.coalesce("c", F.lit(0)).alias("c"))
    higher = Window.partitionBy("grp", "bp").orderBy(F.desc("br")).rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy("grp", "br").orderBy("bp").rowsBetween(Window.unboundedPreceding, -1)
    grid = grid.withColumn("above", F.coalesce(F.sum("c").over(higher), F.lit(0)))
    grid = grid.withColumn("ahead", F.coalesce(F.sum("above").over(earlier), F.lit(0)))
    between = grid.select("grp", (F.col("c") * F.col("ahead")).alias("n"))
    exact = F.sum(F.col("n").cast("decimal(38,0)"))
    return inside.unionByName(between).groupBy("grp").agg(exact.alias("inverted"))
