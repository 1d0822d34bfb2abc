"""The weighted graph of a cost raster: cells are nodes, steps of a neighbourhood are edges.

An edge's weight is the sum of its cells' costs times its length over their number. It is
absent where one of these cells is forbidden or outside.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions.grid import FORBIDDEN
from gridloom.functions.neighborhood import Step, between, factor, most_edges, steps

__all__ = ["FORBIDDEN", "edges", "edges_by_cells", "grid_rows", "isolated", "most_edges", "nodes", "outgoing", "without_isolated"]


def grid_rows(cells: DataFrame, width: int) -> DataFrame:
    """(row, vals): a raster's rows as arrays by column; null where there is no cell."""
    rows = cells.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("col", "value"))).alias("s"))
    full = F.transform("s", lambda x: x["value"])
    # Columns without a cell need a look-up for each place; most rows have none.
    some = F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda c: F.map_from_entries("s")[c])
    return rows.select("row", F.when(F.size("s") == width, full).otherwise(some).alias("vals"))


def edges(cells: DataFrame, width: int, of: Sequence[Step] | int | str = 1, ignore_max: bool = True) -> DataFrame:
    """(u, v, w): each edge once; cells (row, col, value), nodes row * width + col.

    Rows are arrays, so that a step needs no join within its row: a row meets the rows up to
    the neighbourhood's height below it by one shuffle of arrays, and all else is
    arithmetic on their elements. ``ignore_max``: cells of 65535 are forbidden.
    """
    wanted = steps(of, directed=False) if isinstance(of, int | str) else list(of)
    # Steps that go up are those that come down from the other end.
    wanted = [(r, c) if r >= 0 else (-r, -c) for r, c in wanted]
    depth = max((r for r, _ in wanted), default=0)
    rows = grid_rows(cells, width)
    if depth:
        # A row offers itself to the rows above it, as row 0 to depth of their strips.
        offered = rows.select(
            F.explode(F.transform(
                F.sequence(F.lit(0), F.lit(depth)),
                lambda d: F.struct((F.col("row") - d).alias("row"), d.alias("d")),
            )).alias("o"),
            "vals",
        ).select("o.row", "o.d", "vals")
        strips = offered.groupBy("row").agg(*[F.max(F.when(F.col("d") == d, F.col("vals"))).alias(f"r{d}") for d in range(depth + 1)]).where("r0 is not null")
    else:
        strips = rows.withColumnRenamed("vals", "r0")
    ok = lambda x: x.isNotNull() & (x != FORBIDDEN) if ignore_max else x.isNotNull()

    def of_step(dr: int, dc: int) -> Column:
        over = [(0, 0), *between(dr, dc), (dr, dc)]
        first, last = max(0, -dc), width - 1 - max(0, dc)
        if first > last:
            return F.array().cast("array<struct<u:bigint,v:bigint,w:double>>")

        def edge(c: Column) -> Column:
            at = [F.try_element_at(F.col(f"r{r}"), c + (k + 1)) for r, k in over]
            valid, total = ok(at[0]), at[0].cast("double")
            for x in at[1:]:
                valid, total = valid & ok(x), total + x
            u = F.col("row").cast("long") * width + c
            return F.when(valid, F.struct(u.alias("u"), (u + (dr * width + dc)).alias("v"), (total * factor(dr, dc)).alias("w")))

        return F.filter(F.transform(F.sequence(F.lit(first), F.lit(last)), edge), lambda e: e.isNotNull())

    return strips.select(F.explode(F.concat(*[of_step(r, c) for r, c in wanted])).alias("e")).select("e.*")


def edges_by_cells(cells: DataFrame, width: int, of: Sequence[Step] | int | str = 1, ignore_max: bool = True) -> DataFrame:
    """The same edges by joins of cells; plain, and the check on ``edges``."""
    wanted = steps(of, directed=False) if isinstance(of, int | str) else list(of)
    free = cells.where(F.col("value") != FORBIDDEN) if ignore_max else cells
    offsets = F.array(*[F.struct(
        F.lit(i).alias("step"),
        F.lit(r).alias("dr"),
        F.lit(c).alias("dc"),
        F.lit(factor(*s)).alias("factor"),
        F.lit(len(between(*s)) + 2).alias("cells"),
        F.lit(s[0] * width + s[1]).alias("jump"),
    ) for i, s in enumerate(wanted) for r, c in [(0, 0), *between(*s), s]])
    want = free.select(
        (F.col("row").cast("long") * width + F.col("col")).alias("u"),
        F.explode(offsets).alias("o"),
        "row",
        "col",
    ).select("u", "o.*", (F.col("row") + F.col("o.dr")).alias("row"), (F.col("col") + F.col("o.dc")).alias("col"))
    # Merged by shuffles: a raster's file may be small and its cells still too many for the driver, which a broadcast passes.
    met = want.join(free.select("row", "col", "value").hint("merge"), ["row", "col"])
    sums = met.groupBy("u", "step", "factor", "cells", "jump").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("value").alias("total"),
    ).where("n = cells")
    return sums.select("u", (F.col("u") + F.col("jump")).alias("v"), (F.col("total") * F.col("factor")).alias("w"))


def outgoing(
    cells: DataFrame,
    width: int,
    row: int,
    col: int,
    of: Sequence[Step] | int | str = 1,
    ignore_max: bool = True,
    from_forbidden: bool = True,
) -> DataFrame:
    """(u, v, w): the edges that leave one cell; only the cells around it are read.

    The cell itself may be forbidden, unless ``from_forbidden`` is false: then the edges are those of ``edges``. A cell without a value has none.
    """
    wanted = steps(of) if isinstance(of, int | str) else list(of)
    reach = max(max(abs(r), abs(c)) for r, c in wanted)
    near = cells.where(F.col("row").between(row - reach, row + reach) & F.col("col").between(col - reach, col + reach))
    if ignore_max:
        own = (F.col("row") == row) & (F.col("col") == col) & F.col("value").isNotNull()
        free = near.where((F.col("value") != FORBIDDEN) | own & F.lit(from_forbidden))
    else:
        free = near
    table = [(
        i,
        row + r,
        col + c,
        factor(*s),
        len(between(*s)) + 2,
        (row + s[0]) * width + col + s[1],
    ) for i, s in enumerate(wanted) for r, c in [(0, 0), *between(*s), s]]
    want = cells.sparkSession.createDataFrame(table, "step int, row int, col int, factor double, cells int, v long")
    sums = free.join(F.broadcast(want), ["row", "col"]).groupBy("step", "factor", "cells", "v").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("value").alias("total"),
    )
    return sums.where("n = cells").select(
        F.lit(row * width + col).cast("long").alias("u"),
        "v",
        (F.col("total") * F.col("factor")).alias("w"),
    )


def nodes(graph: DataFrame) -> DataFrame:
    """(node): those that an edge touches."""
    return graph.select(F.explode(F.array("u", "v")).alias("node")).distinct()


def isolated(cells: DataFrame, graph: DataFrame, width: int) -> DataFrame:
    """(node): cells that no edge touches."""
    every = cells.select((F.col("row").cast("long") * width + F.col("col")).alias("node"))
    return every.join(nodes(graph), "node", "left_anti")


def without_isolated(cells: DataFrame, graph: DataFrame, width: int) -> DataFrame:
    keyed = cells.withColumn("node", F.col("row").cast("long") * width + F.col("col"))
    return keyed.join(nodes(graph), "node", "left_semi").drop("node")


def counts(graph: DataFrame) -> DataFrame:
    """n_edges, n_nodes (the largest id plus one) and n_touched, in one pass."""
    return graph.agg(F.count(F.lit(1)).alias("n_edges"), (F.max(F.greatest("u", "v")) + 1).alias("n_nodes"))
