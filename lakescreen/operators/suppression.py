"""Non-max suppression: what a greedy pass by falling strength keeps, in rounds that run everywhere at once.

Points lie in cells so small that two of one cell are always in conflict. A cell's strongest undecided point is kept if it is stronger than
those of all cells within reach, and then what lies near it is dropped. Whatever could drop a kept point would have to be stronger and in one
of those cells, so the result is that of the pass one by one. Each round decides the strongest point of each group at least, and compares
one row for each cell, so a cell that holds a third of all points is an aggregate and never pairs. What is sent to the cells around is 25
rows in place of one, which the sizes of written tables do not show, so joins are asked to sort and never to gather a side on the driver.
"""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import written

#: Cells to each side that hold what is nearer than the radius, a cell's side being half of it.
REACH = 2


def _around(rows: DataFrame, own: bool) -> DataFrame:
    """Rows sent to all cells within reach, with or without their own one."""
    steps = [(i, j) for i, j in itertools.product(range(-REACH, REACH + 1), repeat=2) if own or (i, j) != (0, 0)]
    step = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in steps]))
    return rows.withColumn("step", step).withColumn("cx", F.col("cx") + F.col("step.i")).withColumn("cy", F.col("cy") + F.col("step.j")).drop("step")


def suppress(points: DataFrame, radius: float, group: str = "group", key: str = "id", x: str = "x", y: str = "y", strength: str = "strength", limit: int | None = None) -> DataFrame:
    """The kept points of each group (group, id, x, y, strength, rank): by falling strength, then x, y and key, each that is not nearer than radius to one kept
    before; the first ``limit`` of each group, if given.

    Rows with a null or NaN in any of these columns take no part; equal rows are one point. A radius of 0 drops nothing.
    """
    p = F.struct(F.col(strength).cast("double").alias("strength"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"), F.col(key).alias("id"))
    left = points.select(F.col(group).alias("group"), p.alias("p")).where(F.col("group").isNotNull() & F.col("p.id").isNotNull())
    left = left.where(" AND ".join(f"p.{c} IS NOT NULL AND NOT isnan(p.{c})" for c in ("strength", "x", "y"))).distinct()
    side = radius / 2 if radius else 1.0
    left = written(left.select("group", F.floor(F.col("p.x") / side).alias("cx"), F.floor(F.col("p.y") / side).alias("cy"), "p"))
    done, cell = [], ["group", "cx", "cy"]
    if not radius:
        done, left = [left.select("group", "p")], left.where("false")
    while not left.isEmpty():
        best = left.groupBy(cell).agg(F.max("p").alias("p"))
        rival = _around(best, own=False).groupBy(cell).agg(F.max("p").alias("rival"))
        kept = written(best.join(rival.hint("merge"), cell, "left").where(F.col("rival").isNull() | (F.col("p") > F.col("rival"))).drop("rival"))
        done.append(kept.select("group", "p"))
        near = _around(kept, own=True).groupBy(cell).agg(F.collect_list("p").alias("near"))  # one a cell at most, so 25 at most
        hit = lambda k: (F.col("p.x") - k["x"]) ** 2 + (F.col("p.y") - k["y"]) ** 2 < radius * radius
        left = written(left.join(near.hint("merge"), cell, "left").where(F.col("near").isNull() | ~F.exists("near", hit)).select(*cell, "p"))
    out = left.select("group", "p")
    for part in done:
        out = out.unionByName(part)
    rank = F.row_number().over(Window.partitionBy("group").orderBy(F.desc("p")))
    ranked = out.withColumn("rank", rank)
    return (ranked if limit is None else ranked.where(F.col("rank") <= limit)).select("group", "p.id", "p.x", "p.y", "p.strength", "rank")
