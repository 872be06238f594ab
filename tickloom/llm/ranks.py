"""Positions of rows inside their groups without a task that sees a whole group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.llm.common import parts, stored

TASK_BITS = 33  # fixed value: monotonically_increasing_id puts the partition number above these bits


def ranked(rows: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """Add position (from 0 in its group, by `order`), group_size and group_no (from 0 by group, null first).

    Rows are range-sorted once and written, so a group of any size is spread over tasks as long as `order`
    tells its rows apart. What one task holds of a group is a run; runs are counted, and the counts of
    earlier runs are the offset of a run. There are at most as many runs as tasks and groups together.
    """
    keys = [*group, *order]
    spread = rows.repartitionByRange(max(1, parts(rows.sparkSession)), *keys).sortWithinPartitions(*keys)
    marked = stored(spread.withColumn("_at", F.monotonically_increasing_id()), "ranked")
    task = F.shiftright("_at", TASK_BITS)
    runs = marked.groupBy(task.alias("_task"), *group).agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    along = Window.partitionBy(*group).orderBy("_task")
    runs = runs.withColumns({
        "_before": F.coalesce(F.sum("_n").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
        "group_size": F.sum("_n").over(Window.partitionBy(*group)), "_opens": (F.row_number().over(along) == 1).cast("long"),
    })
    opened = runs.groupBy("_task").agg(F.sum("_opens").alias("_k"))
    opened = opened.select(F.col("_task").alias("_t"), F.coalesce(F.sum("_k").over(Window.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_groups"))
    inside = F.sum("_opens").over(Window.partitionBy("_task").orderBy("_first")) - 1
    runs = runs.join(opened, F.col("_task") == F.col("_t")).withColumn("_no", F.when(F.col("_opens") == 1, F.col("_groups") + inside))
    runs = runs.withColumn("group_no", F.max("_no").over(Window.partitionBy(*group)))
    runs = runs.select("_task", "_first", "_before", "group_size", "group_no", *[F.col(g).alias(f"_of_{g}") for g in group])
    same = F.shiftright("_at", TASK_BITS) == F.col("_task")
    for g in group:
        same = same & F.col(g).eqNullSafe(F.col(f"_of_{g}"))
    position = F.col("_before") + F.col("_at") - F.col("_first")
    return marked.join(runs, same).select(*rows.columns, position.alias("position"), "group_size", "group_no")
