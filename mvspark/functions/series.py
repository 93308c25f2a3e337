"""Column helpers for ordered series."""

import tempfile

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def row_index(df: DataFrame, keys: list[str], order: list[str], name: str) -> DataFrame:
    """``df`` with the position of each row (from 0) in its group."""
    return df.withColumn(name, (F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1).cast("int"))


def ranked_in_blocks(df: DataFrame, keys: list[str], order: str, width: float, name: str, ties: list[str] | None = None) -> DataFrame:
    """``row_index`` (as a long) by a number column without a sort of a whole group: rows are counted in ranges of so wide, and numbered in each after those of the ranges before.
    Only a range's rows are one task's; rows of the same order are numbered by ``ties``."""
    rows = df.withColumn("__block", F.floor(F.col(order) / width))
    before = Window.partitionBy(*keys).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy(*keys, "__block").agg(F.count(F.lit(1)).alias("__n"))
    offsets = counts.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    inside = F.row_number().over(Window.partitionBy(*keys, "__block").orderBy(order, *(ties or [])))
    return joined(rows, offsets, [*keys, "__block"]).withColumn(name, (F.col("__before") + inside - 1).cast("long")).drop("__block", "__before")


def joined(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """An inner join in which null keys are like any other, as in a group or a window."""
    other = right.select(*[F.col(k).alias(f"__right_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__right_{k}"))
    return left.join(other, same).drop(*[f"__right_{k}" for k in keys])


def dealt(df: DataFrame, *cols: str) -> DataFrame:
    """Rows by keys over the session's number of shuffle partitions: few bytes that are much work stay many tasks."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *cols)


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage through the shared folder of spark.checkpoint.dir. A session on one machine that names none gets a folder of its own; on a cluster that is an error."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not sc.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            folder = tempfile.mkdtemp(prefix="spark-")
        sc.setCheckpointDir(folder)
    return df.checkpoint()


def percentile(col: str, q: float) -> Column:
    """Exact percentile with linear interpolation; 0 where there are no values."""
    return F.coalesce(F.percentile(col, F.lit(q)), F.lit(0.0))


def is_spaced(i: Column, n: Column, most: int) -> Column:
    """Whether row i (from 0) of n is one of at most ``most`` evenly spaced ones from the first to the last; places are rounded half to even."""
    step = (n - 1) / F.lit(float(max(most - 1, 1)))
    # It is one of the places rint(k * step): try the k on either side of it.
    near = F.floor(i / step)
    at = lambda k: (k >= 0) & (k <= most - 1) & (F.rint(k * step) == i)
    return (n <= most) | at(near) | at(near + 1)


def spaced(df: DataFrame, keys: list[str], order: list[str], most: int) -> DataFrame:
    """At most ``most`` rows of each group, evenly spaced from the first to the last (see is_spaced())."""
    w = Window.partitionBy(*keys)
    ranked = df.withColumns({"__i": F.row_number().over(w.orderBy(*order)) - 1, "__n": F.count(F.lit(1)).over(w)})
    return ranked.filter(is_spaced(F.col("__i"), F.col("__n"), most)).drop("__i", "__n")
