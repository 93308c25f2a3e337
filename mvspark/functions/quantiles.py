"""Exact quantiles of a few large groups by repeated counts: the rows of a group never meet in one task."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mvspark.functions.series import checkpointed

BINS = 4096
PASSES = 8


def quantiles(df: DataFrame, keys: list[str], value: str, at: list[float], bins: int = BINS) -> DataFrame:
    """(keys, q, value): the quantiles ``at`` (0 to 1) of each group, interpolated as percentile() does. Null, NaN and infinite values are left out; a group
    without others has no row. A null key is a group of its own.

    The range that holds a wanted place is cut into so many bins, in which rows are counted before the shuffle; the bin of the place, from its least to its greatest
    value, is the next range. It ends when a range has one value or at most ``bins`` rows; the different values of what is left are then put in order.
    ``df`` is read once a pass and should be a table. Ranges are a row for each group and wanted place; Spark broadcasts them if they are small."""
    v, low, high, here = F.col("__v"), F.col("__lo"), F.col("__hi"), F.col("__place")
    rows = df.select(*keys, F.col(value).cast("double").alias("__v")).filter(v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    groups = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"), F.min("__v").alias("__lo"), F.max("__v").alias("__hi"))
    ends = [F.struct(F.lit(float(q)).alias("q"), f(F.lit(float(q)) * (F.col("__n") - 1)).cast("long").alias("place")) for q in at for f in (F.floor, F.ceil)]
    wanted = groups.withColumn("__e", F.explode(F.array_distinct(F.array(*ends)))).withColumn("__share", F.col("__e.q") * (F.col("__n") - 1) - F.floor(F.col("__e.q") * (F.col("__n") - 1)))
    state = checkpointed(wanted.select(*keys, F.col("__e.q").alias("q"), F.col("__e.place").alias("__place"), "__share", "__lo", "__hi", F.lit(0).cast("long").alias("__before"), F.col("__n").alias("__left")))

    def same(a: DataFrame, b: DataFrame, names: list[str]) -> DataFrame:
        other = b.select(*[F.col(c).alias(f"__r_{i}") for i, c in enumerate(names)], *[c for c in b.columns if c not in names])
        on = [a[c].eqNullSafe(other[f"__r_{i}"]) for i, c in enumerate(names)]
        return a.join(other, on).drop(*[f"__r_{i}" for i in range(len(names))])

    def counted(by) -> DataFrame:
        """Each wanted place with the part of its range (rows of the same ``by``) that holds it."""
        ranges = [*keys, "__lo", "__hi"]
        inside = same(rows, state.select(*ranges).distinct(), keys).filter(v.between(low, high))
        parts = inside.groupBy(*ranges, by.alias("__part")).agg(F.count(F.lit(1)).alias("__in"), F.min("__v").alias("__l"), F.max("__v").alias("__h"))
        parts = parts.withColumn("__start", F.sum("__in").over(Window.partitionBy(*ranges).orderBy("__part")) - F.col("__in"))
        start = F.col("__before") + F.col("__start")
        found = same(state, parts, ranges).filter((here >= start) & (here < start + F.col("__in")))
        return found.select(*keys, "q", "__place", "__share", F.col("__l").alias("__lo"), F.col("__h").alias("__hi"), start.alias("__before"), F.col("__in").alias("__left"))

    for _ in range(PASSES):
        if state.filter((low < high) & (F.col("__left") > bins)).isEmpty():
            break
        width = high / 2 - low / 2  # halves don't overflow
        state = checkpointed(counted(F.when(width > 0, F.least(F.floor((v / 2 - low / 2) / width * bins), F.lit(bins - 1))).otherwise(0)))
    share, first, last = F.first("__share"), F.min("__lo"), F.max("__lo")
    return counted(v).groupBy(*keys, "q").agg((first * (1 - share) + last * share).alias("value"))
