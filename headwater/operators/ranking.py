"""Exact ranks and row numbers that never put one whole group, or the table, in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from headwater.functions.numbers import is_finite
from headwater.operators.keys import join_parents
from headwater.session import checkpoint

# Histogram cells per doubling of the absolute value: about one percent wide. A cell holds less than 2^47
# different doubles, so three splits into 2^16 leave one value in each part.
CELLS_PER_OCTAVE = 64
SPLITS = 65_536
PASSES = 3
HELD_CELLS = 200_000  # chosen cells that go to every task; more of them meet the values by a join


def _cell(value: Column) -> Column:
    """Order-preserving histogram cell of a finite double, the same in every evaluation."""
    height = F.coalesce(F.floor(F.log2(F.abs(value)) * CELLS_PER_OCTAVE), F.lit(0)) + F.lit(70000)
    return (F.signum(value).cast("long") * height).cast("long")


def robust_range(
    df: DataFrame, groups: list[str], value: str, low: float = 0.05, high: float = 0.95
) -> DataFrame:
    """AGG-20: per group the values at sorted positions ``floor(n * p)``, the last one past the end.

    Exact selection by counting. The first pass counts values per cell of a logarithmic histogram and
    finds the cell that holds each wanted position. Each later pass splits the cell found into equal
    parts, counts again and keeps the part that holds the position, until least and greatest value of
    it are the same. The chosen cells, two per group, are written once per pass and reach the values
    where they are read, so only counts are shuffled; a window sees the counts of one group, ``SPLITS`` at
    most, however close together its values lie. The values are read once per pass: an input that is dear to
    compute is better written first.
    """
    finite = df.where(is_finite(F.col(value))).select(
        *groups, F.col(value).cast("double").alias("_v"), _cell(F.col(value).cast("double")).alias("_cell")
    )
    counts = [F.count(F.lit(1)).alias("_rows"), F.min("_v").alias("_low"), F.max("_v").alias("_high")]
    whole = Window.partitionBy(*(groups or [F.lit(0)]))
    upto = whole.orderBy("_cell").rowsBetween(Window.unboundedPreceding, Window.currentRow)

    def wanted(p: float) -> Column:
        return F.least(F.floor(F.col("_n") * F.lit(float(p))), F.col("_n") - 1)

    ends = F.array(
        F.struct(F.lit("low").alias("end"), wanted(low).alias("at")), F.struct(F.lit("high").alias("end"), wanted(high).alias("at"))
    )
    found = checkpoint(
        finite.groupBy(*groups, "_cell").agg(*counts)
        .withColumn("_upto", F.sum("_rows").over(upto)).withColumn("_n", F.sum("_rows").over(whole))
        .withColumn("_want", F.explode(ends)).withColumn("_end", F.col("_want.end"))
        .withColumn("_rest", F.col("_want.at") - F.col("_upto") + F.col("_rows"))
        .where((F.col("_rest") >= 0) & (F.col("_rest") < F.col("_rows")))
        .select(*groups, "_cell", "_n", "_end", "_rest", "_low", "_high")
    )
    settled = found.where(F.col("_low") == F.col("_high"))
    within = Window.partitionBy(*groups, "_end").orderBy("_split").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    for _ in range(PASSES):
        split = F.floor((F.col("_v") - F.col("_from")) / (F.col("_to") - F.col("_from")) * SPLITS)
        unsettled = found.where(F.col("_low") < F.col("_high")).withColumnsRenamed({"_low": "_from", "_high": "_to"})
        cells = unsettled.count()
        if cells == 0:
            break
        on = [*groups, "_cell"]
        met = finite.join(F.broadcast(unsettled), on) if cells <= HELD_CELLS else join_parents(finite, unsettled, on, ["_v"], "inner")
        found = checkpoint(
            met.where(F.col("_v").between(F.col("_from"), F.col("_to")))
            .groupBy(*groups, "_cell", "_n", "_end", "_rest", split.alias("_split")).agg(*counts)
            .withColumn("_rest", F.col("_rest") - F.sum("_rows").over(within) + F.col("_rows"))
            .where((F.col("_rest") >= 0) & (F.col("_rest") < F.col("_rows")))
            .select(*groups, "_cell", "_n", "_end", "_rest", "_low", "_high")
        )
        settled = settled.unionByName(found.where(F.col("_low") == F.col("_high")))
    return settled.groupBy(*groups).agg(
        F.max("_n").alias("n"),
        F.max(F.when(F.col("_end") == "low", F.col("_low"))).alias("range_min"),
        F.max(F.when(F.col("_end") == "high", F.col("_low"))).alias("range_max"),
    )


def number_rows(df: DataFrame, key: str, name: str = "ordinal") -> DataFrame:
    """WIN-01: 1-based position of every row in the order of a unique key, without one big task.

    The keys are sorted over all partitions and checkpointed once, which fixes the partition
    each row lies in; a row's number is its place in the partition plus the rows before it.
    """
    place = F.monotonically_increasing_id()
    ordered = checkpoint(df.select(key).orderBy(key).withColumn("_place", place))
    part, inside = F.shiftright("_place", 33), F.col("_place").bitwiseAND(F.lit((1 << 33) - 1))
    ordered = ordered.select(key, part.alias("_part"), inside.alias("_inside"))
    # One row per partition of the sort: bounded by the number of tasks, not by the data.
    sizes = ordered.groupBy("_part").agg(F.count(F.lit(1)).alias("_rows"))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_part", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_start"))
    return ordered.join(F.broadcast(starts), "_part").select(
        key, (F.col("_start") + F.col("_inside") + 1).alias(name)
    )


def assign_round_robin(parents: DataFrame, key: str, children: DataFrame, series: str) -> DataFrame:
    """WIN-01: child number i goes to parent number ``1 + (i - 1) % n``."""
    numbered = number_rows(parents, key)
    size = numbered.agg(F.count(F.lit(1))).scalar()
    slot = F.pmod(F.col(series) - 1, size) + 1
    return children.withColumn("ordinal", slot).join(numbered, "ordinal").drop("ordinal")


def bounded_first(df: DataFrame, groups: list[str], order: list[Column], limit: int) -> DataFrame:
    """First ``limit`` rows per group; Spark cuts each group on the map side before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(*groups).orderBy(*order))
    return df.withColumn("place", rank).where(F.col("place") <= limit)
