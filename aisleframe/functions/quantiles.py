"""Exact interpolated quantiles of groups of any size.

The built-in exact percentile gathers all distinct values of a group in one
task. Here rows are only counted: first per value band, then, in the bands that
hold the wanted positions, per finer band, as often as it takes until no such
band has more rows than a task may sort. Each pass has at most ``CELLS`` + 1
counts a group and wanted position, whatever the number of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aisleframe.session import settle

BANDS_PER_OCTAVE = 1024
#: Parts into which one pass cuts the range of a band.
CELLS = 4096
#: Rows of a band that one task may sort.
SORTED_ROWS = 100_000
# Target rows (two per group and probability) that may be broadcast.
MAX_BROADCAST_TARGETS = 20_000


def value_band(v: Column) -> Column:
    """Monotone band number of a value: about 17,000 bands cover 0 to 100,000."""
    return F.floor(F.signum(v) * F.log2(F.lit(1.0) + F.abs(v)) * F.lit(float(BANDS_PER_OCTAVE)))


def _counted(rows: DataFrame, group: list[str], band: Column) -> DataFrame:
    """Rows, least and greatest value of every band; ``_upto`` counts the rows up to its end."""
    bands = rows.groupBy(*group, band.alias("_cell")).agg(
        F.count("*").alias("_in_band"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi")
    )
    ordered = (Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))).orderBy("_cell")
    return bands.withColumn("_upto", F.sum("_in_band").over(ordered.rowsBetween(Window.unboundedPreceding, 0)))


def _targets(keyed: DataFrame, group: list[str], probs: dict[str, float]) -> DataFrame:
    """The bands of the neighbours of position (n - 1) * p, per group and probability, with offsets inside them."""
    bands = _counted(keyed, group, F.col("_band"))
    whole = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    bands = bands.withColumn("_total", F.max("_upto").over(whole))
    wanted = F.array(
        *[
            F.struct(F.lit(name).alias("name"), F.lit(float(p)).alias("p"), F.lit(side).alias("side"))
            for name, p in probs.items()
            for side in (0, 1)
        ]
    )
    h = (F.col("_total") - 1) * F.col("_w.p")
    before = F.col("_upto") - F.col("_in_band")
    return (
        bands.select("*", F.explode(wanted).alias("_w"))
        .withColumn("_pos", F.least(F.floor(h) + F.col("_w.side"), F.col("_total") - 1))
        .filter((F.col("_pos") >= before) & (F.col("_pos") < F.col("_upto")))
        .select(
            *group,
            F.col("_cell").alias("_band"),
            F.col("_w.name").alias("_name"),
            F.col("_w.side").alias("_side"),
            (h - F.floor(h)).alias("_frac"),
            (F.col("_pos") - before).alias("_offset"),
            "_in_band",
            "_lo",
            "_hi",
        )
    )


def _inside(keyed: DataFrame, targets: DataFrame, group: list[str]) -> DataFrame:
    """The rows that lie in a target's range, once per target; the join is by group and first band."""
    keys = [*group, "_band"]
    return keyed.join(targets, keys).filter((F.col("_v") >= F.col("_lo")) & (F.col("_v") <= F.col("_hi")))


def _narrowed(keyed: DataFrame, targets: DataFrame, group: list[str]) -> DataFrame:
    """Each target with the cell of its range that holds its position as its new range.

    Cells are parts of equal width. Their numbers never fall as values rise, so
    a cell's least and greatest value mark off exactly its rows.
    """
    width = F.col("_hi") - F.col("_lo")
    cell = F.when(width > 0, F.floor((F.col("_v") - F.col("_lo")) / width * F.lit(float(CELLS)))).otherwise(F.lit(0))
    of_target = [*group, "_band", "_name", "_side", "_frac", "_offset"]
    rows = _inside(keyed, targets, group).withColumn("_at", cell)
    before = F.col("_upto") - F.col("_in_band")
    return (
        _counted(rows.select(*of_target, "_at", "_v"), of_target, F.col("_at"))
        .filter((F.col("_offset") >= before) & (F.col("_offset") < F.col("_upto")))
        .withColumn("_offset", F.col("_offset") - before)
        .select(*of_target, "_in_band", "_lo", "_hi")
    )


def exact_quantiles(df: DataFrame, group: list[str], value: str, probs: dict[str, float]) -> DataFrame:
    """One row per group with a column per entry of ``probs`` (name to probability).

    When the targets are few, which is checked, they are broadcast and a pass
    shuffles only what it counts; otherwise they are joined by key.
    """
    v = F.col(value).cast("double")
    keyed = df.select(*group, v.alias("_v")).filter(F.col("_v").isNotNull()).withColumn("_band", value_band(F.col("_v")))
    targets = _few_or_written(_targets(keyed, group, probs))
    # A range of one value needs no sorting, however many rows have it.
    wide = (F.col("_in_band") > SORTED_ROWS) & (F.col("_hi") > F.col("_lo"))
    while targets.filter(wide).limit(1).count():
        targets = _few_or_written(_narrowed(keyed, targets, group))
    of_target = [*group, "_name", "_side", "_frac", "_offset"]
    levels = _inside(keyed, targets, group).groupBy(*of_target, "_v").agg(F.count("*").alias("_n"))
    inside = Window.partitionBy(*of_target).orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    found = levels.withColumn("_upto", F.sum("_n").over(inside)).filter(
        (F.col("_offset") < F.col("_upto")) & (F.col("_offset") >= F.col("_upto") - F.col("_n"))
    )
    picks = []
    for name in probs:
        mine = F.col("_name") == name
        low = F.max(F.when(mine & (F.col("_side") == 0), F.col("_v")))
        high = F.max(F.when(mine & (F.col("_side") == 1), F.col("_v")))
        frac = F.max(F.when(mine, F.col("_frac")))
        picks.append((low + (high - low) * frac).alias(name))
    return found.groupBy(*group).agg(*picks) if group else found.agg(*picks)


def _few_or_written(targets: DataFrame) -> DataFrame:
    few = targets.limit(MAX_BROADCAST_TARGETS + 1).collect()
    if len(few) <= MAX_BROADCAST_TARGETS:
        return F.broadcast(targets.sparkSession.createDataFrame(few, targets.schema))
    return settle(targets)
