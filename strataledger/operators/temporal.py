"""Joins along an axis: the last row before another, and intervals that meet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strataledger.sources.storage import written

#: Rows of one bin that one task takes; bins beyond it are dealt over several.
CROWDED = 1_000_000


def asof_join(left: DataFrame, right: DataFrame, keys: list[str], at: str, values: list[str], tie: str, ranges: int | None = None) -> DataFrame:
    """``left`` with ``values`` of the last row of ``right`` with equal keys at or before its ``at``; null where there is
    none. Of rows at one time the greatest ``tie`` counts, a column of ``right``; null keys and times have none before them.

    Both sides are put in ranges of keys and time. Each range is read in order by itself, and what the last state of a key
    is at its end is carried to the ranges behind, so that a key may fill any number of ranges.
    """
    spark = left.sparkSession
    typed = lambda df, column: df.select(column.alias("c")).schema["c"].dataType
    state, whole = F.struct(*values), F.struct(*left.columns)
    nothing = F.lit(None).cast(typed(right, state)).alias("__state")
    no_tie, no_row = F.lit(None).cast(right.schema[tie].dataType).alias("__tie"), F.lit(None).cast(typed(left, whole)).alias("__own")
    own = left.select(*keys, F.col(at).alias("__at"), F.lit(1).alias("__side"), no_tie, whole.alias("__own"), nothing)
    told = right.where(F.col(at).isNotNull()).select(*keys, F.col(at).alias("__at"), F.lit(0).alias("__side"), F.col(tie).alias("__tie"), no_row, state.alias("__state"))
    rows = own.unionByName(told).withColumn("__id", F.monotonically_increasing_id())
    order = ["__at", "__side", "__tie", "__id"]
    n = ranges or int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    dealt = written(rows.repartitionByRange(n, *keys, *order).withColumn("__range", F.spark_partition_id()), "asof-ranges")
    inside = W.partitionBy("__range", *keys).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    met = dealt.withColumn("__met", F.last("__state", ignorenulls=True).over(inside)).where("__side = 1")
    # one row for each key and range
    ends = dealt.groupBy(*keys, "__range").agg(F.max_by("__state", F.when(F.col("__state").isNotNull(), F.struct(*order))).alias("__end"))
    before = W.partitionBy(*keys).orderBy("__range").rowsBetween(W.unboundedPreceding, -1)
    carried = ends.select(*keys, "__range", F.last("__end", ignorenulls=True).over(before).alias("__carried"))
    out = met.join(carried, [*keys, "__range"], "left").withColumn("__met", F.coalesce("__met", "__carried"))
    known = F.lit(True)
    for k in [*keys, "__at"]:
        known = known & F.col(k).isNotNull()
    return out.select("__own.*", *(F.when(known, F.col(f"__met.{v}")).alias(f"last_{v}") for v in values))


def _spread(left: DataFrame, right: DataFrame, at: list[str], most: int) -> DataFrame:
    """Inner join on ``at``; the left rows of a value of more than ``most`` are dealt over tasks, each with the right ones."""
    crowded = left.groupBy(*at).agg(F.ceil(F.count("*") / most).alias("__parts")).where("__parts > 1")
    crowded = F.broadcast(crowded)  # each stands for more than ``most`` rows
    parts = F.coalesce("__parts", F.lit(1).cast("long"))
    left = left.join(crowded, at, "left").withColumn("__part", F.pmod(F.monotonically_increasing_id(), parts)).drop("__parts")
    right = right.join(crowded, at, "left").withColumn("__part", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1))).drop("__parts")
    return left.join(right, [*at, "__part"]).drop("__part")


def interval_join(
    a: DataFrame, b: DataFrame, keys: list[str], span_a: tuple[str, str], span_b: tuple[str, str], unit: float = 1.0, most: int = CROWDED
) -> DataFrame:
    """Pairs of rows with equal keys whose closed intervals meet; columns of both, whose names differ but for the keys.

    An interval without a start is its end alone; one without an end, or that ends before it starts, meets nothing. Bins
    double in width from level to level. An interval is filed at the level at which it covers two bins at most, and looks
    for longer ones at those levels above at which the other side has any, so that its rows grow with the number of such
    levels and not with its length. A pair comes from the one bin in which the later of both begins.
    """

    def sized(rows: DataFrame, span: tuple[str, str], side: str) -> DataFrame:
        low, high = F.coalesce(*span).cast("double"), F.col(span[1]).cast("double")
        rows = rows.withColumns({f"__low_{side}": low, f"__high_{side}": high}).where(low <= high)
        level = F.ceil(F.log2(F.greatest((high - low) / F.lit(float(unit)), F.lit(1.0)))).cast("int")
        return rows.withColumn(f"__level_{side}", level)

    def width(level: Column) -> Column:
        return F.pow(F.lit(2.0), level) * F.lit(float(unit))

    def binned(rows: DataFrame, side: str, levels: Column) -> DataFrame:
        rows = rows.withColumn("__level", F.explode(levels))
        bins = F.sequence(*(F.floor(F.col(f"__{end}_{side}") / width(F.col("__level"))) for end in ("low", "high")))
        return rows.withColumn("__bin", F.explode(bins))

    a, b = written(sized(a, span_a, "a"), "intervals"), written(sized(b, span_b, "b"), "intervals")
    # a level is an exponent, so there are few whatever the tables hold
    held = {s: sorted(r[0] for r in rows.select(f"__level_{s}").distinct().collect()) for s, rows in (("a", a), ("b", b))}
    home = lambda side: F.array(f"__level_{side}")
    above = lambda side, other, start: F.filter(F.lit(held[other]).cast("array<int>"), lambda x: x >= F.col(f"__level_{side}") + start)
    at = [*keys, "__level", "__bin"]
    pairs = _spread(binned(a, "a", above("a", "b", 0)), binned(b, "b", home("b")), at, most)
    pairs = pairs.unionByName(_spread(binned(a, "a", home("a")), binned(b, "b", above("b", "a", 1)), at, most))
    later = F.greatest("__low_a", "__low_b")
    meets = (F.col("__low_a") <= F.col("__high_b")) & (F.col("__low_b") <= F.col("__high_a"))
    once = F.col("__bin") == F.floor(later / width(F.col("__level")))
    return pairs.where(meets & once).drop("__level", "__bin", *(f"__{c}_{s}" for c in ("low", "high", "level") for s in "ab"))
