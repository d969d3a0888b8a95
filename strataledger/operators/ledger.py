"""Filters, rollups and figures over a ledger of losses."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Dimensions that a rollup groups by, each for itself.
DIMENSIONS = ("code", "section", "formation", "rig", "tenant", "entity")
SPREAD_RATE = 48_000.0


def is_in(column: str, wanted: str | int | Iterable | None) -> Column | None:
    """Equality or membership; nothing asked for is no condition."""
    if wanted is None or (isinstance(wanted, str) and not wanted):
        return None
    values = [wanted] if isinstance(wanted, str | int) else list(wanted)
    return F.col(column).isin(values) if values else None


def filter_ledger(
    ledger: DataFrame,
    where: Mapping[str, object] | None = None,
    since: str | None = None,
    until: str | None = None,
    depth_min: float | None = None,
    depth_max: float | None = None,
) -> DataFrame:
    """Rows that meet all conditions; bounds are inclusive. Every conjunct reaches the scan."""
    for column, wanted in (where or {}).items():
        condition = is_in(column, wanted)
        ledger = ledger if condition is None else ledger.where(condition)
    bounds = (("day", ">=", since), ("day", "<=", until), ("depth", ">=", depth_min), ("depth", "<=", depth_max))
    for column, sign, bound in bounds:
        if bound is not None:
            value = F.lit(bound).cast("date") if column == "day" else F.lit(bound)
            ledger = ledger.where(F.col(column) >= value if sign == ">=" else F.col(column) <= value)
    return ledger


def scan_order(ledger: DataFrame) -> DataFrame:
    return ledger.orderBy("day", "report_id", "line")


def total(column: str = "hours") -> Column:
    """A decimal sum as a double; 0 for no rows."""
    return F.coalesce(F.sum(column).cast("double"), F.lit(0.0))


def total_where(condition: Column, column: str = "hours") -> Column:
    return F.coalesce(F.sum(F.when(condition, F.col(column))).cast("double"), F.lit(0.0))


def cost(hours: Column, rate: float = SPREAD_RATE) -> Column:
    """Money from unrounded hours."""
    return hours / F.lit(24.0) * F.lit(rate)


def share(part: Column, whole: Column) -> Column:
    """A ratio that is 0 where there is nothing to share."""
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def rollup(ledger: DataFrame, by: Iterable[str], avoidable: Iterable[str], rate: float = SPREAD_RATE) -> DataFrame:
    """Hours, events, mean, cost and avoidable share of each group."""
    is_avoidable = F.col("code").isin(list(avoidable))
    figures = ledger.groupBy(*by).agg(
        total().alias("total_hours"), F.count("*").alias("n_events"), total_where(is_avoidable).alias("avoidable_hours")
    )
    return figures.select(
        *by,
        "total_hours",
        "n_events",
        (F.col("total_hours") / F.col("n_events")).alias("mean_hours"),
        cost(F.col("total_hours"), rate).alias("cost_usd"),
        share(F.col("avoidable_hours"), F.col("total_hours")).alias("avoidable_share"),
    )


def rollup_all(ledger: DataFrame, dimensions: Iterable[str] = DIMENSIONS) -> DataFrame:
    """Each dimension's groups and the grand total, in one pass: ``dimension, value, total_hours, n_events``.

    Rows are first summed over all dimensions together, so the expansion to one row per dimension works on groups.
    """
    names = list(dimensions)
    fine = ledger.groupBy(*names).agg(F.sum("hours").alias("hours"), F.count("*").alias("n"))
    pairs = F.array(
        *(F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("value")) for d in names),
        F.struct(F.lit("all").alias("dimension"), F.lit("").alias("value")),
    )
    each = fine.select(F.inline(pairs), "hours", "n")
    return each.groupBy("dimension", "value").agg(
        F.sum("hours").cast("double").alias("total_hours"), F.sum("n").alias("n_events")
    )


def summary(ledger: DataFrame, avoidable: Iterable[str]) -> DataFrame:
    """One row of counts and sums."""
    return ledger.agg(
        F.count("*").alias("n_events"),
        F.countDistinct("entity").alias("n_entities"),
        F.countDistinct("report_id").alias("n_reports"),
        total().alias("total_hours"),
        total_where(F.col("code").isin(list(avoidable))).alias("avoidable_hours"),
    )


def breakdown(ledger: DataFrame, by: str) -> DataFrame:
    """Groups of one dimension with their entities, largest first, ties by key."""
    out = ledger.groupBy(F.col(by).alias("key")).agg(
        total().alias("total_hours"),
        F.count("*").alias("n_events"),
        F.countDistinct("entity").alias("n_entities"),
        F.min("day").alias("first_day"),
        F.concat_ws(",", F.sort_array(F.collect_set(F.col("tenant")))).alias("tenants"),
    )
    return out.orderBy(F.col("total_hours").desc(), "key")


def figures(ledger: DataFrame, pinned: Iterable[str], avoidable: Iterable[str]) -> DataFrame:
    """The summary and the breakdowns that the question leaves open: ``figure, key, total_hours, n_events``."""
    fixed = set(pinned)
    parts = [
        ledger.agg(total().alias("total_hours"), F.count("*").alias("n_events")).select(
            F.lit("all").alias("figure"), F.lit("").alias("key"), "total_hours", "n_events"
        )
    ]
    for by in ("code", "tenant", "section", "formation"):
        if by not in fixed:
            parts.append(
                ledger.groupBy(F.col(by).alias("key"))
                .agg(total().alias("total_hours"), F.count("*").alias("n_events"))
                .select(F.lit(by).alias("figure"), "key", "total_hours", "n_events")
            )
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def per_entity(ledger: DataFrame, by: Iterable[str]) -> DataFrame:
    """Mean and 90th percentile of what each entity lost, over the entities of a group."""
    keys = list(by)
    sums = ledger.groupBy(*keys, "entity").agg(F.sum("hours").cast("double").alias("hours"))
    return sums.groupBy(*keys).agg(
        F.count("*").alias("n_entities"),
        (F.sum("hours") / F.count("*")).alias("mean_hours"),
        F.round(F.percentile("hours", F.lit(0.9)), 6).alias("p90_hours"),
    )


def depth_window(ledger: DataFrame, by: Iterable[str]) -> DataFrame:
    """Least and greatest known depth; 0 stands for unknown."""
    known = F.nullif(F.col("depth"), F.lit(0.0))
    return ledger.groupBy(*by).agg(
        F.coalesce(F.min(known), F.lit(0.0)).alias("depth_from"), F.coalesce(F.max(known), F.lit(0.0)).alias("depth_to")
    )


def unavoidable_background(ledger: DataFrame, avoidable: DataFrame) -> DataFrame:
    """Hours of codes outside the avoidable ones, zero sums dropped."""
    other = ledger.join(F.broadcast(avoidable), "code", "left_anti")  # a fixed taxonomy
    return other.groupBy("tenant", "code").agg(total().alias("total_hours")).where(F.col("total_hours") > 0)


def entity_register(exposures: DataFrame) -> DataFrame:
    """One row per entity from its reports: first place and rig, first day, greatest depth, sections, formations."""
    first = F.struct("day", "report_id", "line")
    return exposures.groupBy("entity").agg(
        F.min_by("tenant", first).alias("tenant"),
        F.min_by("rig", first).alias("rig"),
        F.min("day").alias("first_day"),
        F.max("depth").alias("total_depth"),
        F.concat_ws(",", F.sort_array(F.collect_set("section"))).alias("sections"),
        F.concat_ws(",", F.sort_array(F.collect_set("formation"))).alias("formations"),
    )


def example_topics(ledger: DataFrame) -> DataFrame:
    """Per tenant: the code that lost most, the section where it lost most, and the formation that lost most."""
    by_code = ledger.groupBy("tenant", "code").agg(F.sum("hours").alias("h"))
    top = by_code.groupBy("tenant").agg(F.min_by("code", F.struct(-F.col("h"), "code")).alias("code"))
    by_section = ledger.join(top, ["tenant", "code"]).groupBy("tenant", "section").agg(F.sum("hours").alias("h"))
    section = by_section.groupBy("tenant").agg(F.min_by("section", F.struct(-F.col("h"), "section")).alias("section"))
    by_formation = ledger.groupBy("tenant", "formation").agg(F.sum("hours").alias("h"))
    formation = by_formation.groupBy("tenant").agg(
        F.min_by("formation", F.struct(-F.col("h"), "formation")).alias("formation")
    )
    return top.join(section, "tenant").join(formation, "tenant")


def catalog(ledger: DataFrame) -> DataFrame:
    """Every known name by kind, without empty and unknown ones."""
    kinds = ("tenant", "code", "section", "formation", "rig", "tool")
    names = F.array(*(F.struct(F.lit(k).alias("kind"), F.col(k).alias("name")) for k in kinds))
    known = ledger.select(*kinds).distinct().select(F.inline(names)).distinct()
    return known.where(F.col("name").isNotNull() & ~F.col("name").isin("", "UNKNOWN"))


def top_sources(ledger: DataFrame, n: int = 5) -> DataFrame:
    """Reports that lost most, for each tenant."""
    sums = ledger.groupBy("tenant", "report_id").agg(total().alias("total_hours"))
    rank = F.row_number().over(W.partitionBy("tenant").orderBy(F.col("total_hours").desc(), "report_id"))
    return sums.withColumn("rank", rank).where(F.col("rank") <= n)


def quantile_sketches(ledger: DataFrame, by: list[str], value: str = "hours", k: int = 400) -> DataFrame:
    """``by, n, sketch``: a KLL sketch of a value for each group, of a few kilobytes whatever the group's size.

    Sketches of parts merge (``merged_sketches``). With ``k`` of 400 a quantile's rank is within 1 % of the one asked for.
    """
    return ledger.groupBy(*by).agg(F.count(value).alias("n"), F.kll_sketch_agg_double(F.col(value).cast("double"), F.lit(k)).alias("sketch"))


def merged_sketches(sketches: DataFrame, by: list[str]) -> DataFrame:
    """Sketches of larger groups from those of their parts."""
    return sketches.groupBy(*by).agg(F.sum("n").alias("n"), F.kll_merge_agg_double("sketch").alias("sketch"))


def sketched_quantile(sketch: Column | str, share: float) -> Column:
    return F.kll_sketch_get_quantile_double(sketch, F.lit(share))
