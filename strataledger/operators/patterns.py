"""Recurring losses, measured against exposure, with each loss owned by a pattern.

Rates are hours per report. An *interval* pattern compares a place (section and formation) with the whole tenant; an
*equipment* pattern compares a category (rig or tool) with the rest of the fleet. Statistics are relational; only the
decision which candidate owns shared losses is a function, of counts per combination of candidates.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from strataledger.operators.ledger import cost, depth_window
from strataledger.sources.storage import written

#: Rows of a group and a span of entities, on average, from which entities are counted as bits: a span's bitmap takes 4 KB
#: in memory.
DENSE = 64

#: Columns of losses that patterns use.
LEDGER = ("tenant", "code", "section", "formation", "rig", "tool", "entity", "hours", "depth")


@dataclass(frozen=True)
class Thresholds:
    min_entities: int = 2
    min_support: float = 0.3
    min_lift: float = 2.0
    min_ratio: float = 2.0
    min_share: float = 0.4
    min_equipment_entities: int = 3
    merge_share: float = 0.5


def hours(condition: Column | None = None) -> Column:
    value = F.col("hours") if condition is None else F.when(condition, F.col("hours"))
    return F.coalesce(F.sum(value).cast("double"), F.lit(0.0))


def ratio(here: Column, rest: Column) -> Column:
    """``here / rest``; without a baseline infinite if anything happened here, else 0."""
    return F.when(rest > 0, here / rest).when(here > 0, F.lit(float("inf"))).otherwise(F.lit(0.0))


def finite(value: Column) -> Column:
    return F.when(value < F.lit(float("inf")), value)


def with_entities(rows: DataFrame, by: list[str], count: str, entities: str, total: str | None = None) -> DataFrame:
    """Rows of each group under ``count``, its distinct entities under ``entities`` and its hours under ``total``.

    Entities that are whole numbers are bits of bitmaps, one for each group and 32,768 of them: these travel in place of a
    row for each entity. Where bitmaps would hold few bits each, and for other entities, the rows travel. ``rows`` are read
    twice, so they should be written.
    """
    parts = [F.count("*").alias(count)] + ([F.sum("hours").alias(total)] if total else [])
    span = F.bitmap_bucket_number("entity")
    bits = isinstance(rows.schema["entity"].dataType, T.IntegralType)
    if bits:
        n, groups = rows.agg(F.count("*"), F.approx_count_distinct(F.struct(*by, span))).first()
        bits = n >= DENSE * groups
    if bits:
        held = rows.groupBy(*by, span.alias("__span")).agg(
            *parts, F.bitmap_construct_agg(F.bitmap_bit_position("entity")).alias("__bits")
        )
        out = held.groupBy(*by).agg(
            F.sum(count).alias(count), F.sum(F.bitmap_count("__bits")).alias(entities), *([F.sum(total).alias(total)] if total else [])
        )
    else:
        out = rows.groupBy(*by).agg(*parts, F.countDistinct("entity").alias(entities))
    return out.withColumn(total, F.coalesce(F.col(total).cast("double"), F.lit(0.0))) if total else out


def exposure_counts(exposures: DataFrame, by: list[str]) -> DataFrame:
    """Reports and entities of each group, where every key is known."""
    known = exposures
    for key in by:
        known = known.where(F.col(key).isNotNull() & (F.col(key) != ""))
    return with_entities(known, by, "days", "exposed")


def code_totals(exposures: DataFrame, losses: DataFrame) -> DataFrame:
    """Hours of each code in a tenant, and the tenant's reports."""
    days = exposures.groupBy("tenant").agg(F.count("*").alias("tenant_days"))
    return losses.groupBy("tenant", "code").agg(hours().alias("tenant_hours")).join(days, "tenant")


def interval_stats(exposures: DataFrame, losses: DataFrame) -> DataFrame:
    """Every (code, section, formation) of a tenant with its support and lift, before any threshold."""
    place = ["tenant", "section", "formation"]
    here = with_entities(losses, [*place, "code"], "events", "affected", "hours")
    joined = here.join(exposure_counts(exposures, place), place).join(code_totals(exposures, losses), ["tenant", "code"])
    return joined.select(
        *place, "code", "days", "exposed", "affected", "events", "hours",
        (F.col("affected") / F.col("exposed")).alias("support"),
        ratio(F.col("hours") / F.col("days"), F.col("tenant_hours") / F.col("tenant_days")).alias("lift"),
    )


def equipment_stats(exposures: DataFrame, losses: DataFrame, kind: str) -> DataFrame:
    """Every (code, category) of a tenant with its ratio to the rest of the fleet.

    A category without a rest to compare with has no ratio and is left out.
    """
    keys = ["tenant", kind]
    here = with_entities(losses, [*keys, "code"], "events", "affected", "hours")
    joined = here.join(exposure_counts(exposures, keys), keys).join(code_totals(exposures, losses), ["tenant", "code"])
    rest_days = F.col("tenant_days") - F.col("days")
    rest_hours = F.col("tenant_hours") - F.col("hours")
    return joined.where(rest_days > 0).select(
        "tenant", F.lit(kind).alias("kind"), F.col(kind).alias("category"), "code", "days", "exposed", "affected", "events", "hours",
        (F.col("affected") / F.col("exposed")).alias("share"),
        ratio(F.col("hours") / F.col("days"), rest_hours / rest_days).alias("ratio"),
    )


def qualified_intervals(stats: DataFrame, t: Thresholds, avoidable: Iterable[str] | None) -> DataFrame:
    fits = (F.col("affected") >= t.min_entities) & (F.col("support") >= t.min_support) & (F.col("lift") >= t.min_lift)
    return stats.where(fits if avoidable is None else fits & F.col("code").isin(list(avoidable)))


def qualified_equipment(stats: DataFrame, t: Thresholds, plausible: Iterable[str] | None) -> DataFrame:
    fits = (
        (F.col("ratio") >= t.min_ratio) & (F.col("share") >= t.min_share) & (F.col("affected") >= t.min_equipment_entities)
    )
    return stats.where(fits if plausible is None else fits & F.col("code").isin(list(plausible)))


def overlap_of(left: DataFrame, right: DataFrame) -> DataFrame:
    """Shared losses of candidates of one tenant and code: ``a, b, shared`` from memberships
    ``candidate, tenant, code, report_id, line``."""
    keys = ["tenant", "code", "report_id", "line"]
    a = left.select(F.col("candidate").alias("a"), *keys)
    b = right.select(F.col("candidate").alias("b"), *keys)
    both = a.join(b, keys).where(F.col("a") != F.col("b"))
    return both.groupBy("a", "b").agg(F.count("*").alias("shared"))


def resolve(intervals: list[str], equipment: list[str], groups: list[tuple[tuple, int]], merge_share: float):
    """Who owns which losses.

    ``intervals`` and ``equipment`` name the candidates of one tenant and code, in order of precedence. ``groups``
    counts the losses by the candidates that hold them. Returns, per surviving candidate, the positions of its groups,
    and the intervals that must qualify again on what is left of them.
    """
    n = [count for _, count in groups]
    held = {c: {k for k, (names, _) in enumerate(groups) if c in names} for c in (*intervals, *equipment)}

    def size(which: set[int]) -> int:
        return sum(n[k] for k in which)

    owners: dict[str, set[int]] = {}
    gone: set[str] = set()
    for i, name in enumerate(equipment):
        if name in gone:
            continue
        owners[name] = set(held[name])
        for other in equipment[i + 1 :]:
            if other not in gone and held[other] and size(owners[name] & held[other]) > merge_share * size(held[other]):
                owners[name] |= held[other]
                gone.add(other)
    final, again = dict(owners), set()
    for name in intervals:
        equipment_groups = set().union(*(final[e] for e in owners)) if owners else set()
        shared = held[name] & equipment_groups
        if not shared:
            final[name] = held[name]
        elif size(shared) > merge_share * size(held[name]):
            target = max(owners, key=lambda e: size(final[e] & held[name]))
            others = set().union(*(final[e] for e in owners if e != target)) if len(owners) > 1 else set()
            final[target] = final[target] | (held[name] - others)
        else:
            final[name] = held[name] - shared
            again.add(name)
    return final, again


OWNED = T.StructType(
    [
        T.StructField("candidate", T.StringType()),
        T.StructField("retest", T.BooleanType()),
        T.StructField("groups", T.ArrayType(T.StringType())),
    ]
)


def _owners(merge_share: float):
    """Resolves the candidates of one tenant and code, from themselves and from counts of losses by combination."""
    import pyarrow as pa

    schema = pa.schema([("candidate", pa.string()), ("retest", pa.bool_()), ("groups", pa.list_(pa.string()))])

    def run(candidates: pa.Table, counted: pa.Table) -> pa.Table:
        rows = candidates.select(["candidate", "scope", "rank", "hours"]).to_pylist()
        intervals = [r["candidate"] for r in sorted(rows, key=lambda r: r["rank"]) if r["scope"] == "interval"]
        fleet = sorted((r for r in rows if r["scope"] == "equipment"), key=lambda r: (-r["hours"], r["rank"]))
        groups = sorted(zip(counted["group"].to_pylist(), counted["n"].to_pylist(), strict=True))
        sets = [(tuple(g.split("&")), n) for g, n in groups]
        final, again = resolve(intervals, [r["candidate"] for r in fleet], sets, merge_share)
        out = [(c, c in again, [groups[k][0] for k in sorted(own)]) for c, own in final.items()]
        return pa.Table.from_arrays(
            [pa.array(x, f.type) for x, f in zip(zip(*out, strict=True) if out else ([], [], []), schema, strict=True)], schema=schema
        )

    return run


def find_patterns(
    exposures: DataFrame,
    losses: DataFrame,
    avoidable: Iterable[str] | None = None,
    rig_codes: Iterable[str] | None = None,
    tool_codes: Iterable[str] | None = None,
    thresholds: Thresholds = Thresholds(),
    kept: bool = False,
) -> DataFrame:
    """Every pattern that clears its thresholds, with its owned losses counted once, largest first.

    Losses are counted by the combination of candidates that hold them. Who owns what is decided in one task for each
    tenant and code, from these counts alone. ``kept``: exposures and losses are read from written tables already.
    """
    t = thresholds
    exposures, losses = exposures.select("tenant", "entity", "section", "formation", "rig", "tool"), losses.select(*LEDGER)
    if not kept:
        exposures, losses = written(exposures, "pattern-exposures"), written(losses, "pattern-losses")
    intervals = qualified_intervals(interval_stats(exposures, losses), t, avoidable)
    equipment = qualified_equipment(equipment_stats(exposures, losses, "rig"), t, rig_codes).unionByName(
        qualified_equipment(equipment_stats(exposures, losses, "tool"), t, tool_codes)
    )
    none = F.lit("")
    found_i = intervals.select(
        F.concat_ws("|", F.lit("interval"), "tenant", "code", "section", "formation").alias("candidate"), "tenant", "code",
        F.lit("interval").alias("scope"), "section", "formation", none.alias("kind"), none.alias("category"), "lift",
        F.lit(None).cast("double").alias("ratio"), "hours", "days", "exposed", F.concat_ws("|", "section", "formation").alias("rank"),
    )
    found_e = equipment.select(
        F.concat_ws("|", F.lit("equipment"), "tenant", "code", "kind", "category").alias("candidate"), "tenant", "code",
        F.lit("equipment").alias("scope"), none.alias("section"), none.alias("formation"), "kind", "category",
        F.lit(None).cast("double").alias("lift"), "ratio", "hours", "days", "exposed", F.concat_ws("|", "kind", "category").alias("rank"),
    )
    candidates = written(found_i.unionByName(found_e), "pattern-candidates")
    found_i, found_e = (candidates.where(F.col("scope") == scope) for scope in ("interval", "equipment"))
    marks = losses.join(
        found_i.select("tenant", "code", "section", "formation", F.col("candidate").alias("m_interval")),
        ["tenant", "code", "section", "formation"], "left",
    )
    for kind in ("rig", "tool"):
        own = found_e.where(F.col("kind") == kind)
        own = own.select("tenant", "code", F.col("category").alias(kind), F.col("candidate").alias(f"m_{kind}"))
        marks = marks.join(own, ["tenant", "code", kind], "left")
    members = ("m_interval", "m_rig", "m_tool")
    marks = marks.where(F.coalesce(*members).isNotNull()).withColumn("group", F.concat_ws("&", *members))
    marks = written(marks.select("tenant", "code", "entity", "hours", "depth", "group"), "pattern-marks")
    counted = marks.groupBy("tenant", "code", "group").agg(F.count("*").alias("n"))
    owned = (
        candidates.groupBy("tenant", "code")
        .cogroup(counted.toDF("c_tenant", "c_code", "group", "n").groupBy("c_tenant", "c_code"))
        .applyInArrow(_owners(t.merge_share), OWNED)
    )
    patterns = written(candidates.drop("hours", "rank").join(owned, "candidate"), "pattern-owners")
    rows = marks.join(patterns.select("candidate", F.explode("groups").alias("group")), "group")
    return _finalised(patterns, rows, exposures, losses, t)


def _finalised(patterns: DataFrame, owned: DataFrame, exposures: DataFrame, losses: DataFrame, t: Thresholds) -> DataFrame:
    """Figures over the owned losses; per-entity figures stay within the exposed population."""
    place = F.concat_ws("|", "kind", "tenant", "category").alias("place")
    equipment = patterns.where(F.col("scope") == "equipment").select(place).distinct()
    fleet = exposures.select(
        "entity", F.explode(F.array(
            F.concat_ws("|", F.lit("rig"), "tenant", "rig"), F.concat_ws("|", F.lit("tool"), "tenant", "tool")
        )).alias("place")
    ).join(equipment, "place", "left_semi").distinct()
    keyed = owned.join(patterns.select("candidate", "scope", "kind", "category"), "candidate")
    # hours of an entity come before its place, so that one row for each entity of a candidate meets the fleet
    per = keyed.groupBy("candidate", "scope", place, "entity").agg(F.sum("hours").cast("double").alias("h"))
    inside = per.where(F.col("scope") != "interval").join(fleet, ["place", "entity"], "left_semi")
    per = per.where(F.col("scope") == "interval").unionByName(inside)
    people = per.groupBy("candidate").agg(
        F.count("*").alias("entities_affected"),
        (F.sum("h") / F.count("*")).alias("mean_hours"),
        F.round(F.percentile("h", F.lit(0.9)), 6).alias("p90_hours"),
    )
    sums = keyed.groupBy("candidate").agg(F.count("*").alias("events"), F.sum("hours").cast("double").alias("total_hours"))
    totals = code_totals(exposures, losses).select("tenant", "code", "tenant_hours", "tenant_days")
    full = (
        patterns.join(sums, "candidate")
        .join(people, "candidate", "left")
        .join(depth_window(keyed, ["candidate"]), "candidate")
        .join(totals, ["tenant", "code"])
    )
    new_lift = ratio(F.col("total_hours") / F.col("days"), F.col("tenant_hours") / F.col("tenant_days"))
    full = full.withColumn("lift", F.when(F.col("retest"), new_lift).otherwise(F.col("lift")))
    still = (
        (F.col("entities_affected") >= t.min_entities)
        & (F.col("entities_affected") / F.col("exposed") >= t.min_support)
        & (F.col("lift") >= t.min_lift)
    )
    full = full.where(~F.col("retest") | still)
    return full.select(
        "candidate", "tenant", "code", "scope", "section", "formation", "kind", "category",
        F.col("exposed").alias("entities_total"), F.coalesce("entities_affected", F.lit(0)).alias("entities_affected"),
        "events", "total_hours", "mean_hours", "p90_hours", "depth_from", "depth_to",
        finite(F.col("lift")).alias("lift"), finite(F.col("ratio")).alias("ratio"),
    ).orderBy(F.col("total_hours").desc(), "candidate")


def interval_only(patterns: DataFrame) -> DataFrame:
    return patterns.where(F.col("scope") == "interval")


def category_rates(first_category: DataFrame, affected: DataFrame, min_entities: int = 3) -> DataFrame:
    """Hit rate of each category of enough entities, against the mean of the others' rates.

    ``first_category``: ``tenant, entity, category``; ``affected``: ``tenant, entity``.
    """
    hit = affected.select("tenant", "entity").distinct().withColumn("hit", F.lit(1))
    rates = first_category.join(hit, ["tenant", "entity"], "left").groupBy("tenant", "category").agg(
        F.count("*").alias("n"), F.count("hit").alias("hits")
    )
    every = W.partitionBy("tenant")  # one row per category
    rated = rates.where(F.col("n") >= min_entities).withColumn("rate", F.col("hits") / F.col("n"))
    others = (F.sum("rate").over(every) - F.col("rate")) / (F.count("*").over(every) - 1)
    return rated.withColumn("rest_rate", F.when(F.count("*").over(every) > 1, F.round(others, 9))).select(
        "tenant", "category", "n", "hits", "rate", "rest_rate"
    )


def categorical_driver(rates: DataFrame, min_rate: float = 0.4, min_ratio: float = 2.0) -> DataFrame:
    """The worst category of each tenant, if it stands out."""
    rank = F.row_number().over(W.partitionBy("tenant").orderBy(F.col("rate").desc(), "category"))
    stands_out = (F.col("rate") >= min_rate) & ((F.col("rest_rate") == 0) | (F.col("rate") >= min_ratio * F.col("rest_rate")))
    return rates.withColumn("__r", rank).where((F.col("__r") == 1) & F.col("rest_rate").isNotNull() & stands_out).drop("__r")


def separation(values: DataFrame, affected: DataFrame, keys: list[str]) -> DataFrame:
    """How far entity means of a quantity differ between affected entities and all others.

    ``values``: keys, ``entity``, ``value``; ``affected``: keys, ``entity``. Both sides need two entities.
    """
    means = values.where(F.col("value").isNotNull() & (F.col("value") != 0)).groupBy(*keys, "entity").agg(F.avg("value").alias("m"))
    marked = means.join(affected.select(*keys, "entity").distinct().withColumn("hit", F.lit(True)), [*keys, "entity"], "left")
    hit = F.coalesce("hit", F.lit(False))
    out = marked.groupBy(*keys).agg(
        F.count_if(hit).alias("n_affected"), F.count_if(~hit).alias("n_clean"),
        F.avg(F.when(hit, F.col("m"))).alias("affected_mean"), F.avg(F.when(~hit, F.col("m"))).alias("clean_mean"),
        F.stddev_pop("m").alias("spread"),
    ).where((F.col("n_affected") >= 2) & (F.col("n_clean") >= 2))
    gap = F.abs(F.col("affected_mean") - F.col("clean_mean"))
    return out.withColumn("sigma", gap / F.greatest(F.col("spread"), F.lit(1e-9))).withColumn("gap", gap)


def quantity_driver(separated: DataFrame, min_sigma: float = 1.2, min_gap: float = 0.03) -> DataFrame:
    direction = F.when(F.col("affected_mean") < F.col("clean_mean"), "lower").otherwise("higher")
    return separated.where((F.col("sigma") > min_sigma) & (F.col("gap") >= min_gap)).withColumn("direction", direction)


def risks(patterns: DataFrame, rate: float = 48_000.0, max_risks: int | None = 8, planned_depth: float | None = None) -> DataFrame:
    """Expected loss of one more entity from each pattern, dearest first."""
    if planned_depth is not None:
        patterns = patterns.where(F.col("depth_from") <= planned_depth + 50)
    probability = F.col("entities_affected") / F.col("entities_total")
    out = patterns.withColumn("probability", probability).withColumn("expected_hours", probability * F.col("mean_hours"))
    out = out.withColumn("expected_cost", cost(F.col("expected_hours"), rate))
    out = out.withColumn("cost_usd", F.round(F.col("expected_cost"), 0)).orderBy(F.col("cost_usd").desc(), F.col("total_hours").desc(), "candidate")
    return out if max_risks is None else out.limit(max_risks)
