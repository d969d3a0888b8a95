"""Risk briefs for a planned entity: what recurred on its neighbours, what it cost, who avoided it and how."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strataledger.functions.text import half_even, scoring_terms, tokenize
from strataledger.operators import mitigations as M
from strataledger.operators import patterns as P
from strataledger.operators.answers import AVOIDABLE, Archive
from strataledger.operators.ledger import SPREAD_RATE, unavoidable_background
from strataledger.operators.matching import is_verbatim
from strataledger.operators.narration import brief_text
from strataledger.operators.passages import evidence_quotes, page_of
from strataledger.sources.storage import written

DISCLAIMER = "Decision support built from the offset archive. Review by a qualified drilling engineer is required."
# Which codes mud weight, a rig and a tool can explain; names of codes.
MUD_CODES = ("STUCK_PIPE", "LOST_CIRCULATION", "WELLBORE_INSTABILITY", "HOLE_CLEANING", "FISHING")
RIG_CODES = ("RIG_REPAIR", "BOP_TEST_FAILURE", "CEMENT_ISSUE", "HSE_STOP")
TOOL_CODES = ("DOWNHOLE_TOOL_FAILURE", "FISHING")


class MissingReports(ValueError):
    """A tenant has losses but no daily reports, so nothing to count exposure by."""


def names_category(planned: str | None, category: Column) -> Column:
    """Whether a planned rig or tool is a category: the same, or one a whole token of the other."""
    wanted = (planned or "").strip()
    own = F.trim(category)
    if not wanted:
        return F.lit(False)
    bounded = lambda c: F.concat(F.lit(r"(?i)(?<![\w-])\Q"), c, F.lit(r"\E(?![\w-])"))
    inside = F.when(F.length(own) < len(wanted), F.regexp_like(F.lit(wanted), bounded(own))).otherwise(F.regexp_like(own, bounded(F.lit(wanted))))
    return F.coalesce((own != "") & ((F.lower(own) == wanted.lower()) | inside), F.lit(False))


def applies(rig: str | None, tool: str | None) -> Column:
    """``applies``, ``does_not_apply`` or ``not_specified`` of patterns ``scope, kind, category``."""

    def state(planned: str | None) -> Column:
        if not (planned or "").strip():
            return F.lit("not_specified")
        return F.when(names_category(planned, F.col("category")), "applies").otherwise("does_not_apply")

    return F.when(F.col("scope") != "equipment", "applies").when(F.col("kind") == "rig", state(rig)).otherwise(state(tool))


def risk_id() -> Column:
    """The code, with the category's letters and digits or the section's digits."""
    category = F.regexp_replace("category", "[^A-Za-z0-9]+", "")
    digits = F.regexp_replace("section", "[^0-9]", "")
    suffix = F.when(F.col("scope") == "equipment", category).otherwise(digits)
    return F.concat_ws("-", "code", F.coalesce(F.nullif(suffix, F.lit("")), F.lit("X")))


def title(labels: Mapping[str, str] | None = None) -> Column:
    """A risk in a few words."""
    label = F.initcap(F.replace(F.lower("code"), F.lit("_"), F.lit(" ")))
    for code, name in (labels or {}).items():
        label = F.when(F.col("code") == code, F.lit(name)).otherwise(label)
    where = F.concat(F.lit(" in the "), "section", F.lit(" section through "), "formation")
    by = F.concat(F.when(F.col("kind") == "rig", " on rig ").otherwise(" on MWD "), "category")
    return F.concat(label, F.when(F.col("scope") == "equipment", by).otherwise(where))


def equipment_driver() -> Column:
    """An equipment pattern is its own driver."""
    named = F.concat(F.when(F.col("kind") == "rig", "rig ").otherwise("MWD "), F.col("category"))
    return F.when(F.col("scope") == "equipment", named)


def affected_by(patterns: DataFrame, owned: DataFrame) -> DataFrame:
    """``candidate, tenant, entity`` of losses at the place and code of interval patterns."""
    keys = ["tenant", "code", "section", "formation"]
    return patterns.where(F.col("scope") == "interval").select("candidate", *keys).join(owned.select(*keys, "entity"), keys).select("candidate", "tenant", "entity").distinct()


def drivers(patterns: DataFrame, daily: DataFrame, losses: DataFrame) -> DataFrame:
    """``candidate, driver`` of interval patterns: mud weight, else rig, else tool, where one sets affected entities apart.

    Each is tried for the codes it can explain. ``daily``: ``tenant, entity, section, formation, rig, tool, mud_weight,
    day, doc_id``.
    """
    keys = ["tenant", "section", "formation"]
    hit = affected_by(patterns, losses)
    place = patterns.where(F.col("scope") == "interval").select("candidate", "code", *keys)
    weights = place.where(F.col("code").isin(*MUD_CODES)).join(daily, keys)
    weights = weights.select("candidate", "entity", F.col("mud_weight").alias("value"))
    by_weight = P.quantity_driver(P.separation(weights, hit, ["candidate"])).join(place, "candidate")
    text = F.format_string(
        "Mud weight in %s averaged %.2f sg on the wells that hit this and %.2f sg on the wells that did not. Affected wells ran %s.",
        "formation", "affected_mean", "clean_mean", "direction",
    )
    found = by_weight.select("candidate", F.lit(0).alias("turn"), text.alias("driver"))
    for turn, (column, codes) in enumerate((("rig", RIG_CODES), ("tool", TOOL_CODES)), 1):
        first = daily.where(F.coalesce(column, F.lit("")) != "").groupBy("tenant", "entity").agg(F.min_by(column, F.struct("doc_id")).alias("category"))
        own = place.where(F.col("code").isin(*codes)).select("candidate", "tenant").join(first, "tenant")
        rates = P.category_rates(
            own.select(F.col("candidate").alias("tenant"), "entity", "category"), hit.select(F.col("candidate").alias("tenant"), "entity")
        )
        worst = P.categorical_driver(rates)
        said = F.format_string(
            "%s hit this on %d of %d wells (%.0f %%) against %.0f %% on the rest of the fleet.",
            "category", "hits", "n", F.col("rate") * 100, F.col("rest_rate") * 100,
        )
        found = found.unionByName(worst.select(F.col("tenant").alias("candidate"), F.lit(turn).alias("turn"), said.alias("driver")))
    return found.groupBy("candidate").agg(F.min_by("driver", "turn").alias("driver"))


def clean_of(patterns: DataFrame, daily: DataFrame, losses: DataFrame) -> DataFrame:
    """``candidate, entity`` of entities exposed to an interval pattern's place, or outside an equipment pattern's
    category, that have none of its losses there."""
    keys = ["tenant", "section", "formation"]
    interval = patterns.where(F.col("scope") == "interval").select("candidate", "code", *keys)
    exposed = interval.join(daily.select(*keys, "entity").distinct(), keys)
    had = losses.select(*keys, "code", "entity").distinct()
    avoided = exposed.join(had, [*keys, "code", "entity"], "left_anti").select("candidate", "entity")
    fleet = daily.select("tenant", "entity").distinct()
    lost = losses.select("tenant", "code", "entity").distinct()
    for kind in ("rig", "tool"):
        own = patterns.where((F.col("scope") == "equipment") & (F.col("kind") == kind)).select("candidate", "tenant", "code", "category")
        used = daily.select("tenant", F.col(kind).alias("category"), "entity").distinct()
        others = own.join(fleet, "tenant").join(used, ["tenant", "category", "entity"], "left_anti")
        avoided = avoided.unionByName(others.join(lost, ["tenant", "code", "entity"], "left_anti").select("candidate", "entity"))
    return avoided


def risk_sources(patterns: DataFrame, losses: DataFrame, most: int = 4) -> DataFrame:
    """The ``most`` largest losses of each pattern, in ledger order on ties."""
    same = lambda c: (F.col(f"p.{c}") == "") | (F.col(f"p.{c}") == F.col(f"l.{c}"))
    p, rows = patterns.alias("p"), losses.alias("l")
    by_kind = lambda kind: (F.col("p.kind") != kind) | (F.col("p.category") == F.col(f"l.{kind}"))
    joined = p.join(rows, (F.col("p.tenant") == F.col("l.tenant")) & (F.col("p.code") == F.col("l.code")))
    joined = joined.where(same("section") & same("formation") & by_kind("rig") & by_kind("tool"))
    order = W.partitionBy("p.candidate").orderBy(F.col("l.hours").desc(), "l.day", "l.doc_id", "l.event_ord")
    ranked = joined.select("p.candidate", "l.doc_id", "l.event_ord", "l.hours", "l.depth", "l.description", F.row_number().over(order).alias("rank"))
    return ranked.where(F.col("rank") <= most)


def brief_totals(risks: DataFrame) -> DataFrame:
    """Expected hours and cost over the risks that do not fail to apply."""
    counts = F.col("applies") != "does_not_apply"
    return risks.agg(
        F.coalesce(F.sum(F.when(counts, F.col("expected_hours"))), F.lit(0.0)).alias("expected_hours"),
        F.coalesce(F.sum(F.when(counts, F.col("cost_usd"))), F.lit(0.0)).alias("cost_usd"),
    )


def register(patterns: DataFrame, planned_depth: float, rate: float, rig: str | None, tool: str | None, most: int | None) -> DataFrame:
    """Risks of patterns that the planned entity reaches, rounded as shown, dearest first."""
    found = P.risks(patterns, rate, None, planned_depth)
    rounded = {
        "probability": half_even("probability", 3), "mean_hours": half_even("mean_hours", 1), "p90_hours": half_even("p90_hours", 1),
        "expected_hours": half_even("expected_hours", 1), "cost_usd": half_even("expected_cost", 0),
    }
    named = {"risk_id": risk_id(), "title": title(), "applies": applies(rig, tool)}
    out = found.withColumns(rounded).withColumns(named).drop("expected_cost")
    out = out.orderBy(F.col("cost_usd").desc(), F.col("total_hours").desc(), "candidate")
    return out if most is None else out.limit(most)


def build_brief(
    archive: Archive, entity: str, tenant: str, planned_depth: float, rate: float = SPREAD_RATE, rig: str | None = None, tool: str | None = None,
    thresholds: P.Thresholds = P.Thresholds(), most: int = 8, filters: bool = True, keywords: Mapping[str, list[str]] = M.KEYWORDS,
) -> dict:
    """A brief as plain values. Without ``filters`` no lift is asked for and unavoidable codes count too."""
    import dataclasses

    losses, daily = archive.ledger.where(F.col("tenant") == tenant), archive.daily.where(F.col("tenant") == tenant)
    if daily.isEmpty() and not losses.isEmpty():
        raise MissingReports(f"{tenant} has losses but no daily reports to count exposure by")
    if not filters:
        thresholds = dataclasses.replace(thresholds, min_lift=0.0)
    keyed = losses.withColumns({"report_id": F.col("doc_id"), "line": F.col("event_ord")})
    exposures = daily.withColumns({"report_id": F.col("doc_id"), "line": F.lit(0)})
    patterns = written(P.find_patterns(exposures, keyed, AVOIDABLE if filters else None, RIG_CODES, TOOL_CODES, thresholds), "brief-patterns")
    risks = register(patterns, planned_depth, rate, rig, tool, most).collect()  # at most ``most`` rows
    kept = patterns.where(F.col("candidate").isin([r.candidate for r in risks]))
    why = {r.candidate: r.driver for r in drivers(kept, daily, losses).collect()}
    clean = written(clean_of(kept, daily, losses), "brief-clean")
    avoided: dict[str, list] = {r.candidate: r.e for r in clean.groupBy("candidate").agg(F.sort_array(F.collect_set("entity")).alias("e")).collect()}
    sources = written(risk_sources(kept, losses), "brief-sources")
    out = []
    for r in risks:
        own = sources.where(F.col("candidate") == r.candidate)
        text = F.lit(" ".join((r.code, r.section, r.formation)))
        docs = archive.documents.join(own.select("doc_id"), "doc_id", "left_semi")
        quotes = evidence_quotes(docs, own, scoring_terms(tokenize(text)))
        pages = page_of("text", F.col("page_ends"), "quote").alias("page")
        cites = docs.join(quotes, "doc_id").join(own.groupBy("doc_id").agg(F.min("rank").alias("rank")), "doc_id")
        cites = [c.asDict() for c in cites.select("doc_id", "doc_type", "entity", "day", "quote", pages, "rank").orderBy("rank").collect()]
        mined = M.mined(M.candidates(archive.finals, archive.incidents, r.code, r.section, r.formation, [tenant], clean.where(F.col("candidate") == r.candidate), keywords))
        told = [m.asDict() for m in mined.orderBy("rank").collect()]
        row = r.asDict() | {"driver": why.get(r.candidate) or _own_driver(r), "mitigations": [m["quote"] for m in told]}
        out.append(row | {"citations": [*cites, *({k: m[k] for k in ("doc_id", "entity", "quote")} for m in told)], "counter_examples": avoided.get(r.candidate, [])})
    counted = [r for r in out if r["applies"] != "does_not_apply"]
    unavoidable = unavoidable_background(losses, archive.documents.sparkSession.createDataFrame([(c,) for c in AVOIDABLE], "code string"))
    brief = {
        "entity": entity, "tenant": tenant, "planned_depth": planned_depth, "spread_rate": rate, "risks": out, "rig": rig, "tool": tool,
        "n_offsets": daily.select("entity").distinct().count(), "expected_hours": round(sum(r["expected_hours"] for r in counted), 1),
        "cost_usd": sum(r["cost_usd"] for r in counted), "thresholds": dataclasses.asdict(thresholds),
        "unavoidable": {r.code: round(r.total_hours, 1) for r in unavoidable.orderBy("code").collect()}, "disclaimer": DISCLAIMER,
    }
    return brief | {"narrative": brief_text(brief), "verification": verify_brief(archive.documents, brief)}


def _own_driver(r) -> str:
    return f"{'rig' if r.kind == 'rig' else 'MWD'} {r.category}" if r.scope == "equipment" else ""


def check_citations(citations: DataFrame, documents: DataFrame) -> DataFrame:
    """``risk_id, doc_id, problem`` of citations ``risk_id, doc_id, quote`` of unknown documents or that aren't verbatim."""
    joined = citations.join(documents.select("doc_id", "text"), "doc_id", "left")
    wrong = F.when(F.col("text").isNull(), "unknown document").when(~is_verbatim(F.col("text"), F.col("quote")), "not verbatim")
    return joined.select("risk_id", "doc_id", wrong.alias("problem")).where(F.col("problem").isNotNull())


def verify_brief(documents: DataFrame, brief: Mapping) -> dict:
    """Whether every citation of a brief resolves and is verbatim."""
    rows = [(r["risk_id"], c["doc_id"], c["quote"]) for r in brief["risks"] for c in r["citations"]]
    found = documents.sparkSession.createDataFrame(rows, "risk_id string, doc_id string, quote string")
    problems = [f"{r.risk_id}: {r.doc_id} {r.problem}" for r in check_citations(found, documents).orderBy("risk_id", "doc_id").collect()] if rows else []
    return {"citations_checked": len(rows), "problems": problems, "ok": not problems}


def provenance(brief: Mapping, version: str, corpus_hash: str, index_hash: str, narrator: str = "offline", built: str | None = None) -> dict:
    """What a brief was built from."""
    import datetime

    now = built or datetime.datetime.now(datetime.UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    return {
        "version": version, "generated_at": now, "corpus_hash": corpus_hash, "index_hash": index_hash, "narrator": narrator,
        "thresholds": brief["thresholds"], "spread_rate": brief["spread_rate"], "verification": brief["verification"],
    }


def _cells(values: Iterable) -> str:
    return "| " + " | ".join(str(v).replace("|", r"\|") for v in values) + " |"


def markdown(brief: Mapping) -> str:
    """The brief as a document with one table of risks."""
    ok = brief["verification"]["ok"]
    equipment = "".join(f", {k} {brief[n]}" for k, n in (("rig", "rig"), ("MWD", "tool")) if brief.get(n))
    head = ("#", "Risk", "Applies", "Wells", "Prob.", "Mean h", "P90 h", "Expected h", "Expected $", "Driver")
    rows = [
        (n, r["title"], r["applies"].replace("_", " "), f"{r['entities_affected']}/{r['entities_total']}", f"{r['probability'] * 100:.0f} %",
         f"{r['mean_hours']:.1f}", f"{r['p90_hours']:.1f}", f"{r['expected_hours']:.1f}", f"{r['cost_usd']:,.0f}", r["driver"] or "-")
        for n, r in enumerate(brief["risks"], 1)
    ]
    blocks = [
        f"# Offset-well risk brief: {brief['entity']} ({brief['tenant']})",
        "" if ok else "**NOT VERIFIED**",
        f"Planned total depth: {brief['planned_depth']:,.0f} m{equipment}\nBuilt from {brief['n_offsets']} offset wells in {brief['tenant']}.",
        f"Total expected NPT: **{brief['expected_hours']:.1f} h** / **${brief['cost_usd']:,.0f}** at ${brief['spread_rate']:,.0f}/day "
        "(risks that do not apply to this plan excluded).",
        "\n".join([_cells(head), "|" + "---|" * len(head), *map(_cells, rows)]),
    ]
    if brief["unavoidable"]:
        blocks.append(f"Unavoidable background NPT: {sum(brief['unavoidable'].values()):.1f} h ({', '.join(brief['unavoidable'])})")
    for n, r in enumerate(brief["risks"], 1):
        lines = [f"- Mitigation: {m}" for m in r["mitigations"][:3]]
        lines += [f"- Evidence: {', '.join(c['doc_id'] for c in r['citations'][:4])}"] if r["citations"] else []
        if lines:
            blocks.append("\n".join([f"## {n}. {r['title']}", *lines]))
    if brief.get("provenance"):
        blocks.append("\n".join(["## Provenance", *(f"- {re.sub('_', ' ', k)}: {v}" for k, v in brief["provenance"].items())]))
    return "\n\n".join(filter(None, [*blocks, brief["disclaimer"]])) + "\n"
