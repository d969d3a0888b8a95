"""Answers and briefs in words, from their figures and quotes alone."""

from __future__ import annotations

from collections.abc import Mapping

# What reads as part of the text of an answer.
NO_MATCH = "No records in this workspace match that question."


def hours_text(hours: float) -> str:
    return f"{hours:,.1f} h"


def money_text(usd: float) -> str:
    return f"${usd / 1e6:,.2f} M" if usd >= 1e6 else f"${usd:,.0f}"


def counted(n: int, word: str, many: str | None = None) -> str:
    return f"{n} {word if n == 1 else many or word + 's'}"


def _largest(title: str, rows: list[dict], key: str, most: int | None = 3) -> list[str]:
    shown = ", ".join(f"{r[key]} {hours_text(r['hours'])}" for r in rows[:most])
    return [f"{title}: {shown}."] if shown else []


def figures_text(answer: Mapping) -> list[str]:
    """Sentences on the totals; on a scope without losses, one that says so."""
    f = answer.get("figures")
    if not f:
        return []
    if not f["event_count"]:
        scope = answer.get("scope") or "no filter"
        where = "in this workspace" if scope == "no filter" else f"for {scope}"
        return [f"No NPT entry is recorded {where}: {hours_text(0.0)} of non-productive time."]
    entries = counted(f["event_count"], "NPT entry", "NPT entries")
    lines = [
        f"{entries} on {counted(f['entity_count'], 'well')}: {hours_text(f['total_hours'])} of non-productive time, "
        f"{money_text(f['total_cost_usd'])} at {money_text(f['spread_rate'])} per day."
    ]
    if len(f.get("by_tenant", ())) > 1:
        lines += _largest("By field", f["by_tenant"], "tenant", None)
    lines += _largest("Largest codes", f.get("by_code", []), "code") + _largest("Largest wells", f.get("by_entity", []), "entity")
    sources = answer.get("figure_sources") or []
    if sources:
        cited = ", ".join(f"[{s['doc_id']}] {hours_text(s['hours'])}" for s in sources)
        lines.append(f"Largest contributing reports ({len(sources)} of {answer.get('report_count') or len(sources)}): {cited}.")
    return lines


def answer_text(answer: Mapping, most_quotes: int = 6, most_mitigations: int = 3) -> str:
    """The figures, the quotes of retrieved documents, and the groups of mitigations, as paragraphs."""
    parts = ["\n".join(figures_text(answer))]
    quotes = [f"- {c['quote']} [{c['doc_id']}]" for c in answer.get("citations", ()) if c["role"] == "retrieval"]
    if quotes:
        parts.append("\n".join(["From the documents:", *quotes[:most_quotes]]))
    for group in answer.get("mitigation_groups", ()):
        parts.append("\n".join([f"{group['heading']}:", *(f"- {m['quote']} [{m['doc_id']}]" for m in group["mitigations"][:most_mitigations])]))
    return "\n\n".join(filter(None, parts)) or NO_MATCH


# What a brief says of risks whose equipment the plan does not name.
APPLIES = {
    "does_not_apply": " (does not apply to this plan, excluded from totals)",
    "not_specified": " (plan did not specify; counted as applying)",
}


def risk_text(n: int, r: Mapping) -> str:
    """One risk of a brief."""
    low, high = r["depth_from"], r["depth_to"]
    place = r["driver"] or f"{r['kind']} {r['category']}" if r["scope"] == "equipment" else f"{r['section']} section, {r['formation']}"
    lines = [
        f"{n}. {r['title']}{APPLIES.get(r['applies'], '')}",
        f"   Hit {r['entities_affected']} of {r['entities_total']} offset wells ({r['probability'] * 100:.0f} %). "
        f"Mean {hours_text(r['mean_hours'])} when it happens, P90 {hours_text(r['p90_hours'])}. "
        f"Expected carry {hours_text(r['expected_hours'])} / {money_text(r['cost_usd'])}.",
        f"   Where: {place}, {int(low):,}-{int(high):,} m.",
    ]
    if r["driver"]:
        lines.append(f"   Driver in the data: {r['driver']}")
    lines += [f"   Mitigation: {m}" for m in r["mitigations"][:3]]
    if r["counter_examples"]:
        lines.append(f"   Wells that avoided it: {', '.join(map(str, r['counter_examples'][:6]))}")
    return "\n".join([*lines, f"   Evidence: {', '.join(c['doc_id'] for c in r['citations'][:4])}"])


def brief_text(brief: Mapping) -> str:
    """A brief in words; without risks, what that does not mean."""
    if not brief["risks"]:
        return (
            f"No recurring problem in the offset history of {brief['tenant']} clears the reporting threshold for "
            f"{brief['entity']}. That is a statement about this archive, not a statement that the well is low risk."
        )
    parts = [
        f"{brief['entity']} is planned to {int(brief['planned_depth']):,} m in {brief['tenant']}. "
        f"The register below is built from {brief['n_offsets']} offset wells in the same field.",
        f"Carried exposure across all listed risks: {hours_text(brief['expected_hours'])} of expected non-productive time, "
        f"{money_text(brief['cost_usd'])} at {money_text(brief['spread_rate'])} per day spread rate.",
        *(risk_text(n, r) for n, r in enumerate(brief["risks"], 1)),
    ]
    if brief["unavoidable"]:
        hours = hours_text(sum(brief["unavoidable"].values()))
        parts.append(f"Unavoidable background NPT: {hours} ({', '.join(brief['unavoidable'])}).")
    return "\n\n".join(parts)
