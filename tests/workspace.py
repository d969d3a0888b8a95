"""A small workspace of reports: two tenants, eight wells, a problem that recurs on one rig."""

from strataledger.sources.reports import FOOTER


def daily(tenant, entity, n, section, formation, rig, tool, depth, weight, entries=()):
    detail = "\n\n".join(
        f"  Code : {c}\n  Hours : {h} h\n  Depth : {d:,} m\n  Formation : {formation}\n  Description : {t}" for c, h, d, t in entries
    )
    text = f"""DAILY DRILLING REPORT

Operator: Quill Energy    Field: {tenant}    Well: {entity}
Rig: {rig}    Report No: {n}    Date: 2024-03-{n:02d}

Depth at start : {depth:,} m
Depth at end : {depth + 150:,} m
Hole section : {section}
Formation at TD : {formation}
Weight : {weight} sg
MWD : {tool}

OPERATIONS SUMMARY (24 h)
06:00-18:00  Drilled ahead with steady parameters.
18:00-06:00  Circulated and serviced the top drive.

NPT DETAIL
{detail}

REMARKS
Next 24 h: drill ahead.
Weather was fair all day.

{FOOTER}
"""
    return f"DDR-{entity}-{n:03d}", "ddr", text


def final(tenant, entity, lessons, recommendations):
    listed = "\n".join(f"  {k}. {x}" for k, x in enumerate(lessons, 1))
    told = "\n".join(f"  - {x}" for x in recommendations)
    text = f"""END OF WELL REPORT

Operator: Quill Energy    Field: {tenant}    Well: {entity}
Rig: Rig-South    Date: 2024-05-01

1. SUMMARY
The well was drilled as planned.

4. LESSONS LEARNED
{listed}

5. RECOMMENDATIONS FOR FUTURE WELLS
{told}

{FOOTER}
"""
    return f"EOWR-{entity}", "eowr", text


def incident(tenant, entity, code, hours, depth, section, formation, actions):
    text = f"""WELL OPERATIONS INCIDENT REPORT

Operator: Quill Energy    Field: {tenant}    Well: {entity}
Rig: Rig-North    Date: 2024-04-01

Classification: {code}    Lost time: {hours} h
Severity: Serious

LOCATION
Depth: {depth:,} m MD  Hole section: {section}  Formation: {formation}

ROOT CAUSE
The fluid end was worn beyond its limit.

CORRECTIVE ACTIONS
{chr(10).join('  - ' + a for a in actions)}

{FOOTER}
"""
    return f"INC-{entity}-01", "incident", text


def reports():
    out = []
    for k in range(1, 7):
        entity, rig = f"RVB-{100 + k}", "Rig-North" if k <= 3 else "Rig-South"
        for n in range(1, 10):
            hot = n <= 4
            entries = []
            if n == 2:
                entries.append(("RIG_REPAIR", 8.0 if k <= 3 else 1.0, 2600 + 10 * k, "mud pump failed and its fluid end was\n      changed out"))
            if n == 3 and k <= 2:
                entries.append(("WELLBORE_INSTABILITY", 6.0, 2650, f"tight hole and overpull in the salt of {entity}"))
            if n == 7 and k == 5:
                entries.append(("WAIT_ON_WEATHER", 3.0, 900, "waited on weather"))
            place = ('12 1/4"', "Keld Salt") if hot else ('17 1/2"', "Orrin Sand")
            depth = 2500 + 100 * n if hot else 300 + 100 * n
            out.append(daily("Riverbend", entity, n, *place, rig, "PJ-3" if k % 2 else "PJ-5", depth, 1.30 if k <= 2 else 1.45, entries))
    for k in (7, 8):
        for n in range(1, 4):
            entries = [("STUCK_PIPE", 4.5, 1820, "string stuck while tripping")] if (k, n) == (7, 2) else []
            out.append(daily("Millbrook", f"MLB-10{k}", n, '8 1/2"', "Vale Shale", "Rig-East", "PJ-9", 1700 + 60 * n, 1.2, entries))
    out.append(final("Riverbend", "RVB-104", [
        "Inspected and changed the mud pump fluid end before the salt;\n     no pump NPT followed.",
        "In the Keld Salt 12 1/4\" hole hold at least 1.42 sg to avoid overpull.",
        "The mud pump failed twice.",
    ], ["Inspect and change the mud pump fluid end before every salt section.", "Hold at least 1.42 sg in the Keld Salt 12 1/4\" section against overpull."]))
    out.append(final("Riverbend", "RVB-101", ["Total losses were taken in the sand."], ["Run the jars high."]))
    out.append(incident("Riverbend", "RVB-101", "RIG_REPAIR", 8.0, 2610, '12 1/4"', "Keld Salt", ["Replace the mud pump fluid end every 500 hours.", "Talk to the crew."]))
    return out
