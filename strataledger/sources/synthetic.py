"""A seeded corpus of reports with known truth: tenants, entities, daily reports, losses that recur on purpose, write-ups.

Every entity draws from a stream of its own, so one entity's reports don't depend on the others'. Rows are made by tasks,
one entity at a time; the truth is what the generator chose, never what a reader found.
"""

from __future__ import annotations

import random
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataledger.sources.reports import FOOTER


@dataclass(frozen=True)
class Interval:
    section: str
    formation: str
    top: int
    base: int
    days: int


@dataclass(frozen=True)
class Planted:
    """A problem that recurs: at a place, or on a rig or a tool, with a share of the entities there."""

    id: str
    code: str
    hours: float
    share: float
    section: str = ""
    formation: str = ""
    rig: str = ""
    tool: str = ""
    light_mud: bool = False


@dataclass(frozen=True)
class Tenant:
    name: str
    prefix: str
    entities: int
    rigs: tuple[str, ...]
    tools: tuple[str, ...]
    intervals: tuple[Interval, ...]
    planted: tuple[Planted, ...] = field(default=())


TENANTS = (
    Tenant(
        "Keldra", "KEL", 28, ("Keldra-1", "Keldra-2"), ("PJ-3", "PJ-5"),
        (Interval('26"', "Upper Sand", 0, 600, 3), Interval('17 1/2"', "Vale Shale", 600, 1800, 5),
         Interval('12 1/4"', "Keld Salt", 1800, 2700, 6), Interval('8 1/2"', "Deep Carbonate", 2700, 3400, 6)),
        (Planted("G1", "STUCK_PIPE", 14.0, 0.5, '12 1/4"', "Keld Salt", light_mud=True), Planted("G3", "DOWNHOLE_TOOL_FAILURE", 9.0, 0.7, tool="PJ-3")),
    ),
    Tenant(
        "Vessra", "VES", 14, ("Vessra-3", "Vessra-5"), ("QX-1",),
        (Interval('17 1/2"', "Coast Sand", 0, 1200, 5), Interval('12 1/4"', "Grey Marl", 1200, 2100, 5), Interval('8 1/2"', "Vessra Carbonate", 2100, 2900, 6)),
        (Planted("G2", "LOST_CIRCULATION", 11.0, 0.5, '8 1/2"', "Vessra Carbonate"), Planted("G4", "RIG_REPAIR", 12.0, 0.9, rig="Vessra-3")),
    ),
)
NOISE, LOST = 0.12, ("BOP_TEST_FAILURE", "CEMENT_ISSUE", "WAIT_ON_WEATHER", "THIRD_PARTY_STANDBY", "WAIT_ON_MATERIALS")
STORIES = {
    "STUCK_PIPE": ("string packed off while tripping and was stuck", "overpull, then the pipe was stuck in the salt"),
    "DOWNHOLE_TOOL_FAILURE": ("MWD failed on temperature and was pulled", "no signal from the MWD; tripped for a new one"),
    "LOST_CIRCULATION": ("total losses were taken; pumped a pill", "lost 120 bbl before the losses stopped"),
    "RIG_REPAIR": ("mud pump fluid end washout; changed out", "mud pump failed twice in one shift"),
    "BOP_TEST_FAILURE": ("annular preventer leaked on test",), "CEMENT_ISSUE": ("cement head leaked; job repeated",),
    "WAIT_ON_WEATHER": ("waited on weather",), "THIRD_PARTY_STANDBY": ("wireline crew on standby",), "WAIT_ON_MATERIALS": ("waited on barite",),
}
PRACTICE = {
    "STUCK_PIPE": "Hold at least 1.42 sg through the Keld Salt 12 1/4\" section before each trip.",
    "DOWNHOLE_TOOL_FAILURE": "Run the MWD with the higher temperature rating.",
    "LOST_CIRCULATION": "Pump an LCM pill ahead of the Vessra Carbonate 8 1/2\" section and reduce flow rate.",
    "RIG_REPAIR": "Inspect and change the mud pump fluid end before each long section.",
}


def stream(seed: int, prefix: str, k: int) -> random.Random:
    """The random stream of one entity."""
    return random.Random(zlib.crc32(f"{seed}/{prefix}/{k}".encode()))


def schedule(tenant: Tenant, k: int) -> tuple[str, str, int]:
    """Rig, tool and first day of an entity: a rig drills one at a time."""
    rig = tenant.rigs[k % len(tenant.rigs)]
    days = sum(i.days for i in tenant.intervals) + 3
    return rig, tenant.tools[(k // len(tenant.rigs)) % len(tenant.tools)], (k // len(tenant.rigs)) * days


def simulate(tenant: Tenant, k: int, seed: int) -> list[dict]:
    """One row for each day of an entity, with its losses."""
    rng, entity = stream(seed, tenant.prefix, k), f"{tenant.prefix}-{101 + k}"
    rig, tool, day = schedule(tenant, k)
    hit = {}
    for p in tenant.planted:
        exposed = (not p.rig or p.rig == rig) and (not p.tool or p.tool == tool)
        hit[p.id] = exposed and rng.random() < p.share
    rows, n = [], 0
    for i in tenant.intervals:
        at = {p.id: rng.randrange(i.days) for p in tenant.planted if hit[p.id] and (not p.section or (p.section, p.formation) == (i.section, i.formation))}
        light = any(p.light_mud and hit[p.id] for p in tenant.planted)
        for d in range(i.days):
            n += 1
            step = (i.base - i.top) / i.days
            losses = []
            for p in tenant.planted:
                if at.get(p.id) == d:
                    losses.append((p.code, round(p.hours * rng.uniform(0.7, 1.3), 1), p.id))
            if rng.random() < NOISE:
                losses.append((rng.choice(LOST), round(rng.uniform(0.5, 5.0), 1), None))
            depth = i.top + step * (d + 1)
            entries = [
                {"code": c, "hours": h, "depth": float(round(depth - rng.random() * step / 2)), "text": rng.choice(STORIES[c]), "pattern": g} for c, h, g in losses
            ]
            weight = round((1.28 if light and i.formation == "Keld Salt" else 1.42) + rng.uniform(-0.01, 0.01), 2)
            rows.append({"tenant": tenant.name, "entity": entity, "n": n, "day": day + n, "rig": rig, "tool": tool, "section": i.section,
                         "formation": i.formation, "start": round(depth - step), "end": round(depth), "weight": weight, "entries": entries})
    return rows


def date_text(day: int) -> str:
    return str((pd.Timestamp("2023-01-01") + pd.Timedelta(days=day)).date())


def head(title: str, r: dict) -> str:
    return f"{title}\n\nOperator: Quill Energy    Field: {r['tenant']}    Well: {r['entity']}\nRig: {r['rig']}    Report No: {r['n']}    Date: {date_text(r['day'])}\n\n"


def daily_text(r: dict) -> str:
    detail = "\n\n".join(
        f"  Code : {e['code']}\n  Hours : {e['hours']} h\n  Depth : {e['depth']:,.0f} m\n  Formation : {r['formation']}\n  Description : {e['text']}" for e in r["entries"]
    )
    lost = sum(e["hours"] for e in r["entries"])
    return head("DAILY DRILLING REPORT", r) + (
        f"Depth at start : {r['start']:,} m\nDepth at end : {r['end']:,} m\nHole section : {r['section']}\nFormation at TD : {r['formation']}\n"
        f"Weight : {r['weight']:.2f} sg\nMWD : {r['tool']}\nProductive time : {24 - lost:.1f} h\nNon-productive time : {lost:.1f} h\n\n"
        f"OPERATIONS SUMMARY (24 h)\n00:00-24:00  Drilled {r['section']} hole from {r['start']:,} m to {r['end']:,} m.\n\nNPT DETAIL\n{detail}\n\n"
        f"REMARKS\nNext 24 h: carry on.\nHole in fair condition.\n\n{FOOTER}\n"
    )


def write_up(tenant: Tenant, rows: list[dict]) -> list[tuple[str, str, str, list[tuple]]]:
    """The final report of an entity and incidents of its largest losses, with the labels of their sentences."""
    first, events = rows[-1], [(r, e) for r in rows for e in r["entries"]]
    by_code: dict[str, float] = {}
    for _, e in events:
        by_code[e["code"]] = by_code.get(e["code"], 0.0) + e["hours"]
    own = {e["pattern"] for _, e in events}
    avoided = [p for p in tenant.planted if p.id not in own]
    lessons = [(f"{e['text'][0].upper()}{e['text'][1:]} in the {r['formation']}.", "failure", e["code"]) for r, e in events if e["pattern"]][:3]
    lessons += [("The crew change went to plan.", "neutral", None)]
    told = [(PRACTICE[p.code], "practice", p.code) for p in avoided]
    name = f"EOWR-{first['entity']}"
    table = "\n".join(f"  {c}   {h:.1f} h" for c, h in sorted(by_code.items()))
    text = head("END OF WELL REPORT", first) + (
        f"Days on well : {len(rows)}\nTotal depth : {first['end']:,} m\nNon-productive time : {sum(by_code.values()):.1f} h\n\n3. NPT BREAKDOWN BY CODE\n{table}\n\n"
        "4. LESSONS LEARNED\n" + "\n".join(f"  {k}. {s}" for k, (s, _, _) in enumerate(lessons, 1))
        + "\n\n5. RECOMMENDATIONS FOR FUTURE WELLS\n" + "\n".join(f"  - {s}" for s, _, _ in told) + f"\n\n{FOOTER}\n"
    )
    labels = [(name, k, s, label, code) for k, part in (("lesson", lessons), ("recommendation", told)) for s, label, code in part]
    out = [(name, "eowr", text, labels)]
    for n, (r, e) in enumerate((x for x in events if x[1]["pattern"] and x[1]["hours"] >= 10), 1):
        action = PRACTICE[e["code"]]
        text = head("WELL OPERATIONS INCIDENT REPORT", r) + (
            f"Classification: {e['code']}    Lost time: {e['hours']} h\nSeverity: Serious\n\nLOCATION\nDepth: {e['depth']:,.0f} m MD  Hole section: {r['section']}"
            f"  Formation: {r['formation']}\n\nSEQUENCE OF EVENTS\n  1. {e['text']}\n\nROOT CAUSE\nThe plan did not foresee it.\n\nCORRECTIVE ACTIONS\n  - {action}\n\n{FOOTER}\n"
        )
        own_name = f"INC-{r['entity']}-{n:02d}"
        out.append((own_name, "incident", text, [(own_name, "corrective_action", action, "practice", e["code"])]))
    return out


def corpus(spark: SparkSession, seed: int = 20260731, scale: int = 1, tenants: tuple[Tenant, ...] = TENANTS) -> dict[str, DataFrame]:
    """``docs`` (doc_id, doc_type, text, page_ends) and the truth: ``events, sentences, wells, patterns``.

    ``scale`` multiplies the entities of every tenant.
    """
    units = spark.createDataFrame([(t, k) for t, tenant in enumerate(tenants) for k in range(tenant.entities * scale)], "t int, k int")
    row = "kind string, doc_id string, doc_type string, text string, entity string, tenant string, code string, hours double, section string, formation string, pattern string, label string, rig string, tool string"
    names = [c.split()[0] for c in row.split(", ")]

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for t, k in zip(batch["t"], batch["k"], strict=True):
                tenant, out = tenants[t], []
                days = simulate(tenant, int(k), seed)
                own = {"entity": days[0]["entity"], "tenant": tenant.name, "rig": days[0]["rig"], "tool": days[0]["tool"]}
                out.append(own | {"kind": "well"})
                for r in days:
                    name = f"DDR-{r['entity']}-{r['n']:03d}"
                    out.append(own | {"kind": "doc", "doc_id": name, "doc_type": "ddr", "text": daily_text(r)})
                    place = {"section": r["section"], "formation": r["formation"]}
                    out += [own | place | {"kind": "event", "doc_id": name, "code": e["code"], "hours": e["hours"], "pattern": e["pattern"]} for e in r["entries"]]
                for name, kind, text, labels in write_up(tenant, days):
                    out.append(own | {"kind": "doc", "doc_id": name, "doc_type": kind, "text": text})
                    out += [own | {"kind": "sentence", "doc_id": d, "doc_type": p, "text": s, "label": x, "code": c} for d, p, s, x, c in labels]
                yield pd.DataFrame(out, columns=names, dtype=object)

    made = units.repartition(max(2, len(tenants) * scale)).mapInPandas(make, row)
    of = lambda kind: made.where(F.col("kind") == kind)
    keys = [(p.id, t.name, "equipment" if p.rig or p.tool else "interval", "mud_weight" if p.light_mud else "rig" if p.rig else "tool" if p.tool else "",
             p.code, p.section, p.formation, p.rig, p.tool) for t in tenants for p in t.planted]
    return {
        "docs": of("doc").select("doc_id", "doc_type", "text", F.lit(None).cast("array<int>").alias("page_ends")),
        "events": of("event").select("doc_id", "entity", "tenant", "code", "hours", "section", "formation", "pattern"),
        "sentences": of("sentence").select("doc_id", F.col("doc_type").alias("kind"), "text", "label", "code"),
        "wells": of("well").select("entity", "tenant", "rig", "tool"),
        "patterns": spark.createDataFrame(keys, "id string, tenant string, scope string, driver string, code string, section string, formation string, rig string, tool string"),
    }


def pdf_bytes(text: str, lines_per_page: int = 60) -> bytes:
    """A text as a PDF of one font; the same text gives the same bytes."""
    lines = text.split("\n")
    pages = [lines[k : k + lines_per_page] for k in range(0, len(lines), lines_per_page)]
    escape = lambda s: s.encode("cp1252", "replace").replace(b"\\", rb"\\").replace(b"(", rb"\(").replace(b")", rb"\)")
    objects = [b"<< /Type /Catalog /Pages 2 0 R >>", b"", b"<< /Type /Font /Subtype /Type1 /BaseFont /Courier /Encoding /WinAnsiEncoding >>"]
    kids = []
    for page in pages:
        shown = zlib.compress(b"BT /F1 9 Tf 36 806 Td\n" + b"\n".join(b"(" + escape(x) + b") Tj 0 -12 Td" for x in page) + b"\nET")
        kids.append(b"%d 0 R" % (len(objects) + 1))
        objects.append(b"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 595 842] /Resources << /Font << /F1 3 0 R >> >> /Contents %d 0 R >>" % (len(objects) + 2))
        objects.append(b"<< /Filter /FlateDecode /Length %d >>\nstream\n" % len(shown) + shown + b"\nendstream")
    objects[1] = b"<< /Type /Pages /Kids [" + b" ".join(kids) + b"] /Count %d >>" % len(pages)
    out, starts = b"%PDF-1.4\n", []
    for n, body in enumerate(objects, 1):
        starts.append(len(out))
        out += b"%d 0 obj\n%s\nendobj\n" % (n, body)
    table = b"".join(b"%010d 00000 n \n" % s for s in starts)
    return out + b"xref\n0 %d\n0000000000 65535 f \n%strailer\n<< /Size %d /Root 1 0 R >>\nstartxref\n%d\n%%%%EOF\n" % (len(objects) + 1, table, len(objects) + 1, len(out))
