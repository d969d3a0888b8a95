"""Whether what an answer says is in its evidence: citations, numbers and names."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CITED = r"\[([A-Za-z0-9._#-]+)\]"
NUMBER = r"(?<![\w.])(\d[\d,]*(?:\.\d+)?)"


def cited_ids(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(CITED), F.lit(1)))


def numbers(text: Column) -> Column:
    """Numbers of a text outside its citations, as they are written."""
    return F.regexp_extract_all(F.regexp_replace(text, CITED, " "), F.lit(NUMBER), F.lit(1))


def unknown_citations(answers: DataFrame, evidence: DataFrame) -> DataFrame:
    """``answer_id, cited`` of ids that the evidence (``answer_id, doc_id``) lacks."""
    cited = answers.select("answer_id", F.explode(cited_ids(F.col("text"))).alias("cited"))
    return cited.join(evidence.select("answer_id", F.col("doc_id").alias("cited")), ["answer_id", "cited"], "left_anti")


def unknown_numbers(answers: DataFrame, evidence: DataFrame) -> DataFrame:
    """``answer_id, written`` of numbers that no value of the evidence (``answer_id, value``) rounds to.

    A number is compared at the precision at which it is written.
    """
    said = answers.select("answer_id", F.explode(numbers(F.col("text"))).alias("written"))
    digits = F.length(F.regexp_extract("written", r"\.(\d+)$", 1))
    said = said.withColumn("x", F.regexp_replace("written", ",", "").cast("double")).withColumn("step", F.pow(F.lit(10.0), -digits))
    near = F.abs(F.col("x") - F.col("value")) <= F.col("step") / 2 + 1e-9
    known = evidence.select(F.col("answer_id").alias("e_id"), "value")
    return said.join(known, (F.col("answer_id") == F.col("e_id")) & near, "left_anti").select("answer_id", "written")


def verdicts(answers: DataFrame, documents: DataFrame, values: DataFrame) -> DataFrame:
    """``answer_id, verified``: nothing unknown is cited or stated, and something is said."""
    bad = unknown_citations(answers, documents).select("answer_id")
    bad = bad.union(unknown_numbers(answers, values).select("answer_id")).distinct().withColumn("bad", F.lit(True))
    said = F.length(F.trim(F.coalesce("text", F.lit("")))) > 0
    return answers.join(bad, "answer_id", "left").select("answer_id", (F.col("bad").isNull() & said).alias("verified"))


# --- one answer or brief: everything its text may name or state, on the driver --------------------------------------

# Layouts of citations, document ids, names, dates, hole sizes and formatted numbers.
LAYOUTS = {
    "citation": r"\[[A-Za-z0-9_\-]+\]",
    "document": r"\b[A-Z]{2,5}-[A-Z]{2,5}-\d{2,4}(?:-\d{2,4})?\b",
    "date": r"\b\d{4}-\d{2}-\d{2}\b",
    "entity": r"\b[A-Z]{2,5}-\d{2,4}\b",
    "size": r"""(?i:\d+(?:\.\d+)?(?:[\s-]\d+/\d+)?\s*(?:"|in\.?\b|¼|½|¾|⅛|⅜|⅝|⅞))""",
}
NOT_NUMBERS = re.compile("|".join(LAYOUTS[k] for k in ("citation", "date", "document", "entity", "size")))
AMOUNT = re.compile(r"(?<![A-Za-z0-9])(?P<dollar>\$)?\s?(?P<digits>\d[\d,]*(?:\.\d+)?)(?:\s?(?P<unit>M\b|%|h\b))?", re.I)
FAULTS = ("quote_char", "id_outside_pack", "untraceable_number", "foreign_well")


@dataclass(frozen=True)
class Evidence:
    """What a text may cite, name and state."""

    doc_ids: frozenset[str] = frozenset()
    entities: frozenset[str] = frozenset()
    tenants: frozenset[str] = frozenset()
    values: tuple[float, ...] = ()


def meanings(m: re.Match) -> list[tuple[float, float]]:
    """What a formatted number may be, each with the step of its last digit: a percentage is a share too."""
    digits = m["digits"].replace(",", "").rstrip(".")
    step, unit = 10.0 ** -len(digits.partition(".")[2]), (m["unit"] or "").lower()
    scales = (1e6,) if m["dollar"] and unit == "m" else (1.0, 0.01) if unit == "%" else (1.0,)
    return [(float(digits) * s, step * s) for s in scales]


def amounts(text: str | None) -> list[re.Match]:
    """Formatted numbers of a text that are no part of a citation, an id, a name, a date or a hole size."""
    return list(AMOUNT.finditer(NOT_NUMBERS.sub(lambda m: " " * len(m[0]), text or "")))


def traced(found: list[tuple[float, float]], values: Iterable[float]) -> bool:
    """Whether a value shows as the number at the number's own precision."""
    return any(round(v / step) == round(x / step) for x, step in found for v in values)


def leaves(value, key: str = "") -> Iterator[tuple[str, object]]:
    """Plain values below a structure with their keys; of each list its length too."""
    if isinstance(value, Mapping):
        for k, v in value.items():
            yield from leaves(v, k)
    elif isinstance(value, list | tuple):
        yield "", float(len(value))
        for v in value:
            yield from leaves(v, key)
    else:
        yield key, value


def evidence_of(structure, quotes: Iterable[str], doc_ids: Iterable[str], entities: Iterable[str] = (), tenants: Iterable[str] = ()) -> Evidence:
    """Numbers of a structure and of quotes; names under ``entity`` and ``tenant`` keys, and entities that quotes mention."""
    found, texts = list(leaves(structure)), [q for q in quotes if q]
    named = lambda kind: {v for k, v in found if k == kind and isinstance(v, str) and v}
    values = [float(v) for _, v in found if isinstance(v, int | float) and not isinstance(v, bool)]
    values += [x for t in texts for m in amounts(t) for x, _ in meanings(m)]
    mentioned = {e for t in texts for e in re.findall(LAYOUTS["entity"], t)}
    return Evidence(frozenset(doc_ids), frozenset({*entities, *named("entity"), *mentioned}), frozenset({*tenants, *named("tenant")}), tuple(values))


def evidence_of_answer(answer: Mapping) -> Evidence:
    """What the text of ``answers.ask`` may draw on."""
    cites, told = answer.get("citations", []), [m for g in answer.get("mitigation_groups", []) for m in g["mitigations"]]
    shown = {k: answer.get(k) for k in ("figures", "figure_sources", "report_count", "mitigation_groups")}
    quotes = [c["quote"] for c in cites] + [m["quote"] for m in told]
    return evidence_of(shown, quotes, {c["doc_id"] for c in cites}, {c["entity"] for c in cites}, {c["tenant"] for c in cites})


def evidence_of_brief(brief: Mapping) -> Evidence:
    """What the narrative of ``briefs.build_brief`` may draw on: no thresholds, but the sum of background hours."""
    shown = {k: brief[k] for k in ("risks", "expected_hours", "cost_usd", "unavoidable", "planned_depth", "spread_rate", "n_offsets")}
    cites = [c for r in brief["risks"] for c in r["citations"]]
    offsets = {e for r in brief["risks"] for e in r["counter_examples"]}
    shown["background"] = sum(brief["unavoidable"].values())
    quotes = [c["quote"] for c in cites] + [r["driver"] for r in brief["risks"]]
    return evidence_of(shown, quotes, {c["doc_id"] for c in cites}, {brief["entity"], *offsets}, {brief["tenant"]})


def verify(text: str, evidence: Evidence, question: str = "", known_tenants: Iterable[str] = ()) -> list[str]:
    """Why a text fails: what it cites, states or names beyond its evidence. Numbers of the question are free."""
    if not (text or "").strip():
        return ["empty reply"]
    asked = [x for m in amounts(question) for x, _ in meanings(m)]
    cited = set(re.findall(CITED, text))
    plain = re.sub(LAYOUTS["citation"], " ", text)
    named = set(re.findall(LAYOUTS["entity"], re.sub(LAYOUTS["document"], " ", plain)))
    return [
        *(f"cites a document outside the evidence: {c}" for c in sorted(cited - evidence.doc_ids)),
        *(f"states a number without a source: {m[0].strip()}" for m in amounts(text) if not traced(meanings(m), (*evidence.values, *asked))),
        *(f"names a well outside the evidence: {e}" for e in sorted(named - evidence.entities)),
        *(f"names a field outside the evidence: {t}" for t in sorted(known_tenants) if t not in evidence.tenants and re.search(rf"\b{re.escape(t)}\b", text)),
    ]


def with_fault(text: str, evidence: Evidence, kind: str, foreign_id: str = "ZZZ-999", foreign_entity: str = "") -> str | None:
    """A verified text made wrong in one way; None where it offers nothing to change."""
    if kind == "id_outside_pack":
        return f"{text.rstrip()} [{foreign_id}]"
    if kind == "untraceable_number":
        return f"{text.rstrip()} A further {max((*evidence.values, 0.0)) + 12_345.67:.1f} h were also recorded."
    if kind == "foreign_well":
        return f"{text.rstrip()} This also affected {foreign_entity}." if foreign_entity else None
    if kind != "quote_char":
        raise ValueError(f"unknown fault: {kind}")
    for m in amounts(text):  # raise one digit, the last first, so that the number has no source
        for at in range(m.end("digits") - 1, m.start("digits") - 1, -1):
            if text[at].isdigit():
                changed = f"{text[:at]}{(int(text[at]) + 1) % 10}{text[at + 1 :]}"
                again = AMOUNT.match(changed, m.start())
                if again and not traced(meanings(again), evidence.values):
                    return changed
    return None


def fault_catch_rate(text: str, evidence: Evidence, foreign_entity: str = "") -> dict[str, bool | None]:
    """Whether each kind of fault is caught; None where it cannot be made."""
    faults = {kind: with_fault(text, evidence, kind, foreign_entity=foreign_entity) for kind in FAULTS}
    return {kind: None if changed is None else bool(verify(changed, evidence)) for kind, changed in faults.items()}
