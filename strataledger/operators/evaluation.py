"""Measures of answers against truth."""

from __future__ import annotations

import re
import tomllib
from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: What a figure may differ by from its gold value.
TOLERANCE = {"hours": 0.05, "usd": 1.0, "share": 0.001}


def precision_and_rank(ranked: DataFrame, good: Column, k: int) -> DataFrame:
    """Precision of the first ``k`` and the reciprocal rank of the first good one: ``case_id, item, score`` in."""
    rank = F.row_number().over(W.partitionBy("case_id").orderBy(F.col("score").desc(), "item"))
    top = ranked.withColumn("k", rank).where(F.col("k") <= k).withColumn("good", good)
    return top.groupBy("case_id").agg(
        (F.count_if("good") / k).alias("precision_at_8" if k == 8 else f"precision_at_{k}"),
        F.coalesce(1.0 / F.min(F.when(F.col("good"), F.col("k"))), F.lit(0.0)).alias("reciprocal_rank"),
    )


def within(value: Column, gold: Column, tolerance: float) -> Column:
    """Equality within a tolerance that rounding of the difference can't break."""
    return F.abs(value - gold) <= tolerance + 1e-9


def confusion_counts(rows: DataFrame) -> DataFrame:
    """``truth, predicted, n``."""
    return rows.groupBy("truth", "predicted").agg(F.count("*").alias("n"))


def scores(confusion: DataFrame, positive) -> DataFrame:
    """Accuracy, precision and recall of one class."""
    n = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    truth, predicted = F.col("truth") == positive, F.col("predicted") == positive
    rate = lambda part, whole: F.when(whole > 0, part / whole).otherwise(F.lit(0.0))
    return confusion.agg(
        rate(n(F.col("truth") == F.col("predicted")), F.sum("n")).alias("accuracy"),
        rate(n(truth & predicted), n(predicted)).alias("precision"),
        rate(n(truth & predicted), n(truth)).alias("recall"),
    )


# --- a workspace against what is known of it -------------------------------------------------------------------------

# What cases are asked for, and the shares that pass.
RETRIEVAL_K, MIN_PRECISION = 8, 0.5
#: Parameters of each category of cases: those needed, and those allowed besides, with their types.
CATEGORIES: dict[str, tuple[dict[str, type | tuple], dict[str, type | tuple]]] = {
    "retrieval-precision": ({"question": str, "tenant": str, "relevant": list}, {}),
    "arithmetic": ({"question": str, "figure": str, "gold": (int, float)}, {"spread_rate": (int, float)}),
    "abstention": ({"question": str}, {}),
    "grounding": ({"question": str}, {}),
    "brief-recall": ({"tenant": str, "entity": str, "planned_depth": (int, float), "pattern": str}, {}),
    "verifier-faults": ({"question": str}, {}),
}
TRUTH = {
    "wells": "entity string, tenant string, rig string, tool string",
    "docs": "doc_id string, doc_type string, tenant string, entity string",
    "events": "doc_id string, entity string, tenant string, code string, hours double, section string, formation string, pattern string",
    "sentences": "doc_id string, kind string, text string, label string, code string, patterns array<string>",
    "patterns": "id string, tenant string, scope string, driver string, code string, section string, formation string, rig string, tool string",
}
LABELS, STATUSES = ("practice", "failure", "neutral"), ("affected", "clean", "out_of_scope")


class BadCase(ValueError):
    pass


def load_truth(spark, sidecar: Mapping[str, list[dict]]) -> dict[str, DataFrame]:
    """Tables of a truth sidecar; a row without one of its columns, or with an unknown label, is an error, never a null."""
    out = {}
    for name, ddl in TRUTH.items():
        columns = [c.split()[0] for c in ddl.split(", ")]
        rows = sidecar.get(name, [])
        for row in rows:
            if missing := sorted(set(columns) - set(row)):
                raise BadCase(f"{name}: missing {missing[0]}")
            if name == "sentences" and row["label"] not in LABELS:
                raise BadCase(f"{name}: unknown label {row['label']}")
        out[name] = spark.createDataFrame([tuple(r[c] for c in columns) for r in rows], ddl)
    return out


def load_cases(text: str) -> list[dict]:
    """Cases of a TOML file: ``id, category`` and the parameters of the category; a case that is no gate says why."""
    cases, seen = tomllib.loads(text).get("case", []), set()
    for case in cases:
        where, own = case.get("id", "?"), {k: v for k, v in case.items() if k not in ("id", "category", "gate", "reason")}
        if not case.get("id") or where in seen or case.get("category") not in CATEGORIES:
            raise BadCase(f"{where}: needs an id of its own and a known category")
        seen.add(where)
        needed, allowed = CATEGORIES[case["category"]]
        if set(needed) - set(own) or set(own) - set(needed) - set(allowed):
            raise BadCase(f"{where}: needs {sorted(needed)}, not {sorted(own)}")
        for key, value in own.items():
            if isinstance(value, bool) or not isinstance(value, (needed | allowed)[key]) or value in ("", []):
                raise BadCase(f"{where}: {key} has the wrong type or is empty")
        if case.get("gate", True) == bool(case.get("reason")):
            raise BadCase(f"{where}: a reason goes with gate = false, and only with it")
    return cases


def retrieval_figures(ranking: list[str], relevant: Iterable[str], k: int = RETRIEVAL_K) -> tuple[float, float]:
    """Precision among the first ``k`` (or as many as are relevant), and the reciprocal rank of the first good one."""
    good, top = set(relevant), ranking[:k]
    first = next((n for n, d in enumerate(top, 1) if d in good), None)
    return sum(d in good for d in top) / max(1, min(k, len(good))), 1 / first if first else 0.0


def names_category(value: str | None, wanted: str | None) -> bool:
    return bool(value and wanted and re.search(rf"(?<![\w-]){re.escape(wanted)}(?![\w-])", value))


def risk_matches(risk: Mapping, key: Mapping) -> bool:
    """Whether a listed risk is a planted one: code and rig, code and tool (or an interval of its section), or code and place."""
    if risk["code"] != key["code"]:
        return False
    own = {risk["kind"]: risk["category"]} if risk["scope"] == "equipment" else {}
    if key.get("rig"):
        return names_category(own.get("rig"), key["rig"])
    if key.get("tool"):
        return names_category(own.get("tool"), key["tool"]) or (risk["scope"] == "interval" and risk["section"] == key["section"])
    return risk["scope"] == "interval" and (risk["section"], risk["formation"]) == (key["section"], key["formation"])


def brief_figures(risks: list[Mapping], keys: list[Mapping]) -> dict[str, float]:
    """Shares of listed risks that are planted, and of planted ones that are listed."""
    planted = sum(any(risk_matches(r, k) for k in keys) for r in risks)
    listed = sum(any(risk_matches(r, k) for r in risks) for k in keys)
    return {"precision": planted / len(risks) if risks else 0.0, "recall": listed / len(keys) if keys else 0.0}


def driver_named(risks: list[Mapping], key: Mapping) -> bool:
    """Whether the first risk that matches names the driver that the truth gives."""
    first = next((r for r in risks if risk_matches(r, key)), None)
    if first is None:
        return False
    said, wanted = first["driver"] or "", key["driver"]
    return "mud weight" in said.lower() if wanted == "mud_weight" else names_category(said, key[wanted])


def mitigation_figures(quoted: DataFrame, sentences: DataFrame) -> DataFrame:
    """``precision, recall`` of quotes ``doc_id, code, quote``: contained in a practice sentence of their document on
    their code; and the share of such sentences that are quoted."""
    squeezed = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))
    truth = sentences.where(F.col("label") == "practice").select(
        F.col("doc_id").alias("t_doc"), F.col("code").alias("t_code"), squeezed("text").alias("sentence")
    )
    same = (F.col("doc_id") == F.col("t_doc")) & (F.col("code") == F.col("t_code")) & F.contains("sentence", squeezed("quote"))
    said = quoted.select("doc_id", "code", "quote").distinct()
    right = said.join(truth, same, "left_semi").count
    n, m = said.count(), truth.count()
    found = truth.join(said, same, "left_semi").count() if m else 0
    spark = quoted.sparkSession
    return spark.createDataFrame([(right() / n if n else 0.0, found / m if m else 0.0)], "precision double, recall double")


def true_clean_entities(truth: Mapping[str, DataFrame], daily: DataFrame, key: Mapping) -> DataFrame:
    """Entities that avoided a planted pattern by the true events: exposed at its place, or of other equipment."""
    events = truth["events"].where((F.col("tenant") == key["tenant"]) & (F.col("code") == key["code"]))
    kind = "rig" if key.get("rig") else "tool" if key.get("tool") else None
    if kind:
        own = truth["wells"].where((F.col("tenant") == key["tenant"]) & ~F.coalesce(F.col(kind) == key[kind], F.lit(False))).select("entity")
        had = events.where(F.col("pattern") == key["id"])
    else:
        place = (F.col("section") == key["section"]) & (F.col("formation") == key["formation"])
        own, had = daily.where((F.col("tenant") == key["tenant"]) & place).select("entity").distinct(), events.where(place)
    return own.join(had.select("entity"), "entity", "left_anti")


def ledger_parity(found: DataFrame, truth: DataFrame) -> DataFrame:
    """Precision and recall of parsed losses against true ones, equal rows one to one: ``doc_id, code, hours``."""
    from strataledger.operators.matching import multiset_match

    keyed = lambda d: d.select("doc_id", "code", F.round(F.col("hours").cast("double"), 1).alias("hours"))
    counts = multiset_match(keyed(found), keyed(truth), ["doc_id", "code", "hours"])
    rate = lambda other: F.when(F.col("matched") + other > 0, F.col("matched") / (F.col("matched") + other)).otherwise(0.0)
    return counts.select("matched", "missed", "invented", rate(F.col("invented")).alias("precision"), rate(F.col("missed")).alias("recall"))


def citation_stats(citations: DataFrame, documents: DataFrame) -> DataFrame:
    """``suite, checked, verbatim`` of citations ``suite, doc_id, quote``."""
    from strataledger.operators.matching import is_verbatim

    joined = citations.join(documents.select("doc_id", "text"), "doc_id", "left")
    verbatim = F.count_if(F.coalesce(is_verbatim(F.col("text"), F.col("quote")), F.lit(False)))
    return joined.groupBy("suite").agg(F.count("*").alias("checked"), verbatim.alias("verbatim"))


def check(case: Mapping, archive, keys: Iterable[Mapping] = ()) -> tuple[bool, str]:
    """Run one case: whether it passes, and what was seen."""
    from strataledger.operators import answers, briefs, verification
    from strataledger.plans.planner import plan_question

    kind = case["category"]
    if kind == "brief-recall":
        brief = briefs.build_brief(archive, case["entity"], case["tenant"], case["planned_depth"])
        wanted = [k for k in keys if k["id"] == case["pattern"]]
        return brief_figures(brief["risks"], wanted)["recall"] == 1.0, f"{len(brief['risks'])} risks"
    if kind == "retrieval-precision":
        plan = plan_question(case["question"], archive.catalog())
        ranking = [r.doc_id for r in answers.search(archive, plan, RETRIEVAL_K).orderBy("rank").collect()]
        precision, reciprocal = retrieval_figures(ranking, case["relevant"])
        foreign = archive.documents.where(F.col("doc_id").isin(ranking) & (F.col("tenant") != case["tenant"])).count()
        return precision >= MIN_PRECISION and not foreign, f"P@8 {precision:.2f}, MRR@8 {reciprocal:.2f}, {foreign} foreign"
    answer = answers.ask(archive, case["question"], rate=float(case.get("spread_rate", 48_000.0)))
    if kind == "arithmetic":
        got = (answer.get("figures") or {}).get(case["figure"])
        near = TOLERANCE["hours" if "hours" in case["figure"] else "usd" if "usd" in case["figure"] else "share"]
        return got is not None and abs(got - case["gold"]) <= near + 1e-9, f"{got} for {case['gold']}"
    if kind == "abstention":
        silent = answer["abstained"] and not answer.get("figures") and not answer.get("citations")
        return silent and answers.NO_MATCH in answer["text"].splitlines(), answer["text"][:80]
    if kind == "verifier-faults":
        caught = verification.fault_catch_rate(answer["text"], verification.evidence_of_answer(answer), "ZZZ-101")
        return any(caught.values()) and False not in caught.values(), str(caught)
    spark = archive.documents.sparkSession
    rows = [("grounding", c["doc_id"], c["quote"]) for c in answer.get("citations", [])]
    stats = citation_stats(spark.createDataFrame(rows, "suite string, doc_id string, quote string"), archive.documents).first()
    return bool(stats) and stats.checked == stats.verbatim, f"{stats.verbatim if stats else 0} of {len(rows)} verbatim"


def run_cases(cases: list[dict], archive, keys: Iterable[Mapping] = ()) -> dict:
    """Results of all cases, and counts; a case that fails to run has failed."""
    rows = []
    for case in cases:
        try:
            passed, detail = check(case, archive, keys)
        except Exception as error:  # the other cases still count
            passed, detail = False, f"error: {type(error).__name__}: {error}"
        rows.append({"id": case["id"], "category": case["category"], "gate": case.get("gate", True), "passed": passed, "detail": detail})
    gates = [r for r in rows if r["gate"]]
    return {"results": rows, "passed": sum(r["passed"] for r in rows), "cases": len(rows), "all_gates": all(r["passed"] for r in gates)}


def ablation(archive, questions: Mapping[str, Iterable[str]]) -> list[dict]:
    """Mean precision and reciprocal rank of every retrieval mode over questions with their relevant documents."""
    from strataledger.operators import answers
    from strataledger.plans.planner import plan_question

    catalog, out = archive.catalog(), []
    for mode in answers.MODES:
        found = []
        for question, relevant in questions.items():
            ranking = answers.search(archive, plan_question(question, catalog), RETRIEVAL_K, mode).orderBy("rank").collect()
            found.append(retrieval_figures([r.doc_id for r in ranking], relevant))
        n = max(1, len(found))
        out.append({"mode": mode, "precision": sum(p for p, _ in found) / n, "reciprocal_rank": sum(r for _, r in found) / n})
    return out


def scrubbed(text: str, home: str) -> str:
    """Results without paths of the machine that made them."""
    return re.sub(rf"{re.escape(home)}[^\s\"']*|/(?:tmp|private|var)/[^\s\"']*", "<path>", text)
