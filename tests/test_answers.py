"""Questions, quotes, mitigations and briefs over a small workspace."""

import dataclasses

import pytest
from pyspark.sql import functions as F
from workspace import reports

from strataledger.operators import answers as A
from strataledger.operators import briefs as B
from strataledger.operators import evaluation as E
from strataledger.operators import mitigations as M
from strataledger.operators import passages as P
from strataledger.operators import patterns as PT
from strataledger.operators import verification as V
from strataledger.operators.narration import answer_text
from strataledger.plans.archive import read_reports, with_index
from strataledger.plans.planner import plan_question


@pytest.fixture(scope="module")
def archive(spark):
    docs = spark.createDataFrame([(*r, None) for r in reports()], "doc_id string, doc_type string, text string, page_ends array<int>")
    return with_index(read_reports(docs))


@pytest.fixture(scope="module")
def catalog(archive):
    return archive.catalog()


@pytest.fixture(scope="module")
def answer(archive):
    return A.ask(archive, "What rig repair was booked in the Riverbend field, and what is recommended?")


def passages(spark, text, doc_type="other"):
    docs = spark.createDataFrame([("d", doc_type, text)], "doc_id string, doc_type string, text string")
    return P.document_passages(docs).orderBy("n").collect()


def test_passages_of_a_daily_report(spark):
    text = reports()[1][2]
    found = passages(spark, text, "ddr")
    assert [p.quote for p in found if p.kind == "operations"] == [
        "06:00-18:00 Drilled ahead with steady parameters.", "18:00-06:00 Circulated and serviced the top drive.",
    ]
    assert [(p.quote, p.role) for p in found if p.kind == "remarks"] == [("Next 24 h: drill ahead.", "label"), ("Weather was fair all day.", "content")]
    assert not any("fictional" in p.quote for p in found)
    for p in found:
        assert " ".join(text[p.start : p.end].split()) == p.quote


UNITS = [
    ("A short line.\nAnd another approx. 20 bbl", ["A short line.", "And another approx. 20 bbl"]),
    ("Prose that wraps at the width of the longest line of its own\nparagraph here. It ends", ["Prose that wraps at the width of the longest line of its own paragraph here.", "It ends"]),
    ("1. one\n   more\n2) two", ["one more", "two"]),
    ("No stop here\nNext starts", ["No stop here", "Next starts"]),
    ("    deep\n  less\n   on\n  less\n- item\nanything\n  at all", ["deep", "less on", "less", "item anything at all"]),
    ('He said "stop." Then (approx. 3) it ran i.e. Fine! 4 more', ['He said "stop."', "Then (approx. 3) it ran i.e. Fine!", "4 more"]),
    ("A.\r\n\r\nTITLE (X)\r\nBody: note\r\ntext", ["A.", "TITLE (X)", "Body: note", "text"]),
    ("", []),
    ("\n \n", []),
]


def test_units_of_text(spark):
    docs = spark.createDataFrame([(str(k), "other", text) for k, (text, _) in enumerate(UNITS)], "doc_id string, doc_type string, text string")
    found = P.document_passages(docs).orderBy("doc_id", "n").collect()
    for k, (text, want) in enumerate(UNITS):
        own = [p for p in found if p.doc_id == str(k)]
        assert [p.quote for p in own] == want
        assert all(" ".join(text[p.start : p.end].split()) == p.quote for p in own)


def test_passages_need_no_python(spark):
    docs = spark.createDataFrame([("d", "ddr", "x")], "doc_id string, doc_type string, text string")
    plan = P.document_passages(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_raw_spans_and_pages(spark):
    text = "the 12¼ in hole –\n  was tight"
    assert text[slice(*P.raw_span(text, "12 1/4 in hole - was tight"))] == "12¼ in hole –\n  was tight"
    assert P.raw_span(text, "12 1/2 in") is None and P.raw_span("e\u0301a", "\u00e9a") == (0, 3)
    assert P.raw_span("abc abc", "abc", 1) == (4, 7) and P.raw_span("abc", "") is None and P.raw_span("é abc é abc", "abc", 3) == (8, 11)
    rows = [(text, "12 1/4 in hole - was", None), (text, "none", None), ("page one\npage two", "two", [8, 17]), ("page one\npage two", "one", [8, 17]), ("x", "x", None), ("a" * 5, "", [5])]
    frame = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k int, t string, q string, p array<int>")
    found = frame.select(P.quote_of("t", "q", F.lit(None).cast("string")).alias("quote"), P.page_of("t", F.col("p"), "q").alias("page"), "k").orderBy("k").collect()
    assert [r.quote for r in found] == ["12¼ in hole – was", None, "two", "one", "x", None] and [r.page for r in found] == [None, None, 2, 1, None, None]
    long = spark.createDataFrame([("word " * 100,), ("x" * 900,)], "t string").select(P.shortened("t").alias("s")).collect()
    assert long[0].s == "word " * 79 + "word" and len(long[1].s) == 400


@pytest.mark.parametrize(
    ("sentence", "kind"),
    [
        ("Hold at least 1.42 sg.", "practice"), ("Flow rate was cut to 430 gpm.", "practice"), ("There were no MWD failures above 118 C.", "practice"),
        ("The string packed off.", "failure"), ("We lost 200 bbl.", "failure"), ("Because mustard was spotted", "practice"),
        ("Runner was used", "neutral"), ("", "neutral"), ("Place the jars above the stuck point", "practice"),
    ],
)
def test_sentence_kinds(spark, sentence, kind):
    assert spark.createDataFrame([(sentence,)], "s string").select(M.sentence_kind(A.F.col("s"))).first()[0] == kind


def test_candidates_and_depth(archive, catalog):
    plan = plan_question("Instability in the Keld Salt of Riverbend field", catalog)
    ids = {r.doc_id for r in A.candidate_documents(plan, archive).collect()}
    assert ids == {"DDR-RVB-101-003", "DDR-RVB-102-003", "EOWR-RVB-101"}
    at = plan_question("what happened at 2,650 m", catalog)
    assert at.depth_filters and "DDR-RVB-101-003" in {r.doc_id for r in A.candidate_documents(at, archive).collect()}
    near = plan_question("rig repair around 2,650 m", catalog)
    ranked = {r.doc_id: r.score for r in A.depth_ranking(near, archive, None).collect()}
    assert ranked["DDR-RVB-105-002"] == 0 and ranked["DDR-RVB-101-002"] == -40 and ranked["INC-RVB-101-01"] == -40
    none = plan_question("cement issue in Riverbend", catalog)
    assert ("code", "CEMENT_ISSUE") in none.unmatched
    quiet = plan_question("lost time on MLB-108", catalog)
    assert {r.doc_id for r in A.candidate_documents(quiet, archive).collect()} == {f"DDR-MLB-108-00{k}" for k in (1, 2, 3)}


def test_search_modes(archive, catalog):
    plan = plan_question("stuck pipe while tripping", catalog)
    found = {mode: [r.doc_id for r in A.search(archive, plan, 4, mode).orderBy("rank").collect()] for mode in A.MODES}
    assert found["hybrid_filtered"] == ["DDR-MLB-107-002"] and found["bm25_only"][0] == "DDR-MLB-107-002"
    assert len(found["hashing_only"]) == len(found["hybrid_unfiltered"]) == 4
    with pytest.raises(ValueError):
        A.search(archive, plan, 4, "other")


def test_answer(answer, archive):
    f = answer["figures"]
    assert (f["event_count"], f["entity_count"], f["total_hours"], f["total_cost_usd"]) == (6, 6, 27.0, 54000.0)
    assert [s["hours"] for s in answer["figure_sources"]] == [8.0, 8.0, 8.0, 1.0, 1.0]
    texts = {r.doc_id: " ".join(r.text.split()) for r in archive.documents.collect()}
    assert answer["citations"] and all(c["quote"] in texts[c["doc_id"]] for c in answer["citations"])
    entry = "mud pump failed and its fluid end was changed out"
    assert {c["quote"] for c in answer["citations"] if c["doc_id"].startswith("DDR")} == {entry}
    heads = {g["heading"]: [m["quote"] for m in g["mitigations"]] for g in answer["mitigation_groups"]}
    assert heads[M.INCIDENT] == ["Replace the mud pump fluid end every 500 hours."] and len(heads[M.GENERAL]) == 2
    assert "6 NPT entries on 6 wells: 27.0 h" in answer["text"]
    assert V.verify(answer["text"], V.evidence_of_answer(answer), answer["question"]) == []
    assert set(V.fault_catch_rate(answer["text"], V.evidence_of_answer(answer), "ZZZ-101").values()) == {True}


def test_abstention(archive):
    found = A.ask(archive, "What happened on XYZ-999 in the Atlantis field?")
    assert found["abstained"] and found["text"] == f"{A.NO_MATCH}\nUnmatched: field Atlantis; well XYZ-999"
    empty = A.ask(archive, "stuck pipe in Riverbend")
    assert empty["abstained"] and "field Riverbend, code STUCK_PIPE" in empty["text"]


def test_mitigations_of_wells_that_avoided_it(archive, catalog):
    plan = plan_question('instability in the 12 1/4" Keld Salt', catalog)
    assert {r.entity for r in A.clean_entities(plan, archive).collect()} == {f"RVB-10{k}" for k in (3, 4, 5, 6)}
    rows, avoided = A.mitigations_for(plan, archive)
    assert avoided and [r.source for r in rows.collect()] == ["eowr"] * 2
    rows = [(9 - k, "lesson", q, f"d{k}", "e", "eowr") for k, q in enumerate(["Hold at least 1.4 sg.", "hold at least 1.4 SG", "x", "y", "z", "?", "!"])]
    found = archive.documents.sparkSession.createDataFrame(rows, "score int, kind string, quote string, doc_id string, entity string, source string")
    assert [r.quote for r in M.mined(found).orderBy("rank").collect()] == ["Hold at least 1.4 sg.", "x", "y"]
    assert [r.quote for r in M.mined(found, 9).orderBy("rank").collect()] == ["Hold at least 1.4 sg.", "x", "y", "z", "?", "!"]
    by = M.mined(found.union(found.withColumn("kind", F.lit("recommendation"))), 2, ("kind",), few=0)
    assert sorted((r.kind, r["rank"], r.quote) for r in by.collect()) == [(k, n, q) for k in ("lesson", "recommendation") for n, q in ((1, "Hold at least 1.4 sg."), (2, "x"))]


@pytest.fixture(scope="module")
def brief(archive):
    return B.build_brief(archive, "RVB-200", "Riverbend", 3500.0, tool="PJ-3")


def test_brief(brief, archive):
    by_code = {r["code"]: r for r in brief["risks"]}
    rig = by_code["RIG_REPAIR"]
    assert (rig["scope"], rig["category"], rig["events"], rig["applies"]) == ("equipment", "Rig-North", 3, "not_specified")
    assert rig["driver"] == "rig Rig-North" and rig["risk_id"] == "RIG_REPAIR-RigNorth"
    unstable = by_code["WELLBORE_INSTABILITY"]
    assert unstable["lift"] == pytest.approx(2.25) and unstable["probability"] == 0.333 and unstable["risk_id"].endswith("-1214")
    assert "averaged 1.30 sg" in unstable["driver"] and "1.45 sg" in unstable["driver"] and unstable["driver"].endswith("ran lower.")
    assert unstable["counter_examples"] == [f"RVB-10{k}" for k in (3, 4, 5, 6)]
    assert brief["unavoidable"] == {"WAIT_ON_WEATHER": 3.0} and brief["verification"]["ok"]
    assert brief["cost_usd"] == sum(r["cost_usd"] for r in brief["risks"])
    assert V.verify(brief["narrative"], V.evidence_of_brief(brief)) == []
    told = B.markdown(brief | {"provenance": B.provenance(brief, "1", "abc", "")})
    assert "| 1 | " in told and told.endswith(B.DISCLAIMER + "\n") and "NOT VERIFIED" not in told
    wrong = dict(brief, risks=[dict(rig, citations=[{"doc_id": "DDR-RVB-101-002", "quote": "never said"}, {"doc_id": "none", "quote": "x"}])])
    assert [p.split(" ", 1)[1] for p in B.verify_brief(archive.documents, wrong)["problems"]] == ["DDR-RVB-101-002 not verbatim", "none unknown document"]


def test_missing_reports(archive):
    bare = dataclasses.replace(archive, daily=archive.daily.limit(0))
    with pytest.raises(B.MissingReports):
        B.build_brief(bare, "RVB-200", "Riverbend", 3500.0)


@pytest.mark.parametrize(
    ("scope", "kind", "category", "rig", "tool", "want"),
    [
        ("interval", "", "", "Rig-1", None, "applies"), ("equipment", "rig", "Rig-North", "rig-north", None, "applies"),
        ("equipment", "rig", "Rig-North", None, "PJ-3", "not_specified"), ("equipment", "tool", "Parvane PJ-3", None, "PJ-3", "applies"),
        ("equipment", "tool", "Parvane PJ-35", None, "PJ-3", "does_not_apply"), ("equipment", "tool", "PJ-3", None, "Parvane PJ-3", "applies"),
    ],
)
def test_applies(spark, scope, kind, category, rig, tool, want):
    rows = spark.createDataFrame([(scope, kind, category)], "scope string, kind string, category string")
    assert rows.select(B.applies(rig, tool)).first()[0] == want


def test_cases_and_figures(archive, brief, spark):
    cases = E.load_cases('''
[[case]]
id = "hours"
category = "arithmetic"
question = "How many hours of rig repair in Riverbend?"
figure = "total_hours"
gold = 27.0
[[case]]
id = "silent"
category = "abstention"
question = "Anything on XYZ-999?"
gate = false
reason = "an example"
''')
    assert E.run_cases(cases, archive)["all_gates"] and E.run_cases(cases, archive)["passed"] == 2
    for bad in ('[[case]]\nid="x"\ncategory="none"', '[[case]]\nid="x"\ncategory="abstention"', '[[case]]\nid="x"\ncategory="abstention"\nquestion="q"\ngate=false'):
        with pytest.raises(E.BadCase):
            E.load_cases(bad)
    keys = [
        {"id": "G1", "code": "WELLBORE_INSTABILITY", "section": '12 1/4"', "formation": "Keld Salt", "rig": None, "tool": None, "driver": "mud_weight"},
        {"id": "G2", "code": "RIG_REPAIR", "section": None, "formation": None, "rig": "Rig-North", "tool": None, "driver": "rig"},
    ]
    assert E.brief_figures(brief["risks"], keys)["recall"] == 1.0 and all(E.driver_named(brief["risks"], k) for k in keys)
    assert E.retrieval_figures(["a", "b", "c"], ["b", "z"]) == (0.5, 0.5)
    truth = E.load_truth(spark, {"sentences": [{"doc_id": "d", "kind": "lesson", "text": "Hold  at least 1.4 sg.", "label": "practice", "code": "C", "patterns": []}]})
    quoted = spark.createDataFrame([("d", "C", "Hold at least 1.4 sg."), ("d", "C", "other")], "doc_id string, code string, quote string")
    assert tuple(E.mitigation_figures(quoted, truth["sentences"]).first()) == (0.5, 1.0)
    with pytest.raises(E.BadCase):
        E.load_truth(spark, {"wells": [{"entity": "a"}]})
    found = E.ledger_parity(archive.ledger, archive.ledger.limit(8)).first()
    assert found.recall == 1.0 and found.precision < 1
    assert E.scrubbed("at /home/me/x/y.txt", "/home/me") == "at <path>"


def test_narration_without_losses():
    assert answer_text({"figures": {"event_count": 0}, "scope": "field A", "citations": []}).startswith("No NPT entry is recorded for field A: 0.0 h")
    assert answer_text({"citations": []}) == A.NO_MATCH
    assert PT.Thresholds().min_lift == 2.0
