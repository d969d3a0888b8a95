"""The question planner, DOCX text and checks of answers."""

import io
import zipfile

import pytest

from strataledger.operators import verification as V
from strataledger.plans.planner import find_depth, find_sections, plan_question
from strataledger.sources.docx import NS, UnreadableDocument, document_text

CATALOG = {"tenant": ["Riverbend", "Millbrook"], "entity": ["RVB-101", "MLB-7"], "formation": ["Riverbend Salt", "Shale"]}


@pytest.mark.parametrize(
    ("question", "want"),
    [
        ("How many hours of packed-off pipe in Millbrook?", {"codes": ["STUCK_PIPE"], "tenants": ["Millbrook"]}),
        ("Losses and MWD failures on rvb-101", {"codes": ["LOST_CIRCULATION", "DOWNHOLE_TOOL_FAILURE"], "entities": ["RVB-101"]}),
        ("What of RVB-999 in the Atlantis field?", {"unmatched": [("field", "Atlantis"), ("well", "RVB-999")]}),
        ("instability in the Riverbend Salt", {"formations": ["Riverbend Salt"], "tenants": []}),
        ("What happened in the Shale field interval?", {"formations": ["Shale"], "tenants": [], "unmatched": []}),
        ("Lessons on lost time in Millbrook field", {"kinds": ["eowr"], "lost_time": True, "tenants": ["Millbrook"]}),
        ("Salt in the Keldra Dolomite", {"unmatched": [("formation", "Keldra Dolomite")]}),
        ("Top-10 of covid-19, XYZ-101", {"entities": ["XYZ-101"], "unmatched": [("well", "XYZ-101")]}),
        ("daily reports at 2,650 m", {"depth": 2650.0, "depth_filters": True, "kinds": ["ddr"]}),
    ],
)
def test_plans(question, want):
    plan = plan_question(question, CATALOG)
    assert {k: getattr(plan, k) for k in want} == want


def test_plan_becomes_a_filter():
    got = plan_question("stuck pipe at 50 m or at 150 m in the 8½″ hole", CATALOG).ledger_filter()
    assert got == {"where": {"code": ["STUCK_PIPE"], "section": ['8 1/2"']}, "depth_min": 50.0, "depth_max": 250.0}


def test_sizes_and_depths():
    assert find_sections('12 1/4" and 17.5 in and 8-1/2 inch, below 9 5/8" casing, 26"')[0] == ['12 1/4"', '17 1/2"', '8 1/2"', '26"']
    assert find_sections('2 in 10 wells, 6" hole, 5" drill pipe, 9" mud', ['12 1/4"']) == (['6"'], ['6"'])
    assert find_depth("around 2650 m") == (2650.0, False) and find_depth("2650 bar") == (None, False)


def docx(xml: str) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as archive:
        archive.writestr("word/document.xml", xml)
    return out.getvalue()


def test_docx():
    space = NS.strip("{}")
    p = lambda t: f"<w:p><w:r><w:t>{t}</w:t></w:r></w:p>"
    table = f"<w:tbl><w:tr><w:tc>{p('a')}</w:tc><w:tc>{p('b')}</w:tc></w:tr></w:tbl>"
    xml = f'<w:document xmlns:w="{space}"><w:body>{p("one")}{table}{p("two")}</w:body></w:document>'
    assert document_text(docx(xml)) == "one\na | b\ntwo"
    for bad in (b"nothing", docx("<!DOCTYPE x>" + xml), docx("<w:document")):
        with pytest.raises(UnreadableDocument):
            document_text(bad)


def test_answers_are_checked(spark):
    answers = spark.createDataFrame(
        [(1, "Lost 12.3 h [d1]"), (2, "Lost 13.0 h [d1]"), (3, "Lost 12 h [d9]"), (4, " "), (5, "About 1,234 [d1]")], "answer_id int, text string"
    )
    documents = spark.createDataFrame([(k, "d1") for k in range(1, 6)], "answer_id int, doc_id string")
    values = spark.createDataFrame([(k, v) for k in range(1, 6) for v in (12.34, 1234.4)], "answer_id int, value double")
    got = {r.answer_id: r.verified for r in V.verdicts(answers, documents, values).collect()}
    assert got == {1: True, 2: False, 3: False, 4: False, 5: True}
