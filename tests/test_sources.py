"""Reports and ledgers from files, as a folder scan finds them."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from strataledger.sources import folder, ledger_csv, reports

DAILY = """DAILY DRILLING REPORT

Operator: Acme  Field: Riverbend  Well: RVB-101
Rig: North-1  Report No: 7  Date: 2024-03-05

Depth at start : 2,000 m
Depth at end   : 2,150.5 m
Hole section   : 12¼"
Formation at TD: Salt (upper)
Weight         : 1.42 sg
ECD            : -
MWD            : PJ-3
Flow           : 3,000 lpm / 800 gpm

NPT DETAIL
  Code: stuck-pipe
  Hours: 3.5 h
  Depth: 2,100 m
  Formation: Shale (lower)
  Description: pulled tight
    at the shoe
  Code: SP2
  Hours: 2
  Description: waited
  Code: RIG_REPAIR

REMARKS
  Code: FISHING
""" + reports.FOOTER + "\nCode: FISHING\nHours: 9\n"
FINAL = "END OF WELL REPORT\nOperator: Acme  Field: Riverbend  Well: RVB-101\nDays on well: 30\nTotal depth: 3,000 m\n\n2. LESSONS LEARNED\n1. Keep the\n   weight up.\n2. Test early.\n\n1. NPT BREAKDOWN BY CODE\nSTUCK_PIPE   5.5 h\n\nRECOMMENDATIONS FOR FUTURE WELLS\n- Use LCM\n* Wait less\n"
INCIDENT = 'WELL OPERATIONS INCIDENT REPORT\nClassification: LOST_CIRCULATION  Lost time: 12.5 h\nDepth: 1,940 m MD  Hole section: 8 1/2"  Formation: Sand\nSeverity: High\nROOT CAUSE\nToo much\nweight.\nCORRECTIVE ACTIONS\n- Lower it\n'


@pytest.fixture(scope="module")
def found(spark, tmp_path_factory):
    top = tmp_path_factory.mktemp("reports")
    (top / "a.txt").write_bytes(b"\xef\xbb\xbf" + DAILY.replace("\n", "\r\n").encode())
    (top / "EOWR-1.md").write_text(FINAL)
    (top / "inc.txt").write_text(INCIDENT)
    (top / "bad.txt").write_bytes(b"caf\xe9")
    (top / "x.pdf").write_bytes(b"%PDF")
    (top / "_skip.txt").write_text("no")
    (top / "DDR-9.txt").write_text("plain")
    return folder.texts(folder.scan(spark, str(top))).cache()


def test_folder(spark, found):
    kinds = {r["name"]: (r.doc_type, r.status, r.reason) for r in found.collect()}
    assert kinds == {
        "a.txt": ("ddr", "ingested", None), "EOWR-1.md": ("eowr", "ingested", None), "inc.txt": ("incident", "ingested", None),
        "bad.txt": (None, "skipped", "not UTF-8"), "x.pdf": (None, "skipped", "not a PDF file"), "DDR-9.txt": ("ddr", "ingested", None),
    }
    manifest = found.select("path", "sha256", "status")
    assert folder.changed(found, manifest).count() == 2
    assert folder.gone(found.limit(0), manifest).count() == 6
    assert folder.coverage(found).agg(F.sum("n_files")).first()[0] == 6


def test_daily_report(found):
    template = reports.Template(aliases={"SP2": "STUCK_PIPE"})
    daily = reports.daily_reports(found.where("doc_id = 'a'").select("doc_id", "text"), template)
    r = daily.first()
    assert (r.tenant, r.entity, r.rig, r.day, r.report_no) == ("Riverbend", "RVB-101", "North-1", dt.date(2024, 3, 5), 7)
    assert (r.depth_end, r.section, r.formation, r.mud_weight, r.ecd, r.tool, r.flow) == (2150.5, '12 1/4"', "Salt", 1.42, None, "PJ-3", 800.0)
    rows = reports.loss_rows(daily, template).orderBy("event_ord").collect()
    assert [(e.code, float(e.hours), e.depth, e.formation, e.description) for e in rows] == [
        ("STUCK_PIPE", 3.5, 2100.0, "Shale", "pulled tight at the shoe"), ("STUCK_PIPE", 2.0, 2150.5, "Salt", "waited")
    ]


def test_final_and_incident_reports(found):
    r = reports.final_reports(found.where("doc_id = 'EOWR-1'").select("doc_id", "text")).first()
    assert (r.days_on_well, r.total_depth, r.lessons) == (30.0, 3000.0, ["Keep the weight up.", "Test early."])
    assert r.recommendations == ["Use LCM", "Wait less"] and [tuple(x) for x in r.by_code] == [("STUCK_PIPE", 5.5)]
    r = reports.incident_reports(found.where("doc_id = 'inc'").select("doc_id", "text")).first()
    assert (r.code, float(r.hours), r.depth, r.section, r.formation) == ("LOST_CIRCULATION", 12.5, 1940.0, '8 1/2"', "Sand")
    assert (r.severity, r.root_cause, r.actions) == ("High", "Too much weight.", ["Lower it"])


def test_templates_are_checked():
    with pytest.raises(ValueError):
        reports.Template(labels={"nonsense": "x"})
    with pytest.raises(ValueError):
        reports.Template(aliases={"SP": "NO_SUCH_CODE"})


LEDGER = 'sep=;\nBohrung;Datum;Code;Stunden;Tiefe;Text\nA-1;05.03.2024;SP;1,5 h;1 200 m;"two\nlines; ""q"""\nA-2;05.03.2024;SP;;;\nA-3;32.03.2024;SP;1;;\nA-4;06.03.2024;SP;1,250;-5;x\nA-5;06.03.2024;SP;1;;"open\nA-6;07.03.2024;SP;2;;\nA-7;07.03.2024;SP;2;;x;y\n'


def test_csv_ledger(spark):
    columns = {"well": "Bohrung", "date": "datum", "hours": " Stunden ", "depth": "Tiefe", "description": "Text"}
    files = spark.createDataFrame([("f", bytearray(LEDGER.encode())), ("g", bytearray(b"a,b\n1,2\n"))], "path string, content binary")
    rows = {(r.path, r.line): r for r in ledger_csv.read_ledgers(files, columns, "%d.%m.%Y").collect()}
    good = rows["f", 3]
    assert (good.entity, good.day, good.hours, good.depth, good.description) == ("A-1", dt.date(2024, 3, 5), 1.5, 1200.0, 'two\nlines; "q"')
    assert rows["f", 5].error == "no value for hours" and "32.03.2024" in rows["f", 6].error
    assert rows["f", 7].hours == 1.25 and rows["f", 7].warning
    assert rows["f", 8].error == "a quote is not closed" and rows["f", 9].entity == "A-6" and rows["f", 10].error == "too many values"
    assert rows["g", 1].error
    with pytest.raises(ValueError):
        ledger_csv.hours_of("1,250", ",")
    for bad in ({"nope": "x"}, {"well": "a", "code": "A"}):
        with pytest.raises(ValueError):
            ledger_csv.check_mapping(bad, None)
    with pytest.raises(ValueError):
        ledger_csv.check_mapping({}, "%d.%m")
