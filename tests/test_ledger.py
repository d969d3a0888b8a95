"""Operators of the ledger, on fixtures that can be worked out by hand, and queries against SQL."""

import datetime as dt
from collections import Counter, defaultdict
from decimal import Decimal

import duckdb
import pytest
from pyspark.sql import functions as F

from strataledger.functions import text as X
from strataledger.operators import matching as M
from strataledger.operators import patterns as P
from strataledger.operators import retrieval as R
from strataledger.plans.bindings import exposures
from strataledger.plans.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
COLUMNS = "report_id long, line int, tenant string, entity string, code string, section string, formation string, rig string, tool string, hours decimal(18,1), day date, depth double"


def ledger(spark, rows):
    return spark.createDataFrame(rows, COLUMNS)


def report(k, entity, section, rig, code=None, hours="0", formation="F"):
    return (k, 1, "Riverbend", entity, code, section, formation, rig, "T1", Decimal(hours), dt.date(2024, 1, 1), 100.0)


@pytest.fixture(scope="module")
def riverbend(spark):
    """Six entities on two rigs; four reports each in the hot section and five in the quiet one."""
    reports, k = [], 0
    for e in range(6):
        rig = "North" if e < 3 else "South"
        for section, n in (("hot", 4), ("quiet", 5)):
            for _ in range(n):
                reports.append(report(k, f"W{e}", section, rig))
                k += 1
    lost = [
        report(100, "W0", "hot", "North", "RIG_REPAIR", "8"), report(101, "W1", "hot", "North", "RIG_REPAIR", "8"),
        report(102, "W2", "hot", "North", "RIG_REPAIR", "8"), report(103, "W3", "hot", "South", "RIG_REPAIR", "1"),
        report(104, "W4", "hot", "South", "RIG_REPAIR", "1"), report(105, "W0", "hot", "North", "INSTABILITY", "6"),
        report(106, "W3", "hot", "South", "INSTABILITY", "6"), report(107, "W5", "quiet", "South", "WEATHER", "3"),
        report(108, "W1", "quiet", "North", "WEATHER", "2"),
    ]
    return ledger(spark, reports), ledger(spark, lost)


def test_statistics_by_hand(riverbend):
    reports, lost = riverbend
    rig = {(r.category, r.code): r for r in P.equipment_stats(reports, lost, "rig").collect()}
    assert rig["North", "RIG_REPAIR"].ratio == pytest.approx(12.0)
    place = {(r.section, r.code): r for r in P.interval_stats(reports, lost).collect()}
    hot = place["hot", "INSTABILITY"]
    assert (hot.lift, hot.support) == (pytest.approx(2.25), pytest.approx(1 / 3))


def test_equipment_owns_what_it_shares(riverbend):
    reports, lost = riverbend
    found = P.find_patterns(reports, lost, ["RIG_REPAIR", "INSTABILITY"], ["RIG_REPAIR"], []).collect()
    assert [(r.scope, r.code, r.total_hours, r.events) for r in found] == [
        ("equipment", "RIG_REPAIR", 26.0, 5), ("interval", "INSTABILITY", 12.0, 2)
    ]
    assert found[0].entities_affected == 3 and found[0].mean_hours == 8.0
    assert found[1].mean_hours == found[1].p90_hours == 6.0
    risk = P.risks(P.find_patterns(reports, lost, ["INSTABILITY"], [], [])).first()
    assert risk.probability == pytest.approx(1 / 3) and risk.cost_usd == 4000.0


def test_one_rig_has_nothing_to_compare_with(spark, riverbend):
    reports, lost = (d.withColumn("rig", F.lit("Only")) for d in riverbend)
    assert P.equipment_stats(reports, lost, "rig").count() == 0


def test_resolve_keeps_the_remainder():
    final, again = P.resolve(["i"], ["e"], [(("e", "i"), 1), (("e",), 5), (("i",), 3)], 0.5)
    assert final == {"e": {0, 1}, "i": {2}} and again == {"i"}
    final, again = P.resolve(["i"], ["e"], [(("e", "i"), 3), (("i",), 2)], 0.5)
    assert final == {"e": {0, 1}} and not again
    final, _ = P.resolve([], ["big", "small"], [(("big", "small"), 2), (("big",), 4), (("small",), 1)], 0.5)
    assert final == {"big": {0, 1, 2}}


def test_claims_are_absorbed_by_existence(spark):
    day = dt.date(2024, 1, 1)
    schema = "entity string, day date, code string, hours decimal(18,1)"
    recorded = spark.createDataFrame([("A", day, "X", Decimal("3.0"))], schema)
    claims = [("A", day, "X", Decimal("3.0"))] * 2 + [("A", day, "X", Decimal("3.2")), ("A", dt.date(2024, 1, 2), "X", Decimal("3.0"))]
    left = M.without_recorded(spark.createDataFrame(claims, schema), recorded).collect()
    assert sorted((str(r.day), float(r.hours)) for r in left) == [("2024-01-01", 3.2), ("2024-01-02", 3.0)]


@pytest.mark.parametrize(
    ("raw", "want"),
    [('12 1/4"', '12 1/4"'), ("8-1/2 in", '8 1/2"'), ('17.5"', '17 1/2"'), ('12.25"', '12 1/4"'), ('26"', '26"'), (" casing ", "casing"), ('9.3"', '9.3"')],
)
def test_sections(spark, raw, want):
    row = spark.range(1).select(X.canonical_section(X.normalise(F.lit(raw))).alias("s")).first()
    assert row.s == want


def test_tokens(spark):
    text = "12¼\" hole on ABC-101 at 2,684 m with 1.42 sg, the losses were 1234567"
    row = spark.range(1).select(X.tokenize(X.normalise(F.lit(text))).alias("t")).first()
    assert {"sec:12_1_4", "well:abc-101", "depth:2684", "dband:2600", "mw:1.42", "losses"} <= set(row.t)
    assert not {"the", "were", "1234567"} & set(row.t)


def test_chunks_cover_the_text():
    text = "\n\n".join("line %d " % k + "x" * 700 for k in range(20)) + "y" * 5000
    parts = R.split_text(text)
    assert "".join(p[3] for p in parts) == text
    assert all(a[2] == b[1] for a, b in zip(parts, parts[1:])) and max(len(p[3]) for p in parts) <= R.MOST
    assert R.split_text("short") == [(0, 0, 5, "short")]


def test_hashed_vectors_are_normal():
    v = R.hashed_vector("stuck pipe in the salt")
    assert (v**2).sum() == pytest.approx(1) and not R.hashed_vector("").any()
    assert v @ R.hashed_vector("stuck pipes in salt") > v @ R.hashed_vector("waiting on weather")


def test_search_prefers_what_was_asked(spark):
    rows = [("T", "d1", "d1#0", "stuck pipe in salt"), ("T", "d2", "d2#0", "waiting on weather"), ("U", "d3", "d3#0", "pipe")]
    chunks = spark.createDataFrame(rows, "tenant string, doc_id string, chunk_id string, text string").withColumn("vector", R.embed("text"))
    index = R.postings(chunks, X.word_tokens(F.col("text")), "tenant", "chunk_id")
    for mode in ("bm25", "dense", "hybrid"):
        found = R.search(chunks, index, ["stuck", "pipe"], R.hashed_vector("stuck pipe"), mode=mode).collect()
        assert {found[0].doc_id, found[1].doc_id} == {"d1", "d3"}, mode


LIGHT = ["ledger_rollup_by_code", "ledger_rollup_all", "ledger_figures", "entity_mean_p90", "interval_stats", "bm25_search", "multiset_match"]


@pytest.mark.parametrize("name", LIGHT)
def test_queries_equal_sql(spark, name):
    con = duckdb.connect()
    for t in ("region", "nation", "supplier", "part", "orders", "lineitem", "documents"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = con.execute(ORACLE_SQL[name])
    columns = [c[0] for c in want.description]
    found = QUERIES[name](spark, SF)
    assert sorted(found.columns) == sorted(columns)
    key = lambda rows: sorted(repr([float(x) if isinstance(x, int | float | Decimal) else str(x) for x in r]) for r in rows)
    ours = key(found.select(*columns).collect())
    assert ours == key(want.fetchall()) and ours


@pytest.mark.parametrize("name", ["claims_without_record", "pattern_overlap", "multiset_match"])
def test_whole_queries_equal_sql(spark, name):
    test_queries_equal_sql(spark, name)


def test_whole_queries_leave_no_report_out(spark):
    rows = exposures(spark, SF).collect()
    lost = [r for r in rows if r.is_loss]
    recorded = defaultdict(list)
    for r in lost:
        recorded[r.entity, r.day, r.code].append(r.hours)
    want = Counter()
    for r in rows:
        hours = r.hours + (Decimal(0) if r.line % 2 == 0 else Decimal("0.5"))
        if all(abs(h - hours) > Decimal("0.1") for h in recorded[r.entity, r.day, r.code]):
            want[r.report_id, r.line] += 1
    found = QUERIES["claims_without_record"](spark, SF).collect()
    assert Counter((r.claim, r.line) for r in found) == want
    assert {k % 3 for k, _ in want} == {0, 1, 2}
    sides = QUERIES["multiset_match"](spark, SF).first()
    assert sides.matched + sides.missed == sides.matched + sides.invented == len(lost)
    shared = QUERIES["pattern_overlap"](spark, SF).collect()
    same = Counter((r.tenant, r.code, r.report_id, r.line) for r in lost)
    assert sum(r.shared for r in shared) == sum(n * n for n in same.values())
