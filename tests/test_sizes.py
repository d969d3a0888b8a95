"""What only shows on tables of more rows than the driver's: results by size, and work that must not grow with a group."""

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from strataledger.operators import digests as D
from strataledger.operators import passages as PA
from strataledger.operators import patterns as P
from strataledger.operators import search_index as SI
from strataledger.operators import temporal as TM
from strataledger.plans import queries as Q
from strataledger.plans import report_queries as RQ
from strataledger.sources import ledger_csv as LC
from strataledger.sources import tables as TB

SMALL = "/root/testdata/sf0.001"


def oracle(name, sf_dir):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for table in ("customer", "documents", "lineitem", "nation", "orders", "part", "region", "supplier"):
        con.execute(f"create view {table} as select * from read_parquet('{sf_dir}/{table}.parquet')")
    return con.execute(Q.ORACLE_SQL[name]).fetchall()


def test_the_corpus_hash_keeps_its_leaves_whatever_the_table_holds(spark, monkeypatch):
    monkeypatch.setattr(D, "LEAF", 0.01)  # as if there were a hundred thousand times as many documents
    assert [tuple(r) for r in Q.corpus_hash(spark, SMALL).collect()] == oracle("corpus_hash", SMALL)


def test_search_tokens_of_keys_of_six_digits_and_more(spark, tmp_path):
    keys = [1, 98_999, 99_000, 123_456, 7_654_321]
    pq.write_table(pa.table({"p_partkey": keys, "p_size": pa.array([1, 4, 12, 50, 7], pa.int32())}), tmp_path / "part.parquet")
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute(f"create view part as select * from read_parquet('{tmp_path}/part.parquet')")
    want = sorted(con.execute(Q.ORACLE_SQL["search_tokens"]).fetchall())
    assert sorted(map(tuple, RQ.search_tokens(spark, f"file://{tmp_path}").collect())) == want


@pytest.mark.parametrize("parts", (1, 7))
def test_entries_that_tie_in_all_that_is_asked_are_told_by_description(spark, parts):
    entries = spark.createDataFrame([(f"R-{i}", 1, f"lost {w}", 2.0, 900.0) for i in range(20) for w in (("b", "a", "c") if i % 2 else ("c", "b", "a"))], "doc_id string, event_ord int, description string, hours double, depth double")
    docs = entries.groupBy("doc_id").agg(F.lit("NPT DETAIL\nlost c\nlost a\nlost b").alias("text"), F.lit("ddr").alias("doc_type"))
    found = PA.entry_quotes(docs, entries.repartition(parts, "description"), F.array().cast("array<string>"), 950.0)
    assert {r.quote for r in found.collect()} == {"lost a"}


def test_ledgers_come_in_slices_and_give_rows_by_the_batch(spark, monkeypatch):
    head = "sep=;\r\n\r\nwell;date;code;hours;description\r\n"
    rows = [f'W-{i};2024-01-{i % 28 + 1:02d};A{"é" * (i % 3)};{i % 9}.5;"says ""{i}""\r\n;over; lines"' for i in range(300)]
    rows[17:17] = ["W-x;2024-01-01;A;1;too;many", 'W-y;2024-01-01;A;2;"never closed', "W-z;2024-01-02;A;3;alone", ""]
    texts = {"a": head + "\r\n".join(rows), "b": "﻿" + (head + "\n".join(rows)).replace("\r\n", "\n"), "c": "", "d": "no;ledger\n" + "x;y\n" * 50, "e": "sep=;\n"}
    files = [(k, v.encode()) for k, v in texts.items()] + [("f", b"well,date\n" * 9 + b"\xe9")]
    want = [(k, r["line"], r.get("raw"), r.get("hours"), r.get("description"), r.get("error")) for k, v in texts.items() for r in LC.records(v, {}, None)]
    want.append(("f", 0, None, None, None, "not UTF-8 at byte 90"))
    monkeypatch.setattr(LC, "SLICE", 7)
    monkeypatch.setattr(LC, "ROWS", 10)
    found = LC.read_ledgers(spark.createDataFrame(files, "path string, content binary").coalesce(1))
    got = [(r.path, r.line, r.raw, r.hours, r.description, r.error) for r in found.collect()]
    key = lambda r: (r[0], r[1])
    assert sorted(got, key=key) == sorted(want, key=key) and len(got) == 2 * 303 + 4


def test_postings_and_passages_are_dealt_out_once_before_they_multiply(spark):
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert plan(Q.postings(spark, SMALL)).count("Exchange hashpartitioning") == 1
    docs = spark.createDataFrame([("a", "ddr", "REMARKS\nIt ran. It fell.")], "doc_id string, doc_type string, text string")
    assert plan(PA.document_passages(docs)).count("Exchange hashpartitioning") == 1


def test_texts_are_indexed_without_moving_a_posting_more_than_once(spark, tmp_path, monkeypatch):
    rows = [(f"d{i}", "x" if i % 3 else "y", f"d{i}#0", " ".join(f"w{i * j % 7}" for j in range(i % 9))) for i in range(40)]
    chunks = spark.createDataFrame(rows, "doc_id string, tenant string, chunk_id string, chunk string")
    monkeypatch.setattr(SI, "SPAN", 8)
    spans = SI.in_spans(chunks, 40, 2)
    # texts travel once, and nothing between the counts of terms and their blocks
    plan = SI.blocks_of(spans, 1)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange rangepartitioning") == 1 and plan.count("Exchange") == 1
    index = SI.of_chunks(chunks)
    tables = index.now.tables
    assert tables["index_chunks"].files == tables["chunks"].files and "postings" not in tables["index_blocks"].schema.names
    assert index.now.read("index_members").count() == sum(1 for r in rows if r[3])
    # a change of one leaves the other as it was
    index.now.delete("chunks", spark.createDataFrame([("d1",)], "doc_id string"))
    assert index.now.read("chunks").count() == 39 and index.now.read("index_chunks").count() == 40


def test_an_index_of_the_earlier_layout_is_made_anew(spark, tmp_path):
    house = TB.Warehouse(spark, f"file://{tmp_path}")
    house.merge("chunks", spark.createDataFrame([("a", "x", "a#0", "salt pump")], "doc_id string, tenant string, chunk_id string, chunk string"))
    house.commit(SI.update)
    house.commit(lambda now: now.drop("index_members"))
    told = []
    house.commit(lambda now: told.append(SI.update(now)))
    assert told == ["built"] and [r.chunk_id for r in SI.StoredIndex.of(house).best(["salt"], 3).collect()] == ["a#0"]


def test_reports_are_grouped_in_tasks_of_bounded_size(spark, monkeypatch):
    monkeypatch.setattr(RQ, "GROUPED", 500)  # 6,000 order lines
    assert RQ.drilled_intervals(spark, SMALL).rdd.getNumPartitions() == 13


def test_intervals_look_only_at_levels_that_the_other_side_has(spark, monkeypatch):
    a = [(k, 0.0, 1000.0 + k) for k in range(3)] + [(7, None, 3.0)]
    b = [(k % 4, float(i), i + 0.5) for i in range(200) for k in (i,)] + [(1, 5.0, None), (2, 9.0, 1.0)]
    dealt, spread = [], TM._spread
    monkeypatch.setattr(TM, "_spread", lambda left, right, *rest: [dealt.append(right.count()), spread(left, right, *rest)][1])
    frames = spark.createDataFrame(a, "k long, a0 double, a1 double"), spark.createDataFrame(b, "k long, b0 double, b1 double")
    found = TM.interval_join(*frames, ["k"], ("a0", "a1"), ("b0", "b1")).select("k", "b0").collect()
    assert sorted(map(tuple, found)) == sorted((k, b0) for k, b0, b1 in b if k < 3 and b1 is not None and b0 <= b1)
    assert dealt[1] == 200  # one level of windows, in place of ten
    assert TM.interval_join(frames[0].where("false"), frames[1], ["k"], ("a0", "a1"), ("b0", "b1")).isEmpty()


def reports_of(spark, entities, kind="long"):
    rows = [("T", f"S{i % 3}", "F", "R", f"B{i % 2}", "AB"[i % 5 > 1], None if e is None else e, i % 4) for i, e in enumerate(entities)]
    rows = spark.createDataFrame(rows, "tenant string, section string, formation string, rig string, tool string, code string, entity long, hours int")
    return rows.withColumns({"hours": F.col("hours").cast("decimal(18,1)"), "entity": F.col("entity").cast(kind)})


EDGES = [-32768, -32767, -1, 0, 1, 32767, 32768, 32769, 65536, 65537, None]


def entities_do_not_travel(spark, stats, by):
    daily = reports_of(spark, [*EDGES, *range(-500, 1500), *range(1000)])
    lost = daily.where("hours > 0")
    found = stats(daily, lost)
    assert "entity" not in "".join(x for x in found._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange" in x)
    want = {tuple(r) for r in lost.groupBy(*by, "code").agg(F.count("*"), F.countDistinct("entity"), F.sum("hours").cast("double")).collect()}
    assert {tuple(r) for r in found.select(*by, "code", "events", "affected", "hours").collect()} == want
    want = {tuple(r) for r in daily.groupBy(*by).agg(F.count("*"), F.countDistinct("entity")).collect()}
    assert {tuple(r) for r in found.select(*by, "days", "exposed").distinct().collect()} == want


def test_entities_of_a_fleet_are_counted_without_a_row_for_each(spark, monkeypatch):
    monkeypatch.setattr(P, "DENSE", 2)
    fleet = lambda daily, lost: P.equipment_stats(daily, lost, "tool").withColumn("tool", F.col("category"))
    entities_do_not_travel(spark, fleet, ["tenant", "tool"])


def test_entities_of_places_are_counted_without_a_row_for_each(spark, monkeypatch):
    monkeypatch.setattr(P, "DENSE", 2)
    entities_do_not_travel(spark, P.interval_stats, ["tenant", "section", "formation"])


@pytest.mark.parametrize("kind, far", (("long", 1), ("long", 1_000_003), ("string", 1), ("int", 1)))
def test_entities_of_any_kind_are_counted_each_once(spark, kind, far):
    daily = reports_of(spark, [None, *(k * far for k in range(-300, 900)), *(k * far for k in range(400))], kind)
    found = P.with_entities(daily, ["tenant", "section"], "n", "entities", "hours")
    want = daily.groupBy("tenant", "section").agg(F.count("*"), F.countDistinct("entity"), F.sum("hours").cast("double"))
    assert {tuple(r) for r in found.select("tenant", "section", "n", "entities", "hours").collect()} == {tuple(r) for r in want.collect()}
    assert P.with_entities(daily.where("false"), ["section"], "n", "entities", "hours").count() == 0


def test_patterns_copy_no_ledger_that_is_written(spark, monkeypatch):
    told, written = [], P.written
    monkeypatch.setattr(P, "written", lambda rows, label: [told.append((label, rows.columns)), written(rows, label)][1])
    found = {tuple(r) for r in Q.patterns(spark, SMALL).collect()}
    assert [label for label, _ in told] == ["pattern-candidates", "pattern-marks", "pattern-owners"]
    assert dict(told)["pattern-marks"] == ["tenant", "code", "entity", "hours", "depth", "group"]
    daily, lost = Q.ledger(spark, SMALL, *P.LEDGER)
    assert {tuple(r) for r in P.find_patterns(daily, lost, Q.AVOIDABLE, thresholds=Q.RELAXED).collect()} == found and found


def test_entities_outside_a_fleet_lose_hours_and_are_not_counted(spark):
    columns = "tenant string, section string, formation string, rig string, tool string, code string, entity long, hours int, depth double"
    rows = [("T", "S", "F", rig, "B", "A", e, 9 if rig == "N" else 1, 5.0) for rig, es in (("N", range(4)), ("M", range(4, 9))) for e in es]
    daily = spark.createDataFrame(rows, columns).withColumn("hours", F.col("hours").cast("decimal(18,1)"))
    lost = daily.unionByName(daily.limit(1).withColumns({"entity": F.lit(99).cast("long"), "rig": F.lit("N")}))
    found = {r.category: r for r in P.find_patterns(daily, lost).collect() if r.kind == "rig"}
    assert (found["N"].events, found["N"].entities_affected, found["N"].entities_total, found["N"].total_hours, found["N"].mean_hours) == (5, 4, 4, 45.0, 9.0)


def test_passages_are_made_in_tasks_of_bounded_size_without_an_aggregate(spark, monkeypatch):
    monkeypatch.setattr(RQ, "GROUPED", 500)  # 6,000 order lines
    found = RQ.document_passages(spark, SMALL)
    assert found.rdd.getNumPartitions() == 13 and sorted(map(tuple, found.collect())) == sorted(oracle("document_passages", SMALL))
    docs = spark.createDataFrame([("a", "ddr", "REMARKS\nIt ran. It fell.")], "doc_id string, doc_type string, text string")
    plan = PA.document_passages(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" not in plan and plan.count("Sort [") <= 4 and plan.count("split(body") == 1


def test_headings_and_blanks_of_any_spelling(spark):
    text = "　\x85ROOT CAUSE\nROOT  CAUSE (b) \r\n It  ran.\x0bThen it fell. Done　\n12. ÀÉ Ω:\nŝMALL (AB)\nABC (d) (e)"
    docs = spark.createDataFrame([("a", "incident", text)], "doc_id string, doc_type string, text string")
    found = [(r.quote, r.section, r.role) for r in PA.document_passages(docs).orderBy("n").collect()]
    assert found[:2] == [("ROOT CAUSE", "", "content"), ("ROOT CAUSE (b)", "ROOT CAUSE", "heading")]
    assert ("12. ÀÉ Ω:", "ÀÉ Ω", "heading") in found and found[-1][2] == "content"


def test_terms_are_made_of_passages_of_the_first_tier_alone(spark):
    docs = spark.createDataFrame([("a", "ddr", "REMARKS\nIt ran. It fell.\n\nRig: pump"), ("b", "ddr", "Rig: pump\nPumps: rig"), ("c", "ddr", "REMARKS")], "doc_id string, doc_type string, text string")
    found = PA.best_passages(docs, F.array(F.lit("pump"), F.lit("fell")))
    assert {r.doc_id: r.quote for r in found.collect()} == {"a": "It fell.", "b": "Rig: pump", "c": "REMARKS"}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    terms, kept = plan.index("array_distinct"), plan.index("= least#")
    assert terms < kept and "array_distinct" not in plan[kept:]


def test_an_index_that_is_searched_by_terms_makes_no_vectors(spark, monkeypatch):
    kept, of_chunks = [], SI.of_chunks
    monkeypatch.setattr(SI, "of_chunks", lambda *a, **k: [kept.append(of_chunks(*a, **k)), kept[-1]][1])
    found = {tuple(r) for r in RQ.stored_index_search(spark, SMALL).collect()}
    assert found == set(oracle("stored_index_search", SMALL)) and "index_vectors" not in kept[0].now.tables
    chunks = spark.createDataFrame([("a", "x", "a#0", "salt pump")], "doc_id string, tenant string, chunk_id string, chunk string")
    assert of_chunks(chunks).vectors().count() == 1
