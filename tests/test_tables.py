"""The commit log: stops between steps, racing writers, buckets; the stored index; ledgers in a folder."""

import itertools
import json
import threading
from collections import Counter

import pytest
from pyspark.sql import functions as F

from strataledger.operators import retrieval as R
from strataledger.operators import search_index as SI
from strataledger.operators.matching import matched
from strataledger.plans.archive import parse_files, stored
from strataledger.plans.settings import Settings
from strataledger.sources import folder as FO
from strataledger.sources import tables as TB
from strataledger.sources import warehouse as WH
from workspace import daily


@pytest.fixture
def house(spark, tmp_path):
    return TB.Warehouse(spark, f"file://{tmp_path}/house")


def rows(spark, *pairs, schema="doc_id string, v int"):
    return spark.createDataFrame(list(pairs), schema)


def held(house, table="t"):
    return sorted(map(tuple, house.read(table).collect()), key=str)


@pytest.mark.parametrize("stop", ["_store", "_rewrite", "put_if_absent"])
def test_a_stop_at_any_step_leaves_the_table_and_the_next_try_completes(spark, house, monkeypatch, stop):
    house.merge("t", rows(spark, *((f"k{i}", i) for i in range(100))))
    before, change = held(house), rows(spark, ("k1", -1), ("new", 7))
    with monkeypatch.context() as patch:
        def fail(*_, **__):
            raise OSError("stopped")

        patch.setattr(TB if stop == "put_if_absent" else TB.Transaction, stop, fail)
        with pytest.raises(OSError, match="stopped"):
            house.merge("t", change)
    assert held(house) == before and house.head()[0] == 1
    house.merge("t", change)
    assert held(house) == sorted([("k1", -1), ("new", 7), *(r for r in before if r[0] != "k1")], key=str)
    assert house.vacuum(keep=1, older_than=0) and len(held(house)) == 101


def test_a_stop_after_the_commit_loses_nothing(spark, house, monkeypatch):
    real = TB.put_if_absent
    with monkeypatch.context() as patch:
        def late(*args):
            real(*args)
            raise OSError("stopped")

        patch.setattr(TB, "put_if_absent", late)
        with pytest.raises(OSError, match="stopped"):
            house.write("t", rows(spark, ("a", 1)), "doc_id")
    assert held(house) == [("a", 1)]


def test_only_touched_buckets_are_written(spark, house):
    house.merge("t", rows(spark, *((f"k{i}", i) for i in range(400))))
    first = house.head()[1]["t"]
    house.merge("t", rows(spark, ("k1", -1)))
    second = house.head()[1]["t"]
    changed = {k for k in first.files if first.files[k] != second.files[k]}
    assert len(first.files) == TB.BUCKETS and len(changed) == 1
    assert house.get("t", "doc_id", "k1")["v"] == -1 and house.get("t", "doc_id", "none") is None
    house.commit(lambda t: t.delete("t", rows(spark, ("k1", 0), ("unknown", 0))))
    assert house.read("t").count() == 399 and house.get("t", "doc_id", "k1") is None


def test_writers_of_other_buckets_both_count_and_of_the_same_bucket_one_works_again(spark, house):
    house.merge("t", rows(spark, *((f"k{i}", i) for i in range(200))))
    bucket = lambda k: spark.range(1).select(TB.bucket_of(F.lit(k), TB.BUCKETS)).first()[0]
    other = next(f"k{i}" for i in range(1, 200) if bucket(f"k{i}") != bucket("k0"))
    one, two, three = house.begin(), house.begin(), house.begin()
    one.merge("t", rows(spark, ("k0", -1)))
    two.merge("t", rows(spark, (other, -2)))
    three.merge("t", rows(spark, ("k0", -3)))
    assert one.publish() and two.publish() and not three.publish()
    assert house.get("t", "doc_id", "k0")["v"] == -1 and house.get("t", "doc_id", other)["v"] == -2 and house.read("t").count() == 200
    seen = []

    def add(now):  # counts what stands, and so depends on the version it works on
        seen.append(now.version)
        if len(seen) == 1:
            house.merge("t", rows(spark, ("k0", 100)))
        now.merge("t", now.read("t").where("doc_id = 'k0'").select("doc_id", (F.col("v") + 1).alias("v")))

    house.commit(add)
    assert len(seen) == 2 and house.get("t", "doc_id", "k0")["v"] == 101


def test_racing_threads_lose_no_update(spark, house):
    house.merge("t", rows(spark, ("k", 0)))
    failed = []

    def work():
        try:
            for _ in range(2):
                house.commit(lambda now: now.merge("t", now.read("t").select("doc_id", (F.col("v") + 1).alias("v"))), tries=50)
        except Exception as error:
            failed.append(error)

    threads = [threading.Thread(target=work) for _ in range(3)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not failed and held(house) == [("k", 6)]


def test_null_keys_new_columns_many_rows_a_key_and_growth(spark, house, monkeypatch):
    house.merge("t", rows(spark, (None, 1), ("a", 2), ("a", 3)))
    house.merge("t", spark.createDataFrame([(None, 4.0, "x"), ("b", 5.0, "y")], "doc_id string, v double, more string"))
    assert held(house) == [("a", 2, None), ("a", 3, None), ("b", 5, "y"), (None, 4, "x")]
    house.merge("t", rows(spark).limit(0))
    assert house.read("t").count() == 4
    monkeypatch.setattr(TB, "TARGET", 1)
    house.merge("t", rows(spark, ("c", 6)))
    assert house.head()[1]["t"].n > TB.BUCKETS and house.read("t").count() == 5
    kept = house.begin()
    house.reset()
    assert not house.has("t") and kept.read("t").count() == 5  # a reader keeps its version
    house.vacuum(keep=1, older_than=0)
    assert house._versions() == [house.head()[0]]


def test_bands_against_all_pairs(spark):
    values = [0.0, 0.04, 0.05, 0.1, 0.149, 0.15, 1.0, 1.0499, 1.06, 7.3, None]
    claims = [(k, v, f"{k}{v}") for k in ("a", "b", None) for v in values]
    told = [("a", v) for v in (0.02, 1.01, 7.25, None)] + [("b", 0.1), ("c", 1.0), (None, 1.0)]
    want = {c[2]: c[0] is not None and c[1] is not None and any(k == c[0] and v is not None and abs(v - c[1]) <= 0.05 for k, v in told) for c in claims}
    frame, other = spark.createDataFrame(claims, "k string, h double, id string"), spark.createDataFrame(told, "k string, h double")
    for most in (1_000_000, 1):
        found = matched(frame, other, ["k"], "h", 0.05, most).collect()
        assert {r.id: r.matched for r in found} == want and len(found) == len(claims)


WORDS = "pump pipe stuck salt mud loss crew drill rig bit".split()


def chunk_rows(n, start=0):
    out = []
    for i in range(start, start + n):
        words = [WORDS[(i * 7 + j * j) % len(WORDS)] for j in range(3 + i % 17)] + ["rare"] * (i % 97 == 0)
        out.append((f"d{i:05d}", "x" if i % 3 else "y", f"d{i:05d}#0", " ".join(words)))
    return out


def scanned(house, words, k):
    """The ranking from postings made anew, every chunk scored."""
    chunks = house.read("chunks").select("tenant", "chunk_id", SI.index_text(F.col("chunk")).alias("chunk"))
    index = R.postings(chunks, SI.tokenize(F.col("chunk")), "tenant", "chunk_id")
    return ranking(R.best(R.bm25(index, words, "tenant", "chunk_id"), k, "chunk_id", ["tenant"]))


def ranking(found):
    return sorted((r.tenant, r["rank"], r.chunk_id, round(r.score, 9)) for r in found.collect())


def test_the_stored_index_grows_and_ranks_as_one_made_anew(spark, house, monkeypatch):
    monkeypatch.setattr(SI, "SPAN", 8)
    put = lambda rows: house.merge("chunks", spark.createDataFrame(rows, "doc_id string, tenant string, chunk_id string, chunk string"))
    update = lambda: [out := [], house.commit(lambda now: out.append(SI.update(now)))][0][-1]
    put(chunk_rows(300))
    assert update() == "built" and update() == "nothing"
    questions = (["rare"], ["rare", "pump", "pump"], WORDS, ["none"])
    told = {}
    for words in questions:
        assert ranking(SI.StoredIndex.of(house).best(words, 5, told=told)) == scanned(house, words, 5)
    SI.StoredIndex.of(house).best(["rare", "salt"], 2, first=2, told=told).collect()
    assert told["blocks_read"] < told["blocks"] / 2 and told["spans_read"] < told["spans"]
    # added, changed, dropped, and back again
    put(chunk_rows(60, 300) + [("d00000", "x", "d00000#0", "salt salt rare rare"), ("d00003", "y", "d00003#0", "pump")])
    assert update() == "added"
    house.commit(lambda now: now.delete("chunks", spark.createDataFrame([("d00097",), ("d00301",)], "doc_id string")))
    assert update() == "added"
    put([r for r in chunk_rows(100) if r[0] == "d00097"])
    assert update() == "added" and house.read("index_blocks").select("segment").distinct().count() >= 3
    for words in questions:
        assert ranking(SI.StoredIndex.of(house).best(words, 7)) == scanned(house, words, 7)
    few = spark.createDataFrame([("d00097#0",), ("d00001#0",)], "chunk_id string")
    assert {r.chunk_id for r in SI.StoredIndex.of(house).best(WORDS, 7, allowed=few).collect()} == {"d00097#0", "d00001#0"}
    assert {r.tenant for r in SI.StoredIndex.of(house).best(WORDS, 7, tenants=["y"]).collect()} == {"y"}
    SI.compact(house)
    assert house.read("index_blocks").select("segment").distinct().count() == 1
    assert ranking(SI.StoredIndex.of(house).best(WORDS, 7)) == scanned(house, WORDS, 7)


HEADER = "well,date,code,hours,field\n"


def ingest(spark, house, folder, **options):
    return WH.ingest(house, FO.scan(spark, f"file://{folder}"), parse_files(Settings()), **options)


def write_daily(folder, entity="RVB-1", hours=23.5, day=1):
    name, _, text = daily("Riverbend", entity, day, '12 1/4"', "Keld Salt", "Rig-1", "PJ-1", 2000, 1.2, [("STUCK_PIPE", hours, 2050, "packed off")])
    (folder / f"{name}.txt").write_text(text)
    return name


def test_ledgers_in_a_folder(spark, house, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    write_daily(folder)
    ledger = folder / "ledger.csv"
    ledger.write_text(HEADER + "RVB-1,2024-03-01,STUCK_PIPE,23.52,Riverbend\nRVB-1,2024-03-01,STUCK_PIPE,5.0,Riverbend\nRVB-9,2024-03-01,Own code,x,\nRVB-9,2024-03-02,Own code,1.5,\n")
    (folder / "none.csv").write_text("")
    (folder / "odd.txt").write_bytes(b"caf\xe9")
    assert ingest(spark, house, folder, dry_run=True)["merged"] == 1 and not house.has("documents")
    report = ingest(spark, house, folder)
    assert (report["files"], report["read"], report["merged"], report["documents"], report["events"]) == (4, {"ingested": 2, "skipped": 2}, 1, 4, 3)
    assert report["messages"] == {"skipped": 2, "row error": 1} and report["tenants"] == 2
    assert report["extraction"] == {"depth": 1.0, "section": 1.0, "formation": 1.0, "mud_weight": 1.0, "npt_blocks": 1.0}
    events = {r.doc_id: (r.entity, r.code, float(r.hours), r.tenant) for r in house.read("events").collect()}
    assert events == {"DDR-RVB-1-001": ("RVB-1", "STUCK_PIPE", 23.5, "Riverbend"), "ledger-r3": ("RVB-1", "STUCK_PIPE", 5.0, "Riverbend"), "ledger-r5": ("RVB-9", "OTHER", 1.5, "unassigned")}
    assert house.get("documents", "doc_id", "ledger-r2")["text"].startswith("RVB-1") and house.get("documents", "doc_id", "ledger-r2")["doc_type"] == "csv"
    assert [(r.line, r.kind) for r in house.read("messages").where("line is not null").collect()] == [(4, "row error")]
    assert house.get("entities", "entity", "RVB-1")["rig"] == "Rig-1"
    again = ingest(spark, house, folder)
    assert (again["unchanged"], again["read"]) == (2, {"skipped": 2}) and house.read("events").count() == 3
    # a changed ledger: rows go, a row of its own before is no duplicate of itself, and a report on record still counts
    ledger.write_text(HEADER + "RVB-1,2024-03-01,STUCK_PIPE,23.46,Riverbend\nRVB-1,2024-03-01,STUCK_PIPE,5.0,Riverbend\n")
    report = ingest(spark, house, folder)
    assert report["merged"] == 1 and {r.doc_id for r in house.read("events").collect()} == {"DDR-RVB-1-001", "ledger-r3"}
    # two ledgers with one row are two losses; a report that changes its hours no longer answers the claim
    (folder / "second.csv").write_text(HEADER + "RVB-1,2024-03-01,STUCK_PIPE,5.0,Riverbend\n")
    assert ingest(spark, house, folder)["merged"] == 0 and house.read("events").count() == 3
    ledger.write_text("")
    ingest(spark, house, folder)
    assert not {r.doc_id for r in house.read("documents").collect()} & {"ledger-r2", "ledger-r3"}
    (folder / "second.csv").unlink()
    assert ingest(spark, house, folder, prune=True)["pruned"] and {r.doc_id for r in house.read("events").collect()} == {"DDR-RVB-1-001"}
    (folder / "DDR-RVB-1-001.txt").write_bytes(b"caf\xe9")
    ingest(spark, house, folder)
    assert house.read("documents").count() == house.read("events").count() == house.read("chunks").count() == 0
    assert house.get("files", "path", f"file:{folder}/DDR-RVB-1-001.txt")["status"] == "skipped"


def test_questions_read_the_stored_tables(spark, house, tmp_path, monkeypatch):
    from strataledger.operators import answers
    from strataledger.sources import reports as P

    folder = tmp_path / "in"
    folder.mkdir()
    for day, entity in itertools.product((1, 2), ("RVB-101", "RVB-102")):
        write_daily(folder, entity, 4.0 + day, day)
    ingest(spark, house, folder)
    assert WH.ensure_index(house) and not WH.ensure_index(house)
    monkeypatch.setattr(P, "daily_reports", lambda *_: pytest.fail("texts are parsed again"))
    monkeypatch.setattr(R, "chunk_documents", lambda *_: pytest.fail("texts are cut again"))
    monkeypatch.setattr(R, "postings", lambda *_: pytest.fail("chunks are indexed again"))
    answer = answers.ask(stored(house), "stuck pipe in RVB-101")
    assert not answer["abstained"] and answer["figures"]["total_hours"] == 11.0
    assert Counter(c["entity"] for c in answer["citations"]) and {c["entity"] for c in answer["citations"]} == {"RVB-101"}
    json.dumps(answer, default=str)
