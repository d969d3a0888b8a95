"""Tables on disk, PDF text and settings."""

import zlib

import pytest
from pyspark.sql import functions as F

from strataledger.plans import settings as S
from strataledger.sources import pdf as PDF
from strataledger.sources import warehouse as WH
from strataledger.sources.tables import Warehouse
from strataledger.streaming.follow import follow

DOCS = "doc_id string, tenant string, text string"
MANIFEST = "path string, sha256 string, size long, doc_ids array<string>, status string, reason string"


@pytest.fixture
def house(spark, tmp_path):
    return Warehouse(spark, f"file://{tmp_path}/house")


def docs(spark, *rows):
    return spark.createDataFrame(list(rows), DOCS)


def test_merge_delete_and_lookup(spark, house):
    with pytest.raises(FileNotFoundError):
        house.read("documents")
    events = spark.createDataFrame([("a", "x", 1.0), ("b", "x", 2.0)], "doc_id string, tenant string, hours double")
    WH.put_documents(house, docs(spark, ("a", "x", "one"), ("b", "x", "two " * 3000)), events)
    WH.put_documents(house, docs(spark, ("a", "x", "new")), events.where("doc_id = 'a'").selectExpr("doc_id", "tenant", "9.0D as hours"))
    assert house.get("documents", "doc_id", "a") == {"doc_id": "a", "tenant": "x", "text": "new"} and house.get("documents", "doc_id", "z") is None
    assert {(r.doc_id, r.hours) for r in house.read("events").collect()} == {("a", 9.0), ("b", 2.0)}
    scan = WH.chunk_scan(house, "x").collect()
    assert [r.chunk_id for r in scan][:2] == ["a#0", "b#0"] and "".join(r.chunk for r in scan if r.doc_id == "b") == "two " * 3000
    WH.delete_documents(house, docs(spark, ("b", "", "")))
    assert {t: house.read(t).select("doc_id").distinct().count() for t in ("documents", "events", "chunks")} == {"documents": 1, "events": 1, "chunks": 1}


def test_ingest_replaces_prunes_and_skips(spark, house):
    def read(files):
        rows = files.collect()
        found = [(i, "x", t) for r in rows for i, t in [tuple(x.split("=")) for x in r.text.split(";")]]
        manifest = [(r.path, r.sha256, 1, [x.split("=")[0] for x in r.text.split(";")], "ingested", None) for r in rows]
        return docs(spark, *found), spark.createDataFrame([], "doc_id string, tenant string"), spark.createDataFrame(manifest, MANIFEST)

    def files(**texts):
        return spark.createDataFrame([(p, str(zlib.crc32(t.encode())), t) for p, t in texts.items()], "path string, sha256 string, text string")

    ids = lambda: sorted(r.doc_id for r in house.read("documents").collect())
    assert WH.ingest(house, files(p="a=1;b=2", q="c=3"), read, dry_run=True)["read"] == {"ingested": 2}
    with pytest.raises(FileNotFoundError):
        house.read("documents")
    WH.ingest(house, files(p="a=1;b=2", q="c=3"), read)
    assert ids() == ["a", "b", "c"]
    report = WH.ingest(house, files(p="a=9"), read)
    assert (report["unchanged"], report["gone"], report["pruned"]) == (0, 1, False) and ids() == ["a", "c"]
    report = WH.ingest(house, files(p="a=9"), read, prune=True)
    assert (report["unchanged"], report["pruned"]) == (1, True) and ids() == ["a"]
    assert house.read("files").count() == 1


def test_index_freshness_hashes_and_log(spark, house):
    WH.put_documents(house, docs(spark, ("a", "x", "stuck pipe"), ("b", "y", "lost returns")))
    status = lambda: {r.tenant: (r.documents, r.chunks, r.stale) for r in WH.index_status(house).collect()}
    assert status() == {"x": (1, 1, True), "y": (1, 1, True)} and WH.index_hash(house) == ""
    assert WH.ensure_index(house) and not WH.ensure_index(house)
    before = WH.index_hash(house)
    assert status() == {"x": (1, 1, False), "y": (1, 1, False)} and len(before) == 64
    assert {r.term for r in house.read("index_blocks").where("tenant = 'x'").collect()} == {"stuck", "pipe"}
    assert WH.ensure_index(house, k1=1.2) and WH.ensure_index(house, k1=1.2, rebuild=True)
    WH.put_documents(house, docs(spark, ("c", "x", "more")))
    assert {r.tenant: r.stale for r in WH.index_status(house, k1=1.2).collect()} == {"x": True, "y": False}
    assert WH.index_hash(house) != before
    WH.log(house, "ask", {"question": "what?"})
    WH.log(house, "brief", {"entity": "A-1"})
    assert sorted(r.kind for r in WH.logged(house).collect()) == ["ask", "brief"]


def test_following_a_folder(spark, house, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()

    def read(files):
        ids = F.regexp_extract("path", "([^/]+)$", 1)
        found = files.select(ids.alias("doc_id"), F.lit("x").alias("tenant"), F.decode("content", "UTF-8").alias("text"))
        state = files.select("path", "sha256", F.col("length").alias("size"), F.array(ids).alias("doc_ids"), F.lit("ingested").alias("status"), F.lit(None).cast("string").alias("reason"))
        return found, spark.createDataFrame([], "doc_id string, tenant string"), state

    for n in (1, 2):
        (folder / f"{n}.txt").write_text(f"text {n}")
        follow(spark, f"file://{folder}", house, read, f"file://{tmp_path}/marks").awaitTermination()
        assert house.read("documents").count() == house.read("files").count() == n


def test_simple_loader(spark, tmp_path):
    (tmp_path / "one.txt").write_bytes(b"a\r\nb")
    (tmp_path / "two.md").write_bytes(b"c")
    (row,) = WH.simple_load(spark, f"file://{tmp_path}").collect()
    assert (row.doc_id, row.doc_type, row.text) == ("one", "ddr", "a\nb")


def pdf(*pages, compress=True, extra=b""):
    """A PDF of pages of lines."""
    objects = {1: b"<< /Type /Catalog /Pages 2 0 R >>", 3: b"<< /Type /Font /Subtype /Type1 /BaseFont /Courier >>"}
    kids = []
    for k, lines in enumerate(pages):
        own = 10 + 2 * k
        shown = b"BT /F1 10 Tf 40 800 Td\n" + b"\n".join(b"(" + line + b") Tj 0 -12 Td" for line in lines) + b"\nET"
        data = zlib.compress(shown) if compress else shown
        kind = b"/Filter /FlateDecode " if compress else b""
        objects[own] = b"<< /Type /Page /Parent 2 0 R /Contents %d 0 R >>" % (own + 1)
        objects[own + 1] = b"<< " + kind + b"/Length %d >>\nstream\n" % len(data) + data + b"\nendstream"
        kids.append(b"%d 0 R" % own)
    objects[2] = b"<< /Type /Pages /Kids [" + b" ".join(kids) + b"] /Count %d /Resources << /Font << /F1 3 0 R >> >> >>" % len(pages)
    body = b"".join(b"%d 0 obj\n%s\nendobj\n" % (n, o) for n, o in sorted(objects.items()))
    return b"%PDF-1.4\n" + body + b"trailer << /Root 1 0 R " + extra + b">>\n%%EOF"


@pytest.mark.parametrize("compress", [True, False])
def test_pdf_text_and_pages(spark, compress):
    data = pdf([b"DAILY \\(A\\) REPORT", rb"size 12\2751 m"], [b"second page", b"end"], compress=compress)
    pages = PDF.pdf_pages(data)
    assert pages == ["DAILY (A) REPORT\nsize 12½1 m", "second page\nend"]
    text, ends = PDF.joined_pages(pages)
    assert ends == [len(pages[0]), len(text)]
    for bad, error in ((b"none", PDF.UnreadablePdf), (pdf([b""]), PDF.NoTextLayer), (pdf([b"x"], extra=b"/Encrypt 9 0 R "), PDF.UnreadablePdf)):
        with pytest.raises(error):
            PDF.pdf_pages(bad)
    rows = spark.createDataFrame([(data,), (b"none",), (None,)], "content binary").select(PDF.pdf_text("content").alias("r")).select("r.*").collect()
    assert rows[0].text == text and rows[0].page_ends == ends and all(r.text is None and r.reason for r in rows[1:])


def test_pdf_unicode_maps_and_arrays():
    cmap = b"1 beginbfchar <0003> <0020> endbfchar 1 beginbfrange <0041> <0043> <0061> endbfrange"
    glyphs = PDF._unicode_map(cmap)
    content = b"BT /F1 9 Tf [<00410042> -300 <0043>] TJ T* <0041> Tj ET"
    assert PDF._page_text(content, {b"F1": glyphs}) == "ab c\na"


def test_settings_layers_and_checks():
    own = S.resolve(
        workspace='[risk]\nmin_lift = 3\n[retrieval]\ntop_k = 5\n[taxonomy.aliases]\nSP = "STUCK_PIPE"',
        folder='[retrieval]\ntop_k = 6\n[parse.ddr.labels]\nmwd = "Tool"\n[taxonomy.keywords]\nFISHING = ["magnet"]',
        environ={"STRATALEDGER_SPREAD_RATE": "1000"}, command={"retrieval": {"top_k": 7}},
    )
    assert (own.retrieval.top_k, own.risk.min_lift, own.costs.spread_rate, own.retrieval.k1) == (7, 3.0, 1000.0, 1.5)
    template = own.template()
    assert template.labels["tool"] == "Tool" and template.labels["section"] == "Hole section" and template.aliases == {"SP": "STUCK_PIPE"}
    assert own.taxonomy.keywords["FISHING"] == ["magnet"] and "STUCK_PIPE" in own.taxonomy.keywords
    assert own.digest() != S.Settings().digest() and S.resolve() == S.Settings()


@pytest.mark.parametrize(
    ("text", "named"),
    [
        ("[risks]\nx = 1", "unknown key risks"), ("[risk]\nlift = 1", "risk.lift"), ("[risk]\nmin_lift = 'a'", "risk.min_lift must be float"),
        ("risk = 1", "[risk] must be a table"), ("[taxonomy.aliases]\nSP = 'NONE'", "known code"), ("[taxonomy.keywords]\nFISHING = 'x'", "list of words"),
        ("[csv.columns]\nnone = 'x'", "no known column"), ("[parse.ddr.labels]\nmwd = ' '", "is empty"), ("x = ", "workspace file"),
        ("[retrieval]\ntop_k = true", "must be int"),
    ],
)
def test_settings_errors_name_the_key(text, named):
    with pytest.raises(S.SettingsError, match="workspace file") as error:
        S.resolve(workspace=text)
    assert named in str(error.value)
    with pytest.raises(S.SettingsError, match="SPREAD_RATE"):
        S.of_environment({"STRATALEDGER_SPREAD_RATE": "much"})
