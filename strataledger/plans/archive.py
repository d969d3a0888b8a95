"""An archive of reports: what each kind says, the ledger, and the search index; from texts, or as a workspace holds it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataledger.functions.text import resolve_code
from strataledger.operators import retrieval as R
from strataledger.operators import search_index as SI
from strataledger.operators.answers import Archive
from strataledger.plans.settings import Settings
from strataledger.sources import folder as FO
from strataledger.sources import ledger_csv as LC
from strataledger.sources import reports as P
from strataledger.sources.storage import written
from strataledger.sources.tables import Warehouse
from strataledger.sources.warehouse import Parsed

#: Where documents are filed that name no field.
UNASSIGNED = "unassigned"
DAILY = ("doc_id", "tenant", "entity", "day", "section", "formation", "rig", "tool", "mud_weight", "depth_start", "depth_end")
FINALS = ("doc_id", "tenant", "entity", "text", "lessons", "recommendations", "by_code")
INCIDENTS = ("doc_id", "tenant", "entity", "text", "code", "section", "formation", "depth", "severity", "root_cause", "actions")
# Schemas of a workspace that holds nothing of a kind yet.
EMPTY = {
    "documents": "doc_id string, doc_type string, tenant string, entity string, day date, text string, page_ends array<int>",
    "events": "doc_id string, event_ord int, tenant string, entity string, day date, code string, hours decimal(18,4), section string, formation string, "
    "depth double, mud_weight double, rig string, tool string, description string",
}


def read_reports(docs: DataFrame, template: P.Template = P.Template()) -> Archive:
    """Tables of documents ``doc_id, doc_type, text, page_ends``; each is written once, so no query reads texts anew.

    Reports without a date count from 1970-01-01. Ledger rows of CSV files are documents of type ``csv``.
    """
    documents = P.with_header(docs).select(
        "doc_id", "doc_type", "tenant", "entity", F.coalesce("day", F.lit("1970-01-01").cast("date")).alias("day"), "text", "page_ends"
    )
    kind = lambda k: docs.where(F.col("doc_type") == k).select("doc_id", "doc_type", "text")
    daily = written(P.daily_reports(kind("ddr"), template), "daily-reports")
    ledger = P.loss_rows(daily, template)
    finals = P.final_reports(kind("eowr"), template).select(*FINALS)
    incidents = P.incident_reports(kind("incident"), template).select(*INCIDENTS)
    return Archive(
        written(documents, "documents"),
        written(ledger, "ledger"),
        daily.select(*DAILY),
        written(finals, "final-reports"),
        written(incidents, "incidents"),
    )


def with_index(archive: Archive) -> Archive:
    """The archive with an index of its chunks, in the session's folder for intermediate tables."""
    chunks = R.chunk_documents(archive.documents.select("doc_id", "tenant", "text"))
    index = SI.of_chunks(chunks)
    return Archive(archive.documents, archive.ledger, archive.daily, archive.finals, archive.incidents, index, index.vectors())


def stored(house: Warehouse, settings: Settings = Settings()) -> Archive:
    """The archive of a workspace as its tables hold it: no text is parsed and no chunk indexed anew."""
    now = house.begin()
    kinds = ("daily", "finals", "incidents")
    missing = [k for k in kinds if not now.has(k)]
    empty = read_reports(house.spark.createDataFrame([], "doc_id string, doc_type string, text string, page_ends array<int>")) if missing else None
    tables = [now.read(k) if now.has(k) else getattr(empty, k) for k in kinds]
    index = SI.StoredIndex(now, settings.retrieval.k1, settings.retrieval.b) if now.has("index_members") else None
    return Archive(now.read("documents", EMPTY["documents"]), now.read("events", EMPTY["events"]), *tables, index, index.vectors() if index else None)


def _ledger_rows(files: DataFrame, settings: Settings, field: str | None) -> DataFrame:
    """Rows of ledgers with their files' ``path`` and ids of their own, ``doc_id``."""
    rows = LC.read_ledgers(files, dict(settings.csv.columns), settings.csv.date_format or None)
    rows = rows.join(files.select("path", F.col("doc_id").alias("file_id")), "path")
    filed = F.coalesce(F.nullif("tenant", F.lit("")), F.lit(field or UNASSIGNED))
    return rows.withColumns({"doc_id": F.concat("file_id", F.lit("-r"), F.col("line").cast("string")), "tenant": filed})


def parse_files(settings: Settings, field: str | None = None):
    """A reader of files for ``warehouse.ingest``: reports and texts, and the ledgers among them.

    ``field`` is where documents are filed that name none. Every good row of a ledger is a document of type ``csv`` and a
    claim; what is wrong with a row or a value is a message.
    """

    def read(files: DataFrame) -> Parsed:
        named = files if "doc_id" in files.columns else files.join(FO.ids(files), "path")
        found = written(FO.texts(named.where(F.col("extension") != FO.LEDGER)), "file-texts")
        rows = written(_ledger_rows(named.where(F.col("extension") == FO.LEDGER), settings, field), "ledger-rows")
        docs = found.where("status = 'ingested'").select("doc_id", "doc_type", "text", F.col("page_ends").cast("array<int>").alias("page_ends"))
        archive = read_reports(docs, settings.template())
        unnamed = F.coalesce(F.nullif("tenant", F.lit("")), F.lit(field or UNASSIGNED)).alias("tenant")
        columns = ("doc_id", "doc_type", unnamed, "entity", "day", "text", "page_ends")
        good = rows.where("error is null")
        of_rows = good.withColumns({"doc_type": F.lit("csv"), "text": F.col("raw"), "page_ends": F.lit(None).cast("array<int>")})
        none = lambda c, kind: F.coalesce(c, F.lit("" if kind == "string" else 0.0)).cast(kind).alias(c)
        claims = good.select(
            "doc_id", F.lit(0).alias("event_ord"), "tenant", "entity", "day",
            resolve_code(F.col("code"), P.CODES, settings.taxonomy.aliases).alias("code"), F.col("hours").cast("decimal(18,4)").alias("hours"),
            none("section", "string"), none("formation", "string"), none("depth", "double"), F.lit(0.0).alias("mud_weight"), none("rig", "string"),
            F.lit("").alias("tool"), F.coalesce(F.nullif("description", F.lit("")), "raw").alias("description"),
        )
        return Parsed(
            archive.documents.select(*columns).unionByName(of_rows.select(*columns)),
            archive.ledger.withColumn("hours", F.col("hours").cast("decimal(18,4)")),
            _manifest(named, found, rows).withColumn("parse_config", F.lit(settings.digest())),
            {"daily": archive.daily, "finals": archive.finals, "incidents": archive.incidents},
            claims,
            _messages(found, rows),
        )

    return read


def _manifest(files: DataFrame, found: DataFrame, rows: DataFrame) -> DataFrame:
    """``path, sha256, size, doc_ids, status, reason`` of reports and ledgers."""
    ids = F.when(F.col("status") == "ingested", F.array("doc_id")).otherwise(F.array().cast("array<string>"))
    reports = found.select("path", "sha256", "size", ids.alias("doc_ids"), "status", "reason")
    # one row of the manifest holds the ids of one file, which one task has read
    failed = F.max(F.when(F.col("failed"), F.col("error")))
    state = rows.groupBy("path").agg(failed.alias("reason"), F.sort_array(F.collect_list(F.when(F.col("error").isNull(), F.col("doc_id")))).alias("doc_ids"))
    ledgers = files.where(F.col("extension") == FO.LEDGER).select("path", "sha256", "size").join(state, "path", "left").select(
        "path", "sha256", "size", F.coalesce("doc_ids", F.array().cast("array<string>")).alias("doc_ids"),
        F.when(F.col("reason").isNull(), "ingested").otherwise("skipped").alias("status"), "reason",
    )
    return reports.unionByName(ledgers)


def _messages(found: DataFrame, rows: DataFrame) -> DataFrame:
    """``path, line, kind, message``: files that were skipped, rows that cannot be read, and values that were left out."""
    none = F.lit(None).cast("int").alias("line")
    failed = F.coalesce("failed", F.lit(False))
    parts = [
        found.where("status = 'skipped'").select("path", none, F.lit("skipped").alias("kind"), F.col("reason").alias("message")),
        rows.where(failed).select("path", none, F.lit("skipped").alias("kind"), F.col("error").alias("message")),
        rows.where(~failed & F.col("error").isNotNull()).select("path", "line", F.lit("row error").alias("kind"), F.col("error").alias("message")),
        rows.where("warning is not null").select("path", "line", F.lit("row warning").alias("kind"), F.col("warning").alias("message")),
    ]
    return parts[0].union(parts[1]).union(parts[2]).union(parts[3])
