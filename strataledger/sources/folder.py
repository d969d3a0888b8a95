"""A folder of reports: what it holds, what changed, and what of it could be read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataledger.sources.docx import docx_text
from strataledger.sources.pdf import pdf_text
from strataledger.sources.reports import kind_of
from strataledger.sources.storage import empty_files

PLAIN = ("txt", "md")
LEDGER = "csv"
READABLE = (*PLAIN, "pdf", "docx", LEDGER)
CONFIG = "strataledger.toml"


def scan(spark: SparkSession, folder: str) -> DataFrame:
    """Files of a folder, not of those below it, as ``described`` gives them."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "false").load(folder)
    # Spark's reader passes over empty files
    empty = [(path, 0, b"") for path in empty_files(spark, folder)]
    return described(files.select("path", "length", "content").union(spark.createDataFrame(empty, "path string, length long, content binary")))


def described(files: DataFrame) -> DataFrame:
    """``path, name, stem, extension, size, sha256, content`` of files as Spark reads them; names with a leading
    underscore and the configuration are skipped."""
    name = F.regexp_extract("path", "([^/]+)$", 1)
    return files.select(
        "path", name.alias("name"), F.regexp_replace(name, r"\.[^.]*$", "").alias("stem"),
        F.lower(F.regexp_extract(name, r"\.([^.]*)$", 1)).alias("extension"), F.col("length").alias("size"),
        F.sha2("content", 256).alias("sha256"), "content",
    ).where(~F.col("name").startswith("_") & (F.col("name") != CONFIG))


def ids(files: DataFrame) -> DataFrame:
    """``path, doc_id`` of files: their stems, with eight digits of the path's hash where several share one."""
    alike = files.groupBy("stem").agg(F.count("*").alias("__alike"))
    named = F.when(F.col("__alike") > 1, F.concat_ws("-", "stem", F.substring(F.sha2("path", 256), 1, 8))).otherwise(F.col("stem"))
    return files.select("path", "stem").join(alike, "stem").select("path", named.alias("doc_id"))


def changed(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """Files that the manifest doesn't hold as read with the same content."""
    read = manifest.where(F.col("status") == "ingested").select("path", "sha256")
    return files.join(read, ["path", "sha256"], "left_anti")


def gone(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """Manifest rows whose files are no longer in the folder."""
    return manifest.join(files.select("path"), "path", "left_anti")


def texts(files: DataFrame) -> DataFrame:
    """Texts of files, of PDF files with the end of each page: ``status`` and ``reason`` say what could not be read.

    A byte-order mark goes, and line ends become one kind. Ids are those of ``ids`` over these files, unless the files
    bring a ``doc_id`` of their own.
    """
    plain = F.col("extension").isin(*PLAIN)
    decoded = F.try_validate_utf8(F.decode(F.when(plain, F.col("content")), "UTF-8"))
    valid = F.is_valid_utf8(F.col("content").cast("string"))
    known = F.col("extension").isin(*READABLE)
    text = F.regexp_replace(F.regexp_replace(decoded, "^﻿", ""), "\r\n?", "\n")
    # a reader gets only the files of its kind; the others are null to it
    read = {"pdf": pdf_text, "docx": docx_text}
    files = files.withColumns({f"__{k}": f(F.when(F.col("extension") == k, F.col("content"))) for k, f in read.items()})
    of_kind = lambda part: F.coalesce(*(F.when(F.col("extension") == k, F.col(f"__{k}.{part}")) for k in read))
    text = F.coalesce(text, of_kind("text"))
    files = files if "doc_id" in files.columns else files.join(ids(files), "path")
    reason = F.when(~known, "unsupported extension").when(plain & ~valid, "not UTF-8").otherwise(of_kind("reason"))
    files = files.withColumn("page_ends", F.col("__pdf.page_ends"))
    out = files.withColumns({"reason": reason}).withColumn(
        "status", F.when(F.col("reason").isNull(), "ingested").otherwise("skipped")
    )
    out = out.withColumn("text", F.when(F.col("reason").isNull(), text)).drop("content", "__pdf", "__docx")
    return out.withColumn("doc_type", F.when(F.col("text").isNotNull(), kind_of(F.col("text"), F.col("stem"))))


def coverage(found: DataFrame) -> DataFrame:
    """Counts of what was read and what was skipped."""
    return found.groupBy("status", "doc_type", "reason").agg(F.count("*").alias("n_files"), F.sum("size").alias("bytes"))


def replaced(old: DataFrame, new: DataFrame, key: str = "doc_id") -> DataFrame:
    """A table with the rows of ``new`` in place of those of equal key."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)
