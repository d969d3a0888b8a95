"""Text of DOCX files: paragraphs and table rows of the main document, by the standard library."""

from __future__ import annotations

import io
import zipfile
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The main document may be no larger than this when unpacked.
MOST_BYTES = 16 << 20
MAIN = "word/document.xml"
NS = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


class UnreadableDocument(ValueError):
    pass


def document_text(data: bytes) -> str:
    """One line per paragraph; a table row is a line of cells parted by ``|``."""
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as archive, archive.open(MAIN) as file:
            xml = file.read(MOST_BYTES + 1)
    except (zipfile.BadZipFile, KeyError, RuntimeError) as error:
        raise UnreadableDocument("not a DOCX file") from error
    if len(xml) > MOST_BYTES:
        raise UnreadableDocument("the document is too large")
    if b"<!DOCTYPE" in xml or b"<!ENTITY" in xml:
        raise UnreadableDocument("the document declares entities")
    try:
        body = ElementTree.fromstring(xml).find(f"{NS}body")
    except ElementTree.ParseError as error:
        raise UnreadableDocument("the document is not well-formed") from error
    lines: list[str] = []
    for block in body if body is not None else ():
        if block.tag == f"{NS}p":
            lines.append(_text(block))
        elif block.tag == f"{NS}tbl":
            for row in block.iter(f"{NS}tr"):
                lines.append(" | ".join(" ".join(_text(p) for p in cell.iter(f"{NS}p")).strip() for cell in row.iter(f"{NS}tc")))
    return "\n".join(lines)


def _text(paragraph: ElementTree.Element) -> str:
    marks = {f"{NS}tab": "\t", f"{NS}br": "\n", f"{NS}cr": "\n", f"{NS}noBreakHyphen": "-"}
    return "".join(e.text or "" if e.tag == f"{NS}t" else marks.get(e.tag, "") for e in paragraph.iter())


def _outcome(data) -> dict:
    try:
        return {"text": document_text(bytes(data or b"")), "reason": None}
    except UnreadableDocument as error:
        return {"text": None, "reason": str(error)}


@F.pandas_udf(T.StructType([T.StructField("text", T.StringType()), T.StructField("reason", T.StringType())]))
def read_docx(content: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([_outcome(c) for c in content], columns=["text", "reason"])


def docx_text(content: Column) -> Column:
    """``text`` and ``reason`` of a file's bytes; one of them is null."""
    return read_docx(content)
