"""Loss ledgers as CSV files, read row by row with line numbers, exact raw text, and errors per row."""

from __future__ import annotations

import codecs
import io
import re
from collections.abc import Iterable, Iterator, Mapping
from datetime import datetime
from itertools import chain, islice

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

REQUIRED = ("well", "date", "code", "hours")
OPTIONAL = ("field", "depth", "section", "formation", "rig", "description")
SCHEMA = (
    "path string, line int, raw string, entity string, day date, code string, hours double, tenant string, depth double, "
    "section string, formation string, rig string, description string, error string, warning string, failed boolean"
)


def check_mapping(columns: Mapping[str, str], date_format: str | None) -> None:
    """A mapping names known columns, each by a header of its own; a date format gives a full date."""
    unknown = set(columns) - {*REQUIRED, *OPTIONAL}
    if unknown:
        raise ValueError(f"unknown ledger columns: {sorted(unknown)}")
    headers = [" ".join(h.split()).lower() for h in columns.values()]
    if "" in headers or len(set(headers)) < len(headers):
        raise ValueError("every mapped column needs a header of its own")
    if date_format is not None and not all(any(d in date_format for d in group) for group in (("%d",), ("%m", "%b", "%B"), ("%Y", "%y"))):
        raise ValueError("the date format must give day, month and year")


def fields(line: str, delimiter: str) -> list[str] | None:
    """Values of a record, or None while a quote is open."""
    if '"' not in line:
        return line.split(delimiter)
    out, value, quoted, k = [], "", False, 0
    while k < len(line):
        quote = line.find('"', k)
        if quoted:
            if quote < 0:
                return None
            value += line[k:quote]
            k = quote + 1
            if line[k : k + 1] == '"':
                value, k = value + '"', k + 1
            else:
                quoted = False
            continue
        end = line.find(delimiter, k)
        if quote >= 0 and (end < 0 or quote <= end):
            value += line[k:quote]
            k = quote + 1
            if not value.strip():
                value, quoted = "", True
            elif quote == end:
                out.append(value)
                value = ""
            else:
                value += '"'
        elif end >= 0:
            out.append(value + line[k:end])
            value, k = "", end + 1
        else:
            value, k = value + line[k:], len(line)
    return None if quoted else [*out, value]


def resolve_header(names: list[str], columns: Mapping[str, str]) -> dict[str, int]:
    """Positions of the logical columns; raises where one is missing or named twice."""
    folded = [" ".join(n.split()).lower() for n in names]
    found = {}
    for key in (*REQUIRED, *OPTIONAL):
        header = " ".join(columns.get(key, key).split()).lower()
        if folded.count(header) > 1:
            raise ValueError(f"the header has {header!r} twice")
        if header in folded:
            found[key] = folded.index(header)
        elif key in REQUIRED or key in columns:
            raise ValueError(f"the header lacks {header!r}")
    return found


def hours_of(text: str, delimiter: str) -> float:
    """Hours with an optional unit; a comma is a decimal sign only where it cannot part thousands."""
    bare = re.sub(r"\s*h(?:rs?|ours)?\.?$", "", text.strip(), flags=re.I)
    if re.fullmatch(r"\d{1,3},\d{3}", bare) and delimiter != ";":
        raise ValueError(f"hours {text!r} can be read two ways")
    value = float(bare.replace(",", "."))
    if not 0 <= value < float("inf"):
        raise ValueError(f"hours {text!r}")
    return value


def depth_of(text: str) -> float | None:
    found = re.fullmatch(r"(\d[\d,.\s]*)\s*m?(?:\s*\w+)?", text.strip(), re.I)
    return float(re.sub(r"[,\s]", "", found.group(1))) if found else None


def date_of(text: str, date_format: str | None):
    if date_format:
        return datetime.strptime(text.strip(), date_format).date()
    return datetime.fromisoformat(text.strip()).date()


def lines_of(slices: Iterable[bytes]) -> Iterator[str]:
    """Lines of a file that comes in slices, cut anywhere; no more than a slice and a line is held."""
    decoder = io.IncrementalNewlineDecoder(codecs.getincrementaldecoder("utf-8")(), translate=True)
    rest = ""
    for part in slices:
        *whole, rest = (rest + decoder.decode(part)).split("\n")
        yield from whole
    yield from (rest + decoder.decode(b"", final=True)).split("\n")


def records(text: str | Iterable[str], columns: Mapping[str, str], date_format: str | None) -> Iterator[dict]:
    """Every row of a ledger, of its text or its lines; a file that cannot be read as one gives one row with its error.

    A quoted value may span lines. Where its quote never closes before a line that is a row by itself, the open row is
    an error and reading goes on at that line.
    """
    lines = iter(text.replace("\r\n", "\n").replace("\r", "\n").split("\n") if isinstance(text, str) else text)
    at_hand = next(lines, "").removeprefix("\ufeff")
    start, wanted, ahead = 0, "", [at_hand]
    if re.fullmatch(r"sep=.", at_hand.strip(), re.I):
        start, wanted, ahead = 1, at_hand.strip()[-1], []
    head = ""
    for head in chain(ahead, lines):
        if head.strip():
            break
        start += 1
    else:
        head = ""
    outside = re.sub(r'"[^"]*"', "", head)
    order = [wanted] if wanted else sorted(";,\t|", key=lambda d: -outside.count(d))
    failure: Exception = ValueError("no header")
    for delimiter in order:
        try:
            at = resolve_header(fields(head, delimiter) or [], columns)
            width = len(fields(head, delimiter))
            break
        except ValueError as error:
            failure = error
    else:
        yield {"line": start + 1, "raw": head, "error": str(failure) if head else "the file is empty", "failed": True}
        return

    def reads_alone(line: str) -> bool:
        values = fields(line, delimiter)
        if not values or len(values) > width or max(at[k] for k in REQUIRED) >= len(values):
            return False
        try:
            date_of(values[at["date"]], date_format)
        except ValueError:
            return False
        return all(values[at[k]].strip() for k in REQUIRED)

    k, below = start + 1, next(lines, None)
    while below is not None:
        first, raw = k, below
        k, below = k + 1, next(lines, None)
        if not raw.strip():
            continue
        values = fields(raw, delimiter)
        while values is None and below is not None and not reads_alone(below):
            raw += "\n" + below
            k, below = k + 1, next(lines, None)
            values = fields(raw, delimiter)
        row: dict = {"line": first + 1, "raw": raw}
        try:
            if values is None:
                raise ValueError("a quote is not closed")
            if len(values) > width:
                raise ValueError("too many values")
            values += [""] * (width - len(values))
            get = {name: values[i].strip() for name, i in at.items()}
            missing = [c for c in REQUIRED if not get[c]]
            if missing:
                raise ValueError(f"no value for {', '.join(missing)}")
            row |= {"entity": get["well"], "code": get["code"], "tenant": get.get("field"), "rig": get.get("rig")}
            row |= {c: get.get(c) for c in ("section", "formation", "description")}
            row["day"] = date_of(get["date"], date_format)
            row["hours"] = hours_of(get["hours"], delimiter)
            if get.get("depth"):
                row["depth"] = depth_of(get["depth"])
                if row["depth"] is None:
                    row["warning"] = f"depth {get['depth']!r} is not read"
        except ValueError as error:
            row["error"] = str(error)
        yield row


#: Bytes of a slice in which a file's content goes to Python, and rows that come back at a time.
SLICE, ROWS = 1 << 20, 4_096


def read_ledgers(files: DataFrame, columns: Mapping[str, str] | None = None, date_format: str | None = None) -> DataFrame:
    """Rows of CSV ledgers from ``path, content``; a file is read by one task, in slices.

    A file that is no ledger gives one row, with ``failed``; any other row with an ``error`` is a row that cannot be read.
    """
    check_mapping(columns or {}, date_format)
    own, names = dict(columns or {}), [f.split()[0] for f in SCHEMA.split(", ")]

    def contents(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[str, bool, int, bytes]]:
        for batch in batches:
            yield from zip(batch["path"], batch["sound"], batch["at"], batch["part"], strict=True)

    def rows_of(head: tuple[str, bool, int, bytes], slices: Iterator[bytes]) -> Iterator[dict]:
        if head[1]:
            return records(lines_of(slices), own, date_format)
        try:  # to tell where it is wrong
            return records(b"".join(slices).decode("utf-8"), own, date_format)
        except UnicodeDecodeError as error:
            return iter([{"line": 0, "error": f"not UTF-8 at byte {error.start}", "failed": True}])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = contents(batches)
        head = next(parts, None)
        while head is not None:
            following: list = []

            def slices(first=head, following=following) -> Iterator[bytes]:
                """The file's slices, up to the first one of the next file."""
                yield bytes(first[3])
                for part in parts:
                    if part[2] == 0:
                        following.append(part)
                        return
                    yield bytes(part[3])

            own_slices = slices()
            rows = rows_of(head, own_slices)
            while some := list(islice(rows, ROWS)):
                yield pd.DataFrame([{"path": head[0]} | r for r in some], columns=names, dtype=object)
            for _ in own_slices:  # of a file that failed at its header
                pass
            head = following[0] if following else None

    content = F.coalesce("content", F.lit(b""))
    cut = f"transform(sequence(0, cast((length(content) - 1) div {SLICE} as int)), i -> substring(content, i * {SLICE} + 1, {SLICE}))"
    whole = files.select("path", content.alias("content")).withColumn("sound", F.is_valid_utf8(F.col("content").cast("string")))
    return whole.select("path", "sound", F.posexplode(F.expr(cut)).alias("at", "part")).mapInPandas(run, SCHEMA)


def sound(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("error").isNull())
