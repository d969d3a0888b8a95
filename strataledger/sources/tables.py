"""Keyed tables in buckets under one commit log.

Rows are filed in buckets by a hash of their key. A change writes new files for the buckets it touches and leaves every
other file as it is. ``_log`` holds one file a version: which folders make up every table. A version is put there whole
and only where none of its number exists, so a change of several tables counts at once or not at all, a failed or
repeated one leaves nothing to see, and readers keep the version they began with.

Of two writers that begin at the same version, the later one takes over what the other wrote if they touched different
buckets; else it does its work again on the new version. Only buckets written are compared: a change that depends on
rows it does not write should merge them too.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strataledger.sources.storage import bytes_below, listed, put_if_absent, read_text, remove

#: Buckets of a new table; bytes that a bucket should hold. Past eight times that, the table gets more buckets.
BUCKETS, TARGET = 16, 128 << 20
BUCKET = "__bucket"


class Conflict(RuntimeError):
    """Another writer changed the same buckets each time."""


def bucket_of(key: Column, n: int) -> Column:
    return F.pmod(F.xxhash64(key.cast("string")), F.lit(n)).cast("int")


@dataclass
class Table:
    """``files``: for each bucket, its folders and their bytes."""

    schema: T.StructType
    key: str | None
    n: int
    files: dict[int, list[tuple[str, int]]] = field(default_factory=dict)

    def plain(self) -> dict:
        return {"schema": self.schema.jsonValue(), "key": self.key, "n": self.n, "files": self.files}

    @staticmethod
    def of(plain: dict) -> Table:
        files = {int(k): [tuple(f) for f in v] for k, v in plain["files"].items()}
        return Table(T.StructType.fromJson(plain["schema"]), plain["key"], plain["n"], files)

    def folders(self, buckets: set[int] | None = None) -> list[str]:
        return [path for k, found in sorted(self.files.items()) if buckets is None or k in buckets for path, _ in found]

    def bytes(self) -> int:
        return sum(size for found in self.files.values() for _, size in found)


def conformed(rows: DataFrame, schema: T.StructType) -> DataFrame:
    """``rows`` with the types that a table's columns have."""
    known = {f.name: f.dataType for f in schema.fields}
    return rows.select(*(F.col(c).cast(known[c]).alias(c) if c in known else F.col(c) for c in rows.columns))


def joined_schema(a: T.StructType, b: T.StructType) -> T.StructType:
    """The columns of ``a``, and those that only ``b`` has."""
    return T.StructType([*a.fields, *(f for f in b.fields if f.name not in a.names)])


class Transaction:
    """Changes of one version, seen by ``read`` at once and by others after ``publish``."""

    def __init__(self, house: Warehouse) -> None:
        self.house, self.spark = house, house.spark
        self.version, self.tables = house.head()
        self.base = self.version
        #: Buckets written, for each table; None for a whole table.
        self.wrote: dict[str, set[int] | None] = {}
        self.folders: list[str] = []

    def has(self, table: str) -> bool:
        return table in self.tables

    def read(self, table: str, empty: str | None = None, buckets: set[int] | None = None) -> DataFrame:
        """The table, or some of its buckets; where there is none yet, an empty one of a given schema."""
        found = self.tables.get(table)
        if found is None:
            if empty is None:
                raise FileNotFoundError(f"no table {table} in {self.house.root}")
            return self.spark.createDataFrame([], empty)
        paths = [f"{self.house.root}/{p}" for p in found.folders(buckets)]
        return self.spark.read.schema(found.schema).parquet(*paths) if paths else self.spark.createDataFrame([], found.schema)

    def _store(self, table: str, rows: DataFrame, key: str | None, n: int, sort: tuple[str, ...] = ()) -> dict[int, list[tuple[str, int]]]:
        """Write rows by bucket; a crowded bucket is several files."""
        folder = f"data/{table}/{uuid.uuid4().hex}"
        self.folders.append(folder)
        filed = rows.withColumn(BUCKET, bucket_of(F.col(key), n) if key else F.lit(0)).hint("rebalance", BUCKET)
        filed = filed.sortWithinPartitions(BUCKET, *sort) if sort else filed
        filed.write.partitionBy(BUCKET).parquet(f"{self.house.root}/{folder}")
        names = [name for name, _ in listed(self.spark, f"{self.house.root}/{folder}") if name.startswith(f"{BUCKET}=")]
        return {int(x.partition("=")[2]): [(f"{folder}/{x}", bytes_below(self.spark, f"{self.house.root}/{folder}/{x}"))] for x in names}

    def _touched(self, table: str, buckets: set[int] | None) -> None:
        before = self.wrote.get(table, set())
        self.wrote[table] = None if buckets is None or before is None else before | buckets

    def write(self, table: str, rows: DataFrame, key: str | None = None, n: int | None = None, sort: tuple[str, ...] = ()) -> None:
        """Replace a table."""
        n = (n or BUCKETS) if key else 1
        self.tables[table] = Table(rows.schema, key, n, self._store(table, rows, key, n, sort))
        self._touched(table, None)

    def share(self, table: str, of: str, key: str, columns: list[str]) -> bool:
        """Let a table be the files of another, which this change itself wrote whole and by that key; whether it could be.

        Files stay as they are, so that each of both changes by itself from then on.
        """
        own = self.tables.get(of)
        if own is None or own.key != key or self.wrote.get(of, set()) is not None:
            return False
        schema = T.StructType([own.schema[c] for c in columns])
        self.tables[table] = Table(schema, key, own.n, {k: list(v) for k, v in own.files.items()})
        self._touched(table, None)
        return True

    def _rewrite(self, table: str, keys: DataFrame, buckets: set[int], added: dict[int, list[tuple[str, int]]], schema: T.StructType) -> None:
        """Buckets without the rows of ``keys``, and with what was added to them."""
        old = self.tables[table]
        held = {k for k in buckets if k in old.files}
        kept: dict[int, list[tuple[str, int]]] = {}
        if held:
            names = keys.select(F.col(old.key).cast(old.schema[old.key].dataType).alias("__key")).distinct()
            rows = self.read(table, buckets=held)
            kept = self._store(table, rows.join(names, rows[old.key].eqNullSafe(names["__key"]), "left_anti"), old.key, old.n)
        files = {k: v for k, v in old.files.items() if k not in buckets}
        for k in sorted(buckets):
            if found := [*kept.get(k, []), *added.get(k, [])]:
                files[k] = found
        self.tables[table] = Table(schema, old.key, old.n, files)
        self._touched(table, buckets)

    def append(self, table: str, rows: DataFrame, key: str, sort: tuple[str, ...] = (), n: int = BUCKETS) -> None:
        """More rows beside those there are, in folders of their own; ``sort``: order of the rows in a file; ``n``: buckets
        of a new table."""
        old = self.tables.get(table)
        rows, n = (conformed(rows, old.schema), old.n) if old else (rows, n)
        added = self._store(table, rows, key, n, sort)
        schema = joined_schema(old.schema, rows.schema) if old else rows.schema
        files = {k: list(v) for k, v in old.files.items()} if old else {}
        for k, found in added.items():
            files[k] = [*files.get(k, []), *found]
        self.tables[table] = Table(schema, key, n, files)
        self._touched(table, set(added) if old else None)

    def merge(self, table: str, rows: DataFrame, key: str = "doc_id") -> None:
        """Rows in place of all that share their keys, a null key being one like any other; new columns are added."""
        old = self.tables.get(table)
        if old is None:
            return self.write(table, rows, key)
        if old.key != key:
            self.write(table, self.read(table), key)
            old = self.tables[table]
        if old.bytes() > 8 * TARGET * old.n:
            self.write(table, self.read(table), key, -(-old.bytes() // TARGET))
            old = self.tables[table]
        rows = conformed(rows, old.schema)
        added = self._store(table, rows, key, old.n)
        if added:
            new = self.spark.read.schema(rows.schema).parquet(*(f"{self.house.root}/{p}" for found in added.values() for p, _ in found))
            self._rewrite(table, new, set(added), added, joined_schema(old.schema, rows.schema))

    def delete(self, table: str, keys: DataFrame) -> None:
        """Drop the rows whose keys ``keys`` names, in a column of the table's key's name."""
        old = self.tables.get(table)
        if old is None:
            return
        if old.key is None:
            raise ValueError(f"table {table} has no key")
        # at most as many values as buckets
        touched = {r[0] for r in keys.select(bucket_of(F.col(old.key), old.n)).distinct().collect()} & set(old.files)
        if touched:
            self._rewrite(table, keys, touched, {}, old.schema)

    def drop(self, table: str) -> None:
        if self.tables.pop(table, None) is not None:
            self._touched(table, None)

    def _entry(self) -> str:
        wrote = {t: None if b is None else sorted(b) for t, b in self.wrote.items()}
        return json.dumps({"tables": {t: x.plain() for t, x in self.tables.items()}, "wrote": wrote})

    def _rebase(self) -> bool:
        """Take over what others have committed since; False if that meets what was written here."""
        newest, theirs = self.house.head()
        for version in range(self.version + 1, newest + 1):
            changed = self.house.changed(version)
            for table, buckets in (self.wrote if changed is None else changed).items():
                if changed is None or (table in self.wrote and (buckets is None or self.wrote[table] is None or buckets & self.wrote[table])):
                    return False
        mine = self.tables
        self.version, self.tables = newest, theirs
        for table, buckets in self.wrote.items():
            if buckets is None:
                self.tables.pop(table, None)
                if table in mine:
                    self.tables[table] = mine[table]
                continue
            into, own = self.tables[table], mine[table]
            files = {k: v for k, v in into.files.items() if k not in buckets} | {k: own.files[k] for k in buckets if k in own.files}
            self.tables[table] = Table(joined_schema(into.schema, own.schema), into.key, into.n, files)
        return True

    def publish(self) -> bool:
        """Make the changes the next version; False if another writer was there first and changed the same buckets."""
        while self.wrote:
            if put_if_absent(self.spark, self.house.place(self.version + 1), self._entry()):
                break
            if not self._rebase():
                return False
        return True

    def discard(self) -> None:
        """Remove what was written for changes that will not be published."""
        for folder in self.folders:
            remove(self.spark, f"{self.house.root}/{folder}")


@dataclass(frozen=True)
class Warehouse:
    """Tables below a root that every executor reaches."""

    spark: SparkSession
    root: str

    def place(self, version: int) -> str:
        return f"{self.root}/_log/{version:012d}.json"

    def _versions(self) -> list[int]:
        return sorted(int(name[:12]) for name, _ in listed(self.spark, f"{self.root}/_log") if name.endswith(".json") and name[:12].isdigit())

    def head(self) -> tuple[int, dict[str, Table]]:
        """The newest version, and its tables."""
        versions = self._versions()
        if not versions:
            return 0, {}
        plain = json.loads(read_text(self.spark, self.place(versions[-1])))
        return versions[-1], {t: Table.of(x) for t, x in plain["tables"].items()}

    def changed(self, version: int) -> dict[str, set[int] | None] | None:
        """What a version wrote; None if that is no longer on record."""
        if version not in self._versions():
            return None
        wrote = json.loads(read_text(self.spark, self.place(version)))["wrote"]
        return {t: None if b is None else set(b) for t, b in wrote.items()}

    def begin(self) -> Transaction:
        return Transaction(self)

    def commit(self, change: Callable[[Transaction], None], tries: int = 20) -> int:
        """Do ``change`` and publish it, again on the newest version where another writer came first; the version."""
        for _ in range(tries):
            transaction = self.begin()
            try:
                change(transaction)
            except BaseException:
                transaction.discard()
                raise
            # where publishing itself fails, the version may stand: what it names stays, and `vacuum` finds what it doesn't
            if transaction.publish():
                return transaction.version + bool(transaction.wrote)
            transaction.discard()
        raise Conflict(f"gave up after {tries} tries")

    def has(self, table: str) -> bool:
        return self.begin().has(table)

    def read(self, table: str, empty: str | None = None) -> DataFrame:
        """The table as it stands; where there is none yet, an empty one of a given schema."""
        return self.begin().read(table, empty)

    def write(self, table: str, rows: DataFrame, key: str | None = None) -> None:
        self.commit(lambda t: t.write(table, rows, key))

    def merge(self, table: str, rows: DataFrame, key: str = "doc_id") -> None:
        self.commit(lambda t: t.merge(table, rows, key))

    def get(self, table: str, key: str, value) -> dict | None:
        """One row by its key; if the table is filed by it, only its bucket is read."""
        now = self.begin()
        found = now.tables.get(table)
        buckets = None
        if found is not None and found.key == key:
            typed = F.lit(value).cast(found.schema[key].dataType)
            buckets = {self.spark.range(1).select(bucket_of(typed, found.n)).first()[0]}
        row = now.read(table, buckets=buckets).where(F.col(key) == value).limit(1).first()
        return row.asDict(recursive=True) if row else None

    def reset(self) -> None:
        """Drop all tables."""
        self.commit(lambda t: [t.drop(x) for x in list(t.tables)])

    def vacuum(self, keep: int = 2, older_than: float = 3600) -> list[str]:
        """Remove versions but the newest ``keep``, and folders of buckets that none of these name; what they were.

        Folders younger than ``older_than`` seconds stay, as a writer may be about to commit them.
        """
        versions = self._versions()
        kept = versions[-keep:]
        named = {f for v in kept for x in json.loads(read_text(self.spark, self.place(v)))["tables"].values() for f in Table.of(x).folders()}
        gone = []
        for version in versions[: -len(kept) or None] if kept else []:
            remove(self.spark, self.place(version))
        for table, _ in listed(self.spark, f"{self.root}/data"):
            for name, changed in listed(self.spark, f"{self.root}/data/{table}"):
                folder = f"data/{table}/{name}"
                if time.time() - changed / 1000 < older_than:
                    continue
                parts = [f"{folder}/{part}" for part, _ in listed(self.spark, f"{self.root}/{folder}") if part.startswith(f"{BUCKET}=")]
                unnamed = [p for p in parts if p not in named]
                unnamed = [folder] if len(unnamed) == len(parts) else unnamed
                for path in unnamed:
                    remove(self.spark, f"{self.root}/{path}")
                gone += unnamed
        return gone
