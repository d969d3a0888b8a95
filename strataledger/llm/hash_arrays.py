"""Sorted arrays of 64-bit hashes: as compact bytes between tasks, and as files that workers map into memory."""

from __future__ import annotations

import json
import mmap
import os
import sys
import uuid
from collections import OrderedDict
from collections.abc import Callable
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

M1, M2, M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that scatters them."""
    x = (x ^ (x >> np.uint64(30))) * M2
    x = (x ^ (x >> np.uint64(27))) * M3
    return x ^ (x >> np.uint64(31))


def chain(first: np.ndarray, *others: np.ndarray) -> np.ndarray:
    """Hash of a sequence of hashes, elementwise."""
    out = mix(first + M1)
    for x in others:
        out = mix(out * M1 + x)
    return out


def to_bytes(values: np.ndarray) -> bytes:
    """Unsigned numbers as compressed byte planes; few planes are used where numbers are small."""
    values = np.ascontiguousarray(values, dtype="<u8")
    planes = values.view(np.uint8).reshape(-1, 8)
    used = max(1, (int(values.max(initial=0)).bit_length() + 7) // 8)
    raw = np.ascontiguousarray(planes[:, :used].T).tobytes()
    head = np.array([len(values), used], "<u8").tobytes()
    return head + (pa.compress(raw, codec="zstd", asbytes=True) if raw else b"")


def from_bytes(data: bytes) -> np.ndarray:
    n, used = np.frombuffer(data, "<u8", 2).astype(int).tolist()
    out = np.zeros((n, 8), np.uint8)
    if n:
        raw = pa.decompress(data[16:], decompressed_size=n * used, codec="zstd", asbytes=True)
        out[:, :used] = np.frombuffer(raw, np.uint8).reshape(used, n).T
    return out.view("<u8").ravel()


def size_of(data: bytes) -> int:
    """How many numbers ``to_bytes`` packed."""
    return int.from_bytes(data[:8], "little")


def sorted_to_bytes(values: np.ndarray) -> bytes:
    """Ascending numbers by their differences."""
    return to_bytes(np.diff(values, prepend=np.uint64(0)))


def sorted_from_bytes(data: bytes) -> np.ndarray:
    return np.cumsum(from_bytes(data), dtype=np.uint64)


def local_folder(uri: str) -> str:
    """The shared folder as workers open it; memory maps need it to be mounted."""
    parsed = urlparse(uri)
    if parsed.scheme not in ("", "file"):
        raise ValueError(f"memory-mapped arrays need a mounted spark.checkpoint.dir, not {parsed.scheme}:")
    return parsed.path


def save(folder: str, **arrays: np.ndarray) -> str:
    """Write arrays as one file, under a name that no other attempt of a task uses; only names that a job returns are
    read. The file begins with the length of its directory and the directory: kind, start and length of each array."""
    os.makedirs(folder, exist_ok=True)
    name, at, entries = uuid.uuid4().hex, 0, {}
    for key, values in arrays.items():
        entries[key] = (values.dtype.str[1:], at, len(values))
        at += -(-values.nbytes // 8) * 8
    directory = json.dumps(entries).encode()
    directory += b" " * (-(len(directory) + 8) % 8)
    with open(os.path.join(folder, name), "wb") as file:
        file.write(len(directory).to_bytes(8, "little") + directory)
        for values in arrays.values():
            raw = np.ascontiguousarray(values).tobytes()
            file.write(raw + b"\0" * (-len(raw) % 8))
    return name


class MappedFiles:
    """Arrays of a folder's files as memory maps; the file read longest ago is closed when more than ``most`` are open."""

    def __init__(self, folder: str, most: int = 256) -> None:
        self.folder, self.most = folder, most
        self.open: OrderedDict[str, dict[str, np.ndarray]] = OrderedDict()

    def __getstate__(self):
        return self.folder, self.most

    def __setstate__(self, state) -> None:
        self.__init__(*state)

    def _load(self, name: str) -> dict[str, np.ndarray]:
        with open(os.path.join(self.folder, name), "rb") as file:
            untracked = {"trackfd": False} if sys.version_info >= (3, 13) else {}
            whole = np.frombuffer(mmap.mmap(file.fileno(), 0, access=mmap.ACCESS_READ, **untracked), np.uint8)
        start = 8 + int.from_bytes(whole[:8].tobytes(), "little")
        entries = json.loads(whole[8:start].tobytes())
        size = {key: np.dtype(kind).itemsize for key, (kind, _, _) in entries.items()}
        return {key: whole[start + at : start + at + n * size[key]].view(kind) for key, (kind, at, n) in entries.items()}

    def arrays(self, name: str) -> dict[str, np.ndarray]:
        """The arrays of a file; a map ends once it is closed here and its arrays are gone."""
        if name in self.open:
            self.open.move_to_end(name)
        else:
            while len(self.open) >= self.most:
                self.open.popitem(last=False)
            self.open[name] = self._load(name)
        return self.open[name]


#: Ranges that what a task has counted is cut into; more shards than these are told apart in a second step.
COARSE = 256


def dealt(parts: DataFrame, shards: int, again: Callable, coarse: int | None = None) -> DataFrame:
    """Rows ``shard, ...`` from rows whose ``shard`` is that of a range of up to ``shards / coarse`` shards.

    A task that counts writes at most ``coarse`` rows each time, not one for each of the shards, whose number grows
    with the input as that of the tasks does. Here each range meets in one partition, in order; ``again`` takes its
    batches, and gives rows of the final shards whenever it has gathered enough.
    """
    coarse = coarse or COARSE
    if shards <= coarse:
        return parts
    return parts.repartition(coarse, "shard").sortWithinPartitions("shard").mapInArrow(again, parts.schema)


def width_of(shards: int, coarse: int | None = None) -> int:
    """How many shards a range holds in what tasks write first."""
    return -(-shards // (coarse or COARSE))


class WordHashes(dict):
    """Numbers of words, in order of arrival, and their 64-bit hashes; forgets all beyond a size."""

    def __init__(self, most: int = 500_000) -> None:
        super().__init__()
        self.most, self.table, self.fresh = most, np.zeros(1 << 16, np.uint64), []

    def __missing__(self, word: bytes) -> int:
        self.fresh.append(xxhash.xxh3_64_intdigest(word))
        self[word] = n = len(self)
        return n

    def index(self, words: list[bytes]) -> np.ndarray:
        out = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        if self.fresh:
            while len(self) > len(self.table):
                self.table = np.append(self.table, np.zeros_like(self.table))
            self.table[len(self) - len(self.fresh) : len(self)] = self.fresh
            self.fresh = []
        return out

    def hashes(self, words: list[bytes]) -> np.ndarray:
        if len(self) > self.most:
            self.clear()
        index = self.index(words)  # may replace the table
        return self.table[index]


def find(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Position of each of ``wanted`` (ascending, for locality) in ascending ``keys``, or -1."""
    if not len(keys):
        return np.full(len(wanted), -1)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, at, -1)


def unique_counts(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values in order and how often each occurs, by one sort."""
    ordered = np.sort(values)
    first = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1])) if len(ordered) else np.zeros(0, np.int64)
    return ordered[first], np.diff(np.append(first, len(ordered)))


def sum_by_key(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys in order, and the sums of each column over them."""
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    first = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1])) if len(ordered) else np.zeros(0, np.int64)
    sums = [np.add.reduceat(v[order], first) if len(first) else v[:0] for v in values]
    return ordered[first], *sums
