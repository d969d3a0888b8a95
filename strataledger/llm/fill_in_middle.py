"""Fill-in-middle: texts cut at token bounds and put together again around sentinels.

A kernel works on the Arrow buffer of a whole batch. A table of byte classes marks letters and first bytes of code
points, neighbours tell where tokens begin, sums that start anew in each document count them, and one ``searchsorted``
finds the cuts of all rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strataledger.sources.storage import spread

#: Marks of the prefix, the suffix and the middle.
SENTINELS = ("<P>", "<S>", "<M>")
BYTES = np.arange(256)
LETTER = ((BYTES | 32) >= 97) & ((BYTES | 32) <= 122) & (BYTES < 128)
#: Not the second or a later byte of a code point.
LEAD = (BYTES & 0xC0) != 0x80
#: Bytes of text that a kernel takes at once; a longer text is taken alone.
TOGETHER = 4 << 20


def _buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (from 0) of a column of strings."""
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    flat = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return flat[at[0] : at[-1]], at - at[0]


def _parts(offsets: np.ndarray, most: int = TOGETHER) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``most`` bytes."""
    a, rows = 0, len(offsets) - 1
    while a < rows:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + most, "right")) - 1)
        yield a, b
        a = b


def _gathered(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """Rows of pieces of ``flat`` (both arrays: rows x pieces), put together as strings."""
    sizes = lengths.sum(axis=1)
    offsets = np.concatenate(([0], np.cumsum(sizes)))
    if offsets[-1] >= 1 << 31:
        raise ValueError("a text beyond 2 GB")
    runs, ends = lengths.ravel(), np.cumsum(lengths.ravel())
    places = np.repeat(starts.ravel() - (ends - runs), runs) + np.arange(offsets[-1])
    data = pa.py_buffer(np.ascontiguousarray(flat[places]))
    return pa.Array.from_buffers(pa.string(), len(sizes), [None, pa.py_buffer(offsets.astype(np.int32)), data])


def _marks(flat: np.ndarray, offsets: np.ndarray, sentinels: tuple[bytes, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places, kinds and rows of the sentinels that lie whole inside a row, in order of place."""
    places, kinds = [], []
    for kind, mark in enumerate(sentinels):
        room = len(flat) - len(mark) + 1
        hit = np.ones(max(0, room), bool)
        for k, byte in enumerate(mark):
            hit &= flat[k : k + len(hit)] == byte
        places.append(np.flatnonzero(hit))
        kinds.append(np.full(len(places[-1]), kind))
    at, kind = np.concatenate(places), np.concatenate(kinds)
    order = np.argsort(at, kind="stable")
    at, kind = at[order], kind[order]
    row = np.searchsorted(offsets, at, "right") - 1
    whole = at + np.array([len(m) for m in sentinels])[kind] <= offsets[row + 1]
    return at[whole], kind[whole], row[whole]


def _transform(flat, offsets, h, plain_from: int, spm_below: int, sentinels: tuple[bytes, ...]):
    """``n, form (0 plain, 1 psm, 2 spm), prefix_chars, middle_chars, output`` of the rows of a batch."""
    rows, begin, end = len(offsets) - 1, offsets[:-1], offsets[1:]
    letter, lead = LETTER[flat], LEAD[flat]
    joined = letter.copy()
    joined[1:] &= letter[:-1]
    joined[:1] = False
    joined[begin[begin < end]] = False
    counts = np.int32 if len(flat) < 1 << 31 else np.int64
    tokens = np.concatenate(([0], np.cumsum(lead & ~joined, dtype=counts)))
    chars = np.concatenate(([0], np.cumsum(lead, dtype=counts)))
    base = tokens[begin].astype(np.int64)
    n = tokens[end] - base
    first, second = h[0] % (n + 1), h[1] % (n + 1)
    # the token after the cut is the first byte at which the count goes beyond it; a cut behind the last one is the end
    low, high = (np.minimum(np.searchsorted(tokens[1:], base + k + 1), end) for k in (np.minimum(first, second), np.maximum(first, second)))
    marked = np.bincount(_marks(flat, offsets, sentinels)[2], minlength=rows) > 0
    plain = (begin == end) | marked | (h[2] % 100 >= plain_from)
    spm = ~plain & (h[3] % 100 < spm_below)
    source = np.concatenate((flat, np.frombuffer(b"".join(sentinels), np.uint8)))
    sizes = np.array([len(m) for m in sentinels])
    at = len(flat) + np.cumsum(sizes) - sizes
    whole = lambda x: np.full(rows, x)
    mark = [(whole(at[k]), np.where(plain, 0, sizes[k])) for k in range(3)]
    prefix, middle, suffix = (begin, low - begin), (low, high - low), (high, end - high)
    pick = lambda a, b: tuple(np.where(spm, y, x) for x, y in zip(a, b, strict=True))
    pieces = [pick(mark[0], mark[1]), pick(prefix, suffix), pick(mark[1], mark[0]), pick(suffix, prefix), mark[2], middle]
    # a plain text is its first piece, whole
    pieces = [(np.where(plain, begin, s), np.where(plain, (end - begin) * (k == 0), size)) for k, (s, size) in enumerate(pieces)]
    output = _gathered(source, *(np.stack(x, axis=1) for x in zip(*pieces, strict=True)))
    return n, np.where(plain, 0, np.where(spm, 2, 1)), chars[low] - chars[begin], chars[high] - chars[low], output


def _restore(flat: np.ndarray, offsets: np.ndarray, plain: np.ndarray, spm: np.ndarray, sentinels: tuple[bytes, ...]) -> pa.Array:
    """The texts that outputs were made from."""
    begin, end = offsets[:-1], offsets[1:]
    at, kind, row = _marks(flat, offsets, sentinels)
    made = ~plain[row]
    at, kind, row = at[made], kind[made], row[made]
    found = np.flatnonzero(~plain)
    if not np.array_equal(row, np.repeat(found, 3)):
        raise ValueError("an output without its three sentinels")
    at, kind = at.reshape(-1, 3), kind.reshape(-1, 3)
    if (at[:, 0] != begin[found]).any() or (kind != np.where(spm[found, None], (1, 0, 2), (0, 1, 2))).any():
        raise ValueError("an output whose sentinels are not those of its form")
    starts = at + np.array([len(m) for m in sentinels])[kind]
    sizes = np.concatenate((at[:, 1:], end[found, None]), axis=1) - starts
    order = np.where(spm[found, None], (1, 2, 0), (0, 2, 1))  # prefix, middle, suffix
    all_starts = np.stack((begin, begin, begin), axis=1)
    all_sizes = np.stack((end - begin, 0 * begin, 0 * begin), axis=1)
    all_starts[found], all_sizes[found] = np.take_along_axis(starts, order, 1), np.take_along_axis(sizes, order, 1)
    return _gathered(flat, all_starts, all_sizes)


def _checked(sentinels: tuple[str, ...]) -> tuple[bytes, ...]:
    """A mark from ``<`` to ``>`` can't arise from text beside it, so a made text holds each just once."""
    if len(set(sentinels)) != 3 or any(len(m) < 3 or m[0] + m[-1] != "<>" or set(m[1:-1]) & set("<>") for m in sentinels):
        raise ValueError("three different sentinels of the form <name>")
    return tuple(m.encode() for m in sentinels)


def draw(doc_id: Column, seed: int, k: int) -> Column:
    """The ``k``-th group of eight digits of a digest of seed and id, as a number."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long")


def fill_in_middle(
    docs: DataFrame, seed: int = 1, rate: int = 90, spm_rate: int = 20, sentinels: tuple[str, str, str] = SENTINELS
) -> DataFrame:
    """``doc_id, n, form, prefix_chars, middle_chars, output`` for every row of ``docs``.

    Tokens are runs of ASCII letters, and every other code point by itself. Two draws from the digest of seed and id
    choose the ends of prefix and middle among the ``n + 1`` bounds; two more choose the form: ``plain`` in
    ``100 - rate`` of 100, ``spm`` in ``spm_rate`` of 100 of the others, else ``psm``. Empty and null texts, and those
    that hold a sentinel, are plain: the output is the text, and both lengths are null. A null id draws as an empty one.
    Rows that repeat an id draw alike; an empty table gives no rows; columns other than ``doc_id`` and ``text`` are not
    read. A text may have up to 2 GB; the kernel needs some 40 bytes for each of a longer text than ``TOGETHER``.
    """
    marks = _checked(sentinels)
    schema = T.StructType(
        [docs.schema["doc_id"], T.StructField("n", T.LongType()), T.StructField("form", T.StringType())]
        + [T.StructField(c, T.LongType()) for c in ("prefix_chars", "middle_chars")]
        + [T.StructField("output", T.StringType())]
    )

    def run(batches):
        for batch in batches:
            flat, offsets = _buffers(batch.column(1))
            draws = [batch.column(2 + k).to_numpy() for k in range(4)]
            for a, b in _parts(offsets):
                own = flat[offsets[a] : offsets[b]]
                made = _transform(own, offsets[a : b + 1] - offsets[a], [h[a:b] for h in draws], rate, spm_rate, marks)
                n, form, prefix, middle, output = made
                lengths = (pa.array(x.astype(np.int64), mask=form == 0) for x in (prefix, middle))
                names = pa.array(["plain", "psm", "spm"]).take(pa.array(form))
                columns = [batch.column(0).slice(a, b - a), pa.array(n.astype(np.int64)), names, *lengths, output]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    text = F.coalesce(F.col("text"), F.lit("")).alias("text")
    rows = spread(docs.select("doc_id", "text"))
    return rows.select("doc_id", text, *(draw(F.col("doc_id"), seed, k).alias(f"h{k}") for k in range(4))).mapInArrow(run, schema)


def restored(made: DataFrame, sentinels: tuple[str, str, str] = SENTINELS) -> DataFrame:
    """``made`` with ``text``, rebuilt from ``output`` and ``form`` alone; other columns pass.

    A row whose output lacks the sentinels of its form fails the job. A column named ``text`` is replaced.
    """
    marks, made = _checked(sentinels), made.drop("text")
    schema = T.StructType([*made.schema.fields, T.StructField("text", T.StringType())])
    at = {c: made.columns.index(c) for c in ("output", "form")}

    def run(batches):
        for batch in batches:
            flat, offsets = _buffers(batch.column(at["output"]))
            form = batch.column(at["form"]).to_numpy(zero_copy_only=False)
            plain, spm = form == "plain", form == "spm"
            for a, b in _parts(offsets):
                text = _restore(flat[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], plain[a:b], spm[a:b], marks)
                yield pa.RecordBatch.from_arrays([*(c.slice(a, b - a) for c in batch.columns), text], names=schema.names)

    return made.mapInArrow(run, schema)


def digests(docs: DataFrame) -> DataFrame:
    """``doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256`` with production parameters."""
    rows = restored(fill_in_middle(docs))
    hashes = [F.sha2("output", 256).alias("output_sha256"), F.sha2("text", 256).alias("restored_sha256")]
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *hashes)
