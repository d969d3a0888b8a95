"""Benchmark passages in documents: Wu-Manber search over words.

The symbols are words. Patterns are the windows of the benchmark items: every run of ``window`` words, or the whole
item where it is shorter. Patterns of one length share a table: a shift for every block of two words, and buckets of
patterns by their last block. A block that no pattern holds lets the search skip a whole window but one word.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strataledger.llm.storage import written
from strataledger.llm.words import alnum_words

#: Windows that one set of tables may hold; more are searched in several passes.
MOST_WINDOWS = 200_000
#: Windows that one row of a cut benchmark holds, so a long item is spread over passes.
PIECE_WINDOWS = 10_000


class WindowIndex:
    """Tables for the windows of pieces of benchmark items: the item, the length of its windows, and words."""

    def __init__(self, pieces: Iterable[tuple[str | None, int, bytes]]) -> None:
        patterns: dict[int, dict[tuple[bytes, ...], set[str | None]]] = defaultdict(lambda: defaultdict(set))
        for item, m, text in pieces:
            words = text.split(b" ")
            for i in range(len(words) - m + 1):
                patterns[m][tuple(words[i : i + m])].add(item)
        self.tables = []
        for m, by_words in sorted(patterns.items()):
            b = min(2, m)
            shift: dict[bytes, int] = {}
            buckets: dict[bytes, dict[bytes, tuple]] = defaultdict(dict)
            for words, found in by_words.items():
                for end in range(b, m + 1):
                    block = b" ".join(words[end - b : end])
                    shift[block] = min(shift.get(block, m), m - end)
                buckets[b" ".join(words[m - b :])][b" ".join(words)] = tuple(found)
            self.tables.append((m, b, m - b + 1, shift, dict(buckets)))

    def search(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str | None]]:
        """Spans ``(start, end)`` of words that occurrences cover, and the items that occur."""
        spans, items, n = [], set(), len(words)
        for m, b, most, shift, buckets in self.tables:
            get, end = shift.get, m
            while end <= n:
                block = words[end - 2] + b" " + words[end - 1] if b == 2 else words[end - 1]
                step = get(block, most)
                if step:
                    end += step
                    continue
                found = buckets[block].get(b" ".join(words[end - m : end]))
                if found is not None:
                    spans.append((end - m, end))
                    items.update(found)
                end += 1
        return spans, items


def merged(spans: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    """The same words as disjoint spans in order."""
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def cut_items(benchmark: DataFrame, window: int) -> DataFrame:
    """``item, m, windows, words`` of pieces of items: ``m`` words make a window, and a piece holds some windows."""

    def run(batches):
        for batch in batches:
            rows = []
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                words = alnum_words(text.as_py())
                m = min(window, len(words))
                n = len(words) - m + 1 if m else 0
                for a in range(0, n, PIECE_WINDOWS):
                    own = min(PIECE_WINDOWS, n - a)
                    rows.append((item, m, own, b" ".join(words[a : a + own + m - 1])))
            columns = zip(*rows, strict=True) if rows else [()] * 4
            kinds = (pa.string(), pa.int32(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["item", "m", "windows", "words"]
            )

    items = benchmark.select(F.col("item_id").cast("string").alias("item"), "text")
    return items.mapInArrow(run, "item string, m int, windows long, words binary")


def _passes(benchmark: DataFrame, window: int, most_windows: int) -> list[DataFrame]:
    """The pieces of the benchmark, in parts of about ``most_windows``."""
    pieces = written(cut_items(benchmark, window), "benchmark-pieces")
    total = pieces.agg(F.sum("windows")).first()[0] or 0
    parts = -(-total // most_windows) or 1
    part = F.pmod(F.xxhash64("item", "words"), F.lit(parts))
    return [pieces.where(part == k) if parts > 1 else pieces for k in range(parts)]


def _scan(docs: DataFrame, index, extra: T.StructType) -> DataFrame:
    """Add the spans and items of one index to what earlier passes found."""
    kept_names = [f.name for f in docs.schema if f.name not in extra.names]
    schema = T.StructType([*(f for f in docs.schema if f.name in kept_names), *extra])
    out_names = schema.names

    def scan(batches):
        tables = index.value
        for batch in batches:
            names = batch.schema.names
            texts = batch.column(names.index("text"))
            had = names.index("__spans") if "__spans" in names else None
            starts, items_out, counts = [], [], []
            for i in range(batch.num_rows):
                words = alnum_words(texts[i].as_py())
                spans, items = tables.search(words)
                if had is not None:
                    flat = batch.column(had)[i].as_py()
                    spans += zip(flat[::2], flat[1::2], strict=True)
                    items |= set(batch.column(names.index("__items"))[i].as_py())
                starts.append([x for span in merged(spans) for x in span])
                items_out.append(sorted(x for x in items if x is not None))
                counts.append(len(words))
            kept = [batch.column(names.index(name)) for name in kept_names]
            found = [
                pa.array(counts, pa.int64()),
                pa.array(starts, pa.list_(pa.int64())),
                pa.array(items_out, pa.list_(pa.string())),
            ]
            yield pa.RecordBatch.from_arrays([*kept, *found], names=out_names)

    return docs.mapInArrow(scan, schema)


_FOUND = T.StructType(
    [
        T.StructField("__words", T.LongType()),
        T.StructField("__spans", T.ArrayType(T.LongType())),
        T.StructField("__items", T.ArrayType(T.StringType())),
    ]
)


def find_windows(
    docs: DataFrame, benchmark: DataFrame, window: int = 10, most_windows: int = MOST_WINDOWS
) -> DataFrame:
    """``docs`` with ``__words``, ``__spans`` (flat: start, end, start, ...) and ``__items`` (sorted strings).

    Null and empty texts have no words and no spans. Items without words have no windows; a null item_id gives
    spans but no name. Repeated rows are searched each for itself. A benchmark of more than ``most_windows`` windows is
    searched in several passes. Each but the last is written out and its tables destroyed before the next are built,
    so driver and workers never hold the tables of more than one pass.
    """
    context, out = docs.sparkSession.sparkContext, docs
    parts = _passes(benchmark, window, most_windows)
    for k, pieces in enumerate(parts):
        index = context.broadcast(WindowIndex((r.item, r.m, bytes(r.words)) for r in pieces.toLocalIterator()))
        out = _scan(out, index, _FOUND)
        if k + 1 < len(parts):
            out = written(out, "windows")
            index.destroy()
    return out


def contamination(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """One row per document: ``doc_id, n_words, n_hit, n_items, items_sha256, contaminated``."""
    found = find_windows(docs.select("doc_id", "text"), benchmark, **options)
    hit = F.expr(
        "aggregate(sequence(1, size(__spans), 2), 0L, (n, i) -> n + __spans[i] - __spans[i - 1])"
    )
    n_hit = F.when(F.size("__spans") > 0, hit).otherwise(F.lit(0).cast("long"))
    return found.select(
        "doc_id",
        F.col("__words").alias("n_words"),
        n_hit.alias("n_hit"),
        F.size("__items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "__items"), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


def without_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """Rows of ``docs`` in which no window occurs, with their own columns.

    Null and empty texts stay, rows that repeat an id are judged each for itself, and an empty table gives no rows. Without
    items all rows stay. ``__words``, ``__spans`` and ``__items`` are the search's own names.
    """
    return find_windows(docs, benchmark, **options).where(F.size("__spans") == 0).select(*docs.columns)
