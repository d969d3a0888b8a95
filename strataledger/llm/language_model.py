"""An interpolated modified Kneser-Ney bigram model.

Words and bigrams of the training rows are counted in tasks, and the counts meet by ranges of hashes. The model is a
folder of sorted hash arrays, one set of files for each shard, which the scoring workers map into memory:

* ``words``: 64-bit hashes of words and their counts;
* ``pairs``: 64-bit hashes of bigrams and their counts, and for each context how many successors it has once, twice,
  and in all;
* ``ends``: 64-bit hashes of words and in how many contexts each occurs.

A bigram belongs to the shard of its context. A context that holds a large part of all tokens is spread over many
shards by its successor; the numbers of these few contexts are summed on the driver.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataledger.llm.hash_arrays import (
    MappedFiles,
    WordHashes,
    chain,
    dealt,
    find,
    from_bytes,
    local_folder,
    mix,
    save,
    size_of,
    sorted_from_bytes,
    sorted_to_bytes,
    sum_by_key,
    to_bytes,
    unique_counts,
    width_of,
)
from strataledger.llm.storage import new_path, partitions_for, written
from strataledger.llm.subword_classifier import fold
from strataledger.llm.words import plain_words

#: No word holds a space.
START, END = b" start", b" end"
#: Tokens that a task gathers before it passes on what it has counted.
GATHERED = 3_000_000
SPREAD = 64
#: Files of the model that a worker keeps open.
OPEN_FILES = 4096
EMPTY = np.zeros(0, np.uint64)
PARTS = pa.schema([("kind", pa.string()), ("shard", pa.int32()), ("keys", pa.binary()), ("more", pa.binary()), ("ends", pa.binary())])
PARTS_DDL = "kind string, shard int, keys binary, more binary, ends binary"


START_HASH, END_HASH = WordHashes().hashes([START, END])


def parts_batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [()] * len(PARTS)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, PARTS, strict=True)], schema=PARTS)


def edges_of(shards: int) -> np.ndarray:
    """Where equal ranges of 64-bit hashes begin, but for the first."""
    return (np.arange(1, shards, dtype=np.float64) * (2.0**64 / shards)).astype(np.uint64)


def cuts(keys: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Where ranges of ascending keys begin and end."""
    return np.append(0, np.append(np.searchsorted(keys, edges), len(keys)))


def token_batches(batches, gathered: int = GATHERED):
    """Numbers of tokens of whole texts in a row, with a start before and an end after each; and their hashes."""
    words, held, n = WordHashes(), [], 0
    for batch in batches:
        for text in batch.column(batch.schema.names.index("text")):
            tokens = [START, *plain_words(text.as_py()), END]
            held.append(words.index(tokens))
            n += len(tokens)
            if n >= gathered:
                yield held, words
                words, held, n = WordHashes(), [], 0
    if held:
        yield held, words


def gathered_rows(batches):
    """Rows of one kind and shard in a row, until they hold as many numbers as a task gathers."""
    rows, n = [], 0
    for batch in batches:
        for row in batch.to_pylist():
            if rows and (row["shard"] != rows[-1]["shard"] or n >= GATHERED):
                yield rows[0]["kind"], rows
                rows, n = [], 0
            rows.append(row)
            n += size_of(row["keys"])
    if rows:
        yield rows[0]["kind"], rows


def shard_of(context: np.ndarray, successor: np.ndarray, hot: np.ndarray, shards: int) -> np.ndarray:
    """The shard of a bigram of hashes; ``hot`` ascends."""
    spread = np.where(find_any(hot, context), successor % np.uint64(SPREAD) + np.uint64(1), np.uint64(0))
    return (mix(context ^ (spread << np.uint64(44))) % np.uint64(shards)).astype(np.int64)


def find_any(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    return find(keys, wanted) >= 0


def discounts(n1: float, n2: float, n3: float, n4: float) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts for counts of one, two, and more; each within its count."""
    y = n1 / (n1 + 2 * n2) if n1 else 0.5
    out = (
        1 - 2 * y * n2 / n1 if n1 else 0.5,
        2 - 3 * y * n3 / n2 if n2 else 0.75,
        3 - 4 * y * n4 / n3 if n3 else 0.9,
    )
    return tuple(min(max(d, 0.05), k) for d, k in zip(out, (0.95, 1.9, 2.85), strict=True))


@dataclass
class Model:
    folder: str
    shards: int
    words: list[str | None]
    pairs: list[str | None]
    ends: list[str | None]
    hot: dict[int, tuple[int, int, int]]
    tokens: int
    types: int
    pair_types: int
    pair_discounts: tuple[float, float, float]
    end_discounts: tuple[float, float, float]
    end_ones: tuple[int, int, int]
    rows: int
    files: MappedFiles = field(init=False)

    def __post_init__(self) -> None:
        self.files = MappedFiles(self.folder, OPEN_FILES)

    @cached_property
    def hot_keys(self) -> np.ndarray:
        return np.array(sorted(self.hot), np.uint64)

    def by_range(self, names: list[str | None], keys: np.ndarray) -> np.ndarray:
        """Counts of ascending keys; 0 where a key is unknown."""
        out = np.zeros(len(keys), np.int64)
        cut = cuts(keys, edges_of(self.shards))
        for k in np.flatnonzero(np.diff(cut)).tolist():
            if names[k] is not None:
                arrays = self.files.arrays(names[k])
                at = find(arrays["keys"], keys[cut[k] : cut[k + 1]])
                out[cut[k] : cut[k + 1]][at >= 0] = arrays["n"][at[at >= 0]]
        return out

    def _by_shard(self, shard: np.ndarray, keys: np.ndarray):
        """Places of the keys of each shard, in order of the keys, with its arrays."""
        order = np.lexsort((keys, shard))
        cut = np.searchsorted(shard[order], np.arange(self.shards + 1))
        for k in np.flatnonzero(np.diff(cut)).tolist():
            if self.pairs[k] is not None:
                yield order[cut[k] : cut[k + 1]], self.files.arrays(self.pairs[k])

    def pair_counts(self, context: np.ndarray, successor: np.ndarray) -> np.ndarray:
        keys, out = chain(context, successor), np.zeros(len(context), np.int64)
        for own, arrays in self._by_shard(shard_of(context, successor, self.hot_keys, self.shards), keys):
            at = find(arrays["keys"], keys[own])
            own, at = own[at >= 0], at[at >= 0]
            n = arrays["n"][at].astype(np.int64)
            large = n == 255
            if large.any():
                n[large] = arrays["big_n"][find(arrays["big_at"], at[large].astype(np.uint64))]
            out[own] = n
        return out

    def successors(self, context: np.ndarray) -> np.ndarray:
        """Rows of (once, twice, in all) for contexts."""
        out = np.zeros((len(context), 3), np.int64)
        hot = find_any(self.hot_keys, context)
        for k in np.flatnonzero(hot).tolist():
            out[k] = self.hot[int(context[k])]
        for own, arrays in self._by_shard(shard_of(context, context, EMPTY, self.shards), context):
            own = own[~hot[own]]
            at = find(arrays["contexts"], context[own])
            own, at = own[at >= 0], at[at >= 0]
            for j, column in enumerate(("once", "twice", "all")):
                out[own, j] = arrays[column][at]
        return out


def _cut_by(n: np.ndarray, d: tuple[float, float, float]) -> np.ndarray:
    return n - np.select([n <= 0, n == 1, n == 2], [0, d[0], d[1]], d[2])


def train(docs: DataFrame) -> Model:
    """Count the tokens and bigrams of all rows of ``docs``, and write the model."""
    spark = docs.sparkSession
    texts = docs.select("text")
    shards = partitions_for(docs, 8 << 20)
    folder = local_folder(new_path(spark, "language-model"))
    edges, width = edges_of(shards), width_of(shards)
    coarse = edges[width - 1 :: width]

    def counts(kind, keys, n, edges):
        """Counts of ascending keys, by range."""
        cut = cuts(keys, edges)
        return [
            (kind, k, sorted_to_bytes(keys[cut[k] : cut[k + 1]]), to_bytes(n[cut[k] : cut[k + 1]] - 1), None)
            for k in np.flatnonzero(np.diff(cut)).tolist()
        ]

    def summed(keys, more):
        n = np.concatenate([from_bytes(b) for b in more]) + np.uint64(1)
        return sum_by_key(np.concatenate([sorted_from_bytes(b) for b in keys]), n)

    def counts_again(batches):
        for kind, rows in gathered_rows(batches):
            yield parts_batch(counts(kind, *summed([r["keys"] for r in rows], [r["more"] for r in rows]), edges))

    def count_words(batches):
        for held, words in token_batches(batches):
            n = np.bincount(np.concatenate(held), minlength=len(words))
            used = np.flatnonzero(n)
            order = used[np.argsort(words.table[used])]
            yield parts_batch(counts("words", words.table[order], n[order], coarse))

    def merge_words(table: pa.Table) -> pa.Table:
        keys, n = summed(table["keys"].to_pylist(), table["more"].to_pylist())
        start = keys == START_HASH
        rows = int(n[start].sum())
        large = np.argsort(n)[-64:]
        large = large[np.argsort(keys[large])]
        name = save(folder, keys=keys[~start], n=n[~start])
        return pa.table(
            [
                [table["shard"][0].as_py()],
                [name],
                [int(n.sum()) - rows],
                [int((~start).sum())],
                [rows],
                [keys[large].tobytes()],
                [n[large].tobytes()],
            ],
            schema=pa.schema(
                [("shard", pa.int32()), ("name", pa.string()), ("tokens", pa.int64()), ("types", pa.int64()), ("rows", pa.int64()), ("large", pa.binary()), ("large_n", pa.binary())]
            ),
        )

    merged = (
        dealt(texts.mapInArrow(count_words, PARTS_DDL), shards, counts_again)
        .groupBy("shard")
        .applyInArrow(merge_words, "shard int, name string, tokens long, types long, rows long, large binary, large_n binary")
    )
    by_word = {r.shard: r for r in written(merged, "lm-words").collect()}  # one row per shard
    tokens = sum(r.tokens for r in by_word.values())
    frequent = [
        key
        for r in by_word.values()
        for key, n in zip(np.frombuffer(r.large, "<u8").tolist(), np.frombuffer(r.large_n, "<u8").tolist(), strict=True)
        if n * 8 * shards > tokens
    ]
    hot = np.array(sorted(set(frequent)), np.uint64)

    def pair_rows(context, successor, n, width):
        """Counts of bigrams, by ``width`` shards."""
        shard = shard_of(context, successor, hot, shards) // width
        order = np.lexsort((successor, context, shard))
        context, successor, n, shard = context[order], successor[order], n[order], shard[order]
        cut = np.flatnonzero(np.append(True, shard[1:] != shard[:-1])).tolist() if len(shard) else []
        return [
            ("pairs", int(shard[a]), sorted_to_bytes(context[a:b]), to_bytes(n[a:b] - 1), to_bytes(successor[a:b]))
            for a, b in zip(cut, [*cut[1:], len(shard)], strict=True)
        ]

    def summed_pairs(rows):
        """Bigrams of several rows, in order, with the sums of their counts."""
        context = np.concatenate([sorted_from_bytes(r["keys"]) for r in rows])
        successor = np.concatenate([from_bytes(r["ends"]) for r in rows])
        n = np.concatenate([from_bytes(r["more"]) for r in rows]) + np.uint64(1)
        order = np.lexsort((successor, context))
        context, successor, n = context[order], successor[order], n[order]
        first = np.flatnonzero(np.append(True, (context[1:] != context[:-1]) | (successor[1:] != successor[:-1])))
        return context[first], successor[first], np.add.reduceat(n, first)

    def pairs_again(batches):
        for _, rows in gathered_rows(batches):
            yield parts_batch(pair_rows(*summed_pairs(rows), 1))

    def count_pairs(batches):
        for held, words in token_batches(batches):
            codes, n = unique_counts(np.concatenate([h[:-1] << 32 | h[1:] for h in held]))
            yield parts_batch(pair_rows(words.table[codes >> 32], words.table[codes & 0xFFFFFFFF], n, width))

    def merge_pairs(table: pa.Table) -> pa.Table:
        context, successor, n = summed_pairs(table.to_pylist())
        contexts, once, twice, every = sum_by_key(
            context, (n == 1).astype(np.uint32), (n == 2).astype(np.uint32), np.ones(len(n), np.uint32)
        )
        keys = chain(context, successor)
        order = np.argsort(keys)
        large = np.flatnonzero(n[order] >= 255)
        name = save(
            folder,
            keys=keys[order],
            n=np.minimum(n[order], 255).astype(np.uint8),
            big_at=large.astype(np.uint64),
            big_n=n[order][large],
            contexts=contexts,
            once=once.astype(np.uint32),
            twice=twice.astype(np.uint32),
            all=every.astype(np.uint32),
        )
        spread = find_any(hot, contexts)
        numbers = np.array([*(int((n == k).sum()) for k in (1, 2, 3, 4)), len(n)], "<u8")
        shard = table["shard"][0].as_py()
        rows = [
            ("file", shard, name.encode(), numbers.tobytes(), None),
            (
                "hot",
                shard,
                contexts[spread].astype("<u8").tobytes(),
                np.stack([once[spread], twice[spread], every[spread]], 1).astype("<u8").tobytes(),
                None,
            ),
        ]
        return pa.Table.from_batches([parts_batch([*rows, *counts("ends", *unique_counts(successor), coarse)])])

    counted = dealt(texts.mapInArrow(count_pairs, PARTS_DDL), shards, pairs_again)
    counted = counted.groupBy("shard").applyInArrow(merge_pairs, PARTS_DDL)
    counted = written(counted, "lm-pairs")
    about = counted.where(F.col("kind").isin("file", "hot")).select("kind", "shard", "keys", "more").collect()
    pairs, numbers, spread = {}, np.zeros(5, np.int64), {}
    for r in about:  # two rows per shard; the spread contexts are at most 8 times the shards
        if r.kind == "file":
            pairs[r.shard] = bytes(r["keys"]).decode()
            numbers += np.frombuffer(r.more, "<u8").astype(np.int64)
        else:
            for key, values in zip(
                np.frombuffer(r["keys"], "<u8").tolist(), np.frombuffer(r.more, "<u8").reshape(-1, 3).tolist(), strict=True
            ):
                spread[key] = tuple(a + b for a, b in zip(spread.get(key, (0, 0, 0)), values, strict=True))

    def merge_ends(table: pa.Table) -> pa.Table:
        keys, n = summed(table["keys"].to_pylist(), table["more"].to_pylist())
        numbers = np.array([*(int((n == k).sum()) for k in (1, 2, 3, 4)), len(n)], "<u8")
        row = ("ends", table["shard"][0].as_py(), save(folder, keys=keys, n=n).encode(), numbers.tobytes(), None)
        return pa.Table.from_batches([parts_batch([row])])

    ends = dealt(counted.where(F.col("kind") == "ends"), shards, counts_again)
    ends = ends.groupBy("shard").applyInArrow(merge_ends, PARTS_DDL)
    by_end, end_numbers = {}, np.zeros(5, np.int64)
    for r in written(ends, "lm-ends").select("shard", "keys", "more").collect():
        by_end[r.shard] = bytes(r["keys"]).decode()
        end_numbers += np.frombuffer(r.more, "<u8").astype(np.int64)
    ones, twos = int(end_numbers[0]), int(end_numbers[1])
    return Model(
        folder,
        shards,
        [by_word[k].name if k in by_word else None for k in range(shards)],
        [pairs.get(k) for k in range(shards)],
        [by_end.get(k) for k in range(shards)],
        spread,
        tokens,
        sum(r.types for r in by_word.values()),
        int(numbers[4]),
        discounts(*numbers[:4].tolist()),
        discounts(*end_numbers[:4].tolist()),
        (ones, twos, int(end_numbers[4]) - ones - twos),
        sum(r.rows for r in by_word.values()),
    )


def token_scores(model: Model, held: list[np.ndarray], words: WordHashes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each row: its known tokens, the score of smoothed single words, and the model's log10 probability."""
    table = words.table[: len(words)]
    order = np.argsort(table)
    count = np.empty(len(table), np.int64)
    count[order] = model.by_range(model.words, table[order])
    contexts = np.empty(len(table), np.int64)
    contexts[order] = model.by_range(model.ends, table[order])
    d = model.end_discounts
    left = sum(x * n for x, n in zip(d, model.end_ones, strict=True)) / max(1, model.pair_types)
    single = np.maximum(_cut_by(contexts, d), 0) / max(1, model.pair_types)
    single = single + (left if model.pair_types else 1.0) / (model.types + 1)

    codes = np.concatenate([h[:-1] << 32 | h[1:] for h in held])
    pairs, inverse = np.unique(codes, return_inverse=True)
    before, after = pairs >> 32, pairs & 0xFFFFFFFF
    seen = np.where(table == START_HASH, model.rows, count)
    seen = np.where(table == END_HASH, 0, seen)  # nothing follows an end
    numbers = np.zeros((len(table), 3), np.int64)
    used = np.unique(before)
    numbers[used] = model.successors(table[used])
    d = model.pair_discounts
    weight = numbers @ np.array([d[0] - d[2], d[1] - d[2], d[2]])  # once, twice, and in all
    n = model.pair_counts(table[before], table[after])
    known = seen[before]
    mixed = (np.maximum(_cut_by(n, d), 0) + weight[before] * single[after]) / np.maximum(known, 1)
    p = np.log10(np.where(known > 0, mixed, single[after]))[inverse]

    sizes = np.array([len(h) - 1 for h in held])
    starts = np.cumsum(sizes) - sizes
    tokens = np.concatenate([h[1:] for h in held])
    base = np.log10((count + 0.1) / (model.tokens + 0.1 * (model.types + 1)))
    return (
        np.add.reduceat((count > 0)[tokens].astype(np.int64), starts),
        np.add.reduceat(base[tokens], starts),
        np.add.reduceat(p, starts),
    )


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, n_tokens, n_known, train_tokens, base_score, score`` of every row; perplexity is
    ``10 ** (-score / n_tokens)``.

    Null and empty texts have one token, the end.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        own = shared.value
        for batch in batches:
            ids, at = batch.column(0), 0
            for held, words in token_batches([batch], 1_000_000):
                known, base, found = token_scores(own, held, words)
                n = len(held)
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(at, n),
                        pa.array([len(h) - 1 for h in held], pa.int64()),
                        pa.array(known, pa.int64()),
                        pa.array(np.full(n, own.tokens), pa.int64()),
                        pa.array(base, pa.float64()),
                        pa.array(found, pa.float64()),
                    ],
                    names=["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )
                at += n

    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return ids.mapInArrow(run, "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def score_documents(docs: DataFrame, modulus: int = 10) -> DataFrame:
    """Learn from the rows whose crc32 of the id is not 0 modulo ``modulus``, and score all rows.

    A null id is not held out. Without training rows, every token has the same probability, 1. Null and empty texts are one
    token, texts of any length are scored whole, rows that repeat an id are trained on and scored each for itself, an empty
    table gives no rows, and columns other than ``doc_id`` and ``text`` are not read.
    """
    held_out = F.coalesce(fold(F.col("doc_id"), modulus) == 0, F.lit(False))
    model = train(docs.where(~held_out).select("text"))
    out = score(docs, model)
    return out.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
