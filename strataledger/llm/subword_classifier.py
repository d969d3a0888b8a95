"""Supervised subword embeddings: hashed vectors of words, their character n-grams and pairs of words, averaged, into a
softmax.

The vectors and the softmax are learned together on the driver, in numpy, from a bounded sample of labelled rows, half of
it of each class where there are enough; the share of the classes among all labels is put back into the bias. Averaging
and the softmax are linear, so a trained model is one number per hash bucket: a word's weight is the mean over its
buckets, a pair's that of its own, a document's score the logistic of the mean over both. Workers get those numbers alone.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strataledger.llm.storage import written

BASE, SECOND, LAST = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


@dataclass(frozen=True)
class Options:
    """``sample_rows`` bounds what the driver gathers: the words and counts of that many labelled rows, of any length."""

    bits: int = 18
    dim: int = 4
    min_docs: int = 10
    shortest: int = 3
    longest: int = 5
    lower: bool = True
    pairs: bool = False
    epochs: int = 8
    rate: float = 30.0
    softmax_rate: float = 0.1
    doubt: float = 5.0
    batch: int = 32
    seed: int = 7
    sample_rows: int = 4000
    cache_words: int = 150_000


def word_hash(word: str) -> int:
    return xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))


def pair_buckets(hashes: np.ndarray, bits: int) -> np.ndarray:
    """The buckets of neighbours, from the hashes of words in order."""
    key = hashes[:-1] * BASE + hashes[1:]
    key = (key ^ (key >> np.uint64(31))) * SECOND
    return (key >> np.uint64(64 - bits)).astype(np.int32)


def words_of(text: str | None, options: Options) -> list[str]:
    return (text.lower() if options.lower else text).split() if text else []


def tokens(text: str | None, options: Options) -> tuple[Counter, np.ndarray]:
    """Words of a whole text with their counts; and, if they are wanted, the buckets of pairs of neighbours, in order."""
    words = words_of(text, options)
    counts = Counter(words)
    if not options.pairs or len(words) < 2:
        return counts, np.zeros(0, np.int32)
    own = {w: word_hash(w) for w in counts}
    return counts, pair_buckets(np.fromiter(map(own.__getitem__, words), np.uint64, len(words)), options.bits)


def features(words: Sequence[str], options: Options) -> tuple[np.ndarray, np.ndarray]:
    """Hash buckets of each word: itself and the n-grams of ``<word>``; and where each word's buckets start."""
    marked = [f"<{w}>" for w in words]
    flat = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
    lengths = np.fromiter(map(len, marked), dtype=np.int64, count=len(marked))
    ends = np.cumsum(lengths)
    owner = np.repeat(np.arange(len(words)), lengths)
    left = np.repeat(ends, lengths) - np.arange(len(flat))  # symbols from here to the word's end
    grams, owners = [], []
    rolling = flat * BASE
    for n in range(2, options.longest + 1):
        shifted = np.zeros_like(flat)
        shifted[: max(0, len(flat) - n + 1)] = flat[n - 1 :]
        rolling = (rolling ^ (rolling >> np.uint64(29))) * BASE + shifted
        if n >= options.shortest:
            whole = left >= n
            grams.append(rolling[whole])
            owners.append(owner[whole])
    # the word itself: its first n-grams chained over the whole length, by a sum of position-dependent products
    place = np.arange(len(flat), dtype=np.uint64) - np.repeat(ends - lengths, lengths).astype(np.uint64)
    mixed = (flat + np.uint64(1)) * (place * np.uint64(2) + np.uint64(1)) * BASE
    mixed = (mixed ^ (mixed >> np.uint64(31))) * SECOND
    grams.append(np.add.reduceat(mixed, ends - lengths) ^ np.uint64(0x5555555555555555))
    owners.append(np.arange(len(words)))
    key, own = np.concatenate(grams), np.concatenate(owners)
    order = np.argsort(own, kind="stable")
    key = key[order]
    key = (key ^ (key >> np.uint64(32))) * LAST
    starts = np.searchsorted(own[order], np.arange(len(words)))
    return (key >> np.uint64(64 - options.bits)).astype(np.int64), starts


def word_means(values: np.ndarray, words: Sequence[str], options: Options) -> np.ndarray:
    """Mean of bucket values over each word's buckets."""
    if not words:
        return np.zeros(0)
    buckets, starts = features(words, options)
    sums = np.add.reduceat(values[buckets], starts)
    return sums / np.diff(np.append(starts, len(buckets)))


@dataclass(frozen=True)
class Model:
    """Bucket weights (difference of the two classes' logits) and the bias."""

    weights: np.ndarray
    bias: float
    options: Options


class Scorer:
    """Scores texts by a model; remembers the numbers of up to ``cache_words`` words, which changes no result."""

    def __init__(self, model: Model) -> None:
        self.model, self.places = model, {}
        self.means, self.hashes = np.zeros(0), np.zeros(0, np.uint64)

    def _place(self, words: list[str]) -> np.ndarray:
        """Where the numbers of words stand."""
        options, places = self.model.options, self.places
        new = [w for w in dict.fromkeys(words) if w not in places]
        if new and len(places) + len(new) > options.cache_words:
            places.clear()
            self.means, self.hashes = self.means[:0], self.hashes[:0]
            new = list(dict.fromkeys(words))
        if new:
            at = len(places)
            if at + len(new) > len(self.means):  # room for twice as many
                more = at + 2 * len(new)
                self.means = np.concatenate([self.means[:at], np.zeros(more)])
                self.hashes = np.concatenate([self.hashes[:at], np.zeros(more if options.pairs else 0, np.uint64)])
            self.means[at : at + len(new)] = word_means(self.model.weights, new, options)
            if options.pairs:
                self.hashes[at : at + len(new)] = np.fromiter(map(word_hash, new), np.uint64, len(new))
            places.update(zip(new, range(at, at + len(new))))
        return np.fromiter(map(places.__getitem__, words), np.int64, len(words))

    def score(self, text: str | None) -> float:
        words, total, n = words_of(text, self.model.options), 0.0, 1
        if words:
            at = self._place(words)
            pairs = pair_buckets(self.hashes[at], self.model.options.bits) if self.model.options.pairs else np.zeros(0, np.int32)
            total = float(self.means[at].sum() + self.model.weights[pairs].sum(dtype=np.float64))
            n = len(words) + len(pairs)
        return float(1 / (1 + np.exp(-np.clip(self.model.bias + total / n, -60, 60))))


def _rows(texts: Iterable[tuple[Counter, np.ndarray]], options: Options):
    """Documents as sparse rows: row starts, columns, weights; and the bucket of each column.

    Columns are the buckets of at least ``options.min_docs`` documents: what fewer share can only be learned by heart.
    """
    ids: dict[str, int] = {}
    docs = []
    for counts, pairs in texts:
        index = np.fromiter((ids.setdefault(w, len(ids)) for w in counts), np.int32, len(counts))
        docs.append((index, np.fromiter(counts.values(), np.float32, len(counts)), pairs))
    parts, sizes, words = [], [], list(ids)
    for k in range(0, len(words), 20_000):
        buckets, starts = features(words[k : k + 20_000], options)
        parts.append(buckets.astype(np.int32))
        sizes.append(np.diff(np.append(starts, len(buckets))))
    none = np.zeros(0, np.int32)
    buckets, size = np.concatenate([none, *parts]), np.concatenate([none, *sizes]).astype(np.int64)
    first = np.cumsum(size) - size

    def places(index):
        n = size[index]
        return np.repeat(first[index] - (np.cumsum(n) - n), n) + np.arange(n.sum()), n

    seen = np.zeros(1 << options.bits, np.int32)
    for index, _, pairs in docs:
        seen[np.unique(np.concatenate([buckets[places(index)[0]], pairs]))] += 1
    used = np.flatnonzero(seen >= min(options.min_docs, len(docs)))
    column = np.full(1 << options.bits, -1, np.int32)
    column[used] = np.arange(len(used))
    rows, cols, vals = [0], [none], [np.zeros(0, np.float32)]
    for index, tf, pairs in docs:
        at, n = places(index)
        own = column[np.concatenate([buckets[at], pairs])]
        share = np.concatenate([np.repeat(tf / np.maximum(n, 1), n), np.ones(len(pairs), np.float32)])
        share = (share / max(1, tf.sum() + len(pairs)))[own >= 0]
        unique, inverse = np.unique(own[own >= 0], return_inverse=True)
        cols.append(unique)
        vals.append(np.bincount(inverse, weights=share, minlength=len(unique)).astype(np.float32))
        rows.append(rows[-1] + len(unique))
    return np.array(rows), np.concatenate(cols), np.concatenate(vals), used


def train(texts: Iterable[tuple[Counter, np.ndarray]], labels: Sequence[int], options: Options, share: float | None = None) -> Model:
    """Learn from texts as ``tokens`` gives them: vectors and softmax by stochastic gradient descent with a rate per bucket.

    ``share`` is that of class 1 among all labels, where ``labels`` are a sample by class: the bias is moved by what the
    two differ.

    A bucket's vector leaves its random start only as far as the sum of its gradients exceeds ``doubt`` times the
    root of their squares, so what single mislabelled documents pull at stays where it was.

    Without rows, or with rows of one class only, the model scores the smoothed share of that class.
    """
    y = np.asarray(labels, dtype=np.float64)
    prior = (y.sum() + 0.5) / (len(y) + 1)
    rng = np.random.default_rng(options.seed)
    bias = float(np.log(prior / (1 - prior)))
    moved = 0.0 if share is None else float(np.log(share / (1 - share))) - bias
    n_buckets = 1 << options.bits
    if len(y) == 0 or y.min() == y.max():
        return Model(np.zeros(n_buckets, np.float32), bias + moved, options)
    rows, cols, vals, used = _rows(texts, options)
    vectors = rng.uniform(-0.5, 0.5, (len(used), options.dim)) / options.dim
    origin, pulled = vectors.copy(), np.zeros_like(vectors)
    softmax = rng.uniform(-0.5, 0.5, (options.dim, 2))
    bias2 = np.array([0.0, bias])
    seen, seen_softmax, seen_bias = np.full(len(used), 1e-12), np.full((options.dim, 2), 1e-8), np.full(2, 1e-8)
    for epoch in range(options.epochs):
        rate = options.softmax_rate * (1 - epoch / options.epochs)
        order = rng.permutation(len(y))
        for k in range(0, len(order), options.batch):
            docs = order[k : k + options.batch]
            n = rows[docs + 1] - rows[docs]
            docs, n = docs[n > 0], n[n > 0]
            if not len(docs):
                continue
            first = np.append(0, np.cumsum(n)[:-1])
            at = np.repeat(rows[docs] - first, n) + np.arange(n.sum())
            col, val = cols[at], vals[at]
            hidden = np.add.reduceat(vectors[col] * val[:, None], first)
            logits = hidden @ softmax + bias2
            p = np.exp(logits - logits.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(docs)), y[docs].astype(int)] -= 1
            error = p / len(docs)
            to_hidden = error @ softmax.T
            to_softmax = hidden.T @ error
            touched, slot = np.unique(col, return_inverse=True)
            each = np.repeat(to_hidden, n, axis=0) * val[:, None]
            step = np.stack([np.bincount(slot, each[:, j], len(touched)) for j in range(options.dim)], axis=1)
            seen[touched] += (step**2).mean(1)
            pulled[touched] += step
            pull, spread = pulled[touched], np.sqrt(seen[touched])
            sure = np.maximum(0, 1 - options.doubt * spread / np.sqrt((pull**2).mean(1) + 1e-30))
            vectors[touched] = origin[touched] - options.rate * (sure / spread)[:, None] * pull
            seen_softmax += to_softmax**2
            softmax -= rate * to_softmax / np.sqrt(seen_softmax)
            seen_bias += error.sum(0) ** 2
            bias2 -= rate * error.sum(0) / np.sqrt(seen_bias)
    weights = np.zeros(n_buckets, np.float32)
    weights[used] = vectors @ (softmax[:, 1] - softmax[:, 0])
    return Model(weights, float(bias2[1] - bias2[0]) + moved, options)


def by_class(known: DataFrame, rows: int) -> tuple[list, float | None]:
    """Up to ``rows`` of ``known`` (``doc_id, __label, __order``), half of each class where there are enough, those of least
    order; and the share of class 1 in all of it, None without rows."""
    n = dict.fromkeys((0, 1), 0) | {r["__label"]: r["count"] for r in known.groupBy("__label").count().collect()}
    ones = min(n[1], max(rows // 2, rows - n[0]))
    quota = {1: ones, 0: min(n[0], rows - ones)}
    picked = [r for c, k in quota.items() if k for r in known.where(F.col("__label") == c).orderBy("__order", "doc_id").limit(k).collect()]
    return picked, (n[1] + 0.5) / (n[0] + n[1] + 1) if picked else None


def learn(docs: DataFrame, labels: DataFrame, label: str, held_out, options: Options) -> Model:
    """Train on the labelled rows that are not held out.

    At most ``options.sample_rows`` rows go to the driver, half of each class where there are enough, those whose id hashes
    lowest. Labels other than 0 and 1, and rows without an id or a text, teach nothing.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("__label")).where(F.col("__label").isin(0, 1))
    known = known.where(~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull()).withColumn("__order", F.xxhash64("doc_id"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(F.col("text").isNotNull())
    # only labels that have a document count for the sample and for the shares
    known = written(known.join(texts.select("doc_id").distinct(), "doc_id", "left_semi"), "known-labels")
    picked, share = by_class(known, options.sample_rows)
    side = docs.sparkSession.createDataFrame(
        [(r.doc_id, r["__label"], r["__order"]) for r in picked], "doc_id long, __label int, __order long"
    )
    joined = texts.join(F.broadcast(side), "doc_id").select("text", "__order", "doc_id", "__label", F.xxhash64("text").alias("__text"))

    def count(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                counts, pairs = tokens(batch.column(0)[k].as_py(), options)
                packed = np.fromiter(counts.values(), "<u4", len(counts)).tobytes(), pairs.astype("<i4").tobytes()
                columns = [pa.array(["\n".join(counts)], pa.string()), *(pa.array([x], pa.binary()) for x in packed)]
                kept = [batch.column(j).slice(k, 1) for j in range(1, 5)]
                yield pa.RecordBatch.from_arrays([*columns, *kept], names=["words", "counts", "pairs", "order", "doc_id", "label", "text"])

    # words hold no line ends, and stand in one string so that a row is small
    schema = "words string, counts binary, pairs binary, order long, doc_id long, label int, text long"
    sample = joined.mapInArrow(count, schema).orderBy("order", "doc_id", "label", "text").limit(options.sample_rows)
    rows = sample.select("words", "counts", "pairs", "label").collect()
    found = (
        (Counter(dict(zip(r.words.split("\n"), np.frombuffer(r.counts, "<u4").tolist(), strict=True))) if r.counts else Counter(), np.frombuffer(r.pairs, "<i4"))
        for r in rows
    )
    return train(found, [r.label for r in rows], options, share)


def classify(docs: DataFrame, model: Model, score: str = "score", predicted: str = "predicted") -> DataFrame:
    """``docs`` with a score between 0 and 1 and a class for every row.

    The whole text counts. Null and empty texts score the bias alone. Columns of those names are replaced.
    """
    kept = [c for c in docs.columns if c not in (score, predicted)]
    schema = T.StructType(
        [*(f for f in docs.schema if f.name in kept), T.StructField(score, T.DoubleType()), T.StructField(predicted, T.IntegerType())]
    )
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = [*kept, score, predicted]

    def run(batches):
        scorer = Scorer(shared.value)
        for batch in batches:
            texts = batch.column(batch.schema.names.index("text"))
            found = [scorer.score(t.as_py()) for t in texts]
            columns = [batch.column(batch.schema.names.index(c)) for c in kept]
            hard = pa.array([int(x >= 0.5) for x in found], pa.int32())
            yield pa.RecordBatch.from_arrays([*columns, pa.array(found, pa.float64()), hard], names=names)

    return docs.mapInArrow(run, schema)


def fold(doc_id, modulus: int):
    """crc32 of the id as text, modulo ``modulus``."""
    return F.pmod(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")), F.lit(modulus))


#: The settings in use: words in lower case for toxicity; case and what stands beside a word tell quality.
TOXICITY = Options(lower=True)
QUALITY = Options(lower=False, pairs=True, min_docs=5, doubt=3.0)


def score_documents(docs: DataFrame, labels: DataFrame, label: str, modulus: int, held: int, options: Options):
    """``doc_id, held_out, score, predicted`` of every document; a null id is not held out and teaches nothing."""

    def held_out(c):
        return F.coalesce(fold(c, modulus) == held, F.lit(False))

    narrow = docs.select("doc_id", "text")
    model = learn(narrow, labels, label, held_out, options)
    out = classify(narrow, model)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def toxicity(docs: DataFrame, labels: DataFrame, options: Options = TOXICITY) -> DataFrame:
    """Every document with its chance of being toxic; learned from rows whose crc32 of the id modulo 5 is not 0.

    Null and empty texts have the score of a text without words. Rows that repeat an id are scored each for itself,
    and teach each if the id is labelled. Without labels of both classes, every row scores the smoothed share of one.
    An empty table gives no rows; other columns are not read.
    """
    return score_documents(docs, labels, "toxic", 5, 0, options)


def quality(docs: DataFrame, labels: DataFrame, options: Options = QUALITY) -> DataFrame:
    """Every document with its chance of being good; learned from rows whose crc32 of the id modulo 3 is not 1.

    Odd rows and tables have the results that ``toxicity`` states.
    """
    return score_documents(docs, labels, "quality", 3, 1, options)


def of_quality(docs: DataFrame, labels: DataFrame, options: Options = QUALITY) -> DataFrame:
    """Rows of ``docs`` that the quality model does not reject, with their own columns.

    Null and empty texts have the score of a text without words; rows that repeat an id are judged each for itself; an
    empty table gives no rows, and without labels of both classes all rows have one score.
    """

    def held_out(c):
        return F.coalesce(fold(c, 3) == 1, F.lit(False))

    model = learn(docs.select("doc_id", "text"), labels, "quality", held_out, options)
    return classify(docs, model, "__score", "__predicted").where(F.col("__predicted") == 1).select(*docs.columns)
