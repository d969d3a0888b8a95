"""Token counts of whole texts, by rank-synchronous merging of arrays.

The pre-tokens of a batch stand in one flat array of symbols. Every round, each pre-token merges its pair of lowest
rank, all at once; those without a pair to merge are done. What survives is counted. Counts of chunks between white
space are remembered, since white space always parts pre-tokens of this vocabulary.
"""

from __future__ import annotations

import json
import re
import unicodedata
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from strataledger.sources.storage import spread

#: What separates the tokens of this vocabulary, and its two special strings.
PRE_TOKEN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
SPECIAL = ("<|startoftext|>", "<|endoftext|>")
#: Characters that ``str.split`` takes for white space and the vocabulary's pattern does not.
SEPARATORS = re.compile("[\x1c-\x1f]")
NO_RANK = np.int64(1 << 40)


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class RankMerger:
    """Merge ranks of a byte-pair vocabulary with word ends, as sorted arrays."""

    def __init__(self, vocab_path: str) -> None:
        with open(vocab_path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        vocab, end = model["vocab"], model["end_of_word_suffix"] or ""
        symbols = byte_symbols()
        self.inner = np.array([vocab[c] for c in symbols], np.int64)
        self.final = np.array([vocab[c + end] for c in symbols], np.int64)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        left = np.array([vocab[a] for a, _ in pairs], np.int64)
        right = np.array([vocab[b] for _, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        keys = left << 32 | right
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.made = made
        # a rank is final if no pair with the symbol that it makes ranks lower: then all its places merge at once
        lowest = np.full(max(vocab.values()) + 1, NO_RANK)
        np.minimum.at(lowest, left, np.arange(len(pairs)))
        np.minimum.at(lowest, right, np.arange(len(pairs)))
        self.all_at_once = lowest[made] > np.arange(len(pairs))

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NO_RANK)

    def count(self, words: list[bytes]) -> np.ndarray:
        """Symbols that are left of each pre-token (none is empty)."""
        out = np.zeros(len(words), np.int64)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        raw = np.frombuffer(b"".join(words), np.uint8)
        symbol = self.inner[raw]
        ends = np.cumsum(lengths) - 1
        symbol[ends] = self.final[raw[ends]]
        word = np.repeat(np.arange(len(words)), lengths)
        pair = np.full(len(symbol), NO_RANK)
        inside = np.flatnonzero(word[:-1] == word[1:])
        pair[inside] = self.rank(symbol[inside], symbol[inside + 1])
        while len(symbol):
            first = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            size = np.diff(np.append(first, len(symbol)))
            best = np.minimum.reduceat(pair, first)
            done = best >= NO_RANK
            if done.any():
                out[word[first[done]]] = size[done]
                keep = np.repeat(~done, size)
                symbol, word, pair = symbol[keep], word[keep], pair[keep]
                best, size = best[~done], size[~done]
                if not len(symbol):
                    break
            place = np.flatnonzero(pair == np.repeat(best, size))
            place = place[self._merged_now(place, word[place], pair[place])]
            symbol[place] = self.made[pair[place]]
            keep = np.ones(len(symbol), bool)
            keep[place + 1] = False
            renumbered = np.cumsum(keep) - 1
            symbol, word, pair = symbol[keep], word[keep], pair[keep]
            place = renumbered[place]
            changed = np.unique(np.concatenate([place, place[place > 0] - 1]))
            following = np.minimum(changed + 1, len(symbol) - 1)
            inside = (following > changed) & (word[following] == word[changed])
            pair[changed] = np.where(inside, self.rank(symbol[changed], symbol[following]), NO_RANK)
        return out

    def _merged_now(self, place: np.ndarray, word: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """Which places of the lowest rank merge in this round: the first of a word, or all that don't overlap."""
        lead = np.append(True, word[1:] != word[:-1])
        run = np.append(True, (place[1:] != place[:-1] + 1) | lead[1:])
        starts = np.flatnonzero(run)
        offset = np.arange(len(place)) - np.repeat(starts, np.diff(np.append(starts, len(place))))
        return lead | (self.all_at_once[rank] & (offset % 2 == 0))


def fold(text: str) -> str:
    """Canonical composition and lower case by single characters, so a final sigma is like any other."""
    if not text.isascii():
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
    return text.lower()


class Counter:
    """Counts tokens of texts; remembers at most ``cache_size`` chunks."""

    def __init__(self, vocab_path: str, cache_size: int = 500_000) -> None:
        self.merger = RankMerger(vocab_path)
        self.cache_size = cache_size
        self.known: dict[str, int] = {}
        self.marks = re.compile("|".join(map(re.escape, SPECIAL)))

    def _learn(self, chunks: set[str]) -> None:
        order = list(chunks)
        found = [PRE_TOKEN.findall(fold(c)) for c in order]
        pieces = list({p for ps in found for p in ps})
        sizes = self.merger.count([p.encode("utf-8", "surrogatepass") for p in pieces]).tolist() if pieces else []
        size = dict(zip(pieces, sizes, strict=True))
        for chunk, ps in zip(order, found, strict=True):
            self.known[chunk] = sum(size[p] for p in ps)

    def _chunks(self, text: str | None) -> list[str]:
        text = text or ""
        if SEPARATORS.search(text):
            # the pattern keeps these inside pre-tokens, so white space is told as the pattern tells it
            return [c for c in regex.split(r"\s+", text) if c]
        return text.split()

    def counts(self, texts: list[str | None]) -> list[int]:
        extra, split = [], []
        for text in texts:
            marks = 0
            if text and "<|" in text:
                marks = len(self.marks.findall(text))
                text = self.marks.sub(" ", text)
            extra.append(marks)
            split.append(self._chunks(text))
        new = set().union(*split).difference(self.known)
        if new:
            if len(self.known) + len(new) > self.cache_size:
                self.known.clear()
                new = set().union(*split)
            self._learn(new)
        return [n + sum(map(self.known.__getitem__, chunks)) for n, chunks in zip(extra, split, strict=True)]


@cache
def counter(vocab_path: str) -> Counter:
    return Counter(vocab_path)


def slices(texts: pa.Array, most_bytes: int = 4 << 20):
    """Parts of a column of about ``most_bytes``; a longer text is a part of its own."""
    part, size = [], 0
    for value in texts:
        text = value.as_py()
        part.append(text)
        size += len(text or "")
        if size >= most_bytes:
            yield part
            part, size = [], 0
    if part:
        yield part


def count_tokens(docs: DataFrame, vocab_path: str, limit: int = 2048) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of every document; a null text counts as empty, so as 0.

    Texts of any length are counted whole. Rows that repeat an id or a text are counted each for itself, an empty table
    gives no rows, and columns other than ``doc_id`` and ``text`` are not read.
    """
    schema = T.StructType(
        [
            docs.schema["doc_id"],
            T.StructField("n_bytes", T.LongType()),
            T.StructField("n_tokens", T.LongType()),
            T.StructField("over_limit", T.BooleanType()),
        ]
    )

    def run(batches):
        own = counter(vocab_path)
        for batch in batches:
            names = batch.schema.names
            sizes, tokens = [], []
            for part in slices(batch.column(names.index("text"))):
                tokens += own.counts(part)
                sizes += [len((t or "").encode("utf-8", "surrogatepass")) for t in part]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(names.index("doc_id")),
                    pa.array(sizes, pa.int64()),
                    pa.array(tokens, pa.int64()),
                    pa.array([n > limit for n in tokens], pa.bool_()),
                ],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return spread(docs.select("doc_id", "text"), "doc_id").mapInArrow(run, schema)
