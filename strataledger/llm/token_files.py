"""Token ids as segments of patched frame-of-reference blocks.

A segment is one self-contained byte string: a header, the documents it holds, the start of every block, and the
blocks. A block holds up to 1024 ids: its minimum, a bit width that fits all but a few of the differences to it, the
low bits of every difference in that width, and the places and high bits of the few. Segments stand in ascending
order of document ids; a partition's segments are rows of one written table, which any file system of Spark holds.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from functools import cache
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataledger.llm.storage import new_path, partitions_for
from strataledger.llm.token_counts import byte_symbols

MAGIC = b"PFOR0001"
BLOCK = 1024
LANES = 64
#: Share of a block's differences that its width must hold.
FITTING = 0.95
HEADER = struct.Struct("<8sIQI")
BLOCK_HEADER = struct.Struct("<IBHH")


def pack(low: np.ndarray, width: int) -> np.ndarray:
    """Rows of 1024 numbers below ``2**width`` as rows of ``16 * width`` words of 64 bits."""
    out = np.zeros((len(low) * BLOCK // LANES, width), np.uint64)
    lanes = low.reshape(-1, LANES).astype(np.uint64)
    for j in range(LANES if width else 0):
        word, shift = divmod(j * width, 64)
        out[:, word] |= lanes[:, j] << np.uint64(shift)
        if shift + width > 64:
            out[:, word + 1] |= lanes[:, j] >> np.uint64(64 - shift)
    return out.reshape(len(low), -1)


def unpack(words: np.ndarray, width: int) -> np.ndarray:
    rows = words.reshape(-1, width) if width else words
    out = np.zeros((len(words) * BLOCK // LANES, LANES), np.uint64)
    mask = np.uint64((1 << width) - 1)
    for j in range(LANES if width else 0):
        word, shift = divmod(j * width, 64)
        value = rows[:, word] >> np.uint64(shift)
        if shift + width > 64:
            value = value | rows[:, word + 1] << np.uint64(64 - shift)
        out[:, j] = value & mask
    return out.reshape(-1, BLOCK)


def encode_blocks(ids: np.ndarray) -> list[bytes]:
    n_blocks = -(-len(ids) // BLOCK)
    table = np.zeros((n_blocks, BLOCK), np.uint32)
    table.ravel()[: len(ids)] = ids
    sizes = np.full(n_blocks, BLOCK)
    if len(ids) % BLOCK:
        sizes[-1] = len(ids) % BLOCK
        table[-1, sizes[-1] :] = table[-1, : sizes[-1]].min()
    base = table.min(1)
    delta = table - base[:, None]
    at = np.maximum(np.ceil(FITTING * sizes).astype(int) - 1, 0)
    # the last block is padded with zeros, which stand first in order
    fitting = np.sort(delta, 1)[np.arange(n_blocks), at + (BLOCK - sizes)]
    widths = np.ceil(np.log2(fitting.astype(np.float64) + 1)).astype(int)
    out: list[bytes] = [b""] * n_blocks
    for width in np.unique(widths).tolist():
        rows = np.flatnonzero(widths == width)
        low = delta[rows] & np.uint32((1 << width) - 1)
        high = (delta[rows].astype(np.uint64) >> np.uint64(width)).astype(np.uint32)
        packed = pack(low, width)
        for k, row in enumerate(rows.tolist()):
            places = np.flatnonzero(high[k])
            out[row] = b"".join(
                (
                    BLOCK_HEADER.pack(int(base[row]), width, int(sizes[row]), len(places)),
                    packed[k].astype("<u8").tobytes(),
                    places.astype("<u2").tobytes(),
                    high[k][places].astype("<u4").tobytes(),
                )
            )
    return out


def decode_blocks(blocks: list[bytes]) -> np.ndarray:
    heads = [BLOCK_HEADER.unpack_from(b) for b in blocks]
    table = np.zeros((len(blocks), BLOCK), np.uint64)
    widths = np.array([h[1] for h in heads], int)
    for width in np.unique(widths).tolist():
        rows = np.flatnonzero(widths == width)
        size = BLOCK // 8 * width
        words = np.frombuffer(
            b"".join(blocks[r][BLOCK_HEADER.size : BLOCK_HEADER.size + size] for r in rows.tolist()), "<u8"
        ).reshape(len(rows), -1)
        table[rows] = unpack(words, width)
    for row, (base, width, _, n) in enumerate(heads):
        if n:
            at = BLOCK_HEADER.size + BLOCK // 8 * width
            places = np.frombuffer(blocks[row], "<u2", n, at)
            high = np.frombuffer(blocks[row], "<u4", n, at + 2 * n).astype(np.uint64)
            table[row, places] |= high << np.uint64(width)
        table[row] += np.uint64(base)
    kept = np.concatenate([table[r, : h[2]] for r, h in enumerate(heads)]) if heads else np.zeros(0)
    return kept.astype(np.uint32)


def write_segment(doc_ids: list[int | None], lengths: list[int], ids: np.ndarray) -> bytes:
    blocks = encode_blocks(ids)
    starts = np.cumsum([0, *map(len, blocks)]).astype("<u8")
    known = np.array([d is not None for d in doc_ids], np.uint8)
    return b"".join(
        (
            HEADER.pack(MAGIC, len(doc_ids), len(ids), len(blocks)),
            np.array([d or 0 for d in doc_ids], "<i8").tobytes(),
            known.tobytes(),
            np.array(lengths, "<u8").tobytes(),
            starts.tobytes(),
            *blocks,
        )
    )


def read_segment(data: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """Document ids, their numbers of ids, and all ids."""
    magic, n_docs, n_ids, n_blocks = HEADER.unpack_from(data)
    if magic != MAGIC:
        raise ValueError("not a segment of token ids")
    at = HEADER.size
    doc_ids = np.frombuffer(data, "<i8", n_docs, at)
    known = np.frombuffer(data, np.uint8, n_docs, at + 8 * n_docs)
    lengths = np.frombuffer(data, "<u8", n_docs, at + 9 * n_docs)
    at += 17 * n_docs
    starts = np.frombuffer(data, "<u8", n_blocks + 1, at)
    at += 8 * (n_blocks + 1)
    ids = decode_blocks([data[at + a : at + b] for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)])
    if len(ids) != n_ids:
        raise ValueError("a segment of token ids is damaged")
    return [d if k else None for d, k in zip(doc_ids.tolist(), known.tolist(), strict=True)], lengths, ids


#: White space in the widest sense that any of the libraries in use has of it.
BLANK = "".join(c for c in map(chr, range(0x3001)) if c.isspace())


def byte_slices(texts: pa.Array, most_bytes: int):
    """Parts of a column of about ``most_bytes``; a longer text is a part of its own."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(texts):
        limit = (ends[at - 1] if at else 0) + most_bytes
        stop = max(at + 1, int(np.searchsorted(ends, limit, side="right")))
        yield texts.slice(at, stop - at)
        at = stop


class Encoder:
    """Ids of whole texts by the tokenizers library, which sees each piece of text once.

    A text is cut into chunks before single spaces between other characters. A byte-level vocabulary whose pre-tokens
    are words with the space before them always has a boundary there. Where a space stands beside other white space,
    or a special string occurs, the library gets the whole text.

    A new chunk of plain letters, digits and ASCII marks is cut into its pre-tokens, and the library's model merges
    each of them. Every other new chunk goes to the library by itself: many of them make up one text, parted by the
    special string, across which the library never merges or looks ahead.
    """

    #: Where a text must be encoded whole; $ is its end.
    WHOLE = f"[{BLANK}] ([{BLANK}]|$)"
    #: Characters whose class no version of Unicode has changed, and the vocabulary's pre-tokens of such text.
    LETTERS, MARKS, BLANKS = "A-Za-zÀ-ÖØ-öø-ſ", r"!-/:-@\[-`{-~", r" \t\n\r"
    PIECES = re.compile(
        f"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTERS}]+| ?[0-9]+| ?[{MARKS}]+|[{BLANKS}]+(?![^{BLANKS}])|[{BLANKS}]+"
    )
    TOGETHER = 256

    def __init__(self, vocab_path: str, cache_size: int = 1_000_000) -> None:
        from tokenizers import Tokenizer, pre_tokenizers

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.library = Tokenizer.from_file(vocab_path)
        cut, special = self.library.pre_tokenizer, list(self.library.get_added_tokens_decoder().items())
        level = isinstance(cut, pre_tokenizers.ByteLevel) and cut.use_regex and not cut.add_prefix_space
        if not level or self.library.normalizer is not None or len(special) != 1:
            raise ValueError(f"not a byte-level vocabulary with one special string and no normaliser: {vocab_path}")
        self.special_id, self.special = special[0][0], special[0][1].content
        self.tokenize = self.library.model.tokenize
        self.to_symbols = str.maketrans({chr(b): c for b, c in enumerate(byte_symbols())})
        self.space = byte_symbols()[ord(" ")]
        self.cache_size = cache_size
        self.reset()

    def reset(self) -> None:
        #: Numbers of what follows a space (chunks and pieces), of other pieces, and of chunks that begin a text.
        self.number: dict[str, int] = {}
        self.inner: dict[str, int] = {}
        self.lead: dict[str, int] = {}
        self.flat, self.used = np.zeros(1 << 16, np.uint32), 0
        self.first, self.size, self.count = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int32), 0

    def _store(self, ids, sizes) -> None:
        """Ids of the next numbers, in a row, and how many each has."""
        ids, sizes = np.asarray(ids, np.uint32), np.asarray(sizes, np.int32)
        while self.used + len(ids) > len(self.flat):
            self.flat = np.append(self.flat, np.zeros_like(self.flat))
        while self.count + len(sizes) > len(self.first):
            self.first, self.size = (np.append(x, np.zeros_like(x)) for x in (self.first, self.size))
        own = slice(self.count, self.count + len(sizes))
        self.first[own] = self.used + np.cumsum(sizes) - sizes
        self.size[own] = sizes
        self.flat[self.used : self.used + len(ids)] = ids
        self.used, self.count = self.used + len(ids), self.count + len(sizes)

    def _gathered(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all numbers in a row, and how many each has."""
        sizes = self.size[numbers].astype(np.int64)
        begin = np.repeat(self.first[numbers] - (np.cumsum(sizes) - sizes), sizes)
        begin += np.arange(len(begin))
        return self.flat[begin], sizes

    def _merged(self, piece: str) -> list[int]:
        if piece.isascii() and piece.isprintable():  # these characters stand for themselves, but for the space
            symbols = piece.replace(" ", self.space)
        else:
            symbols = piece.encode().decode("latin-1").translate(self.to_symbols)
        return [t.id for t in self.tokenize(symbols)]

    def _alone(self, texts: list[str]) -> list[np.ndarray]:
        """The library's ids of each text, none of which holds the special string."""
        groups = [texts[k : k + self.TOGETHER] for k in range(0, len(texts), self.TOGETHER)]
        out = []
        joined = [self.special.join([*g, ""]) for g in groups]
        for found in self.library.encode_batch_fast(joined, add_special_tokens=False):
            ids = np.array(found.ids, np.uint32)
            ends = np.flatnonzero(ids == self.special_id).tolist()
            out += [ids[a:b] for a, b in zip([0, *(e + 1 for e in ends)], ends, strict=False)]
        return out

    def _learn(self, chunks: list[str], space: str, names: dict[str, int]) -> None:
        """Number chunks; ``space`` is what stands before them in their texts."""
        find, merged, number, inner = self.PIECES.findall, self._merged, self.number, self.inner
        ids, sizes, n = [], [], self.count
        several, places, counts, odd = [], [], [], []
        for chunk in chunks:
            if space and chunk.isascii() and chunk.isalpha():
                pieces = (space + chunk,)
            else:
                pieces = find(space + chunk)
                if len("".join(pieces)) != len(space) + len(chunk):  # some characters are in no piece
                    odd.append(chunk)
                    continue
            for piece in pieces:
                store, key = (number, piece[1:]) if piece[0] == " " else (inner, piece)
                own = store.get(key)
                if own is None:
                    own = store[key] = n + len(sizes)
                    found = merged(piece)
                    ids += found
                    sizes.append(len(found))
                places.append(own)
            if names is not number or len(pieces) > 1:
                several.append(chunk)
                counts.append(len(pieces))
            else:
                places.pop()
        self._store(ids, sizes)
        ids, piece_sizes = self._gathered(np.array(places, np.int64))
        ends = np.append(0, np.cumsum(piece_sizes))[np.cumsum([0, *counts])]
        names.update(zip(several, range(self.count, self.count + len(several)), strict=True))
        self._store(ids, np.diff(ends))
        if odd:
            found = self._alone([space + c for c in odd])
            names.update(zip(odd, range(self.count, self.count + len(odd)), strict=True))
            self._store(np.concatenate(found), list(map(len, found)))

    def _numbers(self, chunks: pa.Array, space: str, names: dict[str, int]) -> np.ndarray:
        """The number of each chunk, after learning those that are new."""
        encoded = chunks.dictionary_encode()
        words = encoded.dictionary.to_numpy(zero_copy_only=False).tolist()
        own = np.fromiter(map(names.get, words, repeat(-1)), np.int64, len(words))
        missing = np.flatnonzero(own < 0).tolist()
        if missing:
            unknown = [words[k] for k in missing]
            self._learn(unknown, space, names)
            own[missing] = np.fromiter(map(names.__getitem__, unknown), np.int64, len(unknown))
        return own[encoded.indices.to_numpy()]

    def batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and how many each has; a null is an empty text."""
        if not len(texts):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        if self.count > self.cache_size:
            self.reset()
        texts = pc.fill_null(texts, "")
        odd = pc.or_(pc.match_substring(texts, self.special), pc.match_substring_regex(texts, self.WHOLE))
        at = np.flatnonzero(odd)
        whole = self.library.encode_batch_fast(texts.take(pa.array(at)).to_pylist(), add_special_tokens=False)
        wholes = {k: np.array(found.ids, np.uint32) for k, found in zip(at.tolist(), whole, strict=True)}
        parts = pc.split_pattern(pc.if_else(odd, "", texts) if wholes else texts, " ")
        lengths = parts.value_lengths().to_numpy()
        starts, chunks = np.append(0, np.cumsum(lengths, dtype=np.int64)), parts.flatten()
        numbers = self._numbers(chunks, " ", self.number)
        numbers[starts[:-1]] = self._numbers(chunks.take(pa.array(starts[:-1])), "", self.lead)
        ids, sizes = self._gathered(numbers)
        bounds = np.append(0, np.cumsum(sizes))[starts]
        if not wholes:
            return ids, np.diff(bounds)
        out = [wholes[k] if k in wholes else ids[bounds[k] : bounds[k + 1]] for k in range(len(texts))]
        return np.concatenate(out), np.array(list(map(len, out)), np.int64)


@cache
def encoder(vocab_path: str, cache_size: int) -> Encoder:
    return Encoder(vocab_path, cache_size)


def write_token_files(
    docs: DataFrame, vocab_path: str, end_id: int = 0, segment_ids: int = 1 << 20, cache_size: int = 1_000_000
) -> str:
    """Write the ids of all documents, each followed by ``end_id``, in ascending doc_id order; return the path.

    Null ids stand first; rows of equal id stand in order of a hash of their text. A segment takes whole documents
    until it has ``segment_ids`` ids. ``cache_size``: chunks of text that a worker remembers; it changes no result.
    """
    spark = docs.sparkSession
    path = new_path(spark, "token-files")
    order = [F.col("doc_id").asc_nulls_first(), F.col("__tie")]
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("__tie", F.xxhash64("text"))
    ranged = narrow.repartitionByRange(partitions_for(narrow, 32 << 20), *order).sortWithinPartitions(*order)
    schema = "part int, place int, ids_before long, n_docs long, n_ids long, data binary"

    def run(batches):
        own, part, place, before = encoder(vocab_path, cache_size), TaskContext.get().partitionId(), 0, 0
        doc_ids, lengths, held, size = [], [], [], 0

        def segment():
            data = write_segment(doc_ids, lengths, np.concatenate(held))
            columns = [[part], [place], [before], [len(doc_ids)], [size], [data]]
            kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            return pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                names=["part", "place", "ids_before", "n_docs", "n_ids", "data"],
            )

        for batch in batches:
            keys, at = batch.column(0).to_pylist(), 0
            for texts in byte_slices(batch.column(1), 4 << 20):
                ids, counts = own.batch(texts)
                bounds = np.cumsum(counts)
                with_ends = np.insert(ids, bounds, end_id).astype(np.uint32)
                bounds = bounds + np.arange(1, len(counts) + 1)
                start = 0
                for key, stop in zip(keys[at : at + len(texts)], bounds.tolist(), strict=True):
                    doc_ids.append(key)
                    lengths.append(stop - start)
                    held.append(with_ends[start:stop])
                    size += stop - start
                    start = stop
                    if size >= segment_ids:
                        yield segment()
                        place, before = place + 1, before + size
                        doc_ids, lengths, held, size = [], [], [], 0
                at += len(texts)
        if doc_ids:
            yield segment()

    ranged.drop("__tie").mapInArrow(run, schema).write.parquet(path)
    return path


def read_token_files(spark, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, decoded from the files.

    ``start`` counts the ids of all documents before; the driver sums the ids of each partition for it, one number
    per partition of the writing job.
    """
    files = spark.read.schema("part int, place int, ids_before long, n_docs long, n_ids long, data binary").parquet(path)
    totals = {r.part: r.n for r in files.groupBy("part").agg(F.sum("n_ids").alias("n")).collect()}
    starts, ahead = {}, 0
    for part in sorted(totals):
        starts[part], ahead = ahead, ahead + totals[part]
    shared = spark.sparkContext.broadcast(starts)

    def run(batches):
        for batch in batches:
            for part, before, data in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                doc_ids, lengths, ids = read_segment(data)
                bounds = np.append(0, np.cumsum(lengths)).astype(np.int64)
                raw, view = ids.astype("<u4").tobytes(), bounds * 4
                crcs = [zlib.crc32(raw[a:b]) for a, b in zip(view[:-1].tolist(), view[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(doc_ids, pa.int64()),
                        pa.array(bounds[:-1] + shared.value[part] + before, pa.int64()),
                        pa.array(np.diff(bounds), pa.int64()),
                        pa.array(crcs, pa.int64()),
                    ],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    return files.select("part", "ids_before", "data").mapInArrow(
        run, "doc_id long, start long, n_tokens long, ids_crc32 long"
    )


def token_index(docs: DataFrame, vocab_path: str, **options) -> DataFrame:
    """Write the token files of ``docs`` and read them back; see the two functions above."""
    return read_token_files(docs.sparkSession, write_token_files(docs, vocab_path, **options))
