"""Plain versions of operators, for comparison."""

import hashlib
import math
from collections import Counter

import numpy as np
import xxhash

from strataledger.llm.words import alnum_words

ALL = (1 << 64) - 1


def _hash_of_symbols(word, options):
    """Buckets of ``<word>``: its n-grams, and itself."""
    base, second, last = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB
    points = [ord(c) for c in f"<{word}>"]

    def bucket(h):
        return (((h ^ (h >> 32)) * last) & ALL) >> (64 - options.bits)

    out = []
    for n in range(options.shortest, options.longest + 1):
        for a in range(len(points) - n + 1):
            h = points[a] * base & ALL
            for c in points[a + 1 : a + n]:
                h = ((h ^ (h >> 29)) * base + c) & ALL
            out.append(bucket(h))
    total = 0
    for place, c in enumerate(points):
        x = (c + 1) * (2 * place + 1) * base & ALL
        total += (x ^ (x >> 31)) * second & ALL
    return [*out, bucket((total & ALL) ^ 0x5555555555555555)]


def _pairs(words, options):
    """The bucket of each pair of neighbours."""
    out = []
    for pair in zip(words, words[1:]) if options.pairs else ():
        first, second = (xxhash.xxh64(w.encode("utf-8", "surrogatepass")).intdigest() for w in pair)
        key = (first * 0x9E3779B97F4A7C15 + second) & ALL
        out.append((((key ^ (key >> 31)) * 0xBF58476D1CE4E5B9) & ALL) >> (64 - options.bits))
    return out


def classifier(texts, labels, options):
    """Bucket weights and bias, learned row by row in plain Python: ``weights`` (a dict), ``bias``."""
    docs = []
    for text in texts:
        words = (text.lower() if options.lower else text).split()
        pairs = _pairs(words, options)
        row = Counter()
        for word in words:
            buckets = _hash_of_symbols(word, options)
            for b in buckets:
                row[b] += 1 / (len(words) + len(pairs)) / len(buckets)
        for b in pairs:
            row[b] += 1 / (len(words) + len(pairs))
        docs.append(row)
    seen = Counter(b for row in docs for b in row)
    used = sorted(b for b, n in seen.items() if n >= min(options.min_docs, len(docs)))
    rng = np.random.default_rng(options.seed)
    prior = (sum(labels) + 0.5) / (len(labels) + 1)
    bias = [0.0, math.log(prior / (1 - prior))]
    start = rng.uniform(-0.5, 0.5, (len(used), options.dim)) / options.dim
    origin = dict(zip(used, start.tolist()))
    vector = {b: list(v) for b, v in origin.items()}
    pulled = {b: [0.0] * options.dim for b in used}
    squares = {b: 1e-12 for b in used}
    softmax = rng.uniform(-0.5, 0.5, (options.dim, 2)).tolist()
    softmax_squares = [[1e-8, 1e-8] for _ in softmax]
    bias_squares = [1e-8, 1e-8]
    dims = range(options.dim)
    for epoch in range(options.epochs):
        rate = options.softmax_rate * (1 - epoch / options.epochs)
        order = rng.permutation(len(docs)).tolist()
        for k in range(0, len(order), options.batch):
            batch = [i for i in order[k : k + options.batch] if any(b in origin for b in docs[i])]
            if not batch:
                continue
            step = {}
            to_softmax = [[0.0, 0.0] for _ in dims]
            to_bias = [0.0, 0.0]
            for i in batch:
                row = {b: w for b, w in docs[i].items() if b in origin}
                hidden = [sum(w * vector[b][j] for b, w in row.items()) for j in dims]
                logits = [sum(hidden[j] * softmax[j][c] for j in dims) + bias[c] for c in (0, 1)]
                top = max(logits)
                p = [math.exp(x - top) for x in logits]
                error = [(p[c] / sum(p) - (c == labels[i])) / len(batch) for c in (0, 1)]
                for j in dims:
                    for c in (0, 1):
                        to_softmax[j][c] += hidden[j] * error[c]
                    down = sum(error[c] * softmax[j][c] for c in (0, 1))
                    for b, w in row.items():
                        step.setdefault(b, [0.0] * options.dim)[j] += down * w
                for c in (0, 1):
                    to_bias[c] += error[c]
            for b, g in step.items():
                squares[b] += sum(x * x for x in g) / options.dim
                pulled[b] = [x + y for x, y in zip(pulled[b], g)]
                spread = math.sqrt(squares[b])
                size = math.sqrt(sum(x * x for x in pulled[b]) / options.dim + 1e-30)
                sure = max(0.0, 1 - options.doubt * spread / size)
                vector[b] = [o - options.rate * sure / spread * x for o, x in zip(origin[b], pulled[b])]
            for j in dims:
                for c in (0, 1):
                    softmax_squares[j][c] += to_softmax[j][c] ** 2
                    softmax[j][c] -= rate * to_softmax[j][c] / math.sqrt(softmax_squares[j][c])
            for c in (0, 1):
                bias_squares[c] += to_bias[c] ** 2
                bias[c] -= rate * to_bias[c] / math.sqrt(bias_squares[c])
    return {b: sum(vector[b][j] * (softmax[j][1] - softmax[j][0]) for j in dims) for b in used}, bias[1] - bias[0]


def classifier_score(text, weights, bias, options):
    """The chance of label 1 by these weights."""
    words = (text.lower() if options.lower else text).split()
    means = [np.mean([weights.get(b, 0.0) for b in _hash_of_symbols(w, options)]) for w in words]
    means += [weights.get(b, 0.0) for b in _pairs(words, options)]
    return 1 / (1 + math.exp(-(bias + (sum(means) / len(means) if means else 0.0))))


def contamination(docs, items, window=10):
    """``doc_id, n_words, n_hit, n_items, items_sha256, contaminated`` by comparing every window with every position."""
    out, items = [], list(items)
    for doc_id, text in docs:
        words, hit, names = alnum_words(text), set(), set()
        for item, passage in items:
            pattern = alnum_words(passage)
            m = min(window, len(pattern))
            windows = {tuple(pattern[i : i + m]) for i in range(len(pattern) - m + 1)} if m else set()
            for i in range(len(words) - m + 1):
                if tuple(words[i : i + m]) in windows:
                    hit.update(range(i, i + m))
                    names.add(str(item))
        digest = hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()
        out.append((doc_id, len(words), len(hit), len(names), digest, bool(hit)))
    return out
