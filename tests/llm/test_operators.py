"""Operators of the training-data pipeline against brute force, on tables with every odd case."""

import dataclasses
import hashlib
import pickle
import random
import re
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import brute

from strataledger.llm import decontamination as D
from strataledger.llm import fill_in_middle as FM
from strataledger.llm import hash_arrays as H
from strataledger.llm import jaccard_join as J
from strataledger.llm import language_model as LM
from strataledger.llm import merkle as MK
from strataledger.llm import mixing as MX
from strataledger.llm import near_vectors as NV
from strataledger.llm import subword_classifier as S
from strataledger.llm import token_counts as TC
from strataledger.llm import token_files as TF
from strataledger.llm import top_k as TK
from strataledger.llm import warc as WA
from strataledger.llm.queries import vocabulary
from strataledger.llm.words import plain_words

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, taken long, __words string"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def texts(seed=1, n=40):
    rng = random.Random(seed)
    out = [" ".join(rng.choices(WORDS, k=rng.randint(1, 60))) for _ in range(n)]
    base = " ".join(rng.choices(WORDS, k=80))
    out += [base, base, base.upper(), base + " omega", "odd " + base, base.replace("alpha", "omega", 1)]
    out += ["", None, "   \n\t", "one", "one", "two words", "Two  words", "ÄÖÜ ñandú \x85 \x1c x", "word " * 5000]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", "ab"[i % 2] if i % 7 else None, 1, 0.5, 9, "x") for i, t in enumerate(texts())]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def rows_of(df):
    return {r.doc_id: r for r in df.collect()}


def test_mixing_takes_each_budget_exactly(docs, empty):
    found = MX.mix_documents(docs).collect()
    assert len(found) == docs.count()
    sizes = {i: len(plain_words(t)) for i, t in enumerate(texts())}
    assert {r.doc_id: r["size"] for r in found} == sizes
    by_source = defaultdict(list)
    for r in found:
        assert 0 <= r.taken <= 2 * r["size"]
        by_source[r.source_size, r.target].append(r)
    for (size, target), rows in by_source.items():
        assert target <= 2 * size + 1e-9
        assert sum(r.taken for r in rows) == int(target)
    assert sum(int(t) for _, t in by_source) == pytest.approx(1.5 * sum(sizes.values()), abs=len(by_source))
    again = MX.mix_documents(docs.repartition(3)).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, found))
    assert MX.mix_documents(empty).count() == 0
    assert MX.mix_copies(docs).columns == docs.columns


def test_mixed_copies_keep_rows_without_words_and_half_taken_ones(docs):
    taken = {r.doc_id: (r["size"], r.taken) for r in MX.mix_documents(docs).collect()}
    want = Counter({i: int(t / n + 0.5) if n else 1 for i, (n, t) in taken.items()})
    assert Counter(r.doc_id for r in MX.mix_copies(docs).collect()) == +want
    assert sum(n == 0 for n, _ in taken.values()) == 3


def test_mixing_repeats_rows_that_share_an_id(spark):
    rows = spark.createDataFrame([(1, "a b", None), (1, "a b", None), (None, "c", None), (None, None, None)], "doc_id long, text string, source string")
    found = MX.mix_documents(rows).collect()
    assert sum(r.taken for r in found) == 7 and len(found) == 4


def test_warc_round_trip(spark):
    big, small = "x" * 1000, "y" * 999
    data = [(1, "http://a\r\nb", big), (2, None, big), (3, "u", small), (4, "u", small), (5, "u", None), (5, "u", None), (None, "u", big), (7, "u", "é" * 500), (8, "u", "é" * 500)]
    pages = spark.createDataFrame(data, "page_id long, url string, html string")
    archive = WA.write_archive(pages)
    records = WA.read_records(spark, archive)
    index = sorted(map(tuple, WA.record_index(records).collect()), key=str)
    expected = []
    for page, _, html in data:
        payload = (html or "").encode()
        equal = [p for p, _, h in data if (h or "").encode() == payload and p is not None]
        first = max(equal) if equal else None
        revisit = len(payload) >= 1000 and page != first
        expected.append((page, len(payload), hashlib.sha1(payload).hexdigest(), "revisit" if revisit else "response", first if revisit else None))
    assert index == sorted(expected, key=str)
    assert spark.read.parquet(archive.payloads).count() == len({(h or "") for _, _, h in data})
    for r in records.collect():
        head, _, rest = bytes(r.record).partition(b"\r\n\r\n")
        length = int([line for line in head.split(b"\r\n") if line.startswith(b"Content-Length")][0].split()[1])
        assert len(rest) == length + 4
    empty = WA.write_archive(spark.createDataFrame([], "page_id long, url string, html string"))
    assert WA.record_index(WA.read_records(spark, empty)).count() == 0


@pytest.mark.parametrize("most_windows", [200_000, 30])
def test_decontamination_equals_brute_force(spark, docs, empty, most_windows, monkeypatch):
    monkeypatch.setattr(D, "PIECE_WINDOWS", 7)
    source = texts()
    items = [("i1", source[0]), ("i2", "alpha beta gamma"), (None, source[40]), ("i3", None), ("i4", "..."), ("i2", source[41]), ("i5", "one")]
    benchmark = spark.createDataFrame(items, "item_id string, text string")
    found = D.contamination(docs, benchmark, most_windows=most_windows).collect()
    named = [(i, t) for i, t in items if i is not None]
    want = {r[0]: r for r in brute.contamination(enumerate(source), named)}
    hits = {r[0]: r for r in brute.contamination(enumerate(source), items)}
    for r in found:
        assert (r.n_words, r.n_items, r.items_sha256) == (want[r.doc_id][1], want[r.doc_id][3], want[r.doc_id][4])
        assert (r.n_hit, r.contaminated) == (hits[r.doc_id][2], hits[r.doc_id][5])
    assert len(found) == len(source)
    kept = D.without_contaminated(docs, benchmark)
    assert kept.columns == docs.columns and kept.count() == sum(not h[5] for h in hits.values())
    assert D.contamination(empty, benchmark).count() == 0
    assert D.contamination(docs, benchmark.limit(0)).where("contaminated").count() == 0


def test_tables_of_a_pass_are_bounded():
    rng = random.Random(7)
    words = [a + b + c for a in WORDS for b in WORDS for c in WORDS[:5]]
    piece = " ".join(rng.choices(words, k=D.PIECE_WINDOWS + 9)).encode()
    tracemalloc.start()
    index = D.WindowIndex([("i", 10, piece)])
    held = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert len(index.tables[0][4]) and held * D.MOST_WINDOWS / D.PIECE_WINDOWS < 400e6


@pytest.mark.parametrize(("size", "num", "den"), [(4, 85, 100), (5, 80, 100)])
def test_jaccard_equals_brute_force(spark, docs, empty, size, num, den):
    sets = []
    for t in texts():
        w = plain_words(t)
        sets.append({tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set())
    root = list(range(len(sets)))
    degree = [0] * len(sets)
    for a in range(len(sets)):
        for b in range(a):
            if sets[a] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
                degree[a] += 1
                degree[b] += 1
                low, high = sorted((root[a], root[b]))
                root = [low if r == high else r for r in root]
    found = rows_of(J.jaccard_components(docs, size, num, den))
    assert {i: (r.n_shingles, r.component_id, r.n_links) for i, r in found.items()} == {
        i: (len(sets[i]), root[i], degree[i]) for i in range(len(sets))
    }
    kept = J.one_of_each(docs, size, num, den)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == set(root)
    assert J.jaccard_components(empty).count() == 0


def test_one_of_each_keeps_one_row_of_null_and_repeated_ids(spark):
    rng = random.Random(8)
    a, b, c, d, e = (" ".join(rng.choices([x + y for x in WORDS for y in WORDS], k=60)) for _ in range(5))
    rows = [(None, a), (None, a + " x"), (None, b), (1, b + " x"), (2, c), (2, d + " y"), (1, d), (3, e), (3, e.upper()), (3, e + " z"), (None, None), (4, "")]
    kept = J.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    found = Counter((r.doc_id, (r.text or "")[:20].lower()) for r in kept)
    assert found == Counter([(None, a[:20]), (1, b[:20]), (2, c[:20]), (1, d[:20]), (3, e[:20]), (None, ""), (4, "")])


def test_components_are_whole(spark):
    path = spark.createDataFrame([(k, k + 1) for k in range(40)], "a long, b long")
    assert {(r.node, r.root) for r in J.components(path).collect()} == {(k, 0) for k in range(41)}


def test_few_maps_serve_many_files(tmp_path):
    names = [H.save(str(tmp_path), keys=np.arange(k, k + 5, dtype=np.uint64)) for k in range(3000)]
    files = pickle.loads(pickle.dumps(H.MappedFiles(str(tmp_path), most=20)))
    before = len(open("/proc/self/maps").readlines())
    for k in [*range(3000), *range(0, 3000, 7)]:
        assert files.arrays(names[k])["keys"][0] == k
    assert len(files.open) == 20 and len(open("/proc/self/maps").readlines()) < before + 100


def test_counts_are_dealt_in_two_steps(spark, docs, monkeypatch):
    plain_links, plain_scores = J.jaccard_components(docs).collect(), LM.score_documents(docs).collect()
    monkeypatch.setattr(H, "COARSE", 2)
    for module in (J, LM):
        monkeypatch.setattr(module, "partitions_for", lambda *_: 11)
        monkeypatch.setattr(module, "GATHERED", 50)
    assert sorted(map(tuple, J.jaccard_components(docs).collect())) == sorted(map(tuple, plain_links))
    again = {r.doc_id: r for r in LM.score_documents(docs).collect()}
    for r in plain_scores:
        assert again[r.doc_id][:5] == r[:5] and again[r.doc_id].score == pytest.approx(r.score)
        assert again[r.doc_id].base_score == pytest.approx(r.base_score)


def test_jaccard_opens_split_groups(spark, monkeypatch):
    rng = random.Random(3)
    base = [rng.choice(WORDS) + str(k) for k in range(120)]
    rows = []
    for i in range(60):
        words = list(base)
        for _ in range(rng.randint(0, 5)):
            words[rng.randrange(120)] = f"edit{rng.random()}"
        rows.append((i, " ".join(words)))
    monkeypatch.setattr(J, "GROUP_SIZE", 7)
    monkeypatch.setattr(J, "QUERY_SIZE", 5)
    sets = [{tuple(t.split()[k : k + 4]) for k in range(117)} for _, t in rows]
    degree = [sum(100 * len(a & b) >= 85 * len(a | b) for b in sets) - 1 for a in sets]
    found = rows_of(J.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")))
    assert [found[i].n_links for i in range(60)] == degree


def test_top_k_equals_brute_force(spark):
    rng = np.random.default_rng(5)
    vectors = rng.uniform(-1, 1, (300, 8)).astype(np.float32)
    vectors[40:120] = vectors[40]  # ties
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    odd = [(1000, None), (1020, [1.0, None] + [0.0] * 6), (1040, [float("nan")] * 8), (1060, [float("inf")] * 8), (None, [0.0] * 8), (1080, [1.0]), (1081, [2.0]), (1100, [])]
    table = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>")
    found = defaultdict(list)
    for r in TK.top_k(table, block_vectors=64, block_queries=8).orderBy("query_id", "rank").collect():
        found[r.query_id].append((r["rank"], r.vec_id, r.score))
    ints = np.floor(64 * vectors.astype(np.float64)).astype(np.int64)
    for q in range(0, 300, 20):
        scores = ints @ ints[q]
        best = sorted((-int(s), i) for i, s in enumerate(scores) if i != q)[:20]
        assert found[q] == [(k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert found[1080] == [(1, 1081, 64 * 128)]
    assert set(found) == {*range(0, 300, 20), 1080}
    assert TK.top_k(table.limit(0)).count() == 0


def test_top_k_with_clashing_columns_and_repeated_rows(spark):
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (0, [0.0, 1.0]), (1, [0.5, 0.5]), (1, [0.5, 0.5]), (2, [1.0, 1.0])]
    table = spark.createDataFrame([(i, v, "x", 1, 2, 3) for i, v in rows], "vec_id long, embedding array<float>, score string, rank int, query_id int, dim int")
    found = Counter(map(tuple, TK.top_k(table).select("query_id", "rank", "vec_id", "score").collect()))
    # the two vectors of id 0 are two queries, each against the three other rows
    assert found == Counter({(0, 1, 2, 4096): 2, (0, 2, 1, 2048): 2, (0, 3, 1, 2048): 2})


def test_warc_with_clashing_columns(spark):
    pages = spark.createDataFrame([(1, "u", "x" * 1000, "a", "b", 1, 2), (1, "u", "x" * 1000, "a", "b", 1, 2)], "page_id long, url string, html string, address string, payload string, length int, part int")
    found = WA.record_index(WA.read_records(spark, WA.write_archive(pages))).collect()
    assert [(r.page_id, r.payload_bytes, r.record_type) for r in found] == [(1, 1000, "response")] * 2


def test_top_k_stops_early_and_stays_exact():
    rng = np.random.default_rng(1)
    nothing = np.full(10, -np.inf)
    for shape in (lambda x: x**3 * 8, lambda x: x * 8):  # a few large components, and dense ones
        v = np.floor(shape(rng.standard_normal((2000, 64))))
        block = TK.Block.from_bytes(64, **TK.Block.of(np.arange(2000), v).to_bytes())
        assert (block.vectors() == v).all()
        found, work = block.top(np.arange(10), v[:10], 5, nothing)
        for i, (at, score) in enumerate(found):
            want = sorted((-int(s), j) for j, s in enumerate(v @ v[i]) if j != i)[:5]
            assert list(zip((-score).tolist(), at.tolist())) == want
        assert work < 0.9 * 10 * v.size  # a plain product takes all
        sure = np.array([s[-1] for _, s in found], float)
        again, less = block.top(np.arange(10), v[:10], 5, sure)
        assert all((a[0] == b[0]).all() for a, b in zip(found, again)) and less <= 1.1 * work
    huge = TK.Block.of(np.arange(50), v[:50] * 2.0**40)
    ((at, score),), _ = huge.top(np.arange(1), v[:1] * 2.0**40, 3, nothing[:1])
    want = sorted((-min(max(int(s) << 80, TK.LONG[0]), TK.LONG[1]), j) for j, s in enumerate(v[:50] @ v[0]) if j)[:3]
    assert list(zip([-int(s) for s in score], at.tolist())) == want


def test_blocks_that_cannot_reach_are_not_read():
    rng = np.random.default_rng(2)
    centres = rng.standard_normal((8, 16)) * 40
    queries = np.floor(centres[:4])
    limits = [TK.Block.of(np.arange(30), np.floor(c + rng.standard_normal((30, 16)))).bounds() for c in centres]
    low, high, centre = (np.array([x[j] for x in limits]) for j in range(3))
    bound = TK.best_possible(queries, low, high, centre, np.array([x[3] for x in limits]))
    for q in range(4):
        assert (bound[q, [b for b in range(8) if b != q]] < bound[q, q] - 500).all()


def test_token_counts_equal_the_library(spark, docs, empty):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    rng = random.Random(2)
    odd = ["".join(rng.choice("aAbσΣ \n'é1<|>.\x1c\x85中👍rsteo") for _ in range(rng.randint(0, 50))) for _ in range(500)]
    odd += ["<|endoftext|> a<|startoftext|>", "ab" * 3000, "İ ﬁ Ⅻ", "it's we'll"]
    counter = TC.Counter(vocabulary("word_bpe_49k.json"), cache_size=50)
    assert counter.counts(odd) == [len(library.encode(t, add_special_tokens=False).ids) for t in odd]
    for i, r in rows_of(TC.count_tokens(docs, vocabulary("word_bpe_49k.json"))).items():
        text = texts()[i] or ""
        n = len(library.encode(text, add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(text.encode()), n, n > 2048)
    assert TC.count_tokens(empty, vocabulary("word_bpe_49k.json")).count() == 0


def test_token_files_round_trip(spark, docs, empty):
    from tokenizers import Tokenizer

    path = vocabulary("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    encoder = TF.Encoder(path, cache_size=30)
    odd = ["  a  b\n \n c", "a\n b", "x   y", " lead", "trail  ", "a  b c", "<|endoftext|> hi", "\x85 a", "", None]
    ids, counts = encoder.batch(pa.array(odd))
    want = [library.encode(t or "", add_special_tokens=False).ids for t in odd]
    assert counts.tolist() == list(map(len, want)) and ids.tolist() == sum(want, [])
    found = rows_of(TF.token_index(docs, path, segment_ids=100))
    start = 0
    for i, text in enumerate(texts()):
        own = [*library.encode(text or "", add_special_tokens=False).ids, 0]
        crc = zlib.crc32(np.array(own, "<u4").tobytes())
        assert (found[i].start, found[i].n_tokens, found[i].ids_crc32) == (start, len(own), crc)
        start += len(own)
    twice = TF.token_index(docs.union(docs.limit(3)), path)
    assert twice.count() == docs.count() + 3
    assert TF.token_index(empty, path).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_token_ids_beside_any_white_space(seed):
    encoder = TF.Encoder(vocabulary("byte_bpe_50k.json"), cache_size=2000)
    blank = [c for c in map(chr, range(0x110000)) if c.isspace()]
    others = [*"abcABC'stred019.,!$%éÉßſºª中文👍́​\x00\x7fµ×", "'s", "'ll", "<|endoftext|>", "<|end", "oftext|>", "word"]
    rng = random.Random(seed)
    for _ in range(60):
        some = ["".join(rng.choice(2 * blank + 40 * [" "] + others) for _ in range(rng.randint(0, 30))) for _ in range(40)]
        ids, counts = encoder.batch(pa.array(some))
        want = [encoder.library.encode(t, add_special_tokens=False).ids for t in some]
        assert counts.tolist() == list(map(len, want)) and ids.tolist() == sum(want, [])
    for texts in (["x \xa0 y", "x \xa0\xa0 y", "w \xa0\xa0\xa0 z"], ["a\x1c \x1c b", "\x85 \x85", "\n \n", " ", "  "]):
        ids, _ = encoder.batch(pa.array(texts))
        assert ids.tolist() == sum((encoder.library.encode(t, add_special_tokens=False).ids for t in texts), [])


def test_other_vocabularies_are_refused():
    with pytest.raises(ValueError):
        TF.Encoder(vocabulary("word_bpe_49k.json"))


@pytest.mark.parametrize("n", [0, 1, 63, 1023, 1024, 1025, 3000])
@pytest.mark.parametrize("most", [0, 1, 50256, 2**32 - 1])
def test_patched_blocks(n, most):
    values = np.random.default_rng(n).integers(0, most, n, dtype=np.uint32, endpoint=True)
    values[::9] = 0
    assert (TF.decode_blocks(TF.encode_blocks(values)) == values).all()
    with pytest.raises(ValueError):
        TF.read_segment(b"x" * 64)


def test_classifier_learns_marks_and_misspellings(spark, empty):
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(600):
        words = rng.choices([a + b for a in WORDS for b in WORDS], k=60)
        bad = i % 4 == 0
        if bad:
            for _ in range(4):
                words[rng.randrange(60)] = rng.choice(["wretched", "rubbish"])
        rows.append((i, " ".join(words), "x"))
        labels.append((i, int(bad)))
    rows += [(9000, " ".join(["wretchedd", "rubbishy"] * 3 + rng.choices(WORDS, k=40)), "x"), (9001, None, "x"), (9002, "", "x"), (None, "alpha", "x"), (5, rows[5][1], "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    marks = spark.createDataFrame([*labels, (7, None), (9001, 1), (None, 1)], "doc_id long, toxic int")
    found = S.toxicity(docs, marks).collect()
    assert len(found) == len(rows)
    right = [r.predicted == int(r.doc_id % 4 == 0) for r in found if r.doc_id is not None and r.doc_id < 600 and r.held_out]
    assert np.mean(right) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in found)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in found if r.doc_id is not None)
    assert next(r for r in found if r.doc_id == 9000).predicted == 1
    assert len({r.score for r in found if r.doc_id in (9001, 9002)}) == 1
    assert S.toxicity(docs, marks.limit(0)).where("predicted = 1").count() in (0, len(rows))
    narrow = empty.select("doc_id", "text")
    assert S.toxicity(narrow, marks).count() == 0


@pytest.mark.parametrize("options", [S.TOXICITY, S.QUALITY])
def test_classifiers_equal_plain_python(options):
    rng = random.Random(11)
    options = dataclasses.replace(options, epochs=3, min_docs=3, rate=3.0, doubt=0.5, batch=8)
    good, bad = WORDS[:12], ["Wretched", "rubbish", "Näïve", "spam"]
    texts, labels = [], []
    for i in range(60):
        words = rng.choices(good, k=rng.randint(3, 12)) + (rng.choices(bad, k=3) if i % 3 == 0 else [])
        words += words[-1:] * (i % 2)
        texts.append(" ".join(words))
        labels.append(int(i % 3 != 0))
    model = S.train([S.tokens(t, options) for t in texts], labels, options)
    weights, bias = brute.classifier(texts, labels, options)
    found = np.zeros(1 << options.bits)
    found[list(weights)] = list(weights.values())
    assert model.weights == pytest.approx(found, abs=1e-4) and model.bias == pytest.approx(bias, abs=1e-6)
    assert np.abs(found).max() > 0.5
    small = S.Scorer(dataclasses.replace(model, options=dataclasses.replace(options, cache_words=5)))
    whole = S.Scorer(model)
    assert [small.score(t) for t in texts] == pytest.approx([whole.score(t) for t in texts], abs=1e-12)
    for text in [*texts, "", "unseen", "x " * 3000, "RUBBISH rubbish rubbishy"]:
        assert S.Scorer(model).score(text) == pytest.approx(brute.classifier_score(text, weights, bias, options), abs=1e-4)


def test_a_sample_by_class_keeps_the_share_of_the_classes(spark):
    known = spark.createDataFrame([(i, int(i % 10 == 0), i * 7 % 101) for i in range(200)], "doc_id long, __label int, __order long")
    picked, share = S.by_class(known, 30)
    assert Counter(r["__label"] for r in picked) == {1: 15, 0: 15} and share == pytest.approx(20.5 / 201)
    assert Counter(r["__label"] for r in S.by_class(known, 100)[0]) == {1: 20, 0: 80}  # all of the smaller class
    assert S.by_class(known.limit(0), 30) == ([], None)
    lots = [S.tokens(t, S.TOXICITY) for t in ("good", "bad")] * 20
    even, moved = (S.train(lots, [0, 1] * 20, S.TOXICITY, share) for share in (None, 0.1))
    assert moved.bias - even.bias == pytest.approx(np.log(0.1 / 0.9), abs=1e-9) and np.array_equal(moved.weights, even.weights)


def test_quality_is_told_on_held_out_rows(spark, empty):
    rng = random.Random(12)
    rows = []
    for i in range(700):
        words = rng.choices([a + b for a in WORDS for b in WORDS], k=rng.randint(20, 60))
        rows.append((i, " ".join(w for x in words for w in ([x] * 3 if i % 2 else [x])), "en"))
    rows += [(900, "click " * 40_000, "en"), (901, None, None), (None, "", None), (3, rows[3][1], "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, predicted string")
    marks = spark.createDataFrame([(i, 1 - i % 2) for i in range(700)] + [(900, 0)], "doc_id long, quality int")
    found = S.quality(docs, marks).collect()
    assert len(found) == len(rows)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in found)
    right = [r.predicted == 1 - r.doc_id % 2 for r in found if r.held_out and r.doc_id < 700]
    assert len(right) > 150 and np.mean(right) > 0.95
    assert len({r.score for r in found if r.doc_id in (901, None)}) == 1
    kept = S.of_quality(docs, marks)
    assert kept.columns == docs.columns and sum(r.predicted for r in found) == kept.count()
    assert S.quality(empty.select("doc_id", "text"), marks).count() == 0


def test_language_model_equals_formulas(spark, docs, empty):
    found = rows_of(LM.score_documents(docs))
    tokens = {i: [LM.START, *plain_words(t), LM.END] for i, t in enumerate(texts())}
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i in tokens}
    single, pairs = Counter(), Counter()
    for i, w in tokens.items():
        if not held[i]:
            single.update(w[1:])
            pairs.update(zip(w, w[1:]))
    n, types = sum(single.values()), len(single)
    numbers, ends = defaultdict(lambda: [0, 0, 0, 0]), Counter()
    for (a, b), k in pairs.items():
        numbers[a][min(k, 3) - 1] += 1
        numbers[a][3] += k
        ends[b] += 1
    of = lambda c: LM.discounts(*(Counter(c.values())[k] for k in (1, 2, 3, 4)))
    d2, d1 = of(pairs), of(ends)
    cut = lambda k, d: max(k - d[min(k, 3) - 1], 0) if k else 0
    left = sum(d1[min(k, 3) - 1] for k in ends.values()) / len(pairs)

    def p1(b):
        return cut(ends[b], d1) / len(pairs) + left / (types + 1)

    def p2(a, b):
        if a not in numbers:
            return p1(b)
        *ones, total = numbers[a]
        return (cut(pairs[a, b], d2) + sum(x * k for x, k in zip(d2, ones)) * p1(b)) / total

    assert sum(p2(b"alpha", b) for b in single) + p2(b"alpha", b"unseen") == pytest.approx(1)
    for i, w in tokens.items():
        r = found[i]
        assert (r.held_out, r.n_tokens, r.train_tokens) == (held[i], len(w) - 1, n)
        assert r.n_known == sum(single[b] > 0 for b in w[1:])
        assert r.base_score == pytest.approx(sum(np.log10((single[b] + 0.1) / (n + 0.1 * (types + 1))) for b in w[1:]))
        assert r.score == pytest.approx(sum(np.log10(p2(a, b)) for a, b in zip(w, w[1:])))
    assert LM.score_documents(empty).count() == 0


def test_hash_arrays(tmp_path):
    rng = np.random.default_rng(0)
    for values in (np.zeros(0, np.uint64), rng.integers(0, 2**64, 1000, dtype=np.uint64), np.arange(5, dtype=np.uint64)):
        assert (H.from_bytes(H.to_bytes(values)) == values).all()
        assert (H.sorted_from_bytes(H.sorted_to_bytes(np.sort(values))) == np.sort(values)).all()
        name = H.save(str(tmp_path), keys=values, n=np.arange(3, dtype=np.uint8))
        arrays = H.MappedFiles(str(tmp_path)).arrays(name)
        assert (arrays["keys"] == values).all() and arrays["n"].tolist() == [0, 1, 2]
    with pytest.raises(ValueError):
        H.local_folder("hdfs://host/path")


def test_warc_records_that_do_not_hold_what_they_say_fail(spark):
    pages = spark.createDataFrame([(1, "u", "x" * 1000, 5), (2, "u", "x" * 1000, 6), (3, "u", "é" * 40_000, 7)], "page_id long, url string, html string, record int")
    archive = WA.write_archive(pages)
    records = WA.read_records(spark, archive, most=1)  # a shared payload is dealt to two tasks
    assert {(r.page_id, r.payload_bytes, r.refers_to) for r in WA.record_index(records).collect()} == {(1, 1000, 2), (2, 1000, None), (3, 80_000, None)}
    longer = F.concat("record", F.lit(b"x"))
    other = F.encode(F.regexp_replace(F.decode("header", "UTF-8"), "(WARC-Payload-Digest: sha1:)[0-9a-f]{40}", "$1" + "0" * 40), "UTF-8")
    cut = F.concat(F.substring("record", 1, 10), F.substring("record", 12, 1 << 30), F.lit(b"x"))
    for damaged in (records.withColumn("record", longer), records.withColumn("header", other), records.withColumn("record", cut)):
        with pytest.raises(Exception, match="does not hold what its header says"):
            WA.record_index(damaged).collect()


def merkle(rows):
    """Leaf, subroot, root and proof of every row, and the root that its changed leaf folds to, in plain Python."""
    h = lambda *parts: hashlib.sha256("".join(parts).encode()).hexdigest()
    form = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    lower = str.maketrans(MK.UPPER, MK.LOWER)

    def tree(nodes):
        paths = [[] for _ in nodes]
        owners = [[k] for k in range(len(nodes))]
        while len(nodes) > 1:
            up, above = [], []
            for a in range(0, len(nodes), 8):
                run = nodes[a : a + 8]
                for k in range(len(run)):
                    for leaf in owners[a + k]:
                        paths[leaf].append((run[:k], run[k + 1 :]))
                up.append(h(*run))
                above.append([x for o in owners[a : a + 8] for x in o])
            nodes, owners = up, above
        return nodes[0], paths

    groups = defaultdict(list)
    for doc_id, text, lang, source, n_chars in rows:
        leaf = lambda t: h(*map(form, (doc_id, source, lang, n_chars, t)))  # noqa: B023,E731
        tampered = doc_id is not None and zlib.crc32(str(doc_id).encode()) % 3 == 0 and text is not None
        groups[lang].append((doc_id is not None, doc_id or 0, leaf(text), leaf(text.translate(lower) if tampered else text), doc_id))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in order:
        groups[g].sort(key=lambda r: r[:3])
        trees[g] = tree([r[2] for r in groups[g]])
    root, tops = tree([trees[g][0] for g in order]) if order else (None, [])
    out = []
    for g, top in zip(order, tops, strict=True):
        for (_, _, leaf, shown, doc_id), path in zip(groups[g], trees[g][1], strict=True):
            node = shown
            for left, right in [*path, *top]:
                node = h(*left, node, *right)
            proof = h(*(x for left, right in [*path, *top] for x in (*left, *right)))
            out.append((doc_id, leaf, trees[g][0], root, proof, node, node == root))
    return out


@pytest.mark.parametrize("languages", [(None,), ("en",), ("en", None, "", "é", "z", "ü", "a", "b", "c", "d")])
def test_merkle_against_plain_python(spark, languages):
    data = [(i, t, languages[i % len(languages)] if i % 3 else languages[0], "s" if i % 5 else None, i) for i, t in enumerate(texts(n=90))]
    data += [(7, "Twice", "en", None, 1), (7, "Twice", "en", None, 1), (None, "No id", "en", "s", None), (None, None, None, None, None), (-4, "A" * 300_000, "en", "s", 3)]
    rows = spark.createDataFrame([(*r, "x", 9) for r in data], "doc_id long, text string, lang string, source string, n_chars int, node string, place int")
    for dealt in (rows,) if len(languages) == 1 else (rows.repartition(5),):
        assert sorted(map(tuple, MK.verify_documents(dealt).collect()), key=str) == sorted(merkle(data), key=str)


def test_merkle_levels_and_empty_tables(spark, empty):
    assert MK.verify_documents(empty).count() == 0
    rows = spark.range(70).select("id", F.lit("=g").alias("group"), F.sha2(F.col("id").cast("string"), 256).alias("node"))
    tree = MK.manifest(rows, ["id"])
    assert [level.count() for level in tree.levels] == [70, 9, 2, 1] and len(tree.top) == 1
    assert [r.place for r in tree.leaves.orderBy("id").collect()] == list(range(70))


def near_by_force(rows, threshold=0.95):
    """``(row, links, component)`` of all pairs, in double precision."""
    usable = [k for k, (_, v) in enumerate(rows) if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    units = {k: np.array(rows[k][1], np.float64) for k in usable}
    units = {k: v / np.abs(v).max() for k, v in units.items()}
    units = {k: v / np.linalg.norm(v) for k, v in units.items()}
    links = defaultdict(set)
    for a in usable:
        for b in usable:
            if a < b and len(units[a]) == len(units[b]) and float(units[a] @ units[b]) >= threshold:
                links[a].add(b)
                links[b].add(a)
    out = []
    for k, (vec_id, _) in enumerate(rows):
        seen, todo = {k}, [k]
        while todo:
            for n in links[todo.pop()] - seen:
                seen.add(n)
                todo.append(n)
        ids = [rows[s][0] for s in seen if rows[s][0] is not None]
        least = min(ids) if ids else None
        out.append((vec_id, len(links[k]), least, vec_id == least))
    return out


def vectors(n=160, dim=64, seed=3):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n, dim)).astype(np.float32)
    rows = [(1000 + k, v.tolist()) for k, v in enumerate(base)]
    at = 0
    for k in range(0, 60):  # pairs of cosines about the threshold, chains, and copies
        u = base[k] / np.linalg.norm(base[k])
        away = rng.normal(size=dim)
        away -= (away @ u) * u
        away /= np.linalg.norm(away)
        for cosine in (0.94, 0.951, 0.97, 0.999)[: 1 + k % 4]:
            rows.append((at, (3 * (cosine * u + np.sqrt(1 - cosine**2) * away)).astype(np.float32).tolist()))
            at += 1
    rows += [(5000 + k, rows[5][1]) for k in range(40)] + [(None, rows[6][1]), (None, None), (1005, rows[5][1]), (1007, rows[9][1])]
    rows += [(9001, None), (9002, []), (9003, [0.0] * dim), (9004, [1.0, None] + [0.0] * (dim - 2)), (9005, [float("nan")] * dim), (9006, [float("inf")] + [0.0] * (dim - 1)), (9007, [1.0, 2.0]), (9008, [1.0, 2.0001]), (9009, [1e-30] * dim), (9010, [1e30] * dim)]
    return rows


@pytest.mark.parametrize("small", [False, True])
def test_near_vectors_against_all_pairs(spark, small, monkeypatch):
    if small:  # many blocks, turns and batches
        monkeypatch.setattr(NV, "BLOCK", 8)
        monkeypatch.setattr(NV, "TURN", 8)
        monkeypatch.setattr(NV, "TOGETHER", 4)
        monkeypatch.setattr(NV, "PAIRS", 3)
    rows = vectors()
    frame = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<float>, n_links int, home string")
    found = NV.near_vectors(frame)
    assert found.columns == ["vec_id", "n_links", "component_id", "kept"]
    assert sorted(map(tuple, found.collect()), key=str) == sorted(near_by_force(rows), key=str)
    assert NV.near_vectors(frame.limit(0)).count() == 0 and NV.near_vectors(frame.where("vec_id = 9001")).first().kept


def test_near_vectors_family_and_recall(spark):
    """A third of all rows near one vector; and pairs in random directions about the threshold, at the default margin."""
    rng = np.random.default_rng(11)
    base = rng.normal(size=(1500, 64))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    away = rng.normal(size=base.shape)
    away -= (away * base).sum(1, keepdims=True) * base
    away /= np.linalg.norm(away, axis=1, keepdims=True)
    pairs = 0.952 * base + np.sqrt(1 - 0.952**2) * away
    family = base[0] + rng.normal(size=(1500, 64)) * 0.02
    x = np.concatenate([base, pairs, family])
    units = x / np.linalg.norm(x, axis=1, keepdims=True)
    linked = units @ units.T >= 0.95
    np.fill_diagonal(linked, False)
    frame = spark.createDataFrame([(k, v) for k, v in enumerate(x.tolist())], "vec_id long, embedding array<double>")
    links = {r.vec_id: r.n_links for r in NV.near_vectors(frame).collect()}
    found, all_links = sum(links.values()), int(linked.sum())
    assert all(links[k] <= n for k, n in enumerate(linked.sum(1).tolist())) and found >= 0.999 * all_links
    proved = {r.vec_id: r.n_links for r in NV.near_vectors(frame, sigmas=8.0).collect()}
    assert [proved[k] for k in range(len(x))] == linked.sum(1).tolist()


def filled(doc_id, text):
    """A document cut and put together in plain Python."""
    text = text or ""
    tokens = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (len(tokens) + 1), h[1] % (len(tokens) + 1)))
    prefix, middle, suffix = ("".join(t) for t in (tokens[:a], tokens[a:b], tokens[b:]))
    if not text or any(m in text for m in FM.SENTINELS) or h[2] % 100 >= 90:
        return doc_id, len(tokens), "plain", None, None, text
    if h[3] % 100 < 20:
        return doc_id, len(tokens), "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return doc_id, len(tokens), "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


@pytest.mark.parametrize("together", [FM.TOGETHER, 50, 1])
def test_fill_in_middle_against_plain_python(spark, empty, monkeypatch, together):
    monkeypatch.setattr(FM, "TOGETHER", together)
    monkeypatch.setattr(FM._parts, "__defaults__", (together,))
    rng = random.Random(5)
    odd = ["<P>", "a<S", ">", "<<P", "P>", "<M>x", "é", "日本", "𝄞𝄞", "\x00", "z" * 9, "A1b", "< P>", "\n"]
    rows = [(i, "".join(rng.choices(odd, k=rng.randint(0, 6))) + rng.choice(["", "tail of words, 12"])) for i in range(300)]
    rows += [(i + 300, t) for i, t in enumerate(texts())] + [(None, "no id here"), (None, None), (4, "again"), (4, "again")]
    if together > 1:
        rows.append((-9, "Ab1 ü" * 300_000))
    frame = spark.createDataFrame([(i, t, 7, "x") for i, t in rows], "doc_id long, text string, n int, output string")
    made = FM.fill_in_middle(frame)
    assert Counter(map(tuple, made.collect())) == Counter(filled(i, t) for i, t in rows)
    back = FM.restored(made.withColumn("__x", F.lit(1)))
    assert Counter((r.doc_id, r.text) for r in back.collect()) == Counter((i, t or "") for i, t in rows) and "__x" in back.columns
    short = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = Counter((*filled(i, t)[:5], short(filled(i, t)[5]), short(t or "")) for i, t in rows)
    assert Counter(map(tuple, FM.digests(frame).collect())) == want
    assert FM.digests(empty).count() == 0


def test_fill_in_middle_refuses_what_cannot_be_undone(spark, docs):
    with pytest.raises(ValueError, match="sentinels"):
        FM.fill_in_middle(docs, sentinels=("<a>", "b", "<c>"))
    made = FM.fill_in_middle(docs).where("form = 'psm'").limit(1)
    with pytest.raises(Exception, match="three sentinels"):
        FM.restored(made.withColumn("output", F.lit("<P>a<S>b"))).collect()
    with pytest.raises(Exception, match="of its form"):
        FM.restored(made.withColumn("form", F.lit("spm"))).collect()
