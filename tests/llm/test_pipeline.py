import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
from tokenizers import Tokenizer

import corpus_pipeline
import brute
from strataledger.llm import subword_classifier as S
from strataledger.llm.queries import vocabulary
from strataledger.llm.words import plain_words
from strataledger.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


def test_every_operator_has_a_query():
    assert sorted(int(name[2:].split("_")[0]) for name in QUERIES) == list(range(1, 14))
    assert set(ORACLE_SQL) <= set(QUERIES)


def test_stages_keep_the_columns_of_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == columns, name
        docs = docs.cache()
        assert name == "mixing" or 0 < docs.count() <= before
        before = docs.count()
    out = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert out.count() == before


def test_a_run_on_empty_tables_and_beside_clashing_columns(spark, tmp_path):
    extra = "score double, predicted int, taken long, target double, node string, item_id int, __size double"
    rows = spark.createDataFrame([], f"doc_id long, text string, source string, {extra}")
    labels, items = "doc_id long, quality int, score int", "item_id string, text string, doc_id int"
    for folder, docs in (("none", rows), ("some", spark.createDataFrame([(k, f"some words {k} of a text", "a", 0.5, 1, 2, 3.0, "n", 4, 0.1) for k in range(6)], rows.schema))):
        docs.write.parquet(f"{tmp_path}/{folder}/documents.parquet")
        spark.createDataFrame([(0, 1, 7), (3, 1, 7)][: docs.count()], labels).write.parquet(f"{tmp_path}/{folder}/labels.parquet")
        spark.createDataFrame([], items).write.parquet(f"{tmp_path}/{folder}/benchmark.parquet")
    out = corpus_pipeline.run(spark, f"{tmp_path}/none")
    assert out.count() == 0 and out.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    assert {r.doc_id for r in corpus_pipeline.run(spark, f"{tmp_path}/some").collect()} <= set(range(6))


def test_rows_of_a_run_equal_brute_force(spark, tmp_path):
    rng = random.Random(6)
    vocabulary_of = [a + b for a in ("al", "be", "ga", "de", "ep", "ze") for b in ("pha", "ta", "mma", "lta", "silon", "eta", "ka")]
    good = [" ".join(rng.choices(vocabulary_of, k=rng.randint(20, 60))) for _ in range(90)]
    junk = ["zzq xxv qqk " * rng.randint(5, 12) for _ in range(90)]
    rows = [(i, t, "abc"[i % 3]) for i, t in enumerate(good + junk)]
    rows += [(200, good[3], "a"), (201, good[4] + " end", "b"), (5, good[5], "c"), (5, good[5] + " end", "c"), (6, good[7] + " end", "b")]
    rows += [(None, good[8] + " end", None), (None, good[9] + " end", None), (None, " ".join(reversed(good[9].split())), None)]
    rows += [(210, None, "a"), (211, "", "b"), (212, " \n\t", "c"), (None, None, "a"), (213, "one", "a"), (214, "one", "b")]
    rows += [(215, good[10] + " " + good[11], "a")]
    labels = [(i, int(i < 90)) for i in range(180)]
    items = [("i1", good[12]), ("i2", None)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(items, "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    crc = lambda i: zlib.crc32(str(i).encode())
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    marks = spark.read.parquet(f"{tmp_path}/labels.parquet")
    # the order in which the model sees its rows is the session's hash order; all else is done again by hand
    model = S.learn(docs.select("doc_id", "text"), marks, "quality", lambda c: S.fold(c, 3) == 1, S.QUALITY)
    assert any(crc(i) % 3 == 1 for i, _ in labels)
    scorer = S.Scorer(model)
    kept = [r for r in rows if scorer.score(r[1]) >= 0.5]
    assert 0 < len(kept) < len(rows)

    def shingles(text):
        w = plain_words(text)
        return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()

    sets = [shingles(r[1]) for r in kept]
    root = list(range(len(kept)))
    for a in range(len(kept)):
        for b in range(a):
            if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                root = [root[b] if r == root[a] else r for r in root]
    groups = defaultdict(list)
    for k, r in enumerate(kept):
        groups[root[k] if sets[k] else (k,)].append(r)
    survivors = []  # several texts of the least id are told apart by a hash that only Spark has
    left = Counter((r.doc_id, r.text, r.source) for r in corpus_pipeline.near_duplicates(spark, spark.createDataFrame(kept, docs.schema), "").collect())
    for group in groups.values():
        least = min((r[0] is None, r[0] or 0) for r in group)
        fit = list({r for r in group if (r[0] is None, r[0] or 0) == least and left[r]})
        assert len(fit) == 1
        left[fit[0]] -= 1
        survivors += fit
    assert not +left

    hits = brute.contamination([(k, r[1]) for k, r in enumerate(survivors)], items)
    clean = [r for r, h in zip(survivors, hits) if not h[5]]
    assert len(clean) < len(survivors)

    size = [len(plain_words(r[1])) for r in clean]
    names = sorted({r[2] for r in clean}, key=lambda x: (x is None, x or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    words = {s: sum(n for r, n in zip(clean, size) if r[2] == s) for s in names}
    low, high = 0.0, 1e9
    for _ in range(200):
        level = (low + high) / 2
        low, high = (level, high) if sum(min(2 * words[s], weight[s] * level) for s in names) < 1.5 * sum(size) else (low, level)
    library = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    want = Counter()
    for s in names:
        budget = int(min(2 * words[s], weight[s] * high) + 1e-6)
        epochs, rest = divmod(budget, words[s]) if words[s] else (0, 0)
        own = [(hashlib.md5((("" if r[0] is None else str(r[0])) + "mix-1" + ("" if r[1] is None else hashlib.md5(r[1].encode()).hexdigest())).encode()).hexdigest(), n, r) for r, n in zip(clean, size) if r[2] == s]
        for _, n, r in sorted(own, key=lambda x: x[:2]):
            cut = max(0, min(n, rest))
            rest -= cut
            ids = [*library.encode(r[1] or "", add_special_tokens=False).ids, 0]
            want[r[0], len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())] += int((epochs * n + cut) / n + 0.5) if n else 1
    found = Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    assert found == +want
