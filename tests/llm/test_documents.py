"""Document operators against brute force, on odd rows and on sf0.001."""
import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from filelake.llm import decontam, kneser_ney, lmscore, packing, recompress, simhash, tokencount
from filelake.llm.common import WordHash, span_hashes

from plain import plain_kneser_ney


def rows_of(df):
    return [(r["doc_id"], r["text"]) for r in df.collect()]


def words(text):
    return text.encode().split() if text else []


def inputs(request, name, spark):
    if name == "sf":
        return spark.read.parquet(request.getfixturevalue("sf") + "/documents.parquet")
    df = request.getfixturevalue("clash" if name == "clash" else "docs")
    return df.limit(0) if name == "empty" else df


CASES = pytest.mark.parametrize("name", ["docs", "clash", "empty", "sf"])


def components(ids, links):
    up = {i: i for i in ids}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x
    for a, b in links:
        a, b = sorted((top(a), top(b)))
        up[b] = a
    return {i: top(i) for i in ids}


def test_word_hash_splits_as_bytes_split():
    texts = [b"a bb\tccc\n", None, b"", b"  x ", "é à".encode(), b"A" * 40_000, b"a A"]
    h, n = WordHash()(texts)
    assert n.tolist() == [len((t or b"").split()) for t in texts]
    flat = [w for t in texts for w in (t or b"").split()]
    assert len(set(h.tolist())) == len(set(flat))
    folded, _ = WordHash(fold=True)([b"A a", b"A" * 40_000 + b" " + b"a" * 40_000])
    assert folded[0] == folded[1] and folded[2] == folded[3]


@CASES
def test_substring_dedup(request, spark, name):
    df = inputs(request, name, spark)
    source = rows_of(df)
    count = collections.Counter()
    for _, t in source:
        w = words(t)
        count.update(tuple(w[i:i + 35]) for i in range(len(w) - 34))
    want = []
    for i, t in source:
        w = words(t)
        hit = [False] * len(w)
        for k in range(len(w) - 34):
            if count[tuple(w[k:k + 35])] > 1:
                hit[k:k + 35] = [True] * 35
        kept = [x for x, y in zip(w, hit) if not y]
        want.append((i, len(w), len(w) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
    got = [tuple(r) for r in recompress.kept_digest(recompress.dedup_substrings(df)).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_equal_windows_have_equal_anchors():
    rng = np.random.default_rng(3)
    flat = np.concatenate([rng.integers(0, 2, 300), rng.integers(0, 900, 500), np.zeros(90, int), np.tile([1, 2], 60), rng.integers(0, 900, 5)])
    flat = np.concatenate([flat, flat[310:400], flat[100:200]])
    names = span_hashes(flat.astype(np.uint64), 1)
    start = np.arange(len(flat) - 34)
    key, at = recompress.anchors(names, start, 35)
    seen = collections.defaultdict(set)
    for i in start.tolist():
        seen[tuple(flat[i:i + 35])].add((int(key[i]), int(at[i]) - i))
    assert all(len(v) == 1 for v in seen.values())


@CASES
def test_simhash(request, spark, name):
    df = inputs(request, name, spark)
    prints = []
    for i, t in rows_of(df):
        w = (t or "").encode().lower().split()
        h = [xxhash.xxh64_intdigest(b" ".join(w[k:k + 4]), 42) for k in range(max(1, len(w) - 3))] if w else []
        prints.append((i, sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))))
    kinds = sorted({f for _, f in prints})
    group = components(kinds, [(a, b) for a in kinds for b in kinds if a < b and (a ^ b).bit_count() <= 4])
    least = {}
    for i, f in prints:
        if i is not None:
            least[group[f]] = min(i, least.get(group[f], i))
    want = [(i, f"{f:016x}", least.get(group[f])) for i, f in prints]
    got = [tuple(r) for r in simhash.simhash_result(df).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_simhash_dense_group_and_tiles(spark, monkeypatch):
    monkeypatch.setattr(simhash, "TILE", 16)
    rng = np.random.default_rng(5)
    base = [int(x) for x in rng.integers(0, 1 << 62, 6)]
    fps = {b ^ sum(1 << int(k) for k in rng.choice(64, rng.integers(0, 3), replace=False)) for b in base for _ in range(80)}
    fps = sorted({f - (1 << 64) if f >= 1 << 63 else f for f in fps})
    links = simhash.near_links(spark.createDataFrame([(f,) for f in fps], "fp long")).collect()
    mask = (1 << 64) - 1
    assert all(((r.u ^ r.v) & mask).bit_count() <= 4 for r in links)
    want = components(fps, [(a, b) for a in fps for b in fps if a < b and ((a ^ b) & mask).bit_count() <= 4])
    assert components(fps, [(r.u, r.v) for r in links]) == want


ITEM = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


@pytest.mark.parametrize("block", [200_000, 20])
@CASES
def test_decontamination(request, spark, name, block):
    df = inputs(request, name, spark)
    if name == "sf":
        bench = spark.read.parquet(request.getfixturevalue("sf") + "/benchmark.parquet")
        if block == 20:
            pytest.skip("hundreds of blocks: small inputs only")
    else:
        bench = spark.createDataFrame([(1, "QUICK-brown fox"), (2, None), (3, "p5 p6 p7 p8 p9 p10 p11 p12 p13 p14 p15 p16"), (10, "p6 p7 p8 p9 p10 p11 p12 p13 p14 p15"),
                                       (4, ""), (None, "lazy"), (5, "文字"), (3, "one two")], "item_id long, text string")
    windows = collections.defaultdict(set)
    for i, t in rows_of(bench.withColumnRenamed("item_id", "doc_id")):
        w = ITEM.findall((t or "").encode().lower())
        k = min(10, len(w))
        for a in range(len(w) - k + 1 if k else 0):
            windows[tuple(w[a:a + k])].add(i)
    want = []
    for i, t in rows_of(df):
        w = ITEM.findall((t or "").encode().lower())
        hit, ids = [False] * len(w), set()
        for k in {len(x) for x in windows}:
            for a in range(len(w) - k + 1):
                if tuple(w[a:a + k]) in windows:
                    hit[a:a + k] = [True] * k
                    ids |= windows[tuple(w[a:a + k])] - {None}
        want.append((i, len(w), sum(hit), len(ids), hashlib.sha256(",".join(sorted(map(str, ids))).encode()).hexdigest(), any(hit)))
    found = decontam.find_leaks(df, bench, block=block)
    got = [tuple(r) for r in decontam.leak_digest(found).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    for r in found.where("n_hit > 0").collect():
        assert len(ITEM.findall(r["clean_text"].encode().lower())) <= r["n_words"] - r["n_hit"]


def test_decontamination_by_many_blocks(spark, monkeypatch):
    """Twenty blocks, one in memory at a time; a window that very many items share."""
    monkeypatch.setattr(decontam, "ITEMS", 7)
    items = [(i, "all share this") for i in range(90)] + [(1000 + i, " ".join(f"b{i}x{k}" for k in range(14))) for i in range(40)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    entries = decontam.item_windows(bench)
    assert entries.where("k = 3").count() > 5 and entries.agg(F.max(F.size("items"))).first()[0] < 40
    live, most = set(), []
    real = decontam._blocks

    def watched(*a):
        for handle, last in real(*a):
            live.add(handle)
            most.append(sum(len(e[1]) for t in handle.value.values() for es in t.values() for e in es))
            gone = handle.destroy
            handle.destroy = lambda h=handle, g=gone: (live.discard(h), g())
            assert len(live) == 1
            yield handle, last
    monkeypatch.setattr(decontam, "_blocks", watched)
    rows = [(i, f"x all SHARE this b{i}x3 " + " ".join(f"b{i}x{k}" for k in range(2, 13)) + " y") for i in range(0, 40, 3)] + [(77, "b1x1 b1x2"), (78, None)]
    got = {r.doc_id: r for r in decontam.find_leaks(spark.createDataFrame(rows, "doc_id long, text string"), bench, block=13).collect()}
    assert len(most) >= 19 and max(most) < 60 and sum(most) == 90 + 40 * 5
    for i in range(0, 40, 3):
        assert got[i].n_hit == 14 and got[i].items == [*range(90), 1000 + i] and got[i].clean_text.split() == ["x", f"b{i}x3", "y"]
    assert got[77].n_hit == 0 and got[78].n_words == 0 and got[77].clean_text == "b1x1 b1x2"


def test_decontamination_without_items(spark, docs):
    r = decontam.leak_digest(decontam.find_leaks(docs, spark.createDataFrame([], "item_id long, text string"))).collect()
    assert len(r) == docs.count() and not any(x["contaminated"] for x in r)


@pytest.mark.parametrize("order", [2, 3, 4])
@CASES
def test_lm_scores(request, spark, name, order):
    df = inputs(request, name, spark)
    if order == 4 and name != "docs":
        pytest.skip("order 4 is tried on one table")
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(10))
    got = lmscore.score_texts(df, fold != 0, order=order).collect()
    source = rows_of(df)
    c, after, texts = collections.Counter(), collections.defaultdict(collections.Counter), collections.defaultdict(list)
    held = {i: i is not None and zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in source}

    def grams(w):
        w = [None] * (order - 1) + w
        return [tuple(w[j:j + order]) for j in range(len(w) - order + 1)]
    for i, t in source:
        w = (t or "").encode().lower().split() + [None]
        texts[i].append(w)
        if not held[i]:
            c.update(w)
            for g in grams(w):
                for k in range(1, order):
                    after[g[-1 - k:-1]][g[-1]] += 1
    n, v = sum(c.values()), len(c)
    uni = lambda x: (c[x] + 0.1) / (n + 0.1 * (v + 1))
    total = {h: sum(x.values()) for h, x in after.items()}

    def prob(g):
        p = uni(g[-1])
        for k in range(1, order):
            h = g[-1 - k:-1]
            if h in total:
                p = (max(after[h][g[-1]] - 0.75, 0) + 0.75 * len(+after[h]) * p) / total[h]
        return p

    def both(w):
        return len(w), sum(c[x] > 0 for x in w), sum(math.log10(uni(x)) for x in w), sum(math.log10(prob(g)) for g in grams(w))
    want = sorted((str(i), held[i], *both(w)) for i, ws in texts.items() for w in ws)
    got = sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.base_score, r.score, r.train_tokens) for r in got)
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert g[:4] == w[:4] and g[6] == n
        assert g[4] == pytest.approx(w[4], abs=1e-6)
        assert abs(g[5] - w[5]) <= 0.02 * w[2]  # a quantised probability is off by half a step at most


def test_tries_of_every_level_are_kept_in_a_folder(spark, docs, tmp_path):
    from filelake.llm.eftrie import Trie
    train = F.col("doc_id").isNotNull()
    first = lmscore.score_texts(docs, train, order=3, model_dir=str(tmp_path)).collect()
    files = sorted(p.name for p in tmp_path.iterdir())
    assert {f.split("-")[0] for f in files} == {"1", "2"} and all(f.endswith(".trie") for f in files)
    tokens = sum(len((t or "").encode().split()) + 1 for i, t in rows_of(docs) if i is not None)
    for level in "12":  # each training token follows one context of either length
        assert sum(int(Trie.open(str(tmp_path / f)).counts.sum()) for f in files if f[0] == level) == tokens
    assert sorted(map(str, first)) == sorted(map(str, lmscore.score_texts(docs, train, order=3).collect()))
    assert lmscore.mounted("file:/a/b") == lmscore.mounted("file:///a/b") == "/a/b" and lmscore.mounted("s3a://b/c") is None


def test_lm_beats_unigrams_on_held_out_texts(spark, sf):
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(10))
    for order in (2, 3):
        r = lmscore.score_texts(spark.read.parquet(sf + "/documents.parquet"), fold != 0, order=order).where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
        assert r[0] > r[1]


LEARNED = ["one two one two quick brown fox", "one the lazy dog", "one two no id", "the quick brown dog one two", "fox fox fox fox the", "a"]


@pytest.mark.parametrize("order", [2, 3])
def test_kneser_ney_probabilities_sum_to_one(spark, order):
    prob, words = plain_kneser_ney(LEARNED, order)
    for history in ([None, None], ["one", "two"], ["the", "quick"], ["fox", "fox"], ["never", "one"], ["never", "seen"]):
        assert sum(prob(history, w) for w in words) + prob(history, "unheard") == pytest.approx(1.0)
    uni, unseen, high, tri = kneser_ney.fit(spark.createDataFrame([(t,) for t in LEARNED], "text string"), order)
    assert sum(10 ** r.lower for r in uni.collect()) + 10 ** unseen == pytest.approx(1.0)
    back = {r.w: 10 ** r.back for r in uni.collect()}
    after = collections.defaultdict(float)
    for r in high.where("high is not null").collect():
        after[r.v] += r.high
    assert after and all(x + back[v] == pytest.approx(1.0) for v, x in after.items())
    if order == 3:
        deep = {(r.v, r.w): 10 ** r.back for r in high.where("back is not null").collect()}
        sums = collections.defaultdict(float)
        for r in tri.collect():
            sums[r.u, r.v] += r.high
        assert sums.keys() == deep.keys() and all(x + deep[k] == pytest.approx(1.0) for k, x in sums.items())


@pytest.mark.parametrize("order", [2, 3])
@pytest.mark.parametrize("name", ["docs", "clash", "empty"])
def test_quality_scores(request, spark, name, order):
    df = inputs(request, name, spark)
    prob, _ = plain_kneser_ney(LEARNED, order)
    want = []
    for i, t in rows_of(df):
        w = [None, None] + [x.decode() for x in words((t or "").lower())] + [None]
        want.append((str(i), len(w) - 2, sum(math.log10(prob(w[k - 2:k], w[k])) for k in range(2, len(w)))))
    model = kneser_ney.fit(spark.createDataFrame([(t,) for t in LEARNED], "text string"), order)
    got = sorted((str(r.doc_id), r.n_tokens, r.log10_prob) for r in kneser_ney.score(df, model).collect())
    assert len(got) == len(want)
    for g, w in zip(got, sorted(want)):
        assert g[:2] == w[:2] and g[2] == pytest.approx(w[2], rel=1e-4)


def test_quality_sample_is_bounded_and_never_empty(spark, monkeypatch):
    monkeypatch.setattr(kneser_ney, "TRAIN_WORDS", 500)
    monkeypatch.setattr(kneser_ney, "LONG", 300)
    rows = [(i, " ".join(f"word{(i * 7 + k * k) % 60}" for k in range(60))) for i in range(40)]
    rows += [(1000, " ".join(f"word{k % 60}" for k in range(800)))] * 30 + [(None, "x y")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    good = lambda ids: spark.createDataFrame([(i, False) for i in ids], "doc_id long, held boolean")
    size = lambda r: sorted(len(x.text.split()) for x in r.collect())
    assert size(kneser_ney.sample(df, good([*range(40), 1000, 7777]))) == [60] * 9  # the one that reaches the bound is the last
    assert size(kneser_ney.sample(df, good([1000]))) == [800] and size(kneser_ney.sample(df, good([1000, 3]))) == [60, 800]
    assert size(kneser_ney.sample(df, good([7777]))) == []
    monkeypatch.setattr(kneser_ney, "TRAIN_DOCS", 2)
    assert len(size(kneser_ney.sample(df, good([*range(40), *range(2000, 2400)])))) == 2  # ids without a document take no place


@pytest.mark.parametrize("order", [2, 3])
def test_quality_rejects_noise_and_keeps_trusted(spark, order):
    good = [(i, " ".join(f"word{(i * 7 + k * k) % 60}" for k in range(60)), "en") for i in range(120)]
    bad = [(1000 + i, " ".join(f"{k}{i}zz#" for k in range(60)), "en") for i in range(10)]
    more = [(2000, None, "en"), (2001, "word1 word2", None), (2002, good[0][1], "de")]
    df = spark.createDataFrame(good + bad + more, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(120)] + [(1000, 0, 0), (None, 1, 0), (5, None, None)], "doc_id long, quality int, toxic int")
    r = {x.doc_id: x.kept for x in kneser_ney.classify(df, labels, order).collect()}
    assert not any(r[1000 + i] for i in range(10)) and sum(r[i] for i in range(120)) >= 117 and r[2002]
    assert all(x.kept for x in kneser_ney.classify(df, labels.limit(0)).collect())
    assert kneser_ney.classify(df.limit(0), labels).count() == 0


@CASES
def test_token_counts(request, spark, name):
    import public_tokenizers
    from tokenizers import Tokenizer
    path = public_tokenizers.path("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    df = inputs(request, name, spark)
    want = []
    for i, t in rows_of(df):
        n = len(tok.encode(t or "", add_special_tokens=False))
        want.append((i, len((t or "").encode()), n, n > 512))
    assert sorted(map(tuple, tokencount.count_tokens(df, path).collect()), key=str) == sorted(want, key=str)


def test_token_counts_of_awkward_texts(spark, monkeypatch):
    import public_tokenizers
    from tokenizers import Tokenizer
    path = public_tokenizers.path("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    texts = ["a<|endoftext|> b", "x  y   z \n\n q", "don't 'll we've", "a　 b\xa0 c", "!\x1c! \x1c", " x  ", "  ", "1 2  3a", "a " * 5000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.n_tokens for r in tokencount.count_tokens(df, path).collect()}
    assert got == {i: len(tok.encode(t, add_special_tokens=False)) for i, t in enumerate(texts)}
    for t in texts:
        parts = list(tokencount.pieces(t, 7))
        assert "".join(parts) == t
        assert sum(len(tok.encode(p, add_special_tokens=False)) for p in parts) == len(tok.encode(t, add_special_tokens=False))


@pytest.mark.parametrize("sizes, k", [([1, 2, 3, 10, 11, 12, 50], 3), ([5], 4), ([], 2), ([1, 9, 9, 9, 10, 40], 2)])
def test_bounds_are_optimal(sizes, k):
    import itertools
    hist = dict(collections.Counter(sizes))
    pad = lambda bounds: sum(min(b for b in bounds if b >= s) - s for s in sizes)
    got = packing.best_bounds(hist, k)
    if not sizes:
        assert got == []
        return
    best = min(pad(c) for r in range(1, k + 1) for c in itertools.combinations(sorted(hist), r) if c[-1] == max(sizes))
    assert len(got) <= k and pad(got) == best


@CASES
def test_packing(request, spark, name):
    df = inputs(request, name, spark)
    got = packing.pack(df, max_len=512, buckets=4, budget=2048).collect()
    total = collections.Counter()
    for i, t in rows_of(df):
        total[i] += len(words(t))
    sums = collections.Counter()
    batches = collections.defaultdict(list)
    for r in got:
        sums[r.doc_id] += r.n_tokens
        if r.n_tokens:
            assert r.n_tokens <= r.bucket_len and r.padding == r.bucket_len - r.n_tokens
            batches[r.batch_id].append(r)
        else:
            assert r.bucket_len is None and r.batch_id is None
    assert {k: v for k, v in sums.items()} == dict(total)
    for rows in batches.values():
        size = rows[0].bucket_len
        assert len({r.bucket_len for r in rows}) == 1 and size * len(rows) <= max(2048, size)
        assert sorted(r.slot for r in rows) == list(range(len(rows)))
    # all batches of a bucket but its last are full
    full = collections.Counter()
    for rows in batches.values():
        full[rows[0].bucket_len] += len(rows) < max(1, 2048 // rows[0].bucket_len)
    assert all(v <= 1 for v in full.values())
