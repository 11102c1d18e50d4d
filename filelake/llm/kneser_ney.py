"""Quality classifier: perplexity under a modified Kneser-Ney n-gram model.

The model (order two or three) is trained on trusted text: labelled documents
of high quality that are not toxic, at most ``TRAIN_DOCS`` of them (the smallest by
hash) and about ``TRAIN_WORDS`` words, both documented bounds of the sample.  A fifth
of the trusted documents is held out of it and calibrates the thresholds.

Counts, continuation counts and the discounts D1, D2, D3+ of each level come
from Spark aggregations.  The unigram level, bounded by the sample's words, is
broadcast, and so is a Bloom filter of its bigrams.  Every document of the corpus
is then tokenised once: its unigram and back-off terms are summed at once, and
the tokens whose bigram, or whose context, passes the filter go to the shard that
owns their counts, many to one binary value, grouped by block of texts.  Each
shard joins them with its counts and returns one correction per text.  At order
three a token belongs to the shard of the word before it, which has that word's
bigrams, its trigrams, and the back-off weights of the contexts that end with it.

A document is rejected when its log-perplexity per token, shrunk to its
language's mean by ``PRIOR_TOKENS`` tokens so that short texts are not judged
by a word or two, exceeds the ``QUANTILE`` of the held-out trusted documents of
its language, plus ``MARGIN``.

Defined results: a null or empty text has its end token alone; a language
without held-out documents (null too) takes the threshold of all languages;
without any trusted document all are kept.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from filelake.llm.common import WordHash, by_value, chunks, mix, scramble, small_batches, store, text_key
from filelake.llm.lmscore import END, _pack, _unpack

by_value(__name__)

TRAIN_DOCS = 8000
TRAIN_WORDS = 3_000_000
ORDER = 2            # 3 is also known
LONG = 20_000        # words; longer texts come last into the sample
QUANTILE = 0.99
MARGIN = 0.05        # in powers of ten per token
PRIOR_TOKENS = 30
SHARDS = 24
PART_BLOCKS = 64
BLOOM_BITS = 25
BLOOM_HASHES = 4
BLOCK_BYTES = 8_000_000
CHUNK_BYTES = 2_000_000
ACCURACY = 10_000    # of the quantile sketch


def trusted(labels: DataFrame) -> DataFrame:
    """doc_id, held: trusted documents and whether they calibrate."""
    good = (labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
            .agg(F.min(((F.col("quality") == 1) & (F.coalesce(F.col("toxic"), F.lit(0)) == 0)).cast("int")).alias("ok"))
            .where("ok = 1"))
    return good.select("doc_id", (F.pmod(F.xxhash64("doc_id"), F.lit(5)) == 0).alias("held"))


def _tokens(texts, hashes):
    """Tokens (with an end token after each text), their contexts, lengths."""
    words, lens = hashes(texts)
    lens = lens + 1
    ends = np.cumsum(lens) - 1
    tok = np.empty(len(words) + len(lens), np.uint64)
    is_end = np.zeros(len(tok), bool)
    is_end[ends] = True
    tok[is_end], tok[~is_end] = END, words
    return tok, np.concatenate([np.array([END], np.uint64), tok[:-1]]), lens


def _before(ctx, lens):
    """The word before each token's context; end tokens before a text's first word."""
    u = np.concatenate([np.array([END], np.uint64), ctx[:-1]])
    u[np.cumsum(lens) - lens] = END
    return u


def ngram_counts(texts: DataFrame, order: int) -> DataFrame:
    """u (order 3 only), v, w (names of contexts and word), c."""
    names = ["u", "v", "w"][3 - order:]

    def run(batches):
        hashes = WordHash(fold=True)
        for batch in batches:
            t = batch.column("_t").to_pylist()
            for a, b in chunks(batch, [len(x) if x else 0 for x in t], CHUNK_BYTES):
                tok, ctx, lens = _tokens(t[a:b], hashes)
                cols = [_before(ctx, lens), ctx, tok][3 - order:]
                by = np.lexsort(cols[::-1])
                cols = [c[by] for c in cols]
                first = np.flatnonzero(np.concatenate([[True], np.any([c[1:] != c[:-1] for c in cols], axis=0)]))
                yield pa.RecordBatch.from_arrays([*(pa.array(c[first].view(np.int64)) for c in cols), pa.array(np.diff(np.append(first, len(tok))))],
                                                 names=[*names, "c"])

    kinds = ", ".join(f"{n} long" for n in [*names, "c"])
    rows = small_batches(texts).select(F.col("text").cast("binary").alias("_t")).mapInArrow(run, kinds)
    return rows.groupBy(*names).agg(F.sum("c").alias("c"))


def discounts(counts: DataFrame, column: str) -> list[float]:
    """D1, D2, D3+ of the modified Kneser-Ney estimate from counts of counts."""
    c = F.col(column)
    r = counts.agg(*[F.sum((c == k).cast("long")).alias(f"n{k}") for k in (1, 2, 3, 4)]).first()
    n1, n2, n3, n4 = (r[f"n{k}"] or 0 for k in (1, 2, 3, 4))
    if not (n1 and n2 and n3):
        return [0.5, 0.75, 0.9]  # too little text for the estimate
    y = n1 / (n1 + 2 * n2)
    d = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3]
    return [min(max(x, 0.05), k - 0.05) for k, x in zip((1, 2, 3), d)]


def _discount(c, d):
    return F.when(c == 1, d[0]).when(c == 2, d[1]).otherwise(d[2])


def _level(counts: DataFrame, context: list[str]):
    """(counts with high, the discounted share of each n-gram in its context;
    per context back, the log10 of the weight left for the level below)."""
    d = discounts(counts, "c")
    ctx = counts.groupBy(*context).agg(F.sum("c").alias("total"), F.sum(_discount(F.col("c"), d)).alias("taken"))
    ctx = store(ctx.select(*context, "total", F.log10(F.col("taken") / F.col("total")).alias("back")), "contexts")
    high = counts.join(ctx, context).select(*context, "w", ((F.col("c") - _discount(F.col("c"), d)) / F.col("total")).alias("high"))
    return high, ctx.select(*context, "back")


def fit(texts: DataFrame, order: int = ORDER):
    """(unigrams: w, lower (log10 of the continuation probability), back (log10
    of the back-off weight as a context); log10 of an unseen word's share;
    bigrams: v, w, high, back (null at order 2, and for those that are no
    context); trigrams: u, v, w, high, or None).

    Below the highest level an n-gram counts the different words before it; one
    that begins a text has none and keeps its own count."""
    if order not in (2, 3):
        raise ValueError("order 2 or 3")
    top = store(ngram_counts(texts, order), "ngrams")
    trigrams, deep = (None, None) if order == 2 else _level(top, ["u", "v"])
    if order == 3:
        start = F.col("v") == int(np.uint64(END).view(np.int64))
        bigrams = store(top.groupBy("v", "w").agg(F.when(start, F.sum("c")).otherwise(F.count(F.lit(1))).alias("c")), "bigrams")
        trigrams = store(trigrams, "trigrams")
    else:
        bigrams = top
    high, ctx = _level(bigrams, ["v"])
    after = bigrams.groupBy("w").agg(F.count(F.lit(1)).alias("before"))
    words = store(after.join(ctx.withColumnRenamed("v", "w"), "w", "full"), "words")
    d1 = discounts(words.where("before is not null"), "before")
    s = words.agg(F.sum("before").alias("types"), F.count("before").alias("v"), F.sum(_discount(F.col("before"), d1)).alias("taken")).first()
    types, v = s["types"] or 0, s["v"] or 0
    unseen = ((s["taken"] or 0.0) / types if types else 1.0) / (v + 1)  # the share of each word, seen or not
    lower = F.when(F.col("before").isNull(), F.lit(unseen)).otherwise((F.col("before") - _discount(F.col("before"), d1)) / F.lit(float(types or 1)) + unseen)
    unigrams = store(words.select("w", F.log10(lower).alias("lower"), F.coalesce("back", F.lit(0.0)).alias("back")), "unigrams")
    if deep is None:
        high = high.withColumn("back", F.lit(None).cast("double"))
    else:  # every context of the highest level is a bigram, but that of a text's first word
        high = high.join(deep.select(F.col("u").alias("v"), F.col("v").alias("w"), "back"), ["v", "w"], "full")
    return unigrams, float(np.log10(unseen)), store(high, "high"), trigrams


def _places(key, bits, hashes):
    """Bit positions of keys in the Bloom filter."""
    a, b = scramble(key), scramble(key ^ np.uint64(0xA5A5A5A5A5A5A5A5)) | np.uint64(1)
    return [((a + np.uint64(i) * b) >> np.uint64(64 - bits)).astype(np.int64) for i in range(hashes)]


def score(docs: DataFrame, model, extra: str = "lang") -> DataFrame:
    """doc_id, tk, ``extra``, n_tokens, log10_prob; one row per row of ``docs``."""
    unigrams, unseen, high, trigrams = model
    deep = trigrams is not None
    spark = docs.sparkSession
    # the sample is bounded by TRAIN_WORDS, so are its words and bigrams
    uni = unigrams.select("w", F.col("lower").cast("float"), F.col("back").cast("float")).toArrow()
    names, low, off = (uni.column(c).to_numpy() for c in ("w", "lower", "back"))
    by = np.argsort(names)
    names, low, off = names[by], low[by], off[by]
    counts = store(_keyed(high, trigrams), "counts")
    keys = counts.where("kind < 2").select("key").distinct().toArrow().column("key")
    flags = np.zeros(1 << BLOOM_BITS, bool)
    for part in keys.chunks:
        for place in _places(part.to_numpy().view(np.uint64), BLOOM_BITS, BLOOM_HASHES):
            flags[place] = True
    given = spark.sparkContext.broadcast((names, low, off, np.packbits(flags)))
    del uni, keys, flags

    def first(batches):
        from pyspark import TaskContext
        names, lower, back, bloom = given.value
        flags = np.unpackbits(bloom).view(bool)
        hashes, number = WordHash(fold=True), TaskContext.get().partitionId() << 24
        held, size = [], 0

        def emit():
            nonlocal number
            number += 1
            ids, tks, langs = ([x for h in held for x in h[k]] for k in (0, 1, 2))
            n, base = (np.concatenate([h[k] for h in held]) for k in (3, 4))
            start = np.cumsum([0] + [len(h[0]) for h in held])
            doc = np.concatenate([h[5] + s for h, s in zip(held, start)]).astype(np.uint32)
            pair, context, owner, miss = (np.concatenate([h[k] for h in held]) for k in (6, 7, 8, 9))
            none = pa.array([None] * SHARDS, pa.list_(pa.int64()))
            blobs = []
            shard = (owner % np.uint64(SHARDS)).astype(np.int64)
            for s in range(SHARDS):
                own = np.flatnonzero(shard == s)  # in the order of the documents
                gap = np.diff(doc[own], prepend=np.uint32(0)).astype(np.uint32)
                blobs.append(_pack(gap, pair[own], context[own] if deep else context[:0], miss[own], np.array([len(ids)], np.int64)))
            return pa.RecordBatch.from_arrays([
                pa.array([number] * (SHARDS + 1), pa.int64()), pa.array([*range(SHARDS), -1], pa.int32()),
                pa.array([*blobs, _pack(n.astype(np.int64), base)], pa.binary()),
                pa.concat_arrays([none, pa.array([ids], pa.list_(pa.int64()))]),
                pa.array([None] * SHARDS + [tks], pa.list_(pa.binary())), pa.array([None] * SHARDS + [langs], pa.list_(pa.string()))],
                names=["block", "shard", "data", "ids", "tks", "langs"])

        for batch in batches:
            texts = batch.column("_t").to_pylist()
            cols = [batch.column(c).to_pylist() for c in ("doc_id", "tk", "x")]
            for a, b in chunks(batch, [len(t) if t else 0 for t in texts], CHUNK_BYTES):
                tok, ctx, lens = _tokens(texts[a:b], hashes)
                kinds, which = np.unique(tok, return_inverse=True)
                at = np.searchsorted(names, kinds.view(np.int64))
                at = np.minimum(at, max(len(names) - 1, 0))
                known = (names[at] == kinds.view(np.int64)) if len(names) else np.zeros(len(kinds), bool)
                low = np.where(known, lower[at], unseen).astype(np.float64) if len(names) else np.full(len(kinds), unseen)
                off = np.where(known, back[at], 0.0).astype(np.float64) if len(names) else np.zeros(len(kinds))
                end = int(np.searchsorted(kinds, np.uint64(END)))
                prev = np.concatenate([[end], which[:-1]])
                miss = low[which] + off[prev]
                begin = np.cumsum(lens) - lens
                key = mix(ctx, tok)
                pass_ = known[which] & known[prev]
                cand = np.flatnonzero(pass_)
                for place in _places(key[cand], BLOOM_BITS, BLOOM_HASHES):
                    pass_[cand] &= flags[place]
                ask, own = pass_, key
                if deep:  # the bigram before is the context; before a text's first word it is two end tokens
                    over = np.concatenate([[True], pass_[:-1]])
                    above = np.concatenate([key[:1], key[:-1]])
                    over[begin], above[begin] = True, mix(np.array([END], np.uint64), np.array([END], np.uint64))[0]
                    ask, own = pass_ | over, ctx
                    above[~over] = 0
                hit = np.flatnonzero(ask)
                doc = np.repeat(np.arange(len(lens)), lens)[hit]
                held.append((cols[0][a:b], cols[1][a:b], cols[2][a:b], lens, np.add.reduceat(miss, begin), doc, np.where(pass_, key, 0)[hit].astype(np.uint64),
                             above[hit] if deep else key[:0], own[hit], miss[hit].astype(np.float32)))
                size += 6 * len(tok)
                if size >= BLOCK_BYTES:
                    yield emit()
                    held, size = [], 0
        if held:
            yield emit()

    rows = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), text_key(F.col("text")).alias("tk"),
                       F.col(extra).cast("string").alias("x"), F.col("text").cast("binary").alias("_t"))
    # a shard meets at most about PART_BLOCKS blocks at a time; its counts are bounded by the sample
    size = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    parts = max(1, -(-size // (PART_BLOCKS * BLOCK_BYTES)))
    asked = (rows.mapInArrow(first, "block long, shard int, data binary, ids array<long>, tks array<binary>, langs array<string>")
             .withColumn("part", F.pmod(F.xxhash64("block"), F.lit(parts)).cast("int")))

    def join(left, right):
        """A shard's counts meet what the blocks ask of it; the blocks' own
        sums (shard -1) pass through."""
        if not left.num_rows or left.column("shard")[0].as_py() < 0:
            return left.select(["block", "shard", "data", "ids", "tks", "langs"])
        key, kind, value = (right.column(c).to_numpy() for c in ("key", "kind", "value"))
        tables = []
        for k in range(3):  # shares of bigrams, weights of contexts, shares of trigrams
            at = np.flatnonzero(kind == k)
            at = at[np.argsort(key[at].view(np.uint64), kind="stable")]
            tables.append((key[at].view(np.uint64), value[at]))

        def look(k, ask, default):
            names, values = tables[k]
            if not len(names):
                return np.full(len(ask), default)
            at = np.minimum(np.searchsorted(names, ask), len(names) - 1)
            return np.where(names[at] == ask, values[at], default)

        out = []
        for data in left.column("data"):
            gap, pair, context, miss, n = _unpack(data.as_buffer(), np.uint32, np.uint64, np.uint64, np.float32, np.int64)
            doc = np.cumsum(gap.astype(np.int64))
            p = look(0, pair, 0.0) + 10.0 ** miss.astype(np.float64)
            if deep:
                p = look(2, mix(context, pair), 0.0) + 10.0 ** look(1, context, 0.0) * p
            out.append(_pack(np.bincount(doc, weights=np.log10(p) - miss, minlength=int(n[0])).astype(np.float32)))
        return left.select(["block", "shard", "data", "ids", "tks", "langs"]).set_column(2, "data", pa.array(out, pa.binary()))

    def last(key, table):
        t = table.combine_chunks()
        own = t.column("shard").to_pylist().index(-1)
        n, total = _unpack(t.column("data")[own].as_buffer(), np.int64, np.float64)
        total = total.copy()
        for shard, d in zip(t.column("shard").to_pylist(), t.column("data")):
            if shard >= 0:
                total += _unpack(d.as_buffer(), np.float32)[0]
        flat = [t.column(c).slice(own, 1).combine_chunks().flatten() for c in ("ids", "tks", "langs")]
        return pa.table([*flat, pa.array(n), pa.array(total)], names=["doc_id", "tk", extra, "n_tokens", "log10_prob"])

    counts = counts.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    gains = (asked.groupBy("shard", "part").cogroup(counts.groupBy("shard", "part"))
             .applyInArrow(join, "block long, shard int, data binary, ids array<long>, tks array<binary>, langs array<string>"))
    return gains.groupBy("block").applyInArrow(last, f"doc_id long, tk binary, {extra} string, n_tokens long, log10_prob double")


def _keyed(high: DataFrame, trigrams: DataFrame | None) -> DataFrame:
    """key, kind (0: a bigram, 1: a context of two words, 2: a trigram), shard,
    value (share, log10 of the weight, share)."""
    deep = trigrams is not None

    def run(batches):
        for b in batches:
            v, w = (b.column(c).to_numpy().view(np.uint64) for c in ("v", "w"))
            key = mix(v, w)
            if "u" in b.schema.names:
                u = b.column("u").to_numpy().view(np.uint64)
                parts = [(mix(mix(u, v), key), 2, v, b.column("high"))]
            else:
                parts = [(key, 0, v if deep else key, b.column("high")), (key, 1, w, b.column("back"))]
            for name, kind, owner, value in parts:
                some = np.flatnonzero(np.asarray(value.is_valid()))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(name[some].view(np.int64)), pa.array(np.full(len(some), kind, np.int32)),
                     pa.array((owner[some] % np.uint64(SHARDS)).astype(np.int32)), value.take(pa.array(some))], names=["key", "kind", "shard", "value"])

    kinds = "key long, kind int, shard int, value double"
    rows = high.mapInArrow(run, kinds)
    return rows.unionByName(trigrams.mapInArrow(run, kinds)) if deep else rows


def sample(docs: DataFrame, good: DataFrame) -> DataFrame:
    """The bounded training sample: texts of trusted documents not held out.

    Of the trusted ids that have a document, the ``TRAIN_DOCS`` smallest by hash; of
    their different texts at most ``TRAIN_DOCS``, short ones (up to ``LONG`` words) before
    long ones and then by hash, until ``TRAIN_WORDS`` words are reached.  The text
    that reaches the bound is the last and is taken whole, so a sample is never
    empty while there is a trusted text."""
    number = F.col("doc_id").cast("long").alias("doc_id")
    there = docs.select(number).where("doc_id is not null").distinct()
    ids = good.where("not held").select("doc_id").join(there, "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRAIN_DOCS)
    few = F.broadcast(store(ids, "sample"))  # at most TRAIN_DOCS rows
    size = F.size(F.split(F.trim("text"), r"\s+"))
    own = docs.select(number, text_key(F.col("text")).alias("tk"), "text").where("text is not null").join(few, "doc_id", "left_semi")
    # rows that share id and text are one; at most TRAIN_DOCS rows of numbers go into the window
    narrow = own.select("doc_id", "tk", size.alias("n")).groupBy("doc_id", "tk").agg(F.first("n").alias("n"))
    order = [F.col("n") > LONG, F.xxhash64("doc_id"), F.col("doc_id"), F.col("tk")]
    running = F.sum("n").over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    pick = store(narrow.orderBy(*order).limit(TRAIN_DOCS).withColumn("r", F.coalesce(running, F.lit(0)))
                 .where(F.col("r") < TRAIN_WORDS).select("doc_id", "tk"), "picked")
    return own.join(F.broadcast(pick), ["doc_id", "tk"], "left_semi").dropDuplicates(["doc_id", "tk"]).select("text")


def classify(docs: DataFrame, labels: DataFrame, order: int = ORDER) -> DataFrame:
    """doc_id, tk, lang, n_tokens, log10_perplexity, threshold, kept."""
    good = store(trusted(labels), "trusted")
    scored = store(score(docs, fit(store(sample(docs, good), "texts"), order)), "scored")
    held = good.where("held").select("doc_id")
    calm = store(scored.join(held, "doc_id", "left_semi").select("lang", "n_tokens", "log10_prob"), "held")
    mean = (-F.sum("log10_prob") / F.sum("n_tokens")).alias("mean")
    overall = calm.agg(mean).first()["mean"]
    if overall is None:  # nothing to calibrate by
        return scored.select("doc_id", "tk", "lang", "n_tokens", (-F.col("log10_prob") / F.col("n_tokens")).alias("log10_perplexity"),
                             F.lit(None).cast("double").alias("threshold"), F.lit(True).alias("kept"))
    # one row per language; languages are few but not bounded, so the joins are left to the planner
    means = store(calm.groupBy("lang").agg(mean), "means")

    def shrunk(df):
        m = F.coalesce(F.col("mean"), F.lit(overall))
        return (df.join(means, "lang", "left")
                .withColumn("log10_perplexity", (-F.col("log10_prob") + PRIOR_TOKENS * m) / (F.col("n_tokens") + PRIOR_TOKENS)).drop("mean"))

    top = F.percentile_approx("log10_perplexity", QUANTILE, ACCURACY) + MARGIN
    calm = store(shrunk(calm), "calm")
    limits = store(calm.groupBy("lang").agg(top.alias("threshold")), "limits")
    rest = calm.agg(top.alias("t")).first()["t"]
    judged = shrunk(scored).join(limits, "lang", "left").withColumn("threshold", F.coalesce("threshold", F.lit(rest)))
    return judged.select("doc_id", "tk", "lang", "n_tokens", "log10_perplexity", "threshold",
                         (F.col("log10_perplexity") <= F.col("threshold")).alias("kept"))
