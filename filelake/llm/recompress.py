"""Substring dedup by recompression.

A text is a sequence of word symbols.  Each round names, the same way
everywhere, either every run of one symbol or every pair (x, y) with x in the
round's left class and y in its right class.  A name is a 64-bit hash of what
it stands for, so all tasks agree on it without a shared table; the class of a
symbol is a bit of its hash and of the round.  Whether a symbol inside a window
is merged depends on its neighbours alone, so all copies of a window agree on
every symbol but those at its two ends.

Those ends are dropped round by round by what the window itself shows: after a
run round the first and last symbol; after a pair round the first if it is of
the right class and the last if it is of the left class.  The *anchor* of a
window is the longest symbol among those that remain in its rounds (by hash,
then leftmost, between equals).  Equal windows therefore have anchors of the same name at the same offset, and a
window whose anchor name occurs once is unique.  Consecutive windows share an
anchor, so the text shrinks to a few ranges of windows, each carrying the
anchor's name and a hash of the words the range covers.

Spark then counts anchor names (map-side sums), keeps ranges of shared names,
groups them into classes of equal words and verifies: all windows of a class
with two members repeat; where one name has several classes, one member per
class is expanded to its windows and these are compared by 128 bits (anchor
name and words).  Copies are never paired with one another.

Defined results: null text has no words; a text shorter than the window loses
nothing; rows sharing a doc_id are told apart by their texts.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filelake.llm.common import WordHash, by_value, chunks, mix, scramble, small_batches, span_hashes, store, text_key

by_value(__name__)

WINDOW = 35
ROUNDS = 5        # runs once, then pairs four times
RUN_ROUNDS = (0,)
LONG = 5          # symbols of more words count as equally long
CHUNK_BYTES = 1_000_000


def _round(names, r):
    """Names after round ``r``, the head index of each, and for every old
    symbol the index of its new one."""
    n = len(names)
    head = np.ones(n, bool)
    if r in RUN_ROUNDS:
        head[1:] = names[1:] != names[:-1]
        first = np.flatnonzero(head)
        size = np.diff(np.append(first, n))
        new = names[first]
        long = size > 1
        new[long] = mix(new[long], size[long].astype(np.uint64), 1000 + r)
        return new, first, np.cumsum(head, dtype=np.int32) - np.int32(1), None
    right = (scramble(names + np.uint64(0x5851F42D4C957F2D * (r + 1) & 0xFFFFFFFFFFFFFFFF)) >> np.uint64(17)) & np.uint64(1) == 1
    tail = np.zeros(n, bool)
    tail[1:] = right[1:] & ~right[:-1]
    first = np.flatnonzero(~tail)
    new = names[first]
    nxt = np.minimum(first + 1, n - 1)
    pair = tail[nxt] & (nxt > first)
    new[pair] = mix(names[first[pair]], names[nxt[pair]], 2000 + r)
    return new, first, np.cumsum(~tail, dtype=np.int32) - np.int32(1), right


def anchors(words: np.ndarray, starts: np.ndarray, window: int):
    """For windows at ``starts`` (positions in ``words``): anchor name and the
    position of the anchor's first word."""
    m = len(starts)
    key, at = np.zeros(m, np.uint64), np.zeros(m, np.int64)
    names, pos = words, np.arange(len(words) + 1, dtype=np.int32)
    live = np.arange(m)
    lo = starts.astype(np.int32)
    hi = lo + np.int32(window - 1)
    for r in range(ROUNDS + 1):
        if r < ROUNDS:
            new, first, to, right = _round(names, r)
            if right is None:
                a, b = to[lo] + 1, to[hi] - 1
            else:
                a, b = to[lo] + right[lo], to[hi] - ~right[hi]
            over = a > b
            done = np.flatnonzero(over)
        else:
            done = np.arange(len(live))
        if len(done):
            size = np.diff(pos).astype(np.uint64)
            score = (np.minimum(size, np.uint64(LONG)) << np.uint64(44)) | (scramble(names) >> np.uint64(20))
            i = _first_max(score, lo[done], hi[done])
            key[live[done]], at[live[done]] = mix(names[i], size[i], r), pos[i]
        if len(done) == len(live):
            break
        if len(done):
            keep = ~over
            live, a, b = live[keep], a[keep], b[keep]
        lo, hi, names, pos = a, b, new, np.append(pos[first], pos[-1])
    return key, at


def _first_max(score: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Index of the first largest score in each [lo, hi]: blocks of 2^k symbols
    know theirs, and two blocks cover a range."""
    out = np.empty(len(lo), np.int64)
    level = np.frexp((hi - lo + 1).astype(np.float64))[1] - 1
    table, k = np.arange(len(score)), 0
    while True:
        which = np.flatnonzero(level == k)
        if len(which):
            x, y = table[lo[which]], table[hi[which] - (1 << k) + 1]
            out[which] = np.where(score[y] > score[x], y, x)
        k += 1
        if k > level.max():
            return out
        x, y = table[: len(table) - (1 << k - 1)], table[1 << k - 1:]
        table = np.where(score[y] > score[x], y, x)


def _window_starts(lens, window):
    """Positions (in the joined words) of every window inside one text."""
    off = np.concatenate([[0], np.cumsum(lens)])
    n = np.maximum(np.asarray(lens) - window + 1, 0)
    doc = np.repeat(np.arange(len(lens)), n)
    rel = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return doc, rel, off[doc] + rel


def _ranges(batch: pa.RecordBatch, memo: WordHash, window: int):
    texts = batch.column("_t").to_pylist()
    for a, b in chunks(batch, [len(t) if t else 0 for t in texts], CHUNK_BYTES):
        words, lens = memo(texts[a:b])
        doc, rel, start = _window_starts(lens, window)
        if not len(start):
            continue
        key, at = anchors(words, start, window)
        cut = np.ones(len(start), bool)
        cut[1:] = (doc[1:] != doc[:-1]) | (at[1:] != at[:-1]) | (key[1:] != key[:-1])
        first = np.flatnonzero(cut)
        cnt = np.diff(np.append(first, len(start)))
        length = cnt + (window - 1)
        p0 = start[first]
        rh = np.zeros(len(first), np.uint64)
        for n in np.unique(length):  # at most ``window`` different lengths
            which = np.flatnonzero(length == n)
            rh[which] = _hash_at(words, p0[which], int(n))
        yield (doc[first] + a, key.view(np.int64)[first], rh.view(np.int64), rel[first], cnt)


def _hash_at(words, at, n):
    """Hash of words[i : i + n] at the given positions only."""
    grid = words[at[:, None] + np.arange(n)]
    h = scramble(grid)
    size = 1
    while size * 2 <= n:
        h = mix(h[:, :-size], h[:, size:], size)
        size *= 2
    return mix(h[:, 0], h[:, n - size], n)


def window_ranges(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, tk, key, words, w0, cnt: ``cnt`` consecutive windows from word
    ``w0`` on whose anchor is named ``key``; ``words`` hashes their words.
    All windows of a range contain one anchor, so ``cnt`` <= ``window``."""
    schema = "doc_id long, tk binary, key long, words long, w0 int, cnt int"

    def run(batches):
        memo = WordHash()
        for batch in batches:
            for row, key, words, w0, cnt in _ranges(batch, memo, window):
                yield pa.RecordBatch.from_arrays([
                    batch.column("doc_id").take(pa.array(row)), batch.column("tk").take(pa.array(row)),
                    pa.array(key), pa.array(words), pa.array(w0.astype(np.int32)), pa.array(cnt.astype(np.int32))],
                    names=["doc_id", "tk", "key", "words", "w0", "cnt"])

    return _binary(docs).mapInArrow(run, schema)


def _binary(docs: DataFrame, *more: str) -> DataFrame:
    return small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), text_key(F.col("text")).alias("tk"),
                       F.col("text").cast("binary").alias("_t"), *more)


def _expand(docs: DataFrame, reps: DataFrame, window: int) -> DataFrame:
    """One row per window of the given ranges: key, words, j (its place in the
    range), wh (hash of its words), n (members of the range's class)."""
    wanted = reps.groupBy("doc_id", "tk").agg(
        F.collect_list(F.struct("key", "words", "w0", "cnt", "n")).alias("r"))
    t = _binary(docs).alias("d").join(
        wanted.alias("w"), F.col("d.doc_id").eqNullSafe(F.col("w.doc_id")) & F.col("d.tk").eqNullSafe(F.col("w.tk"))
    ).select("_t", "r")

    def run(batches):
        memo = WordHash()
        for batch in batches:
            rs = batch.column("r")
            for i, t in enumerate(batch.column("_t")):
                words, _ = memo([t.as_py()])
                r = rs[i].values
                w0 = r.field("w0").to_numpy(zero_copy_only=False).astype(np.int64)
                cnt = r.field("cnt").to_numpy(zero_copy_only=False).astype(np.int64)
                at = np.repeat(np.arange(len(w0)), cnt)
                j = np.arange(len(at)) - np.repeat(np.cumsum(cnt) - cnt, cnt)
                start, wh = w0[at] + j, span_hashes(words, window)
                ix = pa.array(at)
                yield pa.RecordBatch.from_arrays(
                    [r.field("key").take(ix), r.field("words").take(ix), pa.array(j.astype(np.int32)),
                     pa.array(wh[start].view(np.int64)), r.field("n").take(ix)], names=["key", "words", "j", "wh", "n"])

    return t.mapInArrow(run, "key long, words long, j int, wh long, n long")


def repeated_windows(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, tk, spans: array of (w0, mask) for each document with repeated
    windows; bit j of mask says that the window from word w0 + j on repeats."""
    ranges = store(window_ranges(docs, window), "ranges")
    shared = store(ranges.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("key"), "shared")
    kept = store(ranges.join(shared, "key", "left_semi"), "kept")
    classes = store(kept.groupBy("key", "words").agg(
        F.count(F.lit(1)).alias("n"), F.max("cnt").alias("cnt"),
        F.min(F.struct("doc_id", "tk", "w0")).alias("rep")), "classes")
    many = store(classes.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("key"), "many")
    mixed = classes.join(many, "key", "left_semi")
    reps = mixed.select("key", "words", "n", "cnt", "rep.doc_id", "rep.tk", "rep.w0")
    # Repeated rows of one text would expand a range twice; distinct undoes it.
    windows = store(_expand(docs, reps, window).distinct(), "windows")
    again = store(windows.groupBy("key", "wh").agg(F.sum("n").alias("s")).where("s > 1").select("key", "wh"), "again")
    of_mixed = (windows.join(again, ["key", "wh"], "left_semi").groupBy("key", "words")
                .agg(F.bit_or(F.expr("shiftleft(1L, j)")).alias("mask")))
    full = F.expr("shiftrightunsigned(-1L, 64 - cnt)")
    of_single = classes.join(many, "key", "left_anti").where("n > 1").select("key", "words", full.alias("mask"))
    masks = store(of_mixed.unionByName(of_single), "masks")
    return (kept.join(masks, ["key", "words"]).groupBy("doc_id", "tk")
            .agg(F.collect_set(F.struct("w0", "mask")).alias("spans")))


def dedup_substrings(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """Every document with the words of repeated windows taken out.

    Columns: those of ``docs`` (but any named like a new one), then n_words, n_removed, kept_words (binary,
    the kept words joined by one space) and kept_text (the text itself where
    nothing was removed, else the kept words).
    """
    taken = store(repeated_windows(docs, window), "spans")
    docs = docs.drop("n_words", "n_removed", "kept_words", "kept_text", "_tk", "_spans")
    d = docs.withColumn("_tk", text_key(F.col("text"))).alias("d")
    both = d.join(taken.alias("s"), F.col("d.doc_id").cast("long").eqNullSafe(F.col("s.doc_id"))
                  & F.col("d._tk").eqNullSafe(F.col("s.tk")), "left")
    rows = both.select("d.*", F.col("s.spans").alias("_spans"))
    names = docs.columns

    def run(batches):
        for batch in batches:
            n_words, n_removed, kept, text = [], [], [], []
            spans = batch.column("_spans")
            for i, t in enumerate(batch.column("text")):
                t = t.as_py()
                toks = t.encode().split() if t else []
                n_words.append(len(toks))
                if spans[i].is_valid:
                    hit = np.zeros(len(toks) + 1, np.int64)
                    for s in spans[i].as_py():
                        for j in range(64):
                            if s["mask"] >> j & 1:
                                hit[s["w0"] + j] += 1
                                hit[s["w0"] + j + window] -= 1
                    keep = np.cumsum(hit)[:-1] == 0
                    left = [w for w, k in zip(toks, keep) if k]
                    n_removed.append(len(toks) - len(left))
                    kept.append(b" ".join(left))
                    text.append(kept[-1].decode() if len(left) < len(toks) else t)
                else:
                    n_removed.append(0)
                    kept.append(b" ".join(toks))
                    text.append(t)
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in names] + [pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()),
                 pa.array(kept, pa.binary()), pa.array(text, pa.string())],
                names=[*names, "n_words", "n_removed", "kept_words", "kept_text"])

    return rows.drop("_tk").mapInArrow(
        run, _ddl(docs) + ", n_words long, n_removed long, kept_words binary, kept_text string")


def _ddl(docs: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)


def kept_digest(result: DataFrame) -> DataFrame:
    return result.select(F.col("doc_id").cast("long").alias("doc_id"), "n_words", "n_removed",
                         F.sha2("kept_words", 256).alias("kept_sha256"))
