"""Spelling variant grouping by an index of variable-length grams.

1. Words are counted over whole texts, summed per task before the shuffle.
2. Words stand between two marks.  The gram dictionary is grown level by level
   from grams of ``LEAST`` symbols: a gram is extended by one symbol only while
   it occurs more than T times in the vocabulary, so rare grams prune what lies
   below them.  T follows the vocabulary, so that at most ``GRAMS`` grams of a
   length are frequent, a proven bound for the broadcast dictionary (a hash and
   a count each).
3. A word is decomposed into the dictionary grams at each of its places.  Every
   one goes into the index, under its hash, the word's length and its place.
4. A word merges the lists of few of its grams only.  One edit affects the grams
   whose symbols it touches; the affected-gram bound of a choice of grams is the
   largest number of them that one edit can touch.  A choice whose size exceeds
   its bound has a gram that stays, at its old place from the left or from the
   right, in every near word, so the union of its lists is complete.  Each word
   takes the cheapest such choice by the dictionary's counts: two grams without
   a common symbol (bound 1).
5. Index rows and the words that ask meet in shards of gram keys (one shuffle).  A
   list is read in blocks: length and parity of letters first, then the exact
   test.  A link found by several grams is kept at the first of them.  Longer
   words are found from the shorter ones, and both directions are returned, as
   one row per word and shard with the count and the best near word.

Keys that many words share are cheap to avoid, as a word asks for its rarest
grams; index rows of a gram with over ``SPLIT`` occurrences are dealt to several
shards, and what asks for it goes to each of them.

Defined results: null texts have no words; a null doc_id reads as an empty one in
the hashed text; rows that share an id are each counted; an empty table has no
words; other columns are not read.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filelake.llm.common import by_value, mix, scramble, small_batches, store
from filelake.session import join_side

by_value(__name__)

SHORTEST = 5         # code points
OFTEN = 3            # occurrences
EVERY = 97
RATIO = 2
LEAST, MOST = 3, 10  # symbols of a gram
FREQUENT = 500       # T, at least
GRAMS = 50_000       # frequent grams of a length, at most
SPLIT = 300_000      # index rows of a gram in one shard
SHARD_ROWS = 400_000
TASK_WORDS = 25_000
PAIRS = 1 << 21
HELD_WORDS = 200_000
FIRST, LAST = "\x02", "\x03"  # fixed values: the marks, which no word holds
RUN = re.compile("[A-Za-zÀ-ÿ]+")


def altered(number, run: str) -> str:
    """The run, without one code point if 97 divides the hash of id and run."""
    h = zlib.crc32(f"{'' if number is None else number}:{run}".encode())
    k = h % len(run)
    return run[:k] + run[k + 1:] if h % EVERY == 0 else run


def word_counts(docs: DataFrame, shortest: int = SHORTEST, often: int = OFTEN) -> DataFrame:
    """word, n: words of at least ``shortest`` code points and ``often`` occurrences."""

    def run(batches):
        import collections
        total = collections.Counter()

        def emit():
            out = pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.string()), pa.array(total.values(), pa.int64())], names=["word", "n"])
            total.clear()
            return out

        for batch in batches:
            for number, text in zip(batch.column("doc_id").to_pylist(), batch.column("_t").to_pylist()):
                if not text:
                    continue
                # lower() of bytes folds A-Z only
                runs = collections.Counter(RUN.findall(text.lower().decode()))
                head = zlib.crc32(f"{'' if number is None else number}:".encode())
                for word, c in runs.items():
                    if len(word) >= shortest:
                        if zlib.crc32(word.encode(), head) % EVERY == 0:
                            word = altered(number, word)
                            if len(word) < shortest:
                                continue
                        total[word] += c
                if len(total) > HELD_WORDS:
                    yield emit()
        if total:
            yield emit()

    rows = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("_t"))
    return rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= often)


def affected_bound(spans: list[tuple[int, int]]) -> int:
    """The most of these grams (start, length) that one edit can touch."""
    return max((sum(a <= at < a + size for a, size in spans) for at, _ in spans), default=0)


def _matrices(words: list[str]):
    """For each length of the marked words: (rows, symbols as rows x length)."""
    size = np.array([len(w) + 2 for w in words], np.int64)
    flat = np.frombuffer((FIRST + (LAST + FIRST).join(words) + LAST).encode("latin-1"), np.uint8)
    at = np.cumsum(size) - size
    for n in np.unique(size).tolist():
        rows = np.flatnonzero(size == n)
        step = max(1, (1 << 22) // n)
        for a in range(0, len(rows), step):
            yield n, rows[a:a + step], flat[at[rows[a:a + step], None] + np.arange(n)]


def _grams(symbols: np.ndarray, levels: list[tuple[np.ndarray, np.ndarray]]):
    """Level by level (length, hashes, which are dictionary grams, counts of
    the frequent ones, else 0); ``levels`` has the frequent hashes and counts."""
    n = symbols.shape[1]
    x = symbols.astype(np.uint64)
    h = scramble(x[:, :n - LEAST + 1])
    for i in range(1, LEAST):
        h = mix(h, x[:, i:n - LEAST + 1 + i], i)
    open_ = np.ones(h.shape, bool)
    for size in range(LEAST, min(MOST, n) + 1):
        if size > LEAST:
            keep = n - size + 1
            open_ = open_[:, :keep] & (count[:, :keep] > 0)  # noqa: F821 - of the level before
            if not open_.any():
                return
            h = mix(h[:, :keep], x[:, size - 1:], size - 1)
        count = np.zeros(h.shape, np.int64)
        if size - LEAST < len(levels) and len(levels[size - LEAST][0]):
            names, counts = levels[size - LEAST]
            at = np.minimum(np.searchsorted(names, h[open_]), len(names) - 1)
            count[open_] = np.where(names[at] == h[open_], counts[at], 0)
        yield size, h, open_, count


def gram_dictionary(words: DataFrame, frequent: int = FREQUENT, most: int = GRAMS):
    """(T, levels): per length the hashes of the grams that occur more than T
    times, sorted, and their counts."""
    total = words.agg(F.sum(F.char_length("word") + F.lit(2 - LEAST + 1))).first()[0] or 0
    limit = max(frequent, total // most)  # so fewer than ``most`` of a length pass
    levels: list[tuple[np.ndarray, np.ndarray]] = []
    for size in range(LEAST, MOST):
        known = list(levels)

        def count(batches, size=size, known=known):
            for batch in batches:
                found = [h[open_] for _, _, m in _matrices(batch.column("word").to_pylist()) for s, h, open_, _ in _grams(m, known) if s == size]
                if found:
                    h, n = np.unique(np.concatenate(found), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n, pa.int64())], names=["h", "n"])

        rows = (words.select("word").mapInArrow(count, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
                .where(F.col("n") > limit).toArrow())  # bounded by ``most``
        h = rows.column("h").to_numpy().view(np.uint64)
        order = np.argsort(h)
        levels.append((h[order], rows.column("n").to_numpy()[order]))
        if not len(h):
            break
    return limit, levels


BIG = np.int64(1) << np.int64(62)


def choose(symbols: np.ndarray, levels, limit: int):
    """Per word two dictionary grams without a common symbol, the cheapest by
    their counts: starts and lengths of the left and of the right one."""
    k, n = symbols.shape
    ends, starts = np.full((k, n + 1), BIG), np.full((k, n + 1), BIG)
    for size, _, open_, count in _grams(symbols, levels):
        place = np.arange(n - size + 1)
        cost = np.where(count > 0, count, limit // 2)
        cost = np.where((place == 0) | (place + size == n), cost, cost // max(1, n - size) + 1)
        code = np.where(open_, np.minimum(cost, (1 << 26) - 1) << 36 | place << 6 | size, BIG)
        ends[:, size:] = np.minimum(ends[:, size:], code)
        starts[:, :n - size + 1] = np.minimum(starts[:, :n - size + 1], code)
    left = np.minimum.accumulate(ends, axis=1)                       # the best that ends by here
    right = np.minimum.accumulate(starts[:, ::-1], axis=1)[:, ::-1]  # the best that starts from here
    both = np.where((left < BIG) & (right < BIG), (left >> 36) + (right >> 36), BIG)
    cut = both.argmin(axis=1)
    row = np.arange(k)
    a, b = left[row, cut], right[row, cut]
    return (a >> 6) & ((1 << 30) - 1), a & 63, (b >> 6) & ((1 << 30) - 1), b & 63


def _key(h, length, place, salt):
    return mix(h, (np.asarray(length).astype(np.uint64) << np.uint64(32)) | np.asarray(place).astype(np.uint64), 17) + np.asarray(salt).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)


INDEX = "key long, kind int, word string, n long, lp int, ll int, rp int, rl int"


def index_rows(words: DataFrame, limit: int, levels, split: int = SPLIT) -> DataFrame:
    """Rows of the index (kind -1) and of the words that ask (kinds 0 to 3: the
    left gram at its place and one later, the right gram likewise; the word
    asked for is as long, kinds 4 and 5, or one longer)."""
    given = words.sparkSession.sparkContext.broadcast(levels)

    def run(batches):
        own = given.value
        for batch in batches:
            words_ = batch.column("word").to_pylist()
            for n, rows, m in _matrices(words_):
                sums = m.astype(np.int64).sum(axis=1)
                key, kind, who, spans = [], [], [], []
                lp, ll, rp, rl = choose(m, own, limit)
                for size, h, open_, count in _grams(m, own):
                    i, p = np.nonzero(open_)
                    parts = np.maximum(1, -(-count[i, p] // split))
                    key.append(_key(h[i, p], n, p, sums[i] % parts))
                    kind.append(np.full(len(i), -1, np.int32))
                    who.append(i)
                    spans.append(np.zeros((len(i), 4), np.int32))
                    for first, at, length in ((0, lp, ll), (2, rp, rl)):
                        i = np.flatnonzero(length == size)
                        if not len(i):
                            continue
                        parts = np.maximum(1, -(-count[i, at[i]] // split))
                        again = np.repeat(np.arange(len(i)), parts)
                        salt = np.arange(len(again)) - np.repeat(np.cumsum(parts) - parts, parts)
                        i = i[again]
                        for longer, shift, tag in ((0, 0, 4 + first // 2), (1, 0, first), (1, 1, first + 1)):
                            key.append(_key(h[i, at[i]], n + longer, at[i] + shift, salt))
                            kind.append(np.full(len(i), tag, np.int32))
                            who.append(i)
                            spans.append(np.stack([lp[i], ll[i], rp[i], rl[i]], axis=1).astype(np.int32))
                key, kind, who, spans = (np.concatenate(x) for x in (key, kind, who, spans))
                for a in range(0, len(key), 1 << 18):
                    part = slice(a, a + (1 << 18))
                    take = pa.array(rows[who[part]])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(key[part].view(np.int64)), pa.array(kind[part]), batch.column("word").take(take), batch.column("n").take(take),
                         *(pa.array(np.ascontiguousarray(spans[part, c])) for c in range(4))], names=["key", "kind", "word", "n", "lp", "ll", "rp", "rl"])

    return words.mapInArrow(run, INDEX)


def near(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row: do symbols a (k x n) and b (k x n or n + 1) differ by exactly
    one replaced or inserted symbol?"""
    n = a.shape[1]
    same = a == b[:, :n]
    if b.shape[1] == n:
        return (~same).sum(axis=1) == 1
    later = a == b[:, 1:]
    head = np.where(same.all(axis=1), n, (~same).argmax(axis=1))                        # equal up to here
    tail = np.where(later.all(axis=1), 0, n - (~later[:, ::-1]).argmax(axis=1))          # equal from here on, one later
    return tail <= head


def _holds(same: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Are the symbols at ... at + size equal?"""
    sums = np.concatenate([np.zeros((len(same), 1), np.int32), np.cumsum(same, axis=1, dtype=np.int32)], axis=1)
    row = np.arange(len(same))
    return sums[row, at + size] - sums[row, at] == size


def links_of_shard(key, kind, words: list[str], spans):
    """(asking row, found index row, found is longer) of every link whose first
    common gram lies in this shard; spans: lp, ll, rp, rl of marked words."""
    size = np.array([len(w) for w in words], np.int64)
    flat = np.frombuffer("".join(words).encode("latin-1") + b"\0", np.uint8)
    at = np.cumsum(size) - size
    parity = np.bitwise_xor.reduceat(np.uint64(1) << (flat[:-1] & np.uint8(63)).astype(np.uint64), at) if len(words) else np.zeros(0, np.uint64)
    index = np.flatnonzero(kind < 0)
    index = index[np.argsort(key[index], kind="stable")]
    asks = np.flatnonzero(kind >= 0)
    names = key[index]
    low, high = np.searchsorted(names, key[asks], "left"), np.searchsorted(names, key[asks], "right")
    asks, low, high = asks[high > low], low[high > low], high[high > low]
    todo, out = [], []

    def settle():
        s, t = (np.concatenate(x) for x in zip(*todo))
        todo.clear()
        group = size[s] * 2 + (kind[s] < 4)
        order = np.argsort(group, kind="stable")
        s, t, group = s[order], t[order], group[order]
        cut = np.append(np.flatnonzero(np.diff(group, prepend=-1)), len(group))
        for x, y in zip(cut[:-1], cut[1:]):
            n, longer = int(group[x]) // 2, int(group[x]) % 2
            step = max(1, (1 << 23) // n)
            for c in range(x, y, step):
                ss, tt = s[c:min(y, c + step)], t[c:min(y, c + step)]
                a, b = flat[at[ss, None] + np.arange(n)], flat[at[tt, None] + np.arange(n + longer)]
                ok = near(a, b)
                ss, tt, a, b = ss[ok], tt[ok], a[ok], b[ok]
                if not len(ss):
                    continue
                edge = np.ones((len(ss), 1), bool)
                here = np.hstack([edge, a == b[:, :n], edge if not longer else ~edge])  # marks too
                lp, ll, rp, rl = (spans[i][ss] for i in range(4))
                tag = kind[ss]
                left, right = _holds(here, lp, ll), _holds(here, rp, rl)
                if longer:
                    there = np.hstack([~edge, a == b[:, 1:], edge])
                    left2, right2 = _holds(there, lp, ll), _holds(there, rp, rl)
                    first = np.select([left, left2, right, right2], [0, 1, 2, 3], -1)
                else:
                    first = np.select([left, right], [4, 5], -1)
                keep = first == tag
                out.append((ss[keep], tt[keep], np.full(int(keep.sum()), bool(longer))))

    a = 0
    many = np.cumsum(high - low)
    while a < len(asks):
        b = max(a + 1, int(np.searchsorted(many, (many[a - 1] if a else 0) + PAIRS, "right")))
        for c in range(0, int((high[a:b] - low[a:b]).max()), PAIRS):  # a list that exceeds a block is read in parts
            lo = np.minimum(low[a:b] + c, high[a:b])
            count = np.minimum(high[a:b], lo + PAIRS) - lo
            s = np.repeat(asks[a:b], count)
            t = index[np.arange(len(s)) + np.repeat(lo - (np.cumsum(count) - count), count)]
            longer = kind[s] < 4
            differ = np.bitwise_count(parity[s] ^ parity[t])
            ok = np.flatnonzero((size[t] - size[s] == longer) & (differ <= 2 - longer))
            todo.append((s[ok], t[ok]))
            if sum(len(x[0]) for x in todo) > 1 << 18:
                settle()
        a = b
    if todo:
        settle()
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
    return tuple(np.concatenate(x) for x in zip(*out))


def near_words(words: DataFrame, frequent: int = FREQUENT, split: int = SPLIT, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """word, n_near, near, near_n: the number of near words, and that of largest
    n (ties: the smallest); one row per word that has any."""
    size, n = words.agg(F.sum(F.char_length("word")), F.count(F.lit(1))).first()
    size = size or 0
    words = words.repartition(max(1, -(-n // TASK_WORDS)), "word")  # stored files may be few
    limit, levels = gram_dictionary(words, frequent)
    shards = max(1, -(-3 * size // shard_rows))  # a word has about three grams at each place

    def run(table):
        t = table.combine_chunks()
        key, kind, n = t.column("key").to_numpy(), t.column("kind").to_numpy(), t.column("n").to_numpy()
        spans = [t.column(c).to_numpy() for c in ("lp", "ll", "rp", "rl")]
        s, f, longer = links_of_shard(key, kind, t.column("word").to_pylist(), spans)
        s, f = np.concatenate([s, f[longer]]), np.concatenate([f, s[longer]])
        # a row of the index and one that asks may be the same word: told apart by nothing, summed by Spark
        order = np.lexsort((-n[f], s))
        s, f = s[order], f[order]
        first = np.flatnonzero(np.diff(s, prepend=-1))
        count = np.zeros(len(s), np.int64)
        count[first] = np.diff(np.append(first, len(s)))
        best = np.repeat(n[f[first]], count[first])
        keep = n[f] == best  # of a word's near words those of the largest n, the first with their number
        s, f, count = s[keep], f[keep], count[keep]
        return pa.table([t.column("word").take(pa.array(s)), pa.array(count), t.column("word").take(pa.array(f)), pa.array(n[f])],
                        names=["word", "count", "near", "near_n"])

    rows = index_rows(words, limit, levels, split).withColumn("shard", F.pmod("key", F.lit(shards)))
    found = rows.groupBy("shard").applyInArrow(run, "word string, count long, near string, near_n long")
    best = F.min(F.struct((-F.col("near_n")).alias("m"), F.col("near")))
    return (found.groupBy("word").agg(F.sum("count").alias("n_near"), best.alias("b"))
            .select("word", "n_near", F.col("b.near").alias("near"), (-F.col("b.m")).alias("near_n")))


def roots(forms: DataFrame) -> DataFrame:
    """word, root for rows (word, form): forms followed to the last, in rounds
    that double the steps (n at least doubles at each step, so they are few)."""
    m = store(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        step = m.select(F.col("word").alias("root"), F.col("root").alias("next"))
        new = store(join_side(m, step, ["root"], "left", "steps").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        m = new.select("word", "root")
        if new.where("moved").isEmpty():
            return m


def variants(words: DataFrame, ratio: int = RATIO, **options) -> DataFrame:
    """word, form, root, n, n_near, form_n; one row per word of ``words`` (word, n)."""
    words = store(words, "words")
    near = join_side(words, near_words(words, **options), ["word"], "left", "near")
    yes = F.col("near_n") >= ratio * F.col("n")
    rows = store(near.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(yes, F.col("near")).alias("form"),
                             F.when(yes, F.col("near_n")).alias("form_n")), "forms")
    last = roots(rows.where("form is not null"))
    return (join_side(rows, last, ["word"], "left", "last")
            .select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"))


def spelling_variants(docs: DataFrame) -> DataFrame:
    return variants(word_counts(docs))
