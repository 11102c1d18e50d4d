"""Benchmark decontamination by a broadcast hash set of word windows.

Every ``window`` consecutive words of an item (all its words, if it has fewer)
are a window.  The distinct windows, each with at most about ``ITEMS`` of its items,
are entries; they are dealt to blocks by hash, about ``BLOCK`` (window, item) pairs
each, a proven bound for one broadcast.  The documents meet one block after
another: only the present block is collected and broadcast, and between blocks the
documents are written with what was found so far.  So a larger benchmark means
more steps, never a larger broadcast or more in an executor's memory.  Each task
hashes all windows of its texts, looks them up, and verifies a hit word by word.

Defined results: null text has no words; an item without words hits nothing; an
item without an id hits but is not listed; items are listed once however often
they occur.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filelake.llm.common import WordHash, by_value, chunks, small_batches, span_hashes, store
from filelake.session import join_side

by_value(__name__)

WINDOW = 10
BLOCK = 200_000
ITEMS = 1000   # of a window in one entry, about
CHUNK_BYTES = 2_000_000
# fixed values: bytes between words, once A-Z are folded
BETWEEN = bytes([*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def item_windows(bench: DataFrame, window: int = WINDOW) -> DataFrame:
    """words (binary, joined by one space), k (their number), items (ids): the
    entries; a window of very many items has several."""

    def run(batches):
        for batch in batches:
            words, size, item = [], [], []
            for i, t in zip(batch.column("item_id").to_pylist(), batch.column("_t").to_pylist()):
                w = WORD.findall(t.lower()) if t else []
                k = min(window, len(w))
                for a in range(len(w) - k + 1 if k else 0):
                    words.append(b" ".join(w[a:a + k]))
                    size.append(k)
                    item.append(i)
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array(size, pa.int32()), pa.array(item, pa.int64())],
                                             names=["words", "k", "item"])

    rows = (small_batches(bench).select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("binary").alias("_t"))
            .mapInArrow(run, "words binary, k int, item long"))
    rows = store(rows.distinct(), "item-windows")
    many = rows.groupBy("words", "k").agg(F.ceil(F.count(F.lit(1)) / ITEMS).alias("cuts")).where("cuts > 1")
    cut = F.pmod(F.xxhash64("item"), F.coalesce("cuts", F.lit(1)))
    return join_side(rows, many, ["words", "k"], "left", "hot-windows").groupBy("words", "k", cut.alias("cut")).agg(F.collect_set("item").alias("items"))


def _blocks(spark, windows: DataFrame, block: int):
    """One after another the broadcast handles; each value: {k: {hash: [(words,
    items), ...]}}, then whether it is the last."""
    windows = store(windows, "entries")
    pairs = windows.agg(F.sum(F.greatest(F.size("items"), F.lit(1)))).first()[0] or 0
    n = max(1, -(-pairs // block))
    memo = WordHash()
    for b in range(n):
        # an entry is a window with a bounded number of items, so a block is bounded by about ``block`` pairs
        table: dict[int, dict[int, list]] = {}
        for r in windows.where(F.pmod(F.xxhash64("words", "cut"), F.lit(n)) == b).collect():
            h = int(span_hashes(memo([bytes(r["words"])])[0], r["k"])[0])
            table.setdefault(r["k"], {}).setdefault(h, []).append((bytes(r["words"]), r["items"]))
        yield spark.sparkContext.broadcast(table), b == n - 1


def _find(batch, tables, hashes):
    """Per row: (number of words, [(first word, k), ...], set of items)."""
    texts = batch.column("_t").to_pylist()
    out = []
    for a, b in chunks(batch, [len(t) if t else 0 for t in texts], CHUNK_BYTES):
        words, lens = hashes(texts[a:b])
        begin = np.cumsum(lens) - lens
        hits: dict[int, list] = {}
        for k, (keys, maybe, table) in tables.items():
            h = span_hashes(words, k)
            at = np.flatnonzero(maybe[h & np.uint64(len(maybe) - 1)])
            at = at[np.isin(h[at], keys)]
            doc = np.searchsorted(begin, at, side="right") - 1
            inside = at + k <= begin[doc] + lens[doc]
            for i, d in zip(at[inside].tolist(), doc[inside].tolist()):
                hits.setdefault(d, []).append((i - int(begin[d]), k, table[int(h[i])]))
        for d in range(b - a):
            spans, items = [], set()
            if d in hits:
                own = WORD.findall(texts[a + d].lower())
                for w, k, entries in hits[d]:
                    seen = b" ".join(own[w:w + k])
                    for text, ids in entries:
                        if text == seen:  # verified, not just equal hashes
                            spans.append((w, k))
                            items.update(ids)
            out.append((int(lens[d]), spans, items))
    return out


def _cut(text: bytes, hit: np.ndarray) -> bytes:
    """The text without its hit words and what stands between them."""
    parts, at = [], 0
    places = [m.span() for m in WORD.finditer(text.lower())]
    i = 0
    while i < len(hit):
        if hit[i]:
            j = i
            while j + 1 < len(hit) and hit[j + 1]:
                j += 1
            parts.append(text[at:places[i][0]])
            at = places[j][1]
            i = j
        i += 1
    return b"".join([*parts, text[at:]])


def find_leaks(docs: DataFrame, bench: DataFrame, window: int = WINDOW, block: int = BLOCK) -> DataFrame:
    """The columns of ``docs`` (but any named like a new one), then n_words,
    n_hit, items (sorted ids) and clean_text (without the hit words)."""
    docs = docs.drop("n_words", "n_hit", "items", "clean_text", "_t", "_spans", "_items")
    df = small_batches(docs).withColumn("_t", F.col("text").cast("binary"))
    df = df.withColumn("_spans", F.array().cast("array<int>")).withColumn("_items", F.array().cast("array<long>"))
    names, before = docs.columns, df.schema

    def stage(handle, last):
        def run(batches):
            hashes = WordHash(BETWEEN, fold=True)
            tables = {}
            for k, table in handle.value.items():
                keys = np.array(list(table), np.uint64)
                maybe = np.zeros(1 << 22, bool)
                maybe[keys & np.uint64(len(maybe) - 1)] = True
                tables[k] = (keys, maybe, table)
            for batch in batches:
                spans, items, rows = [], [], _find(batch, tables, hashes)
                for i, (_, s, ids) in enumerate(rows):
                    old = batch.column("_spans")[i].as_py()
                    spans.append([*old, *(x for pair in s for x in pair)])
                    items.append(sorted({*batch.column("_items")[i].as_py(), *ids}))
                if not last:
                    cols = [*(batch.column(c) for c in [*names, "_t"]), pa.array(spans, pa.list_(pa.int32())), pa.array(items, pa.list_(pa.int64()))]
                    yield pa.RecordBatch.from_arrays(cols, names=[*names, "_t", "_spans", "_items"])
                    continue
                texts = batch.column("text").to_pylist()
                n_hit, clean = [], []
                for i, (n, _, _) in enumerate(rows):
                    hit = np.zeros(n, bool)
                    for a, k in zip(spans[i][::2], spans[i][1::2]):
                        hit[a:a + k] = True
                    n_hit.append(int(hit.sum()))
                    clean.append(_cut(texts[i].encode(), hit).decode() if n_hit[-1] else texts[i])
                cols = [*(batch.column(c) for c in names), pa.array([r[0] for r in rows], pa.int64()), pa.array(n_hit, pa.int64()),
                        pa.array(items, pa.list_(pa.int64())), pa.array(clean, pa.string())]
                yield pa.RecordBatch.from_arrays(cols, names=[*names, "n_words", "n_hit", "items", "clean_text"])
        return run

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    for handle, last in _blocks(docs.sparkSession, item_windows(bench, window), block):
        if last:
            return df.mapInArrow(stage(handle, last), f"{fields}, n_words long, n_hit long, items array<long>, clean_text string")
        df = store(df.mapInArrow(stage(handle, last), before), "block")
        handle.destroy()


def leak_digest(found: DataFrame) -> DataFrame:
    as_text = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return found.select(F.col("doc_id").cast("long").alias("doc_id"), "n_words", "n_hit",
                        F.size("items").cast("long").alias("n_items"), F.sha2(as_text.cast("binary"), 256).alias("items_sha256"),
                        (F.col("n_hit") > 0).alias("contaminated"))
