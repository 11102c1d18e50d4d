"""Language-model scoring with a sharded Elias-Fano trie.

An interpolated n-gram model with absolute discounting over additive unigrams:

    P(w) = (c(w) + 0.1) / (N + 0.1 (V + 1))
    P(w | h) = max(c(h w) - D, 0) / c(h) + D n(h) / c(h) * P(w | h')

with h the ``order`` - 1 tokens before w, h' without its first, n(h) the number of
different successors of h, and end tokens before a text's first word.  Contexts of
one length are a level with shards and tries of its own; steps 2 to 4 run once per
level.  A context of several words is named by a 64-bit hash of their names.

1. Texts are tokenised into blocks of about ``BLOCK_BYTES``: word names (64-bit
   hashes), one local number per token.  Blocks are written.
2. Contexts that hold more than a shard's share of all tokens are found from
   each block's own most frequent words: at most ``MOST_HOT`` of them, whatever the
   data.  Their successors are dealt to several shards by name.
3. Each block sends its distinct n-grams to shards by context: the context's
   name, its successors' names, and their training counts.  Counting per block
   first means that a frequent word or pair is one row per block.
4. A shard adds up the counts, writes its trie to a file of the shared folder, and
   answers every block from the memory-mapped levels: a quantised probability per
   n-gram, count and back-off weight per context.  Files go once they are answered
   from, unless ``model_dir`` names a folder to keep them in.  Where the shared
   folder is no mounted path (an object store), the levels are viewed in memory.  Of a context that was dealt out it knows a part; it says
   how much that part is, and the parts' sums, a bounded table, are broadcast.
   The first level's sums give N and V.
5. Each block meets the answers of all levels and scores its texts.

Model size per shard is bounded by the number of shards, which follows the
input; nothing but the table of dealt contexts is broadcast, and only it, N and V
reach the driver.

Defined results: null text is empty and has the end token alone; a null doc_id
is trained on as if its remainder were not 0 and held_out is false.
"""

from __future__ import annotations

import os
import uuid
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filelake.llm.common import WordHash, by_value, chunks, mix, shared_folder, small_batches, store
from filelake.llm.eftrie import PROBABILITY, Trie, weight

by_value(__name__)

DISCOUNT = 0.75
BLOCK_BYTES = 8_000_000
CHUNK_BYTES = 2_000_000
SHARD_TOKENS = 2_000_000
SHARDS = 32          # at least
MOST_HOT = 10_000    # contexts that are dealt to several shards, at most
END = 0x9D39247E33776D41  # fixed value: the name of the end token


def _pack(*arrays) -> bytes:
    body = b"".join(a.tobytes() for a in arrays)
    return np.array([len(body), *(a.nbytes for a in arrays)], np.int64).tobytes() + pa.compress(body, codec="zstd", asbytes=True)


def _unpack(data, *kinds):
    head = np.frombuffer(data, np.int64, len(kinds) + 1)
    body = pa.decompress(memoryview(data)[head.nbytes:], decompressed_size=int(head[0]), codec="zstd", asbytes=True)
    at = np.concatenate([[0], np.cumsum(head[1:])])
    return [np.frombuffer(body[at[i]:at[i + 1]], k) for i, k in enumerate(kinds)]


def encode_blocks(docs: DataFrame, train) -> DataFrame:
    """block, tokens, doc_ids, trained, data (lengths of texts with the end
    token, word names by falling frequency, number of each token)."""
    rows = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(train, F.lit(True)).alias("train"),
                       F.col("text").cast("binary").alias("_t"))

    def run(batches):
        from pyspark import TaskContext
        hashes, number = WordHash(fold=True), TaskContext.get().partitionId() << 24
        held, size = [], 0

        def block():
            nonlocal number
            lens = np.concatenate([h[1] for h in held])
            words = np.concatenate([h[0] for h in held])
            ends = np.cumsum(lens + 1) - 1
            tokens = np.empty(len(words) + len(lens), np.uint64)
            is_end = np.zeros(len(tokens), bool)
            is_end[ends] = True
            tokens[is_end], tokens[~is_end] = END, words
            names, number_of, count = np.unique(tokens, return_inverse=True, return_counts=True)
            order = np.argsort(-count, kind="stable")
            place = np.empty(len(order), np.uint32)
            place[order] = np.arange(len(order), dtype=np.uint32)
            local = place[number_of]
            planes = np.ascontiguousarray(local.view(np.uint8).reshape(-1, 4).T)
            number += 1
            return pa.RecordBatch.from_arrays([
                pa.array([number], pa.int64()), pa.array([len(tokens)], pa.int64()),
                pa.array([[i for h in held for i in h[2]]], pa.list_(pa.int64())),
                pa.array([[i for h in held for i in h[3]]], pa.list_(pa.bool_())),
                pa.array([_pack((lens + 1).astype(np.int64), names[order], planes)], pa.binary())],
                names=["block", "tokens", "doc_ids", "trained", "data"])

        for batch in batches:
            texts = batch.column("_t").to_pylist()
            ids, trained = batch.column("doc_id").to_pylist(), batch.column("train").to_pylist()
            for a, b in chunks(batch, [len(t) if t else 0 for t in texts], CHUNK_BYTES):
                words, lens = hashes(texts[a:b])
                held.append((words, lens, ids[a:b], trained[a:b]))
                size += 6 * (len(words) + b - a)
                if size >= BLOCK_BYTES:
                    yield block()
                    held, size = [], 0
        if held:
            yield block()

    return rows.mapInArrow(run, "block long, tokens long, doc_ids array<long>, trained array<boolean>, data binary")


def _local(data):
    """Lengths of texts, word names, and the number of each token's word."""
    lens, names, planes = _unpack(data, np.int64, np.uint64, np.uint8)
    return lens, names, np.ascontiguousarray(planes.reshape(4, -1).T).view(np.uint32).reshape(-1).astype(np.int64)


def _contexts(lens, names, tok, length: int):
    """Names of the contexts of ``length`` tokens, and the number of each token's context."""
    end = int(np.flatnonzero(names == END)[0])
    place = np.arange(len(tok)) - np.repeat(np.cumsum(lens) - lens, lens)

    def before(j):
        return np.where(place >= j, np.concatenate([np.full(min(j, len(tok)), end), tok[:-j]]), end)

    own, called = before(length), names
    for j in range(length - 1, 0, -1):
        pair, own = np.unique(own * len(names) + before(j), return_inverse=True)
        called = mix(called[pair // len(names)], names[pair % len(names)])
    return called, own


def hot_contexts(blocks: DataFrame, total: int, shard_tokens: int, most: int = MOST_HOT, length: int = 1):
    """Names (sorted) of contexts with about ``shard_tokens`` tokens or more, and
    into how many shards each is dealt.  A context with that share of all tokens has
    half of them in blocks where its share is half as large or larger; those are
    counted, so none is missed, and what is below half the share is left out."""
    share = max(shard_tokens / max(total, 1), 2 / most)
    if share > 1:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def frequent(batches):
        for batch in batches:
            for data in batch.column("data"):
                lens, names, tok = _local(data.as_buffer())
                names, own = _contexts(lens, names, tok, length)
                n = np.bincount(own, minlength=len(names))
                at = np.flatnonzero(n >= share / 2 * len(tok))
                yield pa.RecordBatch.from_arrays([pa.array(names[at].view(np.int64)), pa.array(n[at])], names=["name", "n"])

    rows = (blocks.select("data").mapInArrow(frequent, "name long, n long").groupBy("name").agg(F.sum("n").alias("n"))
            .where(F.col("n") >= share / 2 * total).toArrow())  # at most 2 / share rows
    name, n = rows.column("name").to_numpy().view(np.uint64), rows.column("n").to_numpy()
    order = np.argsort(name)
    return name[order], np.maximum(2, -(-2 * n[order] // shard_tokens))


def _grams(data, trained, shards, hot, length):
    """lens, names, local tokens, the contexts' names, each token's context, the
    distinct n-grams (context, token) ordered by shard, context and token, the place
    of each token's n-gram among them, and each n-gram's training count and shard."""
    lens, names, tok = _local(data)
    called, own = _contexts(lens, names, tok, length)
    n = len(names)
    pair, where = np.unique(own * n + tok, return_inverse=True)
    left, right = pair // n, pair % n
    shard = ((called >> np.uint64(20)) % np.uint64(shards)).astype(np.int64)[left]
    hot_names, deals = hot
    if len(hot_names):
        at = np.minimum(np.searchsorted(hot_names, called), len(hot_names) - 1)
        deal = np.where(hot_names[at] == called, deals[at], 1)[left]
        shard = (shard + (names[right] >> np.uint64(30)).astype(np.int64) % deal) % shards
    by = np.argsort(shard, kind="stable")  # inside a shard still by context and token
    place = np.empty(len(by), np.int64)
    place[by] = np.arange(len(by))
    where = place[where]
    count = np.bincount(where, weights=np.repeat(np.asarray(trained, np.float64), lens), minlength=len(pair)).astype(np.uint32)
    return lens, names, tok, called, own, left[by], right[by], where, count, shard[by]


ANSWERS = "block long, shard long, data binary, n long, v long, dealt array<struct<name:long,total:long,types:long>>"


def mounted(folder: str) -> str | None:
    """The path of a shared folder that is mounted, else None."""
    path = folder.removeprefix("file://").removeprefix("file:")
    return path if path.startswith("/") else None


def mapped(data: bytes, folder: str, name: str, keep: bool) -> Trie:
    """The trie of ``data``, written to a file that appears whole, and mapped.  A
    file that isn't kept loses its name at once and its space with the mapping."""
    os.makedirs(folder, exist_ok=True)
    draft = f"{folder}/.{name}-{uuid.uuid4().hex}"
    with open(draft, "wb") as f:
        f.write(data)
    trie = Trie.open(draft)
    if keep:
        os.replace(draft, f"{folder}/{name}.trie")
    else:
        os.unlink(draft)
    return trie


def level_answers(blocks: DataFrame, length: int, shards: int, hot, discount: float, folder: str, keep: bool) -> DataFrame:
    """Answers of the shards of one level (``ANSWERS``), stored."""
    given, where_to = blocks.sparkSession.sparkContext.broadcast(hot), mounted(folder)

    def ask(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                _, names, _, called, _, left, right, _, count, shard = _grams(batch.column("data")[i].as_buffer(), batch.column("trained")[i].as_py(), shards, given.value, length)
                cut = np.append(np.flatnonzero(np.diff(shard, prepend=-1)), len(shard))
                for a, b in zip(cut[:-1], cut[1:]):
                    own = left[a:b]
                    first = np.flatnonzero(np.diff(own, prepend=-1))
                    data = _pack(called[own[first]], np.diff(np.append(first, b - a)).astype(np.uint32), names[right[a:b]], count[a:b])
                    yield pa.RecordBatch.from_arrays([batch.column("block")[i:i + 1], pa.array([shard[a]], pa.int64()), pa.array([data], pa.binary())],
                                                     names=["block", "shard", "data"])

    def answer(table):
        asked = []
        for data in table.column("data"):
            contexts, sizes, names, count = _unpack(data.as_buffer(), np.uint64, np.uint32, np.uint64, np.uint32)
            asked.append((contexts, sizes.astype(np.int64), names, count))
        every = np.unique(np.concatenate([a[0] for a in asked]))
        ranks, keys, counts = [], [], []
        for contexts, sizes, names, count in asked:
            seen = count > 0
            ranks.append(np.repeat(np.searchsorted(every, contexts), sizes)[seen])
            keys.append(names[seen])
            counts.append(count[seen].astype(np.int64))
        rank, key, count = (np.concatenate(x) for x in (ranks, keys, counts))
        order = np.lexsort((key, rank))
        rank, key, count = rank[order], key[order], count[order]
        first = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (rank[1:] != rank[:-1])])) if len(key) else np.zeros(0, np.int64)
        sums = np.add.reduceat(count, first) if len(first) else np.zeros(0, np.int64)
        rank, key = rank[first], key[first]
        data = Trie.build(every[rank], key, sums, discount).to_bytes()
        trie = mapped(data, where_to, f"{length}-{table.column('shard')[0].as_py()}", keep) if where_to else Trie.view(data)
        del data
        out = [_pack(*trie.ask(contexts, sizes, names)) for contexts, sizes, names, _ in asked]
        n = len(out)
        dealt = np.isin(every, given.value[0])
        types, total = np.bincount(rank, minlength=len(every)), np.zeros(len(every), np.int64)
        np.add.at(total, rank, sums)
        stats = [{"name": int(a), "total": int(b), "types": int(c)} for a, b, c in zip(every[dealt].view(np.int64), total[dealt], types[dealt])]
        return pa.table({"block": table.column("block"), "shard": table.column("shard"), "data": pa.array(out, pa.binary()),
                         "n": pa.array([int(sums.sum())] + [0] * (n - 1), pa.int64()),
                         "v": pa.array([int((types[~dealt] > 0).sum())] + [0] * (n - 1), pa.int64()),
                         "dealt": pa.array([stats] + [[]] * (n - 1), pa.list_(pa.struct([("name", pa.int64()), ("total", pa.int64()), ("types", pa.int64())])))})

    asked = blocks.mapInArrow(ask, "block long, shard long, data binary")
    return store(asked.groupBy("shard").applyInArrow(answer, ANSWERS), "answers")


def dealt_sums(answers: DataFrame):
    """Names of the contexts that were dealt out with their totals and types, and
    (name, shard, total) of their parts, by name and shard."""
    # parts of dealt contexts: bounded by their number and deals
    parts = answers.select("shard", F.explode("dealt").alias("d")).select("shard", "d.name", "d.total", "d.types").toArrow()
    part_name, part_shard = parts.column("name").to_numpy().view(np.uint64), parts.column("shard").to_numpy()
    order = np.lexsort((part_shard, part_name))
    part_name, part_shard, part_total, part_types = part_name[order], part_shard[order], parts.column("total").to_numpy()[order], parts.column("types").to_numpy()[order]
    whole, of = np.unique(part_name, return_inverse=True)
    whole_total, whole_types = np.zeros(len(whole), np.int64), np.zeros(len(whole), np.int64)
    np.add.at(whole_total, of, part_total)
    np.add.at(whole_types, of, part_types)
    return whole, whole_total, whole_types, part_name, part_shard, part_total


def _read_answers(answers, called, left, shard, sums, discount):
    """Of one level: probability per n-gram, count and back-off weight per context."""
    whole, whole_total, whole_types, part_name, part_shard, part_total = sums
    seen, back, high = np.zeros(len(called), np.int64), np.zeros(len(called)), np.zeros(len(left))
    cut = np.append(np.flatnonzero(np.diff(shard, prepend=-1)), len(shard))
    for a, b in zip(cut[:-1], cut[1:]):
        count, weights, codes = _unpack(answers[int(shard[a])].as_buffer(), np.uint64, np.uint16, np.uint16)
        own = left[a:b]
        ctx = own[np.flatnonzero(np.diff(own, prepend=-1))]
        seen[ctx] = count.astype(np.int64)
        back[ctx] = np.where(count > 0, weight(weights), 1.0)
        high[a:b] = PROBABILITY[codes]
    if len(whole):  # of a dealt context the shards gave shares of their parts
        at = np.minimum(np.searchsorted(whole, called), len(whole) - 1)
        dealt = whole[at] == called
        mine = np.flatnonzero(dealt[left])
        low, stop = np.searchsorted(part_name, called[left[mine]], "left"), np.searchsorted(part_name, called[left[mine]], "right")
        todo = np.arange(len(mine))
        part = np.zeros(len(mine))
        while len(todo):  # a context's parts, by shard
            hit = part_shard[low[todo]] == shard[mine[todo]]
            part[todo[hit]] = part_total[low[todo[hit]]]
            low[todo] += 1
            todo = todo[~hit & (low[todo] < stop[todo])]
        total = whole_total[at]
        high[mine] *= part / np.maximum(total[left[mine]], 1)
        seen[dealt] = total[dealt]
        back[dealt] = np.where(total[dealt] > 0, discount * whole_types[at][dealt] / np.maximum(total[dealt], 1), 1.0)
    return high, seen, back


def score_texts(docs: DataFrame, train, discount: float = DISCOUNT, order: int = 2, model_dir: str | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score;
    ``train`` is a boolean column: which rows are learned from.  ``model_dir``: a
    mounted folder that keeps the tries, ``<context length>-<shard>.trie``."""
    if order < 2:
        raise ValueError("order is 2 or more")
    blocks = store(encode_blocks(docs, train), "blocks")
    total = blocks.agg(F.sum("tokens")).first()[0] or 0
    shards = max(SHARDS, -(-total // SHARD_TOKENS))
    folder = model_dir or shared_folder(docs.sparkSession, "tries")
    levels, hots, sums = [], [], []
    for length in range(1, order):
        hots.append(hot_contexts(blocks, total, SHARD_TOKENS, length=length))
        levels.append(level_answers(blocks, length, shards, hots[-1], discount, folder, model_dir is not None))
        sums.append(dealt_sums(levels[-1]))
    s = levels[0].agg(F.sum("n").alias("n"), F.sum("v").alias("v")).first()
    n_train, v_train = s["n"] or 0, (s["v"] or 0) + int((sums[0][1] > 0).sum())
    known_of = docs.sparkSession.sparkContext.broadcast((hots, sums))

    def score(left_table, right_table):
        if not left_table.num_rows:
            return pa.table({"doc_id": pa.array([], pa.int64()), "trained": pa.array([], pa.bool_()), "n_tokens": pa.array([], pa.int64()),
                             "n_known": pa.array([], pa.int64()), "base_score": pa.array([], pa.float64()), "score": pa.array([], pa.float64())})
        t = left_table.combine_chunks()
        trained = t.column("trained")[0].as_py()
        answers = {(k.as_py(), s.as_py()): d for k, s, d in zip(*(right_table.column(c) for c in ("length", "shard", "data")))}
        for length, (hot, of_level) in enumerate(zip(*known_of.value), 1):
            lens, names, tok, called, own, left, right, where, _, shard = _grams(t.column("data")[0].as_buffer(), trained, shards, hot, length)
            given = {s: d for (k, s), d in answers.items() if k == length}
            high, seen, back = _read_answers(given, called, left, shard, of_level, discount)
            if length == 1:
                known = seen > 0
                single = (seen + 0.1) / (n_train + 0.1 * (v_train + 1))
                p = single[tok]
            p = high[where] + back[own] * p
        full = np.log10(p)
        start = np.cumsum(lens) - lens
        return pa.table({"doc_id": t.column("doc_ids").combine_chunks().flatten(), "trained": pa.array(trained, pa.bool_()),
                         "n_tokens": lens, "n_known": np.add.reduceat(known[tok].astype(np.int64), start),
                         "base_score": np.add.reduceat(np.log10(single)[tok], start),
                         "score": np.add.reduceat(full, start)})

    every = reduce(DataFrame.unionByName, [a.select("block", F.lit(k).alias("length"), "shard", "data") for k, a in enumerate(levels, 1)])
    scored = (blocks.groupBy("block").cogroup(every.groupBy("block"))
              .applyInArrow(score, "doc_id long, trained boolean, n_tokens long, n_known long, base_score double, score double"))
    return scored.select("doc_id", (~F.col("trained")).alias("held_out"), "n_tokens", "n_known",
                         F.lit(n_train).cast("long").alias("train_tokens"), "base_score", "score")
