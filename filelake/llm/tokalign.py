"""Cross-tokenizer alignment: which tokens of A cover the bytes of which of B.

Both tokenizers read a text with a space before it.  Byte offsets at which a
token of A and one of B end together are found by intersecting the key sets of
two end-to-index dictionaries; the sorted common keys slice both id lists into
groups, and in each group the A-B pairs whose byte ranges overlap are links.

1. Texts are cut before each space that follows another character that is not
   white space.  No token of either tokenizer crosses such a place (for B this is
   read off its pieces; if one does, texts stay whole), so a text's tokens are
   those of its parts, and such a place is a common end.  A block of texts
   (``BLOCK_BYTES``, or ``BLOCK_PARTS`` distinct parts) encodes each distinct part
   once: new parts are joined, encoded in one call, and sliced by the method
   above.  A text's groups and links are those of its parts in order.
2. Blocks are written: per text its distinct parts and their number, per part its
   links as numbers of the block's distinct id pairs.  Each block counts for each
   of its id pairs the texts that hold it; summed over blocks this is the pair's
   count, and a maximum per A id (at most the vocabulary's size) tells the best.
3. Each block's distinct pairs meet their counts (``join_side``: pairs that very
   many blocks hold are split off and never gathered), and block and answers meet
   by block.  Nothing per text is shuffled but its block's data.

Defined results: null and empty texts, and texts whose tokens joined differ from
space + text (those that hold U+2581), have no tokens: zeros and an empty
groups_sha256.  Rows are separate documents whatever their doc_id; a null doc_id
stays null; empty tables give no rows; other columns are not read.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filelake.llm.common import by_value, chunks, small_batches, store
from filelake.llm.lmscore import _pack, _unpack
from filelake.llm.tokencount import WHITE
from filelake.session import join_side

by_value(__name__)

BLOCK_BYTES = 16_000_000
BLOCK_PARTS = 400_000
ADD_BYTES = 500_000      # of texts that are taken in at a time
JOIN_BYTES = 1 << 18     # of new parts that are sliced together
CALL_PARTS = 100         # of them in one string
MARK = "▁"               # fixed value: U+2581, the space of B's pieces
CUT = re.compile(f"(?<=[^{WHITE}])(?= )")
ODD = re.compile(f"^ |[{WHITE}] |[{WHITE}]$")


def byte_values() -> dict[str, int]:
    """The characters by which byte-level BPE writes bytes: printable Latin-1
    ones stand for themselves, the others are counted up from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(rest)}


class Pair:
    """The two tokenizers: ids of a string that starts with a space, and the
    number of bytes of each token."""

    def __init__(self, a_path: str, b_path: str):
        import os
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer
        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        # the characters of a byte-level token are its bytes; added tokens are never given out
        known = byte_values().keys()
        self.a_size = np.array([len(t) if (t := self.a.id_to_token(i)) and known >= set(t) else 0 for i in range(self.a.get_vocab_size())], np.int64)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_size = np.array([1 if self.b.is_byte(i) else 0 if self.b.is_control(i) or self.b.is_unknown(i) else len(p.replace(MARK, " ").encode())
                                for i, p in enumerate(pieces)], np.int64)
        # an id as it is written inside a group, and as the last of A's or B's
        self.a_words = [np.array([f"{i}{c}" for i in range(len(self.a_size))], object) for c in ",|"]
        self.b_words = [np.array([f"{i}{c}" for i in range(len(self.b_size))], object) for c in ",;"]
        self.splits = not any(re.search(f"[^{MARK}]{MARK}", p) for p in pieces)

    def parts(self, text: str) -> list[str]:
        """The text in parts that start with a space, which is left out."""
        if not self.splits:
            return [text]
        if ODD.search(text) is None:  # single spaces between words and no white space before them
            return text.split(" ")
        return [p[1:] for p in CUT.split(" " + text)]

    def encode(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of A and of B for the parts, each with its space before it; parts
        between which both may be cut are given ``CALL_PARTS`` to a string."""
        texts = [" ".join(parts[i:i + CALL_PARTS]) for i in range(0, len(parts), CALL_PARTS)]
        a = [x for e in self.a.encode_batch_fast([" " + t for t in texts], add_special_tokens=False) for x in e.ids]
        # B adds the space itself, but not to an empty string
        b = [x for t, ids in zip(texts, self.b.encode(texts, num_threads=1)) for x in (ids if t else [self.b.piece_to_id(MARK)])]
        return np.array(a, np.int64), np.array(b, np.int64)


def common_slices(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every slice between common ends, the number of A's and of B's tokens
    up to its end."""
    a_at, b_at = dict(zip(a_ends.tolist(), range(1, len(a_ends) + 1))), dict(zip(b_ends.tolist(), range(1, len(b_ends) + 1)))
    common = sorted(a_at.keys() & b_at.keys())
    return (np.fromiter(map(a_at.__getitem__, common), np.int64, len(common)), np.fromiter(map(b_at.__getitem__, common), np.int64, len(common)))


def slice_links(a_ends: np.ndarray, b_ends: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions of the overlapping A-B pairs of all slices (x, y as above), in
    order, and the number of pairs of each.  The ends of both cut a slice into
    pieces; a piece lies in one token of A and one of B, and two tokens share at
    most one piece.  A slice of m and n tokens has m + n - 1 of them."""
    ends = np.union1d(a_ends[:x[-1]], b_ends[:y[-1]]) if len(x) else np.zeros(0, np.int64)
    return np.searchsorted(a_ends, ends), np.searchsorted(b_ends, ends), np.diff(x, prepend=0) + np.diff(y, prepend=0) - 1


class Aligned:
    """What is known of some parts: sizes (tokens of A and of B, groups, links;
    -1: no tokens, as they differ from the part), groups as text with a ; after
    each, and the links' id pairs one part after another."""

    def __init__(self, sizes, words: list[str], pairs):
        self.sizes, self.words, self.pairs = sizes, words, pairs

    @classmethod
    def joined(cls, some: list[Aligned]) -> Aligned:
        return cls(np.concatenate([x.sizes for x in some]), [w for x in some for w in x.words], np.concatenate([x.pairs for x in some]))


NOTHING = np.zeros((0, 4), np.int64)


def align(pair: Pair, parts: list[str]) -> Aligned:
    """The parts in the order given."""
    done = [_align_group(pair, group) for group in _joinable(parts)]
    return Aligned.joined(done) if done else Aligned(NOTHING, [], np.zeros(0, np.uint64))


def _align_group(pair: Pair, group: list[str]) -> Aligned:
    a, b = pair.encode(group)
    stops = np.cumsum([len(p.encode()) + 1 for p in group])
    a_ends, b_ends = np.cumsum(pair.a_size[a]), np.cumsum(pair.b_size[b])
    whole = len(a) and len(b) and a_ends[-1] == stops[-1] == b_ends[-1] and not any(MARK in p for p in group)
    if whole:
        x, y = common_slices(a_ends, b_ends)
        last = np.searchsorted(a_ends[x - 1], stops)  # each part's last slice
        whole = (a_ends[x - 1][last] == stops).all()
    if not whole:
        if len(group) == 1:
            return Aligned(np.full((1, 4), -1), [""], np.zeros(0, np.uint64))
        return Aligned.joined([_align_group(pair, [p]) for p in group])  # one of them is at fault: each by itself
    i, j, many = slice_links(a_ends, b_ends, x, y)
    pairs = a[i].astype(np.uint64) << np.uint64(32) | b[j].astype(np.uint64)
    upto = np.stack([x, y, np.arange(1, len(x) + 1), np.cumsum(many)], axis=1)[last]
    sizes = np.diff(upto, axis=0, prepend=np.zeros((1, 4), np.int64))
    # ids in the order of the text: a slice's A ids, a bar, its B ids, a semicolon
    m, n = np.diff(x, prepend=0), np.diff(y, prepend=0)
    out = np.empty(len(a) + len(b), object)
    at = np.arange(len(a)) + np.repeat(y - n, m)
    out[at] = pair.a_words[0][a]
    out[at[x - 1]] = pair.a_words[1][a[x - 1]]
    at = np.arange(len(b)) + np.repeat(x, n)
    out[at] = pair.b_words[0][b]
    out[at[y - 1]] = pair.b_words[1][b[y - 1]]
    flat, cut = out.tolist(), [0, *(upto[:, 0] + upto[:, 1]).tolist()]
    return Aligned(sizes, ["".join(flat[p:q]) for p, q in zip(cut, cut[1:])], pairs)


def _joinable(parts: list[str]):
    """Runs of parts that may be joined by a space and cut there again."""
    run, size = [], 0
    for p in parts:
        alone = not p or p[-1] in WHITE or MARK in p
        if run and (alone or size > JOIN_BYTES):
            yield run
            run, size = [], 0
        if alone:
            yield [p]
        else:
            run.append(p)
            size += len(p)
    if run:
        yield run


class Block:
    """The texts of one block and what is known of their parts."""

    def __init__(self, pair: Pair):
        self.pair, self.number, self.bytes = pair, {}, 0
        self.sizes, self.words, self.pairs = np.zeros((1 << 14, 4), np.int64), [], []
        self.docs = []  # ids, totals, digests, and per text its number of distinct parts; parts and how often

    def add(self, ids, texts) -> None:
        import hashlib
        split = [self.pair.parts(t) if t else [] for t in texts]
        flat = [p for ps in split for p in ps]
        new = [p for p in dict.fromkeys(flat) if p not in self.number]
        found, start = align(self.pair, new), len(self.words)
        self.number.update(zip(new, range(start, start + len(new))))
        self.words += found.words
        self.pairs.append(found.pairs)
        while len(self.words) > len(self.sizes):
            self.sizes = np.concatenate([self.sizes, np.zeros_like(self.sizes)])
        self.sizes[start:len(self.words)] = found.sizes
        own = np.fromiter(map(self.number.__getitem__, flat), np.int64, len(flat))
        size = np.array([len(ps) for ps in split], np.int64)
        doc = np.repeat(np.arange(len(size)), size)
        bad = np.bincount(doc[self.sizes[own, 0] < 0], minlength=len(size)) > 0
        total = np.zeros((len(size), 4), np.int64)
        np.add.at(total, doc, self.sizes[own])
        total[bad] = 0
        ok = ~bad[doc]
        key, count = np.unique(doc[ok] * len(self.words) + own[ok], return_counts=True)
        kinds = np.bincount(key // max(len(self.words), 1), minlength=len(size))
        words, at, sha = self.words, 0, []
        parts = own.tolist()
        for n, b in zip(size.tolist(), bad.tolist()):
            text = "" if b or not n else "".join([words[k] for k in parts[at:at + n]])
            sha.append(hashlib.sha256(text[:-1].encode()).hexdigest() if text else "")
            at += n
        self.docs.append((ids, total, sha, kinds, key % max(len(self.words), 1), count))
        self.bytes += sum(len(t) for t in texts if t)

    def full(self) -> bool:
        return self.bytes >= BLOCK_BYTES or len(self.words) >= BLOCK_PARTS

    def row(self, number: int) -> pa.RecordBatch:
        ids, sha = ([x for d in self.docs for x in d[k]] for k in (0, 2))
        total, kinds, part, count = (np.concatenate([d[k] for d in self.docs]) for k in (1, 3, 4, 5))
        many = np.maximum(self.sizes[:len(self.words), 3], 0)
        pairs, which = np.unique(np.concatenate([np.zeros(0, np.uint64), *self.pairs]), return_inverse=True)
        start, held = np.cumsum(many) - many, np.zeros(len(pairs), np.int64)  # held: texts that hold the pair
        stop = np.cumsum(kinds)
        for a in range(0, len(kinds), 200):
            b = min(a + 200, len(kinds))
            own = slice(stop[a] - kinds[a], stop[b - 1])
            n = many[part[own]]
            at = np.arange(n.sum()) + np.repeat(start[part[own]] - (np.cumsum(n) - n), n)
            doc = np.repeat(np.repeat(np.arange(b - a), kinds[a:b]), n)
            one = np.unique(doc * len(pairs) + which[at]) % max(len(pairs), 1)
            held += np.bincount(one, minlength=len(pairs))
        data = _pack(pairs, held, many.astype(np.uint32), which.astype(np.uint32), kinds.astype(np.uint32), part.astype(np.uint32), count.astype(np.uint32))
        return pa.RecordBatch.from_arrays(
            [pa.array([number], pa.int64()), pa.array([ids], pa.list_(pa.int64())), *(pa.array([total[:, c].tolist()], pa.list_(pa.int64())) for c in range(4)),
             pa.array([sha], pa.list_(pa.string())), pa.array([data], pa.binary())], names=NAMES)


NAMES = ["block", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "data"]
KINDS = [np.uint64, np.int64, np.uint32, np.uint32, np.uint32, np.uint32, np.uint32]
ROWS = "block long, doc_id array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, groups_sha256 array<string>, data binary"


def align_texts(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256; the
    paths name tokenizer files that every executor has."""

    def encode(batches):
        from pyspark import TaskContext
        pair, number = Pair(a_path, b_path), TaskContext.get().partitionId() << 24
        block = Block(pair)
        for batch in batches:
            ids, texts = batch.column("doc_id").to_pylist(), batch.column("_t").to_pylist()
            for a, b in chunks(batch, [len(t) if t else 0 for t in texts], ADD_BYTES):
                block.add(ids[a:b], texts[a:b])
                if block.full():
                    yield block.row(number)
                    number, block = number + 1, Block(pair)
        if block.docs:
            yield block.row(number)

    rows = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("_t"))
    blocks = store(rows.mapInArrow(encode, ROWS), "aligned")

    def held(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                pairs, n, *_ = _unpack(batch.column("data")[i].as_buffer(), *KINDS)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(pairs), batch.column("block")[i].as_py())), pa.array(pairs.view(np.int64)), pa.array(n)],
                                                 names=["block", "pair", "n"])

    asked = store(blocks.select("block", "data").mapInArrow(held, "block long, pair long, n long"), "pairs")
    counts = store(asked.groupBy("pair").agg(F.sum("n").alias("count")), "pair-counts")
    first = F.shiftright("pair", 32).alias("a")
    best = F.broadcast(counts.groupBy(first).agg(F.max("count").alias("most")))  # at most one row per id of A
    counts = counts.select("pair", "count", first).join(best, "a").select("pair", "count", (F.col("count") == F.col("most")).alias("best"))
    answers = join_side(asked.select("block", "pair"), counts, ["pair"], tag="pair-counts")

    def add(left, right):
        if not left.num_rows:
            return pa.table({n: pa.array([], t) for n, t in (*((x, pa.int64()) for x in OUT[:-1]), (OUT[-1], pa.string()))})
        t = left.combine_chunks()
        pairs, _, many, which, size, kinds, times = _unpack(t.column("data")[0].as_buffer(), *KINDS)
        name = right.column("pair").to_numpy().view(np.uint64) if right.num_rows else pairs[:0]
        order = np.argsort(name)
        count = right.column("count").to_numpy()[order] if right.num_rows else np.zeros(0, np.int64)
        top = right.column("best").to_numpy(zero_copy_only=False)[order].astype(np.int64) if right.num_rows else count
        part = np.repeat(np.arange(len(many)), many)
        sums, bests = np.zeros(len(many), np.int64), np.zeros(len(many), np.int64)
        np.add.at(sums, part, count[which])
        np.add.at(bests, part, top[which])
        doc = np.repeat(np.arange(len(size)), size)
        total, most = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)
        np.add.at(total, doc, sums[kinds] * times)
        np.add.at(most, doc, bests[kinds] * times)
        own = [t.column(c).combine_chunks().flatten() for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")]
        return pa.table([*own, pa.array(most), pa.array(total), t.column("groups_sha256").combine_chunks().flatten()], names=OUT)

    return (blocks.groupBy("block").cogroup(answers.groupBy("block"))
            .applyInArrow(add, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"))


OUT = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
