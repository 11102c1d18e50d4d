"""An Elias-Fano n-gram trie over plain buffers.

A level is a monotone sequence of 64-bit values in Elias-Fano form: the low
bits packed one after another, the high parts as a unary bit vector with a
count of zeros before each word for select.  All parts of a trie lie in one
buffer (a memory map, an Arrow value, bytes) and are only viewed, not copied.

The trie of a bigram model has the contexts (64-bit word names), pointers to
each context's successors (monotone), and the successors by their names
relative to their context: rank * 2^40 + the name's upper 40 bits, which makes the
level monotone, and the lower 24 bits beside it, so that names are whole.  A lookup
finds the context, then the successor by search inside the context's range, then
the one of equal upper bits whose lower bits agree.  Probabilities are quantised
in logarithmic steps; counts have 64 bits.
"""

from __future__ import annotations

import numpy as np

from filelake.llm.common import by_value

by_value(__name__)

NAME_BITS = 40       # of a name in the monotone level; the other 24 stand beside it
STEPS = 32          # steps per factor of ten for probabilities, in two bytes
CODES = 300 * STEPS + 2  # down to 10^-300: none that a count can give is clipped
FINE = 4096         # steps per factor of ten for back-off weights, in two bytes
PART = 1 << 16


def _u(x):
    return np.uint64(x)


class EliasFano:
    """A non-decreasing sequence of uint64 values."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, zeros: np.ndarray):
        self.n, self.l, self.low, self.high, self.zeros = n, low_bits, low, high, zeros

    @classmethod
    def build(cls, values: np.ndarray) -> EliasFano:
        n = len(values)
        top = int(values[-1]) if n else 0
        l = max(0, (top // max(n, 1)).bit_length() - 1)
        i = np.arange(n, dtype=np.uint64)
        high = np.zeros(-(-(n + (top >> l) + 2) // 64) * 64, bool)
        high[((values >> _u(l)) + i).astype(np.int64)] = True
        words = np.packbits(high, bitorder="little").view(np.uint64)
        zeros = np.concatenate([[0], np.cumsum(64 - np.bitwise_count(words).astype(np.int64))]).astype(np.uint32)
        low = np.zeros(n * l // 64 + 2, np.uint64)
        if l and n:
            v = values & _u((1 << l) - 1)
            at = (i * _u(l) >> _u(6)).astype(np.int64)
            off = i * _u(l) & _u(63)
            first = np.flatnonzero(np.diff(at, prepend=-1))
            low[at[first]] |= np.bitwise_or.reduceat(v << off, first)
            over = np.flatnonzero(off + _u(l) > 64)
            low[at[over] + 1] |= v[over] >> (_u(64) - off[over])  # at most one value crosses a word's end
        return cls(n, l, low, words, zeros)

    def parts(self) -> list[np.ndarray]:
        return [np.array([self.n, self.l], np.uint64), self.low, self.high, self.zeros]

    @classmethod
    def view(cls, parts: list[np.ndarray]) -> EliasFano:
        return cls(int(parts[0][0]), int(parts[0][1]), *parts[1:])

    def lows(self, i: np.ndarray) -> np.ndarray:
        if not self.l:
            return np.zeros(len(i), np.uint64)
        bit = i.astype(np.uint64) * _u(self.l)
        at, off = (bit >> _u(6)).astype(np.int64), bit & _u(63)
        upper = np.where(off > 0, self.low[at + 1] << (_u(64) - np.maximum(off, _u(1))), _u(0))
        return (self.low[at] >> off | upper) & _u((1 << self.l) - 1)

    def _select(self, bits: np.ndarray, before: np.ndarray, k: np.ndarray) -> np.ndarray:
        """Position of the k-th (from 0) set bit of ``bits``; ``before`` counts those before each word."""
        out = np.empty(len(k), np.int64)
        for a in range(0, len(k), PART):
            q = k[a:a + PART]
            w = np.searchsorted(before, q, side="right") - 1
            word, left = bits[w].copy(), (q - before[w]).astype(np.int64)
            place = np.zeros(len(q), np.int64)
            for half in (32, 16, 8, 4, 2, 1):  # which half of the word has it
                count = np.bitwise_count(word & _u((1 << half) - 1)).astype(np.int64)
                up = left >= count
                left -= np.where(up, count, 0)
                place += np.where(up, half, 0)
                word = np.where(up, word >> _u(half), word)
            out[a:a + PART] = w * 64 + place
        return out

    def bucket(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index range of the values whose high part is h."""
        zero, flip = self.zeros.astype(np.int64), ~self.high
        inside = h < np.uint64(self.zeros[-1])
        hi = np.where(inside, h, 0).astype(np.int64)
        stop = self._select(flip, zero, hi) - hi
        prev = np.maximum(hi - 1, 0)
        start = np.where(hi > 0, self._select(flip, zero, prev) - prev, 0)
        return np.where(inside, start, self.n), np.where(inside, np.minimum(stop, self.n), self.n)

    def get(self, i: np.ndarray) -> np.ndarray:
        ones = np.arange(len(self.zeros), dtype=np.int64) * 64 - self.zeros
        return ((self._select(self.high, ones, i.astype(np.int64)) - i).astype(np.uint64) << _u(self.l)) | self.lows(i)

    def find(self, x: np.ndarray) -> np.ndarray:
        """Index of the first value >= x among those that share its high part
        (the successor, when it equals x), else -1."""
        i, end = self.bucket(x >> _u(self.l) if self.l else x)
        want = x & _u((1 << self.l) - 1)
        i, stop = i.copy(), end.copy()
        todo = np.flatnonzero(i < stop)
        while len(todo):  # by halves: a frequent context fills its buckets
            mid = (i[todo] + stop[todo]) >> 1
            less = self.lows(mid) < want[todo]
            i[todo] = np.where(less, mid + 1, i[todo])
            stop[todo] = np.where(less, stop[todo], mid)
            todo = todo[i[todo] < stop[todo]]
        out = np.full(len(x), -1, np.int64)
        at = np.flatnonzero(i < end)
        at = at[self.lows(i[at]) == want[at]]
        out[at] = i[at]
        return out


def quantise(p: np.ndarray) -> np.ndarray:
    """Code 0 for p = 0, else 1 + steps below one."""
    with np.errstate(divide="ignore"):
        return np.where(p > 0, np.clip(np.rint(-np.log10(p) * STEPS) + 1, 1, CODES - 1), 0).astype(np.uint16)


PROBABILITY = np.concatenate([[0.0], 10.0 ** (-np.arange(CODES - 1) / STEPS)])


def quantise_weight(w: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(-np.log10(np.maximum(w, 1e-15)) * FINE), 0, 65535).astype(np.uint16)


def weight(code: np.ndarray) -> np.ndarray:
    return 10.0 ** (-code.astype(np.float64) / FINE)


class Trie:
    """Contexts -> successors with quantised discounted probabilities, and per
    context its count and back-off weight."""

    def __init__(self, contexts, pointers, successors, tails, codes, counts, weights):
        self.contexts, self.pointers, self.successors = contexts, pointers, successors
        self.tails, self.codes, self.counts, self.weights = tails, codes, counts, weights

    @classmethod
    def build(cls, context: np.ndarray, name: np.ndarray, count: np.ndarray, discount: float) -> Trie:
        """Rows (context, 64-bit name, count > 0) in any order, each pair once."""
        order = np.lexsort((name, context))
        context, name, count = context[order], name[order], count[order]
        first = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]])) if len(context) else np.zeros(0, np.int64)
        size = np.diff(np.append(first, len(context)))
        total = np.add.reduceat(count, first) if len(first) else np.zeros(0, np.int64)
        rank = np.repeat(np.arange(len(first), dtype=np.uint64), size)
        cut = _u(64 - NAME_BITS)
        return cls(EliasFano.build(context[first]), EliasFano.build(np.append(first, len(context)).astype(np.uint64)),
                   EliasFano.build(rank << _u(NAME_BITS) | name >> cut), (name & ((_u(1) << cut) - _u(1))).astype(np.uint32),
                   quantise((count - discount) / np.repeat(total, size)), total.astype(np.uint64),
                   quantise_weight(discount * size / np.maximum(total, 1)))

    def to_bytes(self) -> bytes:
        parts = [*self.contexts.parts(), *self.pointers.parts(), *self.successors.parts(), self.tails, self.codes, self.counts, self.weights]
        head = np.array([len(p) for p in parts], np.uint64).tobytes()
        return head + b"".join(p.tobytes() + b"\0" * (-p.nbytes % 8) for p in parts)

    @classmethod
    def view(cls, buffer) -> Trie:
        """The trie in ``buffer`` (bytes or a memory map); nothing is copied."""
        kinds = [np.uint64, np.uint64, np.uint64, np.uint32] * 3 + [np.uint32, np.uint16, np.uint64, np.uint16]
        sizes = np.frombuffer(buffer, np.uint64, len(kinds))
        parts, at = [], 8 * len(kinds)
        for kind, n in zip(kinds, sizes.tolist()):
            parts.append(np.frombuffer(buffer, kind, n, at))
            at += -(-parts[-1].nbytes // 8) * 8
        ef = [EliasFano.view(parts[i:i + 4]) for i in (0, 4, 8)]
        return cls(*ef, *parts[12:])

    @classmethod
    def open(cls, path: str) -> Trie:
        """The trie of a file, memory-mapped."""
        return cls.view(np.memmap(path, np.uint8, "r"))

    def ask(self, contexts: np.ndarray, sizes: np.ndarray, names: np.ndarray):
        """For each context its count and weight code, and for each of its
        ``sizes`` names the probability code."""
        if not len(self.counts):
            return np.zeros(len(contexts), np.uint64), np.zeros(len(contexts), np.uint16), np.zeros(len(names), np.uint16)
        at = self.contexts.find(contexts)
        known = at >= 0
        place = np.maximum(at, 0)
        begin = self.pointers.get(place).astype(np.int64)
        end = self.pointers.get(place + 1).astype(np.int64)
        owner = np.repeat(np.arange(len(contexts)), sizes)
        ask = np.flatnonzero(known[owner])
        of = owner[ask]
        cut = _u(64 - NAME_BITS)
        want, tail = place[of].astype(np.uint64) << _u(NAME_BITS) | names[ask] >> cut, (names[ask] & ((_u(1) << cut) - _u(1))).astype(np.uint32)
        hit = self.successors.find(want)
        hit[(hit < begin[of]) | (hit >= end[of])] = -1
        wrong = np.flatnonzero((hit >= 0) & (self.tails[np.maximum(hit, 0)] != tail)) if len(hit) else hit
        while len(wrong):  # names of equal upper bits stand side by side
            hit[wrong] += 1
            over = hit[wrong] >= end[of[wrong]]
            next_ = np.where(over, 0, hit[wrong])
            gone = over | (self.successors.get(next_) != want[wrong])
            hit[wrong[gone]] = -1
            left = wrong[~gone]
            wrong = left[self.tails[hit[left]] != tail[left]]
        codes = np.zeros(len(names), np.uint16)
        codes[ask] = np.where(hit >= 0, self.codes[np.maximum(hit, 0)], 0) if len(self.codes) else 0
        return np.where(known, self.counts[place], 0).astype(np.uint64), np.where(known, self.weights[place], 0).astype(np.uint16), codes
