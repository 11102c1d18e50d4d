"""SimHash near-dedup with pigeonring filtering.

Fingerprints within ``distance`` bits are linked; a document's class is its
connected component.  The 64 bits are cut into ``distance`` + 1 segments on a
ring.  By the pigeonring principle some start segment exists from which the
differences summed over the next 1, 2, ... segments never exceed their
proportional share of the budget.  With budget 4 and 5 segments the shares are
0, 1, 2, 3 and 4 bits: the start segment is equal, and the next one differs by
at most one bit, so one of its halves is equal too.  Fingerprints therefore
meet under the key (start, start segment's bits, half, that half's bits), and
inside a key the longer chains are checked segment by segment before the full
distance.

Only distinct fingerprints are compared.  Inside a key links are emitted that
span its groups, not all pairs; a key with more than ``TILE`` fingerprints is
cut into tiles and every pair of tiles is a unit of work.

Defined results: a null, empty or blank text has fingerprint zero and links as
any other; a null doc_id is in its component but never names it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filelake.llm.common import by_value, small_batches, store, text_key
from filelake.llm.components import components, spanning_links

by_value(__name__)

SHINGLE = 4
DISTANCE = 4
SEED = 42
TILE = 4096


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, tk (second key), fp (the 64 bits as a signed long)."""

    def run(batches):
        import xxhash
        digest = xxhash.xxh64_intdigest
        for batch in batches:
            out = np.zeros(batch.num_rows, np.uint64)
            for i, t in enumerate(batch.column("_t").to_pylist()):
                toks = t.lower().split() if t else []
                if not toks:
                    continue
                n = max(1, len(toks) - shingle + 1)
                buf = b" ".join(toks)
                ends = np.cumsum(np.fromiter(map(len, toks), np.int64, len(toks)) + 1)
                starts = np.concatenate([[0], ends])[:n].tolist()
                stops = (ends[min(shingle, len(toks)) - 1:] - 1).tolist()
                h = np.fromiter([digest(buf[a:b], SEED) for a, b in zip(starts, stops)], np.uint64, n)
                ones = np.zeros(64, np.int64)
                for a in range(0, n, 1 << 16):
                    bits = np.unpackbits(h[a:a + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                    ones += bits.sum(axis=0, dtype=np.int32)
                out[i] = np.packbits(ones * 2 > n, bitorder="little").view(np.uint64)[0]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("tk"), pa.array(out.view(np.int64))], names=["doc_id", "tk", "fp"])

    return (small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), text_key(F.col("text")).alias("tk"), F.col("text").cast("binary").alias("_t"))
            .mapInArrow(run, "doc_id long, tk binary, fp long"))


def segments(distance: int = DISTANCE) -> list[tuple[int, int]]:
    """(shift, bits) of each segment of the ring."""
    m = distance + 1
    size = [64 // m + (i < 64 % m) for i in range(m)]
    return [(sum(size[:i]), s) for i, s in enumerate(size)]


def chain_keys(fps: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """start, key, fp: two rows per start segment of the ring."""
    seg = segments(distance)
    rows = []
    for i, (shift, bits) in enumerate(seg):
        nshift, nbits = seg[(i + 1) % len(seg)]
        low = nbits // 2
        own = F.shiftrightunsigned("fp", shift).bitwiseAND(F.lit((1 << bits) - 1))
        for half, (s, b) in enumerate(((nshift, low), (nshift + low, nbits - low))):
            part = F.shiftrightunsigned("fp", s).bitwiseAND(F.lit((1 << b) - 1))
            rows.append(F.struct(F.lit(i).alias("start"),
                                 ((F.shiftleft(F.lit(i * 2 + half).cast("long"), 40)) + F.shiftleft(own, 16) + part).alias("key")))
    return fps.select("fp", F.explode(F.array(*rows)).alias("k")).select("k.start", "k.key", "fp")


def near_links(fps: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """u, v: links that span the components within each key; ``fps`` has
    distinct ``fp``."""
    seg = segments(distance)
    keyed = store(chain_keys(fps, distance), "keys")
    counts = store(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "counts")
    tiles = F.ceil(F.col("n") / TILE).cast("int")
    own = F.pmod(F.xxhash64("fp"), tiles.cast("long")).cast("int")
    # tile a of t meets every tile: units (min, max) of a with 0..t-1
    units = F.transform(F.sequence(F.lit(0), tiles - 1), lambda o: F.struct(
        F.least(o, F.col("t")).alias("a"), F.greatest(o, F.col("t")).alias("b")))
    unit = (keyed.join(counts, "key").withColumn("t", own)
            .select("start", "key", "fp", "t", F.explode(units).alias("x"))
            .select("start", "key", "fp", "t", F.col("x.a").alias("a"), F.col("x.b").alias("b")))

    def links(fp, start):
        order = [(start + k) % len(seg) for k in range(len(seg))]
        share = [(k + 1) * distance // len(seg) for k in range(len(seg))]

        def near(i, rest):
            x = fp[rest] ^ fp[i]
            ok, total = np.ones(len(rest), bool), np.zeros(len(rest), np.int64)
            for s, most in zip(order, share):
                shift, bits = seg[s]
                total = total + np.bitwise_count((x >> np.uint64(shift)) & np.uint64((1 << bits) - 1))
                ok &= total <= most
                if not ok.any():
                    break
            return ok

        return spanning_links(len(fp), near)

    def run(batches):
        held = None

        def flush(cols):
            start, key, a, b, fp = cols
            cut = np.ones(len(key), bool)
            cut[1:] = (key[1:] != key[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1])
            at = np.append(np.flatnonzero(cut), len(key))
            size = np.diff(at)
            i = at[np.flatnonzero(size == 2)]  # most groups: one pair each
            i = i[np.bitwise_count(fp[i] ^ fp[np.minimum(i + 1, len(fp) - 1)]) <= distance]
            u, v = [fp[i]], [fp[np.minimum(i + 1, len(fp) - 1)]]
            for g in np.flatnonzero(size > 2):
                own = fp[at[g]:at[g + 1]]
                pairs = links(own, int(start[at[g]]))
                if pairs:
                    p = np.array(pairs)
                    u.append(own[p[:, 0]])
                    v.append(own[p[:, 1]])
            u, v = np.concatenate(u), np.concatenate(v)
            return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], names=["u", "v"])

        for batch in batches:
            cols = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("start", "key", "a", "b", "fp")]
            cols[4] = cols[4].view(np.uint64)
            if not len(cols[0]):
                continue
            if held is not None:
                cols = [np.concatenate(x) for x in zip(held, cols)]
            start, key, a, b, fp = cols
            # the last group may go on in the next batch
            same = (key == key[-1]) & (a == a[-1]) & (b == b[-1])
            last = int(np.flatnonzero(same)[0])
            held = [c[last:] for c in cols]
            if last:
                yield flush([c[:last] for c in cols])
        if held is not None:
            yield flush(held)

    return (unit.repartition("key", "a", "b").sortWithinPartitions("key", "a", "b", "fp")
            .select("start", "key", "a", "b", "fp").mapInArrow(run, "u long, v long"))


def simhash_classes(docs: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """doc_id, tk, fp, component_id (smallest doc_id of the component), grp (the
    component, known by one of its fingerprints), one row per row of ``docs``."""
    if distance != 4:
        raise ValueError("the chain keys are laid out for a distance of 4")
    marks = store(fingerprints(docs, shingle), "fingerprints")
    fps = store(marks.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    label = components(near_links(fps.select("fp"), distance))
    classes = store(fps.join(label.withColumnRenamed("node", "fp"), "fp", "left")
                    .select("fp", "least", F.coalesce("label", "fp").alias("label")), "classes")
    names = store(classes.groupBy("label").agg(F.min("least").alias("component_id")), "names")
    named = store(classes.join(names, "label").select("fp", "component_id", F.col("label").alias("grp")), "named")
    return marks.join(named, "fp").select("doc_id", "tk", "fp", "component_id", "grp")


def simhash_result(docs: DataFrame) -> DataFrame:
    r = simhash_classes(docs)
    return r.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
