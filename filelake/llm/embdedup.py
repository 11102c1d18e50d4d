"""Embedding near-dedup by int8 tile products with error bounds.

A vector x is scaled to unit length and stored as int8 values q with one scale
s: x = s q + e, and the norm of e is known.  For two vectors

    x.y = s t (q.r) + s q.f + e.(t r) + e.f

so the product differs from s t (q.r) by at most |x'| |f| + |e| |y'| + |e||f|,
with x' = s q.  A pair is surely linked or surely not when the bound says so;
only the pairs in between are recomputed in double precision.

Vectors equal in label and all components are compared once and counted with
their multiplicity.  Within a label the distinct vectors are dealt to tiles of
about ``TILE`` rows, and each pair of tiles is a unit of work that returns link
counts per vector and links that span its groups, never the pairs themselves.
The int8 values, scales and norms travel to the units; a unit names the rows of
its undecided pairs, and a second pass over just those rows gets their doubles.

Defined results: a vector that is null, empty, zero, or has null or non-finite
components, or a null label, links with nothing; vectors of different lengths
do not link; rows with a null vec_id take part but name no component.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filelake.llm.common import by_value, small_batches, store
from filelake.llm.components import components
from filelake.session import join_side

by_value(__name__)

THRESHOLD = 0.98
TILE = 4096
STRIP = 512


def quantise(x: np.ndarray):
    """Unit vectors (doubles) to int8 values, scales, and norms of the parts
    kept and lost."""
    s = np.abs(x).max(axis=1) / 127.0
    q = np.rint(x / s[:, None]).astype(np.int8)
    kept = q * s[:, None]
    # the norms are widened a little to cover the rounding of their own sums
    return q, s, np.linalg.norm(kept, axis=1) * (1 + 1e-12), np.linalg.norm(x - kept, axis=1) * (1 + 1e-9) + 1e-15


def cosine(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Row by row, in double precision."""
    return (x * y).sum(axis=1) / (np.sqrt((x * x).sum(axis=1)) * np.sqrt((y * y).sum(axis=1)))


def possible_pairs(a, b, same: bool, threshold: float):
    """Strip by strip: (row indices of a, of b, surely linked) of all pairs that
    may reach the threshold; for one tile with itself only pairs i < j.  ``a`` and
    ``b`` are (int8 values, scales, norms kept, norms lost)."""
    (qa, sa, ka, ea), (qb, sb, kb, eb) = a, b
    # beyond that float32 sums of int8 products are not exact
    kind = np.float64 if qa.shape[1] * 127 * 127 >= 1 << 24 else np.float32
    fb = np.ascontiguousarray(qb.T.astype(kind))
    for at in range(0, len(qa), STRIP):
        rows = slice(at, at + STRIP)
        near = (qa[rows].astype(kind) @ fb) * (sa[rows, None] * sb[None, :])
        slack = ka[rows, None] * eb[None, :] + ea[rows, None] * (kb + eb)[None, :] + 1e-12
        i, j = np.nonzero(near + slack >= threshold)
        if same:
            up = j > i + at
            i, j = i[up], j[up]
        yield i + at, j, near[i, j] - slack[i, j] >= threshold + 1e-9


def _vectors(column):
    """Values, starts and lengths of a column of lists."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    at = column.offsets.to_numpy().astype(np.int64)
    return column.values.to_numpy(), at[:-1], np.diff(at)


def encode(batches):
    """Adds q (int8 values as bytes), scale, kept and lost to rows with a vector e."""
    for batch in batches:
        flat, at, size = _vectors(batch.column("e"))
        code, numbers = np.empty(len(at), object), np.empty((3, len(at)))
        for d in np.unique(size):
            of = np.flatnonzero(size == d)
            x = flat[at[of][:, None] + np.arange(d)]
            q, *numbers[:, of] = quantise(x / np.sqrt((x * x).sum(axis=1))[:, None])
            for i, row in zip(of, q):
                code[i] = row.tobytes()
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(code, pa.binary()), *(pa.array(n) for n in numbers)],
                                         names=[*batch.schema.names, "q", "scale", "kept", "lost"])


def _gather(node, copies, pairs):
    """Sums the links of a unit: nodes and counts of those with links, and
    links (u, v) that span the unit's groups."""
    count, group, u, v = np.zeros(len(node), np.int64), np.arange(len(node)), [], []
    for i, j in pairs:
        np.add.at(count, i, copies[j])
        np.add.at(count, j, copies[i])
        # of each row's links, one into every group that it isn't joined with yet
        cut = np.append(np.flatnonzero(np.diff(i, prepend=-1)), len(i))
        for k in range(len(cut) - 1):
            me, others = i[cut[k]], j[cut[k]:cut[k + 1]]
            new, where = np.unique(group[others], return_index=True)
            where = where[new != group[me]]
            if len(where):
                u += [node[me]] * len(where)
                v += node[others[where]].tolist()
                group[np.isin(group, new)] = group[me]
    some = np.flatnonzero(count)
    return node[some], count[some], u, v


def unit_links(table, label, a, b, threshold: float, exact: bool):
    """One pair of tiles.  First pass (not ``exact``): the sure links, and the
    rows (``open``) of pairs that the bound leaves undecided.  Second pass, over
    those rows with their doubles: the undecided pairs that are linked."""
    t = table.combine_chunks()
    node, copies, tile, *numbers = (t.column(c).to_numpy() for c in ("node", "copies", "t", "scale", "kept", "lost"))
    code = t.column("q").combine_chunks()
    start = np.frombuffer(code.buffers()[1], np.int32, len(code) + 1, code.offset * 4).astype(np.int64)
    q, size = np.frombuffer(code.buffers()[2] or b"", np.int8), np.diff(start)
    flat, at, _ = _vectors(t.column("e")) if exact else (None, None, None)
    is_open = np.zeros(len(node), bool)

    def pairs():
        for d in np.unique(size):
            of = np.flatnonzero(size == d)
            ia = of if a == b else of[tile[of] == a]
            ib = of if a == b else of[tile[of] == b]
            if not len(ia) or not len(ib):
                continue
            side = lambda i: (q[start[i][:, None] + np.arange(d)], *(n[i] for n in numbers))
            sa = side(ia)
            for i, j, sure in possible_pairs(sa, sa if a == b else side(ib), a == b, threshold):
                i, j = ia[i], ib[j]
                if not exact:
                    is_open[i[~sure]] = is_open[j[~sure]] = True
                    yield i[sure], j[sure]
                    continue
                i, j = i[~sure], j[~sure]
                ok = np.zeros(len(i), bool)
                for c in range(0, len(i), 1 << 16):
                    x, y = (flat[at[k[c:c + (1 << 16)]][:, None] + np.arange(d)] for k in (i, j))
                    ok[c:c + (1 << 16)] = cosine(x, y) >= threshold
                yield i[ok], j[ok]

    some, count, u, v = _gather(node, copies, pairs())
    ask = np.flatnonzero(is_open)
    n, m, k = len(some), len(u), len(ask)
    return pa.table({"label": pa.array([label] * (n + m + k), pa.int64()), "a": pa.array([a] * (n + m + k), pa.int32()), "b": pa.array([b] * (n + m + k), pa.int32()),
                     "t": pa.array([None] * (n + m) + tile[ask].tolist(), pa.int32()), "node": np.concatenate([some, np.array(u, np.int64), node[ask]]),
                     "count": pa.array(count.tolist() + [None] * (m + k), pa.int64()), "v": pa.array([None] * n + v + [None] * k, pa.int64())})


UNIT_ROWS = "label long, a int, b int, t int, node long, count long, v long"  # a count, a link to v, or (both null) an open row


def _usable(e):
    """A finite vector without null components whose length is not zero."""
    bad = F.exists(e, lambda v: v.isNull() | F.isnan(v))
    square = F.aggregate(e, F.lit(0.0), lambda s, v: s + v * v)
    return e.isNotNull() & ~bad & (square > 0) & (square < float("inf"))


def near_vectors(vecs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """vec_id, n_links, component_id, kept; one row per row of ``vecs``."""
    e = F.col("embedding").cast("array<double>")
    rows = vecs.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), e.alias("e"))
    usable = F.when(F.col("label").isNotNull() & F.coalesce(_usable(F.col("e")), F.lit(False)), F.col("e"))
    rows = rows.withColumn("e", F.transform(usable, lambda v: v + F.lit(0.0)))  # -0.0 becomes 0.0
    # two hashes name a vector: its class within the label
    tagged = store(rows.withColumn("node", F.when(F.col("e").isNotNull(), F.xxhash64("label", "e"))), "vectors")
    once = small_batches(tagged).where("node is not null").groupBy("label", "node").agg(
        F.count(F.lit(1)).alias("copies"), F.min("vec_id").alias("least"), F.first("e").alias("e"))
    distinct = store(once.mapInArrow(encode, "label long, node long, copies long, least long, e array<double>, q binary, scale double, kept double, lost double"), "distinct")
    per = distinct.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    tiles = F.ceil(F.col("n") / TILE).cast("int")
    units = F.transform(F.sequence(F.lit(0), tiles - 1), lambda o: F.struct(
        F.least(o, F.col("t")).alias("a"), F.greatest(o, F.col("t")).alias("b")))
    coded = ["node", "copies", "q", "scale", "kept", "lost"]
    # only these columns travel to the tiles: a byte a component
    unit = (join_side(distinct.select("label", *coded), per, ["label"], tag="labels")
            .withColumn("t", F.pmod(F.xxhash64("node", F.lit(7)), tiles.cast("long")).cast("int"))
            .select("label", *coded, "t", F.explode(units).alias("x"))
            .select("label", F.col("x.a").alias("a"), F.col("x.b").alias("b"), "t", *coded))

    def run(exact):
        return lambda key, table: unit_links(table, *(k.as_py() for k in key), threshold, exact)

    first = store(unit.groupBy("label", "a", "b").applyInArrow(run(False), UNIT_ROWS), "tiles")
    # the doubles of the rows that a unit left open, once per unit
    ask = first.where("count is null and v is null").select("label", "a", "b", "t", "node").join(distinct.select("e", *coded), "node")
    second = store(ask.groupBy("label", "a", "b").applyInArrow(run(True), UNIT_ROWS), "recomputed")
    out = first.unionByName(second)
    label = components(out.where("v is not null").select(F.col("node").alias("u"), "v"))
    counts = out.where("count is not null").groupBy("node").agg(F.sum("count").alias("others"))
    classes = store(distinct.select("node", "copies", "least").join(counts, "node", "left").join(label, "node", "left")
                    .select("node", "copies", "least", F.coalesce("others", F.lit(0)).alias("others"),
                            F.coalesce("label", "node").alias("grp")), "classes")
    names = store(classes.groupBy("grp").agg(F.min("least").alias("component_id")), "names")
    named = store(classes.join(names, "grp").select("node", "copies", "others", "component_id"), "named")
    r = join_side(tagged.where("node is not null").select("vec_id", "node"), named, ["node"], tag="vectors").unionByName(
        tagged.where("node is null").select("vec_id", "node"), allowMissingColumns=True)
    comp = F.when(F.col("node").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return r.select("vec_id", F.coalesce(F.col("copies") - 1 + F.col("others"), F.lit(0)).cast("long").alias("n_links"),
                    comp.alias("component_id"), F.coalesce(F.col("vec_id") == comp, F.lit(False)).alias("kept"))
