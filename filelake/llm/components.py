"""Connected components of a link table, as Spark joins.

Each round maps every node to the least node among itself and its neighbours
and rewrites the links by that map; links inside one image vanish.  Rounds
alternate between the natural order (a star closes at once) and a hashed one
(a long chain loses a constant share of its nodes), so the number of rounds
grows with the logarithm of the longest path.  The maps are then chained.
Every round is written to the shared folder; nothing is gathered in one place.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filelake.llm.common import by_value, store

by_value(__name__)


def components(links: DataFrame) -> DataFrame:
    """node, label for every node of ``links`` (u, v: long); nodes with one
    label are connected.  Null ends and loops are ignored."""
    e = store(links.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(),
              "links")
    maps = []
    while True:
        r = len(maps)
        rank = (lambda c: F.struct(F.col(c).alias("h"), F.col(c).alias("n"))) if r % 2 == 0 else (
            lambda c, r=r: F.struct(F.xxhash64(F.lit(r), F.col(c)).alias("h"), F.col(c).alias("n")))
        both = e.select("u", "v").unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        m = store(both.groupBy("u").agg(F.min(rank("v")).alias("b"))
                  .select(F.col("u").alias("node"), F.least(F.col("b"), rank("u")).getField("n").alias("to")), "map")
        maps.append(m)
        moved = (e.join(m.select(F.col("node").alias("u"), F.col("to").alias("a")), "u")
                 .join(m.select(F.col("node").alias("v"), F.col("to").alias("b")), "v")
                 .where("a <> b").select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct())
        e = store(moved, "links")
        if e.isEmpty():
            break
    label = maps[-1].select("node", F.col("to").alias("label"))
    for m in reversed(maps[:-1]):
        nxt = label.select(F.col("node").alias("to"), "label")
        label = store(m.join(nxt, "to", "left").select("node", F.coalesce("label", "to").alias("label")), "label")
    return label


def spanning_links(n: int, near) -> list[tuple[int, int]]:
    """Links that span the components of points 0..n-1; ``near(i, rest)`` says
    which of ``rest`` are linked with i.  A point that has been reached is not
    compared again, so a dense group costs little more than one pass."""
    rest, out = np.arange(n), []
    while len(rest):
        todo, rest = [rest[0]], rest[1:]
        while todo and len(rest):
            i = todo.pop()
            hit = near(i, rest)
            if hit.any():
                found = rest[hit]
                out += [(i, j) for j in found.tolist()]
                todo += found.tolist()
                rest = rest[~hit]
    return out
