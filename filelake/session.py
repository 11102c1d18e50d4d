"""Session helpers.

Library code never creates its own session; it takes the caller's.  These
helpers exist for tests, the bench and command-line use on one machine.
"""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile

from pyspark.sql import SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "filelake") -> SparkSession:
    """A local session with the settings the operators assume (AQE on)."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("FILELAKE_DRIVER_MEMORY", "8g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the reliable checkpoint folder of the session.

    On a cluster ``spark.checkpoint.dir`` names a shared folder and is used
    as is.  Only when it is unset (local tests) a private scratch folder is
    created and registered.
    """
    try:
        sc = spark.sparkContext
    except Exception:  # noqa: BLE001 - Spark Connect: no context, only the conf
        configured = spark.conf.get("spark.checkpoint.dir", None)
        if not configured:
            raise RuntimeError("set spark.checkpoint.dir to a shared folder") from None
        return configured
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = sc.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="filelake-ckpt-")
        atexit.register(shutil.rmtree, configured, ignore_errors=True)
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def materialize(df, tag: str = "step"):
    """Write ``df`` as parquet under the session's checkpoint folder and read
    it back: lineage is cut, several later branches read the stored result
    instead of recomputing it, and the read gets column pruning and filter
    pushdown.  One job; the folder is the reliable (shared) checkpoint
    location, so a lost executor does not lose the data."""
    import uuid

    spark = df.sparkSession
    base = ensure_checkpoint_dir(spark).rstrip("/")
    location = f"{base}/filelake-{tag}-{uuid.uuid4().hex}"
    df.write.mode("overwrite").parquet(location)
    return spark.read.schema(df.schema).parquet(location)


def materialize_counted(df, tag: str = "step", **counts):
    """``materialize``, with the number of rows and ``counts`` (aggregates by
    name) observed while they are written: (stored, metrics).  No second pass
    and no further job; ``metrics["rows"]`` is always there."""
    from pyspark.sql import Observation
    from pyspark.sql import functions as F

    seen = Observation(f"{tag}-{len(counts)}")
    stored = materialize(df.observe(seen, F.count(F.lit(1)).alias("rows"), *[v.alias(k) for k, v in counts.items()]), tag)
    return stored, seen.get


# Row bound for broadcasting a checked build side.  The tables broadcast this
# way (clean paths, content keys with a keeper path, taken-slot lists) are
# roughly 100-150 bytes a row, so 500k rows stay near 50-75 MB per broadcast.
BROADCAST_ROWS = 500_000


def small_side(df, tag: str, max_rows: int = BROADCAST_ROWS, store: bool = True, at_most: int | None = None):
    """Write the build side of a join once and broadcast it only when its
    row count is at most ``max_rows``; above that return it plain so the
    planner keeps a shuffle join.  The size is counted, not estimated, and
    the big side is never shuffled first only to learn that a broadcast
    would have done.  ``store=False`` skips the write when ``df`` is cheap to
    recompute (derived from an already stored table); ``at_most``, a known bound
    on its rows, then saves the count where it is small enough."""
    from pyspark.sql import functions as F

    if store:
        side, seen = materialize_counted(df, tag)
        rows = seen["rows"]
    else:
        side, rows = df, at_most if at_most is not None and at_most <= max_rows else df.count()
    return F.broadcast(side) if rows <= max_rows else side


HOT_KEY_ROWS = 2_000_000  # rows of one key that are still left to one task


def join_side(rows, side, on: list[str], how: str = "inner", tag: str = "side",
              max_rows: int | None = None, hot_rows: int | None = None):
    """Join ``rows`` to ``side`` (at most one row per key, written once).  Up to
    ``max_rows`` rows of it are broadcast.  Beyond that it is a shuffle join of
    all but the keys with more than ``hot_rows`` rows: there are at most rows /
    ``hot_rows`` of those, a proven bound, so their rows stay where they are and
    get their part of the side by broadcast."""
    from pyspark.sql import functions as F

    max_rows = BROADCAST_ROWS if max_rows is None else max_rows
    hot_rows = HOT_KEY_ROWS if hot_rows is None else hot_rows
    side, seen = materialize_counted(side, tag)
    if seen["rows"] <= max_rows:
        return rows.join(F.broadcast(side), on, how)
    keys = rows.groupBy(*on).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > hot_rows).select(*on)
    hot = F.broadcast(materialize(keys, f"{tag}-hot"))
    few = F.broadcast(side.join(hot, on, "left_semi"))
    return (rows.join(hot, on, "left_anti").join(side, on, how)
            .unionByName(rows.join(hot, on, "left_semi").join(few, on, how)))
