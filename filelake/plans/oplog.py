"""Operation log (V10, SK3, SR4): an append-only table of status rows.

Each planned operation gets a stable ``op_id``; marking it done / failed
appends a row; recovery is a grouped ``max_by`` (partial-aggregated, so one
busy op_id cannot pin a task) picking each op's latest status.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

OP_LOG_SCHEMA = ("op_id STRING, op_type STRING, source STRING, dest STRING, hash STRING, "
                 "expected_size BIGINT, new_mode INT, new_uid INT, new_gid INT, status STRING, seq BIGINT, ts TIMESTAMP")
#: What an operation does and to what; every status row of it repeats this.
OPERATION = ("op_id", "op_type", "source", "dest", "hash", "expected_size", "new_mode", "new_uid", "new_gid")
LOGGED_ACTIONS = ("delete", "move", "rmdir", "chmod", "rename", "delete_duplicate", "collision_rename")


def op_id(action, path, run: str | None = None):
    """Deterministic id of one planned operation: sha-256 of 'action:path'
    (actions hold no ':', so the text is unambiguous), or of 'run/action:path'
    when the planning run has a name, so that work planned again is new work."""
    head = F.lit(f"{run}/") if run is not None else F.lit("")
    return F.sha2(F.concat(head, action, F.lit(":"), path), 256)


def op_log_from_plan(plan: DataFrame, seq: int = 0, run: str | None = None) -> DataFrame:
    """One 'pending' row per actionable plan row (keep/skip rows excluded), with
    all that is needed to carry it out: a chmod row has its mode and owner.
    ``run`` names the planning run: an earlier run's 'done' does not hide it."""
    def given(column, kind):
        return (F.col(column) if column in plan.columns else F.lit(None)).cast(kind)

    return plan.filter(F.col("action").isin(list(LOGGED_ACTIONS))).select(
        op_id(F.col("action"), F.col("path"), run).alias("op_id"),
        F.col("action").alias("op_type"), F.col("path").alias("source"),
        given("dest", "string").alias("dest"), given("md5", "string").alias("hash"), given("size", "bigint").alias("expected_size"),
        *[given(c, "int").alias(c) for c in ("new_mode", "new_uid", "new_gid")],
        F.lit("pending").alias("status"), F.lit(seq).cast("bigint").alias("seq"),
        F.current_timestamp().alias("ts"))


def op_log_update(entries: DataFrame, status: str, seq: int) -> DataFrame:
    """Status rows for ``entries`` (op_id ...): mark done / failed / any.
    Entries of a log without modes and owners have none."""
    old = [F.col(c) if c in entries.columns else F.lit(None).cast("int").alias(c) for c in OPERATION]
    return entries.select(*old, F.lit(status).alias("status"), F.lit(seq).cast("bigint").alias("seq"),
                          F.current_timestamp().alias("ts"))


def plan_from_log(entries: DataFrame) -> DataFrame:
    """The plan that carries out logged operations: path, action, dest, md5,
    size, new_mode, new_uid, new_gid."""
    return entries.select(F.col("source").alias("path"), F.col("op_type").alias("action"), "dest", F.col("hash").alias("md5"),
                          F.col("expected_size").alias("size"), "new_mode", "new_uid", "new_gid")


def latest_status(log: DataFrame, order_col: str = "seq") -> DataFrame:
    """op_id, status of each op's latest row (ties: greatest ts)."""
    key = F.struct(F.col(order_col), F.col("ts")) if "ts" in log.columns and order_col != "ts" else F.col(order_col)
    return log.groupBy("op_id").agg(F.max_by("status", key).alias("status"))


def op_log_recover(log: DataFrame, order_col: str = "seq") -> DataFrame:
    """Ops whose latest status is not 'done'."""
    return latest_status(log, order_col).filter(F.col("status") != "done")


def append_op_log(rows: DataFrame, location: str) -> None:
    """SK3: append rows to the log table."""
    rows.write.mode("append").parquet(location)


def load_op_log(spark: SparkSession, location: str) -> DataFrame:
    """SR4: read the log; a location that does not exist is an empty log.  Any
    other error (permission, network, a damaged file) is raised: taking it for
    "no pending work" would lose work."""
    try:
        return spark.read.schema(OP_LOG_SCHEMA).parquet(location)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], OP_LOG_SCHEMA)
