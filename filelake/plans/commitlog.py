"""Operation log as numbered commits (SK3, SR4, V10).

A writer puts its rows into a folder of their own and then publishes a commit
file ``commits/<number>`` that names it.  Publishing never replaces: of writers
that race for a number one wins and the others take the next, so no rows are
lost and readers see whole commits only, in one order.  A caller that planned
on a version may say so (``expect``) and is told when another was published in
between.

``checkpoint`` folds the commits so far into one row per operation, its
latest; readers start from the last checkpoint and add the commits after it, so
the number of files they open does not grow with the log's age.  Folders of
folded commits and of writers that died are left to ``vacuum``.

The latest row of an operation is that of the highest (commit, seq, ts).
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filelake.plans import oplog as OL
from filelake.session import BROADCAST_ROWS

LOGGED = f"{OL.OP_LOG_SCHEMA}, commit_id STRING, folded BIGINT"


class ConflictError(RuntimeError):
    """Another version was published since the one the caller planned on."""


class _Folder:
    """The few operations the log needs, on the file system of the location,
    by Spark's own Hadoop client; local ones by links, which are exclusive."""

    def __init__(self, spark: SparkSession, location: str):
        self.jvm, self.conf = spark._jvm, spark._jsc.hadoopConfiguration()
        self.top = location.rstrip("/")
        self.fs = self._path("").getFileSystem(self.conf)
        uri = self.fs.getUri().toString()
        self.local = uri.startswith("file:")

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.top}/{name}" if name else self.top)

    def _plain(self, name: str) -> str:
        return self.fs.makeQualified(self._path(name)).toUri().getPath()

    def names(self, folder: str) -> list[str]:
        path = self._path(folder)
        if not self.fs.exists(path):
            return []
        return sorted(n for s in self.fs.listStatus(path) if not (n := s.getPath().getName()).startswith("."))

    def read(self, name: str) -> dict:
        stream = self.fs.open(self._path(name))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def publish(self, name: str, content: dict) -> bool:
        """Makes the file, whole, unless there is one: False."""
        if self.local:
            import os
            final = self._plain(name)
            os.makedirs(os.path.dirname(final), exist_ok=True)
            temp = f"{os.path.dirname(final)}/.{uuid.uuid4().hex}"
            with open(temp, "w") as f:
                f.write(json.dumps(content))
            try:
                os.link(temp, final)
                return True
            except FileExistsError:
                return False
            finally:
                os.unlink(temp)
        # a rename that does not replace: HDFS and its like
        temp = self._path(f"{name.rsplit('/', 1)[0]}/.{uuid.uuid4().hex}")
        stream = self.fs.create(temp, False)
        try:
            stream.write(bytearray(json.dumps(content).encode()))
        finally:
            stream.close()
        if not self.fs.exists(self._path(name)) and self.fs.rename(temp, self._path(name)):
            return True
        self.fs.delete(temp, False)
        return False

    def remove(self, folder: str) -> None:
        self.fs.delete(self._path(folder), True)


class CommitLog:
    def __init__(self, spark: SparkSession, location: str):
        self.spark, self.location = spark, location.rstrip("/")
        self.folder = _Folder(spark, self.location)

    # --- state -----------------------------------------------------------------

    def _numbers(self, kind: str) -> list[int]:
        return [int(n) for n in self.folder.names(kind)]

    def version(self) -> int:
        """Number of the last commit; 0 for an empty log."""
        return max(self._numbers("commits"), default=0)

    def _parts(self, upto: int | None = None) -> tuple[str | None, int, list[dict]]:
        """The checkpoint's folder, the commit it reaches to, the commits after it."""
        upto = self.version() if upto is None else upto
        base = max((n for n in self._numbers("checkpoints") if n <= upto), default=0)
        start = self.folder.read(f"checkpoints/{base:020d}")["data"] if base else None
        return start, base, [self.folder.read(f"commits/{n:020d}") for n in self._numbers("commits") if base < n <= upto]

    # --- writing ---------------------------------------------------------------

    def append(self, rows: DataFrame, expect: int | None = None) -> int:
        """Publishes ``rows`` (columns of the operation log) as the next commit
        and returns its number; raises ``ConflictError`` if ``expect`` is given
        and is not the version any more."""
        name = uuid.uuid4().hex
        (rows.withColumns({"commit_id": F.lit(name), "folded": F.lit(None).cast("bigint")})
         .select(*[f.name for f in self._schema()]).write.parquet(f"{self.location}/data/{name}"))
        while True:
            last = self.version()
            if expect is not None and last != expect:
                self.folder.remove(f"data/{name}")
                raise ConflictError(f"version {last}, planned on {expect}")
            if self.folder.publish(f"commits/{last + 1:020d}", {"version": last + 1, "data": name}):
                return last + 1

    def checkpoint(self) -> int:
        """Folds all commits so far into one row per operation."""
        upto = self.version()
        if not upto or upto in self._numbers("checkpoints"):
            return upto
        name = uuid.uuid4().hex
        rows = latest(self.read(upto)).select(*OL.OPERATION, "status", "seq", "ts", F.lit(name).alias("commit_id"), F.col("commit").alias("folded"))
        rows.write.parquet(f"{self.location}/data/{name}")
        if not self.folder.publish(f"checkpoints/{upto:020d}", {"version": upto, "data": name}):
            self.folder.remove(f"data/{name}")  # another folded the same commits
        return upto

    def vacuum(self) -> list[str]:
        """Removes data that no reader of the present version opens: folded
        commits and what was written without being published.  Not while
        writers are at work, whose rows are not published yet."""
        start, _, commits = self._parts()
        used = {start, *(c["data"] for c in commits)}
        gone = [n for n in self.folder.names("data") if n not in used]
        for n in gone:
            self.folder.remove(f"data/{n}")
        return gone

    # --- reading ---------------------------------------------------------------

    def _schema(self):
        return self.spark.createDataFrame([], LOGGED).schema

    def read(self, upto: int | None = None) -> DataFrame:
        """All status rows not superseded by a checkpoint, with ``commit``, the
        number of the commit each came by."""
        start, _, commits = self._parts(upto)
        places = [n for n in (start, *(c["data"] for c in commits)) if n is not None]
        if not places:
            return self.spark.createDataFrame([], f"{OL.OP_LOG_SCHEMA}, commit BIGINT")
        rows = self.spark.read.schema(self._schema()).parquet(*[f"{self.location}/data/{n}" for n in places])
        numbers = self.spark.createDataFrame([(c["data"], c["version"]) for c in commits], "commit_id string, _n bigint")
        if len(commits) <= BROADCAST_ROWS:
            numbers = F.broadcast(numbers)
        return (rows.join(numbers, "commit_id", "left").withColumn("commit", F.coalesce("folded", "_n"))
                .drop("commit_id", "folded", "_n"))

    def recover(self) -> DataFrame:
        """The latest row of every operation that is not done."""
        return latest(self.read()).where("status <> 'done'")


def latest(rows: DataFrame) -> DataFrame:
    """The last row of each operation; combined map-side, so an operation with
    many rows is no hot key."""
    order = F.struct("commit", "seq", "ts")
    columns = [c for c in rows.columns if c != "op_id"]
    return (rows.groupBy("op_id").agg(F.max_by(F.struct(*columns), order).alias("r"))
            .select("op_id", *[F.col(f"r.{c}").alias(c) for c in columns]))
