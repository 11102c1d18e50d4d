"""Co-partitioned manifest store (JN8, JN9, V9).

A stored manifest is a table bucketed and sorted by path.  Whatever is joined
to it by path (a plan, a keeper, a destination) is dealt to the manifest's
buckets; the manifest's own rows, its content column among them, stay where
they are.  ``advance`` writes the manifest after a plan as the next version in
the same layout: rows that keep their path are written from the bucket they are
in, and only moved rows are shuffled to their new one.

A version is a folder ``v<number>`` with the rows, and beside it a row that says
into how many buckets it is cut and its schema; ``open`` reads both, so another
session finds the layout again.  ``plain`` reads the same files without the layout.  It is what verbs
that union and group should read: Spark 4.1 takes unions of bucketed scans as
grouped by the bucket column.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from filelake.plans import apply as AP

BUCKETS = 8                # at least
BUCKET_ROWS = 5_000_000    # rows for each further bucket


class ManifestStore:
    """One version of a stored manifest."""

    def __init__(self, spark: SparkSession, location: str, version: int, buckets: int, schema: StructType):
        self.spark, self.location, self.version, self.buckets, self.schema = spark, location.rstrip("/"), version, buckets, schema
        self.folder = f"{self.location}/v{version:06d}"
        self._table: str | None = None

    # --- writing ---------------------------------------------------------------

    @classmethod
    def create(cls, manifest: DataFrame, location: str, buckets: int | None = None) -> ManifestStore:
        """Version 0: the one time all rows are shuffled by path."""
        if buckets is None:
            buckets = max(BUCKETS, -(-manifest.select("path").count() // BUCKET_ROWS))
        store = cls(manifest.sparkSession, location, 0, buckets, manifest.schema)
        store._write(manifest.repartition(buckets, "path"), "overwrite")
        store._commit()
        return store

    def _write(self, rows: DataFrame, mode: str) -> None:
        self._table = self._table or f"manifest_{uuid.uuid4().hex}"
        (rows.write.format("parquet").mode(mode).option("path", f"{self.folder}/rows")
         .bucketBy(self.buckets, "path").sortBy("path").saveAsTable(self._table))

    def _commit(self) -> None:
        """A version exists once its layout row does."""
        row = (self.version, self.buckets, self.schema.json())
        self.spark.createDataFrame([row], "version int, buckets int, schema string").coalesce(1).write.parquet(f"{self.folder}/layout")

    # --- reading ---------------------------------------------------------------

    @classmethod
    def open(cls, spark: SparkSession, location: str, version: int) -> ManifestStore:
        layout = spark.read.parquet(f"{location.rstrip('/')}/v{version:06d}/layout").first()
        return cls(spark, location, version, layout["buckets"], StructType.fromJson(json.loads(layout["schema"])))

    def plain(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(f"{self.folder}/rows")

    def keyed(self) -> DataFrame:
        """The rows as a bucketed scan, for joins by path."""
        if self._table is None:
            fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in self.schema.fields)
            name = f"manifest_{uuid.uuid4().hex}"
            self.spark.sql(f"CREATE TABLE {name} ({fields}) USING parquet CLUSTERED BY (path) SORTED BY (path) "
                           f"INTO {self.buckets} BUCKETS LOCATION '{self.folder}/rows'")
            self._table = name
        return self.spark.table(self._table)

    def forget(self) -> None:
        """Drops the session's name for the table; the files stay."""
        if self._table is not None:
            self.spark.sql(f"DROP TABLE IF EXISTS {self._table}")
            self._table = None

    # --- plans -----------------------------------------------------------------

    def apply(self, plan: DataFrame) -> DataFrame:
        """``apply_plan`` without a shuffle of manifest rows."""
        return AP.apply_plan(self.keyed(), plan)

    def verify(self, plan: DataFrame) -> DataFrame:
        """``verify_plan`` of a plan against this version; plan rows move, the
        manifest's do not."""
        return AP.verify_plan(plan, self.keyed())

    def advance(self, plan: DataFrame) -> ManifestStore:
        """The next version: this one after ``plan``."""
        manifest = self.keyed()
        after = ManifestStore(self.spark, self.location, self.version + 1, self.buckets, self.schema)
        stay, moved = self.advanced(plan)
        after._write(stay.select(*manifest.columns), "overwrite")
        after._write(moved.select(*manifest.columns).repartition(self.buckets, "path"), "append")
        after._commit()
        return after

    def advanced(self, plan: DataFrame) -> tuple[DataFrame, DataFrame]:
        """The rows after ``plan``: those that keep their path, in their buckets,
        and those that get another."""
        manifest = self.keyed()
        sets = {new: old for new, old in AP.ATTRIBUTES.items() if new in plan.columns and old in manifest.columns}
        p = plan.where(F.col("action").isin([*AP.DELETE_ACTIONS, *AP.MOVE_ACTIONS, "chmod"])).select(
            "path", F.col("action").alias("_action"), (F.col("dest") if "dest" in plan.columns else F.lit(None).cast("string")).alias("_dest"),
            *[F.col(new).alias(f"_{new}") for new in sets])
        # without a hint a small plan is broadcast, which moves the manifest as little
        joined = manifest.join(p, "path", "left").where(~F.coalesce(F.col("_action").isin(list(AP.DELETE_ACTIONS)), F.lit(False)))
        goes = F.col("_action").isin(list(AP.MOVE_ACTIONS)) & (F.col("_dest") != F.col("path"))
        stay = joined.where(~F.coalesce(goes, F.lit(False)))
        stay = stay.withColumns({old: F.coalesce(F.col(f"_{new}").cast(manifest.schema[old].dataType), F.col(old)) for new, old in sets.items()})
        # a row that goes is found from the plan's side: only such rows are read out of the buckets
        moved = AP.apply_plan(manifest.join(p.where(F.col("_action").isin(list(AP.MOVE_ACTIONS)) & (F.col("_dest") != F.col("path"))).select("path"), "path", "left_semi"),
                              plan)
        return stay, moved
