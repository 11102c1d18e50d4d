"""Real folder trees (SR1, SR2): a distributed listing and chunked hashing.

The listing walks the tree level by level: tasks list the folders of a level,
the entries found are written, and its folders are the next level.  The driver
keeps no index, only the number of levels.  A level is read in two passes: names
are counted per folder, then each folder is cut into ranges of about
``RANGE_NAMES`` names by hash, and a task reads the attributes of the names of
its range only, so a flat folder of millions of names is spread like many
small ones.  Every name is listed: hidden ones, names starting with ``_``, empty
folders and symbolic links (not followed).  What cannot be read is a row with
its ``error``: such a folder is never taken for an empty one.

``folder_listing`` is the same reading of one folder as a data source, with a
partition per range and size filters pushed into the readers.

Hashing streams each file in 64 KB chunks inside tasks (files larger than a
binary value cannot go through a column); it opens any URI pyarrow
understands.  It runs only on the rows handed to it -- dedup hands it the
files whose size is shared -- and those are dealt to partitions of about equal
bytes, a huge file alone.

The functions and classes that run in tasks are nested, so they travel by value
and the workers need no copy of this package.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from filelake.session import join_side, materialize

CHUNK_SIZE = 65536  # fixed value: read block of the hashing loop
LISTING_ROWS = 10_000  # entries handed on at a time, however large a folder is
RANGE_NAMES = 20_000   # names of a folder whose attributes one task reads
HASH_BYTES = 256 << 20  # of content for one hashing task
HASH_PARTS = 100_000    # hashing tasks at most; beyond that they get more bytes
TREE_SCHEMA = "path string, is_dir boolean, is_symlink boolean, size bigint, mtime_s bigint, mode int, uid int, gid int, error string"


def _lister():
    """names(folder): how many names it has; entries(folder, part, parts): those
    whose hash falls into the range, as TREE_SCHEMA tuples;
    batches(rows, step): Arrow batches of such tuples."""

    def hashed(name, parts):
        import zlib
        return zlib.crc32(name.encode("utf-8", "surrogateescape")) % parts

    def failed(path, e):
        return (path, True, False, None, None, None, None, None, f"{type(e).__name__}: {e.strerror or e}")

    def remote(folder):
        import pyarrow.fs as pafs
        fs, inner = pafs.FileSystem.from_uri(folder)
        scheme = folder[:folder.rindex(inner)]  # what the listed paths lack
        return scheme, fs.get_file_info(pafs.FileSelector(inner, recursive=False))

    def names(folder):
        import os
        try:
            if "://" in folder:
                return len(remote(folder)[1])
            with os.scandir(folder) as found:
                return sum(1 for _ in found)
        except OSError:
            return 0

    def entries(folder, part=0, parts=1):
        import os
        import stat
        if "://" in folder:
            import pyarrow.fs as pafs
            try:
                scheme, found = remote(folder)
            except OSError as e:
                if part == 0:
                    yield failed(folder, e)
                return
            for info in found:
                if parts > 1 and hashed(info.base_name, parts) != part:
                    continue
                d, seen = info.type == pafs.FileType.Directory, info.mtime
                yield (scheme + info.path, d, False, None if d else info.size, int(seen.timestamp()) if seen else None, None, None, None, None)
            return
        try:
            with os.scandir(folder) as found:
                for e in found:
                    if parts > 1 and hashed(e.name, parts) != part:
                        continue
                    try:
                        st = e.stat(follow_symlinks=False)
                    except FileNotFoundError:
                        continue  # gone since the folder was read
                    except OSError as x:
                        yield (e.path, e.is_dir(follow_symlinks=False), e.is_symlink(), *failed(e.path, x)[3:])
                        continue
                    d = stat.S_ISDIR(st.st_mode)
                    yield (e.path, d, e.is_symlink(), None if d else st.st_size, int(st.st_mtime),
                           stat.S_IMODE(st.st_mode), st.st_uid, st.st_gid, None)
        except FileNotFoundError:
            return
        except OSError as e:
            if part == 0:
                yield failed(folder, e)

    def batches(rows, step):
        import itertools

        import pyarrow as pa
        columns = ["path", "is_dir", "is_symlink", "size", "mtime_s", "mode", "uid", "gid", "error"]
        types = [pa.string(), pa.bool_(), pa.bool_(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.string()]
        while some := list(itertools.islice(rows, step)):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*some), types)], names=columns)

    return names, entries, batches


def folder_listing(pushdown: bool = False):
    """The data source ``folder_listing``: the entries of one folder (option
    ``path``), read in ``ranges`` partitions (an option; by default one for each
    ``RANGE_NAMES`` names).  Register it with ``spark.dataSource.register`` and read it
    with ``spark.read.format("folder_listing")``.  With
    ``spark.sql.python.filterPushdown.enabled`` a lower bound on ``size`` is applied where
    the entries are read."""
    from pyspark.sql.datasource import DataSource, DataSourceReader, GreaterThan, GreaterThanOrEqual, InputPartition

    names, entries, batches = _lister()
    per_range, step, schema = RANGE_NAMES, LISTING_ROWS, TREE_SCHEMA

    class Range(InputPartition):
        def __init__(self, part, parts):
            self.part, self.parts = part, parts

    class Reader(DataSourceReader):
        def __init__(self, options):
            self.path = options["path"].removeprefix("file://").rstrip("/") or "/"
            self.ranges = int(options["ranges"]) if "ranges" in options else None
            self.least = None

        def partitions(self):
            parts = self.ranges or max(1, -(-names(self.path) // per_range))
            return [Range(i, parts) for i in range(parts)]

        def read(self, partition):
            rows = entries(self.path, partition.part, partition.parts)
            if self.least is not None:
                rows = (r for r in rows if r[3] is not None and r[3] >= self.least)
            yield from batches(iter(rows), step)

    class Bounded(Reader):
        def pushFilters(self, filters):
            for f in filters:
                if isinstance(f, (GreaterThan, GreaterThanOrEqual)) and f.attribute == ("size",):
                    bound = f.value + isinstance(f, GreaterThan)
                    self.least = bound if self.least is None else max(self.least, bound)
                else:
                    yield f

    kind = Bounded if pushdown else Reader

    class FolderListing(DataSource):
        @classmethod
        def name(cls):
            return "folder_listing"

        def schema(self):
            return schema

        def reader(self, schema):
            return kind(self.options)

    return FolderListing


def list_tree(spark: SparkSession, root: str) -> DataFrame:
    """Every entry below ``root``: path, is_dir, is_symlink, size (null for
    folders), mtime_s, on a local or mounted file system mode, uid, gid (null
    elsewhere), and error: null, or why the entry's attributes or a folder's
    names could not be read.  ``root`` itself has a row only if it cannot be read."""
    root = root.removeprefix("file://").removeprefix("file:").rstrip("/") or "/"
    names, entries, to_batches = _lister()
    per_range, parts, step = RANGE_NAMES, int(spark.conf.get("spark.sql.shuffle.partitions")), LISTING_ROWS

    def ranges(batches):
        import pyarrow as pa
        for batch in batches:
            for folder in batch.column("path").to_pylist():
                n = max(1, -(-names(folder) // per_range))
                for a in range(0, n, 10_000):
                    k = min(n - a, 10_000)
                    yield pa.RecordBatch.from_arrays([pa.array([folder] * k), pa.array(range(a, a + k), pa.int32()), pa.array([n] * k, pa.int32())],
                                                     names=["path", "part", "parts"])

    def run(batches):
        for batch in batches:
            todo = zip(*(batch.column(c).to_pylist() for c in ("path", "part", "parts")))
            yield from to_batches((e for folder, part, n in todo for e in entries(folder, part, n)), step)

    folders, out = spark.createDataFrame([(root,)], "path string"), None
    while True:
        cut = folders.repartition(parts, "path").mapInArrow(ranges, "path string, part int, parts int")
        found = materialize(cut.repartition(parts, "path", "part").mapInArrow(run, TREE_SCHEMA), "listing")
        out = found if out is None else out.unionByName(found)
        # an entry with an error is not entered twice: a folder that cannot be read lists itself
        folders = found.filter("is_dir").join(folders, "path", "left_anti").select("path")
        if folders.isEmpty():
            break
    # a folder that cannot be read has the row its parent gave it and its own: the error joins the first
    errors = out.where("error is not null and is_dir").groupBy("path").agg(F.min("error").alias("_error"))
    if errors.isEmpty():
        return out
    errors = materialize(errors, "unreadable")
    known = out.where("error is null")
    rows = join_side(known, errors, ["path"], "left", "unreadable")
    lost = out.where("error is not null").join(known.select("path").distinct(), "path", "left_anti").dropDuplicates(["path"])
    return rows.withColumn("error", F.col("_error")).drop("_error").unionByName(lost)


def list_files(spark: SparkSession, root: str, min_size: int | None = None) -> DataFrame:
    """path, is_symlink, size, mtime_s, mode, uid, gid for every file below
    ``root``, and error: null, or why its attributes could not be read."""
    df = list_tree(spark, root).filter("not is_dir").drop("is_dir")
    return df if min_size is None else df.filter(F.col("size") >= min_size)


def byte_balanced(files: DataFrame, part_bytes: int = HASH_BYTES, most: int = HASH_PARTS) -> DataFrame:
    """The same rows in partitions of about equal ``size``: runs of at most
    ``part_bytes`` plus one file, and every file of ``part_bytes`` or more alone.

    Sizes are summed inside each partition of the written rows (in path order);
    partitions' numbers of runs, one row each, give the offsets.  No row is
    gathered and none but the narrow rows is shuffled."""
    t = materialize(files.withColumn("_p", F.spark_partition_id()), "to-hash")
    size = F.coalesce(F.greatest("size", F.lit(0)), F.lit(0))
    total = t.agg(F.sum(size)).first()[0] or 0
    per = max(part_bytes, -(-total // most))
    huge = size >= per
    before = Window.partitionBy("_p").orderBy("path").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("_p").orderBy("path").rowsBetween(Window.unboundedPreceding, 0)
    small = F.when(huge, 0).otherwise(size)
    # runs of small files first, then one for each huge file
    t = t.withColumns({"_run": F.floor(F.coalesce(F.sum(small).over(before), F.lit(0)) / per).cast("bigint"),
                       "_big": F.when(huge, F.sum(huge.cast("int")).over(upto) - 1)})
    counts = t.groupBy("_p").agg((F.max("_run") + 1).alias("_runs"), F.count("_big").alias("_bigs"))
    order = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    counts = materialize(counts.withColumn("_first", F.coalesce(F.sum(F.col("_runs") + F.col("_bigs")).over(order), F.lit(0))), "hash-runs")
    parts = counts.agg(F.sum(F.col("_runs") + F.col("_bigs"))).first()[0] or 1
    at = (F.col("_first") + F.when(F.col("_big").isNull(), F.col("_run")).otherwise(F.col("_runs") + F.col("_big"))).cast("int")
    rows = t.join(F.broadcast(counts), "_p").withColumn("_at", at)
    return rows.repartitionById(int(parts), "_at").select(*files.columns)


def hash_paths(files: DataFrame, chunk_size: int = CHUNK_SIZE, part_bytes: int = HASH_BYTES) -> DataFrame:
    """Add ``md5`` by reading each file (NULL when unreadable, PF1), in
    partitions of about ``part_bytes`` bytes where sizes are known."""
    if "size" in files.columns:
        files = byte_balanced(files, part_bytes)
    from pyspark.sql.types import StringType, StructField, StructType
    # a new StructType: ``schema.add`` would mutate the input's cached schema
    schema = StructType([*files.schema.fields, StructField("md5", StringType(), True)])

    def md5_of(uri):
        import hashlib

        import pyarrow.fs as pafs
        try:
            if "://" in uri:  # a real URI (percent-encoded as the listing gives it)
                fs, p = pafs.FileSystem.from_uri(uri)
            else:  # a plain local path: no URI parsing, so spaces etc. stay as they are
                fs, p = pafs.LocalFileSystem(), uri
            h = hashlib.md5()
            with fs.open_input_stream(p) as f:
                while block := f.read(chunk_size):
                    h.update(block)
            return h.hexdigest()
        except (OSError, ValueError):
            return None  # unreadable -> NULL, reported as a failed hash

    def run(batches):
        import pyarrow as pa
        for batch in batches:
            yield batch.append_column("md5", pa.array([md5_of(p) for p in batch.column("path").to_pylist()], pa.string()))

    return files.mapInArrow(run, schema)
