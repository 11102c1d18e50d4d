"""Deterministic sharded WARC writer and reader.

Records are in one total order: page_id (nulls first), payload digest, md5 of
the url.  Rows equal in all three are the same record, written as often as it
occurs.  Shards are cut from that order by exact byte sums: narrow keys with
their sizes are summed along the order (inside ranges, plus the ranges' totals),
and every ``shard_bytes`` a new shard begins.  The first key of each shard, at most
``MOST_SHARDS`` of them, is the bound by which pages find their shard.  So
neither a sample, nor the input's splits, nor the order of arrival changes a file.

Which pages are revisits is decided on digests alone: the largest page_id of
each digest, summed map-side, joined back to the narrow keys.  A decision goes to
the shard of the page it is about and is sorted just before it, so that
payloads are shuffled once.  A record that occurs more than ``HOT_COPIES`` times is
taken out and comes back as pieces, a row with a number of copies each.

A task writes its shard as files that roll at a compressed size, each record a
gzip member of its own.  A file is written under a temporary name and renamed
when complete; names, ids, dates and headers derive from the data, so a task
that runs again leaves the same files.  The manifest, one row per file, is the
commit: readers open only files that it lists.

Defined results: a null html is an empty payload, a null url has no target
header; rows that share both the largest page_id and the payload are all
responses; a null page_id never counts as the largest.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from filelake.llm.common import by_value, shared_folder, small_batches, store
from filelake.session import join_side

by_value(__name__)

LEAST_BYTES = 1000
ROLL_BYTES = 16 << 20
SHARD_BYTES = 16 << 20
MOST_SHARDS = 100_000   # beyond that shards get more bytes
HOT_COPIES = 10_000
HEAD_BYTES = 600        # counted for a record's headers
DATE = "2024-01-01T00:00:00Z"  # fixed value: equal input gives equal files
NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # fixed value: RFC 4122, URLs
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"  # fixed value: WARC 1.1
MANIFEST = "shard int, seq int, path string, records long, bytes long, sha256 string"


def open_store(where: str):
    """(file system, path) for a folder or file of the shared storage."""
    import pyarrow.fs as pafs
    if where.startswith("file:"):
        where = "/" + where[5:].lstrip("/")
    return pafs.FileSystem.from_uri(where) if "://" in where else (pafs.LocalFileSystem(), where)


def record_id(page_id, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'{page_id}/{digest}')}>"


def warc_record(page_id, url, payload: bytes, digest: str, refers_to) -> bytes:
    """One record, headers regenerated; a revisit carries no payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
            f"WARC-Record-ID: {record_id(page_id, digest)}", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to, digest)}", f"X-Refers-To-Page: {refers_to}"]
    if page_id is not None:
        head.append(f"X-Page: {page_id}")
    head += [f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{hashlib.sha1(block).hexdigest()}",
             "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def revisits(keys: DataFrame, least: int = LEAST_BYTES) -> DataFrame:
    """page_id, digest, uk, refers_to of every key whose payload a larger page_id has too."""
    big = keys.where(F.col("n_bytes") >= least)
    keep = store(big.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.sum("copies").alias("c"))
                 .where("c > 1 and refers_to is not null").select("digest", "refers_to"), "keepers")
    return (join_side(big, keep, ["digest"], tag="keepers").where(~F.col("page_id").eqNullSafe(F.col("refers_to")))
            .select("page_id", "digest", "uk", "refers_to"))


KEY = ["page_id", "digest", "uk", "tie"]


def key_bytes(page, digest, uk, tie) -> np.ndarray:
    """The keys (Arrow arrays, tie a number or an array) as byte strings of the
    same order."""
    known = np.asarray(page.is_valid())
    number = page.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64) ^ np.uint64(1 << 63)
    number[~known] = 0
    n = len(known)
    parts = [known.astype(np.uint8).reshape(n, 1), number.astype(">u8").view(np.uint8).reshape(n, 8),
             *(np.array(c.to_pylist(), f"S{w}").view(np.uint8).reshape(n, w) for c, w in ((digest, 40), (uk, 32))),
             np.broadcast_to(np.asarray(tie), n).astype(">u4").view(np.uint8).reshape(n, 4)]
    return np.ascontiguousarray(np.hstack(parts)).view("S85").reshape(n) if n else np.zeros(0, "S85")


def shard_bounds(pieces: DataFrame, shard_bytes: int, most: int = MOST_SHARDS) -> np.ndarray:
    """First key of each shard; ``pieces``: the keys and ``bytes``."""
    parts = int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    t = store(pieces.select(*KEY, "bytes").repartitionByRange(parts, *KEY).withColumn("_p", F.spark_partition_id()), "record-ranges")
    total = t.agg(F.sum("bytes")).first()[0] or 0
    if not total:
        return np.zeros(0, "S85")
    per = max(shard_bytes, -(-total // most))
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    first = F.broadcast(t.groupBy("_p").agg(F.sum("bytes").alias("b")).select("_p", F.coalesce(F.sum("b").over(before), F.lit(0)).alias("from")))
    here = Window.partitionBy("_p").orderBy(*KEY).rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum("bytes").over(here), F.lit(0)) + F.col("from")
    cuts = t.join(first, "_p").withColumn("shard", F.floor(start / per)).groupBy("shard").agg(F.min(F.struct(*KEY)).alias("k"))
    rows = cuts.select("k.*").toArrow().combine_chunks()  # at most ``most`` rows
    col = [rows.column(c).combine_chunks() for c in KEY]
    return np.sort(key_bytes(*col[:3], col[3].to_numpy(zero_copy_only=False)))


def write_archive(pages: DataFrame, where: str, roll_bytes: int = ROLL_BYTES, shard_bytes: int = SHARD_BYTES, hot_copies: int = HOT_COPIES) -> DataFrame:
    """Writes all pages below ``where`` and returns the manifest."""
    payload = F.coalesce(F.col("html").cast("binary"), F.lit(b""))
    rows = small_batches(pages).select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    uk = F.when(F.col("url").isNull(), "").otherwise(F.md5(F.col("url").cast("binary")))
    rows = rows.withColumns({"digest": F.sha1("payload"), "uk": uk})
    keys = store(rows.select("page_id", "digest", "uk", F.octet_length("payload").cast("long").alias("n_bytes"))
                 .groupBy("page_id", "digest", "uk").agg(F.first("n_bytes").alias("n_bytes"), F.count(F.lit(1)).alias("copies")), "record-keys")
    cuts = F.explode(F.sequence(F.lit(0), F.floor((F.col("copies") - 1) / hot_copies).cast("int"))).alias("tie")
    pieces = keys.select("*", cuts).withColumn("n", F.least(F.lit(hot_copies).cast("long"), F.col("copies") - F.col("tie").cast("long") * hot_copies))
    bounds = shard_bounds(pieces.withColumn("bytes", F.col("n") * (F.col("n_bytes") + HEAD_BYTES)), shard_bytes)

    none = F.lit(None)
    refers = revisits(keys)
    one, kind = F.lit(1).cast("long").alias("n"), F.lit(1).alias("tag")
    same = lambda a, b: a["page_id"].eqNullSafe(b["page_id"]) & (a["digest"] == b["digest"]) & (a["uk"] == b["uk"])
    hot = store(keys.where(F.col("copies") > hot_copies).select("page_id", "digest", "uk"), "hot-records")  # at most rows / hot_copies
    some = not hot.isEmpty()
    plain = rows.join(F.broadcast(hot), same(rows, hot), "left_anti") if some else rows
    both = plain.select("page_id", "digest", "uk", F.lit(0).alias("tie"), kind, "url", "payload", none.cast("long").alias("refers_to"), one)
    both = both.unionByName(refers.select("page_id", "digest", "uk", F.lit(0).alias("tie"), F.lit(0).alias("tag"), none.cast("string").alias("url"),
                                          none.cast("binary").alias("payload"), "refers_to", one))
    if some:
        full = rows.join(F.broadcast(hot), same(rows, hot), "left_semi").groupBy("page_id", "digest", "uk").agg(F.first("url").alias("url"), F.first("payload").alias("payload"))
        again = pieces.where(F.col("copies") > hot_copies)
        full = again.join(full, same(again, full)).select(again["page_id"], again["digest"], again["uk"], "tie", "n", "url", "payload")
        full = full.join(refers, same(full, refers), "left").select(full["page_id"], full["digest"], full["uk"], "tie", kind, "url", "payload", "refers_to", "n")
        both = both.unionByName(full)

    @F.arrow_udf("int")
    def shard_of(page: pa.Array, digest: pa.Array, uk: pa.Array, tie: pa.Array) -> pa.Array:
        keys = key_bytes(page, digest, uk, tie.to_numpy(zero_copy_only=False))
        return pa.array(np.maximum(np.searchsorted(bounds, keys, "right") - 1, 0).astype(np.int32))

    def run(batches):
        from pyspark import TaskContext
        fs, top = open_store(where)
        attempt = TaskContext.get().taskAttemptId()
        state = {"shard": None, "seq": 0, "out": None}

        def close():
            s = state
            s["out"].close()
            name = f"{top}/data/shard-{s['shard']:06d}-{s['seq']:04d}.warc.gz"
            fs.move(s["temp"], name)
            row = (s["shard"], s["seq"], name, s["records"], s["bytes"], s["sha"].hexdigest())
            state.update(seq=s["seq"] + 1, out=None)
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, (pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.string()))],
                                              names=["shard", "seq", "path", "records", "bytes", "sha256"])

        decided = (None, None, None, None)
        for batch in batches:
            cols = [batch.column(c) for c in ("page_id", "digest", "uk", "tag", "url", "payload", "refers_to", "n", "shard")]
            for i in range(batch.num_rows):
                page, digest, uk, tag, url, body, refers, copies, shard = (c[i].as_py() for c in cols)
                if not tag:
                    decided = (page, digest, uk, refers)
                    continue
                if shard != state["shard"]:
                    if state["out"] is not None:
                        yield close()
                    state.update(shard=shard, seq=0)
                if decided[:3] == (page, digest, uk):
                    refers = decided[3]
                z = zlib.compressobj(6, zlib.DEFLATED, 31)
                member = z.compress(warc_record(page, url, body, digest, refers)) + z.flush()
                for _ in range(copies):
                    if state["out"] is None:
                        fs.create_dir(f"{top}/data", recursive=True)
                        fs.create_dir(f"{top}/temp", recursive=True)
                        temp = f"{top}/temp/shard-{shard:06d}-{state['seq']:04d}-{attempt}"
                        state.update(out=fs.open_output_stream(temp, compression=None), temp=temp, records=0, bytes=0, sha=hashlib.sha256())
                    state["out"].write(member)
                    state["sha"].update(member)
                    state["records"] += 1
                    state["bytes"] += len(member)
                    if state["bytes"] >= roll_bytes:
                        yield close()
        if state["out"] is not None:
            yield close()

    placed = both.withColumn("shard", shard_of("page_id", "digest", "uk", "tie"))
    files = placed.repartitionById(max(1, len(bounds)), "shard").sortWithinPartitions("shard", *KEY, "tag").mapInArrow(run, MANIFEST)
    files.write.parquet(f"{where}/manifest")  # _SUCCESS in it is the commit
    return read_manifest(pages.sparkSession, where)


def read_manifest(spark: SparkSession, where: str) -> DataFrame:
    return spark.read.schema(MANIFEST).parquet(f"{where}/manifest")


def parse_records(stream, chunk: int = 1 << 20):
    """(headers, block) of every record; each gzip member is one record."""
    z, raw, data = zlib.decompressobj(31), [], b""
    while True:
        data = data or stream.read(chunk)
        if not data:
            if raw:
                raise ValueError("the file ends inside a record")
            return
        raw.append(z.decompress(data))
        data = b""
        if z.eof:
            data, whole = z.unused_data, b"".join(raw)
            head, _, rest = whole.partition(b"\r\n\r\n")
            lines = head.decode().split("\r\n")
            fields = dict(x.split(": ", 1) for x in lines[1:])
            n = int(fields["Content-Length"])
            if lines[0] != "WARC/1.1" or rest[n:] != b"\r\n\r\n":
                raise ValueError("not a WARC record")
            yield fields, rest[:n]
            z, raw = zlib.decompressobj(31), []


def read_archive(manifest: DataFrame) -> DataFrame:
    """page_id, url, payload (null for a revisit), payload_bytes,
    payload_digest, record_type, refers_to of every record that the manifest
    lists; digests are computed anew and a record or file that does not match
    its own raises."""

    def run(batches):
        for batch in batches:
            for path, records in zip(batch.column("path").to_pylist(), batch.column("records").to_pylist()):
                fs, p = open_store(path)
                out, size, seen = [], 0, 0
                with fs.open_input_stream(p, compression=None) as f:
                    for fields, block in parse_records(f):
                        seen += 1
                        http, _, body = block.partition(b"\r\n\r\n")
                        digest = fields["WARC-Payload-Digest"].split(":")[1]
                        refers = fields.get("X-Refers-To-Page")
                        n = int(dict(x.split(b": ", 1) for x in http.split(b"\r\n")[1:])[b"Content-Length"])
                        if hashlib.sha1(block).hexdigest() != fields["WARC-Block-Digest"].split(":")[1] or (
                                fields["WARC-Type"] == "response" and (hashlib.sha1(body).hexdigest() != digest or len(body) != n)):
                            raise ValueError(f"a record of {p} does not match its digest")
                        out.append((int(fields["X-Page"]) if "X-Page" in fields else None, fields.get("WARC-Target-URI"),
                                    body if fields["WARC-Type"] == "response" else None, n, digest, fields["WARC-Type"],
                                    int(refers) if refers else None))
                        size += len(block)
                        if size > 8 << 20:
                            yield rows(out)
                            out, size = [], 0
                if seen != records:
                    raise ValueError(f"{p} has {seen} records, the manifest says {records}")
                if out:
                    yield rows(out)

    kinds = [("page_id", pa.int64()), ("url", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()),
             ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())]

    def rows(out):
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, (_, t) in enumerate(kinds)], names=[k for k, _ in kinds])

    files = manifest.select("path", "records").repartition(64, "path")
    return files.mapInArrow(run, "page_id long, url string, payload binary, payload_bytes long, "
                                 "payload_digest string, record_type string, refers_to long")


def round_trip(pages: DataFrame) -> DataFrame:
    manifest = write_archive(pages, shared_folder(pages.sparkSession, "warc"))
    return read_archive(manifest).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
