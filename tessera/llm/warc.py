"""WARC archives and their Merkle fixity audit.

Pages are written as WARC 1.1 resource records, each a gzip member, into one
file per task and replica, with an index of offsets beside each file. A
replica's tree has a leaf for each record's stored bytes; each node above
hashes the offset range and hash of up to ``FANOUT`` ordered children, up to
the root of the file. An audit joins the roots of two replicas and descends
only under nodes that differ, so intact files cost one comparison.

Defined cases: null URL or content is written as empty; control characters in
a URL, which no header may hold, are percent-encoded in the file and restored
on reading; repeated pages are records of their own, with ids of their own; a
record or file that one replica lacks differs, also if only the index is
missing; pages of any length are one record; an empty table makes no file and
an empty audit; other columns of the pages are not read.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import re
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import cut, fresh_folder

FANOUT = 16
#: Suspects are broadcast to a level's nodes up to so many.
MAX_BROADCAST_NODES = 200_000
NODE = "file string, level int, idx long, start long, end long, hash binary"


#: Of records whose pages have no time of their own; equal in all replicas.
EPOCH = "1970-01-01T00:00:00Z"
_CONTROL = "[\\x00-\\x1f\\x7f]"


def record(page_id, url: str, content: bytes, place: str = "0") -> bytes:
    """One WARC record; ``place`` (file and number) sets records of repeated pages apart."""
    escaped = ""
    if re.search(_CONTROL, url):
        url, escaped = re.sub(f"{_CONTROL}|%", lambda m: f"%{ord(m[0]):02X}", url), "X-Escaped: 1\r\n"
    unique = uuid.uuid5(uuid.NAMESPACE_URL, f"{place}:{page_id}")
    head = f"WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:uuid:{unique}>\r\nWARC-Date: {EPOCH}\r\nWARC-Target-URI: {url}\r\n{escaped}X-Page-ID: {page_id}\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(content)}\r\n\r\n"
    return head.encode("utf-8", "replace") + content + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and content of one record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    headers = {k: v.removeprefix(" ") for k, _, v in (x.partition(":") for x in lines[1:])}
    if "X-Escaped" in headers:
        headers["WARC-Target-URI"] = re.sub("%([01][0-9A-F]|7F|25)", lambda m: chr(int(m[1], 16)), headers["WARC-Target-URI"])
    return headers, rest[: int(headers["Content-Length"])]


def member(data: bytes) -> bytes:
    """The record as a gzip member without a time, so replicas have equal bytes."""
    out = io.BytesIO()
    with gzip.GzipFile(fileobj=out, mode="wb", compresslevel=1, mtime=0) as f:
        f.write(data)
    return out.getvalue()


def write_archive(pages: DataFrame, folders: list[str], damage=None) -> DataFrame:
    """Write page_id, url and html into every replica folder; returns (file, records).

    ``damage(page_id, stored, replica)`` may return other bytes to store; it
    stands for decay in tests of the audit.
    """

    def run(batches):
        stores = [fs.FileSystem.from_uri(f) for f in folders]
        name, outs, offsets, ids = uuid.uuid4().hex, [], [0], []
        for batch in batches:
            for page_id, url, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary()).to_pylist()):
                if not outs:
                    for store, root in stores:
                        store.create_dir(root, recursive=True)
                        outs.append(store.open_output_stream(f"{root}/{name}.warc.gz", compression=None))
                stored = member(record(page_id, url or "", html or b"", f"{name}:{len(ids)}"))
                for k, out in enumerate(outs):
                    out.write(damage(page_id, stored, k) if damage else stored)
                offsets.append(offsets[-1] + len(stored))
                ids.append(page_id)
        if outs:
            for out, (store, root) in zip(outs, stores):
                out.close()
                with store.open_output_stream(f"{root}/{name}.idx", compression=None) as index:
                    index.write(np.array(offsets, "<i8").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([len(ids)], pa.int64())], ["file", "records"])

    return cut(pages.select("page_id", "url", "html").mapInArrow(run, "file string, records long"))


def members_of(store, root: str, name: str):
    """(offset, stored bytes) of each record of a file, read in order."""
    with store.open_input_file(f"{root}/{name}.idx") as index:
        offsets = np.frombuffer(index.read(), "<i8")
    with store.open_input_file(f"{root}/{name}.warc.gz") as source:
        for a, b in zip(offsets.tolist(), offsets[1:].tolist()):
            yield a, source.read(b - a)


def nodes_of(leaves: list[tuple[int, int, bytes]]) -> list[tuple[int, int, int, int, bytes]]:
    """(level, idx, start, end, hash) of the whole tree over ordered (start, end, hash)."""
    out, level, row = [], 0, leaves
    while True:
        out += [(level, i, *x) for i, x in enumerate(row)]
        if len(row) <= 1:
            return out
        groups = [row[i : i + FANOUT] for i in range(0, len(row), FANOUT)]
        row = [(g[0][0], g[-1][1], hashlib.sha256(b"".join(b"%d-%d:" % (a, b) + h for a, b, h in g)).digest()) for g in groups]
        level += 1


def _per_file(spark: SparkSession, files: DataFrame) -> DataFrame:
    names = files.select("file").repartition(max(1, min(files.count(), spark.sparkContext.defaultParallelism * 4)))
    return names


def merkle_tree(spark: SparkSession, files: DataFrame, folder: str) -> DataFrame:
    """All nodes of the trees of a replica's files; an unreadable file has no nodes."""

    def run(batches):
        store, root = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for name in batch.column("file").to_pylist():
                parts = store.get_file_info([f"{root}/{name}.warc.gz", f"{root}/{name}.idx"])
                if any(p.type != fs.FileType.File for p in parts):
                    continue
                nodes = nodes_of([(a, a + len(x), hashlib.sha256(x).digest()) for a, x in members_of(store, root, name)])
                level, idx, start, end, digest = (list(c) for c in zip(*nodes))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * len(nodes)), pa.array(level, pa.int32()), pa.array(idx, pa.int64()), pa.array(start, pa.int64()), pa.array(end, pa.int64()), pa.array(digest, pa.binary())],
                    ["file", "level", "idx", "start", "end", "hash"],
                )

    made = _per_file(spark, files).mapInArrow(run, NODE)
    path = fresh_folder(spark, "merkle")
    made.write.partitionBy("level").parquet(path)  # so that a level is read alone
    return spark.read.schema(NODE).parquet(path)


def audit(left: DataFrame, right: DataFrame) -> DataFrame:
    """(file, idx, start, end) of the records that differ between two trees."""
    tops = left.unionByName(right).groupBy("file").agg(F.max("level").alias("level"))
    depth = tops.agg(F.max("level")).first()[0]
    spark = left.sparkSession
    found = spark.createDataFrame([], "file string, idx long, start long, end long")
    if depth is None:
        return found
    suspects = None
    for level in range(depth, -1, -1):
        a = left.where(F.col("level") == level).select("file", "idx", "start", "end", "hash")
        b = right.where(F.col("level") == level).select("file", "idx", F.col("start").alias("s"), F.col("end").alias("e"), F.col("hash").alias("h"))
        roots = tops.where(F.col("level") == level).select("file", F.lit(0).cast("long").alias("idx"))
        look = roots if suspects is None else roots.union(suspects.select("file", F.explode(F.sequence(F.col("idx") * FANOUT, F.col("idx") * FANOUT + FANOUT - 1)).alias("idx")))
        if suspects is not None:  # of a level only the children of what differs are shuffled
            small = look.count() <= MAX_BROADCAST_NODES
            a, b = (x.join(F.broadcast(look) if small else look, ["file", "idx"], "left_semi") for x in (a, b))
        both = look.join(a, ["file", "idx"], "left").join(b, ["file", "idx"], "left").where("hash is not null or h is not null")
        differ = both.where(~(F.col("hash").eqNullSafe(F.col("h")) & F.col("start").eqNullSafe(F.col("s")) & F.col("end").eqNullSafe(F.col("e"))))
        suspects = cut(differ.select("file", "idx", F.coalesce("start", "s").alias("start"), F.coalesce("end", "e").alias("end")))
    return suspects


def read_records(spark: SparkSession, files: DataFrame, folder: str) -> DataFrame:
    """file, idx, page_id, url, content bytes and SHA-256 of the content of every record, unpacked from the files."""

    def run(batches):
        store, root = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for name in batch.column("file").to_pylist():
                rows = []
                for i, (_, stored) in enumerate(members_of(store, root, name)):
                    headers, content = parse(zlib.decompress(stored, 31))
                    key = headers["X-Page-ID"]
                    rows.append((name, i, None if key == "None" else int(key), headers["WARC-Target-URI"], len(content), hashlib.sha256(content).hexdigest()))
                cols = [list(c) for c in zip(*rows)]
                kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["file", "idx", "page_id", "url", "n_bytes", "sha256"])

    return _per_file(spark, files).mapInArrow(run, "file string, idx long, page_id long, url string, n_bytes long, sha256 string")
