"""Deterministic sharded WARC archives.

Records are range-sorted by key: counts of bytes per key block give cumulative sizes, which cut the
key range into shards of about ``shard_bytes`` (no sampling, so the same input gives the same
shards). Each shard is written by one task as files rolled at ``file_bytes`` compressed bytes, one
gzip member per record; headers, lengths and digests are made anew from the payload. A file is
written under a temporary name and renamed when it is whole, and the manifest, written last, names
the files with their sizes and digests; readers open only what the manifest names. A lost executor's
task writes the same bytes again, so attempts can't disagree.

Of records with equal payloads of at least ``least`` bytes the smallest key is a response and the others
are revisits that refer to it; smaller payloads are always responses.

Defined results. A null payload is empty. A null key sorts last within equal payloads and is written
without a key header. Rows with the smallest key twice are both responses. A null address becomes
``urn:none``. Extra columns are ignored; an empty table writes an empty manifest.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lotweave.llm.common import lookup, written

LEAST, SHARD_BYTES, FILE_BYTES, BLOCKS = 100, 32 << 20, 16 << 20, 1 << 14
#: Compressed bytes that a reader hands to zlib at a time.
PIECE_BYTES = 1 << 13
#: Revisits whose plan may be broadcast.
MOST_BROADCAST = 1_000_000
DATE = "2020-01-01T00:00:00Z"
#: Hadoop's names of object stores, and those that Arrow knows.
HADOOP_NAMES = {"s3a": "s3", "s3n": "s3", "abfs": "abfss"}
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "file string, shard bigint, records bigint, bytes bigint, sha256 string"


# ---------------------------------------------------------------- records

def record_id(key: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{key}/{digest}')}>"


def record(key: int | None, url: str | None, payload: bytes | None, digest: str, refers_to: int | None, size: int) -> bytes:
    """One uncompressed record; a revisit (``refers_to`` given) keeps the HTTP head only."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: %d\r\n\r\n" % size
    block = http if refers_to is not None else http + payload
    address = (url or "urn:none").replace("\r", "%0D").replace("\n", "%0A")
    head = [("WARC-Type", "revisit" if refers_to is not None else "response"), ("WARC-Record-ID", record_id(key, digest)), ("WARC-Date", DATE),
            ("WARC-Target-URI", address), ("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", f"sha256:{digest}"),
            ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}"), ("X-Payload-Length", str(size))]
    if key is not None:
        head.append(("X-Record-Key", str(key)))
    if refers_to is not None:
        head += [("WARC-Profile", _PROFILE), ("WARC-Refers-To", record_id(refers_to, digest)), ("X-Refers-To-Key", str(refers_to))]
    head.append(("Content-Length", str(len(block))))
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)  # a gzip head without a time
    return pack.compress(data) + pack.flush()


def members(data: bytes):
    """The records of a file, one gzip member each; fed in pieces, since zlib copies what lies behind a member."""
    view, at = memoryview(data), 0
    while at < len(view):
        unpack, parts = zlib.decompressobj(31), []
        while at < len(view) and not unpack.eof:
            piece = view[at:at + PIECE_BYTES]
            parts.append(unpack.decompress(piece))
            at += len(piece) - len(unpack.unused_data)
        yield b"".join(parts) + unpack.flush()


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and block of a record; raises when lengths or digests don't hold."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError(f"not a WARC record: {lines[0]!r}")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    block = rest[:int(fields["Content-Length"])]
    if rest[len(block):] != b"\r\n\r\n" or f"sha256:{hashlib.sha256(block).hexdigest()}" != fields["WARC-Block-Digest"]:
        raise ValueError(f"damaged record {fields.get('WARC-Record-ID')}")
    return fields, block


# ---------------------------------------------------------------- writing

def qualified(spark: SparkSession, folder: str) -> str:
    """The folder with its scheme; without one it lies where Spark's own writers would put it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString()


def _open(folder: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a qualified folder (file, hdfs, s3, gs and their Hadoop names)."""
    scheme, _, rest = folder.partition(":")
    if scheme == "file":
        return pafs.LocalFileSystem(), "/" + rest.lstrip("/")
    return pafs.FileSystem.from_uri(f"{HADOOP_NAMES.get(scheme, scheme)}:{rest}")


class _Roller:
    """Files of one shard, rolled by compressed size."""

    def __init__(self, folder: str, shard: int, most: int):
        self.fs, self.path = _open(folder)
        self.shard, self.most, self.number, self.out = shard, most, 0, None

    def add(self, data: bytes):
        done = None
        if self.out is not None and self.bytes + len(data) > self.most:
            done = self.close()
        if self.out is None:
            self.name = f"shard-{self.shard:06d}-{self.number:04d}.warc.gz"
            self.temporary = f"{self.path}/_temporary/{self.name}.{uuid.uuid4().hex}"
            self.out, self.sum, self.bytes, self.records = self.fs.open_output_stream(self.temporary), hashlib.sha256(), 0, 0
        self.out.write(data)
        self.sum.update(data)
        self.bytes += len(data)
        self.records += 1
        return done

    def close(self):
        if self.out is None:
            return None
        self.out.close()
        self.fs.move(self.temporary, f"{self.path}/{self.name}")  # an earlier attempt's equal file is replaced
        self.out, self.number = None, self.number + 1
        return self.name, self.shard, self.records, self.bytes, self.sum.hexdigest()


def plan_records(pages: DataFrame, key: str, payload: str, least: int = LEAST) -> DataFrame:
    """key, digest, size and refers_to of every row; payloads stay out of the shuffles."""
    body = F.coalesce(F.col(payload), F.lit("")).cast("binary")
    rows = written(pages.select(F.col(key).cast("bigint").alias("key"), F.sha2(body, 256).alias("digest"), F.octet_length(body).cast("bigint").alias("size")), "digests")
    large = rows.filter(F.col("size") >= least)
    groups = written(large.groupBy("digest").agg(F.min("key").alias("first"), F.count(F.lit(1)).alias("copies")), "payloads")
    total = groups.agg(F.coalesce(F.sum("copies"), F.lit(0))).first()[0]
    known = lookup(large.select("key", "digest", "size"), groups, ["digest"], ["first"], "copies", total)
    refers = F.when(~F.col("key").eqNullSafe(F.col("first")), F.col("first"))
    every = known.select("key", "digest", "size", refers.alias("refers_to"))
    return every.unionByName(rows.filter(F.col("size") < least).select("key", "digest", "size", F.lit(None).cast("bigint").alias("refers_to")))


def shards(rows: DataFrame, shard_bytes: int) -> tuple[DataFrame, int, int]:
    """(block, shard) for at most ``BLOCKS`` key blocks, with the first key and the width of a block."""
    ends = rows.agg(F.coalesce(F.min("key"), F.lit(0)), F.coalesce(F.max("key"), F.lit(0))).first()
    width = max(1, -(-(ends[1] - ends[0] + 1) // BLOCKS))
    sizes = rows.filter("key is not null").groupBy(_block(F.col("key"), ends[0], width).alias("block")).agg(F.sum("size").alias("bytes"))
    line = Window.orderBy("block")  # BLOCKS rows at most
    return sizes.select("block", F.floor((F.sum("bytes").over(line) - F.col("bytes")) / F.lit(shard_bytes)).alias("shard")), ends[0], width


def _block(key: Column, first: int, width: int) -> Column:
    return F.floor((key - F.lit(first)) / F.lit(width)).cast("bigint")


def write(pages: DataFrame, folder: str, key: str = "page_id", url: str = "url", payload: str = "html", least: int = LEAST,
          shard_bytes: int = SHARD_BYTES, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write one record per row below ``folder`` and commit the manifest, which is returned."""
    folder = qualified(pages.sparkSession, folder)
    planned = written(plan_records(pages, key, payload, least), "records")
    blocks, first, width = shards(planned, shard_bytes)
    # rows with one key and digest are equal records, so the pair finds the row's plan
    plan = planned.filter("refers_to is not null").select(F.col("key").alias("_key"), F.col("digest").alias("_digest"), "refers_to").distinct()
    if plan.count() <= MOST_BROADCAST:  # else payloads are shuffled for this join as well
        plan = F.broadcast(plan)
    body = F.coalesce(F.col(payload), F.lit("")).cast("binary")
    rows = pages.select(F.col(key).cast("bigint").alias("key"), F.col(url).cast("string").alias("url"), body.alias("payload"),
                        F.sha2(body, 256).alias("digest"), F.octet_length(body).cast("bigint").alias("size"))
    rows = rows.join(plan, rows["key"].eqNullSafe(plan["_key"]) & (rows["digest"] == plan["_digest"]), "left")
    rows = rows.select("key", "url", F.when(F.col("refers_to").isNull(), F.col("payload")).alias("payload"), "digest", "size", "refers_to", _block(F.col("key"), first, width).alias("block"))
    placed = rows.join(F.broadcast(blocks), "block", "left").withColumn("shard", F.coalesce("shard", F.lit(0)))  # BLOCKS rows at most
    columns = ["shard", "key", "url", "payload", "digest", "size", "refers_to"]
    order = ["shard", F.col("key").asc_nulls_last(), "digest", "url"]
    fs, path = _open(folder)
    fs.create_dir(f"{path}/_temporary", recursive=True)

    def run(batches):
        roller, done = None, []
        for batch in batches:
            for shard, k, address, data, digest, size, refers_to in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if roller is None or roller.shard != shard:
                    if roller is not None:
                        done.append(roller.close())
                    roller = _Roller(folder, shard, file_bytes)
                done.append(roller.add(member(record(k, address, data, digest, refers_to, size))))
        if roller is not None:
            done.append(roller.close())
        done = [d for d in done if d]
        yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string()))],
                                         names=["file", "shard", "records", "bytes", "sha256"])

    made = placed.select(*columns).repartition("shard").sortWithinPartitions(*order).mapInArrow(run, MANIFEST)
    made.write.parquet(f"{folder}/_manifest")  # the commit: every file is whole by now
    return manifest(pages.sparkSession, folder)


# ---------------------------------------------------------------- reading

#: Tasks of a reading stage, at most; beyond it a task reads several files.
MOST_TASKS = 50_000
RECORDS = "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, payload binary"


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(MANIFEST).parquet(f"{folder}/_manifest")


def read(spark: SparkSession, folder: str) -> DataFrame:
    """The records of all files that the manifest names; every length and digest is checked on the way."""
    folder = qualified(spark, folder)

    def run(batches):
        fs, path = _open(folder)
        for batch in batches:
            for name, expected in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with fs.open_input_stream(f"{path}/{name}", compression=None) as f:
                    data = f.read()
                if hashlib.sha256(data).hexdigest() != expected:
                    raise ValueError(f"{name} differs from the manifest")
                rows = []
                for raw in members(data):
                    fields, block = parse(raw)
                    payload = block.partition(b"\r\n\r\n")[2] if fields["WARC-Type"] == "response" else None
                    digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
                    if payload is not None and hashlib.sha256(payload).hexdigest() != digest:
                        raise ValueError(f"payload of {fields['WARC-Record-ID']} differs from its digest")
                    number = lambda k: int(fields[k]) if k in fields else None
                    rows.append((number("X-Record-Key"), fields["WARC-Target-URI"], number("X-Payload-Length"), digest, fields["WARC-Type"], number("X-Refers-To-Key"), payload))
                    if len(rows) == 1000:
                        yield _rows(rows)
                        rows = []
                if rows:
                    yield _rows(rows)

    files = manifest(spark, folder).select("file", "sha256")
    # a number of its own keeps a table of few small rows from being coalesced into one task
    tasks = min(MOST_TASKS, max(1, files.count()))
    return files.repartitionByRange(tasks, "file").mapInArrow(run, RECORDS)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary())
    names = [c.split()[0] for c in RECORDS.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=names)
