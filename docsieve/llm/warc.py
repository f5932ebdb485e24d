"""Deterministic sharded WARC writer, and the reader of what it wrote.

Records are range-sorted by page id into shards whose bounds come from the ids alone; each task streams
its shards into files that roll at a compressed size, one gzip member per record. Record ids, HTTP
headers, lengths and digests are made anew from the payloads. Files appear under temporary names that are
an attempt's own; the rows that describe them are fixed in a checkpoint, then each file is renamed, and
the manifest is written last. Readers see only files of the manifest, and the same pages give the same
bytes, whatever was retried.

Of records with equal payloads of ``min_bytes`` at least, that with the largest page id holds the
payload, and the others are revisits of it. That is decided on rows of id and digest. The digests of the
largest groups (``MOST_HEAVY``) are broadcast, so that their revisits' payloads aren't shuffled; those of
smaller groups, if there are more, meet their decision in the one shuffle by shard.

Defined cases: a null html is an empty payload, a null url is written as ``urn:page:`` and the id, and a
null id (smaller than any other) leaves its header out and goes to the first shard. Rows that repeat the
winner's id and payload are responses too. Other columns of the input, of whatever name, aren't read. A
payload must fit a Python worker. An empty table gives a manifest without files. The output must be a place that executors
reach by pyarrow's file systems (a shared mount, HDFS or an object store).
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docsieve.llm.common import cut

ROLL_BYTES = 32 << 20
SHARD_BYTES = 16 << 20
SAMPLE_PER_SHARD = 64
MOST_HEAVY = 100_000
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
FILES = "shard int, seq int, name string, temporary string, bytes long, records long, sha256 string"
_FILE_SCHEMA = pa.schema(
    [("shard", pa.int32()), ("seq", pa.int32()), ("name", pa.string()), ("temporary", pa.string())]
    + [("bytes", pa.int64()), ("records", pa.int64()), ("sha256", pa.string())]
)


def sized(pages: DataFrame) -> DataFrame:
    """``page_id``, ``url``, ``payload``, ``sha1`` and ``length`` of each page."""
    payload = F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8")
    return pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload")
    ).withColumns({"sha1": F.unhex(F.sha1("payload")), "length": F.octet_length("payload").cast("long")})


def shared_payloads(slim: DataFrame, min_bytes: int) -> DataFrame:
    """``sha1``, ``winner`` and ``n`` of the payloads that occur twice or more."""
    rows = slim.where(F.col("length") >= min_bytes)
    return rows.groupBy("sha1").agg(F.max("page_id").alias("winner"), F.count(F.lit(1)).alias("n")).where("n > 1")


def shard_bounds(slim: DataFrame) -> np.ndarray:
    """Page ids at which shards begin: quantiles of a sample that the ids alone decide.

    The sample, ``SAMPLE_PER_SHARD`` ids for each ``SHARD_BYTES``, is ranked where it lies; of each shard the driver
    gets one id of eight bytes: half a millionth of the payloads.
    """
    total = slim.agg(F.sum("length").alias("n"), F.count("page_id").alias("ids")).first()
    shards = max(1, -(-(total["n"] or 0) // SHARD_BYTES))
    share = min(1.0, SAMPLE_PER_SHARD * shards / max(total["ids"], 1))
    least = F.col("page_id").isNotNull() & (F.pmod(F.xxhash64("page_id"), F.lit(1 << 30)) <= int(share * (1 << 30)))
    sample = slim.where(least).select("page_id").repartitionByRange("page_id").sortWithinPartitions("page_id")
    sample = cut(sample.withColumn("part", F.spark_partition_id()))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    counts = sample.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    starts = counts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    n = sample.count()
    rank = F.row_number().over(Window.partitionBy("part").orderBy("page_id")) - 1 + F.col("start")
    ranked = sample.join(F.broadcast(starts), "part").select("page_id", rank.alias("rank"))
    # A shard begins where rank * shards / n passes the next whole number.
    begins = F.expr(f"rank > 0 AND (rank * {shards}) div {max(n, 1)} > ((rank - 1) * {shards}) div {max(n, 1)}")
    bounds = ranked.where(begins).select("page_id").distinct()
    return np.sort(bounds.toArrow().column(0).to_numpy())


def sharded(rows: DataFrame, bounds: np.ndarray) -> DataFrame:
    """Adds ``shard``, the number of bounds up to the page id; 0 without an id."""
    shared = rows.sparkSession.sparkContext.broadcast(bounds)

    @F.pandas_udf("int")
    def shard(ids: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(shared.value, ids.to_numpy(), "right").astype(np.int32))

    return rows.withColumn("shard", F.when(F.col("page_id").isNull(), 0).otherwise(shard(F.coalesce("page_id", F.lit(0)))))


def decide(rows: DataFrame, shared: DataFrame, shards: int, most: int = MOST_HEAVY) -> DataFrame:
    """Rows of ``sized`` with a ``shard``, dealt and ordered by it; ``payload`` is null for revisits, ``refers_to`` for responses.

    A row of ``kind`` 0 says of the pages with its id and digest, which follow it, what they refer to.
    """
    revisit = F.col("winner").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("winner"))
    heavy = shared.orderBy(F.desc("n"), "sha1").limit(most).select("sha1", "winner")
    marked = rows.join(F.broadcast(heavy), "sha1", "left").withColumn("refers_to", F.when(revisit, F.col("winner")))
    kept = F.when(F.col("refers_to").isNull(), F.col("payload"))
    columns = ["shard", "page_id", "url", kept.alias("payload"), "sha1", "length", "refers_to", F.lit(1).alias("kind")]
    out = marked.select(*columns)
    if shared.count() > most:
        slim = rows.select("shard", "page_id", "sha1").distinct().join(heavy.select("sha1"), "sha1", "left_anti")
        others = slim.join(shared, "sha1").where(revisit).withColumn("refers_to", F.col("winner"))
        nothing = {"url": "string", "payload": "binary", "length": "long"}
        found = others.withColumns({c: F.lit(None).cast(t) for c, t in nothing.items()}).withColumn("kind", F.lit(0))
        out = out.unionByName(found.select(out.columns))
    order = [F.col("shard"), F.col("page_id").asc_nulls_first(), F.col("sha1"), F.col("kind"), F.col("url")]
    return out.repartitionById(shards, "shard").sortWithinPartitions(*order)


def base32(sha1: bytes) -> str:
    return base64.b32encode(sha1).decode()


def record_id(page_id: int | None, sha1: bytes, kind: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}:{sha1.hex()}:{kind}')}>"


def record(row: dict, date: str) -> bytes:
    """A WARC record with headers that are derived from the row."""
    kind = "revisit" if row["payload"] is None else "response"
    block, sha1 = b"", row["sha1"]
    if kind == "response":
        sha1 = hashlib.sha1(row["payload"]).digest()
        head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(row['payload'])}\r\n\r\n"
        block = head.encode() + row["payload"]
    uri = "".join(c if c > " " else f"%{ord(c):02X}" for c in row["url"] or f"urn:page:{row['page_id']}")
    headers = {
        "WARC-Type": kind,
        "WARC-Record-ID": record_id(row["page_id"], sha1, kind),
        "WARC-Date": date,
        "WARC-Target-URI": uri,
        "WARC-Payload-Digest": f"sha1:{base32(sha1)}",
        "WARC-Block-Digest": f"sha1:{base32(hashlib.sha1(block).digest())}",
    }
    if row["page_id"] is not None:
        headers["X-Page-Id"] = str(row["page_id"])
    if kind == "revisit":
        headers |= {
            "WARC-Profile": PROFILE,
            "WARC-Refers-To": record_id(row["refers_to"], sha1, "response"),
            "X-Refers-To-Page-Id": str(row["refers_to"]),
            "X-Payload-Length": str(row["length"]),
        }
    headers |= {"Content-Type": "application/http; msgtype=response", "Content-Length": str(len(block))}
    lines = "".join(f"{k}: {v}\r\n" for k, v in headers.items())
    return f"WARC/1.1\r\n{lines}\r\n".encode() + block + b"\r\n\r\n"


def info(name: str, date: str) -> bytes:
    body = b"format: WARC File Format 1.1\r\n"
    headers = f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>\r\n"
    headers += f"WARC-Date: {date}\r\nWARC-Filename: {name}\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(body)}\r\n\r\n"
    return headers.encode() + body + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)  # a gzip member without a time
    return packer.compress(data) + packer.flush()


class RollingFile:
    """Writes one shard's records to temporary files, each of ``roll`` compressed bytes or one record more."""

    def __init__(self, place: fs.FileSystem, root: str, shard: int, roll: int, date: str):
        self.place, self.root, self.shard, self.roll, self.date, self.seq, self.out = place, root, shard, roll, date, 0, None

    def add(self, data: bytes) -> Iterator[tuple]:
        if self.out is None:
            self.name = f"part-{self.shard:05d}-{self.seq:05d}.warc.gz"
            self.temporary = f"_temporary/{self.name}.{uuid.uuid4().hex}"
            self.place.create_dir(f"{self.root}/_temporary", recursive=True)
            self.out = self.place.open_output_stream(f"{self.root}/{self.temporary}", compression=None)
            self.bytes, self.records, self.sha = 0, 0, hashlib.sha256()
            self._put(member(info(self.name, self.date)))
        self._put(member(data))
        self.records += 1
        if self.bytes >= self.roll:
            yield self.close()

    def _put(self, raw: bytes) -> None:
        self.out.write(raw)
        self.bytes += len(raw)
        self.sha.update(raw)

    def close(self) -> tuple:
        self.out.close()
        self.out = None
        self.seq += 1
        return self.shard, self.seq - 1, self.name, self.temporary, self.bytes, self.records, self.sha.hexdigest()


def _described(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [[]] * len(_FILE_SCHEMA)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _FILE_SCHEMA)], schema=_FILE_SCHEMA)


def write_archives(
    pages: DataFrame, path: str, min_bytes: int = 0, roll_bytes: int = ROLL_BYTES, date: str = DATE
) -> DataFrame:
    """Writes all pages under ``path`` and returns the manifest."""
    slim = cut(sized(pages).select("page_id", "sha1", "length"))
    bounds = shard_bounds(slim)
    ranged = decide(sharded(sized(pages), bounds), cut(shared_payloads(slim, min_bytes)), len(bounds) + 1)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, root = fs.FileSystem.from_uri(path)
        file: RollingFile | None = None
        said = None
        for batch in batches:
            done = []
            for row in batch.to_pylist():
                if row["kind"] == 0:
                    said = row
                    continue
                if said and (row["page_id"], row["sha1"]) == (said["page_id"], said["sha1"]):
                    row |= {"payload": None, "refers_to": said["refers_to"]}
                if file is None or file.shard != row["shard"]:
                    if file is not None and file.out is not None:
                        done.append(file.close())
                    file = RollingFile(place, root, row["shard"], roll_bytes, date)
                done += file.add(record(row, date))
            yield _described(done)
        if file is not None and file.out is not None:
            yield _described([file.close()])

    written = cut(ranged.mapInArrow(write, FILES))  # from here on, one attempt's files count

    def commit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, root = fs.FileSystem.from_uri(path)
        for batch in batches:
            for name, temporary in zip(batch.column("name").to_pylist(), batch.column("temporary").to_pylist()):
                if place.get_file_info(f"{root}/{temporary}").type != fs.FileType.NotFound:  # else moved by a lost attempt
                    place.move(f"{root}/{temporary}", f"{root}/{name}")
            yield batch

    written.mapInArrow(commit, FILES).drop("temporary").write.mode("overwrite").json(f"{path}/_manifest")
    place, root = fs.FileSystem.from_uri(path)
    if place.get_file_info(f"{root}/_temporary").type != fs.FileType.NotFound:
        place.delete_dir(f"{root}/_temporary")
    return manifest(pages.sparkSession, path)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    schema = "shard int, seq int, name string, bytes long, records long, sha256 string"
    return spark.read.schema(schema).json(f"{path}/_manifest")


def parsed(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of an unpacked archive."""
    while line := stream.readline():
        if line.strip() == b"":
            continue
        headers = {}
        while (line := stream.readline()).strip():
            name, _, value = line.decode("utf-8").partition(":")
            headers[name] = value.strip()
        yield headers, stream.read(int(headers["Content-Length"]))


def read_archives(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """A row for each response or revisit in the files of the manifest.

    ``page_id``, ``url``, ``record_type``, ``payload_digest``, ``payload_bytes``, ``refers_to``, ``intact``
    (the digest of the payload read is that in the header; null for revisits) and ``payload``.
    """
    schema = pa.schema(
        [("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_digest", pa.string())]
        + [("payload_bytes", pa.int64()), ("refers_to", pa.int64()), ("intact", pa.bool_()), ("payload", pa.binary())]
    )

    def number(text: str | None) -> int | None:
        return None if text in (None, "None") else int(text)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, root = fs.FileSystem.from_uri(path)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                rows, held = [], 0
                with place.open_input_stream(f"{root}/{name}", compression=None) as raw, gzip.GzipFile(fileobj=raw) as plain:
                    for headers, block in parsed(plain):
                        kind = headers["WARC-Type"]
                        if kind == "warcinfo":
                            continue
                        digest = headers["WARC-Payload-Digest"].removeprefix("sha1:")
                        payload = block.partition(b"\r\n\r\n")[2] if kind == "response" else None
                        n = len(payload) if kind == "response" else int(headers["X-Payload-Length"])
                        good = None if payload is None else base32(hashlib.sha1(payload).digest()) == digest
                        kept = payload if with_payload else None
                        rows.append(
                            (number(headers.get("X-Page-Id")), headers["WARC-Target-URI"], kind, digest, n)
                            + (number(headers.get("X-Refers-To-Page-Id")), good, kept)
                        )
                        held += len(kept or b"")
                        if len(rows) >= 4096 or held > 8 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    files = manifest(spark, path).select("name")
    types = "page_id long, url string, record_type string, payload_digest string, payload_bytes long, refers_to long, intact boolean, payload binary"
    return files.repartition(max(1, files.count())).mapInArrow(read, types)


def remove_archives(path: str) -> None:
    place, root = fs.FileSystem.from_uri(path)
    place.delete_dir(root)
