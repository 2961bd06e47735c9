"""Deterministic sharded WARC archives: range-sorted, rolled by compressed size, committed by manifest.

Records are ordered by key; key ranges (shards) come from a sample chosen by a
hash of the key and grow in number with the table, and each is one task, so the
same table gives the same files on any cluster. A shard
is written as gzip members, one record each, to a temporary name that holds the
task attempt, and renamed when complete: a lost executor leaves temporary files
only, and a repeated task writes the same bytes. Readers open what the manifest
table lists, and the manifest is written last.

Files go through pyarrow's file systems, so any folder they can reach on all
executors will do (file:, hdfs:, s3: ...).
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
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridloom.llm.store import materialize

#: Least and greatest bytes of payload a shard, shards before the least grows, files a shard's size allows for, sampled keys a shard.
SHARD_BYTES, MAX_SHARD_BYTES, SHARDS, FILES, KEYS_A_SHARD = 32 << 20, 1 << 30, 10_000, 8, 64
#: Least payload that is deduplicated.
LEAST_REVISIT = 100
#: Manifest rows (about 100 bytes each) that are broadcast to the readers.
MAX_BROADCAST_FILES = 100_000
DATE = "2024-01-01T00:00:00Z"
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")


def record_plan(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) without the payloads.

    Of equal payloads of ``LEAST_REVISIT`` bytes or more the smallest page_id is
    the response, others revisit it. Groups are reduced to one row before they
    are joined back, and the join may split a digest's rows.
    """
    body = F.encode(F.coalesce(F.col(html_col).cast("string"), F.lit("")), "UTF-8")
    thin = pages.select(F.col(id_col).cast("long").alias("page_id"), F.octet_length(body).cast("long").alias("payload_bytes"), F.sha2(body, 256).alias("payload_digest"))
    first = thin.filter(F.col("payload_bytes") >= LEAST_REVISIT).groupBy("payload_digest").agg(F.min("page_id").alias("_first"))
    rows = thin.join(first, "payload_digest", "left")
    again = F.col("page_id") > F.col("_first")
    return rows.select(
        "page_id", "payload_bytes", "payload_digest",
        F.when(again, "revisit").otherwise("response").alias("record_type"),
        F.when(again, F.col("_first")).alias("refers_to"),
    )


def record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, f'page:{page_id}')}>"


def _one_line(text: str) -> str:
    """Header values hold no line breaks or other controls."""
    return "".join(ch if ch >= " " and ch != "\x7f" else f"%{ord(ch):02X}" for ch in text)


def encode_record(row: dict, body: bytes) -> bytes:
    """One gzip member: WARC headers, then the HTTP response head and, for a response, the payload."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row['payload_bytes']}\r\n\r\n".encode()
    block = head + (body if row["record_type"] == "response" else b"")
    url = _one_line(row["url"]) if row["url"] else f"urn:page:{row['page_id']}"
    sha1 = base64.b32encode(hashlib.sha1(block).digest()).decode()
    lines = [
        "WARC/1.1",
        f"WARC-Type: {row['record_type']}",
        f"WARC-Record-ID: {record_id(row['page_id'])}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {url}",
        f"WARC-Payload-Digest: sha256:{row['payload_digest']}",
        f"WARC-Block-Digest: sha1:{sha1}",
        f"X-Page-Id: {row['page_id']}",
    ]
    if row["record_type"] == "revisit":
        lines += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: {record_id(int(row['refers_to']))}",
            f"X-Refers-To-Page-Id: {int(row['refers_to'])}",
        ]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return gzip.compress("\r\n".join(lines).encode() + block + b"\r\n\r\n", 6, mtime=0)


def _members(data: bytes) -> Iterator[bytes]:
    """Decompressed gzip members; input is fed in pieces, so what follows a member isn't copied for each."""
    view, at = memoryview(data), 0
    while at < len(view):
        z, out = zlib.decompressobj(31), []
        while not z.eof:
            if at >= len(view):
                raise ValueError("a record's gzip member is cut off")
            piece = view[at : at + 16384]
            out.append(z.decompress(piece))
            at += len(piece) - len(z.unused_data)
        yield b"".join(out)


def decode_record(member: bytes) -> dict:
    """Fields of one record, its digests checked against the bytes."""
    head, _, rest = member.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    field = dict(line.split(": ", 1) for line in lines[1:])
    block = rest[: int(field["Content-Length"])]
    if rest[len(block) :] != b"\r\n\r\n" or base64.b32encode(hashlib.sha1(block).digest()).decode() != field["WARC-Block-Digest"][5:]:
        raise ValueError(f"damaged record {field['WARC-Record-ID']}")
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:])["Content-Length"])
    digest = field["WARC-Payload-Digest"][7:]
    response = field["WARC-Type"] == "response"
    if response and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError(f"damaged payload {field['WARC-Record-ID']}")
    number = lambda x: None if x in (None, "None") else int(x)
    return {
        "page_id": number(field["X-Page-Id"]), "payload_bytes": size, "payload_digest": digest,
        "record_type": field["WARC-Type"], "refers_to": number(field.get("X-Refers-To-Page-Id")),
        "url": field["WARC-Target-URI"], "payload": payload if response else None,
    }


def _shard_size(size: int) -> int:
    return int(np.clip(size // SHARDS, SHARD_BYTES, MAX_SHARD_BYTES))


def _shard_bounds(plan: DataFrame, size: int, shard_bytes: int) -> np.ndarray:
    """Least keys of all shards but the first: 8 bytes to the driver for each ``shard_bytes`` of payload.

    Cuts are even in bytes over a hash sample of about ``KEYS_A_SHARD`` keys a
    shard, whose running payload tells the shard that a key falls in.
    """
    known = plan.filter("page_id is not null")
    shards = -(-size // shard_bytes)
    if shards < 2:
        return np.zeros(0, np.int64)
    stride = max(1, known.count() // (shards * KEYS_A_SHARD))
    keys = known.filter(F.pmod(F.xxhash64("page_id"), F.lit(stride)) == 0).groupBy("page_id").agg(F.sum("payload_bytes").alias("bytes"))
    # running bytes in key order: within range partitions, plus those of the partitions before
    keys = keys.repartitionByRange(max(1, shards // 64), "page_id").withColumn("part", F.spark_partition_id())
    keys = materialize(keys, "keys")
    before = F.coalesce(F.sum("all").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    of_part = keys.groupBy("part").agg(F.sum("bytes").alias("all")).withColumn("before", before)
    total = keys.agg(F.sum("bytes")).first()[0] or 1
    run = F.coalesce(F.sum("bytes").over(W.partitionBy("part").orderBy("page_id").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    placed = keys.withColumn("run", run).join(of_part.select("part", "before"), "part")
    shard = F.floor((F.col("run") + F.col("before")) * shards / total)
    lows = placed.groupBy(shard.alias("shard")).agg(F.min("page_id").alias("low")).filter("shard > 0").select("low")
    return np.sort(lows.toPandas().low.to_numpy(np.int64))


def write_archives(
    pages: DataFrame,
    folder: str,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    shard_bytes: int | None = None,
    roll_bytes: int | None = None,
) -> DataFrame:
    """Write ``pages`` as WARC files below ``folder``; returns the manifest (file, shard, records, bytes, first, last, sha256).

    A shard holds about ``shard_bytes`` of payload and is one task; without it,
    the payload's 10,000th part, 32 MB to 1 GB. A file is closed before it would
    exceed ``roll_bytes`` compressed (one record at least), an eighth of
    a shard by default.

    Null html is an empty payload, a null url becomes ``urn:page:<id>``, null
    ids come first. Repeated rows are records of their own; with equal ids and
    payloads both have the same type. An empty table gives an empty manifest.
    Other columns are not archived.
    """
    spark = pages.sparkSession
    plan = materialize(record_plan(pages, id_col, html_col), "plan")
    size = plan.agg(F.coalesce(F.sum("payload_bytes"), F.lit(0))).first()[0]
    shard_bytes = shard_bytes or _shard_size(size)
    roll_bytes = max(1, shard_bytes // FILES) if roll_bytes is None else roll_bytes
    shared = spark.sparkContext.broadcast(_shard_bounds(plan, size, shard_bytes))

    @F.pandas_udf("int")
    def shard_of(key: pd.Series) -> pd.Series:
        low = key.fillna(np.iinfo(np.int64).min).astype(np.int64)
        return pd.Series(np.searchsorted(shared.value, low.to_numpy(), side="right").astype(np.int32))

    # decisions and payloads meet in key order, so payloads are shuffled once
    decided = plan.distinct().withColumns({"url": F.lit(None).cast("string"), "html": F.lit(None).cast("string"), "_side": F.lit(0)})
    html = F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    digest = F.sha2(F.encode(html, "UTF-8"), 256)
    bodies = pages.select(
        F.col(id_col).cast("long").alias("page_id"), F.lit(None).cast("long").alias("payload_bytes"), digest.alias("payload_digest"),
        F.lit(None).cast("string").alias("record_type"), F.lit(None).cast("long").alias("refers_to"),
        F.col(url_col).cast("string").alias("url"), html.alias("html"), F.lit(1).alias("_side"),
    )
    both = decided.unionByName(bodies).withColumn("shard", shard_of("page_id"))
    both = both.repartitionById(len(shared.value) + 1, F.col("shard")).sortWithinPartitions("shard", "page_id", "payload_digest", "_side", "url")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = pafs.FileSystem.from_uri(folder)
        files.create_dir(root, recursive=True)
        attempt = TaskContext.get().taskAttemptId()
        done: list[tuple] = []
        out = decision = None
        seq = 0

        def close() -> None:
            nonlocal out
            if out:
                out["to"].close()
                name = f"part-{out['shard']:05d}-{out['seq']:05d}.warc.gz"
                files.move(out["tmp"], f"{root}/{name}")
                done.append((name, out["shard"], out["n"], out["bytes"], out["first"], out["last"], out["sha"].hexdigest()))
                out = None

        for batch in batches:
            for row in batch.to_pylist():
                if row["_side"] == 0:
                    decision = row
                    continue
                if (decision["page_id"], decision["payload_digest"]) != (row["page_id"], row["payload_digest"]):
                    raise ValueError("a payload lacks its decision")
                record = encode_record(decision | {"url": row["url"]}, row["html"].encode())
                if out and (out["shard"] != row["shard"] or out["bytes"] + len(record) > roll_bytes):
                    seq = out["seq"] + 1 if out["shard"] == row["shard"] else 0
                    close()
                if not out:
                    tmp = f"{root}/.tmp-{row['shard']:05d}-{seq:05d}-{attempt}"
                    out = {"to": files.open_output_stream(tmp), "tmp": tmp, "shard": row["shard"], "seq": seq, "n": 0, "bytes": 0, "first": row["page_id"], "sha": hashlib.sha256()}
                    seq = 0
                out["to"].write(record)
                out["sha"].update(record)
                out["n"] += 1
                out["bytes"] += len(record)
                out["last"] = row["page_id"]
        close()
        columns = list(zip(*done, strict=True)) if done else [[]] * 7
        kinds = [pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(x, k) for x, k in zip(columns, kinds, strict=True)],
            names=["file", "shard", "records", "bytes", "first", "last", "sha256"],
        )

    manifest = both.mapInArrow(run, "file string, shard int, records long, bytes long, first long, last long, sha256 string")
    manifest.write.mode("errorifexists").parquet(f"{folder}/_manifest")
    return spark.read.parquet(f"{folder}/_manifest")


def read_archives(spark, folder: str) -> DataFrame:
    """Records of the files that the manifest lists, digests checked: page_id, payload_bytes, payload_digest, record_type, refers_to, url, payload.

    A listed file that is missing or doesn't match its checksum is an error.
    """
    manifest = spark.read.parquet(f"{folder}/_manifest").select("file", F.col("sha256").alias("want"))
    if manifest.isEmpty():
        return spark.createDataFrame([], "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary")
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(folder)
    found = found.select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")
    lost = manifest.join(found.select("file"), "file", "left_anti").first()
    if lost:
        raise ValueError(f"{lost.file} is missing")
    # the manifest is sent to the tasks while it is small, so that contents stay where they are read
    small = manifest.count() <= MAX_BROADCAST_FILES
    joined = found.join(F.broadcast(manifest) if small else manifest, "file").select("file", "want", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {
            "page_id": pa.int64(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "record_type": pa.string(),
            "refers_to": pa.int64(), "url": pa.string(), "payload": pa.binary(),
        }
        for batch in batches:
            for name, want, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if hashlib.sha256(content).hexdigest() != want:
                    raise ValueError(f"{name} is damaged")
                held: list[dict] = []
                for member in _members(content):
                    held.append(decode_record(member))
                    if len(held) == 500:
                        yield pa.RecordBatch.from_pydict({k: pa.array([r[k] for r in held], t) for k, t in kinds.items()})
                        held = []
                if held:
                    yield pa.RecordBatch.from_pydict({k: pa.array([r[k] for r in held], t) for k, t in kinds.items()})

    return joined.mapInArrow(
        run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary"
    )
