"""Deterministic sharded WARC writer and reader.

Records are ordered by page id and cut into shards where their running payload bytes pass multiples of ``shard_bytes``,
so a shard's content depends on the rows alone and not on partition bounds. Payloads are shuffled once: the records and
the marks of those that revisit meet in their shard, each mark sorted before its records. A task writes whole shards: one gzip member per record, a new file when the
compressed size passes ``roll_bytes``. Files are written under a temporary name, renamed when complete, and count only
once the manifest lists them, so a task that is run again replaces its own files and leaves nothing half-written.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import durable, interval_of, running_total, shared_dir, small_batches

MANIFEST = "shard long, seq long, path string, records long, compressed_bytes long, first_id long, last_id long, sha256 string"
READ = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary, digest_ok boolean"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers: int | None, date: str, copy: int = 0) -> bytes:
    """One WARC/1.1 record; a revisit carries the HTTP header and no payload. CR and LF of a url are written as %0D and %0A
    and read back so. ``copy`` tells records of one page apart in their ids."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers is not None else http + payload
    name = "none" if page_id is None else page_id
    own = f"{name}/{copy}" if copy else name
    kind = "response" if refers is None else "revisit"
    uri = (url or f"urn:x-page:{name}").encode("utf-8", "replace").replace(b"\r", b"%0D").replace(b"\n", b"%0A").decode()
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:x-page:{own}>",
        f"WARC-Target-URI: {uri}",
        f"X-Url-Null: {int(url is None)}",
        f"WARC-Date: {date}",
        f"WARC-Payload-Digest: sha1:{base32_sha1(payload)}",
        f"WARC-Block-Digest: sha1:{base32_sha1(block)}",
        f"X-Payload-Length: {len(payload)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if refers is not None:
        head.insert(3, f"WARC-Refers-To: <urn:x-page:{refers}>")
        head.insert(4, "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def mark(pages: DataFrame, min_bytes: int) -> tuple[DataFrame, DataFrame]:
    """Rows with payload, sha and size; and per distinct (page_id, sha): refers, the smallest page id with that payload."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    base = pages.select(F.col("page_id").cast("long"), "url", payload.alias("payload"))
    base = base.withColumns({"sha": F.sha1("payload"), "size": F.octet_length("payload").cast("long")})
    slim = base.groupBy("page_id", "sha", "size").agg(F.count(F.lit(1)).alias("copies"))
    first = slim.groupBy("sha", "size").agg(F.min("page_id").alias("first"))
    slim = slim.join(first, ["sha", "size"]).withColumn(
        "refers", F.when((F.col("size") >= min_bytes) & ~F.col("first").eqNullSafe(F.col("page_id")), F.col("first"))
    )
    return base, slim


def write(pages: DataFrame, out: str, min_bytes: int = 0, shard_bytes: int = 24 << 20, roll_bytes: int = 16 << 20, level: int = 6, date: str = "2000-01-01T00:00:00Z", most_shards: int = 20_000) -> DataFrame:
    """Write a record per row of pages(page_id, url, html) under the folder URI ``out``; the manifest, read back.

    Null html is an empty payload. Of equal payloads of at least ``min_bytes`` bytes the smallest page_id is the
    response and the others revisit it; of rows repeated with the same page_id and payload one is the response and the
    others revisit that page_id. A null page_id sorts first and revisits a page that has an id, if one is equal; without
    such a page it is a response. An empty table gives an empty manifest. Other columns are not read. Shards are longer
    where that made over ``most_shards`` of them (one number each on the driver); files roll at ``roll_bytes`` all the same.
    """
    from pyarrow import fs

    spark = pages.sparkSession
    small_batches(spark)
    base, slim = mark(pages, min_bytes)
    slim = durable(slim)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    weights = slim.groupBy("page_id").agg(F.sum((F.col("size") + 512) * F.col("copies")).alias("weight"))
    placed = running_total(weights, ["page_id"], "weight", "before", n)
    total = weights.agg(F.coalesce(F.sum("weight"), F.lit(0))).first()[0]
    shard_bytes = max(shard_bytes, -(-total // most_shards))
    cuts = placed.groupBy((F.col("before") / shard_bytes).cast("long").alias("shard")).agg(F.min("page_id").alias("cut")).collect()
    cuts = sorted(row["cut"] for row in cuts if row["cut"] is not None)[1:]  # a row per shard
    shard = interval_of(F.col("page_id"), cuts).alias("shard")
    marks = slim.filter("refers is not null").select(shard, "page_id", "sha", "refers", F.lit(None).cast("string").alias("url"), F.lit(None).cast("binary").alias("payload"))
    rows = marks.union(base.select(shard, "page_id", "sha", F.lit(None).cast("long"), "url", "payload"))
    rows = rows.repartitionById(len(cuts) + 1, F.col("shard").cast("int")).sortWithinPartitions("shard", "page_id", "sha", F.col("refers").isNull(), "url")

    def put(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, root = fs.FileSystem.from_uri(out)
        store.create_dir(root, recursive=True)
        shard = seq = -1
        file, last, mark, done, of, copy = None, None, None, [], object(), 0

        def close() -> None:
            nonlocal file
            if file:
                file["stream"].close()
                store.move(file["temporary"], f"{root}/{file['name']}")
                done.append([file["shard"], file["seq"], f"{out}/{file['name']}", file["records"], file["bytes"], file["first"], file["last"], file["sha"].hexdigest()])
            file = None

        for batch in batches:
            for s, page, sha, url, payload, refers in zip(*(batch[c] for c in ("shard", "page_id", "sha", "url", "payload", "refers")), strict=True):
                page, refers = (None if pd.isna(x) else int(x) for x in (page, refers))
                if s != shard:
                    close()
                    shard, seq, last = int(s), -1, None
                if payload is None:  # what the next records of this page and payload refer to
                    mark = (page, sha, refers)
                    continue
                if mark and mark[:2] == (page, sha):
                    refers = mark[2]
                elif page is not None and last == (page, sha) and len(payload) >= min_bytes:
                    refers = page
                last = (page, sha)
                of, copy = page, copy + 1 if page == of else 0  # a page's records are neighbours in one shard
                if file is None:
                    seq += 1
                    name = f"part-{shard:08d}-{seq:05d}.warc.gz"
                    temporary = f"{root}/.{name}.{uuid.uuid4().hex}"
                    file = {"name": name, "temporary": temporary, "stream": store.open_output_stream(temporary, compression=None), "shard": shard, "seq": seq, "records": 0, "bytes": 0, "first": page, "sha": hashlib.sha256()}
                packer = zlib.compressobj(level, zlib.DEFLATED, 31)
                data = packer.compress(record(page, url if isinstance(url, str) else None, bytes(payload), refers, date, copy)) + packer.flush()
                file["stream"].write(data)
                file["sha"].update(data)
                file["records"] += 1
                file["bytes"] += len(data)
                file["last"] = page
                if file["bytes"] >= roll_bytes:
                    close()
        close()
        yield pd.DataFrame(done, columns=["shard", "seq", "path", "records", "compressed_bytes", "first_id", "last_id", "sha256"]).astype({"first_id": "Int64", "last_id": "Int64"})

    manifest = f"{out}/_manifest"
    rows.mapInPandas(put, MANIFEST).write.json(manifest)
    return spark.read.schema(MANIFEST).json(manifest)


def members(stream) -> Iterator[bytes]:
    """The records of a file of gzip members, one at a time."""
    unpack, out, data = zlib.decompressobj(31), [], stream.read(1 << 20)
    while data:
        out.append(unpack.decompress(data))
        if unpack.eof:
            yield b"".join(out)
            data, out, unpack = unpack.unused_data, [], zlib.decompressobj(31)
        else:
            data = b""
        data = data or stream.read(1 << 20)
    if any(out):
        raise ValueError("the file ends within a record")


def parse(raw: bytes) -> list:
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    payload = block.partition(b"\r\n\r\n")[2]
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    page, refers = (fields.get(k, "<urn:x-page:none>")[12:-1].partition("/")[0] for k in ("WARC-Record-ID", "WARC-Refers-To"))
    kind, own = fields["WARC-Type"], fields["WARC-Block-Digest"].removeprefix("sha1:")
    good = base32_sha1(block) == own and (kind == "revisit" or base32_sha1(payload) == digest and len(payload) == int(fields["X-Payload-Length"]))
    uri = None if fields["X-Url-Null"] == "1" else fields["WARC-Target-URI"]
    return [None if page == "none" else int(page), uri, int(fields["X-Payload-Length"]), digest, kind, None if refers == "none" else int(refers), payload if kind == "response" else None, good]


def read(spark: SparkSession, manifest: DataFrame, payloads: bool = True) -> DataFrame:
    """The records of the archives that the manifest lists; ``digest_ok`` says that block and payload digests hold."""
    from pyarrow import fs

    def get(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [x.split()[0] for x in READ.split(", ")]
        for batch in batches:
            for uri in batch["path"]:
                store, path = fs.FileSystem.from_uri(uri)
                with store.open_input_stream(path, compression=None) as stream:
                    rows, size = [], 0
                    for raw in members(stream):
                        rows.append(parse(raw))
                        size += len(raw)
                        if not payloads:
                            rows[-1][6] = None
                        if size > 8 << 20:
                            yield pd.DataFrame(rows, columns=columns).astype({"page_id": "Int64", "refers_to": "Int64"})
                            rows, size = [], 0
                    yield pd.DataFrame(rows, columns=columns).astype({"page_id": "Int64", "refers_to": "Int64"})

    files = manifest.count()
    paths = manifest.select("path").repartition(max(1, min(files, 100_000)), "path")
    return paths.mapInPandas(get, READ)


def archive(pages: DataFrame, **options) -> DataFrame:
    """Write pages under a new folder of the shared one and read the records back."""
    out = f"{shared_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    return read(pages.sparkSession, write(pages, out, **options), payloads=False)
