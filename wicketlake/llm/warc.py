"""Operator 13, a deterministic sharded WARC writer and its reader.

Writing. (1) A narrow table (id, payload digest, bytes) gives, for every
payload that occurs more than once, the row with the largest id, and, by exact
prefix sums of payload bytes over the ids, the first id of each shard: the
shards depend on the rows alone, not on how Spark cut the table. (2) Records
are dealt by shard, together with a small control row in front of every record
that repeats a payload of another id, and sorted by id inside a shard: one
shuffle moves the payloads. (3) A task streams its sorted rows, builds the
WARC and HTTP headers and the block and payload digests anew, compresses each
record as a gzip member of its own and starts a new file when the compressed
size reaches its limit. A file is written under a temporary name of the
attempt and renamed when it is whole; its name, size and digest are one row of
the manifest, which Spark commits for successful attempts only. A lost
executor's task writes the same files again, and readers know only what the
manifest names.

Reading. Files of the manifest are dealt to tasks, streamed member by member
and checked against the manifest and every block digest.

Defined results: a null payload is empty; among equal payloads of
``min_bytes`` or more the row with the largest id is the response and the
others are revisits that refer to it, smaller payloads are always responses;
repeated rows of one id and payload: the first (by address) is what that rule
says, the others are revisits of it; a null id is smaller than all others; a
null address has no target header; control characters and blanks in an address
are percent-encoded; an empty table gives no files and an empty result; other
columns stay behind. A record is held whole by the task that writes or reads
it, nothing larger is.
"""

from __future__ import annotations

import base64
import bisect
import zlib
from collections.abc import Iterator
from hashlib import sha1, sha256
from io import BufferedReader
from urllib.parse import quote
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wicketlake.llm.common import bound_batches, small, stream_batches, written
from wicketlake.session import scratch_path

#: Payload bytes of a shard, which one task writes, and compressed bytes after
#: which it starts a new file: at least these, more where there would be over
#: ``MAX_SHARDS`` shards (their first ids pass through the driver).
SHARD_BYTES = 16 << 20
FILE_BYTES = 4 << 20
MAX_SHARDS = 1 << 18

# Fixed values of the archive format.
VERSION = b"WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "file string, shard bigint, part bigint, records bigint, bytes bigint, sha256 string"


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(sha1(data).digest()).decode()


def record_id(page_id, digest: str, copy: int = 0) -> str:
    """A record's name, from the id, the payload digest and the copy number."""
    return f"<urn:page:{'' if page_id is None else page_id}:{digest}:{copy}>"


def record(kind: str, headers: list[tuple[str, str | None]], block: bytes) -> bytes:
    lines = [VERSION, b"WARC-Type: " + kind.encode()]
    lines += [f"{k}: {v}".encode() for k, v in headers if v is not None]
    lines += [b"WARC-Block-Digest: sha1:" + base32_sha1(block).encode(), b"Content-Length: %d" % len(block)]
    return b"\r\n".join(lines) + b"\r\n\r\n" + block + b"\r\n\r\n"


def encoded_url(url: str | None) -> str | None:
    if url is None:
        return None
    return "".join(quote(c) if c <= " " or c == "\x7f" else c for c in url)


def page_record(page_id, url: str | None, payload: bytes, date: str, copy: int, refers_to: tuple | None) -> bytes:
    """The record of one page; ``refers_to`` is (id, address) of the response
    with the same payload, or None where the page is the response itself."""
    digest = base32_sha1(payload)
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    headers = [("WARC-Record-ID", record_id(page_id, digest, copy)), ("WARC-Date", date), ("WARC-Target-URI", encoded_url(url)),
               ("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", f"sha1:{digest}")]
    if refers_to is None:
        return record("response", headers, http + payload)
    page, target = refers_to
    headers += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", record_id(page, digest)),
                ("WARC-Refers-To-Target-URI", encoded_url(target)), ("WARC-Refers-To-Date", date)]
    return record("revisit", headers, http)


class _File:
    """One archive file under a temporary name."""

    def __init__(self, folder: str, name: str, date: str):
        from pyarrow import fs

        self.store, base = fs.FileSystem.from_uri(folder)
        self.final, self.name = f"{base}/{name}", name
        self.temporary = f"{base}/.{name}.{uuid4().hex}.tmp"
        self.out = self.store.open_output_stream(self.temporary, compression=None)
        self.digest, self.bytes, self.records = sha256(), 0, 0
        info = f"software: wicketlake\r\nformat: WARC File Format 1.1\r\nisPartOf: {name}\r\n".encode()
        self.add(record("warcinfo", [("WARC-Record-ID", f"<urn:file:{name}>"), ("WARC-Date", date), ("WARC-Filename", name),
                                     ("Content-Type", "application/warc-fields")], info), 0)

    def add(self, data: bytes, counts: int = 1) -> None:
        member = zlib.compressobj(6, zlib.DEFLATED, 31)  # a gzip member without a time
        data = member.compress(data) + member.flush()
        self.out.write(data)
        self.digest.update(data)
        self.bytes += len(data)
        self.records += counts

    def commit(self) -> tuple:
        self.out.close()
        self.store.move(self.temporary, self.final)
        return self.records, self.bytes, self.digest.hexdigest()


def _writer(folder: str, file_bytes: int, min_bytes: int, date: str):
    """The function over one task's sorted rows ``(shard, page_id, key, kind,
    url, html, refers_to, refers_url)``; yields manifest rows."""
    def write(rows: Iterator[tuple]) -> Iterator[tuple]:
        out, place, group, leader, copy = None, None, None, None, 0

        def closed() -> tuple:
            return (out.name, *place, *out.commit())

        for shard, page_id, key, kind, url, html, refers_to, refers_url in rows:
            if (shard, page_id, key) != group:
                group, leader, copy = (shard, page_id, key), None, 0
            if kind == 0:
                leader = (refers_to, refers_url)
                continue
            if out is not None and (place[0] != shard or out.bytes >= file_bytes):
                yield closed()
                place = (shard, place[1] + 1 if place[0] == shard else 0)
                out = None
            if out is None:
                place = place if place is not None and place[0] == shard else (shard, 0)
                out = _File(folder, f"pages-{shard:08d}-{place[1]:05d}.warc.gz", date)
            payload = html.encode()
            if copy == 0:
                first_url = url
            own = None if copy == 0 or len(payload) < min_bytes else (page_id, first_url)
            out.add(page_record(page_id, url, payload, date, copy, leader or own))
            copy += 1
        if out is not None:
            yield closed()

    return write


def shard_starts(sizes: DataFrame, shard_bytes: int) -> tuple[list[int], int]:
    """The first id of every shard after the first, and the bytes of a shard:
    ids in ascending order are cut where the bytes before them pass a multiple
    of it. Sums are exact, so the cuts are the same however rows are dealt."""
    spark = sizes.sparkSession
    total = sizes.agg(F.sum("bytes")).first()[0] or 0
    step = max(shard_bytes, -(-total // MAX_SHARDS))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    each = sizes.filter("page_id is not null").groupBy("page_id").agg(F.sum("bytes").alias("bytes"))
    ranged = written(each.repartitionByRange(n, "page_id").withColumn("pid", F.spark_partition_id()), "warc-sizes")
    sums = ranged.groupBy("pid").agg(F.sum("bytes").alias("own"))
    earlier = Window.orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    offsets = sums.select("pid", F.coalesce(F.sum("own").over(earlier), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("pid").orderBy("page_id").rowsBetween(Window.unboundedPreceding, -1)
    placed = ranged.withColumn("inside", F.coalesce(F.sum("bytes").over(inside), F.lit(0))).join(F.broadcast(offsets), "pid")
    first = placed.groupBy(F.floor((F.col("offset") + F.col("inside")) / step).alias("shard")).agg(F.min("page_id").alias("first"))
    return sorted(r.first for r in first.select("first").collect())[1:], step  # at most MAX_SHARDS + 1 rows


def write_warc(pages: DataFrame, folder: str | None = None, shard_bytes: int = SHARD_BYTES, file_bytes: int = FILE_BYTES, min_bytes: int = 0,
               date: str = "1970-01-01T00:00:00Z", id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> tuple[str, DataFrame]:
    """Write the archives of ``pages`` under ``folder`` (default: a new one in
    the shared checkpoint folder, which every executor must reach) and return
    the folder and its manifest, one row per file. Record dates are ``date``:
    the same rows give the same bytes."""
    from pyarrow import fs

    spark = pages.sparkSession
    folder = folder or scratch_path(spark, "warc")
    store, base = fs.FileSystem.from_uri(f"{folder}/archives")
    store.create_dir(base, recursive=True)
    rows = pages.select(F.col(f"`{id_col}`").cast("long").alias("page_id"), F.col(f"`{url_col}`").alias("url"),
                        F.coalesce(F.col(f"`{html_col}`"), F.lit("")).alias("html"))
    key = F.sha2("html", 256)
    sized = written(rows.select("page_id", "url", key.alias("key"), F.octet_length("html").cast("long").alias("bytes")), "warc-pages")

    # Who repeats whom: only payloads of several rows are joined.
    shared = written(sized.filter(F.col("bytes") >= min_bytes).groupBy("key")
                     .agg(F.count("*").alias("n"), F.max(F.struct("page_id", "url")).alias("to")).filter("n > 1"), "warc-shared")
    repeats = (sized.select("page_id", "key").join(small(shared), "key").filter("not (page_id <=> to.page_id)").distinct()
               .select("page_id", "key", F.col("to.page_id").alias("refers_to"), F.col("to.url").alias("refers_url")))

    starts, step = shard_starts(sized, shard_bytes)
    bound_batches(spark)

    @F.udf("bigint", useArrow=True)
    def shard_of(page_id):
        return 0 if page_id is None else bisect.bisect_right(starts, page_id)

    text = F.lit(None).cast("string")
    whole = rows.select(shard_of("page_id").alias("shard"), "page_id", key.alias("key"), F.lit(1).alias("kind"), "url", "html",
                        F.lit(None).cast("long").alias("refers_to"), text.alias("refers_url"))
    control = repeats.select(shard_of("page_id").alias("shard"), "page_id", "key", F.lit(0).alias("kind"), text.alias("url"), text.alias("html"),
                             "refers_to", "refers_url")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = whole.unionByName(control).repartition(n, "shard").sortWithinPartitions("shard", "page_id", "key", "kind", "url")
    limit = max(file_bytes, step // 4) if step > shard_bytes else file_bytes
    manifest = stream_batches(dealt, _writer(f"{folder}/archives", limit, min_bytes, date), MANIFEST)
    manifest.write.parquet(f"{folder}/manifest")
    return folder, read_manifest(spark, folder)


def read_manifest(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")


class _Members(BufferedReader):
    """Decompressed bytes of a file of gzip members, read as a stream; sums up
    the file's size and digest on the way."""

    def __init__(self, raw):
        import gzip

        class Summed:
            def __init__(self):
                self.digest, self.bytes = sha256(), 0

            def read(self, n: int = -1) -> bytes:
                data = raw.read(n if n and n > 0 else 1 << 16)
                self.digest.update(data)
                self.bytes += len(data)
                return data

        self.summed = Summed()
        super().__init__(gzip.GzipFile(fileobj=self.summed), 1 << 16)


def parsed(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """``(headers, block)`` of every record of a decompressed archive."""
    while line := stream.readline():
        if line.strip() != VERSION:
            raise ValueError(f"not a record of {VERSION.decode()}: {line[:40]!r}")
        headers = {}
        while (line := stream.readline().rstrip(b"\r\n")):
            name, _, value = line.decode().partition(":")
            headers[name.strip().lower()] = value.strip()
        block = stream.read(int(headers["content-length"]))
        if stream.read(4) != b"\r\n\r\n" or len(block) != int(headers["content-length"]):
            raise ValueError(f"record {headers.get('warc-record-id')} is cut off")
        yield headers, block


RECORDS = ("file string, record_id string, record_type string, target_uri string, payload_digest string, payload_bytes bigint, "
           "refers_to string, payload string")


def read_warc(spark: SparkSession, folder: str) -> DataFrame:
    """One row per response or revisit record of the committed files. A
    revisit's payload is null; its ``payload_bytes`` and digest are those of
    the payload that it refers to. A file that differs from the manifest, or a
    block that differs from its digest, raises."""
    archives = f"{folder}/archives"

    def read(rows: Iterator[tuple]) -> Iterator[tuple]:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(archives)
        for name, size, digest in rows:
            with store.open_input_stream(f"{base}/{name}", compression=None, buffer_size=1 << 16) as raw:
                members = _Members(raw)
                for headers, block in parsed(members):
                    if headers["warc-block-digest"] != "sha1:" + base32_sha1(block):
                        raise ValueError(f"{name}: block digest of {headers['warc-record-id']} differs")
                    if headers["warc-type"] not in ("response", "revisit"):
                        continue
                    head, _, payload = block.partition(b"\r\n\r\n")
                    fields = dict(x.lower().split(": ", 1) for x in head.decode().split("\r\n")[1:])
                    full = headers["warc-type"] == "response"
                    bare = headers["warc-payload-digest"].partition(":")[2]
                    if full and bare != base32_sha1(payload):
                        raise ValueError(f"{name}: payload digest of {headers['warc-record-id']} differs")
                    yield (name, headers["warc-record-id"], headers["warc-type"], headers.get("warc-target-uri"), bare,
                           len(payload) if full else int(fields["content-length"]), headers.get("warc-refers-to"),
                           payload.decode() if full else None)
                if (members.summed.bytes, members.summed.digest.hexdigest()) != (size, digest):
                    raise ValueError(f"{name} is not the file of the manifest")

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    files = read_manifest(spark, folder).select("file", "bytes", "sha256").repartition(n, "file")
    return stream_batches(files, read, RECORDS)


def warc_digest(pages: DataFrame, **options) -> DataFrame:
    """Write the archives, read them back: ``(page_id, payload_bytes,
    payload_digest, record_type, refers_to)`` per page."""
    folder, _ = write_warc(pages, **options)
    records = read_warc(pages.sparkSession, folder)

    def page(column: str):
        return F.nullif(F.element_at(F.split(column, ":"), 3), F.lit("")).cast("long")

    return records.select(page("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", page("refers_to").alias("refers_to"))


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
r AS (SELECT page_id, html, row_number() OVER (PARTITION BY html ORDER BY page_id DESC NULLS LAST) AS rn, max(page_id) OVER (PARTITION BY html) AS leader FROM p),
h AS (SELECT *, sha1(html) AS h FROM r)
SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(8), lambda k: list_aggregate(list_transform([15, 10, 5, 0],
    lambda s: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((CAST('0x' || substr(h, 5 * k + 1, 5) AS BIGINT) >> s) & 31) + 1, 1)), 'string_agg', '')), '') AS payload_digest,
  CASE WHEN rn = 1 THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN rn > 1 THEN leader END AS refers_to FROM h"""
