"""WARC archives: a deterministic sharded writer, and a reader."""

from __future__ import annotations

import base64
import hashlib
import math
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pitchframe.llm.common import table, text_batches
from pitchframe.llm.files import new_folder, open_fs, publish
from pitchframe.plans.session import staged, tune

DATE = "2020-01-01T00:00:00Z"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
# Uncompressed payload of a shard, compressed size at which a file is closed, ranges of keys that shards are made of.
SHARD_BYTES, FILE_BYTES, RANGES = 256 << 20, 64 << 20, 1 << 16
READ_BYTES = 1 << 20


# ---- records


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page}|{digest}')}>"


def clean(value: str) -> str:
    """A header value on one line."""
    return value.replace("\r", "%0D").replace("\n", "%0A")


def member(fields: list[tuple[str, str]], block: bytes) -> bytes:
    """One record as a gzip member of its own, the same bytes for the same record."""
    fields = [*fields, ("WARC-Block-Digest", f"sha1:{base32_sha1(block)}"), ("Content-Length", str(len(block)))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {clean(v)}\r\n" for k, v in fields) + "\r\n"
    press = zlib.compressobj(6, zlib.DEFLATED, 31)
    return press.compress(head.encode()) + press.compress(block) + press.compress(b"\r\n\r\n") + press.flush()


def info_member(name: str) -> bytes:
    block = b"format: WARC File Format 1.1\r\n"
    return member([("WARC-Type", "warcinfo"), ("WARC-Record-ID", record_id(None, name)), ("WARC-Date", DATE), ("WARC-Filename", name), ("Content-Type", "application/warc-fields")], block)


def page_member(page: int | None, url: str | None, payload: bytes, revisits: bool, target: int | None) -> bytes:
    """A response with its payload, or a revisit that has the HTTP header only. Digest and length are those of the payload."""
    digest = base32_sha1(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    fields = [("WARC-Type", "revisit" if revisits else "response"), ("WARC-Record-ID", record_id(page, digest)), ("WARC-Date", DATE)]
    fields += [("WARC-Target-URI", url)] if url is not None else []
    fields += [("WARC-Page-ID", str(page))] if page is not None else []
    fields += [("WARC-Payload-Digest", f"sha1:{digest}"), ("WARC-Payload-Length", str(len(payload)))]
    if revisits:
        fields += [("WARC-Profile", REVISIT), ("WARC-Refers-To", record_id(target, digest)), ("WARC-Refers-To-Page-ID", str(target))]
    return member([*fields, ("Content-Type", "application/http; msgtype=response")], http if revisits else http + payload)


def members(uri: str):
    """(place in the file, bytes of one record) of each gzip member; the file is read piece by piece."""
    fs, path = open_fs(uri)
    with fs.open_input_stream(path, compression=None) as source:
        left, at = b"", 0
        while left or (left := source.read(READ_BYTES)):
            unpress, out, start = zlib.decompressobj(31), [], at
            while not unpress.eof:
                if not left and not (left := source.read(READ_BYTES)):
                    raise ValueError(f"{uri} ends inside a record")
                out.append(unpress.decompress(left))
                at += len(left) - len(unpress.unused_data)
                left = unpress.unused_data
            yield start, b"".join(out)


def parse(record: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = record.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if version != "WARC/1.1":
        raise ValueError(f"not a WARC record: {version[:40]}")
    fields = dict(line.split(": ", 1) for line in lines)
    return fields, rest[: int(fields["Content-Length"])]


# ---- Spark


def mark_revisits(pages: DataFrame, least: int) -> DataFrame:
    """`pages` (page, url, payload) with `target`: the page that holds the same payload, where that is another one.

    Only digests, lengths and ids are grouped; payloads that occur once never meet a join partner.
    """
    marked = pages.withColumn("digest", F.sha2("payload", 256))
    told = marked.where(F.length("payload") >= least).groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.max("page").alias("holder"))
    holders = staged(told.where("n > 1").drop("n"))
    joined = marked.join(holders, "digest", "left")
    # Without an id there is nothing to refer by: such rows are responses.
    revisits = F.col("holder").isNotNull() & F.col("page").isNotNull() & (F.col("page") != F.col("holder"))
    return joined.withColumn("target", F.when(revisits, F.col("holder"))).drop("holder")


def shard_of(pages: DataFrame, shard_bytes: int) -> DataFrame:
    """`pages` with shard and sub, which depend on the rows alone.

    The range of the ids is cut into at most 65,536 equal ranges, and shards are runs of ranges by payload bytes. A
    range that is larger than a shard (crowded or repeated ids) is dealt to sub-shards by digest.
    """
    low, high = pages.agg(F.min("page"), F.max("page")).first()
    if low is None:
        low = high = 0
    width = (high - low) // RANGES + 1
    cell = F.coalesce(F.floor((F.col("page") - low) / width).cast("bigint"), F.lit(-1))
    if width > 1 << 20:  # wide ids: a double's quotient would not be exact
        cell = F.coalesce(F.expr(f"CAST((CAST(page AS DECIMAL(38,0)) - {low}) DIV {width} AS BIGINT)"), F.lit(-1))
    celled = pages.withColumn("cell", cell)
    sizes = celled.groupBy("cell").agg(F.sum(F.length("payload") + 512).alias("size"))
    before = Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("shard", F.floor(F.coalesce(F.sum("size").over(before), F.lit(0)) / shard_bytes).cast("bigint"))
    sizes = staged(sizes.select("cell", "shard", F.ceil(F.col("size") / shard_bytes).cast("bigint").alias("subs")))
    dealt = celled.join(sizes, "cell")
    return dealt.withColumn("sub", F.pmod(F.xxhash64("digest", "url"), "subs")).drop("cell", "subs")


def write_warc(
    df: DataFrame, folder: str, key: str = "page_id", url: str = "url", html: str = "html",
    least: int = 0, shard_bytes: int = SHARD_BYTES, file_bytes: int = FILE_BYTES,
) -> DataFrame:
    """Write a record for each row, in order of `key`, and return the manifest (a row for each file).

    Payloads are the UTF-8 bytes of `html`, NULL as empty. Of rows with equal payloads of at least `least` bytes that
    with the largest key is the response, others revisit it; rows that repeat the largest key are responses too, as
    are rows without a key. A file is closed once it holds `file_bytes` compressed bytes. File names and contents
    depend on the rows and sizes alone, not on partitions or attempts. Other columns are left out. An empty table
    gives an empty manifest.
    """
    spark = df.sparkSession
    text_batches(spark)
    pages = df.select(
        F.col(f"`{key}`").cast("bigint").alias("page"), F.col(f"`{url}`").alias("url"), F.coalesce(F.col(f"`{html}`"), F.lit("")).cast("binary").alias("payload")
    )
    placed = shard_of(mark_revisits(pages, least), shard_bytes)
    size = placed.agg(F.sum(F.length("payload"))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(size / shard_bytes))
    order = ["shard", "sub", F.col("page").asc_nulls_first(), "digest", "url"]
    placed = placed.repartition(parts, "shard", "sub").sortWithinPartitions(*order)

    def write(batches):
        out, now, done = None, None, []
        name = temp = ""
        seq = records = size = 0

        def finish():
            out.close()
            done.append((name, temp, records, size))

        for batch in batches:
            cols = [batch.column(c).to_pylist() for c in ("shard", "sub", "page", "url", "payload", "target")]
            for shard, sub, page, link, payload, target in zip(*cols):
                if out is not None and ((shard, sub) != now or size >= file_bytes):
                    finish()
                    out, seq = None, seq + 1 if (shard, sub) == now else 0
                if out is None:
                    now, records = (shard, sub), 0
                    name, temp = f"pages-{shard:06d}-{sub:04d}-{seq:04d}.warc.gz", f"{folder}/_{uuid.uuid4().hex}"
                    fs, path = open_fs(temp)
                    out = fs.open_output_stream(path, compression=None)
                    size = out.write(info_member(name))
                size += out.write(page_member(page, link, payload, target is not None, target))
                records += 1
        if out is not None:
            finish()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done)], names=["name", "temp", "records", "size"])

    chosen = placed.select("shard", "sub", "page", "url", "payload", "target")
    return publish(chosen.mapInArrow(write, "name string, temp string, records bigint, size bigint"), folder)


def read_warc(manifest: DataFrame, key: str = "page_id", payloads: bool = True) -> DataFrame:
    """A row for each page record of the files: `key`, url, payload_bytes, payload_digest, record_type, refers_to,
    payload (NULL for revisits), file, place. Digests of blocks and payloads are computed anew and must agree."""
    kinds = [(key, pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary()), ("file", pa.string()), ("place", pa.int64())]
    kinds = [k for k in kinds if payloads or k[0] != "payload"]
    schema = pa.schema(kinds)

    def rows(uri):
        for place, record in members(uri):
            fields, block = parse(record)
            if fields["WARC-Block-Digest"] != f"sha1:{base32_sha1(block)}":
                raise ValueError(f"{uri}: a block differs from its digest at {place}")
            kind = fields["WARC-Type"]
            if kind not in ("response", "revisit"):
                continue
            digest, size = fields["WARC-Payload-Digest"].removeprefix("sha1:"), int(fields["WARC-Payload-Length"])
            payload = block.partition(b"\r\n\r\n")[2] if kind == "response" else None
            if payload is not None and (len(payload), base32_sha1(payload)) != (size, digest):
                raise ValueError(f"{uri}: a payload differs from its digest at {place}")
            whole = lambda name: int(fields[name]) if name in fields else None
            row = [whole("WARC-Page-ID"), fields.get("WARC-Target-URI"), size, digest, kind, whole("WARC-Refers-To-Page-ID"), payload, uri, place]
            yield row if payloads else row[:6] + row[7:]

    def read(batches):
        for batch in batches:
            for uri in batch.column("path").to_pylist():
                held, size = [], 0
                for row in rows(uri):
                    held.append(row)
                    size += 200 + len((row[6] if payloads else None) or b"")
                    if size > READ_BYTES * 4:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
                        held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)

    names = {pa.int64(): "bigint", pa.string(): "string", pa.binary(): "binary"}
    return manifest.select("path").repartition(max(manifest.count(), 1), "path").mapInArrow(read, ", ".join(f"`{n}` {names[t]}" for n, t in kinds))


def op6_warc(spark: SparkSession, folder: str) -> DataFrame:
    tune(spark)
    manifest = write_warc(table(spark, folder, "pages"), new_folder(spark, "warc"), shard_bytes=32 << 20)
    back = read_warc(manifest, payloads=False)
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
