"""WARC archives of Zstandard frames: a leading skippable frame holds the dictionary, then one frame for each record."""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard as zstd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm._store import rows_of, shared_folder

DICTIONARY_MAGIC = 0x184D2A5D
ZSTD_MAGIC = b"\x28\xb5\x2f\xfd"
#: Compressed bytes after which a writer begins another archive: readers hold one archive at a time.
ARCHIVE_BYTES = 8 << 20
#: Payloads of fewer bytes are never deduplicated.
LEAST_REVISIT = 1000
#: The dictionary is fitted on so many pages at most, the first bytes of each.
SAMPLE_PAGES, SAMPLE_BYTES, DICTIONARY_BYTES = 256, 16384, 32768
_ID = "urn:page:"
_DATE = "2020-01-01T00:00:00Z"


class BadArchive(ValueError):
    """The bytes aren't a complete archive."""


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, kind: str, refers_to: int | None) -> bytes:
    """A response record with the payload, or a revisit record with the HTTP header alone."""
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    if kind == "response":
        block += payload
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{_ID}{'' if page_id is None else page_id}>", f"WARC-Date: {_DATE}", f"WARC-Payload-Digest: sha1:{digest}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {quote(url, safe=':/?#[]@!$&()*+,;=%~')}")
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{_ID}{refers_to}>"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def lead(dictionary: bytes) -> bytes:
    return struct.pack("<II", DICTIONARY_MAGIC, len(dictionary)) + dictionary


def records(archive: bytes) -> Iterator[bytes]:
    """The records of an archive, each a frame of its own. BadArchive if something else is met."""
    at, context = 0, zstd.ZstdDecompressor()
    if len(archive) >= 8 and struct.unpack_from("<I", archive)[0] == DICTIONARY_MAGIC:
        n = struct.unpack_from("<I", archive, 4)[0]
        dictionary = archive[8 : 8 + n]
        if len(dictionary) < n:
            raise BadArchive("the dictionary ends early")
        if dictionary[:4] == ZSTD_MAGIC:
            dictionary = zstd.ZstdDecompressor().decompressobj().decompress(dictionary)
        context, at = zstd.ZstdDecompressor(dict_data=zstd.ZstdCompressionDict(dictionary)) if dictionary else context, 8 + n
    view = memoryview(archive)
    while at < len(archive):
        magic = struct.unpack_from("<I", archive, at)[0] if at + 8 <= len(archive) else 0
        if magic & 0xFFFFFFF0 == 0x184D2A50:  # other skippable frames hold nothing of ours
            at += 8 + struct.unpack_from("<I", archive, at + 4)[0]
            continue
        one, parts, step = context.decompressobj(), [], 1 << 13
        while not one.eof:
            if at >= len(archive):
                raise BadArchive("a frame ends early")
            piece = view[at : at + step]
            try:
                parts.append(one.decompress(piece))
            except zstd.ZstdError as e:
                raise BadArchive(f"a damaged frame: {e}") from e
            at += len(piece) - len(one.unused_data)
            step = min(step * 2, 1 << 20)
        yield b"".join(parts)


def parse(raw: bytes) -> dict:
    """The fields and the payload of a record; `error` says what its lengths or digest contradict."""
    head, found, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not found or not re.fullmatch(r"WARC/\d\.\d", lines[0]):
        return {"error": "no WARC header"}
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    kind, digest = fields.get("warc-type"), fields.get("warc-payload-digest", "").removeprefix("sha1:") or None
    out = {"record_type": kind, "digest": digest, "url": fields.get("warc-target-uri"), "payload": None, "payload_bytes": None, "error": None}
    for name, field in (("page_id", "warc-record-id"), ("refers_to", "warc-refers-to")):
        m = re.fullmatch(rf"<{_ID}(-?\d+)>", fields.get(field, ""))
        out[name] = int(m[1]) if m else None
    if not fields.get("content-length", "").isdigit():
        return out | {"error": "no Content-Length"}
    n = int(fields["content-length"])
    if len(rest) != n + 4 or rest[n:] != b"\r\n\r\n":
        return out | {"error": "the block's length isn't Content-Length"}
    http, found, payload = rest[:n].partition(b"\r\n\r\n")
    m = re.search(rb"(?im)^content-length: *(\d+)\r?$", http)
    if not found or not m:
        return out | {"error": "no HTTP header"}
    out["payload_bytes"] = int(m[1])
    if kind == "response":
        out["payload"] = payload
        if len(payload) != out["payload_bytes"]:
            return out | {"error": "the payload's length isn't its Content-Length"}
        if hashlib.sha1(payload).hexdigest() != digest:
            return out | {"error": "the payload's digest differs"}
    return out


def _dictionary(pages: DataFrame) -> bytes:
    """A dictionary fitted on about SAMPLE_PAGES pages, those of least hash, and four times as many at most; from few
    pages, their bytes."""
    share = SAMPLE_PAGES / max(1, pages.count())
    place = F.pmod(F.xxhash64("page", "url"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    part = F.expr(f"substring(payload, 1, {SAMPLE_BYTES})")
    sample = sorted(bytes(r.part) for r in pages.where(place < share).select(part.alias("part")).where("length(part) > 0").limit(4 * SAMPLE_PAGES).collect())
    try:
        return zstd.train_dictionary(DICTIONARY_BYTES, sample).as_bytes()
    except (zstd.ZstdError, ValueError):
        return b"".join(sample)[:DICTIONARY_BYTES]


def write_archives(pages: DataFrame, folder: str, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = LEAST_REVISIT) -> DataFrame:
    """Writes each row of pages as a record into archives (part-*.warc.zst) under folder, which all executors share, and
    returns the archives' names, sizes and numbers of records.

    Null html is an empty payload. Of rows with equal payloads of `least` bytes or more, those with the largest id are
    responses and others revisits of it; shorter payloads and rows without id are responses. A null URL is left out.
    Large groups of equal payloads meet only as digests, counted before the shuffle; payloads move once, by a key of their
    own. A partition is sorted, and archives are renamed when complete, so that a task that runs again writes the same.
    """
    spark = pages.sparkSession
    rows = pages.select(F.col(id_col).alias("page"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col).cast("string").cast("binary"), F.lit(b"")).alias("payload"))
    dictionary = spark.sparkContext.broadcast(_dictionary(rows))
    rows = rows.withColumn("digest", F.sha1("payload"))
    long = rows.where((F.length("payload") >= least) & F.col("page").isNotNull()).select("page", "digest")
    largest = long.groupBy("digest").agg(F.max("page").alias("refers_to"), F.count("*").alias("n")).where("n > 1").drop("n")
    again = long.join(largest, "digest").where("page < refers_to").distinct()
    rows = rows.join(again, ["page", "digest"], "left")
    rows = rows.sortWithinPartitions("page", "url", "digest")
    top = spark.sparkContext.broadcast(folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        files, path = pafs.FileSystem.from_uri(top.value)
        files.create_dir(path, recursive=True)
        own = zstd.ZstdCompressor(level=3, dict_data=zstd.ZstdCompressionDict(dictionary.value)) if dictionary.value else zstd.ZstdCompressor(level=3)
        held, size, count, number, names = [lead(dictionary.value)], 0, 0, 0, []

        def flush() -> None:
            nonlocal held, size, count, number
            name = f"part-{part:06d}-{number:04d}.warc.zst"
            temporary = f"{path}/.{name}.{TaskContext.get().taskAttemptId()}"
            with files.open_output_stream(temporary, compression=None) as out:
                out.write(b"".join(held))
            files.move(temporary, f"{path}/{name}")
            names.append((name, size, count))
            held, size, count, number = [lead(dictionary.value)], 0, 0, number + 1

        for batch in batches:
            for page, url, payload, digest, refers in zip(*(rows_of(batch, c).to_pylist() for c in ("page", "url", "payload", "digest", "refers_to")), strict=True):
                frame = own.compress(record(page, url, payload, digest, "response" if refers is None else "revisit", refers))
                held.append(frame)
                size += len(frame)
                count += 1
                if size >= ARCHIVE_BYTES:
                    flush()
        if count:
            flush()
        if names:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*names, strict=True), (pa.string(), pa.int64(), pa.int64()), strict=True)], ["archive", "bytes", "records"])

    return rows.mapInArrow(run, "archive string, bytes long, records long")


def read_archives(spark: SparkSession, folder: str, *, payloads: bool = True) -> DataFrame:
    """One row for each record of the archives under folder: archive, page_id, url, record_type, refers_to, payload (of
    responses; left out if payloads is false), payload_bytes and payload_digest (of the full payload), and error: null,
    or what a header, a length or a digest contradicts. An archive that ends early or is damaged gives the records before
    the damage and one row with an error. An empty folder gives no rows."""
    schema = "archive string, page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, error string" + ", payload binary" * payloads
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), *[pa.binary()] * payloads]

    def rows(name: str, content: bytes) -> Iterator[dict]:
        try:
            for raw in records(content):
                found = parse(raw)
                yield {"archive": name, "payload_digest": found.get("digest")} | found
        except BadArchive as e:
            yield {"archive": name, "error": str(e)}

    def batch_of(found: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x.get(n) for x in found], t) for n, t in zip(names, kinds, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(rows_of(batch, "path"), rows_of(batch, "content"), strict=True):
                found, held = [], 0
                for x in rows(name.as_py(), content.as_py()):
                    found.append(x)
                    held += len(x.get("payload") or b"") + 200
                    if held > 8 << 20:
                        yield batch_of(found)
                        found, held = [], 0
                if found:
                    yield batch_of(found)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(folder).select("path", "content")
    return files.mapInArrow(run, schema)


def new_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/warc"
