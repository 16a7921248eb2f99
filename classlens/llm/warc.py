"""WARC archives: written as whole-file gzip streams, normalised to one gzip member per record with an offset index.

The writer lets Spark's text sink make the archives: a row is a record, the line separator is the end of a record,
and the codec compresses a whole file as one stream. Such a file can only be read from its start. The normaliser
inflates every file once, in chunks, and rewrites each record as a gzip member of its own beside a sidecar with
offset, length and id of every record, so that afterwards any record is read alone.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from urllib.parse import unquote, urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from classlens.sources.workdir import shared_folder, stage

DATE = "2024-06-01T00:00:00Z"
MIN_PAYLOAD = 100
CHUNK = 1 << 20
#: Repeated payloads are broadcast up to so many (about 100 bytes each), else joined by shuffle.
BROADCAST_DIGESTS = 100_000
_END = "\r\n\r\n"
_ID = "urn:x-page:"


def _header(name: str, value: Column) -> Column:
    """A header line; none for a null value."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit("\r\n")), F.lit(""))


def records(pages: DataFrame, key: str, url: str, html: str, min_payload: int = MIN_PAYLOAD) -> DataFrame:
    """``value``: a record per row without its final blank lines.

    Of equal payloads of at least ``min_payload`` bytes the row with the smallest key is a response, the others
    revisit it. The pages that are first are found on digests alone; hot payloads are counted before the shuffle.
    """
    rows = pages.select(F.col(key).alias("key"), F.col(url).alias("url"), F.coalesce(F.col(html), F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.sha2("html", 256)).withColumn("bytes", F.octet_length("html"))
    first = (
        rows.where(F.col("bytes") >= min_payload)
        .groupBy("digest")
        .agg(F.min("key").alias("first"), F.count(F.lit(1)).alias("n"))
        .where("n > 1")
    )
    first = stage(first, "first")
    if first.limit(BROADCAST_DIGESTS + 1).count() <= BROADCAST_DIGESTS:
        first = F.broadcast(first)  # else pages are shuffled by digest
    rows = rows.join(first, "digest", "left")
    again = F.col("first").isNotNull() & ~F.col("key").eqNullSafe(F.col("first"))
    uri = F.regexp_replace("url", r"[\x00-\x20\x7F]", "%20")
    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"),
        _header("Content-Length", F.col("bytes")),
        F.lit("\r\n"),
    )
    block = F.when(again, http).otherwise(F.concat(http, F.col("html")))
    return rows.select(
        F.concat(
            F.lit("WARC/1.1\r\n"),
            _header("WARC-Type", F.when(again, "revisit").otherwise("response")),
            _header("WARC-Record-ID", F.concat(F.lit(f"<{_ID}"), F.coalesce(F.col("key").cast("string"), F.lit("")), F.lit(">"))),
            F.lit(f"WARC-Date: {DATE}\r\n"),
            _header("WARC-Target-URI", uri),
            _header("WARC-Payload-Digest", F.concat(F.lit("sha256:"), "digest")),
            _header("WARC-Refers-To", F.when(again, F.concat(F.lit(f"<{_ID}"), F.col("first").cast("string"), F.lit(">")))),
            _header(
                "WARC-Profile",
                F.when(again, "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
            ),
            F.lit("Content-Type: application/http; msgtype=response\r\n"),
            _header("Content-Length", F.octet_length(block)),
            F.lit("\r\n"),
            block,
        ).alias("value")
    )


def write_monolithic(records: DataFrame, folder: str) -> None:
    """Archives whose gzip stream spans the whole file, by Spark's own sink and commit protocol."""
    records.write.option("compression", "gzip").option("lineSep", _END).text(folder)


def _place(uri: str):
    """File system and path of a URI as Spark gives it."""
    from pyarrow import fs

    parts = urlsplit(uri)
    if parts.scheme in ("", "file"):
        return fs.LocalFileSystem(), unquote(parts.path)
    return fs.FileSystem.from_uri(uri)


def _inflated(stream):
    """The bytes of a gzip stream of one or more members, a chunk at a time."""
    inflate, begun = zlib.decompressobj(31), False
    while data := stream.read(CHUNK):
        while data:
            begun = True
            yield inflate.decompress(data, CHUNK)
            data = inflate.unconsumed_tail
            if inflate.eof:
                data, inflate, begun = inflate.unused_data, zlib.decompressobj(31), False
    if begun:
        raise ValueError("the gzip stream is cut off")


def parse_header(head: bytes) -> dict[str, str]:
    """Header fields of a record by lower-case name."""
    lines = head.decode("utf-8").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}


def split_records(chunks):
    """(header fields, whole record) for each record of an inflated stream; holds one record at a time."""
    buffer = bytearray()
    chunks = iter(chunks)

    def more(n: int) -> bool:
        while len(buffer) < n:
            piece = next(chunks, None)
            if piece is None:
                return False
            buffer.extend(piece)
        return True

    while more(1):
        seen = 0
        while (end := buffer.find(b"\r\n\r\n", max(0, seen - 3))) < 0:
            seen = len(buffer)
            if not more(seen + 1):
                raise ValueError("a record header is cut off")
        fields = parse_header(bytes(buffer[:end]))
        size = end + 4 + int(fields["content-length"]) + 4
        if not more(size) or bytes(buffer[size - 4 : size]) != b"\r\n\r\n":
            raise ValueError("a record is cut off or its length is wrong")
        yield fields, bytes(buffer[:size])
        del buffer[:size]


def member(record: bytes, level: int = 6) -> bytes:
    """The record as a gzip member of its own, the same bytes on every run."""
    deflate = zlib.compressobj(level, zlib.DEFLATED, 31)
    return deflate.compress(record) + deflate.flush()


def _normalise(folder: str, level: int):
    def normalise(batches):
        system, base = _place(folder)
        system.create_dir(base, recursive=True)
        for batch in batches:
            for path in batch.column(0).to_pylist():
                source, source_path = _place(path)
                name = source_path.rsplit("/", 1)[-1].split(".")[0]
                archive, sidecar = f"{base}/{name}.warc.gz", f"{base}/{name}.idx"
                mark = f".{uuid.uuid4().hex}"
                offset = count = 0
                with (
                    source.open_input_stream(source_path, compression=None) as stream,
                    system.open_output_stream(archive + mark, compression=None) as out,
                    system.open_output_stream(sidecar + mark, compression=None) as index,
                ):
                    for fields, record in split_records(_inflated(stream)):
                        data = member(record, level)
                        out.write(data)
                        line = f"{name}.warc.gz\t{offset}\t{len(data)}\t{fields['warc-record-id']}\n"
                        index.write(line.encode())
                        offset, count = offset + len(data), count + 1
                for made in (archive, sidecar):  # a task that runs again puts the same bytes in place
                    if system.get_file_info(made).type.name != "NotFound":
                        system.delete_file(made)
                    system.move(made + mark, made)
                yield pa.RecordBatch.from_pydict({"archive": [f"{name}.warc.gz"], "records": [count], "bytes": [offset]})

    return normalise


def normalise(spark: SparkSession, source: str, folder: str, level: int = 6) -> DataFrame:
    """Rewrite the gzip WARC files of ``source`` below ``folder``: ``(archive, records, bytes)`` per file.

    Beside each ``name.warc.gz`` stands ``name.idx`` with archive, offset, length and record id per line. A file is
    one task, since its stream cannot be split; it is read in chunks and one record is held at a time.
    """
    files = spark.read.format("binaryFile").load(source).where("length > 0").select("path")
    n = max(1, files.count())
    made = files.repartition(n).mapInArrow(_normalise(folder, level), "archive string, records long, bytes long")
    return stage(made, "normalised")


_PAGE = pa.schema(
    [
        ("key", pa.string()),
        ("payload_bytes", pa.int64()),
        ("payload_digest", pa.string()),
        ("record_type", pa.string()),
        ("refers_to", pa.string()),
    ]
)


def _page(record: bytes) -> tuple:
    head, _, rest = record.partition(b"\r\n\r\n")
    fields = parse_header(head)
    http, _, payload = rest[:-4].partition(b"\r\n\r\n")
    own = dict(x.split(": ", 1) for x in http.decode("utf-8").split("\r\n")[1:])
    stated = fields["warc-payload-digest"].removeprefix("sha256:")
    if fields["warc-type"] == "response" and hashlib.sha256(payload).hexdigest() != stated:
        raise ValueError(f"payload and digest differ in {fields['warc-record-id']}")

    def page(field: str):
        value = fields.get(field)
        return None if value is None else value.strip("<>").removeprefix(_ID) or None

    return page("warc-record-id"), int(own["Content-Length"]), stated, fields["warc-type"], page("warc-refers-to")


def _read(folder: str):
    def read(batches):
        system, base = _place(folder)
        name = stream = None
        for batch in batches:
            rows = []
            for archive, offset, length in zip(*(c.to_pylist() for c in batch.columns)):
                if archive != name:
                    if stream is not None:
                        stream.close()
                    name, stream = archive, system.open_input_file(f"{base}/{archive}")
                stream.seek(offset)
                rows.append(_page(zlib.decompress(stream.read(length), 31)))
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), _PAGE)], schema=_PAGE)
        if stream is not None:
            stream.close()

    return read


def read_records(spark: SparkSession, folder: str) -> DataFrame:
    """Page records of normalised archives, each read on its own by the sidecars' offsets.

    ``(key, payload_bytes, payload_digest, record_type, refers_to)``, keys as strings. A response's payload is hashed
    and compared with its header; a revisit states length and digest of the payload that it refers to.
    """
    index = spark.read.schema("archive string, offset long, length long, id string").option("sep", "\t")
    rows = index.option("quote", "").csv(f"{folder}/*.idx").select("archive", "offset", "length")
    kinds = "key string, payload_bytes long, payload_digest string, record_type string, refers_to string"
    return rows.mapInArrow(_read(folder), kinds)


def archive_pages(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Write pages as whole-file streams, normalise them, and read every record back from the result.

    Returns ``(key, payload_bytes, payload_digest, record_type, refers_to)``, a row per page. A null payload is
    empty; payloads under 100 bytes are never revisits. Rows that repeat the smallest key of a payload are all
    responses; a row without a key revisits a row that has one, and is a response where none has. A null address is
    left out of the record. Other columns are ignored. Empty in, empty out.
    """
    spark, kind = pages.sparkSession, pages.schema[key].dataType
    whole, single = shared_folder(spark, "warc-whole"), shared_folder(spark, "warc")
    write_monolithic(records(pages, key, url, html), whole)
    made = normalise(spark, whole, single)
    if made.where("records > 0").isEmpty():
        return pages.sparkSession.createDataFrame([], f"{key} {kind.simpleString()}, {_CONTRACT}")
    out = read_records(spark, single)
    return out.withColumn("refers_to", F.col("refers_to").cast(kind)).withColumn("key", F.col("key").cast(kind)).withColumnRenamed("key", key)


_CONTRACT = "payload_bytes long, payload_digest string, record_type string, refers_to long"


def op7_warc(spark, sf_dir: str) -> DataFrame:
    return archive_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"))
