"""WARC archives compressed record by record with an embedded Zstandard dictionary.

An archive is one part file of a Spark text write: a leading skippable frame with the
dictionary, then one Zstandard frame per record. Spark ends every row with a line separator;
it is set to an empty skippable frame, which any Zstandard reader passes over. So Spark's own
committer writes the files, and a lost executor leaves no half archive behind.
"""

from __future__ import annotations

import hashlib
import io
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowtables.session import make_folder, written

#: Fixed values of the formats.
DICTIONARY_MAGIC = 0x184D2A5D
SKIPPABLE = range(0x184D2A50, 0x184D2A60)
EMPTY_FRAME = "P*M\x18\x00\x00\x00\x00"
VERSION = b"WARC/1.1\r\n"

#: Bytes a reader feeds at once; what follows a frame's end is fed again.
FEED = 16 << 10
RECORDS = ("page_id long, url string, record_type string, refers_to long, payload binary, "
           "payload_bytes long, payload_digest string")
ARROW = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()),
                   ("refers_to", pa.int64()), ("payload", pa.binary()),
                   ("payload_bytes", pa.int64()), ("payload_digest", pa.string())])


def header(fields: list[tuple[str, str]], block: bytes) -> bytes:
    lines = "".join(f"{name}: {value}\r\n" for name, value in fields)
    return VERSION + f"{lines}Content-Length: {len(block)}\r\n\r\n".encode()


def uri(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, payload_bytes: int,
           refers_to: int | None, date: str) -> bytes:
    """One uncompressed record: a response with its payload, or a revisit without it."""
    fields = [("WARC-Type", "response" if refers_to is None else "revisit"),
              ("WARC-Record-ID", uri(page_id)), ("WARC-Date", date),
              ("WARC-Payload-Digest", f"sha256:{digest}"),
              ("X-Payload-Length", str(payload_bytes)),
              ("Content-Type", "application/http;msgtype=response")]
    if url is not None:
        # Control and non-ASCII characters cannot stand in a header line.
        fields.append(("WARC-Target-URI", quote(url, safe="!#$&'()*+,/:;=?@[]-._~")))
    head = f"HTTP/1.1 200 OK\r\nContent-Length: {payload_bytes}\r\n\r\n".encode()
    if refers_to is None:
        block = head + payload
    else:
        fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/"
                                    "identical-payload-digest"),
                   ("WARC-Refers-To", uri(refers_to))]
        block = head
    return header(fields, block) + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple:
    """The fields of ``RECORDS`` from one uncompressed record."""
    if not data.startswith(VERSION):
        raise ValueError("not a WARC record")
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[:int(fields["Content-Length"])]
    payload = block.partition(b"\r\n\r\n")[2]
    numbers = [fields.get(name, "")[len("<urn:page:"):-1]
               for name in ("WARC-Record-ID", "WARC-Refers-To")]
    page_id, refers_to = (int(number) if number else None for number in numbers)
    url = fields.get("WARC-Target-URI")
    if fields["WARC-Type"] == "response":
        size, digest = len(payload), hashlib.sha256(payload).hexdigest()
        if f"sha256:{digest}" != fields["WARC-Payload-Digest"]:
            raise ValueError(f"record {page_id}: the payload does not have its digest")
    else:
        payload, size = None, int(fields["X-Payload-Length"])
        digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
    return (page_id, None if url is None else unquote(url), fields["WARC-Type"], refers_to,
            payload, size, digest)


def frames(content: bytes) -> Iterator[bytes]:
    """The uncompressed records of one archive."""
    view, at, dictionary = memoryview(content), 0, None
    while at < len(view):
        magic = int.from_bytes(view[at:at + 4], "little")
        if magic in SKIPPABLE:
            size = int.from_bytes(view[at + 4:at + 8], "little")
            if magic == DICTIONARY_MAGIC and size:
                dictionary = zstandard.ZstdCompressionDict(bytes(view[at + 8:at + 8 + size]))
            at += 8 + size
            continue
        frame = zstandard.ZstdDecompressor(dict_data=dictionary).decompressobj()
        out = io.BytesIO()
        while not frame.eof:
            if at >= len(view):
                raise ValueError("an archive ends within a record")
            fed = view[at:at + FEED]
            out.write(frame.decompress(fed))
            at += len(fed)
        at -= len(frame.unused_data)
        yield out.getvalue()


def trained(samples: DataFrame, column: str, size: int, sample_bytes: int) -> bytes:
    """A dictionary from at most ``sample_bytes`` of the rows, made in one task that streams them;
    no task sends it more than that, nor a value twice."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, held = set(), 0
        for batch in batches:
            for value in batch.column(0):
                payload = value.as_buffer().to_pybytes()
                digest = hashlib.sha256(payload).digest()
                if held < sample_bytes and digest not in seen:
                    seen.add(digest)
                    payload = payload[:sample_bytes - held]
                    held += len(payload)
                    yield pa.RecordBatch.from_arrays([pa.array([payload], pa.binary())], [column])
            if held >= sample_bytes:
                break

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, held = [], 0
        for batch in batches:
            for value in batch.column(0):
                payload = value.as_buffer().to_pybytes()[:sample_bytes - held]
                pieces += [payload[i:i + FEED] for i in range(0, len(payload), FEED)]
                held += len(payload)
                if held >= sample_bytes:
                    break
            if held >= sample_bytes:
                break
        dictionary = b"".join(pieces)[-size:]
        try:
            dictionary = zstandard.train_dictionary(size, pieces, k=256, d=8).as_bytes()
        except zstandard.ZstdError:
            pass  # too little to train on: the records' own bytes serve as the dictionary
        yield pa.RecordBatch.from_arrays([pa.array([dictionary], pa.binary())], ["dictionary"])

    own = samples.select(column).mapInArrow(cut, f"{column} binary")
    return own.repartition(1).mapInArrow(train, "dictionary binary").first()[0]


def payload_of(html: str) -> Column:
    return F.coalesce(F.col(html), F.lit("")).cast("binary")


def sampled(pages: DataFrame, facts: DataFrame, sample_bytes: int) -> DataFrame:
    """About twice ``sample_bytes`` of distinct payloads, drawn by hash: one page of each, and rows
    that repeat its id. ``facts`` has the id, digest, length and hash of each page."""
    facts = facts.where("bytes > 0")
    distinct, = facts.groupBy("digest").agg(F.max("bytes").alias("bytes")).agg(F.sum("bytes")).first()
    share = min(1.0, 2.0 * sample_bytes / max(distinct or 0, 1))
    drawn = F.pmod(F.col("mark"), F.lit(1 << 40)) < int(share * (1 << 40)) + 1
    chosen = written(facts.where(drawn).groupBy(F.col("digest").alias("of"))
                     .agg(F.min("page_id").alias("first")), "warc-sample")
    own = pages.withColumn("mark", F.xxhash64("payload")).where(drawn).withColumn("digest", F.sha2("payload", 256))
    return own.join(chosen, (F.col("of") == F.col("digest")) & F.col("first").eqNullSafe(F.col("page_id")), "left_semi")


def write_archives(pages: DataFrame, folder: str, page_id: str = "page_id", url: str = "url",
                   html: str = "html", smallest_revisit: int = 100, archive_bytes: int = 32 << 20,
                   dictionary_bytes: int = 64 << 10, sample_bytes: int = 4 << 20, level: int = 6,
                   date: str = "2026-01-01T00:00:00Z") -> None:
    """Write one record per page into archives of at most about ``archive_bytes`` of payload each,
    and into as many archives as the session has shuffle partitions at least.

    The payload is the html in UTF-8, empty for null. Of pages with equal payloads of at least
    ``smallest_revisit`` bytes the one with the smallest page_id is the response and the
    others revisit it; rows that repeat that page_id are responses too. A page without an id
    revisits like any other page, but is never revisited. Smaller payloads are responses.
    An empty table writes no archive, only the folder. Other columns are ignored.

    Equal payloads are found by digest, with a map-side combined minimum, and joined back by
    page_id and digest: no group of copies meets in one task, and the pages are shuffled once,
    into archives. The dictionary is trained on distinct payloads drawn by hash, ``sample_bytes``
    at most, each read from the pages of its smallest id; it affects the size only.
    """
    payload = payload_of(html)
    pages = pages.select(F.col(page_id).cast("long").alias("page_id"),
                         F.col(url).cast("string").alias("url"), payload.alias("payload"))
    facts = written(pages.select("page_id", F.sha2("payload", 256).alias("digest"),
                                 F.octet_length("payload").cast("long").alias("bytes"),
                                 F.xxhash64("payload").alias("mark")), "warc")
    total, = facts.agg(F.sum("bytes")).first()
    if total is None:
        make_folder(pages.sparkSession, folder)
        return
    first = (facts.where(F.col("bytes") >= smallest_revisit).groupBy("digest")
             .agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
             .where("n > 1 and first is not null").select("digest", "first"))
    slot = F.concat("digest", F.coalesce(F.col("page_id").cast("string"), F.lit(""))).alias("slot")
    again = (facts.join(first, "digest").where("page_id is null or page_id != first")
             .select(slot, F.col("first").alias("refers_to")).distinct())
    dictionary = trained(sampled(pages, facts, sample_bytes), "payload", dictionary_bytes, sample_bytes)

    def archive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        compressor = zstandard.ZstdCompressor(level=level, dict_data=known)
        leading = [DICTIONARY_MAGIC.to_bytes(4, "little")
                   + len(dictionary).to_bytes(4, "little") + dictionary]
        for batch in batches:
            out, held = leading, 0
            for key, target, body, digest, size, refers in zip(*map(pa.Array.to_pylist,
                                                                    batch.columns)):
                out.append(compressor.compress(record(key, target, body or b"", digest, size,
                                                      refers, date)))
                held += len(out[-1])
                if held > FEED << 8:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["frame"])
                    out, held = [], 0
            leading = []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["frame"])

    # With fewer partitions than the session's, the planner would deal the pages out twice.
    least = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    archives = max(least, -(-total // archive_bytes))
    rows = (pages.withColumn("digest", F.sha2("payload", 256)).select("*", slot)
            .repartition(archives, "slot"))
    rows = (rows.join(again, "slot", "left")
            .select("page_id", "url",
                    F.when(F.col("refers_to").isNull(), F.col("payload")).alias("payload"),
                    "digest", F.octet_length("payload").cast("long").alias("bytes"),
                    "refers_to"))
    (rows.mapInArrow(archive, "frame binary").select(F.col("frame").cast("string").alias("frame"))
     .write.option("lineSep", EMPTY_FRAME).option("compression", "none").text(folder))


def read_archives(spark: SparkSession, folder: str, payloads: bool = True) -> DataFrame:
    """The records of all archives in ``folder`` with the columns of ``RECORDS``.

    Payload length and digest of a response are taken from the payload that was read, and a
    wrong digest is an error; a revisit's are those of its header, and its payload is null.
    Without ``payloads`` the payload column is null throughout. No archives, no rows.
    """
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows, held = [], 0
                for data in frames(content.as_buffer()):
                    row = parse(data)
                    rows.append(row if payloads else (*row[:4], None, *row[5:]))
                    held += len(data) if payloads else 200
                    if held > FEED << 8:
                        yield pa.RecordBatch.from_pylist(
                            [dict(zip(ARROW.names, r)) for r in rows], ARROW)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(
                        [dict(zip(ARROW.names, r)) for r in rows], ARROW)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder)
    return files.select("content").mapInArrow(read, RECORDS)
