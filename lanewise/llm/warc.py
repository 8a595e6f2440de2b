"""Legacy archive converter: ARC files of version 1 and 2 become WARC 1.1, and both are read back by their declared lengths.

ARC header lines are told apart by the file's version block, whose field list says what a line holds. From them a WARC record gets what ARC does not
have: an identifier (a UUID of archive, place, address and date, so that a second conversion gives the same), an ISO date, a type, and digests
of block and payload. Archives are written and read by Spark alone, so that any store it reaches will do: a file is what one task writes, and one
row of the binary reader. Files may be plain, one gzip stream, or one gzip member per record.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lanewise.session import use_checkpoints

from .common import cut_lineage, join_copies

# The field lists of ARC header lines by version, and the profile of a WARC revisit.
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

#: Payloads of fewer bytes are always kept in full.
LEAST_BYTES = 100
#: HTTP header that carries a row's own key through an archive.
KEY_HEADER = "X-Archive-Key"
#: Payload bytes that the readers hand over at once.
HAND_OVER = 8 << 20

ARC_SCHEMA = (
    "archive string, offset long, version int, url string, ip string, date string, mime string, status string, header binary, payload binary, "
    "payload_bytes long, payload_digest string, key string, truncated boolean"
)
WARC_SCHEMA = (
    "archive string, offset long, record_type string, record_id string, target_uri string, date string, refers_to string, headers map<string,string>, "
    "header binary, payload binary, payload_bytes long, payload_digest string, declared_digest string, key string, truncated boolean"
)


def archive_folder(spark: SparkSession) -> str:
    """A new folder beside the session's checkpoints, which driver and executors share."""
    use_checkpoints(spark)
    return f"{spark.conf.get('spark.checkpoint.dir', None) or spark.sparkContext.getCheckpointDir()}/archives-{uuid.uuid4().hex}"


def remove_folder(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def _first_row() -> Column:
    """True for the first row that a task writes."""
    return F.monotonically_increasing_id() % (1 << 33) == 0


def write_arc(rows: DataFrame, folder: str, version: int = 1, date: str = "20000101000000", compression: str = "gzip") -> None:
    """Write ``rows (key, url, mime, payload)`` as ARC files of ``version``, one for each task that has rows.

    ``payload`` is binary or text (null: empty); it stands behind an HTTP header that carries the key (null: no such line). White space in an
    address is escaped, a missing address is ``unknown:``. A table without rows gives no file or one without records.
    """
    payload = F.coalesce(F.col("payload").cast("string"), F.lit(""))
    key = F.col("key").cast("string")
    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: "), F.coalesce("mime", F.lit("application/octet-stream")),
        F.lit("\r\nContent-Length: "), F.octet_length(payload).cast("string"),
        F.coalesce(F.concat(F.lit(f"\r\n{KEY_HEADER}: "), key), F.lit("")), F.lit("\r\n\r\n"),
    )
    url = F.regexp_replace(F.coalesce("url", F.lit("unknown:")), r"[\x00-\x20\x7F]", "%20")
    length = (F.octet_length(http) + F.octet_length(payload)).cast("string")
    middle = {1: F.lit(""), 2: F.lit(" 200 - - 0 -")}[version]
    mime = F.regexp_replace(F.element_at(F.split(F.coalesce("mime", F.lit("no-type")), ";"), 1), r"\s", "")
    line = F.concat(url, F.lit(f" 0.0.0.0 {date} "), mime, middle, F.lit(" "), length, F.lit("\n"), http, payload)
    about = f"{version} 0 lanewise\n{ARC_FIELDS[version]}\n"
    more = {1: "", 2: " 200 - - 0 -"}[version]
    block = f"filedesc://lanewise.arc 0.0.0.0 {date} text/plain{more} {len(about)}\n{about}\n"
    out = rows.select(F.concat(F.when(_first_row(), block).otherwise(""), line).alias("value"))
    out.write.option("lineSep", "\n").option("compression", compression).option("maxRecordsPerFile", 0).mode("overwrite").text(folder)


def _stream(data: bytes) -> io.BufferedIOBase:
    return gzip.GzipFile(fileobj=io.BytesIO(data)) if data[:2] == b"\x1f\x8b" else io.BytesIO(data)


def _line(stream: io.BufferedIOBase) -> bytes:
    try:
        return stream.readline()
    except (EOFError, OSError, zlib.error):  # a damaged tail ends the archive
        return b""


def _block(stream: io.BufferedIOBase, length: int) -> tuple[bytes, bool]:
    """Up to ``length`` bytes, and whether there were fewer."""
    parts, left = [], length
    try:
        while left and (part := stream.read(min(left, 1 << 20))):
            parts.append(part)
            left -= len(part)
    except (EOFError, OSError, zlib.error):
        pass
    return b"".join(parts), left > 0


def _http(block: bytes) -> tuple[bytes | None, bytes, str | None]:
    """HTTP header (null if the block has none), payload and the key that the header carries."""
    if not block.startswith(b"HTTP/"):
        return None, block, None
    ends = [(k, len(mark)) for mark in (b"\r\n\r\n", b"\n\n") if (k := block.find(mark)) >= 0]
    if not ends:
        return block, b"", None
    at, size = min(ends)
    header, key = block[: at + size], None
    for line in header.splitlines()[1:]:
        name, _, value = line.partition(b":")
        if name.strip().lower() == KEY_HEADER.lower().encode():
            key = value.strip().decode("utf-8", "replace")
    return header, block[at + size :], key


def arc_records(stream: io.BufferedIOBase) -> Iterator[dict]:
    """Records of one ARC file. A line that is no header line of the file's version is passed over, up to the next one that is."""
    fields, version = ARC_FIELDS[1].split(), 1
    while True:
        at = stream.tell()
        line = _line(stream)
        if not line:
            return
        text = line.strip(b"\r\n")
        if text.startswith(b"filedesc:"):
            version = 2 if len(text.split(b" ")) >= len(ARC_FIELDS[2].split()) else 1
            fields = ARC_FIELDS[version].split()
        parts = text.rsplit(b" ", len(fields) - 1)  # an address may hold spaces, the other fields do not
        if len(parts) != len(fields) or not parts[-1].isdigit():
            continue
        head = dict(zip(fields, (p.decode("utf-8", "replace") for p in parts), strict=True))
        block, short = _block(stream, int(parts[-1]))
        if text.startswith(b"filedesc:"):
            lines = block.decode("utf-8", "replace").split("\n")
            own = lines[1].split() if len(lines) > 1 else []
            if own[:1] == ["URL"] and own[-1:] == ["Archive-length"]:  # the file says itself what its lines hold
                fields = own
            header, payload, key = None, block, None
        else:
            header, payload, key = _http(block)
        yield {
            "offset": at, "version": version, "url": head["URL"], "ip": head.get("IP-address"), "date": head.get("Archive-date"), "mime": head.get("Content-type"),
            "status": head.get("Result-code"), "header": header, "payload": payload, "key": key, "truncated": short,
        }


def warc_records(stream: io.BufferedIOBase) -> Iterator[dict]:
    """Records of one WARC file; what does not begin with a version line is passed over."""
    while True:
        at = stream.tell()
        line = _line(stream)
        if not line:
            return
        if not line.startswith(b"WARC/"):
            continue
        named: dict[str, str] = {}
        while (line := _line(stream)).strip(b"\r\n"):
            name, _, value = line.decode("utf-8", "replace").partition(":")
            named[name.strip().lower()] = value.strip()
        length = named.get("content-length", "")
        block, short = _block(stream, int(length) if length.isdigit() else 0)
        header, payload, key = _http(block)
        yield {
            "offset": at, "record_type": named.get("warc-type"), "record_id": named.get("warc-record-id"), "target_uri": named.get("warc-target-uri"), "date": named.get("warc-date"),
            "refers_to": named.get("warc-refers-to"), "headers": list(named.items()), "header": header, "payload": payload, "declared_digest": named.get("warc-payload-digest"), "key": key, "truncated": short,
        }


def _read(spark: SparkSession, folder: str, schema: str, records, payloads: bool) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    fields = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for batch in batches:
            for k in range(batch.num_rows):
                name = batch.column(0)[k].as_py().rsplit("/", 1)[-1]
                for r in records(_stream(batch.column(1)[k].as_py())):
                    r |= {"archive": name, "payload_bytes": len(r["payload"]), "payload_digest": hashlib.sha256(r["payload"]).hexdigest()}
                    if payloads:
                        held += len(r["payload"])
                    else:
                        r["payload"] = None
                    rows.append(r)
                    if held > HAND_OVER or len(rows) == 1_000:
                        yield pa.RecordBatch.from_pylist(rows, schema=fields)
                        rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=fields)

    return spark.read.format("binaryFile").load(folder).select("path", "content").mapInArrow(run, schema)


def read_arc(spark: SparkSession, folder: str, payloads: bool = True) -> DataFrame:
    """Records of the ARC files in ``folder``, version blocks included, with digest and size of each payload; without ``payloads`` that column is null."""
    return _read(spark, folder, ARC_SCHEMA, arc_records, payloads)


def read_warc(spark: SparkSession, folder: str, payloads: bool = True) -> DataFrame:
    """Records of the WARC files in ``folder``; digest and size are those of the payload as read, ``declared_digest`` the header's."""
    return _read(spark, folder, WARC_SCHEMA, warc_records, payloads)


def record_type() -> Column:
    """``metadata`` for a version block, ``response`` with an HTTP header, else ``resource``."""
    return F.when(F.col("url").startswith("filedesc:"), "metadata").when(F.col("header").isNotNull(), "response").otherwise("resource")


def record_id(archive: str, offset: str, url: str, date: str) -> Column:
    h = F.md5(F.concat_ws("\n", F.col(archive), F.col(offset).cast("string"), F.col(url), F.col(date)))
    part = lambda a, n: F.substring(h, a, n)
    return F.concat(F.lit("<urn:uuid:"), part(1, 8), F.lit("-"), part(9, 4), F.lit("-5"), part(14, 3), F.lit("-8"), part(18, 3), F.lit("-"), part(21, 12), F.lit(">"))


def iso_date(date: Column) -> Column:
    """ARC's 14 digits as an ISO date; shorter ones are filled up, other text is the epoch."""
    full = F.when(date.rlike(r"^[0-9]{4,17}$"), F.substring(F.concat(date, F.expr("substring('00000101000000', length(date) + 1)")), 1, 14)).otherwise("19700101000000")
    return F.regexp_replace(full, r"^(....)(..)(..)(..)(..)(..)$", "$1-$2-$3T$4:$5:$6Z")


def find_revisits(records: DataFrame, key_type: str, least: int = LEAST_BYTES) -> DataFrame:
    """``archive, offset, first_id, first_uri, first_date`` of each record whose payload an earlier one has, "earlier" by key, then by place.

    ``records`` is a written table without payloads. Only ``response`` records of ``least`` bytes take part; records without a key come last.
    """
    able = records.where((F.col("record_type") == "response") & (F.col("payload_bytes") >= least) & ~F.col("truncated"))
    able = able.withColumns({"own": F.col("key").cast(key_type), "id": record_id("archive", "offset", "url", "date"), "iso": iso_date(F.col("date"))})
    place = F.struct(F.col("own").isNull().alias("none"), "own", "archive", "offset", "url", "id", "iso")
    groups = able.groupBy("payload_digest").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("copies")).where("copies > 1")
    rows = able.select("archive", "offset", "payload_digest")
    found = join_copies(rows, cut_lineage(groups), "payload_digest")
    later = F.col("first").isNotNull() & ~((F.col("first.archive") == F.col("archive")) & (F.col("first.offset") == F.col("offset")))
    return found.where(later).select("archive", "offset", F.col("first.id").alias("first_id"), F.col("first.url").alias("first_uri"), F.col("first.iso").alias("first_date"))


def warc_text(records: DataFrame) -> Column:
    """A record's header and block as text, from the columns of ``read_arc`` with ``record_type`` and ``find_revisits``' columns."""
    revisit = F.col("first_id").isNotNull()
    header, payload = F.coalesce(F.col("header").cast("string"), F.lit("")), F.coalesce(F.col("payload").cast("string"), F.lit(""))
    block = F.when(revisit, header).otherwise(F.concat(header, payload))
    field = lambda name, value: F.coalesce(F.concat(F.lit(f"\r\n{name}: "), value), F.lit(""))
    kind = F.when(F.col("record_type") == "response", "application/http; msgtype=response").otherwise(F.coalesce("mime", F.lit("application/octet-stream")))
    return F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.when(revisit, "revisit").otherwise(F.col("record_type")),
        field("WARC-Record-ID", record_id("archive", "offset", "url", "date")), field("WARC-Date", iso_date(F.col("date"))), field("WARC-Target-URI", F.col("url")),
        field("WARC-IP-Address", F.when(F.col("ip") != "0.0.0.0", F.col("ip"))), field("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("payload_digest"))),
        field("WARC-Block-Digest", F.concat(F.lit("sha256:"), F.sha2(block, 256))), field("WARC-Truncated", F.when(F.col("truncated"), "unspecified")),
        field("WARC-Profile", F.when(revisit, REVISIT_PROFILE)), field("WARC-Refers-To", F.col("first_id")),
        field("WARC-Refers-To-Target-URI", F.col("first_uri")), field("WARC-Refers-To-Date", F.col("first_date")),
        field("Content-Type", kind), field("Content-Length", F.octet_length(block).cast("string")), F.lit("\r\n\r\n"), block,
    )


def convert(spark: SparkSession, arc_folder: str, warc_folder: str, key_type: str = "string", least: int = LEAST_BYTES, compression: str = "gzip") -> None:
    """Convert all ARC files of a folder to WARC files in another, each with a ``warcinfo`` record first.

    The archives are read twice: for digests, from which the revisits follow, and for the payloads. Payloads are shuffled once at most, by their own place, so
    that neither a group of copies nor an archive decides where they go. A payload that ends before its declared length is marked as truncated and never a revisit.
    """
    small = cut_lineage(read_arc(spark, arc_folder, payloads=False).withColumn("record_type", record_type()).drop("payload", "header"))
    revisits = cut_lineage(find_revisits(small, key_type, least))
    records = read_arc(spark, arc_folder).withColumn("record_type", record_type()).join(revisits, ["archive", "offset"], "left")
    about = "software: lanewise\r\nformat: WARC File Format 1.1\r\n"
    tag = F.md5(F.concat(F.lit(f"{warc_folder}/"), F.spark_partition_id().cast("string")))
    info = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:"), F.regexp_replace(tag, r"^(.{8})(.{4}).(...).(...)(.{12})$", "$1-$2-5$3-8$4-$5"),
        F.lit(f">\r\nWARC-Date: 1970-01-01T00:00:00Z\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(about)}\r\n\r\n{about}\r\n\r\n"),
    )
    out = records.select(F.concat(F.when(_first_row(), info).otherwise(""), warc_text(records)).alias("value"))
    out.write.option("lineSep", "\r\n\r\n").option("compression", compression).option("maxRecordsPerFile", 0).mode("overwrite").text(warc_folder)


def resolve(records: DataFrame, key_type: str = "string") -> DataFrame:
    """``key, payload_bytes, payload_digest, record_type, refers_to`` (the key of the record that a revisit names) of the responses and revisits.

    ``records`` are those of ``read_warc``; a revisit has size and digest of the payload it stands for, read where that payload is.
    """
    kept = cut_lineage(records.where("record_type in ('response', 'revisit')").select("record_type", "record_id", "refers_to", F.col("key").cast(key_type).alias("key"), "payload_bytes", "payload_digest"))
    revisits = kept.where("record_type = 'revisit'").select("refers_to", "key")
    named = revisits.groupBy("refers_to").agg(F.count(F.lit(1)).alias("copies"))
    full = kept.where("record_type = 'response'")
    first = full.select(F.col("record_id").alias("refers_to"), F.col("key").alias("of"), "payload_bytes", "payload_digest")
    back = join_copies(revisits, cut_lineage(first.join(named, "refers_to")), "refers_to")
    told = back.select("key", "payload_bytes", "payload_digest", F.lit("revisit").alias("record_type"), F.col("of").alias("refers_to"))
    return full.select("key", "payload_bytes", "payload_digest", "record_type", F.lit(None).cast(key_type).alias("refers_to")).unionByName(told)


def archive_pages(pages: DataFrame, folder: str | None = None, least: int = LEAST_BYTES) -> tuple[DataFrame, str]:
    """Pages through legacy archives into WARC files, and the records read back from them, with the folder that keeps the files.

    ``pages (page_id, url, html)``; half of them, by a hash of the address, go through ARC version 1, the others through version 2. Nulls: no html is an empty
    payload, no page_id comes last among equal payloads. Repeated rows are records of their own. Returns ``resolve``'s columns.
    """
    spark = pages.sparkSession
    folder = folder or archive_folder(spark)
    kind = pages.schema["page_id"].dataType.simpleString()
    rows = pages.select(F.col("page_id").alias("key"), "url", F.lit("text/html; charset=utf-8").alias("mime"), F.col("html").alias("payload"))
    half = F.coalesce(F.pmod(F.xxhash64("url"), F.lit(2)), F.lit(0))
    for version in (1, 2):
        write_arc(rows.where(half == version - 1), f"{folder}/arc/v{version}", version)
    convert(spark, f"{folder}/arc/*", f"{folder}/warc", kind, least)
    remove_folder(spark, f"{folder}/arc")
    return resolve(read_warc(spark, f"{folder}/warc", payloads=False), kind), f"{folder}/warc"
