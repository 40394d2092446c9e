"""WARC archives as a data source: written as one gzip member for each record, read back by byte ranges.

*Writing.* A task writes its rows to a file of its own, a new one whenever a
size is reached. Files get their names when the job commits, so a task may run
twice or be lost. Of records with equal payloads only one holds the payload;
the others are revisit records that name it.

*Reading.* An archive is cut into byte ranges without an index. A task looks
for gzip magic from its range's start, takes a place for a record if what
follows decodes to a WARC header, and owns the records that start inside its
range, wherever they end. So each record has one owner, for any cuts.

Defined results: null html is an empty payload; rows whose payload is short
are all responses; where several rows share the smallest page_id and a payload,
each of them is a response; a null page_id is larger than any other, and if a
group has no other, all are responses. Repeated rows give repeated records. A
record that can't be decoded gives a row with ``error`` and the reader goes on
at the next one; ``gaps`` finds stretches of a file that no record covers.
Control characters and blanks in addresses are percent-encoded. Other columns
are ignored. A record's payload has to fit in a task's memory.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from orograph.llm.common import scratch, scratch_root, utf8
from orograph.sources.files import locate

#: Bytes of an archive that a task reads, and bytes after which a task begins a new file.
SPLIT_BYTES, FILE_BYTES = 32 << 20, 1 << 30
#: Payloads shorter than this are stored each time.
LEAST_SHARED = 100
#: When the pages were fetched, if the table doesn't say.
DATE = "1970-01-01T00:00:00Z"

# Fixed values of the formats.
MAGIC = b"\x1f\x8b\x08"
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_END = b"\r\n\r\n"

_PIECE, _FEED, _HEAD = 1 << 22, 1 << 14, 1 << 16
_BATCH_BYTES = 8 << 20
#: All columns that can be asked for. ``payload_digest`` is what the record says, ``sha256`` is of the payload that was read.
COLUMNS = {
    "page_id": "long",
    "record_type": "string",
    "record_id": "string",
    "date": "string",
    "target_uri": "string",
    "payload_bytes": "long",
    "payload_digest": "string",
    "refers_to": "long",
    "refers_to_id": "string",
    "sha256": "string",
    "payload": "binary",
    "path": "string",
    "offset": "long",
    "end": "long",
    "error": "string",
}
_ARROW = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}


# --- writing ----------------------------------------------------------------


def _record_id(page_id: int | None, digest: str) -> str:
    """The same for the same page and payload, so that a revisit can name a record of another task."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'{page_id}:{digest}')}>"


def _address(url: str) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)


def _member(fields: list[tuple[str, object]], block: bytes) -> bytes:
    head = VERSION + b"\r\n" + b"".join(f"{k}: {v}\r\n".encode() for k, v in (*fields, ("Content-Length", len(block))) if v is not None)
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(head + b"\r\n" + block + _END) + packer.flush()


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, payload_bytes: int, refers_to: int | None, *, date: str = DATE) -> bytes:
    """A response record, or a revisit record if ``refers_to`` names a page; the latter keeps the headers alone."""
    revisit = refers_to is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {payload_bytes}\r\n\r\n".encode()
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", _record_id(page_id, digest)),
        ("WARC-Date", date),
        ("WARC-Target-URI", None if url is None else _address(url)),
        ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("WARC-Profile", PROFILE if revisit else None),
        ("WARC-Refers-To", _record_id(refers_to, digest) if revisit else None),
        ("X-Page-Id", page_id),
        ("X-Refers-To-Page-Id", refers_to),
        ("Content-Type", "application/http;msgtype=response"),
    ]
    return _member(fields, http if revisit else http + payload)


@dataclass
class _Written(WriterCommitMessage):
    files: list[tuple[str, str]]


class _Writer(DataSourceArrowWriter):
    def __init__(self, root: str, file_bytes: int, date: str):
        self.root, self.file_bytes, self.date = root.rstrip("/"), file_bytes, date

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        system, root = locate(self.root)
        system.create_dir(root, recursive=True)
        files, out, held = [], None, 0
        try:
            for b in iterator:
                for page, url, payload, digest, size, refers_to in zip(*(b.column(c) for c in ("page_id", "url", "payload", "digest", "payload_bytes", "refers_to")), strict=True):
                    if out is None or held >= self.file_bytes:
                        if out is not None:
                            out.close()
                        name = uuid.uuid4().hex
                        files.append((f"{root}/.{name}", f"{root}/{name}.warc.gz"))
                        out, held = system.open_output_stream(files[-1][0], compression=None), 0
                        fields = [("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", self.date), ("Content-Type", "application/warc-fields")]
                        out.write(_member(fields, b"format: WARC File Format 1.1\r\n"))
                    data = record(page.as_py(), url.as_py(), payload.as_py() or b"", digest.as_py(), size.as_py(), refers_to.as_py(), date=self.date)
                    out.write(data)
                    held += len(data)
        finally:
            if out is not None:
                out.close()
        return _Written(files)

    def commit(self, messages: list[_Written | None]) -> None:
        system, _ = locate(self.root)
        for m in messages:
            for draft, name in m.files if m else []:
                system.move(draft, name)

    def abort(self, messages: list[_Written | None]) -> None:
        system, _ = locate(self.root)
        for m in messages:
            for draft, _name in m.files if m else []:
                system.delete_file(draft)


# --- reading ----------------------------------------------------------------


class _Forward:
    """A file read in large pieces at rising places."""

    def __init__(self, source: pa.NativeFile):
        self.source, self.base, self.data = source, 0, b""

    def at(self, offset: int, n: int) -> bytes:
        """Up to ``n`` bytes from a place; none at the file's end."""
        if not self.base <= offset <= offset + n <= self.base + len(self.data):
            self.source.seek(offset)
            self.base, self.data = offset, self.source.read(max(n, _PIECE))
        return self.data[offset - self.base : offset - self.base + n]

    def find(self, offset: int, end: int) -> int | None:
        """The first place of gzip magic from ``offset`` on that is before ``end``."""
        while offset < end:
            piece = self.at(offset, min(_PIECE, end - offset + len(MAGIC) - 1))
            found = piece.find(MAGIC)
            if found >= 0:
                return offset + found
            offset += max(1, len(piece) - len(MAGIC) + 1)
        return None


def _header(data: bytes) -> tuple[dict[str, str], int] | None:
    """The fields of a record's header (names in lower case) and where its block begins, if the bytes begin with one."""
    stop = data.find(_END)
    if not data.startswith(b"WARC/") or stop < 0:
        return None
    lines = data[:stop].split(b"\r\n")[1:]
    fields = dict(x.decode("utf-8", "replace").split(":", 1) for x in lines if b":" in x)
    fields = {k.strip().lower(): v.strip() for k, v in fields.items()}
    return (fields, stop + len(_END)) if fields.get("content-length", "").isdigit() and "warc-type" in fields else None


def _intact(piece: bytes) -> bytes:
    """What a damaged member holds before the damage, up to a header's length."""
    unpack, out = zlib.decompressobj(31), b""
    try:
        while piece and len(out) < _HEAD:
            out += unpack.decompress(piece, 64)
            piece = unpack.unconsumed_tail
    except zlib.error:
        pass
    return out


def _decoded(source: _Forward, offset: int) -> tuple[dict[str, str], bytes, int, str | None] | None:
    """Fields, block, end and error of the record whose member starts here; None if none does."""
    unpack, at, parts, held, head = zlib.decompressobj(31), offset, [], 0, None
    try:
        while not unpack.eof:
            piece = source.at(at, _FEED)
            if not piece:
                break
            parts.append(unpack.decompress(piece))
            at, held = at + len(piece), held + len(parts[-1])
            if head is None and held >= 5:
                parts = [b"".join(parts)]
                head = _header(parts[0])
                if head is None and (not parts[0].startswith(b"WARC/") or held > _HEAD):
                    return None
    except zlib.error as e:
        head = head or _header(_intact(source.at(offset, _FEED)))
        return (head[0], b"", offset + 1, f"{e}") if head else None
    data = b"".join(parts)
    head = head or _header(data)
    if head is None:
        return None
    if not unpack.eof:
        return head[0], b"", offset + 1, "the file ends within the record"
    end, (fields, begins) = at - len(unpack.unused_data), head
    block = data[begins : begins + int(fields["content-length"])]
    return fields, block, end, None if data[begins + len(block) :] == _END else "the block is not as long as its header says"


def records(source: pa.NativeFile, start: int, end: int) -> Iterator[tuple[int, int, dict[str, str], bytes, str | None]]:
    """offset, end, fields, block and error of the records that start in [start, end)."""
    forward, at = _Forward(source), start
    while (at := forward.find(at, end)) is not None:
        found = _decoded(forward, at)
        if found is None:
            at += 1
            continue
        fields, block, stop, error = found
        yield at, stop, fields, block, error
        at = stop


def _row(path: str, at: int, stop: int, fields: dict[str, str], block: bytes, error: str | None, wanted: set[str]) -> dict:
    row = {
        "page_id": int(fields["x-page-id"]) if "x-page-id" in fields else None,
        "record_type": fields["warc-type"],
        "record_id": fields.get("warc-record-id"),
        "date": fields.get("warc-date"),
        "target_uri": fields.get("warc-target-uri"),
        "payload_digest": fields["warc-payload-digest"].rpartition(":")[2] if "warc-payload-digest" in fields else None,
        "refers_to": int(fields["x-refers-to-page-id"]) if "x-refers-to-page-id" in fields else None,
        "refers_to_id": fields.get("warc-refers-to"),
        "path": path,
        "offset": at,
        "end": stop,
        "error": error,
    }
    http = fields.get("content-type", "").startswith("application/http")
    head, gap, payload = block.partition(_END) if http else (b"", b"", block)
    said = re.search(rb"(?im)^content-length:\s*(\d+)", head)
    if fields["warc-type"] == "revisit":
        return row | {"payload_bytes": int(said[1]) if said else None}
    if not error and http and not gap:
        row["error"] = "no HTTP header"
    row |= {"payload_bytes": len(payload), "payload": payload}
    return row | {"sha256": hashlib.sha256(payload).hexdigest()} if "sha256" in wanted else row


@dataclass
class _Range(InputPartition):
    path: str
    start: int
    end: int


class _Reader(DataSourceReader):
    def __init__(self, root: str, split: int, schema: StructType):
        self.root, self.split, self.types = root, split, {f.name: f.dataType.simpleString().replace("bigint", "long") for f in schema}

    def partitions(self) -> list[_Range]:
        system, root = locate(self.root)
        found = system.get_file_info(root)
        files = [found] if found.is_file else system.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
        files = [f for f in files if f.is_file and f.base_name[0] not in "._" and f.base_name.endswith(".gz")]
        ranges = [_Range(f.path, at, min(at + self.split, f.size)) for f in files for at in range(0, f.size, self.split)]
        return ranges or [_Range("", 0, 0)]

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        system, _ = locate(self.root)
        schema = pa.schema([(n, _ARROW[t]) for n, t in self.types.items()])
        rows, held = [], 0
        if not partition.path:  # a folder without archives
            return
        with system.open_input_file(partition.path) as source:
            for at, stop, fields, block, error in records(source, partition.start, partition.end):
                row = _row(partition.path, at, stop, fields, block, error, set(self.types))
                rows.append({n: row.get(n) for n in self.types})
                held += len(block) if "payload" in self.types else 0
                if held > _BATCH_BYTES or len(rows) >= 2000:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)
                    rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=schema)


class WarcSource(DataSource):
    """``format("warc")``: a folder (or one file) of .warc.gz archives.

    A schema of some of ``COLUMNS`` limits what is built and handed over. Options
    are ``split_bytes`` for reading, ``file_bytes`` and ``date`` for writing.
    """

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return ", ".join(f"{c} {t}" for c, t in COLUMNS.items())

    def reader(self, schema: StructType) -> _Reader:
        return _Reader(self.options["path"], int(self.options.get("split_bytes", SPLIT_BYTES)), schema)

    def writer(self, schema: StructType, overwrite: bool) -> _Writer:
        return _Writer(self.options["path"], int(self.options.get("file_bytes", FILE_BYTES)), self.options.get("date", DATE))


def with_revisits(pages: DataFrame, *, least: int = LEAST_SHARED) -> DataFrame:
    """page_id, url, payload, payload_bytes, digest and refers_to (null for responses) of each page."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), utf8(F.col("html")).alias("payload"))
    rows = rows.select("*", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("digest"))
    shared = rows.where(F.col("payload_bytes") >= least).groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
    # a table of its own, so that the join can split a payload that very many pages share
    shared = scratch(shared.where("n > 1").select("digest", "first"), "shared-payloads")
    again = F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    return rows.join(shared, "digest", "left").select("page_id", "url", "payload", "payload_bytes", "digest", again.alias("refers_to"))


def write_archives(pages: DataFrame, root: str, *, least: int = LEAST_SHARED, file_bytes: int = FILE_BYTES) -> None:
    """Add archives with a record for each page to a folder that all executors share."""
    pages.sparkSession.dataSource.register(WarcSource)
    with_revisits(pages, least=least).write.format("warc").option("file_bytes", file_bytes).mode("append").save(root)


def read_archives(spark: SparkSession, root: str, *, columns: Iterable[str] = COLUMNS, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """The records of all archives in a folder, with the given columns."""
    spark.dataSource.register(WarcSource)
    return spark.read.format("warc").schema(", ".join(f"{c} {COLUMNS[c]}" for c in columns)).option("split_bytes", split_bytes).load(root)


def gaps(records: DataFrame) -> DataFrame:
    """path, offset, end of the stretches of each file that lie before a record and that no record covers."""
    earlier = F.coalesce(F.lag("end").over(Window.partitionBy("path").orderBy("offset")), F.lit(0))
    return records.select("path", earlier.alias("offset"), F.col("offset").alias("end")).where("offset <> end")


def through_archives(pages: DataFrame, *, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Write the pages to archives and read them back: page_id, payload_bytes, payload_digest, record_type, refers_to.

    The digest of a response is of the payload that was read; one that differs
    from what its record says, like any damaged record, is an error.
    """
    spark = pages.sparkSession
    root = f"{scratch_root(spark)}/archives-{uuid.uuid4().hex}"
    write_archives(pages, root)
    found = read_archives(spark, root, columns=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "sha256", "error"], split_bytes=split_bytes)
    wrong = F.coalesce(F.col("error"), F.when(F.col("sha256") != F.col("payload_digest"), F.lit("the payload's digest differs")))
    digest = F.when(wrong.isNotNull(), F.raise_error(wrong)).otherwise(F.col("payload_digest"))
    return found.where("record_type <> 'warcinfo'").select("page_id", "payload_bytes", digest.alias("payload_digest"), "record_type", "refers_to")


def oracle(least: int = LEAST_SHARED) -> str:
    return f"""
        WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
        g AS (SELECT *, CASE WHEN payload_bytes >= {least} THEN min(page_id) OVER (PARTITION BY payload_digest) END AS first FROM p)
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN first IS NULL OR page_id IS NOT DISTINCT FROM first THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to
        FROM g"""
